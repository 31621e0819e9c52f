"""SimHash bits and FTRL weights against plain loops that share no code with them but the word hashes."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest

from tallyweave.llm import fingerprints, quality, textblocks

ALL = (1 << 64) - 1


def finish(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & ALL
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & ALL
    return x ^ (x >> 31)


def words_of(text, **how):
    return [int(h) for h in textblocks.word_hashes(pa.array([text]), **how)[0]]


def plain_simhash(text):
    words = words_of(text or "")
    if not words:
        return bytes(16)
    terms = collections.Counter()
    if len(words) < 5:
        whole = 0
        for place, word in enumerate(words, 1):
            whole ^= finish((word + place) & ALL)
        terms[whole >> 20] = 1
    for i in range(len(words) - 4):
        term = words[i]
        for k in range(1, 5):
            term = finish((term * 0x9E3779B97F4A7C15 + words[i + k] + k) & ALL)
        terms[term >> 20] += 1
    votes = [0] * 128
    for term, count in terms.items():
        weight, seed = 1 + int(math.log2(count)), finish(term)
        bits = b"".join(finish((seed + k) & ALL).to_bytes(8, "little") for k in (1, 2))
        for i in range(128):
            votes[i] += weight if bits[i // 8] >> (7 - i % 8) & 1 else -weight
    return bytes(sum((votes[8 * i + k] > 0) << (7 - k) for k in range(8)) for i in range(16))


def test_simhash_bits_equal_a_vote_loop():
    rng = random.Random(3)
    texts = [None, "", " \t", "one", "One two", "a b c d", "a b c d e", "x " * 300, "A b  C d e f"]
    texts += [" ".join(rng.choice("abcdefé") * rng.randint(1, 2) for _ in range(rng.choice([6, 30, 400]))) for _ in range(60)]
    got = [x.tobytes() for x in fingerprints.simhash(pa.array(texts, pa.string()))]
    assert got == [plain_simhash(t) for t in texts]
    assert [x.tobytes() for x in fingerprints.simhash(pa.array(texts[3:4], pa.string()))] == got[3:4]


def plain_features(text):
    """slot: value, of a text's words and word pairs and the constant."""
    words = words_of(text, classes=textblocks.WORDS_AND_MARKS, lower=False)
    counts = collections.Counter(max(w >> (64 - quality.BITS), 1) for w in words)
    for a, b in zip(words, words[1:]):
        pair = finish(5) if a == b else finish((a * 3 + b) & ALL)
        counts[max(pair >> (64 - quality.BITS), 1)] += 1
    norm = math.sqrt(sum(counts.values()))
    return {0: 1.0} | {slot: math.sqrt(n) / norm for slot, n in counts.items()}


def plain_ftrl(rows):
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(slot):
        if abs(z[slot]) <= quality.L1:
            return 0.0
        return -math.copysign(abs(z[slot]) - quality.L1, z[slot]) / ((quality.BETA + math.sqrt(n[slot])) / quality.ALPHA + quality.L2)

    for text, y in rows:
        x = plain_features(text)
        w = {slot: weight(slot) for slot in x}
        p = 1 / (1 + math.exp(-max(-30, min(30, sum(w[s] * v for s, v in x.items())))))
        for slot, v in x.items():
            g = (p - y) * v
            sigma = (math.sqrt(n[slot] + g * g) - math.sqrt(n[slot])) / quality.ALPHA
            z[slot] += g - sigma * w[slot]
            n[slot] += g * g
    return {slot: weight(slot) for slot in z}


def test_ftrl_weights_equal_a_plain_loop():
    rng = random.Random(5)
    rows = [(" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))) + (" good, fine" if y else " bad"), y) for y in (rng.randrange(2) for _ in range(200))]
    slots, values, at = quality.features(pa.array([t for t, _ in rows]))
    model = quality.Ftrl(np.zeros(quality.WIDTH, np.float32))
    for i, (text, y) in enumerate(rows):
        own = plain_features(text)
        assert dict(zip(slots[at[i] : at[i + 1]].tolist(), values[at[i] : at[i + 1]].tolist())) == pytest.approx(own)
        model.update(slots[at[i] : at[i + 1]], values[at[i] : at[i + 1]], float(y))
    want = plain_ftrl(rows)
    got = model.weights(slice(None))
    assert set(np.flatnonzero(got)) == {s for s, w in want.items() if w} and len(want) > 20
    assert all(got[s] == pytest.approx(w) for s, w in want.items())
    dots = quality.products(pa.array([t for t, _ in rows]), got)
    assert dots.tolist() == pytest.approx([sum(want.get(s, 0.0) * v for s, v in plain_features(t).items()) for t, _ in rows], abs=1e-9)
