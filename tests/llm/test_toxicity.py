"""The toxicity models against a brute-force Kneser-Ney, and their sums."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import textblocks, toxicity

WORD = re.compile(r"[A-Za-z0-9_\x80-\U0010ffff]+")


def ascii_lower(x):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), x)


def hashed(words):
    return dict(zip(words, (textblocks.word_hashes(pa.array(list(words)), toxicity._LETTERS)[0] & np.uint64((1 << 48) - 1)).view(np.int64).tolist()))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = ["a", "the", "É", "x1", *(f"v{i}" for i in range(30))]
    texts = [" ".join(rng.choice(vocab[:4] if rng.random() < 0.5 else vocab) + rng.choice(["", "", "!", ", "]) for _ in range(rng.choice([0, 1, 3, 20, 60]))) for _ in range(60)]
    texts += [texts[-1]] * 30 + [None, "", "THE the The"]
    return [(t, int(i % 3 == 0)) for i, t in enumerate(texts)]


def brute(rows):
    lefts, texts, shared = collections.defaultdict(set), collections.Counter(), collections.defaultdict(set)
    for text, y in rows:
        words = WORD.findall(ascii_lower(text or ""))
        for a, b in zip([None, *words], words):
            lefts[b, y].add(a)
            shared[b].add((a, y))
        texts.update((w, y) for w in set(words))
    return {w: (len(s), *(min(len(lefts[w, y]), texts[w, y]) for y in (0, 1))) for w, s in shared.items()}


def test_counts_equal_brute_force(spark, rows):
    frame = spark.createDataFrame(rows, "text string, y int").repartition(5)
    got = {r["word"]: (r["shared"], *r["counts"]) for r in toxicity.word_counts(frame, np.zeros((1, toxicity.PAIRS), np.float32)).collect()}
    want = brute(rows)
    names = hashed(want)
    assert {names[w]: v for w, v in want.items()} == {w: v[:3] for w, v in got.items()} and not any(any(v[3:]) for v in got.values())


def test_probabilities_sum_to_one_and_rare_words_cancel(spark, rows):
    model = toxicity._counted(spark.createDataFrame(rows, "text string, y int"), np.zeros((1, toxicity.PAIRS), np.float32))
    want = brute(rows)
    table = np.array(list(want.values()), float)
    assert abs(model.p_shared(table[:, 0]).sum() + model.p_shared(0.0) - 1) < 1e-9
    names = hashed(want)
    kept = set(model.words.view(np.int64).tolist())
    for mass, share in enumerate(toxicity.MASSES):
        for y in (0, 1):
            c = table[:, 1 + y]
            d, total = model.discounts[mass, y], c.sum()
            assert model.totals[y] == total and abs(np.minimum(c, d).sum() - share * total) < 1e-6
            p = model.probability(y, table[:, 0], c, mass)
            plain = np.maximum(c - d, 0) / total + share * model.p_shared(table[:, 0])
            assert np.allclose(p, plain) and abs(p.sum() + share * model.p_shared(0.0) - 1) < 1e-9
    rare = [w for w, v in want.items() if names[w] not in kept]
    assert rare and all(v[1] <= model.discounts[0, 0] and v[2] <= model.discounts[0, 1] for w, v in want.items() if w in rare)
    # the difference of a text is its expressions' log-likelihoods
    text, mass = "the v1, a v2 the v1 unseen", 1
    words = WORD.findall(text)
    pairs = set(zip([None, *words], words))
    log = lambda w, y: np.log(model.probability(y, np.array(float(want.get(w, (0, 0, 0))[0])), np.array(float(want.get(w, (0, 0, 0))[1 + y])), mass))
    plain = sum(log(w, 1) - log(w, 0) for _, w in pairs)
    found, numbers = model.likelihoods(pa.array([text, "", None]), [mass])
    assert abs(found[0, 0] - plain) < 1e-9 and found[1:].tolist() == [[0], [0]] and numbers.tolist() == [len(pairs), 0, 0]


def test_discount_frees_the_mass():
    counts, times = np.array([1.0, 2.0, 10.0]), np.array([5.0, 3.0, 1.0])
    for mass in (0.3, 0.5, 0.8, 1.0):
        d = toxicity.discount(counts, times, mass)
        assert abs((np.minimum(counts, d) * times).sum() - mass * (counts * times).sum()) < 1e-9


def test_groups_keep_spellings_apart():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc ") for _ in range(300)) for _ in range(20)] + ["".join(rng.choice("xyz ") for _ in range(300)) for _ in range(20)]
    centres = toxicity.group_centres(toxicity.letter_pairs(pa.array(texts)), most=2)
    own = toxicity.groups_of(pa.array(texts), centres)
    assert len(set(own[:20])) == len(set(own[20:])) == 1 and own[0] != own[20]
    assert toxicity.letter_pairs(pa.array(["ab", "ba"])).sum() == toxicity.letter_pairs(pa.array(["ab"])).sum() + toxicity.letter_pairs(pa.array(["ba"])).sum()


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["idiot"] if i % 5 == 0 and rng.random() < 0.1 else [f"w{rng.randrange(200)}"]) for _ in range(50))) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("y", F.lit(1))
    got = [toxicity.score_toxicity(docs.repartition(n), labels).toPandas().sort_values("doc_id").score.to_numpy() for n in (2, 40)]
    assert np.allclose(*got)


def test_quality_scores_do_not_depend_on_partitions(spark):
    from tallyweave.llm import quality

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["!!", "buy"] if i % 4 == 0 and rng.random() < 0.3 else [f"w{rng.randrange(80)}"]) for _ in range(40))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [quality.score_quality(docs.repartition(n), labels).toPandas().sort_values("doc_id").score.to_numpy() for n in (2, 200)]
    assert np.allclose(*got, atol=1e-6)
