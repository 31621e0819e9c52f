"""The training-data operators against brute force, the libraries they must equal, and edge cases."""

import collections
import hashlib
import itertools
import random
import re
import textwrap
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import exact_dedup, fingerprints, html_extract, jaccard_join, labelled, license_scan, mixing, piece_codec, quality, textblocks, token_counts, toxicity
from tallyweave.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def ascii_lower(x):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), x)


def make(spark, rows):
    """Documents with an extra column whose name clashes with results."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefghijé") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    rows, n = [], 0
    for base in range(25):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 60, 150]))]
        for _ in range(rng.choice([1, 1, 2, 9])):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((n, rng.choice([" ", "\n", "  "]).join(copy), rng.choice(["a", "b", "é", None])))
            n += 1
    rows += [(n, None, "a"), (n + 1, "", None), (n + 2, " \t ", "b"), (n + 3, "one", "a"), (n + 4, "ONE", "a"), (n + 5, "x y " * 8000, "b"), (None, "nobody", None), (n + 3, "one", "a")]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return make(spark, corpus).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


def test_word_hashes_equal_words_alone():
    texts = ["A b  c", None, "", "b a\tA c", "é " * 50]
    h, at = textblocks.word_hashes(pa.array(texts))
    words = [w for t in texts for w in WORD.findall(ascii_lower(t or ""))]
    assert len(words) == len(h) and at.tolist() == np.cumsum([0] + [len(WORD.findall(t or "")) for t in texts]).tolist()
    assert len(dict(zip(words, h.tolist()))) == len(set(zip(words, h.tolist())))


def test_exact_dedup_equals_sql(docs, corpus):
    got = exact_dedup.exact_dedup(docs).toPandas()
    documents = pd.DataFrame(corpus, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})  # noqa: F841
    want = duckdb.sql(exact_dedup.SQL).df()
    key = lambda d: sorted(map(str, d[["doc_id", "keep_id", "group_size", "kept", "text_sha256"]].astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert [re.sub(r"\.0|<NA>|nan", "", x) for x in key(got)] == [re.sub(r"\.0|<NA>|nan", "", x) for x in key(want)]
    assert got.groupby("text_sha256").kept.sum().eq(1).all()


def test_exact_dedup_empty_and_rows(spark, docs, empty):
    assert exact_dedup.exact_dedup(empty).count() == 0
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns and left.count() == exact_dedup.exact_dedup(docs).where("kept").count()


def test_cuckoo_index_inserts_deletes_and_grows():
    index, live, rng = exact_dedup.CuckooIndex(8), {}, random.Random(1)
    digests = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(3000)]
    for _ in range(20_000):
        d = rng.choice(digests)
        if rng.random() < 0.6:
            index.insert(d, 1, 1)
            live[d] = live.get(d, 0) + 1
        else:
            index.delete(d, 1)
            live[d] = live.get(d, 0) - 1
            if live[d] <= 0:
                del live[d]
    assert index.resizes > 0 and {d: n for d, _, n in index.rows()} == live
    assert all((index.find(d) is not None) == (d in live) for d in digests)


def test_index_changes(spark):
    keyed = lambda ids: spark.createDataFrame([(i, hashlib.sha256(str(i % 7).encode()).hexdigest()) for i in ids], "doc_id long, digest string")
    index = exact_dedup.build_index(keyed(range(20)), 4)
    after = exact_dedup.apply_changes(index, keyed([100, 101]), keyed([3, 10, 17]), 4)
    counts = collections.Counter(hashlib.sha256(str(i % 7).encode()).hexdigest() for i in [*range(20), 100, 101] if i not in (3, 10, 17))
    assert {r["digest"]: r["n"] for r in after.collect()} == counts


def brute_components(corpus, k, num, den):
    sets = []
    for _, t, _ in corpus:
        w = WORD.findall(ascii_lower(t or ""))
        sets.append(frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i in range(len(sets)):
        groups[find(i)].append(corpus[i][0])
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return sorted(((corpus[i][0], len(s), least[find(i)]) for i, s in enumerate(sets)), key=str)


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80), (2, 50)])
def test_jaccard_join_equals_brute_force(docs, corpus, k, num):
    got = jaccard_join.near_components(docs, k, num, 100).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(corpus, k, num, 100)


def test_jaccard_join_large_near_copies(spark):
    """One cluster of many different near copies: more members than a comparing group holds."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(90)] = f"z{rng.randrange(10_000)}"
        rows.append((i, " ".join(words), "a"))
    kept, jaccard_join.GROUP = jaccard_join.GROUP, 16
    try:
        got = jaccard_join.near_components(make(spark, rows), 4, 85, 100).collect()
    finally:
        jaccard_join.GROUP = kept
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows, 4, 85, 100)


@pytest.mark.parametrize("split", [1, 5, 40])
def test_jaccard_join_divided_ngrams(spark, monkeypatch, split):
    """Postings of frequent n-grams in several parts: near copies of three texts, chains of small changes, and repeated rows."""
    rng = random.Random(split)
    rows = []
    for base in range(3):
        words = [f"w{rng.randrange(60)}" for _ in range(50)]
        for i in range(40):
            if i % 4 == 0:
                words[rng.randrange(50)] = f"z{rng.randrange(1000)}"
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(50)] = f"y{rng.randrange(1000)}"
            rows += [(len(rows) + j, " ".join(copy), "a") for j in range(1 + (i % 9 == 0))]
    want = brute_components(rows, 4, 85, 100)
    monkeypatch.setattr(jaccard_join, "SPLIT", split)
    monkeypatch.setattr(jaccard_join, "GROUP", 16)
    measure = jaccard_join._order

    def divided(sets):
        place, fragment, parts = measure(sets)
        assert parts.max() > 1 or split > 20  # the mean of a sparse table is near 0
        return place, fragment, parts

    monkeypatch.setattr(jaccard_join, "_order", divided)
    got = jaccard_join.near_components(make(spark, rows).repartition(3), 4, 85, 100).collect()
    assert sorted((tuple(r) for r in got), key=str) == want


def test_jaccard_join_empty(empty):
    assert jaccard_join.near_components(empty).count() == 0
    assert jaccard_join.drop_near_copies(empty).columns == empty.columns


def test_mixing_meets_targets(docs, empty, corpus):
    got = mixing.mix_sources(docs).toPandas()
    assert mixing.mix_sources(empty).count() == 0
    sizes = collections.Counter()
    for _, t, s in corpus:
        sizes[s] += len(WORD.findall(t or ""))
    weight = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), itertools.cycle([5, 2, 1])))
    target, full = {}, set()
    while True:  # shares by weight, what is over the cap shared again
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in sizes}
        over = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    for r in got.itertuples():
        source = r.source if isinstance(r.source, str) else None
        assert r.target == pytest.approx(target[source]) and r.source_size == sizes[source] and r.taken == r.size * r.copies and 0 <= r.copies <= 2
    for source, rows in got.groupby(got.source.fillna("null")):
        assert abs(rows.taken.sum() - rows.target.iloc[0]) <= rows["size"].max()
    again = mixing.mix_sources(docs.repartition(7)).toPandas()
    order = lambda d: sorted(d[["doc_id", "size", "copies"]].fillna(-1).itertuples(index=False, name=None))
    assert order(got) == order(again) and len(got) == len(corpus)
    assert mixing.mixed(docs).count() == got.copies.sum()


def test_fights_keep_words(spark):
    rows = spark.range(500).selectExpr("id AS doc_id", "'s' AS source", "1 + id % 97 AS size", "0.37D AS p")
    out = mixing.pivotal_round(rows, [[F.col("source"), F.pmod(F.xxhash64("doc_id"), F.lit(9))], [F.col("source")]], [F.col("source")]).toPandas()
    assert len(out) == 500 and set(out.copies) == {0, 1}
    assert abs((out["size"] * out.copies).sum() - 0.37 * out["size"].sum()) <= 50


ODD = [None, "", " ", "  a", "a  b   ", "▁x▁▁y", "a▁b", "\x00a", "\n\n\t  x", "é" * 700, "a" * 3000, " " * 1500 + "b", "日本語テキスト😀🏽", "http://" + "x." * 300, "<s></s><unk><0x41>", "the" * 600, "​﻿ x", "ﬁ Ａ"]


def odd_texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice(" ab\n▁1the.é漢😀") for _ in range(rng.randint(1, 400))) for _ in range(60)]


def test_codec_equals_library(spark, empty):
    import sentencepiece

    library, texts = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path()), odd_texts()
    got = piece_codec.encode_decode(make(spark, [(i, t, "a") for i, t in enumerate(texts)]), tokenizer_path()).collect()
    want = library.encode([t or "" for t in texts])
    assert {r["doc_id"]: list(r["ids"]) for r in got} == dict(enumerate(want))
    assert {r["doc_id"]: r["decoded"] for r in got} == dict(enumerate(library.decode(want)))
    assert piece_codec.codec_digests(empty, tokenizer_path()).count() == 0


def test_long_words_equal_library():
    import sentencepiece

    library, model, rng = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path()), piece_codec.load(tokenizer_path()), random.Random(6)
    bits = ["ab", "the", "01", "aeiou", "./:-_", "éàü", "日本", "ing", "tion", "aaaa", "http", "www", "😀"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(520, 4000))) for some in (rng.sample(bits, rng.randint(1, 5)) for _ in range(40))]
    texts += ["a" * 200_000, "".join(rng.choice(bits) for _ in range(30_000))]
    for text in texts:
        assert model.encode([text])[0].tolist() == library.encode(text)
    assert model._unsafe  # there are pieces whose merges have to be watched


def test_decode_of_any_ids_equals_library():
    import sentencepiece

    library, model, rng = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path()), piece_codec.load(tokenizer_path()), random.Random(2)
    lists = [[rng.randrange(3, 259) if rng.random() < 0.5 else rng.randrange(32_000) for _ in range(30)] for _ in range(100)]
    flat = np.array(sum(lists, []), np.int32)
    assert model.decode(flat, np.arange(0, len(flat) + 1, 30)).to_pylist() == library.decode(lists)


@pytest.mark.parametrize("chunk,overlap", [(16_384, 128), (200, 8), (64, 2)])
def test_token_counts_equal_library(chunk, overlap):
    import sentencepiece

    library, counter = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path()), token_counts.Counter(tokenizer_path(), chunk, overlap)
    for text in [*odd_texts(), "word and " * 4000, "a" * 60_000, "ab" * 20_000 + " " + "a" * 5000]:
        assert counter.long(text or "") == len(library.encode(text or ""))
    assert chunk > 1000 or counter.widened > 0


def test_token_counts_rows(docs, empty, corpus):
    got = {(r["doc_id"], r["n_bytes"]) for r in token_counts.token_counts(docs, tokenizer_path()).collect()}
    assert got == {(i, len((t or "").encode())) for i, t, _ in corpus}
    assert token_counts.token_counts(empty, tokenizer_path()).count() == 0


def test_fingerprints_of_edited_texts(docs, corpus, empty):
    got = fingerprints.edited_fingerprints(docs).collect()
    order = sorted(corpus, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = collections.Counter()
    for a, b in zip(order, order[1:] + order[:1]):
        x, y = a[1] or "", b[1] or ""
        want[a[0], len(x), hashlib.sha256((x[: len(x) - len(x) // 3] + y[: len(x) // 3]).encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and len(r["fingerprint"]) == 32 for r in got)
    assert fingerprints.edited_fingerprints(empty).count() == 0


def test_radius_search_equals_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(128) for _ in range(20)]
    values = [b ^ sum(1 << k for k in rng.sample(range(128), rng.randrange(9))) for b in base for _ in range(10)]
    df = spark.createDataFrame([(bytearray(v.to_bytes(16, "big")),) for v in values] + [(None,)], "fp binary")
    got = {(bytes(r["query"]), bytes(r["entry"]), r["distance"]) for r in fingerprints.within_radius(df, df.limit(30), 6).collect()}
    queries = [bytes(r["fp"]) for r in df.limit(30).collect()]
    number = lambda x: int.from_bytes(x, "big")
    want = {(q, v.to_bytes(16, "big"), (number(q) ^ v).bit_count()) for q in queries for v in values if (number(q) ^ v).bit_count() <= 6}
    assert got == want


def labelled_corpus(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        words, toxic, low = [rng.choice(vocab) for _ in range(60)], rng.random() < 0.2, rng.random() < 0.3
        for _ in range(3 if toxic else 0):
            words[rng.randrange(60)] = rng.choice(["idiot", "scum"])
        rows.append((i, " ".join(f"{w}!!" if low else w for w in words), "a"))
        labels.append((i, int(not low), int(toxic)))
    return make(spark, [*rows, (5000, None, "a"), (5001, "", "a"), (None, "w1", None)]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,score,label,parts,out", [(toxicity, "score_toxicity", "toxic", 4, 2), (quality, "score_quality", "quality", 5, 0)])
def test_classifiers_on_held_out_rows(spark, empty, module, score, label, parts, out):
    docs, labels = labelled_corpus(spark)
    got = getattr(module, score)(docs, labels).toPandas()
    assert len(got) == 1503 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    known = got.dropna(subset=["doc_id"])
    assert (known.held_out == [zlib.crc32(str(int(i)).encode()) % parts == out for i in known.doc_id]).all()
    met = known.merge(labels.toPandas(), on="doc_id")
    held = met[met.held_out]
    assert (held.predicted == held[label]).mean() > 0.97
    # labels of the held-out fold change nothing
    flipped = labels.withColumn(label, F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts)) == out, 1 - F.col(label)).otherwise(F.col(label)))
    again = getattr(module, score)(docs, flipped).toPandas()
    assert np.allclose(got.sort_values("doc_id").score, again.sort_values("doc_id").score)
    assert getattr(module, score)(empty, labels).count() == 0
    assert getattr(module, score)(docs, labels.limit(0)).count() == 1503


def test_toxic_rows_go_and_columns_stay(spark):
    docs, labels = labelled_corpus(spark)
    left = toxicity.drop_toxic(docs, labels)
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    ids = {r["doc_id"] for r in left.collect()}
    assert left.columns == docs.columns and len(ids & toxic) <= 0.03 * len(toxic) and len(set(range(1500)) - toxic - ids) <= 15


def test_bound_of_labelled_rows(spark):
    docs, labels = labelled_corpus(spark)
    assert 100 < labelled.labelled_texts(docs, labels, "toxic", F.lit(True), 200).count() < 320


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>A title</h1><p>First &amp; <b>bold</b> text<br>goes on and on with many words.<p>Second\n  block, unclosed <i>tags.</p><script>var x = "<p>no</p>";</script><div class="ad">Buy</div></article>
<div id="comments"><p>Nice post</p></div><form><label>Mail</label></form><footer>&copy; us</footer></body></html>"""


def test_html_main_text(spark):
    want = "A title First & bold text goes on and on with many words. Second block, unclosed tags."
    assert html_extract.main_text(PAGE) == want
    plain = "<div>" + "".join(f"<p>{'word ' * 40}{i}</p>" for i in range(3)) + "</div><aside>side</aside>"
    assert html_extract.main_text(plain) == " ".join("word " * 40 + str(i) for i in range(3))
    odd = ["", None, "<", "<p", "<p>a</b></p></div>", "&#x110000; &bogus; <![CDATA[x]]> <!-- ", "<nav>only</nav>", "<p>" * 500 + "deep"]
    rows = spark.createDataFrame([(i, "u", h, "x") for i, h in enumerate([PAGE, *odd])], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract_pages(rows).collect()}
    assert got[0]["text"] == want and got[0]["n_chars"] == len(want) and got[1]["text"] == "" and got[2]["text"] == "" and got[7]["text"] == "" and got[5]["text"] == "a"
    assert html_extract.extract_pages(rows.limit(0)).count() == 0


def test_gaussian_keeps_constants():
    assert np.allclose(html_extract.smoothed(np.full(9, 2.5)), 2.5)


def test_license_scan(spark, empty):
    texts = [
        "prose\nReleased under the MIT License.\nmore", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "licensed under the Apache license, version 2.0",
        "This work is licensed under the GNU General Public License, version 3.", "This work is licensed under the GNU General Public License, version 2.",
        "My driving license expired and nobody cares about it at all today.", "", None, "long " * 5000 + ". Released under the MIT License. " + "tail " * 500, "Licensed under the Apache License, Version 7.0.",
    ]
    got = license_scan.scan_licenses(make(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()
    assert {r["doc_id"]: r["license"] for r in got} == {0: "MIT", 1: "CC-BY-NC-4.0", 2: "CC-BY-4.0", 3: "Apache-2.0", 4: "GPL-3.0", 5: "GPL-2.0", 9: "MIT"}
    assert all(r["with_template_bytes"] < r["plain_bytes"] for r in got)
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_every_phrase_is_found(spark):
    prose = "The river was high and the boats stayed in the harbour for another week. "
    cases = [(name, phrase) for name, phrases in license_scan.TEMPLATES.items() for phrase in phrases]
    assert all(list(license_scan.candidate_runs(phrase)) for _, phrase in cases)
    texts = [phrase for _, phrase in cases] + [prose * 2 + phrase.rstrip(".") + ". " + prose * 2 for _, phrase in cases]
    texts += ["Released under the MIT License. Licensed under CC BY 4.0.", "Er kam mit dem Zug. The gnu is an animal. An apache helicopter."]
    got = license_scan.scan_licenses(make(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()
    n = len(cases)
    assert {(r["doc_id"] % n, r["license"]) for r in got if r["doc_id"] < n} == {(i, name) for i, (name, _) in enumerate(cases)}
    assert {(r["doc_id"] - n, r["license"]) for r in got if n <= r["doc_id"] < 2 * n} == {(i, name) for i, (name, _) in enumerate(cases)}
    assert sorted((r["doc_id"] - 2 * n, r["license"]) for r in got if r["doc_id"] >= 2 * n) == [(0, "CC-BY-4.0"), (0, "MIT")]
    assert all(texts[r["doc_id"]][r["start"] : r["start"] + r["n_chars"]].strip() for r in got)


def test_license_files_and_names(spark):
    wrap = lambda text: "\n".join(textwrap.wrap(text, 72))
    conditions = license_scan._BSD.replace("Redistributions of", "1. Redistributions of").replace("Redistributions in", "2. Redistributions in")
    mit = "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + wrap(license_scan._MIT)
    bsd = "Copyright 2019 Foo Inc.\n\n" + wrap(conditions)
    files = [("MIT", mit), ("BSD-2-Clause", f"{bsd}\n\n{wrap(license_scan._BSD_END)}"), ("BSD-3-Clause", f"{bsd}\n3. {license_scan._BSD_NAMES}\n\n{wrap(license_scan._BSD_END)}"), ("ISC", "ISC License\n\nCopyright (c) 2020 Jane Doe\n\n" + wrap(license_scan._ISC))]
    named = [
        ("MIT", "Released under the MIT License, see LICENSE for details."), ("MIT", "This software is released under the MIT License and copyright 2020 Jane Doe."), ("MPL-2.0", "Licensed under the Mozilla Public License 2.0"),
        ("CC-BY-4.0", "All content is licensed under CC BY 4.0 unless noted otherwise."), ("GPL-3.0", "Code is licensed under GPLv3."), ("BSD-3-Clause", "BSD 3-clause license"), ("MIT OR Apache-2.0", "Dual licensed under MIT or Apache-2.0"),
    ]
    none = ["License", "the License", "I got a license. Copyright law is hard.", "It was licensed under MIT-like terms.", "Licensed under the Apache License, Version 7.0."]
    texts = [t for _, t in files + named] + none
    got = license_scan.scan_licenses(make(spark, [(i, f"The boats stayed in the harbour.\n\n{t}\n\nThe boats left again.", "a") for i, t in enumerate(texts)])).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == [(i, name) for i, (name, _) in enumerate(files + named)]
    whole = {r["doc_id"]: r for r in got}
    assert all(whole[i]["start"] == 34 and whole[i]["n_chars"] == len(text) and whole[i]["differing_words"] <= 4 for i, (_, text) in enumerate(files))


def test_license_alignment_equals_all_spans():
    rng = random.Random(8)

    def distance(a, b):  # insertions and deletions
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(before[j - 1] if x == y else 1 + min(before[j], row[-1]))
        return row[-1]

    for _ in range(60):
        block, phrase = ([rng.randrange(4) for _ in range(rng.randint(1, 7))] for _ in range(2))
        rows = license_scan.alignments(block, np.array(phrase))
        for i in range(len(block) + 1):
            assert rows[i].min() == min(distance(block[:i], phrase[a:b]) for a in range(len(phrase) + 1) for b in range(a, len(phrase) + 1))
        lone = license_scan.left_over(rows, block, phrase)
        assert len(lone) == rows[-1].min()
