"""Shards, ball-tree clusters and the Merkle manifest against brute force, and their edge cases."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from tallyweave.llm import clusters, manifest, sharding

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, path string, root string, size string"


def docs_of(spark, rows):
    """(doc_id, text, lang) as documents, with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, g, "s" if (i or 0) % 2 else None, len(t) if t is not None else None, "x", "x", "x", "x") for i, t, g in rows], DOCS)


# --- shards


def check_shards(got, rows, shards):
    assert sorted((r["doc_id"] is None, r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((i is None, i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    slots = {}
    for r in got:
        assert 0 <= r["shard"] < shards and r["law"] == "bytes" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return {s: sum(r["size"] for r in got if r["shard"] == s) for s in range(shards)}


def test_shards_are_even_and_keep_groups(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abé ") for _ in range(rng.randint(0, 300))), "en") for i in range(3000)]
    rows += [(5000 + i, "copy " * 50, "en") for i in range(60)] + [(6000, None, None), (6001, "", None), (None, "null id", None), (7, rows[7][1], "en")]
    got = sharding.shard_documents(docs_of(spark, rows), 8).collect()
    load = check_shards(got, rows, 8)
    mean = sum(load.values()) / 8
    assert all(abs(x - mean) < 0.03 * mean for x in load.values())
    homes = {}
    for r in got:
        homes.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert all(len(x) == 1 for x in homes.values())
    again = sharding.shard_documents(docs_of(spark, rows[::-1]).repartition(7), 8).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_a_group_larger_than_a_shard_is_subdivided(spark):
    rows = [(i, "hot text", "en") for i in range(4000)] + [(10_000 + i, f"cold {i}", "en") for i in range(2000)] + [(1, "hot text", "en")] * 3000 + [(None, None, None)] * 500
    load = check_shards(sharding.shard_documents(docs_of(spark, rows), 8).collect(), rows, 8)
    mean = sum(load.values()) / 8
    assert all(abs(x - mean) < 0.03 * mean for x in load.values())


@pytest.mark.parametrize("rows", [[], [(1, "one", "en")], [(1, "x" * 100_000, "en"), (2, "y", "en"), (3, "z", None)], [(5, "same", "en")] * 3])
def test_few_records(spark, rows):
    check_shards(sharding.shard_documents(docs_of(spark, rows), 4).collect(), rows, 4)


def test_place_counts_bounds(spark):
    for bounds in ([], [5], [-3, 0, 4], list(range(0, 90, 3)), [-(1 << 63), (1 << 63) - 1]):
        rows = spark.range(-5, 100).select("id", sharding.place(sharding.F.col("id"), bounds).alias("at")).collect()
        assert all(r["at"] == sum(b <= r["id"] for b in bounds) for r in rows)


# --- clusters


def plain_clusters(rows):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(v) for _, v in first[:16]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(3):
        own = {}
        for _, v in kept:
            own.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(own[k]) for x in zip(*own[k])] if k in own else c for k, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    every = sum(d for *_, d in found)
    inertia = {k: sum(d for _, c, d in found if c == k) for k in range(len(centroids))}
    return [(i, k, d, inertia[k], every, hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, k, d in found]


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string, v string")


def blobs(rng, n, spread):
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(middles)]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.01, 0.4])
def test_clusters_equal_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(clusters, "TREE", 64)
    rng = random.Random(4)
    rows = blobs(rng, 300, spread)
    rows += [(1000 + i, rows[3][1]) for i in range(80)]  # a very common vector
    rows += [(2000, None), (2001, [1.0] * 63), (2002, [1.0] * 63 + [None]), (2003, [float("nan")] * 64), (2004, [float("inf")] * 64), (2005, []), (None, [0.5] * 64), (3, rows[3][1]), (2006, [-0.001] * 64)]
    got = [tuple(r) for r in clusters.cluster_vectors(vectors_of(spark, rows).repartition(3)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_clusters(rows)))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.25] * 64)], [(i % 2, [float(i % 2)] * 64) for i in range(40)]])
def test_few_vectors(spark, rows):
    got = [tuple(r) for r in clusters.cluster_vectors(vectors_of(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, plain_clusters(rows)))


def test_huge_components_are_held(spark):
    got = clusters.cluster_vectors(vectors_of(spark, [(1, [3e38] * 64), (2, [-3e38] * 64), (3, [1.0] * 64)])).collect()
    assert len(got) == 3 and all(r["distance"] == 0 for r in got)


def test_balls_are_assigned_whole_and_right():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-4, 5, (400, 64)) + 1000 * k for k in range(3)])
    order, tree = clusters.ball_tree(points)
    centroids = np.array([[0] * 64, [1000] * 64, [2000] * 64])
    balls, places, *_ = clusters.assign(tree | {"vectors": points[order]}, centroids)
    assert sum(int(tree["last"][n] - tree["first"][n]) for n, _ in balls) + len(places) == 1200 and len(balls) < 60 and len(places) < 100
    for node, k in balls:
        own = points[order][tree["first"][node] : tree["last"][node]]
        assert (clusters._squared(own, centroids).argmin(axis=1) == k).all()
        assert (tree["total"][node] == own.sum(axis=0)).all()
        assert np.sqrt(((own - tree["centre"][node]) ** 2).sum(axis=1)).max() <= tree["radius"][node] + 1e-9


# --- manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes, run):
    """The root, and per node its (before, after) from the bottom up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            own = at[k]
            a = own // run * run
            path.append(("".join(nodes[a:own]), "".join(nodes[own + 1 : a + run])))
        nodes = [sha(*nodes[a : a + run]) for a in range(0, len(nodes), run)]
        at = [x // run for x in at]
    return nodes[0], paths


def plain_manifest(rows, run=2):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, s, g, n, t: sha(*map(part, (i, s, g, n, t)))
    groups = {}
    for i, t, g in rows:
        s, n = "s" if (i or 0) % 2 else None, len(t) if t is not None else None
        tampered = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
        groups.setdefault(g, []).append((i, leaf(i, s, g, n, t), leaf(i, s, g, n + 1, t) if tampered else None))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = plain_tree([x[1] for x in groups[g]], run)
    root, above = plain_tree([trees[g][0] for g in names], run)
    out = []
    for g, top in zip(names, above):
        for (i, node, changed), path in zip(groups[g], trees[g][1]):
            folded = changed or node
            for before, after in path + top:
                folded = sha(before, folded, after)
            out.append((i, node, trees[g][0], root, sha(*[a + b for a, b in path + top]), folded, folded == root))
    return out


LANGS = [("en", 37), ("é", 1), (None, 8), ("", 3), ("zz", 16), ("a", 2)]


def some_documents():
    ids = itertools.count()
    rows = [(next(ids), f"text {k} é", g) for g, n in LANGS for k in range(n)]
    return rows + [(3, rows[3][1], "en"), (3, "other", "en"), (None, "nobody", "en"), (None, None, "zz"), (900, None, "en"), (901, "", "en"), (902, "x" * 70_000, None)]


def test_manifest_equals_brute_force(spark):
    rows = some_documents()
    got = [tuple(r) for r in manifest.manifest_proofs(docs_of(spark, rows).repartition(5)).collect()]
    want = plain_manifest(rows)
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {w[-1] for w in want} == {True, False}


def test_longer_runs(spark):
    rows = some_documents()
    leaves = docs_of(spark, rows).select("doc_id", "lang", manifest.row_digest(*[manifest.F.col(c) for c in manifest.FIELDS]).alias("node"))
    got = manifest.manifest(leaves, "lang", ["doc_id"], run=3).select("doc_id", "node", "root", manifest.proof_digest(manifest.F.col("path")).alias("proof"), manifest.folded(manifest.F.col("node"), manifest.F.col("path")).alias("folded")).collect()
    assert all(r["folded"] == r["root"] for r in got)
    want = [(w[0], w[1], w[3], w[4], w[3]) for w in plain_manifest(rows, 3)]
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))


@pytest.mark.parametrize("rows", [[], [(7, "one", "en")], [(7, "one", None)], [(1, "a", "x"), (1, "a", "x")], [(1, "a", "x"), (2, "b", "y"), (3, "c", None)]])
def test_few_leaves(spark, rows):
    got = [tuple(r) for r in manifest.manifest_proofs(docs_of(spark, rows)).collect()]
    assert sorted(map(str, got)) == (sorted(map(str, plain_manifest(rows))) if rows else [])
