"""Centroid clustering with ball trees: exact integer k-means that assigns whole balls where it can.

Vectors are cut to integers and packed into metric trees, each over at most TREE vectors of one
partition. A node stores its centre, radius, count and integer sum. In a round every tree meets the
few centroids: the triangle inequality drops the centroids that can't be the nearest of any vector in
a ball; a ball with one left is assigned whole by its count and sum, others descend, and leaves
compare their vectors exactly with the centroids left. Each task returns one sum a cluster. Trees are
written once and read by every round; vectors never shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.textblocks import cut

WIDTH, SCALE = 64, 64
CENTROIDS, ROUNDS = 16, 3
#: Vectors of a tree and of a leaf at most.
TREE, LEAF = 4096, 24
#: Components are held to this much, so that a squared distance fits a long.
LARGEST = 1 << 27
#: Above this much, products no longer fit a double exactly.
_EXACT = 1 << 22
_TREE = "ids binary, known binary, vectors binary, first binary, last binary, child binary, centre binary, radius binary, total binary"


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, v: floor(SCALE * x) of every component x; only vectors of WIDTH components, none null, NaN or infinite."""
    x = F.col("embedding").cast("array<double>")
    fine = (F.size(x) == WIDTH) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # held before flooring, as floor turns a double into a long
    cut_off = lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int")
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, cut_off).alias("v"))


def ball_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """An order of the points, and nodes over ranges of it, the root first: first, last, child (of two neighbours, or -1), centre, radius, total.

    A ball is halved at the median of its widest component; equal points are never parted.
    """
    order = np.arange(len(points))
    first, last, child, centre, radius, total = [0], [len(points)], [], [], [], []
    at = 0
    while at < len(first):
        a, b = first[at], last[at]
        own = points[order[a:b]]
        total.append(own.sum(axis=0))
        middle = total[-1] / (b - a)
        gaps = own - middle
        reach = float(np.sqrt((gaps * gaps).sum(axis=1).max()))
        centre.append(middle)
        radius.append(reach)
        wide = int(np.argmax(np.ptp(own, axis=0)))
        if b - a <= leaf or (own[:, wide] == own[0, wide]).all():
            child.append(-1)
        else:
            half = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, wide], half)]
            child.append(len(first))
            first += [a, a + half]
            last += [a + half, b]
        at += 1
    kinds = {"first": np.int32, "last": np.int32, "child": np.int32, "centre": np.float64, "radius": np.float64, "total": np.int64}
    return order, {k: np.array(v, kinds[k]) for k, v in zip(kinds, (first, last, child, centre, radius, total), strict=True)}


def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per tree over the vectors of a partition."""

    def grow(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
        order, nodes = ball_tree(points)
        known = ids.is_valid().to_numpy(zero_copy_only=False)[order]
        numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[order]
        row = {"ids": numbers, "known": known, "vectors": points[order].astype(np.int32), **nodes}
        return pa.RecordBatch.from_pydict({k: [v.tobytes()] for k, v in row.items()})

    ids, points, n = [], [], 0
    for batch in batches:
        flat = batch.column(1).flatten().to_numpy().reshape(-1, WIDTH)
        for a in range(0, batch.num_rows, TREE):
            part = flat[a : a + TREE].astype(np.int64)
            ids.append(batch.column(0)[a : a + TREE])
            points.append(part)
            n += len(part)
            while n >= TREE:
                every, all_ids = np.concatenate(points), pa.concat_arrays(ids)
                yield grow(all_ids[:TREE], every[:TREE])
                ids, points, n = [all_ids[TREE:]], [every[TREE:]], n - TREE
    if n:
        yield grow(pa.concat_arrays(ids), np.concatenate(points))


def _squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points and centroids, as long."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= _EXACT:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c * c).sum(axis=1)[None]).astype(np.int64)
    return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def assign(tree: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """Balls assigned whole as (node, centroid); and of the other vectors: their places, nearest centroids (ties: the smaller number) and squared distances."""
    live, left = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
    balls, places, nearest, squares = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    goal = centroids.astype(np.float64)
    while len(live):
        centre, radius = tree["centre"][live], tree["radius"][live]
        gaps = np.sqrt(((centre[:, None, :] - goal[None]) ** 2).sum(axis=2))
        slack = 1e-9 * (1 + gaps.max(initial=0.0) + radius)  # doubles are rounded
        best = np.where(left, gaps, np.inf).min(axis=1)
        left &= gaps - (radius + slack)[:, None] <= (best + radius + slack)[:, None]
        one = left.sum(axis=1) == 1
        balls += list(zip(live[one].tolist(), left[one].argmax(axis=1).tolist(), strict=True))
        live, left = live[~one], left[~one]
        leaf = tree["child"][live] < 0
        for node, mask in zip(live[leaf].tolist(), left[leaf], strict=True):
            at, few = np.arange(tree["first"][node], tree["last"][node]), np.flatnonzero(mask)
            square = _squared(tree["vectors"][at], centroids[few])
            which = square.argmin(axis=1)
            places.append(at)
            nearest.append(few[which])
            squares.append(square[np.arange(len(at)), which])
        down = tree["child"][live[~leaf]].astype(np.int64)
        live, left = np.concatenate([down, down + 1]), np.concatenate([left[~leaf], left[~leaf]])
    return balls, np.concatenate(places), np.concatenate(nearest), np.concatenate(squares)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    kinds = {"ids": np.int64, "known": bool, "vectors": np.int32, "first": np.int32, "last": np.int32, "child": np.int32, "centre": np.float64, "radius": np.float64, "total": np.int64}
    for batch in batches:
        for row in batch.to_pylist():
            tree = {k: np.frombuffer(row[k], kind) for k, kind in kinds.items()}
            for k in ("vectors", "centre", "total"):
                tree[k] = tree[k].reshape(-1, WIDTH)
            yield tree | {"vectors": tree["vectors"].astype(np.int64)}


def moved(trees: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after a round: the floor of the exact mean of each one's vectors; one without vectors stays."""
    goal = np.array(centroids, np.int64)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(goal), np.int64), np.zeros((len(goal), WIDTH), np.int64)
        for tree in _trees(batches):
            balls, places, nearest, _ = assign(tree, goal)
            for node, cluster in balls:
                counts[cluster] += tree["last"][node] - tree["first"][node]
                sums[cluster] += tree["total"][node]
            np.add.at(counts, nearest, 1)
            np.add.at(sums, nearest, tree["vectors"][places])
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(counts[some], pa.int64()), "sums": pa.array(sums[some].tolist(), pa.list_(pa.int64()))})

    each = trees.mapInArrow(gather, "cluster int, n long, sums array<long>")
    totals = each.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(k))).alias(f"s{k}") for k in range(WIDTH)])
    out = [list(c) for c in centroids]
    for row in totals.collect():  # a row per centroid
        out[row["cluster"]] = [row[f"s{k}"] // row["n"] for k in range(WIDTH)]
    return out


def assigned(trees: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance of every vector."""
    goal = np.array(centroids, np.int64).reshape(-1, WIDTH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree in _trees(batches):
            balls, places, nearest, squares = assign(tree, goal)
            cluster, distance = np.zeros(len(tree["ids"]), np.int32), np.zeros(len(tree["ids"]), np.int64)
            cluster[places], distance[places] = nearest, squares
            for node, k in balls:
                own = slice(tree["first"][node], tree["last"][node])
                cluster[own], distance[own] = k, _squared(tree["vectors"][own], goal[k : k + 1])[:, 0]
            yield pa.RecordBatch.from_arrays([pa.array(tree["ids"], pa.int64(), mask=~tree["known"]), pa.array(cluster), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, "vec_id long, cluster int, distance long")


def first_centroids(vectors: DataFrame, count: int = CENTROIDS) -> list[list[int]]:
    """The vectors with the least sha256 of "1:<vec_id>"; null ids last, equal ids by their components."""
    draw: Column = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [r["v"] for r in vectors.orderBy(draw.asc_nulls_last(), "v").limit(count).collect()]


def cluster(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance of quantised vectors (vec_id, v) after so many rounds, and the final centroids."""
    centroids = first_centroids(vectors, count)
    trees = cut(vectors.mapInArrow(plant, _TREE))
    if centroids:
        for _ in range(rounds):
            centroids = moved(trees, centroids)
    return assigned(trees, centroids), centroids


def cluster_vectors(embeddings: DataFrame) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Null vectors, vectors of another width and ones with a null, NaN or infinite component are left
    out. Components beyond LARGEST / SCALE count as that much. Equal vectors share a cluster; repeated
    rows each give one; with fewer vectors than centroids each begins as one. Null ids are kept and are
    the last to begin as a centroid. An empty table gives an empty result. Other columns are not read.
    """
    found, centroids = cluster(cut(quantised(embeddings)))
    found = cut(found)
    spark = embeddings.sparkSession
    names = spark.createDataFrame([(k, ",".join(map(str, c))) for k, c in enumerate(centroids)], "own int, components string")
    sums = found.groupBy(F.col("cluster").alias("of")).agg(F.sum("distance").alias("cluster_inertia"))
    whole = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    # a row per centroid: CENTROIDS at most
    facts = sums.join(names, F.col("own") == F.col("of")).select("of", "cluster_inertia", F.sha2(F.col("components").cast("binary"), 256).alias("centroid_sha256"), F.lit(whole.first()[0]).cast("long").alias("inertia"))
    return found.join(F.broadcast(facts), F.col("cluster") == F.col("of")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(k: int) -> str:
    return f"""
near{k} AS (
  SELECT v.row, v.v, arg_min(c.k, list_sum(list_transform(list_zip(v.v, c.c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) * {CENTROIDS} + c.k) AS k
  FROM kept v CROSS JOIN c{k} c GROUP BY v.row, v.v),
c{k + 1} AS (
  SELECT k, list(m ORDER BY place) AS c FROM (
    SELECT k, place, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m
    FROM (SELECT k, unnest(v) AS x, unnest(range({WIDTH})) AS place FROM near{k}) GROUP BY k, place) GROUP BY k
  UNION ALL SELECT k, c FROM c{k} WHERE k NOT IN (SELECT k FROM near{k}))"""


#: All distances of all rounds.
SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {WIDTH}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS k, v AS c FROM kept QUALIFY k < {CENTROIDS}),
{",".join(map(_round, range(ROUNDS)))},
done AS (
  SELECT row, vec_id, min(list_sum(list_transform(list_zip(v.v, c.c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) * {CENTROIDS} + c.k) AS best
  FROM kept v CROSS JOIN c{ROUNDS} c GROUP BY row, vec_id),
split AS (SELECT vec_id, CAST(best % {CENTROIDS} AS INT) AS cluster, CAST(best // {CENTROIDS} AS BIGINT) AS distance FROM done)
SELECT s.vec_id, s.cluster, s.distance, CAST(sum(s.distance) OVER (PARTITION BY s.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(s.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM split s JOIN c{ROUNDS} c ON c.k = s.cluster
"""
