"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source should be copied target / source size times. The whole part is taken
outright; the fractional parts are rounded together: pairs of documents fight, words move at random
from one to the other until one of them is copied 0 or 1 times, and the other goes on. Documents are
dealt to blocks by source, size class and hash; each block leaves one residual; residuals meet again
in ever fewer blocks (a reduction tree) until each size class of a source has one left, and these
few are settled together. Fights keep the sum of words; only settling, bounded by the smallest
residual, moves it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.textblocks import cut

#: Documents that fight in one block, on average at most; the fan-in of the tree.
BLOCK = 96
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 20240607
_EPS = 1e-9


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target of sizes (source, size).

    Sources in code point order, null last, weigh 5, 2, 1 repeating. They share SHARE of all sizes
    by weight; a target stops at MOST times its source's size and the excess is shared again. That
    fixed point is target = min(cap, level * weight): sources are filled in order of cap / weight.
    This works on one row per source.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = each.withColumn("turn", F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS)))).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("turn").cast("int") + 1))
    whole = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_rows = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * MOST
    level = (F.sum("source_size").over(all_rows) * SHARE - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(after)
    filled = ranked.withColumn("cap", cap).withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    last = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return filled.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(last["level"] * F.col("weight")).alias("target"))


def _chance(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _fight(items: Column, round_: int) -> Column:
    """Of an array of items (p in (0, 1)) in order: done, the (at, copies) that became whole, and the residual's at and p.

    Two fractions p, q of sizes s, t fight: words move from one to the other, either way with the
    chance that keeps both expectations, until one is 0 or 1. p * s + q * t stays as it was.
    """

    def step(acc: Column, at: Column) -> Column:
        me, other = F.get(items, acc["at"]), F.get(items, at)
        p, q, s, t = acc["p"], other["p"], me["size"], other["size"]
        most_up, most_down = F.least((1 - p) * s, q * t), F.least(p * s, (1 - q) * t)
        up = _chance(me["doc_id"], other["doc_id"], F.lit(round_), at) * (most_up + most_down) < most_down
        mine, theirs = F.when(up, (1 - p) * s).otherwise(p * s), F.when(up, q * t).otherwise((1 - q) * t)
        i_end = mine <= theirs
        rest = F.when(i_end, F.when(up, q - mine / t).otherwise(q + mine / t)).otherwise(F.when(up, p + theirs / s).otherwise(p - theirs / s))
        ended = F.struct(F.when(i_end, acc["at"]).otherwise(at).alias("at"), F.when(i_end == up, 1).otherwise(0).alias("copies"))
        stays = F.when(i_end, at).otherwise(acc["at"])
        also = (rest <= _EPS) | (rest >= 1 - _EPS)
        both = F.array(ended, F.struct(stays.alias("at"), F.round(rest).cast("int").alias("copies")))
        met = F.struct(F.when(also, F.lit(-1)).otherwise(stays).alias("at"), rest.alias("p"), F.concat(acc["done"], F.when(also, both).otherwise(F.array(ended))).alias("done"))
        return F.when(acc["at"] < 0, F.struct(at.alias("at"), q.alias("p"), acc["done"].alias("done"))).otherwise(met)

    start = F.struct(F.lit(-1).alias("at"), F.lit(0.0).alias("p"), F.expr("CAST(array() AS array<struct<at:int,copies:int>>)").alias("done"))
    return F.aggregate(F.sequence(F.lit(0), F.size(items) - 1), start, step)


def _settle(items: Column) -> Column:
    """Copies of the last residuals, in order: each is rounded so that the words taken so far stay nearest to those due."""

    def step(acc: Column, x: Column) -> Column:
        due = acc["due"] + x["p"] * x["size"]
        one = due * 2 >= x["size"]
        return F.struct((due - F.when(one, x["size"]).otherwise(0)).alias("due"), F.concat(acc["copies"], F.array(F.when(one, 1).otherwise(0))).alias("copies"))

    start = F.struct(F.lit(0.0).alias("due"), F.expr("CAST(array() AS array<int>)").alias("copies"))
    return F.aggregate(items, start, step)["copies"]


def pivotal_round(rows: DataFrame, blocks: list[list[Column]], tree: list[Column]) -> DataFrame:
    """Rows with their column p (in [0, 1]) replaced by copies, 0 or 1; sums of p * size are nearly kept per tree.

    rows have doc_id, size > 0 where p is a fraction, p and payload columns. blocks lists the
    grouping keys of each level from the leaves up; each group leaves at most one residual. Those
    of a tree, a few for it, are settled together, the largest first.
    """
    names = rows.columns
    whole = (F.col("p") <= _EPS) | (F.col("p") >= 1 - _EPS)
    rest = [c for c in names if c != "p"]
    decided = [rows.where(whole).select(*rest, F.round("p").cast("int").alias("copies"))]
    left = rows.where(~whole)
    item = F.struct((-F.col("size")).alias("order"), F.xxhash64(F.lit(SEED), "doc_id").alias("hash"), *names)
    packed = lambda keys: left.groupBy(*[k.alias(f"key{i}") for i, k in enumerate(keys)]).agg(F.array_sort(F.collect_list(item)).alias("items"))
    for round_, keys in enumerate(blocks):
        fought = cut(packed(keys).select("items", _fight(F.col("items"), round_).alias("end")))
        done = fought.select("items", F.explode("end.done").alias("one")).select(F.get("items", F.col("one.at")).alias("item"), F.col("one.copies").alias("copies"))
        decided.append(done.select(*[F.col(f"item.{c}").alias(c) for c in rest], "copies"))
        residual = fought.where("end.at >= 0").select(F.get("items", F.col("end.at")).alias("item"), F.col("end.p").alias("p"))
        left = residual.select(*[F.col("p") if c == "p" else F.col(f"item.{c}").alias(c) for c in names])
    last = packed(tree).select(F.explode(F.arrays_zip(F.col("items").alias("item"), _settle(F.col("items")).alias("copies"))).alias("one"))
    decided.append(last.select(*[F.col(f"one.item.{c}").alias(c) for c in rest], F.col("one.copies").alias("copies")))
    out = decided[0]
    for x in decided[1:]:
        out = out.unionByName(x)
    return out


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix_sources(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (of its source), copies, taken = size * copies.

    size counts the words (runs of anything but ASCII white space); null and empty texts have 0 and
    take nothing. copies is 0, 1 or 2 and depends only on the set of rows, so reruns agree. Null is
    a source of its own, ordered last. Repeated rows are documents of their own. An empty table
    gives an empty result. Other columns are not read.
    """
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size")))
    targets = source_targets(sized).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("rate", rate).withColumn("base", F.floor("rate").cast("int"))
    rows = rated.withColumn("p", F.when(F.col("size") == 0, 0.0).otherwise(F.col("rate") - F.col("base"))).drop("rate")
    n, keys = math.ceil(sized.count() / BLOCK), []
    size_class, own = F.floor(F.log2(F.col("size")) * 2), F.xxhash64(F.lit(SEED + 1), F.col("doc_id"))
    while n > 1:
        keys.append([F.col("source"), size_class, F.pmod(own, F.lit(n))])
        n = math.ceil(n / BLOCK)
    keys.append([F.col("source"), size_class])
    out = pivotal_round(rows, keys, [F.col("source")]).withColumn("copies", F.col("copies") + F.col("base"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """docs, all its columns, each row as many times as mix_sources copies it.

    Null and empty texts have no words: they are taken as often as their source's rate, rounded down,
    says. Rows that share doc_id, source and size are told apart by
    number only. An empty table stays empty.
    """
    keys = ["id", "of", "words"]
    taken = mix_sources(docs).groupBy(F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("size").alias("words")).agg(F.collect_list("copies").alias("copies"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").alias("of"), word_count(F.col("text")).alias("words"))
    turns = rows.withColumn("turn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))
    same = [turns[k].eqNullSafe(taken[k]) for k in keys]
    met = turns.join(taken, same[0] & same[1] & same[2]).select("row", F.array_repeat(F.lit(0), F.get("copies", F.col("turn") - 1)).alias("times"))
    return met.select("row", F.explode("times").alias("time")).select("row.*")
