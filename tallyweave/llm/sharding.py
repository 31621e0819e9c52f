"""Shards of near equal bytes by sampled splitters, in DataFrame operations only.

The key of a record is a hash of its text, so equal texts lie together. Keys are drawn with a chance
proportional to their bytes; quantiles of the sample are the splitters, PER_SHARD times as many as
shards, and records are range-partitioned by them. A key that holds several quantiles is a range of
its own. Overfull ranges, a key with more bytes than a shard among them, are subdivided. Groups that
span ranges but fit into a shard are dealt whole, the largest first, to the emptiest shard; the other
ranges fill what the shards have left in key order, cut at the exact byte.

Equal rows are counted before they move, so a hot key is a row with a count until its copies are
numbered. Tables of ranges have a size that depends on the number of shards alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.textblocks import cut

SHARDS = 40
#: Ranges a shard, and draws a range: a shard's share of 1/64 is cut exactly, so draws only keep ranges small.
PER_SHARD, DRAWS = 64, 8
#: Bytes that a record costs besides its text.
OVERHEAD = 16
#: Copies of one row that are numbered together.
STRETCH = 4096
SEED = 71


def _chance(*parts: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def sampled_splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Ascending lower bounds of ranges of key with about total / ranges bytes each.

    rows have key, doc_id, size and n, the number of equal rows. About ranges * DRAWS draws meet in
    one array, whatever the input. A key that more than one quantile falls on begins a range that ends with it.
    """
    due = F.col("size") * F.col("n") * F.lit(ranges * DRAWS / total)
    times = F.floor(due) + F.when(_chance("key", "doc_id", "size") < due - F.floor(due), 1).otherwise(0)
    drawn = rows.select("key", times.cast("int").alias("times")).where("times > 0").select(F.explode(F.array_repeat("key", F.col("times"))).alias("key"))
    ordered = drawn.agg(F.array_sort(F.collect_list("key")).alias("keys"))
    at = lambda k: F.get("keys", F.floor(k * F.size("keys") / ranges).cast("int"))
    quantiles = ordered.select(F.filter(F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), at), lambda x: x.isNotNull()).alias("at")).first()["at"] if ranges > 1 else []
    own = {a for a, b in zip(quantiles, quantiles[1:]) if a == b}
    return sorted({*quantiles, *(k + 1 for k in own if k < (1 << 63) - 1)})


def place(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds are not above key, by binary search; the bounds are one literal."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]

    def step(low: Column, width: Column) -> Column:
        return low + F.when((low + width <= len(bounds)) & (F.get(table, F.least(low + width, F.lit(len(bounds))) - 1) <= key), width).otherwise(0)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step)


def _dealt(whole: DataFrame, shards: int) -> DataFrame:
    """part, sub, shard of the groups that stay whole: the largest first, each to the shard with the fewest bytes so far."""

    def step(acc: Column, x: Column) -> Column:
        least = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        return F.struct(F.transform(acc["loads"], lambda load, i: F.when(i == least, load + x["bytes"]).otherwise(load)).alias("loads"), F.concat(acc["shards"], F.array(least)).alias("shards"))

    start = F.struct(F.array_repeat(F.lit(0).cast("long"), F.lit(shards)).alias("loads"), F.expr("CAST(array() AS array<int>)").alias("shards"))
    items = whole.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("order"), "part", "sub", "bytes"))).alias("items"))
    dealt = items.select(F.explode(F.arrays_zip("items", F.aggregate("items", start, step)["shards"].alias("shard"))).alias("x"))
    return dealt.select("x.items.part", "x.items.sub", "x.items.bytes", "x.shard")


def _room(dealt: DataFrame, light: int, shards: int) -> list[float]:
    """Per shard, the bytes where it begins in the run of all light ranges: all shards fill up to one level."""
    loads = dealt.sparkSession.range(shards).select(F.col("id").cast("int").alias("own")).join(dealt.groupBy("shard").agg(F.sum("bytes").alias("load")), F.col("own") == F.col("shard"), "left")
    loads = loads.select("own", F.coalesce("load", F.lit(0)).alias("load"))
    upto = Window.orderBy("load", "own").rowsBetween(Window.unboundedPreceding, 0)
    level = loads.withColumn("level", (F.sum("load").over(upto) + light) / F.count("*").over(upto)).agg(F.min("level")).first()[0]
    starts, at = [], 0.0
    for row in loads.orderBy("own").collect():
        starts.append(at)
        at += max(0.0, level - row["load"])
    return starts


def shard_records(records: DataFrame, shards: int = SHARDS) -> DataFrame:
    """records (doc_id, size > 0, crc, key) with shard and slot: near equal bytes a shard, slots gapless from 0 in each.

    Rows of one key share a shard unless they hold more bytes than a shard's share. The result depends
    only on the set of rows (with their repeats), not on partitions or order.
    """
    rows = cut(records.groupBy("key", "doc_id", "size", "crc").agg(F.count("*").alias("n")))
    total = rows.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0
    ranges = shards * PER_SHARD
    bounds = sampled_splitters(rows, total, ranges) if total else []
    single = {k for k, (a, b) in enumerate(zip(bounds, bounds[1:]), 1) if b == a + 1}
    fair = max(total / ranges, 1.0)

    ranged = rows.withColumn("part", place(F.col("key"), bounds)).withColumn("stretch", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / STRETCH))))
    ranged = ranged.withColumn("n", F.least(F.col("n") - F.col("stretch") * STRETCH, F.lit(STRETCH)))
    alone = F.array_contains(F.lit(sorted(single)).cast("array<int>"), F.col("part")) if single else F.lit(False)
    sums = [F.sum(F.col("size") * F.col("n")).alias("bytes"), F.max("size").alias("most")]
    stats = ranged.groupBy("part").agg(*sums).withColumn("alone", alone)
    split = F.when(F.col("alone"), (F.col("bytes") > total / shards) & (F.col("most") <= total / shards / 8)).otherwise(F.col("bytes") > 4 * fair)
    stats = stats.select(F.col("part").alias("of_part"), "alone", split.alias("split"), F.when(split, F.ceil(F.col("bytes") / fair)).otherwise(1).alias("pieces"))
    # at most two ranges a splitter: bounded by the number of shards
    ranged = ranged.join(F.broadcast(stats), F.col("part") == F.col("of_part")).drop("of_part")
    mark = F.when(F.col("alone"), F.xxhash64("doc_id", "stretch")).otherwise(F.xxhash64("key"))
    ranged = cut(ranged.withColumn("sub", F.pmod(mark, F.col("pieces"))).withColumn("whole", F.col("alone") & ~F.col("split")).drop("pieces"))

    parts = cut(ranged.groupBy("part", "sub", "whole").agg(F.sum(F.col("size") * F.col("n")).alias("bytes")))
    dealt = cut(_dealt(parts.where("whole"), shards))
    light = parts.where("NOT whole")
    starts = _room(dealt, light.agg(F.sum("bytes")).first()[0] or 0, shards)
    before = F.coalesce(F.sum("bytes").over(Window.orderBy("part", "sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = light.select(F.col("part").alias("of_part"), F.col("sub").alias("of_sub"), before.alias("base"), F.lit(None).cast("int").alias("own"))
    base = base.unionByName(dealt.select(F.col("part").alias("of_part"), F.col("sub").alias("of_sub"), F.lit(0).cast("long").alias("base"), F.col("shard").alias("own")))

    each = ranged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    within = Window.partitionBy("part", "sub")
    ordered = within.orderBy("key", "doc_id", "size", "crc", "stretch", "copy")
    upto = F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    keyed = within.orderBy("key")
    upper = F.sum("size").over(keyed.rangeBetween(Window.unboundedPreceding, 0))
    lower = F.coalesce(F.sum("size").over(keyed.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = F.when(F.col("alone"), upto - F.col("size") / 2).otherwise((upper + lower) / 2)
    each = each.withColumn("middle", middle).withColumn("number", F.row_number().over(ordered))
    # at most two ranges a splitter and the pieces of overfull ones: bounded by the number of shards
    each = each.join(F.broadcast(base), (F.col("part") == F.col("of_part")) & (F.col("sub") == F.col("of_sub")))
    share = place(F.floor(F.col("base") + F.col("middle")), [-(-int(x * 2) // 2) for x in starts[1:]])
    each = cut(each.select("doc_id", "size", "crc", "part", "sub", "number", F.coalesce("own", share).alias("shard")))

    runs = each.groupBy(F.col("shard").alias("of_shard"), F.col("part").alias("of_part"), F.col("sub").alias("of_sub")).agg(F.min("number").alias("first"), F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("of_shard").orderBy("of_part", "of_sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("of_shard", "of_part", "of_sub", (earlier - F.col("first")).alias("shift"))
    met = each.join(F.broadcast(runs), (F.col("shard") == F.col("of_shard")) & (F.col("part") == F.col("of_part")) & (F.col("sub") == F.col("of_sub")))
    return met.select("doc_id", "size", "crc", "shard", (F.col("number") + F.col("shift")).cast("long").alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per document: doc_id, size (UTF-8 bytes of the text and OVERHEAD), text_crc32, law, shard, slot, grown_shard.

    The law is "bytes": shards have near equal bytes. Equal texts share a shard unless they are more
    than a shard's share. grown_shard is null, as one more shard moves all boundaries. Null texts have
    no bytes and fare as empty ones; null and repeated ids are rows like others, equal rows told apart
    by their slot. An empty table gives an empty result. Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    records = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("key"))
    sharded = shard_records(records, shards)
    return sharded.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
