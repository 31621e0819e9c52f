"""The best payments for a document by money and date, within classes, without listing pairs.

Payments of a class lie in cells: sorted by class, 45-day stretch and amount, and range-partitioned,
so a cell has a bounded number of them whatever the data. A document asks the cell where its amount
falls in each stretch that its window touches, and in the order that has no dates; it walks outward
from its amount in both directions and stops where the best that is still possible falls below its
K-th best. Partial best lists of all cells merge; what they leave possible decides which neighbouring
cells are asked in a second round, after which the lists are final.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.reference_data import WINDOW_DAYS
from tallyweave.sources.ledger import cut, shuffled

#: Payments kept for each document and class, and a score below which none is kept.
K, LEAST = 8, 0.05
#: Payments of a cell at least, cells at most, and documents that one task asks a cell for.
CELL, MOST_CELLS, ASKED = 4096, 1 << 16, 50_000
#: The stretch of payments seen without their dates, and the day of none.
UNDATED = NO_DAY = -(1 << 30)
AMOUNT, DATE = 0.35, 0.1
_STEP = 16


def _amount_score(gross: np.ndarray, settled: np.ndarray) -> np.ndarray:
    """scoring.amount_score over arrays; it only selects, final scores are Catalyst's."""
    delta = settled - gross
    d, size = np.abs(delta), np.abs(gross)
    near = np.maximum(50_000, np.floor(size * 0.12 + 0.5))
    zero = np.maximum(near, np.floor(size * 0.5 + 0.5))
    base = np.where(d <= near, 1 - 0.45 * d / near, np.where(d <= zero, 0.55 * (zero - d) / np.where(zero == near, 1, zero - near), 0.0))
    return np.where(delta > 0, base * 0.6, base)


def _possible(gross: int, settled: int) -> float:
    """_amount_score of one pair."""
    near = max(50_000, math.floor(abs(gross) * 0.12 + 0.5))
    zero, d = max(near, math.floor(abs(gross) * 0.5 + 0.5)), abs(settled - gross)
    base = 1 - 0.45 * d / near if d <= near else 0.55 * (zero - d) / (zero - near) if d <= zero else 0.0
    return base * 0.6 if settled > gross else base


def _date_score(gap: np.ndarray) -> np.ndarray:
    d = np.abs(gap)
    base = np.where(d <= 21, 1.0, np.where(d <= WINDOW_DAYS, 1 - 0.8 * (d - 21) / (WINDOW_DAYS - 21), 0.0))
    return np.where(gap < 0, base * 0.6, base)


def search(ask: dict[str, np.ndarray], pay: dict[str, np.ndarray], k: int = K, least: float = LEAST) -> tuple[np.ndarray, ...]:
    """(ask, pay, score, amount score, days apart): of each asked row the best k rows of pay in its class and stretch.

    pay is sorted by class, stretch, amount and id. Dated rows meet within the window, undated ones outside of it.
    """
    same = (np.diff(pay["class"]) == 0) & (np.diff(pay["stretch"]) == 0)
    begins = np.flatnonzero(np.append(True, ~same))
    ends = np.append(begins[1:], len(pay["class"]))
    segment = {c: i for i, c in enumerate(zip(pay["class"][begins].tolist(), pay["stretch"][begins].tolist(), strict=True))}
    own = np.array([segment.get(c, -1) for c in zip(ask["class"].tolist(), ask["stretch"].tolist(), strict=True)], np.int64)
    rows = np.flatnonzero(own >= 0)
    n, top = len(rows), {"at": np.full((len(rows), k), -1), "score": np.full((len(rows), k), -1.0), "amount": np.zeros((len(rows), k)), "gap": np.zeros((len(rows), k))}
    gross, day, dated = ask["gross"][rows], ask["day"][rows], ask["stretch"][rows] != UNDATED
    first, last = begins[own[rows]], ends[own[rows]]
    _, rank = np.unique(np.concatenate([pay["amount"], gross]), return_inverse=True)
    inside_of = lambda segments, ranks: segments * (1 << 32) + ranks
    places = inside_of(np.repeat(np.arange(len(begins)), ends - begins), rank[: len(pay["amount"])])
    down = np.searchsorted(places, inside_of(own[rows], rank[len(pay["amount"]) :]), "right") - 1
    up, live = down + 1, np.arange(n)
    turn = pay["id_rank"]
    while len(live):
        reach = np.arange(_STEP)
        at = np.concatenate([down[live, None] - reach, up[live, None] + reach], axis=1)
        inside = (at >= first[live, None]) & (at < last[live, None])
        at = np.where(inside, at, first[live, None])
        amount = _amount_score(gross[live, None], pay["amount"][at])
        known = (day[live, None] != NO_DAY) & (pay["day"][at] != NO_DAY)
        gap = np.where(known, pay["day"][at] - day[live, None], 1 << 40)
        close = np.abs(gap) <= WINDOW_DAYS
        score = AMOUNT * amount + np.where(close, DATE * _date_score(gap), 0.0)
        fits = inside & (close == dated[live, None]) & (score >= least)
        all_at, all_score = np.concatenate([top["at"][live], np.where(fits, at, -1)], axis=1), np.concatenate([top["score"][live], np.where(fits, score, -1.0)], axis=1)
        all_amount, all_gap = np.concatenate([top["amount"][live], amount], axis=1), np.concatenate([top["gap"][live], np.abs(gap)], axis=1)
        best = np.lexsort((turn[all_at], all_gap, -all_amount, -all_score), axis=-1)[:, :k]
        for name, values in (("at", all_at), ("score", all_score), ("amount", all_amount), ("gap", all_gap)):
            top[name][live] = np.take_along_axis(values, best, axis=1)
        down[live] -= _STEP
        up[live] += _STEP
        bar = np.maximum(top["score"][live, -1], least)
        more = np.zeros(len(live), bool)
        for way, there in ((down[live], down[live] >= first[live]), (up[live], up[live] < last[live])):
            possible = AMOUNT * _amount_score(gross[live], pay["amount"][np.where(there, way, 0)]) + np.where(dated[live], DATE, 0.0)
            more |= there & (possible >= bar)
        live = live[more]
    found = top["at"] >= 0
    where = np.nonzero(found)[0]
    return rows[where], top["at"][found], top["score"][found], top["amount"][found], top["gap"][found]


def _columns(table: pa.Table, *names: str) -> dict[str, np.ndarray]:
    return {c: table.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names}


def _in_cell(asked: pa.Table, paid: pa.Table) -> pa.Table:
    ids = paid.column("payment_id").combine_chunks()
    pay = _columns(paid, "class", "stretch", "amount", "day")
    rank = np.empty(len(ids), np.int64)
    rank[pa.compute.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    order = np.lexsort((rank, pay["amount"], pay["stretch"], pay["class"]))
    ask = _columns(asked, "class", "stretch", "gross", "day")
    if not len(order) or not len(ask["class"]):
        return _FOUND.empty_table()
    a, p, score, amount, gap = search(ask, {c: v[order] for c, v in (pay | {"id_rank": rank}).items()})
    columns = [ask["class"][a], ask["gross"][a], ask["day"][a].astype(np.int32), ids.take(pa.array(order[p])), score, amount, gap.astype(np.int64)]
    return pa.Table.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=_FOUND)


_FOUND = pa.schema([("class", pa.int64()), ("gross", pa.int64()), ("day", pa.int32()), ("payment_id", pa.string()), ("score", pa.float64()), ("amount_score", pa.float64()), ("gap", pa.int64())])
_FOUND_SQL = "class long, gross long, day int, payment_id string, score double, amount_score double, gap long"
_ROUTED = "cell int, class long, stretch int, gross long, day int"


def _routes(bounds: list[tuple], bar: bool):
    """A function over batches of (class, stretch, gross, day[, bar]): the cells to ask; with a bar, the ones beyond those of the first round that could still hold better."""
    cells, lows, highs = ([b[k] for b in bounds] for k in range(3))

    def nearest_cells(place: tuple) -> tuple[int, int]:
        c = max(bisect.bisect_right(lows, place) - 1, 0)
        return c, c + 1 if c + 1 < len(cells) and highs[c] < place else c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                group, place = row[:2], row[:3]
                left, right = nearest_cells(place)
                if not bar:
                    out += [(cells[c], *row) for c in dict.fromkeys((left, right)) if lows[c][:2] <= group <= highs[c][:2]]
                    continue
                day_part = DATE if group[1] != UNDATED else 0.0
                for c, step, edge in ((left - 1, -1, highs), (right + 1, 1, lows)):
                    while 0 <= c < len(cells) and edge[c][:2] == group:
                        if AMOUNT * _possible(place[2], edge[c][2]) + day_part < row[4]:
                            break
                        out.append((cells[c], *row[:4]))
                        c += step
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], names=["cell", "class", "stretch", "gross", "day"])

    return run


def _ask(routed: DataFrame, placed: DataFrame) -> DataFrame:
    """The best of each asked cell. A cell that many ask is copied, so that no task has more than about ASKED of them."""
    loads = routed.groupBy("cell").agg(F.ceil(F.count("*") / ASKED).cast("int").alias("parts")).withColumnRenamed("cell", "of_cell")
    of_cell = F.col("cell") == F.col("of_cell")
    asks = routed.join(loads, of_cell).withColumn("part", F.pmod(F.hash("class", "gross", "day"), F.col("parts"))).drop("of_cell", "parts")
    pays = placed.join(loads, of_cell).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("of_cell", "parts")
    return asks.groupBy("cell", "part").cogroup(pays.groupBy("cell", "part")).applyInArrow(_in_cell, _FOUND_SQL)


def _best(found: DataFrame) -> DataFrame:
    order = Window.partitionBy("class", "gross", "day").orderBy(F.col("score").desc(), F.col("amount_score").desc(), "gap", "payment_id")
    return found.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= K)


def nearest_payments(asked: DataFrame, payments: DataFrame) -> DataFrame:
    """class, gross, day, payment_id, score: for each distinct (class, gross, day) the K best payments of its class.

    asked has class (a hash), gross and day (NO_DAY for none); payments class, payment_id, amount and day.
    A payment's score is what amount and date add to the composite; LEAST is needed. Ties: the amount's score,
    the days apart, the id. Of payments of one class, amount and day the K least ids count, as the others can't be better.
    """
    same = Window.partitionBy("class", "amount", "day").orderBy("payment_id")
    lean = payments.distinct().withColumn("turn", F.row_number().over(same)).where(F.col("turn") <= K).drop("turn")
    stretches = F.when(F.col("day") == NO_DAY, F.array(F.lit(UNDATED))).otherwise(F.array(F.lit(UNDATED), F.floor(F.col("day") / WINDOW_DAYS).cast("int")))
    copies = cut(lean.withColumn("stretch", F.explode(stretches)))
    cells = max(1, min(MOST_CELLS, math.ceil(copies.count() / CELL)))
    placed = cut(copies.repartitionByRange(cells, "class", "stretch", "amount", "payment_id").withColumn("cell", F.spark_partition_id()))
    place = F.struct("class", "stretch", "amount")
    # a row per cell: MOST_CELLS at most
    bounds = sorted((r["cell"], tuple(r["low"]), tuple(r["high"])) for r in placed.groupBy("cell").agg(F.min(place).alias("low"), F.max(place).alias("high")).collect())
    if not bounds:
        return asked.sparkSession.createDataFrame([], _FOUND_SQL).drop("amount_score", "gap")
    at = F.floor(F.col("day") / WINDOW_DAYS).cast("int")
    windows = F.when(F.col("day") == NO_DAY, F.array(F.lit(UNDATED))).otherwise(F.array(F.lit(UNDATED), at - 1, at, at + 1))
    entries = asked.distinct().select("class", F.explode(windows).alias("stretch"), "gross", "day")
    first = cut(_best(_ask(cut(entries.mapInArrow(_routes(bounds, False), _ROUTED)), placed)))
    bars = first.where(F.col("turn") == K).select(F.col("class").alias("c"), F.col("gross").alias("g"), F.col("day").alias("d"), F.col("score").alias("bar"))
    barred = entries.join(shuffled(bars), (F.col("class") == F.col("c")) & (F.col("gross") == F.col("g")) & (F.col("day") == F.col("d")), "left")
    barred = barred.select("class", "stretch", "gross", "day", F.coalesce("bar", F.lit(LEAST)).alias("bar"))
    again = _ask(cut(barred.mapInArrow(_routes(bounds, True), _ROUTED)), placed)
    return _best(first.drop("turn").unionByName(again)).select("class", "gross", "day", "payment_id", "score")
