"""N-gram Jaccard join by vertical partitioning.

The global order puts n-grams that few texts hold first: by the count of their slot in a hashed
table that covers all texts, then by slot and hash. That order is cut into fragments of equal mass.
A set travels as one segment per fragment; the partial overlaps of a pair are counted in each
fragment apart and summed per pair. Only pairs that can reach the threshold are counted: they share
an n-gram of both prefixes, their sizes and positions allow the overlap, and so do parity sketches of
the sets. A sketch has about as many bits as its set has n-grams; sets whose sketches differ in d
bits differ in d n-grams at least, also after the longer sketch is folded to the shorter one's size.

Texts with the same set are one class. Pairs are never listed within a group: per prefix n-gram each
class meets one centre; once those links are known, only classes of different components that still
share a prefix n-gram are compared, inside tasks, in groups of bounded size. Every link between
classes is found or joins two classes that are connected already, so components are exact.

Postings of a frequent n-gram are dealt over several parts, as many as its slot's count asks for. Each
part has a centre of its own, and these meet the n-gram's centre.

Sets are of 64-bit hashes; a set has a 64-bit signature. The counts table has a fixed width, the
filter for needed sets a fixed number of bits, so all that is broadcast has a fixed bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.llm.piece_codec import blocks
from tallyweave.llm.textblocks import chain, cut, mix, word_hashes

#: Slots of the counts table and of one row of it; bits of a sketch, least and most; fragments of the order.
TABLE_BITS, ROW, SKETCH, LONG_SKETCH, FRAGMENTS = 20, 1 << 13, 512, 1 << 15, 32
#: 64-bit words of the filter for needed sets; classes of one comparing group, at most twice over.
FILTER_WORDS, GROUP = 1 << 18, 1024
#: Postings that one part of an n-gram takes, about; parts of an n-gram at most; parts of a node's links.
SPLIT, MOST_PARTS, NODE_PARTS = 1024, 4096, 16
_U = np.uint64
_SLOT = _U((1 << TABLE_BITS) - 1)


def shingle_sets(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, their text's place, and the set sizes.

    A text with fewer than k words has one shingle, all its words; one without words has none.
    """
    words, at = word_hashes(text)
    grams, to = chain(words, at, k)
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(to))
    few = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < k))
    if len(few):
        whole = np.array([int(np.bitwise_xor.reduce(mix(words[at[i] : at[i + 1]] + np.arange(1, at[i + 1] - at[i] + 1).astype(np.uint64)))) for i in few], np.uint64)
        grams, doc = np.append(grams, whole), np.append(doc, few)
    by = np.lexsort((grams, doc))
    grams, doc = grams[by], doc[by]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[fresh], doc[fresh], np.bincount(doc[fresh], minlength=n)


def signatures(grams: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One 64-bit number per set; equal sets have equal ones."""
    ends = np.cumsum(sizes)
    total = np.append(_U(0), np.cumsum(mix(grams + _U(17))))
    return mix(total[ends] - total[ends - sizes] + sizes.astype(np.uint64) * _U(0x9E3779B97F4A7C15)).view(np.int64)


def sketches(grams: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Parity sketches: bit h mod m is set if an odd number of the set's hashes fall there; m is a power of two."""
    width = np.clip(1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), SKETCH, LONG_SKETCH)
    at = np.cumsum(width) - width
    bit = at[doc] + (mix(grams + _U(29)).astype(np.int64) & (width[doc] - 1))
    packed = np.packbits((np.bincount(bit, minlength=int(width.sum())) & 1).astype(np.uint8))
    return [packed[a : a + w].tobytes() for a, w in zip((at // 8).tolist(), (width // 8).tolist(), strict=True)]


def sketch_distance(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, the longer one folded."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    n = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, n)) if len(v) > n else v for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from blocks(batch)


def _fresh(seen: set[int], sigs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which sets this task meets for the first time. Empty ones never count."""
    if len(seen) > 2_000_000:  # forgetting only sends a set once more
        seen.clear()
    out = np.zeros(len(sigs), bool)
    for i in np.flatnonzero(sizes).tolist():
        sig = int(sigs[i])
        if sig not in seen:
            seen.add(sig)
            out[i] = True
    return out


_SETS = "doc_id long, n int, sig long, sketch binary, row int, counts binary"


def _measure(k: int):
    """Per document its set's size, signature and sketch; at the end this task's counts table, in rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << TABLE_BITS, np.int64), set()
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int32()), ("sig", pa.int64()), ("sketch", pa.binary()), ("row", pa.int32()), ("counts", pa.binary())])
        for part in _slices(batches):
            grams, doc, sizes = shingle_sets(part.column(1), k)
            sigs = signatures(grams, doc, sizes)
            fresh = _fresh(seen, sigs, sizes)
            counts += np.bincount((grams[fresh[doc]] & _SLOT).astype(np.int64), minlength=1 << TABLE_BITS)
            none = pa.nulls(part.num_rows, pa.int32()), pa.nulls(part.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int32()), pa.array(sigs), pa.array(sketches(grams, doc, sizes), pa.binary()), *none], schema=schema)
        kind = np.uint8 if counts.max() < 1 << 8 else np.uint16 if counts.max() < 1 << 16 else np.uint64
        for i, x in enumerate(counts.reshape(-1, ROW)):
            if x.any():
                yield pa.RecordBatch.from_pylist([{"row": i, "counts": x.astype(kind).tobytes()}], schema=schema)

    return run


def _order(sets: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each slot's place in the global order, its fragment, and the parts of its n-grams. The table is summed a row at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for x in batch.to_pylist():
                kind = {ROW: np.uint8, 2 * ROW: np.uint16}.get(len(x["counts"]), np.uint64)
                part = total.setdefault(x["row"], np.zeros(ROW, np.uint64))
                part += np.frombuffer(x["counts"], kind)
        for row, part in total.items():
            yield pa.RecordBatch.from_pydict({"row": pa.array([row], pa.int32()), "counts": [part.tobytes()]})

    counts = np.zeros(1 << TABLE_BITS, np.uint64)
    for x in sets.where("row IS NOT NULL").select("row", "counts").repartition("row").mapInArrow(add, "row int, counts binary").toLocalIterator():
        counts[x["row"] * ROW : (x["row"] + 1) * ROW] = np.frombuffer(x["counts"], np.uint64)
    by = np.argsort(counts, kind="stable")
    place = np.empty(1 << TABLE_BITS, np.int32)
    place[by] = np.arange(1 << TABLE_BITS)
    mass = np.cumsum(counts[by].astype(np.float64))
    fragment = np.empty(1 << TABLE_BITS, np.uint8)
    fragment[by] = np.minimum(mass / max(mass[-1], 1) * FRAGMENTS, FRAGMENTS - 1).astype(np.uint8)
    parts = np.clip(np.ceil(counts / max(SPLIT, 16 * counts.mean())), 1, MOST_PARTS).astype(np.uint16)
    return place, fragment, parts


def _need(a: Column, b: Column, num: int, den: int) -> Column:
    """The least overlap with which sets of sizes a and b link."""
    return F.floor((num * (a.cast("long") + b) + num + den - 1) / (num + den)).cast("int")


def _can(n: Column, pos: Column, m: Column, qos: Column, num: int, den: int) -> Column:
    """Whether sizes and the positions of a shared prefix n-gram allow a link."""
    return (den * F.least(n, m) >= num * F.greatest(n, m)) & (F.least(n - pos, m - qos) >= _need(n, m, num, den))


def _pairs_by_order(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


class Join:
    """One run over docs (doc_id, text): shingles of k words, links at Jaccard >= num / den."""

    def __init__(self, docs: DataFrame, k: int, num: int, den: int):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.k, self.num, self.den = k, num, den
        self.context = docs.sparkSession.sparkContext
        measured = cut(self.docs.mapInArrow(_measure(k), _SETS))
        self.place, self.fragment, self.parts = (self.context.broadcast(x) for x in _order(measured))
        self.sets = measured.where("row IS NULL").select("doc_id", "n", "sig", "sketch")
        self.classes = self.sets.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))

    def postings(self) -> DataFrame:
        """gram, sig, n, pos of the prefix n-grams of the sets, in global order, the gram's number of parts
        and the part that the set falls in; a task sends each set once."""
        k, num, den, place, split = self.k, self.num, self.den, self.place, self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for part in _slices(batches):
                grams, doc, sizes = shingle_sets(part.column(0), k)
                sigs = signatures(grams, doc, sizes)
                fresh = _fresh(seen, sigs, sizes)
                grams, doc = grams[fresh[doc]], doc[fresh[doc]]
                by = np.lexsort((grams, place.value[(grams & _SLOT).astype(np.int64)], doc))  # doc is sorted already
                own = np.where(fresh, sizes, 0)
                pos = np.arange(len(grams)) - np.repeat(np.cumsum(own) - own, own)
                head = pos < (sizes - -(-num * sizes // den) + 1)[doc]
                grams, doc = grams[by][head], doc[head]
                parts = split.value[(grams & _SLOT).astype(np.int64)]
                part_of = mix(sigs[doc].view(np.uint64) + _U(41)) % parts
                columns = [pa.array(grams.view(np.int64)), pa.array(sigs[doc]), *(pa.array(x.astype(np.int32)) for x in (sizes[doc], pos[head], parts, part_of))]
                yield pa.RecordBatch.from_arrays(columns, names=["gram", "sig", "n", "pos", "parts", "part"])

        return self.docs.select("text").mapInArrow(run, "gram long, sig long, n int, pos int, parts int, part int")

    def segments(self, needed: np.ndarray) -> DataFrame:
        """sig, fragment, grams (packed, sorted) of the sets that the filter lets through."""
        k, fragment, sent = self.k, self.fragment, self.context.broadcast(needed)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for part in _slices(batches):
                grams, doc, sizes = shingle_sets(part.column(0), k)
                sigs = signatures(grams, doc, sizes)
                sizes = np.where((sent.value[sigs & (FILTER_WORDS - 1)] >> ((sigs >> 20) & 63).astype(np.uint64)) & _U(1), sizes, 0)
                fresh = _fresh(seen, sigs, sizes)
                grams, doc = grams[fresh[doc]], doc[fresh[doc]]
                key = doc * FRAGMENTS + fragment.value[(grams & _SLOT).astype(np.int64)]
                by = np.argsort(key, kind="stable")
                grams, key = grams[by], key[by]
                first = np.flatnonzero(np.diff(key, prepend=-1))
                data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.append(first, len(key)).astype(np.int32) * np.int32(8)), pa.py_buffer(np.ascontiguousarray(grams))])
                yield pa.RecordBatch.from_arrays([pa.array(sigs[key[first] // FRAGMENTS]), pa.array(key[first] % FRAGMENTS, pa.int32()), data], names=["sig", "fragment", "grams"])

        # equal sets of different tasks send equal segments
        return self.docs.select("text").mapInArrow(run, "sig long, fragment int, grams binary").groupBy("sig", "fragment").agg(F.first("grams").alias("grams"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """a, b of the pairs of classes (a, b, na, nb) that link: overlaps per fragment, summed per pair."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("sig"))
        bit = F.expr("shiftleft(1L, CAST(shiftright(sig, 20) & 63 AS INT))")
        words = ends.groupBy(F.col("sig").bitwiseAND(F.lit(FILTER_WORDS - 1).cast("long")).alias("word")).agg(F.bit_or(bit).alias("bits"))
        needed = np.zeros(FILTER_WORDS, np.int64)
        for x in words.toLocalIterator():  # FILTER_WORDS at most
            needed[x["word"]] = x["bits"]
        segments = cut(self.segments(needed.view(np.uint64)))

        @F.arrow_udf("int")
        def overlap(x: pa.Array, y: pa.Array) -> pa.Array:
            both = ((np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)) for p, q in zip(x, y, strict=True))
            return pa.array([int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum()) for p, q in both], pa.int32())

        left = pairs.join(segments.withColumnsRenamed({"sig": "a", "grams": "left"}), "a")
        both = left.join(segments.withColumnsRenamed({"sig": "b", "grams": "right"}), ["b", "fragment"])
        partial = both.select("a", "b", "na", "nb", overlap("left", "right").alias("part"))
        total = partial.groupBy("a", "b").agg(F.sum("part").alias("common"), F.min("na").alias("na"), F.min("nb").alias("nb"))
        return total.where(self.den * F.col("common") >= self.num * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")

    def _sketched(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs whose sketches are near enough."""
        near = lambda end: self.classes.select(F.col("sig").alias(end), F.col("sketch").alias(f"sketch_{end}"))
        both = pairs.groupBy("a", "b").agg(F.min("na").alias("na"), F.min("nb").alias("nb")).join(near("a"), "a").join(near("b"), "b")
        most = F.col("na") + F.col("nb") - 2 * _need(F.col("na"), F.col("nb"), self.num, self.den)

        @F.arrow_udf("int")
        def apart(x: pa.Array, y: pa.Array) -> pa.Array:
            return pa.array([sketch_distance(p.as_buffer(), q.as_buffer()) for p, q in zip(x, y, strict=True)], pa.int32())

        return both.where(apart("sketch_a", "sketch_b") <= most).select("a", "b", "na", "nb")

    def _others(self, met: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs of different components that share a prefix n-gram, filtered inside tasks. The centre of an
        undivided n-gram has met all others already."""
        num, den = self.num, self.den
        known = met.where("parts > 1 OR sig != centre.sig").select("gram", "part", "parts", "sig", "n", "pos").join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
        spans = known.groupBy("gram").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("size"), F.first("parts").alias("parts")).where("least != most")
        mixed = known.drop("parts").join(spans.select("gram", "size", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), ["gram", "part"])
        groups = F.ceil(F.col("size") / GROUP).cast("int")
        own = F.pmod(F.xxhash64("sig"), groups).cast("int")
        met_in = F.transform(F.sequence(F.lit(0), groups - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
        dealt = mixed.select("gram", "sig", "n", "pos", "label", own.alias("own"), F.explode(met_in).alias("with")).join(self.classes.select("sig", "sketch"), "sig")
        keyed = dealt.select(F.xxhash64("gram", "with.i", "with.j").alias("key"), "gram", F.col("with.i").alias("i"), F.col("with.j").alias("j"), "own", "sig", "n", "pos", "label", "sketch")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rest = None
            for batch in _with_end(batches):
                table = pa.Table.from_batches([x for x in (rest, batch) if x is not None]).combine_chunks() if rest is not None or batch is not None else None
                if table is None or not table.num_rows:
                    continue
                key = table["key"].to_numpy()
                stop = len(key) if batch is None else int(np.searchsorted(key, key[-1]))  # keys are sorted; the last may go on
                rest = table.slice(stop).to_batches()[0] if stop < len(key) else None
                if stop:
                    yield from _near_pairs(table.slice(0, stop), num, den)

        sorted_ = keyed.repartition("key").sortWithinPartitions("key", "gram", "i", "j")
        return sorted_.mapInArrow(compare, "a long, b long, na int, nb int")

    def components(self) -> DataFrame:
        """label, the least signature of its component, of every class (sig) that has a link."""
        run = W.partitionBy("gram", "part")
        least = F.min(F.struct("pos", "n", "sig"))
        met = self.postings().withColumn("centre", least.over(run)).withColumn("last", F.max("sig").over(run)).withColumn("first", F.min("sig").over(run)).where("parts > 1 OR first != last")
        met = cut(met.select("gram", "part", "parts", "sig", "n", "pos", "centre").dropDuplicates(["gram", "part", "sig"]))
        tops = met.where("parts > 1 AND sig = centre.sig").withColumn("centre", least.over(W.partitionBy("gram")))  # one a part
        both = met.unionByName(tops).where(F.col("sig") != F.col("centre.sig"))
        can = _can(F.col("n"), F.col("pos"), F.col("centre.n"), F.col("centre.pos"), self.num, self.den)
        own = F.col("sig") < F.col("centre.sig")
        sizes = [F.when(own, F.col("n")).otherwise(F.col("centre.n")).alias("na"), F.when(own, F.col("centre.n")).otherwise(F.col("n")).alias("nb")]
        stars = both.where(can).select(*_pairs_by_order(F.col("sig"), F.col("centre.sig")), *sizes)
        links = cut(self.links(cut(self._sketched(stars))))
        labels = connected(links)
        others = cut(self._others(met, labels).groupBy("a", "b").agg(F.min("na").alias("na"), F.min("nb").alias("nb")))
        if others.isEmpty():
            return labels
        return connected(links.unionByName(cut(self.links(others))))

    def result(self) -> DataFrame:
        labelled = self.classes.select("sig", "rep").join(self.components(), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
        least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
        of = labelled.join(least, "label").select("sig", "component_id")
        rows = self.sets.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("sig")).alias("sig"))
        return rows.join(of, "sig", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _near_pairs(rows: pa.Table, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Pairs of rows of one key and different labels that sizes, positions and sketches allow; rows are sorted by key."""
    gram, i, j, own, sig, label = (rows[c].to_numpy() for c in ("gram", "i", "j", "own", "sig", "label"))
    n, pos = rows["n"].to_numpy().astype(np.int64), rows["pos"].to_numpy().astype(np.int64)
    sketch = rows["sketch"].to_pylist()
    short = np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, SKETCH // 64)) for x in sketch])  # all folded alike
    last = np.append(np.flatnonzero((gram[1:] != gram[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])), len(gram) - 1)
    end = last[np.searchsorted(last, np.arange(len(gram)))]
    found, at = set(), np.arange(len(gram))
    for d in range(1, len(gram)):
        at = at[at + d <= end[at]]
        if not len(at):
            break
        x, y = at, at + d
        ok = (label[x] != label[y]) & ((own[x] != own[y]) | (i[x] == j[x]))
        ok &= den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y])
        x, y = x[ok], y[ok]
        need = -(-num * (n[x] + n[y]) // (num + den))
        ok = np.minimum(n[x] - pos[x], n[y] - pos[y]) >= need
        x, y, need = x[ok], y[ok], need[ok]
        most = n[x] + n[y] - 2 * need
        ok = np.bitwise_count(short[x] ^ short[y]).sum(axis=1, dtype=np.int64) <= most
        for p, q, limit in zip(x[ok].tolist(), y[ok].tolist(), most[ok].tolist(), strict=True):
            p, q = (p, q) if sig[p] < sig[q] else (q, p)
            pair = int(sig[p]), int(sig[q]), int(n[p]), int(n[q])
            if pair not in found and (max(len(sketch[p]), len(sketch[q])) == SKETCH // 8 or sketch_distance(sketch[p], sketch[q]) <= limit):
                found.add(pair)
        if len(found) > 20_000:
            yield _pair_batch(found)
            found = set()
    yield _pair_batch(found)


def _pair_batch(found: set[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*sorted(found), strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["a", "b", "na", "nb"])


def connected(links: DataFrame) -> DataFrame:
    """sig, label of every end of links (a, b): the least sig of its component, by label spreading with shortcuts.

    A node's links are dealt over NODE_PARTS parts, so that one with very many isn't one task's.
    """
    ends = links.select(F.col("a").alias("sig"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("sig"), F.col("a").alias("to")))
    edges = cut(ends.withColumn("part", F.pmod(F.xxhash64("sig"), F.lit(NODE_PARTS)).cast("int")))
    every = F.explode(F.sequence(F.lit(0), F.lit(NODE_PARTS - 1))).alias("part")
    labels = cut(edges.groupBy("sig").agg(F.least(F.min("to"), F.first("sig")).alias("label")))
    while True:
        near = edges.join(labels.select(F.col("sig").alias("to"), "label", every), ["to", "part"]).groupBy("sig").agg(F.min("label").alias("near"))
        spread = labels.join(near, "sig").select("sig", F.col("label").alias("old"), F.least("label", "near").alias("via"))
        jump = labels.select(F.col("sig").alias("via"), F.col("label").alias("far"))
        after = cut(spread.join(jump, "via").select("sig", "old", F.least("via", "far").alias("label")))
        if after.where("old != label").isEmpty():
            return after.select("sig", "label")
        labels = after.select("sig", "label")


def near_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Words are lower-cased (A-Z) runs of anything but ASCII white space. component_id is the smallest
    doc_id that links reach. Null texts count as empty; documents without words link with nothing,
    not even each other. Repeated rows each give a row in one component. A null doc_id never names a
    component that has another. An empty table gives an empty result; other columns are not read.
    """
    return Join(docs, k, num, den).result()


def drop_near_copies(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, all its columns, with the document of each component that has the smallest doc_id.

    Null ids not linked to another stay, as do documents without words. Rows that share the id that
    stays all stay: the exact stage before leaves one of those with equal texts. An empty table stays
    empty.
    """
    stay = near_components(docs, k, num, den).where("component_id <=> doc_id").select(F.col("doc_id").alias("stay_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(stay, F.col("id").eqNullSafe(F.col("stay_id")), "left_semi").select("row.*")
