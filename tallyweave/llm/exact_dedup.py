"""Exact deduplication through a cuckoo-filter index of live digests.

Texts are equal when identical after replacing each run of ASCII white space by one space; null
counts as empty. Digests (SHA-256 of the normalised text) are dealt to buckets by their own bits.
Each bucket owns a cuckoo filter over its live digests and the bucketed content (the full digests):
a filter miss proves a digest new, a hit is verified against the content. Of a group of copies at
most SALTS pre-aggregated rows reach a bucket, so a text that a third of all rows repeat stays cheap.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.llm.textblocks import cut

#: Distinct digests that a bucket holds on average, and rows per digest after pre-aggregation.
PER_BUCKET = 50_000
SALTS = 16
INDEX_SCHEMA = "bucket long, digest string, keep_id long, n long"


class CuckooIndex:
    """A cuckoo filter (16-bit fingerprints, 4 slots) over digests, with the content that hits verify against.

    insert() and delete() work on live digests. When an insertion finds no slot after MAX_KICKS
    moves, the filter doubles and is rebuilt from the stored keys, so it never loses or refuses one.
    """

    SLOTS, MAX_KICKS = 4, 200

    def __init__(self, capacity: int = 64):
        self.content: dict[int, dict[str, list[int]]] = {}
        self.size = self.false_hits = self.resizes = 0
        self._clear(capacity)

    def _clear(self, capacity: int) -> None:
        self.width = 1 << max(2, (capacity // self.SLOTS).bit_length())
        self.table: list[list[int]] = [[] for _ in range(self.width)]

    @staticmethod
    def _parts(digest: str) -> tuple[int, int]:
        return int(digest[16:32], 16), int(digest[32:36], 16) or 1

    def _places(self, digest: str) -> tuple[int, int, int]:
        base, mark = self._parts(digest)
        first = base & (self.width - 1)
        return first, self._other(first, mark), mark

    def _other(self, place: int, mark: int) -> int:
        return (place ^ (mark * 0x5BD1E995)) & (self.width - 1)

    def maybe(self, digest: str) -> bool:
        first, second, mark = self._places(digest)
        return mark in self.table[first] or mark in self.table[second]

    def find(self, digest: str) -> list[int] | None:
        """[keep_id, n] of a live digest, else None. The filter answers first; hits look at the content."""
        if not self.maybe(digest):
            return None
        found = self.content.get(self._parts(digest)[0] & 0xFFFF, {}).get(digest)
        self.false_hits += found is None
        return found

    def _place(self, digest: str) -> bool:
        first, second, mark = self._places(digest)
        for place in (first, second):
            if len(self.table[place]) < self.SLOTS:
                self.table[place].append(mark)
                return True
        place = first if mark & 1 else second
        for kick in range(self.MAX_KICKS):
            slot = kick % self.SLOTS
            self.table[place][slot], mark = mark, self.table[place][slot]
            place = self._other(place, mark)
            if len(self.table[place]) < self.SLOTS:
                self.table[place].append(mark)
                return True
        return False

    def insert(self, digest: str, keep_id: int | None, n: int) -> None:
        """Adds n documents of one text; the smallest id of those seen at insertion names the group."""
        if (live := self.find(digest)) is not None:
            live[0] = min((x for x in (live[0], keep_id) if x is not None), default=None)
            live[1] += n
            return
        self.content.setdefault(self._parts(digest)[0] & 0xFFFF, {})[digest] = [keep_id, n]
        self.size += 1
        if not self._place(digest):
            self._grow()

    def _grow(self) -> None:
        self.resizes += 1
        capacity = self.width * self.SLOTS
        while True:
            capacity *= 2
            self._clear(capacity)
            if all(self._place(x) for held in self.content.values() for x in held):
                return

    def delete(self, digest: str, n: int) -> None:
        """Takes n documents from a live digest; at none it leaves filter and content. Unknown digests are ignored."""
        if (live := self.find(digest)) is None:
            return
        live[1] -= n
        if live[1] <= 0:
            del self.content[self._parts(digest)[0] & 0xFFFF][digest]
            self.size -= 1
            first, second, mark = self._places(digest)
            self.table[first if mark in self.table[first] else second].remove(mark)

    def rows(self):
        for held in self.content.values():
            for digest, (keep_id, n) in held.items():
                yield digest, keep_id, n


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ").cast("binary"), 256)


def _bucket(digest: Column, buckets: int) -> Column:
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(buckets))


def _indexed(bucket: int, index: CuckooIndex) -> pa.Table:
    rows = list(index.rows())
    digests, ids, counts = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"bucket": pa.array([bucket] * len(rows), pa.int64()), "digest": pa.array(digests, pa.string()), "keep_id": pa.array(ids, pa.int64()), "n": pa.array(counts, pa.int64())})


def _fill(table: pa.Table) -> pa.Table:
    index = CuckooIndex()
    for digest, keep_id, n in zip(*(table[k].to_pylist() for k in ("digest", "keep_id", "n")), strict=True):
        index.insert(digest, keep_id, n)
    return _indexed(table["bucket"][0].as_py(), index)


def build_index(keyed: DataFrame, buckets: int) -> DataFrame:
    """The index of live digests: one row (bucket, digest, keep_id, n) per distinct text of keyed (doc_id, digest)."""
    partial = keyed.groupBy("digest", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
    dealt = partial.select(_bucket(F.col("digest"), buckets).alias("bucket"), "digest", "keep_id", "n")
    return dealt.groupBy("bucket").applyInArrow(_fill, INDEX_SCHEMA)


def apply_changes(index: DataFrame, inserted: DataFrame, deleted: DataFrame, buckets: int) -> DataFrame:
    """The index after deleting and then inserting documents, each a frame of (doc_id, digest).

    Buckets must be the number the index was built with. A group keeps its name (keep_id) while any
    of its documents lives, even if the document of that id is deleted. Deleting what isn't there
    changes nothing.
    """
    some = lambda df, sign: df.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), (F.count("*") * sign).alias("n"))
    changes = some(deleted, -1).unionByName(some(inserted, 1)).withColumn("bucket", _bucket(F.col("digest"), buckets))

    def change(old: pa.Table, new: pa.Table) -> pa.Table:
        live = CuckooIndex()
        for x in old.to_pylist():
            live.insert(x["digest"], x["keep_id"], x["n"])
        for x in sorted(new.to_pylist(), key=lambda x: x["n"]):
            if x["n"] < 0:
                live.delete(x["digest"], -x["n"])
            else:
                live.insert(x["digest"], x["keep_id"], x["n"])
        return _indexed((old if len(old) else new)["bucket"][0].as_py(), live)

    return index.groupBy("bucket").cogroup(changes.groupBy("bucket")).applyInArrow(change, INDEX_SCHEMA)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the smallest doc_id of equal texts stays. Null ids come last and stay only where a
    group has no other; of repeated rows with one id just one stays. Null texts count as empty, so
    all null, empty texts are one group. An empty table gives an empty result. Other columns of
    docs are not read.
    """
    keyed = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest")))
    buckets = max(1, -(-keyed.count() // PER_BUCKET))
    index = build_index(keyed, buckets).select("digest", "keep_id", F.col("n").alias("group_size"))
    turn = F.row_number().over(Window.partitionBy("doc_id", "digest").orderBy("doc_id"))
    return (
        keyed.withColumn("turn", turn)
        .join(index, "digest")
        .select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("turn") == 1)).alias("kept"), F.col("digest").alias("text_sha256"))
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs, all its columns, with the one row of each group of equal texts that exact_dedup keeps.

    Null texts count as empty; null ids stay only where a group has no other; of rows with one id and
    equal texts one stays, whichever; an empty table stays empty.
    """
    kept = exact_dedup(docs).where("kept").select("doc_id", "text_sha256")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), text_digest(F.col("text")).alias("digest"))
    stay = rows.join(kept, (F.col("digest") == F.col("text_sha256")) & F.col("id").eqNullSafe(F.col("doc_id")), "left_semi")
    return stay.groupBy("digest", "id").agg(F.first("row").alias("row")).select("row.*")


SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size,
       coalesce(t.doc_id = g.keep_id, t.doc_id IS NULL AND g.keep_id IS NULL)
         AND row_number() OVER (PARTITION BY t.doc_id, t.text_sha256) = 1 AS kept,
       t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
