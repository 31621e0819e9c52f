"""Token counts by the sentencepiece library, huge documents by overlap resynchronisation.

A huge text is encoded in overlapping chunks with offsets. Neighbours are spliced at a boundary
that both encodings have and that is proven stable: no vocabulary piece holds the two characters
beside it in a row, so no merge can ever cross it and each side's tokens don't depend on the other.
If an overlap has none, it is widened; if it reaches the chunk's start, the chunk doubles instead.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.piece_codec import MARK, blocks

#: Characters of a chunk; longer texts are cut. Characters that neighbours share at first.
CHUNK, OVERLAP = 16_384, 128
LIMIT = 4096


class Counter:
    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i)))
        self.joined = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        self.widened = 0

    def starts(self, text: str, a: int, b: int) -> np.ndarray:
        """Where the tokens of text[a:b], encoded alone, begin in text."""
        part = text[a:b]
        begin = np.array([p.begin for p in self.model.encode(part, return_type="proto").pieces], np.int64)  # in UTF-8 bytes
        lead = (np.frombuffer(part.encode(), np.uint8) & 0xC0) != 0x80
        return (np.cumsum(lead) - 1)[begin] + a

    def stable(self, text: str, at: int) -> bool:
        return text[at - 1 : at + 1].replace(" ", MARK) not in self.joined

    def long(self, text: str) -> int:
        """Tokens of a text of any length, a chunk at a time."""
        begin, since, end, total = 0, 0, min(self.chunk, len(text)), 0  # the chunk, and from where its tokens count
        tokens = self.starts(text, begin, end)
        while end < len(text):
            overlap = self.overlap
            while True:
                start = max(begin, end - overlap)
                stop = min(len(text), end + self.chunk)
                if start == begin:  # no boundary in the whole chunk: encode twice as much from its start, so all growth costs what the last does
                    end = min(len(text), max(stop, 2 * end - begin))
                    tokens = self.starts(text, begin, end)
                    break
                following = self.starts(text, start, stop)
                common = np.intersect1d(tokens[tokens > max(start, since)], following)
                splice = next((int(x) for x in common[::-1] if self.stable(text, int(x))), None)
                if splice is None:
                    overlap *= 2
                    self.widened += 1
                    continue
                total += int(((tokens >= since) & (tokens < splice)).sum())
                begin, since, end, tokens = start, splice, stop, following
                break
        return total + int((tokens >= since).sum())

    def counts(self, texts: list[str | None]) -> list[int]:
        short = [x if x and len(x) <= self.chunk else "" for x in texts]
        ids = self.model.encode(short, num_threads=1) if short else []
        return [self.long(x) if x and len(x) > self.chunk else len(y) for x, y in zip(texts, ids, strict=True)]


@lru_cache(maxsize=1)
def load(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each whole text.

    Null and empty texts have 0 of both. Repeated rows each give a row; an empty table gives an
    empty result. Other columns are not read. path is the model file's place on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = load(path)
        for batch in batches:
            for part in blocks(batch, 1_000_000):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counter.counts(part.column(1).to_pylist()), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.col("text").cast("string")
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
