"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

A vocabulary whose pieces hold the space mark only in front never merges across a word (a run of
marks and what follows up to the next mark), so words are encoded apart, each distinct word once.
All distinct words of a block lie in flat numpy symbol arrays. A round finds each word's minimum
pair rank (a segmented minimum), merges the leftmost pair of that rank in all words at once,
compacts the arrays, and looks up the two pairs beside each merge; words without a pair leave.
Long words have rounds of their own that merge all pairs of the least rank, the leftmost first.
Results equal the sentencepiece library's, which the tests compare.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_NONE = np.int32(2**31 - 1)
#: Words of more symbols have rounds of their own, which merge all pairs of a rank: together with others', rounds would be as many as symbols.
LONG = 512
#: Distinct words kept between blocks, and characters in a block.
KEPT, BLOCK_CHARS = 300_000, 2_000_000


class _Seen(dict):
    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        return at


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places starts[i] .. starts[i] + counts[i] - 1 of all i, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


class PieceModel:
    """A BPE model file with byte fallback and no normalisation but the space mark and a dummy prefix."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        rule, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        if model.trainer_spec.model_type != 2 or rule.precompiled_charsmap or rule.remove_extra_whitespaces or not rule.add_dummy_prefix or not rule.escape_whitespaces or kinds & {4, 5} or 6 not in kinds:
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no other normalisation are supported")
        self.size = len(model.pieces)
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece crosses the start of a word")
        self._normal = normal
        scores = np.array([p.score for p in model.pieces])
        order = {s: i for i, s in enumerate(sorted({float(scores[i]) for p, i in normal.items() if len(p) > 1}, reverse=True))}
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for piece, at in normal.items():
            for k in range(1, len(piece)):
                left, right = self._symbol(piece[:k]), self._symbol(piece[k:])
                if left is not None and right is not None:
                    pairs[left, right] = order[float(scores[at])], at
        own = {i: order[float(scores[i])] for p, i in normal.items() if len(p) > 1}
        #: Ranks of pieces that are part of a pair of no higher rank.
        self._unsafe = {own[x] for pair, (rank, _) in pairs.items() for x in pair if x in own and rank <= own[x]}
        self._span = self.size + 0x110000
        keys = np.array([a * self._span + b for a, b in pairs], np.int64)
        by = np.argsort(keys)
        self._keys = keys[by]
        self._pairs = {a * self._span + b: made for (a, b), made in pairs.items()}
        self._ranks, self._made = (np.array([v[k] for v in pairs.values()], np.int32)[by] for k in (0, 1))
        self._bytes = np.array([next((i for i, p in enumerate(model.pieces) if p.piece == f"<0x{b:02X}>"), 0) for b in range(256)])
        raw = [bytes([int(p.piece[3:5], 16)]) if p.type == 6 else b"" if p.type == 3 else model.trainer_spec.unk_surface.encode() if p.type == 2 else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        self._raw = np.frombuffer(b"".join(raw), np.uint8)
        self._raw_len = np.array([len(x) for x in raw])
        self._raw_at = np.cumsum(self._raw_len) - self._raw_len
        self._is_byte = np.array([p.type == 6 for p in model.pieces])
        self._opens = np.array([p.type == 1 and p.piece.startswith(MARK) for p in model.pieces])
        self._forget()

    def _symbol(self, text: str) -> int | None:
        """The id of a piece, else size + code point of a single character, else None."""
        return self._normal.get(text, self.size + ord(text) if len(text) == 1 else None)

    def _forget(self) -> None:
        self._seen = _Seen()
        self._ids, self._counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self._span + right
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        hit = self._keys[at] == key
        return np.where(hit, self._ranks[at], _NONE), self._made[at]

    def _long(self, symbols: np.ndarray) -> np.ndarray:
        """One long word, a rank a round: all its pairs of the least rank merge at once, the leftmost of overlapping ones.

        That is the order of single merges as long as no merge makes a pair of no higher rank; from the
        first one that does, the round goes on merge by merge. Symbols stay in place, linked past merged
        ones, so a round costs what it merges.
        """
        n = len(symbols)
        symbols, ahead, back = symbols.copy(), np.arange(1, n + 1), np.arange(-1, n - 1)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(at: np.ndarray) -> None:
            rank, _ = self._look(symbols[at], symbols[ahead[at]])
            at, rank = at[rank < _NONE], rank[rank < _NONE]
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            first = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, own in zip(rank[first].tolist(), np.split(at, first[1:]), strict=True) if len(at) else ():
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(own)

        wait(np.arange(n - 1))
        while ranks:
            least = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(least)))
            at = at[(symbols[at] >= 0) & (ahead[at] < n)]
            rank, made = self._look(symbols[at], symbols[ahead[at]])
            at, made = at[rank == least], made[rank == least]  # others merged meanwhile
            if not len(at):
                continue
            number = np.arange(len(at))
            begins = np.append(True, ahead[at[:-1]] != at[1:])  # a run of overlapping pairs
            take = (number - np.maximum.accumulate(np.where(begins, number, 0))) % 2 == 0
            rest = at[:0]
            if least in self._unsafe and len(at) > 1:  # up to the first merge that makes a pair of no higher rank
                own, new = at[take], made[take].astype(np.int64)
                right, left = ahead[ahead[own]], back[own]
                beside = [np.where(left >= 0, self._look(symbols[left], new)[0], _NONE), np.where(right < n, self._look(new, symbols[np.minimum(right, n - 1)])[0], _NONE)]
                beside.append(np.append(np.where(right[:-1] == own[1:], self._look(new[:-1], new[1:])[0], _NONE), _NONE))
                early = np.flatnonzero(np.minimum.reduce(beside) <= least)
                if len(early):
                    rest = at[at >= own[early[0]]]
                    take &= at < own[early[0]]
            at, made = at[take], made[take]
            gone = ahead[at]
            symbols[at], symbols[gone] = made, -1
            ahead[at] = ahead[gone]
            inner = ahead[at] < n
            back[ahead[at[inner]]] = at[inner]
            beside = np.unique(np.append(at, self._one_by_one(symbols, ahead, back, rest, least)) if len(rest) else at)
            beside = beside[symbols[beside] >= 0]
            beside = np.unique(np.concatenate([back[beside][back[beside] >= 0], beside]))
            wait(beside[ahead[beside] < n])
        return symbols[symbols >= 0]

    def _one_by_one(self, symbols: np.ndarray, ahead: np.ndarray, back: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
        """Merges pairs of rank least at these places, the leftmost first, and whatever pairs of no higher rank that makes; the places merged."""
        n, span, get, heap, merged = len(symbols), self._span, self._pairs.get, [], []
        whole = len(at) * 16 > n  # lists are faster than arrays, and cost what they hold
        s, f, b = (x.tolist() if whole else x for x in (symbols, ahead, back))
        places = iter(at.tolist())
        place = next(places, n)
        while heap or place < n:
            if heap and heap[0] < (least, place):
                rank, p = heapq.heappop(heap)
            else:
                rank, p, place = least, place, next(places, n)
            if s[p] < 0 or (q := f[p]) >= n or (found := get(int(s[p] * span + s[q]))) is None or found[0] != rank:
                continue
            made, r, left = found[1], f[q], b[p]
            s[p], s[q], f[p] = made, -1, r
            merged.append(p)
            if left >= 0 and (found := get(int(s[left] * span + made))) is not None and found[0] <= least:
                heapq.heappush(heap, (found[0], int(left)))
            if r < n:
                b[r] = p
                if (found := get(int(made * span + s[r]))) is not None and found[0] <= least:
                    heapq.heappush(heap, (found[0], p))
        if whole:
            symbols[:], ahead[:], back[:] = s, f, b
        return np.array(merged, np.int64)

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and their number per word."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        kinds, which = np.unique(points, return_inverse=True)
        table = np.array([self._symbol(chr(c)) for c in kinds.tolist()], np.int64)
        symbols = table[which] if len(kinds) else points
        owner = np.arange(len(words))
        done_words, done_symbols = [], []
        if (lens > LONG).any():
            at = np.cumsum(lens) - lens
            for w in np.flatnonzero(lens > LONG).tolist():
                got = self._long(symbols[at[w] : at[w] + lens[w]])
                done_words.append(np.full(len(got), w))
                done_symbols.append(got)
            short = lens <= LONG
            symbols, owner, lens = symbols[np.repeat(short, lens)], owner[short], lens[short]
        starts = np.cumsum(lens) - lens
        rank, made = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int32)
        if len(symbols) > 1:
            rank[:-1], made[:-1] = self._look(symbols[:-1], symbols[1:])
            rank[starts[1:] - 1] = _NONE
            rank[-1] = _NONE
        while len(lens):
            best = np.minimum.reduceat(rank, starts)
            live = best < _NONE
            if not live.all():
                stay = np.repeat(live, lens)
                done_words.append(np.repeat(owner[~live], lens[~live]))
                done_symbols.append(symbols[~stay])
                symbols, rank, made = symbols[stay], rank[stay], made[stay]
                owner, lens, best = owner[live], lens[live], best[live]
                starts = np.cumsum(lens) - lens
                if not len(lens):
                    break
            match = np.flatnonzero(rank == np.repeat(best, lens))
            word = np.searchsorted(starts, match, "right") - 1
            at = match[np.flatnonzero(np.diff(word, prepend=-1))]  # the leftmost of each word
            symbols[at] = made[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, rank, made = symbols[keep], rank[keep], made[keep]
            at -= np.arange(len(at))
            lens = lens - 1
            starts = np.cumsum(lens) - lens
            last = starts + lens - 1
            rank[last] = _NONE
            for x in (at[at > starts] - 1, at[at < last]):
                rank[x], made[x] = self._look(symbols[x], symbols[x + 1])
        words_of = np.concatenate([*done_words, np.zeros(0, np.int64)]).astype(np.int64)
        symbols = np.concatenate([*done_symbols, np.zeros(0, np.int64)]).astype(np.int64)
        by = np.argsort(words_of, kind="stable")
        words_of, symbols = words_of[by], symbols[by]
        unknown = symbols >= self.size
        if unknown.any():  # a character without a piece becomes its UTF-8 bytes
            raw = [chr(c - self.size).encode() for c in symbols[unknown].tolist()]
            width = np.ones(len(symbols), np.int64)
            width[unknown] = [len(x) for x in raw]
            symbols, words_of = np.repeat(symbols, width), np.repeat(words_of, width)
            symbols[np.repeat(unknown, width)] = self._bytes[np.frombuffer(b"".join(raw), np.uint8)]
        return symbols.astype(np.int32), np.bincount(words_of, minlength=len(words))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and n + 1 offsets. Null and empty texts have none."""
        if len(self._seen) > KEPT:
            self._forget()
        known, places, sizes = len(self._seen), [], []
        get = self._seen.__getitem__
        for text in texts:
            if not text:
                sizes.append(0)
                continue
            if text[0] == " " or "  " in text or MARK in text:
                words = _WORD.findall(MARK + text.replace(" ", MARK))
            else:
                words = [MARK + x for x in text.split(" ")]
            places.append(np.fromiter(map(get, words), np.int64, len(words)))
            sizes.append(len(words))
        if len(self._seen) > known:
            fresh = list(self._seen)[known:]
            ids, counts = self._merge(fresh)
            self._ids, self._counts = np.append(self._ids, ids), np.append(self._counts, counts)
        place = np.concatenate([*places, np.zeros(0, np.int64)])
        at = np.cumsum(self._counts) - self._counts
        counts = self._counts[place]
        before = np.append(0, np.cumsum(counts))
        return self._ids[_ragged(at[place], counts)], before[np.append(0, np.cumsum(np.array(sizes, np.int64)))]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of id lists, as an Arrow string column: bytes gathered piece by piece, the dummy space dropped."""
        width = self._raw_len[ids]
        data = self._raw[_ragged(self._raw_at[ids], width)]
        ends = np.append(0, np.cumsum(width))[offsets]
        some = np.flatnonzero(np.diff(offsets) > 0)
        strip = some[self._opens[ids[offsets[some]]]]
        keep = np.ones(len(data), bool)
        keep[ends[strip]] = False
        data = data[keep]
        cuts = np.zeros(len(offsets), np.int64)
        cuts[strip + 1] = 1
        ends = ends - np.cumsum(cuts)
        out = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
        try:
            out.validate(full=True)
            return out
        except pa.ArrowInvalid:  # bytes that no text encodes to: each bad byte of a run becomes U+FFFD
            return pa.array([self._careful(ids[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.large_string())

    def _careful(self, ids: np.ndarray) -> str:
        out, run = [], b""
        for i in [*ids.tolist(), None]:
            if i is not None and self._is_byte[i]:
                run += bytes([self._raw[self._raw_at[i]]])
                continue
            while run:
                for n in range(1, 5):
                    try:
                        out.append(run[:n].decode())
                        run = run[n:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    run = run[1:]
            if i is not None:
                out.append(bytes(self._raw[self._raw_at[i] : self._raw_at[i] + self._raw_len[i]]).decode())
        text = "".join(out)
        return text[1:] if len(ids) and self._opens[ids[0]] else text


@lru_cache(maxsize=1)
def load(path: str) -> PieceModel:
    return PieceModel(path)


def blocks(batch: pa.RecordBatch, most: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about most bytes of text (its column "text"), one row at least."""
    text = batch.column(batch.schema.get_field_index("text")).cast(pa.large_string())
    size = np.nan_to_num(pa.compute.binary_length(text).to_numpy(zero_copy_only=False).astype(float))
    part = (np.cumsum(size) // most).astype(np.int64)
    edges = [*np.flatnonzero(np.diff(part, prepend=-1)).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string: each whole text's ids, and the text those ids decode to.

    Null and empty texts have no ids and decode to the empty string. Repeated rows each give a row;
    an empty table gives an empty result. Other columns are not read. path is the model file's place
    on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for part in blocks(batch):
                ids, at = model.encode(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, model.decode(ids, at).cast(pa.string())], names=["doc_id", "ids", "decoded"])
        model._forget()  # a worker outlives its task; words needn't

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def codec_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256."""
    return encode_decode(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
