"""References that a bank line's narration quotes in pieces: bonds between pieces, runs, candidates.

One narration gives any number of references, found by a scan over its pieces in order. The scan is
a small function per value inside an Arrow batch; everything around it is DataFrame operations.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from tallyweave.functions.reference_data import LEGAL_SUFFIXES, NOISE_TOKENS, REFERENCE_PREFIXES

PIECE = re.compile(r"[^\W_]+", re.UNICODE)
#: Pieces of a run, letters of a series code, and digits of a document-length piece.
MOST_PIECES, MOST_CODE, LEAST = 6, 4, 3
_NOISE, _PREFIX, _LEGAL = frozenset(NOISE_TOKENS), frozenset(REFERENCE_PREFIXES), frozenset(LEGAL_SUFFIXES)


def bonds(text: str) -> list[tuple[str, str]]:
    """(piece, bond to the one before): tight, space or break; a list separator or the start breaks."""
    out, end = [], None
    for m in PIECE.finditer(text):
        gap = "," if end is None else text[end : m.start()]
        out.append((m.group().lower(), "break" if re.search(r"[,;|&+\n]", gap) else "space" if re.search(r"\s", gap) else "tight"))
        end = m.end()
    return out


def _is_code(piece: str) -> bool:
    return piece.isalpha() and (piece in _PREFIX or (len(piece) <= MOST_CODE and piece not in _NOISE and piece not in _LEGAL))


def runs(pieces: list[tuple[str, str]]) -> list[tuple[list[int], str]]:
    """(places, joined) of the numeric pieces that read as one number, with the series code before them."""
    numeric = [p.isdigit() for p, _ in pieces]

    def reaches(k: int) -> bool:
        """A document-length piece follows from k on, over numbers alone."""
        while k < len(pieces) and numeric[k]:
            if len(pieces[k][0]) >= LEAST:
                return True
            k += 1
            if k < len(pieces) and pieces[k][1] == "break":
                return False
        return False

    def following(k: int) -> int | None:
        """The number that continues a run ending at k, across one prefix word at most."""
        for step in (1, 2):
            to = k + step
            if to >= len(pieces) or any(b == "break" for _, b in pieces[k + 1 : to + 1]):
                return None
            if numeric[to]:
                loose = any(b == "space" for _, b in pieces[k + 1 : to + 1])
                return to if not loose or reaches(to) else None
            if pieces[to][0] not in _PREFIX:
                return None
        return None

    out, k = [], 0
    while k < len(pieces):
        if not numeric[k]:
            k += 1
            continue
        places = [k]
        while (to := following(places[-1])) is not None:
            places.append(to)
        code = [pieces[k - 1][0]] if k and pieces[k][1] != "break" and _is_code(pieces[k - 1][0]) else []
        words = [pieces[i][0] for i in places]
        if len(places) <= MOST_PIECES and any(len(w) >= LEAST for w in words) and (len(places) > 1 or code):
            out.append((places, " ".join(code + words)))
        k = places[-1] + 1
    return out


def references(text: str | None) -> list[str]:
    """Reference candidates in order: long numbers and mixed pieces outside of runs, then whole runs."""
    pieces = bonds(text or "")
    found = runs(pieces)
    inside = {i for places, _ in found if len(places) > 1 for i in places}
    out: dict[str, None] = {}
    for i, (piece, _) in enumerate(pieces):
        if i in inside:
            continue
        if piece.isdigit():
            if len(piece) >= LEAST:
                out[piece] = None
        elif any(c.isdigit() for c in piece) and any(c.isalpha() for c in piece):
            head = re.match(r"[^\W\d_]+", piece)
            if not (head and head.group() in _NOISE and head.group() not in _PREFIX):
                out[piece] = None
    return list(out | {joined: None for _, joined in found})


@F.arrow_udf(ArrayType(StringType()))
def _references(text: pa.Array) -> pa.Array:
    return pa.array([references(x) for x in text.to_pylist()], pa.list_(pa.string()))


def quoted_references(text: Column) -> Column:
    """The references of a narration, as an array; null narrations quote nothing."""
    return F.coalesce(_references(text), F.array().cast("array<string>"))


def narration_references(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, turn, reference: what each narration quotes. Null narrations quote nothing."""
    return rows.select(key, F.posexplode(_references(F.col(text))).alias("turn", "reference"))


def aliases_from_vendors(vendors: DataFrame, name: Column) -> DataFrame:
    """key, vendor_id: canonical names; of vendors that share one the least id owns it."""
    return vendors.select(name.alias("key"), "vendor_id").where("key <> ''").groupBy("key").agg(F.min("vendor_id").alias("vendor_id"))


def merged_aliases(*tables: DataFrame) -> DataFrame:
    """Alias tables in one; a later table's entry wins."""
    parts = [t.withColumn("turn", F.lit(i)) for i, t in enumerate(tables)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("key").agg(F.max_by("vendor_id", "turn").alias("vendor_id"))


def resolve_aliases(rows: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """Rows with vendor_id of the alias that their canonical name is, or null."""
    return rows.join(aliases.withColumnRenamed("key", key), key, "left")
