"""Canonical forms of references, vendor names, narrations and identifiers, as Column expressions.

A profile is an ordered list of steps, folded over a column when the plan is made. A step that would
blank a value that isn't blank is suppressed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyweave.functions.reference_data import ABBREVIATIONS, LEGAL_SUFFIXES, NOISE_TOKENS, REFERENCE_PREFIXES
from tallyweave.sources.ledger import shuffled

#: Letters that look like Latin ones, and those.
LOOK_ALIKES = ("ıøØłŁđĐðÐþÞßæ", "ioOlLdDdDtTsa")


@F.arrow_udf(StringType())
def _decomposed(text: pa.Array) -> pa.Array:
    import unicodedata

    def fold(x: str | None) -> str | None:
        return x if x is None else unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFKD", x) if not 0x300 <= ord(c) <= 0x36F))

    return pa.array([fold(x) for x in text.to_pylist()], pa.string())


def unicode_fold(c: Column) -> Column:
    """Without combining marks, and look-alikes as ASCII. ASCII values never reach Python's part."""
    beyond = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return F.coalesce(F.translate(_decomposed(beyond), *LOOK_ALIKES), c)


def case_fold(c: Column) -> Column:
    return F.lower(c)


def punctuation_strip(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}]+", " ")


def whitespace_collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def delimiter_segment(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(r"(\p{L}+|\p{N}+|[^\p{L}\p{N}\s]+)"), F.lit(1)), " ")


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def _without(words: Iterable[str]) -> Callable[[Column], Column]:
    stop = list(words)
    return lambda c: F.array_join(F.filter(_tokens(c), lambda t: ~t.isin(stop)), " ")


noise_token_strip = _without(NOISE_TOKENS)
legal_suffix_strip = _without(LEGAL_SUFFIXES)


def abbreviation_expand(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.array_join(F.transform(_tokens(c), lambda t: F.coalesce(F.try_element_at(table, t), t)), " ")


def reference_prefix_strip(c: Column) -> Column:
    """Prefix words go; of a word like inv0042 the digits stay."""
    head, tail = r"^(\p{L}+)(\p{N}.*)$", r"^\p{L}+"
    kept = F.filter(_tokens(c), lambda t: ~t.isin(REFERENCE_PREFIXES))
    return F.array_join(F.transform(kept, lambda t: F.when(F.regexp_extract(t, head, 1).isin(REFERENCE_PREFIXES), F.regexp_replace(t, tail, "")).otherwise(t)), " ")


def leading_zero_strip(c: Column) -> Column:
    return F.array_join(F.transform(_tokens(c), lambda t: F.regexp_replace(t, r"^0+([0-9]+)$", "$1")), " ")


def token_sort(c: Column, dedupe: bool = False) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(_tokens(c)) if dedupe else _tokens(c)), " ")


def identifier_repair(c: Column) -> Column:
    """15 characters of the tax identifier's layout, with optical confusions of letters and digits undone."""
    packed = F.upper(F.regexp_replace(c, r"[^0-9A-Za-z]", ""))
    digit, letter = (lambda x: F.translate(x, "ODILZSB", "0011258")), (lambda x: F.translate(x, "01258", "OIZSB"))
    kinds = [digit] * 2 + [letter] * 5 + [digit] * 4 + [letter] + [lambda x: x] + [letter] + [lambda x: x]
    fixed = F.concat(*[kind(F.substring(packed, i + 1, 1)) for i, kind in enumerate(kinds)])
    return F.when(F.length(packed) == 15, fixed).otherwise(packed)


STEPS: dict[str, Callable[[Column], Column]] = {f.__name__: f for f in (unicode_fold, case_fold, punctuation_strip, whitespace_collapse, delimiter_segment, reference_prefix_strip, abbreviation_expand, leading_zero_strip, token_sort, identifier_repair)}
STEPS |= {"noise_token_strip": noise_token_strip, "legal_suffix_strip": legal_suffix_strip}

_BASE = ["unicode_fold", "case_fold", "punctuation_strip", "whitespace_collapse"]
PROFILES: dict[str, list[str]] = {
    "vendor.v1": [*_BASE, "noise_token_strip", "legal_suffix_strip", "abbreviation_expand"],
    "reference.v1": [*_BASE, "reference_prefix_strip", "leading_zero_strip"],
    "reference.v2": [*_BASE, "delimiter_segment", "reference_prefix_strip", "leading_zero_strip"],
    "narration.v1": [*_BASE, "noise_token_strip", "legal_suffix_strip", "abbreviation_expand"],
    "identifier.v1": ["unicode_fold", "identifier_repair"],
    "scan.v1": ["unicode_fold", "case_fold", "punctuation_strip", "whitespace_collapse"],
}


def _steps(c: Column, profile: str, without: Iterable[str]) -> Column:
    """A struct of the final value and the names of the steps that changed it.

    Each step's value is bound in a one-element array, so the expression grows with the number of
    steps and no more. unicode_fold may run in Python, so it stays outside of them.
    """
    skip = set(without)
    names = [s for s in PROFILES[profile] if s not in skip]
    first = F.when((F.trim(unicode_fold(c)) == "") & (F.trim(c) != ""), c).otherwise(unicode_fold(c)) if "unicode_fold" in names else c
    none = F.array().cast("array<string>")
    state = F.struct(first.alias("value"), F.when(first != c, F.array(F.lit("unicode_fold"))).otherwise(none).alias("marks"))

    def stepped(step: Callable[[Column], Column]) -> Callable[[Column], Column]:
        return lambda x: F.struct(x.alias("state"), step(x["value"]).alias("new"))

    def guarded(name: str) -> Callable[[Column], Column]:
        def run(pair: Column) -> Column:
            old, new = pair["state"]["value"], pair["new"]
            stays = ((F.trim(new) == "") & (F.trim(old) != "")) | (new == old)
            marks = F.when(stays, pair["state"]["marks"]).otherwise(F.concat(pair["state"]["marks"], F.array(F.lit(name))))
            return F.struct(F.when(stays, old).otherwise(new).alias("value"), marks.alias("marks"))

        return run

    box = F.array(state)
    for name in names:
        if name != "unicode_fold":
            box = F.transform(F.transform(box, stepped(STEPS[name])), guarded(name))
    return F.get(box, F.lit(0))


def normalise(c: Column, profile: str, without: Iterable[str] = ()) -> Column:
    """The profile's steps in order, but those switched off; null stays null."""
    return _steps(c, profile, without)["value"]


def changed_steps(c: Column, profile: str, without: Iterable[str] = ()) -> Column:
    """The rule string '<profile>:<step>+<step>' of the steps that changed the value."""
    return F.concat(F.lit(f"{profile}:"), F.array_join(_steps(c, profile, without)["marks"], "+"))


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]+", "")


def duplicate_key(c: Column) -> Column:
    """The duplicate family's reference: upper-case ASCII letters and digits, nothing else."""
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def token_class(t: Column) -> Column:
    shape = r"^[0-9]{2}[A-Za-z]{5}[0-9]{4}[A-Za-z][0-9A-Za-z][A-Za-z][0-9A-Za-z]$"
    return (
        F.when((t == "") | t.isin(NOISE_TOKENS), "noise")
        .when(t.rlike(shape), "identifier")
        .when(t.rlike(r"^\p{N}+$"), "numeric")
        .when(t.rlike(r"\p{N}") & t.rlike(r"\p{L}"), "mixed_alphanumeric")
        .otherwise("word")
    )


def classified_tokens(rows: DataFrame, key: str, text: str, scan: Iterable[str] = ("case_fold", "punctuation_strip", "whitespace_collapse")) -> DataFrame:
    """key, index, token, klass of every token of a field."""
    value = reduce(lambda c, s: STEPS[s](c), scan, F.col(text))
    return rows.select(key, F.posexplode(_tokens(value)).alias("index", "token")).withColumn("klass", token_class(F.col("token")))


def names_in(c: Column) -> Column:
    """The words of a narration that may name a vendor: neither noise nor numbers nor identifiers."""
    tokens = _tokens(reduce(lambda x, s: STEPS[s](x), ("case_fold", "punctuation_strip", "whitespace_collapse"), c))
    return F.array_join(F.filter(tokens, lambda t: token_class(t) == "word"), " ")


def residue(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, residue, identifiers: the words of a field that may name a vendor, and how many tokens have the shape of an identifier."""
    tokens = _tokens(reduce(lambda c, s: STEPS[s](c), ("case_fold", "punctuation_strip", "whitespace_collapse"), F.col(text)))
    of = lambda klass: F.filter(tokens, lambda t: token_class(t) == klass)
    return rows.select(key, F.array_join(of("word"), " ").alias("residue"), F.size(of("identifier")).cast("long").alias("identifiers"))


def displaced_tokens(tokens: DataFrame, field: str, least: int = 3) -> DataFrame:
    """Tokens whose class belongs to another field than the one they are in."""
    home = F.when(F.col("klass") == "identifier", "identifier").when(F.col("klass").isin("numeric", "mixed_alphanumeric"), "reference").when(F.col("klass") == "word", "vendor")
    out = tokens.withColumn("belongs_to", home).where(F.col("belongs_to").isNotNull() & (F.col("belongs_to") != field))
    out = out.where((F.col("klass") != "numeric") | (F.length("token") >= least))
    return out.where(F.col("belongs_to") != "vendor") if field == "narration" else out


def reference_numbers(text: Column, least: int = 4) -> Column:
    """The distinct numbers of at least so many digits that a text quotes, years apart, without leading zeros.

    Of a fused year and number, as in inv20240000042, the number counts too.
    """
    runs = F.regexp_extract_all(text, F.lit(f"(?=[0-9]{{{least}}})(?<![0-9])(?!(?:19|20)[0-9]{{2}}(?![0-9]))0*([0-9]+)"), F.lit(1))
    fused = F.regexp_extract_all(text, F.lit("(?i:inv)(?:19|20)[0-9]{2}(?=[0-9]{4})0*([0-9]+)"), F.lit(1))
    return F.array_distinct(F.concat(runs, fused))


def reference_keys(rows: DataFrame, key: str, text: str, least: int = 4) -> DataFrame:
    """key, number: the reference_numbers of a text, one a row."""
    return rows.select(key, F.explode(reference_numbers(F.col(text), least)).alias("number"))


def quoted_pairs(documents: DataFrame, lines: DataFrame, *also: str) -> DataFrame:
    """Rows of documents beside the rows of lines that share a number with them, each pair once.

    Both have numbers (reference_numbers); rows also agree in the columns of also. A pair that shares more
    than one number meets at the least of them, so no distinct over pairs is needed. Rows without numbers
    meet nothing, but for explode() Spark would look for them first, and so work the numbers out again.
    """
    left = documents.withColumn("number", F.explode_outer("numbers"))
    right = lines.withColumnRenamed("numbers", "quoted").withColumn("number", F.explode_outer("quoted"))
    alone = (F.size("numbers") == 1) | (F.size("quoted") == 1)
    met = left.join(shuffled(right), ["number", *also])
    return met.where(alone | (F.col("number") == F.array_min(F.array_intersect("numbers", "quoted")))).drop("number", "numbers", "quoted", *also)
