"""The radius search loses no pair at radii that don't divide the bits evenly."""

import random

import pyarrow as pa
import pytest

from tallyweave.llm import fingerprints


@pytest.mark.parametrize("radius", [13, 16, 20])
def test_radius_search_with_a_bit_in_every_block(spark, radius):
    size = -(-128 // (radius + 1))  # of equal blocks, as many as fit
    blocks = -(-128 // size)
    other = sum(1 << (127 - k * size) for k in range(blocks))
    pairs = [(0).to_bytes(16, "big"), other.to_bytes(16, "big")]
    rows = spark.createDataFrame([(bytearray(p),) for p in pairs], "fp binary")
    got = {(bytes(r["query"]), bytes(r["entry"])): r["distance"] for r in fingerprints.within_radius(rows, rows, radius).collect()}
    assert blocks <= radius and got[pairs[0], pairs[1]] == blocks and len(got) == 4


def test_radius_query_equals_brute_force(spark, tmp_path):
    from tallyweave.llm.queries import simhash_radius

    rng = random.Random(8)
    words = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(60)] for _ in range(12)]
    rows = [(i, " ".join(words[i % 12][: 60 - (i // 40)])) for i in range(120)] + [(120, None), (121, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["other_id"], r["distance"]) for r in simhash_radius(spark, str(tmp_path)).collect()}
    prints = {i: int.from_bytes(x.tobytes(), "big") for (i, _), x in zip(rows, fingerprints.simhash(pa.array([t for _, t in rows])), strict=True)}
    least = {}
    for i in sorted(prints, reverse=True):
        least[prints[i]] = i
    want = {(q, least[p], (prints[q] ^ p).bit_count()) for q in prints if q % 20 == 0 for p in least if (prints[q] ^ p).bit_count() <= 3}
    assert got == want and any(d for *_, d in got)
