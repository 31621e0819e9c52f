"""Seats by largest remainder, without a task that sees all keys."""

from tallyweave.operators import review


def test_largest_remainder_without_a_global_window(spark, capsys):
    weights = [(f"k{i:02d}", (i * 37) % 11) for i in range(40)]
    rows = review.largest_remainder(spark.createDataFrame(weights, "key string, weight long"), 97)
    total = sum(w for _, w in weights)
    seats = {k: w * 97 // total for k, w in weights}
    for k, _ in sorted(weights, key=lambda r: (-round(r[1] * 97 / total - r[1] * 97 // total, 9), r[0]))[: 97 - sum(seats.values())]:
        seats[k] += 1
    assert {r["key"]: r["seats"] for r in rows.collect()} == seats and sum(seats.values()) == 97
    rows.explain()
    assert "Window" not in capsys.readouterr().out
