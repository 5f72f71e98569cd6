"""Places in a global order."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from stormglass.operators.order import placed


def test_places_of_all_rows_with_ties_and_nulls(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, "a", "b", "é", "Z"]), rng.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "row string, at int, tie int")
    got = placed(df, [(F.col("row"), True), F.col("at"), F.col("tie")]).collect()
    key = lambda r: (r[0] is None, [-b for b in (r[0] or "").encode()], r[1], r[2])
    assert [(r["row"], r["at"], r["tie"]) for r in sorted(got, key=lambda r: r.place)] == sorted(rows, key=key)
    assert sorted(r.place for r in got) == list(range(500)) and {r.size for r in got} == {500}


def test_places_within_groups_one_of_which_has_most_rows(spark):
    rows = [("hot" if i % 10 else None if i % 20 else f"g{i}", i * 7919 % 1000) for i in range(1000)]
    got = placed(spark.createDataFrame(rows, "g string, v int"), [F.col("v")], by=[F.col("g")], place="p", size="n").collect()
    for group in {g for g, _ in rows}:
        mine = sorted((r for r in got if r.g == group), key=lambda r: r.p)
        assert [r.v for r in mine] == sorted(v for g, v in rows if g == group)
        assert [r.p for r in mine] == list(range(len(mine))) and {r.n for r in mine} == {len(mine)}


def test_equal_rows_spread_over_ranges_and_no_window_sees_all(spark):
    df = spark.range(5000).select(F.lit("x").alias("x"))
    out = placed(df, [F.col("x")])
    assert sorted(r.place for r in out.collect()) == list(range(5000))
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert placed(df.limit(0), [F.col("x")]).collect() == [] and placed(df.limit(0), [F.col("x")], by=[F.col("x")]).collect() == []
