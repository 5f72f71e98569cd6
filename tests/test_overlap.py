"""Overlaps of all entries with all alerts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from stormglass.operators import overlap


def test_pairs_and_counts_against_sets(spark, monkeypatch):
    monkeypatch.setattr(overlap, "PART_BUCKETS", 1)
    rng = random.Random(2)
    code = lambda: rng.choice(["", None, *(f"c{i}" for i in range(40))])
    entries = [(f"e{i}", [code() for _ in range(rng.randrange(4))]) for i in range(30)] + [("all", ["everywhere"]), ("e0", ["c1"]), (None, ["c1"]), ("none", None)]
    alerts = [(i, ["everywhere", *(code() for _ in range(rng.randrange(3)))]) for i in range(300)] + [(5, ["c2"]), (None, ["c1"]), (900, None), (901, [])]
    e, a = spark.createDataFrame(entries, "entry_id string, regions array<string>"), spark.createDataFrame(alerts, "id long, geocode_same array<string>")
    want = {(x, i) for x, own in entries for i, codes in alerts if x is not None and i is not None and {c for c in own or [] if c} & {c for c in codes or [] if c}}
    numbers = overlap.numbered(a)
    found = overlap.matches(e, a, numbers)
    got = [tuple(r) for r in overlap.pairs(found, numbers).collect()]
    assert set(got) == want and len(got) == len(want)
    assert {tuple(r) for r in overlap.counts(found).collect()} == {(x, sum(y == x for y, _ in want)) for x, _ in want}
    assert overlap.pairs(overlap.matches(e.limit(0), a, numbers), numbers).collect() == [] and overlap.matches(e, a.limit(0), numbers.limit(0)).collect() == []


def test_a_code_of_all_alerts_is_bits_and_not_rows(spark):
    alerts = spark.range(70_000).select(F.col("id"), F.array(F.lit("all")).alias("geocode_same"))
    entries = spark.range(3).select(F.col("id").alias("entry_id"), F.array(F.lit("all")).alias("regions"))
    numbers = overlap.numbered(alerts)
    found = overlap.matches(entries, alerts, numbers)
    assert found.count() == 9 and {tuple(r) for r in overlap.counts(found).collect()} == {(i, 70_000) for i in range(3)}


def test_lists_of_codes_with_long_ones_against_sets(spark, monkeypatch):
    monkeypatch.setattr(overlap, "PART", 7)
    monkeypatch.setattr(overlap, "LONG", 6)
    rng = random.Random(3)
    code = lambda: rng.choice(["", None, *(f"c{i}" for i in range(30))])
    entries = [(f"e{i}", [code() for _ in range(rng.choice([0, 1, 2, 3, 6, 12]))]) for i in range(40)] + [("all", ["everywhere", "c1"]), ("e0", ["c1", "c1"]), (None, ["c1"]), ("none", None)]
    alerts = [(i, ["everywhere", *(code() for _ in range(rng.choice([0, 1, 3, 5, 9])))]) for i in range(200)] + [(5, ["c2"]), (None, ["c1"]), (900, None), (901, [])]
    names = lambda rows: {k: {c for key, codes in rows if key == k for c in codes or [] if c} for k, _ in rows if k is not None}
    kinds = ("entry_id string, regions array<string>", "id long, geocode_same array<string>")
    for few_entries, few_alerts in ((entries, alerts), ([x for x in entries if len(x[1] or []) < 4], [x for x in alerts if len(x[1] or []) < 5]), ([], alerts), (entries, [])):
        e, a = spark.createDataFrame(few_entries, kinds[0]), spark.createDataFrame(few_alerts, kinds[1])
        want = {(x, i) for x, own in names(few_entries).items() for i, codes in names(few_alerts).items() if own & codes}
        got = [tuple(r) for r in overlap.paired(e, a).collect()]
        assert set(got) == want and len(got) == len(want)
        assert {tuple(r) for r in overlap.counted(e, a).collect()} == {(x, sum(y == x for y, _ in want)) for x, _ in want}


def test_pairs_are_not_shuffled_and_counts_make_no_pairs(spark, tmp_path):
    entries = spark.range(3000).select(F.col("id").alias("entry_id"), F.array(F.lit("all"), F.concat(F.lit("c"), (F.col("id") % 7).cast("string"))).alias("regions"))
    alerts = spark.range(3000).select("id", F.array(F.lit("all"), F.concat(F.lit("d"), (F.col("id") % 7).cast("string"))).alias("geocode_same"))
    written = lambda: sum(x.totalShuffleWrite() for x in (lambda s: [s.apply(i) for i in range(s.size())])(spark._jsc.sc().statusStore().executorList(False)))
    before = written()
    overlap.paired(entries, alerts).write.format("noop").mode("overwrite").save()
    assert overlap.counted(entries, alerts).agg(F.min("n_alerts"), F.max("n_alerts"), F.count("entry_id")).first() == (3000, 3000, 3000)
    # 9 million pairs; as rows or as bitmaps of each entry they are tens of MB.
    assert written() - before < 2_000_000


def test_pairs_that_share_several_codes_are_not_listed(spark):
    both = lambda name: F.array(F.lit("all"), F.lit("one"), F.lit("two")).alias(name)
    entries, alerts = spark.range(3000).select(F.col("id").alias("entry_id"), both("regions")), spark.range(3000).select("id", both("geocode_same"))
    written = lambda: sum(x.totalShuffleWrite() for x in (lambda s: [s.apply(i) for i in range(s.size())])(spark._jsc.sc().statusStore().executorList(False)))
    before = written()
    assert overlap.paired(entries, alerts).agg(F.count(F.lit(1)), F.countDistinct("entry_id"), F.sum("id")).first() == (9_000_000, 3000, 3000 * 2999 * 1500)
    assert written() - before < 2_000_000


def test_a_result_of_many_pairs_takes_little_disk(spark, tmp_path):
    entries = spark.range(30).select(F.col("id").alias("entry_id"), F.array(F.lit("all")).alias("regions"))
    alerts = spark.range(400_000).select((F.col("id") * 7919 % 400_000).alias("id"), F.array(F.lit("all")).alias("geocode_same"))
    overlap.paired(entries, alerts).write.parquet(str(tmp_path / "pairs"))
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == 12_000_000
    # Ids alone are 96 MB.
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 12_000_000
