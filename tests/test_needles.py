"""Needles from a table."""

from __future__ import annotations

import random

import pytest

from stormglass.operators import needles as needle_join
from stormglass.operators.needles import first_needles, index


@pytest.mark.parametrize("few", [10**5, 0])
def test_first_needle_against_all_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(needle_join, "BROADCAST_ROWS", few)
    monkeypatch.setattr(needle_join, "WINDOW", 1000)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcé😀 ") for _ in range(rng.randrange(1, 8)))
    texts = [(i, " ".join(word() for _ in range(rng.randrange(0, 30)))) for i in range(200)] + [(900, None), (901, ""), (902, "x" * 70_000 + "needle\n?"), (903, "same"), (903, "other abc")]
    needles = [(word(), i) for i in range(300)] + [("needle\n?", 5000), ("", 0), (None, 1), ("zzzq", 2), ("é", 9999), ("other", 6000), ("same", 6001), ("abc", 7000), ("abc", 6500), ("a.c", -5), ("$1", -6)]
    t, n = spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(needles, "needle string, place long")
    want = {}
    for i, text in texts:
        hits = [(place, needle) for needle, place in needles if needle and text is not None and needle in text]
        if hits:
            want[i] = min(want.get(i, (10**9, "")), min(hits))
    out = first_needles(t, n)
    assert {(r.text_id, r.place, r.needle) for r in out.collect()} == {(i, *hit) for i, hit in want.items()}
    assert "NestedLoop" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "Cartesian" not in plan
    assert "zzzq" not in {r.needle for r in index(t, n)[0].collect()}
    assert first_needles(t, n.limit(0)).collect() == [] and first_needles(t.limit(0), n).collect() == []


def test_a_needle_is_filed_under_its_rarest_gram(spark):
    texts = spark.createDataFrame([(i, "common words") for i in range(50)] + [(99, "common qwords")], "text_id long, text string")
    filed, _ = index(texts, spark.createDataFrame([("common qwords", 1)], "needle string, place long"))
    assert "q" in filed.first().gram
