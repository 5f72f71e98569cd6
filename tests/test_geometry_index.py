"""Look-ups in the laid-out store: what they find, and what they read."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from stormglass.operators import geometry_index


def metrics(df) -> dict[str, int]:
    """The scan's numbers after a run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan
    todo, out = [plan], {}
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if "FileSourceScan" in node.getClass().getSimpleName():
            found = node.metrics()
            out = {k: found.apply(k).value() for k in ("numFiles", "numOutputRows") if found.contains(k)}
    return out


def test_a_look_up_reads_one_file_and_few_rows(spark, tmp_path):
    point = F.format_string('{"type":"Point","coordinates":[%d,1]}', F.col("id"))
    store = spark.range(20_000).select(F.concat(F.lit("nws:"), "id").alias("ref"), point.alias("geometry"), F.length(point).cast("long").alias("size"), F.col("id").alias("touch_seq"))
    n = geometry_index.write(store, str(tmp_path), bucket_rows=2_000)
    assert n == 10 and len(list(tmp_path.rglob("*.parquet"))) == n
    there = geometry_index.lookup(spark, str(tmp_path), "nws:777")
    read = metrics(there)  # of the first run
    (row,) = there.collect()
    assert json.loads(row.body)["features"][0]["geometry"]["coordinates"] == [777, 1]
    assert read["numFiles"] == 1 and read["numOutputRows"] <= 4_000
    absent = [geometry_index.lookup(spark, str(tmp_path), f"nws:{x}") for x in ("x", "777x", "20000", "1e5")]
    found = [metrics(df) for df in absent]
    assert all(df.isEmpty() for df in absent) and all(m["numFiles"] <= 1 for m in found) and sum(m["numOutputRows"] == 0 for m in found) >= 3


def test_many_refs_at_once_and_awkward_ones(spark, tmp_path):
    rows = [("a", '{"type":"Point","coordinates":[1,2]}', 5, 1), ("b", None, 5, 2), ("a", '{"type":"Point","coordinates":[3,4]}', 5, 3), (None, "{}", 2, 4), ("é/=", '{"type":"Point","coordinates":[5,6]}', 5, 5)]
    names = "ref string, geometry string, size long, touch_seq long"
    geometry_index.write(spark.createDataFrame(rows, names), f"{tmp_path}/s", bucket_rows=1)
    wanted = spark.createDataFrame([("a",), ("a",), (None,), ("é/=",), ("zz",)], "ref string")
    assert sorted(r.ref for r in geometry_index.lookup_all(spark, f"{tmp_path}/s", wanted).collect()) == ["a", "a", "é/="]
    geometry_index.write(spark.createDataFrame([], names), f"{tmp_path}/e")
    assert geometry_index.lookup_all(spark, f"{tmp_path}/e", wanted).collect() == [] and geometry_index.lookup(spark, f"{tmp_path}/e", "a").collect() == []
