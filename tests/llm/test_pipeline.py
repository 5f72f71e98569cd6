"""The pipeline against a plain form of each of its stages, and its stages on awkward rows."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_joins import slow_classes, slow_dedup, tokens

from stormglass.llm import language_id, packing, quality_rules
from stormglass.llm.common import words

SF = "/root/testdata/sf0.001"


def table_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages_on_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "quality rules", "n-gram Jaccard join", "substring dedup", "best-fit packing"]

    kept = stages["language ID"](spark, docs, SF)
    model = language_id.fit(docs)
    want = [r for r in docs.collect() if (p := model.predict(r["text"]))[0] != "und" and p[1] >= corpus_pipeline.LEAST_CERTAIN]
    assert kept.columns == names and table_of(kept) == sorted(map(tuple, want), key=repr)
    # Documents in a language of the table stay.
    assert len(want) > 0.9 * docs.count()

    docs, rows = kept, want
    kept = stages["quality rules"](spark, docs, SF)
    cutoffs = quality_rules.learn_cutoffs(quality_rules.text_counts(docs), spark.read.parquet(f"{SF}/labels.parquet"))
    assert cutoffs == {}  # so few labels certify no cutoff: the base rules decide
    passes = lambda t: (c := quality_rules.counts_of(t))[0] >= 50 and 100 * c[5] <= 50 * c[0]
    want = [r for r in rows if passes(r["text"])]
    assert kept.columns == names and table_of(kept) == sorted(map(tuple, want), key=repr)

    docs, rows = kept, want
    kept = stages["n-gram Jaccard join"](spark, docs, SF)
    first = {d for d, _, c in slow_classes([(r["doc_id"], r["text"]) for r in rows]) if d == c}
    want = [r for r in rows if r["doc_id"] in first]
    assert kept.columns == names and table_of(kept) == sorted(map(tuple, want), key=repr) and len(want) < len(rows)

    docs, rows = kept, want
    kept = stages["substring dedup"](spark, docs, SF)
    removed = {d: n for d, _, n, _ in slow_dedup([(r["doc_id"], r["text"]) for r in rows])}
    got = {r["doc_id"]: r for r in kept.collect()}
    assert kept.columns == names and any(removed.values())
    for r in rows:
        n = len(tokens(r["text"]))
        if removed[r["doc_id"]] == n:
            assert r["doc_id"] not in got
        else:
            after = got[r["doc_id"]]
            assert len(tokens(after["text"])) == n - removed[r["doc_id"]] and after["n_chars"] == (len(after["text"]) if removed[r["doc_id"]] else r["n_chars"])

    packed = stages["best-fit packing"](spark, kept, SF).collect()
    total = Counter()
    for r in packed:
        total[r["doc_id"]] += r["n_tokens"]
        assert r["bin_offset"] + r["n_tokens"] <= r["bin_capacity"] and r["bin_capacity"] in packing.CAPACITIES
    assert total == {d: len(words(r["text"])) for d, r in got.items()}
    assert table_of(corpus_pipeline.run(spark, SF).select("doc_id", "piece", "n_tokens")) == sorted(((r["doc_id"], r["piece"], r["n_tokens"]) for r in packed), key=repr)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_awkward_rows(spark, awkward, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, awkward, SF)
    assert name == "best-fit packing" or got.columns == awkward.columns
    assert got.count() <= (3 if name != "best-fit packing" else 10) * awkward.count()
    assert stage(spark, empty, SF).count() == 0


def test_clean_documents_stay(spark):
    """Long documents of known words without repeats pass the filters and lose nothing."""
    rng = random.Random(3)
    syllables = ["ka", "lo", "mi", "ter", "un", "sta", "ver", "dol", "pi", "ran"]
    rows = [(i, " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(200)), "xx", "s", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs, SF).count() == 60, name


def test_one_of_each_class_stays(spark):
    """Content decides, not ids: one id with two texts, near copies without an id, repeated rows, blank texts, odd names."""
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(60))
    near = lambda i: body(i) + " tail"
    rows = [(1, body(1)), (1, body(2)), (2, body(1)), (1, body(2)), (None, near(1)), (None, body(3)), (None, near(3)), (None, body(3)), (7, near(3)), (None, body(4)), (None, near(4)), (5, None), (5, None), (6, " "), (None, ""), (8, body(5)), (8, near(5))]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, `a.b` int").withColumn("single", F.lit(1)).withColumn("text_key", F.lit("k"))
    kept = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"](spark, docs, SF)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert got.pop((5, None)) == 2 and got.pop((6, " ")) == 1 and got.pop((None, "")) == 1
    assert got.pop((1, body(1))) == got.pop((1, body(2))) == got.pop((7, near(3))) == 1
    assert sorted(got.values()) == [1, 1] and {i for i, _ in got} == {None, 8} and all(t in (body(4), near(4), body(5), near(5)) for _, t in got)
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.withColumn("lang", F.lit("xx")), SF).columns == [*docs.columns, "lang"], name
