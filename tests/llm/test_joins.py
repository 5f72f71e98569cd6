"""Jaccard join, substring dedup, Merkle audit and nearest neighbours against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from conftest_data import rows_of
from pyspark.sql import functions as F

from stormglass.llm import ann_forest, components, jaccard_join, substring_dedup, warc_fixity
from stormglass.llm.common import WordHashes, Windows
from stormglass.llm.sketch import count_keys

GAPS = re.compile(r"[\x20\x09-\x0D]+")


def tokens(text):
    return [w for w in GAPS.split(text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = tokens(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def slow_classes(rows):
    """(doc_id, n_shingles, component_id) of each row, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def classes_of(df, **options):
    return sorted((tuple(r)[:3] for r in jaccard_join.similarity_classes(df, **options).collect()), key=repr)


def near_copies(seed, n=150):
    """Texts with chains of near copies, subsets, exact copies and shared passages."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 40))
    texts = [" ".join(word() for _ in range(rng.choice([1, 3, 5, 6, 20, 60, 200]))) for _ in range(n // 3)]
    while len(texts) < n:
        w = rng.choice(texts).split()
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 3)] = [word() for _ in range(rng.randint(0, 3))]
        texts.append(rng.choice([" ", "\n", "  "]).join(w).swapcase() if rng.random() < 0.2 else " ".join(w))
    return list(zip(rng.sample(range(10 * n), n), texts, strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_classes_against_all_pairs(spark, monkeypatch, seed):
    # Small groups and blocks, so that groups are split and opened by way of the matrix.
    monkeypatch.setattr(jaccard_join, "CAP_TOKENS", 500 if seed else 2**19)
    monkeypatch.setattr(jaccard_join, "BLOCK_QUERIES", 2)
    rows = near_copies(seed)
    assert classes_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == slow_classes(rows)


def test_classes_of_one_large_group(spark, monkeypatch):
    """All rows in one group of near copies, beside many exact copies."""
    monkeypatch.setattr(jaccard_join, "CAP_TOKENS", 2_000)
    monkeypatch.setattr(jaccard_join, "BLOCK_QUERIES", 4)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base[:50], f"x{i}", *base[51:]])) for i in range(120)] + [(i, " ".join(base)) for i in range(200, 260)]
    assert classes_of(spark.createDataFrame(rows, "doc_id long, text string")) == slow_classes(rows)


def test_the_threshold_is_met_exactly(spark):
    # 9 shared of 10 + 10 - 9 = 11; 8 of 10 is a link (80 %), 4 of 5 as well, 7 of 9 is not.
    line = lambda *w: " ".join(w)
    a = [f"a{i}" for i in range(12)]
    rows = [(1, line(*a)), (2, line(*a, "b0", "b1")), (3, line(*[f"c{i}" for i in range(11)])), (4, line(*[f"c{i}" for i in range(11)], "d", "e")), (5, "Only Four words here"), (6, "only four WORDS here")]
    assert classes_of(spark.createDataFrame(rows, "doc_id long, text string")) == [(1, 8, 1), (2, 10, 1), (3, 7, 3), (4, 9, 4), (5, 1, 5), (6, 1, 5)]


def test_classes_of_awkward_rows(spark, awkward, empty):
    assert classes_of(awkward) == slow_classes([(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert classes_of(empty) == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randint(0, 200):03d}", f"n{rng.randint(0, 200):03d}") for _ in range(150)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(120)] + [("p000", f"s{i}") for i in range(50)]
    up: dict[str, str] = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: root(x) for x in up}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_sketch_never_misses_a_repeat(spark):
    rng = random.Random(3)
    sets = [sorted({rng.randint(0, 3000) for _ in range(20)}) for _ in range(100)]
    df = spark.createDataFrame([(s,) for s in sets], "v array<long>").repartition(7)
    for cells in (4, 17):
        found = count_keys(df, lambda: lambda v: np.array(v, np.uint64), max(cells, 16), 2, least=2)
        many = np.array([x for x in range(3000) if sum(x in s for s in sets) > 1], np.uint64)
        assert found.maybe(many).all()
    once = np.array([x for x in range(3000) if sum(x in s for s in sets) < 2], np.uint64)
    assert found.maybe(once).mean() < 0.1


def test_rolling_hashes_tell_windows_apart():
    w = [b"a", b"b", b"a", b"b", b"c", b"a", b"b"]
    h = Windows().of(WordHashes().of(w), 2)
    pairs = list(zip(w, w[1:], strict=False))
    assert all((h[i] == h[j]) == (pairs[i] == pairs[j]) for i in range(6) for j in range(6))
    assert len(Windows().of(WordHashes().of(w), 8)) == 0


def slow_dedup(rows, window=50):
    first: dict[tuple, int] = {}
    known = [(d, tokens(t)) for d, t in rows]
    rank = lambda d: 2**63 - 1 if d is None else d
    for d, w in known:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(rank(d), first.get(key, rank(d)))
    out = []
    for d, w in known:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < rank(d):
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def dedup_of(df, **options):
    return sorted((tuple(r) for r in substring_dedup.dedup(df, **options).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize(("seed", "held"), [(0, 1_000_000), (1, 50), (2, 1)])
def test_dedup_against_all_windows(spark, monkeypatch, seed, held):
    monkeypatch.setattr(substring_dedup, "HELD_WINDOWS", held)
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 10**6)}"
    passages = [[word() for _ in range(rng.choice([6, 7, 9, 15, 30]))] for _ in range(12)]
    rows = []
    for i in rng.sample(range(1000), 80):
        body: list[str] = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a = rng.randint(0, 3)
            body += p[a:] if rng.random() < 0.5 else p
            body += [word() for _ in range(rng.randint(0, 4))]
        rows.append((i, " ".join(body)))
    rows += [(i + 2000, t) for i, t in rows[:20]] + rows[:3] + [(rows[0][0], rows[1][1]), (None, rows[2][1]), (5000, "z " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for window in (6, 7):
        assert dedup_of(df, window=window) == slow_dedup(rows, window)


def test_dedup_of_awkward_rows(spark, awkward, empty):
    assert dedup_of(awkward) == slow_dedup([(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert dedup_of(empty) == []
    kept = {r["doc_id"]: r["kept_text"] for r in substring_dedup.dedup(awkward).filter("n_removed > 0").collect()}
    assert kept[10] == "tail" and kept[2] == ""


def test_merkle_audit(spark):
    pages = [(i, f"http://h/{i}", f"<p>{i}</p>" if i % 9 else None) for i in range(0, 9000, 3)]
    pages += [(None, "x", "y"), (6, "http://h/6", "again"), (-5, None, "neg")]
    names = "page_id long, url string, html string, hash int"
    a = spark.createDataFrame([(*p, 1) for p in pages], names)
    assert warc_fixity.audit(a, a.repartition(3)).count() == 0
    damaged = [p for p in pages if p[0] not in (12, 4098, 8997)]
    damaged = [(i, u, (h or "") + "!") if i in (0, 300, None) else (i, u, h) for i, u, h in damaged] + [(20_000, "new", "")]
    b = spark.createDataFrame([(*p, 2) for p in damaged], names)
    got = {(r["page_id"], r["status"]) for r in warc_fixity.audit(a, b).collect()}
    assert got == {(12, "missing"), (4098, "missing"), (8997, "missing"), (0, "changed"), (300, "changed"), (None, "missing"), (None, "extra"), (20_000, "extra")}
    found = {r["page_id"]: r for r in warc_fixity.audit(a, b).collect()}
    record = lambda i, u, h: f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: {u}\r\nContent-Type: text/html\r\nContent-Length: {len(h)}\r\n\r\n{h}\r\n\r\n"
    assert found[300]["hash_a"] == hashlib.sha256(record(300, "http://h/300", "<p>300</p>").encode()).hexdigest()
    before = sum(len(record(i, u, h or "")) for i, u, h in pages if i is not None and 0 <= i < 300)
    assert found[300]["offset_a"] == before and found[300]["offset_b"] == before - len(record(12, "http://h/12", "<p>12</p>")) + 1
    nothing = a.limit(0)
    assert warc_fixity.audit(nothing, nothing).count() == 0
    assert {r["status"] for r in warc_fixity.audit(a, nothing).collect()} == {"missing"} and warc_fixity.audit(nothing, a).count() == len(pages) - 1


def test_merkle_audit_of_shared_ids(spark):
    names = "page_id long, url string, html string"
    rows = [(None, "u", str(i)) for i in range(300)] + [(None, "u", "same")] * 40 + [(7, "u", str(i)) for i in range(50)] + [(7, "u", "twice")] * 2
    a = spark.createDataFrame(rows, names)
    assert warc_fixity.audit(a, a.repartition(5)).count() == 0
    found = lambda b: sorted((r["page_id"] or 0, r["status"]) for r in warc_fixity.audit(a, spark.createDataFrame(b, names)).collect())
    assert found(rows[:-1]) == [(7, "changed")]
    assert len(found([*rows[:300], *rows[301:]])) == 1  # one copy of 40 lost
    altered = found([(None, "u", "other"), *rows[1:]])
    assert len(altered) == 2 and {k for k, _ in altered} == {0}


def test_roots_cover_offset_ranges(spark):
    leaf = lambda *cuts: spark.createDataFrame([(0, i, i, lo, hi - lo, f"h{i}") for i, (lo, hi) in enumerate(zip((0, *cuts), (*cuts, 100), strict=True))], "file_no long, slot int, page_id long, offset long, length long, hash string")
    root = lambda rows: warc_fixity.tree(rows)[-1].first()["hash"]
    assert root(leaf(10, 20)) == root(leaf(10, 20)) != root(leaf(10, 21))


def test_roots_differ_only_where_leaves_do(spark):
    pages = spark.createDataFrame([(i, "u", str(i)) for i in range(0, 20_000, 7)], "page_id long, url string, html string")
    changed = pages.withColumn("html", F.when(F.col("page_id") == 700, "other").otherwise(F.col("html")))
    levels = [[{(r["file_no"], r["node"]): r["hash"] for r in level.collect()} for level in warc_fixity.tree(warc_fixity.leaves(side))] for side in (pages, changed)]
    for a, b, node in zip(*levels, (700, 43, 2, 0), strict=True):
        assert {k for k in a if a[k] != b[k]} == {(0, node)}


def test_forest_walks_all_leaves_in_order():
    rng = np.random.default_rng(1)
    x = ann_forest.unit(rng.normal(size=(500, 8)))
    forest = ann_forest.plant(x, trees=3, leaf_rows=20)
    every = forest.nearest_leaves(x[0], 10**6)
    assert len(every) == len(set(every)) == 3 * 2**forest.depth
    own = forest.leaves(x[:1])[0]
    assert {(t, int(own[t])) for t in range(3)} <= set(every[:3])


def near_rows(df, queries, **options):
    found: dict[int, list] = {}
    for r in ann_forest.search(df, queries, **options).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(v) for q, v in found.items()}


def exact(vectors, query, k=5):
    q = np.array(vectors[query], float)
    score = {i: float(q @ np.array(v, float) / np.linalg.norm(q) / np.linalg.norm(np.array(v, float))) for i, v in vectors.items() if i != query}
    return sorted(((-round(s, 12), i) for i, s in score.items()))[:k]


def test_buckets_are_of_bounded_size():
    sizes = np.array([[3, 0, 4, 25, 2, 9], [10, 11, 0, 0, 7, 1]])
    first, shares = ann_forest.assign_buckets(sizes, 10)
    assert shares.tolist() == [[1, 1, 1, 3, 1, 1], [1, 2, 1, 1, 1, 1]]
    held: dict[int, list] = {}
    for (tree, leaf), n in np.ndenumerate(sizes):
        for b in range(first[tree, leaf], first[tree, leaf] + shares[tree, leaf]):
            held.setdefault(b, []).append((tree, -(-n // shares[tree, leaf]), shares[tree, leaf]))
    for there in held.values():
        assert len({tree for tree, *_ in there}) == 1 and sum(n for _, n, _ in there) <= 20
        assert len(there) == 1 or all(s == 1 for *_, s in there)


@pytest.mark.parametrize("bucket_bytes", [ann_forest.BUCKET_BYTES, 8 * 6 * 7])
def test_search_with_all_leaves_is_exact(spark, monkeypatch, bucket_bytes):
    monkeypatch.setattr(ann_forest, "BUCKET_BYTES", bucket_bytes)
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=6).round(1).tolist() for i in range(400)} | {i: [1.0, 2.0, 0.0, 0.0, 0.0, 1.0] for i in range(400, 460)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>").withColumn("embedding", F.col("embedding").cast("array<double>"))
    df = spark.createDataFrame([(i, [float(np.float64(x)) for x in v]) for i, v in vectors.items()], "vec_id long, embedding array<double>").withColumn("bucket", F.lit(1)).withColumn("v", F.lit(2))
    got = near_rows(df, df.filter("vec_id % 20 = 0"), open_share=1.0)
    assert len(got) == 23
    for q, found in got.items():
        want = exact(vectors, q)
        assert [i for _, i, _ in found] == [i for _, i in want] and [r for r, _, _ in found] == [1, 2, 3, 4, 5]
        assert np.allclose([s for *_, s in found], [-s for s, _ in want], atol=1e-12)


def test_search_cases(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 1.0]), (8, [2.0, 0.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0, 0.0]), (7, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = near_rows(df, df)
    assert {q: [i for _, i, _ in v] for q, v in got.items()} == {1: [8, 7], 7: [1, 8], 8: [1, 7]}
    assert near_rows(df.limit(0), df) == near_rows(df, df.limit(0)) == {} == near_rows(df.filter("vec_id = 1"), df.filter("vec_id = 1"))


@pytest.mark.parametrize("sample_rows", [ann_forest.SAMPLE_ROWS, 1000])
def test_recall_on_the_table(spark, monkeypatch, sample_rows):
    """Recall of the query against brute force over the whole table, which is larger than the smaller sample."""
    monkeypatch.setattr(ann_forest, "SAMPLE_ROWS", sample_rows)
    sf = "/root/testdata/sf0.1"
    rows = dict(rows_of(sf, "embeddings", "vec_id", "embedding"))
    ids = np.array(sorted(i for i, v in rows.items() if v))
    x = np.array([rows[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found: dict[int, set] = {}
    for r in ann_forest.op6_ann_forest(spark, sf).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for at in np.flatnonzero(ids % 50 == 0):
        score = x @ x[at]
        score[at] = -2
        hits += len(found[int(ids[at])] & set(ids[np.lexsort((ids, -score))[:5]].tolist()))
        total += 5
    assert total >= 200 and hits / total >= 0.95


@pytest.mark.parametrize("bucket_bytes", [ann_forest.BUCKET_BYTES, 8 * 7 * 10])
def test_search_orders_scaled_copies_by_id(spark, monkeypatch, bucket_bytes):
    """Leaves of more scaled copies than a bucket holds are dealt over several."""
    monkeypatch.setattr(ann_forest, "BUCKET_BYTES", bucket_bytes)
    rng = np.random.default_rng(9)
    base = rng.normal(size=(30, 7))
    vectors = {i: (base[i % 30] * (1.0, 3.0, 0.7, 11.0)[i % 4]).tolist() for i in rng.permutation(600).tolist()}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = near_rows(df, df.filter("vec_id % 20 = 0"), open_share=1.0)
    for q, found in got.items():
        assert [i for _, i, _ in found] == [i for _, i in exact(vectors, q)]
