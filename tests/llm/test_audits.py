"""Manifest, divergence audit and exact dedup against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormglass.llm import dataset_manifest as manifest
from stormglass.llm import exact_dedup, source_divergence

# Exact dedup


def groups_of(rows: list[tuple]) -> Counter:
    """What ``dedup`` should give for rows of (doc_id, text)."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        for nth, i in enumerate(sorted(ids, key=lambda i: i != keep)):
            out[i, keep, len(ids), nth == 0, sha] += 1
    return out


def check_dedup(spark, rows: list[tuple], **how) -> None:
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("body", "n_bytes", "hi", "lo", "sha", "n")})
    got = exact_dedup.dedup(df, log2_cells=16, **how)
    assert Counter(tuple(r) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == groups_of(rows)


def some_texts() -> list[tuple]:
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    copies = [text(n) for n in (1, 50, 3_000, 40_000)]
    rows = [(i, rng.choice(copies)) for i in range(60)] + [(100 + i, text(60)) for i in range(60)]
    near = copies[3]
    return rows + [(300, near[:-1] + "x"), (301, "x" + near[1:]), (302, near[:20_000] + "x" + near[20_001:]), (7, None), (8, ""), (9, ""), (None, None), (None, copies[0]), (5, "once"), (5, "once"), (5, "once"), (None, "alone"), (None, "alone"), (400, "\0"), (401, "\0\0")]


def test_dedup_equals_plain_groups(spark):
    check_dedup(spark, some_texts())


def test_long_texts_are_hashed_by_segments(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SEGMENT", 20_000)
    check_dedup(spark, some_texts())


@pytest.mark.parametrize("segment", [2**20, 20_000])
def test_colliding_fingerprints_are_told_apart(spark, monkeypatch, segment):
    monkeypatch.setattr(exact_dedup, "SEGMENT", segment)
    check_dedup(spark, some_texts(), primes=(2, 1, 1, 1))


def test_fingerprints_compose_and_equal_the_definition():
    poly = exact_dedup.Polynomial()
    data = np.frombuffer(random.Random(2).randbytes(50_000), np.uint8)
    plain = []
    for p, b in zip(exact_dedup.PRIMES, exact_dedup.BASES, strict=True):
        x = 0
        for byte in data.tolist():
            x = (x * b + byte) % p
        plain.append(x)
    assert poly.of(data) == plain
    for at in (0, 1, 16_384, 33_333, 50_000):
        assert poly.joined(poly.of(data[:at]), poly.of(data[at:]), poly.shift(len(data) - at)) == plain
    full = np.full(exact_dedup.CHUNK, 255, np.uint8)
    assert poly.chunk(full) == [sum(255 * pow(b, i, p) for i in range(len(full))) % p for p, b in zip(exact_dedup.PRIMES, exact_dedup.BASES, strict=True)]


def test_dedup_of_awkward_rows_and_of_normalised_texts(spark, awkward, empty):
    got = exact_dedup.dedup(awkward, log2_cells=16)
    want = groups_of([(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()])
    assert Counter(tuple(r) for r in got.collect()) == Counter({(i, k, n, kept, sha): c for (i, k, n, kept, sha), c in want.items()})
    assert exact_dedup.dedup(empty, log2_cells=16).collect() == []
    lower = exact_dedup.dedup(spark.createDataFrame([(1, "A b"), (2, "a B"), (3, "a c")], "doc_id long, text string"), normalise=F.lower, log2_cells=16)
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in lower.collect()) == [(1, 2, False), (2, 2, True), (3, 3, True)]


# Manifest


def H(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(hashes: list[str]) -> tuple[str, list[list[tuple[int, list[str]]]]]:
    """The root, and for each leaf its (slot, siblings) level by level."""
    proofs = [[] for _ in hashes]
    nodes, members = hashes, [[i] for i in range(len(hashes))]
    while len(nodes) > 1:
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for slot in range(len(run)):
                for leaf in members[at + slot]:
                    proofs[leaf].append((slot, run[:slot] + run[slot + 1 :]))
        members = [sum(members[at : at + 8], []) for at in range(0, len(nodes), 8)]
        nodes = [H(*nodes[at : at + 8]) for at in range(0, len(nodes), 8)]
    return nodes[0], proofs


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    """Rows of (doc_id, text, lang, source, n_chars)."""
    coded = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, text, lang, source, n: H(*map(coded, (i, source, lang, n, text)))
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = plain_tree([leaf(*r) for r in by[lang]])
    root, above = plain_tree([trees[x][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for r, path in zip(by[lang], trees[lang][1], strict=True):
            path = path + above[k]
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            x = leaf(r[0], text, *r[2:])
            for slot, others in path:
                x = H(*others[:slot], x, *others[slot:])
            out.append((r[0], leaf(*r), trees[lang][0], root, H(*(h for _, others in path for h in others)), x, x == root))
    return out


def check_manifest(spark, monkeypatch, rows: list[tuple]) -> list:
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("tree", "node", "leaf", "path", "group", "id", "place", "row")})
    monkeypatch.setattr(manifest, "documents", lambda *_: df)
    got = [tuple(r) for r in manifest.op11_dataset_manifest(spark, "").collect()]
    assert Counter(got) == Counter(plain_manifest(rows))
    return got


def test_manifest_equals_plain_trees(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, f"Text {i} É" if i % 3 else f"text {i}", "en" if i % 5 else rng.choice(["de", None, "é", "Z"]), rng.choice(["s1", None]), rng.choice([i, None])) for i in range(700)]
    rows += [(5, "Again", "en", None, 1), (5, "Again", "en", None, 1), (None, "No Id", "en", "s", 2), (None, None, None, None, None), (9000, "One", "alone", "s", 3), (9001, "", "", "", 0)]
    got = check_manifest(spark, monkeypatch, rows)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 2


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_manifest_of_one_group(spark, monkeypatch, n):
    check_manifest(spark, monkeypatch, [(i, f"T{i}", "en", "s", 2) for i in range(n)])


def test_manifest_of_awkward_rows(spark, awkward, empty):
    fields = ("doc_id", "text", "n")
    got = manifest.manifest(awkward, fields=fields)
    assert got.count() == awkward.count() and got.select("root").distinct().count() == 1
    assert got.filter(manifest.fold(F.col("leaf"), F.col("path")) != F.col("root")).isEmpty()
    assert manifest.manifest(empty, fields=fields).collect() == []


# Divergence


def plain_divergences(rows: list[tuple], least: int = 3, top: int = 200) -> Counter:
    """Rows of (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = lambda text: re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    out = Counter()
    for lang in {r[1] for r in rows}:
        mine = [(terms(text), source) for text, x, source in rows if x == lang]
        df = Counter(t for ts, _ in mine for t in set(ts))
        kept = [t for t, n in df.items() if n >= least]
        counts = {s: Counter() for _, s in mine}
        for ts, s in mine:
            counts[s].update(t for t in ts if df[t] >= least)
        p = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))
        ps = {s: {t: p(c[t], c.total()) for t in kept} for s, c in counts.items()}
        whole = sum(counts.values(), Counter())
        f = lambda x, y: (x - y) ** 2 // y
        for s, c in counts.items():
            pairs = [(-sum(f(ps[s][t], ps[o][t]) for t in kept), o.encode()) for o in counts if o != s]
            own = [(-f(ps[s][t], q), t.encode()) for t in kept if c[t] and ps[s][t] > (q := p(whole[t], whole.total()))]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(own)[:top])):
                out.update((lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1))
    return out


def check_divergences(spark, rows: list[tuple], **how) -> None:
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({c: F.lit(1) for c in ("term", "n", "p", "q", "item", "shard", "doc_id")})
    got = source_divergence.divergences(df, **how)
    assert Counter(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == plain_divergences(rows, top=how.get("top", 200))


def some_rows() -> list[tuple]:
    rng = random.Random(4)
    vocabulary = [w + rng.choice(["", "é", "ß", " "]) for w in ("a", "the", "The", "bird", "x1y", "ODD", "zebra", "über", "naïve", "q", "w", "e", "r", "t", "y", "abcdefgh" * 12)]
    text = lambda: " ".join(rng.choices(vocabulary, weights=range(1, len(vocabulary) + 1), k=rng.randrange(1, 60))) + rng.choice(["", ".", "\n", " end"])
    rows = [(text(), rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", None, "é"])) for _ in range(150)]
    return rows + [(None, "en", "mute"), ("", "en", "mute"), ("12 34", "xx", "a"), ("", "xx", "b"), ("rare words here", "en", "s2"), ("lonely lonely", "yy", "a")]


def test_divergences_equal_plain_sums(spark):
    check_divergences(spark, some_rows())


@pytest.mark.parametrize("most_terms", [0, 7])
def test_divergences_with_terms_in_shards(spark, monkeypatch, most_terms):
    monkeypatch.setattr(source_divergence, "SHARD_TERMS", 5)
    monkeypatch.setattr(source_divergence, "SHARD_BYTES", 200)
    check_divergences(spark, some_rows(), most_terms=most_terms, top=3)


def test_long_texts_are_cut_at_delimiters(monkeypatch):
    monkeypatch.setattr(source_divergence, "PIECE", 10)
    text = "Wörter, die länger sind " * 50 + "x" * 9_000 + " Ende"
    assert b" ".join(source_divergence.pieces(text)).split() == text.lower().replace(",", " ").encode().split()
    assert list(source_divergence.pieces("")) == []


def test_divergences_of_awkward_and_empty_tables(spark, awkward, empty):
    rows = [(r.text, r.lang, "s") for r in awkward.select("text", "lang").collect()]
    got = source_divergence.divergences(awkward.withColumn("source", F.lit("s")))
    assert Counter(tuple(r) for r in got.collect()) == plain_divergences(rows)
    assert source_divergence.divergences(empty.withColumn("source", F.lit("s"))).collect() == []
