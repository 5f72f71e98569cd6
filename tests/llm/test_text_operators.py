"""BPE, licences, packing and quality rules against plain Python, on awkward rows and on none."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from conftest_data import rows_of

from stormglass.llm import bpe, license_scan, packing, quality_rules
from stormglass.llm.common import n_words, words

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def test_words_split_at_ascii_space_only():
    assert words("a b c\x1cd\x0be\r\nf") == ["a b".encode(), b"c\x1cd", b"e", b"f"]
    assert words(None) == words(" \t") == []


def test_bpe_matches_tiktoken_and_decodes(spark, awkward, empty):
    enc = bpe.encoding(PATH, PATTERN)
    for df, chunk, overlap in ((awkward, bpe.CHUNK_CHARS, bpe.OVERLAP_CHARS), (awkward, 500, 40)):
        got = sorted((str(r["doc_id"]), list(r["ids"]), bytes(r["decoded"])) for r in bpe.round_trip(df, PATH, PATTERN, chunk_chars=chunk, overlap_chars=overlap).collect())
        want = sorted((str(r["doc_id"]), enc.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in df.collect())
        assert got == want
    assert bpe.round_trip(empty, PATH, PATTERN).count() == 0


def test_bpe_seams(spark):
    rng = random.Random(3)
    pool = ["'s", "'re", " ", "  ", "\n\n", "\t", "12", "ab", "é", "日本", "!?", "'", "x" * 70, " " * 70]
    texts = ["".join(rng.choice(pool) for _ in range(300)) for _ in range(40)] + ["y" * 1000, " " * 1000, "ab " * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = bpe.encoding(PATH, PATTERN)
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(df, PATH, PATTERN, chunk_chars=60, overlap_chars=20).collect()}
    assert got == {i: enc.encode_ordinary(t) for i, t in enumerate(texts)}


def test_bpe_decode_concatenates_bytes(spark):
    enc = bpe.encoding(PATH, PATTERN)
    ids = enc.encode_ordinary("日本 ñ")
    df = spark.createDataFrame([(1, ids), (2, ids[:1]), (3, []), (4, None)], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(df, PATH, PATTERN).collect()}
    assert bytes(got[1]) == "日本 ñ".encode() and bytes(got[2]) == enc.decode_bytes(ids[:1]) and bytes(got[3]) == b"" and got[4] is None


def test_licenses(spark, awkward, empty):
    known = license_scan.known_licenses(spark)
    apache = "LICENSED under the Apache Licence -- version 2.0\nCopyright 2020 Somebody"
    df = spark.createDataFrame([(1, apache), (2, "Text.\nLicensed under the MIT License.\nlicensed under the mit licence"), (3, None), (4, "Copyright (c) X"), (2, "other"), (None, "Released under the MIT license.")], "doc_id long, text string")
    got = {(r["doc_id"], r["text_license"], r["line_licenses"], r["n_license_lines"]) for r in license_scan.scan(df, known).collect()}
    assert got == {(1, "Apache-2.0", "Apache-2.0", 1), (2, None, "MIT", 2), (3, None, None, 0), (4, None, None, 0), (2, None, None, 0), (None, "MIT", "MIT", 1)}
    assert license_scan.scan(awkward, known).count() == awkward.count()
    assert license_scan.scan(empty, known).count() == 0
    many = known.unionByName(known.withColumn("license", known["license"]))
    assert license_scan.scan(df, many).count() == 6
    none = license_scan.scan(df, known.limit(0)).collect()
    assert len(none) == 6 and all(r["text_license"] is None for r in none)


MIT_TEXT = """The MIT License (MIT)

Copyright (c) 1999 Some Body

PERMISSION is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicence, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


def test_whole_licence_texts_and_usual_notices(spark):
    files = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0"}
    folder = Path("/usr/share/common-licenses")
    texts = {name: (folder / name).read_text(encoding="utf-8") for name in files if (folder / name).exists()}
    rows = [(MIT_TEXT, "MIT")] + [(t, files[n]) for n, t in texts.items()] + [(t + "\nand more", None) for t in texts.values()]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    known = license_scan.known_licenses(spark)
    got = {r["doc_id"]: r["text_license"] for r in license_scan.scan(df, known).collect()}
    assert got == {i: w for i, (_, w) in enumerate(rows)}
    notices = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1-or-later",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.": "CC-BY-NC-SA-3.0", "to deal in the Software without restriction.": None,
    }
    df = spark.createDataFrame([(i, f"Some prose.\n{t}\nMore.") for i, t in enumerate(notices)], "doc_id long, text string")
    got = {r["doc_id"]: r["line_licenses"] for r in license_scan.scan(df, known).collect()}
    assert got == dict(enumerate(notices.values()))


def test_licenses_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "BROADCAST_ROWS", 3)
    df = spark.createDataFrame([(1, "Licensed under the MIT License.")], "doc_id long, text string")
    assert license_scan.scan(df, license_scan.known_licenses(spark)).first()["text_license"] == "MIT"


def test_best_fit_is_sound():
    rng = random.Random(5)
    for _ in range(50):
        lengths = sorted((rng.randint(1, 8192) for _ in range(rng.randint(1, 200))), reverse=True)
        bins, offsets, sizes = packing.best_fit(lengths)
        used = Counter()
        for x, b, o in zip(lengths, bins, offsets, strict=True):
            assert o == used[b]
            used[b] += x
        for b, u in used.items():
            assert sizes[b] == min(c for c in packing.CAPACITIES if c >= u)
        # Never worse than a bin for each piece.
        alone = sum(packing.cost(min(c for c in packing.CAPACITIES if c >= x)) for x in lengths)
        assert sum(map(packing.cost, sizes)) <= alone * 1.0001


def test_best_fit_against_slow_search():
    rng = random.Random(6)
    for _ in range(30):
        lengths = sorted((rng.randint(1, 3000) for _ in range(60)), reverse=True)
        open_bins: list[list[int]] = []  # room, used, contents
        left, want = sum(lengths), []
        for x in lengths:
            fits = [(b[0], i) for i, b in enumerate(open_bins) if b[0] >= x]
            if fits:
                i = min(fits)[1]
            else:
                c = min((c for c in packing.CAPACITIES if c >= x), key=lambda c: (packing.cost(c) / min(c, left), c))
                open_bins.append([c, 0])
                i = len(open_bins) - 1
            want.append((i, open_bins[i][1]))
            open_bins[i][0] -= x
            open_bins[i][1] += x
            left -= x
        bins, offsets, _ = packing.best_fit(lengths)
        assert list(zip(bins, offsets, strict=True)) == want


def test_packing_keeps_every_row(spark, awkward, empty):
    lengths = awkward.select("doc_id", n_words(awkward["text"]).alias("n_tokens"))
    got = packing.pack(lengths, shard_pieces=5).collect()
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["n_tokens"]
        assert (r["bin_id"] is None) == (r["n_tokens"] == 0)
        assert r["bin_id"] is None or r["bin_offset"] + r["n_tokens"] <= r["bin_capacity"]
    want = Counter()
    for r in awkward.collect():
        want[r["doc_id"]] += len(words(r["text"]))
    assert total == want and len(got) >= awkward.count()
    spans = sorted((r["bin_id"], r["bin_offset"], r["n_tokens"]) for r in got if r["bin_id"])
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(spans, spans[1:], strict=False))
    assert packing.pack(empty.selectExpr("doc_id", "0L as n_tokens")).count() == 0


def slow_counts(text):
    import re

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = Counter(tri)
    rep = {j for i, t in enumerate(tri) if often[t] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if [y for y in re.split(r"[\x20\x09-\x0D]+", x) if y]]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines), sum(x in lines[:i] for i, x in enumerate(lines)), len(rep), len(set(w)))


@pytest.mark.parametrize("seed", range(4))
def test_quality_counts(seed):
    rng = random.Random(seed)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "c ", " ", "\n", "\t", "#", "é", "|", "a b c ", " "]) for _ in range(rng.randint(0, 60)))
        assert quality_rules.counts_of(text) == slow_counts(text)
    assert quality_rules.counts_of(None) == (0,) * 7


def test_upper_bound_is_clopper_pearson():
    from math import comb

    for k, n, e in ((0, 100, 0.01), (3, 200, 0.05), (10, 50, 0.001)):
        p = quality_rules.upper_bound(k, n, e)
        assert abs(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) - e) < 1e-9
    assert quality_rules.upper_bound(0, 0, 0.1) == quality_rules.upper_bound(5, 5, 0.1) == 1.0
    assert abs(quality_rules.upper_bound(0, 10_000, 0.01) - (1 - 0.01 ** (1 / 10_000))) < 1e-9


def test_quality_verdicts(spark, awkward, empty):
    rng = random.Random(8)
    rows = []
    for i in range(3000):
        bad = i % 5 == 0
        body = " ".join(f"w{rng.randint(0, 10**6)}" + ("###" if bad else "") for _ in range(60 + i % 30))
        rows.append((i, body, 0 if bad else 1))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = df.select("doc_id", "quality")
    got = {r["doc_id"]: r for r in quality_rules.judge(df, labels).collect()}
    assert all(got[i]["kept"] == (q == 1) for i, _, q in rows)
    counts = quality_rules.text_counts(df)
    cutoffs = quality_rules.learn_cutoffs(counts, labels)
    assert set(cutoffs) == {(0, "symbols")}
    # Few labels certify nothing: only the base rules act.
    assert quality_rules.learn_cutoffs(counts, labels.limit(100)) == {}
    none = spark.createDataFrame([], "doc_id long, quality int")
    judged = quality_rules.judge(awkward, none).collect()
    assert len(judged) == awkward.count() and all(r["kept"] != r["base_failed"] for r in judged)
    assert quality_rules.judge(empty, none).count() == 0


def test_quality_cutoffs_by_brute_force(spark):
    rng = random.Random(9)
    texts = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) + rng.choice(["", "", "#"]) * rng.randint(0, 1) for _ in range(rng.randint(50, 400)))) for i in range(1500)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    marks = {i: int(t.count("#") < 40) for i, t in texts}
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, quality int")
    got = quality_rules.learn_cutoffs(quality_rules.text_counts(df), labels)
    import math

    names = ("symbols", "dup_lines", "repeats", "few_words")
    want = {}
    held = []
    for i, t in texts:
        n, chars, sym, lines, dup, rep, distinct = slow_counts(t)
        if n >= 50 and 100 * rep <= 50 * n:
            band = sum(n > b for b in quality_rules.BANDS)
            held.append((marks[i], band, [math.ceil(x * 100) for x in (sym / chars, dup / lines, rep / n, 1.0 - distinct / n)]))
    for band in range(4):
        for j, name in enumerate(names):
            best = 0
            good = [c[j] for q, b, c in held if b == band and q]
            bad = [c[j] for q, b, c in held if b == band and not q]
            for cut in range(99, 0, -1):
                k = sum(c > cut for c in good)
                if not good or quality_rules.upper_bound(k, len(good), 0.05 / 16) > 0.05 / 4:
                    break
                gain = sum(c > cut for c in bad) - 20 * k
                if gain > best:
                    best, want[band, name] = gain, cut / 100
    assert got == pytest.approx(want)


def test_queries_on_small_tables(spark):
    for q in (bpe.op5_byte_bpe, license_scan.op7_license_scan, packing.op8_best_fit_packing, quality_rules.op9_quality_rules):
        assert q(spark, "/root/testdata/sf0.001").count() >= 200
    rows = bpe.op5_byte_bpe(spark, "/root/testdata/sf0.001").collect()
    texts = dict(rows_of("/root/testdata/sf0.001", "documents", "doc_id", "text"))
    enc = bpe.encoding(PATH, PATTERN)
    for r in rows:
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_licences_whatever_their_lines_and_script(spark):
    whole = MIT_TEXT.replace("Copyright (c) 1999 Some Body\n", "")
    wrapped = "\n".join(whole.split()) + "\nCopyright 2001 X\nAll rights reserved.\n"
    text = "Предоставлено по лицензии. 日本語の文 licence licence"
    rows = [whole, wrapped, " ".join(whole.split()), whole.upper().replace(",", " ,"), whole + "текст", text, text.replace("licence licence", "LICENSE - license"), "日本語", "日本文", "copyright notice, this list"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: (r["text_digest"], r["text_license"]) for r in license_scan.scan(df, license_scan.known_licenses(spark)).collect()}
    assert [got[i][1] for i in range(5)] == ["MIT"] * 4 + [None]
    assert got[5][0] == got[6][0] and got[7][0] not in (None, got[8][0])
    assert got[9][0] == hashlib.sha256(b"copyright notice this list").hexdigest()


def test_repeated_rows_certify_nothing(spark):
    """The promise on false rejections needs independent trials."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60 + i % 40)), 1 if i % 2 else 0) for i in range(300)]
    rows = [(i, t if q else t + " ### $$$ ***" * 5, q) for i, t, q in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    once = quality_rules.learn_cutoffs(quality_rules.text_counts(df), df.select("doc_id", "quality"))
    for many in (df.crossJoin(spark.range(16)).select(df.columns), df.crossJoin(spark.range(16)).selectExpr("doc_id + 1000 * id as doc_id", "text", "quality")):
        assert quality_rules.learn_cutoffs(quality_rules.text_counts(many), many.select("doc_id", "quality")) == once == {}


def test_false_rejections_stay_within_the_promise(spark):
    """Over many draws of good documents whose ratios are alike, few certify cutoffs that reject too many."""
    rng = np.random.default_rng(5)
    broken = 0
    for _ in range(40):
        share = rng.beta(0.5, 8, 2000)
        js = np.minimum(np.ceil(share * 100).astype(int) - 1, len(quality_rules.GRID)).clip(0)
        tally = np.bincount(js, minlength=len(quality_rules.GRID) + 1).tolist()
        cutoffs = quality_rules.certified({(0, "repeats"): tally}, {(0, "repeats"): [10**6] * len(tally)})
        truth = rng.beta(0.5, 8, 200_000)
        broken += any((np.ceil(truth * 100) > round(c * 100)).mean() > quality_rules.MAX_FALSE_REJECTION / 4 for c in cutoffs.values())
    assert broken <= 40 * quality_rules.ERROR
