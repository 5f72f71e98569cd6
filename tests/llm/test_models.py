"""Toxicity and language ID: held-out accuracy, their parts against slow forms, awkward rows."""

from __future__ import annotations

import math
import random
import re
import time

import numpy as np
import pytest

from stormglass.llm import language_id, toxicity

SF = "/root/testdata/sf0.01"


def slow_segments(scores: list[float]) -> set[tuple[int, int]]:
    """Maximal segments by their definition: the best stretch (shortest of equals), then the same left and right of it."""
    out = set()

    def best(lo: int, hi: int) -> None:
        found = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += scores[b]
                if total > 1e-9 and (found is None or total > found[0] + 1e-9):
                    found = (total, a, b)
        if found:
            _, a, b = found
            out.add((a, b))
            best(lo, a)
            best(b + 1, hi)

    best(0, len(scores))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_segments(seed):
    rng = random.Random(seed)
    for _ in range(60):
        # Odd scores, so that no two stretches are equal.
        scores = [rng.choice([-toxicity.GAP, -toxicity.GAP, -toxicity.GAP, rng.uniform(0.1, 2.0)]) for _ in range(rng.randint(0, 40))]
        hits = [(i, s) for i, s in enumerate(scores) if s > 0]
        found = toxicity.segments(hits)
        assert {(a, b) for a, b, _ in found} == slow_segments(scores)
        assert all(abs(s - sum(scores[a : b + 1])) < 1e-9 for a, b, s in found)


def test_log_odds_follow_the_formula():
    toxic, other = np.array([30.0, 2.0]), np.array([1.0, 200.0])
    delta, z = toxicity.log_odds(toxic, other, 1000, 9000)
    prior = 1 + toxicity.PRIOR * 31 / 10_000
    want = math.log((30 + prior) / (1100 - 30 - prior)) - math.log((1 + prior) / (9100 - 1 - prior))
    assert abs(delta[0] - want) < 1e-12 and abs(z[0] - want / math.sqrt(1 / (30 + prior) + 1 / (1 + prior))) < 1e-12
    assert delta[0] > 0 > delta[1]


def test_karlin_altschul_solves_its_equation():
    rate = toxicity.karlin_altschul({4.0: 10, 2.0: 5}, 100_000)
    p = np.array([100_000 - 15, 11, 5]) / (100_001)
    assert abs((p * np.exp(rate * np.array([-toxicity.GAP, 4.0, 2.0]))).sum() - 1) < 1e-6


def synthetic(spark, n: int = 1500):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 7)))
    rows = []
    for i in range(n):
        body = [word() for _ in range(rng.randint(20, 200))]
        toxic = int(i % 6 == 0)
        for _ in range(3 * toxic):
            body.insert(rng.randrange(len(body)), rng.choice(["Vilgrub", "vilgrubber", "dreckzig", "QUOMP!"]))
        rows.append((i, " ".join(body), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int"), rows


def test_toxicity_finds_planted_documents(spark, awkward, empty):
    df, rows = synthetic(spark)
    held = toxicity.held_out(df["doc_id"])
    model = toxicity.fit(df.filter(~held), df.filter(~held).select("doc_id", "toxic"))
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    caught = [got[i]["score"] >= 0.5 for i, _, t in rows if t]
    blamed = [got[i]["score"] >= 0.5 for i, _, t in rows if not t]
    assert (np.mean(caught), np.mean(blamed)) >= (0.98, 0) and np.mean(blamed) <= 0.01
    for i, body, t in rows:
        words = toxicity.words_of(body)
        if t and got[i]["score"] >= 0.5:
            assert any(w.startswith(("vilgru", "dreck", "quomp")) for p in got[i]["passages"] for w in words[p["first"] : p["last"] + 1])
    scored = toxicity.score(awkward, model).collect()
    assert len(scored) == awkward.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert all(r["score"] == 0 for r in scored if r["doc_id"] in (3, 4, 5))
    assert toxicity.score(empty, model).count() == 0


def plain_toxicity(train: list[tuple[str, int]], texts: list[str]) -> list[float]:
    """The scores of ``texts`` by the formulas of the method, in plain loops over what ``train`` (text, toxic) has."""
    words = lambda text: re.findall(r"[^\W_]+", text.lower())
    beginnings = lambda w: {f"^{w[:n]}" for n in (3, 4, 5) if len(w) > n}
    seen: dict[int, dict[str, int]] = {0: {}, 1: {}}
    for text, label in train:
        for token in {t for w in words(text) for t in {w} | beginnings(w)}:
            seen[label][token] = seen[label].get(token, 0) + 1
    among = {t for t, n in seen[1].items() if n >= 3}
    # All tokens of all documents count, those of no lexicon too.
    total = {label: sum(of.values()) for label, of in seen.items()}
    lexicon = {}
    for t in among:
        prior = 1 + 100 * (seen[1][t] + seen[0].get(t, 0)) / (total[0] + total[1])
        a, b = seen[1][t] + prior, seen[0].get(t, 0) + prior
        odds = math.log(a / (total[1] + 100 - a)) - math.log(b / (total[0] + 100 - b))
        if odds >= 2 and odds / math.sqrt(1 / a + 1 / b) >= 3.5:
            lexicon[t] = odds
    score = lambda w: max((lexicon[t] for t in {w} | beginnings(w) if t in lexicon), default=-0.25)
    other = [[score(w) for w in words(text)] for text, label in train if not label]
    times: dict[float, int] = {max(lexicon.values()): 1}
    for x in (round(x, 1) for text in other for x in text if x > 0):
        times[x] = times.get(x, 0) + 1
    n_words = sum(map(len, other))
    times = times | {-0.25: n_words - sum(times.values()) + 1}
    # One more sighting goes to the highest score, rounded or not.
    if (top := max(times)) != max(lexicon.values()):
        times[top] += 1
        times[max(lexicon.values())] -= 1
    excess = lambda rate: sum(n * math.exp(min(700, rate * x)) for x, n in times.items()) - sum(times.values())
    low, high = 1e-6, 20.0
    while high - low > 1e-12:
        low, high = ((low + high) / 2, high) if excess((low + high) / 2) < 0 else (low, (low + high) / 2)
    hits = sum(any(x > 0 for x in text) for text in other)
    least = min(x for x in [max(lexicon.values()), *times] if x > 0)
    scale = min(1.0, (hits + 1) / max(1.0, n_words * math.exp(-low * least)))

    def evidence(text: str) -> float:
        scores = [score(w) for w in words(text)]
        found = [low * sum(scores[a : b + 1]) - math.log(scale * len(scores)) for a, b in slow_segments(scores)]
        return sum(x for x in found if x > 0) or max(found, default=-99.0)

    judged = [(round(min(100.0, evidence(text)), 1), label) for text, label in train]
    wrong = lambda level: sum((x >= level) != label and 1 / sum(u == label for _, u in judged) for x, label in judged)
    level = min(sorted({-math.log(0.005)} | {x for x, _ in judged if x > -math.log(0.005)}), key=lambda at: round(wrong(at), 9))
    return [math.exp(-math.log(2) * math.exp(min(50.0, level - x))) if (x := evidence(text)) > -99 else 0.0 for text in texts]


def test_toxicity_against_plain_loops(spark):
    df, rows = synthetic(spark, 240)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, toxicity.fit(df.filter("doc_id % 5 > 0"), df.select("doc_id", "toxic"))).collect()}
    want = plain_toxicity([(text, t) for i, text, t in rows if i % 5], [text for _, text, _ in rows])
    assert sum(x >= 0.5 for x in want) > 20
    assert max(abs(got[i] - x) for (i, *_), x in zip(rows, want, strict=True)) < 1e-6


def test_toxicity_without_labels(spark, awkward, empty):
    for docs, labels in ((awkward, awkward.limit(0)), (empty, awkward), (awkward, awkward.selectExpr("doc_id", "cast(null as int) as toxic"))):
        model = toxicity.fit(docs, labels.select("doc_id", "toxic"))
        assert model.lexicon == {} and toxicity.score(awkward, model).filter("score <> 0").count() == 0


def test_toxicity_on_the_tables(spark):
    got = {r["doc_id"]: r for r in toxicity.op1_toxicity(spark, SF).collect()}
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == 1000 and all((r["predicted"] == 1) == (r["score"] >= 0.5) for r in got.values())
    clean = [got[i]["predicted"] for i, t in marks.items() if t == 0]
    english = [got[i]["predicted"] for i, t in marks.items() if t == 1]
    assert sum(clean) / len(clean) < 0.05 and sum(english) / len(english) > 0.7


def test_language_model_parts():
    at, times = language_id.ngram_counts("Ab ab")
    assert times.sum() == 5 + 4 + 3 and len(at) == len(set(at))
    assert language_id.ngram_counts("")[0].size == 0
    x = language_id.weighted(at, times, np.ones(language_id.BUCKETS))
    assert abs(x @ x - 1) < 1e-9


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(0)
    model = language_id.Ftrl(2)
    rows = []
    for i in range(400):
        at = np.unique(np.concatenate([rng.integers(0, 50, 5) + 100 * (i % 2), rng.integers(1000, 3000, 5)]))
        rows.append((at, np.full(len(at), 1 / math.sqrt(len(at))), i % 2))
    for r in rows:
        model.learn(*r)
    w = model.weights(slice(None))
    assert (w != 0).mean() < 0.1
    assert np.mean([(x @ w[at] + w[-1]).argmax() == y for at, x, y in rows]) > 0.95


def test_language_id_is_right_on_held_out_rows(spark):
    got = language_id.op2_language_id(spark, SF).collect()
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and len(held) > 150
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in held]) >= 0.99
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_cases(spark, awkward, empty):
    model = language_id.fit(awkward)
    got = language_id.predict(awkward, model).collect()
    assert len(got) == awkward.count()
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (3, 4, 5)} == {("und", 0.0)}
    assert language_id.predict(empty, model).count() == 0
    nothing = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.predict(awkward, nothing).collect()} == {"und"}
    digits = spark.createDataFrame([(1, "12 34 !?")], "doc_id long, text string")
    assert language_id.predict(digits, model).first()["lang_pred"] == "und"


def test_best_level_by_brute_force():
    rng = random.Random(1)
    for _ in range(50):
        seen = [(int(rng.random() < 0.4), round(rng.uniform(0, 12) + 4 * (rng.random() < 0.5), 1)) for _ in range(rng.randint(0, 60))]
        tally: dict[tuple[int, float], int] = {}
        for x in seen:
            tally[x] = tally.get(x, 0) + 1
        level = toxicity.best_level(tally)
        rate = lambda at: sum((x >= at) != t and 1 / sum(u == t for u, _ in seen) for t, x in seen)
        assert level >= -math.log(toxicity.SIGNIFICANCE)
        assert all(rate(level) <= rate(x) + 1e-9 for _, x in seen if x > -math.log(toxicity.SIGNIFICANCE))


def test_segments_take_linear_time():
    rng = random.Random(6)
    hits = [(40 * i, rng.uniform(0.1, 2.0)) for i in range(1_000_000)]
    start = time.process_time()
    found = toxicity.segments(hits)
    assert time.process_time() - start < 20 and len(found) > 900_000
    # Hits close together, so that segments join again and again.
    assert len(toxicity.segments([(i + i // 3, s) for i, (_, s) in enumerate(hits)])) < 10


def test_every_label_is_learned(spark):
    """More labels than a model of all bits has: each is told from the others, and the model stays of one size."""
    rows = [(20 * i + j, " ".join(f"{chr(0x4E00 + i)}{chr(0x5E00 + i)}{k}" for k in range(j, j + 6)), f"l{i}") for i in range(450) for j in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, max_train=3_000)
    assert len(model.langs) == 450 and model.bits == 14 and model.weights.size <= 1.3 * language_id.BUCKETS * language_id.FULL_LANGS
    some = rows[::97]
    assert np.mean([model.predict(t)[0] == lang for _, t, lang in some]) > 0.9
    assert [language_id.bits_for(n) for n in (1, 200, 201, 400, 401, 800, 5_000)] == [16, 16, 15, 15, 14, 14, 11]


def slow_model(examples, langs, counts, n_docs):
    """FTRL over {bucket: weight} by plain loops, from the examples in the order of learning."""
    z: dict = {}
    n: dict = {}
    bias = language_id.BUCKETS

    def weight(b, c):
        v = z.get((b, c), 0.0)
        return 0.0 if abs(v) <= language_id.L1 else (math.copysign(language_id.L1, v) - v) / ((language_id.BETA + math.sqrt(n.get((b, c), 0.0))) / language_id.ALPHA + language_id.L2)

    def features(text):
        at, times = language_id.ngram_counts(text)
        x = {int(b): (1 + math.log(t)) * (math.log((1 + n_docs) / (1 + counts.get(int(b), 0))) + 1) for b, t in zip(at, times, strict=True)}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {b: v / size for b, v in x.items()} | {bias: 1.0}

    def chances(x):
        e = [sum(v * weight(b, c) for b, v in x.items()) for c in range(len(langs))]
        e = [math.exp(v - max(e)) for v in e]
        return [v / sum(e) for v in e]

    for text, lang in examples:
        x = features(text)
        w = {(b, c): weight(b, c) for b in x for c in range(len(langs))}
        p = chances(x)
        for b, v in x.items():
            for c, name in enumerate(langs):
                g = v * (p[c] - (name == lang))
                old = n.get((b, c), 0.0)
                z[b, c] = z.get((b, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / language_id.ALPHA * w[b, c]
                n[b, c] = old + g * g
    return lambda text: chances(features(text))


def test_language_model_against_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CALIBRATION", 0.0)
    rng = random.Random(8)
    letters = {"a": "abcdefg", "b": "defghij", "c": "ghijklm"}
    rows = [(i, " ".join("".join(rng.choice(letters[lang]) for _ in range(4)) for _ in range(8)), lang) for i, lang in enumerate("abc" * 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    order = []
    learn = language_id.Ftrl.learn

    def spy(self, at, x, y):
        order.append((frozenset(at.tolist()), y))
        learn(self, at, x, y)

    monkeypatch.setattr(language_id.Ftrl, "learn", spy)
    model = language_id.fit(df)
    of = {(frozenset(language_id.ngram_counts(t)[0].tolist()), model.langs.index(lang)): (t, lang) for _, t, lang in rows}
    counts: dict[int, int] = {}
    for _, t, _ in rows:
        for b in language_id.ngram_counts(t)[0].tolist():
            counts[b] = counts.get(b, 0) + 1
    slow = slow_model([of[x] for x in order], model.langs, counts, len(rows))
    for _, t, _ in rows[:9]:
        want = slow(t)
        assert model.predict(t)[0] == model.langs[want.index(max(want))]
        assert np.allclose(language_id.softmax(model.logits(t).astype(float)), want, atol=1e-4)
