import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language_id as li
from plumbline.llm.queries import QUERIES

TEXTS = {"aa": ["abba cab abc cabba", "bab ab cab"], "bb": ["xyz zyx zzxy", "yx abz xzy yyx"]}


def symbols(text):
    out, last = [], True
    for c in text + "\0":
        s = c.lower() if c.isalpha() else 0
        if s or not last:
            out.append(s)
        last = not s
    return out


def brute_prob(texts, vocabulary):
    """A function (context, symbol) → interpolated Kneser-Ney probability, by plain dictionaries."""
    counts = Counter()
    for t in texts:
        s = [0] * (li.ORDER - 1) + symbols(t)
        counts.update(tuple(s[i : i + li.ORDER]) for i in range(len(s) - li.ORDER + 1))
    tables = []
    for _ in range(li.ORDER):
        n1, n2 = (sum(v == k for v in counts.values()) for k in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.75
        by = defaultdict(dict)
        for g, n in counts.items():
            by[g[:-1]][g[-1]] = n
        tables.append((d, by))
        counts = Counter(g[1:] for g in counts)

    def prob(context, symbol, level=0):
        if level == li.ORDER:
            return 1 / vocabulary
        d, by = tables[level]
        seen = by.get(tuple(context))
        below = prob(context[1:], symbol, level + 1)
        if not seen:
            return below
        total = sum(seen.values())
        left = sum(min(n, d) for n in seen.values()) / total
        return max(seen.get(symbol, 0) - d, 0) / total + left * below

    return prob


def model_of(texts):
    grams = {}
    for name, own in texts.items():
        s, _, place = li._symbols(own)
        grams[name] = np.unique(li._keys(s, place, 0, len(s)), return_counts=True)
    return li.estimate(sorted(texts), {k: (a, b.astype(float)) for k, (a, b) in grams.items()})


@pytest.mark.parametrize("text", ["cab", "zyx abba", "qq", "Abz!! xzy 12 yyx", "a", "x\ny"])
def test_entropy_against_dictionaries(text, monkeypatch):
    monkeypatch.setattr(li, "CHUNK", 3)
    model = model_of(TEXTS)
    vocabulary = len({s for own in TEXTS.values() for t in own for s in symbols(t)}) + 1
    got, _ = li._entropies(model, ["other", text])
    for i, name in enumerate(model.languages):
        prob = brute_prob(TEXTS[name], vocabulary)
        s = [0] * (li.ORDER - 1) + symbols(text)
        each = [-math.log(prob(s[k : k + li.ORDER - 1], s[k + li.ORDER - 1])) for k in range(len(s) - li.ORDER + 1)]
        assert got[1, i] == pytest.approx(sum(each) / len(each), rel=1e-5)


def test_probabilities_sum_to_one():
    model = model_of(TEXTS)
    known = sorted({ord(s) if s else 0 for own in TEXTS.values() for t in own for s in symbols(t)})
    for context in [(97, 98, 98, 97), (0, 0, 0, 120), (113, 113, 113, 113)]:
        base = sum(c << (li.BITS * (li.ORDER - 1 - k)) for k, c in enumerate(context))
        p = np.exp(li._log_probs(model, np.array([base | s for s in known] + [base | 999]))).sum(axis=0)
        assert p == pytest.approx(np.ones(len(model.languages)), rel=1e-5)


def test_edge_rows(spark):
    rows = [(i, t, n) for n, own in TEXTS.items() for i, t in enumerate(own * 40)]
    rows += [(None, None, None), (1, "", "aa"), (2, "123 !!", "bb"), (3, "abba " * 30_000, None), (3, "abba " * 30_000, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").select("*", F.lit(1).alias("Score"), F.lit("k").alias("Text_"))
    got = li.identify(df, li.train(df))
    assert got.columns[:4] == ["doc_id", "text", "lang", "Text_"]
    for r in got.collect():
        if not r.text or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred == (r.lang or "aa") and 0 <= r.score <= 1 and not r.rejected
    assert li.train(df.limit(0)) is None and li.identify(df.limit(0), None).count() == 0
    assert {r.lang_pred for r in li.identify(df, None).collect()} == {"und"}


def test_held_out_accuracy(spark, folder):
    got = QUERIES["op2_language_id"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    rate = got.filter("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.avg(F.col("rejected").cast("double"))).first()
    assert rate[0] > 0.95 and rate[1] < 0.05


@pytest.mark.parametrize("rare_rows", [40, 5, 0])
def test_rare_languages_keep_a_limit(spark, rare_rows):
    rng = np.random.default_rng(3)
    words = {"aa": ["abba", "cab", "abc", "bab"], "bb": ["xyz", "zyx", "zzxy", "yxy"]}
    text = lambda name: " ".join(rng.choice(words[name], 30))
    model = model_of({name: [text(name) for _ in range(50)] for name in words})
    rows = [(text("aa"), "aa") for _ in range(4000)] + [(text("bb"), "bb") for _ in range(rare_rows)]
    model = li.calibrate(model, spark.createDataFrame(rows, "text string, lang string"), rows=100)
    assert np.isfinite(model.limits).all()
    odd = spark.createDataFrame([("zqxzwyvxkzzjqy" * 20,), (text("bb"),)], "text string")
    got = [(r.lang_pred, r.rejected) for r in li.identify(odd, model).collect()]
    assert got == [("bb", True), ("bb", False)]


def test_counts_passed_on_in_parts_and_rows_beyond_the_bound(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = {"aa": ["abba", "cab", "abc", "bab"], "bb": ["xyz", "zyx", "zzxy", "yxy"]}
    texts = {name: [" ".join(rng.choice(words[name], 30)) for _ in range(60)] for name in words}
    monkeypatch.setattr(li, "CHUNK", 50)
    monkeypatch.setattr(li, "GRAMS_HELD", 20)
    batch = li.pa.RecordBatch.from_pydict({"lang": [n for n in texts for _ in texts[n]], "text": [t for n in texts for t in texts[n]]})
    sums = Counter()
    parts = list(li._count_grams(iter([batch])))
    assert len(parts) > 2 and all(p.num_rows <= 200 for p in parts)
    for p in parts:
        for name, gram, n in zip(*p.to_pydict().values()):
            sums[name, gram] += n
    whole = li.fit(spark.createDataFrame([(t, n) for n in texts for t in texts[n]], "text string, lang string"))
    want = model_of(texts)
    assert whole.languages == want.languages and sum(sums.values()) == sum(len(symbols(t)) for own in texts.values() for t in own)
    for a, b in zip(whole.levels, want.levels):
        assert np.array_equal(a.grams, b.grams) and np.allclose(a.logs, b.logs, atol=1e-5)
    few = li.fit(spark.createDataFrame([(t, n) for n in texts for t in texts[n]], "text string, lang string"), chars=2_000)
    assert few.levels[-1].logs.shape != whole.levels[-1].logs.shape or not np.allclose(few.levels[-1].logs, whole.levels[-1].logs)
    entropies, _ = li._entropies(few, texts["aa"] + texts["bb"])
    assert (entropies.argmin(axis=1) == np.repeat([0, 1], 60)).all()
