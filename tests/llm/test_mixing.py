import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import mixing as mx

def dims():
    return [F.col("source"), F.col("lang"), F.col("topic")]


def brute(cells, targets, budget, sweeps):
    """Cells {(s, l, t): tokens} → probabilities, by plain loops and bisection."""
    w = {c: float(n) for c, n in cells.items()}
    for _ in range(sweeps):
        for d in range(3):
            sums = {}
            for c in w:
                sums[c[d]] = sums.get(c[d], 0.0) + w[c]
            w = {c: w[c] * targets[d][c[d]] / sums[c[d]] if sums[c[d]] else 0.0 for c in w}
    low, high = 0.0, 1e9 * sum(cells.values())
    for _ in range(300):
        middle = (low + high) / 2
        held = sum(n * min(1, middle * w[c] / n) for c, n in cells.items() if n)
        low, high = (middle, high) if held < budget * sum(cells.values()) else (low, middle)
    return {c: min(1, high * w[c] / n) if n else 1.0 for c, n in cells.items()}, w


def rows():
    rng = np.random.default_rng(2)
    out = []
    for i in range(900):
        s, t = ["big", "big", "big", "small", None][rng.integers(5)], ["x", "y"][rng.integers(2)]
        out.append((i, " ".join(["w"] * int(rng.integers(0, 30))), ["en", "en", "de"][rng.integers(3)], s, t))
    return out + [(None, None, None, None, "x"), (7, "", "zz", "none", "x"), (9, "a " * 20_000, "en", "big", "x"), (9, "a " * 20_000, "en", "big", "x")]


@pytest.mark.parametrize("budget", [0.3, 0.9])
def test_probabilities_against_brute_force(spark, budget):
    data = rows()
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, topic string").withColumn("d0", F.lit(1)).withColumn("Sampled", F.lit("s"))
    got = mx.mixed(df, dims(), mx.token_count(F.col("text")), [F.col("doc_id"), F.col("text")], budget=budget)
    assert got.columns == ["doc_id", "text", "lang", "source", "topic", "d0", "n_tokens", "probability", "sampled"]
    found = got.collect()
    assert len(found) == len(data)
    cells = {}
    for _, text, lang, source, topic in data:
        cells[source, lang, topic] = cells.get((source, lang, topic), 0) + len((text or "").split())
    targets = []
    for d in range(3):
        sums = {}
        for c, n in cells.items():
            sums[c[d]] = sums.get(c[d], 0) + n
        powers = {k: v**mx.POWER for k, v in sums.items()}
        targets.append({k: v / sum(powers.values()) for k, v in powers.items()})
    want, w = brute(cells, targets, budget, mx.SWEEPS)
    for r in found:
        assert r.probability == pytest.approx(want[r.source, r.lang, r.topic], rel=1e-6)
        assert r.n_tokens == len((r.text or "").split())
    assert sum(r.probability * r.n_tokens for r in found) == pytest.approx(budget * sum(cells.values()), rel=1e-6)
    for d in range(3):  # raked weights have the target marginals
        for k, t in targets[d].items():
            assert sum(x for c, x in w.items() if c[d] == k) == pytest.approx(t, abs=0.02)
    assert len({r.sampled for r in found if r.doc_id == 9}) <= 2


def test_given_targets_and_empty_table(spark):
    df = spark.createDataFrame([(i, "a b c d", "en", "p" if i % 4 else "q", "x") for i in range(4000)], "doc_id bigint, text string, lang string, source string, topic string")
    aims = {
        "d0": spark.createDataFrame([("p", 0.5), ("q", 0.5)], "c string, s double"),
        "d1": spark.createDataFrame([], "c string, s double"),
        "d2": spark.createDataFrame([("x", 1.0)], "c string, s double"),
    }
    key = [F.col("doc_id"), F.col("text")]
    got = mx.mixed(df, dims(), mx.token_count(F.col("text")), key, aims, budget=0.5)
    held = {r.source: r.n for r in got.filter("sampled").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert held["q"] == 1000 and abs(held["p"] - 1000) < 100
    again = mx.mixed(df.repartition(13), dims(), mx.token_count(F.col("text")), key, aims, budget=0.5)
    assert again.filter("sampled").exceptAll(got.filter("sampled")).count() == 0
    assert mx.mixed(df.limit(0), dims(), mx.token_count(F.col("text")), key).count() == 0
