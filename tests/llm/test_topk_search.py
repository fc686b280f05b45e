import math

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import topk_search as tk


def brute(rows, asked, k):
    ok = lambda v: v is not None and all(c is not None and math.isfinite(c) for c in v)
    whole = lambda v: [math.floor(256 * c) for c in v]
    rows = list({(i, tuple(v)) for i, v in rows if i is not None and ok(v)})
    out = []
    for i, v in rows:
        if not asked(i):
            continue
        scored = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(whole(v), whole(w))))), j) for j, w in rows if (j, w) != (i, v)]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").select("vec_id", F.lit(1).alias("Vec_ID2"), "embedding", F.lit("s").alias("score"))
    return sorted(map(tuple, tk.top_k(df, df.filter("vec_id % 50 = 0"), k).collect()))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tk, "ROWS_PER_BLOCK", 70)
    monkeypatch.setattr(tk, "QUERIES_PER_BLOCK", 3)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=10).round(3).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[50][1]) for i in range(90)] + [(50, rows[50][1])] * 3  # many ties, repeated rows
    rows += [(None, [1.0] * 10), (400, None), (450, [float("nan")] * 10), (500, [None] + [1.0] * 9), (550, [float("inf")] * 10), (600, [1.0, -2.0]), (650, [])]
    assert run(spark, rows) == brute(rows, lambda i: i % 50 == 0, 5)


def test_few_rows_and_huge_components(spark):
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == []
    rows = [(0, [1e15, 1.0, 3.0]), (1, [1e15, 2.0, 0.1]), (2, [-1e15, 0.5, 2.0]), (3, [3.0, 1.0, 1.0]), (50, [1e3, 7e12, -1e12])]
    assert run(spark, rows) == brute(rows, lambda i: i % 50 == 0, 5)
    assert run(spark, rows, k=1) == brute(rows, lambda i: i % 50 == 0, 1)


def test_nothing_broadcast_grows_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(tk, "ROWS_PER_BLOCK", 20)
    rng = np.random.default_rng(6)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(6000, 12)).round(3).tolist())]
    limit = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(limit, "1m")  # the 120 queries hold 12 KB
    try:
        assert run(spark, rows) == brute(rows, lambda i: i % 50 == 0, 5)
    finally:
        spark.conf.unset(limit)


def test_queries_reach_the_driver_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(tk, "QUERY_BYTES", 4 << 10)
    monkeypatch.setattr(tk, "ROWS_PER_BLOCK", 50)
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: (sent.append(x.nbytes), broadcast(self, x))[1])
    rng = np.random.default_rng(7)
    # vectors of all lengths, numbers of all sizes, and one vector that many rows have
    rows = [(i, (rng.normal(size=i % 9) * 10.0 ** rng.integers(0, 12)).round(3).tolist()) for i in range(400)]
    rows += [(i, [0.5, 0.25, -1.0]) for i in range(1000, 1300)]
    assert run(spark, rows, k=3) == brute(rows, lambda i: i % 50 == 0, 3)
    assert len(sent) >= 4 and max(sent) <= 4 << 10
