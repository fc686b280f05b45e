import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from plumbline.llm import spelling
from plumbline.llm.common import staged
from plumbline.llm.queries import QUERIES

LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, ratio=5):
    out = {}
    beside = {w: [v for v in counts if near(w, v)] for w in counts}
    for w, n in counts.items():
        best = min(beside[w], key=lambda v: (-counts[v], v), default=None)
        form = best if best and counts[best] >= ratio * n else None
        out[w] = [n, len(beside[w]), form, counts[form] if form else None, w]
    for w, row in out.items():
        while out[row[4]][2]:
            row[4] = out[row[4]][2]
    return {w: tuple(row) for w, row in out.items()}


def table(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_against_brute_force(spark):
    rng = random.Random(11)
    words = Counter()
    for _ in range(60):
        base = "".join(rng.choice("abé") for _ in range(rng.randint(6, 9)))
        words[base] = rng.choice([5, 30, 200, 2000])
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(1, 2)):
                at, how = rng.randrange(len(w)), rng.randrange(3)
                w[at : at + (how != 0)] = [] if how == 1 else [rng.choice("abéz")]
            if len(w) >= 6:
                words["".join(w)] = rng.choice([5, 6, 25, 400])
    long = "".join(rng.choice("abc") for _ in range(4000))
    words |= {long: 100, long[:-1]: 10, long[1:]: 10, long[:2000] + "x" + long[2001:]: 7, "aaaaaa": 3000, "aaaaaaa": 500, "aaaaaaaa": 90, "aaaaaaaaa": 5}
    df = spark.createDataFrame(list(words.items()), "word string, n int").withColumn("form", F.lit("clash"))
    want = brute(words)
    assert table(spelling.variants(df)) == want
    assert sum(row[1] for row in want.values()) > 200 and any(row[4] != (row[2] or w) for w, row in want.items())
    assert spelling.variants(df.limit(0)).count() == 0


def test_every_pair_once_in_either_order(spark):
    words = staged(spark.createDataFrame([(i, w) for i, w in enumerate(["abcdef", "abcdeg", "bcdefg", "abcdefg", "xabcdef", "zzzzzz"])], "w bigint, word string"))
    pairs = [tuple(r) for r in spelling.near_words(words).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a, b in [(0, 1), (0, 3), (0, 4), (1, 3), (2, 3)] for a, b in [(a, b), (b, a)]}


def brute_counts(rows):
    words = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    return {w: n for w, n in words.items() if len(w) >= 6 and n >= 5}


def test_words_of_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, "ÀÉÎõüÿ ÀÉÎõüÿ. 12 ÀÉÎõüÿ×ÀÉÎõüÿ÷Abcdef"), (2, "ÀÉÎõüÿ ÀÉÎõüÿ. 12 ÀÉÎõüÿ×ÀÉÎõüÿ÷Abcdef"), (None, "abcdeF " * 50_000)]
    rows += [(i, "abcdef ghijkl") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("run", F.lit(1)).withColumn("id", F.lit(2))
    words = spelling.runs(df).select(spelling.with_typos(F.col("run"), F.col("id")).alias("word"))
    assert dict(map(tuple, spelling.counted(words).collect())) == brute_counts(rows)


def test_query(spark, folder):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert table(QUERIES["op12_spelling_variants"](spark, folder)) == brute(brute_counts(rows))
