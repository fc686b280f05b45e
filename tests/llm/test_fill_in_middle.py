import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import fill_in_middle as fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "a", " a", "a ", "one two  three\n\nfour ", "<P> a b c", "a <M", "é ñ ü", "  x　y", "x<" * 50, "<S" * 3 + " >", "w " * 60_000]


def brute(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("form", ["psm", "spm"])
def test_rotations_and_back(form):
    rng = random.Random(form)
    for _ in range(300):
        data = "".join(rng.choice("ab<>SPM é\n") for _ in range(rng.randint(0, 12)))
        if any(s in data for s in ("<P>", "<S>", "<M>")):
            continue
        data = data.encode()
        a, b = sorted((rng.randint(0, len(data)), rng.randint(0, len(data))))
        p, m, s = data[:a], data[a:b], data[b:]
        want = b"<P>" + p + b"<S>" + s + b"<M>" + m if form == "psm" else b"<S>" + s + b"<P>" + p + b"<M>" + m
        assert fim.arrange(data, a, b, form) == want and fim.rebuild(want, form) == data


def test_units_end_where_the_pattern_says():
    for t in TEXTS:
        data, at, want = (t or "").encode(), 0, []
        for u in UNIT.findall(t or ""):
            at += len(u.encode())
            want.append(at)
        assert fim.unit_ends(data).tolist() == want


def test_against_brute_force(spark):
    rows = [(i, t) for i in [None, *range(60)] for t in TEXTS[:-1]] + [(i, TEXTS[-1]) for i in range(5)] + [(3, "a b c")] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", F.lit("k").alias("Text_"), F.lit(1).alias("Form"), F.lit(2).alias("restored"))
    done = fim.restore(fim.transform(df))
    assert done.columns == ["doc_id", "text", "Text_", *fim.OUT, "restored"]
    got = done.collect()
    assert len(got) == len(rows) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.doc_id, r.text) and r.restored == (r.text or "")
    assert fim.restore(fim.transform(df.limit(0))).count() == 0
    assert fim.restore(spark.createDataFrame([(None, None), ("x", None)], "output string, form string")).filter("restored is not null").count() == 1
