import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import license_scan as ls
from plumbline.llm.license_texts import PHRASES, TEMPLATES
from plumbline.llm.queries import QUERIES

AUTOMATON = ls.Automaton(TEMPLATES, PHRASES)


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def plain_base(text):
    w = plain_words(text)
    found = sorted((i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def test_matching_statistics_against_brute_force():
    random.seed(4)
    templates = {str(k): " ".join(random.choice("abc") for _ in range(14)) for k in range(4)}
    automaton = ls.Automaton(templates, {})
    inside = [t.split() for t in templates.values()]
    for _ in range(60):
        text = [random.choice("abcd") for _ in range(25)]
        ids = [automaton.ids.get(w.encode(), -1) for w in text]
        for i, (state, length) in enumerate(automaton.statistics(ids)):
            longest = max(n for n in range(i + 2) if n == 0 or any(s[k : k + n] == text[i + 1 - n : i + 1] for s in inside for k in range(len(s))))
            assert length == longest
            if length:
                ends = {(t, k + length - 1) for t, s in enumerate(inside) for k in range(len(s)) if s[k : k + length] == text[i + 1 - length : i + 1]}
                assert automaton.ends[state] == ends


def test_templates_are_found_whole_and_with_gaps():
    for name, text in TEMPLATES.items():
        row = ls.scan_text(AUTOMATON, "some words before\n" + text + "\nsome words behind")
        assert name in row[5].split(",") and row[6] == 1.0
        assert any(s[0] == name and s[1] == 3 and s[2] == 2 + len(plain_words(text)) for s in row[7])
    changed = TEMPLATES["mit-text"].replace("software", "work").replace("without restriction", "with no bounds set")
    assert "mit-text" in ls.scan_text(AUTOMATON, changed)[5]
    assert ls.scan_text(AUTOMATON, "any person may use the work of this author")[5] == ""
    twice = ls.scan_text(AUTOMATON, (TEMPLATES["bsd-text"] + " far apart words " * 20) * 2)
    assert sum(s[0] == "bsd-text" and s[4] == 1.0 for s in twice[7]) == 2


ROWS = [
    (1, "Released under the MIT License. MIT License; mit-license"), (2, None), (3, ""), (None, "GENERAL  public, License apache\nlicense"),
    (4, "mit license " * 50_000), (5, "ümit license É"), (5, "ümit license É"), (6, "mit licenses general public"),
]


def test_frames_against_plain_scan(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").select("doc_id", F.lit(1).alias("Text_"), "text", F.lit("s").alias("Spans"))
    got = ls.scan(df)
    assert got.columns == ["doc_id", "Text_", "text", *ls.OUT]
    rows = got.collect()
    assert len(rows) == len(ROWS) and ls.scan(df.limit(0)).count() == 0
    for r in rows:
        assert tuple(r)[3:8] == plain_base(r.text)
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    monkeypatch.setattr(ls, "CHUNK", 5)
    for _, text in ROWS[:4] + ROWS[5:]:
        assert ls.scan_text(AUTOMATON, text)[:5] == plain_base(text)


def test_query(spark, folder):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op9_license_scan"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(texts[r.doc_id])
