import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm.substring_dedup import remove_repeated_spans, sentences

A = "The first sentence has five words. And the second one has a few more of them. A third one ends it here. "
B = "Nothing of this stands anywhere else in all the rows. It is only here once. So it has to stay. "
LONG = " ".join(f"w{i}" for i in range(60)) + ". "
ROWS = [
    (1, "Intro to a. " + A + B), (2, A.upper() + "Own words. "), (3, "x. " + A + A), (4, LONG), (5, "Before it. " + LONG),
    (6, None), (7, ""), (8, "No. No. No. No. No. "), (8, "No. No. No. No. No. "), (None, A), (9, "Él. " * 40), (10, "word " * 3_000), (10, A),
    (11, A + B + A), (12, "other " + A + B), (13, "\n" + LONG), (14, "\u3042" * 300 + "\u3002" + "\u3044" * 200), (15, "\u3042" * 300 + "\u3002" + "\u3044" * 200),
    (16, "  "), (17, "..."), (18, "Yes. " * 60 + A), (19, "x " + "Yes. " * 60),
]


def cut(text):
    ends = ".!?\u2026\u0964\u061f\u06d4\u3002\uff01\uff1f"
    for sentence in re.findall(rf"[^{ends}\n]*[{ends}\n]+[ \t-\r]*|[^{ends}\n]+", text):
        if len(sentence.encode().split()) <= 16:
            yield sentence
            continue
        part = ""
        for word in re.findall(r"[ \t-\r]*[^ \t-\r]+[ \t-\r]*", sentence):
            part += word
            if len(re.sub(r"[ \t-\r]+", "", word)) >= 8:
                yield part
                part = ""
        if part:
            yield part


def brute(rows, run=16, stretch=30):
    order = sorted({(i is not None, i or 0, t or "") for i, t in rows})
    seen, hidden = set(), {}
    for key in order:
        parts = list(cut(key[2]))
        assert "".join(parts) == key[2]
        words = [p.encode().lower().split() for p in parts]
        size = [max(len(w), len(p) // 12) for w, p in zip(words, parts)]
        covered = [False] * len(parts)
        for i in range(len(parts)):
            j = next((j for j in range(i + 1, len(parts) + 1) if sum(size[i:j]) >= run), None)
            if j:
                span = tuple(map(tuple, words[i:j]))
                if span in seen:
                    covered[i:j] = [True] * (j - i)
                seen.add(span)
        gone, i = set(), 0
        for hit, group in itertools.groupby(range(len(parts)), covered.__getitem__):
            group = list(group)
            if hit and sum(size[k] for k in group) >= stretch:
                gone.update(group)
        hidden[key] = "".join(p for k, p in enumerate(parts) if k not in gone), len(parts), len(gone)
    return [(i, None if t is None else hidden[(i is not None, i or 0, t or "")][0], *hidden[(i is not None, i or 0, t or "")][1:]) for i, t in rows]


def test_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").select("doc_id", F.lit(3).alias("Text"), "text", F.lit("q").alias("n_removed"), F.lit(1).alias("span"))
    got = remove_repeated_spans(df)
    assert got.columns == ["doc_id", "Text", "text", "span", "n_sentences", "n_removed"]
    # rows of equal id and different text are ordered by a hash of the text: compare those that do not depend on it
    rows = [tuple(r)[0:1] + tuple(r)[2:3] + tuple(r)[4:] for r in got.collect()]
    assert sorted(rows, key=str) == sorted(brute(ROWS), key=str)
    assert remove_repeated_spans(df.limit(0)).count() == 0


def test_sentences_are_the_text():
    for text in ["a.b! c?\n\nd  e", "...", "\n", "é. ", "no end"]:
        assert "".join(sentences(text)) == text
    assert sentences(None) == []


@pytest.mark.parametrize("shortest,longest", [(1, 4), (8, 15), (15, 30), (25, 45)])
def test_passages_that_begin_inside_a_sentence(spark, shortest, longest):
    rng = random.Random(longest)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice([2, 3, 4, 5, 6, 7, 8, 9, 10])))

    def prose(n):
        out = []
        while len(out) < n:
            out += [word() for _ in range(rng.randint(shortest, longest))]
            out[-1] += "."
        return out[:n]

    passages = [prose(200)[k : k + 60] for k in range(60)]
    rows = [(i, " ".join(prose(80) + passages[i % 60] + prose(80))) for i in range(120)]
    lines = [" ".join(prose(14)) for _ in range(20)]
    rows += [(200 + i, "\n".join([" ".join(prose(40)), lines[i % 20], " ".join(prose(40))])) for i in range(60)]
    got = {r.doc_id: r.n_removed for r in remove_repeated_spans(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i] == 0 for i in got if i < 60 or i >= 200)
    assert sum(got[i] > 0 for i in range(60, 120)) >= 57
