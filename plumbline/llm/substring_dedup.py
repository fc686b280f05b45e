"""Substring dedup by sliding sentence spans: runs of consecutive sentences seen before go."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import lean, slices, staged

# Bytes of text whose sentences a task holds at a time.
HELD = 1_000_000

# Sentences end at runs of these and take the white space behind them; nothing of a text is left over.
ENDS = ".!?\u2026\u0964\u061f\u06d4\u3002\uff01\uff1f"
SENTENCE = re.compile(rf"[^{ENDS}\n]*[{ENDS}\n]+[\x20\x09-\x0D]*|[^{ENDS}\n]+")
# A long sentence is cut behind its long words, so that a passage that begins inside it is cut as elsewhere.
LONG_WORD = 8
PART = re.compile(
    rf"(?s)[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]{{1,{LONG_WORD - 1}}}[\x20\x09-\x0D]+)*[^\x20\x09-\x0D]{{{LONG_WORD},}}[\x20\x09-\x0D]*|.+"
)
# Characters that stand for a word where there are no spaces.
WORD_CHARS = 12


def sentences(text: str | None, long: int = 16) -> list[str]:
    """The text cut into sentences, those of over ``long`` words into parts; joined again they are the text."""
    out = []
    for s in SENTENCE.findall(text) if text else []:
        out += PART.findall(s) if len(s.encode("utf-8", "surrogatepass").split()) > long else [s]
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _runs(parts: list[list[str]], run: int) -> tuple[np.ndarray, ...]:
    """(document, first sentence, sentences, hash) of every run in a list of cut texts, and all sizes.

    A run ends with the sentence that gives it a size of ``run`` words; one that reaches
    over the end of its text first does not count. A sentence counts its words, or one per
    twelve characters if that is more.
    """
    sizes, hashes = [], []
    for text in parts:
        for s in text:
            words = s.encode("utf-8", "surrogatepass").lower().split()
            sizes.append(max(len(words), len(s) // WORD_CHARS))
            hashes.append(xxhash.xxh64_intdigest(b" ".join(words)))
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    n = len(sizes)
    ends = np.repeat(np.cumsum(counts), counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - (ends - counts[doc])
    w, h = np.array(sizes, dtype=np.int64), np.array(hashes, dtype=np.uint64)
    total, length, mixed = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.uint64)
    open_, k = np.arange(n), 0
    while len(open_):
        at = open_ + k
        open_, at = open_[at < ends[open_]], at[at < ends[open_]]
        total[open_] += w[at]
        mixed[open_] = _mix(mixed[open_] + h[at] + np.uint64(k + 1))
        length[open_] += 1
        open_, k = open_[total[open_] < run], k + 1
    good = total >= run
    return doc[good], place[good], length[good], mixed[good].view(np.int64), w


def _occurrences(run: int, long: int, places: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for i, j in slices([len(t) if t else 0 for t in texts.to_pylist()], HELD):
                parts = [sentences(t, long) for t in texts.slice(i, j - i).to_pylist()]
                doc, place, _, span, _ = _runs(parts, run)
                if not places:
                    yield pa.RecordBatch.from_arrays([pa.array(span)], ["span"])
                    continue
                keys = [batch.column(k).slice(i, j - i).take(pa.array(doc)) for k in range(2)]
                yield pa.RecordBatch.from_arrays([pa.array(span), *keys, pa.array(place.astype(np.int32))], ["span", "id", "print", "place"])

    return lean(work)


def _gone(parts: list[str], starts: list[int], run: int, stretch: int) -> set[int]:
    """Sentences that the runs from ``starts`` cover, in unbroken stretches of ``stretch`` words or more."""
    _, place, length, _, size = _runs([parts], run)
    reach, covered = dict(zip(place.tolist(), length.tolist())), set()
    for start in starts:
        covered.update(range(start, start + reach[start]))
    out, now = set(), []
    for k in sorted(covered):
        if now and k != now[-1] + 1:
            out.update(now if size[now].sum() >= stretch else ())
            now = []
        now.append(k)
    return out.union(now if now and size[now].sum() >= stretch else ())


def _cut(run: int, long: int, stretch: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices([len(t) if t else 0 for t in batch.column(batch.num_columns - 2).to_pylist()], HELD):
                *others, texts, starts = [c.slice(i, j - i) for c in batch.columns]
                out, total, removed = [], [], []
                for text, own in zip(texts.to_pylist(), starts.to_pylist()):
                    parts = sentences(text, long)
                    gone = _gone(parts, own, run, stretch) if own else ()
                    out.append("".join(p for k, p in enumerate(parts) if k not in gone) if gone else text)
                    total.append(len(parts))
                    removed.append(len(gone))
                arrays = [*others, pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-2], "_text", "_total", "_removed"])

    return lean(work)


def remove_repeated_spans(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", run: int = 16, long: int = 16, stretch: int = 30
) -> DataFrame:
    """``df`` with repeated spans cut out of ``text``, and ``n_sentences`` and ``n_removed``.

    Sentences of over ``long`` words are cut into parts behind their long words. From every
    sentence on, so many as make ``run`` words are hashed over their ASCII-lower-cased
    words; a run that occurs earlier, in order of id, text hash and place, covers its
    sentences, and an unbroken stretch of covered sentences goes if it has ``stretch``
    words. So a passage of over 50 words is found wherever in a sentence it begins, and a
    line that texts share stays. Ids order with null first; rows with equal id and text
    count as one document and are cut alike. Null texts stay null, empty ones empty; a text
    whose sentences are all repeats becomes empty, its row stays. Input columns called like
    the two new ones are replaced; all others are kept whatever their names. Spans are
    64-bit hashes.
    """
    columns = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(columns))])
    key, body = f"_c{columns.index(id_col)}", f"_c{columns.index(text)}"
    kind = dict(flat.dtypes)[key]
    keyed = flat.select(F.col(key).alias("id"), F.xxhash64(body).alias("print"), F.col(body).alias("text"))

    spans = keyed.select("text").mapInArrow(_occurrences(run, long, False), "span bigint")
    repeated = spans.groupBy("span").agg(F.count("*").alias("n")).filter("n > 1").select("span")
    places = keyed.mapInArrow(_occurrences(run, long, True), f"span bigint, id {kind}, print bigint, place int")
    # Written, so that both joins may split a hot span and the first place is reduced before it is shuffled.
    again = staged(places.join(repeated, "span"))
    place = F.struct("id", "print", "place")
    first = staged(again.groupBy("span").agg(F.min(place).alias("first")))
    later = again.join(first.withColumnRenamed("span", "_span"), F.col("span") == F.col("_span")).filter(place != F.col("first"))
    gone = staged(later.groupBy("id", "print").agg(F.collect_set("place").alias("_gone")))

    joined = flat.withColumn("_print", F.xxhash64(body)).join(
        gone, F.col(key).eqNullSafe(F.col("id")) & (F.col("_print") == F.col("print")), "left"
    )
    new = {"n_sentences", "n_removed"}
    others = [c for i, c in enumerate(flat.columns) if c != body and columns[i].lower() not in new]
    schema = ", ".join([f"{n} {t}" for n, t in flat.select(*others).dtypes] + ["_text string", "_total bigint", "_removed bigint"])
    done = joined.select(*others, body, "_gone").mapInArrow(_cut(run, long, stretch), schema)
    shown = []
    for i, name in enumerate(columns):
        if f"_c{i}" == body:
            shown.append(F.col("_text").alias(name))
        elif name.lower() not in new:
            shown.append(F.col(f"_c{i}").alias(name))
    return done.select(*shown, F.col("_total").alias("n_sentences"), F.col("_removed").alias("n_removed"))
