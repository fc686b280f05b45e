"""Spelling variants by a relational trie: states of words meet a distributed edge table level by level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import quoted, staged
from plumbline.plans.staging import broadcast_if_small

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Nodes up to this depth are never folded into a longer edge; words are twice as long at least.
SHALLOW = 3
# Code points of words whose nodes a task works out at a time.
HELD = 1_000_000


def runs(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, run): every maximal run of letters of every text, A-Z lower-cased; null texts have none."""
    found = F.explode(F.regexp_extract_all(quoted(text), F.lit(LETTERS), 0))
    return df.select(quoted(id_col).alias("id"), found.alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))


def with_typos(run: Column, id_col: Column, every: int = 199) -> Column:
    """A run without one code point, if ``every`` divides the crc32 of ``id:run``; which one the crc32 tells as well."""
    h = F.crc32(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted(words: DataFrame, word: str = "word", shortest: int = 6, least: int = 5) -> DataFrame:
    """(word, n) of the words of ``shortest`` code points that occur ``least`` times."""
    long = words.filter(F.length(quoted(word)) >= shortest)
    return long.groupBy(quoted(word).alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, side, depth, node, next) of every beginning of every word, the whole word included (next -1).

    A node is a hash of the beginning's letters and places; side 1 has the words backwards.
    """
    for batch in batches:
        ids, words = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        first = 0
        while first < len(words):
            last = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), HELD, side="right")))
            part, n = words[first:last], sizes[first:last]
            w = np.repeat(np.arange(last - first), n + 1)
            depth = np.arange(len(w)) - np.repeat(np.cumsum(n + 1) - (n + 1), n + 1)
            power = np.cumprod(np.r_[np.uint64(1), np.full(int(n.max()), 0x9E3779B97F4A7C15, np.uint64)])
            for side in (0, 1):
                flat = "".join((x[::-1] if side else x) + "\0" for x in part)
                points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
                value = np.where(points > 0, _mix(points.astype(np.uint64) + np.uint64(1)) * power[depth], np.uint64(0))
                upto = np.cumsum(value) - value  # what stands before each place
                own = upto - np.repeat(upto[depth == 0], n + 1)
                node = _mix(own + _mix((2 * depth + side + 1).astype(np.uint64))).view(np.int64)
                arrays = [pa.array(ids[first:last][w]), pa.array(np.full(len(w), side, np.int32)), pa.array(depth.astype(np.int32)), pa.array(node)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.where(points > 0, points, -1).astype(np.int32))], ["w", "side", "depth", "node", "next"])
            first = last


def _trie(words: DataFrame) -> DataFrame:
    """The path of every word (w, side, depth, node, label, child), both ways.

    A node is kept where words part or end, or at a small depth; an edge holds all letters up to the
    next one, so a long word that is like no other is a few edges.
    """
    rows = words.select("w", "word").mapInArrow(_nodes, "w bigint, side int, depth int, node bigint, next int")
    rows = staged(rows)
    kinds = rows.groupBy("node").agg(F.min("next").alias("low"), F.max("next").alias("high"), F.min("depth").alias("d"))
    kept = staged(kinds.filter((F.col("low") < 0) | (F.col("low") < F.col("high")) | (F.col("d") <= SHALLOW)).select(F.col("node").alias("kept")))
    path = rows.join(broadcast_if_small(kept), F.col("node") == F.col("kept"), "left_semi").select("w", "side", "depth", "node")
    along = Window.partitionBy("w", "side").orderBy("depth")
    path = path.withColumn("child", F.lead("node").over(along)).withColumn("to", F.lead("depth").over(along))
    named = words.select(F.col("w").alias("_w"), "word")
    read = F.when(F.col("side") == 1, F.reverse("word")).otherwise(F.col("word"))
    path = path.join(named, F.col("w") == F.col("_w")).withColumn("read", read)
    label = F.substring("read", F.col("depth") + 1, F.col("to") - F.col("depth"))
    return staged(path.select("w", "side", "depth", "node", "child", "read", label.alias("label")))


def _step(state: DataFrame, edges: DataFrame) -> DataFrame:
    """All states one edge further.

    A state that has used its edit must read the label as it is. Another may also read it
    with one letter replaced, or with one letter of the word left out; what a letter more
    gives is the same pair seen from the longer word. Edits count only behind the word's
    first half, since those before it are found from the word's other end.
    """
    rest, size, long = F.col("rest"), F.length("label"), F.length("rest")
    same = F.startswith(rest, F.col("label"))
    free = (F.col("edits") == 0) & (F.col("position") + size > F.col("half"))
    one = lambda n: F.levenshtein(F.substring(rest, F.lit(1), n), F.col("label"), 1) == 1
    replaced = free & ~same & (long >= size) & one(size)
    # A letter left out; behind the whole label only at the word's end, elsewhere the next edge sees it.
    left_out = free & (long > size) & ((~same & one(size + 1)) | (same & (long == size + 1)))
    move = lambda used, more: F.struct(used.alias("read"), (F.col("edits") + more).alias("edits"))
    moves = F.array_compact(F.array(F.when(same, move(size, 0)), F.when(replaced, move(size, 1)), F.when(left_out, move(size + 1, 1))))
    met = state.join(broadcast_if_small(edges), F.col("node") == F.col("from")).withColumn("m", F.explode(moves))
    read = F.col("m.read")
    return met.select(
        "w", "half", (F.col("position") + read).alias("position"), F.col("child").alias("node"), F.col("m.edits").alias("edits"),
        F.substring(rest, read + 1, long).alias("rest"),
    )


def near_words(words: DataFrame) -> DataFrame:
    """(w, v): every ordered pair of words that differ by one inserted, deleted or replaced code point.

    ``words`` (w long, word), staged, holds distinct words of six code points at least;
    every pair differs in the second half of the word, read forwards or backwards, so states
    start at the node in the middle of each word with no edit and move along the edges,
    level by level; a word that ends where another does, one edit used, has found it.
    """
    path = _trie(words)
    edges = staged(path.filter("child is not null").select(F.col("node").alias("from"), "label", "child").distinct())
    ends = path.filter("child is null").select(F.col("node").alias("end"), F.col("w").alias("v"))
    half = F.floor(F.length("read") / 2).cast("int")
    middle = F.max_by(F.struct("node", "depth", "read"), F.when(F.col("depth") <= half, F.col("depth"))).alias("s")
    start = path.groupBy("w", "side").agg(middle).select("w", "s.*")
    state = start.select(
        "w", F.floor(F.length("read") / 2).cast("int").alias("half"), F.col("depth").alias("position"), "node",
        F.lit(0).alias("edits"), F.substring("read", F.col("depth") + 1, F.length("read")).alias("rest"),
    )
    found = None
    while True:
        state = staged(_step(state, edges))
        over = (F.col("rest") == "") & (F.col("edits") == 1)
        done = state.filter(over).join(broadcast_if_small(ends), F.col("node") == F.col("end")).select("w", "v")
        found = done if found is None else found.union(done)
        state = state.filter((F.col("rest") != "") | (F.col("edits") == 0))
        if state.isEmpty():
            break
    left, right = words.toDF("_w", "a"), words.toDF("_v", "b")
    once = staged(found.select(F.least("w", "v").alias("w"), F.greatest("w", "v").alias("v")).distinct())
    exact = once.join(left, F.col("w") == F.col("_w")).join(right, F.col("v") == F.col("_v"))
    exact = staged(exact.filter(F.levenshtein("a", "b", 1) == 1).select("w", "v"))
    return exact.union(exact.select(F.col("v").alias("w"), F.col("w").alias("v")))


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every row of ``words`` (word, n; distinct words of six letters at least).

    Near words differ by one code point inserted, deleted or replaced. A word's form is its
    most frequent near word, the smallest of ties in code-point order, if that is
    ``ratio`` times as frequent at least; its root is where its forms lead in the end. A
    word without a form is its own root; an empty table gives an empty one.
    """
    # Numbers are fixed by writing them.
    numbered = staged(words.select(F.monotonically_increasing_id().alias("w"), "word", F.col("n").cast("long").alias("n")))
    near = near_words(numbered.select("w", "word"))
    other = numbered.select(F.col("w").alias("_v"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("k"), "near", F.col("v").alias("to"))).alias("best")
    named = staged(near.join(other, F.col("v") == F.col("_v")).groupBy("w").agg(F.count("*").alias("n_near"), best).withColumnRenamed("w", "_w"))
    rows = numbered.join(named, F.col("w") == F.col("_w"), "left").withColumn("near_n", -F.col("best.k"))
    has = F.col("near_n") >= ratio * F.col("n")
    rows = staged(rows.select(
        "w", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best.near")).alias("form"),
        F.when(has, F.col("near_n")).alias("form_n"), F.when(has, F.col("best.to")).alias("to"),
    ))
    roots = _roots(rows.filter("to is not null").select("w", "to"))
    last = roots.toDF("_w", "_to").join(numbered.select(F.col("w").alias("_r"), F.col("word").alias("root")), F.col("_to") == F.col("_r"))
    done = rows.join(last.select("_w", "root"), F.col("w") == F.col("_w"), "left")
    return done.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def _roots(parents: DataFrame) -> DataFrame:
    """(w, root) by pointer jumping; counts grow along a chain, so there are few rounds and no circle."""
    now = staged(parents)
    while True:
        up = now.toDF("_w", "_to")
        further = now.join(broadcast_if_small(up), F.col("to") == F.col("_w"), "left")
        now = staged(further.select("w", F.coalesce("_to", "to").alias("to"), F.col("_to").isNotNull().alias("moved")))
        if now.filter("moved").isEmpty():
            return now.select("w", "to")
        now = now.select("w", "to")
