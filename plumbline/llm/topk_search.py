"""Exact top-k inner-product search by a three-phase uniform threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import lean, pick, quoted, staged
from plumbline.plans.staging import new_path

PARTS = 4  # local score lists: one for each part of the components
ROWS_PER_BLOCK = 4096
# Queries go out in broadcasts of about so many, and of so many bytes with what a task keeps for them.
QUERIES_PER_BLOCK = 32_768
QUERY_BYTES = 32 << 20
QUERIES_PER_TILE = 128
# Row groups of the staged rows: small, so that any number of tasks can share them.
ROW_GROUP_BYTES = 8 << 20
# Tasks of a phase, or twice the cores if that is more: each hands on k rows a query.
TASKS = 64
EXACT = float(1 << 53)
EXACT_SINGLE = float(1 << 24)
LONG = (1 << 63) - 1


def clean(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Distinct (id, v) rows that take part: an id, and a vector of finite components."""
    rows = pick(df, id_col, vector).select(quoted(id_col).cast("long").alias("id"), quoted(vector).cast("array<double>").alias("v"))
    broken = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(~broken).distinct()


def _pieces(rows: pa.RecordBatch | pa.Table, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, ids and integer components of rows (id, v), at most ``size`` at a time in order of id.

    The rows of a piece are alike in length (shorter ones end in zeros) and in magnitude:
    few very long vectors or huge numbers neither widen nor slow down the others.
    """
    ids, lists = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (rows.column(0), rows.column(1)))
    ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    # no negative zeros: equal components have equal bits
    flat = np.floor(256.0 * lists.flatten().to_numpy(zero_copy_only=False)) + 0.0
    start, filled = np.cumsum(lengths) - lengths, lengths > 0
    largest = np.zeros(len(ids))
    if filled.any():
        largest[filled] = np.maximum.reduceat(np.abs(flat), start[filled])
    square = lengths * largest**2
    alike = 128 * ((square >= EXACT_SINGLE).astype(int) + (square >= EXACT)) + np.frexp(lengths.astype(float))[1]
    order = np.lexsort((ids, alike))
    for same in np.split(order, np.flatnonzero(np.diff(alike[order])) + 1):
        for at in (same[i : i + size] for i in range(0, len(same), size)):
            n = lengths[at]
            values = np.zeros((len(at), max(1, n.max())))
            row, column = np.repeat(np.arange(len(at)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            values[row, column] = flat[np.repeat(start[at], n) + column]
            yield at, ids[at], values


def _prints(ids: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A hash of each row, the same whatever zeros it ends in."""
    odd = np.arange(1, values.shape[1] + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    bits = values.view(np.uint64)
    return ((bits ^ (bits >> np.uint64(32))) * odd[1:]).sum(axis=1, dtype=np.uint64) + ids.astype(np.uint64) * odd[0]


def _cast(values: np.ndarray, bound: float) -> np.ndarray:
    """Components in a type in which sums up to ``bound`` are exact."""
    if bound < EXACT_SINGLE:
        return values.astype(np.float32)
    return values if bound < EXACT else np.vectorize(int, otypes=[object])(values)


class _Block:
    """Some rows in order of id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, first: int) -> None:
        self.ids, self.values, self.first = ids, values, first  # first: number of the first row in its task
        self.largest = np.abs(values).max()
        prints = _prints(ids, values)
        self.by_print = np.argsort(prints, kind="stable")
        self.prints = prints[self.by_print]
        self._cut, self._parts = None, []

    def parts(self, width: int, bound: float) -> list[tuple[int, int, np.ndarray]]:
        """Where each part of the first ``width`` components begins and ends, and the part itself."""
        cut = (width, bound < EXACT_SINGLE, bound < EXACT)
        if cut != self._cut:
            edges = [width * i // PARTS for i in range(PARTS + 1)]
            parts = [(a, b, _cast(self.values[:, a:b], bound)) for a, b in zip(edges, edges[1:]) if b > a]
            self._cut, self._parts = cut, [(a, b, np.ascontiguousarray(part.T)) for a, b, part in parts]
        return self._parts


class _Tile:
    """Some queries: their places in the broadcast, and the k best entries of each group so far."""

    def __init__(self, places: np.ndarray, ids: np.ndarray, values: np.ndarray, groups: int, kinds: tuple[type, ...]) -> None:
        self.places, self.ids, self.values = places, ids, values
        self.largest = np.abs(values).max()
        self.prints = _prints(ids, values)
        # group, fall (smaller is better), tie, more; fall of the k-th best
        self.best = tuple(np.empty(0, dtype=kind) for kind in (np.int64, *kinds))
        self.worst = np.full(len(ids) * groups, np.inf if kinds[0] is float else LONG, dtype=kinds[0])

    def _reach(self, block: _Block) -> tuple[int, float]:
        """Components that both sides have, and what no sum of their products goes beyond."""
        width = min(self.values.shape[1], block.values.shape[1])
        return width, float(width * self.largest * block.largest)

    def own(self, block: _Block) -> tuple[np.ndarray, np.ndarray]:
        """Where a query meets its own row."""
        low, high = np.searchsorted(block.prints, self.prints, "left"), np.searchsorted(block.prints, self.prints, "right")
        times = high - low
        row = np.repeat(np.arange(len(times)), times)
        at = block.by_print[np.arange(len(row)) - np.repeat(np.cumsum(times) - times - low, times)]
        q, x, width = self.values[row], block.values[at], self._reach(block)[0]
        same = (q[:, :width] == x[:, :width]).all(axis=1) & ~q[:, width:].any(axis=1) & ~x[:, width:].any(axis=1)
        same &= self.ids[row] == block.ids[at]
        return row[same], at[same]

    def local_scores(self, block: _Block) -> list[np.ndarray]:
        """One score matrix per part of the components; whole numbers, exact at any size."""
        width, bound = self._reach(block)
        return [_cast(self.values[:, a:b], bound) @ part for a, b, part in block.parts(width, bound)]

    def totals(self, block: _Block, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whole scores of some pairs."""
        width, bound = self._reach(block)
        return (_cast(self.values[row, :width], bound) * _cast(block.values[at, :width], bound)).sum(axis=1)

    def add(self, k: int, *entries: np.ndarray) -> np.ndarray:
        """Take entries (group, fall, tie, more) up; the groups that have k by now."""
        group, fall, tie, *more = (np.concatenate([old, new]) for old, new in zip(self.best, entries))
        order = np.lexsort((tie, fall, group))
        group = group[order]
        number = _number(group)
        keep, last = number < k, number == k - 1
        self.best = (group[keep], *(c[order[keep]] for c in (fall, tie, *more)))
        self.worst[group[last]] = fall[order[last]]
        return group[last]


def _number(group: np.ndarray) -> np.ndarray:
    """Number of each entry in its group, from 0; groups lie together."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    return np.arange(len(group)) - np.repeat(first, np.diff(first, append=len(group)))


def _tiles(queries: pa.Table, groups: int, *kinds: type) -> list[_Tile]:
    return [_Tile(*piece, groups, kinds) for piece in _pieces(queries, QUERIES_PER_TILE)] if queries.num_rows else []


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[_Block]:
    first = 0
    for batch in batches:
        for _, ids, values in _pieces(batch, size) if batch.num_rows else ():
            yield _Block(ids, values, first)
            first += len(ids)


def _in_range(score: np.ndarray) -> np.ndarray:
    """Scores as longs, cut off at their ends (only exact sums of huge components reach them)."""
    if score.dtype == object:
        return np.array([max(-LONG - 1, min(LONG, s)) for s in score], dtype=np.int64)
    return score.astype(np.int64)


def _below(score: np.ndarray) -> np.ndarray:
    """Doubles that are not above the scores: below a rounded-down score there is nothing to lose."""
    near = score.astype(float)
    return near - np.where(np.abs(near) >= EXACT, np.abs(near) * 1e-12, 0.0)


def _first_equal(row: np.ndarray, equal: np.ndarray, k: int) -> np.ndarray:
    """All entries (in order of row) but those marked equal beyond the first ``k`` of their row."""
    number = np.cumsum(equal)
    before = (number - equal)[np.searchsorted(row, row, "left")]
    return ~equal | (number - before <= k)


def _least(score: np.ndarray, k: int) -> np.ndarray:
    """For each row a score that its ``k`` best reach: the k-th best of the largest of ``4 k`` groups."""
    size = score.shape[1] // (4 * k)
    if size < 2:
        return np.full(len(score), -np.inf)
    largest = score[:, : size * 4 * k].reshape(len(score), size, 4 * k).max(axis=1)
    return np.partition(largest, 3 * k, axis=1)[:, 3 * k].astype(float)


def _phase_one(shared, k: int, size: int):
    """Local lists: the k best of each part, with the scores they come to in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = _tiles(shared.value, PARTS, float, np.int64, float)
        for block in _blocks(batches, size) if tiles else ():
            for tile in tiles:
                found, parts, own = [], tile.local_scores(block), tile.own(block)
                for n, part in enumerate(parts):
                    if part.dtype == object:
                        part = part.astype(float)
                    part[own] = -np.inf
                    least = 1.0 - tile.worst[n::PARTS]
                    if np.isinf(least).any():
                        least = np.maximum(least, _least(part, k))
                    flat = np.flatnonzero(part >= least.astype(part.dtype)[:, None])
                    row, at = np.divmod(flat, part.shape[1])
                    score = part.ravel()[flat].astype(float)
                    kept = _first_equal(row, score == least[row], k) & (score > -np.inf)
                    found.append((at[kept], row[kept] * PARTS + n, -score[kept]))
                at, group, fall = (np.concatenate(c) for c in zip(*found))
                if len(at):
                    tile.add(k, group, fall, block.first + at, np.zeros(len(at)))
                    group, _, number, total = tile.best
                    new = number >= block.first
                    total[new] = _below(_in_range(tile.totals(block, group[new] // PARTS, number[new] - block.first)))
        for tile in tiles:
            group, _, number, total = tile.best
            order = np.lexsort((number, group // PARTS))
            row, number, total = group[order] // PARTS, number[order], total[order]
            # a row of several lists counts once
            once = (np.diff(row, prepend=-1) != 0) | (np.diff(number, prepend=-1) != 0)
            row, total = row[once], total[once]
            order = np.lexsort((-total, row))
            order = order[_number(row[order]) < k]
            arrays = [pa.array(tile.places[row[order]], pa.int64()), pa.array(total[order])]
            yield pa.RecordBatch.from_arrays(arrays, ["place", "score"])

    return lean(run)


def _phases_two_three(shared, bounds, k: int, size: int):
    """Entries over the uniform threshold in some list, resolved exactly against the cutoff."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles = _tiles(shared.value, 1, np.int64, np.int64)
        cutoffs = [bounds.value[tile.places] for tile in tiles]
        for block in _blocks(batches, size) if tiles else ():
            for tile, cutoff in zip(tiles, cutoffs):
                parts, own = tile.local_scores(block), tile.own(block)
                with np.errstate(over="ignore"):
                    kind = float if parts[0].dtype == object else parts[0].dtype
                    share = np.nextafter((cutoff / len(parts)).astype(kind), np.array(-np.inf, dtype=kind))[:, None]
                enough = np.zeros(parts[0].shape, dtype=bool)
                for part in parts:
                    enough |= part >= share
                enough |= cutoff[:, None] <= -float(LONG)
                enough[own] = False
                flat = np.flatnonzero(enough)
                score = _in_range(sum((part.ravel()[flat] for part in parts[1:]), parts[0].ravel()[flat]))
                row, at = np.divmod(flat, len(block.ids))
                near = score >= cutoff[row]
                row, at, score = row[near], at[near], score[near]
                # the block is in order of id: of equal scores the first come first
                kept = _first_equal(row, score == cutoff[row], k)
                if kept.any():
                    full = tile.add(k, row[kept], ~score[kept], block.ids[at[kept]])
                    cutoff[full] = np.maximum(cutoff[full], _below(~tile.worst[full]))
        for tile in tiles:
            row, fall, vec_id = tile.best
            arrays = [pa.array(tile.places[row], pa.int64()), pa.array(tile.ids[row]), pa.array(vec_id), pa.array(~fall)]
            yield pa.RecordBatch.from_arrays(arrays, ["place", "query_id", "vec_id", "score"])

    return lean(run)


def _first(found: DataFrame, k: int, *order) -> DataFrame:
    """The ``k`` first rows of every place, numbered by ``rank``."""
    number = F.row_number().over(Window.partitionBy("place").orderBy(*order))
    return found.withColumn("rank", number).filter(F.col("rank") <= k)


def _answers(asked: DataFrame, rows: DataFrame, k: int, path: str) -> None:
    """The three phases for as many queries as go out in one broadcast; answers are added to ``path``."""
    context = asked.sparkSession.sparkContext
    queries = asked.toArrow()
    held = [context.broadcast(queries)]
    try:
        lists = rows.mapInArrow(_phase_one(held[0], k, ROWS_PER_BLOCK), "place bigint, score double")
        reached = _first(lists, k, F.desc("score")).filter(F.col("rank") == k).select("place", "score").toArrow()
        cutoffs = np.full(queries.num_rows, -np.inf)
        cutoffs[reached["place"].to_numpy()] = reached["score"].to_numpy()
        held.append(context.broadcast(cutoffs))
        found = rows.mapInArrow(_phases_two_three(*held, k, ROWS_PER_BLOCK), "place bigint, query_id bigint, vec_id bigint, score bigint")
        ranked = _first(found, k, F.desc("score"), F.col("vec_id"))
        ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").write.mode("append").parquet(path)
    finally:
        for broadcast in held:
            broadcast.destroy()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best rows of ``vectors`` but its own.

    Components become floor(256 x), scores are their integer inner products, ties go to
    the smaller id. Phase one gathers from the rows of every task, for each part of the
    components, the k best local scores; the k-th best of what these rows come to is a
    cutoff that no better answer is below. Phase two takes it back to the rows: a sum
    that reaches it has a part of at least an equal share of it, so only entries with
    such a part are collected, and phase three adds up all their parts. Every task hands
    on at most k rows a query, which loses nothing.

    Queries go to the rows in broadcasts of bounded bytes, one after the other: neither
    the driver nor a task holds more of them, and no row is copied for them.

    Rows without id, vector or with a null or non-finite component take no part; equal
    rows count once; of one id with several vectors each is a row (and a query) of its
    own; shorter vectors end in zeros; scores beyond a long are cut off there. Other
    columns are ignored whatever their names, and an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kept = new_path(spark, "stage")
    clean(vectors, id_col, vector).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(kept)
    rows = spark.read.schema("id bigint, v array<double>").parquet(kept).coalesce(max(TASKS, 2 * spark.sparkContext.defaultParallelism))
    asked = staged(clean(queries, id_col, vector))
    held = F.coalesce(F.sum(8 * (F.size("v").cast("long") + 4 * PARTS * k)), F.lit(0))
    count, held = asked.agg(F.count("*"), held).first()
    blocks = max(1, -(-count // QUERIES_PER_BLOCK), -(-held // QUERY_BYTES))
    path = new_path(spark, "stage")
    for n in range(blocks):
        _answers(asked.filter(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)) == n), rows, k, path)
    return spark.read.schema("query_id bigint, rank int, vec_id bigint, score bigint").parquet(path)
