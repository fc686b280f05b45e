"""SimHash near-duplicates by deletion-variant signatures of few segments."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import lean, pick, quoted, slices, staged, without
from plumbline.llm.components import connected_components

# A group of equal keys beyond this size is not compared pair by pair but dealt out again.
PAIR_LIMIT = 4096
# Links that a task holds before it reduces them to stars.
LINKS_HELD = 500_000
# Up to so many ways to mask the bits that may differ, all of them are signatures.
MASK_LIMIT = 600


def fingerprint(text: str | None, width: int, seed: int = 42) -> list[int]:
    """Hashes of the ``width``-word shingles of one text (see :func:`fingerprints`)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if len(words) <= width:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(width)]))
    return [xxhash.xxh64_intdigest(s, seed) for s in shingles]


def _majority(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint per run of hashes: a bit is 1 if set in over half of them."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for bit in range(64):
        ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), starts)
        out |= (2 * ones > counts).astype(np.uint64) << np.uint64(bit)
    return out


def _fingerprint_batches(width: int, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            sizes = [len(t) if t is not None else 0 for t in texts.to_pylist()] if len(texts) else []
            parts = []
            for i, j in slices(sizes):
                runs = [fingerprint(t, width) for t in texts.slice(i, j - i).to_pylist()]
                counts = np.array([len(r) for r in runs], dtype=np.uint64)
                out = np.zeros(j - i, dtype=np.uint64)
                filled = counts > 0
                if filled.any():
                    flat = np.array([h for r in runs for h in r], dtype=np.uint64)
                    ends = np.cumsum(counts[filled])
                    starts = (ends - counts[filled]).astype(np.int64)
                    out[filled] = _majority(flat, starts, counts[filled])
                parts.append(out.view(np.int64))
            prints = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
            kept = [c for k, c in enumerate(batch.columns) if k != at]
            names = [n for k, n in enumerate(batch.schema.names) if k != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(prints)], [*names, "fp"])

    return lean(run)


def fingerprints(df: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """The other columns of ``df`` and ``fp``, the 64-bit fingerprint of the whole text.

    A-Z are lower-cased, words are runs of characters other than ASCII white space, and
    shingles are ``width`` words joined by one space, repeats included; a shorter text is
    one shingle. Each is hashed by XXH64 with seed 42. Null, empty and white texts have
    the fingerprint 0. ``fp`` replaces a column of that name.
    """
    df = without(df, "fp")
    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema if f.name != text] + ["fp bigint"])
    return df.mapInArrow(_fingerprint_batches(width, df.columns.index(text)), schema)


def _segments(bits: int) -> list[tuple[int, int]]:
    """(offset, width) of the fewest segments (two at least) of which one differs by at most one bit."""
    count = max(2, bits // 2 + 1)
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _signatures(bits: int) -> Column:
    """Keys of one fingerprint: every segment as it is, and with each single bit masked.

    Key layout: segment value from bit 0, variant (0 whole, j + 1 for bit j) from bit 40,
    segment number from bit 48.
    """
    keys = []
    for number, (offset, width) in enumerate(_segments(bits)):
        value = F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit((1 << width) - 1))
        for variant in range(width + 1):
            masked = value if variant == 0 else value.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << (variant - 1))))
            keys.append(masked + F.lit((number << 48) | (variant << 40)))
    return F.array(*keys)


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components by one link per node, to the smallest of its component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _pairs(keys: np.ndarray, prints: np.ndarray, bits: int, offsets: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Verified links inside runs of equal keys.

    With the segments' ``offsets`` (keys of the first level), whole-segment groups compare
    all members and masked groups only those that do differ in the masked bit, since the
    others meet in the whole-segment group.
    """
    if offsets is not None:
        variant = (keys >> 40) & 0xFF
        shift = (offsets[keys >> 48] + np.maximum(variant - 1, 0)).astype(np.uint64)
        side = (prints.view(np.uint64) >> shift) & np.uint64(1)
    left, right, held = [], [], 0
    active = np.arange(len(keys))
    step = 1
    while True:
        active = active[active + step < len(keys)]
        active = active[keys[active] == keys[active + step]]
        if not len(active):
            break
        i, j = active, active + step
        if offsets is not None:
            near = (variant[i] == 0) | (side[i] != side[j])
            i, j = i[near], j[near]
        near = np.bitwise_count((prints[i] ^ prints[j]).view(np.uint64)) <= bits
        left.append(prints[i[near]])
        right.append(prints[j[near]])
        held += len(left[-1])
        if held > LINKS_HELD:
            a, b = _stars(np.concatenate(left), np.concatenate(right))
            left, right, held = [a], [b], 0
        step += 1
    if not left:
        return prints[:0], prints[:0]
    return _stars(np.concatenate(left), np.concatenate(right))


def _context(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For keys of :func:`_signatures`: the bits they cover, and how many others may differ."""
    covers = np.array([((1 << w) - 1) << o for o, w in _segments(bits)], dtype=np.uint64)
    return covers[keys >> 48].view(np.int64), bits - (((keys >> 40) & 0xFF) > 0)


def _link_groups(bits: int, limit: int):
    """Links inside the sorted runs of equal keys; rows of runs over ``limit`` pass on.

    Input: key, fp and, from the second level on, used and left as in :func:`_deal_again`.
    Output: links (a, b), or rows to deal again (b null).
    """
    offsets = np.array([o for o, _ in _segments(bits)], dtype=np.int64)
    names = ["key", "used", "left", "a", "b"]

    def linked(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.nulls(len(a), pa.int64())] * 3, pa.array(a), pa.array(b)], names)

    def passed(k, used, left, p, first) -> Iterator[pa.RecordBatch]:
        full = used == -1  # no bit is left to look at: the first member links them all
        if full.any():
            near = full & (np.bitwise_count((p ^ first).view(np.uint64)) <= bits)
            yield linked(p[near], first[near])
        arrays = [pa.array(x[~full], pa.int64()) for x in (k, used, left, p)]
        yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(int((~full).sum()), pa.int64())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        passing: tuple[int, int] | None = None  # key and first member of a run that passes on row by row

        def work(k, p, used, left) -> Iterator[pa.RecordBatch]:
            if not len(k):
                return
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            sizes = np.diff(np.r_[starts, len(k)])
            size, first = np.repeat(sizes, sizes), np.repeat(p[starts], sizes)
            large = size > limit
            if large.any():
                yield from passed(k[large], used[large], left[large], p[large], first[large])
            small = (size > 1) & ~large
            yield linked(*_pairs(k[small], p[small], bits, offsets if level == 1 else None))

        level = 1
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            if len(columns) == 2:
                columns += [np.asarray(x, dtype=np.int64) for x in _context(columns[0], bits)]
            else:
                level = 2
            if passing is not None:
                same = columns[0] == passing[0]
                if same.any():
                    k, p, used, left = (c[same] for c in columns)
                    yield from passed(k, used, left, p, np.full(len(p), passing[1]))
                    columns = [c[~same] for c in columns]
                if len(columns[0]):
                    passing = None
            if not len(columns[0]):
                continue
            columns = [np.concatenate(pair) for pair in zip(held, columns)]
            cut = int(np.searchsorted(columns[0], columns[0][-1], side="left"))  # the last run may go on
            yield from work(*[c[:cut] for c in columns])
            held = [c[cut:] for c in columns]
            if len(held[0]) > limit:
                k, p, used, left = held
                passing = (k[0], p[0])
                yield from passed(k, used, left, p, np.full(len(p), p[0]))
                held = [c[:0] for c in held]
        yield from work(*held)

    return lean(run)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _variants(free: list[int], budget: int) -> Iterator[tuple[int, int, int]]:
    """(bits covered, bits compared, bits that may still differ outside) of each further signature.

    Few enough ways to mask ``budget`` of the free bits are all taken, which leaves no bit
    to look at; otherwise the free bits are cut into segments once more.
    """
    every = sum(1 << i for i in free)
    if comb(len(free), budget) <= MASK_LIMIT:
        for masked in combinations(free, budget):
            yield every, every ^ sum(1 << i for i in masked), 0
        return
    count = budget // 2 + 1
    edges = [len(free) * i // count for i in range(count + 1)]
    for x, y in zip(edges, edges[1:]):
        cover = sum(1 << i for i in free[x:y])
        yield cover, cover, budget
        for i in free[x:y]:
            yield cover, cover ^ (1 << i), budget - 1


def _deal_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same signatures once more, over the bits that an over-large group has not used.

    ``used`` marks the bits that members share but for masked ones, ``left`` is how many
    of the others may differ between two members worth linking.
    """
    for batch in batches:
        key, used, left, prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        for u, budget in set(zip(used.tolist(), left.tolist())):
            mine = (used == u) & (left == budget)
            k, p = key[mine].view(np.uint64), prints[mine]
            free = [i for i in range(64) if not (u >> i) & 1]
            for tag, (cover, compared, rest) in enumerate(_variants(free, budget)):
                fresh = _mix(_mix(k + np.uint64(tag)) ^ (p.view(np.uint64) & np.uint64(compared)))
                now = np.full(len(p), (u & 0xFFFFFFFFFFFFFFFF) | cover, dtype=np.uint64)
                arrays = [fresh.view(np.int64), p, now.view(np.int64), np.full(len(p), rest, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["key", "fp", "used", "left"])


def links(prints: DataFrame, bits: int = 2, limit: int = PAIR_LIMIT) -> DataFrame:
    """Links (a, b) that connect what ``bits`` or fewer differing bits connect.

    ``prints`` holds distinct fingerprints ``fp``. Segments are chosen so few that one of
    them differs by at most one bit; equal keys (a segment, or a segment with one bit
    masked) meet in one sorted run and are verified on all 64 bits. Inside a task a
    component is reduced to a star. Runs over ``limit`` are never held or paired: their
    rows get the same signatures over the bits not used yet, until runs are small or no
    bit is left, which is exact as well.
    """
    rows = prints.select(F.explode(_signatures(bits)).alias("key"), "fp")
    near = None
    while True:
        runs = rows.repartition("key").sortWithinPartitions("key", "fp")
        found = staged(runs.mapInArrow(_link_groups(bits, limit), "key bigint, used bigint, left bigint, a bigint, b bigint"))
        linked = found.filter("b is not null").select("a", "b")
        near = linked if near is None else near.union(linked)
        large = found.filter("b is null").select("key", "used", "left", F.col("a").alias("fp"))
        if large.isEmpty():
            return near
        rows = large.mapInArrow(_deal_again, "key bigint, fp bigint, used bigint, left bigint")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, bits: int = 2, limit: int = PAIR_LIMIT
) -> DataFrame:
    """One row per row of ``df``: its id, ``fp`` and ``component_id``.

    Texts are linked when their fingerprints differ in at most ``bits`` bits;
    ``component_id`` is the smallest id in reach (nulls do not count; null only if no
    member has an id). Null, empty and white texts share fingerprint 0 and are linked like
    any others; repeated rows are repeated in the result; an empty table gives an empty
    one; other columns are ignored whatever their names.
    """
    prints = staged(fingerprints(pick(df, id_col, text), text, width))
    return components_of(prints, id_col, bits, limit)


def components_of(prints: DataFrame, id_col: str, bits: int = 2, limit: int = PAIR_LIMIT) -> DataFrame:
    """``prints`` (with ``fp``, staged) and ``root``'s smallest id as ``component_id``."""
    by_print = staged(prints.groupBy("fp").agg(F.min(quoted(id_col)).alias("least")))
    roots = connected_components(links(by_print.select("fp"), bits, limit))
    rooted = by_print.join(roots, by_print.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    rooted = staged(rooted)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    final = staged(rooted.join(named, "root").select(F.col("fp").alias("__fp"), F.col("root").alias("__root"), "component_id"))
    return without(prints, "component_id", "root").join(final, F.col("fp") == F.col("__fp")).drop("__fp").withColumnRenamed("__root", "root")


def keep_first(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 3, bits: int = 2) -> DataFrame:
    """``df`` with one row of each component of near-duplicates, all columns unchanged.

    The row with the smallest id stays (null ids last; among equal ids the one with the
    smallest row hash; of fully equal rows exactly one).
    """
    columns = df.columns
    flat = df.toDF(*[f"_k{i}" for i in range(len(columns))])
    names = flat.columns
    key, body = f"_k{columns.index(id_col)}", f"_k{columns.index(text)}"
    row = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.xxhash64(*names).alias("h1"), F.xxhash64(F.lit(7), *names).alias("h2"))
    digests = staged(fingerprints(flat.select(row.alias("row"), body), body, width))
    by_print = digests.groupBy("fp").agg(F.min("row").alias("first"))
    by_print = staged(by_print)
    roots = connected_components(links(by_print.select("fp"), bits))
    rooted = by_print.join(roots, by_print.fp == roots.node, "left").select("first", F.coalesce("root", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first").alias("first"))
    copies = digests.groupBy("row").agg(F.count("*").alias("copies"))
    stays = staged(first.join(copies, F.col("first") == F.col("row")).select("first", "copies"))
    chosen = flat.join(stays, row == F.col("first"))
    single = chosen.filter("copies = 1").select(*names)
    if not stays.filter("copies > 1").isEmpty():
        single = single.union(chosen.filter("copies > 1").select(*names).dropDuplicates())
    return single.toDF(*columns)
