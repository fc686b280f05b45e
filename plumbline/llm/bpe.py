"""Byte-level BPE: merges by a segment tree of pair ranks over byte positions."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import lean, slices, without

NONE = np.int32(2**31 - 1)  # rank of a pair that does not merge
SHORT = 64  # pieces up to this many bytes are merged many at a time
CACHE = 100_000  # pieces a task remembers before it starts anew
# The pattern in ASCII alone, for texts without other characters.
ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"


class Vocabulary:
    """Ranks as arrays: tokens' bytes, and every pair of tokens that makes a third."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.pattern = pattern
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        pairs = {}
        for token, i in self.rank.items():
            for cut in range(1, len(token)):
                a, b = self.rank.get(token[:cut]), self.rank.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int32)
        self.single = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int32)
        lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.length, self.start = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.values[at], NONE)


def read_vocabulary(path: str, pattern: str) -> Vocabulary:
    """A rank file of lines "base64 token, rank"; read on the driver and broadcast."""
    with open(path, "rb") as lines:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    return Vocabulary([ranks.get(i, b"") for i in range(max(ranks) + 1)], pattern)


def merge_one(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """Tokens of one piece: log-many steps a merge, whatever its length.

    Leaf i of the tree holds the rank of the pair that starts at byte i, each inner node
    the least of its two children. The leftmost least leaf is merged; its own leaf, its
    left neighbour's and that of the byte it swallows change.
    """
    n = len(piece)
    ids = vocabulary.single[np.frombuffer(piece, dtype=np.uint8)]
    width = 1 << max(1, (n - 1).bit_length())
    none = int(NONE)
    level = np.full(width, NONE, dtype=np.int32)
    level[: n - 1] = vocabulary.pair_ranks(ids[:-1], ids[1:])
    levels = [level]
    while len(level) > 1:
        level = level.reshape(-1, 2).min(axis=1)
        levels.append(level)
    tree = [none] + np.concatenate(levels[::-1]).tolist()
    ids = ids.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs = _pair_dict(vocabulary)

    def put(place: int, rank: int) -> None:
        node = width + place
        tree[node] = rank
        while node > 1:
            node >>= 1
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                return
            tree[node] = least

    while tree[1] != none:
        best, node = tree[1], 1
        while node < width:
            node *= 2
            if tree[node] != best:
                node += 1
        i = node - width
        j = after[i]
        k, h = after[j], before[i]
        ids[i], after[i] = best, k
        put(j, none)
        if k < n:
            before[k] = i
        put(i, pairs.get(best << 32 | ids[k], none) if k < n else none)
        if h >= 0:
            put(h, pairs.get(ids[h] << 32 | best, none))
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


@lru_cache(maxsize=2)
def _pair_dict(vocabulary: Vocabulary) -> dict[int, int]:
    return dict(zip(vocabulary.keys.tolist(), vocabulary.values.tolist()))


def merge_many(vocabulary: Vocabulary, pieces: list[bytes]) -> list[np.ndarray]:
    """:func:`merge_one` for many short pieces at once, each merging once a step."""
    lengths = np.array([len(p) for p in pieces])
    n, widest = len(pieces), int(lengths.max())
    width = 1 << max(1, (widest - 1).bit_length())
    place = np.arange(width)
    flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
    ids = vocabulary.single[flat]
    tree = np.full((n, 2 * width), NONE, dtype=np.int32)
    ranks = vocabulary.pair_ranks(ids[:, :-1], ids[:, 1:])
    tree[:, width : 2 * width - 1] = np.where(place[1:] < lengths[:, None], ranks, NONE)
    for node in range(width - 1, 0, -1):
        tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
    after = np.tile(np.arange(1, width + 2), (n, 1))[:, :width]
    before = np.tile(np.arange(-1, width - 1), (n, 1))
    alive = place < lengths[:, None]

    def put(rows: np.ndarray, at: np.ndarray, rank) -> None:
        node = width + at
        tree[rows, node] = rank
        while node[0] > 1:  # all leaves have the same depth
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    rows = np.flatnonzero(tree[:, 1] != NONE)
    while len(rows):
        best = tree[rows, 1]
        node = np.ones(len(rows), dtype=np.int64)
        while node[0] < width:
            node = 2 * node
            node += tree[rows, node] != best
        i = node - width
        j = after[rows, i]
        k, h = after[rows, j], before[rows, i]
        ids[rows, i], after[rows, i], alive[rows, j] = best, k, False
        put(rows, j, NONE)
        right = k < lengths[rows]
        r, a, b = rows[right], i[right], k[right]
        before[r, b] = a
        rank = np.full(len(rows), NONE, dtype=np.int32)
        rank[right] = vocabulary.pair_ranks(ids[r, a], ids[r, b])
        put(rows, i, rank)
        left = h >= 0
        r, a, b = rows[left], h[left], i[left]
        if len(r):
            put(r, a, vocabulary.pair_ranks(ids[r, a], ids[r, b]))
        rows = rows[tree[rows, 1] != NONE]
    counts = alive.sum(axis=1)
    return np.split(ids[alive], np.cumsum(counts)[:-1])


class _Pieces(dict):
    """Piece → number; new ones are noted for merging."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class Encoder:
    """Encodes lists of texts; equal pieces are merged once, as long as they are remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        self.find_ascii = re.compile(ASCII_PATTERN, re.ASCII).findall
        self.forget()

    def forget(self) -> None:
        self.pieces = _Pieces()
        self.length = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.int32)

    def _learn(self) -> None:
        new = [p.encode("utf-8", "surrogatepass") for p in self.pieces.new]
        self.pieces.new = []
        out: list = [None] * len(new)
        by_width: dict[int, list[int]] = {}
        for at, piece in enumerate(new):
            rank = self.vocabulary.rank.get(piece)
            if rank is not None:
                out[at] = [rank]
            elif len(piece) > SHORT:
                out[at] = merge_one(self.vocabulary, piece)
            else:
                by_width.setdefault((len(piece) - 1).bit_length(), []).append(at)
        for places in by_width.values():
            for start in range(0, len(places), 20_000):
                part = places[start : start + 20_000]
                for at, ids in zip(part, merge_many(self.vocabulary, [new[k] for k in part])):
                    out[at] = ids
        self.length = np.concatenate([self.length, np.array([len(x) for x in out], dtype=np.int64)])
        self.pool = np.concatenate([self.pool, *[np.asarray(x, dtype=np.int32) for x in out]])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, and how many each text has."""
        if len(self.pieces) > CACHE:
            self.forget()
        found = [(self.find_ascii(t) if t.isascii() else self.find(t)) if t else [] for t in texts]
        of = self.pieces.__getitem__
        numbers = np.array([of(p) for pieces in found for p in pieces], dtype=np.int64)
        if self.pieces.new:
            self._learn()
        lengths = self.length[numbers]
        ends = np.cumsum(lengths)
        start = np.cumsum(self.length) - self.length
        at = np.repeat(start[numbers] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))
        edges = np.cumsum([0, *[len(p) for p in found]])
        upto = np.r_[0, ends]
        return self.pool[at], np.diff(upto[edges])


def decode_ids(vocabulary: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and how many each text has."""
    lengths = vocabulary.length[ids]
    ends = np.cumsum(lengths)
    at = np.repeat(vocabulary.start[ids] - (ends - lengths), lengths) + np.arange(int(lengths.sum()))
    return vocabulary.bytes[at], np.diff(np.r_[0, ends][np.r_[0, np.cumsum(counts)]])


def _offsets(counts: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.r_[0, np.cumsum(counts)].astype(np.int32))


def _binary(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, _offsets(counts), pa.py_buffer(data)])


def _encode_batches(shared, at: int, both: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            for i, j in slices([len(t) if t else 0 for t in batch.column(at).to_pylist()]):
                part = batch.slice(i, j - i)
                ids, counts = encoder.encode(part.column(at).to_pylist())
                arrays = [pa.ListArray.from_arrays(np.r_[0, np.cumsum(counts)].astype(np.int32), pa.array(ids))]
                if both:
                    arrays.append(_binary(*decode_ids(encoder.vocabulary, ids, counts)))
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, "ids", "decoded"][: part.num_columns + len(arrays)])

    return lean(run)


def _decode_batches(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(at).to_pylist()
            for i, j in slices([8 * len(r) if r else 0 for r in rows]):
                counts = np.array([len(r) if r else 0 for r in rows[i:j]], dtype=np.int64)
                ids = np.array([x for r in rows[i:j] if r for x in r], dtype=np.int64)
                done = _binary(*decode_ids(shared.value, ids, counts))
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, done], [*batch.schema.names, "decoded"])

    return run


def _add(df: DataFrame, column: str, run, vocabulary: Vocabulary, new: dict[str, str], *more) -> DataFrame:
    df = without(df, *[n for n in new if n != column])
    names = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    schema = ", ".join(f"{n} {t}" for n, t in [*flat.dtypes, *new.items()])
    done = flat.mapInArrow(run(shared, names.index(column), *more), schema)
    return done.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)], *new)


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``df`` and ``ids``, the tokens of the whole text; null and empty texts have none.

    Each match of the vocabulary's pattern is merged on its own, without special tokens.
    A column called ids is replaced; all others are kept whatever their names.
    """
    return _add(df, text, _encode_batches, vocabulary, {"ids": "array<int>"}, False)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """``df`` and ``decoded``, the bytes of the tokens in ``ids``; null ids give no bytes."""
    return _add(df, ids, _decode_batches, vocabulary, {"decoded": "binary"})


def encode_decode(df: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass: ``df``, ``ids`` and ``decoded``."""
    return _add(df, text, _encode_batches, vocabulary, {"ids": "array<int>", "decoded": "binary"}, True)
