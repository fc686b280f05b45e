"""Licence scans by a generalised suffix automaton over the words of licence texts."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, without
from plumbline.llm.license_texts import PHRASES, TEMPLATES

LEAST_MATCH = 4  # words of a match that may join a chain
GAP = 12  # words of the file or the template that a chain may leave out at once
COVERAGE = 0.7  # share of a template that makes its label
CHUNK = 1 << 22

# A-Z lower-cased, a-z, digits and all beyond ASCII kept, the rest made spaces.
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in chunks of about four megabytes."""
    data, start = data.translate(_WORD_BYTES), 0
    while start < len(data):
        stop = min(len(data), start + CHUNK)
        if stop < len(data):
            cut = data.rfind(b" ", start, stop)
            if cut <= start:
                cut = data.find(b" ", stop)
            stop = cut if cut > 0 else len(data)
        yield data[start:stop].split()
        start = stop


class Automaton:
    """Suffix automaton of several word sequences, with where each state's words end."""

    def __init__(self, templates: Mapping[str, str], phrases: Mapping[str, str]):
        self.names = list(templates)
        split = lambda text: [w for part in words(text.encode()) for w in part]
        sequences = [split(t) for t in templates.values()]
        self.ids: dict[bytes, int] = {}
        for w in [w for s in sequences for w in s] + [w for p in phrases for w in split(p)]:
            self.ids.setdefault(w, len(self.ids))
        self.phrases = [([self.ids[w] for w in split(p)], label) for p, label in phrases.items()]
        self.sizes = [len(s) for s in sequences]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, self.ids[word])
                self.ends[last].add((number, place))
        for state in sorted(range(1, len(self.length)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state for the words of q that p's words and ``word`` make."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word, self.next[p][word])
        return new

    def statistics(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """Per word: the state and the length of the longest match that ends there."""
        state, length = 0, 0
        for word in ids:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                length += 1
            yield state, length

    def matches(self, ids: np.ndarray, least: int = LEAST_MATCH) -> Iterator[tuple[int, int, int, int]]:
        """(template, first word, place in the template, words) of matches no longer to the right."""
        known = np.flatnonzero(np.diff(np.r_[0, (ids >= 0).astype(np.int8), 0]))
        for start, stop in zip(known[::2].tolist(), known[1::2].tolist()):
            if stop - start < least:
                continue
            before = (0, 0)
            for at, now in enumerate([*self.statistics(ids[start:stop].tolist()), (0, 0)], start):
                if before[1] >= least and now[1] <= before[1]:
                    for template, end in self.ends[before[0]]:
                        yield template, at - before[1], end - before[1] + 1, before[1]
                before = now

    def spans(self, ids: np.ndarray, gap: int = GAP) -> list[tuple[str, int, int, int, float]]:
        """(template, first word, last word, words covered, share) of the best chain of each stretch.

        A chain goes forward in file and template, leaving out at most ``gap`` words of
        either at once; chains that touch in the file are one stretch.
        """
        by = defaultdict(list)
        for template, first, place, size in self.matches(ids):
            by[template].append((first, place, size))
        out = []
        for template, own in by.items():
            own.sort()
            best: list[tuple[int, int]] = []  # words covered, first word of the chain
            floor = 0
            for k, (first, place, size) in enumerate(own):
                while own[floor][0] + self.sizes[template] + gap < first:
                    floor += 1
                covered, begun = size, first
                for h in range(floor, k):
                    f, p, s = own[h]
                    over = max(0, f + s - first, p + s - place)
                    if f < first and p < place and over < size and first - f - s <= gap and place - p - s <= gap:
                        if best[h][0] + size - over > covered:
                            covered, begun = best[h][0] + size - over, best[h][1]
                best.append((covered, begun))
            stretch: tuple | None = None
            for (first, _, size), (covered, begun) in zip(own, best):
                now = (covered, begun, first + size - 1)
                if stretch and begun <= stretch[2]:
                    stretch = max(stretch, now)
                else:
                    if stretch:
                        out.append((template, *stretch))
                    stretch = now
            out.append((template, *stretch))
        spans = [(self.names[t], b, e, c, min(1.0, c / self.sizes[t])) for t, c, b, e in out]
        return sorted(spans, key=lambda s: (s[1], s[0]))


SPAN = "array<struct<template: string, first: bigint, last: bigint, covered: bigint, share: double>>"
OUT = {
    "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint",
    "base_labels": "string", "labels": "string", "score": "double", "spans": SPAN,
}
_ARROW_SPAN = pa.list_(pa.struct([("template", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.int64()), ("share", pa.float64())]))


def scan_text(automaton: Automaton, text: str | None, coverage: float = COVERAGE) -> tuple:
    get = automaton.ids.get
    data = text.encode("utf-8", "surrogatepass") if text else b""
    parts = [np.fromiter(map(get, chunk, repeat(-1)), dtype=np.int32, count=len(chunk)) for chunk in words(data)]
    ids = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
    starts, base = [], set()
    for phrase, label in automaton.phrases:
        n = len(ids) - len(phrase) + 1
        if n > 0:
            at = np.ones(n, dtype=bool)
            for k, word in enumerate(phrase):
                at &= ids[k : k + n] == word
            places = np.flatnonzero(at)
            if len(places):
                starts.append(places)
                base.add(label)
    places = np.concatenate(starts) if starts else ids[:0]
    spans = automaton.spans(ids)
    labels = base | {s[0] for s in spans if s[4] >= coverage}
    ends = (int(places.min()), int(places.max())) if len(places) else (None, None)
    joined = [",".join(sorted(x)) for x in (base, labels)]
    return len(ids), len(places), *ends, *joined, max((s[4] for s in spans), default=0.0), spans


def _scan_batches(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices([len(t) if t else 0 for t in batch.column(at).to_pylist()]):
                part = batch.slice(i, j - i)
                rows = [scan_text(shared.value, t) for t in part.column(at).to_pylist()]
                types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), _ARROW_SPAN]
                columns = [list(c) for c in zip(*rows)]
                columns[7] = [[dict(zip(("template", "first", "last", "covered", "share"), s)) for s in x] for x in columns[7]]
                arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, *OUT])

    return run


def scan(df: DataFrame, text: str = "text", templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES) -> DataFrame:
    """``df`` with n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    Every word of the whole text is run through the automaton, which gives the longest
    template passage that ends there; matches of several words are chained into spans,
    and a template of which a span covers enough gives its name as a label. Labels of
    phrases are always kept. ``score`` is the largest share of a template covered. Null
    and empty texts have no words, empty labels and score 0; equal texts get equal
    answers. Input columns called like the new ones are replaced, others kept whatever
    their names. The automaton is bounded by the templates and broadcast.
    """
    df = without(df, *OUT)
    names = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    shared = df.sparkSession.sparkContext.broadcast(Automaton(templates, phrases))
    schema = ", ".join(f"{n} {t}" for n, t in [*flat.dtypes, *OUT.items()])
    done = flat.mapInArrow(_scan_batches(shared, names.index(text)), schema)
    return done.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)], *OUT)
