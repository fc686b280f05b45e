"""Token counts with a shortcut: words proven to be one token are looked up, only the rest is merged."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import lean, slices

# Pre-tokens beside the proven ones that a task remembers before it starts anew.
CACHE = 150_000
SHORT = 48
# Capitals of Unicode 16 and their small letters, for a Python that does not know them yet.
NEWER = {0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
ASCII_ONLY = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable Latin, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in out]
    return [out[b] if b in out else chr(0x100 + hidden.index(b)) for b in range(256)]


class WordVocabulary:
    """A vocabulary of words with ends, its merges, its special strings and the proven words."""

    def __init__(self, settings: dict):
        model = settings["model"]
        norms = [n["type"] for n in (settings["normalizer"] or {}).get("normalizers", ())]
        split, level = ((settings["pre_tokenizer"] or {}).get("pretokenizers") or [{"type": None}] * 2)[:2]
        expected = (
            norms == ["NFC", "Replace", "Lowercase"] and split["type"] == "Split" and split["invert"] and split["behavior"] == "Removed"
            and level["type"] == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"]
            and model["type"] == "BPE" and model["end_of_word_suffix"] and not model.get("ignore_merges") and not model.get("byte_fallback")
        )
        if not expected:
            raise ValueError("a vocabulary of another kind: NFC, white space, lower case, split, bytes and merges with word ends are built")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.pattern = split["pattern"]["Regex"]
        self.specials = [t["content"] for t in settings["added_tokens"]]
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.last = [vocab[s + end] for s in symbols]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.proven = self._prove(vocab, end, {s: b for b, s in enumerate(symbols)})

    def _prove(self, vocab: dict[str, int], end: str, byte_of: dict[str, int]) -> frozenset[str]:
        """The words of the vocabulary that the merges do put together again to the one token."""
        out = set()
        for token in vocab:
            if token.endswith(end) and len(token) > len(end) and all(c in byte_of for c in token[: -len(end)]):
                data = bytes(byte_of[c] for c in token[: -len(end)])
                try:
                    word = data.decode()
                except UnicodeDecodeError:
                    continue  # no text has it as a word
                if self.count(data) == 1:
                    out.add(word)
        return frozenset(out)

    def count(self, data: bytes) -> int:
        """Tokens of one pre-token after all merges, the lowest rank first, leftmost among equals."""
        if not data:
            return 0
        ids = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        return self._few(ids) if len(ids) <= SHORT else self._many(ids)

    def _few(self, ids: list[int]) -> int:
        pairs = self.pairs
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                found = pairs.get(ids[i] << 32 | ids[i + 1])
                if found is not None and (best is None or found < best):
                    best, at = found, i
            if best is None:
                break
            ids[at : at + 2] = [best[1]]
        return len(ids)

    def _many(self, ids: list[int]) -> int:
        """:meth:`_few` by a heap of pairs over linked places, for words of any length."""
        pairs, n = self.pairs, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            if 0 <= i and after[i] < n:
                a, b = ids[i], ids[after[i]]
                found = pairs.get(a << 32 | b)
                if found is not None:
                    heapq.heappush(heap, (found[0], i, a, b))

        for i in range(n - 1):
            offer(i)
        left = n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = pairs[a << 32 | b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            left -= 1
            offer(i)
            offer(before[i])
        return left


@lru_cache(maxsize=4)
def read_vocabulary(path: str) -> WordVocabulary:
    """A vocabulary file, read and proven on the driver; its size bounds what is broadcast."""
    with open(path, encoding="utf-8") as f:
        return WordVocabulary(json.load(f))


class _Known(dict):
    """Pre-token → tokens; those not proven are merged when first met."""

    def __init__(self, vocabulary: WordVocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.update(dict.fromkeys(self.vocabulary.proven, 1))

    def __missing__(self, word: str) -> int:
        self[word] = n = self.vocabulary.count(word.encode("utf-8", "surrogatepass"))
        return n


class Counter:
    """Counts the tokens of texts."""

    def __init__(self, vocabulary: WordVocabulary):
        self.find = regex.compile(vocabulary.pattern, regex.VERSION0).findall
        self.find_ascii = re.compile(ASCII_ONLY, re.ASCII).findall if vocabulary.pattern == ASCII_OF else self.find
        self.special = re.compile("|".join(map(re.escape, sorted(vocabulary.specials, key=len, reverse=True)))) if vocabulary.specials else None
        self.known = _Known(vocabulary)
        self.most = len(vocabulary.proven) + CACHE

    def _plain(self, text: str) -> int:
        of = self.known.__getitem__
        if text.isascii():
            return sum(map(of, self.find_ascii(text.lower())))
        # Letter by letter: a sigma at a word's end is lower-cased like any other.
        low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().translate(NEWER)
        return sum(map(of, self.find(low)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.known) > self.most:
            self.known.forget()
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))


# The pattern whose ASCII form is ASCII_ONLY; any other is used as it is.
ASCII_OF = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _counted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            sizes = [len(t) if t else 0 for t in texts.to_pylist()]
            counts = [counter.count(t) for i, j in slices(sizes) for t in texts.slice(i, j - i).to_pylist()]
            kept = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(np.array(counts, dtype=np.int64))], [*batch.schema.names[:-1], "n_tokens"])

    return lean(run)


def count_tokens(df: DataFrame, vocabulary: WordVocabulary, text: str = "text") -> DataFrame:
    """``df`` and ``n_tokens``, the tokens of the whole text without begin, end or padding.

    Special strings inside a text are one token each; null and empty texts have none. Code
    points to which Python, ``regex`` and the vocabulary's library do not give the same class
    (those that Unicode assigned lately) may count otherwise than in the library. A column called n_tokens is replaced; all others are kept whatever their names.
    """
    at = df.columns.index(text)
    kept = [i for i, c in enumerate(df.columns) if c.lower() != "n_tokens"]
    names = [df.columns[i] for i in kept]
    flat = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    flat = flat.select(*[f"_c{i}" for i in kept], F.col(f"_c{at}").alias("_text"))
    schema = ", ".join([f"{n} {t}" for n, t in flat.dtypes[:-1]] + ["n_tokens bigint"])
    done = flat.mapInArrow(_counted(df.sparkSession.sparkContext.broadcast(vocabulary)), schema)
    return done.select(*[F.col(f"_c{i}").alias(n) for i, n in zip(kept, names)], "n_tokens")
