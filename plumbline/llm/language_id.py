"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import lean, pick, quoted, slices, staged, without

ORDER = 5
BITS = 12  # of a symbol: letters below 2048 as they are, others hashed into the upper half
UNKNOWN = "und"
# Characters of labelled texts of a language, at most about, that its model is fitted on; this bounds the model.
TRAIN_CHARS = 8_000_000
# Labelled rows of a language, at most about, that fit the confidence and the limit of rejection.
CALIBRATION_ROWS = 8_000
DRAWS = 1_000_000_000_000
CHUNK = 250_000
# N-grams that a counting task holds before it passes its sums on.
GRAMS_HELD = 1_000_000
# Entropy that chance may add to a text of n letters, times the root of n: four deviations of two nats.
SPREAD = 8.0


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    """Code point → symbol: lower-cased letters, 0 for all else."""
    out = np.zeros(0x110000, dtype=np.uint16)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            p = ord(low) if len(low) == 1 else c
            out[c] = p if p < 2048 else 2048 + (p * 2654435761 >> 7) % 2048
    return out


def _symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts (words set apart by one 0), their document and place in it."""
    texts = [t or "" for t in texts]
    points = np.frombuffer("".join(t + "\0" for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    symbols = _symbol_table()[points]
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), [len(t) + 1 for t in texts])
    kept = symbols != 0
    kept[1:] |= symbols[:-1] != 0
    symbols, doc = symbols[kept].astype(np.int64), doc[kept]
    starts = np.searchsorted(doc, np.arange(len(texts)))
    return symbols, doc, np.arange(len(symbols)) - starts[doc] if len(doc) else np.zeros(0, np.int64)


def _keys(symbols: np.ndarray, place: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Packed n-grams that end at start … stop; before a text stand zeros."""
    key = symbols[start:stop].copy()
    for d in range(1, ORDER):
        lo = max(0, start - d)
        back = np.zeros(stop - start, dtype=np.int64)
        if stop - d > lo:
            back[lo + d - start :] = symbols[lo : stop - d]
        key |= np.where(place[start:stop] >= d, back, 0) << (BITS * d)
    return key


def _hash(key: np.ndarray) -> np.ndarray:
    """A bijection, so that equal hashes mean equal n-grams."""
    x = key.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Level:
    """One order: sorted hashes of n-grams and of contexts, with a row per language each."""

    grams: np.ndarray
    logs: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


@dataclass
class Model:
    languages: list[str]
    levels: list[Level]
    floor: float
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: tuple[float, float] = (0.0, 1.0)


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(table, wanted)
    at[at == len(table)] = 0
    return at, table[at] == wanted


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, inverse = np.unique(keys, return_inverse=True)
    return found, np.bincount(inverse, weights=weights, minlength=len(found))


def _one_language(keys: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Per order from 1: n-grams, discounted shares, contexts and their left-over mass."""
    orders = []
    for order in range(ORDER, 0, -1):
        n1, n2 = (counts == 1).sum(), (counts == 2).sum()
        discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.75
        contexts, totals = _sums(keys >> BITS, counts)
        _, kinds = _sums(keys >> BITS, np.minimum(counts, discount))
        share = np.maximum(counts - discount, 0) / totals[np.searchsorted(contexts, keys >> BITS)]
        orders.append((keys, share, contexts, kinds / totals))
        # The lower order counts in how many left neighbours an n-gram has been seen.
        keys, counts = _sums(keys & ((1 << (BITS * (order - 1))) - 1), np.ones(len(keys)))
    return orders[::-1]


def estimate(languages: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Interpolated Kneser-Ney models from n-gram counts of the highest order."""
    single = [_one_language(*grams[name]) for name in languages]
    vocabulary = len(np.unique(np.concatenate([s[0][0] for s in single]))) + 1
    lower, levels = None, []
    for order in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([s[order - 1][0] for s in single]))
        contexts = np.unique(np.concatenate([s[order - 1][2] for s in single]))
        probs = np.zeros((len(keys), len(languages)))
        mass = np.ones((len(contexts), len(languages)))
        for i, s in enumerate(single):
            own, share, ctx, left = s[order - 1]
            probs[np.searchsorted(keys, own), i] = share
            mass[np.searchsorted(contexts, ctx), i] = left
        of = np.searchsorted(contexts, keys >> BITS)
        if lower is None:
            probs += mass[of] / vocabulary
        else:
            suffix = np.searchsorted(lower[0], keys & ((1 << (BITS * (order - 1))) - 1))
            probs += mass[of] * lower[1][suffix]
        lower = (keys, probs)
        g, c = np.argsort(_hash(keys)), np.argsort(_hash(contexts))
        levels.append(
            Level(_hash(keys)[g], np.log(probs[g]).astype(np.float32), _hash(contexts)[c], np.log(mass[c]).astype(np.float32))
        )
    return Model(languages, levels, float(-np.log(vocabulary)))


def _log_probs(model: Model, keys: np.ndarray) -> np.ndarray:
    """Log probability of each n-gram's last symbol, a column per language."""
    out = np.zeros((len(keys), len(model.languages)), dtype=np.float32)
    todo = np.arange(len(keys))
    for order in range(ORDER, 0, -1):
        level, now = model.levels[order - 1], keys[todo] & ((1 << (BITS * order)) - 1)
        at, hit = _find(level.grams, _hash(now))
        out[todo[hit]] += level.logs[at[hit]]
        todo, now = todo[~hit], now[~hit]
        if not len(todo):
            return out
        at, hit = _find(level.contexts, _hash(now >> BITS))
        out[todo[hit]] += level.backoff[at[hit]]
    out[todo] += model.floor
    return out


def _entropies(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Nats per symbol under each language, and the number of letters, of each text."""
    symbols, doc, place = _symbols(texts)
    total = np.zeros((len(texts), len(model.languages)))
    for start in range(0, len(symbols), CHUNK):
        stop = min(len(symbols), start + CHUNK)
        logs, d = _log_probs(model, _keys(symbols, place, start, stop)), doc[start:stop]
        for i in range(total.shape[1]):
            total[:, i] -= np.bincount(d, weights=logs[:, i], minlength=len(texts))
    count = np.bincount(doc, minlength=len(texts))
    letters = np.bincount(doc[symbols != 0], minlength=len(texts))
    return total / np.maximum(count, 1)[:, None], letters


def _best_two(entropies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.arange(len(entropies))
    best = np.argmin(entropies, axis=1)
    low = entropies[rows, best]
    others = entropies.copy()
    others[rows, best] = np.inf
    second = others.min(axis=1) if entropies.shape[1] > 1 else low + 10.0
    return best, low, second - low


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(n, first)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n), summed over what the task has seen since it last passed its sums on."""
    sums: dict[str, list] = {}

    def held() -> int:
        return sum(len(k) for parts in sums.values() for k, _ in parts)

    def passed() -> Iterator[pa.RecordBatch]:
        for name, parts in sums.items():
            keys, n = _added(parts)
            for i in range(0, len(keys), 100_000):
                part = slice(i, i + 100_000)
                arrays = [pa.array([name] * len(keys[part])), pa.array(keys[part]), pa.array(n[part].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["lang", "gram", "n"])
        sums.clear()

    for batch in batches:
        names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for name in sorted(set(names)):
            own = [t for t, x in zip(texts, names) if x == name]
            for i, j in slices([len(t) if t else 0 for t in own], CHUNK):
                symbols, _, place = _symbols(own[i:j])
                for start in range(0, len(symbols), CHUNK):
                    keys = np.sort(_keys(symbols, place, start, min(len(symbols), start + CHUNK)))
                    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                    sums.setdefault(name, []).append((keys[first], np.diff(np.r_[first, len(keys)])))
                if held() > 2 * GRAMS_HELD:
                    sums = {x: [_added(parts)] for x, parts in sums.items()}
                    if held() > GRAMS_HELD:
                        yield from passed()
    yield from passed()


def _drawn(rows: DataFrame, lang: str, text: str, seed: int, rate: dict[str, float]) -> DataFrame:
    """Texts of each language drawn by a hash at the language's rate; equal texts go together."""
    cuts = [F.lit(x) for name, r in rate.items() for x in (name, int(r * DRAWS))]
    draw = F.pmod(F.xxhash64(F.lit(seed), quoted(text)), F.lit(DRAWS))
    return rows.filter(draw < F.create_map(*cuts)[quoted(lang)]) if cuts else rows


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", chars: int = TRAIN_CHARS) -> Model | None:
    """Models of the languages of ``labelled`` (rows with a null label do not count).

    A language with more than ``chars`` characters is fitted on labelled rows drawn at a
    rate that gives about so many; every n-gram of every drawn text counts, so discounts and
    continuation counts are those of the drawn texts as a whole. None without any
    labelled text.
    """
    rows = pick(labelled, lang, text).filter(quoted(lang).isNotNull() & quoted(text).isNotNull())
    there = dict(map(tuple, rows.groupBy(quoted(lang)).agg(F.sum(F.length(quoted(text)))).collect()))
    rate = {name: min(1.0, chars / n) if n else 1.0 for name, n in there.items()}
    counted = _drawn(rows, lang, text, 29, rate).mapInArrow(lean(_count_grams), "lang string, gram bigint, n bigint")
    data = staged(counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))).toArrow()
    names = data.column("lang").dictionary_encode().combine_chunks()
    listed = names.dictionary.to_pylist()
    if not listed:
        return None
    number = names.indices.to_numpy(zero_copy_only=False)
    keys, counts = data.column("gram").to_numpy(), data.column("n").to_numpy().astype(float)
    own = {}
    for i, name in enumerate(listed):
        mine = number == i
        order = np.argsort(keys[mine])
        own[name] = keys[mine][order], counts[mine][order]
    return estimate(sorted(listed), own)


def _platt(x: np.ndarray, right: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic curve of being right over the margin, with smoothed targets; rising."""
    good, bad = weight[right].sum(), weight[~right].sum()
    target = np.where(right, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 0.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = weight * (p * (1 - p) + 1e-9)
        off = weight * (target - p)
        g = np.array([off.sum(), (off * x).sum() - 1e-3 * b])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(max(b, 0.0))


def calibrate(model: Model, labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = CALIBRATION_ROWS) -> Model:
    """Fit confidence and rejection on about ``rows`` labelled rows of each language that trained no model.

    What chance adds to a short text is taken off first. A language's limit lies as far
    above its largest usual entropy (the 99.9 % point of right answers) as that is
    above the median. With under 20 right answers it lies as far above its median (the
    largest of all languages, if it has none) as the deviations of the languages with more
    say; there is no limit if no language has more.
    The confidence counts each row as often as it stands for others of its language.
    """
    known = pick(labelled, lang, text).filter(quoted(lang).isin(model.languages) & quoted(text).isNotNull())
    there = dict(map(tuple, known.groupBy(quoted(lang)).count().collect()))
    rate = {name: min(1.0, rows / n) for name, n in there.items()}
    sample = _drawn(known, lang, text, 17, rate)
    scored = _score(sample, model, text).select(quoted(lang).alias("lang"), "lang_pred", "cross_entropy", "margin", "n_letters").toPandas()
    scored = scored[scored.lang_pred != UNKNOWN]
    right = (scored.lang == scored.lang_pred).to_numpy()
    weight = 1 / np.array([rate[name] for name in scored.lang], dtype=float)
    model.weights = _platt(scored.margin.to_numpy(), right, weight) if len(scored) else (0.0, 1.0)
    usual = []
    for name in model.languages:
        own = scored[(scored.lang == name) & right]
        usual.append((own.cross_entropy - SPREAD / np.sqrt(own.n_letters)).to_numpy())
    medians = [np.median(u) for u in usual if len(u)]
    pooled = [u - np.median(u) for u in usual if len(u) >= 20]
    limits = []
    for u in usual:
        if len(u) >= 20:
            middle, high = np.quantile(u, [0.5, 0.999])
            limits.append(high + (high - middle))
        elif pooled:
            limits.append((np.median(u) if len(u) else max(medians)) + 2 * np.quantile(np.concatenate(pooled), 0.999))
        else:
            limits.append(np.inf)
    model.limits = np.array(limits)
    return model


def _predict_batches(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        limits = model.limits if len(model.limits) else np.full(len(model.languages), np.inf)
        for batch in batches:
            parts = []
            texts = batch.column(at)
            for i, j in slices([len(t) if t else 0 for t in texts.to_pylist()]):
                entropies, letters = _entropies(model, texts.slice(i, j - i).to_pylist())
                best, low, margin = _best_two(entropies)
                a, b = model.weights
                score = 1 / (1 + np.exp(-np.clip(a + b * margin, -30, 30)))
                none = letters == 0
                out = low - SPREAD / np.sqrt(np.maximum(letters, 1)) > limits[best]
                best[none], score[none], low[none], margin[none] = len(model.languages), 0.0, np.nan, 0.0
                parts.append((names[best], score, low, margin, letters, out | none))
            pred, score, low, margin, letters, out = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0)] * 6
            arrays = [pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(low, from_pandas=True), pa.array(margin)]
            arrays += [pa.array(letters.astype(np.int64)), pa.array(out.astype(bool))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *OUT])

    return lean(run)


OUT = ("lang_pred", "score", "cross_entropy", "margin", "n_letters", "rejected")


def _score(df: DataFrame, model: Model, text: str) -> DataFrame:
    df = without(df, *OUT)
    names = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([f"{n} {t}" for n, t in flat.dtypes]) + ", lang_pred string, score double, cross_entropy double, margin double, n_letters bigint, rejected boolean"
    done = flat.mapInArrow(_predict_batches(shared, names.index(text)), schema)
    return done.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)], *OUT)


def identify(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``df`` with lang_pred, score, cross_entropy, margin, n_letters and rejected, from ``text`` alone.

    The language with the lowest cross-entropy per symbol wins, ties by name; ``score`` is
    the calibrated probability that it is right; ``rejected`` marks texts beyond their
    language's entropy limit. Null texts and texts without a letter are ``und``, score 0,
    rejected; so is every text if there is no model. Equal texts get equal answers; input
    columns called like the new ones are replaced, all others kept whatever their names.
    """
    if model is None:
        none = {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "cross_entropy": F.lit(None).cast("double")}
        kept = without(df, *OUT)
        return kept.withColumns(none | {"margin": F.lit(0.0), "n_letters": F.lit(None).cast("long"), "rejected": F.lit(True)})
    return _score(df, model, text)


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo five; 0 where the id is null."""
    return F.pmod(F.crc32(F.coalesce(quoted(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def train(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Models from folds 2 to 4 and their calibration from fold 1; fold 0 stays unseen."""
    rows = pick(df, id_col, text, lang).withColumn("_fold", fold(id_col))
    model = fit(rows.filter("_fold >= 2"), text, lang)
    return model and calibrate(model, rows.filter("_fold = 1"), text, lang)
