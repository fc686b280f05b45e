"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import quoted, slices, staged, without
from plumbline.plans.staging import broadcast_if_small

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOLS = b"#*$%&|<>"
_SPACE = bytes.maketrans(b"", b"")

# Share of a group that an estimate rests on, and rows (about) that its search starts from.
SUPPORT = 0.75
START_ROWS = 600
# Groups under this size are pooled by language, then over all; pools under it reject nothing.
LEAST_ROWS = 100
STEPS = 6
# Tail of the chi-squared law beyond which a vector is an outlier. Real texts have heavier
# tails than that law, so it is far below one in all texts.
TAIL = 1e-12
# Deviations below these are not told apart, so that constant statistics do not reject by trifles.
RESOLUTION = (0.25, 0.05, 0.25, 0.1, 0.1)
NAMES = ("v0", "v1", "v2", "v3", "v4")
PAIRS = list(combinations_with_replacement(range(len(NAMES)), 2))


def text_statistics(text: str | None) -> tuple[int, ...]:
    """The counts of STATISTICS for one text; all zero for null."""
    if not text:
        return (0,) * len(STATISTICS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    symbols = len(data) - len(data.translate(_SPACE, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        number: dict[tuple, int] = {}
        codes = np.array([number.setdefault(w, len(number)) for w in windows])
        twice = np.bincount(codes)[codes] > 1
        marks = np.zeros(n, dtype=bool)
        for k in range(3):
            marks[k : k + len(windows)] |= twice
        repeated = int(marks.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def _statistics_batches(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices([len(t) if t else 0 for t in batch.column(at).to_pylist()]):
                part = batch.slice(i, j - i)
                rows = np.array([text_statistics(t) for t in part.column(at).to_pylist()], dtype=np.int64)
                arrays = [pa.array(rows[:, k]) for k in range(len(STATISTICS))]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], [*part.schema.names, *STATISTICS])

    return run


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` and the counts of STATISTICS of the whole text; null and empty texts count nothing.

    Columns called like the counts are replaced, all others kept whatever their names.
    """
    df = without(df, *STATISTICS)
    names = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(names))])
    schema = ", ".join([f"{n} {t}" for n, t in flat.dtypes] + [f"{s} bigint" for s in STATISTICS])
    done = flat.mapInArrow(_statistics_batches(names.index(text)), schema)
    return done.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)], *STATISTICS)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """Transformed statistics: length, word length, and shares of symbols, copied lines, repeats."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.log1p(F.col("word_chars") / n),
        F.log1p(100.0 * F.col("n_symbols") / n),
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        F.col("n_repeat_words") / n,
    ]


def _chi2_cdf(x: float, p: int) -> float:
    """Regularised lower incomplete gamma function by its series."""
    if x <= 0:
        return 0.0
    a, half = p / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-17:
        k += 1
        term *= half / k
        total += term
    return min(1.0, total * math.exp(-half + a * math.log(half) - math.lgamma(a)))


def _chi2_sf(x: float, p: int) -> float:
    """Upper tail for odd p, by its finite sum; exact far out."""
    total = math.erfc(math.sqrt(x / 2))
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, (p - 1) // 2 + 1):
        total += term
        term *= x / (2 * k + 1)
    return total


@lru_cache(maxsize=None)
def chi2_quantile(tail: float, p: int) -> float:
    low, high = 0.0, 1.0
    while _chi2_sf(high, p) > tail:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2_sf(middle, p) > tail else (low, middle)
    return (low + high) / 2


def consistency(share: float, p: int) -> float:
    """What the covariance of the nearest ``share`` of normal vectors falls short by."""
    return share / _chi2_cdf(chi2_quantile(1 - share, p), p + 2)


def _invert(cov: np.ndarray) -> tuple[np.ndarray, float]:
    """Precision and log determinant of a covariance with the resolution added."""
    full = cov + np.diag(np.square(RESOLUTION[: len(cov)]))
    return np.linalg.inv(full), float(np.linalg.slogdet(full)[1])


def fast_mcd(x: np.ndarray, support: float, seed: int, starts: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, covariance and log determinant of the best of many random starts."""
    n, p = x.shape
    h = max(p + 1, math.ceil(support * n))
    rng = np.random.default_rng(seed)

    def step(mean, cov):
        inverse, _ = _invert(cov)
        d = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
        near = x[np.argsort(d, kind="stable")[:h]]
        cov = np.cov(near.T, bias=True)
        return near.mean(axis=0), cov, _invert(cov)[1]

    tried = []
    for _ in range(starts):
        some = x[rng.choice(n, min(n, p + 1), replace=False)]
        now = some.mean(axis=0), np.cov(some.T, bias=True), 0.0
        for _ in range(2):
            now = step(*now[:2])
        tried.append(now)
    best = None
    for now in sorted(tried, key=lambda t: t[2])[:8]:
        for _ in range(50):
            after = step(*now[:2])
            if after[2] >= now[2] - 1e-9:
                break
            now = after
        best = now if best is None or now[2] < best[2] else best
    return best


PARAMETERS = "g string, mean array<double>, precision array<double>, logdet double"


def _start(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["draw", *NAMES])
    mean, cov, logdet = fast_mcd(rows[list(NAMES)].to_numpy(float), SUPPORT, seed=len(rows))
    return pd.DataFrame([(group[0], mean.tolist(), _invert(cov)[0].ravel().tolist(), logdet)], columns=["g", "mean", "precision", "logdet"])


def _sums() -> list[Column]:
    out = [F.count("*").alias("n"), *[F.sum(v).alias(f"s_{v}") for v in NAMES]]
    return out + [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q_{i}_{j}") for i, j in PAIRS]


def _parameters(scale: float):
    """From sums of a group's nearest rows: centre, precision and log determinant."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                mean = np.array([r[f"s_{v}"] / r["n"] for v in NAMES])
                cov = np.zeros((len(NAMES), len(NAMES)))
                for i, j in PAIRS:
                    cov[i, j] = cov[j, i] = r[f"q_{i}_{j}"] / r["n"] - mean[i] * mean[j]
                inverse, logdet = _invert(scale * cov)
                out.append((r["g"], mean.tolist(), inverse.ravel().tolist(), logdet))
            yield pd.DataFrame(out, columns=["g", "mean", "precision", "logdet"])

    return run


def _distance() -> Column:
    total = F.lit(0.0)
    for i, j in PAIRS:
        q = F.col("precision")[i * len(NAMES) + j] * (1.0 if i == j else 2.0)
        total = total + q * (F.col(NAMES[i]) - F.col("mean")[i]) * (F.col(NAMES[j]) - F.col("mean")[j])
    return F.greatest(total, F.lit(0.0))


def _measured(rows: DataFrame, parameters: DataFrame, groups: int) -> DataFrame:
    named = parameters.withColumnRenamed("g", "_g")
    return rows.join(broadcast_if_small(named, groups), F.col("g") == F.col("_g"), "left").withColumn("d2", _distance())


def _classes(rows: DataFrame) -> DataFrame:
    """Group and class of distance (eight to a doubling) with the class's sums."""
    rank = F.floor(8 * F.log2(F.col("d2") + 1e-9)).cast("int")
    return rows.groupBy("g", rank.alias("rank")).agg(*_sums())


def _nearest(classes: DataFrame, support: float) -> DataFrame:
    """Sums over the nearest classes that hold ``support`` of each group."""
    whole, inner = Window.partitionBy("g"), Window.partitionBy("g").orderBy("rank")
    counted = classes.withColumn("all", F.sum("n").over(whole)).withColumn("before", F.sum("n").over(inner) - F.col("n"))
    sums = [c for c in classes.columns if c not in ("g", "rank")]
    return counted.filter(F.col("before") < support * F.col("all")).groupBy("g").agg(*[F.sum(c).alias(c) for c in sums])


def _key(name: str) -> Column:
    return F.when(quoted(name).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), quoted(name).cast("string")))


def estimates(rows: DataFrame, groups: int, support: float = SUPPORT, steps: int = STEPS) -> DataFrame:
    """Parameters of each group of ``rows`` (g, draw, v0 … v4, staged).

    The search starts from a sample of about START_ROWS rows a group; concentration steps
    over all rows follow: every row is measured, counted in classes of distance, and the
    nearest classes give the next centre and covariance, until no determinant falls. The
    estimate is then re-weighted on all rows within the 97.5 % point.
    """
    p = len(NAMES)
    sizes = rows.groupBy("g").agg(F.count("*").alias("n")).withColumnRenamed("g", "_g")
    share = F.lit(float(START_ROWS)) / F.col("n")
    sample = rows.join(broadcast_if_small(sizes, groups), F.col("g") == F.col("_g")).filter(F.col("draw") < share)
    now = staged(sample.select("g", "draw", *NAMES).groupBy("g").applyInPandas(_start, PARAMETERS))
    for _ in range(steps):
        sums = _nearest(_classes(_measured(rows, now, groups)), support)
        after = staged(sums.mapInPandas(_parameters(1.0), PARAMETERS))
        old = now.select(F.col("g").alias("_g"), F.col("logdet").alias("_old"))
        fallen = after.join(old, F.col("g") == F.col("_g"), "left").filter("_old is null or logdet < _old - 0.01").limit(1).count()
        now = after
        if not fallen:
            break
    near = _measured(rows, now, groups).filter(F.col("d2") <= consistency(support, p) * chi2_quantile(0.025, p))
    return staged(near.groupBy("g").agg(*_sums()).mapInPandas(_parameters(consistency(0.975, p)), PARAMETERS))


def judged(df: DataFrame, by: Sequence[str] = ("lang", "source"), tail: float = TAIL, least: int = LEAST_ROWS) -> DataFrame:
    """``df`` (with STATISTICS, staged) and base_failed, distance, cutoff and kept.

    Rows that pass the base rules are vectors of transformed statistics; for each value of
    ``by`` (language, then source; nulls are a value) centre and covariance are estimated,
    and rows beyond the chi-squared point of ``tail`` are rejected. Small groups share an
    estimate with the small groups of their language, or with all small ones; without
    ``least`` rows even there, nothing is rejected. Repeated rows count as often as they
    stand and get equal verdicts; an empty table gives an empty one. Columns called like
    the new ones are replaced, all others kept whatever their names.
    """
    df = without(df, "base_failed", "distance", "cutoff", "kept")
    names = df.columns
    record = F.struct(*[quoted(c).alias(f"r{i}") for i, c in enumerate(names)])
    draw = F.pmod(F.xxhash64(F.lit(3), *[quoted(c) for c in names]), F.lit(1 << 30)) / float(1 << 30)
    rows = df.select(
        record.alias("record"), base_failed().alias("base_failed"), draw.alias("draw"),
        *[c.alias(n) for c, n in zip(vector(), NAMES)], _key(by[0]).alias("k0"), F.concat_ws("\u0001", *[_key(b) for b in by]).alias("k1"),
    )
    cells = rows.filter("not base_failed").groupBy("k0", "k1").agg(F.count("*").alias("n"))
    pool = F.when(F.col("n") >= least, F.col("k1")).otherwise(F.col("k0"))
    cells = cells.withColumn("g", pool)
    cells = cells.withColumn("m", F.sum("n").over(Window.partitionBy("g")))
    cells = staged(cells.withColumn("g", F.when(F.col("m") >= least, F.col("g")).otherwise(F.lit("*"))))
    count = cells.count()
    sums = cells.groupBy("g").agg(F.sum("n").alias("m")).filter(F.col("m") >= least)
    named = staged(cells.select(F.col("k1").alias("_k"), "g").join(sums.select(F.col("g").alias("_s")), F.col("g") == F.col("_s")).select("_k", "g"))
    grouped = staged(rows.join(broadcast_if_small(named, count), (F.col("k1") == F.col("_k")) & ~F.col("base_failed"), "left").drop("k0", "k1", "_k"))
    vectors = grouped.filter("g is not null").select("g", "draw", *NAMES)
    cutoff = chi2_quantile(tail, len(NAMES))
    done = _measured(grouped, estimates(vectors, count), count)
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))
    return done.select(
        *[F.col(f"record.r{i}").alias(c) for i, c in enumerate(names)],
        "base_failed", F.sqrt("d2").alias("distance"), F.lit(math.sqrt(cutoff)).alias("cutoff"), kept.alias("kept"),
    )
