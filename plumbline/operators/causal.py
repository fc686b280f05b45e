"""Adjusted effect of a treatment and the checks that try to refute it.

The main fit and the three refits differ only in their columns or rows, so one
aggregate gathers the centred cross products of all four. The systems that remain have
one row per group and a handful of unknowns.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import hash_int, hash_normal

# Seeds of the hashed draws: placebo treatment, extra confounder, row subset.
PLACEBO_SEED, CAUSE_SEED, SUBSET_SEED = 11, 23, 37


def _products(names: Sequence[str], keep: Column | None = None) -> Column:
    """Lower triangle of covariances times n, for the given columns."""
    def c(name: str) -> Column:
        return F.col(name) if keep is None else F.when(keep, F.col(name))

    cells = [F.covar_pop(c(names[i]), c(names[j])) for i in range(len(names)) for j in range(i + 1)]
    return F.array(*cells)


FIT = T.StructType([T.StructField("effect", T.DoubleType()), T.StructField("standard_error", T.DoubleType())])


@F.pandas_udf(FIT)
def _solve(products: pd.Series, n: pd.Series, width: pd.Series) -> pd.DataFrame:
    """First coefficient and its standard error from the covariances of (x…, y)."""
    out = []
    for cells, rows, k in zip(products, n, width):
        k = int(k)
        lower = np.zeros((k + 1, k + 1))
        lower[np.tril_indices(k + 1)] = np.asarray(cells, dtype=float)
        cov = lower + lower.T - np.diag(np.diag(lower))
        xx, xy, yy = cov[:k, :k], cov[:k, k], cov[k, k]
        if rows <= k + 1 or not np.all(np.isfinite(cov)) or np.linalg.matrix_rank(xx) < k:
            out.append((None, None))
            continue
        inverse = np.linalg.inv(xx)
        beta = inverse @ xy
        left = max(float(yy - beta @ xy), 0.0) * rows / (rows - k - 1)
        out.append((float(beta[0]), float(np.sqrt(left * inverse[0, 0] / rows))))
    return pd.DataFrame(out, columns=["effect", "standard_error"], dtype=float)


def _part(fit: str, name: str) -> Column:
    """A field of a fit; what could not be solved is null, not nan."""
    c = F.col(f"{fit}.{name}")
    return F.when(~F.isnan(c), c)


def _check(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str]) -> None:
    if not confounders:
        raise ValueError("confounders must be named; use association() to explore")
    missing = [c for c in [treatment, outcome, *confounders] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")


def _complete(df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], by: Sequence[str], key) -> DataFrame:
    columns = [F.col(treatment).cast("double").alias("_t"), F.col(outcome).cast("double").alias("_y")]
    columns += [F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(confounders)]
    if key is not None:
        k = F.col(key) if isinstance(key, str) else key
        columns += [
            hash_normal(k, PLACEBO_SEED).alias("_placebo"),
            hash_normal(k, CAUSE_SEED).alias("_extra"),
            (hash_int(k, SUBSET_SEED) % 100 < 80).alias("_keep"),
        ]
    rows = df.select(*by, *columns)
    return rows.na.drop(subset=["_t", "_y", *[f"_c{i}" for i in range(len(confounders))]])


def causal_effect(
    df: DataFrame, treatment: str, outcome: str, confounders: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Coefficient of the treatment in outcome ~ treatment + confounders, with its error."""
    _check(df, treatment, outcome, confounders)
    rows = _complete(df, treatment, outcome, confounders, by, None)
    names = ["_t", *[f"_c{i}" for i in range(len(confounders))], "_y"]
    sums = rows.groupBy(*by).agg(F.count("*").alias("n"), _products(names).alias("_p"))
    fit = sums.withColumn("_f", _solve("_p", "n", F.lit(len(names) - 1)))
    effect, error = _part("_f", "effect"), _part("_f", "standard_error")
    return fit.select(
        *by,
        "n",
        effect.alias("estimated_effect"),
        error.alias("standard_error"),
        (effect - 1.96 * error).alias("ci_lower"),
        (effect + 1.96 * error).alias("ci_upper"),
    )


def refute(
    df: DataFrame,
    treatment: str,
    outcome: str,
    confounders: Sequence[str],
    key: str | Column,
    by: Sequence[str] = (),
) -> DataFrame:
    """The effect, its three refutation checks and the confidence they leave.

    ``key`` is an integer per row; the random treatment, the random confounder and the
    80 % subset are functions of it, so they do not change with the partitioning.
    """
    _check(df, treatment, outcome, confounders)
    rows = _complete(df, treatment, outcome, confounders, by, key)
    others = [f"_c{i}" for i in range(len(confounders))]
    k = len(confounders) + 1
    keep = F.col("_keep")
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(keep).alias("_n_subset"),
        _products(["_t", *others, "_y"]).alias("_p_main"),
        _products(["_placebo", *others, "_y"]).alias("_p_placebo"),
        _products(["_t", "_extra", *others, "_y"]).alias("_p_cause"),
        _products(["_t", *others, "_y"], keep).alias("_p_subset"),
    )
    fits = sums.withColumns(
        {
            "_main": _solve("_p_main", "n", F.lit(k)),
            "_placebo": _solve("_p_placebo", "n", F.lit(k)),
            "_cause": _solve("_p_cause", "n", F.lit(k + 1)),
            "_subset": _solve("_p_subset", "_n_subset", F.lit(k)),
        }
    )
    effect, error = _part("_main", "effect"), _part("_main", "standard_error")
    size = F.abs(effect)

    def change(fit: str) -> Column:
        return F.when(effect != 0, F.abs(_part(fit, "effect") - effect) / F.nullif(size, F.lit(0.0))).otherwise(0.0)

    placebo = F.abs(_part("_placebo", "effect"))
    passed = {
        "placebo_passed": F.when(effect != 0, placebo < 0.1 * size).otherwise(placebo < 0.01),
        "random_cause_passed": change("_cause") < 0.2,
        "subset_passed": change("_subset") < 0.3,
    }
    out = fits.select(
        *by,
        "n",
        effect.alias("estimated_effect"),
        error.alias("standard_error"),
        (effect - 1.96 * error).alias("ci_lower"),
        (effect + 1.96 * error).alias("ci_upper"),
        _part("_placebo", "effect").alias("placebo_effect"),
        _part("_cause", "effect").alias("random_cause_effect"),
        _part("_subset", "effect").alias("subset_effect"),
        *[F.coalesce(test, F.lit(False)).alias(name) for name, test in passed.items()],
    )
    count = sum((F.col(name).cast("int") for name in passed), F.lit(0))
    out = out.withColumns({"refutations_run": F.lit(3), "refutations_passed": count})
    return out.withColumn("causal_confidence", causal_confidence(len(confounders)))


def causal_confidence(confounders: int) -> Column:
    """high, medium or low from the error, the number of confounders and the checks."""
    has_error = F.coalesce(F.col("standard_error") > 0, F.lit(False))
    failed = F.col("refutations_run") - F.col("refutations_passed")
    high = has_error & F.lit(confounders <= 5) & (F.col("refutations_passed") >= 2)
    low = ~has_error | F.lit(confounders > 10) | (failed >= 2)
    return F.when(high, "high").when(low, "low").otherwise("medium")
