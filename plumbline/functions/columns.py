"""Small column expressions used everywhere; all of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIME = 2147483647
SECOND_PRIME = 2147483629
# Doubles below EXACT_LIMIT that this type holds to the last digit add up without rounding, 10^11 of them at least.
EXACT, EXACT_LIMIT = "decimal(38,16)", 1e11


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(numerator: Column | str, denominator: Column | str, default: float | None = None) -> Column:
    """n / d, null (or ``default``) where d is zero or missing."""
    ratio = as_column(numerator).cast("double") / F.nullif(as_column(denominator).cast("double"), F.lit(0.0))
    return ratio if default is None else F.coalesce(ratio, F.lit(float(default)))


def exact_parts(column: Column | str) -> tuple[Column, Column]:
    """A double as a decimal of the same value, or null, and then the double itself (null or 0 otherwise)."""
    c = as_column(column).cast("double")
    held = c.try_cast(EXACT)
    fits = F.coalesce((F.abs(c) < EXACT_LIMIT) & (held.cast("double") == c), F.lit(False))
    return F.when(fits, held), F.when(fits, 0.0).otherwise(c)


def joined_parts(held: Column | str, rest: Column | str) -> Column:
    """The double nearest to a sum kept in two parts; null parts are empty ones."""
    return F.coalesce(as_column(held).cast("double"), F.lit(0.0)) + F.coalesce(as_column(rest), F.lit(0.0))


def exact_sum(column: Column | str) -> Column:
    """Sum of doubles that does not depend on the order of the rows; null without a value.

    A sum of doubles differs in its last bits from run to run, which is enough to part equal
    sums in a ranking or in a distinct count. Only values that no decimal of EXACT holds,
    such as 1e300 or 1e-20, still add up as doubles.
    """
    held, rest = exact_parts(column)
    return F.when(F.count(as_column(column)) > 0, joined_parts(F.sum(held), F.sum(rest)))


def transform(column: Column | str, fn: str) -> Column:
    """Guardrail transformation LOG (log(1+x)) or SQRT; null outside the domain."""
    c = as_column(column).cast("double")
    if fn.upper() == "LOG":
        return F.when(c > -1, F.log1p(c))
    if fn.upper() == "SQRT":
        return F.when(c >= 0, F.sqrt(c))
    raise ValueError(f"unknown transformation {fn!r}")


def hash_int(key: Column | str, seed: int | Column = 0) -> Column:
    """Integer in [0, 2147483647) that depends only on the row's key and the seed."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    k = F.pmod(as_column(key).cast("long"), F.lit(PRIME).cast("long"))
    first = (k * F.lit(48271) + (seed + 1).cast("long") * 7919) % F.lit(PRIME)
    return ((first * first) % F.lit(PRIME) * F.lit(69621) + first) % F.lit(PRIME)


def hash_uniform(key: Column | str, seed: int | Column = 0) -> Column:
    """Uniform draw in (0, 1) from the row's key; the same on every partitioning.

    Two hashes over coprime moduli are added modulo one, so draws repeat only after
    about 4.6e18 keys.
    """
    step = (F.lit(seed) if isinstance(seed, int) else seed) + 1
    k = F.pmod(as_column(key).cast("long"), F.lit(SECOND_PRIME).cast("long"))
    first = (k * F.lit(69621) + step.cast("long") * 104729) % F.lit(SECOND_PRIME)
    other = ((first * first) % F.lit(SECOND_PRIME) * F.lit(48271) + first) % F.lit(SECOND_PRIME)
    total = (hash_int(key, seed) + F.lit(0.5)) / F.lit(float(PRIME)) + (other + F.lit(0.25)) / F.lit(float(SECOND_PRIME))
    return total - F.floor(total)


def hash_normal(key: Column | str, seed: int = 0) -> Column:
    """Standard normal draw by the Box-Muller transform of two hashed uniforms."""
    return F.sqrt(F.lit(-2.0) * F.log(hash_uniform(key, seed))) * F.cos(
        F.lit(6.283185307179586) * hash_uniform(key, seed + 1)
    )


def seconds(ts: Column) -> Column:
    """Seconds since the epoch as a double, for any date or timestamp column."""
    return F.unix_micros(ts.cast("timestamp")).cast("double") / F.lit(1e6)


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, NUMERIC)


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, INTEGER)


def is_temporal(t: T.DataType) -> bool:
    return isinstance(t, TEMPORAL)
