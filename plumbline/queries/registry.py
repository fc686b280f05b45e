"""Where queries register themselves, and the SQL views their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, fn: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(prepare(spark), folder)

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = sql


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL that checks it."""

    def add(fn: Query) -> Query:
        register(fn.__name__, fn, sql)
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round all doubles so that two engines' last bits do not matter."""
    return df.select(
        *[
            (F.round(c, special.get(c, digits)) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c)
            for c, kind in df.dtypes
        ]
    )


# The sales view in SQL; the funnel and usage views likewise.
SALES = """
WITH sales AS (
  SELECT l_shipdate AS date,
         l_extendedprice * (1 - l_discount) AS sales,
         l_extendedprice * l_discount AS ad_cost,
         p_retailprice * l_quantity AS cost,
         l_quantity AS inventory,
         l_linenumber AS our_position,
         l_orderkey AS order_id,
         l_partkey AS product_id,
         o_custkey AS customer_id,
         p_type AS category,
         p_brand AS brand,
         c_mktsegment AS segment,
         o_orderpriority AS priority,
         n_name AS country
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey)
"""

FUNNEL = """
WITH funnel AS (
  SELECT user_id, CAST(ts AS DATE) AS day,
         count(*) FILTER (event_type = 'view') AS impressions,
         count(*) FILTER (event_type = 'click') AS clicks,
         count(*) FILTER (event_type = 'signup') AS signups,
         count(*) FILTER (event_type = 'purchase') AS conversions,
         count(*) FILTER (event_type = 'error') AS errors,
         coalesce(sum(value) FILTER (event_type = 'click'), 0) AS spend,
         coalesce(sum(value) FILTER (event_type = 'purchase'), 0) AS revenue
  FROM events GROUP BY ALL)
"""

USAGE = """
WITH calls AS (
  SELECT role AS phase, 'model_' || CAST(conv_id % 2 AS VARCHAR) AS model,
         CASE WHEN role = 'user' THEN len(string_split(text, ' ')) ELSE 0 END AS input_units,
         CASE WHEN role = 'user' THEN 0 ELSE len(string_split(text, ' ')) END AS output_units
  FROM conversations)
"""


def hash_sql(key: str, seed: int | str = 0) -> str:
    """The row hash of ``functions.columns.hash_int`` in SQL."""
    first = f"((({key}) % 2147483647 * 48271 + 7919 * (({seed}) + 1)) % 2147483647)"
    return f"(({first} * {first} % 2147483647 * 69621 + {first}) % 2147483647)"


def uniform_sql(key: str, seed: int | str = 0) -> str:
    first = f"((({key}) % 2147483629 * 69621 + 104729 * (({seed}) + 1)) % 2147483629)"
    other = f"(({first} * {first} % 2147483629 * 48271 + {first}) % 2147483629)"
    total = f"(({hash_sql(key, seed)} + 0.5e0) / 2147483647e0 + ({other} + 0.25e0) / 2147483629e0)"
    return f"({total} - floor({total}))"


def normal_sql(key: str, seed: int = 0) -> str:
    return f"(sqrt(-2e0 * ln({uniform_sql(key, seed)})) * cos(6.283185307179586e0 * {uniform_sql(key, seed + 1)}))"


def student_p_sql(t: str, df: str) -> str:
    """Two-sided Student tail by Simpson's rule on t = tan(u), 2000 slices; for any t."""
    step = f"(atan(abs({t}) / sqrt({df})) / 2000)"
    # With t = sqrt(df)·tan(u) the density becomes a power of the cosine.
    weight = "CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = f"(SELECT sum({weight} * pow(cos(i * {step}), {df} - 1)) * {step} / 3 FROM range(2001) r(i))"
    front = f"exp(lgamma(({df} + 1) / 2e0) - lgamma({df} / 2e0)) / sqrt(pi())"
    return f"greatest(0e0, 1 - 2 * {front} * {area})"


def normal_cdf_sql(z: str) -> str:
    """Normal distribution function by Simpson's rule, 2000 slices."""
    weight = "CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = f"(SELECT sum({weight} * exp(-pow(i * ({z}) / 2000, 2) / 2)) * ({z}) / 6000 FROM range(2001) r(i))"
    return f"(0.5e0 + {area} / sqrt(2 * pi()))"
