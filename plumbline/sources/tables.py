"""Reading raw CSV, cleaning and typing it, and writing results."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.fixed_values import CAST_RATE, DATE_FORMATS, DATE_NAME_PARTS, NUMERIC_NOISE, NUMERIC_SHAPE


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """All columns as string; bad fields null, surplus fields of a line dropped."""
    return (
        spark.read.option("header", True).option("mode", "PERMISSIVE").option("inferSchema", False).csv(path)
    )


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """Types chosen by Spark; fields that do not fit become null."""
    return spark.read.option("header", True).option("mode", "PERMISSIVE").option("inferSchema", True).csv(path)


def normalize_headers(df: DataFrame, unicode: bool = False) -> DataFrame:
    """Snake-case names. ``unicode`` keeps letters beyond a-z; repeats get a suffix."""
    names: list[str] = []
    for i, raw in enumerate(df.columns):
        name = raw.lower().strip()
        name = re.sub(r"\W" if unicode else r"[^a-z0-9]", "_", name)
        name = re.sub(r"_+", "_", name).strip("_") or f"col_{i}"
        base, n = name, 2
        while name in names:
            name, n = f"{base}_{n}", n + 1
        names.append(name)
    return df.toDF(*names)


def clean_numeric(column: Column | str) -> Column:
    """Text to double after removing currency signs, separators, % and blanks.

    The shape test spares the parser (and its exceptions) on texts that are no numbers.
    """
    c = F.col(column) if isinstance(column, str) else column
    bare = F.regexp_replace(F.trim(c), NUMERIC_NOISE, "")
    return F.when(bare.rlike(NUMERIC_SHAPE), bare.try_cast("double"))


def parse_date(column: Column, pattern: str | None, shape: str) -> Column:
    """Timestamp for texts of the given shape. The guard keeps '2024' a number and
    spares the parser (and its exceptions) on texts that cannot match."""
    parsed = column.try_cast("timestamp") if pattern is None else F.try_to_timestamp(column, F.lit(pattern))
    return F.when(column.rlike(shape), parsed)


def separator(pattern: str | None) -> str:
    """The character between the parts of a date format."""
    return "-" if pattern is None else next(c for c in pattern if c in "-/ ")


@dataclass(frozen=True)
class CastResult:
    """Typed table and one log row per column."""

    data: DataFrame
    log: DataFrame


LOG_SCHEMA = T.StructType(
    [
        T.StructField("column_name", T.StringType()),
        T.StructField("decision", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("rate", T.DoubleType()),
        T.StructField("numeric_rate", T.DoubleType()),
        T.StructField(
            "date_rates",
            T.ArrayType(
                T.StructType([T.StructField("format", T.StringType()), T.StructField("rate", T.DoubleType())])
            ),
        ),
    ]
)


def infer_and_cast(df: DataFrame, threshold: float = CAST_RATE) -> CastResult:
    """Cast string columns whose texts parse often enough: dates in order, then numbers.

    One aggregate measures every column and format; one projection applies the result.
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    # Unpivoted, so that nine aggregates serve any number of columns. The separator after
    # the first digits is found once and rules out most formats before their own test.
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"`{name}`").alias("text")) for i, name in enumerate(texts)])
    texts_long = df.select(F.inline(cells)).filter("text is not null")
    texts_long = texts_long.withColumn("sep", F.regexp_extract("text", r"^\d{1,4}([-/ ])", 1))
    measured = texts_long.groupBy("i").agg(
        F.count("*").alias("present"),
        F.count(clean_numeric("text")).alias("numbers"),
        *[
            F.count(F.when(F.col("sep") == separator(pattern), parse_date(F.col("text"), pattern, shape))).alias(f"d{j}")
            for j, (_, pattern, shape) in enumerate(DATE_FORMATS)
        ],
    )
    # One row per text column.
    counts = {row["i"]: row for row in measured.collect()} if texts else {}

    projection, log = [], []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.name not in texts:
            projection.append(c)
            log.append((field.name, "typed", None, None, None, None))
            continue
        i = texts.index(field.name)
        if i not in counts:
            projection.append(c)
            log.append((field.name, "empty", None, None, None, None))
            continue
        present = counts[i]["present"]
        rates = [counts[i][f"d{j}"] / present for j in range(len(DATE_FORMATS))]
        numeric_rate = counts[i]["numbers"] / present
        shown = [(DATE_FORMATS[j][0], r) for j, r in enumerate(rates)]
        hit = next((j for j, r in enumerate(rates) if r >= threshold), None)
        if hit is not None:
            label, pattern, shape = DATE_FORMATS[hit]
            projection.append(parse_date(c, pattern, shape).alias(field.name))
            log.append((field.name, "timestamp", label, rates[hit], numeric_rate, shown))
        elif numeric_rate >= threshold:
            projection.append(clean_numeric(c).alias(field.name))
            log.append((field.name, "double", None, numeric_rate, numeric_rate, shown))
        else:
            projection.append(c)
            log.append((field.name, "string", None, max(numeric_rate, *rates), numeric_rate, shown))
    return CastResult(df.select(*projection), df.sparkSession.createDataFrame(log, LOG_SCHEMA))


def load_csv(spark: SparkSession, path: str, threshold: float = CAST_RATE) -> CastResult:
    """Raw CSV to a typed table with clean headers."""
    return infer_and_cast(normalize_headers(read_csv_strings(spark, path)), threshold)


def trim_strings(df: DataFrame) -> DataFrame:
    """Trim every string column."""
    return df.select(
        *[
            F.trim(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns that hold no value at all; one aggregate over all columns."""
    present = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n_{i}") for i, c in enumerate(df.columns)]).first()
    return df.drop(*[c for i, c in enumerate(df.columns) if present[f"n_{i}"] == 0])


def parse_named_dates(df: DataFrame) -> DataFrame:
    """Parse text columns whose name speaks of a date; unparsable texts become null."""
    _, pattern, shape = DATE_FORMATS[0]
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        named = any(part in f.name.lower() for part in DATE_NAME_PARTS)
        if named and isinstance(f.dataType, T.StringType):
            c = parse_date(c, pattern, shape).alias(f.name)
        out.append(c)
    return df.select(*out)


def require_rows(df: DataFrame) -> DataFrame:
    """The same table, or an error when it has no columns or no rows."""
    if not df.columns:
        raise ValueError("no columns remain")
    if df.isEmpty():
        raise ValueError("the table has no rows")
    return df


def clean_table(df: DataFrame) -> DataFrame:
    """The older cleaning order: headers, trim, drop empty, dates by name, checks."""
    named = normalize_headers(df, unicode=True)
    return require_rows(parse_named_dates(drop_empty_columns(trim_strings(named))))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows as the scan returns them."""
    return df.limit(n)


def table_shape(df: DataFrame) -> DataFrame:
    """Row count and column count in one row."""
    return df.agg(F.count("*").alias("row_count")).withColumn("column_count", F.lit(len(df.columns)).cast("long"))


def write_results(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a results table as Parquet or JSON lines."""
    if fmt not in ("parquet", "json"):
        raise ValueError("results are written as parquet or json")
    df.write.mode("error").format(fmt).save(path)
