"""Scan, cleaning and sink queries over CSV text that Spark writes from the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators.spec import MetricSpec
from plumbline.operators.run import run_specs
from plumbline.plans.staging import checkpoint_parquet, new_path
from plumbline.queries.registry import SALES, query, rounded
from plumbline.sources import tables as S
from plumbline.sources.views import sales_view, table

KEY_HASH = "(o_orderkey * 48271) % 2147483647"

# Header in the file → (Spark text of the field, DuckDB text of the field).
RAW = {
    "Order Key": ("CAST(o_orderkey AS STRING)", "CAST(o_orderkey AS VARCHAR)"),
    "Ship Date": ("date_format(o_orderdate, 'dd-MM-yyyy')", "strftime(o_orderdate, '%d-%m-%Y')"),
    "US Date": (
        "CASE WHEN day(o_orderdate) > 12 THEN date_format(o_orderdate, 'MM/dd/yyyy') END",
        "CASE WHEN day(o_orderdate) > 12 THEN strftime(o_orderdate, '%m/%d/%Y') END",
    ),
    "Ambiguous": (
        "CASE WHEN day(o_orderdate) <= 12 THEN date_format(o_orderdate, 'MM/dd/yyyy') END",
        "CASE WHEN day(o_orderdate) <= 12 THEN strftime(o_orderdate, '%m/%d/%Y') END",
    ),
    "Month Name": ("date_format(o_orderdate, 'dd-MMM-yyyy')", "strftime(o_orderdate, '%d-%b-%Y')"),
    "Spelled": ("date_format(o_orderdate, 'dd MMM yyyy')", "strftime(o_orderdate, '%d %b %Y')"),
    "Slashed": ("date_format(o_orderdate, 'yyyy/MM/dd')", "strftime(o_orderdate, '%Y/%m/%d')"),
    "ISO": ("date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"),
    "Year": ("CAST(year(o_orderdate) AS STRING)", "CAST(year(o_orderdate) AS VARCHAR)"),
    "Price ($)": (
        "concat('$', format_number(CAST(o_totalprice AS DECIMAL(15, 2)), 2))",
        "'$' || format('{:,.2f}', o_totalprice)",
    ),
    "Discount %": ("concat(CAST(o_orderkey % 11 AS STRING), '%')", "CAST(o_orderkey % 11 AS VARCHAR) || '%'"),
    "Mostly Num": (
        f"CASE WHEN {KEY_HASH} % 100 < 75 THEN CAST(o_custkey AS STRING) ELSE 'n/a' END",
        f"CASE WHEN {KEY_HASH} % 100 < 75 THEN CAST(o_custkey AS VARCHAR) ELSE 'n/a' END",
    ),
    "Barely Num": (
        f"CASE WHEN {KEY_HASH} % 100 < 60 THEN CAST(o_custkey AS STRING) ELSE 'n/a' END",
        f"CASE WHEN {KEY_HASH} % 100 < 60 THEN CAST(o_custkey AS VARCHAR) ELSE 'n/a' END",
    ),
    "Text": ("o_orderpriority", "o_orderpriority"),
    "Empty": ("CAST(NULL AS STRING)", "CAST(NULL AS VARCHAR)"),
}
NAMES = (
    "order_key ship_date us_date ambiguous month_name spelled slashed iso year price discount mostly_num barely_num text empty"
).split()
RAW_SQL = "WITH raw AS (SELECT " + ", ".join(f"{sql} AS {n}" for n, (_, sql) in zip(NAMES, RAW.values())) + " FROM orders)\n"


def raw_csv(spark, folder) -> str:
    """Write the orders as a text table and return its path."""
    path = new_path(spark, "csv")
    fields = [F.expr(text).alias(header) for header, (text, _) in RAW.items()]
    table(spark, folder, "orders").select(*fields).write.option("header", True).csv(path)
    return path


@query(RAW_SQL + "SELECT * FROM raw")
def csv_as_strings(spark, folder):
    return S.normalize_headers(S.read_csv_strings(spark, raw_csv(spark, folder)))


@query(
    RAW_SQL
    + """SELECT CAST(order_key AS INT) AS order_key, CAST(year AS INT) AS year, price, text, mostly_num, CAST(iso AS DATE) AS iso FROM raw"""
)
def csv_inferred(spark, folder):
    typed = S.normalize_headers(S.read_csv_inferred(spark, raw_csv(spark, folder)))
    return typed.select("order_key", "year", "price", "text", "mostly_num", F.to_date("iso").alias("iso"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def parquet_round_trip(spark, folder):
    return checkpoint_parquet(table(spark, folder, "orders"))


@query('SELECT o_orderkey AS order_key, o_totalprice AS unit_price, o_custkey AS unit_price_2, o_orderstatus AS col_3 FROM orders')
def header_rules(spark, folder):
    odd = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus")
    return S.normalize_headers(odd.toDF("  Order--Key!", "Unit Price ($)", "unit__price", "€€"))


@query('SELECT o_orderkey AS order_key, o_totalprice AS größe_m FROM orders')
def header_rules_unicode(spark, folder):
    odd = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return S.normalize_headers(odd.toDF("Order Key", "Größe (m)"), unicode=True)


@query(
    RAW_SQL
    + """SELECT CAST(order_key AS DOUBLE) AS order_key, CAST(strptime(ship_date, '%d-%m-%Y') AS DATE) AS ship_date,
  CAST(strptime(us_date, '%m/%d/%Y') AS DATE) AS us_date, CAST(strptime(ambiguous, '%d/%m/%Y') AS DATE) AS ambiguous,
  CAST(strptime(month_name, '%d-%b-%Y') AS DATE) AS month_name, CAST(strptime(spelled, '%d %b %Y') AS DATE) AS spelled,
  CAST(strptime(slashed, '%Y/%m/%d') AS DATE) AS slashed, CAST(iso AS DATE) AS iso, CAST(year AS DOUBLE) AS year,
  CAST(replace(replace(price, '$', ''), ',', '') AS DOUBLE) AS price, CAST(replace(discount, '%', '') AS DOUBLE) AS discount,
  TRY_CAST(mostly_num AS DOUBLE) AS mostly_num, barely_num, text, empty FROM raw"""
)
def infer_and_cast(spark, folder):
    data = S.load_csv(spark, raw_csv(spark, folder)).data
    dates = [c for c, kind in data.dtypes if kind == "timestamp"]
    return data.withColumns({c: F.to_date(c) for c in dates})


def _log_sql() -> str:
    formats = [
        ("dd-MM-yyyy", "%d-%m-%Y"),
        ("dd/MM/yyyy", "%d/%m/%Y"),
        ("MM/dd/yyyy", "%m/%d/%Y"),
        ("yyyy/MM/dd", "%Y/%m/%d"),
        ("dd-MMM-yyyy", "%d-%b-%Y"),
        ("dd MMM yyyy", "%d %b %Y"),
    ]
    parts = []
    for n in NAMES:
        rates = [("ISO 8601", f"count(CASE WHEN regexp_matches({n}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN TRY_CAST({n} AS TIMESTAMP) END)")]
        rates += [(label, f"count(try_strptime({n}, '{f}'))") for label, f in formats]
        number = f"count(TRY_CAST(regexp_replace(trim({n}), '[$£€₹,%\\s]', '', 'g') AS DOUBLE))"
        cells = ", ".join(f"{{'f': '{label}', 'r': {c} / nullif(count({n}), 0)}}" for label, c in rates)
        parts.append(f"SELECT '{n}' AS column_name, count({n}) AS present, {number} / nullif(count({n}), 0) AS num, [{cells}] AS rates FROM raw")
    return (
        RAW_SQL
        + ", c AS ("
        + " UNION ALL ".join(parts)
        + """), h AS (SELECT *, list_filter(rates, lambda x: x.r >= 0.7)[1] AS hit, list_max(list_transform(rates, lambda x: x.r)) AS top FROM c)
SELECT column_name, CASE WHEN present = 0 THEN 'empty' WHEN hit IS NOT NULL THEN 'timestamp' WHEN num >= 0.7 THEN 'double' ELSE 'string' END AS decision,
  CASE WHEN present > 0 THEN hit.f END AS format,
  round(CASE WHEN present = 0 THEN NULL WHEN hit IS NOT NULL THEN hit.r WHEN num >= 0.7 THEN num ELSE greatest(num, top) END, 6) AS rate,
  round(num, 6) AS numeric_rate FROM h"""
    )


@query(_log_sql())
def cast_log(spark, folder):
    return rounded(S.load_csv(spark, raw_csv(spark, folder)).log.drop("date_rates"))


@query(
    """SELECT p_partkey, p_retailprice AS plain, round(p_retailprice * 1000, 2) AS separated, CAST(p_size AS DOUBLE) AS percent, CAST(NULL AS DOUBLE) AS word FROM part"""
)
def numeric_cleaning(spark, folder):
    part = table(spark, folder, "part")
    price = F.col("p_retailprice").cast("decimal(15,2)")
    texts = part.select(
        "p_partkey",
        F.concat(F.lit("  £ "), price.cast("string"), F.lit(" ")).alias("plain"),
        F.concat(F.lit("₹"), F.format_number((price * 1000).cast("decimal(15,2)"), 2)).alias("separated"),
        F.concat(F.col("p_size").cast("string"), F.lit(" %")).alias("percent"),
        F.col("p_name").alias("word"),
    )
    return texts.select("p_partkey", *[S.clean_numeric(c).alias(c) for c in ("plain", "separated", "percent", "word")])


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def trimmed_strings(spark, folder):
    padded = table(spark, folder, "customer").select(
        "c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("c_name"), F.concat("c_mktsegment", F.lit("   ")).alias("c_mktsegment")
    )
    return S.trim_strings(padded)


@query("SELECT c_custkey, c_name FROM customer")
def empty_columns_dropped(spark, folder):
    holes = table(spark, folder, "customer").select(
        "c_custkey", "c_name", F.lit(None).cast("double").alias("nothing"), F.when(F.lit(False), F.col("c_name")).alias("never")
    )
    return S.drop_empty_columns(holes)


@query(
    """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date, strftime(o_orderdate, '%Y-%m-%d') AS placed,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS ship_time FROM orders"""
)
def dates_by_name(spark, folder):
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = table(spark, folder, "orders").select(
        "o_orderkey", text.alias("order_date"), text.alias("placed"), F.when(F.col("o_orderkey") % 2 == 0, text).otherwise("soon").alias("ship_time")
    )
    parsed = S.parse_named_dates(raw)
    return parsed.withColumns({c: F.to_date(c) for c in ("order_date", "ship_time")})


@query("SELECT c_custkey AS cust_key, c_name AS name, c_acctbal AS balance FROM customer")
def cleaned_table(spark, folder):
    raw = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("Cust Key"), F.concat(F.lit(" "), "c_name").alias(" Name "), F.col("c_acctbal").alias("Balance!"), F.lit(None).cast("string").alias("Notes")
    )
    return S.clean_table(raw)


@query("SELECT count(*) AS row_count, CAST(6 AS BIGINT) AS column_count FROM orders")
def table_shape(spark, folder):
    return S.table_shape(S.require_rows(table(spark, folder, "orders")))


@query("SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 5")
def preview_rows(spark, folder):
    return S.preview(table(spark, folder, "orders").orderBy("o_orderdate", "o_orderkey"), 5)


@query(
    SALES
    + """SELECT 'sales:DIMENSIONAL:segment' AS spec_id, segment AS key, round(sum(sales), 4) AS value, count(*) AS sample_size, TRUE AS is_significant
FROM sales GROUP BY segment"""
)
def results_written(spark, folder):
    spec = MetricSpec("sales", "sales", template="SUM", scope="DIMENSIONAL", dims=("segment",))
    results = run_specs(sales_view(spark, folder, "segment", "sales"), [spec])
    path = new_path(spark, "results")
    S.write_results(results, path, "json")
    back = spark.read.schema(results.schema).json(path)
    return rounded(back.select("spec_id", F.element_at("group_key", "segment").alias("key"), "value", "sample_size", "is_significant"), 4)
