"""Metric queries: rows, formulas, scopes, motifs and derived ratios."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.fixed_values import USAGE_PRICES
from plumbline.functions.columns import safe_div, transform
from plumbline.operators import derived as D
from plumbline.operators import metrics as M
from plumbline.operators import motifs
from plumbline.operators.run import run_specs
from plumbline.operators.spec import Guardrail, MetricSpec
from plumbline.queries.registry import FUNNEL, SALES, USAGE, query, register, rounded
from plumbline.sources.views import funnel_view, sales_view, table, usage_view


def ratio(scope: str, *dims: str, **more) -> MetricSpec:
    where = "DIMENSIONAL" if dims else "GLOBAL"
    return MetricSpec("roas", "sales", "ad_cost", "RATIO", where, scope, dims, **more)


# --- rows ---------------------------------------------------------------------------


@query(
    SALES
    + """SELECT order_id, CAST(our_position AS BIGINT) AS our_position, round(sales, 4) AS sales, round(ad_cost, 4) AS ad_cost
FROM sales WHERE sales IS NOT NULL AND ad_cost IS NOT NULL AND ad_cost > 0"""
)
def sanitize_rows(spark, folder):
    rows = M.sanitize(sales_view(spark, folder, "order_id", "our_position", "sales", "ad_cost"), ["sales", "ad_cost"], "ad_cost")
    return rounded(rows.withColumn("our_position", F.col("our_position").cast("long")), 4)


@query(SALES + "SELECT order_id, product_id, round(sales / nullif(ad_cost, 0), 6) AS value FROM sales")
def row_ratio(spark, folder):
    view = sales_view(spark, folder, "order_id", "product_id", "sales", "ad_cost")
    return rounded(M.with_metric(view, ratio("SAME_ROW")).select("order_id", "product_id", "value"))


@query(SALES + "SELECT order_id, product_id, round(sales / (SELECT sum(ad_cost) FROM sales), 10) AS value FROM sales")
def row_share_of_total(spark, folder):
    view = sales_view(spark, folder, "order_id", "product_id", "sales", "ad_cost")
    return rounded(M.with_metric(view, ratio("GLOBAL_SUM")).select("order_id", "product_id", "value"), 10)


@query(
    SALES
    + """SELECT order_id, product_id, round(sales / nullif(ad_cost, 0), 6) AS ratio,
       round(coalesce(sales / nullif(ad_cost, 0), 0), 6) AS ratio_or_zero FROM sales"""
)
def zero_safe_division(spark, folder):
    view = sales_view(spark, folder, "order_id", "product_id", "sales", "ad_cost")
    return rounded(
        view.select(
            "order_id",
            "product_id",
            safe_div("sales", "ad_cost").alias("ratio"),
            safe_div("sales", "ad_cost", default=0.0).alias("ratio_or_zero"),
        )
    )


@query(
    SALES
    + """SELECT order_id, product_id, CAST((SELECT max(our_position) FROM sales) + 1 - our_position AS BIGINT) AS inverted FROM sales"""
)
def inverted_rank(spark, folder):
    view = sales_view(spark, folder, "order_id", "product_id", "our_position")
    out = M.invert_rank(view, "our_position", "inverted")
    return out.select("order_id", "product_id", F.col("inverted").cast("long").alias("inverted"))


@query(
    SALES
    + """SELECT brand, count(*) AS sample_size, round(sum(sales), 4) AS value FROM sales
WHERE our_position <= 3 AND sales IS NOT NULL GROUP BY brand"""
)
def guardrail_filter(spark, folder):
    spec = MetricSpec(
        "sales", "sales", template="SUM", scope="DIMENSIONAL", dims=("brand",), guardrail=Guardrail("our_position", filter_condition="our_position <= 3")
    )
    out = M.metric_by(sales_view(spark, folder, "brand", "sales", "our_position"), spec, ordered=False)
    return rounded(out.select("brand", "sample_size", "value"), 4)


@query(
    SALES
    + """SELECT segment, round(avg((SELECT max(our_position) FROM sales) + 1 - our_position), 6) AS value, count(*) AS sample_size
FROM sales GROUP BY segment"""
)
def guardrail_inverted_mean(spark, folder):
    spec = MetricSpec("rank", "our_position", scope="DIMENSIONAL", dims=("segment",), guardrail=Guardrail("our_position", invert=True))
    out = M.metric_by(sales_view(spark, folder, "segment", "our_position"), spec, ordered=False)
    return rounded(out.select("segment", "value", "sample_size"))


@query(
    """SELECT c_custkey, round(CASE WHEN c_acctbal > -1 THEN ln(1 + c_acctbal) END, 6) AS log_balance,
       round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 6) AS sqrt_balance FROM customer"""
)
def guardrail_transform(spark, folder):
    return rounded(
        table(spark, folder, "customer").select(
            "c_custkey", transform("c_acctbal", "LOG").alias("log_balance"), transform("c_acctbal", "SQRT").alias("sqrt_balance")
        )
    )


@query(
    SALES
    + """SELECT isodow(date) IN (6, 7) AS is_weekend, day(date) = 1 AS is_month_start,
       CAST(date AS DATE) = last_day(date) AS is_month_end, count(*) AS n, round(sum(sales), 4) AS sales
FROM sales GROUP BY ALL"""
)
def calendar_slices(spark, folder):
    flagged = M.calendar_flags(sales_view(spark, folder, "date", "sales"), "date")
    out = flagged.groupBy("is_weekend", "is_month_start", "is_month_end").agg(F.count("*").alias("n"), F.sum("sales").alias("sales"))
    return rounded(out, 4)


@query(
    """SELECT 'value' AS metric, TRUE AS "numeric", round(null_share, 6) AS null_share, null_share <= 0.7 AS eligible
FROM (SELECT 1 - count(CASE WHEN (event_id * 48271) % 2147483647 % 100 >= 60 THEN value END) / count(*) AS null_share FROM events)"""
)
def metric_column_check(spark, folder):
    planted = table(spark, folder, "events").withColumn(
        "value", F.when((F.col("event_id") * 48271) % 2147483647 % 100 >= 60, F.col("value"))
    )
    return rounded(M.check_metric_columns(planted, MetricSpec("value", "value")))


# --- scopes and formulas ------------------------------------------------------------

KEPT = "sales IS NOT NULL AND ad_cost IS NOT NULL AND ad_cost > 0"


@query(
    SALES
    + f"""SELECT 'roas' AS metric, round(sum(sales) / sum(ad_cost), 6) AS value, count(*) AS sample_size,
       count(*) >= 30 AS is_significant, 'SUM(sales) / SUM(ad_cost)' AS formula FROM sales WHERE {KEPT}"""
)
def metric_global_ratio(spark, folder):
    return rounded(M.metric_global(sales_view(spark, folder, "sales", "ad_cost"), ratio("DIMENSIONAL")))


@query(
    SALES
    + f"""SELECT brand, category, round(sum(sales) / sum(ad_cost), 6) AS value, count(*) AS sample_size,
       count(*) >= 30 AS is_significant FROM sales WHERE {KEPT} GROUP BY brand, category"""
)
def metric_by_dims(spark, folder):
    return rounded(M.metric_by(sales_view(spark, folder, "brand", "category", "sales", "ad_cost"), ratio("DIMENSIONAL", "brand", "category")))


@query(
    SALES
    + f"""SELECT brand, round(value, 6) AS value, CAST(total AS BIGINT) AS sample_size FROM (
  SELECT brand, sum(sales) / sum(ad_cost) AS value, sum(count(*)) OVER () AS total FROM sales WHERE {KEPT} GROUP BY brand)
ORDER BY value DESC LIMIT 1"""
)
def metric_top_segment(spark, folder):
    groups = M.metric_by(sales_view(spark, folder, "brand", "sales", "ad_cost"), ratio("DIMENSIONAL", "brand"), ordered=False)
    return rounded(M.top_segment(groups, ["brand"]))


def _over_time(grain: str, part: str) -> None:
    spec = MetricSpec("sales", "sales", template="SUM", scope="TEMPORAL", time="date", grain=grain)

    def run(spark, folder):
        out = M.metric_over_time(sales_view(spark, folder, "date", "sales"), spec)
        return rounded(out.select(F.col("bucket").cast("date").alias("bucket"), "value", "sample_size"), 4)

    sql = f"""SELECT CAST(date_trunc('{part}', l_shipdate) AS DATE) AS bucket,
       round(sum(l_extendedprice * (1 - l_discount)), 4) AS value, count(*) AS sample_size FROM lineitem GROUP BY 1"""
    register(f"metric_over_time_{grain}", run, sql)


for _grain, _part in (("daily", "day"), ("weekly", "week"), ("monthly", "month"), ("quarterly", "quarter"), ("yearly", "year")):
    _over_time(_grain, _part)


@query(
    SALES
    + f"""SELECT segment, CAST(date_trunc('month', date) AS DATE) AS bucket, round(avg(sales / ad_cost), 6) AS value, count(*) AS sample_size
FROM sales WHERE {KEPT} GROUP BY 1, 2"""
)
def metric_over_time_by_dim(spark, folder):
    spec = MetricSpec("roas", "sales", "ad_cost", scope="TEMPORAL", time="date", grain="monthly", dims=("segment",))
    out = M.metric_over_time(sales_view(spark, folder, "date", "segment", "sales", "ad_cost"), spec)
    return rounded(out.select("segment", F.col("bucket").cast("date").alias("bucket"), "value", "sample_size"))


TREND = """, buckets AS (
  SELECT brand, date_trunc('month', date) AS bucket, sum(sales) AS v, count(*) AS n FROM sales GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY bucket) - 1 AS x FROM buckets)
SELECT brand, round(arg_max(v, bucket), 4) AS last_value, CAST(sum(n) AS BIGINT) AS sample_size,
       round(regr_slope(v, x), 4) AS trend_slope, round(regr_intercept(v, x), 4) AS trend_intercept,
       round(regr_r2(v, x), 6) AS r_squared,
       CASE WHEN count(v) <= 1 THEN 'flat' WHEN regr_slope(v, x) > 0 THEN 'increasing' ELSE 'decreasing' END AS trend_direction
FROM numbered GROUP BY brand"""


@query(SALES + TREND)
def metric_trend(spark, folder):
    spec = MetricSpec("sales", "sales", template="SUM", scope="TEMPORAL", time="date", grain="monthly", dims=("brand",))
    buckets = M.metric_over_time(sales_view(spark, folder, "brand", "date", "sales"), spec)
    return rounded(M.trend(buckets, ["brand"]), 4, r_squared=6)


@query(
    SALES
    + """, groups AS (SELECT brand, category, avg(sales / nullif(ad_cost, 0)) AS v, count(*) AS n FROM sales GROUP BY 1, 2)
SELECT 'roas' AS metric, round(avg(coalesce(v, 0)), 6) AS value, CAST(sum(n) AS BIGINT) AS sample_size FROM groups"""
)
def metric_mean_of_groups(spark, folder):
    view = sales_view(spark, folder, "brand", "category", "sales", "ad_cost")
    return rounded(M.metric_mean_of_groups(view, ratio("SAME_ROW", "brand", "category")))


def _by_brand(name: str, spec: MetricSpec, value: str, columns: tuple[str, ...], where: str, digits: int = 6) -> None:
    def run(spark, folder):
        out = M.metric_by(sales_view(spark, folder, *spec.dims, *columns), spec, ordered=False)
        return rounded(out.select(*spec.dims, "value", "sample_size"), digits)

    dims = ", ".join(spec.dims)
    sql = SALES + f"SELECT {dims}, round({value}, {digits}) AS value, count(*) AS sample_size FROM sales WHERE {where} GROUP BY {dims}"
    register(name, run, sql)


_by_brand(
    "formula_sum", MetricSpec("sales", "sales", template="SUM", scope="DIMENSIONAL", dims=("brand",)), "sum(sales)", ("sales",), "TRUE", 4
)
_by_brand(
    "formula_mean", MetricSpec("sales", "sales", template="MEAN", scope="DIMENSIONAL", dims=("brand",)), "avg(sales)", ("sales",), "TRUE"
)
_by_brand("formula_default_mean", MetricSpec("sales", "sales", scope="DIMENSIONAL", dims=("priority",)), "avg(sales)", ("sales",), "TRUE")
_by_brand("formula_same_row", ratio("SAME_ROW", "brand"), "avg(sales / ad_cost)", ("sales", "ad_cost"), KEPT)
_by_brand("formula_unknown_scope", ratio("SOMETHING", "priority"), "avg(sales / ad_cost)", ("sales", "ad_cost"), KEPT)
_by_brand("formula_ratio_of_sums", ratio("DIMENSIONAL", "brand"), "sum(sales) / nullif(sum(ad_cost), 0)", ("sales", "ad_cost"), KEPT)
_by_brand(
    "formula_count",
    MetricSpec("lines", "sales", template="COUNT", scope="DIMENSIONAL", dims=("brand", "segment")),
    "CAST(count(*) AS DOUBLE)",
    ("sales",),
    "TRUE",
)
_by_brand(
    "formula_share_of_total",
    MetricSpec("share", "sales", "cost", "RATIO", "DIMENSIONAL", "GLOBAL_SUM", ("brand",)),
    "sum(sales) / sum(sum(cost)) OVER ()",
    ("sales", "cost"),
    "cost > 0",
    9,
)
_by_brand(
    "formula_share_of_group",
    MetricSpec("share", "sales", "cost", "RATIO", "DIMENSIONAL", "GROUP_SUM", ("category", "brand")),
    "sum(sales) / sum(sum(cost)) OVER (PARTITION BY category)",
    ("sales", "cost"),
    "cost > 0",
    9,
)
_by_brand(
    "formula_rate",
    MetricSpec("rate", "sales", template="RATE", scope="DIMENSIONAL", dims=("brand",), time="date", grain="monthly"),
    "CAST(count(*) AS DOUBLE) / count(DISTINCT date_trunc('month', date))",
    ("sales", "date"),
    "TRUE",
)

GROWTH = """, buckets AS (SELECT segment, date_trunc('month', date) AS bucket, sum(sales) AS v, count(*) AS n FROM sales GROUP BY 1, 2)
SELECT segment, CAST(bucket AS DATE) AS bucket,
       round((v - lag(v) OVER w) / nullif(lag(v) OVER w, 0) * 100, 6) AS value, n AS sample_size
FROM buckets WINDOW w AS (PARTITION BY segment ORDER BY bucket)"""


@query(SALES + GROWTH)
def formula_growth(spark, folder):
    out = motifs.velocity(sales_view(spark, folder, "segment", "date", "sales"), "sales", "date", "monthly", ["segment"])
    return rounded(out.select("segment", F.col("bucket").cast("date").alias("bucket"), "value", "sample_size"))


@query(SALES + GROWTH)
def formula_percent_change(spark, folder):
    spec = MetricSpec("sales", "sales", template="PERCENT_CHANGE", scope="TEMPORAL", time="date", grain="monthly", dims=("segment",))
    out = M.metric_over_time(sales_view(spark, folder, "segment", "date", "sales"), spec)
    return rounded(out.select("segment", F.col("bucket").cast("date").alias("bucket"), "value", "sample_size"))


@query(
    SALES
    + """SELECT brand, round(sum(sales), 4) AS sum_value, round(avg(sales), 6) AS mean_value,
       max(inventory) FILTER (date = latest) AS last_value, max(inventory) AS max_value, min(inventory) AS min_value,
       count(DISTINCT customer_id) AS distinct_value
FROM (SELECT *, max(date) OVER (PARTITION BY brand) AS latest FROM sales) GROUP BY brand"""
)
def measure_aggregations(spark, folder):
    view = sales_view(spark, folder, "brand", "sales", "inventory", "customer_id", "date")
    out = view.groupBy("brand").agg(
        M.measure("sales", "SUM").alias("sum_value"),
        M.measure("sales", "MEAN").alias("mean_value"),
        M.measure("inventory", "LAST", "date").alias("last_value"),
        M.measure("inventory", "MAX").alias("max_value"),
        M.measure("inventory", "MIN").alias("min_value"),
        M.measure("customer_id", "DISTINCT_COUNT").alias("distinct_value"),
    )
    return rounded(out, 6, sum_value=4)


@query(
    SALES
    + """SELECT segment, round(sum(sales) / count(DISTINCT customer_id), 6) AS value, count(*) AS sample_size
FROM sales GROUP BY segment"""
)
def kpi_sales_per_customer(spark, folder):
    spec = MetricSpec("arpu", "sales", "customer_id", numerator_agg="SUM", denominator_agg="DISTINCT_COUNT", sanitized=False)
    return rounded(M.kpi(sales_view(spark, folder, "segment", "sales", "customer_id"), spec, ["segment"]))


# --- motifs --------------------------------------------------------------------------

PARETO = """, sums AS (SELECT {dim}, sum(sales) AS value FROM sales GROUP BY {dim}),
ranked AS (SELECT *, sum(value) OVER () AS total, sum(value) OVER w AS running, row_number() OVER w AS rank FROM sums
           WINDOW w AS (ORDER BY value DESC, {dim} ROWS UNBOUNDED PRECEDING))
SELECT {dim}, round(value, 4) AS value, round(value / total, 9) AS share, round(running / total, 9) AS cumulative_share, rank
FROM ranked"""


def pareto_of(spark, folder, dim, **split):
    out = motifs.pareto(sales_view(spark, folder, dim, "sales"), dim, "sales", **split)
    return rounded(out, 9, value=4)


@query(SALES + PARETO.format(dim="brand"))
def pareto_brand(spark, folder):
    return pareto_of(spark, folder, "brand")


@query(SALES + PARETO.format(dim="customer_id"))
def pareto_customer(spark, folder):
    return pareto_of(spark, folder, "customer_id")


@query(SALES + PARETO.format(dim="customer_id"))
def pareto_customer_split(spark, folder):
    """The same by ranges, the way large tables go."""
    return pareto_of(spark, folder, "customer_id", window_rows=50)


@query(
    SALES
    + f"""SELECT segment, priority, round(sum(sales) / nullif(sum(ad_cost), 0), 6) AS value, count(*) AS sample_size
FROM sales WHERE {KEPT} GROUP BY 1, 2"""
)
def elasticity_by_segment(spark, folder):
    out = motifs.elasticity(sales_view(spark, folder, "segment", "priority", "sales", "ad_cost"), "ad_cost", "sales", ["segment", "priority"])
    return rounded(out.select("segment", "priority", "value", "sample_size"))


@query(
    SALES
    + """SELECT brand, round(avg(sales), 6) AS segment_average, round((SELECT avg(sales) FROM sales), 6) AS overall_average,
       round(avg(sales) / (SELECT avg(sales) FROM sales), 6) AS "index", count(*) AS sample_size
FROM sales GROUP BY brand"""
)
def benchmark_by_brand(spark, folder):
    return rounded(motifs.benchmark(sales_view(spark, folder, "brand", "sales"), "sales", ["brand"]))


@query(
    SALES
    + """, g AS (SELECT brand, CAST(count(*) AS DOUBLE) AS frequency, sum(sales) AS sales, sum(ad_cost) AS cost FROM sales GROUP BY brand),
t AS (SELECT sum(frequency) AS rows, sum(sales) AS total FROM g)
SELECT 'frequency' AS ranked_by, brand AS value, frequency AS amount, round(100 * frequency / rows, 1) AS pct
  FROM (SELECT * FROM g, t ORDER BY frequency DESC, brand LIMIT 5)
UNION ALL SELECT 'sales', brand, round(sales, 4), round(100 * sales / total, 1)
  FROM (SELECT * FROM g, t ORDER BY sales DESC, brand LIMIT 5)
UNION ALL SELECT 'cost', brand, round(cost, 4), NULL FROM (SELECT * FROM g ORDER BY cost DESC, brand LIMIT 5)"""
)
def impact_of_brand(spark, folder):
    view = sales_view(spark, folder, "brand", "sales", "ad_cost")
    return rounded(motifs.impact_metrics(view, "brand", ["ad_cost", "sales"]), 4, pct=1)


def _domain_sql() -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS member, '{m}' AS metric, sum({m}) AS amount FROM sales GROUP BY {d}"
        for d in ("brand", "category", "segment", "country")
        for m in ("sales", "inventory")
    )
    return (
        SALES
        + f""", cells AS ({cells}),
shares AS (SELECT *, amount / sum(amount) OVER (PARTITION BY dimension, metric) AS share,
                  count(*) OVER (PARTITION BY dimension, metric) AS members,
                  row_number() OVER (PARTITION BY dimension, metric ORDER BY amount DESC, member) AS rn FROM cells)
SELECT dimension, metric, max(members) AS members, round(max(share), 9) AS top_share,
       round(greatest(0, least(1, (sum(share * share) - 1e0 / max(members)) / (1 - 1e0 / max(members)))), 9) AS variance_score,
       string_agg(member, '|' ORDER BY rn) FILTER (rn <= 5) AS top_values
FROM shares GROUP BY dimension, metric"""
    )


@query(_domain_sql())
def insight_domains(spark, folder):
    dims = ["brand", "category", "segment", "country"]
    view = sales_view(spark, folder, *dims, "sales", "inventory")
    return rounded(motifs.insight_domains(view, dims, ["sales", "inventory"], 10), 9)


# --- many specs, usage ----------------------------------------------------------------

SPECS = [
    MetricSpec("sales", "sales", template="SUM", scope="DIMENSIONAL", dims=("brand",), title="Sales by brand"),
    MetricSpec("price", "sales", scope="DIMENSIONAL", dims=("brand",), title="Mean sale by brand"),
    ratio("DIMENSIONAL", "brand", title="Return by brand"),
    ratio("GLOBAL_SUM", "brand", motif="Pareto"),
    MetricSpec("sales", "sales", template="SUM", scope="DIMENSIONAL", dims=("brand",), title="Sales by brand", priority=5),
    MetricSpec("inventory", "inventory", template="SUM", filter="our_position <= 3"),
    MetricSpec("sales", "sales", template="GROWTH", scope="TEMPORAL", time="date", grain="monthly", title="Growth"),
]

RUN_SQL = (
    SALES
    + """, m AS (SELECT date_trunc('month', date) AS b, sum(sales) AS v, count(*) AS n FROM sales GROUP BY 1)
SELECT 'sales:DIMENSIONAL:brand:Sales by brand' AS spec_id, brand AS key, round(sum(sales), 4) AS value, count(*) AS sample_size FROM sales GROUP BY brand
UNION ALL SELECT 'price:DIMENSIONAL:brand:Mean sale by br', brand, round(avg(sales), 4), count(*) FROM sales GROUP BY brand
UNION ALL SELECT 'roas:DIMENSIONAL:brand:Return by brand', brand, round(sum(sales) / sum(ad_cost), 4), count(*) FROM sales WHERE ad_cost > 0 GROUP BY brand
UNION ALL SELECT 'roas:DIMENSIONAL:brand:Pareto', brand, round(sum(sales) / sum(sum(ad_cost)) OVER (), 4), count(*) FROM sales WHERE ad_cost > 0 GROUP BY brand
UNION ALL SELECT 'inventory:GLOBAL', NULL, round(sum(inventory), 4), count(*) FROM sales WHERE our_position <= 3
UNION ALL SELECT 'sales:TEMPORAL:monthly:Growth', strftime(b, '%Y-%m-%d %H:%M:%S'),
                 round((v - lag(v) OVER (ORDER BY b)) / lag(v) OVER (ORDER BY b) * 100, 4), n FROM m"""
)


def many_specs(spark, folder):
    return run_specs(sales_view(spark, folder, "date", "brand", "sales", "ad_cost", "inventory", "our_position"), SPECS)


@query(RUN_SQL)
def run_specs_bundled(spark, folder):
    flat = many_specs(spark, folder).select("spec_id", F.element_at(F.map_values("group_key"), 1).alias("key"), "value", "sample_size")
    return rounded(flat, 4)


@query(
    USAGE
    + """, prices AS (SELECT * FROM (VALUES ('model_0', 0.59e0, 0.79e0), ('model_1', 0.30e0, 0.60e0)) p(model, input_price, output_price)),
g AS (SELECT CASE WHEN grouping(phase) = 0 THEN 'phase' WHEN grouping(model) = 0 THEN 'model' ELSE 'overall' END AS level,
             coalesce(phase, model, 'all') AS name, count(*) AS calls, CAST(sum(input_units) AS BIGINT) AS input_units,
             CAST(sum(output_units) AS BIGINT) AS output_units FROM calls GROUP BY GROUPING SETS ((phase), (model), ()))
SELECT level, name, calls, input_units, output_units, input_units + output_units AS total_units,
       round(CASE WHEN level = 'model' THEN input_units / 1e6 * input_price + output_units / 1e6 * output_price END, 9) AS cost
FROM g LEFT JOIN prices ON level = 'model' AND name = model"""
)
def usage_by_phase_and_model(spark, folder):
    rows = [(f"model_{i}", p_in, p_out) for i, (_, p_in, p_out) in enumerate(USAGE_PRICES)]
    prices = spark.createDataFrame(rows, "model string, input_price double, output_price double")
    return rounded(motifs.usage_rollup(usage_view(spark, folder), prices), 9)


# --- derived ratios -------------------------------------------------------------------

# Metric → (view, the two columns).
DERIVED_ON = {
    "ROAS": ("sales", "sales", "ad_cost"),
    "CPA": ("funnel", "spend", "conversions"),
    "CTR": ("funnel", "clicks", "impressions"),
    "CVR": ("funnel", "conversions", "clicks"),
    "Margin": ("sales", "sales", "cost"),
    "GrossMargin": ("sales", "sales", "cost"),
    "NetMargin": ("sales", "ad_cost", "sales"),
    "ROI": ("sales", "sales", "cost"),
    "CAC": ("funnel", "spend", "signups"),
    "LTV_CAC": ("funnel", "revenue", "spend"),
    "InventoryTurnover": ("sales", "cost", "inventory"),
    "GrowthRate": ("funnel", "revenue", "spend"),
    "CPC": ("funnel", "spend", "clicks"),
    "BounceRate": ("funnel", "errors", "impressions"),
    "FulfillmentRate": ("funnel", "conversions", "signups"),
    "UtilizationRate": ("sales", "our_position", "inventory"),
}


def _derived(name: str, view: str, a: str, b: str) -> None:
    key = "brand" if view == "sales" else "day"
    formula = D.DERIVED_METRICS[name][2].__name__
    top = {"_quotient": "{a}", "_rest_of_first": "({a} - {b})", "_excess_over_second": "({a} - {b})"}[formula]
    bottom = "{a}" if formula == "_rest_of_first" else "{b}"
    sums = {"a": f"CAST(sum({a}) AS DOUBLE)", "b": f"CAST(sum({b}) AS DOUBLE)"}
    row = {"a": f"CAST({a} AS DOUBLE)", "b": f"CAST({b} AS DOUBLE)"}

    def load(spark, folder):
        return sales_view(spark, folder, "brand", a, b) if view == "sales" else funnel_view(spark, folder)

    def by_group(spark, folder):
        return rounded(D.derive(load(spark, folder), name, (a, b), "group", [key]))

    def by_row(spark, folder):
        values = D.derive(load(spark, folder), name, (a, b)).groupBy(key)
        return rounded(values.agg(F.count("value").alias("rows_with_value"), F.avg("value").alias("mean_value")), 4)

    prefix = SALES if view == "sales" else FUNNEL
    ratio_of = f"{top} / nullif({bottom}, 0)"
    register(
        f"derived_{name.lower()}",
        by_group,
        prefix + f"SELECT {key}, round({ratio_of.format(**sums)}, 6) AS value FROM {view} GROUP BY {key}",
    )
    register(
        f"derived_{name.lower()}_rows",
        by_row,
        prefix
        + f"""SELECT {key}, count({ratio_of.format(**row)}) AS rows_with_value, round(avg({ratio_of.format(**row)}), 4) AS mean_value
FROM {view} GROUP BY {key}""",
    )


for _name, (_view, _a, _b) in DERIVED_ON.items():
    _derived(_name, _view, _a, _b)
