"""Series and forecast queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import fits as X
from plumbline.operators import forecast as FC
from plumbline.operators import series as T
from plumbline.queries.registry import ORACLES, SALES, normal_cdf_sql, query, register, rounded
from plumbline.sources.views import sales_view, table

# Monthly sales per brand; whole tables, so every brand is a series of its own. The first
# nine months of one brand stand for a newcomer, whose series is too short for a forecast.
NEW, UNTIL = "Brand#11", "1995-10-01"
BUCKETS = (
    SALES
    + f""", sold AS (SELECT brand, date, sales, cost FROM sales
  UNION ALL SELECT brand || ' new', date, sales, cost FROM sales WHERE brand = '{NEW}' AND date < DATE '{UNTIL}'),
points AS (SELECT brand, date_trunc('month', date) AS bucket, sum(sales) AS value, sum(cost) AS cost FROM sold WHERE date IS NOT NULL GROUP BY 1, 2),
counted AS (SELECT *, count(*) OVER (PARTITION BY brand) AS n FROM points WHERE value IS NOT NULL),
series AS (SELECT * FROM counted WHERE n >= 10)
"""
)


def monthly(spark, folder, exog=()):
    view = sales_view(spark, folder, "brand", "date", "sales", *exog)
    # A row of the newcomer counts for both; the joins behind the view run once.
    new = (F.col("brand") == NEW) & (F.col("date") < UNTIL)
    brands = F.when(new, F.array("brand", F.concat("brand", F.lit(" new")))).otherwise(F.array("brand"))
    return T.to_series(view.withColumn("brand", F.explode(brands)), "sales", "date", "monthly", ["brand"], exog=exog)


@query(BUCKETS + "SELECT brand, CAST(bucket AS DATE) AS bucket, round(value, 4) AS value, n AS points FROM counted")
def series_prepared(spark, folder):
    out = monthly(spark, folder)
    return rounded(out.select("brand", F.col("bucket").cast("date").alias("bucket"), "value", "points"), 4)


def frequency_sql(source: str, by: str) -> str:
    return f""", g AS (SELECT {by}, epoch(bucket) - epoch(lag(bucket) OVER (PARTITION BY {by} ORDER BY bucket)) AS gap FROM {source}),
m AS (SELECT *, quantile_cont(gap, 0.5) OVER (PARTITION BY {by}) AS med FROM g),
f AS (SELECT {by}, max(med) AS median_gap_seconds, count(*) FILTER (gap > 2 * med) AS gaps_detected FROM m GROUP BY {by})
SELECT {by}, CAST(median_gap_seconds AS DOUBLE) AS median_gap_seconds, gaps_detected,
  CASE WHEN median_gap_seconds <= 86400 THEN 'daily' WHEN median_gap_seconds <= 7 * 86400 THEN 'weekly' WHEN median_gap_seconds <= 31 * 86400 THEN 'monthly' ELSE 'unknown' END AS frequency,
  CASE WHEN median_gap_seconds <= 86400 THEN 7 WHEN median_gap_seconds <= 7 * 86400 THEN 52 ELSE 12 END AS seasonal_period,
  CASE WHEN median_gap_seconds IS NULL THEN 0.3e0 WHEN gaps_detected < 3 THEN 0.9e0 ELSE 0.6e0 END AS confidence FROM f"""


@query(BUCKETS + frequency_sql("counted", "brand"))
def series_frequency_monthly(spark, folder):
    return T.series_frequency(monthly(spark, folder), ["brand"])


# Daily orders per priority with every twentieth day (by hash) taken out.
GAPPY = """WITH days AS (SELECT o_orderpriority AS priority, date_trunc('day', o_orderdate) AS bucket, sum(o_totalprice) AS value FROM orders
  WHERE (CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) * 48271) % 2147483647 % 20 <> 0 GROUP BY 1, 2)
"""


@query(GAPPY + frequency_sql("days", "priority"))
def series_frequency_gaps(spark, folder):
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    kept = table(spark, folder, "orders").filter((day * 48271) % 2147483647 % 20 != 0)
    series = T.to_series(kept.withColumnRenamed("o_orderpriority", "priority"), "o_totalprice", "o_orderdate", "daily", ["priority"])
    return T.series_frequency(series, ["priority"])


ACF = """, d AS (SELECT brand, value - avg(value) OVER (PARTITION BY brand) AS d, count(*) OVER (PARTITION BY brand) AS cnt,
  row_number() OVER (PARTITION BY brand ORDER BY bucket) AS i FROM counted),
v AS (SELECT brand, max(cnt) AS n, sum(d * d) AS s2 FROM d GROUP BY brand),
a AS (SELECT x.brand, y.i - x.i AS lag, sum(x.d * y.d) AS c FROM d x JOIN d y ON x.brand = y.brand AND y.i > x.i AND y.i - x.i <= 20 GROUP BY 1, 2),
acf AS (SELECT brand, n, CAST(lag AS INT) AS lag, c / s2 AS acf FROM a JOIN v USING (brand) WHERE lag <= n // 2)
"""


@query(BUCKETS + ACF + "SELECT brand, n, lag, round(acf, 9) AS acf FROM acf")
def series_autocorrelation(spark, folder):
    return rounded(T.autocorrelation(monthly(spark, folder), ["brand"]), 9)


@query(
    BUCKETS
    + ACF
    + """SELECT brand, n, round(1.96e0 / sqrt(n), 9) AS confidence_band, n >= 24 AND count(*) FILTER (abs(acf) > 1.96e0 / sqrt(n)) > 0 AS seasonal,
  coalesce(string_agg(lag::VARCHAR, ',' ORDER BY lag) FILTER (n >= 24 AND abs(acf) > 1.96e0 / sqrt(n)), '') AS significant_lags
FROM v LEFT JOIN (SELECT brand, lag, acf FROM acf) USING (brand) GROUP BY brand, n"""
)
def series_seasonality(spark, folder):
    found = T.seasonality(monthly(spark, folder), ["brand"])
    return rounded(found.withColumn("significant_lags", F.array_join("significant_lags", ",")), 9)


@query(
    BUCKETS
    + """, q AS (SELECT brand, row_number() OVER (PARTITION BY brand ORDER BY bucket) AS step, value, n FROM counted),
f AS (SELECT brand, max(n) AS n, count(*) AS periods, sum(value) AS total, regr_slope(value, step) / nullif(avg(value), 0) * 100 AS pct, max(value) / 1000 AS aic FROM q GROUP BY brand)
SELECT brand, round(total, 4) AS forecast_total, CASE WHEN periods < 2 THEN 'flat' WHEN pct > 5 THEN 'up' WHEN pct < -5 THEN 'down' ELSE 'flat' END AS trend_direction,
  round(greatest(0, least(1, 0.5e0 + CASE WHEN aic < 3000 THEN 0.2e0 ELSE 0 END + CASE WHEN n > 50 THEN 0.2e0 WHEN n > 30 THEN 0.1e0 ELSE 0 END - CASE WHEN aic > 2 * n THEN 0.1e0 ELSE 0 END)), 6) AS model_confidence,
  CASE WHEN aic < 3000 AND n <= 2 AND aic <= 1000 THEN 'no remarks' ELSE coalesce(nullif(concat_ws('; ',
    CASE WHEN NOT aic < 3000 THEN 'series not stationary, differences were modelled' END, CASE WHEN n > 2 THEN n || ' gaps in time' END,
    CASE WHEN aic > 1000 THEN 'poor information criterion' END), ''), 'no remarks') END AS notes FROM f"""
)
def forecast_grading(spark, folder):
    """Direction, confidence and notes rules on figures that SQL can repeat."""
    keyed = W.partitionBy("brand")
    steps = monthly(spark, folder).select(
        "brand",
        F.row_number().over(keyed.orderBy("bucket")).alias("step"),
        F.col("value").alias("forecast"),
        F.lit("given").alias("model"),
        F.count("*").over(keyed).alias("n"),
        (F.max("value").over(keyed) / 1000).alias("aic"),
        F.lit(0.0).alias("bic"),
        F.lit("monthly").alias("frequency"),
    )
    steps = steps.withColumn("is_stationary", F.col("aic") < 3000).withColumn("gaps_detected", F.col("n"))
    steps = steps.withColumn("status", F.lit("ok")).withColumn("reason", F.lit(None).cast("string"))
    out = FC.summarize_forecast(steps, ["brand"])
    return rounded(out.select("brand", "forecast_total", "trend_direction", "model_confidence", "notes"), 6, forecast_total=4)


# --- models with given weights, so that SQL can repeat the recursion ----------------------

ROOT = """, d AS (SELECT brand, value - lag(value) OVER w AS dy, lag(value) OVER w AS y0, count(*) OVER (PARTITION BY brand) AS cnt FROM series
  WINDOW w AS (PARTITION BY brand ORDER BY bucket)),
f AS (SELECT brand, max(cnt) AS n, count(*) AS m, regr_slope(dy, y0) AS b, sqrt((1 - regr_r2(dy, y0)) * regr_syy(dy, y0) / (count(*) - 2) / regr_sxx(dy, y0)) AS se
  FROM d WHERE y0 IS NOT NULL GROUP BY brand),
t AS (SELECT brand, n, b / se AS t FROM f),
z AS (SELECT *, CASE WHEN t <= -1.61 THEN 2.1659e0 + 1.4412e0 * t + 0.038269e0 * t * t
  ELSE 1.7339e0 + 0.93202e0 * t - 0.12745e0 * t * t - 0.010368e0 * t * t * t END AS z FROM t)
"""


@query(
    BUCKETS
    + ROOT
    + f"""SELECT brand, n, round(t, 6) AS adf_statistic, round(CASE WHEN t < -18.83 THEN 0e0 ELSE {normal_cdf_sql('greatest(z.z, -30e0)')} END, 6) AS adf_p,
  CASE WHEN t < -18.83 THEN TRUE ELSE {normal_cdf_sql('greatest(z.z, -30e0)')} < 0.05 END AS is_stationary FROM z
UNION ALL SELECT DISTINCT brand, n, NULL, 1e0, FALSE FROM counted WHERE n < 10"""
)
def stationarity_without_lags(spark, folder):
    return rounded(FC.adf(monthly(spark, folder), ["brand"], max_lag=0).drop("adf_lag", "critical_values"))


WITH_SERIES = BUCKETS.replace("WITH sales", "WITH RECURSIVE sales", 1)


def given(spark, folder, model: str, weights, difference: int):
    fits = FC.fit_models(monthly(spark, folder), 12, ["brand"], models=[model], weights={model: weights}, difference=difference)
    return fits.filter("status = 'ok'").select("brand", "step", "forecast", "lower", "upper", "aic", "bic")


@query(
    WITH_SERIES
    + """, w AS (SELECT brand, i, value - lag(value) OVER (PARTITION BY brand ORDER BY i) AS w, value FROM (
  SELECT brand, value, row_number() OVER (PARTITION BY brand ORDER BY bucket) - 1 AS i FROM series)),
e AS (SELECT brand, i, w, 0e0 AS e FROM w WHERE i = 1
  UNION ALL SELECT n.brand, n.i, n.w, n.w - 0.5e0 * e.w - 0.2e0 * e.e FROM e JOIN w n ON n.brand = e.brand AND n.i = e.i + 1),
s AS (SELECT brand, count(*) - 1 AS m, sum(e * e) AS sse, arg_max(w, i) AS w_last, arg_max(e, i) AS e_last FROM e GROUP BY brand),
l AS (SELECT brand, arg_max(value, i) AS y_last FROM w GROUP BY brand),
psi AS (SELECT k, 1 + 0.7e0 * (1 - pow(0.5e0, k)) / 0.5e0 AS psi FROM range(12) r(k)),
f AS (SELECT s.brand, h.step, y_last + (0.5e0 * w_last + 0.2e0 * e_last) * (1 - pow(0.5e0, h.step)) / 0.5e0 AS mean,
  1.96e0 * sqrt(sse / m * (SELECT sum(psi * psi) FROM psi WHERE k < h.step)) AS half, (m + 2) * (ln(2 * pi() * sse / m) + 1) AS level, m + 2 AS m
  FROM s JOIN l USING (brand), range(1, 13) h(step))
SELECT brand, CAST(step AS INT) AS step, round(mean, 4) AS forecast, round(mean - half, 4) AS lower, round(mean + half, 4) AS upper,
  round(level + 6, 4) AS aic, round(level + 3 * ln(m), 4) AS bic FROM f"""
)
def forecast_arima_given(spark, folder):
    return rounded(given(spark, folder, "arima", (0.5, 0.2), 1), 4)


@query(
    WITH_SERIES
    + """, v AS (SELECT brand, list(value ORDER BY bucket) AS y FROM series GROUP BY brand HAVING count(*) >= 24),
b AS (SELECT brand, y, len(y) AS n, list_avg(y[1:12]) AS a1, (list_avg(y[13:24]) - list_avg(y[1:12])) / 12 AS slope FROM v),
r AS (SELECT brand, y, n, 0 AS t, a1 - slope * 13 / 2 AS level, slope AS trend,
    list_transform(range(12), lambda k: y[k + 1] - (a1 + slope * (k - 5.5e0))) AS seasons, 0e0 AS sse FROM b
  UNION ALL
  SELECT brand, y, n, t + 1, nl, 0.1e0 * (nl - level) + 0.9e0 * trend,
    list_transform(range(12), lambda k: CASE WHEN k = t % 12 THEN 0.2e0 * (y[t + 1] - nl) + 0.8e0 * seasons[k + 1] ELSE seasons[k + 1] END),
    sse + pow(y[t + 1] - level - trend - seasons[t % 12 + 1], 2)
  FROM (SELECT *, 0.3e0 * (y[t + 1] - seasons[t % 12 + 1]) + 0.7e0 * (level + trend) AS nl FROM r WHERE t < n)),
last AS (SELECT * FROM r WHERE t = n),
f AS (SELECT brand, h.step, level + trend * h.step + seasons[(n + h.step - 1) % 12 + 1] AS mean, n, n * (ln(2 * pi() * sse / n) + 1) AS base,
  1.96e0 * sqrt(sse / n * (1 + coalesce((SELECT sum(pow(0.3e0 * (1 + 0.1e0 * k) + CASE WHEN k % 12 = 0 THEN 0.2e0 * 0.7e0 ELSE 0 END, 2)) FROM range(1, 12) q(k) WHERE k < h.step), 0))) AS half
  FROM last, range(1, 13) h(step))
SELECT brand, CAST(step AS INT) AS step, round(mean, 4) AS forecast, round(mean - half, 4) AS lower, round(mean + half, 4) AS upper,
  round(base + 34, 4) AS aic, round(base + 17 * ln(n), 4) AS bic FROM f"""
)
def forecast_ets_given(spark, folder):
    return rounded(given(spark, folder, "ets", (0.3, 0.1, 0.2), 0), 4)


ARIMA_GIVEN, ETS_GIVEN = ORACLES["forecast_arima_given"], ORACLES["forecast_ets_given"]


@query(
    f"""SELECT brand, model, step, forecast, aic FROM (
  SELECT *, rank() OVER (PARTITION BY brand ORDER BY aic, model) AS place FROM (
    SELECT 'arima' AS model, * FROM ({ARIMA_GIVEN}) UNION ALL BY NAME SELECT 'ets' AS model, * FROM ({ETS_GIVEN})))
WHERE place = 1"""
)
def forecast_lowest_aic(spark, folder):
    weights = {"arima": (0.5, 0.2), "ets": (0.3, 0.1, 0.2)}
    fits = FC.fit_models(monthly(spark, folder), 12, ["brand"], models=list(weights), weights=weights, difference=1)
    return rounded(FC.best_model(fits, ["brand"]).filter("status = 'ok'").select("brand", "model", "step", "forecast", "aic"), 4)


# --- lag by AIC and searched weights ------------------------------------------------


def _sweep_sql(name: str, start: str, steps: str) -> str:
    """Columns regressed out one after another as in fits.swept; ``start`` has brand, m, cols."""
    return f""", {name}_r AS (
  SELECT brand, m, 0 AS k, cols, CAST([] AS DOUBLE[]) AS sse FROM {start}
  UNION ALL
  SELECT brand, m, k + 1, left_over, list_append(sse, list_inner_product(left_over[-1], left_over[-1]))
  FROM (SELECT r.brand, r.m, k, r.sse, list_transform(r.cols[2:], lambda c: list_transform(range(1, r.m + 1), lambda i: c[i]
          - r.cols[1][i] * CASE WHEN list_inner_product(r.cols[1], r.cols[1]) > 1e-12
                           THEN list_inner_product(c, r.cols[1]) / list_inner_product(r.cols[1], r.cols[1]) ELSE 0 END)) AS left_over
        FROM {name}_r r JOIN {start} s ON r.brand = s.brand WHERE k < s.{steps})),
{name} AS (SELECT * FROM {name}_r QUALIFY k = max(k) OVER (PARTITION BY brand))"""


ADF = (
    """, folded AS (SELECT brand, list(value ORDER BY bucket) AS y, count(*) AS n FROM series GROUP BY brand),
held AS (
  SELECT *, CAST(greatest(0, least(ceil(12 * pow(n / 100, 0.25)), floor(n / 2) - 2)) AS BIGINT) AS most,
         list_transform(range(1, n), lambda i: y[i + 1] - y[i]) AS dy FROM folded),
first AS (
  SELECT brand, n - 1 - most AS m, most + 2 AS steps, most,
         list_concat([list_transform(range(1, n - most), lambda i: 1e0), y[most + 1:n - 1]],
                     list_transform(range(1, most + 1), lambda j: dy[most + 1 - j:n - 1 - j]), [dy[most + 1:n - 1]]) AS cols FROM held)"""
    + _sweep_sql("common", "first", "steps")
    + """, picked AS (
  SELECT c.brand, list_transform(range(0, most + 1), lambda p: c.m * (ln(2 * pi() * greatest(c.sse[p + 2] / c.m, 1e-300)) + 1) + 2 * (p + 2)) AS aic
  FROM common c JOIN first f ON c.brand = f.brand),
lagged AS (SELECT brand, list_position(aic, list_min(aic)) - 1 AS lag FROM picked),
second AS (
  SELECT h.brand, n - 1 - lag AS m, lag + 1 AS steps, lag,
         list_concat([list_transform(range(1, n - lag), lambda i: 1e0)],
                     list_transform(range(1, lag + 1), lambda j: dy[lag + 1 - j:n - 1 - j]), [y[lag + 1:n - 1], dy[lag + 1:n - 1]]) AS cols
  FROM held h JOIN lagged l ON h.brand = l.brand)"""
    + _sweep_sql("own", "second", "steps")
    + """, b AS (
  SELECT o.brand, lag, o.m - lag - 2 AS free, list_inner_product(o.cols[1], o.cols[1]) AS size,
         list_inner_product(o.cols[1], o.cols[2]) / list_inner_product(o.cols[1], o.cols[1]) AS beta, o.cols AS cols, o.m AS m
  FROM own o JOIN second s ON o.brand = s.brand),
t AS (
  SELECT brand, lag, beta / sqrt(list_sum(list_transform(range(1, m + 1), lambda i: pow(cols[2][i] - beta * cols[1][i], 2))) / free / size) AS t FROM b),
z AS (SELECT *, CASE WHEN t <= -1.61 THEN 2.1659e0 + 1.4412e0 * t + 0.038269e0 * t * t
  ELSE 1.7339e0 + 0.93202e0 * t - 0.12745e0 * t * t - 0.010368e0 * t * t * t END AS z FROM t),
root AS (SELECT brand, lag, t, CASE WHEN t < -18.83 THEN 0e0 ELSE """
    + normal_cdf_sql("greatest(z.z, -30e0)")
    + """ END AS p FROM z)
"""
)


@query(
    WITH_SERIES
    + ADF
    + f"""SELECT root.brand, n, round(t, 4) AS adf_statistic, abs(round(p, 4)) AS adf_p, p < 0.05 AS is_stationary, CAST(lag AS INT) AS adf_lag,
  {", ".join(f"round({a}e0 + {b}e0 / (n - 1 - lag) + {c}e0 / pow(n - 1 - lag, 2) + {d}e0 / pow(n - 1 - lag, 3), 4) AS critical_{name[:-1]}" for name, (a, b, c, d) in FC.CRITICAL.items())}
FROM root JOIN folded ON root.brand = folded.brand
UNION ALL SELECT DISTINCT brand, n, NULL, 1e0, FALSE, NULL, NULL, NULL, NULL FROM counted WHERE n < 10"""
)
def stationarity(spark, folder):
    tested = FC.adf(monthly(spark, folder), ["brand"])
    levels = [F.col("critical_values")[name].alias(f"critical_{name[:-1]}") for name in FC.CRITICAL]
    return rounded(tested.select("*", *levels).drop("critical_values"), 4)


def _model(name: str, model: str, exog=(), sql: str | None = None) -> None:
    def run(spark, folder):
        steps = FC.forecast(monthly(spark, folder, exog), 12, ["brand"], exog, model).filter("status = 'ok'")
        return rounded(steps.select("brand", "model", "step", "forecast", "lower", "upper", "aic", "bic"), 2)

    register(name, run, sql)


def forecast_summary(spark, folder):
    return rounded(FC.summarize_forecast(FC.forecast(monthly(spark, folder), 12, ["brand"]), ["brand"]), 2)


def scenario_impact(spark, folder):
    return rounded(FC.simulate(monthly(spark, folder, ["cost"]), "cost", 20.0, 12, ["brand"]), 2)


_axis = lambda values: "[" + ", ".join(f"{v}e0" for v in values) + "]"
ARIMA_FIT = (
    ADF
    + f""", zs AS (
  SELECT f.brand, f.y, CASE WHEN p < 0.05 THEN 0 ELSE 1 END AS d, CASE WHEN p < 0.05 THEN f.y ELSE h.dy END AS z
  FROM folded f JOIN root ON f.brand = root.brand JOIN held h ON f.brand = h.brand),
ws AS (
  SELECT brand, y, d, CASE WHEN d = 0 THEN list_avg(z) ELSE 0 END AS centre,
         list_transform(z, lambda v: v - CASE WHEN d = 0 THEN list_avg(z) ELSE 0 END) AS w FROM zs),
ar AS (
  SELECT brand, phi, theta, 1::BIGINT AS i, 0e0 AS e, 0e0 AS sse
  FROM ws, unnest({_axis(X.ARMA_STARTS)}) p(phi), unnest({_axis(X.ARMA_STARTS)}) q(theta)
  UNION ALL
  SELECT brand, phi, theta, i + 1, e1, sse + e1 * e1
  FROM (SELECT ar.brand, phi, theta, i, sse, w[i + 1] - phi * w[i] - theta * e AS e1 FROM ar JOIN ws ON ar.brand = ws.brand WHERE i < len(w))),
a0 AS (
  SELECT ar.brand, phi, theta FROM ar JOIN ws ON ar.brand = ws.brand WHERE i = len(w)
  QUALIFY row_number() OVER (PARTITION BY ar.brand ORDER BY sse, phi, theta) = 1),
al AS (
  SELECT brand, 0 AS it, 1::BIGINT AS i, phi AS x, theta AS y, 0e0 AS e, 0e0 AS p, 0e0 AS q,
         {{'sse': 0e0, 'pp': 0e0, 'pq': 0e0, 'qq': 0e0, 'pe': 0e0, 'qe': 0e0}} AS r, {X.DAMPING * 10}e0 AS damping, phi, theta,
         {{'sse': 1e308, 'pp': 0e0, 'pq': 0e0, 'qq': 0e0, 'pe': 0e0, 'qe': 0e0}} AS best FROM a0
  UNION ALL
  SELECT * FROM (SELECT brand, it, i + 1, x, y, e1, p1, q1,
         {{'sse': r.sse + e1 * e1, 'pp': r.pp + p1 * p1, 'pq': r.pq + p1 * q1, 'qq': r.qq + q1 * q1, 'pe': r.pe + p1 * e1, 'qe': r.qe + q1 * e1}},
         damping, phi, theta, best
  FROM (SELECT al.*, w[i + 1] - x * w[i] - al.y * e AS e1, -w[i] - al.y * p AS p1, -e - al.y * q AS q1 FROM al JOIN ws ON al.brand = ws.brand WHERE i < len(w))
  UNION ALL
  SELECT brand, it + 1, 1, CASE WHEN det > 1e-300 THEN least({X.BOUND}e0, greatest(-{X.BOUND}e0, phi + (b.qe * b.pq - b.pe * b.qq * more) / det)) ELSE phi END,
         CASE WHEN det > 1e-300 THEN least({X.BOUND}e0, greatest(-{X.BOUND}e0, theta + (b.pe * b.pq - b.qe * b.pp * more) / det)) ELSE theta END,
         0e0, 0e0, 0e0, {{'sse': 0e0, 'pp': 0e0, 'pq': 0e0, 'qq': 0e0, 'pe': 0e0, 'qe': 0e0}}, damping, phi, theta, b
  FROM (SELECT *, 1 + damping AS more, b.pp * (1 + damping) * b.qq * (1 + damping) - b.pq * b.pq AS det FROM (
    SELECT al.brand, it, CASE WHEN r.sse < best.sse THEN x ELSE phi END AS phi, CASE WHEN r.sse < best.sse THEN al.y ELSE theta END AS theta,
           CASE WHEN r.sse < best.sse THEN r ELSE best END AS b, CASE WHEN r.sse < best.sse THEN damping * 0.1e0 ELSE damping * 10e0 END AS damping
    FROM al JOIN ws ON al.brand = ws.brand WHERE i = len(w) AND it <= {X.STEPS})))),
aw AS (
  SELECT brand, round(phi, {X.DECIMALS}) AS phi, round(theta, {X.DECIMALS}) AS theta FROM al WHERE it = {X.STEPS} + 1 AND i = 1),
ae AS (
  SELECT brand, 1::BIGINT AS i, 0e0 AS e, 0e0 AS sse FROM aw
  UNION ALL
  SELECT brand, i + 1, e1, sse + e1 * e1 FROM (
    SELECT ae.brand, i, sse, w[i + 1] - phi * w[i] - theta * e AS e1 FROM ae JOIN ws ON ae.brand = ws.brand JOIN aw ON ae.brand = aw.brand WHERE i < len(w))),
am AS (
  SELECT ae.brand, phi, theta, e, sse, y, d, centre, w, len(w) - 1 AS m FROM ae JOIN ws ON ae.brand = ws.brand JOIN aw ON ae.brand = aw.brand WHERE i = len(w)),
ap AS (
  SELECT am.*, step, (phi * w[-1] + theta * e) * pow(phi, step - 1) AS move,
         CASE WHEN step = 1 THEN 1 ELSE (phi + theta) * pow(phi, step - 2) END AS psi FROM am, range(1, 13) h(step)),
aq AS (SELECT *, sum(move) OVER s AS moved, CASE WHEN d = 1 THEN sum(psi) OVER s ELSE psi END AS shock FROM ap WINDOW s AS (PARTITION BY brand ORDER BY step)),
arima AS (
  SELECT brand, 'arima' AS model, CAST(step AS INT) AS step, CASE WHEN d = 1 THEN y[-1] + moved ELSE centre + move END AS mean,
         1.96e0 * sqrt(sse / m * sum(shock * shock) OVER (PARTITION BY brand ORDER BY step)) AS half,
         len(y) * (ln(2 * pi() * greatest(sse / m, 1e-300)) + 1) AS level, len(y) AS m, CASE WHEN d = 1 THEN 3 ELSE 4 END AS k FROM aq)
"""
)
SHOWN = """SELECT brand, model, step, round(mean, 2) AS forecast, round(mean - half, 2) AS lower, round(mean + half, 2) AS upper,
  round(level + 2 * k, 2) AS aic, round(level + k * ln(m), 2) AS bic FROM """

# Shares of an error for level, trend and season; the queue of seasons starts with the next one.
ETS_STEP = "list_append(seasons[2:], seasons[1] + c * e)"
_STARTS = ", ".join(f"[{x}e0, {y}e0, {z}e0]" for x, y, z in (X.shares(a, b, c) for a in X.LEVEL_STARTS for b in X.TREND_STARTS for c in X.SEASON_STARTS))
_ZERO = "{'sse': 0e0, " + ", ".join(f"'{p}': 0e0" for p in ("ae", "be", "ce", "aa", "ab", "ac", "bb", "bc", "cc")) + "}"
_NONE = "[" + ", ".join(["0e0"] * 12) + "]"
ETS_FIT = f""", ev AS (SELECT brand, list(value ORDER BY bucket) AS y, count(*) AS n FROM series GROUP BY brand HAVING count(*) >= 24),
ea AS (SELECT *, list_avg(y[1:12]) AS a1, (list_avg(y[13:24]) - list_avg(y[1:12])) / 12 AS slope FROM ev),
eb AS (
  SELECT brand, y, n, a1 - slope * 13 / 2 AS level0, slope, list_transform(range(12), lambda k: y[k + 1] - (a1 + slope * (k - 5.5e0))) AS seasons0 FROM ea),
es AS (
  SELECT brand, w[1] AS a, w[2] AS b, w[3] AS c, 0::BIGINT AS t, level0 AS lvl, slope AS trend, seasons0 AS seasons, 0e0 AS sse
  FROM eb, unnest([{_STARTS}]) p(w)
  UNION ALL
  SELECT brand, a, b, c, t + 1, lvl + trend + a * e, trend + b * e, {ETS_STEP}, sse + e * e
  FROM (SELECT es.*, eb.y[t + 1] - lvl - trend - seasons[1] AS e FROM es JOIN eb ON es.brand = eb.brand WHERE t < n)),
e0 AS (SELECT es.brand, a, b, c FROM es JOIN eb ON es.brand = eb.brand WHERE t = n QUALIFY row_number() OVER (PARTITION BY es.brand ORDER BY sse, a, b, c) = 1),
el AS (
  SELECT e0.brand, 0 AS it, 0::BIGINT AS t, a, b, c, level0 AS lvl, slope AS trend, seasons0 AS seasons,
         [0e0, 0e0, 0e0] AS lv, [0e0, 0e0, 0e0] AS tr, {_NONE} AS sa, {_NONE} AS sb, {_NONE} AS sc, {_ZERO} AS r,
         {X.DAMPING * 10}e0 AS damping, a AS a0, b AS b0, c AS c0, struct_update({_ZERO}, sse := 1e308) AS best
  FROM e0 JOIN eb ON e0.brand = eb.brand
  UNION ALL
  SELECT * FROM (SELECT brand, it, t + 1, a, b, c, lvl + trend + a * e, trend + b * e, {ETS_STEP},
         [lv[1] + tr[1] + (e + a * da), lv[2] + tr[2] + a * db, lv[3] + tr[3] + a * dc], [tr[1] + b * da, tr[2] + (e + b * db), tr[3] + b * dc],
         list_append(sa[2:], sa[1] + c * da), list_append(sb[2:], sb[1] + c * db), list_append(sc[2:], sc[1] + (e + c * dc)),
         {{'sse': r.sse + e * e, 'ae': r.ae + da * e, 'be': r.be + db * e, 'ce': r.ce + dc * e, 'aa': r.aa + da * da, 'ab': r.ab + da * db,
           'ac': r.ac + da * dc, 'bb': r.bb + db * db, 'bc': r.bc + db * dc, 'cc': r.cc + dc * dc}}, damping, a0, b0, c0, best
  FROM (SELECT el.*, eb.y[t + 1] - lvl - trend - seasons[1] AS e, -(lv[1] + tr[1] + sa[1]) AS da, -(lv[2] + tr[2] + sb[1]) AS db,
               -(lv[3] + tr[3] + sc[1]) AS dc FROM el JOIN eb ON el.brand = eb.brand WHERE t < n)
  UNION ALL
  SELECT brand, it + 1, 0, na, least(na, greatest(0e0, b0 - CASE WHEN det > 1e-300 THEN db / det ELSE 0 END)), least(1 - na, nc),
         level0, slope, seasons0, [0e0, 0e0, 0e0], [0e0, 0e0, 0e0], {_NONE}, {_NONE}, {_NONE}, {_ZERO}, damping, a0, b0, c0, g
  FROM (SELECT *, greatest(1 - {X.BOUND}e0, ra - greatest(0e0, ra + rc - 1) / 2) AS na, greatest(0e0, rc - greatest(0e0, ra + rc - 1) / 2) AS nc FROM (
   SELECT *, least({X.BOUND}e0, greatest(1 - {X.BOUND}e0, a0 - CASE WHEN det > 1e-300 THEN da / det ELSE 0 END)) AS ra,
          least(1e0, greatest(0e0, c0 - CASE WHEN det > 1e-300 THEN dc / det ELSE 0 END)) AS rc FROM (
    SELECT *, aa * (bb * cc - g.bc * g.bc) - g.ab * (g.ab * cc - g.bc * g.ac) + g.ac * (g.ab * g.bc - bb * g.ac) AS det,
           g.ae * (bb * cc - g.bc * g.bc) - g.ab * (g.be * cc - g.bc * g.ce) + g.ac * (g.be * g.bc - bb * g.ce) AS da,
           aa * (g.be * cc - g.bc * g.ce) - g.ae * (g.ab * cc - g.bc * g.ac) + g.ac * (g.ab * g.ce - g.be * g.ac) AS db,
           aa * (bb * g.ce - g.be * g.bc) - g.ab * (g.ab * g.ce - g.be * g.ac) + g.ae * (g.ab * g.bc - bb * g.ac) AS dc FROM (
      SELECT *, g.aa * (1 + damping) AS aa, g.bb * (1 + damping) AS bb, g.cc * (1 + damping) AS cc FROM (
        SELECT el.brand, it, level0, slope, seasons0, CASE WHEN r.sse < best.sse THEN a ELSE a0 END AS a0, CASE WHEN r.sse < best.sse THEN b ELSE b0 END AS b0,
               CASE WHEN r.sse < best.sse THEN c ELSE c0 END AS c0, CASE WHEN r.sse < best.sse THEN r ELSE best END AS g,
               CASE WHEN r.sse < best.sse THEN damping * 0.1e0 ELSE damping * 10e0 END AS damping
        FROM el JOIN eb ON el.brand = eb.brand WHERE t = n AND it <= {X.STEPS}))))))),
ew AS (SELECT brand, round(a0, {X.DECIMALS}) AS a, round(b0, {X.DECIMALS}) AS b, round(c0, {X.DECIMALS}) AS c FROM el WHERE it = {X.STEPS} + 1 AND t = 0),
ee AS (
  SELECT ew.*, 0::BIGINT AS t, level0 AS lvl, slope AS trend, seasons0 AS seasons, 0e0 AS sse FROM ew JOIN eb ON ew.brand = eb.brand
  UNION ALL
  SELECT brand, a, b, c, t + 1, lvl + trend + a * e, trend + b * e, {ETS_STEP}, sse + e * e
  FROM (SELECT ee.*, eb.y[t + 1] - lvl - trend - seasons[1] AS e FROM ee JOIN eb ON ee.brand = eb.brand WHERE t < n)),
em AS (SELECT ee.*, n FROM ee JOIN eb ON ee.brand = eb.brand WHERE t = n),
ep AS (
  SELECT em.*, step, lvl + trend * step + seasons[(step - 1) % 12 + 1] AS mean,
         CASE WHEN step = 1 THEN 1 ELSE a + b * (step - 1) + CASE WHEN (step - 1) % 12 = 0 THEN c ELSE 0 END END AS psi
  FROM em, range(1, 13) h(step)),
ets AS (
  SELECT brand, 'ets' AS model, CAST(step AS INT) AS step, mean, 1.96e0 * sqrt(sse / n * sum(psi * psi) OVER (PARTITION BY brand ORDER BY step)) AS half,
         n * (ln(2 * pi() * greatest(sse / n, 1e-300)) + 1) AS level, n AS m, 17 AS k FROM ep)
"""

_model("forecast_arima", "arima", sql=WITH_SERIES + ARIMA_FIT + SHOWN + "arima")
_model("forecast_ets", "ets", sql=WITH_SERIES + ETS_FIT + SHOWN + "ets")


def _diff(a: str, lag: int) -> str:
    return f"list_transform(range(1, len({a}) - {lag - 1}), lambda i: {a}[i + {lag}] - {a}[i])"


def _regression_sql() -> str:
    """(1,d,1) × (1,d,1,12) with cost in two stages, differenced as the table zs (brand, y, d, z) says."""
    zeros = "list_transform(range(1, m + 1), lambda i: 0e0)"
    only = lambda part: f"CASE WHEN seas THEN {part} ELSE {zeros} END"
    constant = "list_transform(range(1, m + 1), lambda i: CASE WHEN d = 0 THEN 1e0 ELSE 0e0 END)"
    back = lambda a, lag: f"{a}[start + 1 - {lag}:start + m - {lag}]"
    stage = [constant, *[back("z", k) for k in range(1, X.LONG_LAGS + 1)], only(back("z", 12)), only(back("z", 13)), back("x", 0)]
    parts = [back("z", 1), only(back("z", 12)), only(back("z", 13)), back("e", 1), only(back("e", 12)), only(back("e", 13)), back("x", 0), constant]
    out = f""", xf AS (SELECT brand, list(cost ORDER BY bucket) AS cost FROM series GROUP BY brand),
xa AS (
  SELECT zs.brand, factor, y, d, z, len(z) - 12 * d >= 45 AS seas, list_concat(cost, list_transform(range(12), lambda k: factor * cost[-1])) AS x
  FROM zs JOIN xf ON zs.brand = xf.brand, (VALUES (1e0), (1.2e0)) v(factor)),
xo AS (SELECT * REPLACE (CASE WHEN d = 1 THEN {_diff("x", 1)} ELSE x END AS x) FROM xa),
xz AS (
  SELECT * REPLACE (CASE WHEN d = 1 AND seas THEN {_diff("x", 12)} ELSE x END AS x, CASE WHEN d = 1 AND seas THEN {_diff("z", 12)} ELSE z END AS z) FROM xo),
x1 AS (SELECT *, CASE WHEN seas THEN 13 ELSE {X.LONG_LAGS} END AS start, len(z) - CASE WHEN seas THEN 13 ELSE {X.LONG_LAGS} END AS m FROM xz WHERE factor = 1),
xl AS (SELECT brand, m, {len(stage)} AS steps, [{", ".join(stage)}, {back("z", 0)}] AS cols FROM x1)"""
    out += _sweep_sql("xe", "xl", "steps")
    out += f""", x2 AS (
  SELECT x1.* REPLACE (start + CASE WHEN seas THEN 13 ELSE 1 END AS start, x1.m - CASE WHEN seas THEN 13 ELSE 1 END AS m),
         list_concat(list_transform(range(1, start + 1), lambda i: 0e0), xe.cols[1]) AS e FROM x1 JOIN xe ON x1.brand = xe.brand),
xm AS (SELECT *, 3 + 4 * seas::INT + CASE WHEN d = 0 THEN 1 ELSE 0 END AS active FROM x2 WHERE m >= 3 + 4 * seas::INT + CASE WHEN d = 0 THEN 1 ELSE 0 END + 2)"""
    for i, own in enumerate(parts):
        others = [p for j, p in enumerate(parts) if j != i]
        out += f""", xs{i} AS (SELECT brand, m, {len(others)} AS steps, [{", ".join([*others, own, back("z", 0)])}] AS cols FROM xm)"""
        out += _sweep_sql(f"xw{i}", f"xs{i}", "steps")
        out += f""", xb{i} AS (
  SELECT brand, m, cols, CASE WHEN list_inner_product(cols[1], cols[1]) > 1e-12
         THEN list_inner_product(cols[1], cols[2]) / list_inner_product(cols[1], cols[1]) ELSE 0 END AS b FROM xw{i})"""
    last = len(parts) - 1
    joins = " ".join(f"JOIN xb{i} ON xm.brand = xb{i}.brand" for i in range(len(parts)))
    far = lambda a, b: f"{b[0]} * {a}[-1] + CASE WHEN xc.seas THEN {b[1]} * {a}[len({a}) - 11] + {b[2]} * {a}[len({a}) - 12] ELSE 0 END"
    return out + f""", xc AS (
  SELECT xm.*, {", ".join(f"xb{i}.b AS b{i}" for i in range(len(parts)))},
         list_sum(list_transform(range(1, xm.m + 1), lambda i: pow(xb{last}.cols[2][i] - xb{last}.b * xb{last}.cols[1][i], 2))) AS sse FROM xm {joins}),
xp AS (
  SELECT xc.brand, xz.factor, 0 AS h, xc.z AS path, xc.e AS shock, xc.y AS level, CAST([] AS DOUBLE[]) AS psi, CAST([] AS DOUBLE[]) AS summed
  FROM xc JOIN xz ON xc.brand = xz.brand
  UNION ALL
  SELECT brand, factor, h + 1, list_append(path, move), list_append(shock, 0e0),
         list_append(level, move + CASE WHEN d = 1 THEN level[-1] ELSE 0 END + CASE WHEN d = 1 AND seas THEN level[len(level) - 11] - level[len(level) - 12] ELSE 0 END),
         list_append(psi, turn),
         list_append(summed, turn + CASE WHEN d = 1 AND h >= 1 THEN summed[-1] ELSE 0 END + CASE WHEN d = 1 AND seas AND h >= 12 THEN summed[len(summed) - 11] ELSE 0 END
           - CASE WHEN d = 1 AND seas AND h >= 13 THEN summed[len(summed) - 12] ELSE 0 END)
  FROM (
    SELECT xp.*, xc.d, xc.seas, {far("path", ("b0", "b1", "b2"))} + {far("shock", ("b3", "b4", "b5"))} + b7 + b6 * xz.x[len(xc.z) + h + 1] AS move,
           CASE WHEN h = 0 THEN 1 ELSE b0 * psi[-1] + CASE WHEN xc.seas AND h >= 12 THEN b1 * psi[len(psi) - 11] ELSE 0 END
             + CASE WHEN xc.seas AND h >= 13 THEN b2 * psi[len(psi) - 12] ELSE 0 END END
           + CASE WHEN h = 1 THEN b3 ELSE 0 END + CASE WHEN xc.seas AND h = 12 THEN b4 WHEN xc.seas AND h = 13 THEN b5 ELSE 0 END AS turn
    FROM xp JOIN xc ON xp.brand = xc.brand JOIN xz ON xp.brand = xz.brand AND xp.factor = xz.factor WHERE h < 12)),
xr AS (
  SELECT xp.brand, xp.factor, h, level[-1] AS mean, summed[-1] AS response, sse, m, len(xc.y) AS n, active + 1 AS k FROM xp JOIN xc ON xp.brand = xc.brand WHERE h > 0),
sarimax AS (
  SELECT brand, 'sarimax' AS model, CAST(h AS INT) AS step, mean, 1.96e0 * sqrt(sse / m * sum(response * response) OVER (PARTITION BY brand ORDER BY h)) AS half,
         n * (ln(2 * pi() * greatest(sse / m, 1e-300)) + 1) AS level, n AS m, k FROM xr WHERE factor = 1)
"""


REGRESSION_FIT = ARIMA_FIT + _regression_sql()
# The same with the differences that are asked for, whatever the unit-root test says.
DIFFERENCED = (
    WITH_SERIES
    + f""", folded AS (SELECT brand, list(value ORDER BY bucket) AS y FROM series GROUP BY brand),
zs AS (SELECT brand, y, 1 AS d, {_diff("y", 1)} AS z FROM folded)"""
    + _regression_sql()
)
SHORT = "UNION ALL SELECT DISTINCT brand, {} FROM counted WHERE n < 10"
BEST = """, best AS (SELECT * FROM tried QUALIFY dense_rank() OVER (PARTITION BY brand ORDER BY level + 2 * k, model) = 1)
"""
ALL_THREE = WITH_SERIES + REGRESSION_FIT + ETS_FIT + ", tried AS (SELECT * FROM arima UNION ALL SELECT * FROM sarimax UNION ALL SELECT * FROM ets)" + BEST

SCENARIO = """SELECT base.brand, baseline_model, round(base, 2) AS baseline_total, round(changed, 2) AS scenario_total, 20e0 AS delta_percent,
  round(changed - base, 2) AS impact_absolute, round((changed - base) / nullif(base, 0) * 100, 2) AS impact_percent, 'ok' AS status, CAST(NULL AS VARCHAR) AS reason
FROM base JOIN changed ON base.brand = changed.brand
""" + SHORT.format("NULL, NULL, NULL, 20e0, NULL, NULL, 'insufficient_data', 'fewer than 10 points: ' || n")
_model("forecast_with_cost", "sarimax", ("cost",), WITH_SERIES + REGRESSION_FIT + SHOWN + "sarimax")
_model("forecast_best_model", "auto", ("cost",), ALL_THREE + SHOWN + "best")
register(
    "scenario_impact",
    scenario_impact,
    ALL_THREE
    + """, base AS (SELECT brand, any_value(model) AS baseline_model, sum(mean) AS base FROM best GROUP BY brand),
changed AS (SELECT brand, sum(mean) AS changed FROM xr WHERE factor > 1 GROUP BY brand)
"""
    + SCENARIO,
)


@query(DIFFERENCED + "SELECT brand, step, round(mean, 2) AS forecast, round(level + 2 * k, 4) AS aic FROM sarimax")
def forecast_with_cost_differenced(spark, folder):
    fits = FC.fit_models(monthly(spark, folder, ["cost"]), 12, ["brand"], ["cost"], ["sarimax"], difference=1)
    return rounded(fits.filter("status = 'ok'").select("brand", "step", "forecast", "aic"), 4, forecast=2)


@query(
    DIFFERENCED
    + """, base AS (SELECT brand, 'sarimax' AS baseline_model, sum(mean) AS base FROM sarimax GROUP BY brand),
changed AS (SELECT brand, sum(mean) AS changed FROM xr WHERE factor > 1 GROUP BY brand)
"""
    + SCENARIO
)
def scenario_impact_differenced(spark, folder):
    series = monthly(spark, folder, ["cost"])
    return rounded(FC.simulate(series, "cost", 20.0, 12, ["brand"], ["sarimax"], 1), 2)



register(
    "forecast_summary",
    forecast_summary,
    WITH_SERIES
    + ARIMA_FIT
    + ETS_FIT
    + ", tried AS (SELECT * FROM arima UNION ALL SELECT * FROM ets)"
    + BEST
    + """, gap AS (SELECT brand, epoch(bucket) - epoch(lag(bucket) OVER (PARTITION BY brand ORDER BY bucket)) AS gap FROM counted),
med AS (SELECT *, quantile_cont(gap, 0.5) OVER (PARTITION BY brand) AS med FROM gap WHERE gap IS NOT NULL),
freq AS (
  SELECT brand, count(*) FILTER (gap > 2 * med) AS gaps, CASE WHEN max(med) <= 86400 THEN 'daily' WHEN max(med) <= 7 * 86400 THEN 'weekly'
         WHEN max(med) <= 31 * 86400 THEN 'monthly' ELSE 'unknown' END AS frequency FROM med GROUP BY brand),
sums AS (
  SELECT best.brand, model, n, count(*) AS periods, sum(mean) AS total, max(level + 2 * k) AS aic, max(level + k * ln(m)) AS bic,
         regr_slope(mean, step) / nullif(avg(mean), 0) * 100 AS pct, max(p) < 0.05 AS calm, max(gaps) AS gaps, max(frequency) AS frequency
  FROM best JOIN root ON best.brand = root.brand JOIN folded ON best.brand = folded.brand JOIN freq ON best.brand = freq.brand
  GROUP BY best.brand, model, n)
SELECT brand, model AS model_selected, n AS sample_size, periods, round(total, 2) AS forecast_total, round(aic, 2) AS aic, round(bic, 2) AS bic,
  calm AS is_stationary, frequency, CASE WHEN pct > 5 THEN 'up' WHEN pct < -5 THEN 'down' ELSE 'flat' END AS trend_direction,
  round(greatest(0, least(1, 0.5e0 + CASE WHEN calm THEN 0.2e0 ELSE 0 END + CASE WHEN n > 50 THEN 0.2e0 WHEN n > 30 THEN 0.1e0 ELSE 0 END
    - CASE WHEN aic > 2 * n THEN 0.1e0 ELSE 0 END)), 2) AS model_confidence,
  coalesce(nullif(concat_ws('; ', CASE WHEN NOT calm THEN 'series not stationary, differences were modelled' END,
    CASE WHEN gaps > 2 THEN gaps || ' gaps in time' END, CASE WHEN aic > 1000 THEN 'poor information criterion' END), ''), 'no remarks') AS notes,
  'ok' AS status, CAST(NULL AS VARCHAR) AS reason
FROM sums
UNION ALL SELECT DISTINCT brand, NULL, n, 0, NULL, NULL, NULL, FALSE, frequency, 'flat', 0e0, 'fewer than 10 points: ' || n, 'insufficient_data',
  'fewer than 10 points: ' || n FROM counted JOIN freq USING (brand) WHERE n < 10""",
)
