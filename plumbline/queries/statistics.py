"""Anomaly, association and causal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import anomaly as N
from plumbline.operators import association as C
from plumbline.operators import causal as K
from plumbline.operators import validate as V
from plumbline.queries.registry import SALES, hash_sql, normal_sql, query, register, rounded, student_p_sql, uniform_sql
from plumbline.sources.views import sales_view, table

ROW_KEY = "l_orderkey * 8 + l_linenumber"
LINE_HASH = f"(({ROW_KEY}) * 48271) % 2147483647 % 1000"
# One line in a thousand is a spike, one a drop, one zero.
PLANTED = (
    f"CASE WHEN {LINE_HASH} = 0 THEN l_extendedprice * 20 WHEN {LINE_HASH} = 1 THEN l_extendedprice * -1 "
    f"WHEN {LINE_HASH} = 2 THEN 0e0 ELSE l_extendedprice END"
)
LINES = f"""WITH lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_shipdate, {ROW_KEY} AS row_key, {PLANTED} AS amount FROM lineitem)
"""


def lines(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_returnflag",
        "l_shipdate",
        F.expr(ROW_KEY).alias("row_key"),
        F.expr(PLANTED).alias("amount"),
    )


CLASS = """CASE WHEN amount = 0 THEN 'zero_value'
  WHEN amount > upper THEN CASE WHEN amount > upper * 2 THEN 'extreme_spike' ELSE 'spike' END
  WHEN amount < lower THEN CASE WHEN amount <= 0 OR amount < lower / 2 THEN 'extreme_drop' ELSE 'drop' END END"""


def iqr_cte(by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    match = f"lines.{by} IS NOT DISTINCT FROM f.{by}" if by else "TRUE"
    return (
        LINES
        + f""", q AS (SELECT {head}count(amount) AS n, quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.75) AS q3 FROM lines {group}),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5e0 * (q3 - q1) AS lower, q3 + 1.5e0 * (q3 - q1) AS upper FROM q),
flagged AS (SELECT lines.*, n, iqr, lower, upper, n >= 10 AND (amount < lower OR amount > upper) AS hit,
  CASE WHEN iqr > 0 THEN CASE WHEN amount > upper THEN amount - upper ELSE lower - amount END / nullif(iqr, 0) ELSE 0 END AS severity
  FROM lines JOIN f ON {match} WHERE amount IS NOT NULL)
"""
    )


def zscore_cte(by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    head = f"{by}, " if by else ""
    match = f"lines.{by} IS NOT DISTINCT FROM f.{by}" if by else "TRUE"
    return (
        LINES
        + f""", f AS (SELECT {head}count(amount) AS n, avg(amount) AS mean, stddev_pop(amount) AS std,
  avg(amount) - 3 * stddev_pop(amount) AS lower, avg(amount) + 3 * stddev_pop(amount) AS upper FROM lines {group}),
flagged AS (SELECT lines.*, lower, upper, abs(amount - mean) / nullif(std, 0) AS severity,
  coalesce(n >= 10 AND abs(amount - mean) / nullif(std, 0) > 3, FALSE) AS hit FROM lines JOIN f ON {match} WHERE amount IS NOT NULL)
"""
    )


ROWS = f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag, round(amount, 6) AS amount, round(lower, 6) AS lower,
  round(upper, 6) AS upper, round(severity, 6) AS severity, {CLASS} AS classification FROM flagged WHERE hit"""


def anomaly_rows(df):
    shown = df.select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_returnflag", "amount", "lower", "upper", "severity", "classification"
    )
    return rounded(shown)


@query(iqr_cte() + ROWS)
def anomalies_iqr(spark, folder):
    return anomaly_rows(N.anomalies_iqr(lines(spark, folder), "amount"))


@query(iqr_cte("l_partkey") + ROWS)
def anomalies_iqr_by_part(spark, folder):
    return anomaly_rows(N.anomalies_iqr(lines(spark, folder), "amount", ["l_partkey"]))


@query(zscore_cte() + ROWS)
def anomalies_zscore(spark, folder):
    return anomaly_rows(N.anomalies_zscore(lines(spark, folder), "amount"))


@query(zscore_cte("l_returnflag") + ROWS)
def anomalies_zscore_by_flag(spark, folder):
    return anomaly_rows(N.anomalies_zscore(lines(spark, folder), "amount", by=["l_returnflag"]))


SUMMARY = """count(*) AS sample_size, count(*) FILTER (hit) AS anomalies_found, round(avg(hit::INT), 6) AS anomaly_rate,
  round(max(lower), 4) AS lower, round(max(upper), 4) AS upper, round(coalesce(avg(severity) FILTER (hit), 0), 6) AS mean_severity,
  round(coalesce(max(severity) FILTER (hit), 0), 6) AS max_severity FROM flagged"""


@query(iqr_cte() + "SELECT " + SUMMARY)
def anomaly_summary_iqr(spark, folder):
    return rounded(N.anomaly_summary(N.flag_iqr(lines(spark, folder), "amount")), 6, lower=4, upper=4)


@query(zscore_cte("l_returnflag") + "SELECT l_returnflag, " + SUMMARY + " GROUP BY l_returnflag")
def anomaly_summary_by_flag(spark, folder):
    flagged = N.flag_zscore(lines(spark, folder), "amount", by=["l_returnflag"])
    return rounded(N.anomaly_summary(flagged, ["l_returnflag"]), 6, lower=4, upper=4)


@query(
    iqr_cte("l_returnflag")
    + """SELECT l_returnflag, round(avg((amount < lower OR amount > upper)::INT), 6) AS iqr_rate,
  round(greatest(0.01e0, least(0.15e0, avg((amount < lower OR amount > upper)::INT))), 6) AS contamination FROM flagged GROUP BY l_returnflag"""
)
def adaptive_contamination(spark, folder):
    return rounded(N.contamination(lines(spark, folder), "amount", ["l_returnflag"]))


@query(iqr_cte() + f"SELECT {CLASS} AS classification, count(*) AS n, round(sum(amount), 4) AS amount FROM flagged GROUP BY 1")
def anomaly_classes(spark, folder):
    classed = N.classify_anomalies(N.flag_iqr(lines(spark, folder), "amount"), "amount")
    return rounded(classed.groupBy("classification").agg(F.count("*").alias("n"), F.sum("amount").alias("amount")), 4)


@query(
    iqr_cte()
    + f""", z AS (SELECT avg(amount) AS mean, stddev_pop(amount) AS std FROM lines),
both_ways AS (SELECT flagged.*, hit AS a, abs(amount - mean) / std > 3 AS b FROM flagged, z)
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(amount, 4) AS amount, 2 AS agreement_count, 'iqr,zscore' AS methods_agreed,
  'medium' AS consensus_confidence, round(severity, 6) AS severity, {CLASS} AS classification FROM both_ways WHERE a AND b"""
)
def anomaly_consensus_two(spark, folder):
    found = N.anomalies_consensus(lines(spark, folder), "amount")
    return rounded(
        found.select(
            "l_orderkey",
            F.col("l_linenumber").cast("long").alias("l_linenumber"),
            "amount",
            "agreement_count",
            "methods_agreed",
            "consensus_confidence",
            "severity",
            "classification",
        ),
        4,
        severity=6,
    )


def _forest_sql() -> str:
    """Samples, levels and steps of the isolation forest; then ``forest``: lines with severity and hit."""
    path = "CASE WHEN {n} > 2 THEN 2 * (ln(greatest({n} - 1, 1)) + 0.5772156649015329e0) - 2 * ({n} - 1) / {n} WHEN {n} = 2 THEN 1 ELSE 0 END"
    out = f""", size AS (SELECT greatest(1, count(amount)) AS n FROM lines),
draws AS (SELECT n, least({N.MOST_DRAWS}, greatest(1, CAST(ceil({N.SPARE * N.SAMPLE * N.TREES}e0 / n) AS BIGINT))) AS m FROM size),
drawn AS (
  SELECT amount AS v, row_key AS k, j, {uniform_sql("row_key", "42 + 2 * j")} AS u, {uniform_sql("row_key", "43 + 2 * j")} AS t, n, m
  FROM lines, draws, range({N.MOST_DRAWS}) r(j) WHERE j < m AND amount IS NOT NULL),
taken AS (
  SELECT CAST(floor(t * {N.TREES}) AS BIGINT) AS tree, v, u FROM drawn WHERE u < least(1, {N.SPARE * N.SAMPLE * N.TREES}e0 / (n * m))),
l0 AS (
  SELECT tree, v, 1::BIGINT AS node, 0 AS depth, NULL::DOUBLE AS low, NULL::DOUBLE AS high
  FROM (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY u, v) AS place FROM taken) WHERE place <= {N.SAMPLE})"""
    levels = (N.SAMPLE - 1).bit_length()
    for i in range(levels):
        place = uniform_sql(f"(tree * {1 << (levels + 1)} + node)", 41)
        out += f""",
c{i} AS (SELECT *, min(v) OVER w AS a, max(v) OVER w AS b FROM l{i} WINDOW w AS (PARTITION BY tree, node)),
d{i} AS (SELECT *, a + (b - a) * {place} AS raw FROM c{i}),
e{i} AS (SELECT *, CASE WHEN raw > a AND raw <= b THEN raw END AS cut FROM d{i}),
l{i + 1} AS (
  SELECT tree, v, CASE WHEN cut IS NULL THEN node WHEN v < cut THEN 2 * node ELSE 2 * node + 1 END AS node,
         depth + CAST(cut IS NOT NULL AS INT) AS depth, CASE WHEN cut IS NOT NULL AND v >= cut THEN cut ELSE low END AS low,
         CASE WHEN cut IS NOT NULL AND v < cut THEN cut ELSE high END AS high FROM e{i})"""
    return out + f""",
leaf AS (
  SELECT tree, low, high, count(*) AS n, CAST(round((depth + {path.format(n="count(*)")}) * 1e9) AS BIGINT) AS path
  FROM l{levels} GROUP BY tree, node, low, high, depth),
whole AS (SELECT count(*) AS trees, max(n) AS size FROM (SELECT sum(n) AS n FROM leaf GROUP BY tree)),
turn AS (SELECT edge, sum(path) AS turn FROM (SELECT low AS edge, path FROM leaf UNION ALL SELECT high, -path FROM leaf WHERE high IS NOT NULL) GROUP BY edge),
step AS (
  SELECT coalesce(edge, '-infinity'::DOUBLE) AS edge,
         round(pow(2e0, -(CAST(sum(turn) OVER (ORDER BY edge NULLS FIRST ROWS UNBOUNDED PRECEDING) AS DOUBLE) / 1e9 / trees)
               / greatest({path.format(n="size")}, 1e-12)), 9) AS severity FROM turn, whole),
scored AS (SELECT lines.*, step.severity FROM lines ASOF JOIN step ON lines.amount >= step.edge WHERE amount IS NOT NULL),
part AS (SELECT greatest(0.01e0, least(0.15e0, avg((amount < lower OR amount > upper)::INT))) AS rate FROM flagged),
o AS (SELECT severity, row_number() OVER (ORDER BY severity DESC) - 1 AS i, count(*) OVER () AS n FROM scored),
limits AS (
  SELECT max(severity) FILTER (i = floor(spot)) AS a, max(severity) FILTER (i = ceil(spot)) AS b, max(spot) - floor(max(spot)) AS f, max(n) AS n
  FROM (SELECT o.*, rate * (n - 1) AS spot FROM o, part)),
forest AS (SELECT scored.*, n >= {N.MIN_VALUES} AND severity > a + (b - a) * f AS found FROM scored, limits),
two AS (SELECT avg(amount) - 2 * stddev_pop(amount) AS low2, avg(amount) + 2 * stddev_pop(amount) AS high2 FROM lines)
"""


@query(
    iqr_cte()
    + _forest_sql()
    + f"""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag, round(amount, 6) AS amount, round(lower, 6) AS lower,
  round(upper, 6) AS upper, round(severity, 6) AS severity, {CLASS} AS classification
FROM (SELECT forest.*, low2 AS lower, high2 AS upper FROM forest, two WHERE found)"""
)
def anomalies_iforest(spark, folder):
    return anomaly_rows(N.anomalies_iforest(lines(spark, folder), "amount", "row_key"))


@query(
    iqr_cte()
    + _forest_sql()
    + f""", z AS (SELECT avg(amount) AS mean, stddev_pop(amount) AS std FROM lines),
votes AS (
  SELECT flagged.l_orderkey, flagged.l_linenumber, flagged.l_returnflag, flagged.row_key, flagged.amount, hit AS a,
         coalesce(abs(flagged.amount - mean) / nullif(std, 0) > 3, FALSE) AS b, found AS c, flagged.severity AS sa,
         abs(flagged.amount - mean) / nullif(std, 0) AS sb, lower AS la, upper AS ua, mean - 3 * std AS lb, mean + 3 * std AS ub
  FROM flagged JOIN forest ON flagged.row_key = forest.row_key AND flagged.l_partkey = forest.l_partkey
    AND flagged.l_shipdate = forest.l_shipdate AND flagged.amount = forest.amount, z),
named AS (
  SELECT *, a::INT + b::INT + c::INT AS agreement_count, CASE WHEN a THEN sa ELSE sb END AS severity,
         CASE WHEN a THEN la ELSE lb END AS lower, CASE WHEN a THEN ua ELSE ub END AS upper FROM votes)
SELECT l_orderkey, l_linenumber, l_returnflag, row_key, round(amount, 6) AS amount, agreement_count,
  concat_ws(',', CASE WHEN a THEN 'iqr' END, CASE WHEN b THEN 'zscore' END, CASE WHEN c THEN 'isolation_forest' END) AS methods_agreed,
  CASE WHEN agreement_count >= 3 THEN 'high' ELSE 'medium' END AS consensus_confidence, round(severity, 6) AS severity,
  {CLASS} AS classification FROM named WHERE agreement_count >= 2"""
)
def anomaly_consensus_three(spark, folder):
    found = N.anomalies_consensus(lines(spark, folder), "amount", key="row_key")
    return rounded(found.drop("l_shipdate", "l_partkey"))


# --- association ------------------------------------------------------------------------

READING = """CASE WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.7 THEN 'moderate' ELSE 'strong' END AS strength,
  CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS direction"""


@query(
    SALES
    + f""", c AS (SELECT segment, count(*) AS n, corr(sales, inventory) AS r FROM sales WHERE sales IS NOT NULL AND inventory IS NOT NULL GROUP BY segment)
SELECT segment, n, round(r, 9) AS pearson, {READING} FROM c"""
)
def pearson_by_segment(spark, folder):
    out = C.association(sales_view(spark, folder, "segment", "sales", "inventory"), "sales", "inventory", ["segment"], ranks=False)
    return rounded(out.select("segment", "n", "pearson", "strength", "direction"), 9)


def spearman_sql(by: str) -> str:
    head, group, part = (f"{by}, ", f"GROUP BY {by}", f"PARTITION BY {by}") if by else ("", "", "")
    return (
        SALES
        + f""", ranked AS (SELECT {head}rank() OVER (w ORDER BY sales) + (count(*) OVER (w, sales) - 1) / 2e0 AS a,
  rank() OVER (w ORDER BY inventory) + (count(*) OVER (w, inventory) - 1) / 2e0 AS b FROM sales)
SELECT {head}count(*) AS n, round(corr(a, b), 9) AS spearman FROM ranked {group}"""
    ).replace("(w ORDER", f"({part} ORDER").replace("(w, ", f"({part + ', ' if part else 'PARTITION BY '}")


@query(spearman_sql("segment"))
def spearman_by_segment(spark, folder):
    return rounded(C.spearman(sales_view(spark, folder, "segment", "sales", "inventory"), "sales", "inventory", ["segment"]), 9)


@query(spearman_sql(""))
def spearman_all(spark, folder):
    return rounded(C.spearman(sales_view(spark, folder, "sales", "inventory"), "sales", "inventory"), 9)


@query(spearman_sql(""))
def spearman_all_split(spark, folder):
    """The same by ranges, the way large tables go."""
    return rounded(C.spearman(sales_view(spark, folder, "sales", "inventory"), "sales", "inventory", window_rows=500), 9)


@query(
    SALES
    + f""", c AS (SELECT brand, count(*) AS n, corr(sales, our_position) AS r FROM sales GROUP BY brand),
t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS df FROM c)
SELECT brand, n, round(r, 9) AS pearson, round({student_p_sql('t.t', 't.df')}, 6) AS pearson_p, {READING},
  {student_p_sql('t.t', 't.df')} < 0.05 AS is_significant FROM t"""
)
def association_with_p(spark, folder):
    view = sales_view(spark, folder, "brand", "sales", "our_position")
    out = C.association(view, "sales", "our_position", ["brand"])
    return rounded(out.drop("spearman", "spearman_p"), 6, pearson=9)


@query(
    SALES
    + f""", p AS (SELECT brand, sales AS y, epoch(date) / 86400e0 AS x FROM sales),
f AS (SELECT brand, count(*) AS n, regr_slope(y, x) AS slope, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy FROM p GROUP BY brand),
e AS (SELECT *, sqrt((1 - r2) * syy / (n - 2) / sxx) AS se FROM f)
SELECT brand, n, round(slope, 6) AS slope, round(r2, 6) AS r_squared, round(se, 6) AS standard_error,
  round({student_p_sql('e.slope / e.se', '(e.n - 2)')}, 6) AS p_value FROM e"""
)
def linear_trend_by_brand(spark, folder):
    return rounded(C.linear_trend(sales_view(spark, folder, "brand", "date", "sales"), "sales", "date", ["brand"]))


# --- adjusted effects ---------------------------------------------------------------------

# Treatment and outcome both lean on the quantity; the true effect is 2.
NOISE_1, NOISE_2 = hash_sql(ROW_KEY, 101), hash_sql(ROW_KEY, 202)
CONFOUNDED = {
    "row_key": ROW_KEY,
    "flag": "l_returnflag",
    "quantity": "l_quantity",
    "treatment": f"l_quantity * 0.5e0 + {NOISE_1} % 1000 / 100e0",
    "outcome": f"2e0 * (l_quantity * 0.5e0 + {NOISE_1} % 1000 / 100e0) + 3e0 * l_quantity + {NOISE_2} % 1000 / 100e0",
}
CONFOUNDED_SQL = "WITH d AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in CONFOUNDED.items()) + " FROM lineitem)\n"


def confounded(spark, folder):
    return table(spark, folder, "lineitem").select(*[F.expr(e).alias(c) for c, e in CONFOUNDED.items()])


def effect_sql(t: str, y: str = "outcome", c: str = "quantity") -> str:
    """Coefficient of t in y ~ t + c."""
    return (
        f"(covar_pop({t}, {y}) * var_pop({c}) - covar_pop({c}, {y}) * covar_pop({t}, {c})) "
        f"/ (var_pop({t}) * var_pop({c}) - pow(covar_pop({t}, {c}), 2))"
    )


ERROR = """, s AS (SELECT flag, count(*) AS n, covar_pop(treatment, outcome) AS ty, covar_pop(quantity, outcome) AS cy, covar_pop(treatment, quantity) AS tc,
  var_pop(treatment) AS tt, var_pop(quantity) AS cc, var_pop(outcome) AS yy FROM d GROUP BY flag),
e AS (SELECT *, (ty * cc - cy * tc) / (tt * cc - tc * tc) AS b, (cy * tt - ty * tc) / (tt * cc - tc * tc) AS g FROM s),
x AS (SELECT *, sqrt((yy - b * ty - g * cy) * n / (n - 3) * cc / (tt * cc - tc * tc) / n) AS se FROM e)
"""


@query(
    CONFOUNDED_SQL
    + ERROR
    + """SELECT flag, n, round(b, 6) AS estimated_effect, round(se, 6) AS standard_error, round(b - 1.96e0 * se, 6) AS ci_lower,
  round(b + 1.96e0 * se, 6) AS ci_upper FROM x"""
)
def causal_effect_by_flag(spark, folder):
    return rounded(K.causal_effect(confounded(spark, folder), "treatment", "outcome", ["quantity"], ["flag"]))


# Coefficient of t in y ~ t + e + c, by taking c out of all three first.
RESIDUAL = """, r AS (SELECT d.*, extra - (avg_e + k_e * (quantity - avg_c)) AS re, treatment - (avg_t + k_t * (quantity - avg_c)) AS rt,
    outcome - (avg_y + k_y * (quantity - avg_c)) AS ry FROM d,
  (SELECT avg(extra) AS avg_e, avg(treatment) AS avg_t, avg(outcome) AS avg_y, avg(quantity) AS avg_c, regr_slope(extra, quantity) AS k_e,
    regr_slope(treatment, quantity) AS k_t, regr_slope(outcome, quantity) AS k_y FROM d))
"""


@query(
    "WITH d AS (SELECT "
    + ", ".join(f"{e} AS {c}" for c, e in CONFOUNDED.items())
    + f", {normal_sql(ROW_KEY, K.PLACEBO_SEED)} AS placebo, {normal_sql(ROW_KEY, K.CAUSE_SEED)} AS extra, {hash_sql(ROW_KEY, K.SUBSET_SEED)} % 100 < 80 AS keep FROM lineitem)\n"
    + RESIDUAL
    + f""", f AS (SELECT {effect_sql('treatment')} AS b, {effect_sql('placebo')} AS pb,
  (SELECT {effect_sql('rt', 'ry', 're')} FROM r) AS cb, (SELECT {effect_sql('treatment')} FROM d WHERE keep) AS sb, count(*) AS n FROM d),
g AS (SELECT *, abs(pb) < 0.1 * abs(b) AS p1, abs(cb - b) / abs(b) < 0.2 AS p2, abs(sb - b) / abs(b) < 0.3 AS p3 FROM f)
SELECT n, round(b, 6) AS estimated_effect, round(pb, 6) AS placebo_effect, round(cb, 6) AS random_cause_effect, round(sb, 6) AS subset_effect,
  p1 AS placebo_passed, p2 AS random_cause_passed, p3 AS subset_passed, p1::INT + p2::INT + p3::INT AS refutations_passed,
  CASE WHEN p1::INT + p2::INT + p3::INT >= 2 THEN 'high' WHEN p1::INT + p2::INT + p3::INT <= 1 THEN 'low' ELSE 'medium' END AS causal_confidence FROM g"""
)
def causal_refutation(spark, folder):
    out = K.refute(confounded(spark, folder), "treatment", "outcome", ["quantity"], "row_key")
    return rounded(out.drop("refutations_run", "standard_error", "ci_lower", "ci_upper"))


# --- stability over time --------------------------------------------------------------------

WINDOWED = """, b AS (SELECT min(epoch(date)) AS lo, max(epoch(date)) AS hi FROM sales),
w AS (SELECT sales.*, CASE WHEN lo < hi THEN least(CAST(floor((epoch(date) - lo) / ((hi - lo) / 3e0)) AS INT) + 1, 3) ELSE 1 END AS win FROM sales, b)
"""


@query(
    SALES.replace("WITH sales AS (", "WITH every AS (")
    + ", sales AS (SELECT * FROM every)"
    + """, b AS (SELECT segment, min(epoch(date)) AS lo, max(epoch(date)) AS hi, corr(sales, inventory) AS r0 FROM sales GROUP BY segment),
w AS (SELECT sales.*, r0, CASE WHEN lo < hi THEN least(CAST(floor((epoch(date) - lo) / ((hi - lo) / 3e0)) AS INT) + 1, 3) ELSE 1 END AS win
  FROM sales JOIN b USING (segment)),
c AS (SELECT segment, win, max(r0) AS r0, corr(sales, inventory) AS r, count(*) AS n FROM w GROUP BY segment, win HAVING count(*) > 10)
SELECT segment, round(max(r0), 9) AS correlation, count(*) AS window_count, round(var_pop(r), 9) AS variance, bool_and((r > 0) = (r0 > 0)) AS same_sign,
  bool_and(abs(r) > 0.7 * abs(r0)) AS magnitude_similar,
  CASE WHEN count(*) < 2 THEN TRUE ELSE var_pop(r) < 0.1 AND bool_and((r > 0) = (r0 > 0)) AND bool_and(abs(r) > 0.7 * abs(r0)) END AS is_stable
FROM c GROUP BY segment"""
)
def stability_of_correlation(spark, folder):
    view = sales_view(spark, folder, "segment", "date", "sales", "inventory")
    return rounded(V.stability_corr(view, "sales", "inventory", "date", ["segment"]), 9)


@query(
    SALES
    + WINDOWED
    + """, c AS (SELECT win, avg(sales) AS m FROM w GROUP BY win HAVING count(*) > 5), s AS (SELECT *, m - lag(m) OVER (ORDER BY win) AS step FROM c)
SELECT count(*) AS window_count, round(var_pop(m), 4) AS variance,
  CASE WHEN count(*) < 2 THEN TRUE ELSE bool_and(step > 0) OR bool_and(step < 0) END AS is_stable FROM s"""
)
def stability_of_trend(spark, folder):
    return rounded(V.stability_trend(sales_view(spark, folder, "date", "sales"), "sales", "date"), 4)
