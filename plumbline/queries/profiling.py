"""Health, profile and grain queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import fixed_values as V
from plumbline.operators import grain as G
from plumbline.operators import health as H
from plumbline.operators import measures
from plumbline.operators import profile as P
from plumbline.queries.registry import FUNNEL, SALES, query, register, rounded
from plumbline.sources.views import funnel_view, sales_view, table

# --- a table with planted conditions ---------------------------------------------------

H_KEY = "(event_id * 48271) % 2147483647"
# Column → how it is made from events, the same text for both engines.
PLANTED = {
    "event_id": "event_id",
    "ts": "ts",
    "event_type": "event_type",
    "value_3": f"CASE WHEN {H_KEY} % 100 >= 3 THEN value END",
    "value_15": f"CASE WHEN {H_KEY} % 100 >= 15 THEN value END",
    "value_30": f"CASE WHEN {H_KEY} % 100 >= 30 THEN value END",
    "value_60": f"CASE WHEN {H_KEY} % 100 >= 60 THEN value END",
    "constant": "1e0",
    "sales_sparse": f"CASE WHEN {H_KEY} % 100 < 80 THEN 0e0 ELSE value END",
    "revenue_gap": f"CASE WHEN {H_KEY} % 100 < 80 THEN 0e0 WHEN {H_KEY} % 100 < 99 THEN NULL ELSE value END",
    "click_views": f"CASE WHEN {H_KEY} % 100 < 75 THEN 0 ELSE user_id + 1 END",
    "user_rank": "CAST(user_id + 1 AS BIGINT)",
}
PLANTED_SQL = "WITH planted AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in PLANTED.items()) + " FROM events)\n"
PLANTED_NUMBERS = [c for c in PLANTED if c not in ("ts", "event_type")]


def planted(spark, folder):
    return table(spark, folder, "events").select(*[F.expr(e).alias(c) for c, e in PLANTED.items()])


def per_column(columns, text: str, source: str = "planted") -> str:
    """UNION ALL of one SELECT per column; ``{c}`` is the column."""
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, " + text.replace("{c}", c) + f" FROM {source}" for c in columns)


UNIQUE = "count(DISTINCT {c}) + CAST(bool_or({c} IS NULL) AS BIGINT)"


def _health_cte() -> str:
    parts = []
    for c in PLANTED:
        variance = f"var_samp({c})" if c in PLANTED_NUMBERS else "CAST(NULL AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS column_name, count(*) AS row_count, 100e0 * count(*) FILTER ({c} IS NULL) / count(*) AS null_percentage, "
            f"{UNIQUE.replace('{c}', c)} AS unique_count, {variance} AS v FROM planted"
        )
    return (
        PLANTED_SQL
        + ", c AS ("
        + " UNION ALL ".join(parts)
        + """), h AS (SELECT *, unique_count / row_count AS unique_ratio,
  CASE WHEN null_percentage > 50 THEN 0e0 WHEN null_percentage > 20 THEN 50e0 WHEN null_percentage > 5 THEN 80e0 ELSE 100e0 END AS base FROM c),
scored AS (SELECT column_name, row_count, null_percentage, unique_count, unique_ratio,
  null_percentage > 50 AS is_critical, null_percentage > 20 AND null_percentage <= 50 AS many_nulls,
  coalesce(v = 0, FALSE) AS zero_variance, unique_count > 1000 AS high_cardinality,
  unique_ratio > 0.95 AND unique_count > 100 AS likely_identifier,
  CASE WHEN v = 0 THEN least(base, 30e0) ELSE base END AS score FROM h)
"""
    )


HEALTH = _health_cte()


@query(
    HEALTH
    + """SELECT column_name, row_count, round(null_percentage, 6) AS null_percentage, unique_count, round(unique_ratio, 6) AS unique_ratio,
       is_critical, many_nulls, zero_variance, high_cardinality, likely_identifier, score FROM scored"""
)
def health_columns(spark, folder):
    return rounded(H.health_columns(planted(spark, folder)))


@query(
    HEALTH
    + """, r AS (SELECT avg(score) AS m, max(row_count) AS row_count, count(*) AS column_count,
   CAST(sum(is_critical::INT) + CASE WHEN max(row_count) < 30 THEN 1 ELSE 0 END AS BIGINT) AS critical_issues,
   CAST(sum(many_nulls::INT) + sum(zero_variance::INT) + sum(high_cardinality::INT) + sum(likely_identifier::INT) AS BIGINT) AS warnings FROM scored)
SELECT round(m * CASE WHEN critical_issues > 0 THEN 0.5e0 ELSE 1 END, 6) AS overall_score, critical_issues, warnings, row_count, column_count,
       critical_issues = 0 AND m >= 70 AS should_proceed FROM r"""
)
def health_report(spark, folder):
    return rounded(H.health_report(planted(spark, folder)))


def _stats_sql() -> str:
    parts = []
    for c in PLANTED:
        number = c in PLANTED_NUMBERS

        def stat(text: str) -> str:
            return f"round(CAST({text.replace('{c}', c)} AS DOUBLE), 6)" if number else "CAST(NULL AS DOUBLE)"

        parts.append(
            f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, "
            f"round(100e0 * count(*) FILTER ({c} IS NULL) / count(*), 6) AS null_percentage, {UNIQUE.replace('{c}', c)} AS unique_count, "
            f"{stat('avg({c})')} AS mean, {stat('quantile_cont({c}::DOUBLE, 0.5)')} AS median, {stat('stddev_samp({c})')} AS std, "
            f"{stat('min({c})')} AS min, {stat('max({c})')} AS max FROM planted"
        )
    return PLANTED_SQL + " UNION ALL ".join(parts)


@query(_stats_sql())
def basic_stats(spark, folder):
    return rounded(measures.basic_stats(planted(spark, folder)))


LINE_COLUMNS = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate"
).split()


@query(per_column(LINE_COLUMNS, f"{UNIQUE} AS unique_count", "lineitem"))
def distinct_counts(spark, folder):
    return measures.distinct_counts(table(spark, folder, "lineitem"))


# --- rules over the measures of a table, in SQL ----------------------------------------


def measures_sql(columns: dict[str, str], source: str) -> str:
    """One row per column with what the rules need; kind is number, text or time."""
    parts = []
    triggers = [c for c, k in columns.items() if k == "number" and any(w in c for w in V.TRIGGER_WORDS)]
    for i, (c, kind) in enumerate(columns.items()):
        number = kind == "number"

        def stat(text: str, empty: str = "CAST(NULL AS DOUBLE)") -> str:
            return text.replace("{c}", f"CAST({c} AS DOUBLE)") if number else empty

        trigger = "CASE"
        for t in triggers:
            if number and t != c:
                trigger += f" WHEN count(*) FILTER ({c} = 0 AND {t} = 0) / nullif(count(*) FILTER ({t} = 0), 0) > 0.8e0 THEN '{t}'"
        trigger = "CAST(NULL AS VARCHAR)" if trigger == "CASE" else trigger + " END"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS column_name, '{kind}' AS kind, count(*) AS row_count, count({c}) AS present, "
            f"{UNIQUE.replace('{c}', c)} AS unique_count, {stat('avg({c})')} AS mean, {stat('min({c})')} AS lo, {stat('max({c})')} AS hi, "
            f"{stat('stddev_samp({c})')} AS std, {stat('sum({c})')} AS total, {stat('kurtosis_pop({c})')} AS kurt, "
            f"""{stat('''(avg(pow({c}, 3)) - 3 * avg({c}) * avg(pow({c}, 2)) + 2 * pow(avg({c}), 3)) / nullif(pow(var_pop({c}), 1.5), 0)''')} AS skew, """
            f"{stat('count(*) FILTER ({c} = 0)', 'CAST(NULL AS BIGINT)')} AS zeros, "
            f"{stat('bool_and({c} = floor({c}))', 'CAST(NULL AS BOOLEAN)')} AS whole, {trigger} AS trigger FROM {source}"
        )
    return " UNION ALL ".join(parts)


def _any(name: str, words) -> str:
    return "(" + " OR ".join(f"contains({name}, '{w}')" for w in words) + ")"


def rules_sql(columns: dict[str, str], source: str, similar: dict[str, str] | None = None) -> str:
    """CTEs m (measures), o (ordinal), t (type), r (role), p (profile).

    ``similar`` names the columns that match a pattern by similarity, as role per name.
    """
    similar = similar or {}
    expand = "CASE column_name " + " ".join(f"WHEN '{c}' THEN '{_expanded(c)}'" for c in columns) + " END"
    score = {role: ("3e-1" if role == "other" else "0e0") for role in V.ROLES}

    def add(role: str, when: str, boost: float) -> None:
        score[role] += f" + CASE WHEN {when} THEN {boost!r}::DOUBLE ELSE 0e0 END"

    add("time", "stype = 'temporal'", 0.7)
    for role in ("product", "customer"):
        add(role, "stype = 'categorical'", 0.2)
    for role, boost in (("financial", 0.2), ("inventory", 0.2), ("funnel", 0.1)):
        add(role, "stype = 'numeric'", boost)
    add("identifier", "stype = 'identifier'", 0.6)
    add("customer", "stype = 'identifier'", 0.1)
    add("identifier", "unique_ratio > 0.9", 0.1)
    for role in ("financial", "funnel"):
        add(role, "unique_ratio < 0.1", 0.1)
    for fragment, role, boost in V.KEYWORD_BOOSTS:
        add(role, f"(contains(column_name, '{fragment}') OR contains(expanded, '{fragment}'))", boost)
    for role in ("funnel", "financial"):
        names = [f"'{c}'" for c, r in similar.items() if r == role]
        if names:
            add(role, f"column_name IN ({', '.join(names)})", V.FUZZY_BOOST)
    scores = ", ".join(f"{text} AS s_{role}" for role, text in score.items())
    capped = ", ".join(
        f"least(0.95::DOUBLE, s_{r} * CASE WHEN lifted THEN 1.2::DOUBLE ELSE 1e0 END) AS c_{r}"
        if r in ("financial", "funnel")
        else f"least(0.95::DOUBLE, s_{r}) AS c_{r}"
        for r in V.ROLES
    )

    def best(roles) -> str:
        top = "greatest(" + ", ".join(f"c_{r}" for r in roles) + ")"
        return "CASE " + " ".join(f"WHEN c_{r} = {top} THEN '{r}'" for r in roles) + " END"

    every = "greatest(" + ", ".join(f"c_{r}" for r in V.ROLES) + ")"
    rest = "greatest(" + ", ".join(f"c_{r}" for r in V.ROLES[1:]) + ")"
    doubtful = f"({best(V.ROLES)} = 'time' AND stype <> 'temporal' AND {every} < 0.8::DOUBLE)"
    zero_share = "zeros / nullif(row_count, 0)"
    reason = f"""CASE WHEN {zero_share} < 0.3 THEN 'few zeros'
      WHEN row_count > present AND zeros / nullif(row_count - present, 0) > 5 THEN 'many more zeros than nulls'
      WHEN zeros > 0 AND row_count = present THEN 'no nulls'
      WHEN role IN ('financial', 'funnel') AND trigger IS NOT NULL THEN 'follows ' || trigger ELSE 'not confirmed' END"""
    return f""", m AS ({measures_sql(columns, source)}),
d AS (SELECT *, unique_count - CASE WHEN present < row_count THEN 1 ELSE 0 END AS u, hi - lo + 1 AS span, unique_count / row_count AS unique_ratio FROM m),
s AS (SELECT *, u / nullif(hi, 0) AS density, span * (span + 1) / 2 + CASE WHEN lo > 0 THEN lo * u - lo * (lo + 1) / 2 ELSE 0 END AS series FROM d),
o AS (SELECT *, CASE WHEN NOT coalesce(kind = 'number' AND whole AND present >= 2 AND lo >= 0 AND hi <> 0, FALSE) THEN 0e0
   WHEN density >= 0.9 THEN CASE WHEN series > 0 AND abs(total - series) / series < 0.1 THEN 0.99::DOUBLE
      WHEN series > 0 AND abs(total - series) / series < 0.3 THEN 0.85::DOUBLE ELSE 0.75::DOUBLE END
   WHEN density >= 0.7 THEN 0.6::DOUBLE ELSE 0e0 END AS ordinal FROM s),
t AS (SELECT *, CASE WHEN kind = 'time' THEN 'temporal'
   WHEN unique_ratio < 0.01 AND unique_count <= 2 AND {_any('column_name', V.BOOLEAN_WORDS)} THEN 'boolean'
   WHEN unique_ratio > 0.95 AND CASE WHEN kind = 'number' THEN {_any('column_name', V.NUMERIC_ID_WORDS)} ELSE {_any('column_name', V.TEXT_ID_WORDS)} END THEN 'identifier'
   WHEN kind = 'number' AND ordinal >= 0.75 AND {_any('column_name', V.RANK_WORDS)} THEN 'categorical'
   WHEN kind = 'number' THEN 'numeric' ELSE 'categorical' END AS stype,
   {expand} AS expanded, CAST({_any('column_name', V.PERFORMANCE_WORDS)} AS INT) AS performs FROM o),
r0 AS (SELECT *, {scores} FROM t),
r1 AS (SELECT *, sum(performs) OVER () - performs >= 2 AND (s_financial > 0.3::DOUBLE OR s_funnel > 0.3::DOUBLE) AS lifted FROM r0),
r2 AS (SELECT *, {capped} FROM r1),
r AS (SELECT *, CASE WHEN {doubtful} THEN {best(V.ROLES[1:])} ELSE {best(V.ROLES)} END AS role,
   round(CASE WHEN {doubtful} THEN {rest} ELSE {every} END, 2) AS confidence FROM r2),
p AS (SELECT *, CASE WHEN stype <> 'numeric' OR present < 10 THEN 'unknown' WHEN zeros / nullif(present, 0) > 0.7 THEN 'sparse'
   WHEN abs(skew) < 0.5 AND abs(kurt) < 1 THEN 'normal' WHEN abs(skew) >= 2 OR kurt > 5 THEN 'long_tail'
   WHEN abs(skew) >= 0.5 THEN 'skewed' ELSE 'uniform' END AS dist,
   {reason} AS reason, 100e0 * (row_count - present) / row_count AS null_percentage,
   stype = 'categorical' AND kind = 'number' AND ordinal > 0 AS is_ordinal FROM r)
"""


def _expanded(name: str) -> str:
    return "_".join(V.ACRONYMS.get(part, part) for part in name.lower().replace("_", " ").split())


SALES_KINDS = {
    "date": "time",
    "sales": "number",
    "ad_cost": "number",
    "cost": "number",
    "inventory": "number",
    "our_position": "number",
    "order_id": "number",
    "product_id": "number",
    "customer_id": "number",
    "category": "text",
    "brand": "text",
    "segment": "text",
    "priority": "text",
    "country": "text",
}
PLANTED_KINDS = {c: ("time" if c == "ts" else "text" if c == "event_type" else "number") for c in PLANTED}
FUNNEL_KINDS = {
    "user_id": "number",
    "day": "time",
    "impressions": "number",
    "clicks": "number",
    "signups": "number",
    "conversions": "number",
    "errors": "number",
    "spend": "number",
    "revenue": "number",
}
# The names whose similarity to a known pattern is 0.7 or more.
FUNNEL_SIMILAR = {"impressions": "funnel", "conversions": "funnel"}

def all_sales(spark, folder):
    return sales_view(spark, folder)


SALES_RULES = SALES + rules_sql(SALES_KINDS, "sales")
PLANTED_RULES = PLANTED_SQL + rules_sql(PLANTED_KINDS, "planted")
FUNNEL_RULES = FUNNEL + rules_sql(FUNNEL_KINDS, "funnel", FUNNEL_SIMILAR)


@query(
    PLANTED_RULES + "SELECT column_name, ordinal > 0 AS is_ordinal, ordinal AS ordinal_confidence FROM o"
)
def ordinal_ranks(spark, folder):
    return P.ordinal_confidence(planted(spark, folder))


@query(PLANTED_RULES + "SELECT column_name, dist AS distribution_type FROM p")
def distribution_types(spark, folder):
    return P.distribution_type(planted(spark, folder))


@query(SALES_RULES + "SELECT column_name, stype AS statistical_type, unique_count, round(unique_ratio, 6) AS unique_ratio FROM p")
def statistical_types(spark, folder):
    typed = P.statistical_type(measures.column_measures(sales_view(spark, folder)))
    return rounded(typed.select("column_name", "statistical_type", "unique_count", "unique_ratio"))


def _roles(name: str, load, sql: str) -> None:
    def run(spark, folder):
        typed = P.statistical_type(measures.column_measures(load(spark, folder)))
        return P.semantic_roles(typed).select("column_name", "semantic_guess", "confidence")

    register(name, run, sql + "SELECT column_name, role AS semantic_guess, confidence FROM p")


_roles("semantic_roles_sales", all_sales, SALES_RULES)
_roles("semantic_roles_funnel", funnel_view, FUNNEL_RULES)
_roles("semantic_roles_planted", planted, PLANTED_RULES)

@query(
    " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, column_name, role AS semantic_guess, confidence FROM ({rules}SELECT * FROM p)"
        for name, rules in (("sales", SALES_RULES), ("funnel", FUNNEL_RULES), ("planted", PLANTED_RULES))
    )
)
def semantic_roles_of_many_tables(spark, folder):
    """One frame of profile rows; neighbours are looked for within each table."""
    frames = (("sales", all_sales), ("funnel", funnel_view), ("planted", planted))
    typed = [
        P.statistical_type(measures.column_measures(load(spark, folder))).withColumn("table_name", F.lit(name)) for name, load in frames
    ]
    rows = reduce(DataFrame.unionByName, typed)
    return P.semantic_roles(rows, ["table_name"]).select("table_name", "column_name", "semantic_guess", "confidence")


PROFILE_SQL = """SELECT CAST(position AS INT) AS position, column_name, stype AS statistical_type, role AS semantic_guess, confidence, unique_count,
   round(unique_ratio, 6) AS unique_ratio, stype = 'identifier' AS is_identifier, is_ordinal, dist = 'sparse' AND reason <> 'not confirmed' AS sparsity_validated,
   CASE WHEN dist = 'sparse' THEN reason END AS sparsity_reason, dist AS distribution_type, round(null_percentage, 6) AS null_percentage,
   round(mean, 6) AS mean, round(std, 6) AS std, round(lo, 6) AS min, round(hi, 6) AS max FROM p"""


def _profile(name: str, load, sql: str) -> None:
    def run(spark, folder):
        return rounded(P.profile_columns(load(spark, folder)).drop("data_type", "row_count"))

    register(name, run, sql + PROFILE_SQL)


_profile("profile_sales", all_sales, SALES_RULES)
_profile("profile_funnel", funnel_view, FUNNEL_RULES)
_profile("profile_planted", planted, PLANTED_RULES)


@query(
    PLANTED_RULES
    + """SELECT column_name, NOT starts_with(z, 'not') AS zeros_valid, z AS reason FROM (
  SELECT column_name, CASE WHEN zeros / row_count < 0.3 THEN 'few zeros'
      WHEN row_count > present AND zeros / nullif(row_count - present, 0) > 5 THEN 'many more zeros than nulls'
      WHEN zeros > 0 AND row_count = present THEN 'no nulls'
      WHEN trigger IS NOT NULL THEN 'follows ' || trigger ELSE 'not confirmed' END AS z FROM p WHERE column_name = 'revenue_gap')"""
)
def zero_validation(spark, folder):
    return P.validate_zeros(planted(spark, folder), "revenue_gap", "financial")


@query(
    PLANTED_RULES
    + """SELECT 'low confidence' AS warning, column_name FROM p WHERE confidence < 0.5
UNION ALL SELECT 'sparse numeric column', column_name FROM p WHERE dist = 'sparse' AND stype = 'numeric'
UNION ALL SELECT 'may hold identifiers', column_name FROM p WHERE stype = 'categorical' AND unique_ratio > 0.8
UNION ALL SELECT 'no numeric columns', NULL WHERE (SELECT count(*) FROM p WHERE stype IN ('numeric', 'boolean')) = 0
UNION ALL SELECT 'several time columns', NULL WHERE (SELECT count(*) FROM p WHERE stype = 'temporal') > 1
UNION ALL SELECT 'only identifiers', NULL WHERE (SELECT bool_and(stype = 'identifier') FROM p)"""
)
def profile_warnings(spark, folder):
    return P.profile_warnings(P.profile_columns(planted(spark, folder)))


@query(
    SALES_RULES
    + """SELECT 'role' AS breakdown, role AS name, count(*) AS columns FROM p GROUP BY role
UNION ALL SELECT 'type', stype, count(*) FROM p GROUP BY stype"""
)
def profile_summary(spark, folder):
    return P.profile_summary(P.profile_columns(sales_view(spark, folder)))


def _pair_sql(label: str, a: str, b: str, factor: str) -> str:
    return f"""SELECT '{label}' AS type, round((SELECT avg(confidence) FROM p WHERE role IN ('{a}', '{b}')) * {factor}, 6) AS confidence,
  (SELECT string_agg(column_name, ',' ORDER BY position) FROM p WHERE role = '{a}') AS left_columns,
  (SELECT string_agg(column_name, ',' ORDER BY position) FROM p WHERE role = '{b}') AS right_columns
WHERE EXISTS (SELECT 1 FROM p WHERE role = '{a}') AND EXISTS (SELECT 1 FROM p WHERE role = '{b}')"""


@query(
    SALES_RULES
    + """SELECT 'time_series' AS type, CASE WHEN (SELECT count(*) FROM p WHERE stype = 'temporal') = 1 THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
  (SELECT string_agg(column_name, ',' ORDER BY position) FROM p WHERE stype = 'temporal') AS left_columns,
  (SELECT string_agg(column_name, ',' ORDER BY position) FROM (SELECT * FROM p WHERE stype IN ('numeric', 'boolean'))) AS right_columns
WHERE EXISTS (SELECT 1 FROM p WHERE stype = 'temporal') AND EXISTS (SELECT 1 FROM p WHERE stype IN ('numeric', 'boolean'))
UNION ALL """
    + " UNION ALL ".join(
        _pair_sql(*x)
        for x in (
            ("product_financial", "product", "financial", "0.6::DOUBLE"),
            ("customer_financial", "customer", "financial", "0.6::DOUBLE"),
            ("product_inventory", "product", "inventory", "0.65::DOUBLE"),
        )
    )
)
def relationship_candidates(spark, folder):
    return rounded(P.candidate_relationships(P.profile_columns(sales_view(spark, folder))))


@query(
    """WITH p AS (SELECT DISTINCT o_custkey AS a, o_orderkey AS b FROM orders WHERE o_custkey IS NOT NULL AND o_orderkey IS NOT NULL),
x AS (SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM p GROUP BY a)) AS b_per_a, (SELECT max(n) FROM (SELECT count(*) AS n FROM p GROUP BY b)) AS a_per_b)
SELECT 'o_custkey' AS left_column, 'o_orderkey' AS right_column, b_per_a, a_per_b,
  CASE WHEN b_per_a = 1 AND a_per_b = 1 THEN '1:1' WHEN a_per_b = 1 THEN '1:Many' WHEN b_per_a = 1 THEN 'Many:1' ELSE 'Many:Many' END AS cardinality FROM x"""
)
def column_cardinality(spark, folder):
    return P.cardinality(table(spark, folder, "orders"), "o_custkey", "o_orderkey")


@query(
    SALES_RULES
    + """, b AS (SELECT column_name, position, CASE stype WHEN 'temporal' THEN 1e0 WHEN 'identifier' THEN 0.9e0 WHEN 'numeric' THEN 0.6e0 WHEN 'categorical' THEN 0.5e0 ELSE 0.3e0 END
  + CASE WHEN confidence >= 0.80 THEN 0.2e0 WHEN confidence >= 0.60 THEN 0.1e0 ELSE 0 END
  + CASE WHEN role IN ('financial', 'funnel', 'customer') THEN 0.15e0 WHEN role IN ('inventory', 'product') THEN 0.1e0 ELSE 0 END AS score, null_percentage, unique_ratio FROM p)
SELECT column_name, round(least(1, score * CASE WHEN null_percentage > 70 THEN 0.3e0 WHEN null_percentage > 50 THEN 0.6e0 ELSE 1 END
  * CASE WHEN unique_ratio < 0.01 THEN 0.2e0 ELSE 1 END + CASE WHEN unique_ratio > 0.80 THEN 0.1e0 ELSE 0 END), 6) AS density
FROM b ORDER BY density DESC, position LIMIT 20"""
)
def column_ranking(spark, folder):
    return rounded(P.rank_columns(P.profile_columns(sales_view(spark, folder)), 20))


@query(
    SALES_RULES
    + """SELECT column_name, role, CASE WHEN num THEN round(lo, 4) END AS min, CASE WHEN num THEN round(hi, 4) END AS max,
  CASE WHEN num THEN round(mean, 6) END AS mean, CASE WHEN NOT num THEN unique_count END AS distinct_values
FROM (SELECT *, stype IN ('numeric', 'identifier') AND mean IS NOT NULL AS num FROM p)"""
)
def column_metadata(spark, folder):
    meta = P.column_metadata(P.profile_columns(sales_view(spark, folder))).drop("data_type")
    return rounded(meta, 4, mean=6)


@query(
    """WITH r AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position, count(*) OVER () AS n, * FROM orders)
SELECT o_orderkey, o_orderdate, position FROM r WHERE n <= 10 OR position <= 3 OR position BETWEEN n // 2 - 1 AND n // 2 + 2 OR position > n - 3"""
)
def diverse_sample(spark, folder):
    sample = P.diverse_sample(table(spark, folder, "orders"), ["o_orderdate", "o_orderkey"])
    return sample.select("o_orderkey", "o_orderdate", "position")


def sample_values(spark, folder):
    texts = P.sample_values(sales_view(spark, folder))
    return texts.select("column_name", F.size("sample_values").cast("long").alias("samples"))


register(
    "sample_values",
    sample_values,
    SALES + per_column(SALES_KINDS, "least(count({c}), 5) AS samples", "sales"),
)


# Columns whose values both engines write alike.
SAMPLED = [c for c, kind in SALES_KINDS.items() if kind in ("text", "time") or c.endswith("_id") or c == "our_position"]


@query(
    SALES
    + ", cells AS ("
    + per_column(SAMPLED, "CAST({c} AS VARCHAR) AS v", "sales")
    + """), folded AS (SELECT column_name, v, count(*) AS n FROM cells WHERE v IS NOT NULL GROUP BY ALL),
turns AS (SELECT column_name, v, unnest(range(1, least(n, 5) + 1)) AS turn FROM folded),
placed AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY turn, substr(md5(v), 1, 15), v) AS place FROM turns)
SELECT column_name, string_agg(v, '|' ORDER BY place) AS samples FROM placed WHERE place <= 5 GROUP BY column_name"""
)
def sample_value_texts(spark, folder):
    texts = P.sample_values(sales_view(spark, folder).select(*SAMPLED))
    return texts.select("column_name", F.array_join("sample_values", "|").alias("samples"))


# --- grain ----------------------------------------------------------------------------


@query(
    """SELECT 'l_orderkey,l_linenumber' AS columns, count(DISTINCT concat(l_orderkey, '||', l_linenumber)) AS unique_count, count(*) AS row_count,
  round(count(DISTINCT concat(l_orderkey, '||', l_linenumber)) / count(*), 6) AS ratio FROM lineitem"""
)
def key_uniqueness(spark, folder):
    return rounded(G.uniqueness(table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"]))


@query(
    """WITH k AS (SELECT event_type || '||' || CAST(CASE WHEN (event_id * 48271) % 2147483647 % 100 >= 30 THEN user_id END AS VARCHAR) AS key FROM events)
SELECT 'event_type,user_id' AS columns, count(DISTINCT key) + CAST(bool_or(key IS NULL) AS BIGINT) AS unique_count, count(*) AS row_count,
  round((count(DISTINCT key) + CAST(bool_or(key IS NULL) AS BIGINT)) / count(*), 6) AS ratio FROM k"""
)
def key_uniqueness_with_nulls(spark, folder):
    holes = F.when((F.col("event_id") * 48271) % 2147483647 % 100 >= 30, F.col("user_id"))
    return rounded(G.uniqueness(table(spark, folder, "events").withColumn("user_id", holes), ["event_type", "user_id"]))


@query(
    SALES_RULES
    + """, k AS (SELECT column_name, position, CASE WHEN role = 'identifier' AND confidence >= 0.7 THEN 1 WHEN is_ordinal THEN 2
   WHEN stype = 'categorical' AND confidence >= 0.7 AND unique_ratio > 0.05 THEN 3 END AS tier FROM p WHERE stype <> 'temporal')
SELECT column_name, CAST(tier AS INT) AS tier, CAST(position AS INT) AS position FROM k WHERE tier IS NOT NULL"""
)
def key_candidates(spark, folder):
    return G.key_candidates(P.profile_columns(sales_view(spark, folder)))


def _keys_sql(source: str, time: str, dims: list[str]) -> str:
    parts = []
    for i in range(len(dims) + 1):
        cols = [time, *dims[:i]]
        text = ", '||', ".join(cols)
        parts.append(f"SELECT {i} AS i, '{','.join(cols)}' AS k, count(DISTINCT concat({text})) / count(*) AS ratio FROM {source}")
    return (
        "k AS (" + " UNION ALL ".join(parts) + """), c AS (SELECT *, min(i) FILTER (ratio >= 0.99) OVER () AS early, max(ratio) OVER () AS top FROM k)
"""
    )


KEY_PICK = """SELECT k AS composite_key, round(ratio, 6) AS uniqueness_ratio, ratio >= 0.99 AS is_unique FROM c
WHERE CASE WHEN early IS NOT NULL THEN i = early ELSE ratio = top END ORDER BY i LIMIT 1"""


@query("WITH " + _keys_sql("lineitem", "l_shipdate", ["l_partkey", "l_suppkey", "l_linenumber"]) + KEY_PICK)
def composite_key(spark, folder):
    return rounded(G.find_key(table(spark, folder, "lineitem"), "l_shipdate", ["l_partkey", "l_suppkey", "l_linenumber"]))


@query("WITH " + _keys_sql("lineitem", "l_shipdate", ["l_returnflag", "l_linestatus"]) + KEY_PICK)
def composite_key_not_found(spark, folder):
    return rounded(G.find_key(table(spark, folder, "lineitem"), "l_shipdate", ["l_returnflag", "l_linestatus"]))


# Eleven parts that tell no rows apart; only the twelfth makes the key.
MANY = [f"d{i}" for i in range(1, 12)] + ["event_id"]
MANY_SQL = "e AS (SELECT date_trunc('month', ts) AS month, event_id, " + ", ".join(f"event_id % 2 AS d{i}" for i in range(1, 12)) + " FROM events), "


@query("WITH " + MANY_SQL + _keys_sql("e", "month", MANY) + KEY_PICK)
def composite_key_many_dims(spark, folder):
    month, copies = F.date_trunc("month", "ts").alias("month"), [(F.col("event_id") % 2).alias(f"d{i}") for i in range(1, 12)]
    return rounded(G.find_key(table(spark, folder, "events").select(month, "event_id", *copies), "month", MANY))


def gaps_sql(source: str, time: str, distinct: bool) -> str:
    rows = f"(SELECT DISTINCT {time} AS t FROM {source})" if distinct else f"(SELECT {time} AS t FROM {source})"
    return f"""gaps AS (SELECT epoch(t) - epoch(lag(t) OVER (ORDER BY t)) AS gap FROM {rows}),
f AS (SELECT count(gap) AS gaps, quantile_cont(gap, 0.5) AS m FROM gaps)
"""


FREQUENCY = """CASE WHEN m IS NULL THEN 'unknown' WHEN floor(m / 86400) <= 1.5 THEN 'daily' WHEN floor(m / 86400) <= 8 THEN 'weekly'
  WHEN floor(m / 86400) <= 35 THEN 'monthly' ELSE 'irregular' END"""


def _frequency(name: str, source: str, time: str, mode: str) -> None:
    def run(spark, folder):
        return rounded(G.temporal_frequency(table(spark, folder, source), time, mode), 3)

    sql = "WITH " + gaps_sql(source, time, mode == "distinct") + f"SELECT gaps, round(m, 3) AS median_gap_seconds, {FREQUENCY} AS frequency FROM f"
    register(name, run, sql)


_frequency("temporal_frequency_rows", "orders", "o_orderdate", "rows")
_frequency("temporal_frequency_distinct", "orders", "o_orderdate", "distinct")
_frequency("temporal_frequency_events", "events", "ts", "rows")


@query(
    """SELECT count(*) AS periods, round(avg(n), 6) AS avg_rows_per_period FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderdate)"""
)
def rows_per_period(spark, folder):
    return rounded(G.rows_per_period(table(spark, folder, "orders"), "o_orderdate"))


def grain_of(df):
    return rounded(G.discover_grain(df, P.profile_columns(df)))


@query(
    "WITH "
    + gaps_sql("orders", "o_orderdate", False)
    + f"""SELECT 'transactional' AS primary_grain, {FREQUENCY} AS temporal_frequency, 'o_orderdate,o_orderkey' AS composite_key,
  round((SELECT count(DISTINCT concat(o_orderdate, '||', o_orderkey)) / count(*) FROM orders), 6) AS uniqueness_ratio, TRUE AS is_unique,
  TRUE AS aggregation_needed, round((SELECT avg(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderdate)), 6) AS avg_rows_per_period FROM f"""
)
def grain_transactional(spark, folder):
    return grain_of(table(spark, folder, "orders"))


@query(
    "WITH "
    + gaps_sql("lineitem", "l_shipdate", False)
    + f"""SELECT 'row_index' AS primary_grain, {FREQUENCY} AS temporal_frequency, 'l_shipdate' AS composite_key,
  round((SELECT count(DISTINCT l_shipdate) / count(*) FROM lineitem), 6) AS uniqueness_ratio, FALSE AS is_unique,
  TRUE AS aggregation_needed, round((SELECT avg(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_shipdate)), 6) AS avg_rows_per_period FROM f"""
)
def grain_row_index(spark, folder):
    flags = ["l_shipdate", "l_returnflag", "l_linestatus", "l_quantity"]
    return grain_of(table(spark, folder, "lineitem").select(*flags))


@query(
    """WITH d AS (SELECT date_trunc('day', o_orderdate) AS day, sum(o_totalprice) AS sales FROM orders GROUP BY 1),
"""
    + gaps_sql("d", "day", False)
    + f"""SELECT 'timeseries_' || {FREQUENCY} AS primary_grain, {FREQUENCY} AS temporal_frequency, 'day' AS composite_key, 1e0 AS uniqueness_ratio,
  TRUE AS is_unique, FALSE AS aggregation_needed, 1e0 AS avg_rows_per_period FROM f"""
)
def grain_time_series(spark, folder):
    daily = table(spark, folder, "orders").groupBy(F.date_trunc("day", "o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("sales"))
    return grain_of(daily)


@query(
    """SELECT 'snapshot' AS primary_grain, CAST(NULL AS VARCHAR) AS temporal_frequency, 'c_custkey' AS composite_key,
  round(count(DISTINCT c_custkey) / count(*), 6) AS uniqueness_ratio, count(DISTINCT c_custkey) / count(*) >= 0.99 AS is_unique,
  FALSE AS aggregation_needed, CAST(NULL AS DOUBLE) AS avg_rows_per_period FROM customer"""
)
def grain_snapshot(spark, folder):
    return grain_of(table(spark, folder, "customer"))
