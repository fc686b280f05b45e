"""Semantic profile: one row per column, decided by rules over its measures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.fixed_values import (
    BOOLEAN_WORDS,
    FINANCIAL_PATTERNS,
    FUNNEL_PATTERNS,
    FUZZY_BOOST,
    FUZZY_THRESHOLD,
    KEYWORD_BOOSTS,
    NUMERIC_ID_WORDS,
    PERFORMANCE_WORDS,
    RANK_WORDS,
    ROLES,
    TEXT_ID_WORDS,
)
from plumbline.functions.names import contains_any, expand_acronyms, similarity
from plumbline.operators.measures import column_measures, quote
from plumbline.plans.running import running_totals
from plumbline.plans.staging import checkpoint_parquet

# Classes of hashes whose minima bound the sample of a column.
SAMPLE_SLOTS = 64
# One row in so many bounds the hashes; a column with up to FOLDED values there has all its values folded.
SAMPLE_SHARE, SAMPLE_SEED, FOLDED = 64, 42, 4096


def ordinal_confidence_of(m: DataFrame) -> Column:
    """How sure a whole-number column is a rank 1..n, from its measures (0 = it is not).

    A double that only holds whole numbers counts as integer. The distinct count here
    leaves null out.
    """
    distinct = F.col("unique_count") - (F.col("present") < F.col("row_count")).cast("long")
    low, high = F.col("min"), F.col("max")
    density = distinct / F.nullif(high, F.lit(0.0))
    span = high - low + 1
    series = span * (span + 1) / 2 + F.when(low > 0, low * distinct - low * (low + 1) / 2).otherwise(0.0)
    miss = F.when(series > 0, F.abs(F.col("sum") - series) / series)
    usable = F.col("is_numeric") & F.coalesce(F.col("whole"), F.lit(False)) & (F.col("present") >= 2) & (low >= 0) & (high != 0)
    sure = F.when(miss < 0.1, 0.99).when(miss < 0.3, 0.85).otherwise(0.75)
    return F.when(usable & (density >= 0.9), sure).when(usable & (density >= 0.7), 0.60).otherwise(0.0)


def ordinal_confidence(df: DataFrame) -> DataFrame:
    """(column_name, is_ordinal, ordinal_confidence) for every column."""
    m = column_measures(df)
    return m.select("column_name", ordinal_confidence_of(m).alias("ordinal_confidence")).select(
        "column_name", (F.col("ordinal_confidence") > 0).alias("is_ordinal"), "ordinal_confidence"
    )


def _statistical_type() -> Column:
    name = F.col("column_name")
    two_valued = (F.col("unique_ratio") < 0.01) & (F.col("unique_count") <= 2) & contains_any(name, BOOLEAN_WORDS)
    id_words = F.when(F.col("is_numeric"), contains_any(name, NUMERIC_ID_WORDS)).otherwise(contains_any(name, TEXT_ID_WORDS))
    ranked = F.col("is_numeric") & (F.col("ordinal_confidence") >= 0.75) & contains_any(name, RANK_WORDS)
    return (
        F.when(F.col("is_temporal"), "temporal")
        .when(F.col("is_boolean"), "boolean")
        .when(two_valued, "boolean")
        .when((F.col("unique_ratio") > 0.95) & id_words, "identifier")
        .when(ranked, "categorical")
        .when(F.col("is_numeric"), "numeric")
        .when(F.col("is_text"), "categorical")
        .otherwise("other")
    )


def statistical_type(measures: DataFrame) -> DataFrame:
    """Add unique ratio, ordinal confidence and the statistical type to measure rows."""
    ratio = F.coalesce(F.col("unique_count") / F.nullif("row_count", F.lit(0)), F.lit(0.0))
    return (
        measures.withColumn("unique_ratio", ratio)
        .withColumn("ordinal_confidence", ordinal_confidence_of(measures))
        .withColumn("statistical_type", _statistical_type())
    )


def semantic_roles(profile: DataFrame, table_keys: Sequence[str] = ()) -> DataFrame:
    """Add ``semantic_guess`` and ``confidence``.

    Scores add up as doubles in a fixed order: type prior, distinctness, keywords,
    similar names; then the neighbour factor. ``table_keys`` separates the profiles of
    several tables held in one frame.
    """
    name = F.lower("column_name")
    kind = F.col("statistical_type")
    df = profile.withColumn("_expanded", expand_acronyms(F.col("column_name")))
    df = df.withColumn("_funnel_like", similarity(F.col("_expanded"), FUNNEL_PATTERNS))
    df = df.withColumn("_financial_like", similarity(F.col("_expanded"), FINANCIAL_PATTERNS))

    scores = {role: "0.3D" if role == "other" else "0.0D" for role in ROLES}

    def add(role: str, test: str, boost: float) -> None:
        scores[role] += f" + CASE WHEN {test} THEN {boost}D ELSE 0.0D END"

    add("time", "statistical_type = 'temporal'", 0.7)
    add("product", "statistical_type = 'categorical'", 0.2)
    add("customer", "statistical_type = 'categorical'", 0.2)
    add("financial", "statistical_type = 'numeric'", 0.2)
    add("inventory", "statistical_type = 'numeric'", 0.2)
    add("funnel", "statistical_type = 'numeric'", 0.1)
    add("identifier", "statistical_type = 'identifier'", 0.6)
    add("customer", "statistical_type = 'identifier'", 0.1)
    add("identifier", "unique_ratio > 0.9D", 0.1)
    add("financial", "unique_ratio < 0.1D", 0.1)
    add("funnel", "unique_ratio < 0.1D", 0.1)
    for fragment, role, boost in KEYWORD_BOOSTS:
        add(role, f"contains(lower(column_name), '{fragment}') OR contains(_expanded, '{fragment}')", boost)
    add("funnel", f"_funnel_like >= {FUZZY_THRESHOLD}D", FUZZY_BOOST)
    add("financial", f"_financial_like >= {FUZZY_THRESHOLD}D", FUZZY_BOOST)
    df = df.withColumns({f"_s_{role}": F.expr(formula) for role, formula in scores.items()})

    # Neighbours: other columns of the same table with performance names.
    df = df.withColumn("_performs", contains_any(name, PERFORMANCE_WORDS).cast("int"))
    same_table = W.partitionBy(*(table_keys or [F.lit(0)]))
    neighbours = F.sum("_performs").over(same_table) - F.col("_performs")
    lifted = (neighbours >= 2) & ((F.col("_s_financial") > 0.3) | (F.col("_s_funnel") > 0.3))
    factor = F.when(lifted, F.lit(1.2)).otherwise(F.lit(1.0))
    df = df.withColumn("_factor", factor)
    df = df.withColumns({f"_s_{r}": F.col(f"_s_{r}") * F.col("_factor") for r in ("financial", "funnel")})
    df = df.withColumns({f"_s_{r}": F.least(F.lit(0.95), F.col(f"_s_{r}")) for r in ROLES})

    def first_best(roles: Sequence[str]) -> Column:
        best = F.greatest(*[F.col(f"_s_{r}") for r in roles])
        pick = F.when(F.lit(False), F.lit(None).cast("string"))
        for r in roles:
            pick = pick.when(F.col(f"_s_{r}") == best, r)
        return F.struct(pick.alias("role"), best.alias("score"))

    # "time" without a temporal column must be well supported.
    df = df.withColumn("_first", first_best(ROLES)).withColumn("_second", first_best(ROLES[1:]))
    doubtful = (F.col("_first.role") == "time") & (kind != "temporal") & (F.col("_first.score") < 0.8)
    chosen = F.when(doubtful, F.col("_second")).otherwise(F.col("_first"))
    df = df.withColumn("_chosen", chosen)
    helpers = ["_expanded", "_funnel_like", "_financial_like", "_performs", "_factor", "_first", "_second", "_chosen"]
    return df.withColumns(
        {"semantic_guess": F.col("_chosen.role"), "confidence": F.round("_chosen.score", 2)}
    ).drop(*helpers, *[f"_s_{r}" for r in ROLES])


def distribution_of() -> Column:
    """Shape of a numeric column from its moments; "uniform" is what is left over."""
    zero_share = F.col("zero") / F.nullif("present", F.lit(0))
    skew, kurt = F.abs("skew"), F.col("kurt")
    return (
        F.when((F.col("statistical_type") != "numeric") | (F.col("present") < 10), "unknown")
        .when(zero_share > 0.7, "sparse")
        .when((skew < 0.5) & (F.abs(kurt) < 1), "normal")
        .when((skew >= 2) | (kurt > 5), "long_tail")
        .when(skew >= 0.5, "skewed")
        .otherwise("uniform")
    )


def distribution_type(df: DataFrame) -> DataFrame:
    """(column_name, distribution_type) for every column."""
    typed = statistical_type(column_measures(df))
    return typed.select("column_name", distribution_of().alias("distribution_type"))


def zero_verdict() -> tuple[Column, Column]:
    """Are the zeros of a column data, and why; needs measures and ``semantic_guess``."""
    zeros, nulls = F.col("zero"), F.col("row_count") - F.col("present")
    share = zeros / F.nullif("row_count", F.lit(0))
    by_trigger = F.col("semantic_guess").isin("financial", "funnel") & F.col("trigger").isNotNull()
    reason = (
        F.when(F.coalesce(share, F.lit(0.0)) < 0.3, "few zeros")
        .when((nulls > 0) & (zeros / F.nullif(nulls, F.lit(0)) > 5), "many more zeros than nulls")
        .when((zeros > 0) & (nulls == 0), "no nulls")
        .when(by_trigger, F.concat(F.lit("follows "), F.col("trigger")))
        .otherwise("not confirmed")
    )
    return reason != "not confirmed", reason


def validate_zeros(df: DataFrame, col: str, role: str) -> DataFrame:
    """One row for a numeric column taken in the given role."""
    m = column_measures(df, distinct=False).filter(F.col("column_name") == col).withColumn("semantic_guess", F.lit(role))
    valid, reason = zero_verdict()
    return m.select("column_name", valid.alias("zeros_valid"), reason.alias("reason"))


def profile_columns(df: DataFrame, samples: bool = False, approximate: bool = False) -> DataFrame:
    """The full column profile, staged so that the frames built on it cost nothing."""
    typed = statistical_type(column_measures(df, approximate=approximate))
    roles = semantic_roles(typed)
    valid, reason = zero_verdict()
    sparse = distribution_of() == "sparse"
    profile = roles.select(
        "position",
        "column_name",
        "data_type",
        "statistical_type",
        "semantic_guess",
        "confidence",
        "row_count",
        "unique_count",
        "unique_ratio",
        (F.col("statistical_type") == "identifier").alias("is_identifier"),
        ((F.col("statistical_type") == "categorical") & F.col("is_numeric") & (F.col("ordinal_confidence") > 0)).alias("is_ordinal"),
        (sparse & valid).alias("sparsity_validated"),
        F.when(sparse, reason).alias("sparsity_reason"),
        distribution_of().alias("distribution_type"),
        F.coalesce(100.0 * (F.col("row_count") - F.col("present")) / F.nullif("row_count", F.lit(0)), F.lit(0.0)).alias(
            "null_percentage"
        ),
        "mean",
        "std",
        "min",
        "max",
    )
    profile = checkpoint_parquet(profile)
    if samples:
        profile = profile.join(F.broadcast(sample_values(df)), "column_name", "left")
    return profile


def sample_values(df: DataFrame, n: int = 5) -> DataFrame:
    """Up to ``n`` non-null values per column as text: those of the lowest hashes.

    Every distinct value comes once before any comes again, so a column with fewer than
    ``n`` distinct values fills up with repeats of them. The choice depends on the values
    alone, not on their order or files. An empty or all-null column gives an empty array.

    The table is read twice, however many columns are sparse. One row in SAMPLE_SHARE sets
    bounds: the ``n``-th lowest of the hashes found there is never below that of the table.
    Then every row of the table is looked at. Of a column with more than FOLDED values among
    those rows only values up to the bound are kept; values of the others are folded on the
    map side and hashed afterwards.
    """
    names = [F.col(quote(c)).cast("string") for c in df.columns]
    hashed = F.substring(F.md5("v"), 1, 15)
    some = df.sample(1 / SAMPLE_SHARE, SAMPLE_SEED).select(
        F.inline(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(names)]))
    )
    found = some.filter("v is not null").groupBy("i", hashed.alias("h")).agg(F.lit(1).alias("one"))
    slots = found.groupBy("i", (F.crc32("h") % max(SAMPLE_SLOTS, n)).alias("slot")).agg(F.min("h").alias("h"), F.count("*").alias("values"))
    bounds = slots.groupBy("i").agg(F.sum("values").alias("values"), F.get(F.sort_array(F.collect_list("h")), n - 1).alias("bound"))
    # One short text per column.
    limits = {r["i"]: r["bound"] for r in bounds.filter(F.col("values") > FOLDED).collect()}
    cells = [
        F.when(v.isNotNull() if limits.get(i) is None else F.substring(F.md5(v), 1, 15) <= limits[i], F.struct(F.lit(i).alias("i"), v.alias("v")))
        for i, v in enumerate(names)
    ]
    near = df.select(F.explode(F.array(*cells)).alias("c")).filter("c is not null").select("c.i", "c.v")
    values = near.groupBy("i", "v").agg(F.least(F.count("*"), F.lit(n)).alias("copies")).withColumn("h", hashed)
    turns = values.select("i", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("turn"), "h", "v")
    place = F.row_number().over(W.partitionBy("i").orderBy("turn", "h", "v"))
    kept = turns.withColumn("place", place).filter(F.col("place") <= n)
    found = kept.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("found"))
    names = df.sparkSession.createDataFrame(list(enumerate(df.columns)), "i int, column_name string")
    texts = F.transform("found", lambda f: f["v"])
    return names.join(found, "i", "left").select(
        "column_name", F.coalesce(texts, F.array().cast("array<string>")).alias("sample_values")
    )


# --- frames built on the profile ----------------------------------------------------


def profile_warnings(profile: DataFrame) -> DataFrame:
    """(warning, column_name) rows; table-level warnings carry no column."""
    kind = F.col("statistical_type")
    per_column = [
        ("low confidence", F.col("confidence") < 0.5),
        ("sparse numeric column", (F.col("distribution_type") == "sparse") & (kind == "numeric")),
        ("may hold identifiers", (kind == "categorical") & (F.col("unique_ratio") > 0.8)),
    ]
    marks = F.filter(F.array(*[F.when(test, F.lit(text)) for text, test in per_column]), lambda w: w.isNotNull())
    columns = profile.select(F.explode(marks).alias("warning"), "column_name")
    counts = profile.agg(
        F.count_if(kind.isin("numeric", "boolean")).alias("numbers"),
        F.count_if(kind == "temporal").alias("times"),
        F.count_if(kind == "identifier").alias("ids"),
        F.count("*").alias("all"),
    )
    table_marks = F.filter(
        F.array(
            F.when(F.col("numbers") == 0, F.lit("no numeric columns")),
            F.when(F.col("times") > 1, F.lit("several time columns")),
            F.when(F.col("ids") == F.col("all"), F.lit("only identifiers")),
        ),
        lambda w: w.isNotNull(),
    )
    table = counts.select(F.explode(table_marks).alias("warning"), F.lit(None).cast("string").alias("column_name"))
    return columns.unionByName(table)


def profile_summary(profile: DataFrame) -> DataFrame:
    """Column counts by role and by statistical type."""
    roles = profile.groupBy(F.col("semantic_guess").alias("name")).agg(F.count("*").alias("columns"))
    kinds = profile.groupBy(F.col("statistical_type").alias("name")).agg(F.count("*").alias("columns"))
    return roles.select(F.lit("role").alias("breakdown"), "name", "columns").unionByName(
        kinds.select(F.lit("type").alias("breakdown"), "name", "columns")
    )


def candidate_relationships(profile: DataFrame) -> DataFrame:
    """Pairs of roles that suggest an analysis, with confidence and the columns involved."""
    role, kind = F.col("semantic_guess"), F.col("statistical_type")
    ordered = F.struct("position", "column_name")

    def names(test: Column) -> Column:
        picked = F.array_sort(F.collect_list(F.when(test, ordered)))
        return F.transform(picked, lambda s: s["column_name"])

    def mean_confidence(*roles: str) -> Column:
        return F.avg(F.when(role.isin(*roles), F.col("confidence")))

    pairs = [
        ("product_financial", "product", "financial", 0.6),
        ("customer_financial", "customer", "financial", 0.6),
        ("product_inventory", "product", "inventory", 0.65),
    ]
    facts = profile.agg(
        names(kind == "temporal").alias("times"),
        names(kind.isin("numeric", "boolean")).alias("numbers"),
        *[names(role == r).alias(r) for r in ("product", "financial", "customer", "inventory")],
        *[mean_confidence(a, b).alias(f"_c_{label}") for label, a, b, _ in pairs],
    )
    rows = [
        F.struct(
            F.lit("time_series").alias("type"),
            F.when(F.size("times") == 1, 0.7).otherwise(0.5).alias("confidence"),
            F.array_join("times", ",").alias("left_columns"),
            F.array_join("numbers", ",").alias("right_columns"),
            ((F.size("times") > 0) & (F.size("numbers") > 0)).alias("found"),
        )
    ]
    for label, a, b, factor in pairs:
        rows.append(
            F.struct(
                F.lit(label).alias("type"),
                (F.col(f"_c_{label}") * factor).alias("confidence"),
                F.array_join(a, ",").alias("left_columns"),
                F.array_join(b, ",").alias("right_columns"),
                ((F.size(a) > 0) & (F.size(b) > 0)).alias("found"),
            )
        )
    return facts.select(F.inline(F.array(*rows))).filter("found").drop("found")


def cardinality(df: DataFrame, a: str, b: str) -> DataFrame:
    """Is a→b 1:1, 1:Many, Many:1 or Many:Many? Distinct pairs first, then counts per side."""
    pairs = df.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null").distinct()
    pairs = checkpoint_parquet(pairs)
    right = pairs.groupBy("a").agg(F.count("*").alias("n")).agg(F.max("n").alias("b_per_a"))
    left = pairs.groupBy("b").agg(F.count("*").alias("n")).agg(F.max("n").alias("a_per_b"))
    label = (
        F.when((F.col("b_per_a") == 1) & (F.col("a_per_b") == 1), "1:1")
        .when(F.col("a_per_b") == 1, "1:Many")
        .when(F.col("b_per_a") == 1, "Many:1")
        .otherwise("Many:Many")
    )
    return right.crossJoin(F.broadcast(left)).select(
        F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), "b_per_a", "a_per_b", label.alias("cardinality")
    )


def rank_columns(profile: DataFrame, limit: int | None = None) -> DataFrame:
    """Columns by information density, best first; all, or the first ``limit``."""
    kind, role = F.col("statistical_type"), F.col("semantic_guess")
    base = F.when(kind == "temporal", 1.0).when(kind == "identifier", 0.9).when(kind == "numeric", 0.6)
    base = base.when(kind == "categorical", 0.5).otherwise(0.3)
    sure = F.when(F.col("confidence") >= 0.80, 0.2).when(F.col("confidence") >= 0.60, 0.1).otherwise(0.0)
    weight = F.when(role.isin("financial", "funnel", "customer"), 0.15).when(role.isin("inventory", "product"), 0.10).otherwise(0.0)
    empty = F.when(F.col("null_percentage") > 70, 0.3).when(F.col("null_percentage") > 50, 0.6).otherwise(1.0)
    flat = F.when(F.col("unique_ratio") < 0.01, 0.2).otherwise(1.0)
    fine = F.when(F.col("unique_ratio") > 0.80, 0.1).otherwise(0.0)
    density = F.least(F.lit(1.0), (base + sure + weight) * empty * flat + fine)
    ranked = profile.select("column_name", "position", density.alias("density")).orderBy(F.col("density").desc(), "position")
    return (ranked if limit is None else ranked.limit(limit)).drop("position")


def column_metadata(profile: DataFrame) -> DataFrame:
    """Type, role and the figures shown for a column: range and mean, or distinct count."""
    number = F.col("statistical_type").isin("numeric", "identifier") & F.col("mean").isNotNull()
    return profile.select(
        "column_name",
        "data_type",
        F.col("semantic_guess").alias("role"),
        F.when(number, F.col("min")).alias("min"),
        F.when(number, F.col("max")).alias("max"),
        F.when(number, F.col("mean")).alias("mean"),
        F.when(~number, F.col("unique_count")).alias("distinct_values"),
    )


def diverse_sample(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Three first, four middle and three last rows in the order of ``order_by``.

    ``order_by`` must be a total order. Only those columns are ranked; the ten keys found
    are then looked up in the table. Tables of ten rows or fewer come back whole.
    """
    keys = df.select(*order_by).withColumn("_one", F.lit(1).cast("long"))
    ranked = running_totals(keys, list(order_by), {"position": "_one"})
    total = ranked.agg(F.count("*").alias("_n"))
    middle = F.floor(F.col("_n") / 2)
    wanted = (
        (F.col("_n") <= 10)
        | (F.col("position") <= 3)
        | F.col("position").between(middle - 1, middle + 2)
        | (F.col("position") > F.col("_n") - 3)
    )
    picked = ranked.crossJoin(F.broadcast(total)).filter(wanted)
    picked = picked.select("position", *[F.col(c).alias(f"_k_{c}") for c in order_by])
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in order_by])
    # At most ten rows by construction.
    return df.join(F.broadcast(picked), match).drop(*[f"_k_{c}" for c in order_by])
