"""Named business ratios on two columns, per row or per group."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import safe_div


def _quotient(a: Column, b: Column) -> Column:
    return safe_div(a, b)


def _rest_of_first(a: Column, b: Column) -> Column:
    return safe_div(a - b, a)


def _excess_over_second(a: Column, b: Column) -> Column:
    return safe_div(a - b, b)


# Key → (full name, what the two columns are, formula).
DERIVED_METRICS = {
    "ROAS": ("Return on Ad Spend (ROAS)", ("revenue", "ad spend"), _quotient),
    "CPA": ("Cost Per Acquisition (CPA)", ("cost", "conversions"), _quotient),
    "CTR": ("Click-Through Rate (CTR)", ("clicks", "impressions"), _quotient),
    "CVR": ("Conversion Rate", ("conversions", "clicks or sessions"), _quotient),
    "Margin": ("Profit Margin", ("revenue", "cost"), _rest_of_first),
    "GrossMargin": ("Gross Margin", ("revenue", "cost of goods"), _rest_of_first),
    "NetMargin": ("Net Margin", ("net profit", "revenue"), _quotient),
    "ROI": ("Return on Investment", ("gain", "cost"), _excess_over_second),
    "CAC": ("Customer Acquisition Cost", ("marketing spend", "new customers"), _quotient),
    "LTV_CAC": ("LTV to CAC Ratio", ("lifetime value", "acquisition cost"), _quotient),
    "InventoryTurnover": ("Inventory Turnover", ("cost of goods", "average inventory"), _quotient),
    "GrowthRate": ("Growth Rate", ("current", "previous"), _excess_over_second),
    "CPC": ("Cost Per Click", ("ad spend", "clicks"), _quotient),
    "BounceRate": ("Bounce Rate", ("bounces", "sessions"), _quotient),
    "FulfillmentRate": ("Fulfillment Rate", ("fulfilled", "orders"), _quotient),
    "UtilizationRate": ("Utilization Rate", ("usage", "capacity"), _quotient),
}


def _plain(text: str) -> str:
    return re.sub(r"[ _-]", "", text.lower())


# Keys and full names without case, blanks, ``_`` and ``-``; a full name may leave out its abbreviation.
_NAMES = {_plain(n): key for key, (full, _, _) in DERIVED_METRICS.items() for n in (key, full, full.split(" (")[0])}


def find_derived(name: str) -> str | None:
    """Key of a metric by its key or full name; nothing else matches."""
    return _NAMES.get(_plain(name))


def derive(
    df: DataFrame,
    name: str,
    cols: tuple[str, str],
    level: str = "row",
    by: Sequence[str] = (),
    out: str = "value",
) -> DataFrame:
    """Add the ratio to every row, or give the ratio of sums per group."""
    key = find_derived(name)
    if key is None:
        raise ValueError(f"unknown metric {name!r}")
    formula = DERIVED_METRICS[key][2]
    a, b = cols
    if level == "row":
        return df.withColumn(out, formula(F.col(a).cast("double"), F.col(b).cast("double")))
    if level != "group":
        raise ValueError("level is 'row' or 'group'")
    sums = df.groupBy(*by).agg(F.sum(a).cast("double").alias("_a"), F.sum(b).cast("double").alias("_b"))
    return sums.select(*by, formula(F.col("_a"), F.col("_b")).alias(out))
