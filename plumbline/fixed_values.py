"""Fixed values that results depend on: word lists, boosts, patterns and thresholds.

They are plain data, kept in their natural order. The order of ``KEYWORD_BOOSTS``
matters: boosts are added as doubles one after the other.
"""

# Date shapes tried in this order, as (label, parse pattern, shape guard).
DATE_FORMATS = [
    ("ISO 8601", None, r"^\d{4}-\d{2}-\d{2}"),
    ("dd-MM-yyyy", "d-M-yyyy", r"^\d{1,2}-(0?[1-9]|1[0-2])-\d{4}$"),
    ("dd/MM/yyyy", "d/M/yyyy", r"^\d{1,2}/(0?[1-9]|1[0-2])/\d{4}$"),
    ("MM/dd/yyyy", "M/d/yyyy", r"^(0?[1-9]|1[0-2])/\d{1,2}/\d{4}$"),
    ("yyyy/MM/dd", "yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("dd-MMM-yyyy", "d-MMM-yyyy", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"),
    ("dd MMM yyyy", "d MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
]

# Characters removed before a text is read as a number.
NUMERIC_NOISE = r"[$£€₹,%\s]"

# What a number looks like once the noise is gone.
NUMERIC_SHAPE = r"^[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"

# A column is cast when at least this share of its texts parses.
CAST_RATE = 0.7

# Name parts that mark a text column as a date.
DATE_NAME_PARTS = ["date", "time", "timestamp"]

# Business abbreviations in column names.
ACRONYMS = {
    "abd": "abandoned",
    "aband": "abandoned",
    "cpc": "cost_per_click",
    "cpm": "cost_per_mille",
    "cpa": "cost_per_acquisition",
    "impr": "impressions",
    "imp": "impressions",
    "conv": "conversions",
    "cvr": "conversion_rate",
    "ctr": "click_through_rate",
    "roas": "return_on_ad_spend",
    "roi": "return_on_investment",
    "aov": "average_order_value",
    "ltv": "lifetime_value",
    "clv": "customer_lifetime_value",
    "cac": "customer_acquisition_cost",
    "arpu": "average_revenue_per_user",
    "sess": "sessions",
    "vis": "visitors",
    "uv": "unique_visitors",
    "pv": "page_views",
    "gmv": "gross_merchandise_value",
    "aur": "average_unit_retail",
    "asp": "average_selling_price",
    "sku": "stock_keeping_unit",
    "qty": "quantity",
    "yoy": "year_over_year",
    "mom": "month_over_month",
    "wow": "week_over_week",
    "dod": "day_over_day",
    "rev": "revenue",
    "prof": "profit",
    "marg": "margin",
    "disc": "discount",
    "ret": "return",
    "refund": "refund",
}

# Roles in the order in which ties are decided.
ROLES = ["time", "product", "financial", "inventory", "funnel", "customer", "identifier", "other"]

# Fixed values: (fragment of a column name, role, boost).
KEYWORD_BOOSTS = [
    ("price", "financial", 0.25),
    ("cost", "financial", 0.25),
    ("amount", "financial", 0.15),
    ("sales", "financial", 0.25),
    ("revenue", "financial", 0.25),
    ("profit", "financial", 0.25),
    ("margin", "financial", 0.20),
    ("tax", "financial", 0.15),
    ("budget", "financial", 0.25),
    ("qty", "inventory", 0.25),
    ("quantity", "inventory", 0.25),
    ("stock", "inventory", 0.25),
    ("units", "inventory", 0.15),
    ("count", "inventory", 0.15),
    ("customer", "customer", 0.25),
    ("client", "customer", 0.25),
    ("user", "customer", 0.20),
    ("account", "customer", 0.15),
    ("product", "product", 0.25),
    ("item", "product", 0.20),
    ("sku", "product", 0.25),
    ("category", "product", 0.15),
    ("brand", "product", 0.15),
    ("date", "time", 0.25),
    ("time", "time", 0.25),
    ("year", "time", 0.20),
    ("click", "funnel", 0.25),
    ("view", "funnel", 0.20),
    ("impression", "funnel", 0.20),
    ("convert", "funnel", 0.25),
    ("conversion", "funnel", 0.25),
    ("session", "funnel", 0.15),
    ("abandoned", "funnel", 0.25),
    ("cart", "funnel", 0.15),
    ("id", "identifier", 0.25),
    ("key", "identifier", 0.20),
]

# Name patterns matched by similarity.
FUNNEL_PATTERNS = ["abandoned_carts", "click_through_rate", "conversion_rate", "impressions"]
FINANCIAL_PATTERNS = ["cost_per_click", "return_on_ad_spend", "average_order_value"]
FUZZY_THRESHOLD = 0.7
FUZZY_BOOST = 0.45

# Name parts used by single rules.
PERFORMANCE_WORDS = ["sales", "revenue", "price", "cost", "profit"]
BOOLEAN_WORDS = ["is_", "has_", "flag", "active", "enabled"]
TEXT_ID_WORDS = ["id", "key", "uuid", "hash", "code"]
NUMERIC_ID_WORDS = ["id", "_id", "key"]
RANK_WORDS = ["position", "rank", "order", "place", "level", "tier", "grade"]
TRIGGER_WORDS = ["click", "view", "visit", "session", "impression", "traffic", "user"]
SALES_WORDS = ["sales", "revenue", "income", "gmv"]
COST_WORDS = ["cost", "spend", "expense", "adcost"]

# Coefficients of the published response surfaces for the p-value of the
# unit-root t statistic with a constant (MacKinnon 1994).
UNIT_ROOT_SMALL_P = [2.1659, 1.4412, 0.038269]
UNIT_ROOT_LARGE_P = [1.7339, 0.93202, -0.12745, -0.010368]
UNIT_ROOT_SPLIT = -1.61
UNIT_ROOT_MIN = -18.83
UNIT_ROOT_MAX = 2.74

# Price per million units of usage, as (model, input, output).
USAGE_PRICES = [
    ("groq/llama-3.1-70b-versatile", 0.59, 0.79),
    ("huggingface/meta-llama/Meta-Llama-3-8B-Instruct", 0.30, 0.60),
]
