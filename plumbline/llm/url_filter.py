"""URL filters: rules first, then the reputation of the host by empirical Bayes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import quoted, staged, without
from plumbline.plans.staging import broadcast_if_small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Second-level registries of two-letter countries count as a suffix.
DOMAIN = r"([^.]*\.)?((?:ac|co|com|edu|gov|net|org)\.[a-z][a-z]|[^.]*)$"

# A host is blocked if its rate of bad pages is above LIMIT with a certainty of Z deviations.
LIMIT, Z = 0.3, 1.0
LEAST_CORRELATION, MOST_CORRELATION = 0.001, 0.999
OUT = ("host", "path", "rule", "verdict", "bad_rate", "bad_bound")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def _rule(rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule of (verdict, "host/path"), and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked last and wins
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _correlation(units: DataFrame, name: str) -> DataFrame:
    """One row: how strongly outcomes of a unit agree beyond its parent's rate, by moments."""
    spread = F.col("prior") * (1 - F.col("prior"))
    excess = F.when(spread > 0, F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2) / spread).otherwise(0.0)
    seen = units.filter("n > 0").agg(F.sum(excess - 1).alias("over"), F.sum(F.col("n") - 1).alias("pairs"))
    rho = F.when(F.col("pairs") > 0, F.col("over") / F.col("pairs")).otherwise(F.lit(LEAST_CORRELATION))
    return seen.select(F.greatest(F.lit(LEAST_CORRELATION), F.least(F.lit(MOST_CORRELATION), rho)).alias(name))


def _shrunk(units: DataFrame) -> DataFrame:
    """``units`` (n, bad, prior) with the weight of the prior in pages and the posterior mean."""
    weight = (1 - F.col("rho")) / F.col("rho")
    joined = units.crossJoin(F.broadcast(_correlation(units, "rho"))).withColumn("weight", weight)
    return joined.withColumn("rate", (F.col("weight") * F.col("prior") + F.col("bad")) / (F.col("weight") + F.col("n")))


def reputation(outcomes: DataFrame) -> DataFrame:
    """One row per host of ``outcomes`` (host, bad 0 / 1, null if not labelled).

    Beta-binomial rates are shrunk from the whole table to suffix, registered domain and
    host: each level's posterior mean is the next one's prior, whose weight is estimated
    from how far units of that level differ more than chance would have it.
    ``bad_bound`` lies Z posterior deviations below the mean. Hosts without labels have
    their domain's rate; without any labels the rate is zero.
    """
    plain = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":[0-9]*$", "")
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.select("host", "n", "bad", F.regexp_extract(plain, DOMAIN, 0).alias("domain"), F.regexp_extract(plain, DOMAIN, 2).alias("suffix"))
    hosts = staged(hosts)
    whole = hosts.agg(F.try_divide(F.sum("bad"), F.sum("n")).alias("all")).select(F.coalesce("all", F.lit(0.0)).alias("prior"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = staged(_shrunk(suffixes.crossJoin(F.broadcast(whole))).select("suffix", F.col("rate").alias("prior")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = staged(domains.join(suffixes, "suffix"))
    domains = staged(_shrunk(domains).select("domain", F.col("rate").alias("prior")))
    hosts = staged(hosts.join(domains, "domain"))
    shrunk = _shrunk(hosts)
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + F.col("n") + 1))
    bound = F.greatest(F.lit(0.0), F.col("rate") - Z * deviation)
    return staged(shrunk.select("host", F.round("rate", 6).alias("bad_rate"), F.round(bound, 6).alias("bad_bound")))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", limit: float = LIMIT
) -> DataFrame:
    """``pages`` with host, path, rule, verdict (allow, block), bad_rate and bad_bound.

    The longest rule that fits decides; without one a host is blocked if its bound is
    above ``limit``. ``outcomes`` holds (url, bad) of labelled pages, repeated pages as
    often as they stand. Null urls and those without ``://`` have empty host and path and
    share the reputation of the empty host. Columns called like the new ones are
    replaced, all others kept whatever their names; an empty table stays empty. Hosts are
    broadcast only if counted few, otherwise Spark may split a hot one at run time.
    """
    pages = without(pages, *OUT)
    names = pages.columns
    flat = pages.toDF(*[f"_c{i}" for i in range(len(names))])
    address = F.col(f"_c{names.index(url)}")
    parsed = flat.withColumns({"host": host_of(address), "path": path_of(address)})
    known = outcomes.select(host_of(quoted(url)).alias("host"), F.col("bad").cast("long").alias("bad"))
    unlabelled = parsed.select("host", F.lit(None).cast("long").alias("bad"))
    trust = reputation(known.filter("bad is not null").union(unlabelled)).withColumnRenamed("host", "_host")
    joined = parsed.join(broadcast_if_small(trust), F.col("host") == F.col("_host"), "left")
    rule, verdict = _rule(rules)
    other = F.when(F.col("bad_bound") > limit, F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(
        *[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)],
        "host", "path", rule.alias("rule"), F.coalesce(verdict, other).alias("verdict"), "bad_rate", "bad_bound",
    )
