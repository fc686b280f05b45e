"""The registered queries of the operators: thin readers of a table and digests of results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import (
    bpe, fill_in_middle, language_id, license_scan, mixing, quality_rules, sharding, simhash, spelling, substring_dedup,
    token_counts, topk_search, url_filter,
)
from plumbline.llm.common import pick, staged, table
from plumbline.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL that checks it."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def _mixing_sql() -> str:
    """Raking, unrolled, and the water level of the probabilities in closed form."""
    dims = ("source", "lang", "topic")
    kinds = " ".join(f"WHEN regexp_matches(text, '{pattern}') THEN '{name}'" for name, pattern in mixing.TOPICS)
    steps = [f"""
WITH r AS (
  SELECT doc_id, source, lang, CASE {kinds} ELSE 'prose' END AS topic,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS n_tokens,
         CAST('0x' || substr(md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 13) AS BIGINT)
           / pow(2, {mixing.DRAW_BITS}) AS draw
  FROM documents),
c AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM r GROUP BY ALL),
t AS (SELECT *, {", ".join(f"pow(sum(tokens) OVER (PARTITION BY {d}), {mixing.POWER}) AS p_{d}" for d in dims)} FROM c),
w0 AS (
  SELECT source, lang, topic, tokens, CAST(tokens AS DOUBLE) AS weight,
         {", ".join(f"p_{d} / (SELECT sum(p) FROM (SELECT {d}, any_value(p_{d}) AS p FROM t GROUP BY {d})) AS target_{d}" for d in dims)}
  FROM t)"""]
    for k in range(mixing.SWEEPS * len(dims)):
        d = dims[k % len(dims)]
        steps.append(
            f"w{k + 1} AS (SELECT * REPLACE (coalesce(weight * target_{d} / nullif(sum(weight) OVER (PARTITION BY {d}), 0), 0) AS weight) FROM w{k})"
        )
    steps.append(f"""
x AS (SELECT source, lang, topic, tokens, weight, weight / nullif(tokens, 0) AS ratio FROM w{mixing.SWEEPS * len(dims)}),
y AS (
  SELECT *, coalesce(sum(tokens) OVER b, 0) AS full_tokens, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS rest,
         {mixing.BUDGET} * sum(tokens) OVER () AS aim
  FROM x WINDOW b AS (ORDER BY ratio DESC NULLS LAST, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT max((aim - full_tokens) / rest) AS factor FROM y WHERE rest > 1e-12),
p AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN least(1, factor * ratio) ELSE 1 END AS probability FROM x, f)
SELECT doc_id, r.source, r.lang, r.topic, n_tokens, round(probability, 6) AS probability, draw < probability AS sampled
FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source AND r.lang IS NOT DISTINCT FROM p.lang AND r.topic = p.topic""")
    return ",\n".join(steps)


@query(_mixing_sql())
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source")
    topics = documents.withColumn("topic", mixing.topic_of(F.col("text")))
    key = [F.col("doc_id"), F.col("text")]
    found = mixing.mixed(topics, [F.col("source"), F.col("lang"), F.col("topic")], mixing.token_count(F.col("text")), key)
    return found.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "sampled")


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    model = language_id.train(documents)
    found = language_id.identify(documents.select("doc_id", "text"), model)
    held_out = language_id.fold("doc_id") == 0
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "margin", "rejected")


@query()
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source")
    counted = staged(quality_rules.with_statistics(documents).drop("text"))
    found = quality_rules.judged(counted, by=("lang", "source"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *base, "base_failed", "kept", "distance")


TOP_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_inner_product(CAST(q.c AS DOUBLE[]), CAST(x.c AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query(TOP_SQL)
def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5, "vec_id", "embedding")


SHARDS = 24


@query()
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rows = pick(documents, "doc_id", "text").withColumn("row", F.lit(0))
    if "_metadata" not in documents.columns:  # the row number in its file tells repeated rows apart
        rows = documents.select("doc_id", "text", F.col("_metadata.row_index").alias("row"))
    size = sharding.text_bytes("text")
    out = sharding.shuffled(rows, SHARDS, size, key=[F.col("doc_id"), F.col("row")])
    return out.select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]


def _level_sql(name: str, units: str, out: str) -> str:
    """Shrinkage of one level as in url_filter._shrunk."""
    return f"""
{name}_c AS (
  SELECT greatest(0.001e0, least(0.999e0, CASE WHEN sum(n - 1) > 0 THEN
           sum(CASE WHEN prior * (1 - prior) > 0 THEN n * pow(bad / n - prior, 2) / (prior * (1 - prior)) ELSE 0 END - 1)
           / sum(n - 1) ELSE 0.001e0 END)) AS rho FROM {units} WHERE n > 0),
{name} AS (
  SELECT {out}, n, (1 - rho) / rho AS weight,
         ((1 - rho) / rho * prior + bad) / ((1 - rho) / rho + n) AS rate
  FROM {units}, {name}_c)"""


URL_SQL = rf"""
WITH p AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '{url_filter.SPLIT}', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
         coalesce(regexp_extract(url, '{url_filter.SPLIT}', 2), '') AS path FROM pages),
o AS (
  SELECT host, path, nullif(regexp_extract(path, '/([0-9]{{1,15}})([./]|$)', 1), '') AS shown FROM p),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
h0 AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad,
         regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS plain
  FROM o LEFT JOIN l ON CAST(shown AS BIGINT) = doc_id GROUP BY host),
h1 AS (
  SELECT host, n, bad, regexp_extract(plain, '{url_filter.DOMAIN}', 0) AS domain,
         regexp_extract(plain, '{url_filter.DOMAIN}', 2) AS suffix FROM h0),
s0 AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT coalesce(sum(bad) / sum(n), 0) FROM h1) AS prior
  FROM h1 GROUP BY suffix),
{_level_sql("s", "s0", "suffix")},
d0 AS (
  SELECT domain, h1.suffix, sum(h1.n) AS n, sum(bad) AS bad, any_value(rate) AS prior
  FROM h1 JOIN s ON h1.suffix = s.suffix GROUP BY domain, h1.suffix),
{_level_sql("d", "d0", "domain")},
e0 AS (SELECT host, h1.n, bad, rate AS prior FROM h1 JOIN d ON h1.domain = d.domain),
{_level_sql("e", "e0", "host")},
t AS (
  SELECT host, round(rate, 6) AS bad_rate,
         round(greatest(0, rate - {url_filter.Z} * sqrt(rate * (1 - rate) / (weight + n + 1))), 6) AS bad_bound FROM e),
r AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, r.host AS host, path, rule,
       CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN bad_bound > {url_filter.LIMIT} THEN 'block' ELSE 'allow' END AS verdict, bad_rate, bad_bound
FROM r LEFT JOIN t ON r.host = t.host
"""


@query(URL_SQL)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pick(table(spark, sf_dir, "pages"), "page_id", "url")
    labels = table(spark, sf_dir, "labels")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    known = labels.groupBy("doc_id").agg(F.max(bad).alias("bad"))
    # A page shows the document whose number stands in its path.
    shown = F.nullif(F.regexp_extract(url_filter.path_of(F.col("url")), "/([0-9]{1,15})([./]|$)", 1), F.lit(""))
    outcomes = pages.select("url", shown.cast("long").alias("shown")).join(known, F.col("shown") == F.col("doc_id"))
    return url_filter.judge(pages, outcomes.select("url", "bad"), RULES).drop("url")


@query()
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text", width=3, bits=2)
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", shown.alias("fingerprint"), "component_id")


@query()
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    done = bpe.encode_decode(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), vocabulary)
    listed = F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(pick(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return found.select("doc_id", *[c for c in license_scan.OUT if c != "spans"], F.size("spans").alias("n_spans"))


# Sentences, long ones in parts, with their sizes; runs of 16 words, stretches of 30.
SPAN_SQL = rf"""
WITH d AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^{substring_dedup.ENDS}\n]*[{substring_dedup.ENDS}\n]+[ \x09-\x0D]*|[^{substring_dedup.ENDS}\n]+') AS whole
  FROM documents),
l AS (
  SELECT doc_id, text, flatten(list_transform(whole, lambda x:
    CASE WHEN len(regexp_extract_all(x, '[^ \x09-\x0D]+')) > 16 THEN regexp_extract_all(x,
      '(?s)[ \x09-\x0D]*(?:[^ \x09-\x0D]{{1,7}}[ \x09-\x0D]+)*[^ \x09-\x0D]{{8,}}[ \x09-\x0D]*|.+') ELSE [x] END)) AS parts
  FROM d),
s AS (
  SELECT doc_id, i, parts[i] AS part,
         trim(regexp_replace(translate(parts[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[ \x09-\x0D]+', ' ', 'g')) AS norm
  FROM l, range(1, len(parts) + 1) r(i)),
w AS (SELECT *, greatest(CASE WHEN norm = '' THEN 0 ELSE len(string_split(norm, ' ')) END, length(part) // {substring_dedup.WORD_CHARS}) AS n FROM s),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM w),
r AS (
  SELECT a.doc_id, a.i, b.i AS j FROM (SELECT doc_id, i, upto - n + 16 AS aim FROM c) a
  ASOF JOIN c b ON a.doc_id = b.doc_id AND a.aim <= b.upto),
p AS (SELECT doc_id, list(norm ORDER BY i) AS norms FROM s GROUP BY doc_id),
f AS (
  SELECT r.doc_id, i, j, row_number() OVER (PARTITION BY list_slice(norms, i, j) ORDER BY r.doc_id, i) AS nth
  FROM r JOIN p ON r.doc_id = p.doc_id),
g AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM f WHERE nth > 1),
h AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g),
k AS (SELECT doc_id, i FROM h JOIN w USING (doc_id, i) QUALIFY sum(n) OVER (PARTITION BY doc_id, island) >= 30),
t AS (
  SELECT s.doc_id, count(*) AS n_sentences, count(k.i) AS n_removed,
         coalesce(string_agg(part, '' ORDER BY s.i) FILTER (k.i IS NULL), '') AS text
  FROM s LEFT JOIN k ON s.doc_id = k.doc_id AND s.i = k.i GROUP BY s.doc_id)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed,
       coalesce(t.text, d.text) AS text
FROM d LEFT JOIN t ON d.doc_id = t.doc_id
"""


@query(SPAN_SQL)
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    return substring_dedup.remove_repeated_spans(documents)


TOKEN_LIMIT = 2048


@query()
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_counts.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    found = token_counts.count_tokens(pick(table(spark, sf_dir, "documents"), "doc_id", "text"), vocabulary)
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return found.select("doc_id", n_bytes, "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


@query()
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.runs(table(spark, sf_dir, "documents"), "doc_id", "text")
    words = runs.select(spelling.with_typos(F.col("run"), F.col("id")).alias("word"))
    return spelling.variants(spelling.counted(words)).select("word", "form", "root", "n", "n_near", "form_n")


FIM_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[ \x09-\x0D]*[^ \x09-\x0D]+|[ \x09-\x0D]+') AS u FROM documents),
c AS (
  SELECT *, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS y,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
s AS (
  SELECT *, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m,
         array_to_string(u[greatest(x, y) + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
              ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM s
"""


@query(FIM_SQL)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle.restore(fill_in_middle.transform(pick(table(spark, sf_dir, "documents"), "doc_id", "text")))
    digest = lambda name: F.sha2(F.col(name).cast("binary"), 256).alias(f"{name}_sha256")
    return done.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", digest("output"), digest("restored"))
