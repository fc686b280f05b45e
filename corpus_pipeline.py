"""From raw documents to tokens: language, near copies, repeated passages, mixture, BPE."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, language_id, mixing, simhash, substring_dedup
from plumbline.llm.common import pick, staged, table
from plumbline.session import prepare

# Near copies: fingerprints over three-word shingles that differ in few bits, as in op7_simhash.
SHINGLE_WORDS, DIFFERING_BITS = 3, 2


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that clash with nothing, and what each column is called there."""
    flat = docs.toDF(*[f"_p{i}" for i in range(len(docs.columns))])
    return flat, {name: f"_p{i}" for i, name in reversed(list(enumerate(docs.columns)))}


def _back(done: DataFrame, docs: DataFrame) -> DataFrame:
    return done.select(*[f"_p{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without a letter or beyond the limits go.

    Null and empty texts go; without any labelled text there is no model and none stays.
    """
    flat, name = _apart(docs)
    model = language_id.train(flat, name["doc_id"], name["text"], name["lang"])
    return _back(language_id.identify(flat, model, name["text"]).filter("not rejected"), docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates; one of repeated rows; null ids last."""
    return simhash.keep_first(docs, "doc_id", "text", SHINGLE_WORDS, DIFFERING_BITS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the sentences that repeat an earlier passage; a row stays even if its text is empty then."""
    flat, name = _apart(docs)
    cut = substring_dedup.remove_repeated_spans(flat, name["doc_id"], name["text"])
    return _back(cut.withColumn(name["n_chars"], F.length(name["text"]).cast("long")), docs)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which source, language and topic have tempered shares of the tokens; null is a category of its own."""
    flat, name = _apart(docs)
    text = F.col(name["text"])
    dims = [F.col(name["source"]), F.col(name["lang"]), mixing.topic_of(text)]
    found = mixing.mixed(flat, dims, mixing.token_count(text), [F.col(name["doc_id"]), text])
    return _back(found.filter("sampled"), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text; null and empty texts have none."""
    vocabulary = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    done = bpe.encode_decode(pick(docs, "doc_id", "lang", "source", "text"), vocabulary)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return done.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_near_copies),
    ("substring_dedup", without_repeats),
    ("mixing", to_weights),
    ("bpe", tokens),
]

# Language models, fingerprints and merges are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for _, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir))
    return docs
