"""The pipeline against plain Python versions of its stages, each on the stage's own input."""

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import bpe, language_id
from plumbline.llm.common import staged
from tests.llm.test_simhash import brute_groups, brute_print
from tests.llm.test_substring_dedup import brute


@pytest.fixture(scope="module")
def steps(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], folder)))
    return [(df.columns, df.collect()) for df in out]


def test_columns_stay_until_the_last_stage(steps):
    assert all(columns == steps[0][0] for columns, _ in steps[:-1])


def test_language_stage_keeps_clean_documents(steps):
    (_, before), (_, after) = steps[0], steps[1]
    ids = {r.doc_id for r in after}
    assert ids <= {r.doc_id for r in before} and len(ids) >= 0.97 * len(before)
    assert all(r.text is not None and any(c.isalpha() for c in r.text) for r in after)


def test_one_document_of_each_group(steps):
    (_, before), (_, after) = steps[1], steps[2]
    prints = [brute_print(r.text, corpus_pipeline.SHINGLE_WORDS) for r in before]
    label = brute_groups(prints, corpus_pipeline.DIFFERING_BITS)
    first = {}
    for r, g in zip(before, label):
        first[g] = min(first.get(g, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after) == sorted(first.values())
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_repeats_go(steps):
    (_, before), (_, after) = steps[2], steps[3]
    want = {i: t for i, t, _, _ in brute([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)


def test_mixture_and_tokens(steps):
    (_, before), (_, mixed), (_, done) = steps[3:6]
    assert {tuple(r) for r in mixed} <= {tuple(r) for r in before}
    held = sum(len(r.text.split()) for r in mixed) / sum(len(r.text.split()) for r in before)
    assert abs(held - 0.9) < 0.1
    ranks = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).rank
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in mixed}
    assert len(done) == len(texts)
    for r in done:
        assert r.ids == library.encode_ordinary(texts[r.doc_id]) and r.round_trip and r.n_tokens == len(r.ids)


def test_model_of_the_first_stage_is_the_operators(spark, folder, steps):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language_id.train(docs)
    texts = [r.text for r in steps[0][1]]
    entropies, letters = language_id._entropies(model, texts)
    low = entropies.min(axis=1) - language_id.SPREAD / np.sqrt(np.maximum(letters, 1))
    kept = (letters > 0) & (low <= model.limits[entropies.argmin(axis=1)])
    assert {r.doc_id for r in steps[1][1]} == {r.doc_id for r, k in zip(steps[0][1], kept) if k}


def test_odd_rows_go_through_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = [(None, None, None, None, None), (7, "", "en", None, 0), (7, "", "en", None, 0), (None, "word " * 50_000, None, "s", 1), (8, "! 1 ?", "en", "s", 5)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.limit(20))
    for name in ("Score", "margin", "rejected", "sampled", "probability", "n_tokens", "n_removed", "_fold", "id", "row"):
        rows = rows.withColumn(name, F.lit(f"kept {name}"))
    now = staged(rows)
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        now = staged(stage(spark, now, folder))
        assert name == "bpe" or now.columns == columns
        if name != "bpe":
            assert now.filter("Score <> 'kept Score' or n_removed <> 'kept n_removed' or sampled <> 'kept sampled'").count() == 0
    assert now.count() > 0 and now.filter("not round_trip").count() == 0
    empty = staged(docs.limit(0))
    for _, stage in corpus_pipeline.STAGES:
        empty = staged(stage(spark, empty, folder))
    assert empty.count() == 0
