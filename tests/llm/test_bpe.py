import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import bpe
from plumbline.llm.queries import QUERIES

VOCABULARY = bpe.read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=VOCABULARY.rank, special_tokens={})
ENCODER = bpe.Encoder(VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=80), st.text("ab 'st\n\t1é中", max_size=200)), max_size=6))
def test_same_as_the_library_and_round_trip(texts):
    ids, counts = ENCODER.encode(texts)
    want = [LIBRARY.encode_ordinary(t) for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]
    data, sizes = bpe.decode_ids(VOCABULARY, ids, counts)
    assert data.tobytes() == "".join(texts).encode() and sizes.tolist() == [len(t.encode()) for t in texts]


@pytest.mark.parametrize("piece", ["ab" * 40, "a" * 65, "qzx" * 500, "é" * 300, "中文" * 200, "=" * 4000])
def test_long_pieces(piece):
    want = LIBRARY.encode_ordinary(piece)
    assert ENCODER.encode([piece])[0].tolist() == want
    assert [i for p in ENCODER.find(piece) for i in bpe.merge_one(VOCABULARY, p.encode())] == want


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    fresh = bpe.Encoder(VOCABULARY)
    for text in ["one two three four five", "six seven one two", "<|endoftext|> one"]:
        assert fresh.encode([text])[0].tolist() == LIBRARY.encode_ordinary(text)


ROWS = [(1, "Hello  world"), (2, None), (3, ""), (None, "x"), (4, "long words " * 40_000), (4, "long words " * 40_000), (5, "é" * 70)]


def test_frames(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").select("doc_id", "text", F.lit(1).alias("IDS"), F.lit(2).alias("decoded"))
    both = bpe.encode_decode(df, VOCABULARY)
    assert both.columns == ["doc_id", "text", "ids", "decoded"]
    got = {(r.doc_id, r.text): (r.ids, bytes(r.decoded)) for r in both.collect()}
    assert got == {(i, t): (LIBRARY.encode_ordinary(t or ""), (t or "").encode()) for i, t in ROWS}
    apart = bpe.decode(bpe.encode(df, VOCABULARY), VOCABULARY)
    assert {(r.doc_id, r.text): (r.ids, bytes(r.decoded)) for r in apart.collect()} == got and apart.count() == len(ROWS)
    assert bpe.encode_decode(df.limit(0), VOCABULARY).count() == 0


def test_query(spark, folder):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op8_bpe"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert tuple(r)[1:] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(texts[r.doc_id].encode()))
