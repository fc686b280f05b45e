import random
import unicodedata

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import token_counts as tc
from plumbline.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "The cat's I'LL 1234 ... don't!?", "<|endoftext|>a<|startoftext|><|endoftext|> b", "<|ENDOFTEXT|> <|endoftext", "ΑΣ ΣΑΣ ς", "İstanbul İ ÉÉ é",
    "A" * 5000 + "b" * 700, "日本語のテキスト 한국어 עברית", "a b　c\x1cd\x85e", "😀👍🏽 ½ Ⅷ ²", "ﬁ ﬂ ǅ ẞ", "\0a\0", "it's'S'Re", "x" * 49, "_" * 200_000,
]


@pytest.fixture(scope="module")
def vocabulary():
    return tc.read_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def lengths(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_proven_words_are_one_token(vocabulary, library):
    words = sorted(vocabulary.proven)
    assert len(words) > 30_000
    assert all(ids == [1] for ids in ([n] for n in lengths(library, [w for w in words if w == library.normalizer.normalize_str(w)][::7])))


def test_merges_against_the_library(vocabulary, library):
    rng = random.Random(7)
    counter = tc.Counter(vocabulary)
    texts = ["".join(rng.choice("abcdefghinorstu 'é9.ß中") for _ in range(rng.randint(0, 120))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x370, 0x700), rng.randrange(0x3040, 0x30FF), rng.randrange(0x1F300, 0x1F600)])) for _ in range(40)) for _ in range(2000)]
    texts = ["".join(c for c in t if unicodedata.category(c) != "Cn") for t in texts]
    assert [counter.count(t) for t in texts] == lengths(library, texts)
    for word in (b"abcabc" * 30, b"q", bytes(range(128, 256)) * 2, b"lalala" * 9):
        ids = [vocabulary.inner[b] for b in word[:-1]] + [vocabulary.last[word[-1]]]
        assert vocabulary._few(list(ids)) == vocabulary._many(list(ids))


def test_table_against_the_library(spark, vocabulary, library, monkeypatch):
    monkeypatch.setattr(tc, "CACHE", 0)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "again again"), (None, "again again")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", F.lit(9).alias("N_Tokens"), "text", F.lit("x").alias("Text_"))
    got = tc.count_tokens(df, vocabulary)
    assert got.columns == ["doc_id", "text", "Text_", "n_tokens"]
    found = got.collect()
    assert [r.n_tokens for r in found] == lengths(library, [r.text for r in found]) and len(found) == len(rows)
    assert tc.count_tokens(df.limit(0), vocabulary).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        tc.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))


def test_query(spark, folder, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op11_token_counts"](spark, folder).collect()
    assert len(got) == len(texts)
    want = dict(zip(texts, lengths(library, texts.values())))
    for r in got:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((texts[r.doc_id] or "").encode()), want[r.doc_id], want[r.doc_id] > 2048)
