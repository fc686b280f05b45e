import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plumbline.llm.simhash import fingerprint, keep_first, links, near_duplicates
from plumbline.llm.components import connected_components


def brute_print(text, width):
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum((h >> b) & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_groups(prints, bits):
    values = np.array(prints, dtype=np.uint64)
    label = np.arange(len(values))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= bits
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("bits,limit", [(2, 4096), (2, 4), (5, 4096), (5, 20)])
def test_links_connect_what_brute_force_connects(spark, bits, limit):
    rng = np.random.default_rng(bits * 100 + limit)
    base = rng.integers(0, 2**64, 12, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base:
        for _ in range(25):
            flips = rng.choice(64, rng.integers(1, 2 * bits), replace=False)
            prints.add(int(b) ^ sum(1 << int(i) for i in flips))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    found = dict(map(tuple, connected_components(links(df, bits, limit)).collect()))
    ours = [found.get(p, p) for p in signed]
    want = brute_groups(prints, bits)
    assert len(set(zip(ours, want))) == len(set(ours)) == len(set(want))


ROWS = [
    (5, "The quick brown fox jumps over the lazy dog " * 30),
    (3, "the QUICK brown fox jumps over the lazy dog " * 30),
    (8, "one two"), (9, "one two"), (9, "one two"), (10, None), (11, ""), (12, " \t\n"),
    (None, "Élan vital"), (2, "y " * 50_000), (4, "nothing shared with any of the other rows here"),
]


def test_contract_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").select("doc_id", "text", F.lit(1).alias("Text"), F.lit("x").alias("fp"))
    got = sorted(map(tuple, near_duplicates(df).select("doc_id", "fp", "component_id").collect()), key=str)
    prints = [brute_print(t, 3) for _, t in ROWS]
    label = brute_groups(prints, 2)
    ids = {g: min([i for (i, _), x in zip(ROWS, label) if x == g and i is not None], default=None) for g in label}
    want = [(i, p - (1 << 64) if p >> 63 else p, ids[g]) for (i, _), p, g in zip(ROWS, prints, label)]
    assert got == sorted(want, key=str)


def test_hashes_of_short_texts():
    assert fingerprint(None, 3) == [] and fingerprint(" \n", 3) == []
    assert fingerprint("A b", 3) == [xxhash.xxh64_intdigest(b"a b", 42)]


def test_one_of_each_group_stays(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string").withColumn("first", F.lit(1))
    kept = keep_first(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["10", "2", "3", "4", "8", "None"]
    assert keep_first(df.limit(0)).count() == 0 and near_duplicates(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b c d")] * 5 + [(1, "other words stand here")], "doc_id bigint, text string")
    assert keep_first(twice).count() == 2
