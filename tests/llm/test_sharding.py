import zlib

from pyspark.sql import functions as F

from plumbline.llm import queries
from plumbline.llm.sharding import shuffled, text_bytes, write_shards

KIND = "doc_id bigint, text string, shard string"
ROWS = [(i, f"text {i % 7} " * (i % 50), "x") for i in range(3000)] + [(None, None, None), (5, "", "y")] * 5


def test_law_order_and_whole_rows(spark):
    df = spark.createDataFrame(ROWS, KIND)
    got = shuffled(df, 24, text_bytes(), bucket_bytes=50_000).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in got))) == sorted(str((i, t)) for i, t, _ in ROWS)
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r.slot)
    assert set(sizes) == set(range(24))
    assert max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    again = shuffled(df, 24, text_bytes(), bucket_bytes=50_000)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    other = shuffled(df, 24, text_bytes(), bucket_bytes=50_000, seed=7)
    assert sorted(map(str, other.collect())) != sorted(map(str, got))


def test_order_is_mixed_inside_a_bucket(spark):
    got = shuffled(spark.createDataFrame(ROWS[:1000], KIND), 1, text_bytes()).orderBy("slot").collect()
    ids = [r.doc_id for r in got]
    assert sorted(ids) == list(range(1000)) and sum(b == a + 1 for a, b in zip(ids, ids[1:])) < 20
    # neither is it the order of the hash that brings the bucket into a fixed order
    frame = spark.createDataFrame(ROWS[:1000], KIND).drop("shard")
    hashed = [r.doc_id for r in frame.orderBy(F.xxhash64(F.lit(43), "doc_id", "text")).collect()]
    assert sum(a == b for a, b in zip(ids, hashed)) < 20


def test_small_tables_and_plan(spark, tmp_path):
    df = spark.createDataFrame(ROWS, KIND)
    assert shuffled(df.limit(0), 3, text_bytes()).count() == 0
    assert [(r.shard, r.slot) for r in shuffled(df.limit(1), 3, text_bytes()).collect()] == [(0, 0)]
    plan = shuffled(df, 3, text_bytes())._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    write_shards(df, f"{tmp_path}/out", 4, text_bytes())
    assert spark.read.parquet(f"{tmp_path}/out").groupBy("shard").count().count() == 4


def test_query(spark, folder):
    got = queries.QUERIES["op5_sharding"](spark, folder).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)
