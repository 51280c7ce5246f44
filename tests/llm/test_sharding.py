"""Against the SQL, and the law of rendezvous hashing: only the shards that change give or take."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import AWKWARD
from tessera.llm import sharding as S

DATA = "/root/testdata/sf0.001"


def by_hand(key, weights):
    def drawn(s):
        h = int(hashlib.md5(f"31:{s}:{'' if key is None else key}".encode()).hexdigest()[:13], 16)
        return -math.log((h + 0.5) / 2**52) / weights[s]

    return min(range(len(weights)), key=drawn)


def law(rows):
    """Slots are gapless in every shard; one more shard takes rows only into itself."""
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    assert all(r["shard"] == by_hand(r["doc_id"], [1.0] * 8) and r["grown_shard"] == by_hand(r["doc_id"], [1.0] * 9) and r["law"] == "key" for r in rows)


def test_table_and_sql(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = S.sharded(docs)
    rows = out.collect()
    law(rows)
    expected = duckdb.sql(S.SQL.replace("FROM documents", f"FROM '{DATA}/documents.parquet'"))
    assert out.columns == expected.columns and sorted(map(tuple, rows)) == sorted(expected.fetchall())
    text = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    assert all(r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["size"] == len(text[r["doc_id"]]) + 1 for r in rows)


def test_awkward(awkward, nothing):
    rows = S.sharded(awkward.select("*", F.lit(0).alias("slot"), F.lit(0).alias("shard"))).collect()
    law(rows)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len((t or "").encode()) + 1) for i, t, *_ in AWKWARD)
    assert S.sharded(nothing).count() == 0


def test_slots_do_not_depend_on_partitions_or_ranges(spark):
    docs = spark.range(3000).select(F.when(F.col("id") < 1000, 5).otherwise(F.col("id") % 900).alias("doc_id"), F.when(F.col("id") < 1000, "same").otherwise(F.concat(F.lit("t"), F.col("id") % 7)).alias("text"))
    rows = sorted(map(tuple, S.sharded(docs).collect()))
    law(S.sharded(docs).collect())
    narrow = docs.repartition(7).select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))
    placed = S.assigned(narrow, "doc_id", {"shard": [1.0] * 8, "grown_shard": [1.0] * 9})
    cut = S.slotted(placed, range_rows=50, alike=64).select("doc_id", "size", "text_crc32", F.lit("key"), "shard", "slot", "grown_shard")
    assert sorted(map(tuple, cut.collect())) == rows


def test_weights(spark):
    keys = spark.range(40_000).withColumnRenamed("id", "key")
    weights = [1.0, 2.0, 5.0]
    counts = {r["shard"]: r["count"] for r in S.assigned(keys, "key", {"shard": weights}).groupBy("shard").count().collect()}
    assert all(abs(counts[s] / 40_000 - w / 8) < 0.01 for s, w in enumerate(weights))
    assert {r["shard"] for r in keys.limit(300).select(S.shard_of(F.col("key"), {4: 1, 9: 2}).alias("shard")).collect()} == {4, 9}
    with pytest.raises(ValueError):
        S.shard_of(F.col("key"), [1.0, 0.0])


def test_changes_move_few(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "key")
    flows = lambda old, new: [tuple(r) for r in S.moved(keys, "key", old, new).collect()]
    more = flows([1] * 8, [1] * 9)
    assert {t for _, t, _ in more} == {8} and abs(sum(n for *_, n in more) / 20_000 - 1 / 9) < 0.01
    gone = flows({0: 1, 1: 1, 2: 1}, {0: 1, 2: 1})
    assert {s for s, *_ in gone} == {1} and abs(sum(n for *_, n in gone) / 20_000 - 1 / 3) < 0.02
    heavier = flows([1, 1, 1], [1, 2, 1])
    assert {t for _, t, _ in heavier} == {1}
    lighter = flows([1, 2, 1], [1, 1, 1])
    assert {s for s, *_ in lighter} == {1}
    assert flows([1, 2], [2, 4]) == []
