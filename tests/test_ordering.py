"""Positions and running sums: whole, exact and the same every time."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import ordering as O
from tessera.operators import relational as R
from tessera.operators import statistics as G


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("hashed", [False, True])
def test_wide_rows(many_partitions, hashed):
    rows = many_partitions.range(600_000, numPartitions=24).select("id", F.repeat(F.md5(F.col("id").cast("string")), 12).alias("wide"))
    order = R.shuffled_order(42, F.col("id")) if hashed else [F.col("id")]
    got = O.positions(rows, order, range_rows=10_000)
    seen = got.agg(F.count("*"), F.count_distinct("index"), F.min("index"), F.max("index"), F.count_if(F.col("index") != F.col("id")), F.sum(F.length("wide"))).first()
    assert tuple(seen)[:4] == (600_000, 600_000, 0, 599_999) and seen[5] == 600_000 * 384
    assert hashed or seen[4] == 0
    if hashed:
        expected = [r[0] for r in rows.orderBy(*order).select("id").limit(2_000).collect()]
        assert [r["id"] for r in got.filter("index < 2000").orderBy("index").collect()] == expected


def test_ranges_of_two_levels(many_partitions, monkeypatch):
    """More rows than the first level's ranges hold are cut again, and numbered alike."""
    monkeypatch.setattr(O, "RANGES", 4)
    monkeypatch.setattr(O, "INNER", 16)
    rows = many_partitions.range(60_000, numPartitions=8).select(F.col("id"), F.when(F.col("id") % 5 == 0, None).otherwise(F.md5(F.col("id").cast("string"))).alias("k"))
    keyed = rows.select("*", F.col("k").alias("__o0"), F.col("id").alias("__o1"))
    sizes = [r["count"] for r in O._with_range(keyed, ["__o0", "__o1"], 60_000, 1_000).groupBy("__range").count().collect()]
    assert len(sizes) > 30 and max(sizes) < 6_000
    got = O.positions(rows, [F.col("k"), F.col("id")], range_rows=1_000)
    assert [r["id"] for r in got.orderBy("index").collect()] == [r["id"] for r in rows.orderBy("k", "id").collect()]
    both = O.sums_before(rows, [F.col("id")], {"a": F.col("id"), "b": F.lit(2)}, range_rows=1_000)
    assert both.filter("a <> id * (id - 1) / 2 OR b <> 2 * id").count() == 0 and both.count() == 60_000


def test_nulls_ties_and_nothing(spark):
    rows = spark.createDataFrame([(None, 1), (3, 2), (3, 3), (1, 4), (None, 5)], "k long, x long")
    for size in (1, 2, 100):
        got = O.sum_before(rows, [F.col("k"), F.col("x")], F.col("x"), "before", range_rows=size)
        assert sorted((r["x"], r["before"]) for r in got.collect()) == [(1, 0), (2, 10), (3, 12), (4, 6), (5, 1)]
    assert O.positions(rows.limit(0), [F.col("k")]).count() == 0


def test_batch_and_split(spark):
    groups = spark.range(1_000).select("id", (F.col("id") % 3 + 1).alias("n"))
    kept = R.fill_batch(groups, [F.col("id")], "n", 64)
    total, expected = 0, []
    for i in range(1_000):
        if total < 64:
            expected.append(i)
        total += i % 3 + 1
    assert sorted(r["id"] for r in kept.collect()) == expected
    rows = spark.range(3_000).select((F.col("id") % 500).alias("g"))
    split = G.group_split(rows, "g", 42, 100).groupBy("g").agg(F.count_distinct("split").alias("kinds"), F.first("split").alias("s")).collect()
    assert all(r["kinds"] == 1 for r in split) and sum(r["s"] == "val" for r in split) == 16


def test_upper_median(spark):
    rows = spark.createDataFrame([(g, x) for g in range(1, 40) for x in [(7 * i * i) % 23 for i in range(g)]], "g long, x long")
    got = {r["g"]: r["m"] for r in rows.groupBy("g").agg(G.upper_median("x").alias("m")).collect()}
    assert got == {g: sorted((7 * i * i) % 23 for i in range(g))[g // 2] for g in range(1, 40)}
