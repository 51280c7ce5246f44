"""Against the SQL and against a plain search in whole numbers."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows):
    """rows: (vec_id, vector, label), labels as given."""
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v), lab) for i, v, lab in rows if lab is not None and ok(v)]
    out = []
    last = lambda i: (i is None, i or 0)
    for at, (i, v, label) in enumerate(kept):
        if i is None or i % 50:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), j, lab) for k, (j, w, lab) in enumerate(kept) if k != at and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            near = [s for s in scored if s[2] != label and 50 * p <= 100 * s[0] <= 95 * p][:3]
            out += [(i, j, k + 1, s[1], p, s[0]) for k, s in enumerate(near)]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_table_and_sql(spark, sf):
    path = f"/root/testdata/{sf}/embeddings.parquet"
    rows = got(H.mined(spark.read.parquet(path)))
    assert rows and rows == sorted(map(tuple, duckdb.sql(H.SQL.replace("FROM embeddings", f"FROM '{path}'")).fetchall()), key=repr)


def test_ties_copies_nulls_and_blocks(spark):
    noise = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in np.round(noise.normal(size=4), 1)], int(noise.integers(3))) for i in noise.integers(0, 400, 300)]
    rows += [(50, [1.0, 0.5, 0.0, -1.0], 1)] * 9 + [(7, [1.0, 0.5, 0.0, -1.0], 2)] * 70  # one label and vector in many rows
    rows += [(100, None, 1), (150, [1.0, None, 0.0, 0.0], 1), (200, [float("nan"), 0.0, 0.0, 0.0], 1), (250, [float("inf"), 0.0, 0.0, 0.0], 1), (300, [1.0, 0.0, 0.0, 0.0], None)]
    rows += [(None, [1.0, 0.5, 0.1, -1.0], 0), (350, [], 1), (400, [1.0, 2.0], 1), (401, [1.0, 2.0], 1), (402, [1.0, 1.0], 0), (450, [0.0] * 4, 1), (550, [1e30, 0.0, 0.0, 0.0], 1)]
    table = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("row"), F.lit("x").alias("anchor"), F.lit(0).alias("score"))
    expected = by_hand([r for r in rows if r[0] != 550])  # too large for a long
    for blocks in ({}, {"block_rows": 8, "block_anchors": 3}):
        assert got(H.mine(table, F.col("vec_id") % 50 == 0, **blocks)) == expected
    assert any(r[3] is None for r in expected) or len(expected) > 50


def test_relabelling(spark):
    rows = [(0, [1.0], 9), (7, [1.0], 3), (8, [1.0], 9), (None, [1.0], 2), (14, [1.0], None)]
    assert [r["label"] for r in H.relabelled(spark.createDataFrame(rows, SCHEMA)).collect()] == [0, 4, 9, 2, None]


def test_nothing_to_mine(spark):
    assert H.mined(spark.createDataFrame([], SCHEMA)).count() == 0
    assert H.mined(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 2)], SCHEMA)).count() == 0


def test_labels_of_other_types(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [1.0, 0.1], "a"), (2, [0.8, 0.1], "b"), (3, [0.1, 0.9], "c")]
    assert got(H.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), F.col("vec_id") == 0)) == [(0, 1, 1, 2, 65536, 52224)]


def test_sorted_places():
    noise = np.random.default_rng(1)
    for scale in (5, 1 << 60):
        scores = noise.integers(-scale, scale, (7, 100))
        assert (H.sorted_places(scores) == np.array([sorted(range(100), key=lambda j, r=r: (-int(r[j]), j)) for r in scores])).all()
    assert H.sorted_places(np.zeros((2, 0), np.int64)).shape == (2, 0)


def test_limits():
    for p in range(-300, 300):
        fits = [n for n in range(-400, 400) if 50 * p <= 100 * n <= 95 * p]
        low, high = H.limits(p, 50, 95)
        assert fits == list(range(low, high + 1))
