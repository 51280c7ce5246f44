"""Held-out accuracy, traversal and awkward rows."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import quality as Q

DATA = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = Q.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert ((got["score"] >= 0.7) == got["quality"]).mean() > 0.95
    good, bad = got["score"][got["quality"] == 1].to_numpy(), got["score"][got["quality"] == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97


def test_flat_trees_follow_each_row():
    noise = np.random.default_rng(0)
    x = noise.normal(size=(400, 5))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    trees = Q.fit(x, y)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95

    def walk(row):
        total = trees.base
        for i in trees.roots:
            while trees.left[i] != i:
                i = trees.left[i] if row[trees.feature[i]] <= trees.threshold[i] else trees.right[i]
            total += trees.value[i]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x[:20]), [walk(r) for r in x[:20]])


def test_statistics_are_per_text():
    texts = ["Some words here.\nSome words here.", "", "ALL!! CAPS!!", "a a a a", "one"]
    together = Q.batch_statistics(pa.array(texts))
    for t, row in zip(texts, together, strict=True):
        assert np.allclose(Q.batch_statistics(pa.array([t]))[0], row)
    f = dict(zip(Q.FEATURES, together.T, strict=True))
    assert f["distinct_lines"][0] == 0.5 and f["repeated_neighbours"][3] == 0.75 and f["upper"][2] == 1 and f["log_words"][1] == 0


def test_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, None), (8, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = Q.classify(awkward, labels).collect()
    assert len(got) == 12 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (3, 4)}) == 1
    assert Q.classify(nothing, labels.limit(0)).count() == 0
    assert {r["score"] for r in Q.classify(awkward, labels.limit(0)).collect()} == {0.5}
    assert Q.keep_good(awkward, labels).columns == awkward.columns


def test_labels_rule(spark):
    import zlib

    rows = spark.range(50).select("id", Q.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)
