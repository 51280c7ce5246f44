"""Batches collected in state, over several runs, against a loop over the rounds."""

import pytest
from pyspark.sql import functions as F

from tessera.streaming import full
from tessera.streaming import resume as S

SCHEMA = "lane string, round long, uid long, scores array<double>, _note long"


def write(spark, path, rounds):
    for number, rows in rounds:
        spark.createDataFrame([(lane, number, uid, scores, None if uid % 5 == 0 else -uid) for lane, uid, scores in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, size, most=0):
    stream = S.files(spark, str(tmp_path / "in"), SCHEMA)
    out = full.collected(stream, "lane", F.col("round"), F.col("uid"), full.varied(F.col("scores")), ["uid", "_note"], size, most)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("lane", "batch", "position").collect()
    return [(r["lane"], r["batch"], r["position"], r["uid"], r["_note"]) for r in got]


def by_hand(rounds, size):
    out = []
    for lane in sorted({r[0] for _, rows in rounds for r in rows}):
        held, groups, batch = [], 0, 0
        for _, rows in rounds:
            good = sorted(uid for name, uid, s in rows if name == lane and s is not None and (len(set(s)) > 1 or len(s) == 1))
            held, groups = held + good, groups + len(good)
            if groups >= size:
                out += [(lane, batch, k, uid, None if uid % 5 == 0 else -uid) for k, uid in enumerate(held[:size])]
                held, groups, batch = [], 0, batch + 1
    return out


def rounds_of(numbers):
    return [(n, [("ab"[u % 2], 1000 * n + u, None if u % 11 == 0 else [0.5] if u % 7 == 0 else [float(u % 3 == 0), 0.0]) for u in range(30 - 3 * n)]) for n in numbers]


def test_batches_over_several_runs(spark, tmp_path):
    got = []
    for numbers in ([0], [1, 2], [3], [4, 5, 6]):
        write(spark, str(tmp_path / "in"), rounds_of(numbers))
        got = run(spark, tmp_path, 10)
    expected = by_hand(rounds_of(range(7)), 10)
    assert got == expected and {b for _, b, *_ in got} >= {0, 1} and max(sum(x[:2] == y[:2] for y in got) for x in got) == 10


def test_too_many_rounds(spark, tmp_path):
    write(spark, str(tmp_path / "in"), [(0, [("a", 1, [0.0, 1.0])])])
    assert run(spark, tmp_path, 2, most=2) == []
    write(spark, str(tmp_path / "in"), [(1, [("a", 2, [1.0, 1.0])])])
    with pytest.raises(Exception, match="1 groups of 2 after 2 rounds"):
        run(spark, tmp_path, 2, most=2)
