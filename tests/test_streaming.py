"""Streams run to completion over small folders."""

from pyspark.sql import functions as F

from tessera.streaming import resume as S


def test_resume(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2), ("", 3)], "title string, x long").write.parquet(str(tmp_path / "in"))
    for k in ("one", "two"):  # a second run has nothing to add but the blank title
        stream = S.files(spark, str(tmp_path / "in"), "title string, x long", 10)
        S.append_pending(stream, str(tmp_path / "out"), str(tmp_path / k)).awaitTermination()
    got = spark.read.schema("title string, x long").json(str(tmp_path / "out")).groupBy("title").count().collect()
    assert {r["title"]: r["count"] for r in got} == {"a": 1, "b": 1, "": 2}


def test_rewrite(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "in"))
    S.rewrite(S.files(spark, str(tmp_path / "in"), "id long"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("id")).first()[0] == 4950


def test_carried_coefficient(spark, tmp_path):
    spark.createDataFrame([("k", 2.0), ("k", 0.5)], "key string, kl double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = S.files(spark, str(tmp_path / "in"), "key string, kl double")
    out = S.carried_coefficient(stream, "key", "kl", 0.2, 1.0, 10.0, 1.0)
    out.writeStream.format("memory").queryName("coefficients").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    got = spark.sql("SELECT beta FROM coefficients").collect()[-1]["beta"]
    assert abs(got - 0.2 * 1.02 * 0.98) < 1e-12


def test_windowed_counts(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, 'a' AS k UNION ALL SELECT timestamp'2024-01-01 00:02:00', 'a'").write.parquet(str(tmp_path / "in"))
    stream = S.windowed_counts(S.files(spark, str(tmp_path / "in"), "ts timestamp, k string"), "ts", "k")
    stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [r["n"] for r in spark.sql("SELECT n FROM counts").collect()] == [2]
