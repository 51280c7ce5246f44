"""Readers and writers of files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet_dir(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet files of one folder; raises if there are none."""
    return spark.read.parquet(path)


def parquet_recursive(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """All Parquet files below a folder, folder names not read as columns."""
    reader = spark.read.option("recursiveFileLookup", True)
    return (reader.schema(schema) if schema else reader).parquet(path)


def parquet_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.parquet(*paths)


def exists(spark: SparkSession, path: str) -> bool:
    """In any file system that Spark reads."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in files.listStatus(p)] if files.exists(p) else []


def jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """One JSON object per line.  Strict: a bad line raises.  Otherwise bad lines are left out and a missing path is empty."""
    if not strict and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def percent_slice(df: DataFrame, order: Sequence[Column], low: int, high: int) -> DataFrame:
    """Rows from low to high percent of an order."""
    from tessera.operators.ordering import positions

    n = df.count()
    return positions(df, order, "__i").filter((F.col("__i") >= n * low // 100) & (F.col("__i") < n * high // 100)).drop("__i")


def nested(df: DataFrame, keys: Sequence[str]) -> Column:
    """A cell by a path of keys; an array on the way must hold one element, which is taken."""
    field, out = df.schema[keys[0]].dataType, F.col(keys[0])
    for key in keys[1:]:
        if isinstance(field, T.ArrayType):
            out, field = F.get(out, F.lit(0)), field.elementType
        out, field = out[key], field[key].dataType
    return F.get(out, F.lit(0)) if isinstance(field, T.ArrayType) else out


def in_batches(df: DataFrame, rows: int) -> DataFrame:
    """Streams the rows through Arrow batches of at most so many rows."""

    def run(it):
        for batch in it:
            for i in range(0, batch.num_rows, rows):
                yield batch.slice(i, rows)

    return df.mapInArrow(run, df.schema)


def write_parquet(df: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Writes and reads back."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "snappy").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_counted(df: DataFrame, path: str, source: str) -> DataFrame:
    """Writes, and counts the rows of each source as written."""
    return write_parquet(df, path).groupBy(source).agg(F.count("*").alias("n"))


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_by_status(df: DataFrame, path: str, status: str, good: str) -> tuple[DataFrame, DataFrame]:
    """Successes and the rest in two folders."""
    return write_parquet(df.filter(F.col(status) == good), f"{path}/success"), write_parquet(df.filter(~F.col(status).eqNullSafe(good)), f"{path}/fail")


def metric_line(step: Column, metrics: dict[str, Column]) -> Column:
    """step:S - key:value with three decimals."""
    parts = [F.concat(F.lit("step:"), step.cast("string")), *(F.concat(F.lit(f"{k}:"), F.format_string("%.3f", v)) for k, v in metrics.items())]
    return F.concat_ws(" - ", *parts)


def write_observed(df: DataFrame, path: str, keep: Column, before: dict[str, Column], after: dict[str, Column]) -> tuple[DataFrame, dict]:
    """Writes the rows that `keep` selects, and measures while writing: aggregates of all rows and of the written ones.

    One job reads the input once, writes and measures; the numbers are of the rows that were written."""
    from pyspark.sql import Observation

    seen, kept = Observation(), Observation()
    rows = df.observe(seen, *(c.alias(k) for k, c in before.items())).filter(keep).observe(kept, *(c.alias(k) for k, c in after.items()))
    rows.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), {**seen.get, **kept.get}
