"""What the operators share: shared-folder tables, worker caches, guards."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word and line rules name it.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Only where that is unset and Spark runs on this machine alone, as in tests,
    a temporary folder serves."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends
    here, an executor that is lost takes nothing with it, and the optimizer
    sees the real size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what table() wrote for df; everything made from it must be written by now."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(df.written_to).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(df: DataFrame) -> Column:
    """Null counts as empty."""
    return F.coalesce(df["text"], F.lit(""))


def bounded(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; looks at no more than that."""
    return df.limit(rows + 1).count() <= rows


def give_back() -> None:
    """At the end of a task: return freed memory to the system, since workers
    outlive their tasks and the next one may be another operator's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not this C library; its own rules hold
