"""Streams over files: append-only output with resume, row counts while rewriting, a coefficient carried between steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.relational import pending
from tessera.sources.files import exists


def append_pending(stream: DataFrame, out: str, checkpoint: str, title: str = "title"):
    """A query that appends the stream's items whose title isn't in the output yet, as JSON lines.

    Restarted on the same checkpoint it goes on where it stopped; items that an
    interrupted batch had written already are not written again."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = pending(batch, spark.read.schema(batch.schema).json(out), title) if exists(spark, out) else batch
        fresh.write.mode("append").json(out)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rewrite(stream: DataFrame, out: str, checkpoint: str):
    """A query that rewrites the stream as Parquet in bounded micro-batches."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def files(spark: SparkSession, path: str, schema, per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def carried_coefficient(stream: DataFrame, key: str, current: str, start: float, target: float, horizon: float, steps: float) -> DataFrame:
    """The adaptive coefficient of each key after each batch of measurements, by state."""
    import pandas as pd

    def update(group, frames, state):
        beta = state.get[0] if state.exists else start
        for rows in frames:
            for x in rows[current]:
                beta *= 1 + max(-0.2, min(0.2, x / target - 1)) * steps / horizon
        state.update((beta,))
        yield pd.DataFrame({key: [group[0]], "beta": [beta]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, beta double", "beta double", "update", "NoTimeout")


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Extension: counts per tumbling window and key, rows later than the watermark left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
