"""A training loader as a stream: seeded epochs whose place survives a restart.

The source's offset is (epoch, position in the epoch's permutation); a batch is
the next so many positions of one epoch, so the checkpoint of the query is the
saved state of the loader.  A query that is stopped, or fails, anywhere in an
epoch and starts again on its checkpoint goes on where it was.

The source gives one row per batch, the positions' range.  The rows themselves
are put into the epoch's order once, by ranges of a hash of seed, epoch and
key, and written sorted by position; a batch then reads only the row groups
that its range falls in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tessera.operators.ordering import positions
from tessera.sources.files import exists

#: Rows of one file of an epoch's order, about.
FILE_ROWS = 1_000_000


class PositionReader(SimpleDataSourceStreamReader):
    """Ranges of positions: (epoch, first, end)."""

    def __init__(self, rows: int, batch: int, steps: int, drop_last: bool) -> None:
        if batch < 1:
            raise ValueError("a batch has at least one row")
        self.batch, self.steps = batch, steps
        self.used = rows - rows % batch if drop_last else rows
        self.per_epoch = -(-self.used // batch)

    def initialOffset(self) -> dict:
        return {"epoch": 0, "position": 0}

    def done(self, offset: dict) -> int:
        """Batches before the offset."""
        return offset["epoch"] * self.per_epoch + offset["position"] // self.batch

    def step(self, offset: dict) -> tuple[tuple[int, int, int], dict]:
        end = min(offset["position"] + self.batch, self.used)
        after = {"epoch": offset["epoch"], "position": end} if end < self.used else {"epoch": offset["epoch"] + 1, "position": 0}
        return (offset["epoch"], offset["position"], end), after

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if not self.used or self.done(start) >= self.steps:
            return iter(()), start
        row, after = self.step(start)
        return iter([row]), after

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        while self.done(start) < self.done(end):
            row, start = self.step(start)
            yield row


class Positions(DataSource):
    """Options rows, batch, steps and drop_last: `steps` batches in all, over as many epochs as they take."""

    @classmethod
    def name(cls) -> str:
        return "epoch_positions"

    def schema(self) -> str:
        return "epoch bigint, first bigint, end bigint"

    def simpleStreamReader(self, schema) -> PositionReader:
        return PositionReader(int(self.options["rows"]), int(self.options["batch"]), int(self.options["steps"]), self.options.get("drop_last", "true").lower() == "true")


def epoch_order(seed: int, epoch: int, key: Sequence[str]) -> list:
    """The order of an epoch: by a hash of seed, epoch and key, then by key."""
    return [F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), *(F.col(k).cast("string") for k in key))), *(F.col(k) for k in key)]


def shuffled(rows: DataFrame, key: Sequence[str], seed: int, epoch: int, store: str) -> DataFrame:
    """rows with their position in the epoch, written below `store` when the epoch is first read."""
    spark, path = rows.sparkSession, f"{store}/epoch={epoch}"
    if not exists(spark, f"{path}/_SUCCESS"):
        ordered = positions(rows, epoch_order(seed, epoch, key), "position")
        files = max(1, -(-rows.count() // FILE_ROWS))
        ordered.repartitionByRange(files, "position").sortWithinPartitions("position").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load(rows: DataFrame, key: Sequence[str], batch: int, steps: int, sink: Callable[[DataFrame, int], None], store: str, checkpoint: str, seed: int = 1, drop_last: bool = True) -> int:
    """Gives `sink` the batches up to step `steps` (counted from the first one ever), in order, and returns how many rows the table has.

    sink gets the batch's rows, with epoch and position, and its step, from 0.
    An epoch's incomplete last batch is left out with drop_last, and is smaller
    without.  The batch at which a run failed is given again by the next run on
    the checkpoint, with the same rows and step; no other is.  Rows of one key
    should differ in nothing: their places are any.  The table and the options must
    stay the same from run to run; only steps may grow.
    """
    spark = rows.sparkSession
    spark.dataSource.register(Positions)
    total = rows.count()
    per_epoch = (total - total % batch if drop_last else total) / batch

    def give(spec: DataFrame, _: int) -> None:
        for epoch, first, end in sorted(map(tuple, spec.collect())):  # a row per batch, one but for a replay
            part = shuffled(rows, key, seed, epoch, store).filter((F.col("position") >= first) & (F.col("position") < end))
            sink(part.withColumn("epoch", F.lit(epoch).cast("long")), int(epoch * -(-per_epoch // 1) + first // batch))

    options = {"rows": str(total), "batch": str(batch), "steps": str(steps), "drop_last": str(drop_last).lower()}
    query = spark.readStream.format("epoch_positions").options(**options).load().writeStream.foreachBatch(give).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return total
