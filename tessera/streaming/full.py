"""Groups collected over generation rounds until a batch is full, as a stateful operator.

Each lane (a trainer, a source) holds in state the passing groups of its rounds
so far, their number and the number of rounds.  When there are as many as a
batch takes, the first ones, by round and place, are handed over; the surplus
is dropped and counting starts again.  A lane that is not full after the most
rounds that are allowed fails the stream.

State and memory of a lane are a batch's groups at most: of a round only the
first ones that still fit are kept, the others are counted.  A checkpoint holds
the state, so a restarted query goes on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NotFull(ValueError):
    """A batch was not full after the rounds that are allowed."""


class Collector(StatefulProcessor):
    """Input columns: lane, round, place, passes, payload columns; output: lane, batch, position, payload columns."""

    def __init__(self, lane: str, payload: list[T.StructField], size: int, most_rounds: int) -> None:
        self.lane, self.size, self.most_rounds = lane, size, most_rounds
        self.names = [f.name for f in payload]
        self.whole = [isinstance(f.dataType, T.IntegralType) for f in payload]
        self.held_schema = T.StructType([T.StructField("r", T.LongType()), T.StructField("p", T.LongType()), *payload])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", self.held_schema)
        self.counts = handle.getValueState("counts", "groups bigint, rounds bigint, batches bigint")

    def cells(self, row: list) -> tuple:
        """A frame's cells as the state takes them: nulls as None, whole numbers whole beside nulls too."""
        null = lambda x: x is None or x is pd.NA or (isinstance(x, float) and x != x)
        return tuple(None if null(x) else int(x) if whole else x for x, whole in zip(row, self.whole, strict=True))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Of each round, the first groups that fit a batch, and how many pass.
        first: dict[int, list] = {}
        passing: dict[int, int] = {}
        for frame in rows:
            frame.columns = ["lane", "round", "place", "passes", *range(len(self.names))]  # names that begin with an underscore arrive changed
            for number, own in frame.groupby("round", sort=False):
                good = own[own["passes"].astype(bool)]
                passing[number] = passing.get(number, 0) + len(good)
                some = [(int(p), self.cells(x)) for p, *x in good.drop(columns=["lane", "round", "passes"]).itertuples(index=False, name=None)]
                first[number] = heapq.nsmallest(self.size, [*first.get(number, []), *some], key=lambda x: x[0])
        groups, rounds, batches = self.counts.get() if self.counts.exists() else (0, 0, 0)
        held = [tuple(x) for x in self.held.get()] if self.held.exists() else []
        for number in sorted(passing):
            held += [(int(number), p, *x) for p, x in first[number][: self.size - len(held)]]
            groups, rounds = groups + passing[number], rounds + 1
            if groups >= self.size:
                out = pd.DataFrame([x[2:] for x in held], columns=self.names, dtype=object)
                out.insert(0, "position", range(len(held)))
                out.insert(0, "batch", batches)
                out.insert(0, self.lane, key[0])
                yield out
                held, groups, rounds, batches = [], 0, 0, batches + 1
            elif 0 < self.most_rounds <= rounds:
                raise NotFull(f"{key[0]}: {groups} groups of {self.size} after {rounds} rounds")
        self.counts.update((groups, rounds, batches))
        if held:
            self.held.put(held)
        else:
            self.held.clear()

    def close(self) -> None:
        pass


def collected(stream: DataFrame, lane: str, round_: Column, place: Column, passes: Column, payload: list[str], size: int, most_rounds: int = 0) -> DataFrame:
    """lane, batch (from 0), position (from 0) and payload of the groups that are handed over, each lane's batches of `size` groups.

    stream has a row per group.  A lane's rounds follow each other by number; all
    of a lane's round must come in one micro-batch, as from a file per round written after the one before,
    and a round without rows in a lane isn't one of it.  place orders a round's
    groups, null ones aside; passes tells which of them count, null none.  most_rounds: rounds that
    a batch may take, 0 any number; a lane that takes more fails with NotFull.  NaN in the payload becomes null.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")  # a micro-batch writes its changes, not each partition's whole state
    fields = [stream.schema[c] for c in payload]
    kind = stream.schema[lane].dataType
    rows = stream.select(lane, round_.cast("long").alias("__round"), place.cast("long").alias("__place"), F.coalesce(passes & place.isNotNull(), F.lit(False)).alias("__passes"), *payload)
    out = T.StructType([T.StructField(lane, kind), T.StructField("batch", T.LongType()), T.StructField("position", T.LongType()), *fields])
    return rows.groupBy(lane).transformWithStateInPandas(Collector(lane, fields, size, most_rounds), out, "Append", "None")


def varied(metrics: Column) -> Column:
    """Whether a group's metrics, an array, differ, or there is only one."""
    return (F.array_max(metrics) > F.array_min(metrics)) | (F.size(metrics) == 1)
