"""Set operations on row batches, sampling, sharding and balancing."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def union_cast(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both, the second one's columns cast to the first one's types."""
    return a.unionByName(b.select(*(F.col(f.name).cast(f.dataType) for f in a.schema.fields)))


def union_filled(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both with the union of columns, nested ones too; missing strings are empty."""
    out = a.unionByName(b, allowMissingColumns=True)

    def filled(c: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.struct(*(filled(c[f.name], f.dataType).alias(f.name) for f in kind.fields))
        return F.coalesce(c, F.lit("")) if isinstance(kind, T.StringType) else c

    return out.select(*(filled(F.col(f.name), f.dataType).alias(f.name) for f in out.schema.fields))


def chunk(index: Column, total: int, chunks: int) -> Column:
    """Which of equal chunks a row is in; raises if the rows don't divide."""
    if total % chunks:
        raise ValueError(f"{total} rows are not {chunks} equal chunks")
    return F.floor(index / (total // chunks)).cast("long")


def split_size(index: Column, total: int, size: int) -> Column:
    if total % size:
        raise ValueError(f"{total} rows are not batches of {size}")
    return F.floor(index / size).cast("long")


def repeat_rows(df: DataFrame, times: int, name: str = "rep") -> DataFrame:
    """Every row `times` times: order by (row, rep) interleaves, by (rep, row) tiles."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(times - 1)).cast("array<bigint>")))


def pad_to_divisor(df: DataFrame, index: str, total: int, divisor: int) -> DataFrame:
    """Appends rows from the start until the count divides."""
    missing = -total % divisor
    rounds = -(-missing // total) if total else 0
    more = df.withColumn("__r", F.explode(F.sequence(F.lit(1), F.lit(rounds)))) if rounds else None
    out = df.withColumn("padded", F.lit(False))
    if more is None:
        return out
    more = more.withColumn(index, F.col(index) + F.col("__r") * total).filter(F.col(index) < total + missing).drop("__r")
    return out.unionByName(more.withColumn("padded", F.lit(True)))


def transpose(df: DataFrame, row: str, sample: str, value: str) -> DataFrame:
    pairs = F.sort_array(F.collect_list(F.struct(sample, value)))
    return df.groupBy(row).agg(F.transform(pairs, lambda x: x[value]).alias("values"))


def mini_batches(df: DataFrame, index: str, size: int, epochs: int) -> DataFrame:
    return repeat_rows(df, epochs, "epoch").withColumn("batch", F.floor(F.col(index) / size).cast("long"))


def shard(df: DataFrame, index: str, total: int, world: int) -> DataFrame:
    """Rows dealt to ranks in turn, the incomplete tail dropped."""
    return df.filter(F.col(index) < total - total % world).withColumn("rank", F.col(index) % world)


def drop_last(df: DataFrame, index: str, total: int, size: int) -> DataFrame:
    return df.filter(F.col(index) < total - total % size)


class _Split:
    """Sets of (place, length) by sum, size and members, the largest first; of two splits the one with the larger spread goes first."""

    def __init__(self, sets: list[tuple[int, int, list[tuple[int, int]]]]) -> None:
        self.sets = sorted(sets, reverse=True)
        self.rank = (self.sets[0][0] - self.sets[-1][0], self.sets[0])

    def __lt__(self, other: _Split) -> bool:
        return self.rank > other.rank

    def with_(self, other: _Split) -> _Split:
        """Largest sets meet smallest ones."""
        return _Split([(a[0] + b[0], a[1] + b[1], a[2] + b[2]) for a, b in zip(self.sets, reversed(other.sets), strict=True)])


def differenced(sizes: Sequence[int], parts: int, equal_size: bool = False) -> list[list[int]]:
    """The places of `sizes` in parts with nearly equal sums, by largest differencing."""
    if not sizes:
        return [[] for _ in range(parts)]
    if equal_size and len(sizes) % parts:
        raise ValueError("rows don't divide into parts")
    order = sorted((int(n), i) for i, n in enumerate(sizes))
    step = parts if equal_size else 1
    empty = [(0, 0, []) for _ in range(parts - step)]
    heap = [_Split([*((n, 1, [(i, n)]) for n, i in order[k : k + step]), *empty]) for k in range(0, len(order), step)]
    heapq.heapify(heap)
    while len(heap) > 1:
        first = heapq.heappop(heap)
        heapq.heapreplace(heap, first.with_(heap[0]))
    return [[i for i, _ in members] for _, _, members in heap[0].sets]


def balanced(df: DataFrame, batch: Sequence[str], key: str, length: str, parts: int, equal_size: bool = False) -> DataFrame:
    """Parts of each batch with nearly equal sums, by largest differencing.  A batch is one training step's rows, so it fits a task."""
    schema = T.StructType([*(df.schema[b] for b in batch), df.schema[key], T.StructField("part", T.IntegerType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key).reset_index(drop=True)
        part = [0] * len(rows)
        for k, members in enumerate(differenced(rows[length].tolist(), parts, equal_size)):
            for i in members:
                part[i] = k
        return rows.assign(part=part)[[*batch, key, "part"]]

    return df.groupBy(*batch).applyInPandas(run, schema)


def greedy_balanced(df: DataFrame, batch: Sequence[str], key: str, length: str, parts: int, equal_size: bool = False) -> DataFrame:
    """Rows in key order, each to the part with the least sum so far; equal_size: to one of those with the fewest rows."""
    schema = T.StructType([*(df.schema[b] for b in batch), df.schema[key], T.StructField("part", T.IntegerType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        if equal_size and len(rows) % parts:
            raise ValueError("rows don't divide into parts")
        heap, out = [(0, 0, k) for k in range(parts)], []
        for n in rows[length]:
            count, total, k = heap[0]
            out.append(k)
            heapq.heapreplace(heap, (count + equal_size, total + n, k))
        return rows.assign(part=out)[[*batch, key, "part"]]

    return df.groupBy(*batch).applyInPandas(run, schema)


def micro_batches(df: DataFrame, batch: Sequence[str], rank: str, key: str, length: str, most: int) -> DataFrame:
    """batch, rank, key, parts, part, position: each rank's rows in micro-batches of at most about `most` tokens.

    All ranks of a batch take as many parts as the one that needs most, so that they step together; each splits its
    own rows by largest differencing.  position is the row's place when the parts follow each other: the inverse
    of the order in which they are worked on.  A row longer than `most`, or a rank with fewer rows than parts, raises.
    """
    needs = df.groupBy(*batch, rank).agg(F.sum(length).alias("__n"), F.max(length).alias("__longest"), F.count("*").alias("__rows"))
    agreed = needs.groupBy(*batch).agg(F.max(F.ceil(F.col("__n") / most)).alias("__parts"), F.max("__longest").alias("__longest"), F.min("__rows").alias("__rows"))
    fault = F.when(F.col("__longest") > most, "a row is longer than a micro-batch").when(F.col("__parts") > F.col("__rows"), "a rank has fewer rows than micro-batches")
    agreed = agreed.select(*batch, F.when(fault.isNotNull(), F.raise_error(fault).cast("int")).otherwise(F.greatest(F.col("__parts"), F.lit(1)).cast("int")).alias("parts"))
    whole = df.select(*batch, rank, key, length).join(agreed, list(batch))
    schema = T.StructType([*(df.schema[b] for b in (*batch, rank, key)), *(T.StructField(n, T.IntegerType()) for n in ("parts", "part", "position"))])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key).reset_index(drop=True)
        part, position, at = [0] * len(rows), [0] * len(rows), 0
        for k, members in enumerate(differenced(rows[length].tolist(), int(rows["parts"].iloc[0]))):
            for i in members:
                part[i], position[i], at = k, at, at + 1
        return rows.assign(part=part, position=position)[[*batch, rank, key, "parts", "part", "position"]]

    return whole.groupBy(*batch, rank).applyInPandas(run, schema)
