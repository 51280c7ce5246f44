"""Positions and running sums in a total order, without one task that sorts everything.

The order's range is cut at keys of a sample, which the driver keeps as
constants: a row's range depends on its own key alone, so that counting and
numbering agree however often, and by whatever tasks, the rows are computed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one range, about; ranges of the first level at most, and ranges that each of them is cut into (more rows than
#: RANGES * INNER ranges hold make longer ranges, which spill); sampled keys for each range.
RANGE_ROWS, RANGES, INNER, SAMPLED = 100_000, 1_024, 256, 32


def _cuts(keyed: DataFrame, keys: Sequence[str], ranges: int, rows: int) -> list[Column]:
    """Literal keys that cut the order into about so many ranges."""
    share = min(1.0, 2 * SAMPLED * ranges / rows)
    sampled = keyed.select(*keys).sample(share, 7).orderBy(*keys).collect()  # about 64 keys for each range
    step = max(1, len(sampled) // ranges)
    chosen = list(dict.fromkeys(tuple(r) for r in sampled[step::step]))
    return [F.struct(*(F.lit(v).cast(keyed.schema[k].dataType).alias(k) for k, v in zip(keys, c, strict=True))) for c in chosen]


def _range(cuts: list[Column], key: Column) -> Column:
    """How many cuts are below the key: first among every 32nd of them, then among 32."""
    if not cuts:
        return F.lit(0)
    wide = 32
    coarse, every = F.array(*cuts[::wide]), F.array(*cuts)
    block = F.size(F.filter(coarse, lambda c: c < key))
    inside = F.size(F.filter(F.slice(every, F.greatest(block - 1, F.lit(0)) * wide + 1, wide), lambda c: c < key))
    return F.when(block == 0, 0).otherwise((block - 1) * wide + inside)


def _with_range(keyed: DataFrame, keys: Sequence[str], rows: int, range_rows: int) -> DataFrame:
    """keyed with __range: 0 to RANGES cut in two levels.  The first level's cuts are constants of the plan; where ranges
    would be longer than range_rows, each is cut again at keys of its own sample, which come from a table of a row per range."""
    ranges = min(RANGES, -(-rows // range_rows))
    cuts = _cuts(keyed, keys, ranges, rows) if ranges > 1 else []
    ranged = keyed.withColumn("__range", _range(cuts, F.struct(*keys)).cast("long"))
    inner = min(INNER, rows // (range_rows * (len(cuts) + 1)))
    if inner < 2:
        return ranged
    sampled = ranged.filter(F.pmod(F.xxhash64(*keys), F.lit(max(1, range_rows // SAMPLED))) == 0)  # by key, so that every run cuts alike
    listed = F.array_sort(F.collect_set(F.struct(*keys)))  # about SAMPLED * inner keys of a range
    step = F.greatest(F.floor(F.size("__k") / inner), F.lit(1)).cast("int")
    chosen = F.filter("__k", lambda x, i: (i + 1) % step == 0)
    second = sampled.groupBy(F.col("__range").alias("__r")).agg(listed.alias("__k")).select("__r", F.slice(chosen, 1, INNER - 1).alias("__cuts"))
    out = ranged.join(F.broadcast(second), F.col("__range") == F.col("__r"), "left")  # RANGES rows of INNER keys at most
    below = F.coalesce(F.size(F.filter("__cuts", lambda c: c < F.struct(*keys))), F.lit(0))
    return out.withColumn("__range", F.col("__range") * INNER + below).drop("__r", "__cuts")


def _ranged(df: DataFrame, order: Sequence[Column], value: Column, range_rows: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """df with its keys, value (__v) and __range; per range __r its sum __s and the sum before it, __offset; the keys' names."""
    keys = [f"__o{i}" for i in range(len(order))]
    keyed = df.select("*", *(c.alias(k) for c, k in zip(order, keys, strict=True)), value.cast("long").alias("__v"))
    ranged = _with_range(keyed, keys, keyed.count(), range_rows)
    sums = ranged.groupBy("__range").agg(F.sum("__v").alias("__s"))
    # One row for each range.
    offsets = sums.select(F.col("__range").alias("__r"), "__s", (F.sum("__s").over(Window.orderBy("__range")) - F.col("__s")).alias("__offset"))
    return ranged, offsets, keys


def sums_before(df: DataFrame, order: Sequence[Column], values: dict[str, Column], range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with, by name, the sum of each value (whole numbers) over all rows before the row in
    the order, ascending, nulls first; 0 for the first row.  Rows of equal keys come in any order, one for all values.

    Rows that fit one range are ordered by one task; the others by ranges."""
    keys = [f"__o{i}" for i in range(len(order))]
    held = {n: f"__v{i}" for i, n in enumerate(values)}
    keyed = df.select("*", *(c.alias(k) for c, k in zip(order, keys, strict=True)), *(v.cast("long").alias(held[n]) for n, v in values.items()))
    before = lambda w, v: F.coalesce(F.sum(v).over(w.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = keyed.count()
    if rows <= range_rows:
        return keyed.select(*df.columns, *(before(Window.partitionBy(), v).cast("long").alias(n) for n, v in held.items()))
    ranged = _with_range(keyed, keys, rows, range_rows)
    sums = ranged.groupBy("__range").agg(*(F.sum(v).alias(v) for v in held.values()))
    # One row for each range.
    offsets = sums.select(F.col("__range").alias("__r"), *((F.sum(v).over(Window.orderBy("__range")) - F.col(v)).alias(f"{v}_offset") for v in held.values()))
    summed = ranged.select("*", *(before(Window.partitionBy("__range"), v).alias(f"{v}_before") for v in held.values()))
    joined = summed.join(F.broadcast(offsets), F.col("__range") == F.col("__r"))
    return joined.select(*df.columns, *((F.col(f"{v}_offset") + F.col(f"{v}_before")).cast("long").alias(n) for n, v in held.items()))


def sum_before(df: DataFrame, order: Sequence[Column], value: Column, name: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """sums_before() of one value."""
    return sums_before(df, order, {name: value}, range_rows)


def draw_places(spark, k: int, n: int, seed: int) -> DataFrame:
    """draw (0 to k - 1) and __place (0 to n - 1), by a hash of seed and draw; __place differs from even odds by less than n / 2**52."""
    hashed = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("draw").cast("string"))), 1, 13), 16, 10).cast("long")
    return spark.range(k).select(F.col("id").alias("draw")).withColumn("__place", F.pmod(hashed, F.lit(n)))


def drawn(df: DataFrame, order: Sequence[Column], k: int, seed: int = 0, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Exactly k rows of df with replacement, each with its draw, from 0; no row of an empty df.

    The draws are places in the order, so they are the same however df is split.  Rows are
    counted by range; only the ranges that are drawn from are numbered."""
    ranged, offsets, keys = _ranged(df, order, F.lit(1), range_rows)
    n = offsets.agg(F.sum("__s")).first()[0]
    if not n or k < 1:
        return df.limit(0).withColumn("draw", F.lit(0).cast("long"))
    places = draw_places(df.sparkSession, k, n, seed)
    # A row per range against k draws.
    hit = places.join(F.broadcast(offsets), (F.col("__place") >= F.col("__offset")) & (F.col("__place") < F.col("__offset") + F.col("__s")))
    hit = hit.select("draw", F.col("__r"), (F.col("__place") - F.col("__offset")).alias("__inside"))
    some = ranged.join(F.broadcast(hit.select("__r").distinct()), F.col("__range") == F.col("__r"), "left_semi")  # a row per range at most
    numbered = some.withColumn("__i", F.row_number().over(Window.partitionBy("__range").orderBy(*keys)) - 1)
    return numbered.join(hit, (F.col("__range") == F.col("__r")) & (F.col("__i") == F.col("__inside"))).select(*df.columns, "draw")


def shown(df: DataFrame, order: Sequence[Column], k: int, seed: int = 0) -> DataFrame:
    """k rows drawn with replacement from more than k; all rows, in order, if there are no more."""
    return drawn(df, order, k, seed) if df.limit(k + 1).count() > k else positions(df, order, "draw")


def positions(df: DataFrame, order: Sequence[Column], name: str = "index", range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with 0-based positions in the order."""
    return sum_before(df, order, F.lit(1), name, range_rows)
