"""Grouped statistics of rollouts: aggregates, advantages, whitening, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.ordering import sum_before


def mean_of_means(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Mean per row of responses, then per source."""
    rows = df.groupBy(outer, inner).agg(F.avg(value).alias("__m"))
    return rows.groupBy(outer).agg(F.avg("__m").alias("score"), F.count("*").alias("n"))


def upper_median(name: str) -> Column:
    """Element n // 2 of the sorted whole numbers: exact, not interpolated; values are counted, not gathered."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{name}` DESC)").cast("long")


def weighted_mean(score: Column, weight: Column) -> Column:
    """Null scores count in neither sum."""
    return F.sum(score * weight) / F.nullif(F.sum(F.when(score.isNotNull(), weight)).cast("double"), F.lit(0.0))


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, greatest and least of each column in long form; NaN counts as missing."""
    clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns]
    wide = df.select(*clean).agg(*(f(F.col(c)).alias(f"{c}__{n}") for c in columns for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), *(F.col(f"{c}__{n}").alias(n) for n in ("mean", "max", "min"))) for c in columns))).alias("r")).select("r.*")


def explained_variance(returns: Column, values: Column) -> Column:
    return 1 - F.var_samp(returns - values) / (F.var_samp(returns) + 1e-5)


def masked_sum(x: Column, mask: Column) -> Column:
    return F.sum(x * mask)


def masked_mean(x: Column, mask: Column) -> Column:
    return F.sum(x * mask) / (F.sum(mask) + 1e-8)


def masked_var(x: Column, mask: Column, unbiased: bool = True) -> Column:
    """Of the masked values; raises for a mask of one or none where unbiased."""
    n = F.sum(mask)
    mean = F.sum(x * mask) / (n + 1e-8)
    biased = F.sum(x * x * mask) / (n + 1e-8) - 2 * mean * mean + mean * mean * n / (n + 1e-8)
    if not unbiased:
        return biased
    checked = F.when(n <= 1, F.raise_error(F.lit("the mask must have at least two ones")).cast("double")).otherwise(n)
    return biased * checked / (checked - 1)


def whiten(df: DataFrame, value: str, mask: str, name: str, shift_mean: bool = True) -> DataFrame:
    """Mean 0 and variance 1 over the masked rows: one aggregation, its single row broadcast."""
    stats = df.agg(masked_mean(F.col(value), F.col(mask)).alias("__mean"), masked_var(F.col(value), F.col(mask)).alias("__var"))
    scaled = (F.col(value) - F.col("__mean")) / F.sqrt(F.col("__var") + 1e-8)
    out = df.join(F.broadcast(stats))  # one row
    return out.withColumn(name, scaled if shift_mean else scaled + F.col("__mean")).drop("__mean", "__var")


def grpo(score: Column, *group: str, epsilon: float = 1e-6) -> Column:
    """Score against the group's mean, in its standard deviations; a group of one keeps its score."""
    w = Window.partitionBy(*group)
    alone = F.count("*").over(w) == 1
    return (score - F.when(alone, 0.0).otherwise(F.avg(score).over(w))) / (F.when(alone, 1.0).otherwise(F.stddev_samp(score).over(w)) + epsilon)


def baseline(score: Column, *group: str) -> Column:
    w = Window.partitionBy(*group)
    return score - F.when(F.count("*").over(w) == 1, 0.0).otherwise(F.avg(score).over(w))


def leave_one_out(score: Column, *group: str) -> Column:
    w = Window.partitionBy(*group)
    n = F.count("*").over(w)
    return F.when(n > 1, (score - F.avg(score).over(w)) * n / (n - 1)).otherwise(score)


def token_leave_one_out(df: DataFrame, value: str, mask: str, response: str, group: str, n: int) -> Column:
    """Token values against the sum of the group's masked means per response; unmasked ones are 0."""
    per = Window.partitionBy(group, response)
    x, m = F.col(value), F.col(mask)
    mean = F.sum(x * m).over(per) / F.sum(m).over(per)
    size = F.count("*").over(per)
    total = F.sum(mean / size).over(Window.partitionBy(group))
    return F.when(m > 0, x * (n / (n - 1)) - total / (n - 1)).otherwise(0.0)


def prime_advantages(df: DataFrame, response: str, group: str, order: str, mask: str, n: int, sources: Sequence[tuple[str, str, float]], name: str = "advantage") -> DataFrame:
    """df with `returns` and `name`: leave-one-out advantages of several reward sources, weighted and summed, then summed
    over the tokens from each one on, and whitened over the masked tokens.

    sources: (values, mask, coefficient), as a model's token rewards under the response mask, and an
    outcome on the last token under a mask of that token alone; a coefficient of 0 leaves a source out.  A group has n responses."""
    used = [(v, m, c) for v, m, c in sources if c]
    if not used:
        raise ValueError("no reward source counts")
    total = None
    for values, own, coefficient in used:
        part = token_leave_one_out(df, values, own, response, group, n) * coefficient
        total = part if total is None else total + part
    summed = df.withColumn("__r", total).withColumn("returns", reverse_running(F.col("__r") * F.col(mask), [group, response], order))
    return whiten(summed.drop("__r"), "returns", mask, name)


def best_of_n_weight(value: Column, *group: str) -> Column:
    """n times the share of the group's values that are at most this one, to the power n - 1: how much likelier it is the best of n draws.
    Equal values share the largest rank."""
    n = F.count("*").over(Window.partitionBy(*group))
    return n * F.pow(F.cume_dist().over(Window.partitionBy(*group).orderBy(value)), n - 1)


def reverse_running(value: Column, group: Sequence[str], order: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.currentRow, Window.unboundedFollowing))


def running(value: Column, group: Sequence[str], order: str) -> Column:
    return F.sum(value).over(Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def majority(df: DataFrame, group: Sequence[str], vote: str, value: str, index: str) -> DataFrame:
    """The most frequent vote, the first seen of equals, and its first value: two aggregations."""
    per = df.groupBy(*group, vote).agg(F.count("*").alias("__n"), F.min(index).alias("__first"), F.min_by(value, index).alias("__value"))
    best = per.groupBy(*group).agg(F.max_by(F.struct(vote, "__value", "__n"), F.struct("__n", -F.col("__first"))).alias("__b"))
    return best.select(*group, F.col(f"__b.{vote}").alias(vote), F.col("__b.__value").alias("value"), F.col("__b.__n").alias("votes"))


def expected_best(values: Column, n: int | Column, worst: bool = False) -> Column:
    """The expected best of n draws with replacement from an array, in closed form."""
    s, size, n = F.sort_array(values, asc=not worst), F.size(values), n if isinstance(n, Column) else F.lit(n)
    terms = F.transform(s, lambda x, i: x * (F.pow((i + 1) / size, n) - F.pow(i / size, n)))
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def bootstrap(df: DataFrame, group: Sequence[str], value: str, index: str, size: int, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """Mean and population deviation of the greatest and the least of `size` draws, over seeded rounds.

    The draws are those of `numpy.random.seed(seed)` and `choice`.  A group is a
    prompt's rollouts, an array in one row; groups of one size share their draws.
    """
    import numpy as np
    import pyarrow as pa

    keys = [df.schema[g] for g in group]
    names = ["best_mean", "best_std", "worst_mean", "worst_std"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in keys), *(f"{n} double" for n in names)])
    placed = F.struct(F.col(index).isNull().alias("n"), F.col(index).alias("i"), F.col(value).cast("double").alias("v"))
    lists = df.groupBy(*group).agg(F.transform(F.sort_array(F.collect_list(placed)), lambda x: x["v"]).alias("__values"))
    together = max(1, 1_000_000 // (rounds * size))

    def run(batches):
        for batch in batches:
            values = batch.column("__values")
            flat, counts = values.flatten().to_numpy(zero_copy_only=False), values.value_lengths().to_numpy()
            starts = np.cumsum(counts) - counts
            out = np.empty((4, len(counts)))
            for n in np.unique(counts):
                picks = np.random.RandomState(seed).randint(0, n, (rounds, size))
                at = np.flatnonzero(counts == n)
                for i in range(0, len(at), together):
                    some = at[i : i + together]
                    drawn = flat[starts[some, None, None] + picks]
                    best, worst = drawn.max(2), drawn.min(2)
                    out[:, some] = best.mean(1), best.std(1), worst.mean(1), worst.std(1)
            yield pa.RecordBatch.from_arrays([*(batch.column(g) for g in group), *(pa.array(x, pa.float64(), from_pandas=True) for x in out)], names=[*group, *names])

    return lists.mapInArrow(run, schema)


def group_split(df: DataFrame, key: str, seed: int, size: int) -> DataFrame:
    """Whole groups into validation, in hash order, as long as they fit: one row per group is numbered, not the rows."""
    groups = df.groupBy(F.col(key).alias("__k")).agg(F.count("*").alias("__n"))
    order = [F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("__k").cast("string"), F.lit("")))), F.col("__k")]
    chosen = sum_before(groups, order, F.col("__n"), "__before").select("__k", (F.col("__before") + F.col("__n") <= size).alias("__val"))
    return df.join(chosen, df[key].eqNullSafe(chosen["__k"])).withColumn("split", F.when(F.col("__val"), "val").otherwise("train")).drop("__k", "__val")


def bipartite(df: DataFrame, group: str, bullet: str, score: str, position: str, n: Column) -> DataFrame:
    """Each bullet's best match keeps its score, the earlier position on ties; the others get 0 and reused = true."""
    valid = F.col(bullet).between(1, n)
    w = Window.partitionBy(group, F.when(valid, F.col(bullet))).orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), position)
    lost = valid & (F.row_number().over(w) > 1)
    return df.withColumn("__lost", F.coalesce(lost, F.lit(False))).withColumn(score, F.when(F.col("__lost"), 0.0).otherwise(F.col(score))).withColumnRenamed("__lost", "reused")


def greedy_matches(matches: Column) -> Column:
    """One-to-one on both sides: array of (gt_id, pred_id, score), best score first, then lowest gt_id; zeros go."""
    order = F.array_sort(F.transform(F.filter(matches, lambda m: (m["score"] > 0) & (m["pred_id"] > 0)), lambda m: F.struct((-m["score"]).alias("s"), m["gt_id"].cast("long").alias("g"), m["pred_id"].cast("long").alias("p"))))
    start = F.array().cast("array<struct<s:double,g:bigint,p:bigint>>")
    kept = F.aggregate(order, start, lambda k, m: F.when(F.exists(k, lambda x: (x["g"] == m["g"]) | (x["p"] == m["p"])), k).otherwise(F.concat(k, F.array(m))))
    return F.array_sort(F.transform(kept, lambda m: F.struct(m["g"].alias("gt_id"), m["p"].alias("pred_id"), (-m["s"]).alias("score"))))
