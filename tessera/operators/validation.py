"""Validation metrics of sampled responses: mean, deviation, and best, worst and majority of N."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.statistics import expected_best

#: Numbers of drawn values held at once.
HELD = 4_000_000


def ladder(n: int) -> list[int]:
    """2, 4, 8, ... below n, and n."""
    return [*(2**k for k in range(1, 64) if 2**k < n), n]


def ladder_column(n: Column) -> Column:
    powers = F.filter(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda k: F.pow(F.lit(2), k).cast("long")), lambda p: p < n)
    return F.concat(powers, F.array(n.cast("long")))


def draws(n: int, size: int, rounds: int, seed: int) -> np.ndarray:
    """The places of `rounds` draws of `size` with replacement, as numpy.random.seed(seed) and repeated choice give them."""
    return np.random.RandomState(seed).randint(0, n, (rounds, size))


def voted(votes: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Per row of votes (small whole numbers) and draw, the place of the first drawn value of the most frequent vote; of
    equally frequent ones, of the one drawn first."""
    drawn = votes[:, picks]  # rows, rounds, size
    size = drawn.shape[2]
    best, place = np.full(drawn.shape[:2], -1), np.zeros(drawn.shape[:2], np.int64)
    for v in range(int(votes.max(initial=-1)) + 1):
        hit = drawn == v
        count, first = hit.sum(2), hit.argmax(2)
        key = np.where(count > 0, count * (size + 1) + size - first, -1)
        better = key > best
        best, place = np.where(better, key, best), np.where(better, first, place)
    return np.take_along_axis(np.broadcast_to(picks, drawn.shape), place[..., None], 2)[..., 0]


def vote_codes(votes: np.ndarray) -> np.ndarray:
    """Each vote as the place of the first one equal to it: rows that vote alike, whatever for, have the same codes."""
    out = np.zeros(votes.shape, np.int64)
    for k in range(1, votes.shape[1]):
        out[:, k] = (votes[:, : k + 1] == votes[:, k : k + 1]).argmax(1)
    return out


def weighted(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row, the mean and deviation of values that occur so often; a value that never does may be NaN."""
    values = np.where(counts > 0, values, 0.0)
    share = counts / counts.sum(-1, keepdims=True)
    mean = (values * share).sum(1)
    return mean, np.sqrt(((values - mean[:, None]) ** 2 * share).sum(1))


def extremes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest and the least value of every set of places, at the number whose bits are the places; one array operation a place."""
    best = np.empty((len(values), 1 << values.shape[1]))
    worst = best.copy()
    best[:, 0], worst[:, 0] = -np.inf, np.inf
    for k in range(values.shape[1]):
        half, x = 1 << k, values[:, k : k + 1]
        np.maximum(best[:, :half], x, out=best[:, half : 2 * half])
        np.minimum(worst[:, :half], x, out=worst[:, half : 2 * half])
    return best, worst


@functools.lru_cache(maxsize=256)
def drawn_sets(n: int, size: int, rounds: int, seed: int) -> np.ndarray:
    """How often each set of places is drawn, at the number whose bits are the places."""
    return np.bincount(np.bitwise_or.reduce(1 << draws(n, size, rounds, seed), axis=1), minlength=1 << n)


#: What majority_places() found, by codes and draws; a worker keeps at most KINDS of them.
_FOUND: dict[tuple, np.ndarray] = {}
KINDS = 20_000


def majority_places(codes: np.ndarray, size: int, rounds: int, seed: int) -> np.ndarray:
    """Per row of codes, how often each place gives the majority's value over the rounds.  Rows of the same codes
    are looked at once, a bounded number of kinds together, and remembered for the next rows."""
    n = codes.shape[1]
    kinds, which = np.unique(codes, axis=0, return_inverse=True)
    keys = [(k.tobytes(), size, rounds, seed) for k in kinds]
    out = np.empty((len(kinds), n), np.int64)
    new = [i for i, key in enumerate(keys) if key not in _FOUND]
    for i in set(range(len(keys))) - set(new):
        out[i] = _FOUND[keys[i]]
    together = max(1, HELD // (rounds * size))
    for start in range(0, len(new), together):
        some = new[start : start + together]
        places = voted(kinds[some], draws(n, size, rounds, seed))
        rows = np.arange(len(places))[:, None] * n
        out[some] = np.bincount((rows + places).ravel(), minlength=len(places) * n).reshape(-1, n)
        if len(_FOUND) + len(some) > KINDS:
            _FOUND.clear()
        _FOUND.update((keys[i], out[i].copy()) for i in some[:KINDS])
    return out[which.ravel()]


def few_sets(n: int, rounds: int) -> bool:
    """Whether n places have no more sets than there are rounds."""
    return (1 << min(n, 62)) <= rounds


def prompt_metrics(values: np.ndarray, codes: np.ndarray | None, rounds: int, seed: int) -> dict[str, np.ndarray]:
    """Metric name -> one number per prompt, for prompts (rows) of equally many responses (columns).

    All prompts share their draws, so what a draw gives depends on the set of its places, and for
    majorities on which votes are equal: where these sets are fewer than the rounds, they are counted
    once and each is looked at once, not once a round."""
    n = values.shape[1]
    out = {f"mean@{n}": values.mean(1), f"std@{n}": values.std(1)}
    few = few_sets(n, rounds)
    best, worst = extremes(values) if few else (None, None)
    for size in ladder(n):
        got = {}
        if few:
            counts = drawn_sets(n, size, rounds, seed)
            some = np.flatnonzero(counts)
            got["best"], got["worst"] = weighted(best[:, some], counts[some]), weighted(worst[:, some], counts[some])
        else:
            drawn = values[:, draws(n, size, rounds, seed)]
            got |= {kind: (x.mean(1), x.std(1)) for kind, x in (("best", drawn.max(2)), ("worst", drawn.min(2)))}
        if codes is not None:
            got["maj"] = weighted(values, majority_places(codes, size, rounds, seed))
        for kind, (mean, std) in got.items():
            out[f"{kind}@{size}/mean"], out[f"{kind}@{size}/std"] = mean, std
    return out


def validation_metrics(df: DataFrame, source: str, prompt: Sequence[str], index: str, values: Sequence[str], vote: str | None = None, rounds: int = 1000, seed: int = 42) -> DataFrame:
    """source, variable, metric, value: each source's mean over its prompts of mean@n, std@n, and of the mean and
    deviation over `rounds` seeded draws of best@N, worst@N and maj@N for N = 2, 4, ... and n.

    A prompt has n responses, in the order of index; prompts of different n have different metrics, and
    each counts for those that it has.  Prompts of one n share their draws, so they are computed
    together; a prompt's responses are one row.  vote names the column that maj@N counts; null votes are a
    vote.  A null value counts as NaN, as in the metrics that it is in.
    """
    cells = F.struct(F.col(index).isNull().alias("_n"), F.col(index).alias("_i"), *(F.col(v).cast("double").alias(f"_{k}") for k, v in enumerate(values)), *([F.col(vote).cast("string").alias("_vote")] if vote else []))
    rows = df.groupBy(source, *prompt).agg(F.sort_array(F.collect_list(cells)).alias("_r"))
    lists = rows.select(F.col(source).alias("_source"), *(F.transform(f"_r._{k}", lambda x: F.coalesce(x, F.lit(float("nan")))).alias(f"_{k}") for k in range(len(values))), *([F.transform("_r._vote", lambda x: F.coalesce(x, F.lit("\0"))).alias("_vote")] if vote else []))
    kind = df.schema[source].dataType.simpleString()

    def summed(part: pa.RecordBatch) -> list[dict]:
        """Sums of the metrics over the prompts of one source and n."""
        n = len(part.column("_0")[0])
        codes, out = None, []
        if vote:
            votes = part.column("_vote").flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).reshape(-1, n)
            codes = vote_codes(votes)
        together = max(1, HELD // (1 << n if few_sets(n, rounds) else rounds * n))
        for k, name in enumerate(values):
            x = part.column(f"_{k}").flatten().to_numpy().reshape(-1, n)
            for start in range(0, len(x), together):
                some = slice(start, start + together)
                got = prompt_metrics(x[some], codes[some] if codes is not None else None, rounds, seed)
                out += [{"source": part.column("_source")[0].as_py(), "variable": name, "metric": m, "total": float(v.sum()), "n": len(v)} for m, v in got.items()]
        return out

    def run(batches):
        for batch in batches:
            counts = batch.column("_0").value_lengths().to_numpy()
            sources = batch.column("_source").dictionary_encode()
            codes = sources.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            out: list[dict] = []
            for n, code in sorted({*zip(counts.tolist(), codes.tolist(), strict=True)}):
                out += summed(batch.filter(pa.array((counts == n) & (codes == code))))
            schema = pa.schema([("source", batch.schema.field("_source").type), ("variable", pa.string()), ("metric", pa.string()), ("total", pa.float64()), ("n", pa.int64())])
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    parts = lists.mapInArrow(run, f"source {kind}, variable string, metric string, total double, n long")
    return parts.groupBy(F.col("source").alias(source), "variable", "metric").agg((F.sum("total") / F.sum("n")).alias("value"), F.sum("n").alias("prompts"))


def expected_metrics(df: DataFrame, source: str, prompt: Sequence[str], value: str) -> DataFrame:
    """source, size, best, worst, prompts: the expectations that best@N and worst@N estimate, in closed form, by DataFrame functions."""
    rows = df.groupBy(source, *prompt).agg(F.collect_list(F.col(value).cast("double")).alias("_v"))
    steps = rows.withColumn("size", F.explode(ladder_column(F.size("_v"))))
    each = steps.select(source, "size", expected_best(F.col("_v"), F.col("size")).alias("_b"), expected_best(F.col("_v"), F.col("size"), worst=True).alias("_w"))
    return each.groupBy(source, "size").agg(F.avg("_b").alias("best"), F.avg("_w").alias("worst"), F.count("*").alias("prompts"))


def validation_row(samples: DataFrame, step: int, order: Sequence[Column], columns: Sequence[str], k: int) -> DataFrame:
    """One row: the step and the first k samples in the order side by side, column_1 to column_k for each column; null beyond the last sample."""
    first = samples.select(*columns, *(c.alias(f"__o{i}") for i, c in enumerate(order))).orderBy(*(f"__o{i}" for i in range(len(order)))).limit(k)  # k rows
    names = [f"__o{i}" for i in range(len(order))]
    listed = first.agg(F.sort_array(F.collect_list(F.struct(*names, *(F.col(c).alias(f"__c{j}") for j, c in enumerate(columns))))).alias("__s"))
    cells = [F.get("__s", F.lit(i))[f"__c{j}"].alias(f"{c}_{i + 1}") for i in range(k) for j, c in enumerate(columns)]
    return listed.select(F.lit(step).cast("long").alias("step"), *cells)
