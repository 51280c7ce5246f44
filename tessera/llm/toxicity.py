"""Toxicity grades by cumulative-link ordinal regression on sparse words.

P(grade > j) = sigmoid(w . x - t_j) with one weight vector for all thresholds
t_0 < t_1 < t_2; the expected severity is the sum of these probabilities, 0 to
3.  The labels only tell toxic from not; a toxic document's grade for training
is 1, 2 or 3 by thirds of its density of marker words, which are the words
that toxic labelled documents have far more often than others.

x holds 1 + log(occurrences) of the vocabulary's features: words, and their
beginnings of five to seven letters, which inflected words share.  The
vocabulary is all features of at least `LEAST_DOCUMENTS` sampled documents whose
log-odds in the training sample are at least `LEAST_Z` standard errors from 0;
the sample bounds it.  The sample is at most `SAMPLE` labelled documents chosen by hash; a quarter of the labels
(by the checksum rule of the quality classifier) is held out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import table, text_of
from tessera.llm.quality import held_out

SAMPLE = 12_000
LEAST_DOCUMENTS = 4
LEAST_Z = 2.5
MARKER_Z = 6.0
GRADES = 3
STEMS = (5, 6, 7)
#: A worker remembers the features of so many different words at most.
REMEMBERED = 400_000
WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def features(word: str) -> list[str]:
    """The word and its beginnings, which end in a star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) > k)]


class Hits(dict):
    """Word -> the numbers of its features in the vocabulary."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[int, ...]:
        out = tuple(self.vocabulary[f] for f in features(word) if f in self.vocabulary)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out
        return out


@dataclass
class Model:
    vocabulary: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, margin: np.ndarray) -> np.ndarray:
        """P(grade > j) for each j."""
        return 1 / (1 + np.exp(-np.clip(margin[:, None] - self.thresholds, -500, 500)))

    def margins(self, texts: list[str], hits: Hits) -> np.ndarray:
        """w . x of each text: occurrences are counted for all texts at once."""
        lists = [[i for ids in filter(None, map(hits.__getitem__, words(t))) for i in ids] for t in texts]
        size = max(len(self.weights), 1)
        cells = np.repeat(np.arange(len(texts)), list(map(len, lists))) * size + np.array([i for own in lists for i in own], np.int64)
        cells, n = np.unique(cells, return_counts=True)
        return np.bincount(cells // size, self.weights[cells % size] * (1 + np.log(n)), len(texts)) if len(cells) else np.zeros(len(texts))


def fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, size: int, steps: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the ordinal log-likelihood of a sparse matrix.
    The thresholds are the first one plus exponentials, hence increasing."""
    n = len(grades)
    w, free = np.zeros(size), np.array([2.0, 0.0, 0.0])
    state = [np.zeros(size + GRADES), np.zeros(size + GRADES)]
    for i in range(1, steps + 1):
        t = free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])
        z = np.bincount(rows, w[cols] * values, n)
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - t, -30, 30)))
        full = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1)
        k = np.arange(n)
        likely = np.maximum(full[k, grades] - full[k, grades + 1], 1e-12)
        slope = full * (1 - full)
        dz = -(slope[k, grades] - slope[k, grades + 1]) / likely
        dt = np.zeros((n, GRADES + 2))
        dt[k, grades] += slope[k, grades] / likely
        dt[k, grades + 1] -= slope[k, grades + 1] / likely
        dt = dt[:, 1:-1].sum(0) / n
        grad_free = np.concatenate([[dt.sum()], np.cumsum(dt[::-1])[::-1][1:] * np.exp(free[1:])])
        grad = np.concatenate([np.bincount(cols, dz[rows] * values, size) / n + ridge * w, grad_free])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.999 * state[1] + 0.001 * grad**2
        move = 0.05 * (state[0] / (1 - 0.9**i)) / (np.sqrt(state[1] / (1 - 0.999**i)) + 1e-9)
        w, free = w - move[:size], free - move[size:]
    return w, free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Two passes over the sample's texts: the features' document counts, then
    the chosen features' occurrences, as numbers, to the driver."""
    chosen = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("__y"))
    chosen = table(chosen.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(sample).withColumnRenamed("doc_id", "__id"), "sample")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_of(docs).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("__id"))
    one = F.min(F.struct(F.md5("text").alias("h"), "text"))  # of rows of one doc_id, whichever order they come in
    rows = table(rows.groupBy("id").agg(one.alias("one"), F.max("__y").alias("y")).select("id", "one.text", "y"), "texts")
    toxic, everyone = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    clean = everyone - toxic

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                seen: Counter = Counter()
                bad: Counter = Counter()
                part = batch.slice(start, 256)
                for text, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
                    own = {f for w in set(words(text)) for f in features(w)}
                    seen.update(own)
                    if y:
                        bad.update(own)
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([bad[w] for w in seen], pa.int64())], names=["word", "d", "t"])

    per_word = rows.select("text", "y").mapInArrow(present, "word string, d long, t long").groupBy("word").agg(F.sum("d").alias("d"), F.sum("t").alias("t")).filter(F.col("d") >= LEAST_DOCUMENTS)
    t, c = F.col("t") + 0.5, F.col("d") - F.col("t") + 0.5
    z = (F.log(t / (toxic + 1 - t)) - F.log(c / (clean + 1 - c))) / F.sqrt(1 / t + 1 / c)
    best = per_word.select("word", z.alias("z")).filter(F.abs("z") >= LEAST_Z).toPandas().sort_values("word", ignore_index=True) if toxic and clean else None
    if best is None or best.empty:  # nothing to learn: nothing is toxic
        return Model({}, np.zeros(0), np.array([20.0, 21.0, 22.0]))
    vocabulary = {w: i for i, w in enumerate(best["word"])}

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(vocabulary)
        for batch in batches:
            ids, counts, totals = [], [], []
            for text in batch.column("text").to_pylist():
                found = words(text)
                got = Counter(i for own in filter(None, map(hits.__getitem__, found)) for i in own)
                ids.append(sorted(got))
                counts.append([got[i] for i in ids[-1]])
                totals.append(len(found))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(totals, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))], names=["id", "y", "total", "ids", "counts"])

    got = rows.mapInArrow(occurrences, "id long, y long, total long, ids array<int>, counts array<int>").toPandas().sort_values("id")
    at = np.repeat(np.arange(len(got)), got["ids"].map(len).to_numpy(np.int64))
    cols = np.concatenate([*got["ids"], np.zeros(0)]).astype(np.int64)
    n = np.concatenate([*got["counts"], np.zeros(0)]).astype(float)
    y = got["y"].to_numpy(np.int64)
    marker = (best["z"] >= MARKER_Z).to_numpy()
    marks = np.bincount(at, n * marker[cols], len(got)) / np.maximum(got["total"].to_numpy(float), 1)
    thirds = np.quantile(marks[y == 1], [1 / 3, 2 / 3])
    grades = np.where(y == 1, 1 + np.searchsorted(thirds, marks, "left"), 0)
    weights, thresholds = fit(at, cols, 1 + np.log(n), grades, len(vocabulary))
    return Model(vocabulary, weights, thresholds)


def grade(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity (0 to 3), grade (the likeliest), p_toxic, toxic (1 if
    p_toxic is at least a half) of every document, from its whole text.

    Null and empty texts have no words and score as such; a null doc_id stays
    null; repeated rows are graded alike; no shuffle.
    """
    kept = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(model.vocabulary)
        for batch in batches:
            p = model.above(model.margins(batch.column("text").to_pylist(), hits))
            full = np.concatenate([np.ones((len(p), 1)), p, np.zeros((len(p), 1))], 1)
            best = (full[:, :-1] - full[:, 1:]).argmax(1)
            columns = [batch.column("doc_id"), pa.array(p.sum(1)), pa.array(best, pa.int32()), pa.array(p[:, 0]), pa.array((p[:, 0] >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, f"doc_id {kept}, severity double, grade int, p_toxic double, toxic int")


def graded(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    out = grade(docs, train(docs, labels, sample))
    return out.withColumn("held_out", held_out(F.col("doc_id")))
