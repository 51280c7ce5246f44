"""Hard negatives by a full sort of every anchor's scores.

Scores are inner products of whole numbers, floor(SCALE * component), so they
are exact.  The rows are dealt to blocks by their row number, the anchors to
blocks of their own, and each pair of blocks is a group: an anchor's scores
with a block are computed at once and sorted by score, descending, and id.
Blocks are even whatever labels and copies there are, and a group's memory is
bounded by the blocks' sizes, not by the table.

The first pass takes each anchor's best rows of its own label, its positives.
The second one sorts again, finds by binary search where each positive's upper
limit falls, and reads on from there: the first rows of other labels down to the
lower limit.  Each pass keeps a few rows of each block; the first ones of all
blocks together are the answer, since a block's rows keep their order.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import table

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these percentages of the positive's.
LOWER, UPPER = 50, 95
#: Rows of a block and anchors of a block at most; blocks of rows at least, so that small tables use all cores.
BLOCK_ROWS, BLOCK_ANCHORS, LEAST_BLOCKS = 16_384, 2_048, 16
#: Scores held at once.
SCORES = 1 << 20
_LARGE = (1 << 63) - 1


def _matrix(t: pa.Table) -> np.ndarray:
    whole = t.column("v").combine_chunks()
    flat = (whole.flatten() if isinstance(whole, pa.ListArray) else whole.values).to_numpy(zero_copy_only=False)
    return flat.reshape(t.num_rows, -1)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where every partial sum fits one, else in 64-bit integers."""
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if largest < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


def sorted_places(scores: np.ndarray) -> np.ndarray:
    """Per row of scores, its places by score, descending; equal scores by place.  With columns in the order of
    their ids this is a lexsort by score and id.  Where they fit, both are packed into one integer, which sorts faster."""
    n = scores.shape[1]
    bits = max(n - 1, 1).bit_length()
    if not scores.size or int(np.abs(scores).max()) < 1 << (62 - bits):
        packed = (-scores << bits) | np.arange(n)
        packed.sort(axis=1)
        return packed & ((1 << bits) - 1)
    return np.lexsort((np.broadcast_to(np.arange(n), scores.shape), -scores), axis=1)


def _in_chunks(anchors: pa.Table, rows: pa.Table):
    """(anchor's place, its scores sorted, the rows' places in that order), anchor by anchor."""
    if not anchors.num_rows or not rows.num_rows:  # a pair of blocks of which one has no vectors of this length
        return
    x, y = _matrix(anchors), _matrix(rows)
    step = max(1, SCORES // max(len(y), 1))
    for start in range(0, len(x), step):
        scores = _scores(x[start : start + step], y)
        order = sorted_places(scores)
        for i in range(len(scores)):
            yield start + i, scores[i, order[i]], order[i]


def _labels(anchors: pa.Table, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Labels of any type as numbers that agree in both."""
    both = pa.chunked_array([*anchors.column("label").chunks, *rows.column("label").chunks]).combine_chunks().dictionary_encode()
    codes = both.indices.to_numpy(zero_copy_only=False)
    return codes[: anchors.num_rows], codes[anchors.num_rows :]


def _by_id(rows: pa.Table) -> pa.Table:
    """In the order of ids, null last, then of rows."""
    return rows.sort_by([("id", "ascending"), ("row", "ascending")])


def best_of_block(anchors: pa.Table, rows: pa.Table, wanted: int) -> pa.Table:
    """Each anchor's first `wanted` other rows of its label in this block."""
    rows = _by_id(rows)
    own, other = _labels(anchors, rows)
    number, numbers = anchors.column("row").to_numpy(), rows.column("row").to_numpy()
    at, got, values = [], [], []
    for i, scores, order in _in_chunks(anchors, rows):
        first = np.flatnonzero((other[order] == own[i]) & (numbers[order] != number[i]))[:wanted]
        at.append(np.full(len(first), i))
        got.append(order[first])
        values.append(scores[first])
    at, got = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (at, got))
    return pa.table({"anchor": anchors.column("row").take(at), "row": rows.column("row").take(got), "id": rows.column("id").take(got), "score": pa.array(np.concatenate([*values, np.zeros(0, np.int64)]).astype(np.int64))})


def limits(positive: int, lower: int, upper: int) -> tuple[int, int]:
    """The least and the largest negative score n with lower * positive <= 100 * n <= upper * positive."""
    return -(-lower * positive // 100), upper * positive // 100


def window_of_block(anchors: pa.Table, rows: pa.Table, wanted: int, lower: int, upper: int) -> pa.Table:
    """For each anchor and positive, the first `wanted` rows of another label between the limits."""
    rows = _by_id(rows)
    own, other = _labels(anchors, rows)
    positives = anchors.column("positives").to_pylist()
    at, place, got, values = [], [], [], []
    for i, scores, order in _in_chunks(anchors, rows):
        different = np.flatnonzero(other[order] != own[i])
        falling = -scores[different]  # ascending
        for k, p in enumerate(positives[i]):
            least, most = limits(p["score"], lower, upper)
            start = int(np.searchsorted(falling, -most, "left"))
            end = int(np.searchsorted(falling[start : start + wanted], -least, "right"))
            if end:
                taken = different[start : start + end]
                at.append(np.full(len(taken), i))
                place.append(np.full(len(taken), k))
                got.append(order[taken])
                values.append(scores[taken])
    at, place, got, values = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (at, place, got, values))
    return pa.table({"anchor": anchors.column("row").take(at), "place": pa.array(place, pa.int32()), "id": rows.column("id").take(got), "row": rows.column("row").take(got), "score": pa.array(values)})


def usable(vector: Column) -> Column:
    """Whether the scaled vector has no null or non-finite component, and none so large that a score might not fit a long."""
    fits = F.lit(float(math.isqrt(_LARGE))) / F.sqrt(F.greatest(F.size(vector), F.lit(1)))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < fits)), F.lit(False))


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, lower: int = LOWER, upper: int = UPPER, scale: int = SCALE, block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score
    for every row of rows (vec_id, embedding, label) that `anchor` selects.

    An anchor's positives are its first `positives` other rows of its label by
    score, descending, and vec_id; a positive's negatives the first `negatives`
    rows of other labels with lower <= 100 * negative / positive <= upper, all
    of them if there are fewer.  Rows take no part if the label or vector is null,
    the vector is empty, or a component is null, not finite, or so large that a
    score might not fit a long.  Vectors meet vectors of their own length
    only.  Repeated rows, and rows of one vec_id, are rows of their own, as
    anchors too; a null vec_id comes last among ties.  An empty table, and a
    table without anchors, gives no rows.
    """
    scaled = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    kept = rows.select(F.col("vec_id").cast("long").alias("id"), "label", F.coalesce(anchor, F.lit(False)).alias("anchor"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x * scale).alias("raw"), scaled.alias("v"))
    kept = kept.filter(F.col("label").isNotNull() & usable(F.col("raw"))).select("id", "label", "anchor", F.size("v").alias("n"), F.col("v").cast("array<long>").alias("v"))
    kept = table(kept.withColumn("row", F.monotonically_increasing_id()), "scaled")
    many, few = kept.agg(F.count("*"), F.count_if("anchor")).first()
    blocks = max(LEAST_BLOCKS, -(-many // block_rows))
    groups = max(1, -(-few // block_anchors))
    dealt = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), F.col("row")), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = kept.select("row", "id", "label", "n", "v", dealt(blocks, 1).alias("b"), every(groups).alias("g"))
    own = table(kept.filter("anchor").select("row", "id", "label", "n", "v", dealt(groups, 2).alias("g")), "anchors")
    by = ["n", "b", "g"]

    one = own.select("row", "label", "n", "v", "g", every(blocks).alias("b")).groupBy(*by).cogroup(spread.groupBy(*by))
    found = one.applyInArrow(lambda a, r: best_of_block(a, r, positives), "anchor long, row long, id long, score long")
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    found = found.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= positives)
    listed = F.sort_array(F.collect_list(F.struct("place", "id", "score")))  # `positives` at most
    found = table(found.groupBy("anchor").agg(listed.alias("positives")), "positives")

    with_positives = own.join(found, own["row"] == found["anchor"]).select("row", "label", "n", "v", "g", "positives", every(blocks).alias("b"))
    near = with_positives.groupBy(*by).cogroup(spread.groupBy(*by))
    near = near.applyInArrow(lambda a, r: window_of_block(a, r, negatives, lower, upper), "anchor long, place int, id long, row long, score long")
    first = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    near = near.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
    about = own.select(F.col("row").alias("own"), F.col("id").alias("anchor_id")).join(found.withColumnRenamed("anchor", "__a"), F.col("own") == F.col("__a"))
    out = near.join(about, F.col("anchor") == F.col("own")).withColumn("p", F.get("positives", F.col("place")))
    return out.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def relabelled(rows: DataFrame) -> DataFrame:
    """vec_id, embedding, label with every seventh vec_id's label moved on by one of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.select("vec_id", "embedding", moved.alias("label"))


def mined(vectors: DataFrame) -> DataFrame:
    return mine(relabelled(vectors), F.col("vec_id") % 50 == 0)


#: DuckDB's form of mined(), over embeddings.
SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.row AS anchor, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v a JOIN v b ON a.row <> b.row AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST, row) AS place FROM s WHERE same) WHERE place <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id NULLS LAST, s.row) AS rank
  FROM p JOIN s ON p.anchor = s.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""
