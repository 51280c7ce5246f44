"""Mixing sources to target weights by capped water-filling.

Every source has a weight; its target is the weight's share of all words, but
at most `epochs` times the words it has.  What a clamped source can't take is
shared among the others by weight until none is above its cap.  Sorted by
cap / weight, the clamped sources come first, so the level follows from
running sums over one row per source.

A source with target t and size s takes every document floor(t / s) times and
once more those of a seeded sample with the words that are left.  The sample
is the documents whose hash, of doc_id and text, comes first; the hash's place
where the words run out is found by two aggregations (4096 buckets, then the last
bucket's hashes), so no source is ever sorted or gathered in one task.  Rows
that share the last hash are repeated rows, alike in doc_id and text; as many
of them are taken as come nearest to the target, however many there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, bounded, table, text_of
from tessera.operators.ordering import positions, sums_before

WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 17
#: A plan of at most so many sources is broadcast; a larger one is joined by key, where AQE splits hot sources.
BROADCAST_SOURCES = 20_000


#: Bits of the hash, and of the part of it that the first aggregation counts.
KEY_BITS, COARSE_BITS = 60, 12
#: Groups that rows of one last hash are dealt to before they are ranked.
TIE_GROUPS = 4096


def measured(docs: DataFrame, seed: int = SEED, keep: bool = False) -> DataFrame:
    """doc_id, source, __size (words) and __key (60 bits of a seeded hash of doc_id and text); keep: all columns."""
    words = F.regexp_count(text_of(docs), F.lit(f"[^{SPACE}]+")).cast("long")
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"), F.md5(text_of(docs)))
    key = F.conv(F.substring(F.md5(named), 1, KEY_BITS // 4), 16, 10).cast("long")
    if keep:
        return docs.select("*", words.alias("__size"), key.alias("__key"))
    return docs.select("doc_id", "source", words.alias("__size"), key.alias("__key"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: source, __source_size, __target, __whole (repetitions), __left (words beyond them).

    Sources are ordered and summed up by ranges, so that there may be very many."""
    big = "decimal(38,0)"
    sources = table(sized.groupBy("source").agg(F.sum("__size").alias("__source_size")), "sources")
    last = [F.col("source").isNull(), F.col("source")]  # by code point, null last
    sources = positions(sources, last, "__i")
    sources = sources.select("source", "__source_size", F.element_at(F.array(*map(F.lit, weights)), (F.col("__i") % len(weights)).cast("int") + 1).alias("__w"), (F.col("__source_size") * epochs).alias("__cap"))
    by_ratio = [F.col("__cap").cast("double") / F.col("__w"), *last]
    sources = table(sums_before(sources, by_ratio, {"__caps": F.col("__cap"), "__before": F.col("__w")}), "ordered")
    sources = sources.crossJoin(F.broadcast(sources.agg(F.sum("__w").alias("__all"), F.sum("__source_size").alias("__total"))))  # one row
    fits = F.col("__caps").cast(big) * F.col("__w") + F.col("__cap").cast(big) * (F.col("__all") - F.col("__before")) <= F.col("__total").cast(big) * F.col("__w")
    sources = sources.select("*", fits.alias("__full"))
    shared = sources.agg(F.coalesce(F.sum(F.when(F.col("__full"), F.col("__cap"))), F.lit(0)).alias("__clamped"), F.sum(F.when(~F.col("__full"), F.col("__w"))).alias("__sharing"))
    sources = sources.crossJoin(F.broadcast(shared))  # one row
    share = (F.col("__total") - F.col("__clamped")).cast("double") * F.col("__w") / F.col("__sharing")
    sources = sources.select("source", "__source_size", F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(share).alias("__target"))
    whole = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(F.lit(0))
    return sources.select("*", whole.cast("long").alias("__whole"), (F.col("__target") - whole * F.col("__source_size")).alias("__left"))


def _joined(left: DataFrame, small: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    small = small.withColumnRenamed("source", "__source")
    return left.join(F.broadcast(small) if few else small, left["source"].eqNullSafe(small["__source"]), how).drop("__source")


def plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> tuple[DataFrame, bool]:
    """targets() with the hash where the sample ends (__cut: rows below it are in), how many of the rows with that
    hash (__ties) are in (__some); and whether it is small enough to broadcast.  __cut is null where all rows are in."""
    goal = table(targets(sized, weights, epochs), "targets")
    few = bounded(goal, BROADCAST_SOURCES)
    fine_bits = KEY_BITS - COARSE_BITS
    coarse = sized.groupBy("source", F.shiftright("__key", fine_bits).alias("__coarse")).agg(F.sum("__size").alias("__n"))
    running = Window.partitionBy("source").orderBy("__coarse")
    coarse = coarse.select("source", "__coarse", "__n", F.sum("__n").over(running).alias("__upto"))
    cut = _joined(coarse, goal.select("source", "__left"), few).filter("__upto > __left")
    cut = cut.groupBy("source").agg(F.min(F.struct("__coarse", (F.col("__upto") - F.col("__n")).alias("b"), "__left")).alias("__c"))
    cut = table(cut.select("source", F.col("__c.__coarse").alias("__coarse"), F.col("__c.b").alias("__before"), "__c.__left"), "cut")
    fine = _joined(sized.select("source", "__key", "__size"), cut, few).filter(F.shiftright("__key", fine_bits) == F.col("__coarse"))
    fine = fine.groupBy("source", "__key").agg(F.sum("__size").alias("__n"), F.count("*").alias("__ties"), F.max("__size").alias("__z"), F.first("__before").alias("__before"), F.first("__left").alias("__left"))
    running = Window.partitionBy("source").orderBy("__key")
    fine = fine.select("source", "__key", "__n", "__ties", "__z", "__left", (F.col("__before") + F.sum("__n").over(running) - F.col("__n")).alias("__before"))
    last = fine.filter("__before + __n > __left").groupBy("source").agg(F.min(F.struct("__key", "__ties", "__z", "__before", "__left")).alias("__l"))
    some = F.least(F.floor((F.col("__l.__left") - F.col("__l.__before")) / F.col("__l.__z") + 0.5).cast("long"), F.col("__l.__ties"))
    last = last.select("source", F.col("__l.__key").alias("__cut"), F.col("__l.__ties").alias("__ties"), some.alias("__some"))
    return table(_joined(goal, last, few, "left").select(*goal.columns, "__cut", "__ties", "__some"), "plan"), few


def _ranked(tied: DataFrame) -> DataFrame:
    """Rows of one hash per source with __extra: 1 for __some of them, 0 for the others.  They are numbered once, in a table."""
    numbered = table(tied.withColumn("__row", F.monotonically_increasing_id()), "ties").withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(TIE_GROUPS)))
    groups = numbered.groupBy("source", "__group").agg(F.count("*").alias("__n"))
    before = groups.select(F.col("source").alias("__s"), F.col("__group").alias("__g"), (F.sum("__n").over(Window.partitionBy("source").orderBy("__group")) - F.col("__n")).alias("__b"))
    placed = numbered.join(before, numbered["source"].eqNullSafe(before["__s"]) & (numbered["__group"] == before["__g"]))
    rank = F.col("__b") + F.row_number().over(Window.partitionBy("source", "__group").orderBy("__row"))
    return placed.withColumn("__extra", (rank <= F.col("__some")).cast("long")).drop("__row", "__group", "__s", "__g", "__b")


def decide(sized: DataFrame, planned: DataFrame, few: bool, epochs: int = EPOCHS) -> DataFrame:
    """sized with its source's plan and __copies, how often the mix takes the document: never more than epochs, not even one without words."""
    out = _joined(sized, planned, few)
    split = F.coalesce((F.col("__key") == F.col("__cut")) & (F.col("__some") > 0) & (F.col("__some") < F.col("__ties")), F.lit(False))
    inside = F.coalesce((F.col("__key") < F.col("__cut")) | ((F.col("__key") == F.col("__cut")) & (F.col("__some") == F.col("__ties"))), F.lit(True)).cast("long")
    whole = out.filter(~split).withColumn("__extra", inside)
    if not planned.filter("__some > 0 AND __some < __ties").isEmpty():  # repeated rows of which some are in
        whole = whole.unionByName(_ranked(out.filter(split)))
    return whole.withColumn("__copies", F.least(F.col("__whole") + F.col("__extra"), F.lit(epochs))).drop("__extra")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document.

    A null text has size 0; a null source is a source, the last; a null doc_id
    hashes as empty.  Rows of one doc_id and different texts are taken or left
    each by itself; of repeated rows, alike in both, as many as come nearest
    to the target.  A source's taken words miss its target by half the words of
    one document at most.  A source without words has target 0.  An empty table
    gives no rows.
    """
    sized = table(measured(docs, seed), "sized")
    out = decide(sized, *plan(sized, weights, epochs), epochs)
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"), F.col("__copies").alias("copies"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: docs' rows as often as the mix takes them, same columns."""
    sized = table(measured(docs, seed), "sized")
    planned, few = plan(sized, weights, epochs)
    chosen = planned.select("source", "__whole", "__cut", "__ties", "__some")
    out = decide(measured(docs, seed, keep=True), chosen, few, epochs).filter("__copies > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*docs.columns)


#: DuckDB's form of mix() with the defaults, over documents.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS k
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w,
              source_size * 3 AS cap FROM s0),
s2 AS (SELECT *,
         coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         (SELECT sum(w) FROM s1) - coalesce(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights,
         (SELECT sum(source_size) FROM s1) AS total
       FROM s1),
s3 AS (SELECT *, CAST(caps AS HUGEINT) * w + CAST(cap AS HUGEINT) * weights <= CAST(total AS HUGEINT) * w AS clamped FROM s2),
s4 AS (SELECT *, coalesce((SELECT sum(cap) FROM s3 WHERE clamped), 0) AS clamped_caps, (SELECT sum(w) FROM s3 WHERE NOT clamped) AS sharing FROM s3),
s5 AS (SELECT source, source_size,
         CASE WHEN clamped THEN CAST(cap AS DOUBLE) ELSE CAST(total - clamped_caps AS DOUBLE) * w / sharing END AS target FROM s4),
s6 AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM s5),
k0 AS (SELECT source, k, CAST(sum(size) AS BIGINT) AS n, count(*) AS ties, max(size) AS z FROM sized GROUP BY source, k),
k1 AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source ORDER BY k) AS BIGINT) - n AS before FROM k0),
k2 AS (SELECT k1.source, k1.k, CASE WHEN k1.before + k1.n <= s6.target - s6.whole * s6.source_size THEN ties
                                    WHEN k1.before > s6.target - s6.whole * s6.source_size THEN 0
                                    ELSE least(CAST(floor((s6.target - s6.whole * s6.source_size - k1.before) / k1.z + 0.5::DOUBLE) AS BIGINT), ties) END AS some
       FROM k1 JOIN s6 ON k1.source IS NOT DISTINCT FROM s6.source),
d AS (SELECT *, row_number() OVER (PARTITION BY source, k) AS i FROM sized)
SELECT d.doc_id, d.size, s6.source_size, s6.target,
       d.size * least(s6.whole + CASE WHEN d.i <= k2.some THEN 1 ELSE 0 END, 3) AS taken,
       least(s6.whole + CASE WHEN d.i <= k2.some THEN 1 ELSE 0 END, 3) AS copies
FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source
JOIN k2 ON d.source IS NOT DISTINCT FROM k2.source AND d.k = k2.k
"""
