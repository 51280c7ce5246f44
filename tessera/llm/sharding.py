"""Shards by weighted rendezvous hashing of record keys, in DataFrame functions only.

Every shard draws a number u in (0, 1) from a hash of the key and the shard's
name; the record goes to the shard with the largest weight / -log(u).  A shard's
share of the keys is its weight's share.  Nothing depends on the other
shards' places or number: one more shard takes records only into itself,
one less gives its own records to the others, and a weight that changes moves
records only to or from its shard.

Within a shard records have slots 0, 1, 2, ... in the order of a hash, so that
slots do not depend on how the table is split.  The shard's order is cut into ranges
of the hash; ranges are counted, and slots counted within a range.
Rows that are alike in all of this are one row with a count until the end, so
that no range holds more than its share of different rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import bounded, table, text_of

SHARDS = 8
SEED = 31
#: Hexadecimal digits of the hash that make the draw: 52 bits, exact in a double.
DIGITS = 13
#: Different rows of one range of all shards' order, about.
RANGE_ROWS = 50_000
#: Rows that are alike and are given their slots together.
ALIKE = 50_000
#: At most so many ranges are broadcast.
BROADCAST_RANGES = 100_000

Weights = Mapping[int, float] | Sequence[float]


def _named(weights: Weights) -> dict[int, float]:
    named = dict(weights) if isinstance(weights, Mapping) else dict(enumerate(weights))
    if not named or any(not w > 0 for w in named.values()):
        raise ValueError("every shard needs a weight above 0, and there must be one shard")
    return named


def draw(key: Column, shard: int, seed: int = SEED) -> Column:
    """-log of the shard's number in (0, 1) for the key; a null key is an empty one."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{shard}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, DIGITS), 16, 10)
    return -F.log((h.cast("double") + 0.5) / float(1 << (4 * DIGITS)))


def _smallest(draws: Mapping[int, Column], weights: dict[int, float]) -> Column:
    """The shard with the least draw / weight, of equal ones the smallest."""
    return F.least(*(F.struct((draws[s] / F.lit(float(w))).alias("d"), F.lit(s).alias("s")) for s, w in sorted(weights.items()))).getField("s")


def shard_of(key: Column, weights: Weights, seed: int = SEED) -> Column:
    """The key's shard, an int; weights: per shard, by name or in the order 0, 1, ..."""
    named = _named(weights)
    return _smallest({s: draw(key, s, seed) for s in named}, named)


def assigned(rows: DataFrame, key: str, plans: Mapping[str, Weights], seed: int = SEED) -> DataFrame:
    """rows with a column of shards for each plan; a shard's draw is made once for all plans.  No shuffle."""
    named = {name: _named(w) for name, w in plans.items()}
    shards = sorted({s for w in named.values() for s in w})
    drawn = rows.withColumn("__draws", F.array(*(draw(F.col(key), s, seed) for s in shards)))
    draws = {s: F.get("__draws", F.lit(i)) for i, s in enumerate(shards)}
    return drawn.withColumns({name: _smallest(draws, w) for name, w in named.items()}).drop("__draws")


def moved(rows: DataFrame, key: str, old: Weights, new: Weights, seed: int = SEED) -> DataFrame:
    """How many rows a change of plan moves: source, target, n, for every pair of different shards that has some."""
    both = assigned(rows.select(key), key, {"source": old, "target": new}, seed)
    return both.filter("source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))


def slotted(rows: DataFrame, shard: str = "shard", name: str = "slot", range_rows: int = RANGE_ROWS, alike: int = ALIKE) -> DataFrame:
    """rows with gapless numbers from 0 within each shard; the same set of rows has the same numbers, however it is split.

    The order is by a hash of all columns, then by the columns, so rows should be narrow.  Rows that are alike share a run of slots."""
    kinds = table(rows.groupBy(*rows.columns).agg(F.count("*").alias("__n")), "kinds")
    ranges = max(1, -(-kinds.count() // range_rows))
    text = F.concat_ws(":", F.lit("slot"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns))
    placed = kinds.withColumn("__h", F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long"))
    placed = placed.withColumn("__range", F.floor(F.col("__h") / ((1 << (4 * DIGITS)) / ranges)))
    counted = placed.groupBy(F.col(shard).alias("__s"), F.col("__range").alias("__r")).agg(F.sum("__n").alias("__c"))
    offsets = table(counted.select("__s", "__r", (F.sum("__c").over(Window.partitionBy("__s").orderBy("__r")) - F.col("__c")).alias("__offset")), "offsets")  # a row per range
    order = Window.partitionBy(shard, "__range").orderBy("__h", *rows.columns).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("__before", F.coalesce(F.sum("__n").over(order), F.lit(0)))
    joined = inside.join(F.broadcast(offsets) if bounded(offsets, BROADCAST_RANGES) else offsets, (F.col(shard) == F.col("__s")) & (F.col("__range") == F.col("__r")))
    first = joined.select(*rows.columns, "__n", (F.col("__offset") + F.col("__before")).alias("__first"))
    starts = F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(alike).cast("long"))
    if not kinds.filter(F.col("__n") > alike).isEmpty():
        parts = first.withColumn("__start", F.explode(starts)).repartition(*rows.columns, "__start")  # a part is a task's work, a kind isn't
    else:
        parts = first.withColumn("__start", F.lit(0).cast("long"))
    begin = F.col("__first") + F.col("__start")
    return parts.select(*rows.columns, F.explode(F.sequence(begin, begin + F.least(F.lit(alike), F.col("__n") - F.col("__start")) - 1)).alias(name))


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, weights: Sequence[float] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    size is the text's UTF-8 bytes plus 1, of a null text 1; the checksum is that of
    the bytes, of a null text 0.  shard follows from doc_id and the number of
    shards, grown_shard with one more of them, which weighs as much as the
    first.  Rows of one doc_id share a shard, as do all rows without doc_id;
    repeated rows have a slot each.  An empty table gives no rows.
    """
    own = list(weights) if weights is not None else [1.0] * shards
    about = docs.select("doc_id", (F.octet_length(text_of(docs)) + 1).cast("long").alias("size"), F.crc32(text_of(docs).cast("binary")).alias("text_crc32"))
    placed = assigned(about, "doc_id", {"shard": own, "grown_shard": [*own, own[0]]}, seed)
    out = slotted(placed)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


_DRAW = f"-ln((CAST('0x' || substr(md5('{SEED}:' || s || ':' || k), 1, {DIGITS}) AS BIGINT) + 0.5::DOUBLE) / {1 << (4 * DIGITS)}::DOUBLE)"
#: DuckDB's form of sharded() with the defaults, over documents: the checksum's table and its steps over bytes in SQL.
SQL = f"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS k, hex(encode(coalesce(text, ''))) AS h FROM documents),
a AS (
  SELECT doc_id, k, CAST(len(h) // 2 + 1 AS BIGINT) AS size,
         xor(list_reduce(list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32,
         CAST(list_min(list_transform(range({SHARDS}), lambda s: {{'d': {_DRAW}, 's': s}})).s AS INTEGER) AS shard,
         CAST(list_min(list_transform(range({SHARDS + 1}), lambda s: {{'d': {_DRAW}, 's': s}})).s AS INTEGER) AS grown_shard
  FROM d, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY CAST('0x' || substr(md5(concat_ws(':', 'slot', k, size, text_crc32, shard, grown_shard)), 1, {DIGITS}) AS BIGINT), doc_id, size, text_crc32) - 1 AS slot, grown_shard
FROM a
"""
