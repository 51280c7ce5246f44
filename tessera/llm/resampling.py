"""Importance resampling towards a target's distribution, over word-id suffix arrays.

A document's features are its runs of 1 to `longest` words, each hashed to a
bucket.  In each partition the words of many documents become one sequence of
numbers, a document's end being a number of its own, and the suffixes of that
sequence are sorted (prefix doubling; a round sorts only the suffixes that are
not told apart yet).  Neighbours that share n words stand in one run; a run is
one n-gram, however often it occurs.  So each n-gram is hashed once per run and
its bucket is scattered back to the places of the run's suffixes.

The buckets by place are written once.  Their counts over all documents and
over the target give each bucket's gain, the log of how much likelier it is in
the target; a document's weight is the sum of gains over its buckets.  With
Gumbel noise from a hash of doc_id, the highest scores are a sample without
replacement in proportion to the exponential of the weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import give_back, table, text_of
from tessera.operators.ordering import positions

LONGEST, BUCKETS = 1, 10_000
#: Documents with fewer words aren't drawn; percent of the others that are.
LEAST_WORDS, PERCENT = 20, 10
SEED = 2024
#: Words of one suffix array at most; a longer document is taken in pieces that overlap.
WORDS = 1 << 19
#: On bytes: every byte of a character beyond ASCII belongs to a word.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8; letters A-Z are lowered, others are not."""
    return WORD.findall(text.lower())


def suffix_array(ids: np.ndarray) -> np.ndarray:
    """The suffixes of a sequence of numbers from 0, in order; one that ends first is less.

    Ranks double their reach every round, and only suffixes whose rank isn't
    theirs alone are sorted again."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    rank = np.zeros(n, np.int64)  # the place of the first suffix that is equal as far as is known
    rank[order] = _firsts(ids[order], np.arange(n))
    reach = 1
    open_ = _shared(rank[order], np.arange(n))  # places whose suffixes share their rank, in the order
    while len(open_):
        who = order[open_]
        then = who + reach
        after = np.where(then < n, rank[np.minimum(then, n - 1)] + 1, 0)
        key = rank[who] * (n + 1) + after
        sort = np.argsort(key, kind="stable")
        who, key = who[sort], key[sort]
        order[open_] = who
        rank[who] = _firsts(key, open_)
        open_ = open_[_shared(rank[who], np.arange(len(who)))]
        reach *= 2
    return order


def _firsts(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For sorted keys, the place of the first equal one."""
    new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    return places[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))] if len(keys) else places


def _shared(keys: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places, in sorted order, whose key a neighbour has too."""
    same = keys[1:] == keys[:-1]
    return places[np.r_[False, same] | np.r_[same, False]] if len(keys) else places


def run_buckets(ids: np.ndarray, ends: np.ndarray, names: list[bytes], longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, places, buckets of the n-grams that begin there), for n from 1 to longest.

    ids: word numbers, `names` being the words' bytes; ends: for every place, where its document's words end."""
    n = len(ids)
    last = np.flatnonzero(np.arange(n) == ends)  # a document's end is a number of its own
    sequence = ids + len(last)
    sequence[last] = np.arange(len(last))
    order = suffix_array(sequence)
    shared = np.zeros(max(n - 1, 0), np.int64)  # words that neighbours in the order have in common, up to longest
    alike = np.ones(max(n - 1, 0), bool)
    for k in range(longest):
        a, b = order[:-1] + k, order[1:] + k
        alike &= (b < n) & (a < n)
        alike[alike] = sequence[a[alike]] == sequence[b[alike]]
        shared += alike
    for k in range(1, longest + 1):
        whole = order + k <= ends[order]  # n-grams that end within their document
        starts = np.r_[True, shared < k][:n]
        run = np.cumsum(starts) - 1
        first = order[np.flatnonzero(starts & whole)]  # a run is whole or not: all its n-grams are the same words
        hashed = np.fromiter((zlib.crc32(b" ".join([names[i] for i in ids[p : p + k]])) % buckets for p in first.tolist()), np.int64, len(first))
        by_run = np.zeros(run[-1] + 1 if n else 0, np.int64)
        by_run[run[starts & whole]] = hashed
        yield k, order[whole], by_run[run[whole]]


def pieces(lists: list[list[bytes]], longest: int, most: int) -> Iterator[list[tuple[int, list[bytes], int]]]:
    """Groups of (document, words, how many places of them count) of about `most` words each; pieces overlap by longest - 1 words."""
    out, size = [], 0
    for i, own in enumerate(lists):
        for start in range(0, max(len(own), 1), most):
            piece = own[start : start + most + longest - 1]
            out.append((i, piece, min(most, len(own) - start)))
            size += len(piece)
            if size >= most:
                yield out
                out, size = [], 0
    if out:
        yield out


def buckets_of(texts: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS, most: int = WORDS) -> tuple[list[int], list[np.ndarray]]:
    """Per text the number of words, and the buckets of its features by length and place."""
    lists = [words(t) for t in texts]
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for group in pieces(lists, longest, most):
        sequence = [w for _, piece, _ in group for w in (*piece, b"")]  # an empty one at every document's end
        names = list(dict.fromkeys(sequence))
        number = dict(zip(names, range(len(names)), strict=True))
        ids = np.fromiter(map(number.__getitem__, sequence), np.int64, len(sequence))
        sizes = np.array([len(piece) + 1 for _, piece, _ in group])
        starts = np.r_[0, np.cumsum(sizes)]
        for k, places, got in run_buckets(ids, np.repeat(starts[1:] - 1, sizes), names, longest, buckets):
            scattered = np.full(len(ids), -1, np.int64)
            scattered[places] = got
            for (i, _, counted), start in zip(group, starts, strict=False):
                own = scattered[start : start + counted]
                found[i].append(own[own >= 0])
    return list(map(len, lists)), [np.concatenate([*x, np.zeros(0, np.int64)]) for x in found]


def bucketed(docs: DataFrame, keep: list[str], longest: int = LONGEST, buckets: int = BUCKETS, most: int = WORDS) -> DataFrame:
    """keep's columns, words and features (bucket numbers, repeats included) of every row of docs (text)."""
    schema = f"{''.join(f'`{c}` {docs.schema[c].dataType.simpleString()}, ' for c in keep)}words long, features array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pa.compute.binary_length(batch.column("__text")).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(sizes // (8 * most))) + 1).tolist(), batch.num_rows]  # about as many words as one array holds
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(a, b - a)
                counts, got = buckets_of(part.column("__text").to_pylist(), longest, buckets, most)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, got)]), pa.int32()), pa.array(np.concatenate([*got, np.zeros(0, np.int64)]), pa.int32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(counts, pa.int64()), lists], names=[*keep, "words", "features"])
        give_back()

    return docs.select(*keep, text_of(docs).cast("binary").alias("__text")).mapInArrow(run, schema)


def counts_of(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs; a partition gives one row per bucket it has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("features").flatten().to_numpy(), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    got = features.select("features").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # `buckets` rows at most
    out = np.zeros(buckets, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log of each bucket's smoothed share of the target against that of the source, rounded down."""
    n = len(source)
    ratio = (target + 1.0) * (source.sum() + float(n)) / ((source + 1.0) * (target.sum() + float(n)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel variate from the hash of seed and doc_id, rounded down; a null doc_id hashes as empty."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank is 1, 2, ... of the drawn ones, else null.

    percent of the documents with least_words or more are drawn, rounded down,
    the highest scores first, ties to the smaller doc_id, a null one last.  A
    null or empty text has no features and weight 0.  Repeated rows are
    documents of their own; rows of one doc_id share their noise, and among
    equal scores the one with fewer features comes first.  An empty target, or
    one without words, leaves only the smoothed counts; an empty table gives no rows.
    """
    features = table(bucketed(docs, ["doc_id"], longest, buckets), "features")
    gain = gains(counts_of(features, buckets), counts_of(bucketed(target, [], longest, buckets), buckets))
    kept = docs.schema["doc_id"].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("features")
            sums = np.r_[0, np.cumsum(gain[lists.flatten().to_numpy()])]
            ends = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("words"), pa.array(np.diff(ends), pa.int64()), pa.array(np.diff(sums[ends]), pa.int64())], names=["doc_id", "words", "n_features", "weight"])

    weighed = features.mapInArrow(weigh, f"doc_id {kept}, words long, n_features long, weight long")
    scored = table(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    long_enough = scored.filter(F.col("words") >= least_words)
    drawn = long_enough.count() * percent // 100
    # In the order of positions() nulls come first.
    order = [-F.col("score"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("n_features")]
    ranked = positions(long_enough, order, "__place").withColumn("rank", F.when(F.col("__place") < drawn, F.col("__place") + 1))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return ranked.select(*columns).unionByName(scored.filter(F.col("words") < least_words).withColumn("rank", F.lit(None).cast("long")).select(*columns))


#: DuckDB's form of resample() with the defaults, over documents and benchmark: the checksum's table and its steps over bytes in SQL.
SQL = r"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT row, unnest(w) AS word FROM d),
bw AS (SELECT unnest(w) AS word FROM b),
names AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
hashed AS (SELECT word, xor(list_reduce(list_transform(range(1, len(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)),
                  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS bucket FROM names, crc),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN hashed USING (word) GROUP BY bucket),
g AS (SELECT s.bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t ON s.bucket = t.bucket),
w AS (SELECT row, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN hashed USING (word) JOIN g USING (bucket) GROUP BY row),
scored AS (
  SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN w USING (row)),
ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM scored LEFT JOIN ranked USING (row)
"""
