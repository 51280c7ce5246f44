"""Document fingerprints by closed syncmers, in DataFrame functions only.

A text's symbols are its code points.  Of every `K` symbols in a row, the hashes
of the inner runs of `S` symbols are compared; the k-mer is an anchor if the
least of them is the first or the last one.  That depends on the k-mer alone,
so equal passages have equal anchors wherever they stand, with or without
spaces, and every K - S + 1 k-mers in a row have one at least.  For the same reason a
long text can be taken in pieces that overlap by K - 1, each a bounded array.
A text with fewer than K symbols is one anchor, its whole text; an empty text
has none.

The fingerprint lists the anchors in the text's order, each as 8 hexadecimal
digits of its hash and 2 of the distance from the anchor before (of the first
one: from the beginning), so it gives their positions.  Two fingerprints are
matched by position: an anchor of one matches an anchor of the other if the hashes, the next
anchors' hashes and the distances to these are equal.  The likeness is
2 * matching / (size + size) over the different ones, 1 for two empty
fingerprints: a text whose second half is replaced keeps about 0.5.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, text_of

K, S = 16, 4
#: Code points of a text that are looked at together.
PIECE = 1 << 16
#: Rows of one bucket of neighbouring documents, about; buckets at most (more documents make longer buckets, which spill); sampled keys for each.
BUCKET_ROWS, BUCKETS, SAMPLED = 2_000, 20_000, 32
#: Rows that are alike and are written by one task.
TOGETHER = 1_000

_LOW = 0xFFFFFFFF


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pairwise(values: Column, step: int, join) -> Column:
    """join(value, the value `step` places on), at every place; the last ones have none and are not used."""
    return F.transform(values, lambda x, i: join(x, F.get(values, i + step)))


def _runs(symbols: Column, s: int, body) -> Column:
    """body(hashes of all runs of s symbols), s a power of two: a run's hash is made from its halves' hashes."""
    if s == 1:
        return _let(F.transform(symbols, lambda c: F.xxhash64(c)), body)
    return _runs(symbols, s // 2, lambda h: _let(_pairwise(h, s // 2, F.xxhash64), body))


def _least(values: Column, width: int, body) -> Column:
    """body(f), where f(x, i) tells whether x is at most each of the `width` values after place i: the
    least of 2, 4, ... values by doubling, and the first of a few of these that is less ends the look."""

    def grow(values: Column, have: int) -> Column:
        if 4 * have > width:
            starts = [*range(0, width - have, have), width - have]
            return body(lambda x, i: functools.reduce(lambda p, q: p & q, [x <= F.get(values, i + (j + 1)) for j in starts]))
        return _let(_pairwise(values, have, F.least), lambda v: grow(v, 2 * have))

    return grow(values, 1)


def _anchors_of(text: Column, offset: Column, k: int, s: int) -> Column:
    """Anchors of a text's k-mers, each as position << 32 | hash, positions counted from offset."""
    last = k - s  # of a k-mer's inner runs

    def chosen(runs: Column) -> Column:
        def edges(at_most) -> Column:
            covering = [*range(0, last, s), last]
            mark = lambda i: F.shiftleft(i.cast("long") + offset, 32).bitwiseOR(F.xxhash64(*(F.get(runs, i + j) for j in covering)).bitwiseAND(F.lit(_LOW)))
            kmers = F.size(runs) - (k - 1)
            marked = F.transform(runs, lambda x, i: F.when(at_most(F.least(x, F.get(runs, i + last)), i) & (i < kmers), mark(i)))
            return F.array_compact(marked)

        return _least(runs, last - 1, edges)

    return F.when(F.length(text) >= k, _runs(F.split(text, ""), s, chosen)).otherwise(F.array().cast("array<bigint>"))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """The anchors in order, an array of long: position << 32 | 32-bit hash."""
    n = F.length(text)
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0)), F.lit(PIECE)), lambda i: _anchors_of(F.substring(text, i + 1, F.lit(PIECE + k - 1)), i.cast("long"), k, s))
    return F.when(n >= k, F.flatten(pieces)).when(n > 0, F.array(_short(text))).otherwise(F.array().cast("array<bigint>"))


def _short(text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit(_LOW))


def _position(mark: Column) -> Column:
    return F.shiftright(mark, 32)


def edited_anchors(marks: Column, next_marks: Column, edited: Column, keep: Column, taken: Column, k: int = K, s: int = S) -> Column:
    """anchors(edited) of a text of `keep` code points from one text and `taken` from the beginning
    of the next, from the anchors of both: only k-mers across the seam are looked at."""
    n = keep + taken
    first = F.greatest(keep - (k - 1), F.lit(0))
    seam = _anchors_of(F.substring(edited, first + 1, F.lit(2 * (k - 1))), first.cast("long"), k, s)
    before = F.filter(marks, lambda m: _position(m) <= keep - k)
    after = F.transform(F.filter(next_marks, lambda m: _position(m) <= taken - k), lambda m: m + F.shiftleft(keep.cast("long"), 32))
    return F.when(n >= k, F.concat(before, seam, after)).when(n > 0, F.array(_short(edited))).otherwise(F.array().cast("array<bigint>"))


def fingerprint(marks: Column) -> Column:
    """The anchors as text; k - s + 1, the largest distance, has two digits."""
    gap = lambda m, i: _position(m) - F.when(i > 0, _position(F.get(marks, i - 1))).otherwise(F.lit(0).cast("long"))
    return F.lower(F.array_join(F.transform(marks, lambda m, i: F.lpad(F.hex(F.shiftleft(m.bitwiseAND(F.lit(_LOW)), 8) + gap(m, i)), 10, "0")), ""))


def places(marks: Column) -> Column:
    """Per anchor, a hash of it, the next anchor and the distance between them; of the last one, of it alone."""

    def one(m: Column, i: Column) -> Column:
        after = F.get(marks, i + 1)
        return F.xxhash64(m.bitwiseAND(F.lit(_LOW)), after.bitwiseAND(F.lit(_LOW)), _position(after) - _position(m))

    return F.array_distinct(F.transform(marks, one))


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of places(), 0 to 1."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def _bucket(keys: DataFrame, n: int, rows: int):
    """A function that gives each (neg, tie) its bucket: how many cuts are at or below it.  Cuts are keys of
    a sample; every row finds its bucket by its own key alone."""
    parts = min(BUCKETS, n // rows)
    if parts < 2:
        return lambda key: F.lit(0)
    sampled = keys.select("neg", "tie").sample(min(1.0, SAMPLED * parts / n), 5).toArrow()
    sampled = np.unique(np.array([sampled.column("neg").to_numpy(), sampled.column("tie").to_numpy()]).T, axis=0)
    step = max(1, len(sampled) // parts)
    cuts = sampled[step::step]
    wide = max(1, int(len(cuts) ** 0.5))
    literal = lambda c: F.arrays_zip(*(F.lit(np.ascontiguousarray(c[:, i])).alias(name) for i, name in enumerate(("neg", "tie"))))
    if not len(cuts):
        return lambda key: F.lit(0)

    def found(key: Column) -> Column:
        block = F.size(F.filter(literal(cuts[::wide]), lambda c: c <= key))
        inside = F.size(F.filter(F.slice(literal(cuts), F.greatest(block - 1, F.lit(0)) * wide + 1, wide), lambda c: c <= key))
        return F.when(block == 0, 0).otherwise((block - 1) * wide + inside)

    return found


def _whole_rows(texts: DataFrame, keys: DataFrame) -> tuple[DataFrame, bool]:
    """texts with copies: rows that are alike in doc_id and text as one row; and whether any has more than TOGETHER.
    Only such rows are gathered, after partial aggregation."""
    same = ["neg", "tie", "tie2"]
    repeated = table(keys.groupBy(*same).count().filter("count > 1").select(*(F.col(c).alias(f"r_{c}") for c in (*same, "count"))), "repeated")
    on = [texts[c] == repeated[f"r_{c}"] for c in same]
    single = texts.withColumn("copies", F.lit(1).cast("long"))
    if repeated.isEmpty():
        return single, False
    gathered = texts.join(repeated, on, "left_semi").groupBy("doc_id", *same).agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    return single.join(repeated, [single[c] == repeated[f"r_{c}"] for c in same], "left_anti").unionByName(gathered), not repeated.filter(F.col("r_count") > TOGETHER).isEmpty()


def fingerprints(docs: DataFrame, k: int = K, s: int = S, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next of every document.

    Documents are in descending order of doc_id, null last; rows of one doc_id
    are ordered by their texts' hash.  The edited text has its last half
    replaced by the beginning of the next document's, or all of it if that is
    shorter; the last document is followed by the first, a single document
    by itself.  A null text counts as empty; an empty table gives no rows.

    The texts move once: to buckets of neighbouring documents, cut by doc_id and
    the text's hash, so that many rows of one doc_id are dealt out too.  Each bucket
    also gets a copy of the first document of the next one.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
    texts = texts.withColumn("neg", F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1))).withColumn("tie", F.xxhash64("text")).withColumn("tie2", F.xxhash64(F.lit(1), "text"))
    keys = table(texts.select("neg", "tie", "tie2"), "keys")
    rank = F.struct("neg", "tie")
    bucket = _bucket(keys, keys.count(), bucket_rows)
    # The first document of each bucket, and the bucket before it, the first one following the last.
    heads = keys.withColumn("__bucket", bucket(rank)).groupBy("__bucket").agg(F.min(F.struct("neg", "tie", "tie2")).alias("__head"))
    order = Window.orderBy("__bucket")  # a row per bucket
    backward = heads.select("__head", F.lag("__bucket").over(order).alias("__before"), F.max("__bucket").over(Window.partitionBy()).alias("__last"))
    backward = table(backward.select(F.col("__head.neg").alias("h_neg"), F.col("__head.tie").alias("h_tie"), F.col("__head.tie2").alias("h_tie2"), F.coalesce("__before", "__last").alias("__to")), "backward")
    whole, many = _whole_rows(texts, keys)
    whole = whole.withColumn("__bucket", bucket(rank))
    found = whole.join(F.broadcast(backward), (F.col("neg") == F.col("h_neg")) & (F.col("tie") == F.col("h_tie")) & (F.col("tie2") == F.col("h_tie2")), "left")  # a row per bucket
    place = lambda b, ghost: F.struct(F.col(b).alias("b"), F.lit(ghost).alias("g"))
    spread = found.withColumn("__at", F.explode(F.when(F.col("__to").isNull(), F.array(place("__bucket", 0))).otherwise(F.array(place("__bucket", 0), place("__to", 1)))))
    spread = spread.select("doc_id", "text", "neg", "tie", "tie2", "copies", F.col("__at.b").alias("__bucket"), F.col("__at.g").alias("__ghost"))
    marked = spread.repartition("__bucket").withColumn("marks", anchors(F.col("text"), k, s)).withColumn("places", places(F.col("marks")))
    row = Window.partitionBy("__bucket").orderBy("__ghost", "neg", "tie", "tie2")
    paired = marked.withColumn("next", F.lead("text").over(row)).withColumn("next_marks", F.lead("marks").over(row)).withColumn("next_places", F.lead("places").over(row)).filter("__ghost = 0")
    # Rows that are alike follow each other; the last of them has the next document.  The others have one result, which is repeated at the end.
    following = lambda count, *names: F.struct(count.cast("long").alias("rows"), *(F.col(c).alias(n) for c, n in zip(names, ("text", "marks", "places"), strict=True)))
    after, own = following(F.lit(1), "next", "next_marks", "next_places"), following(F.col("copies") - 1, "text", "marks", "places")
    paired = paired.select("doc_id", "text", "marks", "places", F.explode(F.when(F.col("copies") == 1, F.array(after)).otherwise(F.array(own, after))).alias("next"))
    n = F.length("text")
    taken = F.least(F.expr("length(text) div 2").cast("int"), F.length("next.text"))
    keep = n - F.expr("length(text) div 2").cast("int")
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 2)"), F.expr("left(next.text, length(text) div 2)"))
    out = paired.select("doc_id", F.col("next.rows").alias("rows"), n.cast("long").alias("n_chars"), "marks", "places", F.col("next.marks").alias("next_marks"), F.col("next.places").alias("next_places"), keep.alias("keep"), taken.alias("taken"), edited.alias("edited"))
    out = out.select("doc_id", "rows", "n_chars", "marks", "places", "next_places", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), edited_anchors(F.col("marks"), F.col("next_marks"), F.col("edited"), F.col("keep"), F.col("taken"), k, s).alias("edited_marks"))
    out = out.select(
        "doc_id", "rows", "n_chars", "edited_sha256",
        fingerprint(F.col("marks")).alias("fingerprint"), fingerprint(F.col("edited_marks")).alias("edited_fingerprint"),
        _let(places(F.col("edited_marks")), lambda x: likeness(F.col("places"), x)).alias("near_edited"), likeness(F.col("places"), F.col("next_places")).alias("near_next"),
    )
    if many:  # in parts, so that no task writes all rows of one kind
        out = out.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(TOGETHER).cast("long"))))
        out = out.repartition("doc_id", "n_chars", "edited_sha256", "__part").withColumn("rows", F.least(F.col("rows") - F.col("__part"), F.lit(TOGETHER))).drop("__part")
    return out.withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("rows", "__row")
