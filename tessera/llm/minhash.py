"""Near-dedup by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct 5-word shingles as 64-bit hashes.  One
permutation places a shingle in a universe of 2**20; the second one, shifted
circularly by k, gives coordinate k of the signature, so that two permutations
make all coordinates and a shingle's 256 values lie side by side.  Bands of
eight coordinates put documents into buckets.

Documents with equal sets are one class, represented by the smallest doc_id,
before anything is compared.  In each bucket the classes are first compared
with the smallest one only; what that links is one component.  Buckets that
still hold different components are then compared in blocks of about
`BLOCK_SHINGLES` shingles, each pair of blocks a group of its own, and yield
only links that join components: no pairs are written, however large a group
of near copies is.  All comparisons are exact, on whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded, give_back, table, text_of
from tessera.llm.graph import components, of_one_id

WORDS = 5
BANDS, ROWS = 32, 8
UNIVERSE = 1 << 20
SEED = 11
BLOCK_SHINGLES = 60_000
#: At most so many ids are broadcast; more are joined by shuffling.
BROADCAST_IDS = 500_000

_MIX = tuple(np.random.default_rng(SEED + 1).integers(1, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingles' hashes, sorted; fewer words than five are one shingle, none give none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    if len(h) < WORDS:
        return mixed(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 99)], np.uint64))
    n = len(h) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for j, m in enumerate(_MIX):
        total += h[j : j + n] * m
    return np.unique(mixed(total))


class Circulant:
    """The two permutations and the bands made of their signatures."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> None:
        noise = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.place = noise.permutation(UNIVERSE).astype(np.int64)
        value = noise.permutation(UNIVERSE).astype(np.int32)
        size = bands * rows
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([value, value[: size - 1]]), size)
        self.factors = noise.integers(1, 1 << 62, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """The least value in each of the shifted permutations."""
        at = self.place[(hashes & np.uint64(UNIVERSE - 1)).astype(np.int64)]
        out = None
        for i in range(0, len(at), 2048):
            part = self.windows[at[i : i + 2048]].min(0)
            out = part if out is None else np.minimum(out, part)
        return out

    def band_hashes(self, hashes: np.ndarray) -> np.ndarray:
        rows = self.signature(hashes).astype(np.uint64).reshape(self.bands, self.rows)
        return mixed((rows * self.factors).sum(1, dtype=np.uint64) + np.arange(self.bands, dtype=np.uint64)).view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]))).cast(pa.list_(pa.int64()))


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n (set size), s0, s1 (a hash of the set), bands (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Circulant(bands, rows)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                sizes, digests, signed = [], [], []
                for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                    got = shingles(text)
                    sizes.append(len(got))
                    digests.append(hashlib.md5(got.tobytes()).digest())
                    signed.append(family.band_hashes(got) if len(got) else np.zeros(0, np.int64))
                pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), _lists(signed)], names=["doc_id", "n", "s0", "s1", "bands"])
        give_back()

    return _texts(docs).mapInArrow(run, "doc_id long, n long, s0 long, s1 long, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, set (sorted hashes) of the classes wanted: cid, rep, s0, s1.

    The texts of the doc_ids rep are read again; of rows with one doc_id, those
    whose set is the class's count."""
    ids = wanted.select("rep").distinct()
    chosen = _texts(docs).join(F.broadcast(ids) if bounded(ids, BROADCAST_IDS) else ids, F.col("doc_id") == ids["rep"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                got = [shingles(x) for x in batch.column("text").cast(pa.large_binary()).to_pylist()]
                pair = np.frombuffer(b"".join(hashlib.md5(x.tobytes()).digest() for x in got), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), _lists([x.view(np.int64) for x in got])], names=["h0", "h1", "set"])
        give_back()

    sets = chosen.select("text").mapInArrow(run, "h0 long, h1 long, set array<long>").dropDuplicates(["h0", "h1"])
    return wanted.join(sets, (F.col("s0") == F.col("h0")) & (F.col("s1") == F.col("h1"))).select("cid", "set")


def linked(docs: DataFrame, reps: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b: doc_ids) of the pairs of classes (ca, cb: their cids; a, b; na, nb: set sizes) whose sets are at least so alike."""
    pairs = table(pairs.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).distinct(), "pairs")
    cids = pairs.select(F.explode(F.array("ca", "cb")).alias("c")).distinct()
    sets = table(sets_of(docs, table(_named(reps, cids), "ids")), "sets")
    both = pairs.join(sets.select(F.col("cid").alias("ca"), F.col("set").alias("sa")), "ca").join(sets.select(F.col("cid").alias("cb"), F.col("set").alias("sb")), "cb")
    shared = F.size(F.array_intersect("sa", "sb"))
    scored = both.select("a", "b", "na", "nb", shared.alias("shared"))
    return table(scored.filter(F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * percent).select("a", "b"), "links")


def _named(reps: DataFrame, cids: DataFrame) -> DataFrame:
    """cid, rep, s0, s1 of the classes whose cid is in cids (column c)."""
    return reps.select("cid", "rep", "s0", "s1").join(cids, F.col("cid") == F.col("c"), "left_semi")


def across(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join different labels within buckets (band, key).

    rows: cid, rep, n, label, band, key, blocks, set."""
    block = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    placed = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("rep", "n", "label", "set", "band", "key", "block", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"))

    def compare(group: pa.Table) -> pa.Table:
        rep, n, label, side = (group.column(c).to_numpy() for c in ("rep", "n", "label", "block"))
        b1, b2 = group.column("b1")[0].as_py(), group.column("b2")[0].as_py()
        lists = group.column("set").combine_chunks()
        owner = np.repeat(np.arange(len(rep)), np.diff(lists.offsets.to_numpy()))
        _, code, count = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        shared = count[code] > 1  # a shingle of one document is in no intersection
        renumbered = np.cumsum(count > 1) - 1
        owner, code = owner[shared], renumbered[code[shared]]
        bits = np.zeros((len(rep), int((count > 1).sum()) // 64 + 1), np.uint64)
        np.bitwise_or.at(bits, (owner, code >> 6), np.uint64(1) << (code & 63).astype(np.uint64))
        top = {x: x for x in label.tolist()}

        def root(x: int) -> int:
            while top[x] != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        right = np.flatnonzero(side == b2)
        a, b = [], []
        for i in np.flatnonzero(side == b1).tolist():
            some = right[(label[right] != label[i]) & (np.minimum(n[right], n[i]) * 100 >= np.maximum(n[right], n[i]) * percent)]
            if b1 == b2:
                some = some[some > i]
            both = np.bitwise_count(bits[some] & bits[i]).sum(1, dtype=np.int64)
            for j in some[both * 100 >= (n[some] + n[i] - both) * percent].tolist():
                p, q = root(int(label[i])), root(int(label[j]))
                if p != q:
                    top[max(p, q)] = min(p, q)
                    a.append(int(rep[i]))
                    b.append(int(rep[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return placed.groupBy("band", "key", "b1", "b2").applyInArrow(compare, "a long, b long")


def classes(docs: DataFrame, percent: int = 85, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Links are pairs with 100 * intersection >= percent * union.  Documents
    without words have empty sets and link with nothing.  Rows of equal text
    are in one component, and so are rows of one doc_id, each linked by its own
    text; rows without doc_id have no component and are kept.  Whole texts
    count, however long; an empty table gives no rows.
    """
    signed = table(signatures(docs, bands, rows), "signed")
    worded = signed.filter("n > 0 AND doc_id IS NOT NULL")
    reps = worded.groupBy("s0", "s1").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    reps = table(reps.withColumn("cid", F.monotonically_increasing_id()), "classes")  # different classes of one doc_id have the same rep
    entries = reps.select("cid", "rep", "n", F.posexplode("bands").alias("band", "key"))
    buckets = entries.groupBy("band", "key").agg(F.min(F.struct("rep", "cid", "n")).alias("least"), F.count("*").alias("members")).filter("members > 1").drop("members")
    held = table(entries.join(buckets, ["band", "key"]).select("cid", "rep", "n", "band", "key", F.col("least.cid").alias("lc"), F.col("least.rep").alias("least"), F.col("least.n").alias("nl")), "buckets")
    stars = held.filter("cid <> lc").select(F.col("lc").alias("ca"), F.col("cid").alias("cb"), F.col("least").alias("a"), F.col("rep").alias("b"), F.col("nl").alias("na"), F.col("n").alias("nb"))
    links = linked(docs, reps, stars, percent)

    own = signed.join(reps.select(F.col("s0").alias("r0"), F.col("s1").alias("r1"), "rep"), (F.col("s0") == F.col("r0")) & (F.col("s1") == F.col("r1")) & (F.col("n") > 0), "left")
    own = table(own.select("doc_id", "n", "rep"), "rows")
    links = table(links.unionByName(of_one_id(own.select(F.col("doc_id").alias("id"), "rep"))), "links_and_ids")
    found = table(components(links), "components")

    # Buckets that still hold different components: compare across these.
    labelled = table(held.join(found, held["rep"] == found["node"], "left").select("cid", "rep", "n", "band", "key", F.coalesce("label", "rep").alias("label")), "labelled")
    totals = labelled.groupBy("band", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members"), F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    left = table(labelled.join(totals.filter("lo <> hi AND members > 2").select("band", "key", "blocks"), ["band", "key"]), "open")
    sets = table(sets_of(docs, table(_named(reps, left.select(F.col("cid").alias("c")).distinct()), "open_ids")).withColumnRenamed("cid", "c"), "open_sets")
    more = table(across(left.join(sets, left["cid"] == sets["c"]).drop("c"), percent), "more_links")
    if not more.isEmpty():
        found = table(components(links.unionByName(more)), "components")

    own = own.join(found, F.coalesce("rep", "doc_id") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "rep", "doc_id"))
    out = own.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs without the documents that aren't their component's smallest; same columns.
    Rows of one doc_id are one document, and stay or go together."""
    gone = table(classes(docs, percent, bands, rows).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(F.broadcast(gone) if bounded(gone, BROADCAST_IDS) else gone, docs["doc_id"].cast("long") == gone["__gone"], "left_anti")
