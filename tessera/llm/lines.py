"""Line dedup with sharded cuckoo filters over exact reference-count tables.

A line's key is its text without the white space at both ends, ASCII letters in
lower case.  References are the distinct (key, document) pairs, keys as
128-bit hashes.  The exact table counts the references of every key and names
its smallest document; a line goes if its key is long enough, has at least two
documents and this is not the smallest.

The keys that have at least two documents are also held as 16-bit
fingerprints in cuckoo filters, one for each shard of the hash space.  References
are dealt to their shards, busy shards in several parts, and each part meets its
shard's filter alone, so that no task ever holds all filters.  A filter never
misses a key that it holds, so a reference that its filter denies is unique and
needs no look at the exact table: that spares most references the join.  Filters
support deletion, and `LineIndex` keeps references and removals as batches, so
documents can be added and taken back: taking one back may leave a key with
one document, whose fingerprint is then deleted, and the line stays again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded, give_back, table, text_of
from tessera.sources.files import children, exists

LEAST_CHARS = 10
STRIPPED = b" \t\n\x0b\x0c\r"
#: Keys for each shard's filter, about.
SHARD_KEYS = 100_000
#: References of one part of a shard, about.
PART_REFERENCES = 1_000_000
#: At most so many shards' numbers of parts are broadcast.
BROADCAST_SHARDS = 200_000

KEY_SCHEMA = "doc_id long, hi long, lo long, lines long"


def line_key(line: bytes) -> bytes | None:
    """The key, or None if it is too short to count."""
    key = line.strip(STRIPPED).lower()
    if len(key) < LEAST_CHARS or (len(key) < 4 * LEAST_CHARS and len(key.decode()) < LEAST_CHARS):
        return None
    return key


def key_hash(key: bytes) -> tuple[int, int]:
    got = np.frombuffer(xxhash.xxh3_128_digest(key), "<i8")
    return int(got[0]), int(got[1])


def references(docs: DataFrame) -> DataFrame:
    """doc_id, hi, lo, lines: a row per document and long enough key.  Rows without
    doc_id give none; rows of one doc_id are one document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests, lines = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                seen: dict[bytes, int] = {}
                for line in text.split(b"\n"):
                    if (key := line_key(line)) is not None:
                        d = xxhash.xxh3_128_digest(key)
                        seen[d] = seen.get(d, 0) + 1
                ids += [doc] * len(seen)
                digests += seen
                lines += seen.values()
            pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(lines, pa.int64())], names=["doc_id", "hi", "lo", "lines"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).filter("doc_id IS NOT NULL").mapInArrow(run, KEY_SCHEMA)


def counted(refs: DataFrame) -> DataFrame:
    """The exact table: hi, lo, refs (references), least and most (doc_ids).  Hot
    keys are summed up before the shuffle."""
    return refs.groupBy("hi", "lo").agg(F.count("*").alias("refs"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))


class Cuckoo:
    """A cuckoo filter: buckets of four 16-bit fingerprints, 0 for empty."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int = 0, table: np.ndarray | None = None) -> None:
        if table is None:
            buckets = 1 << max(2, int(np.ceil(np.log2(max(capacity, 1) / (0.8 * self.SLOTS)))))
            table = np.zeros((buckets, self.SLOTS), np.uint16)
        self.table = table

    @staticmethod
    def fingerprint(hi: np.ndarray) -> np.ndarray:
        return (hi.view(np.uint64) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    def places(self, lo: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(len(self.table) - 1)
        a = (lo.view(np.uint64) >> np.uint64(17)) & mask
        return a, a ^ self.turn(mark)

    def turn(self, mark: np.ndarray) -> np.ndarray:
        return (mark.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(len(self.table) - 1)

    @staticmethod
    def _ranks(*keys: np.ndarray) -> np.ndarray:
        """How many equal ones stand before each."""
        order = np.lexsort(keys)
        new = np.zeros(len(order), bool)
        new[:1] = True
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        heads = np.flatnonzero(new)
        out = np.empty(len(order), np.int64)
        out[order] = np.arange(len(order)) - np.repeat(heads, np.diff(np.r_[heads, len(order)]))
        return out

    def _put(self, place: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Marks into free slots of their buckets; True for those that found one."""
        free = self.table[place] == 0
        slots, rank = np.argsort(~free, 1, kind="stable"), self._ranks(place)
        fits = np.flatnonzero(rank < free.sum(1))
        self.table[place[fits], slots[fits, rank[fits]]] = marks[fits]
        done = np.zeros(len(place), bool)
        done[fits] = True
        return done

    def insert(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """All at once into free slots, those that are left over by kicking others out.  Raises OverflowError if
        the table is too full; nothing is lost then, as the caller still has the keys."""
        marks = self.fingerprint(hi)
        first, second = self.places(lo, marks)
        rest = ~self._put(first, marks)
        marks, first, second = marks[rest], first[rest], second[rest]
        rest = ~self._put(second, marks)
        cells, kick = self.table, np.random.default_rng(len(marks))
        for mark, place in zip(marks[rest].tolist(), second[rest].tolist(), strict=True):
            for _ in range(self.KICKS):
                slot = int(kick.integers(self.SLOTS))
                mark, cells[place, slot] = int(cells[place, slot]), mark
                place ^= int(self.turn(np.array([mark], np.uint16))[0])
                free = np.flatnonzero(cells[place] == 0)
                if len(free):
                    cells[place, free[0]] = mark
                    break
            else:
                raise OverflowError("the cuckoo filter is full")

    def delete(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Of keys that were inserted.  Keys that share a mark and a bucket share both buckets, so any of their slots will do."""
        marks = self.fingerprint(hi)
        left = np.arange(len(marks))
        for place in self.places(lo, marks):
            held = self.table[place[left]] == marks[left, None]
            slots, rank = np.argsort(~held, 1, kind="stable"), self._ranks(place[left], marks[left])
            found = rank < held.sum(1)
            self.table[place[left[found]], slots[found, rank[found]]] = 0
            left = left[~found]

    def holds(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """True for all keys that it holds, and for few others."""
        marks = self.fingerprint(hi)
        first, second = self.places(lo, marks)
        return (self.table[first] == marks[:, None]).any(1) | (self.table[second] == marks[:, None]).any(1)

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Cuckoo:
        return cls(table=np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy())

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> Cuckoo:
        """A filter of these keys, as large as they need."""
        room = len(hi)
        while True:
            out = cls(room)
            try:
                out.insert(hi, lo)
                return out
            except OverflowError:
                room *= 2


def shard(shards: int):
    return F.pmod(F.col("lo"), F.lit(shards)).cast("int")


def filters(repeated: DataFrame, shards: int) -> DataFrame:
    """shard, filter: a cuckoo filter of each shard's keys."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["hi", "lo"])
        got = Cuckoo.of(group["hi"].to_numpy(np.int64), group["lo"].to_numpy(np.int64))
        return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "filter": [got.to_bytes()]})

    return repeated.select("hi", "lo", shard(shards).alias("shard")).groupBy("shard").applyInPandas(build, "shard int, filter binary")


def suspected(refs: DataFrame, built: DataFrame, shards: int) -> DataFrame:
    """doc_id, hi, lo of the references that the filters don't rule out."""
    dealt = refs.select("doc_id", "hi", "lo", shard(shards).alias("shard"))
    parts = dealt.groupBy("shard").agg(F.ceil(F.count("*") / PART_REFERENCES).cast("int").alias("parts")).filter("parts > 1")
    parts = table(parts.withColumnRenamed("shard", "__shard"), "parts")
    parts = F.broadcast(parts) if bounded(parts, BROADCAST_SHARDS) else parts

    def with_parts(df: DataFrame) -> DataFrame:
        return df.join(parts, F.col("shard") == F.col("__shard"), "left").withColumn("parts", F.coalesce("parts", F.lit(1))).drop("__shard")

    left = with_parts(dealt).withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int")).drop("parts")
    right = with_parts(built).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def look(own: pa.Table, held: pa.Table) -> pa.Table:
        if not held.num_rows:  # a shard without repeated keys
            return own.select(["doc_id", "hi", "lo"]).slice(0, 0)
        maybe = Cuckoo.from_bytes(held.column("filter")[0].as_py()).holds(own.column("hi").to_numpy(), own.column("lo").to_numpy())
        return own.select(["doc_id", "hi", "lo"]).filter(pa.array(maybe))

    return left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(look, "doc_id long, hi long, lo long")


def dropped_keys(docs: DataFrame) -> DataFrame:
    """__doc, __keys: for every document that loses lines, their keys (hi, lo)."""
    refs = table(references(docs).drop("lines"), "references")
    repeated = table(counted(refs).filter("least <> most"), "repeated")
    shards = max(1, repeated.count() // SHARD_KEYS)
    maybe = suspected(refs, table(filters(repeated, shards), "filters"), shards)
    losing = maybe.join(repeated.select("hi", "lo", "least"), ["hi", "lo"]).filter("doc_id <> least")
    return losing.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set(F.struct("hi", "lo")).alias("__keys"))


def kept_text(text: bytes, drop: set[bytes]) -> tuple[bytes, int, int]:
    """The text without the lines whose keys' digests are in drop, its lines before, and those that went."""
    lines = text.split(b"\n")
    if not drop:
        return text, len(lines), 0
    kept = [x for x in lines if (key := line_key(x)) is None or xxhash.xxh3_128_digest(key) not in drop]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def rewritten(docs: DataFrame, names: list[str], as_text: bool) -> DataFrame:
    """docs' columns `names` with __n, __gone and __kept: the text left, or its SHA-256."""
    losing = dropped_keys(docs)
    joined = docs.select(*(docs[c].alias(f"__c{i}") for i, c in enumerate(names)), docs["doc_id"].cast("long").alias("__id"), text_of(docs).alias("__text"))
    joined = joined.join(losing, F.col("__id") == F.col("__doc"), "left").select(*(f"__c{i}" for i in range(len(names))), "__text", F.col("__keys.hi").alias("__hi"), F.col("__keys.lo").alias("__lo"))
    result = joined.select(*(f"__c{i}" for i in range(len(names)))).schema
    result = result.add("__n", "long").add("__gone", "long").add("__kept", "string")
    fields = [f.name for f in result.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                n, gone, out = [], [], []
                for text, hi, lo in zip(batch.column("__text").cast(pa.large_binary()).to_pylist(), batch.column("__hi").to_pylist(), batch.column("__lo").to_pylist(), strict=True):
                    drop = {np.array(x, "<i8").tobytes() for x in zip(hi, lo, strict=True)} if hi else set()
                    kept, lines, lost = kept_text(text, drop)
                    n.append(lines)
                    gone.append(lost)
                    out.append(kept.decode() if as_text else hashlib.sha256(kept).hexdigest())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], names=fields)
        give_back()

    return joined.mapInArrow(run, result)


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document.

    A null or empty text is one empty line.  A document without doc_id keeps
    all lines and counts for none.  Rows of one doc_id are one document and
    lose the same keys.  All of a document's lines may go; the text is empty
    then.
    """
    out = rewritten(docs, ["doc_id"], as_text=False)
    return out.select(F.col("__c0").alias("doc_id"), F.col("__n").alias("n_lines"), F.col("__gone").alias("n_dropped"), F.col("__kept").alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the texts that dedup() leaves; same rows and columns.  A null
    text stays null, n_chars (if there) follows the text."""
    names = docs.columns
    out = rewritten(docs, names, as_text=True)
    columns = []
    for i, c in enumerate(names):
        if c == "text":
            columns.append(F.when(F.col(f"__c{i}").isNotNull(), F.col("__kept")).alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("__gone") > 0, F.length("__kept").cast(docs.schema[c].dataType)).otherwise(F.col(f"__c{i}")).alias(c))
        else:
            columns.append(F.col(f"__c{i}").alias(c))
    return out.select(*columns)


class LineIndex:
    """An incremental index in a shared folder: batches of references and of
    removals, the exact table and the filters that follow from them.

    insert() and delete() only write what is new; refresh() recounts the keys
    and changes the filters by the keys that gained or lost their second
    document.  All state is in the folder, so an index can be opened again
    there; what an interrupted call left is not counted, and its number not
    used again.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 1) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        known = [int(x.removeprefix("shards=")) for x in children(spark, self.path) if x.startswith("shards=")]
        if not known:
            spark.range(1).write.parquet(f"{self.path}/shards={shards}")
        self.shards = known[0] if known else shards

    def _numbers(self, *kinds: str, whole: bool) -> list[int]:
        """Numbers of a kind's subfolders: all, or those that were written to their end in every kind."""
        seen = [{int(x.removeprefix("batch=")) for x in children(self.spark, f"{self.path}/{k}") if not whole or exists(self.spark, f"{self.path}/{k}/{x}/_SUCCESS")} for k in kinds]
        return sorted(set.intersection(*seen) if whole else set.union(*seen))

    def _next(self, *kinds: str) -> int:
        return max(self._numbers(*kinds, whole=False), default=0) + 1

    def insert(self, docs: DataFrame) -> None:
        references(docs).write.parquet(f"{self.path}/references/batch={self._next('references', 'removals')}")

    def delete(self, doc_ids: DataFrame) -> None:
        """Takes back all references that these doc_ids have so far."""
        doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().write.parquet(f"{self.path}/removals/batch={self._next('references', 'removals')}")

    def _read(self, kind: str, schema: str) -> DataFrame | None:
        folders = [f"{self.path}/{kind}/batch={i}" for i in self._numbers(kind, whole=True)]
        return self.spark.read.schema(f"{schema}, batch int").option("basePath", f"{self.path}/{kind}").parquet(*folders) if folders else None

    def references(self) -> DataFrame:
        """Those that are not taken back."""
        refs = self._read("references", KEY_SCHEMA)
        if refs is None:
            return self.spark.createDataFrame([], "doc_id long, hi long, lo long")
        gone = self._read("removals", "doc_id long")
        if gone is not None:
            gone = gone.groupBy(F.col("doc_id").alias("__doc")).agg(F.max("batch").alias("__at"))
            refs = refs.join(gone, (refs["doc_id"] == gone["__doc"]) & (refs["batch"] < gone["__at"]), "left_anti")
        return refs.select("doc_id", "hi", "lo").distinct()

    def refresh(self) -> DataFrame:
        """The exact table of keys with at least two documents."""
        before, number = max(self._numbers("repeated", "filters", whole=True), default=0), self._next("repeated", "filters")
        counted(self.references()).filter("least <> most").write.parquet(f"{self.path}/repeated/{number}")
        now = self.spark.read.parquet(f"{self.path}/repeated/{number}")
        if not before:
            filters(now, self.shards).write.parquet(f"{self.path}/filters/{number}")
            return now
        old = self.spark.read.parquet(f"{self.path}/repeated/{before}")
        came = now.join(old, ["hi", "lo"], "left_anti").select("hi", "lo", F.lit(1).alias("sign"))
        went = old.join(now, ["hi", "lo"], "left_anti").select("hi", "lo", F.lit(-1).alias("sign"))
        change = came.unionByName(went).withColumn("shard", shard(self.shards))

        def apply(held: pd.DataFrame, delta: pd.DataFrame) -> pd.DataFrame:
            got = Cuckoo.from_bytes(held["filter"].iloc[0]) if len(held) else None
            key = int((held if len(held) else delta)["shard"].iloc[0])
            for sign in (-1, 1):
                rows = delta[delta["sign"] == sign]
                hi, lo = rows["hi"].to_numpy(np.int64), rows["lo"].to_numpy(np.int64)
                if not len(rows):
                    continue
                if got is None:
                    got = Cuckoo.of(hi, lo)
                elif sign < 0:
                    got.delete(hi, lo)
                else:
                    try:
                        got.insert(hi, lo)
                    except OverflowError:  # admit everything until the next rebuild
                        got.table[:] = 0
                        return pd.DataFrame({"shard": [key], "filter": [b""]})
            return pd.DataFrame({"shard": [key], "filter": [got.to_bytes()]})

        held = self.spark.read.parquet(f"{self.path}/filters/{before}")
        after = held.groupBy("shard").cogroup(change.groupBy("shard")).applyInPandas(apply, "shard int, filter binary")
        if after.filter(F.length("filter") == 0).limit(1).count():
            after = filters(now, self.shards)
        after.write.parquet(f"{self.path}/filters/{number}")
        return now

    def _last(self, kind: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{kind}/{max(self._numbers('repeated', 'filters', whole=True))}")

    def repeated(self) -> DataFrame:
        return self._last("repeated")

    def filters(self) -> DataFrame:
        return self._last("filters")

    def losing(self) -> DataFrame:
        """doc_id, hi, lo of the references whose lines go, by the keys of the last refresh()."""
        maybe = suspected(self.references(), self.filters(), self.shards)
        return maybe.join(self.repeated().select("hi", "lo", "least"), ["hi", "lo"]).filter("doc_id <> least").select("doc_id", "hi", "lo")


#: DuckDB's form of dedup() over documents.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS least FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.i, k.line, r.key IS NOT NULL AND k.doc_id <> r.least AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
