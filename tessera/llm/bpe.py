"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of byte pieces.  Every adjacent pair that the
vocabulary can merge waits in the bucket of its merge rank; a three-level
bitmap over the ranks tells, by find-first-set, which bucket is next.  Entries
whose pair has changed since are stale and skipped.  Each merge costs a
constant number of steps and a push into the bucket's heap of positions, so a
pre-token of n bytes costs O(n log n) at worst, however long it is.

Pre-tokens repeat, so a task remembers their ids in two generations of at
most `CACHE_ENTRIES` pre-tokens of at most `CACHE_CHARS` characters.  That changes
no result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import give_back, text_of

CACHE_ENTRIES = 120_000
CACHE_CHARS = 32
#: Characters whose pre-tokens are merged together, and where the ids are kept for the output too.
BATCH_CHARS, BATCH_CHARS_WITH_IDS = 4_000_000, 1_500_000

#: The split pattern that `starts` implements.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LETTER, NUMBER, SPACE, OTHER = range(4)


def character_classes() -> np.ndarray:
    """The class of every code point, by the regex module's Unicode tables."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *[0xFFFE] * 0x800, *range(0xE000, 0x110000)]))
    out = np.full(0x110000, OTHER, np.uint8)
    for name, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\p{White_Space}", SPACE)):
        for m in regex.finditer(f"{name}+", every):
            out[m.start() : m.end()] = kind
    return out


def starts(points: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the pattern's matches begin in a text of these code points and
    their classes.

    Matches are runs of one class; the last white space before another class
    starts a match of its own, which goes on into that class if it is a plain
    space; an apostrophe that starts a match takes the ending of a contraction.
    """
    n = len(points)
    change = kind[1:] != kind[:-1]
    start = np.empty(n, bool)
    start[0] = True
    start[1:] = change
    last = np.flatnonzero(change & (kind[:-1] == SPACE))  # of a run of white space, text following
    start[last] = True
    plain = last[points[last] == 32]
    start[plain + 1] = False
    quotes = np.flatnonzero(points == 39)
    for i in quotes[start[quotes]].tolist() if len(quotes) else ():
        tail = points[i + 1 : i + 3].tolist()
        size = 2 if tail and tail[0] in _ONE else 3 if tuple(tail) in _TWO else 0
        if size:
            start[i + 1 : i + size] = False
            if i + size < n and kind[i + size] != SPACE:
                start[i + size] = True
    return np.flatnonzero(start)


_ONE = frozenset(map(ord, "stmd"))
_TWO = frozenset(tuple(map(ord, x)) for x in ("re", "ve", "ll"))


class RankQueue:
    """A priority queue over merge ranks below 2**18: heaps of positions per
    rank under a bitmap of three levels of 64."""

    def __init__(self) -> None:
        self.top = 0
        self.mid = [0] * 64
        self.low = [0] * 4096
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heapq.heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        a, b = rank >> 12, rank >> 6
        self.top |= 1 << a
        self.mid[a] |= 1 << (b & 63)
        self.low[b] |= 1 << (rank & 63)

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost position; top must not be 0."""
        a = (self.top & -self.top).bit_length() - 1
        m = self.mid[a]
        b = (a << 6) | ((m & -m).bit_length() - 1)
        w = self.low[b]
        rank = (b << 6) | ((w & -w).bit_length() - 1)
        bucket = self.buckets[rank]
        position = bucket.pop() if len(bucket) == 1 else heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[b] = w & (w - 1)
            if not self.low[b]:
                self.mid[a] = m & (m - 1)
                if not self.mid[a]:
                    self.top &= self.top - 1
        return rank, position


class Batch:
    """Merges many short pre-tokens on one linked list with one rank queue.

    Pre-tokens don't touch, so taking the queue's next rank for all of them at
    once, at the leftmost valid position of each, merges every pre-token in
    its own order."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = np.full(1 << 16, -1, np.int64)  # of two bytes
        keys, values = [], []
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    keys.append(left << 18 | right)
                    values.append(rank)
        order = np.argsort(np.array([*keys, 1 << 40], np.int64))
        self.keys = np.array([*keys, 1 << 40], np.int64)[order]
        self.values = np.array([*values, -1], np.int64)[order]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 18 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], -1)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many ids each has."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        n = len(raw)
        word = np.repeat(np.arange(len(words)), sizes)
        ids = self.single[raw]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        ends = np.cumsum(sizes)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        pair = np.full(n, -1, np.int64)
        pair[:-1] = self.pairs[raw[:-1] << 8 | raw[1:]]
        pair[ends - 1] = -1
        alive = np.ones(n, bool)
        top, mid, low, buckets = 0, [0] * 64, [0] * 4096, {}

        def push(positions: np.ndarray, ranks: np.ndarray) -> None:
            nonlocal top
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            begin = [0, *cuts.tolist()]
            for rank, a, b in zip(ranks[begin].tolist(), begin, [*begin[1:], len(ranks)], strict=True):
                if rank in buckets:
                    buckets[rank].append(positions[a:b])
                else:
                    buckets[rank] = [positions[a:b]]
                    top |= 1 << (rank >> 12)
                    mid[rank >> 12] |= 1 << (rank >> 6 & 63)
                    low[rank >> 6] |= 1 << (rank & 63)

        there = np.flatnonzero(pair >= 0)
        if len(there):
            push(there, pair[there])
        while top:
            a = (top & -top).bit_length() - 1
            b = a << 6 | ((mid[a] & -mid[a]).bit_length() - 1)
            rank = b << 6 | ((low[b] & -low[b]).bit_length() - 1)
            held = buckets.pop(rank)
            at = held[0] if len(held) == 1 else np.concatenate(held)
            at = at[pair[at] == rank]  # the rest is stale
            rest = at[:0]
            if len(at) > 1:
                if len(held) > 1:
                    at = np.unique(at)
                own = word[at]
                first = np.ones(len(at), bool)
                first[1:] = own[1:] != own[:-1]
                if not first.all():
                    at, rest = at[first], at[~first]
            if len(rest):
                buckets[rank] = [rest]
            else:
                low[b] &= low[b] - 1
                if not low[b]:
                    mid[a] &= mid[a] - 1
                    if not mid[a]:
                        top &= top - 1
            if not len(at):
                continue
            gone = after[at]
            ids[at] = rank
            alive[gone] = False
            pair[gone] = -1
            pair[at] = -1
            then = after[gone]
            after[at] = then
            some = then >= 0
            here, then = at[some], then[some]
            before[then] = here
            prior = before[at]
            some = prior >= 0
            prior = prior[some]
            left = np.concatenate([here, prior])
            if not len(left):
                continue
            new = self.rank(ids[left], ids[np.concatenate([then, at[some]])])
            pair[left] = new
            there = new >= 0
            if there.any():
                push(left[there], new[there])
        return ids[alive], np.bincount(word[alive], minlength=len(words))


class Codec:
    """Encodes and decodes by a rank table: bytes -> rank, the rank being the
    token's id.  The table must hold all single bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        if max(ranks.values()) >= 1 << 18:
            raise ValueError("ranks must be below 2**18")
        if pattern != PATTERN:
            raise ValueError("only PATTERN is implemented")
        self.ranks = ranks
        self.classes = character_classes()
        self.latin = self.classes[:256].tobytes()
        self.vocabulary: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        self.queue = RankQueue()
        self.batch = Batch(ranks)
        self.cache = _Packed(self)

    @classmethod
    def load(cls, data: bytes, pattern: str = PATTERN) -> Codec:
        """From the lines of a rank file: base64 of the token, its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}, pattern)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        get, queue = self.ranks.get, self.queue
        whole = get(word)
        if whole is not None:
            return [whole]
        n = len(word)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        push = queue.push
        pair = [get(word[i : i + 2], -1) for i in range(n)]  # rank of the pair that starts here; -1: none, or gone
        pair[-1] = -1
        for i, r in enumerate(pair):
            if r >= 0:
                push(r, i)
        pop = queue.pop
        while queue.top:
            rank, i = pop()
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            pair[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                r = pair[i] = get(word[i : after[k]], -1)
                if r >= 0:
                    push(r, i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                r = get(word[h:k], -1)
                if r != pair[h]:
                    pair[h] = r
                    if r >= 0:
                        push(r, h)
        out, i = [], 0
        ranks = self.ranks
        while i < n:
            j = after[i]
            out.append(ranks[word[i:j]])
            i = j
        return out

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        try:
            raw = text.encode("latin-1")
            points, kind = np.frombuffer(raw, np.uint8), np.frombuffer(raw.translate(self.latin), np.uint8)
        except UnicodeEncodeError:
            points = np.frombuffer(text.encode("utf-32-le"), "<u4")
            kind = self.classes[points]
        at = starts(points, kind).tolist()
        return [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)]

    def forget(self) -> None:
        """Empty the memory of pre-tokens."""
        self.cache = _Packed(self)

    def learn(self, words: set[str]) -> None:
        """Fill the memory with the ids of these pre-tokens, all at once."""
        new = [w for w in words if w not in self.cache and len(w) <= CACHE_CHARS]
        fresh: list[str] = []
        for w in new:
            out = self.cache.older.get(w)
            if out is None:
                fresh.append(w)
            else:
                self.cache.keep(w, out)
        if fresh:
            ids, counts = self.batch.merge([w.encode() for w in fresh])
            packed = ids.astype("<u4").tobytes()
            ends = (np.cumsum(counts) * 4).tolist()
            for w, a, b in zip(fresh, [0, *ends], ends, strict=False):
                self.cache.keep(w, packed[a:b])

    def encode_many(self, texts: list[str], batch_chars: int = BATCH_CHARS) -> Iterator[bytes]:
        """Packed ids of each text; pre-tokens are merged in batches of texts
        that have about so many characters."""
        group: list[list[str]] = []
        chars = 0
        for i, text in enumerate(texts):
            group.append(self.split(text))
            chars += len(text)
            if chars >= batch_chars or i == len(texts) - 1:
                self.learn(set().union(*group))
                for words in group:
                    yield b"".join(map(self.cache.__getitem__, words))
                group, chars = [], 0

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, self.split(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


class _Packed(dict):
    """Pre-token -> its packed ids; the older generation is behind it."""

    def __init__(self, codec: Codec) -> None:
        self.codec = codec
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            ids = self.codec.merge(word.encode())
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= CACHE_CHARS:
            self.keep(word, out)
        return out

    def keep(self, word: str, out: bytes) -> None:
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[word] = out


def worker_codec(data: bytes, pattern: str = PATTERN) -> Codec:
    """One codec for each worker process and rank file."""
    keep = sys.modules.setdefault("_tessera_kept", types.ModuleType("_tessera_kept")).__dict__
    key = ("bpe", hashlib.md5(data).hexdigest(), pattern)
    if key not in keep:
        keep[key] = Codec.load(data, pattern)
    return keep[key]


def encode(docs: DataFrame, rank_file: str, pattern: str = PATTERN, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and token_ids if asked
    for) of every whole text.  A null text counts as empty: no tokens, and
    the hashes of nothing.  A null doc_id stays null, repeated rows give
    repeated rows, other columns are ignored.

    rank_file is read once, by the driver; the table goes out with the tasks
    (under 1 MB for 50,000 ranks).  No shuffle.
    """
    with open(rank_file, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [("doc_id", docs.schema["doc_id"].dataType), ("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(("token_ids", T.ArrayType(T.IntegerType())))
    schema = T.StructType([T.StructField(*x) for x in fields])

    chars = BATCH_CHARS_WITH_IDS if with_ids else BATCH_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(shipped.value, pattern)
        for whole in batches:
            size = np.cumsum(pc.binary_length(whole.column("text")).to_numpy(zero_copy_only=False))
            cuts = [0, *(np.flatnonzero(np.diff(size // (2 * chars))) + 1).tolist(), whole.num_rows]  # by bytes, not by rows
            for start, end in zip(cuts, cuts[1:], strict=False):
                batch = whole.slice(start, end - start)
                n, ids_sha, decoded_sha, arrays = [], [], [], []
                for packed in codec.encode_many(batch.column("text").to_pylist(), chars):
                    ids = np.frombuffer(packed, "<u4")
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(packed).hexdigest())
                    decoded_sha.append(hashlib.sha256(codec.decode(ids.tolist())).hexdigest())
                    if with_ids:
                        arrays.append(ids.astype(np.int32))
                columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(n, dtype=np.int64)]).astype(np.int32)
                    flat = np.concatenate([*arrays, np.zeros(0, np.int32)])
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
        codec.forget()
        give_back()

    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, schema)
