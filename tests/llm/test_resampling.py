"""Against the SQL and plain counting in Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import resampling as R


def grams(text, longest):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return len(own), [zlib.crc32(" ".join(own[i : i + k]).encode()) for k in range(1, longest + 1) for i in range(len(own) - k + 1)]


def by_hand(docs, target, longest=1, buckets=10_000, percent=10, least=20):
    """docs: (doc_id, text)."""
    split = [(i, *grams(t, longest)) for i, t in docs]
    s, t = Counter(h % buckets for _, _, f in split for h in f), Counter(h % buckets for x in target for h in grams(x, longest)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    out = []
    for i, n, f in split:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(x % buckets) for x in f)
        out.append([n, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[0] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = k + 1
    return sorted((tuple(r[1:]) for r in out), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_table_and_sql(spark, sf):
    docs, target = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = got(R.resample(docs, target))
    for t in ("documents", "benchmark"):
        sql = (sql if t == "benchmark" else R.SQL).replace(f"FROM {t}", f"FROM '/root/testdata/{sf}/{t}.parquet'")
    assert rows == sorted(map(tuple, duckdb.sql(sql).fetchall()), key=repr)
    assert rows == by_hand([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()])
    assert sum(r[4] is not None for r in rows) > 10


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_awkward(spark, awkward, nothing, longest):
    docs = awkward.select("*", F.lit(1).alias("words"), F.lit(0).alias("features"), F.lit(0).alias("weight"))
    target = spark.createDataFrame([("shared line of text",), (None,), ("",), ("Word word",)], "text string")
    kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for some in (target, target.limit(0)):
        rows = got(R.resample(docs, some, longest=longest, percent=60, least_words=2))
        assert rows == by_hand(kept, [r["text"] for r in some.collect()], longest, percent=60, least=2)
    assert got(R.resample(nothing, target, longest=longest)) == []


def test_suffix_array():
    noise = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 60, 300):
        for kinds in (1, 2, 5, 1000):
            ids = noise.integers(0, kinds, n)
            assert R.suffix_array(ids).tolist() == sorted(range(n), key=lambda i, ids=ids: ids[i:].tolist())


@pytest.mark.parametrize("most", [3, 10, 1 << 19])
def test_runs_and_pieces(most):
    noise = np.random.default_rng(3)
    texts = [" ".join(noise.choice(["a", "b", "Cc", "é", "x-y"], int(n))) for n in noise.integers(0, 40, 30)] + ["", "a b " * 50]
    for longest in (1, 2, 4):
        counts, found = R.buckets_of([t.encode() for t in texts], longest, 97, most)
        for text, n, own in zip(texts, counts, found, strict=True):
            words, hashes = grams(text, longest)
            assert n == words and sorted(own.tolist()) == sorted(h % 97 for h in hashes)


def test_each_ngram_is_hashed_once(monkeypatch):
    calls = []
    monkeypatch.setattr(R.zlib, "crc32", lambda b, f=zlib.crc32: calls.append(b) or f(b))
    R.buckets_of([b"a b a b a b", b"b a b", b"c"], 2, 97)
    assert sorted(calls) == [b"a", b"a b", b"b", b"b a", b"c"]


def test_a_large_repeated_batch_is_sorted_quickly():
    import time

    text = " ".join(f"w{i % 700}" for i in range(20_000))
    start = time.process_time()
    R.buckets_of([text.encode()] * 20)
    assert time.process_time() - start < 20
