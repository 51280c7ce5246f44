"""Against the same rule in plain Python."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import AWKWARD, sha
from tessera.llm import syncmers as S


def xx(seed, *values):
    """Spark's xxhash64 of texts and longs, from a seed."""
    for v in values:
        data = v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed - (1 << 64) if seed >> 63 else seed


def h(*values):
    out = 42
    for v in values:
        out = xx(out % (1 << 64), v)
    return out


def anchors(text, k=S.K, s=S.S):
    """(position, 32-bit hash) of every anchor, by the definition."""
    if len(text) < k:
        return [(0, h(text) % (1 << 32))] if text else []
    runs, width = [h(c) for c in text], 1
    while width < s:
        runs = [h(a, b) for a, b in zip(runs, runs[width:], strict=False)]
        width *= 2
    out = []
    for i in range(len(text) - k + 1):
        inner = runs[i : i + k - s + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append((i, h(*(inner[j] for j in [*range(0, k - s, s), k - s])) % (1 << 32)))
    return out


def written(found):
    gaps = [p - q for (p, _), (q, _) in zip(found, [(0, 0), *found], strict=False)]
    return "".join(f"{x:08x}{g:02x}" for (_, x), g in zip(found, gaps, strict=True))


def alike(a, b):
    def places(found):
        after = [(y, q - p) for (p, _), (q, y) in zip(found, found[1:], strict=False)]
        return {(x, *z) for (_, x), z in zip(found, [*after, ()], strict=False)}

    x, y = places(a), places(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0


def model(rows):
    """All columns of every row, by brute force."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), h(r[1] or "")))
    out = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, following = anchors(text), anchors(edited), anchors(after)
        out.append((doc, len(text), sha(edited), written(own), written(other), alike(own, other), alike(own, following)))
    return sorted(out, key=repr)


def mixed_texts(noise):
    """Words, unspaced scripts, one letter again and again, all lengths around k."""
    letters = ["abcdefgh ijkl", "漢字かな😀é", "01", "x", "the quick\n\tbrown fox "]
    return ["".join(noise.choice(some) for _ in range(n)) for some in letters for n in (0, 1, S.K - 1, S.K, S.K + 1, 2 * S.K, 150, 900)]


@pytest.mark.parametrize("piece", [S.PIECE, 7, 64])
def test_anchors_against_the_definition(spark, monkeypatch, piece):
    monkeypatch.setattr(S, "PIECE", piece)
    texts = mixed_texts(random.Random(5))
    got = [r["m"] for r in spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", S.anchors(F.col("t")).alias("m")).orderBy("i").collect()]
    assert [[(m >> 32, m % (1 << 32)) for m in row] for row in got] == [anchors(t) for t in texts]
    for text, found in zip(texts, got, strict=True):  # every K - S + 1 k-mers in a row have an anchor
        places = [-1, *(m >> 32 for m in found), len(text) - S.K + 1]
        assert len(text) < S.K or all(q - p <= S.K - S.S + 1 for p, q in zip(places, places[1:], strict=False))


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_every_column_against_brute_force(spark, awkward, bucket):
    texts = mixed_texts(random.Random(9))
    rows = list(enumerate(texts)) + [(3, t) for t in texts[10:20]] + [(4, texts[13])] * 5 + [(None, texts[7])] * 3 + [(None, texts[6]), (2, None), (2, "")]
    for some in (rows, [r[:2] for r in AWKWARD]):
        got = S.fingerprints(spark.createDataFrame(some, "doc_id long, text string").repartition(5), bucket_rows=bucket).collect()
        assert sorted(map(tuple, got), key=repr) == model(some)


def test_unspaced_text_stays_half_alike(spark):
    noise = random.Random(6)
    rows = [(i, "".join(noise.choice("abcdefgh漢字かな") for _ in range(10_000))) for i in (1, 2)]
    r = S.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 2").first()
    assert 0.4 < r["near_edited"] < 0.6 and r["near_next"] == 0


def test_anchors_need_no_context(spark):
    noise = random.Random(8)
    for core in (" ".join(f"c{i}" for i in range(200)), "".join(noise.choice("漢字かなカナ仮名") for _ in range(900))):
        rows = spark.createDataFrame([(core,), ("before " + core,), ("先" + core,), (core + " after",)], "t string").select(S.anchors(F.col("t")).alias("m")).collect()
        first, *others = [[m % (1 << 32) for m in r["m"]] for r in rows]
        assert all(set(first) <= set(x) for x in others)


def test_equal_texts(spark, awkward, nothing):
    got = S.fingerprints(awkward).collect()
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (5, 11)}) == 1
    assert S.fingerprints(nothing).count() == 0
    single = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    assert S.fingerprints(single).first()["near_next"] == 1.0


def test_likeness(spark):
    text = " ".join(f"w{i * 7919 % 1000}" for i in range(600))
    rows = spark.createDataFrame([(2, text), (1, " ".join(f"z{i}" for i in range(600)))], "doc_id long, text string")
    r = S.fingerprints(rows).filter("doc_id = 2").first()
    assert 0.4 < r["near_edited"] < 0.6 and r["near_next"] == 0


def test_native(awkward):
    plan = S.fingerprints(awkward)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_thousands_of_repeated_rows(spark, monkeypatch):
    """One result for all rows that are alike but the last; written in parts, also without doc_id."""
    import hashlib

    monkeypatch.setattr(S, "TOGETHER", 700)
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(8_000))
    rows = spark.range(6_001).select(F.when(F.col("id") < 4_000, 5).when(F.col("id") < 6_000, F.lit(None)).otherwise(1).cast("long").alias("doc_id"), F.when(F.col("id") < 6_000, text).otherwise("the last of those with an id").alias("text"))
    got = S.fingerprints(rows).groupBy("doc_id", "n_chars", "edited_sha256", "near_edited", "near_next", F.md5("fingerprint").alias("f"), F.md5("edited_fingerprint").alias("e")).count().collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    half, other = text[:4_000], "the last of those with an id"
    same, after = sha(half + half), {5: sha(half + other), None: sha(half + half), 1: sha(other[:14] + text[:14])}
    counts = {}
    for r in got:
        counts[r["doc_id"], r["edited_sha256"]] = counts.get((r["doc_id"], r["edited_sha256"]), 0) + r["count"]
    assert counts == {(5, same): 3_999, (5, after[5]): 1, (None, same): 2_000, (1, after[1]): 1}
    assert len({r["f"] for r in got if r["n_chars"] == 8_000}) == 1
