"""Stage by stage, each result written and read again as a cluster would, against brute force on the stage's own input."""

from collections import Counter

import pytest
import tiktoken
from public_tokenizers import PATTERN, path
from pyspark.sql import functions as F
from tiktoken.load import load_tiktoken_bpe

import corpus_pipeline
from tests.llm.conftest import AWKWARD, sha
from tests.llm.test_lines import key
from tests.llm.test_minhash import brute as brute_groups
from tests.llm.test_mixing import by_hand
from tessera.llm import quality

DATA = "/root/testdata/sf0.001"


def kept_texts(rows):
    """(doc_id, text) after the loss of lines that a smaller doc_id has."""
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if key(line) and doc is not None:
                held.setdefault(key(line), set()).add(doc)
    gone = lambda doc, line: doc is not None and key(line) and len(held[key(line)]) > 1 and min(held[key(line)]) != doc
    return [(doc, None if text is None else "\n".join(x for x in text.split("\n") if not gone(doc, x))) for doc, text in rows]


def pairs(rows):
    return [(r["doc_id"], r["text"]) for r in rows]


def check(spark, docs, folder, labels_dir):
    """Runs the stages from docs and compares each with brute force; the tables."""
    columns, seen = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], labels_dir).write.parquet(str(folder / str(k)))
        seen.append(spark.read.parquet(str(folder / str(k))))
        assert k == len(corpus_pipeline.STAGES) - 1 or seen[-1].columns == columns
    first, good, unrepeated, unlike, mixed, tokens = [df.collect() for df in seen]
    labels = spark.read.parquet(f"{labels_dir}/labels.parquet")
    accepted = {(r["doc_id"]) for r in quality.classify(docs, labels).filter("predicted = 1").collect()}
    assert Counter(map(repr, good)) == Counter(repr(r) for r in first if r["doc_id"] in accepted)
    after = [(doc, text, r["n_chars"] if text == r["text"] else len(text)) for r, (doc, text) in zip(good, kept_texts(pairs(good)), strict=True)]
    assert Counter((r["doc_id"], r["text"], r["n_chars"]) for r in unrepeated) == Counter(after)
    heads = {c for _, _, c in brute_groups(pairs(unrepeated), 80)}
    assert Counter(map(repr, unlike)) == Counter(repr(r) for r in unrepeated if r["doc_id"] is None or r["doc_id"] in heads)
    size = lambda r: len((r["text"] or "").encode().split())
    sizes, taken, most = Counter(), Counter(), Counter()
    for r in unlike:
        sizes[r["source"]] += size(r)
        most[r["source"]] = max(most[r["source"]], size(r))
    for r in mixed:
        taken[r["source"]] += size(r)
    assert all(abs(taken[s] - t) <= most[s] / 2 + 1e-6 for s, t in by_hand(sizes).items())
    assert set(map(repr, mixed)) <= set(map(repr, unlike)) and all(n <= 3 * Counter(map(repr, unlike))[r] for r, n in Counter(map(repr, mixed)).items())
    codec = tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=load_tiktoken_bpe(path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    expected = Counter((r["doc_id"], tuple(codec.encode_ordinary(r["text"] or "")), sha(r["text"] or "")) for r in mixed)
    assert Counter((r["doc_id"], tuple(r["token_ids"]), r["decoded_sha256"]) for r in tokens) == expected
    return seen


def test_stages(spark, tmp_path):
    assert check(spark, spark.read.parquet(f"{DATA}/documents.parquet"), tmp_path, DATA)[-1].count() > 100


@pytest.fixture
def lenient(monkeypatch):
    """All documents are good enough, so that the awkward ones reach every stage."""
    monkeypatch.setattr(quality, "THRESHOLD", 0.0)


def test_awkward_rows(spark, awkward, tmp_path, lenient):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names, a hot row."""
    hot = spark.createDataFrame([AWKWARD[0]] * 9, awkward.select("doc_id", "text", "lang", "source", "n_chars").schema)
    docs = awkward.unionByName(hot.select("*", F.lit(1).alias("score"), F.lit("x").alias("id"), F.lit(2).alias("label"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("set")))
    assert check(spark, docs, tmp_path, DATA)[1].count() == 21


def test_empty_tables(spark, nothing, tmp_path, lenient):
    (tmp_path / "t").mkdir()
    spark.read.parquet(f"{DATA}/labels.parquet").limit(0).write.parquet(str(tmp_path / "t" / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, DATA).count() == 0
        assert stage(spark, nothing, str(tmp_path / "t")).count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 100
