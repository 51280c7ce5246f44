"""Against brute force and the SQL; the filters; the index with documents added and taken back."""

import duckdb
import numpy as np

from tests.llm.conftest import AWKWARD, sha
from tessera.llm import lines

DATA = "/root/testdata/sf0.001"


def key(line):
    k = line.strip(" \t\n\x0b\x0c\r")
    k = "".join(c.lower() if "A" <= c <= "Z" else c for c in k)
    return k if len(k) >= 10 else None


def brute(rows):
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if key(line) and doc is not None:
                held.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        all_ = (text or "").split("\n")
        kept = [x for x in all_ if doc is None or not key(x) or len(held[key(x)]) < 2 or min(held[key(x)]) == doc]
        out.append((doc, len(all_), len(all_) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=repr)


def test_awkward(awkward, nothing):
    assert sorted(map(tuple, lines.dedup(awkward).collect()), key=repr) == brute([r[:2] for r in AWKWARD])
    assert lines.dedup(nothing).count() == 0
    out = lines.without_repeats(awkward)
    assert out.columns == awkward.columns and out.count() == 12
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[2]["text"] == "hello" and got[2]["n_chars"] == 5 and got[4]["text"] is None


def test_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = sorted(map(tuple, lines.dedup(docs).collect()))
    assert got == sorted(brute([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert got == sorted(duckdb.sql(lines.SQL.replace("FROM documents", f"FROM '{DATA}/documents.parquet'")).fetchall())


def test_many_shards_and_parts(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = sorted(map(tuple, lines.dedup(docs).collect()))
    monkeypatch.setattr(lines, "SHARD_KEYS", 5)
    monkeypatch.setattr(lines, "PART_REFERENCES", 20)
    monkeypatch.setattr(lines, "BROADCAST_SHARDS", 1)
    assert sorted(map(tuple, lines.dedup(docs).collect())) == first


def test_the_filters_spare_unique_references(spark):
    """What they let through holds every repeated key's references and hardly any others."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    refs = lines.references(docs).drop("lines")
    repeated = lines.counted(refs).filter("least <> most")
    maybe = lines.suspected(refs, lines.filters(repeated, 3), 3)
    true = refs.join(repeated, ["hi", "lo"], "left_semi").count()
    assert maybe.join(repeated, ["hi", "lo"], "left_semi").count() == true > 0
    assert true <= maybe.count() <= true + 0.01 * refs.count()


def test_cuckoo():
    noise = np.random.default_rng(0)
    hi, lo = noise.integers(-(2**62), 2**62, (2, 5000))
    got = lines.Cuckoo.of(hi, lo)
    assert got.holds(hi, lo).all()
    other = noise.integers(-(2**62), 2**62, (2, 20000))
    assert got.holds(*other).mean() < 0.001
    got.delete(hi[:2500], lo[:2500])
    assert got.holds(hi[2500:], lo[2500:]).all() and got.holds(hi[:2500], lo[:2500]).mean() < 0.01
    twice = lines.Cuckoo.of(np.tile(hi[:40], 3), np.tile(lo[:40], 3))  # equal keys: one slot each, taken back one by one
    for left in (2, 1, 0):
        twice.delete(hi[:40], lo[:40])
        assert (twice.table > 0).sum() == 40 * left and twice.holds(hi[:40], lo[:40]).all() == (left > 0)
    back = lines.Cuckoo.from_bytes(got.to_bytes())
    assert (back.holds(hi, lo) == got.holds(hi, lo)).all()


def test_index_is_reversible(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = lines.LineIndex(spark, str(tmp_path), shards=2)
    index.insert(make([(1, "the first long line\nanother long line"), (2, "the first long line")]))
    index.refresh()
    losing = lambda: sorted(r["doc_id"] for r in index.losing().collect())
    assert losing() == [2]
    index.insert(make([(3, "another long line\nthe first long line")]))
    index.refresh()
    assert losing() == [2, 3, 3]
    index.delete(make([(1, "")]))  # now document 2 is the first with the line, and 3 alone has the other
    index.refresh()
    assert losing() == [3]
    index.delete(make([(2, "")]))
    index.refresh()
    assert losing() == [] and index.repeated().count() == 0
    index.insert(make([(2, "another long line")]))
    index.refresh()
    assert losing() == [3]


def test_index_opened_again(spark, tmp_path):
    """Every call on a new object, with an interrupted insert and refresh in between."""
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = lambda: lines.LineIndex(spark, str(tmp_path), shards=3)
    losing = lambda: sorted(r["doc_id"] for r in index().losing().collect())
    index().insert(make([(1, "the first long line\nanother long line"), (2, "the first long line")]))
    index().refresh()
    assert losing() == [2] and lines.LineIndex(spark, str(tmp_path), shards=9).shards == 3
    for left in ("references/batch=2", "repeated/2"):
        (tmp_path / left / "_temporary").mkdir(parents=True)
    index().insert(make([(3, "another long line\nthe first long line")]))
    index().delete(make([(1, "")]))
    index().refresh()
    assert losing() == [3]
    index().delete(make([(2, "")]))
    index().refresh()
    assert losing() == [] and index().repeated().count() == 0
