"""Against water-filling by hand and the SQL."""

import re

import duckdb
import pytest

from tests.llm.conftest import AWKWARD
from tessera.llm import mixing

DATA = "/root/testdata/sf0.001"


def by_hand(sizes):
    """Targets by repeated clamping and resharing."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    clamped, total = {}, sum(sizes.values())
    while True:
        free = {s: w for s, w in weight.items() if s not in clamped}
        level = (total - sum(clamped.values())) / sum(free.values()) if free else 0
        over = [s for s in free if free[s] * level >= 3 * sizes[s]]
        if not over:
            return clamped | {s: free[s] * level for s in free}
        clamped |= {s: 3 * sizes[s] for s in over}


def check(rows):
    sizes = {}
    for r in rows:
        sizes[r["source"]] = r["source_size"]
        assert r["taken"] <= 3 * r["size"]
    goal = by_hand(sizes)
    for s in sizes:
        own = [r for r in rows if r["source"] == s]
        assert own[0]["target"] == pytest.approx(goal[s])
        assert abs(sum(r["taken"] for r in own) - goal[s]) <= max(r["size"] for r in own) / 2 + 1e-6


def test_table_and_sql(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    check(rows)
    expected = duckdb.sql(mixing.SQL.replace("FROM documents", f"FROM '{DATA}/documents.parquet'")).fetchall()
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"], r["copies"]) for r in rows) == sorted(expected)


def test_broadcast_or_not(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == first


def test_awkward(awkward, nothing):
    got = mixing.mix(awkward).collect()
    assert len(got) == 12
    sizes = {}
    for _, text, _, source, _ in AWKWARD:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    assert {r["source_size"] for r in got} == set(sizes.values()) and max(r["copies"] for r in got) <= mixing.EPOCHS
    assert {round(r["target"], 6) for r in got} == {round(x, 6) for x in by_hand(sizes).values()}
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_rows(nothing).count() == 0
    copies = sum(r["copies"] for r in got)
    rows = mixing.mixed_rows(awkward)
    assert rows.columns == awkward.columns and rows.count() == copies


def by_sql(spark, docs, tmp_path):
    docs.coalesce(1).write.parquet(str(tmp_path))
    return sorted(duckdb.sql(mixing.SQL.replace("FROM documents", f"FROM '{tmp_path}/*.parquet'")).fetchall(), key=repr)


def as_tuples(got):
    return sorted(((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"], r["copies"]) for r in got), key=repr)


def test_awkward_and_sql(spark, awkward, tmp_path):
    assert as_tuples(mixing.mix(awkward).collect()) == by_sql(spark, awkward, tmp_path / "d")


@pytest.mark.parametrize("ids", ["none", "one", "repeated rows"])
def test_targets_without_distinct_ids(spark, tmp_path, ids):
    """Sources whose rows have no doc_id, one doc_id, or are the same row again and again still come near their targets."""
    name = {"none": lambda i: None, "one": lambda i: 7, "repeated rows": lambda i: i % 2}[ids]
    text = lambda i: "same words every time" if ids == "repeated rows" else " ".join(["w%d" % i] * (10 + i % 3))
    rows = [(name(i), text(i), s) for s, many in (("a", 100), ("b", 40), ("c", 300), (None, 15)) for i in range(many)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mixing.mix(docs).collect()
    sizes, taken, most = {}, {}, {}
    for r in got:  # sources have different sizes here
        sizes[r["source_size"]] = r["target"]
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
        most[r["source_size"]] = max(r["size"], most.get(r["source_size"], 0))
        assert r["taken"] <= 3 * r["size"]
    assert len(sizes) == 4 and all(abs(taken[s] - sizes[s]) <= most[s] / 2 + 1e-6 for s in sizes)
    assert as_tuples(got) == by_sql(spark, docs, tmp_path / "d") == as_tuples(mixing.mix(docs.repartition(3)).collect())
    assert mixing.mixed_rows(docs).count() == sum(r["copies"] for r in got)


def test_no_words_at_all(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert {r["target"] for r in mixing.mix(docs).collect()} == {0.0}
