"""The loader: each row once per epoch, in the permutation's order, whatever stops it."""

import hashlib

import pytest

from tessera.streaming import loader as L


def by_hand(n, epoch, seed):
    return sorted(range(n), key=lambda k: (hashlib.md5(f"{seed}|{epoch}|{k}".encode()).hexdigest(), k))


def run(spark, tmp_path, got, n=53, batch=10, steps=12, fail_at=None, **options):
    def sink(rows, step):
        if step == fail_at and step not in [s for s, _ in got]:
            got.append((step, None))
            raise RuntimeError("stopped in mid-epoch")
        got.append((step, [(r["epoch"], r["id"]) for r in rows.orderBy("position").collect()]))

    L.load(spark.range(n).repartition(3), ["id"], batch, steps, sink, str(tmp_path / "store"), str(tmp_path / "checkpoint"), seed=5, **options)


def test_runs_that_stop_go_on_where_they_were(spark, tmp_path):
    got = []
    for steps in (3, 3, 7, 12):  # the second one has nothing to do
        run(spark, tmp_path, got, steps=steps)
    assert [s for s, _ in got] == list(range(12))
    rows = [r for _, batch in got for r in batch]
    assert rows == [(e, k) for e in (0, 1) for k in by_hand(53, e, 5)[:50]] + [(2, k) for k in by_hand(53, 2, 5)[:20]]


def test_a_batch_that_failed_is_given_again(spark, tmp_path):
    got = []
    with pytest.raises(Exception, match="stopped in mid-epoch"):
        run(spark, tmp_path, got, fail_at=6)
    run(spark, tmp_path, got, fail_at=6)
    assert [s for s, _ in got] == [0, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10, 11] and got[6][1] is None
    assert [r for _, batch in got if batch for r in batch][:100] == [(e, k) for e in (0, 1) for k in by_hand(53, e, 5)[:50]]


def test_last_batches(spark, tmp_path):
    got = []
    run(spark, tmp_path, got, drop_last=False)
    assert [(s, len(b)) for s, b in got] == [(s, 3 if s % 6 == 5 else 10) for s in range(12)]
    assert sorted(k for _, b in got[:6] for _, k in b) == list(range(53))


def test_fewer_rows_than_a_batch(spark, tmp_path):
    got = []
    run(spark, tmp_path, got, n=4)
    assert got == []
    run(spark, tmp_path / "all", got, n=4, steps=2, drop_last=False)
    assert [len(b) for _, b in got] == [4, 4]
    run(spark, tmp_path / "none", got, n=0, drop_last=False)
    assert len(got) == 2


def test_reader_replays_what_it_gave():
    reader = L.PositionReader(25, 10, 100, False)
    at, given = reader.initialOffset(), []
    for _ in range(7):
        rows, at = reader.read(at)
        given += rows
    assert list(reader.readBetweenOffsets(reader.initialOffset(), at)) == given and given[2] == (0, 20, 25) and given[3] == (1, 0, 10)
    with pytest.raises(ValueError):
        L.PositionReader(5, 0, 1, True)
