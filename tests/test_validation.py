"""Validation metrics against plain loops with numpy's own generator, and exact draws."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ordering as O
from tessera.operators import validation as V

SCHEMA = "source string, prompt long, i long, score double, acc double, pred string"


def resampled(data, size, reduce, rounds, seed):
    np.random.seed(seed)
    got = [reduce([data[i] for i in np.random.choice(len(data), size=size, replace=True)]) for _ in range(rounds)]
    return np.mean(got), np.std(got)


def majority(pairs):
    votes = defaultdict(list)
    for vote, value in pairs:
        votes[vote].append(value)
    return votes[max(votes, key=lambda k: len(votes[k]))][0]


def by_hand(rows, rounds, seed):
    prompts = defaultdict(list)
    for r in sorted(rows, key=lambda r: r[2]):
        prompts[r[0], r[1]].append(r)
    found = defaultdict(list)
    for (source, _), own in prompts.items():
        n, sizes, k = len(own), [], 2
        while k < len(own):
            sizes.append(k)
            k *= 2
        for name, at in (("score", 3), ("acc", 4)):
            x = [r[at] for r in own]
            found[source, name, f"mean@{n}"].append(np.mean(x))
            found[source, name, f"std@{n}"].append(np.std(x))
            for size in [*sizes, n]:
                for kind, data, f in (("best", x, max), ("worst", x, min), ("maj", [(r[5], r[at]) for r in own], majority)):
                    mean, std = resampled(data, size, f, rounds, seed)
                    found[source, name, f"{kind}@{size}/mean"].append(mean)
                    found[source, name, f"{kind}@{size}/std"].append(std)
    return {k: (np.mean(v), len(v)) for k, v in found.items()}


def test_whole_report(spark):
    noise = np.random.default_rng(9)
    rows = []
    for prompt in range(14):
        n = [1, 2, 3, 5, 8][prompt % 5]
        rows += [("ab"[prompt % 2] if prompt != 13 else None, prompt, i, float(np.round(noise.normal(), 3)), float(noise.integers(2)), None if noise.random() < 0.2 else "xyz"[noise.integers(3)]) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r["source"], r["variable"], r["metric"]): (r["value"], r["prompts"]) for r in V.validation_metrics(df, "source", ["prompt"], "i", ["score", "acc"], "pred", rounds=60, seed=42).collect()}
    expected = by_hand(rows, 60, 42)
    assert set(got) == set(expected)
    for k, v in expected.items():
        assert got[k] == pytest.approx(v), k
    plain = V.validation_metrics(df, "source", ["prompt"], "i", ["score"], rounds=60)
    assert not plain.filter("metric LIKE 'maj%'").count() and plain.count() == sum(1 for k in expected if k[1] == "score" and not k[2].startswith("maj"))
    assert V.validation_metrics(df.limit(0), "source", ["prompt"], "i", ["score"], "pred").count() == 0


def test_sets_and_kinds_are_looked_at_once(monkeypatch):
    """Of 5,000 prompts with 7 responses, draws are compared by kind of votes, and give what every round alone does."""
    noise = np.random.default_rng(4)
    values, votes = noise.integers(0, 9, (5000, 7)).astype(float), noise.integers(0, 2, (5000, 7))
    seen, plain = [], V.voted
    monkeypatch.setattr(V, "voted", lambda kinds, picks: seen.append(len(kinds)) or plain(kinds, picks))
    codes = V.vote_codes(votes)
    got = V.prompt_metrics(values, codes, 200, 42)
    assert sum(seen) <= 3 * 64  # 64 ways to split 7 votes in two, for N = 2, 4, 7
    for size in (2, 4, 7):
        picks = V.draws(7, size, 200, 42)
        chosen = np.take_along_axis(values, plain(votes, picks), 1)
        for kind, x in (("best", values[:, picks].max(2)), ("worst", values[:, picks].min(2)), ("maj", chosen)):
            assert got[f"{kind}@{size}/mean"] == pytest.approx(x.mean(1)) and got[f"{kind}@{size}/std"] == pytest.approx(x.std(1), abs=1e-9)


def test_many_prompts_in_parts(spark, monkeypatch):
    rows = [("s", p, i, float((p * 7 + i * 3) % 11), 0.0, str((p + i) % 3)) for p in range(50) for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    run = lambda: {(r["variable"], r["metric"]): r["value"] for r in V.validation_metrics(df, "source", ["prompt"], "i", ["score"], "pred", rounds=100).collect()}
    whole = run()
    monkeypatch.setattr(V, "HELD", 1)
    parts = run()
    assert parts.keys() == whole.keys() and all(parts[k] == pytest.approx(whole[k]) for k in whole)


def test_ladder(spark):
    assert [V.ladder(n) for n in (1, 2, 3, 4, 9)] == [[1], [2], [2, 3], [2, 4], [2, 4, 8, 9]]
    got = spark.range(1, 10).select(V.ladder_column(F.col("id")).alias("x")).collect()
    assert [r["x"] for r in got] == [V.ladder(n) for n in range(1, 10)]


def test_expectation_is_what_resampling_estimates(spark):
    rows = [("s", 0, i, float(x), 0.0, "x") for i, x in enumerate([3, 1, 4, 1, 5])]
    df = spark.createDataFrame(rows, SCHEMA)
    drawn = {r["metric"]: r["value"] for r in V.validation_metrics(df, "source", ["prompt"], "i", ["score"], rounds=20_000).collect()}
    for r in V.expected_metrics(df, "source", ["prompt"], "score").collect():
        assert r["best"] == pytest.approx(drawn[f"best@{r['size']}/mean"], abs=0.05) and r["worst"] == pytest.approx(drawn[f"worst@{r['size']}/mean"], abs=0.05)


def test_exact_draws(spark):
    rows = spark.range(5000).withColumn("x", F.col("id") * 2)
    for k in (1, 37, 9000):
        first = sorted((r["draw"], r["id"]) for r in O.drawn(rows, [F.col("id")], k, seed=4).collect())
        assert [d for d, _ in first] == list(range(k)) and all(0 <= i < 5000 for _, i in first)
        again = sorted((r["draw"], r["id"]) for r in O.drawn(rows.repartition(7), [F.col("id")], k, seed=4, range_rows=400).collect())
        assert again == first
    assert len({i for _, i in first}) < 5000 and O.drawn(rows, [F.col("id")], 0).count() == 0 and O.drawn(rows.limit(0), [F.col("id")], 5).count() == 0


def test_shown_rows(spark):
    few = O.shown(spark.range(5), [-F.col("id")], 20).orderBy("draw").collect()
    assert [r["id"] for r in few] == [4, 3, 2, 1, 0]
    assert O.shown(spark.range(21), [F.col("id")], 20).count() == 20


def test_row_of_samples(spark):
    rows = spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "i long, x string")
    out = V.validation_row(rows, 7, [F.col("i")], ["i", "x"], 4)
    assert out.columns == ["step", *(f"{c}_{k}" for k in range(1, 5) for c in "ix")] and tuple(out.first()) == (7, 1, "a", 2, None, 3, "c", None, None)
