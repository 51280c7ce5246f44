import os
import time

import numpy as np
import pytest

from tessera.functions import custom


def test_scoring_function_of_a_file(spark, tmp_path):
    (tmp_path / "mine.py").write_text("def score(source, solution, truth, extra, bonus=0):\n    if solution == 'bad':\n        raise ValueError('no')\n    return float(solution == truth) + bonus\n")
    rows = spark.createDataFrame([("s", "a", "a", None), ("s", "b", "a", None), ("s", "bad", "a", None)], "data_source string, solution string, ground_truth string, extra_info string")
    got = {r["solution"]: (r["score"], r["error"]) for r in custom.scored(rows, custom.from_file(str(tmp_path / "mine.py"), "score"), bonus=1).collect()}
    assert got == {"a": (2.0, None), "b": (1.0, None), "bad": (0.0, "ValueError: no")}
    with pytest.raises(AttributeError):
        custom.from_file(str(tmp_path / "mine.py"), "other")


SCHEMA = "data_source string, solution string, ground_truth string, extra_info string"


def test_calls_that_never_return(spark):
    """The task ends within the deadline and a second, and the calls after them still count."""

    def score(source, solution, truth, extra):
        while solution == "loop":
            pass
        if solution == "sleep":
            time.sleep(3600)
        if solution == "die":
            os._exit(3)
        return [[2.5, "x"]] if solution == "list" else float(len(solution))

    rows = spark.createDataFrame([("s", x, None, None) for x in ("loop", "sleep", "die", "abc", "list", "loop", "four", "")], SCHEMA).coalesce(1)
    custom.scored(rows.filter("solution = 'abc'"), score, timeout=5.0).count()  # the worker's start isn't a call's time
    start = time.monotonic()
    got = [(r["solution"], r["score"], r["error"]) for r in custom.scored(rows, score, workers=4, timeout=1.5).collect()]
    assert time.monotonic() - start < 1.5 + 1 + 2  # and what Spark takes for a job
    assert got == [("loop", 0.0, "timeout"), ("sleep", 0.0, "timeout"), ("die", 0.0, "died: exit code 3"), ("abc", 3.0, None), ("list", 2.5, None), ("loop", 0.0, "timeout"), ("four", 4.0, None), ("", 0.0, None)]


def test_deadlines_of_the_pool():
    calls = custom.Calls(lambda x: time.sleep(x) or x, 3, 0.5)
    start = time.monotonic()
    got = calls.map([(9.0,), (0.0,), (9.0,), (0.1,), (9.0,), (0.2,)])
    took = time.monotonic() - start
    assert got == [(0.0, "timeout"), (0.0, None), (0.0, "timeout"), (0.1, None), (0.0, "timeout"), (0.2, None)] and took < 1.5
    assert calls.map([(0.1,)] * 2) == [(0.1, None)] * 2 and calls.map([]) == []
    children = [c for c, _ in calls.idle]
    calls.close()
    assert children and not any(c.is_alive() for c in children)


def test_without_a_deadline():
    calls = custom.Calls(lambda x: 1 / x, 2, None)
    assert calls.map([(2,), (0,), (4,)]) == [(0.5, None), (0.0, "ZeroDivisionError: division by zero"), (0.25, None)]
    calls.close()


def test_reducers_and_loaders(spark):
    rows = spark.createDataFrame([("p", 1.0), ("p", 3.0), ("q", 2.0)], "prompt string, x double")
    got = {r["prompt"]: (r["best"], r["mean"]) for r in custom.reduced(rows, ["prompt"], "x", {"best": np.max, "mean": np.mean}).collect()}
    assert got == {"p": (3.0, 2.0), "q": (2.0, 2.0)}

    @custom.loader("numbers")
    def numbers(session, path):
        return session.range(int(path))

    assert custom.load(spark, "numbers", "3").count() == 3
    with pytest.raises(KeyError):
        custom.load(spark, "absent", "")
