"""User code as operators: scoring functions, reducers and loaders."""

from __future__ import annotations

import ctypes
import functools
import importlib.util
import multiprocessing
import os
import signal
import sys
import time
import warnings
from collections import deque
from collections.abc import Callable, Sequence
from multiprocessing import connection

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Loaders by name: (spark, path) -> DataFrame.
LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def loader(name: str):
    """Registers a loader under a name."""

    def add(f):
        LOADERS[name] = f
        return f

    return add


def load(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name not in LOADERS:
        raise KeyError(f"no loader is named {name}")
    return LOADERS[name](spark, path)


def from_file(path: str, name: str) -> Callable:
    """A function of a Python file; it travels to the executors by value."""
    from pyspark import cloudpickle

    spec = importlib.util.spec_from_file_location("tessera_user_code", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no {name}")
    sys.modules["tessera_user_code"] = module
    cloudpickle.register_pickle_by_value(module)
    return getattr(module, name)


class Calls:
    """Calls of one function in child processes, each with a deadline; a child that misses it is killed and another one starts.

    Children are forked, so the function need not be importable there, and die with their parent."""

    def __init__(self, call: Callable[..., object], workers: int, timeout: float | None) -> None:
        self.call, self.timeout = call, timeout
        self.fork = multiprocessing.get_context("fork")
        self.idle: list[tuple] = []
        self.workers = workers

    def _child(self, ours, theirs) -> None:
        ours.close()
        if sys.platform == "linux":
            ctypes.CDLL(None).prctl(1, signal.SIGKILL)  # PR_SET_PDEATHSIG
        while True:
            try:
                args = theirs.recv()
            except EOFError:
                os._exit(0)
            try:
                theirs.send((number(self.call(*args)), None))
            except BaseException as e:  # noqa: BLE001  user code may raise anything
                theirs.send((0.0, f"{type(e).__name__}: {e}"))

    def _start(self) -> tuple:
        ours, theirs = self.fork.Pipe()
        child = self.fork.Process(target=self._child, args=(ours, theirs), daemon=True)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", DeprecationWarning)  # of forking beside threads: the child runs user code only
            child.start()
        theirs.close()
        return child, ours

    @staticmethod
    def _kill(child, pipe) -> None:
        pipe.close()
        child.kill()
        child.join()

    def map(self, many: Sequence[tuple]) -> list[tuple[float, str | None]]:
        """(value, None) or (0, reason) of each call, in order."""
        out: list = [(0.0, None)] * len(many)
        waiting, busy = deque(range(len(many))), {}  # pipe -> child, call, deadline
        try:
            while waiting or busy:
                while waiting and len(busy) < self.workers:
                    child, pipe = self.idle.pop() if self.idle else self._start()
                    at = waiting.popleft()
                    try:
                        pipe.send(many[at])
                    except OSError:  # it died while it was idle
                        self._kill(child, pipe)
                        waiting.appendleft(at)
                        continue
                    busy[pipe] = child, at, time.monotonic() + (self.timeout if self.timeout is not None else float("inf"))
                soonest = min(d for _, _, d in busy.values())
                for pipe in connection.wait(list(busy), None if soonest == float("inf") else max(0.0, soonest - time.monotonic())):
                    child, at, _ = busy.pop(pipe)
                    try:
                        out[at] = pipe.recv()
                        self.idle.append((child, pipe))
                    except EOFError:
                        self._kill(child, pipe)
                        out[at] = (0.0, f"died: exit code {child.exitcode}")
                now = time.monotonic()
                for pipe in [p for p, (_, _, d) in busy.items() if d <= now]:
                    child, at, _ = busy.pop(pipe)
                    self._kill(child, pipe)
                    out[at] = (0.0, "timeout")
        finally:
            for pipe, (child, _, _) in busy.items():
                self._kill(child, pipe)
        return out

    def close(self) -> None:
        while self.idle:
            self._kill(*self.idle.pop())


def number(value) -> float:
    """A score: a number, or the first one of a list, of lists too."""
    while isinstance(value, (list, tuple)):
        value = value[0]
    return float(value)


def scored(df: DataFrame, score: Callable[..., object], columns: Sequence[str] = ("data_source", "solution", "ground_truth", "extra_info"), workers: int = 8, timeout: float | None = 60.0, **kwargs) -> DataFrame:
    """df with `score`: the function of the four columns, called in child processes, `workers` for each task.

    A call that fails, kills its process, or takes longer than `timeout` seconds gives 0 and its reason
    in `error`; its process is killed then, so a task ends whatever the function does.
    The function may return a list, whose first number counts."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("error", T.StringType())])

    def run(frames):
        calls = Calls(functools.partial(score, **kwargs), workers, timeout)
        try:
            for rows in frames:
                got = calls.map(list(rows[list(columns)].itertuples(index=False, name=None)))
                yield rows.assign(score=[v for v, _ in got], error=[e for _, e in got])
        finally:
            calls.close()

    return df.mapInPandas(run, schema)


def reduced(df: DataFrame, by: Sequence[str], value: str, reducers: dict[str, Callable[[np.ndarray], float]]) -> DataFrame:
    """Each group's values through the reducers; a group is a prompt's rollouts and fits a task."""
    from pyspark.sql import types as T

    schema = T.StructType([*(df.schema[c] for c in by), *(T.StructField(n, T.DoubleType()) for n in reducers)])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows[value].to_numpy(float)
        return pd.DataFrame([[*rows[list(by)].iloc[0], *(float(f(x)) for f in reducers.values())]], columns=[*by, *reducers])

    return df.groupBy(*by).applyInPandas(run, schema)
