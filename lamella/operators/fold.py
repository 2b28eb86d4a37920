"""Ordered folds.

Prefer ``View.aggregate``: Spark's aggregates combine on both sides of a shuffle.
These serve functions that are associative but not commutative, or neither.
"""

from __future__ import annotations

import pickle
from functools import partial
from functools import reduce as left_fold

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

_INDEX, _FILE, _PART = "_index", "_file", "_part"
#: A state up to this size is handed from task to task.
STATE_BYTES = 1 << 20


def reduce(frame: DataFrame, plain, f, *init):
    """Sequential left fold over the rows in file order.

    The parts of the sorted rows are folded in tasks, one part after the other; what
    passes through the driver is the state.  A state of more than ``STATE_BYTES``, such as a
    list of the rows, would pass once a part: from there on the rows are streamed instead.
    """
    rows = frame.orderBy(_FILE, _INDEX).drop(_FILE, _INDEX, _PART).rdd
    code, state = cloudpickle.dumps((plain, f)), [cloudpickle.dumps(x) for x in init]
    for part in range(rows.getNumPartitions()):
        if state and len(state[0]) > STATE_BYTES:
            return _streamed(rows, part, plain, f, pickle.loads(state[0]))
        state = rows.context.runJob(rows, partial(_reduced, code=code, state=state), [part])
    return pickle.loads(state[0]) if state else f()


def _reduced(rows, code: bytes, state: list[bytes]) -> list[bytes]:
    """The state after the rows of a part; none where there was neither a state nor a row."""
    plain, f = cloudpickle.loads(code)
    rows, state = map(plain, rows), [pickle.loads(s) for s in state]
    state = state or [r for _, r in zip(range(1), rows)]
    return [cloudpickle.dumps(left_fold(f, rows, s)) for s in state]


def _streamed(rows, part: int, plain, f, state):
    for at in range(part, rows.getNumPartitions()):
        state = left_fold(f, map(plain, rows.context.runJob(rows, iter, [at])), state)
    return state


def _runs(frames, code: bytes, record: bool):
    """Partial folds of the runs of a partition that rise within a part file, with their first and last positions."""
    combine, reducer = cloudpickle.loads(code)
    state = last = None
    for pdf in frames:
        names = [c for c in pdf.columns if c not in (_INDEX, _FILE, _PART)]
        for file, index, part, *values in pdf[[_FILE, _INDEX, _PART, *names]].itertuples(index=False, name=None):
            if last is None or file != last[0] or index < last[1] or part != last[2]:
                if state is not None:
                    yield _run(state)
                state = [file, index, combine(), index]
            row = dict(zip(names, values)) if record else values[0]
            state[2:] = reducer(state[2], row), index
            last = (file, index, part)
    if state is not None:
        yield _run(state)


def _run(state: list) -> pd.DataFrame:
    file, start, value, stop = state
    return pd.DataFrame([(file, start, stop, pickle.dumps(value))], columns=["file", "start", "stop", "state"])


def fold(frame: DataFrame, record: bool, combine, reducer):
    """Partial folds in the tasks, one state per contiguous run of rows to the driver,
    combined in the order of positions from ``combine()``.  Runs that interleave, which no
    scan of files makes, have no order to be combined in: they are an error."""
    code = cloudpickle.dumps((combine, reducer))
    parts = frame.mapInPandas(partial(_runs, code=code, record=record), "file int, start long, stop long, state binary")
    found = sorted(((r["file"], r["start"], r["stop"], bytes(r["state"])) for r in parts.collect()), key=lambda r: r[:3])
    if any(a[0] == b[0] and b[1] <= a[2] and a[2] > a[1] and b[1] != a[1] for a, b in zip(found, found[1:])):
        raise ValueError("rows were shuffled since they were read: they have no order to be folded in")
    return left_fold(combine, (pickle.loads(s) for *_, s in found), combine())


__all__ = ["fold", "reduce"]
