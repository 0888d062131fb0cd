"""K1 (b): per-cell rules written in Python, as states that tasks build and merge, so that no cell is gathered.

A rule is four functions, which Spark's Column form can't always state: an empty state, a state with more rows (a pandas
frame of one cell) added, two states as one, and the verdict of a state. Each task keeps one state per cell it meets and
hands them on (at ``MAX_STATES`` cells, early: they merge later); states are shuffled by cell, and one after the other is
merged. A hot cell costs one state per task, whatever its rows. A rule must give the same verdict however rows are split
and ordered, and its states must stay small; that is the rule's own duty, as with any aggregate.

Rows with a NULL cell form a cell of their own. A table without rows gives no verdicts.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

CELL = "cell_id"
MAX_STATES = 10_000


@dataclass(frozen=True)
class CellRule:
    """``start()``, ``update(state, frame)``, ``merge(a, b)`` and ``finish(state)`` -> (valid, details)."""

    name: str
    columns: Sequence[str]
    start: Callable[[], Any]
    update: Callable[[Any, pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], tuple[bool, str]]


def _partial(rule: CellRule, key: str):
    """Arrow function (key, columns): a state per cell of the task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, states = None, {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(states), kind), pa.array(
                [pickle.dumps(s) for s in states.values()], pa.binary())], [key, "state"])

        for batch in batches:
            kind, codes = batch.schema.field(0).type, batch.column(0).dictionary_encode(null_encoding="encode")
            cells = codes.dictionary.to_pylist()
            frame = pa.RecordBatch.from_arrays(batch.columns[1:], batch.schema.names[1:]).to_pandas()
            for code, part in frame.groupby(codes.indices.to_numpy(), sort=False):
                cell = cells[code]
                states[cell] = rule.update(states[cell] if cell in states else rule.start(), part)
            if len(states) > MAX_STATES:
                yield out()
                states.clear()
        if states:
            yield out()

    return rows


def _finished(rule: CellRule, key: str):
    """Arrow function over states sorted by cell: the verdict of each cell."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_cell, state, kind, done = None, None, None, []

        def out() -> pa.RecordBatch:
            cells, verdicts = [c for c, _ in done], [rule.finish(s) for _, s in done]
            done.clear()
            return pa.RecordBatch.from_arrays([
                pa.array(cells, kind), pa.array([rule.name] * len(cells), pa.string()), pa.array([bool(v) for v, _ in verdicts], pa.bool_()),
                pa.array([d for _, d in verdicts], pa.string())], [key, "rule", "is_valid", "details"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for cell, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                new = pickle.loads(packed)
                if state is not None and cell == open_cell[0]:
                    state = (rule.merge(state[0], new),)
                else:
                    done += [(open_cell[0], state[0])] if state is not None else []
                    open_cell, state = (cell,), (new,)
            if done:
                yield out()
        if state is not None:
            done.append((open_cell[0], state[0]))
            yield out()

    return rows


def check_cells(df: DataFrame, rule: CellRule, key: str = CELL) -> DataFrame:
    """One row per cell: the key, ``rule``, ``is_valid`` and ``details``."""
    ship_package(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    states = df.select(key, *rule.columns).mapInArrow(_partial(rule, key), f"`{key}` {kind}, state binary")
    by_cell = states.repartition(F.col(key)).sortWithinPartitions(key)
    return by_cell.mapInArrow(_finished(rule, key), f"`{key}` {kind}, rule string, is_valid boolean, details string")


def variety_rule(column: str, width: float, bins: int, least: float, name: str = "value_variety") -> CellRule:
    """The entropy (in bits) of a cell's histogram of ``column`` must reach ``least``: ``bins`` steps of ``width`` from 0,
    the first and last of which take what lies outside. A cell without values is not valid.

    The entropy is a sum over the cell's bins, so no single aggregate expression over rows states it.
    """
    import numpy as np

    def update(state, frame):
        x = frame[column].dropna().to_numpy(float)
        places = np.clip(np.floor(x / width), 0, bins - 1).astype(int)
        return state + np.bincount(places, minlength=bins)

    def finish(state):
        total = int(state.sum())
        share = state[state > 0] / max(1, total)
        entropy = float(-(share * np.log2(share)).sum()) if total else 0.0
        return total > 0 and entropy >= least, f"{total} values in {int((state > 0).sum())} bins"

    return CellRule(name, [column], lambda: np.zeros(bins, np.int64), update, lambda a, b: a + b, finish)
