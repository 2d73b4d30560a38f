"""Aggregates with a state that merges: rows become states where they lie, and only states travel to where a key's result is made.

A fold says what some rows of a key come to (`of`, from arrays in order), how two states that follow each other come to one (`merge`) and what the last one says
(`result`). A state is a tuple of typed columns (`state`). Folds that depend on order take ranges of (key, order), so a key of any size spreads over tasks;
a key has one state a task at the end. Merging is associative: the result doesn't depend on where the rows are split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from momentis.operators.keyed import per_key
from momentis.session import ship

_KINDS = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
#: Keys that a task holds states of before it hands them on.
KEYS = 10_000
#: Numbers in the lists of these states, at most.
CELLS = 500_000


class Gaps:
    """Distances between neighbouring times: how many there are by powers of two of a unit, and the longest. Times are in order."""

    ordered = True
    state = {"first": "long", "last": "long", "counts": "array<long>", "longest": "long"}
    columns = {"bin": "long", "gaps": "long", "longest": "long"}

    def __init__(self, unit: int, bins: int = 12):
        self.unit, self.bins = unit, bins

    def bin(self, gaps: np.ndarray) -> np.ndarray:
        """0 below the unit, k from 2 ** (k - 1) units; the last bin is open."""
        return np.minimum(np.searchsorted(self.unit << np.arange(self.bins - 1), gaps, side="right"), self.bins - 1)

    def of(self, t: np.ndarray) -> tuple:
        gaps = np.diff(t)
        return int(t[0]), int(t[-1]), np.bincount(self.bin(gaps), minlength=self.bins).tolist(), int(gaps.max(initial=-1))

    def merge(self, a: tuple, b: tuple) -> tuple:
        between = b[0] - a[1]
        counts = np.add(a[2], b[2])
        counts[self.bin(np.array([between]))[0]] += 1
        return a[0], b[1], counts.tolist(), max(a[3], b[3], between)

    def result(self, s: tuple) -> list[tuple]:
        return [(k, n, s[3]) for k, n in enumerate(s[2]) if n]


class Streak:
    """The longest run of equal words, the earliest of equals: word, length and the time it begins."""

    ordered = True
    state = {"n": "long", "head": "string", "heads": "long", "tail": "string", "tails": "long", "since": "long", "word": "string", "best": "long", "at": "long"}
    columns = {"word": "string", "length": "long", "begins": "long"}

    def of(self, t: np.ndarray, words: np.ndarray) -> tuple:
        starts = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
        lengths = np.diff(np.append(starts, len(words)))
        k = int(lengths.argmax())
        return len(words), words[0], int(lengths[0]), words[-1], int(lengths[-1]), int(t[starts[-1]]), words[starts[k]], int(lengths[k]), int(t[starts[k]])

    def merge(self, a: tuple, b: tuple) -> tuple:
        n, head, heads, tail, tails, since, word, best, at = b
        joined = a[3] == head
        runs = [a[6:], (a[3], a[4] + heads, a[5]), (word, best, at)] if joined else [a[6:], b[6:]]
        whole = joined and heads == n
        top = max(runs, key=lambda r: r[1])
        return a[0] + n, a[1], a[2] + heads if joined and a[2] == a[0] else a[2], tail, tails + a[4] if whole else tails, a[5] if whole else since, *top

    def result(self, s: tuple) -> list[tuple]:
        return [s[6:]]


class Spread:
    """Median and median deviation from it of values on a grid, from counts; of an even number the lower middle."""

    ordered = False
    # Only cells that have values: a key of few rows has a small state, however wide the grid is.
    state = {"cells": "array<long>", "counts": "array<long>"}
    columns = {"n": "long", "median": "double", "deviation": "double"}

    def __init__(self, step: float, cells: int):
        self.step, self.cells = step, cells

    def of(self, v: np.ndarray) -> tuple:
        at = np.clip(np.floor(v[~np.isnan(v)] / self.step), 0, self.cells - 1).astype(int)
        cells, counts = np.unique(at, return_counts=True)
        return cells.tolist(), counts.tolist()

    def merge(self, a: tuple, b: tuple) -> tuple:
        cells, at = np.unique(np.concatenate([a[0], b[0]]).astype(int), return_inverse=True)
        counts = np.zeros(len(cells), int)
        np.add.at(counts, at, np.concatenate([a[1], b[1]]).astype(int))
        return cells.tolist(), counts.tolist()

    def result(self, s: tuple) -> list[tuple]:
        cells, counts = np.asarray(s[0], int), np.asarray(s[1], int)
        n = int(counts.sum())
        if not n:
            return []
        middle = int(cells[np.searchsorted(np.cumsum(counts), (n + 1) // 2)])
        away = np.abs(cells - middle)
        near = np.argsort(away, kind="stable")
        return [(n, middle * self.step, int(away[near][np.searchsorted(np.cumsum(counts[near]), (n + 1) // 2)]) * self.step)]


def aggregate(rows: DataFrame, key: str, fold, reads: list[str], order: list[str] | None = None) -> DataFrame:
    """(key, ...) of what the fold says of each key's rows; a null key has no row, and neither has a key without rows."""
    ship(rows.sparkSession)
    own = rows.select(*dict.fromkeys([key, *(order or []), *reads])).where(f"{key} is not null")
    if fold.ordered:
        own = own.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    kind = own.schema[key].dataType.simpleString().replace("bigint", "long")
    kinds = [_KINDS[kind], pa.int64(), *(_KINDS[k] for k in fold.state.values())]
    names = [key, "part", *fold.state]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's key has one state for each time that it hands them on; these follow each other.
        part = TaskContext.get().partitionId() << 32
        held: dict = {}

        def handed() -> pa.RecordBatch:
            values = list(zip(*((k, part, *s) for k, s in held.items()), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names)

        for batch in batches:
            frame = batch.to_pandas()
            for k, some in frame.groupby(key, sort=False):
                state = fold.of(*(some[c].to_numpy() for c in reads))
                held[k] = fold.merge(held[k], state) if k in held else state
            if len(held) > KEYS or sum(len(x) for s in held.values() for x in s if isinstance(x, list)) > CELLS:
                yield handed()
                held.clear()
                part += 1
        if held:
            yield handed()

    states = own.mapInArrow(run, ", ".join([f"{key} {kind}", "part long", *(f"{c} {k}" for c, k in fold.state.items())]))

    def merged(g: pd.DataFrame) -> list[tuple]:
        whole = None
        for s in g[list(fold.state)].itertuples(index=False, name=None):
            whole = s if whole is None else fold.merge(whole, s)
        return fold.result(whole)

    return per_key(states, key, merged, fold.columns, ["part"])
