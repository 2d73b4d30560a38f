"""Trackers as streams: typed state for each key, rows put in order by event time, and timers that let state go.

Rows wait until the watermark has passed their frame, so the order in which they arrive doesn't matter within the lateness, and later ones are dropped. A timer at the first waiting frame takes all that the watermark has closed; another one, after the longest time that anything is held, clears what is left of a silent key.
A key is called once for a batch's rows and once for its timer, and reads and writes each state once in a call, however many frames that call takes.
So the rows of a tracker are those of its batch form over all closed frames. State lies in typed columns (lists, values, maps), which a changed
program can still read, and in a store that spills.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from momentis.operators import folds, kernels
from momentis.session import ship

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Typed state takes values of its columns' own types only; others become null.
_PYTHON = {"long": int, "double": float, "string": str, "array<double>": lambda x: list(map(float, x))}
_KINDS = {"long": "int64", "double": "float64", "string": "object", "boolean": "bool"}


class Framed(StatefulProcessor):
    """Buffers rows (frame, order, ...) and hands them on frame by frame once the watermark has passed the frame's end.

    span: a frame's milliseconds of event time, from origin on; held: frames after which a silent key is cleared.
    """

    def __init__(self, key: str, row: dict[str, str], out: dict[str, str], span: int, origin: int, held: int):
        self.key, self.row, self.out, self.span, self.origin, self.held = key, row, out, span, origin, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ", ".join(f"{n} {k}" for n, k in self.row.items()))
        # The last frame that was taken, and how many there were.
        self.taken = handle.getValueState("taken", "frame long, count long")
        self.open(handle)

    def end(self, frame: int) -> int:
        return self.origin + (frame + 1) * self.span

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # The engine drops late rows by the watermark of the batch before; this one's has closed more frames.
        now = timerValues.getCurrentWatermarkInMs()
        first = None
        for batch in rows:
            own = list(zip(*(map(_PYTHON[k], batch[n]) for n, k in self.row.items()), strict=True))
            own = [r for r in own if self.end(r[0]) > now]
            if own:
                self.waiting.appendList(own)
                first = min(r[0] for r in own) if first is None else min(first, *(r[0] for r in own))
        # Every waiting row has a timer at its frame or before it: earlier rows have theirs.
        if first is not None:
            self.handle.registerTimer(self.end(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Not the timer's own time: one call takes all frames that are closed.
        now = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        ready = sorted((r for r in rows if self.end(r[0]) <= now), key=lambda r: (r[0], r[1]))
        last, count = self.taken.get() if self.taken.exists() else (None, 0)
        out: list[tuple] = []
        if ready:
            left = [r for r in rows if self.end(r[0]) > now]
            self.waiting.put(left) if left else self.waiting.clear()
            frames = [(int(f), list(own)) for f, own in groupby(ready, key=lambda r: r[0])]
            out = self.take(count, frames)
            last, count = frames[-1][0], count + len(frames)
            self.taken.update((last, count))
            self.handle.registerTimer(self.end(min((r[0] for r in left), default=last + self.held)))
        elif rows:
            self.handle.registerTimer(self.end(min(r[0] for r in rows)))
        elif last is not None:
            if self.end(last + self.held) <= now:
                self.clear()
            else:
                self.handle.registerTimer(self.end(last + self.held))
        return iter([self._frame(key, out)] if out else ())

    def _frame(self, key, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=list(self.out)).astype({n: _KINDS[k] for n, k in self.out.items()})
        frame.insert(0, self.key, pd.Series([key[0]] * len(out), dtype="int64"))
        return frame

    def open(self, handle: StatefulProcessorHandle) -> None:
        """Get further state."""

    def take(self, count: int, frames: list[tuple[int, list[tuple]]]) -> list[tuple]:
        """What the rows of frames (frame, rows), in order, give; count frames were taken before."""
        raise NotImplementedError

    def clear(self) -> None:
        """Let a silent key's state go."""

    def close(self) -> None: ...


class Tracked(Framed):
    """A tracker of lines or rows (`folds.LogLines`, `kernels.FeedRows`) over frames; counted: frames are numbered as they come."""

    def __init__(self, tracker, counted: bool, **more):
        super().__init__(out=tracker.found, **more)
        self.tracker, self.counted = tracker, counted

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getListState("live", self.tracker.live)

    def take(self, count: int, frames: list[tuple[int, list[tuple]]]) -> list[tuple]:
        live = list(self.live.get()) if self.live.exists() else []
        out: list[tuple] = []
        for k, (frame, rows) in enumerate(frames):
            live, found = self.tracker.frame(live, count + k if self.counted else frame, [r[2:] for r in rows])
            out += found
        kinds = [_PYTHON[x.split(" ")[1]] for x in self.tracker.live.split(", ")]
        self.live.put([tuple(k(v) for k, v in zip(kinds, x, strict=True)) for x in live]) if live else self.live.clear()
        return [(int(a), b) for a, b in out]

    def clear(self) -> None:
        # Counted frames stand still in silence, so their rows do as well.
        if not self.counted:
            self.live.clear()


class Clustered(Framed):
    """Shapes (frame, order, x) clustered one by one (`kernels.Shapes`): clusters in a map, the key's place in a value; neither is ever forgotten, as the first is the zero."""

    def __init__(self, shapes: kernels.Shapes, **more):
        super().__init__(out={"id": "long", "shape": "long", "fresh": "boolean"}, **more)
        self.shapes = shapes

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.clusters = handle.getMapState("clusters", "k long", "x array<double>, seen boolean")
        self.place = handle.getValueState("place", "current long, candidate array<double>, start long, run long")

    def take(self, count: int, frames: list[tuple[int, list[tuple]]]) -> list[tuple]:
        known = {k[0]: (list(x[0]), x[1]) for k, x in self.clusters.iterator()} if self.clusters.exists() else {}
        before, out = dict(known), []
        place = tuple(self.place.get()) if self.place.exists() else (None, None, 0, 0)
        for _, order, x in (r for _, rows in frames for r in rows):
            place, fresh = self.shapes.push(known, place, int(order), np.array(x, float))
            out.append((int(order), place[0], fresh is not None))
        for k, x in known.items():
            if before.get(k) != x:
                self.clusters.updateValue((k,), (list(map(float, x[0])), bool(x[1])))
        current, candidate, start, run = place
        self.place.update((current, list(map(float, candidate)), start, run))
        return out


def store(spark: SparkSession) -> None:
    """Typed state needs the store that keeps column families."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def followed(rows: DataFrame, key: str, at: str, lateness: str, processor: Framed) -> DataFrame:
    """What a processor gives for the stream's rows (key, frame, order, ..., and the time `at`), append mode."""
    ship(rows.sparkSession)
    store(rows.sparkSession)
    schema = ", ".join([f"{key} long", *(f"{n} {k}" for n, k in processor.out.items())])
    grouped = rows.withWatermark(at, lateness).select(key, *processor.row, at).groupBy(key)
    # The driver's own worker, which reads the state's types, knows no shipped files: what a processor is made of goes with it.
    own = [sys.modules[__name__], folds, kernels]
    for module in own:
        cloudpickle.register_pickle_by_value(module)
    try:
        return grouped.transformWithStateInPandas(processor, schema, "Append", "EventTime")
    finally:
        for module in own:
            cloudpickle.unregister_pickle_by_value(module)


def log_lines(rows: DataFrame, key: str, at: str, lateness: str, lines, span: int, origin: int) -> DataFrame:
    """`folds.track_log` over a stream of rows (key, frame, id, y, kind, at): a row per line, once, when it has been seen often enough."""
    row = {"frame": "long", "id": "long", "y": "double", "kind": "string"}
    return followed(rows, key, at, lateness, Tracked(lines, False, key=key, row=row, span=span, origin=origin, held=int(lines.hold) + 1))


def feed_rows(rows: DataFrame, key: str, at: str, lateness: str, tracker, span: int, origin: int) -> DataFrame:
    """`kernels.track_rows` over a stream of rows (key, frame, id, left, y, role, at)."""
    row = {"frame": "long", "id": "long", "left": "double", "y": "double", "role": "string"}
    return followed(rows, key, at, lateness, Tracked(tracker, True, key=key, row=row, span=span, origin=origin, held=1))


def shape_clusters(rows: DataFrame, key: str, at: str, lateness: str, shapes: kernels.Shapes, span: int, origin: int) -> DataFrame:
    """`kernels.track_shapes` over a stream of rows (key, frame, id, x, at): each row's cluster, and whether it shows a shape not seen since the first."""
    row = {"frame": "long", "id": "long", "x": "array<double>"}
    return followed(rows, key, at, lateness, Clustered(shapes, key=key, row=row, span=span, origin=origin, held=1))
