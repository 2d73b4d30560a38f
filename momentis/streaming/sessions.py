"""Streams: sessions that close after silence, windows, stateful operators in push style, and sinks that take each result once."""

from __future__ import annotations

import pickle
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from momentis.session import exists, ship


def closed_sessions(events: DataFrame, at: str, key: str, gap: str, lateness: str) -> DataFrame:
    """A row per session once the watermark has passed its end; later events don't reopen it (append mode)."""
    windowed = events.withWatermark(at, lateness).groupBy(key, F.session_window(at, gap).alias("w"))
    return windowed.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def windowed_counts(events: DataFrame, at: str, key: str, size: str, slide: str, lateness: str) -> DataFrame:
    """A row per window and key once the watermark has passed the window's end."""
    return events.withWatermark(at, lateness).groupBy(F.window(at, size, slide).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def stateful(rows: DataFrame, key: str, start: Callable[[], object], push: Callable[[object, pd.DataFrame], list[tuple]], columns: dict[str, str], order: list[str]) -> DataFrame:
    """Rows (key, ...) that push gives for each key's new rows, in order within a micro-batch, and the key's state, which it changes in place.

    A key's state is as large as what start and push keep in it; rows that arrive after later ones are pushed when they come.
    """
    ship(rows.sparkSession)
    kinds = {"long": "int64", "double": "float64", "string": "object"}

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = pickle.loads(state.get[0]) if state.exists else start()
        rows_ = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")
        found = push(own, rows_)
        state.update((pickle.dumps(own),))
        out = pd.DataFrame(found, columns=list(columns)).astype({n: kinds[k] for n, k in columns.items()})
        out.insert(0, key, group[0])
        yield out

    kind = rows.schema[key].dataType.simpleString()
    schema = ", ".join([f"{key} {kind}", *(f"{n} {k}" for n, k in columns.items())])
    return rows.groupBy(key).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.NoTimeout)


class OpenHits:
    """Finishing blows paired with the hits before them, event by event; see `operators.sequences.open_queue`."""

    def __init__(self, window: float, repeat: float):
        self.window, self.repeat = window, repeat
        self.waiting: deque[float] = deque()
        self.read: dict[str, float] = {}

    def push(self, t: float, kind: str) -> list[tuple[float, str]]:
        while self.waiting and t - self.waiting[0] > self.window:
            self.waiting.popleft()
        if kind not in ("finish", "wipe"):
            if kind == "hit":
                self.waiting.append(t)
            return [(t, kind)]
        since = t - self.read.get(kind, float("-inf"))
        self.read[kind] = t
        if self.waiting:
            if kind == "wipe":
                self.waiting.clear()
            else:
                self.waiting.popleft()
            return []
        return [(t, "hit")] if since > self.repeat else []


class Settling:
    """A file that polls see: given once it has been still for long enough, and again after each change."""

    def __init__(self, settle: float):
        self.settle = settle
        self.version, self.since, self.given = None, 0.0, False

    def push(self, t: float, version) -> list[tuple]:
        if version != self.version:
            self.version, self.since, self.given = version, t, False
        if self.given or t - self.since < self.settle:
            return []
        self.given = True
        return [(t, version)]


def once(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that holds each batch once: a batch that is replayed replaces itself, and no batch reads what others wrote.

    Keys are made distinct in the stream, by its state (`dropDuplicatesWithinWatermark`), not by looking through the sink.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={epoch}")

    return write


def produced(batch: DataFrame, fn: Callable[[dict], str], keys: list[str]) -> DataFrame:
    """What fn makes of each row, with its status: a failure is recorded with its message and, as its key is taken, never tried again by itself."""
    ship(batch.sparkSession)
    names = batch.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    out.append(("done", fn(row)))
                except Exception as error:  # whatever fails is the record's content
                    out.append(("failed", f"{type(error).__name__}: {error}"))
            yield frame[keys].assign(status=[a for a, _ in out], result=[b for _, b in out])

    kinds = {f.name: f.dataType.simpleString() for f in batch.schema.fields}
    return batch.select(*names).mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "status string, result string"]))


def recorded(path: str, fn: Callable[[dict], str], keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of one record per key, done or failed: keys that earlier batches have recorded are left alone, and a batch that is replayed replaces itself.

    Of earlier records only the keys are read.
    """
    top = path.rstrip("/")

    def write(batch: DataFrame, epoch: int) -> None:
        fresh = batch.dropDuplicates(keys)
        if exists(batch.sparkSession, top):
            schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in batch.select(*keys).schema.fields), "batch long"])
            earlier = batch.sparkSession.read.schema(schema).parquet(top).where(F.col("batch") < epoch).select(*keys)
            fresh = fresh.join(earlier, keys, "left_anti")
        produced(fresh, fn, keys).write.mode("overwrite").parquet(f"{top}/batch={epoch}")

    return write


class Progress(StreamingQueryListener):
    """Rows done and the time left at the rate of the last `span` seconds."""

    def __init__(self, total: int, span: float = 20.0, clock: Callable[[], float] = time.monotonic):
        self.total, self.span, self.clock = total, span, clock
        self.done = 0
        self.marks: deque[tuple[float, int]] = deque([(clock(), 0)])

    def add(self, rows: int) -> None:
        self.done += rows
        now = self.clock()
        self.marks.append((now, self.done))
        while len(self.marks) > 2 and now - self.marks[1][0] >= self.span:
            self.marks.popleft()

    def left(self) -> float | None:
        """Seconds left; None before anything is known."""
        (t0, n0), (t1, n1) = self.marks[0], self.marks[-1]
        return None if n1 == n0 or t1 == t0 else max(0, self.total - self.done) * (t1 - t0) / (n1 - n0)

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.add(event.progress.numInputRows)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
