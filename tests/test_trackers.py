"""Trackers as streams against their batch forms: over micro-batches, out of order, late, after silence and after a restart."""

import random
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from momentis.functions.events import HOUR, load_events
from momentis.operators import folds, kernels
from momentis.plans import registry, streams
from momentis.streaming import trackers

SF = "/root/testdata/sf0.001"
SCHEMA = "cap long, frame long, id long, y double, kind string, at timestamp"


def closed(spark, kinds, hours):
    """Events by capture of the frames that six hours' lateness has closed."""
    e = load_events(spark, SF)
    end = e.agg(F.max("t")).first()[0] // 1000 - 6 * HOUR // 1000
    out = defaultdict(list)
    for r in e.where(F.col("kind").isin(*kinds)).orderBy("cap", "t", "id").collect():
        frame = r.t // (hours * HOUR)
        if (frame + 1) * hours * HOUR // 1000 <= end:
            out[r.cap].append((frame, r.id, r.v, r.kind))
    return out


def test_log_lines_equal_the_batch_form(spark):
    got = sorted(map(tuple, streams.stream_log_tracks(spark, SF).collect()))
    want = [(cap, int(t), k) for cap, rows in closed(spark, ("shot", "assist"), 3).items() for t, k in folds.track_log([(f, v, k) for f, _, v, k in rows], 16, 20.0, 2)]
    assert got == sorted(want) and got


def test_feed_rows_equal_the_batch_form(spark):
    got = sorted(map(tuple, registry.queries()["stream_row_tracks"](spark, SF).collect()))
    want = []
    for cap, rows in closed(spark, ("kill", "death"), 6).items():
        frames = defaultdict(list)
        for f, i, v, k in sorted(rows):
            frames[f].append((float(i % 4), v, k))
        want += [(cap, a, k) for a, k in kernels.track_rows([frames[f] for f in sorted(frames)], 0.5, 2, 8)]
    assert got == sorted(want) and got


def test_shapes_equal_the_batch_form(spark):
    got = sorted(map(tuple, registry.queries()["stream_shapes"](spark, SF).collect()))
    want = []
    for cap, rows in closed(spark, ("assist",), 1).items():
        own = sorted(rows)
        angles = [np.floor(v / 12.5) * np.pi / 8 for _, _, v, _ in own]
        state, clusters = (None, None, 0, 0), {}
        for (_, i, _, _), a in zip(own, angles, strict=True):
            state, fresh = kernels.Shapes(0.95).push(clusters, state, i, np.array([np.cos(a), np.sin(a)]))
            want.append((cap, i, state[0], fresh is not None))
    assert got == sorted(want) and any(r[3] for r in got)


def line(cap, hour, i, y, kind="kill"):
    return (cap, hour, i, float(y), kind, hour)


def put(spark, path, rows):
    at = F.timestamp_seconds(F.col("at") * 3600 + 60)
    spark.createDataFrame(rows, SCHEMA.replace("at timestamp", "at long")).withColumn("at", at).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, work, lines):
    """One drain of all new files, one file a micro-batch."""
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    found = trackers.log_lines(rows, "cap", "at", "2 hours", lines, 3_600_000, 0)
    query = found.writeStream.outputMode("append").option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{work}/out").start()
    query.awaitTermination()
    return query, sorted(map(tuple, spark.read.schema("cap long, frame long, kind string").parquet(f"{work}/out").collect()))


@pytest.fixture
def places(tmp_path):
    return str(tmp_path / "in"), str(tmp_path / "work")


def test_order_within_the_lateness_does_not_matter_and_later_rows_are_dropped(spark, places):
    path, work = places
    lines = folds.LogLines(16, 20.0, 2)
    put(spark, path, [line(1, 1, 1, 50), line(1, 3, 3, 48)])
    put(spark, path, [line(1, 2, 2, 49), line(2, 3, 4, 10)])  # behind frame 3, within two hours
    put(spark, path, [line(1, 9, 5, 500), line(2, 9, 6, 10)])  # closes what is before hour 7
    put(spark, path, [line(1, 2, 7, 300), line(1, 2, 8, 300), line(1, 3, 9, 300)])  # too late: two sightings that count for nothing
    put(spark, path, [line(3, 40, 10, 1)])
    _, got = run(spark, path, work, lines)
    on_time = {1: [(1, 50.0, "kill"), (2, 49.0, "kill"), (3, 48.0, "kill"), (9, 500.0, "kill")], 2: [(3, 10.0, "kill"), (9, 10.0, "kill")]}
    assert got == sorted((cap, int(t), k) for cap, rows in on_time.items() for t, k in folds.track_log(rows, 16, 20.0, 2))


def test_a_silent_key_is_cleared_and_a_restart_goes_on(spark, places):
    path, work = places
    lines = folds.LogLines(4, 20.0, 2)
    put(spark, path, [line(1, 1, 1, 50), line(2, 1, 2, 50)])
    put(spark, path, [line(3, 5, 3, 1)])
    first, got = run(spark, path, work, lines)
    assert got == []
    state = lambda query: sum(p.numRowsTotal for p in [query.lastProgress.stateOperators[0]])
    held = state(first)
    # The line of key 2 goes on after a restart from the checkpoint; that of key 1 stays silent.
    put(spark, path, [line(2, 4, 4, 45)])
    put(spark, path, [line(3, 30, 5, 1)])
    second, got = run(spark, path, work, lines)
    assert got == [(2, 1, "kill")]
    # Keys 1 and 2 are cleared by their timers: their live lines are gone, one count each stays.
    put(spark, path, [line(3, 60, 6, 1)])
    third, got = run(spark, path, work, lines)
    assert got == [(2, 1, "kill")]
    assert state(third) < held + 4


def test_streams_do_not_depend_on_how_rows_are_cut(spark, tmp_path):
    rng = random.Random(3)
    rows = [line(rng.randrange(3), h, 10 * h + k, rng.randrange(0, 60, 5), rng.choice(["kill", "aid"])) for h in range(20) for k in range(rng.randrange(4))]
    results = []
    for name, parts in (("one", 1), ("six", 6)):
        path = str(tmp_path / name)
        size = -(-len(rows) // parts)
        for k in range(parts):
            put(spark, path, rows[k * size : (k + 1) * size])
        put(spark, path, [line(9, 100, 10_000, 0)])
        results.append(run(spark, path, str(tmp_path / f"{name}-work"), folds.LogLines(4, 10.0, 2))[1])
    want = []
    for cap in range(3):
        want += [(cap, int(t), k) for t, k in folds.track_log([(r[1], r[3], r[4]) for r in rows if r[0] == cap], 4, 10.0, 2)]
    assert results[0] == results[1] == sorted(want)


class Held:
    """A list or value of state, and how often it was called."""

    def __init__(self, calls):
        self.calls, self.x = calls, None

    def exists(self):
        return self.x is not None

    def get(self):
        self.calls.append("get")
        return self.x

    def put(self, x):
        self.calls.append("put")
        self.x = x

    update = put

    def appendList(self, x):
        self.put((self.x or []) + x)

    def clear(self):
        self.x = None


def test_one_timer_takes_all_closed_frames():
    class Handle:
        def __init__(self):
            self.timers, self.calls = [], []
            self.getListState = self.getValueState = lambda *_: Held(self.calls)

        def registerTimer(self, at):
            self.timers.append(at)

    class At:
        def __init__(self, now):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: now

    row = {"frame": "long", "id": "long", "y": "double", "kind": "string"}
    own = trackers.Tracked(folds.LogLines(4, 20.0, 2), False, key="cap", row=row, span=10, origin=0, held=5)
    handle = Handle()
    own.init(handle)
    frame = pd.DataFrame([(f, f, 50.0, "kill" if f % 2 else "aid") for f in range(60)], columns=list(row))
    list(own.handleInputRows((7,), iter([frame]), At(0)))
    assert handle.timers == [10]
    handle.calls.clear()
    found = pd.concat(own.handleExpiredTimer((7,), At(500), At(10)))
    # Frames 0 to 49 at once, in a bounded number of calls; the timer goes on to the first one that waits.
    assert list(map(tuple, found.to_numpy().tolist())) == [(7, 0, "aid"), (7, 1, "kill")]
    assert len(handle.calls) < 8 and handle.timers == [10, 510] and own.taken.x == (49, 50)
    assert list(own.handleExpiredTimer((7,), At(600), At(510))) == [] and own.taken.x == (59, 60) and own.live.x
    # Silent for the longest time that a line is held: cleared.
    assert list(own.handleExpiredTimer((7,), At(650), At(650))) == [] and own.live.x is None
