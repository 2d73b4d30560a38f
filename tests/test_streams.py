"""Streams over several micro-batches: state that is carried on, replays, late events, failures, and progress."""

import pytest

from momentis.plans import registry, streams
from momentis.streaming import sessions

SF = "/root/testdata/sf0.001"


@pytest.fixture
def parts(spark, tmp_path):
    """The events in five files in order of time, read one a micro-batch."""
    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts", "event_id").collect()
    size = -(-len(rows) // 5)
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    for k in range(5):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "events.parquet"))


def test_state_is_carried_over_batches(spark, parts, monkeypatch):
    monkeypatch.setattr(type(spark.readStream), "parquet", lambda self, path: parts)
    got = sorted(map(tuple, streams.stream_open_hits(spark, SF).collect()))
    monkeypatch.undo()
    assert got == sorted(map(tuple, registry.queries()["open_queue"](spark, SF).collect()))


def test_late_events_reopen_nothing(spark, tmp_path):
    schema = "cap long, at timestamp"
    for k, at in enumerate(["2024-01-01 00:00:00", "2024-01-05 00:00:00", "2024-01-06 00:00:00", "2024-01-01 01:00:00", "2024-01-09 00:00:00"]):
        spark.sql(f"SELECT 1L AS cap, timestamp'{at}' AS at").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = streams.drained(spark, sessions.closed_sessions(stream, "at", "cap", "2 hours", "1 hour")).orderBy("start").collect()
    assert [(r.start.day, r.n) for r in rows] == [(1, 1), (5, 1), (6, 1)]


def test_replayed_batches_change_nothing(spark, tmp_path):
    write = sessions.once(str(tmp_path / "out"))
    batch = spark.range(3)
    write(batch, 0), write(spark.range(3, 5), 1), write(batch, 0)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3, 4]


def test_failures_are_recorded(spark):
    def make(row):
        if row["id"] == 1:
            raise ValueError("no space")
        return f"file {row['id']}"

    got = sorted(map(tuple, sessions.produced(spark.range(3), make, ["id"]).collect()))
    assert got == [(0, "done", "file 0"), (1, "failed", "ValueError: no space"), (2, "done", "file 2")]


def test_records_are_never_made_again(spark, tmp_path):
    """Failures hold, replays replace themselves, and later batches leave recorded keys alone."""

    def make(row):
        if row["id"] % 2 and row["n"] < 9:
            raise ValueError(f"n is {row['n']}")
        return f"made of {row['n']}"

    write = sessions.recorded(str(tmp_path / "out"), make, ["id"])
    rows = lambda *x: spark.createDataFrame(x, "id long, n long")
    write(rows((0, 1), (1, 1), (1, 1)), 0)
    write(rows((1, 9), (2, 9), (0, 9)), 1)  # 0 and 1 have their records, one of them a failure
    write(rows((1, 9), (2, 9), (0, 9)), 1)  # the same batch again
    write(rows((0, 1), (1, 1), (1, 1)), 0)  # and the first, which looks at no later one
    got = sorted((r.id, r.status, r.result) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, "done", "made of 1"), (1, "failed", "ValueError: n is 1"), (2, "done", "made of 9")]


def test_settling_files():
    f = sessions.Settling(15)
    assert f.push(0, 10) == [] and f.push(10, 10) == [] and f.push(15, 10) == [(15, 10)] and f.push(40, 10) == []
    assert f.push(41, 11) == [] and f.push(56, 11) == [(56, 11)]


def test_progress():
    now = [0.0]
    p = sessions.Progress(100, 20.0, lambda: now[0])
    assert p.left() is None
    for t, n in ((10, 10), (20, 10), (30, 30)):
        now[0] = t
        p.add(n)
    assert p.left() == pytest.approx(50 * 20 / 40)
