"""Streams run over all files to their end, into files with a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentis.functions.events import HOUR, KINDS, ORIGIN
from momentis.operators import folds, kernels
from momentis.plans.moments import EV, H
from momentis.plans.registry import query
from momentis.plans.sequential import MARKS, OPEN
from momentis.session import scratch, table
from momentis.streaming import sessions, trackers


def event_stream(spark, sf_dir: str) -> DataFrame:
    """cap, id, t, kind, v and the time `at` of the events, as a stream of files."""
    static = table(spark, sf_dir, "events")
    e = spark.readStream.schema(static.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    kind = F.lit(None).cast("string")
    for own, name in KINDS.items():
        kind = F.when(F.col("event_type") == own, name).otherwise(kind)
    at = F.col("ts").cast("timestamp")
    return e.select(F.col("user_id").alias("cap"), F.col("event_id").alias("id"), (F.unix_micros(at) - ORIGIN).alias("t"), kind.alias("kind"), F.col("value").alias("v"), at.alias("at"))


def drained(spark, stream: DataFrame, sink=None, schema: str | None = None) -> DataFrame:
    """What a stream has given once all its files are read; schema: that of what the sink writes, if it is another."""
    path = scratch(spark)
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if sink is None:
        writer.format("parquet").option("path", f"{path}/out").start().awaitTermination()
    else:
        writer.foreachBatch(sink(f"{path}/out")).start().awaitTermination()
    return spark.read.schema(schema or stream.schema).parquet(f"{path}/out")


CLOSED = f""", m AS (SELECT cap, t, id, CASE WHEN t - lag(t) OVER o <= {48 * H} THEN 0 ELSE 1 END AS f FROM ev WINDOW o AS (PARTITION BY cap ORDER BY t, id)), s AS (SELECT *, sum(f) OVER (PARTITION BY cap ORDER BY t, id) AS grp FROM m),
 c AS (SELECT cap, min(t) AS s, max(t) + {48 * H} AS e, count(*) AS n FROM s GROUP BY cap, grp) SELECT cap, s, n FROM c WHERE e // 1000 <= (SELECT max(t) FROM ev) // 1000 - {H // 1000}"""


@query("stream_closed_sessions", EV + CLOSED)
def stream_closed_sessions(spark, sf_dir):
    """Sessions that the watermark has closed."""
    found = drained(spark, sessions.closed_sessions(event_stream(spark, sf_dir), "at", "cap", "48 hours", "1 hour"))
    return found.select("cap", (F.unix_micros("start") - ORIGIN).alias("s"), "n")


@query("stream_windows", EV + f""", w AS (SELECT cap, unnest([t // {24 * H}, t // {24 * H} - 1]) AS day FROM ev) SELECT day * {24 * H} AS s, cap, count(*) AS n FROM w WHERE (day * {24 * H} + {48 * H}) // 1000 <= (SELECT max(t) FROM ev) // 1000 - {HOUR // 1000} GROUP BY ALL""")
def stream_windows(spark, sf_dir):
    """Sliding windows of two days that the watermark has closed."""
    found = drained(spark, sessions.windowed_counts(event_stream(spark, sf_dir), "at", "cap", "48 hours", "24 hours", "1 hour"))
    return found.select((F.unix_micros("start") - ORIGIN).alias("s"), "cap", "n")


@query("stream_days_once", EV + " SELECT DISTINCT cap, t // 86400000000 AS day FROM ev")
def stream_days_once(spark, sf_dir):
    """Each day of a capture once, by the stream's state and a sink that replays don't change."""
    days = event_stream(spark, sf_dir).select("cap", F.floor(F.col("t") / (24 * HOUR)).alias("day"), "at").withWatermark("at", "60 days").dropDuplicatesWithinWatermark(["cap", "day"])
    return drained(spark, days.select("cap", "day"), sessions.once).select("cap", "day")


def _report(row: dict) -> str:
    if row["n"] < 3:
        raise ValueError(f"{row['n']} events are too few")
    return f"{row['n']} events"


@query("evening_history", EV + f""", w AS (SELECT cap, t // {24 * H} AS day, count(*) AS n FROM ev GROUP BY ALL), c AS (SELECT * FROM w WHERE ((day + 1) * {24 * H}) // 1000 <= (SELECT max(t) FROM ev) // 1000 - {HOUR // 1000})
 SELECT cap, day, CASE WHEN n < 3 THEN 'failed' ELSE 'done' END AS status, CASE WHEN n < 3 THEN 'ValueError: ' || n || ' events are too few' ELSE n || ' events' END AS result FROM c""")
def evening_history(spark, sf_dir):
    """A record of each day of a capture that the watermark has closed: what was made of it, or why that failed; a day that has a record gets no other."""
    days = sessions.windowed_counts(event_stream(spark, sf_dir), "at", "cap", "24 hours", "24 hours", "1 hour")
    rows = days.select("cap", F.floor((F.unix_micros("start") - ORIGIN) / (24 * HOUR)).cast("long").alias("day"), "n")
    return drained(spark, rows, lambda path: sessions.recorded(path, _report, ["cap", "day"]), "cap long, day long, status string, result string").select("cap", "day", "status", "result")


@query("stream_settled_files", EV + f""", c AS (SELECT cap, id, t, CAST(floor(v / 40) AS BIGINT) AS size, lag(CAST(floor(v / 40) AS BIGINT)) OVER (PARTITION BY cap ORDER BY t, id) AS b FROM ev), g AS (SELECT *, sum(CASE WHEN b = size THEN 0 ELSE 1 END) OVER (PARTITION BY cap ORDER BY t, id) AS version FROM c),
 s AS (SELECT *, min(t) OVER (PARTITION BY cap, version) AS since FROM g) SELECT cap, min(t) AS t, min(size) AS size FROM s WHERE t - since >= {15 * H} GROUP BY cap, version""")  # fmt: skip
def stream_settled_files(spark, sf_dir):
    """Files (captures) given once their size has held for fifteen hours of polls (events), and again after each change."""
    polls = event_stream(spark, sf_dir).select("cap", "id", "t", F.floor(F.col("v") / 40).alias("size"))
    push = lambda own, rows: [x for t, size in zip(rows.t.tolist(), rows["size"].tolist(), strict=True) for x in own.push(t, size)]
    return drained(spark, sessions.stateful(polls, "cap", lambda: sessions.Settling(15 * HOUR), push, {"t": "long", "size": "long"}, ["t", "id"]))


@query("stream_open_hits", OPEN)
def stream_open_hits(spark, sf_dir):
    """Finishing blows paired with hits by a state for each capture; equal to `open_queue` over the whole table."""
    marks = event_stream(spark, sf_dir).where("kind in ('kill', 'shot', 'death')").select("cap", "id", "t", "kind").withColumn("later", (F.col("kind") != "shot").cast("int"))
    push = lambda own, rows: [x for t, kind in zip(rows.t.tolist(), rows.kind, strict=True) for x in own.push(t, MARKS[kind])]
    return drained(spark, sessions.stateful(marks, "cap", lambda: sessions.OpenHits(48 * HOUR, 12 * HOUR), push, {"t": "long", "kind": "string"}, ["t", "later", "id"]))


LATENESS = "6 hours"


def _framed(e: DataFrame, hours: int, *columns) -> DataFrame:
    return e.select("cap", F.floor(F.col("t") / (hours * HOUR)).alias("frame"), "id", *columns, "at")


def _spans(hours: int) -> dict[str, int]:
    return {"span": hours * HOUR // 1000, "origin": ORIGIN // 1000}


@query("stream_log_tracks")
def stream_log_tracks(spark, sf_dir):
    """Lines followed over frames of three hours that the watermark has closed; over closed frames equal to `log_tracks`."""
    rows = _framed(event_stream(spark, sf_dir).where("kind in ('shot', 'assist')"), 3, F.col("v").alias("y"), "kind")
    return drained(spark, trackers.log_lines(rows, "cap", "at", LATENESS, folds.LogLines(16, 20.0, 2), **_spans(3)))


@query("stream_row_tracks")
def stream_row_tracks(spark, sf_dir):
    """Rows followed over frames of six hours that the watermark has closed; over closed frames equal to `row_tracks`."""
    rows = _framed(event_stream(spark, sf_dir).where("kind in ('kill', 'death')"), 6, (F.col("id") % 4).cast("double").alias("left"), F.col("v").alias("y"), F.col("kind").alias("role"))
    return drained(spark, trackers.feed_rows(rows, "cap", "at", LATENESS, kernels.FeedRows(0.5, 2, 8), **_spans(6)))


@query("stream_shapes")
def stream_shapes(spark, sf_dir):
    """Shapes that events show (unit vectors at an angle that the value gives), clustered in order of their hours."""
    angle = F.floor(F.col("v") / 12.5) * F.lit(3.141592653589793 / 8)
    rows = _framed(event_stream(spark, sf_dir).where("kind = 'assist'"), 1, F.array(F.cos(angle), F.sin(angle)).alias("x"))
    return drained(spark, trackers.shape_clusters(rows, "cap", "at", LATENESS, kernels.Shapes(0.95), **_spans(1)))
