"""Operators against small literal inputs and plain loops."""

import random

import numpy as np
from pyspark.sql import functions as F

from momentis.functions.events import duration_us, letters, rounded
from momentis.operators import folds, intervals, matching
from momentis.sources import tables
from momentis.streaming import sessions


def test_durations(spark):
    cases = {"90": 90_000_000, "12.5s": 12_500_000, "1m30s": 90_000_000, "1h2m3.5s300ms": 3_723_800_000, "01:23.5": 83_500_000, "1:00:00": 3_600_000_000, "-2s": -2_000_000, "PT1M2S": 62_000_000, "abc": None, "": None}
    got = spark.createDataFrame([(k,) for k in cases], "x string").select("x", duration_us(F.col("x"))).collect()
    assert dict(map(tuple, got)) == cases


def test_rounding_and_letters(spark):
    row = spark.createDataFrame([(-2.5, "éL1m1nat!0n")], "x double, t string").select(rounded(F.col("x"), 0), letters(F.col("t"))).first()
    assert (row[0], row[1]) == (-2.0, "ELIMINATION")


def test_intervals_against_a_bitmap(spark):
    rng = random.Random(3)
    rows = [(k, i, *sorted((rng.randrange(60), rng.randrange(60)))) for k in range(4) for i in range(12)]
    holes = [(k, i, *sorted((rng.randrange(60), rng.randrange(60)))) for k in range(4) for i in range(4)]
    a, b = (spark.createDataFrame(x, "k long, id long, s long, e long") for x in (rows, holes))

    def bits(some, k):
        return {t for kk, _, s, e in some if kk == k for t in range(s, e)}

    got = intervals.subtract(a, b, "k").collect()
    for k in range(4):
        assert {t for r in got if r.k == k for t in range(r.s, r.e)} == bits(rows, k) - bits(holes, k)
    covered = dict(map(tuple, intervals.covered_length(a, "k").collect()))
    assert covered == {k: len(bits(rows, k)) for k in range(4)}


def test_greedy_matching(spark):
    make = lambda ts: spark.createDataFrame([(1, i, t) for i, t in enumerate(ts)], "cap long, id long, t long")
    pairs = matching.greedy_pairs(make([100, 110, 1000]), make([108, 500]), 20, 0).collect()
    assert [(r.lid, r.rid) for r in pairs] == [(1, 0)]
    assert [(r.lid, r.rid) for r in matching.greedy_pairs(make([120, 200]), make([100, 210]), 3, 30).collect()] == [(0, 0)]
    assert matching.greedy_pairs(make([120, 200]), make([100, 210]), 3, 0).count() == 0


def test_folds():
    assert folds.spaced(np.array([0.0, 1, 5]), np.array([1.0, 2, 1]), 2).tolist() == [False, True, True]
    two = [np.array([0.0, 1e6]), np.array([9e6, 9e6]), np.array([1, 2])]
    assert folds.distinct_games(*two, game=["a", "b"]).all() and folds.distinct_games(*two, reliable=[True, False]).all()
    assert folds.distinct_games(*two, reliable=[False, False], size=[5, 5]).tolist() == folds.distinct_games(*two, reliable=[False, False], file=["x", "x"]).tolist() == [False, True]
    assert folds.budgeted(np.array([15.0, 15, 15]), np.array([0.6, 0.9, 0.8]), 35, 3).tolist() == [5, 15, 15]
    assert [x for x in folds.fifo_pairs([(382.5, 1), (388.5, 1), (578.5, 1)], [366, 370, 693], 30, 1)] == [(366, "paired"), (370, "paired"), (578.5, "lone"), (693, "free")]
    assert folds.sellers("ELIMINATION", "XXELIMNATIONXX") == 1
    assert folds.track_log([(k, 10.0, "kill") for k in range(5)], 6, 32, 2) == [(0, "kill")]
    # A line rises by several pitches and is the same one; one far below is another; a lone sighting counts for nothing.
    assert folds.track_log([(0, 200.0, "kill"), (1, 80.0, "kill"), (2, 80.0, "kill"), (2, 200.0, "kill"), (3, 200.0, "kill"), (9, 5.0, "aid")], 6, 32, 2) == [(0, "kill"), (2, "kill")]
    assert folds.track_log([(0, 10.0, "a"), (1, 40.0, "a"), (2, 40.0, "a")], 6, 32, 2) == [(1, "a")] and folds.track_log([(0, 10.0, "a"), (1, 40.0, "a")], 6, 32, 2, 1) == [(0, "a")]
    team = [110, 112, 115, 120], [100, 105, 130, 133, 140]
    assert folds.clutches(*team, [], 40) == [(120, 3, 140)]
    assert folds.clutches(*team, [121.4], 40) == [] and folds.clutches(*team, [], 40, starts=[115]) == [] and folds.clutches(*team, [], 40, least=4) == []
    assert folds.clutches([*team[0], 139], team[1], [139.5], 40) == [] and folds.clutches(*team, [300], 40) == [(120, 3, 140)]
    assert folds.distinct_games(np.array([0.0, 1, 100]), np.array([44.0, 40, 40]), np.array([21, 23, 12])).tolist() == [False, True, True]
    assert folds.diverse(np.array([[0.0], [0.1], [1.0]]), np.arange(3), 0.25, 5) == [0, 2]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"version": 1, "capture": "a", "duration_us": 5, "extra": 1,\n "moments": []}')
    (tmp_path / "b.json").write_text('{"version": 9, "capture": "b"}')
    (tmp_path / "c.json").write_text("{oops")
    assert [r.capture for r in tables.read_sessions(spark, str(tmp_path)).collect()] == ["a"]
    (tmp_path / "log").mkdir()
    (tmp_path / "log/x.txt").write_text("frame:0 pts_time:0\nlavfi.r128.M=-120.691\nframe:1 pts_time:0.1\nlavfi.r128.M=-23.5\n")
    assert [(r.t, r.lufs) for r in tables.read_loudness(spark, str(tmp_path / "log")).orderBy("t").collect()] == [(0.0, -120.691), (0.1, -23.5)]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c")], "k int, v string")
    assert sorted(map(tuple, tables.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "c")]


def test_stream_equals_batch_and_sink_takes_each_once(spark, tmp_path):
    batch = spark.createDataFrame([(1, m) for m in (0, 1, 2, 30, 31, 500)], "k int, m int").select("k", F.timestamp_seconds(F.col("m") * 60).alias("at"))
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    sink = sessions.once(str(tmp_path / "out"))
    q = sessions.closed_sessions(stream, "at", "k", "10 minutes", "5 minutes").writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.n for r in got.collect()) == [2, 3]
    last = got.agg(F.max("batch")).first()[0]
    again = got.where(F.col("batch") == last).drop("batch")
    sink(spark.createDataFrame(again.collect(), again.schema), last)  # a replay
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_spacing_and_distinct_games_equal_all_pairs():
    rng = np.random.default_rng(9)
    for _ in range(60):
        n = int(rng.integers(0, 40))
        times, strength = rng.integers(0, 100, n).astype(float), rng.integers(0, 5, n)
        kept = []
        for k in np.lexsort((times, -strength)):
            if all(abs(times[k] - times[j]) >= 7 for j in kept):
                kept.append(k)
        assert set(np.flatnonzero(folds.spaced(times, strength, 7.0))) == set(kept)
        start, length = rng.integers(0, 60, n) * 1e6, rng.integers(0, 12, n) * 700_000.0
        start[rng.random(n) < 0.1] = np.nan
        kills, game, file, size, sure = rng.integers(0, 6, n), rng.integers(0, 3, n), rng.integers(0, 30, n), rng.integers(0, 6, n), rng.random(n) < 0.7
        kept = []
        for k in np.argsort(-kills, kind="stable"):
            if np.isnan(start[k]):
                continue
            shared = lambda j: min(start[j] + length[j], start[k] + length[k]) - max(start[j], start[k])  # noqa: B023, E731
            if not any(game[j] == game[k] and (file[j] == file[k] or (size[j] == size[k] > 0 and abs(length[j] - length[k]) < 1e6) or (sure[j] and sure[k] and shared(j) > min(length[j], length[k]) / 2)) for j in kept):
                kept.append(k)
        assert set(np.flatnonzero(folds.distinct_games(start, length, kills, game, file, size, sure))) == set(kept)


def test_dice(spark):
    from momentis.functions.events import dice

    rows = [(1, [0.9, 0.8, 0.1], [0.7, 0.2, 0.1]), (2, [0.0], [0.1]), (3, [0.6], [0.6]), (4, [0.6, 0.0], [0.0, 0.6]), (5, None, [0.6])]
    got = spark.createDataFrame(rows, "k int, a array<double>, b array<double>").select("k", dice(F.col("a"), F.col("b"), 0.5)).collect()
    assert {k: v and round(v, 6) for k, v in map(tuple, got)} == {1: 0.666667, 2: 0.0, 3: 1.0, 4: 0.0, 5: None}
