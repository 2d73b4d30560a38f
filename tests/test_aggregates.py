"""Mergeable aggregates: any split of the rows gives what one pass over all of them gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentis.operators import aggregates

RNG = np.random.default_rng(4)


def columns(fold, n):
    t = np.sort(RNG.integers(0, 300, n))
    return {aggregates.Gaps: (t,), aggregates.Streak: (t, RNG.choice(list("ab"), n).astype(object)), aggregates.Spread: (np.where(RNG.random(n) < 0.1, np.nan, RNG.random(n) * 60),)}[type(fold)]


@pytest.mark.parametrize("fold", [aggregates.Gaps(5, 6), aggregates.Streak(), aggregates.Spread(0.5, 100)], ids=lambda f: type(f).__name__)
def test_split_does_not_matter(fold):
    for _ in range(300):
        n = int(RNG.integers(1, 25))
        data = columns(fold, n)
        cuts = [0, *sorted(set(RNG.integers(1, n, 4).tolist() if n > 1 else [])), n]
        parts = [fold.of(*(c[a:b] for c in data)) for a, b in zip(cuts, cuts[1:], strict=False)]
        while len(parts) > 1:
            k = int(RNG.integers(0, len(parts) - 1))
            parts[k : k + 2] = [fold.merge(parts[k], parts[k + 1])]
        assert parts[0] == fold.of(*data)


def test_one_large_key_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "KEYS", 3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        rows = [(1 if RNG.random() < 0.6 else int(RNG.integers(2, 30)), k, int(k // 2), str(RNG.choice(list("xy")))) for k in range(3000)] + [(None, 1, 1, "x")]
        frame = spark.createDataFrame(rows, "key long, id long, t long, word string").repartition(6)
        got = {r.key: tuple(r)[1:] for r in aggregates.aggregate(frame, "key", aggregates.Streak(), ["t", "word"], ["t", "id"]).collect()}
        fold = aggregates.Streak()
        for key in {r[0] for r in rows} - {None}:
            own = sorted((r[2], r[1], r[3]) for r in rows if r[0] == key)
            assert got.pop(key) == fold.of(np.array([r[0] for r in own]), np.array([r[2] for r in own], object))[6:]
        assert not got
        assert aggregates.aggregate(frame.where("key < 0"), "key", aggregates.Spread(1.0, 9), ["t"]).count() == 0
        spread = aggregates.aggregate(frame.withColumn("v", F.col("t").cast("double")), "key", aggregates.Spread(1.0, 2000), ["v"])
        assert {r.key: r.n for r in spread.collect()} == {k: sum(r[0] == k for r in rows) for k in {r[0] for r in rows} - {None}}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_state_of_counts_is_as_long_as_its_values():
    fold = aggregates.Spread(0.5, 1024)
    state = fold.merge(fold.of(np.array([3.0, 3.2, 90.0])), fold.of(np.array([3.1, np.nan])))
    assert sum(map(len, state)) == 4 and fold.result(state) == [(4, 3.0, 0.0)]
