"""Learners against fits by plain loops: the same minimum, the same held-out hits, and the gates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from momentis.operators import learners
from momentis.plans import registry
from momentis.plans.detecting import RULE, day_choices

SF = "/root/testdata/sf0.001"


def plain_choice(options, chosen, rule, sharpness=4.0, penalty=0.02, rate=0.05, steps=40_000):
    """Small fixed steps up the likelihood less the penalty, until they stand still."""
    w = np.array(rule, float)
    for _ in range(steps):
        slope = -penalty * (w - rule)
        for x, t in zip(options, chosen, strict=True):
            p = np.exp(sharpness * (x @ w) - (sharpness * (x @ w)).max())
            slope += sharpness * (x[t] - p @ x / p.sum()) / len(options)
        w += rate * slope
        if np.abs(slope).max() < 1e-10:
            break
    return w


def plain_logistic(x, y, penalty=0.1, rate=0.5, steps=60_000):
    mean, scale = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / np.where(scale > 1e-9, scale, 1)
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        e = 1 / (1 + np.exp(-(z @ w + b))) - y
        gw, gb = z.T @ e / len(y) + penalty * w, e.mean()
        w, b = w - rate * gw, b - rate * gb
        if max(np.abs(gw).max(), abs(gb)) < 1e-11:
            break
    return w, b, mean, np.where(scale > 1e-9, scale, 1)


def choices(seed, n, noise):
    rng = np.random.default_rng(seed)
    hidden = np.array([0.2, 1.0, -0.7])
    options = [np.round(rng.normal(size=(rng.integers(2, 6), 3)), 3) for _ in range(n)]
    return options, [int(np.argmax(x @ hidden + noise * rng.normal(size=len(x)))) for x in options]


@pytest.mark.parametrize("n", [9, 60])
def test_choice_model_equals_a_plain_fit(spark, n):
    options, chosen = choices(n, n, 0.5)
    rule = [1.0, 0.0, 0.0]
    rows = spark.createDataFrame([(k, x.tolist(), c) for k, (x, c) in enumerate(zip(options, chosen, strict=True))], "id long, o array<array<double>>, c long").repartition(3)
    got = learners.choice_model(rows, F.col("id"), F.col("o"), F.col("c"), rule)
    assert np.allclose(got["weights"], plain_choice(options, chosen, rule), atol=1e-6)
    assert got["rule_hits"] == sum(int(np.argmax(x @ rule)) == c for x, c in zip(options, chosen, strict=True))
    if n <= learners.FOLDS:
        hits = 0
        for k in range(n):
            w = plain_choice(options[:k] + options[k + 1 :], chosen[:k] + chosen[k + 1 :], rule)
            hits += int(np.argmax(options[k] @ w)) == chosen[k]
        assert got["hits"] == hits
    assert got["active"] == (got["hits"] > got["rule_hits"])


@pytest.mark.parametrize(("n", "noise"), [(14, 0.3), (200, 0.5), (40, 50.0)])
def test_logistic_model_equals_a_plain_fit(spark, n, noise):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, 3)) * [1, 10, 0.1] + [5, 0, 0], 4)
    y = ((x - [5, 0, 0]) @ [1, 0.1, -5] + noise * rng.normal(size=n) > 0).astype(float)
    rows = spark.createDataFrame([(k, v.tolist(), float(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y double").repartition(3)
    got = learners.logistic_model(rows, F.col("id"), F.col("x"), F.col("y"))
    w, b, _, _ = plain_logistic(x, y)
    assert np.allclose(got["weights"], w, atol=1e-6) and abs(got["bias"] - b) < 1e-6
    if n <= learners.FOLDS:
        hits = 0
        for k in range(n):
            seen = np.arange(n) != k
            w, b, mean, scale = plain_logistic(x[seen], y[seen])
            hits += ((x[k] - mean) / scale @ w + b >= 0) == (y[k] > 0.5)
        assert got["accuracy"] == hits / n
    assert got["active"] == (got["accuracy"] >= 0.8)
    assert n < 20 or got["active"] == (noise < 1)


def test_too_little_to_learn_from(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], 1.0)], "id long, x array<double>, y double")
    one = learners.logistic_model(rows, F.col("id"), F.col("x"), F.col("y"))
    assert one["rows"] == 1 and one["accuracy"] is None and not one["active"]
    assert learners.logistic_model(rows.where("false"), F.col("id"), F.col("x"), F.col("y"))["rows"] == 0
    none = learners.choice_model(rows.where("false"), F.col("id"), F.array("x"), F.lit(0), [1.0, 0.0])
    assert none["weights"] == [1.0, 0.0] and not none["active"]


def test_queries(spark):
    days = day_choices(spark, SF).orderBy("cap", "day").collect()
    got = {r.cap: r for r in registry.queries()["choice_learner"](spark, SF).collect()}
    assert set(got) == {r.cap for r in days} and all(got[c].days == sum(r.cap == c for r in days) for c in got)
    for cap in sorted(got)[:3]:
        own = [r for r in days if r.cap == cap]
        want = plain_choice([np.array(r.options) for r in own], [r.chosen for r in own], np.array(RULE))
        assert np.allclose([got[cap].value, got[cap].kill, got[cap].assist, got[cap].late], want, atol=2e-6)
    every = registry.queries()["library_choice_learner"](spark, SF).collect()
    assert every[0].days == len(days) and every[0].hits >= every[0].rule_hits
    gate = registry.queries()["quality_gate"](spark, SF).collect()
    assert [r.feature for r in gate] == ["length", "symbols", "lines", "shouting", "bias"] and gate[0].documents == spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null").count()


def test_preference_over_all_rows_equals_small_steps(spark):
    from momentis.operators import sequences

    rng = np.random.default_rng(2)
    for base, hidden, count, sharpness in (([0.4, 0.3, 0.2, 0.1], [0.1, 0.2, 0.6, 0.1], 60, 30.0), ([1.0, 1.0, 1.0], [9.0, 1.0, 0.01], 40, 30.0), ([0.5, 0.5], [0.5, 0.5], 12, 6.0)):
        choices = []
        for _ in range(count):
            x = rng.random((int(rng.integers(2, 6)), len(base)))
            chosen = int((x @ np.array(hidden)).argmax())
            x[rng.random(x.shape) < 0.1] = np.nan
            choices.append((x, chosen))
        rows = [([[None if np.isnan(v) else float(v) for v in r] for r in x], c) for x, c in choices]
        rows += [([[0.1] * len(base)], 0), (None, 0), ([[0.1] * len(base)] * 2, None), ([[0.1] * len(base)] * 2, 2)]
        frame = spark.createDataFrame(rows, "variants array<array<double>>, chosen int").repartition(3)
        got = learners.preference_model(frame, F.col("variants"), F.col("chosen"), base, sharpness)
        want = sequences.preference_weights(choices, np.array(base), 4000, 0.02, sharpness, 0.05)
        assert np.allclose(got["weights"], want, atol=1e-6), (got, want)
        assert got["choices"] == count and got["active"] and abs(sum(want) - sum(base)) < 0.5
        assert got["after"] == sequences.agreement(choices, want) and got["before"] == sequences.agreement(choices, np.array(base))
    few = learners.preference_model(frame.limit(5), F.col("variants"), F.col("chosen"), base)
    assert few["weights"] == base and not few["active"] and few["before"] == few["after"]


def test_sums_over_many_rows_equal_row_by_row_and_are_taken_together(monkeypatch):
    from momentis.operators import sequences

    rng = np.random.default_rng(9)
    rows = []
    for _ in range(60):
        n = int(rng.integers(2, 6))
        x = np.where(rng.random((n, 3)) < 0.2, np.nan, rng.random((n, 3)))
        rows.append((x, int(rng.integers(n))))
    task, w = learners.Preference(np.array([0.5, 0.3, 0.2]), 6.0, 0.001, 0.05), np.array([0.4, 0.35, 0.25])
    each = [task.sums([r], w) for r in rows]
    assert np.allclose(task.sums(rows, w), sum(each)) and task.agreed(rows, w) == sum(task.agreed([r], w) for r in rows)
    choice = learners.Choice(np.array([1.0, 0.0, 0.0]))
    options = [(k % 4, np.nan_to_num(x).tolist(), c) for k, (x, c) in enumerate(rows)]
    v = rng.random((5, 3))
    assert np.allclose(choice.sums(options, v), sum(choice.sums([r], v) for r in options))
    # A pass looks at rows of one size together, and a step of the weights at all pairs together.
    calls = []
    exp = np.exp
    monkeypatch.setattr(np, "exp", lambda *a, **b: calls.append(1) or exp(*a, **b))
    choice.sums(options, v), task.sums(rows, w), sequences.preference_weights(rows, task.base, 10, 0.05, 6.0, 0.001)
    assert len(calls) <= 4 + 4 + 10


def test_a_path_looked_at_as_a_whole_ends_where_single_steps_end():
    from momentis.plans.details import descent, path_sums

    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(3000), rng.normal(size=(3000, 3))])
    y = (x @ [0.5, 2.0, -4.0, 0.0] + rng.normal(size=3000) > 0).astype(float)
    w = np.zeros(4)
    for _ in range(500):
        w -= 0.5 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / 3000 + 0.1 / 3000 * w)
    passes = []
    got = descent(lambda path: passes.append(1) or path_sums(x, y, path) / 3000, 0.1 / 3000)
    assert np.abs(got - w).max() < 1e-9 and len(passes) < 30
