"""Learners whose loss is a sum over rows: a model of all rows and one without each fold are fitted in the same passes.

A pass sums losses' slopes and curvatures where the rows lie, for all models at once (a row counts for each model but that of its own fold), and
adds the sums up in Spark; only these come to the driver: (folds + 1) x (2 + d + d²) numbers, whatever the rows. Newton steps from them, shorter where a step would raise the
loss, reach the minimum of a convex loss with a quadratic penalty in some ten passes, where small fixed steps need thousands. Up to `FOLDS` rows every row is its own fold, so what the
models say of their own folds is leave-one-out; beyond, rows are dealt to `FOLDS` folds by a hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentis.session import ship, written

FOLDS = 20
PASSES = 80
CLOSE = 1e-10


def by_size(rows: list[tuple], at: int) -> Iterator[list[tuple]]:
    """Rows whose lists in place `at` are of one length, together."""
    own: dict[int, list[tuple]] = {}
    for r in rows:
        own.setdefault(len(r[at]), []).append(r)
    yield from own.values()


class Choice:
    """Conditional choice: the chosen one of a row's options is the likeliest under softmax(sharpness x option · w); weights are drawn towards a rule."""

    def __init__(self, rule: np.ndarray, sharpness: float = 4.0, penalty: float = 0.02):
        self.rule, self.sharpness, self.penalty = np.asarray(rule, float), sharpness, penalty
        self.d = len(self.rule)

    def start(self) -> np.ndarray:
        return self.rule

    def weight(self) -> np.ndarray:
        return np.full(self.d, self.penalty)

    def sums(self, rows: list[tuple], w: np.ndarray) -> np.ndarray:
        """Numbers of rows, losses, slopes and curvatures, flat for each model; rows are (fold, options, chosen)."""
        m, d = w.shape
        out = np.zeros((m, 2 + d + d * d))
        for some in by_size(rows, 1):
            fold, x, chosen = np.array([r[0] for r in some]), np.array([r[1] for r in some], float), np.array([r[2] for r in some])
            n = len(some)
            z = self.sharpness * x @ w.T
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            loss = np.log(p.sum(axis=1)) - z[np.arange(n), chosen]
            # A row counts for each model but that of its own fold.
            counts = (fold[:, None] != np.arange(m)) | (np.arange(m) == m - 1)
            p *= (counts / p.sum(axis=1))[:, None, :]
            mean = np.einsum("nkm,nkd->mnd", p, x)
            flat = x.reshape(-1, d)
            squares = (p.reshape(-1, m).T @ (flat[:, :, None] * flat[:, None, :]).reshape(-1, d * d)).reshape(m, d, d)
            spread = squares - mean.transpose(0, 2, 1) @ mean
            slope = mean.sum(axis=1) - counts.T @ x[np.arange(n), chosen]
            out += np.column_stack([counts.sum(axis=0), (loss * counts).sum(axis=0), self.sharpness * slope, self.sharpness**2 * spread.reshape(m, -1)])
        return out

    def right(self, row: tuple, w: np.ndarray) -> bool:
        """Whether a model finds the choice; the first of equals."""
        return int(np.argmax(np.round(np.asarray(row[1], float) @ w, 12))) == row[2]


class Logistic:
    """Logistic regression of 0 and 1 on columns standardised by the rows that a model sees; the last weight is the bias and free of penalty."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, penalty: float = 0.1):
        """mean and scale: of each model's rows."""
        self.mean, self.scale, self.penalty = mean, scale, penalty
        self.d = mean.shape[1] + 1

    def start(self) -> np.ndarray:
        return np.zeros(self.d)

    @property
    def rule(self) -> np.ndarray:
        return np.zeros(self.d)

    def weight(self) -> np.ndarray:
        return np.append(np.full(self.d - 1, self.penalty), 0.0)

    def columns(self, x: np.ndarray, k: int) -> np.ndarray:
        return np.column_stack([(x - self.mean[k]) / self.scale[k], np.ones(len(x))])

    def sums(self, rows: list[tuple], w: np.ndarray) -> np.ndarray:
        """rows are (fold, x, y)."""
        m, d = w.shape
        out = np.zeros((m, 2 + d + d * d))
        if not rows:
            return out
        folds, x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
        for k in range(m):
            seen = folds != k if k < m - 1 else np.ones(len(rows), bool)
            z = self.columns(x[seen], k)
            margin = z @ w[k]
            p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
            loss = np.logaddexp(0, margin) - y[seen] * margin
            out[k] = np.concatenate([[seen.sum(), loss.sum()], z.T @ (p - y[seen]), (z.T @ (z * (p * (1 - p))[:, None])).ravel()])
        return out

    def right(self, row: tuple, w: np.ndarray) -> bool:
        k = row[0]
        return bool((self.columns(np.asarray(row[1], float)[None], k)[0] @ w >= 0) == (row[2] > 0.5))


def fitted(task, folds: int, total: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The weights of the models without each fold and, last, of all rows; total(w) gives the sums over all rows at weights w."""
    pull = task.weight()
    best = np.tile(task.start(), (folds + 1, 1)).astype(float)
    damping = np.full(folds + 1, 1e-3)
    w, low = best, None
    for _ in range(PASSES):
        s = total(w)
        n = np.maximum(s[:, 0], 1)
        loss = s[:, 1] / n + (pull * (w - task.rule) ** 2).sum(axis=1) / 2
        slope = s[:, 2 : 2 + task.d] / n[:, None] + pull * (w - task.rule)
        curve = s[:, 2 + task.d :].reshape(-1, task.d, task.d) / n[:, None, None] + np.diag(pull)
        if low is None:
            low, slopes, curves = loss, slope, curve
        else:
            # What didn't raise the loss (but for rounding) holds; the others try a shorter step from where they were.
            fine = loss <= low + 1e-13 * np.abs(low)
            damping = np.where(fine, damping / 10, damping * 10)
            best, low = np.where(fine[:, None], w, best), np.where(fine, loss, low)
            slopes, curves = np.where(fine[:, None], slope, slopes), np.where(fine[:, None, None], curve, curves)
        damped = curves + (damping[:, None] * np.trace(curves, axis1=1, axis2=2)[:, None] / task.d + 1e-14)[:, :, None] * np.eye(task.d)
        step = np.linalg.solve(damped, slopes[:, :, None])[:, :, 0]
        if np.abs(step).max() < CLOSE:
            break
        w = best - step
    return best


def fitted_here(task, rows: list[tuple], folds: int) -> np.ndarray:
    """The same for rows in one task."""
    return fitted(task, folds, lambda w: task.sums(rows, w))


def summed(rows: DataFrame, size: int, fn: Callable[[list[tuple]], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what fn gives for some, `size` numbers."""
    ship(rows.sparkSession)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            cells = batch.to_pydict()
            total += np.asarray(fn(list(zip(*(cells[n] for n in names), strict=True)))).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], ["k", "v"])

    found = np.zeros(size)
    for r in rows.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        found[r.k] = r.v
    return found


def with_folds(rows: DataFrame, key: Column, n: int) -> tuple[DataFrame, int]:
    """rows with `fold`, and the number of folds; n: the number of rows."""
    if n <= FOLDS:
        return rows.withColumn("fold", (F.row_number().over(Window.orderBy(key)) - 1).cast("long")), max(n, 1)
    return rows.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(FOLDS))), FOLDS


def fit_all(task, rows: DataFrame, folds: int) -> tuple[np.ndarray, int]:
    """Weights over written rows (fold, ...), and how many rows the models without their folds get right."""
    shape = (folds + 1, 2 + task.d + task.d**2)
    w = fitted(task, folds, lambda w: summed(rows, shape[0] * shape[1], lambda some: task.sums(some, w)).reshape(shape))
    hits = summed(rows, 1, lambda some: np.array([sum(task.right(r, w[r[0]]) for r in some)]))
    return w, int(hits[0])


def logistic_model(rows: DataFrame, key: Column, x: Column, y: Column, penalty: float = 0.1, least: int = 8, least_of_each: int = 3, accuracy: float = 0.8) -> dict:
    """A logistic model over all rows, with the share of rows that models without them get right; active with enough rows of each kind and that share at `accuracy`."""
    own = rows.select(key.alias("_key"), x.alias("x"), y.cast("double").alias("y")).where("y is not null")
    n, ones, d = own.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0)), F.max(F.size("x"))).first()
    if not n:
        return {"weights": [], "bias": 0.0, "rows": 0, "accuracy": None, "active": False}
    own, folds = with_folds(own, F.col("_key"), n)
    own = written(own.select("fold", "x", "y"))

    def parts(some: list[tuple]) -> np.ndarray:
        out = np.zeros((folds + 1, 1 + 2 * d))
        for fold, v, _ in some:
            v = np.asarray(v, float)
            one = np.concatenate([[1.0], v, v * v])
            out += one
            if fold < folds:
                out[fold] -= one
        return out

    s = summed(own, (folds + 1) * (1 + 2 * d), parts).reshape(folds + 1, -1)
    count = np.maximum(s[:, :1], 1)
    mean = s[:, 1 : 1 + d] / count
    scale = np.sqrt(np.maximum(s[:, 1 + d :] / count - mean**2, 0))
    task = Logistic(mean, np.where(scale > 1e-9, scale, 1.0), penalty)
    w, hits = fit_all(task, own, folds)
    share = hits / n if n >= 2 and 0 < ones < n else None
    active = n >= least and ones >= least_of_each and n - ones >= least_of_each and share is not None and share >= accuracy
    return {"weights": w[-1][:-1].tolist(), "bias": float(w[-1][-1]), "mean": mean[-1].tolist(), "scale": task.scale[-1].tolist(), "rows": n, "accuracy": share, "active": active}


def choice_model(rows: DataFrame, key: Column, options: Column, chosen: Column, rule: list[float], sharpness: float = 4.0, penalty: float = 0.02, least: int = 6) -> dict:
    """A choice model over all rows with at least one option, drawn towards the rule's weights; active if the models without a row find more choices than the rule does."""
    own = rows.select(key.alias("_key"), options.alias("options"), chosen.cast("long").alias("chosen"))
    n = own.count()
    task = Choice(np.array(rule), sharpness, penalty)
    if not n:
        return {"weights": list(rule), "rows": 0, "hits": 0, "rule_hits": 0, "active": False}
    own, folds = with_folds(own, F.col("_key"), n)
    own = written(own.select("fold", "options", "chosen"))
    w, hits = fit_all(task, own, folds)
    by_rule = int(summed(own, 1, lambda some: np.array([sum(task.right(r, task.rule) for r in some)]))[0])
    return {"weights": w[-1].tolist(), "rows": n, "hits": hits, "rule_hits": by_rule, "active": n >= least and hits > by_rule}


class Preference:
    """Weights of criteria under which the chosen variant of a choice scores above its others: ln(1 + exp(-sharpness * difference)) over pairs; a score is the weighted mean of the criteria that aren't null."""

    def __init__(self, base: np.ndarray, sharpness: float, penalty: float, rate: float):
        self.base, self.sharpness, self.penalty, self.rate = np.asarray(base, float), sharpness, penalty, rate
        self.d = len(self.base)

    def scores(self, x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each variant's score, and how it moves with each weight."""
        known = ~np.isnan(x)
        x, under = np.where(known, x, 0.0), np.maximum(known @ w, 1e-12)
        score = x @ w / under
        return score, np.where(known, x - score[..., None], 0.0) / under[..., None]

    def sums(self, rows: list[tuple], w: np.ndarray) -> np.ndarray:
        """Pairs, slopes and curvatures (of the scores' linear part); rows are (variants, chosen)."""
        out = np.zeros(1 + self.d + self.d**2)
        for some in by_size(rows, 0):
            chosen, each = np.array([r[1] for r in some]), np.arange(len(some))
            score, moves = self.scores(np.array([r[0] for r in some], float), w)
            apart = (moves[each, chosen][:, None] - moves).reshape(-1, self.d)
            wrong = 1 / (1 + np.exp(np.clip(self.sharpness * (score[each, chosen][:, None] - score), -500, 500)))
            # The chosen one is no pair with itself; its distance is 0 in any case.
            wrong[each, chosen] = 0
            wrong = wrong.ravel()
            curve = apart.T @ (apart * (self.sharpness**2 * wrong * (1 - wrong))[:, None])
            out += np.concatenate([[len(wrong) - len(some)], -self.sharpness * wrong @ apart, curve.ravel()])
        return out

    def agreed(self, rows: list[tuple], w: np.ndarray) -> int:
        """Choices whose chosen variant alone scores highest."""
        hits = 0
        for some in by_size(rows, 0):
            chosen, each = np.array([r[1] for r in some]), np.arange(len(some))
            score = self.scores(np.array([r[0] for r in some], float), w)[0]
            top = score[each, chosen].copy()
            score[each, chosen] = -np.inf
            hits += int((score.max(axis=1) < top).sum())
        return hits

    def moved(self, w: np.ndarray, slope: np.ndarray) -> np.ndarray:
        """A step down, within a quarter of the base and four times it, and with the base's sum."""
        low, high = self.base / 4, self.base * 4
        w = np.clip(w - self.rate * (slope + 2 * self.penalty * (w - self.base) / self.base**2), low, high)
        return np.clip(w * self.base.sum() / w.sum(), low, high)


def settled(task: Preference, total: Callable[[np.ndarray], np.ndarray], steps: int = 2000) -> np.ndarray:
    """Where the task's steps come to rest. Each pass over the rows gives slopes and curvatures, from which the driver takes all steps; only where they end is looked at anew.

    A pass whose end lies further from rest than its start is taken back by half.
    """
    w, best, least = task.base.copy(), task.base.copy(), np.inf
    for _ in range(PASSES):
        s = total(w)
        n = max(s[0], 1)
        slope, curve = s[1 : 1 + task.d] / n, s[1 + task.d :].reshape(task.d, task.d) / n
        unrest = float(np.abs(task.moved(w, slope) - w).max())
        if unrest > least and np.abs(w - best).max() > CLOSE:
            w = (w + best) / 2
            continue
        best, least = w, unrest
        if unrest < CLOSE * task.rate:
            break
        at = w
        for _ in range(steps):
            after = task.moved(at, slope + curve @ (at - w))
            done = np.abs(after - at).max() < 1e-15
            at = after
            if done:
                break
        w = at
    return best


def preference_model(rows: DataFrame, variants: Column, chosen: Column, base: list[float], sharpness: float = 30.0, penalty: float = 0.05, rate: float = 0.02, least: int = 10) -> dict:
    """Weights over all choices of two variants or more, kept near the base by a penalty; the base itself with fewer than `least` choices. With the shares of choices that both agree with."""
    own = written(rows.select(variants.alias("variants"), chosen.cast("long").alias("chosen")).where("size(variants) >= 2 and chosen between 0 and size(variants) - 1"))
    n, task = own.count(), Preference(np.array(base), sharpness, penalty, rate)
    w = task.base
    if n >= least:
        w = settled(task, lambda w: summed(own, 1 + task.d + task.d**2, lambda some: task.sums(some, w)))
    before, after = summed(own, 2, lambda some: np.array([task.agreed(some, task.base), task.agreed(some, w)])) / max(n, 1)
    return {"weights": w.tolist(), "choices": n, "before": float(before), "after": float(after), "active": n >= least}
