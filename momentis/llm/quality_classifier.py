"""Quality classifier by positive-unlabelled learning: trusted documents against web text, no negative label is ever read.

A text is measured as a whole: shares of neighbouring character classes (letters, digits, marks, line ends and so on), how its words and
lines repeat, and the same shares of its worst lines. A logistic model then minimises the non-negative unbiased risk

    prior * mean_P loss(+) + max(0, mean_U loss(-) - prior * mean_P loss(-))

over trusted positives P and unlabelled documents U of which a share `prior` is positive. Where the second part falls below zero, the
step goes against it alone, so the model can't gain by calling its own positives of U negative. The prior is estimated, too: a mixture
U = prior * P + (1 - prior) * N holds at least prior * P of every score range, so it is the least ratio of U's and P's tails
under a first model, each with a bound for chance; the histograms of that cover all rows. The score is the model's estimate of P(good).

Scale: one pass over the texts writes features (under 200 small numbers a document); all else reads these. Samples for the fit are those
with the least hashes, at most `SAMPLE` positives and as many unlabelled ones (documented bounds; they come to the driver as numbers, not
texts); tail histograms and scores cover all rows. Labels of positives are the only shuffle, on ids.

Null and empty texts get the features of an empty text and a score; very long texts are measured whole, in pieces of `PIECE` characters;
repeated rows are rows each; a document labelled both ways is not trusted; ids may be null (then without label and, as crc32 of an empty
text is 0, held out); without any positive the score is the prior's default 0.5; empty tables give an empty result; only doc_id, text
and the labels' doc_id and quality are read, so others may have any names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentis.llm.common import materialize, small_batches, strings

#: Positives, and unlabelled documents, that the model is fitted on at most.
SAMPLE = 8_000
THRESHOLD = 0.3
PIECE = 1 << 20
BINS = 1000
STEPS = 300
PENALTY = 1e-3
RATE = 0.1

LOWER, UPPER, LETTER, DIGIT, SPACE, LINE, STOP, COMMA, BAND, MARK, BRACKET, OTHER = range(12)
KINDS = 12


def _kinds() -> np.ndarray:
    """The class of every code point."""
    of = np.full(0x110000, OTHER, np.uint8)
    for k in range(0x110000):
        name = unicodedata.category(chr(k))
        if name == "Ll":
            of[k] = LOWER
        elif name in ("Lu", "Lt"):
            of[k] = UPPER
        elif name[0] in "LM":
            of[k] = LETTER
        elif name[0] == "N":
            of[k] = DIGIT
        elif name in ("Ps", "Pe", "Pi", "Pf"):
            of[k] = BRACKET
        elif name == "Zs":
            of[k] = SPACE
        elif name[0] == "S":
            of[k] = MARK
    for chars, kind in ((" \t", SPACE), ("\n\r\v\f", LINE), (".!?…。！？", STOP), (",;:-'’", COMMA), ("|\\/_~=<>", BAND), ("#*$%&@^+`", MARK), ('"«»„“”', BRACKET)):
        for c in chars:
            of[ord(c)] = kind
    return of


_table: list[np.ndarray] = []


def _classes(text: str) -> np.ndarray:
    if not _table:
        _table.append(_kinds())
    return _table[0][np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]


_OTHERS = 17
WIDTH = KINDS * KINDS + _OTHERS


def _share(a: float, b: float) -> float:
    return a / b if b else 0.0


def features(text: str) -> np.ndarray:
    """What the model sees of a text: roots of shares, all between 0 and about 1 but for two logarithms."""
    out = np.zeros(WIDTH, np.float32)
    pairs = np.zeros(KINDS * KINDS, np.int64)
    last = LINE
    for k in range(0, len(text), PIECE):
        own = _classes(text[k : k + PIECE]).astype(np.int64)
        pairs += np.bincount(np.concatenate([[last], own[:-1]]) * KINDS + own, minlength=KINDS * KINDS)
        last = int(own[-1])
    n = len(text)
    out[: KINDS * KINDS] = np.sqrt(pairs / max(n, 1))
    words = text.split()
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    w = len(words)
    distinct = set(words)
    # Neighbours in order of the text: no list of all pairs.
    same = sum(map(str.__eq__, words, words[1:]))
    two = len(set(zip(words, words[1:], strict=False)))
    by_kind = pairs.reshape(KINDS, KINDS).sum(0)
    letters = by_kind[LOWER] + by_kind[UPPER] + by_kind[LETTER]
    worst = [0.0] * 5
    for x in lines:
        if len(x) >= 20:
            upper = sum(map(str.isupper, x.split()))
            odd = x.count("|") + x.count("#") + x.count("*") + x.count("$") + x.count("%") + x.count("&")
            worst[0] = max(worst[0], upper / (x.count(" ") + 1))
            worst[1] = max(worst[1], odd / len(x))
            worst[2] = max(worst[2], x.count("!") / len(x))
            own = x.split()
            worst[3] = max(worst[3], 1 - len(set(own)) / max(len(own), 1))
            worst[4] = max(worst[4], len(max(own, key=len, default="")) / len(x))
    out[KINDS * KINDS :] = [
        np.log1p(n) / 10, np.log1p(w) / 10, np.sqrt(_share(same, w)), np.sqrt(_share(two, w - 1)) if w > 1 else 1.0, np.sqrt(_share(len(distinct), w)),
        np.sqrt(_share(len(set(lines)), len(lines))), np.sqrt(_share(by_kind[UPPER], letters)), _share(letters, n), _share(sum(map(len, words)), w) / 10,
        np.sqrt(_share(by_kind[MARK] + by_kind[BAND], n)), np.sqrt(_share(by_kind[STOP], w)), _share(len(lines), w) ** 0.5, *np.sqrt(worst),
    ]
    return out


def measure(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float32).reshape(-1, WIDTH)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid((x - self.mean) / self.scale @ self.weights + self.bias)


def _descend(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias by full gradients with momentum (Adam): of P against U if prior is None, else of the non-negative risk."""
    theta, m, v = (np.zeros(p.shape[1] + 1, np.float32) for _ in range(3))
    if prior is not None:
        theta[-1] = np.log(prior / (1 - prior))
    for t in range(1, steps + 1):
        sp, su = _sigmoid(p @ theta[:-1] + theta[-1]), _sigmoid(u @ theta[:-1] + theta[-1])
        # Gradients over the margins: of mean_P loss(+), mean_P loss(-) and mean_U loss(-).
        plus, minus, web = (sp - 1) / len(p), sp / len(p), su / len(u)
        if prior is None:
            gp, gu = plus / 2, web / 2
        else:
            negative = -np.log(np.clip(1 - su, 1e-12, 1)).mean() + prior * np.log(np.clip(1 - sp, 1e-12, 1)).mean()
            gp, gu = (prior * plus - prior * minus, web) if negative >= 0 else (prior * minus, -web)
        g = np.append(gp @ p + gu @ u, gp.sum() + gu.sum())
        g[:-1] += PENALTY * theta[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8) * min(1, 2 * (1 - t / (steps + 1)))
    return theta[:-1], float(theta[-1])


def estimated_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The least ratio of the shares of U and of P over a score, from histograms of both; tails hold so much of P that chance gives under 1 % or so."""
    over_p, over_u = (np.cumsum(x[::-1]) / max(x.sum(), 1) for x in (p, u))
    chance = np.sqrt(np.log(40) / 2)
    ratio = (over_u + chance / np.sqrt(max(u.sum(), 1)) / 2) / np.maximum(over_p - chance / np.sqrt(max(p.sum(), 1)) / 2, 1e-9)
    usable = over_p >= 0.2
    return float(np.clip(ratio[usable].min(), 0.05, 0.99))


def standard(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return u.mean(0), np.maximum(u.std(0), 1e-2)


def first_model(p: np.ndarray, u: np.ndarray) -> Model:
    """P against U, only for the order of its scores."""
    mean, scale = standard(u)
    return Model(mean, scale, *_descend((p - mean) / scale, (u - mean) / scale, None, STEPS // 2), 0.5)


def binned(scores: np.ndarray) -> np.ndarray:
    return np.minimum((scores * BINS).astype(np.int64), BINS - 1)


def histogram(scores: np.ndarray) -> np.ndarray:
    return np.bincount(binned(scores), minlength=BINS)


def fit(p: np.ndarray, u: np.ndarray, prior: float) -> Model:
    mean, scale = standard(u)
    return Model(mean, scale, *_descend((p - mean) / scale, (u - mean) / scale, prior), prior)


def held_out(key: Column) -> Column:
    """One of five ids, by a checksum: no label of these is read."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, held_out, a hash of the row and the features of the whole text."""
    small_batches(docs.sparkSession)
    own = F.col(f"`{key}`")
    rows = docs.select(own.alias("key"), held_out(own).alias("held_out"), F.xxhash64(own.cast("string"), F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = measure(strings(batch.column(3)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, WIDTH), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], lists], ["key", "held_out", "h", "x"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, held_out boolean, h long, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """(key, held_out, score) of measured rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(_matrix(batch.column(2))).astype(np.float64))], ["key", "held_out", "score"])

    return rows.select("key", "held_out", "x").mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, held_out boolean, score double")


def _sample(rows: DataFrame) -> np.ndarray:
    """The features of the rows with the least hashes, at most SAMPLE, in their order."""
    found = rows.orderBy("h").select("x").limit(SAMPLE).toArrow().column("x").combine_chunks()
    return _matrix(found)


def learned(rows: DataFrame, labels: DataFrame) -> Model | None:
    """The model of measured rows (written) and the labels (doc_id, quality); None without a positive or an unlabelled row outside the held-out part."""
    ids = F.col("doc_id")
    trusted = labels.where(ids.isNotNull() & ~held_out(ids)).groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("top")).where("q = 1 AND top = 1")
    trusted = materialize(trusted.select(ids.alias("id")))
    some = trusted.orderBy(F.xxhash64(F.col("id").cast("string"))).limit(SAMPLE)  # so many ids at most are broadcast
    web = rows.where(~F.col("held_out"))
    p, u = _sample(web.join(F.broadcast(some), F.col("key") == F.col("id"), "left_semi")), _sample(web)
    if not len(p):
        return None
    # Tails of the first model's scores over all rows: at most BINS rows come back.
    first = scored(web, first_model(p, u)).select("key", F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    known = first.join(trusted, F.col("key") == F.col("id"), "left").groupBy("bin").agg(F.count("*").alias("u"), F.count("id").alias("p")).collect()
    tails = np.zeros((2, BINS), np.int64)
    for r in known:
        tails[:, r["bin"]] = r["p"], r["u"]
    return fit(p, u, estimated_prior(*tails))


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, held_out and score, an estimate of the chance that it is good."""
    rows = materialize(measured(docs, key, text))
    model = learned(rows, labels)
    if model is None:
        model = Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, 0.5)
    return scored(rows, model).withColumnRenamed("key", key)


def op12_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("documents", "labels"))
    found = quality_scores(docs.select("doc_id", "text"), labels.select("doc_id", "quality"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
