import random
import zlib

import numpy as np
import pytest

from momentis.llm import quality_classifier as qc

SF = "/root/testdata/sf0.01"


def area(scores, good):
    """Area under the ROC curve, by all pairs."""
    a, b = scores[good][:, None], scores[~good][None, :]
    return float(((a > b) + 0.5 * (a == b)).mean())


@pytest.fixture(scope="module")
def scored(spark):
    rows = qc.op12_quality_classifier(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    return rows, labels


def test_held_out_accuracy(spark, scored):
    rows, labels = scored
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= 0.3)).all() and rows.score.between(0, 1).all()
    both = rows[rows.held_out].merge(labels, on="doc_id")
    good = (both.quality == 1).to_numpy()
    assert area(both.score.to_numpy(), good) > 0.97
    assert (both.predicted == both.quality).mean() > 0.95


def test_labels_of_held_out_rows_and_negative_labels_are_not_read(spark, scored):
    """Other labels there leave all scores as they are, up to rounding."""
    rows, _ = scored
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    from pyspark.sql import functions as F

    other = labels.where("quality = 1").withColumn("quality", F.when(qc.held_out(F.col("doc_id")), 0).otherwise(F.col("quality")))
    again = qc.quality_scores(docs, other).toPandas().set_index("doc_id").score
    assert np.allclose(again.loc[rows.doc_id].to_numpy(), rows.score.to_numpy(), atol=1e-6)


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(1)
    p, n = rng.normal(1, 1, (40_000, 2)), rng.normal(-1.5, 1, (40_000, 2))
    for share in (0.3, 0.6, 0.9):
        u = np.concatenate([p[20_000:][: int(20_000 * share)], n[: int(20_000 * (1 - share))]])
        trusted = p[:20_000]
        first = qc.first_model(trusted.astype(np.float32), u.astype(np.float32))
        prior = qc.estimated_prior(qc.histogram(first.score(trusted)), qc.histogram(first.score(u)))
        assert abs(prior - share) < 0.06
        # The risk with this prior finds the mixture's halves without a single negative label.
        model = qc.fit(trusted.astype(np.float32), u.astype(np.float32), prior)
        good, bad = model.score(p[20_000:30_000:4]), model.score(n[20_000:30_000:4])
        assert area(np.concatenate([good, bad]), np.arange(len(good) + len(bad)) < len(good)) > 0.97
        assert good.mean() > 0.8 and bad.mean() < 0.4


def test_features_equal_a_plain_count():
    text = "Ab c!! 12|x\n\nÄß — „so“ 日本 #1.\n" * 3
    kinds = [int(qc._classes(c)[0]) for c in text]
    pairs = np.zeros((qc.KINDS, qc.KINDS))
    for a, b in zip([qc.LINE, *kinds], kinds, strict=False):
        pairs[a, b] += 1
    got = qc.features(text)
    assert np.allclose(got[: qc.KINDS**2], np.sqrt(pairs / len(text)).ravel(), atol=1e-6)
    assert not np.isnan(qc.measure(["", " ", "\n", "a", "\x00", "x" * 50])).any()


def test_pieces_of_a_very_long_text(monkeypatch):
    rng = random.Random(2)
    text = "".join(rng.choice("ab C.!\n|") for _ in range(5000))
    whole = qc.features(text)
    monkeypatch.setattr(qc, "PIECE", 7)
    assert (qc.features(text) == whole).all()


def test_odd_rows(spark):
    schema = "doc_id long, text string, held_out int, h string, x string, key int"
    rows = [(None, None), (1, ""), (1, ""), (2, "word " * 300_000), (3, "Good text. Well said."), (None, "a"), (4, None)]
    docs = spark.createDataFrame([(*r, 1, "b", "c", 2) for r in rows], schema)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (3, 1), (None, 1), (99, 1)], "doc_id long, quality int")
    got = qc.quality_scores(docs, labels).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == sorted((i is not None, i or 0) for i, _ in rows)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in qc.quality_scores(docs, labels.where("false")).collect()} == {0.5}
    assert qc.quality_scores(docs.where("false"), labels).count() == 0
