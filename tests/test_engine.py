"""The engine's stages and verbs."""

import pytest
from pyspark.sql import functions as F

from momentis import detectors
from momentis.engine import Engine, Profile
from momentis.functions.events import HOUR

SF = "/root/testdata/sf0.001"


def test_stages_can_be_replaced(spark, tmp_path):
    own = Engine(spark, SF)
    found = own.analyse(Profile(top=5)).collect()
    assert len(found) == 5 and min(r.score for r in found) >= 0.5 and all(r.place >= 1 for r in found)
    doubled = Engine(spark, SF, fuse=lambda rows, p: rows.groupBy("cap", "win").agg(F.lit(0.0).alias("total")))
    assert doubled.analyse().count() == 0
    last = Engine(spark, SF, plan=lambda rows, p: rows.withColumn("place", F.lit(0)))
    assert {r.place for r in last.analyse().collect()} == {0}
    assert own.export(str(tmp_path / "report"), Profile(top=3)).count() == 3


def test_verbs(spark):
    own = Engine(spark, SF)
    assert own.search(least_kills=2).count() > 0 and own.stats().count() > 0 and own.evaluate().count() > 0
    one = own.events().orderBy("cap", "t").first()
    assert own.clip(one.cap, one.t, HOUR).where(F.col("id") == one.id).count() == 1
    assert {r.kind for r in own.detect("outplayed-events").select("kind").distinct().collect()} == {"kill", "death", "support"}


def test_profiles_are_checked():
    for bad in ({"detector": "none"}, {"low": 0.9, "high": 0.5}, {"top": 0}):
        with pytest.raises(ValueError):
            Profile(**bad)
    with pytest.raises(ValueError, match="two detectors"):
        detectors.detector("killfeed")(lambda e: e)
    wanted = "audio-loudness voice-activity outplayed-events game-sounds audio-events hud-template killfeed killfeed-teams killfeed-headshot ammo-counter hud-counter hud-change round-score ocr-log".split()
    assert set(wanted) <= set(detectors.DETECTORS)
