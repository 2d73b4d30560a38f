"""Entry points: detectors by name, replaceable stages, and the verbs analyse, search, statistics and evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentis.detectors import DETECTORS, detector
from momentis.functions.events import HOUR, load_events
from momentis.operators import grid, intervals, matching

@detector("window-max")
def window_max(events: DataFrame) -> DataFrame:
    return grid.expand(events).groupBy("cap", "kind", "win").agg(F.max("v").alias("raw"))


@detector("window-count")
def window_count(events: DataFrame) -> DataFrame:
    return grid.expand(events).groupBy("cap", "kind", "win").agg(F.count("*").cast("double").alias("raw"))


@dataclass(frozen=True)
class Profile:
    """Parameters of an analysis; checked before any plan is built."""

    detector: str = "window-max"
    weights: dict[str, float] = field(default_factory=lambda: {"kill": 0.7, "shot": 0.3, "assist": 0.2})
    low: float = 0.5
    high: float = 0.98
    threshold: float = 0.5
    gap_windows: int = 2
    top: int | None = None

    def __post_init__(self):
        if self.detector not in DETECTORS:
            raise ValueError(f"no detector is called {self.detector}")
        if not 0 <= self.low < self.high <= 1:
            raise ValueError("the low percentile must be below the high one")
        if self.gap_windows < 1 or (self.top is not None and self.top < 1):
            raise ValueError("gaps and limits are at least 1")

    def with_(self, **changes) -> Profile:
        return replace(self, **changes)


def islands_over(total: DataFrame, p: Profile) -> DataFrame:
    """Islands of windows over the profile's threshold."""
    hot = intervals.islands(total.where(F.col("total") >= p.threshold), "cap", "win", p.gap_windows, ties="win")
    return hot.groupBy("cap", "grp").agg(F.min("win").alias("first_win"), F.max("win").alias("last_win"), F.max("total").alias("score"))


def in_order(found: DataFrame, p: Profile) -> DataFrame:
    """The best moments, if the profile limits them, and their place in time."""
    best = found if p.top is None else found.orderBy(F.desc("score"), "cap", "first_win").limit(p.top)
    return best.withColumn("place", F.row_number().over(Window.partitionBy("cap").orderBy("first_win")))


@dataclass
class Engine:
    """Queries over a folder of tables; each stage can be replaced by a function of the same form."""

    spark: SparkSession
    folder: str
    normalise: Callable[[DataFrame, Profile], DataFrame] = lambda rows, p: grid.percentile_norm(rows, ["cap", "kind"], "raw", p.low, p.high)
    fuse: Callable[[DataFrame, Profile], DataFrame] = lambda rows, p: grid.fuse(rows.where(F.col("kind").isin(*p.weights)), p.weights)
    select: Callable[[DataFrame, Profile], DataFrame] = islands_over
    plan: Callable[[DataFrame, Profile], DataFrame] = in_order

    def events(self) -> DataFrame:
        return load_events(self.spark, self.folder)

    def detect(self, name: str) -> DataFrame:
        """What a detector makes of the events."""
        return DETECTORS[name](self.events())

    def score(self, profile: Profile = Profile()) -> DataFrame:
        """The fused total of every window."""
        return self.fuse(self.normalise(self.detect(profile.detector), profile), profile)

    def analyse(self, profile: Profile = Profile()) -> DataFrame:
        """Moments in the order of a plan."""
        return self.plan(self.select(self.score(profile), profile), profile)

    def export(self, path: str, profile: Profile = Profile()) -> DataFrame:
        """Moments written as a report, and read back."""
        self.analyse(profile).write.mode("overwrite").json(path)
        return self.spark.read.json(path)

    def clip(self, capture: int, at: int, reach: int = 12 * HOUR) -> DataFrame:
        """Events of a capture around an instant."""
        return self.events().where((F.col("cap") == capture) & F.col("t").between(at - reach, at + reach))

    def search(self, **terms) -> DataFrame:
        from momentis.plans.sessions import outcomes, search

        return search(outcomes(self.spark, self.folder), **terms)

    def stats(self) -> DataFrame:
        from momentis.plans.sessions import evenings

        return evenings(self.spark, self.folder)

    def evaluate(self, truth: str = "kill", found: str = "shot", tolerance: int = 3 * HOUR, lead: int = 12 * HOUR) -> DataFrame:
        """Matched pairs of expected and found events."""
        e = self.events()
        return matching.greedy_pairs(e.where(F.col("kind") == truth), e.where(F.col("kind") == found), tolerance, lead)
