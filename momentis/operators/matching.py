"""Joins in time: existence, nearest, as-of, and one-to-one matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentis.operators.keyed import per_key


def near_events(left: DataFrame, right: DataFrame, before: int, after: int) -> DataFrame:
    """Pairs with right.t in [left.t - before, left.t + after], through buckets as wide as the window: an equi join with a residual."""
    width = before + after + 1
    l = left.select(F.col("cap"), F.col("id").alias("lid"), F.col("t").alias("lt"), F.explode(F.sequence(F.floor((F.col("t") - before) / width), F.floor((F.col("t") + after) / width))).alias("_cell"))
    r = right.select("cap", F.col("id").alias("rid"), F.col("t").alias("rt"), F.floor(F.col("t") / width).alias("_cell"))
    return l.join(r, ["cap", "_cell"]).where(F.col("rt").between(F.col("lt") - before, F.col("lt") + after)).drop("_cell")


def having(left: DataFrame, right: DataFrame, before: int, after: int, how: str = "left_semi") -> DataFrame:
    """Left events with (left_semi) or without (left_anti) a right event in their window."""
    hits = near_events(left, right, before, after).select(F.col("cap"), F.col("lid").alias("id")).distinct()
    return left.join(hits, ["cap", "id"], how)


def nearest(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """For each left event its nearest right one within the tolerance; the earlier of equals."""
    by = Window.partitionBy("cap", "lid").orderBy(F.abs(F.col("rt") - F.col("lt")), "rt", "rid")
    return near_events(left, right, tolerance, tolerance).withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


def as_of(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Left events with the last right value at or before them: a union and one window, no range join."""
    both = left.select("cap", "id", "t", F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias("_x")).unionByName(right.select("cap", "id", "t", F.lit(0).alias("_side"), F.col(value).alias("_x")))
    upto = Window.partitionBy("cap").orderBy("t", "_side", "id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("as_of", F.last("_x", ignorenulls=True).over(upto)).where("_side = 1").drop("_side", "_x")


def greedy_pairs(expected: DataFrame, found: DataFrame, tolerance: int, lead: int) -> DataFrame:
    """One-to-one matching by distance: expected - found in [-tolerance, max(tolerance, lead)]; nearest pairs first.

    Only candidates that share an event depend on each other, so each capture's candidates are one small group.
    """
    pairs = near_events(expected, found, max(tolerance, lead), tolerance)

    def match(group: pd.DataFrame) -> list[tuple]:
        left, right, out = set(), set(), []
        d = (group["lt"] - group["rt"]).abs().to_numpy()
        order = np.lexsort((group.rid, group.lid, group["rt"], group["lt"], d))
        for l, r, own in zip(group.lid.to_numpy()[order].tolist(), group.rid.to_numpy()[order].tolist(), d[order].tolist(), strict=True):
            if l not in left and r not in right:
                out.append((l, r, own))
                left.add(l)
                right.add(r)
        return out

    return per_key(pairs.select("cap", "lid", "lt", "rid", "rt"), "cap", match, {"lid": "long", "rid": "long", "d": "long"}, ["lt", "rt"])
