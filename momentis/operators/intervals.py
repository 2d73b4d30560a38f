"""Islands and interval algebra as windows over sorted rows: one shuffle by key, no self joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, key: str, start: str, gap: int, end: str | None = None, ties: str = "id", into: str = "grp", breaks: Column | None = None) -> DataFrame:
    """rows with the number of their island: a distance over `gap` from all before, or `breaks`, opens a new one; equality merges."""
    own = Window.partitionBy(key).orderBy(start, ties)
    reach = F.max(end or start).over(own.rowsBetween(Window.unboundedPreceding, -1))
    fresh = reach.isNull() | (F.col(start) - reach > gap)
    if breaks is not None:
        fresh = fresh | F.coalesce(breaks, F.lit(False))
    marked = rows.withColumn("_fresh", fresh.cast("int"))
    return marked.withColumn(into, F.sum("_fresh").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def merge(rows: DataFrame, key: str, start: str = "s", end: str = "e", gap: int = 0) -> DataFrame:
    """Merged intervals (key, s, e); touching ones merge, and those up to `gap` apart."""
    return islands(rows, key, start, gap, end, ties=end).groupBy(key, "grp").agg(F.min(start).alias("s"), F.max(end).alias("e")).drop("grp")


def sweep(positive: DataFrame, holes: DataFrame, key: str) -> DataFrame:
    """Elementary pieces [p, n) of a key with the number of positive intervals and holes over them."""

    def edges(rows: DataFrame, a: int, b: int) -> DataFrame:
        both = F.array(F.struct(F.col("s").alias("p"), F.lit(a).alias("a"), F.lit(b).alias("b")), F.struct(F.col("e").alias("p"), F.lit(-a).alias("a"), F.lit(-b).alias("b")))
        return rows.where("s < e").select(key, F.inline(both))

    points = edges(positive, 1, 0).unionByName(edges(holes, 0, 1)).groupBy(key, "p").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    own = Window.partitionBy(key).orderBy("p")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    return points.select(key, "p", F.lead("p").over(own).alias("n"), F.sum("a").over(upto).alias("ca"), F.sum("b").over(upto).alias("cb")).where("n is not null")


def subtract(positive: DataFrame, holes: DataFrame, key: str) -> DataFrame:
    """Parts of the positive intervals outside the holes."""
    return merge(sweep(positive, holes, key).where("ca > 0 and cb = 0").select(key, F.col("p").alias("s"), F.col("n").alias("e")), key)


def covered_length(rows: DataFrame, key: str) -> DataFrame:
    """Length of the union of a key's intervals, from the furthest end before each."""
    own = Window.partitionBy(key).orderBy("s", "e")
    before = F.max("e").over(own.rowsBetween(Window.unboundedPreceding, -1))
    part = F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce(before, F.col("s"))))
    return rows.withColumn("part", part).groupBy(key).agg(F.sum("part").alias("covered"))


def bucketed_overlap(left: DataFrame, right: DataFrame, key: str, width: int, condition: Column) -> DataFrame:
    """Join of left intervals (ls, le) and right ones (rs, re) of one key through time buckets; each pair once."""

    def cells(rows: DataFrame, s: str, e: str) -> DataFrame:
        return rows.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width))))

    pairs = cells(left, "ls", "le").join(cells(right, "rs", "re"), [key, "_cell"]).where(condition)
    return pairs.where(F.col("_cell") == F.greatest(F.floor(F.col("ls") / width), F.floor(F.col("rs") / width))).drop("_cell")
