"""Aggregates whose states merge, over whole captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from momentis.functions.events import HOUR, load_events
from momentis.operators import aggregates
from momentis.operators.keyed import per_key
from momentis.plans.moments import EV, H
from momentis.plans.registry import query


@query("gap_histogram", EV + f""", g AS (SELECT cap, t - lag(t) OVER (PARTITION BY cap ORDER BY t, id) AS gap FROM ev WHERE cap IS NOT NULL), b AS (SELECT cap, gap, CASE WHEN gap < {H} THEN 0 ELSE least(floor(log2(gap / {H})) + 1, 11) END AS bin FROM g WHERE gap IS NOT NULL)
 SELECT cap, CAST(bin AS BIGINT) AS bin, count(*) AS gaps, max(max(gap)) OVER (PARTITION BY cap) AS longest FROM b GROUP BY cap, bin""")  # fmt: skip
def gap_histogram(spark, sf_dir):
    """Gaps between a capture's events by powers of two of an hour, with the longest."""
    return aggregates.aggregate(load_events(spark, sf_dir), "cap", aggregates.Gaps(HOUR), ["t"], ["t", "id"])


@query("longest_streak", EV + """, r AS (SELECT cap, t, id, coalesce(kind, '') AS word, row_number() OVER (PARTITION BY cap ORDER BY t, id) - row_number() OVER (PARTITION BY cap, coalesce(kind, '') ORDER BY t, id) AS run FROM ev WHERE cap IS NOT NULL),
 s AS (SELECT cap, word, run, count(*) AS length, min(t) AS begins, min(id) AS id FROM r GROUP BY ALL) SELECT cap, word, length, begins FROM (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY length DESC, begins, id) AS n FROM s) z WHERE n = 1""")  # fmt: skip
def longest_streak(spark, sf_dir):
    """The longest run of events of one kind in each capture."""
    rows = load_events(spark, sf_dir).withColumn("word", F.coalesce("kind", F.lit("")))
    return aggregates.aggregate(rows, "cap", aggregates.Streak(), ["t", "word"], ["t", "id"])


@query("robust_spread", EV + """, b AS (SELECT cap, least(greatest(floor(v / 0.5), 0), 1023) AS c FROM ev WHERE v IS NOT NULL AND cap IS NOT NULL), m AS (SELECT cap, count(*) AS n, quantile_disc(c, 0.5) AS m FROM b GROUP BY cap)
 SELECT cap, n, m * 0.5 AS median, quantile_disc(abs(c - m), 0.5) * 0.5 AS deviation FROM b JOIN m USING (cap) GROUP BY cap, n, m""")  # fmt: skip
def robust_spread(spark, sf_dir):
    """Median and median deviation of each capture's values, to half a unit, from counts of cells that are added before anything travels."""
    fold = aggregates.Spread(0.5, 1024)
    v = F.col("v").cast("double")
    cell = F.least(F.greatest(F.floor(v / fold.step), F.lit(0)), F.lit(fold.cells - 1)).alias("cell")
    counts = load_events(spark, sf_dir).where(F.col("cap").isNotNull() & v.isNotNull() & ~F.isnan(v)).groupBy("cap", cell).agg(F.count("*").alias("n"))
    return per_key(counts, "cap", lambda g: fold.result((g.cell, g.n)), fold.columns, ["cell"])
