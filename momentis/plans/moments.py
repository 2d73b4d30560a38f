"""Queries over the grid: signals, normalisation, fusion and the moments they give; intervals and joins in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentis.functions.events import DAY, HOUR, TOTAL, load_events, rounded
from momentis.operators import grid, intervals, matching
from momentis.plans.registry import query

EV = """WITH ev AS (SELECT user_id AS cap, event_id AS id, epoch_us(ts) - 1704067200000000 AS t, CASE event_type WHEN 'purchase' THEN 'kill' WHEN 'error' THEN 'death'
 WHEN 'signup' THEN 'headshot' WHEN 'click' THEN 'shot' WHEN 'view' THEN 'assist' END AS kind, value AS v, props FROM events)"""
H = 3_600_000_000
#: Closed windows of 24 h every 12 h over 30 days.
GRID = f""", g AS (SELECT e.*, w.win FROM ev e, unnest(generate_series(CAST(greatest(ceil((t - {24 * H}) / {12 * H}.0 - 1e-9), 0) AS BIGINT), CAST(least(floor(t / {12 * H}.0 + 1e-9), 59) AS BIGINT))) AS w(win)
 WHERE t BETWEEN 0 AND {720 * H})"""
SIGNAL = GRID + ", sig AS (SELECT cap, kind, win, max(v) AS raw FROM g GROUP BY ALL)"
NORM = SIGNAL + """, b AS (SELECT cap, kind, quantile_cont(raw, 0.5) AS lo, quantile_cont(raw, 0.98) AS hi FROM sig GROUP BY ALL),
 nrm AS (SELECT sig.*, CASE WHEN greatest(hi - lo, 10.0) <= 1e-12 THEN 0 ELSE least(greatest((raw - lo) / greatest(hi - lo, 10.0), 0.0), 1.0) END AS norm FROM sig JOIN b USING (cap, kind))"""
WEIGHTS = {"kill": 0.7, "shot": 0.3, "assist": 0.2}
FUSED = NORM + """, w AS (SELECT *, CASE kind WHEN 'kill' THEN 0.7::DOUBLE WHEN 'shot' THEN 0.3::DOUBLE WHEN 'assist' THEN 0.2::DOUBLE END AS w FROM nrm),
 fused AS (SELECT cap, win, floor(coalesce(sum(w * norm) / nullif(sum(w), 0), 0) * 10000 + 0.5) / 10000 AS total FROM w WHERE w IS NOT NULL GROUP BY ALL)"""


def signals(spark, sf_dir: str) -> DataFrame:
    return grid.expand(load_events(spark, sf_dir)).groupBy("cap", "kind", "win").agg(F.max("v").alias("raw"))


def normalised(spark, sf_dir: str) -> DataFrame:
    return grid.percentile_norm(signals(spark, sf_dir), ["cap", "kind"], "raw")


def fused(spark, sf_dir: str) -> DataFrame:
    return grid.fuse(normalised(spark, sf_dir).where(F.col("kind").isin(*WEIGHTS)), WEIGHTS)


@query("grid_window_max", EV + SIGNAL + " SELECT cap, kind, win, raw FROM sig")
def grid_window_max(spark, sf_dir):
    return signals(spark, sf_dir)


@query("percentile_norm", EV + NORM + " SELECT cap, kind, win, round(norm, 6) AS norm FROM nrm")
def percentile_norm(spark, sf_dir):
    return normalised(spark, sf_dir).select("cap", "kind", "win", F.round("norm", 6).alias("norm"))


@query("local_contrast", EV + SIGNAL + """ SELECT cap, kind, win, round(0.7 * (raw - quantile_cont(raw, 0.5) OVER (PARTITION BY cap, kind ORDER BY win ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING))
 + (1 - 0.7) * (raw - quantile_cont(raw, 0.5) OVER (PARTITION BY cap, kind)), 4) AS contrast FROM sig""")  # fmt: skip
def local_contrast(spark, sf_dir):
    return grid.local_contrast(signals(spark, sf_dir), ["cap", "kind"], "win", "raw").select("cap", "kind", "win", F.round("contrast", 4).alias("contrast"))


@query("weighted_fusion", EV + FUSED + " SELECT cap, win, total FROM fused")
def weighted_fusion(spark, sf_dir):
    return fused(spark, sf_dir)


GATED = FUSED + """, boost AS (SELECT cap, win, sum(CASE kind WHEN 'kill' THEN 0.8 WHEN 'headshot' THEN 0.5 ELSE 0.1 END) AS b FROM g WHERE kind IN ('kill', 'headshot') GROUP BY ALL),
 gate AS (SELECT cap, win, least(greatest(norm, 0.0), 1.0) AS gate FROM nrm WHERE kind = 'assist'),
 gated AS (SELECT f.cap, f.win, gate, floor(greatest((total + coalesce(b, 0)) * coalesce(gate, 1), 0) * 10000 + 0.5) / 10000 AS total FROM fused f LEFT JOIN boost USING (cap, win) LEFT JOIN gate USING (cap, win))"""


def gated(spark, sf_dir: str) -> DataFrame:
    """Fused totals with event boosts, multiplied by a gate: totals, boosts and gate come from one pass over the signals."""
    cells = grid.expand(load_events(spark, sf_dir)).groupBy("cap", "kind", "win").agg(F.max("v").alias("raw"), F.count("*").alias("n"))
    norm = grid.percentile_norm(cells, ["cap", "kind"], "raw")
    weight = F.lit(None).cast("double")
    for kind, w in WEIGHTS.items():
        weight = F.when(F.col("kind") == kind, w).otherwise(weight)
    boost = F.when(F.col("kind") == "kill", 0.8).when(F.col("kind") == "headshot", 0.5) * F.col("n")
    gate = F.when(F.col("kind") == "assist", F.least(F.greatest("norm", F.lit(0.0)), F.lit(1.0)))
    rows = norm.withColumns({"w": weight, "b": boost, "g": gate}).groupBy("cap", "win").agg(
        F.sum(F.col("w") * F.col("norm")).alias("wn"), F.sum("w").alias("w"), F.sum("b").alias("b"), F.min("g").alias("gate")
    )
    mean = rounded(F.coalesce(F.col("wn") / F.nullif("w", F.lit(0.0)), F.lit(0.0)), 4)
    total = F.greatest((mean + F.coalesce("b", F.lit(0.0))) * F.coalesce("gate", F.lit(1.0)), F.lit(0.0))
    return rows.where("w is not null").select("cap", "win", "gate", rounded(total, 4).alias("total"))


@query("boost_gate_fusion", EV + GATED + " SELECT cap, win, total FROM gated")
def boost_gate_fusion(spark, sf_dir):
    return gated(spark, sf_dir).select("cap", "win", "total")


@query("excluded_ranges", EV + GATED + f""", bad AS (SELECT cap, win, win - row_number() OVER (PARTITION BY cap ORDER BY win) AS run FROM gated WHERE gate < 0.5)
 SELECT cap, min(win) * {12 * H} AS s, least(max(win) * {12 * H} + {24 * H}, {720 * H}) AS e FROM bad GROUP BY cap, run""")  # fmt: skip
def excluded_ranges(spark, sf_dir):
    """Runs of windows that the gate closes."""
    run = F.col("win") - F.row_number().over(Window.partitionBy("cap").orderBy("win"))
    runs = gated(spark, sf_dir).where("gate < 0.5").withColumn("run", run).groupBy("cap", "run").agg(F.min("win").alias("a"), F.max("win").alias("b"))
    return runs.select("cap", (F.col("a") * grid.HOP).alias("s"), F.least(F.col("b") * grid.HOP + grid.SIZE, F.lit(TOTAL)).alias("e"))


ISLANDS = FUSED + f""", hot AS (SELECT cap, win, total, CASE WHEN lag(win) OVER o IS NULL OR (win - lag(win) OVER o) > 2 THEN 1 ELSE 0 END AS f FROM fused WHERE total >= 0.5 WINDOW o AS (PARTITION BY cap ORDER BY win)),
 grp AS (SELECT *, sum(f) OVER (PARTITION BY cap ORDER BY win) AS grp FROM hot),
 moments AS (SELECT cap, CAST(grp AS BIGINT) AS grp, min(win) AS first_win, max(win) AS last_win, max(total) AS score, min(win) FILTER (WHERE total = m) AS peak_win FROM (SELECT *, max(total) OVER (PARTITION BY cap, grp) AS m FROM grp) GROUP BY cap, grp)"""


def moments(spark, sf_dir: str) -> DataFrame:
    """Islands of windows over the threshold, with the first best window of each."""
    hot = intervals.islands(fused(spark, sf_dir).where("total >= 0.5"), "cap", "win", 2, ties="win")
    best = F.min_by("win", F.struct(-F.col("total"), F.col("win")))
    return hot.groupBy("cap", "grp").agg(F.min("win").alias("first_win"), F.max("win").alias("last_win"), F.max("total").alias("score"), best.alias("peak_win"))


@query("threshold_islands", EV + ISLANDS + " SELECT cap, grp, first_win, last_win, score, peak_win FROM moments")
def threshold_islands(spark, sf_dir):
    return moments(spark, sf_dir)


@query("event_islands", EV + f""", k AS (SELECT cap, id, t, CASE WHEN t - lag(t) OVER (PARTITION BY cap ORDER BY t, id) <= {12 * H} THEN 0 ELSE 1 END AS f FROM ev WHERE kind = 'kill'),
 g AS (SELECT *, sum(f) OVER (PARTITION BY cap ORDER BY t, id) AS grp FROM k) SELECT cap, CAST(grp AS BIGINT) AS grp, min(t) AS s, max(t) AS e, count(*) AS n FROM g GROUP BY cap, grp""")  # fmt: skip
def event_islands(spark, sf_dir):
    kills = load_events(spark, sf_dir).where("kind = 'kill'")
    return intervals.islands(kills, "cap", "t", 12 * HOUR).groupBy("cap", "grp").agg(F.min("t").alias("s"), F.max("t").alias("e"), F.count("*").alias("n"))


@query("streak_labels", EV + f""", k AS (SELECT cap, id, t, CASE WHEN t - lag(t) OVER (PARTITION BY cap ORDER BY t, id) <= {12 * H} THEN 0 ELSE 1 END AS f FROM ev WHERE kind = 'kill'),
 g AS (SELECT *, sum(f) OVER (PARTITION BY cap ORDER BY t, id) AS grp FROM k), n AS (SELECT *, row_number() OVER (PARTITION BY cap, grp ORDER BY t, id) AS n FROM g)
 SELECT cap, id, CAST(n AS BIGINT) AS n FROM n WHERE n > 1""")  # fmt: skip
def streak_labels(spark, sf_dir):
    """The count of a streak, from its second event on."""
    kills = intervals.islands(load_events(spark, sf_dir).where("kind = 'kill'"), "cap", "t", 12 * HOUR)
    n = F.row_number().over(Window.partitionBy("cap", "grp").orderBy("t", "id"))
    return kills.withColumn("n", n.cast("long")).where("n > 1").select("cap", "id", "n")


def spans(spark, sf_dir: str, kinds: str, before: int, after: int) -> DataFrame:
    """Intervals around events of some kinds, within the capture."""
    e = load_events(spark, sf_dir).where(f"kind in ({kinds})")
    return e.select("cap", "id", F.greatest(F.col("t") - before, F.lit(0)).alias("s"), F.least(F.col("t") + after, F.lit(TOTAL)).alias("e"))


SPANS = f""", pos AS (SELECT cap, id, greatest(t - {4 * H}, 0) AS s, least(t + {8 * H}, {720 * H}) AS e FROM ev WHERE kind IN ('kill', 'shot')),
 hole AS (SELECT cap, id, greatest(t - {2 * H}, 0) AS s, least(t + {2 * H}, {720 * H}) AS e FROM ev WHERE kind = 'death')"""
MERGED = SPANS + """, mk AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY cap ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM pos),
 mg AS (SELECT *, sum(f) OVER (PARTITION BY cap ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM mk), merged AS (SELECT cap, min(s) AS s, max(e) AS e FROM mg GROUP BY cap, grp)"""


def positive(spark, sf_dir):
    return spans(spark, sf_dir, "'kill', 'shot'", 4 * HOUR, 8 * HOUR)


def holes(spark, sf_dir):
    return spans(spark, sf_dir, "'death'", 2 * HOUR, 2 * HOUR)


@query("merge_intervals", EV + MERGED + " SELECT cap, s, e FROM merged")
def merge_intervals(spark, sf_dir):
    return intervals.merge(positive(spark, sf_dir), "cap")


SWEEP = """, ed AS (SELECT cap, s AS p, 1 AS a, 0 AS b FROM {0} UNION ALL SELECT cap, e, -1, 0 FROM {0} UNION ALL SELECT cap, s, 0, 1 FROM {1} UNION ALL SELECT cap, e, 0, -1 FROM {1}),
 pt AS (SELECT cap, p, sum(a) AS a, sum(b) AS b FROM ed GROUP BY ALL), sw AS (SELECT cap, p, lead(p) OVER o AS n, sum(a) OVER o AS ca, sum(b) OVER o AS cb FROM pt WINDOW o AS (PARTITION BY cap ORDER BY p)),
 pc AS (SELECT cap, p, n, CASE WHEN lag(n) OVER (PARTITION BY cap ORDER BY p) = p THEN 0 ELSE 1 END AS f FROM sw WHERE ca > 0 AND cb = 0 AND n IS NOT NULL),
 pg AS (SELECT *, sum(f) OVER (PARTITION BY cap ORDER BY p) AS grp FROM pc) SELECT cap, min(p) AS s, max(n) AS e FROM pg GROUP BY cap, grp"""


@query("subtract_intervals", EV + SPANS + SWEEP.format("pos", "hole"))
def subtract_intervals(spark, sf_dir):
    return intervals.subtract(positive(spark, sf_dir), holes(spark, sf_dir), "cap")


@query("complement_intervals", EV + SPANS + f", whole AS (SELECT DISTINCT cap, 0 AS s, {720 * H} AS e FROM ev)" + SWEEP.format("whole", "pos"))
def complement_intervals(spark, sf_dir):
    whole = load_events(spark, sf_dir).select("cap").distinct().select("cap", F.lit(0).cast("long").alias("s"), F.lit(TOTAL).cast("long").alias("e"))
    return intervals.subtract(whole, positive(spark, sf_dir), "cap")


@query("covered_length", EV + MERGED + " SELECT cap, CAST(sum(e - s) AS BIGINT) AS covered FROM merged GROUP BY cap")
def covered_length(spark, sf_dir):
    return intervals.covered_length(positive(spark, sf_dir), "cap")


@query("longest_gap", EV + f" SELECT cap, max(coalesce(lead, {720 * H}) - t) AS lull FROM (SELECT cap, t, lead(t) OVER (PARTITION BY cap ORDER BY t, id) AS lead FROM ev) GROUP BY cap")
def longest_gap(spark, sf_dir):
    after = F.lead("t").over(Window.partitionBy("cap").orderBy("t", "id"))
    return load_events(spark, sf_dir).withColumn("gap", F.coalesce(after, F.lit(TOTAL)) - F.col("t")).groupBy("cap").agg(F.max("gap").alias("lull"))


@query("headshot_semi_join", EV + f" SELECT cap, id, t FROM ev k WHERE kind = 'kill' AND EXISTS (SELECT 1 FROM ev h WHERE h.cap = k.cap AND h.kind = 'headshot' AND h.t BETWEEN k.t - {2 * H} AND k.t + {2 * H})")
def headshot_semi_join(spark, sf_dir):
    e = load_events(spark, sf_dir)
    return matching.having(e.where("kind = 'kill'"), e.where("kind = 'headshot'"), 2 * HOUR, 2 * HOUR).select("cap", "id", "t")


@query("death_anti_join", EV + f" SELECT cap, id, t FROM ev k WHERE kind = 'kill' AND NOT EXISTS (SELECT 1 FROM ev d WHERE d.cap = k.cap AND d.kind = 'death' AND d.t BETWEEN k.t - {H} AND k.t + {6 * H})")
def death_anti_join(spark, sf_dir):
    e = load_events(spark, sf_dir)
    return matching.having(e.where("kind = 'kill'"), e.where("kind = 'death'"), HOUR, 6 * HOUR, "left_anti").select("cap", "id", "t")


@query("nearest_match", EV + f""", c AS (SELECT k.cap, k.id AS lid, h.id AS rid, k.t AS lt, h.t AS rt, row_number() OVER (PARTITION BY k.cap, k.id ORDER BY abs(h.t - k.t), h.t, h.id) AS n FROM ev k JOIN ev h
 ON h.cap = k.cap AND h.kind = 'headshot' AND k.kind = 'kill' AND abs(h.t - k.t) <= {12 * H}) SELECT cap, lid, rid, lt, rt FROM c WHERE n = 1""")  # fmt: skip
def nearest_match(spark, sf_dir):
    e = load_events(spark, sf_dir)
    return matching.nearest(e.where("kind = 'kill'"), e.where("kind = 'headshot'"), 12 * HOUR)


@query("asof_score", EV + """, x AS (SELECT *, last_value(CASE WHEN kind = 'shot' THEN v END IGNORE NULLS) OVER (PARTITION BY cap ORDER BY t, CASE WHEN kind = 'shot' THEN 0 ELSE 1 END, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS as_of
 FROM ev WHERE kind IN ('kill', 'shot')) SELECT cap, id, t, as_of FROM x WHERE kind = 'kill'""")  # fmt: skip
def asof_score(spark, sf_dir):
    e = load_events(spark, sf_dir)
    return matching.as_of(e.where("kind = 'kill'"), e.where("kind = 'shot'"), "v")


OVERLAP = ", pr AS (SELECT p.cap, p.id AS lid, h.id AS rid, least(p.e, h.e) - greatest(p.s, h.s) AS shared FROM pos p JOIN hole h ON p.cap = h.cap AND p.s < h.e AND h.s < p.e)"


def overlaps(spark, sf_dir: str) -> DataFrame:
    left = positive(spark, sf_dir).select("cap", F.col("id").alias("lid"), F.col("s").alias("ls"), F.col("e").alias("le"))
    right = holes(spark, sf_dir).select("cap", F.col("id").alias("rid"), F.col("s").alias("rs"), F.col("e").alias("re"))
    pairs = intervals.bucketed_overlap(left, right, "cap", DAY, (F.col("ls") < F.col("re")) & (F.col("rs") < F.col("le")))
    return pairs.select("cap", "lid", "rid", (F.least("le", "re") - F.greatest("ls", "rs")).alias("shared"))


@query("overlap_join", EV + SPANS + OVERLAP + " SELECT cap, lid, rid, shared FROM pr")
def overlap_join(spark, sf_dir):
    return overlaps(spark, sf_dir)


@query("max_overlap_inherit", EV + SPANS + OVERLAP + " SELECT cap, lid, rid FROM (SELECT *, row_number() OVER (PARTITION BY cap, lid ORDER BY shared DESC, rid) AS n FROM pr) WHERE n = 1")
def max_overlap_inherit(spark, sf_dir):
    best = Window.partitionBy("cap", "lid").orderBy(F.desc("shared"), "rid")
    return overlaps(spark, sf_dir).withColumn("n", F.row_number().over(best)).where("n = 1").select("cap", "lid", "rid")


@query("grid_overlap_ratio", EV + MERGED + f""" SELECT cap, win, round(sum(greatest(0, least(e, least(win * {12 * H} + {24 * H}, {720 * H})) - greatest(s, win * {12 * H}))) / {24 * H}.0, 6) AS ratio
 FROM merged, unnest(generate_series(CAST(greatest(ceil((s - {24 * H}) / {12 * H}.0 - 1e-9), 0) AS BIGINT), CAST(least(floor(e / {12 * H}.0 + 1e-9), 59) AS BIGINT))) AS w(win) GROUP BY ALL""")  # fmt: skip
def grid_overlap_ratio(spark, sf_dir):
    """Share of each window that the merged intervals cover."""
    low = F.greatest(F.ceil((F.col("s") - grid.SIZE) / F.lit(float(grid.HOP)) - 1e-9), F.lit(0))
    high = F.least(F.floor(F.col("e") / F.lit(float(grid.HOP)) + 1e-9), F.lit(grid.COUNT - 1))
    cells = intervals.merge(positive(spark, sf_dir), "cap").withColumn("win", F.explode(F.sequence(low, high)))
    start = F.col("win") * grid.HOP
    part = F.greatest(F.lit(0), F.least(F.col("e"), start + grid.SIZE, F.lit(TOTAL)) - F.greatest(F.col("s"), start))
    return cells.groupBy("cap", "win").agg(F.round(F.sum(part) / F.lit(float(grid.SIZE)), 6).alias("ratio"))


MATCH = EV + f""", c AS (SELECT k.cap, k.id AS lid, s.id AS rid, k.t AS lt, s.t AS rt, abs(k.t - s.t) AS d FROM ev k JOIN ev s ON s.cap = k.cap AND s.kind = 'shot' AND s.t BETWEEN k.t - {12 * H} AND k.t + {3 * H} WHERE k.kind = 'kill'),
 l AS (SELECT cap, list({{'l': lid, 'r': rid, 'd': d}} ORDER BY d, lt, rt, lid, rid) AS x FROM c GROUP BY cap),
 f AS (SELECT cap, list_reduce(list_transform(x, lambda y: [y]), lambda a, b: CASE WHEN list_bool_or(list_transform(a, lambda k: k.l = b[1].l OR k.r = b[1].r)) THEN a ELSE list_concat(a, b) END) AS y FROM l),
 mt AS (SELECT cap, u.l AS lid, u.r AS rid, u.d AS d FROM (SELECT cap, unnest(y) AS u FROM f) z)"""


@query("truth_match", MATCH + " SELECT * FROM mt")
def truth_match(spark, sf_dir):
    """Greedy one-to-one matching of kills and shots; checked against a plain loop in the tests."""
    e = load_events(spark, sf_dir)
    return matching.greedy_pairs(e.where("kind = 'kill'"), e.where("kind = 'shot'"), 3 * HOUR, 12 * HOUR)


@query("precision_recall", MATCH + """, n AS (SELECT cap, count(*) FILTER (WHERE kind = 'kill') AS expected, count(*) FILTER (WHERE kind = 'shot') AS found FROM ev GROUP BY cap), h AS (SELECT cap, count(*) AS hits FROM mt GROUP BY cap)
 SELECT n.cap, expected, found, coalesce(hits, 0) AS hits, coalesce(hits, 0) / nullif(found, 0) AS precision, coalesce(hits, 0) / nullif(expected, 0) AS recall FROM n LEFT JOIN h ON h.cap = n.cap""")  # fmt: skip
def precision_recall(spark, sf_dir):
    """Hits, expected and found per capture, with the ratios; null where nothing was expected or found."""
    e = load_events(spark, sf_dir)
    counts = e.groupBy("cap").agg(F.count_if(F.col("kind") == "kill").alias("expected"), F.count_if(F.col("kind") == "shot").alias("found"))
    hits = truth_match(spark, sf_dir).groupBy("cap").agg(F.count("*").alias("n"))
    out = counts.join(hits, "cap", "left").withColumn("hits", F.coalesce("n", F.lit(0)))
    return out.select("cap", "expected", "found", "hits", (F.col("hits") / F.nullif("found", F.lit(0))).alias("precision"), (F.col("hits") / F.nullif("expected", F.lit(0))).alias("recall"))


@query("peak_picking", EV + SIGNAL + """, pk AS (SELECT *, max(raw) OVER (PARTITION BY cap, kind ORDER BY win ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m,
 max(raw) OVER (PARTITION BY cap, kind ORDER BY win ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b FROM sig) SELECT cap, kind, win, raw FROM pk WHERE raw = m AND (b IS NULL OR b < raw) AND raw > 50""")  # fmt: skip
def peak_picking(spark, sf_dir):
    """Local maxima over a threshold; the first of equals."""
    by = Window.partitionBy("cap", "kind").orderBy("win")
    marked = signals(spark, sf_dir).withColumns({"m": F.max("raw").over(by.rowsBetween(-3, 3)), "b": F.max("raw").over(by.rowsBetween(-3, -1))})
    return marked.where("raw = m and (b is null or b < raw) and raw > 50").select("cap", "kind", "win", "raw")


@query("level_rise", EV + SIGNAL + " SELECT cap, kind, win, round(raw - max(raw) OVER (PARTITION BY cap, kind ORDER BY win ROWS BETWEEN 12 PRECEDING AND 4 PRECEDING), 6) AS rise FROM sig")
def level_rise(spark, sf_dir):
    recent = F.max("raw").over(Window.partitionBy("cap", "kind").orderBy("win").rowsBetween(-12, -4))
    return signals(spark, sf_dir).select("cap", "kind", "win", F.round(F.col("raw") - recent, 6).alias("rise"))


@query("zscore", EV + SIGNAL + " SELECT cap, kind, win, round((raw - avg(raw) OVER w) / nullif(stddev_pop(raw) OVER w, 0), 4) AS z FROM sig WINDOW w AS (PARTITION BY cap, kind)")
def zscore(spark, sf_dir):
    w = Window.partitionBy("cap", "kind")
    return signals(spark, sf_dir).select("cap", "kind", "win", F.round((F.col("raw") - F.avg("raw").over(w)) / F.nullif(F.stddev_pop("raw").over(w), F.lit(0.0)), 4).alias("z"))


@query("trend_slope", EV + SIGNAL + " SELECT cap, kind, round(regr_slope(raw, win), 6) AS slope, count(*) AS n FROM sig GROUP BY ALL")
def trend_slope(spark, sf_dir):
    return signals(spark, sf_dir).groupBy("cap", "kind").agg(F.round(F.regr_slope("raw", F.col("win").cast("double")), 6).alias("slope"), F.count("*").alias("n"))
