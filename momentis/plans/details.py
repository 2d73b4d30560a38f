"""Smaller operators of the inventory: fits, attributions, bins, roles, overlays, learners, and streams run to their end."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from momentis.functions.events import DAY, HOUR, TOTAL, load_events
from momentis.operators import intervals, learners, matching
from momentis.plans.moments import EV, ISLANDS, MERGED, SIGNAL, H, moments, positive, signals
from momentis.plans.registry import query
from momentis.plans.sessions import GROUPS, outcomes
from momentis.session import table, written

FIT = f"""CASE WHEN e - s > {72 * H} THEN greatest(least(p - {36 * H}, {720 * H} - {72 * H}), 0) WHEN e - s < {36 * H} THEN greatest(least(s - ({36 * H} - (e - s)) // 2, {720 * H} - {36 * H}), 0) ELSE s END"""


@query("length_fit", EV + ISLANDS + f""", m AS (SELECT cap, grp, first_win * {12 * H} AS s, least(last_win * {12 * H} + {24 * H}, {720 * H}) AS e, peak_win * {12 * H} + {12 * H} AS p FROM moments)
 SELECT cap, grp, CAST({FIT} AS BIGINT) AS s, CAST({FIT} + least(greatest(e - s, {36 * H}), {72 * H}) AS BIGINT) AS e FROM m""")  # fmt: skip
def length_fit(spark, sf_dir):
    """Moments between 36 and 72 hours: too long ones around their peak, too short ones extended, both within the capture."""
    rows = moments(spark, sf_dir).select("cap", "grp", (F.col("first_win") * 12 * HOUR).alias("s"), F.least(F.col("last_win") * 12 * HOUR + DAY, F.lit(TOTAL)).alias("e"), (F.col("peak_win") * 12 * HOUR + 12 * HOUR).alias("p"))
    size = F.col("e") - F.col("s")
    around = F.greatest(F.least(F.col("p") - 36 * HOUR, F.lit(TOTAL - 72 * HOUR)), F.lit(0))
    wider = F.greatest(F.least(F.col("s") - F.floor((36 * HOUR - size) / 2), F.lit(TOTAL - 36 * HOUR)), F.lit(0))
    start = F.when(size > 72 * HOUR, around).when(size < 36 * HOUR, wider).otherwise(F.col("s")).cast("long")
    return rows.select("cap", "grp", start.alias("s"), (start + F.least(F.greatest(size, F.lit(36 * HOUR)), F.lit(72 * HOUR))).cast("long").alias("e"))


@query("reaction_attribution", EV + f""", c AS (SELECT k.cap, k.id, r.id AS rid, r.v * CASE r.kind WHEN 'assist' THEN 1 WHEN 'headshot' THEN 0.7 ELSE 0.3 END AS strength, r.t FROM ev k JOIN ev r ON r.cap = k.cap AND k.kind = 'kill' AND r.kind IN ('assist', 'headshot', 'shot')
 AND r.t BETWEEN k.t - {H // 2} AND k.t + {12 * H}), b AS (SELECT *, row_number() OVER (PARTITION BY cap, id ORDER BY strength DESC, t, rid) AS n FROM c) SELECT cap, id, rid, round(strength, 6) AS strength FROM b WHERE n = 1""")  # fmt: skip
def reaction_attribution(spark, sf_dir):
    """The best weighted reaction that starts near a kill; the first of equals."""
    e = load_events(spark, sf_dir)
    weight = F.when(F.col("kind") == "assist", 1.0).when(F.col("kind") == "headshot", 0.7).otherwise(0.3)
    reactions = e.where("kind in ('assist', 'headshot', 'shot')")
    pairs = matching.near_events(e.where("kind = 'kill'"), reactions, HOUR // 2, 12 * HOUR)
    strong = pairs.join(reactions.select("cap", F.col("id").alias("rid"), (F.col("v") * weight).alias("strength")), ["cap", "rid"])
    n = F.row_number().over(Window.partitionBy("cap", "lid").orderBy(F.desc("strength"), "rt", "rid"))
    return strong.withColumn("n", n).where("n = 1").select("cap", F.col("lid").alias("id"), "rid", F.round("strength", 6).alias("strength"))


@query("keep_disabled", EV + MERGED + """ SELECT cap, s, e, EXISTS (SELECT 1 FROM ev d WHERE d.cap = m.cap AND d.kind = 'death' AND d.t >= m.s AND d.t < m.e) AS disabled FROM merged m""")
def keep_disabled(spark, sf_dir):
    """Merged spans flagged where a disabling event lies in them: events take the last span begun before them, no range join."""
    spans = intervals.merge(positive(spark, sf_dir), "cap")
    marks = load_events(spark, sf_dir).where("kind = 'death'").select("cap", F.col("t").alias("s"), F.lit(None).cast("long").alias("e"))
    both = spans.unionByName(marks).withColumn("mark", F.col("e").isNull().cast("int"))
    upto = Window.partitionBy("cap").orderBy("s", "mark").rowsBetween(Window.unboundedPreceding, 0)
    held = both.withColumns({"ls": F.last(F.when(F.col("mark") == 0, F.col("s")), ignorenulls=True).over(upto), "le": F.last("e", ignorenulls=True).over(upto)})
    return held.where("ls is not null").groupBy("cap", F.col("ls").alias("s"), F.col("le").alias("e")).agg(F.bool_or((F.col("mark") == 1) & (F.col("s") < F.col("le"))).alias("disabled"))


@query("rms_bins", EV + f" SELECT cap, t // {24 * H} AS bin, round(10 * log10(avg(v * v) + 1e-9), 6) AS db, count(*) AS n FROM ev WHERE t >= 0 GROUP BY ALL HAVING count(*) > 2")
def rms_bins(spark, sf_dir):
    """Level per day in decibels; bins with too few samples dropped."""
    e = load_events(spark, sf_dir).where("t >= 0").groupBy("cap", F.floor(F.col("t") / DAY).alias("bin"))
    return e.agg(F.round(10 * F.log10(F.avg(F.col("v") * F.col("v")) + 1e-9), 6).alias("db"), F.count("*").alias("n")).where("n > 2")


@query("peak_envelope", EV + """, i AS (SELECT cap, v, row_number() OVER (PARTITION BY cap ORDER BY t, id) - 1 AS i, count(*) OVER (PARTITION BY cap) AS n FROM ev), b AS (SELECT cap, i * 20 // n AS bucket, max(abs(v)) AS peak FROM i GROUP BY ALL)
 SELECT cap, bucket, round(peak / nullif(max(peak) OVER (PARTITION BY cap), 0), 6) AS peak FROM b""")  # fmt: skip
def peak_envelope(spark, sf_dir):
    """Twenty buckets of equal counts, as shares of the highest."""
    i = F.row_number().over(Window.partitionBy("cap").orderBy("t", "id")) - 1
    rows = load_events(spark, sf_dir).withColumns({"i": i, "n": F.count("*").over(Window.partitionBy("cap"))})
    peaks = rows.groupBy("cap", F.floor(F.col("i") * 20 / F.col("n")).alias("bucket")).agg(F.max(F.abs("v")).alias("peak"))
    return peaks.select("cap", "bucket", F.round(F.col("peak") / F.nullif(F.max("peak").over(Window.partitionBy("cap")), F.lit(0.0)), 6).alias("peak"))


@query("ability_kills", EV + f" SELECT cap, id FROM ev k WHERE kind = 'kill' AND NOT EXISTS (SELECT 1 FROM ev s WHERE s.cap = k.cap AND s.kind = 'shot' AND s.t BETWEEN k.t - {10 * H} AND k.t + {3 * H})")
def ability_kills(spark, sf_dir):
    e = load_events(spark, sf_dir)
    return matching.having(e.where("kind = 'kill'"), e.where("kind = 'shot'"), 10 * HOUR, 3 * HOUR, "left_anti").select("cap", "id")


@query("shots_before", EV + f" SELECT k.cap, k.id, count(s.id) AS shots FROM ev k LEFT JOIN ev s ON s.cap = k.cap AND s.kind = 'shot' AND s.t BETWEEN k.t - {10 * H} AND k.t WHERE k.kind = 'kill' GROUP BY ALL")
def shots_before(spark, sf_dir):
    """Shots in the burst window before each kill."""
    e = load_events(spark, sf_dir)
    kills = e.where("kind = 'kill'")
    n = matching.near_events(kills, e.where("kind = 'shot'"), 10 * HOUR, 0).groupBy("cap", F.col("lid").alias("id")).agg(F.count("*").alias("n"))
    return kills.join(n, ["cap", "id"], "left").select("cap", "id", F.coalesce("n", F.lit(0)).alias("shots"))


@query("thumbnail_rank", EV + GROUPS + """, r AS (SELECT cap, grp, kills + CASE WHEN ace THEN 3 ELSE 0 END + CAST(0.3 AS DOUBLE) * quick AS r FROM oc), m AS (SELECT *, max(r) OVER (PARTITION BY cap) AS m, row_number() OVER (PARTITION BY cap ORDER BY r DESC, grp) AS n FROM r)
 SELECT cap, grp, round(r, 6) AS r FROM m WHERE r >= m - 0.5 AND n <= 6""")  # fmt: skip
def thumbnail_rank(spark, sf_dir):
    """Contenders within half a point of each capture's best, at most six."""
    r = F.col("kills") + F.when(F.col("ace"), 3).otherwise(0) + F.lit(0.3) * F.col("quick")
    rows = outcomes(spark, sf_dir).select("cap", "grp", r.alias("r"))
    best = Window.partitionBy("cap").orderBy(F.desc("r"), "grp")
    return rows.withColumns({"m": F.max("r").over(Window.partitionBy("cap")), "n": F.row_number().over(best)}).where("r >= m - 0.5 and n <= 6").select("cap", "grp", F.round("r", 6).alias("r"))


@query("section_roles", EV + SIGNAL + """, s AS (SELECT cap, win // 10 AS section, avg(raw) AS level FROM sig WHERE kind = 'kill' GROUP BY ALL), c AS (SELECT *, lag(level) OVER o AS before, lead(level) OVER o AS after, max(level) OVER (PARTITION BY cap) AS top FROM s WINDOW o AS (PARTITION BY cap ORDER BY section))
 SELECT cap, section, CASE WHEN level = top THEN 'drop' WHEN before IS NULL THEN 'intro' WHEN after IS NULL THEN 'outro' WHEN after = top THEN 'build-up' WHEN level < 0.6 * top THEN 'breakdown' ELSE 'body' END AS role FROM c""")  # fmt: skip
def section_roles(spark, sf_dir):
    """Role of each section by its level against its neighbours and the loudest."""
    s = signals(spark, sf_dir).where("kind = 'kill'").groupBy("cap", F.floor(F.col("win") / 10).alias("section")).agg(F.avg("raw").alias("level"))
    o = Window.partitionBy("cap").orderBy("section")
    c = s.withColumns({"before": F.lag("level").over(o), "after": F.lead("level").over(o), "top": F.max("level").over(Window.partitionBy("cap"))})
    role = F.when(F.col("level") == F.col("top"), "drop").when(F.col("before").isNull(), "intro").when(F.col("after").isNull(), "outro").when(F.col("after") == F.col("top"), "build-up").when(F.col("level") < 0.6 * F.col("top"), "breakdown").otherwise("body")
    return c.select("cap", "section", role.alias("role"))


@query("smoothed", EV + SIGNAL + """ SELECT cap, kind, win, round((0.25 * coalesce(lag(raw) OVER o, raw) + 0.5 * raw + 0.25 * coalesce(lead(raw) OVER o, raw)), 6) AS smooth FROM sig WINDOW o AS (PARTITION BY cap, kind ORDER BY win)""")
def smoothed(spark, sf_dir):
    """A short kernel over neighbouring windows; edges repeat."""
    o = Window.partitionBy("cap", "kind").orderBy("win")
    near = 0.25 * F.coalesce(F.lag("raw").over(o), F.col("raw")) + 0.5 * F.col("raw") + 0.25 * F.coalesce(F.lead("raw").over(o), F.col("raw"))
    return signals(spark, sf_dir).select("cap", "kind", "win", F.round(near, 6).alias("smooth"))


@query("steady_values", EV + """, r AS (SELECT cap, id, t, CAST(floor(v / 25) AS BIGINT) AS x FROM ev WHERE isfinite(v)), c AS (SELECT *, CASE WHEN lag(x) OVER o = x THEN 0 ELSE 1 END AS f FROM r WINDOW o AS (PARTITION BY cap ORDER BY t, id)),
 g AS (SELECT *, sum(f) OVER (PARTITION BY cap ORDER BY t, id) AS run FROM c), h AS (SELECT cap, run, min(t) AS since, any_value(x) AS x, count(*) AS n FROM g GROUP BY cap, run HAVING count(*) >= 2),
 d AS (SELECT *, lag(x) OVER (PARTITION BY cap ORDER BY run) AS p FROM h) SELECT cap, since, x, n FROM d WHERE p IS NULL OR p <> x""")  # fmt: skip
def steady_values(spark, sf_dir):
    """Values held for two reads at least; unreadable ones skipped, the same value twice in a row dropped."""
    o = Window.partitionBy("cap").orderBy("t", "id")
    reads = load_events(spark, sf_dir).where("v is not null and not isnan(v) and abs(v) < double('infinity')").select("cap", "id", "t", F.floor(F.col("v") / 25).alias("x"))
    runs = reads.withColumn("f", F.when(F.lag("x").over(o) == F.col("x"), 0).otherwise(1)).withColumn("run", F.sum("f").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    held = runs.groupBy("cap", "run").agg(F.min("t").alias("since"), F.min("x").alias("x"), F.count("*").alias("n")).where("n >= 2")
    return held.withColumn("p", F.lag("x").over(Window.partitionBy("cap").orderBy("run"))).where("p is null or p <> x").select("cap", "since", "x", "n")


@query("alternations", EV + " SELECT cap, CAST(sum(CASE WHEN nx <> kind THEN 1 ELSE 0 END) AS BIGINT) AS changes FROM (SELECT cap, kind, lead(kind) OVER (PARTITION BY cap ORDER BY t, id) AS nx FROM ev) GROUP BY cap")
def alternations(spark, sf_dir):
    nx = F.lead("kind").over(Window.partitionBy("cap").orderBy("t", "id"))
    return load_events(spark, sf_dir).withColumn("nx", nx).groupBy("cap").agg(F.sum(F.when(F.col("nx") != F.col("kind"), 1).otherwise(0)).alias("changes"))


@query("percentile_flavours", EV + """ SELECT cap, round(quantile_cont(v, 0.9), 6) AS interpolated, round(list_sort(list(v))[CAST(floor(0.9 * (count(*) - 1)) AS BIGINT) + 1], 6) AS floored, round(list_sort(list(v))[CAST(round(0.9 * (count(*) - 1)) AS BIGINT) + 1], 6) AS nearest,
 round(list_sort(list(v))[count(*) // 2 + 1], 6) AS upper_median FROM ev GROUP BY cap""")  # fmt: skip
def percentile_flavours(spark, sf_dir):
    """The four rank rules in use, from ranks: no capture's values are gathered in a row."""
    own = Window.partitionBy("cap")
    rows = load_events(spark, sf_dir).select("cap", "v", F.row_number().over(own.orderBy("v", "id")).alias("r"), F.count("*").over(own).alias("n"))
    n = F.col("n")
    at = lambda k: F.max(F.when(F.col("r") == k + 1, F.round("v", 6)))
    below = F.floor(F.lit(0.9) * (n - 1))
    part = F.lit(0.9) * (n - 1) - below
    low, high = F.max(F.when(F.col("r") == below + 1, F.col("v"))), F.max(F.when(F.col("r") == F.least(below + 2, n), F.col("v")))
    return rows.groupBy("cap").agg(F.round(low + (high - low) * F.max(part), 6).alias("interpolated"), at(below).alias("floored"), at(F.round(F.lit(0.9) * (n - 1))).alias("nearest"), at(F.floor(n / 2)).alias("upper_median"))


@query("usual_kind", EV + """, c AS (SELECT cap, kind, count(*) AS n FROM ev GROUP BY ALL) SELECT cap, kind, n FROM (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY n DESC, kind) AS r FROM c) WHERE r = 1""")
def usual_kind(spark, sf_dir):
    """The most frequent kind; the first by name of equals."""
    c = load_events(spark, sf_dir).groupBy("cap", "kind").agg(F.count("*").alias("n"))
    return c.groupBy("cap").agg(F.min_by(F.struct("kind", "n"), F.struct(-F.col("n"), F.col("kind"))).alias("x")).select("cap", "x.kind", "x.n")


@query("overlay", """SELECT p_partkey, coalesce(CASE WHEN p_size > 40 THEN 'large' END, CASE WHEN p_brand = 'Brand#1' THEN 'house' END, 'default') AS preset FROM part""")
def overlay(spark, sf_dir):
    """The most specific setting that is given wins."""
    special, own = F.when(F.col("p_size") > 40, "large"), F.when(F.col("p_brand") == "Brand#1", "house")
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(special, own, F.lit("default")).alias("preset"))


@query("job_queue", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 0 ELSE 1 END, o_orderkey) AS slot FROM orders")
def job_queue(spark, sf_dir):
    """Urgent before others, first come first served within."""
    w = Window.partitionBy("o_custkey").orderBy(F.when(F.col("o_orderpriority").like("1%"), 0).otherwise(1), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("slot"))


@query("seeded_pick", "SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 7))::BIGINT % 5 AS BIGINT) AS pick FROM documents")
def seeded_pick(spark, sf_dir):
    """One of five labels, the same for the same key anywhere."""
    return table(spark, sf_dir, "documents").select("doc_id", (F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 7), 16, 10).cast("long") % 5).alias("pick"))


@query("presence", EV + f""", k AS (SELECT DISTINCT cap, t // {12 * H} AS w FROM ev WHERE kind = 'kill' AND t >= 0), a AS (SELECT cap, max(t) // {12 * H} AS last FROM ev GROUP BY cap)
 SELECT a.cap, w AS win, CASE WHEN w <= last THEN EXISTS (SELECT 1 FROM k WHERE k.cap = a.cap AND k.w BETWEEN g.w - 1 AND g.w + 1) END AS present FROM a, unnest(generate_series(0, 59)) AS g(w)""")  # fmt: skip
def presence(spark, sf_dir):
    """Whether a kill lies in a window or beside it; null after a capture's last sample."""
    e = load_events(spark, sf_dir)
    near = e.where("kind = 'kill' and t >= 0").select("cap", F.explode(F.array(*(F.floor(F.col("t") / (12 * HOUR)) + k for k in (-1, 0, 1)))).alias("win")).distinct().withColumn("seen", F.lit(True))
    grid = e.groupBy("cap").agg(F.floor(F.max("t") / (12 * HOUR)).alias("last")).withColumn("win", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"))))
    return grid.join(near, ["cap", "win"], "left").select("cap", "win", F.when(F.col("win") <= F.col("last"), F.coalesce("seen", F.lit(False))).alias("present"))


@query("sentences", r"""WITH s AS (SELECT *, CASE WHEN regexp_matches(lag(trim(text)) OVER o, '[.!?]$') OR lag(text) OVER o IS NULL THEN 1 ELSE 0 END AS f FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn)),
 g AS (SELECT *, sum(f) OVER (PARTITION BY conv_id ORDER BY turn) AS sentence FROM s) SELECT conv_id, CAST(sentence AS BIGINT) AS sentence, count(*) AS parts FROM g GROUP BY ALL HAVING NOT bool_or(contains(lower(text), 'password'))""")  # fmt: skip
def sentences(spark, sf_dir):
    """Captions joined up to end punctuation; a sentence goes whole if any part matches."""
    o = Window.partitionBy("conv_id").orderBy("turn")
    last = F.lag("text").over(o)
    rows = table(spark, sf_dir, "conversations").withColumn("f", F.when(last.isNull() | F.trim(last).rlike("[.!?]$"), 1).otherwise(0))
    rows = rows.withColumn("sentence", F.sum("f").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("conv_id", "sentence").agg(F.count("*").alias("parts"), F.bool_or(F.contains(F.lower("text"), F.lit("password"))).alias("x")).where("not x").drop("x")


@query("file_name_times", EV + " SELECT id, CASE WHEN id % 3 < 2 THEN t // 1000000 + 1704067200 END AS seconds FROM ev")
def file_name_times(spark, sf_dir):
    """Times from recorders' file names, two patterns in turn; other names and impossible dates give null."""
    at = F.timestamp_seconds(F.floor(F.col("t") / 1_000_000) + 1_704_067_200)
    name = F.when(F.col("id") % 3 == 0, F.date_format(at, "yyyy-MM-dd HH-mm-ss'.mkv'")).when(F.col("id") % 3 == 1, F.concat(F.lit("Game "), F.date_format(at, "yyyy.MM.dd - HH.mm.ss'.05.mp4'"))).otherwise("clip 2024-13-45 99-99-99.mkv")
    rows = load_events(spark, sf_dir).select("id", name.alias("name"))
    digits = F.coalesce(*(F.nullif(F.regexp_replace(F.regexp_extract("name", p, 1), r"\D", ""), F.lit("")) for p in (r"(\d{4}-\d\d-\d\d \d\d-\d\d-\d\d)", r"(\d{4}\.\d\d\.\d\d - \d\d\.\d\d\.\d\d)")))
    return rows.select("id", F.unix_seconds(F.try_to_timestamp(digits, F.lit("yyyyMMddHHmmss"))).alias("seconds"))


def path_sums(x: np.ndarray, y: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Slopes and curvatures of the logistic loss, summed over rows, at all weights of a path at once."""
    out = np.zeros((len(path), 20))
    for a in range(0, len(x), 1000):
        own, squares = x[a : a + 1000], (x[a : a + 1000, :, None] * x[a : a + 1000, None, :]).reshape(-1, 16)
        p = 1 / (1 + np.exp(-np.clip(own @ path.T, -30, 30)))
        out += np.column_stack([(p - y[a : a + 1000, None]).T @ own, (p * (1 - p)).T @ squares])
    return out


def descent(mean: Callable[[np.ndarray], np.ndarray], penalty: float, steps: int = 500, rate: float = 0.5) -> np.ndarray:
    """Where `steps` steps down from 0 end; mean(path) gives mean slopes and curvatures at weights.

    A pass over the rows looks at all steps of the path at once, and the next path follows its slopes and curvatures; at rest each step is the one that the rows give. A pass makes at least one more step final, in practice all in some ten.
    """
    path, end = np.zeros((steps, 4)), np.zeros(4)
    for _ in range(steps):
        s, w, after = mean(path), np.zeros(4), np.zeros_like(path)
        for k in range(steps):
            after[k] = w
            w = w - rate * (s[k, :4] + s[k, 4:].reshape(4, 4) @ (w - path[k]) + penalty * w)
        moved = max(np.abs(after - path).max(), np.abs(w - end).max())
        path, end = after, w
        if moved < 1e-11:
            break
    return end


@query("quality_learner")
def quality_learner(spark, sf_dir):
    """A standardised, regularised logistic regression of the quality label: 500 small steps over all labelled documents, with slopes summed in Spark."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("quality is not null")
    n_chars = F.greatest("n_chars", F.lit(1))
    features = F.array(F.log1p("n_chars"), F.length(F.regexp_replace("text", "[^|#*$%&]", "")) / n_chars, F.size(F.split("text", "\n")) / n_chars)
    # Only numbers are written and read again; of them the driver gets sums.
    own = written(d.select(features.alias("x"), F.col("quality").cast("double").alias("y")))
    n, *rest = own.agg(F.count("*"), *(F.avg(F.col("x")[k]) for k in range(3)), *(F.stddev_pop(F.col("x")[k]) for k in range(3))).first()
    w, hits = np.zeros(4), None
    if n:
        mean, scale = np.array(rest[:3]), np.maximum(np.array(rest[3:]), 1e-9)

        def columns(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
            x = (np.array([r[0] for r in rows], float) - mean) / scale
            return np.column_stack([np.ones(len(x)), x]), np.array([r[1] for r in rows])

        w = descent(lambda path: learners.summed(own, path.shape[0] * 20, lambda some: path_sums(*columns(some), path)).reshape(-1, 20) / n, 0.1 / n)
        hits = learners.summed(own, 1, lambda some: np.array([((x @ w > 0) == (y > 0.5)).sum() for x, y in [columns(some)]]))[0] / n
    names = ["bias", "length", "symbols", "lines", "agreement"]
    values = [*(round(float(x), 6) for x in w), None if hits is None else float(hits)]
    return spark.createDataFrame(list(zip(names, values, strict=True)), "feature string, value double")
