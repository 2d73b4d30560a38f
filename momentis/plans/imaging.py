"""Signals and images as arrays: masks, runs, bands, profiles, envelopes, holds and rates. Vectors stand for scan lines or for images of 8 by 8."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from momentis.functions.events import DAY, HOUR, load_events
from momentis.operators import grid, intervals, kernels, matching, sequences
from momentis.operators.keyed import per_key
from momentis.plans.moments import EV, MERGED, SIGNAL, H, positive, signals
from momentis.plans.registry import query
from momentis.session import table

PX = "WITH px AS (SELECT vec_id, CAST(label AS BIGINT) AS label, i - 1 AS p, CAST(embedding[i] AS DOUBLE) AS x FROM embeddings, range(1, 65) AS r(i))"


def pixels(spark, sf_dir: str) -> DataFrame:
    """(vec_id, label, p, x): a row per component."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("p", "y")).select("vec_id", "label", "p", F.col("y").cast("double").alias("x"))


LIT = "list_transform(embedding, lambda x: CASE WHEN x > 0.1 THEN 1 ELSE 0 END)"


@query("gap_bridging", f"SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: list_max(list_slice(m, greatest(i - 2, 1), i)) * list_max(list_slice(m, i, least(i + 2, 64)))))::BIGINT AS lit FROM (SELECT vec_id, {LIT} AS m FROM embeddings) e")
def gap_bridging(spark, sf_dir):
    """Lit pixels of a line once gaps are filled that have lit ones within two on both sides."""
    lit = F.transform("embedding", lambda x: (x > 0.1).cast("int"))
    left = lambda i: F.array_max(F.slice("m", F.greatest(i - 2, F.lit(1)), i - F.greatest(i - 2, F.lit(1)) + 1))
    right = lambda i: F.array_max(F.slice("m", i, F.lit(3)))
    filled = F.aggregate(F.sequence(F.lit(1), F.lit(64)), F.lit(0).cast("long"), lambda n, i: n + left(i) * right(i))
    return table(spark, sf_dir, "embeddings").select("vec_id", lit.alias("m")).select("vec_id", filled.alias("lit"))


@query("mask_dilation", f"SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: list_max(list_slice(m, greatest(i - 1, 1), least(i + 1, 64)))))::BIGINT AS lit FROM (SELECT vec_id, {LIT} AS m FROM embeddings) e")
def mask_dilation(spark, sf_dir):
    """Lit pixels of a line that has grown by one on both sides."""
    by = Window.partitionBy("vec_id").orderBy("p").rowsBetween(-1, 1)
    return pixels(spark, sf_dir).withColumn("on", F.max((F.col("x") > 0.1).cast("int")).over(by)).groupBy("vec_id").agg(F.sum("on").alias("lit"))


RUNS = PX + """, on_ AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY vec_id ORDER BY p) <= 2 THEN 0 ELSE 1 END AS f FROM px WHERE x > 0.1), rn AS (SELECT *, sum(f) OVER (PARTITION BY vec_id ORDER BY p) AS run FROM on_)"""


def lit_runs(spark, sf_dir: str, gap: int) -> DataFrame:
    """Lit runs (vec_id, run, low, high) of each line over holes of up to gap - 1."""
    return intervals.islands(pixels(spark, sf_dir).where("x > 0.1"), "vec_id", "p", gap, ties="p", into="run").groupBy("vec_id", "run").agg(F.min("p").alias("low"), F.max("p").alias("high"))


@query("scanline_runs", RUNS + " SELECT vec_id, CAST(run AS BIGINT) AS run, min(p) AS low, max(p) AS high FROM rn GROUP BY vec_id, run")
def scanline_runs(spark, sf_dir):
    """Runs over holes of one pixel."""
    return lit_runs(spark, sf_dir, 2)


@query("paired_strokes", RUNS + """, r AS (SELECT vec_id, min(p) AS low, max(p) AS high FROM rn GROUP BY vec_id, run), o AS (SELECT *, lead(low) OVER w AS low2, lead(high) OVER w AS high2 FROM r WINDOW w AS (PARTITION BY vec_id ORDER BY low))
 SELECT vec_id, low, high2 AS high FROM o WHERE low2 - high BETWEEN 3 AND 10 AND abs((high - low) - (high2 - low2)) <= 1""")  # fmt: skip
def paired_strokes(spark, sf_dir):
    """Neighbouring runs of about one length with a gap between them: the two strokes of an outline."""
    w = Window.partitionBy("vec_id").orderBy("low")
    rows = lit_runs(spark, sf_dir, 2).select("vec_id", "low", "high", F.lead("low").over(w).alias("low2"), F.lead("high").over(w).alias("high2"))
    return rows.where("low2 - high between 3 and 10 and abs((high - low) - (high2 - low2)) <= 1").select("vec_id", "low", F.col("high2").alias("high"))


@query("band_count", PX + """, on_ AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY vec_id ORDER BY p) <= 3 THEN 0 ELSE 1 END AS f FROM px WHERE x > 0.1), rn AS (SELECT *, sum(f) OVER (PARTITION BY vec_id ORDER BY p) AS run FROM on_),
 b AS (SELECT vec_id, run FROM rn GROUP BY vec_id, run HAVING max(p) - min(p) + 1 BETWEEN 3 AND 12) SELECT e.vec_id, count(b.run) AS bands FROM embeddings e LEFT JOIN b ON b.vec_id = e.vec_id GROUP BY e.vec_id""")  # fmt: skip
def band_count(spark, sf_dir):
    """Bands of lit lines over up to two dark ones, as high as a line of text; 0 where there is none."""
    bands = lit_runs(spark, sf_dir, 3).where("high - low + 1 between 3 and 12").groupBy("vec_id").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "embeddings").select("vec_id").join(bands, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).alias("bands"))


@query("level_appearances", EV + f""", c AS (SELECT cap, id, t, CAST(floor(v / 20) AS BIGINT) AS n FROM ev WHERE kind = 'shot'),
 w AS (SELECT *, min(n) OVER (PARTITION BY cap ORDER BY t, id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS low, count(*) OVER (PARTITION BY cap ORDER BY t, id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS k, max(n) OVER (PARTITION BY cap ORDER BY t RANGE BETWEEN {36 * H} PRECEDING AND 1 PRECEDING) AS high FROM c)
 SELECT cap, id, t FROM w WHERE k = 3 AND low > high""")  # fmt: skip
def level_appearances(spark, sf_dir):
    """Where a count is higher, for three reads, than all in the time before it; not where nothing was read before."""
    rows = load_events(spark, sf_dir).where("kind = 'shot'").select("cap", "id", "t", F.floor(F.col("v") / 20).alias("n"))
    ahead, before = Window.partitionBy("cap").orderBy("t", "id").rowsBetween(0, 2), Window.partitionBy("cap").orderBy("t").rangeBetween(-36 * HOUR, -1)
    return rows.withColumns({"low": F.min("n").over(ahead), "k": F.count("*").over(ahead), "high": F.max("n").over(before)}).where("k = 3 and low > high").select("cap", "id", "t")


@query("pixel_classes", PX + """, c AS (SELECT *, CASE WHEN x > 0.2 THEN 'bright' WHEN x > 0.1 THEN 'warm' WHEN x < -0.2 THEN 'dark' WHEN x < -0.1 THEN 'cold' ELSE 'plain' END AS class FROM px)
 SELECT vec_id, p // 8 AS line, class, count(*) / 8.0::DOUBLE AS share FROM c GROUP BY ALL""")  # fmt: skip
def pixel_classes(spark, sf_dir):
    """Each pixel in one of five classes, and their shares in each line of an image."""
    kind = F.when(F.col("x") > 0.2, "bright").when(F.col("x") > 0.1, "warm").when(F.col("x") < -0.2, "dark").when(F.col("x") < -0.1, "cold").otherwise("plain")
    return pixels(spark, sf_dir).groupBy("vec_id", F.floor(F.col("p") / 8).alias("line"), kind.alias("class")).agg((F.count("*") / F.lit(8.0)).alias("share"))


@query("image_sharpness", """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS m FROM embeddings), l AS (SELECT vec_id, list_transform(list_filter(range(1, 65), lambda i: (i - 1) // 8 BETWEEN 1 AND 6 AND (i - 1) % 8 BETWEEN 1 AND 6), lambda i: m[i - 8] + m[i + 8] + m[i - 1] + m[i + 1] - 4 * m[i]) AS d, list_avg(m) AS mean FROM e)
 SELECT vec_id, round(list_aggregate(d, 'var_pop'), 6) AS sharpness, round(mean, 6) AS brightness FROM l""")  # fmt: skip
def image_sharpness(spark, sf_dir):
    """Variance of the Laplacian inside an image, and its mean."""
    m = F.col("m")
    inside = F.filter(F.sequence(F.lit(1), F.lit(64)), lambda i: F.floor((i - 1) / 8).between(1, 6) & ((i - 1) % 8).between(1, 6))
    lap = F.transform(inside, lambda i: F.element_at(m, i - 8) + F.element_at(m, i + 8) + F.element_at(m, i - 1) + F.element_at(m, i + 1) - 4 * F.element_at(m, i))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("m")).withColumn("d", lap).withColumn("c", mean(F.col("d")))
    return rows.select("vec_id", F.round(mean(F.transform("d", lambda x: (x - F.col("c")) * (x - F.col("c")))), 6).alias("sharpness"), F.round(mean(m), 6).alias("brightness"))


@query("pose_similarity", PX + """, k AS (SELECT label, p FROM px GROUP BY label, p HAVING var_pop(x) < 0.02), m AS (SELECT px.*, lag(x) OVER (PARTITION BY px.label, px.p ORDER BY vec_id) AS y FROM px JOIN k USING (label, p))
 SELECT label, vec_id, count(*) AS n, round(sum(x * y) / nullif(sqrt(sum(x * x) * sum(y * y)), 0), 6) AS alike FROM m WHERE y IS NOT NULL GROUP BY ALL""")  # fmt: skip
def pose_similarity(spark, sf_dir):
    """Likeness of each image to the one before of its label, over the pixels that hardly change within the label."""
    px = pixels(spark, sf_dir)
    stable = px.groupBy("label", "p").agg(F.var_pop("x").alias("v")).where("v < 0.02").select("label", "p")
    rows = px.join(stable, ["label", "p"]).withColumn("y", F.lag("x").over(Window.partitionBy("label", "p").orderBy("vec_id"))).where("y is not null")
    return rows.groupBy("label", "vec_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("x") * F.col("y")) / F.nullif(F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("y") * F.col("y"))), F.lit(0.0)), 6).alias("alike"))


@query("timbre_change", """WITH e AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS m FROM embeddings), l AS (SELECT *, lag(m, 2) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM e),
 d AS (SELECT label, vec_id, 1 - list_sum(list_transform(list_zip(m, b), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(m, lambda x: x * x)) * list_sum(list_transform(b, lambda x: x * x))) AS d FROM l WHERE b IS NOT NULL)
 SELECT CAST(label AS BIGINT) AS label, vec_id, round(d, 6) AS change, d > 1.2 * median(d) OVER (PARTITION BY label) AS unusual FROM d""")  # fmt: skip
def timbre_change(spark, sf_dir):
    """Cosine distance of each vector from the one two before, against what is usual for its label."""
    from momentis.functions.events import cosine

    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), "vec_id", "embedding")
    rows = rows.withColumn("b", F.lag("embedding", 2).over(Window.partitionBy("label").orderBy("vec_id"))).where("b is not null").withColumn("d", 1 - cosine(F.col("embedding"), F.col("b")))
    return rows.select("label", "vec_id", F.round("d", 6).alias("change"), (F.col("d") > 1.2 * F.median("d").over(Window.partitionBy("label"))).alias("unusual"))


@query("profile_shifts", """WITH e AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings), l AS (SELECT *, lag(a) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM e),
 c AS (SELECT label, vec_id, s, round(list_avg(list_transform(range(1, 65 - abs(s)), lambda i: abs(a[i + greatest(s, 0)] - b[i + greatest(-s, 0)]))), 9) AS cost FROM l, range(-4, 5) AS r(s) WHERE b IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cost, abs(s), s) AS n FROM c) SELECT CAST(label AS BIGINT) AS label, vec_id, s AS shift FROM r WHERE n = 1""")  # fmt: skip
def profile_shifts(spark, sf_dir):
    """The shift by up to four of each profile against the one before with the least mean difference; the smallest of equals."""
    a, b = F.col("a"), F.col("b")

    def slid(s: int):
        pairs = F.zip_with(F.slice(a, 1 + max(s, 0), 64 - abs(s)), F.slice(b, 1 + max(-s, 0), 64 - abs(s)), lambda x, y: F.abs(x - y))
        return F.round(F.aggregate(pairs, F.lit(0.0), lambda n, x: n + x) / F.lit(float(64 - abs(s))), 9)

    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("label"), "vec_id", F.col("embedding").cast("array<double>").alias("a"))
    rows = rows.withColumn("b", F.lag("a").over(Window.partitionBy("label").orderBy("vec_id"))).where("b is not null")
    best = F.array_min(F.array(*(F.struct(slid(s).alias("cost"), F.lit(abs(s)).alias("size"), F.lit(s).cast("long").alias("s")) for s in range(-4, 5))))
    return rows.select("label", "vec_id", best["s"].alias("shift"))


@query("shot_locating", EV + f""", p AS (SELECT k.cap, k.id, s.t, s.id AS sid, s.v * exp(-pow((s.t - (k.t - {3 * H})) / {6 * H}.0, 2) / 2) AS fit FROM ev k JOIN ev s ON s.cap = k.cap AND s.kind = 'shot' AND s.t BETWEEN k.t - {24 * H} AND k.t + {24 * H} WHERE k.kind = 'kill'),
 r AS (SELECT *, row_number() OVER (PARTITION BY cap, id ORDER BY fit DESC, t, sid) AS n FROM p) SELECT cap, id, t, round(fit, 6) AS fit FROM r WHERE n = 1""")  # fmt: skip
def shot_locating(spark, sf_dir):
    """The shot of each kill: the strongest under a normal preference for three hours before it."""
    e = load_events(spark, sf_dir)
    shots = e.where("kind = 'shot'").select("cap", "id", "t", "v")
    met = matching.near_events(e.where("kind = 'kill'"), shots, 24 * HOUR, 24 * HOUR).join(shots.select("cap", F.col("id").alias("rid"), "v"), ["cap", "rid"])
    fit = F.col("v") * F.exp(-F.pow((F.col("rt") - (F.col("lt") - 3 * HOUR)) / F.lit(6.0 * HOUR), 2) / 2)
    best = Window.partitionBy("cap", "lid").orderBy(F.desc("fit"), "rt", "rid")
    return met.withColumn("fit", fit).withColumn("n", F.row_number().over(best)).where("n = 1").select("cap", F.col("lid").alias("id"), F.col("rt").alias("t"), F.round("fit", 6).alias("fit"))


@query("missing_values", EV + f""", r AS (SELECT cap, id, t, CAST(floor(v / 10) AS BIGINT) AS x FROM ev WHERE kind = 'assist'), c AS (SELECT *, lag(x) OVER o AS b FROM r WINDOW o AS (PARTITION BY cap ORDER BY t, id)), k AS (SELECT cap, id, t, x FROM c WHERE b IS NULL OR b <> x),
 n AS (SELECT *, lead(x) OVER o AS nx, lead(t) OVER o AS nt FROM k WINDOW o AS (PARTITION BY cap ORDER BY t, id)) SELECT cap, id, t AS s, nt AS e, x + 1 AS value FROM n WHERE nx = x + 2 AND nt - t <= {72 * H}""")  # fmt: skip
def missing_values(spark, sf_dir):
    """Where a run of a value is followed soon by one of two more, what lies between is one more."""
    o = Window.partitionBy("cap").orderBy("t", "id")
    reads = load_events(spark, sf_dir).where("kind = 'assist'").select("cap", "id", "t", F.floor(F.col("v") / 10).alias("x"))
    firsts = reads.withColumn("b", F.lag("x").over(o)).where("b is null or b <> x")
    rows = firsts.select("cap", "id", "t", "x", F.lead("x").over(o).alias("nx"), F.lead("t").over(o).alias("nt"))
    return rows.where((F.col("nx") == F.col("x") + 2) & (F.col("nt") - F.col("t") <= 72 * HOUR)).select("cap", "id", F.col("t").alias("s"), F.col("nt").alias("e"), (F.col("x") + 1).alias("value"))


@query("attack_envelope", EV + """, f AS (SELECT cap, t // 21600000000 AS frame, 10 * log10(avg(v * v) + 1e-10::DOUBLE) AS level FROM ev WHERE t >= 0 GROUP BY ALL) SELECT cap, frame, round(coalesce(greatest(level - lag(level) OVER (PARTITION BY cap ORDER BY frame), 0), 0), 4) AS attack FROM f""")
def attack_envelope(spark, sf_dir):
    """Rises of the level in decibels from frame to frame; falls and the first frame are 0."""
    frames = load_events(spark, sf_dir).where("t >= 0").groupBy("cap", F.floor(F.col("t") / (6 * HOUR)).alias("frame")).agg((10 * F.log10(F.avg(F.col("v") * F.col("v")) + 1e-10)).alias("level"))
    rise = F.greatest(F.col("level") - F.lag("level").over(Window.partitionBy("cap").orderBy("frame")), F.lit(0.0))
    return frames.select("cap", "frame", F.round(F.coalesce(rise, F.lit(0.0)), 4).alias("attack"))


FRAGMENTS = EV + """, f AS (SELECT cap, kind, list({'c': CAST(floor(v) AS BIGINT), 'l': CAST(t // 3600000000 AS BIGINT), 'r': CAST(t // 3600000000 + 30 AS BIGINT)} ORDER BY floor(v), t // 3600000000) AS x FROM ev WHERE kind IN ('kill', 'death') GROUP BY ALL),
 m AS (SELECT cap, kind, list_reduce(list_transform(x, lambda y: [y]), lambda a, b: CASE WHEN abs(a[len(a)].c - b[1].c) <= 3 AND b[1].l <= a[len(a)].r + 2 THEN list_concat(a[1:len(a) - 1], [{'c': a[len(a)].c, 'l': a[len(a)].l, 'r': greatest(a[len(a)].r, b[1].r)}]) ELSE list_concat(a, b) END) AS m FROM f)"""


@query("fragment_merge", FRAGMENTS + " SELECT cap, kind, u.c AS centre, u.l AS l, u.r AS r FROM (SELECT cap, kind, unnest(m) AS u FROM m) z")
def fragment_merge(spark, sf_dir):
    """Pieces of one frame: of one role, side by side in the order of their centres, whose centre lies within three of the first piece's."""
    rows = load_events(spark, sf_dir).where("kind in ('kill', 'death')").select("cap", "id", "kind", F.floor("v").alias("c"), F.floor(F.col("t") / HOUR).alias("l"))

    def run(g: pd.DataFrame) -> list[tuple]:
        out: list[list] = []
        for kind, c, l in zip(g.kind, g.c.tolist(), g.l.tolist(), strict=True):
            if out and out[-1][0] == kind and abs(out[-1][1] - c) <= 3 and l <= out[-1][3] + 2:
                out[-1][3] = max(out[-1][3], l + 30)
            else:
                out.append([kind, c, l, l + 30])
        return [tuple(x) for x in out]

    return per_key(rows, "cap", run, {"kind": "string", "centre": "long", "l": "long", "r": "long"}, ["kind", "c", "l"])


HOLD = EV + SIGNAL + """, h AS (SELECT cap, win, CASE WHEN win - lag(win) OVER (PARTITION BY cap ORDER BY win) = 1 THEN 0 ELSE 1 END AS f FROM sig WHERE kind = 'shot' AND raw > 40), n AS (SELECT *, sum(f) OVER (PARTITION BY cap ORDER BY win) AS run FROM h),
 b AS (SELECT cap, min(win) + 1 AS win FROM n GROUP BY cap, run HAVING count(*) >= 2)"""


@query("debounced", HOLD + ", l AS (SELECT cap, list_reduce(list_transform(list(win ORDER BY win), lambda w: [w]), lambda a, b: CASE WHEN b[1] - a[len(a)] > 6 THEN list_concat(a, b) ELSE a END) AS w FROM b GROUP BY cap) SELECT cap, unnest(w) AS win FROM l")
def debounced(spark, sf_dir):
    """Events of a state once it has held for two windows, and only more than six after the last event that was given."""
    rows = signals(spark, sf_dir).where("kind = 'shot' and raw > 40").select("cap", "win")
    held = intervals.islands(rows, "cap", "win", 1, ties="win", into="run").groupBy("cap", "run").agg(F.min("win").alias("first"), F.count("*").alias("n")).where("n >= 2").select("cap", (F.col("first") + 1).alias("win"))

    def run(g: pd.DataFrame) -> list[tuple]:
        out: list[int] = []
        for w in g.win.tolist():
            if not out or w - out[-1] > 6:
                out.append(w)
        return [(w,) for w in out]

    return per_key(held, "cap", run, {"win": "long"}, ["win"])


@query("section_thirds", EV + SIGNAL + """, n AS (SELECT cap, raw, ntile(3) OVER (PARTITION BY cap ORDER BY win) AS third FROM sig WHERE kind = 'kill'), a AS (SELECT cap, third, avg(raw) AS level FROM n GROUP BY ALL)
 SELECT cap, third, round(level - lag(level) OVER (PARTITION BY cap ORDER BY third), 6) AS rise FROM a""")  # fmt: skip
def section_thirds(spark, sf_dir):
    """How much the level rises from third to third."""
    rows = signals(spark, sf_dir).where("kind = 'kill'").select("cap", "raw", F.ntile(3).over(Window.partitionBy("cap").orderBy("win")).alias("third"))
    by = rows.groupBy("cap", "third").agg(F.avg("raw").alias("level"))
    return by.select("cap", "third", F.round(F.col("level") - F.lag("level").over(Window.partitionBy("cap").orderBy("third")), 6).alias("rise"))


@query("progress_rate", EV + f""", p AS (SELECT cap, id, t, row_number() OVER (PARTITION BY cap ORDER BY t, id) AS done, count(*) OVER (PARTITION BY cap) AS total, count(*) OVER (PARTITION BY cap ORDER BY t RANGE BETWEEN {48 * H} PRECEDING AND CURRENT ROW) AS recent, min(t) OVER (PARTITION BY cap ORDER BY t RANGE BETWEEN {48 * H} PRECEDING AND CURRENT ROW) AS since FROM ev)
 SELECT cap, id, done, round((total - done) * (t - since) / nullif(recent - 1, 0) / {H}.0, 4) AS hours_left FROM p""")  # fmt: skip
def progress_rate(spark, sf_dir):
    """Time left at the throughput of the last 48 hours; null before it is known."""
    lately = Window.partitionBy("cap").orderBy("t").rangeBetween(-48 * HOUR, 0)
    rows = load_events(spark, sf_dir).select(
        "cap", "id", "t", F.row_number().over(Window.partitionBy("cap").orderBy("t", "id")).cast("long").alias("done"), F.count("*").over(Window.partitionBy("cap")).alias("total"), F.count("*").over(lately).alias("recent"), F.min("t").over(lately).alias("since")
    )
    return rows.select("cap", "id", "done", F.round((F.col("total") - F.col("done")) * (F.col("t") - F.col("since")) / F.nullif(F.col("recent") - 1, F.lit(0)) / F.lit(float(HOUR)), 4).alias("hours_left"))


@query("gaussian_clip", EV + SIGNAL + """, z AS (SELECT cap, kind, win, least(greatest((raw - avg(raw) OVER w) / nullif(stddev_pop(raw) OVER w, 0), -2), 2) AS z FROM sig WINDOW w AS (PARTITION BY cap, kind)),
 s AS (SELECT cap, kind, win, """ + ", ".join(f"lag(z, {k}) OVER w AS b{k}, lead(z, {k}) OVER w AS a{k}" for k in (1, 2, 3)) + """, z FROM z WINDOW w AS (PARTITION BY cap, kind ORDER BY win))
 SELECT cap, kind, win, round((z + """ + " + ".join(f"exp(-{k * k} / 4.5) * (coalesce(b{k}, 0) + coalesce(a{k}, 0))" for k in (1, 2, 3)) + ") / (1 + " + " + ".join(f"exp(-{k * k} / 4.5) * (CASE WHEN b{k} IS NULL THEN 0 ELSE 1 END + CASE WHEN a{k} IS NULL THEN 0 ELSE 1 END)" for k in (1, 2, 3)) + "), 4) + 0.0 AS smooth FROM s")
def gaussian_clip(spark, sf_dir):
    """Standard scores clipped at two, smoothed by a Gaussian of seven taps that keeps its weight at the edges."""
    own, order = Window.partitionBy("cap", "kind"), Window.partitionBy("cap", "kind").orderBy("win")
    z = F.least(F.greatest((F.col("raw") - F.avg("raw").over(own)) / F.nullif(F.stddev_pop("raw").over(own), F.lit(0.0)), F.lit(-2.0)), F.lit(2.0))
    rows = signals(spark, sf_dir).withColumn("z", z)
    total, weight = F.col("z"), F.lit(1.0)
    for k in (1, 2, 3):
        tap = F.exp(F.lit(-k * k / 4.5))
        sides = F.lag("z", k).over(order), F.lead("z", k).over(order)
        for x in sides:
            total, weight = total + tap * F.coalesce(x, F.lit(0.0)), weight + tap * F.when(x.isNull(), 0).otherwise(1)
    return rows.select("cap", "kind", "win", (F.round(total / weight, 4) + 0.0).alias("smooth"))


@query("floored_maximum", EV + f""", w AS (SELECT cap, unnest(generate_series(0, 59)) AS win FROM (SELECT DISTINCT cap FROM ev) c), l AS (SELECT cap, t, CASE WHEN v IS NULL OR isnan(v) THEN -70 ELSE greatest(ln(v + 0.001) * 10, -70) END AS lufs FROM ev WHERE kind = 'assist' AND t BETWEEN 0 AND {720 * H})
 SELECT w.cap, win, round(coalesce(max(lufs), -70), 4) AS level FROM w LEFT JOIN l ON l.cap = w.cap AND l.t BETWEEN win * {12 * H} AND win * {12 * H} + {24 * H} GROUP BY ALL""")  # fmt: skip
def floored_maximum(spark, sf_dir):
    """The greatest level of each window of the whole grid, floored; what has no level, or no number for one, is at the floor."""
    e = load_events(spark, sf_dir)
    level = F.when(F.col("v").isNull() | F.isnan("v"), -70.0).otherwise(F.greatest(F.log(F.col("v") + 0.001) * 10, F.lit(-70.0)))
    found = grid.expand(e.where("kind = 'assist'").withColumn("lufs", level)).groupBy("cap", "win").agg(F.max("lufs").alias("level"))
    every = e.select("cap").distinct().select("cap", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid.COUNT - 1).cast("long"))).alias("win"))
    return every.join(found, ["cap", "win"], "left").select("cap", "win", F.round(F.coalesce("level", F.lit(-70.0)), 4).alias("level"))


@query("presence_known", EV + f""", w AS (SELECT cap, unnest(generate_series(0, 59)) AS win FROM (SELECT DISTINCT cap FROM ev) c), s AS (SELECT cap, max(t) AS last FROM ev WHERE kind = 'shot' GROUP BY cap),
 h AS (SELECT DISTINCT w.cap, win FROM w JOIN ev ON ev.cap = w.cap AND kind = 'shot' AND t BETWEEN win * {12 * H} - {6 * H} AND win * {12 * H} + {24 * H} + {6 * H}),
 p AS (SELECT w.cap, w.win, CASE WHEN w.win * {12 * H} > s.last THEN NULL WHEN h.win IS NOT NULL THEN 1 ELSE 0 END AS seen FROM w LEFT JOIN s ON s.cap = w.cap LEFT JOIN h ON h.cap = w.cap AND h.win = w.win)
 SELECT cap, win, CASE WHEN avg(seen) OVER (PARTITION BY cap) >= 0.2 THEN seen END AS present FROM p""")  # fmt: skip
def presence_known(spark, sf_dir):
    """Whether shots lie in or near each window; unknown after the last one, and for captures that hardly show any."""
    e = load_events(spark, sf_dir)
    shots = e.where("kind = 'shot'")
    every = e.select("cap").distinct().select("cap", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid.COUNT - 1).cast("long"))).alias("win"))
    low, high = F.ceil((F.col("t") - 30 * HOUR) / (12 * HOUR)), F.floor((F.col("t") + 6 * HOUR) / (12 * HOUR))
    hits = shots.select("cap", F.explode(F.sequence(low, high)).alias("win")).distinct().withColumn("hit", F.lit(1))
    last = shots.groupBy("cap").agg(F.max("t").alias("last"))
    rows = every.join(last, "cap", "left").join(hits, ["cap", "win"], "left").withColumn("seen", F.when(F.col("win") * 12 * HOUR > F.col("last"), None).otherwise(F.coalesce("hit", F.lit(0))))
    return rows.select("cap", "win", F.when(F.avg("seen").over(Window.partitionBy("cap")) >= 0.2, F.col("seen")).alias("present"))


@query("held_hits", EV + SIGNAL + """, h AS (SELECT cap, kind, win, CASE WHEN win - lag(win) OVER (PARTITION BY cap, kind ORDER BY win) <= 3 THEN 0 ELSE 1 END AS f FROM sig WHERE raw > 60), n AS (SELECT *, sum(f) OVER (PARTITION BY cap, kind ORDER BY win) AS run FROM h)
 SELECT cap, kind, min(win) AS win, count(*) AS hits FROM n GROUP BY cap, kind, run HAVING count(*) >= 2""")  # fmt: skip
def held_hits(spark, sf_dir):
    """Events from hits that follow one another over gaps of two windows, two of them at least, dated at the first."""
    o = Window.partitionBy("cap", "kind").orderBy("win")
    rows = signals(spark, sf_dir).where("raw > 60").withColumn("f", F.when(F.col("win") - F.lag("win").over(o) <= 3, 0).otherwise(1)).withColumn("run", F.sum("f").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("cap", "kind", "run").agg(F.min("win").alias("win"), F.count("*").alias("hits")).where("hits >= 2").drop("run")


@query("score_changes", EV + """, c AS (SELECT cap, t, max(id) AS id, max(CASE WHEN kind = 'kill' THEN 1 ELSE 0 END) AS up FROM ev WHERE kind IN ('kill', 'death') GROUP BY cap, t // 3600000000, t), d AS (SELECT *, sum(1 - up) OVER (PARTITION BY cap ORDER BY t) AS life FROM c)
 SELECT cap, t, CAST(sum(up) OVER (PARTITION BY cap, life ORDER BY t) AS BIGINT) AS score FROM d""")  # fmt: skip
def score_changes(spark, sf_dir):
    """A counter that deaths set back, as a sequence of instants: several changes at one instant are one."""
    rows = load_events(spark, sf_dir).where("kind in ('kill', 'death')").groupBy("cap", "t").agg(F.max((F.col("kind") == "kill").cast("int")).alias("up"))
    order = Window.partitionBy("cap").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    lives = rows.withColumn("life", F.sum(1 - F.col("up")).over(order))
    return lives.select("cap", "t", F.sum("up").over(Window.partitionBy("cap", "life").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)).alias("score"))


@query("rank_percentiles", EV + """, r AS (SELECT cap, v, row_number() OVER (PARTITION BY cap ORDER BY v, id) AS n, count(*) OVER (PARTITION BY cap) AS c FROM ev WHERE kind = 'shot')
 SELECT cap, max(v) FILTER (WHERE n = floor(0.9 * (c - 1)) + 1) AS floor_rank, max(v) FILTER (WHERE n = ceil(0.9 * c)) AS ceil_rank, max(v) FILTER (WHERE n = c // 2 + 1) AS upper_median, max(v) FILTER (WHERE n = floor(0.9 * c + 0.5)) AS rounded_rank FROM r GROUP BY cap""")  # fmt: skip
def rank_percentiles(spark, sf_dir):
    """Percentiles by rank: rounded down, up, to the nearest, and the upper median; from ranks, so that no capture's values are gathered in a row."""
    own = Window.partitionBy("cap")
    rows = load_events(spark, sf_dir).where("kind = 'shot'").select("cap", "v", F.row_number().over(own.orderBy("v", "id")).alias("n"), F.count("*").over(own).alias("c"))
    at = lambda place: F.max(F.when(F.col("n") == place, F.col("v")))
    nine, c = F.lit(0.9), F.col("c")
    return rows.groupBy("cap").agg(at(F.floor(nine * (c - 1)) + 1).alias("floor_rank"), at(F.ceil(nine * c)).alias("ceil_rank"), at(F.floor(c / 2) + 1).alias("upper_median"), at(F.floor(nine * c + 0.5)).alias("rounded_rank"))


# Kernels by Arrow batches, and table functions ----------------------------------------------------------------------------------------------------

def vectors(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))


def batched(fn, kind: str):
    """A function of one array as an Arrow-batched column function."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for xs in batches:
            yield pd.Series([fn(np.asarray(x, float)) for x in xs])

    return F.pandas_udf(run, kind)


def _kernel(name: str, doc: str, fn, kind: str, into: str = "value"):
    def run(spark, sf_dir: str) -> DataFrame:
        return vectors(spark, sf_dir).select("vec_id", batched(fn, kind)("x").alias(into))

    run.__name__, run.__doc__, run.__module__ = name, doc, __name__
    query(name)(run)


_kernel("mel_levels", "The mean of each vector's log-mel rows, as a signal repeated to one frame.", lambda x: round(float(kernels.log_mel(np.resize(x, 800)).mean()), 6), "double")
_kernel("onset_strength", "The sum of spectral rises over an image's lines.", lambda x: round(float(kernels.onset_envelope(x.reshape(8, 8)).sum()), 6), "double")
_kernel("beat_tempo", "Beats a minute of a signal of four samples a second.", lambda x: round(kernels.tempo(np.abs(x), 4.0), 4), "double")
_kernel("percussive_parts", "The mean share of energy across bands.", lambda x: round(float(kernels.percussive_share(np.abs(x).reshape(8, 8), 3).mean()), 6), "double")
_kernel("section_novelty", "The place of the greatest novelty along an image's lines.", lambda x: int(np.argmax(kernels.novelty(np.corrcoef(x.reshape(16, 4)), 4))), "long")
_kernel("template_matches", "The best normalised correlation of an image's centre anywhere in it but there.", lambda x: round(float(_best_elsewhere(x.reshape(8, 8))), 6), "double")
_kernel("mask_boxes", "Connected parts of an image's mask.", lambda x: len(kernels.boxes(x.reshape(8, 8) > 0.1)), "long")
_kernel("own_lag", "The lag by which the second half of a signal follows the first, if one stands out.", lambda x: sequences.best_lag(x[:32], x[32:], 8, 0.05), "long")
_kernel("cluster_labels", "The best one-to-one labels of four clusters, by their scores.", lambda x: int("".join(str(c) for c in kernels.best_labelling(x[:16].reshape(4, 4))[0][1])), "long")


def _best_elsewhere(image: np.ndarray) -> float:
    found = kernels.correlation(image, image[3:6, 3:6])
    found[3, 3] = -1
    return found.max()


@query("common_subsequences")
def common_subsequences(spark, sf_dir):
    """Length of the longest common subsequence of the kinds in each capture's earlier and later half."""
    run = lambda g: [(sequences.longest_common(g.kind.tolist()[: len(g) // 2], g.kind.tolist()[len(g) // 2 :]),)]
    return per_key(load_events(spark, sf_dir).select("cap", "id", "t", "kind"), "cap", run, {"length": "long"}, ["t", "id"])


@query("variant_distance")
def variant_distance(spark, sf_dir):
    """How far two cuts of each capture's evenings lie apart: what they don't have in common in order, cuts without a partner, and the shift of the passage."""

    def run(g: pd.DataFrame) -> list[tuple]:
        a, b = g[g.id % 3 != 0], g[g.id % 3 != 1]
        most = max(len(a), len(b), 1)
        apart = 1 - len(sequences.common_places(a.id.tolist(), b.id.tolist())) / most
        cuts = 1 - len(np.intersect1d(a.t // DAY, b.t // DAY)) / max(len(np.union1d(a.t // DAY, b.t // DAY)), 1)
        shift = min(1.0, abs(float(a.t.iloc[0] - b.t.iloc[0])) / (4 * DAY)) if len(a) and len(b) else 1.0
        return [(round(max(apart, cuts, shift), 6),)]

    return per_key(load_events(spark, sf_dir).where("kind = 'kill'").select("cap", "id", "t"), "cap", run, {"distance": "double"}, ["t", "id"])


@query("row_tracks")
def row_tracks(spark, sf_dir):
    """Rows followed over frames of six hours: columns by event number, heights by value."""

    def run(g: pd.DataFrame) -> list[tuple]:
        frames = [list(zip((f.id % 4).astype(float).tolist(), f.v.tolist(), f.kind, strict=True)) for _, f in g.groupby("frame")]
        return [(int(a), k) for a, k in kernels.track_rows(frames, 0.5, 2, 8)]

    rows = load_events(spark, sf_dir).where("kind in ('kill', 'death')").select("cap", "id", F.floor(F.col("t") / (6 * HOUR)).alias("frame"), "v", "kind")
    return per_key(rows, "cap", run, {"first": "long", "role": "string"}, ["frame", "id"])


@query("hud_shots", EV + f""", p AS (SELECT k.cap, k.id, min(s.t) AS fatal FROM ev k JOIN ev s ON s.cap = k.cap AND s.kind = 'shot' AND s.t BETWEEN k.t - {12 * H} AND k.t + {3 * H} WHERE k.kind = 'kill' GROUP BY k.cap, k.id)
 SELECT p.cap, p.id, fatal, count(s.id) AS shots FROM p LEFT JOIN ev s ON s.cap = p.cap AND s.kind = 'shot' AND s.t BETWEEN fatal AND fatal + {24 * H} GROUP BY ALL""")  # fmt: skip
def hud_shots(spark, sf_dir):
    """Shots of the burst that begins at each kill's first shot near it, counted forward."""
    e = load_events(spark, sf_dir)
    shots = e.where("kind = 'shot'").select("cap", "id", "t")
    first = matching.near_events(e.where("kind = 'kill'"), shots, 12 * HOUR, 3 * HOUR).groupBy("cap", F.col("lid").alias("id")).agg(F.min("rt").alias("t"))
    burst = matching.near_events(first, shots, 0, 24 * HOUR).groupBy("cap", F.col("lid").alias("id")).agg(F.count("*").alias("shots"))
    return first.join(burst, ["cap", "id"]).select("cap", "id", F.col("t").alias("fatal"), "shots")


@query("windows_table_function", EV + SIGNAL.split(", sig AS")[0] + " SELECT cap, id, win FROM g WHERE kind = 'kill'")
def windows_table_function(spark, sf_dir):
    """The windows that cover an instant, by a Python table function beside the built-in expansion."""

    @F.udtf(returnType=StructType([StructField("win", LongType())]))
    class Covering:
        def eval(self, t: int):  # noqa: A003
            low, high = max(0, -(-(t - grid.SIZE) // grid.HOP)), min(grid.COUNT - 1, t // grid.HOP)
            for k in range(low, high + 1):
                yield (k,)

    spark.udtf.register("covering_windows", Covering)
    load_events(spark, sf_dir).where(f"kind = 'kill' and t between 0 and {grid.TOTAL}").createOrReplaceTempView("kills_to_cover")
    found = spark.sql("SELECT k.cap, k.id, w.win FROM kills_to_cover k, LATERAL covering_windows(k.t) w")
    # The plan holds what the view stood for.
    spark.catalog.dropTempView("kills_to_cover")
    return found


@query("merging_table_function", EV + MERGED + " SELECT cap, s, e FROM merged")
def merging_table_function(spark, sf_dir):
    """Merged spans by a table function over partitions: it keeps the open span from row to row and gives the last one at its partition's end, which no built-in generator can."""

    @F.udtf(returnType="cap long, s long, e long")
    class Merging:
        def __init__(self):
            self.open = None

        def eval(self, row):  # noqa: A003
            if self.open and row["s"] <= self.open[2]:
                self.open[2] = max(self.open[2], row["e"])
                return
            if self.open:
                yield tuple(self.open)
            self.open = [row["cap"], row["s"], row["e"]]

        def terminate(self):
            if self.open:
                yield tuple(self.open)

    spans = positive(spark, sf_dir).select("cap", "s", "e")
    return Merging(spans.asTable().partitionBy("cap").orderBy("s", "e"))


@query("model_labels")
def model_labels(spark, sf_dir):
    """Classes of vectors by a model loaded once for each worker and applied in batches of 32: here the nearest of fixed directions."""

    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = np.random.default_rng(3).normal(size=(64, 10))
        for xs in batches:
            found = [np.argmax(np.stack(xs.iloc[a : a + 32]) @ weights, axis=1) for a in range(0, len(xs), 32)]
            yield pd.Series(np.concatenate(found) if found else np.zeros(0, np.int64))

    return vectors(spark, sf_dir).select("vec_id", F.pandas_udf(classify, "long")("x").alias("class"))
