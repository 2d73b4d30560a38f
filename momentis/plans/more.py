"""Further rows of the inventory: predicates, look-ups, criteria, runs, spans and scalar rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from momentis.functions.events import DAY, HOUR, TOTAL, load_events
from momentis.operators import intervals
from momentis.plans.moments import EV, SIGNAL, H, signals
from momentis.operators.keyed import per_key
from momentis.plans.registry import query
from momentis.plans.sessions import GAMES, GROUPS, games, outcomes
from momentis.session import table


@query("event_mapping", EV + f" SELECT id, kind, least(greatest(t + CASE kind WHEN 'kill' THEN {-2 * H} WHEN 'death' THEN {H} ELSE 0 END, 0), {720 * H}) AS t FROM ev WHERE kind <> 'assist'")
def event_mapping(spark, sf_dir):
    """Kinds renamed, one dropped, times shifted by kind and clamped into the capture."""
    shift = F.when(F.col("kind") == "kill", -2 * HOUR).when(F.col("kind") == "death", HOUR).otherwise(0)
    return load_events(spark, sf_dir).where("kind <> 'assist'").select("id", "kind", F.least(F.greatest(F.col("t") + shift, F.lit(0)), F.lit(TOTAL)).alias("t"))


@query("quality_floor", EV + GROUPS + """, f AS (SELECT cap, grp, score, count(*) FILTER (WHERE score >= 95) OVER (PARTITION BY cap) AS good, row_number() OVER (PARTITION BY cap ORDER BY score DESC, grp) AS n FROM gr)
 SELECT cap, grp FROM f WHERE score >= 95 OR (good = 0 AND n <= 3)""")  # fmt: skip
def quality_floor(spark, sf_dir):
    """Groups over the floor; where none is, the capture's best three."""
    own = Window.partitionBy("cap")
    rows = outcomes(spark, sf_dir).withColumns({"good": F.sum((F.col("score") >= 95).cast("int")).over(own), "n": F.row_number().over(own.orderBy(F.desc("score"), "grp"))})
    return rows.where("score >= 95 or (good = 0 and n <= 3)").select("cap", "grp")


@query("accepted_files", r"SELECT page_id, regexp_matches(lower(url), '\.(html?|com|net)([/?#]|$)') AND NOT regexp_matches(lower(url), '(token|secret|auth)') AS accepted FROM pages")
def accepted_files(spark, sf_dir):
    url = F.lower("url")
    return table(spark, sf_dir, "pages").select("page_id", (url.rlike(r"\.(html?|com|net)([/?#]|$)") & ~url.rlike("(token|secret|auth)")).alias("accepted"))


@query("unique_name_lookup", """WITH n AS (SELECT page_id, url, regexp_extract(url, '([^/]*)$', 1) AS base FROM pages), u AS (SELECT base, min(page_id) AS found FROM n GROUP BY base HAVING count(*) = 1)
 SELECT n.page_id, u.found FROM n LEFT JOIN u USING (base)""")  # fmt: skip
def unique_name_lookup(spark, sf_dir):
    """A file found by its name only where that is unique."""
    n = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "([^/]*)$", 1).alias("base"))
    u = n.groupBy("base").agg(F.min("page_id").alias("found"), F.count("*").alias("n")).where("n = 1").drop("n")
    return n.join(u, "base", "left").select("page_id", "found")


@query("kinds_of_capture", EV + " SELECT cap, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM ev GROUP BY cap")
def kinds_of_capture(spark, sf_dir):
    return load_events(spark, sf_dir).groupBy("cap").agg(F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


@query("criteria_mean", EV + GAMES + """, c AS (SELECT cap, game, CASE WHEN deaths IS NOT NULL THEN least(kills / greatest(deaths, 1) / 3.0, 1) END AS a, least(headshots / nullif(kills, 0), 1) AS b, least(kills / 10.0, 1) AS k FROM game)
 SELECT cap, game, round((coalesce(0.5 * a, 0) + coalesce(0.3 * b, 0) + 0.2 * k) / (CASE WHEN a IS NULL THEN 0 ELSE 0.5 END + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END + 0.2), 6) AS score FROM c""")  # fmt: skip
def criteria_mean(spark, sf_dir):
    """A weighted mean over the criteria that are known."""
    c = games(spark, sf_dir)
    parts = [(0.5, F.when(F.col("deaths").isNotNull(), F.least(F.col("kills") / F.greatest("deaths", F.lit(1)) / 3.0, F.lit(1.0)))), (0.3, F.least(F.col("headshots") / F.nullif("kills", F.lit(0)), F.lit(1.0))), (0.2, F.least(F.col("kills") / 10.0, F.lit(1.0)))]
    total, weight = F.lit(0.0), F.lit(0.0)
    for w, x in parts:
        total, weight = total + F.coalesce(w * x, F.lit(0.0)), weight + F.when(x.isNull(), 0.0).otherwise(w)
    return c.select("cap", "game", F.round(total / weight, 6).alias("score"))


@query("concordance", EV + GAMES + """, p AS (SELECT a.cap, CASE WHEN (a.kills - b.kills) * (a.duration - b.duration) > 0 THEN 1 ELSE 0 END AS ok FROM game a JOIN game b ON a.cap = b.cap AND a.game < b.game AND a.kills <> b.kills)
 SELECT cap, round(avg(ok), 6) AS ratio FROM p GROUP BY cap""")  # fmt: skip
def concordance(spark, sf_dir):
    """Share of a capture's pairs of games in which more kills go with more time, counted by sorted insertion instead of pair by pair."""
    from bisect import bisect_left, insort
    from itertools import groupby

    def run(g):
        rows = list(zip(g.kills.tolist(), g.duration.tolist(), strict=True))
        seen: list[int] = []
        ok = pairs = 0
        for _, same in groupby(rows, key=lambda r: r[0]):
            lengths = [d for _, d in same]
            ok += sum(bisect_left(seen, d) for d in lengths)
            pairs += len(seen) * len(lengths)
            for d in lengths:
                insort(seen, d)
        return [(round(ok / pairs, 6),)] if pairs else []

    return per_key(games(spark, sf_dir).select("cap", "kills", "duration"), "cap", run, {"ratio": "double"}, ["kills", "duration"])


@query("held_runs", EV + SIGNAL + """, h AS (SELECT cap, win, win - row_number() OVER (PARTITION BY cap ORDER BY win) AS run FROM sig WHERE kind = 'kill' AND raw > 40) SELECT cap, min(win) AS win, count(*) AS n FROM h GROUP BY cap, run HAVING count(*) >= 3""")
def held_runs(spark, sf_dir):
    """Runs of at least three windows over a level, dated at their first."""
    run = F.col("win") - F.row_number().over(Window.partitionBy("cap").orderBy("win"))
    rows = signals(spark, sf_dir).where("kind = 'kill' and raw > 40").withColumn("run", run)
    return rows.groupBy("cap", "run").agg(F.min("win").alias("win"), F.count("*").alias("n")).where("n >= 3").drop("run")


@query("salience", EV + SIGNAL + """, n AS (SELECT *, quantile_cont(raw, 0.5) OVER (PARTITION BY cap, kind ORDER BY win ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m, max(raw) OVER (PARTITION BY cap, kind ORDER BY win ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS top FROM sig)
 SELECT cap, kind, win, round(greatest(raw - m, 0) * raw / nullif(top, 0), 6) AS salience FROM n""")  # fmt: skip
def salience(spark, sf_dir):
    """Rise over the neighbours' median, weighed by the level against the local maximum."""
    by = Window.partitionBy("cap", "kind").orderBy("win")
    rows = signals(spark, sf_dir).withColumns({"m": F.percentile("raw", 0.5).over(by.rowsBetween(-4, 4)), "top": F.max("raw").over(by.rowsBetween(-8, 8))})
    return rows.select("cap", "kind", "win", F.round(F.greatest(F.col("raw") - F.col("m"), F.lit(0.0)) * F.col("raw") / F.nullif("top", F.lit(0.0)), 6).alias("salience"))


@query("split_groups", EV + GROUPS + f""", x AS (SELECT cap, grp, t, id, CASE WHEN t - lag(t) OVER (PARTITION BY cap, grp ORDER BY t, id) > {4 * H} THEN 1 ELSE 0 END AS f FROM kg)
 SELECT cap, grp, CAST(part AS BIGINT) AS part, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY cap, grp ORDER BY t, id) AS part FROM x) GROUP BY ALL""")  # fmt: skip
def split_groups(spark, sf_dir):
    """Groups cut where their inner silence is long."""
    from momentis.plans.sessions import rounds

    order = Window.partitionBy("cap").orderBy("t", "id")
    kills = rounds(spark, sf_dir).where("kind = 'kill'").withColumn("turn", F.col("round") != F.lag("round").over(order))
    grouped = intervals.islands(kills, "cap", "t", 12 * HOUR, breaks=F.col("turn"))
    within = Window.partitionBy("cap", "grp").orderBy("t", "id")
    cut = grouped.withColumn("f", F.when(F.col("t") - F.lag("t").over(within) > 4 * HOUR, 1).otherwise(0))
    return cut.withColumn("part", F.sum("f").over(within.rowsBetween(Window.unboundedPreceding, 0))).groupBy("cap", "grp", "part").agg(F.count("*").alias("n"))


@query("merge_strongest", EV + f""", r AS (SELECT cap, id, t, kind, v, CASE WHEN t - lag(t) OVER o <= {6 * H} THEN 0 ELSE 1 END AS f FROM ev WHERE kind IN ('headshot', 'assist') WINDOW o AS (PARTITION BY cap ORDER BY t, id)),
 g AS (SELECT *, sum(f) OVER (PARTITION BY cap ORDER BY t, id) AS grp FROM r) SELECT cap, CAST(grp AS BIGINT) AS grp, min(t) AS s, max(t) AS e, max(v) AS strength, min(kind) AS kind FROM g GROUP BY cap, grp""")  # fmt: skip
def merge_strongest(spark, sf_dir):
    """Reactions merged over gaps, with the strongest level and the first kind by name."""
    rows = load_events(spark, sf_dir).where("kind in ('headshot', 'assist')")
    return intervals.islands(rows, "cap", "t", 6 * HOUR).groupBy("cap", "grp").agg(F.min("t").alias("s"), F.max("t").alias("e"), F.max("v").alias("strength"), F.min("kind").alias("kind"))


@query("distinct_chain", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY source, n_chars ORDER BY doc_id) AS m FROM a WHERE n = 1) SELECT doc_id FROM b WHERE m = 1""")
def distinct_chain(spark, sf_dir):
    """Distinct by text, then by source and length; the first stays. The texts are compared by digest, so they aren't shuffled."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), "source", "n_chars")
    first = d.groupBy("h").agg(F.min_by(F.struct("doc_id", "source", "n_chars"), "doc_id").alias("x")).select("x.*")
    return first.groupBy("source", "n_chars").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("music_rank", EV + GAMES + """, m AS (SELECT cap, count(*) AS n, avg(kills) AS k, max(s) AS last FROM game GROUP BY cap), r AS (SELECT *, n * 1.0 / max(n) OVER () AS share, row_number() OVER (ORDER BY last DESC, cap) AS recent FROM m)
 SELECT cap, round(k * share + least(greatest((n - 2) / 8.0, 0), 1) * 0.5 - CASE WHEN recent <= 3 THEN 1 ELSE 0 END, 6) AS score FROM r""")  # fmt: skip
def music_rank(spark, sf_dir):
    """Score times the share of the most used, a pace bonus, and a penalty for the three most recent."""
    m = games(spark, sf_dir).groupBy("cap").agg(F.count("*").alias("n"), F.avg("kills").alias("k"), F.max("s").alias("last"))
    top = m.agg(F.max("n").alias("most"))
    recent = m.orderBy(F.desc("last"), "cap").limit(3).select("cap", F.lit(1).alias("recent"))
    rows = m.crossJoin(F.broadcast(top)).join(F.broadcast(recent), "cap", "left")
    score = F.col("k") * (F.col("n") * 1.0 / F.col("most")) + F.least(F.greatest((F.col("n") - 2) / 8.0, F.lit(0.0)), F.lit(1.0)) * 0.5 - F.coalesce("recent", F.lit(0))
    return rows.select("cap", F.round(score, 6).alias("score"))


@query("cadence", "SELECT p_partkey, round(2.0 * pow(8.0 / 2.0, p_size / 50.0), 6) AS pace, CAST(pow(2, round(log2(greatest(p_size, 1)))) AS BIGINT) AS beats FROM part")
def cadence(spark, sf_dir):
    """Geometric interpolation, and the nearest power of two."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(2.0 * F.pow(F.lit(4.0), size / 50.0), 6).alias("pace"), F.pow(F.lit(2.0), F.round(F.log2(F.greatest(size, F.lit(1))))).cast("long").alias("beats"))


@query("decibels", EV + " SELECT id, round(20 * log10(v + 1e-6), 6) AS db FROM ev WHERE v >= 0")
def decibels(spark, sf_dir):
    return load_events(spark, sf_dir).where("v >= 0").select("id", F.round(20 * F.log10(F.col("v") + 1e-6), 6).alias("db"))


@query("aspect_labels", """WITH r AS (SELECT p_partkey, p_size / 25.0 AS ratio FROM part), k(label, x) AS (VALUES ('1:1', 1.0), ('4:3', 1.3333), ('16:9', 1.7778)), d AS (SELECT p_partkey, label, abs(ratio - x) AS d, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(ratio - x), label) AS n FROM r, k)
 SELECT p_partkey, CASE WHEN d < 0.06 THEN label ELSE 'other' END AS label FROM d WHERE n = 1""")  # fmt: skip
def aspect_labels(spark, sf_dir):
    """The nearest known ratio, if it is near enough."""
    ratio = F.col("p_size") / 25.0
    near = F.least(*(F.struct(F.abs(ratio - x).alias("d"), F.lit(label).alias("label")) for label, x in (("1:1", 1.0), ("4:3", 1.3333), ("16:9", 1.7778))))
    return table(spark, sf_dir, "part").withColumn("near", near).select("p_partkey", F.when(F.col("near.d") < 0.06, F.col("near.label")).otherwise("other").alias("label"))


@query("time_remap", EV + f" SELECT id, CAST(least(t, {240 * H}) + greatest(least(t, {480 * H}) - {240 * H}, 0) // 2 + greatest(t - {480 * H}, 0) * 2 AS BIGINT) AS out_t FROM ev WHERE t >= 0")
def time_remap(spark, sf_dir):
    """Source to output time through speed segments (once, double, half), as a fold over the segments."""
    segments = F.array(*(F.struct(F.lit(a * HOUR).alias("a"), F.lit(b * HOUR).alias("b"), F.lit(n).alias("n"), F.lit(d).alias("d")) for a, b, n, d in ((0, 240, 1, 1), (240, 480, 1, 2), (480, 10_000, 2, 1))))
    out = F.aggregate(segments, F.lit(0).cast("long"), lambda s, x: s + F.floor(F.greatest(F.least(F.col("t"), x["b"]) - x["a"], F.lit(0)) * x["n"] / x["d"]))
    return load_events(spark, sf_dir).where("t >= 0").select("id", out.alias("out_t"))


@query("moved_items", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN r = 3 THEN 0.5 ELSE r END) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)")
def moved_items(spark, sf_dir):
    """The third of each list moved to its front."""
    own = Window.partitionBy("o_custkey")
    rows = table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(own.orderBy("o_orderkey")))
    return rows.select("o_orderkey", F.row_number().over(own.orderBy(F.when(F.col("r") == 3, 0.5).otherwise(F.col("r")))).cast("long").alias("place"))


@query("three_orders", """SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END ASC NULLS LAST, event_id) AS chronological, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS by_score FROM events""")
def three_orders(spark, sf_dir):
    """Chronological with unknown times last, and by score."""
    at = F.when(F.col("event_id") % 11 != 0, F.col("ts"))
    own = Window.partitionBy("user_id")
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(own.orderBy(at.asc_nulls_last(), "event_id")).cast("long").alias("chronological"), F.row_number().over(own.orderBy(F.desc("value"), "event_id")).cast("long").alias("by_score"))


@query("shot_levels", EV + """, p AS (SELECT cap, list_sort(list(v))[CAST(floor(0.9 * (count(*) - 1)) AS BIGINT) + 1] AS p FROM ev WHERE kind = 'shot' GROUP BY cap) SELECT e.cap, e.id FROM ev e JOIN p USING (cap) WHERE kind = 'shot' AND v >= p - 30""")
def shot_levels(spark, sf_dir):
    """Shots near the capture's loud ones (the floor-rank 90th percentile, by rank)."""
    own = Window.partitionBy("cap")
    shots = load_events(spark, sf_dir).where("kind = 'shot'").withColumns({"r": F.row_number().over(own.orderBy("v", "id")), "n": F.count("*").over(own)})
    level = F.max(F.when(F.col("r") == F.floor(F.lit(0.9) * (F.col("n") - 1)) + 1, F.col("v"))).over(own)
    return shots.withColumn("p", level).where("v >= p - 30").select("cap", "id")


@query("target_duration", EV + GROUPS + " SELECT cap, round(CAST(least(greatest(sum(2.5 + 1.5 * (kills - 1) + CASE WHEN ace THEN 2 ELSE 0 END), 10), 60) AS DOUBLE), 6) AS seconds FROM oc GROUP BY cap")
def target_duration(spark, sf_dir):
    """Seconds for a capture's groups, between ten and sixty."""
    own = F.sum(F.lit(2.5) + F.lit(1.5) * (F.col("kills") - 1) + F.when(F.col("ace"), 2).otherwise(0))
    return outcomes(spark, sf_dir).groupBy("cap").agg(F.round(F.least(F.greatest(own, F.lit(10.0)), F.lit(60.0)), 6).alias("seconds"))


@query("version_order", "SELECT s_suppkey, (s_suppkey % 7) * 1000000 + (s_nationkey % 5) * 1000 + s_suppkey % 11 > 3002005 AS newer FROM supplier")
def version_order(spark, sf_dir):
    """Whether a dotted version is after 3.2.5, part by part."""
    text = F.concat_ws(".", (F.col("s_suppkey") % 7).cast("string"), (F.col("s_nationkey") % 5).cast("string"), (F.col("s_suppkey") % 11).cast("string"))
    parts = F.transform(F.split(text, r"\."), lambda x: x.cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", (parts > F.array(F.lit(3), F.lit(2), F.lit(5))).alias("newer"))


@query("fixed_days", EV + f" SELECT t // {24 * H} AS day, count(*) AS n FROM ev WHERE t >= 0 GROUP BY ALL")
def fixed_days(spark, sf_dir):
    """Tumbling windows of a day."""
    return load_events(spark, sf_dir).where("t >= 0").groupBy(F.floor(F.col("t") / DAY).alias("day")).agg(F.count("*").alias("n"))
