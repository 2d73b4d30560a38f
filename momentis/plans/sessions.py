"""Rounds, kill groups with their outcome and rank, and the statistics of games and evenings; unknown is null, never 0."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentis.functions.events import HOUR, load_events
from momentis.operators import intervals
from momentis.plans.moments import EV, H
from momentis.plans.registry import query

ROUNDS = f""", kd AS (SELECT *, lag(kind) OVER o AS pk, lag(t) OVER o AS pt FROM ev WHERE kind IN ('kill', 'death') WINDOW o AS (PARTITION BY cap ORDER BY t, CASE kind WHEN 'kill' THEN 0 ELSE 1 END, id)),
 rd AS (SELECT *, CAST(sum(CASE WHEN pt IS NULL OR pk = 'death' OR t - pt > {48 * H} THEN 1 ELSE 0 END) OVER (PARTITION BY cap ORDER BY t, CASE kind WHEN 'kill' THEN 0 ELSE 1 END, id) AS BIGINT) AS round FROM kd)"""
GROUPS = ROUNDS + f""", kl AS (SELECT *, CASE WHEN lag(t) OVER k IS NULL OR t - lag(t) OVER k > {12 * H} OR round <> lag(round) OVER k THEN 1 ELSE 0 END AS f,
  CASE WHEN t - lag(t) OVER k <= {3 * H} THEN 1 ELSE 0 END AS quick FROM rd WHERE kind = 'kill' WINDOW k AS (PARTITION BY cap ORDER BY t, id)),
 kg AS (SELECT *, CAST(sum(f) OVER (PARTITION BY cap ORDER BY t, id) AS BIGINT) AS grp FROM kl),
 gr AS (SELECT cap, grp, min(round) AS round, min(t) AS s, max(t) AS e, count(*) AS kills, max(v) AS score, sum(CASE WHEN f = 0 THEN quick ELSE 0 END) AS quick FROM kg GROUP BY cap, grp),
 rs AS (SELECT cap, round, count(*) FILTER (WHERE kind = 'kill') AS round_kills, min(t) FILTER (WHERE kind = 'death') AS died FROM rd GROUP BY ALL),
 oc AS (SELECT gr.*, coalesce(died - e BETWEEN 0 AND {6 * H}, false) AS traded, round_kills >= 5 AND died IS NOT NULL AND row_number() OVER (PARTITION BY gr.cap, gr.round ORDER BY grp DESC) = 1 AS ace FROM gr JOIN rs ON gr.cap = rs.cap AND gr.round = rs.round)"""


def rounds(spark, sf_dir: str) -> DataFrame:
    """Kills and deaths with their round: a death or a long silence ends one."""
    both = load_events(spark, sf_dir).where("kind in ('kill', 'death')").withColumn("rank", F.when(F.col("kind") == "kill", 0).otherwise(1))
    order = Window.partitionBy("cap").orderBy("t", "rank", "id")
    last_t, last_kind = F.lag("t").over(order), F.lag("kind").over(order)
    fresh = last_t.isNull() | (last_kind == "death") | (F.col("t") - last_t > 48 * HOUR)
    return both.withColumn("fresh", fresh.cast("int")).withColumn("round", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def kill_groups(spark, sf_dir: str) -> DataFrame:
    """Groups of kills, split by silence and by round, with quick repeats counted."""
    order = Window.partitionBy("cap").orderBy("t", "id")
    kills = rounds(spark, sf_dir).where("kind = 'kill'")
    kills = kills.withColumns({"near": F.col("t") - F.lag("t").over(order), "turn": F.col("round") != F.lag("round").over(order)})
    grouped = intervals.islands(kills, "cap", "t", 12 * HOUR, breaks=F.col("turn"))
    first = F.row_number().over(Window.partitionBy("cap", "grp").orderBy("t", "id"))
    grouped = grouped.withColumn("quick", ((first > 1) & (F.col("near") <= 3 * HOUR)).cast("int"))
    return grouped.groupBy("cap", "grp").agg(F.min("round").alias("round"), F.min("t").alias("s"), F.max("t").alias("e"), F.count("*").alias("kills"), F.max("v").alias("score"), F.sum("quick").alias("quick"))


def outcomes(spark, sf_dir: str) -> DataFrame:
    """Groups with traded (a death soon after) and ace (the last group of a round of five kills that a death ends)."""
    per = rounds(spark, sf_dir).groupBy("cap", "round").agg(F.count_if(F.col("kind") == "kill").alias("round_kills"), F.min(F.when(F.col("kind") == "death", F.col("t"))).alias("died"))
    last = F.row_number().over(Window.partitionBy("cap", "round").orderBy(F.desc("grp"))) == 1
    joined = kill_groups(spark, sf_dir).join(per, ["cap", "round"])
    traded = F.coalesce((F.col("died") - F.col("e")).between(0, 6 * HOUR), F.lit(False))
    return joined.withColumns({"traded": traded, "ace": (F.col("round_kills") >= 5) & F.col("died").isNotNull() & last})


@query("rounds", EV + ROUNDS + " SELECT cap, round, count(*) FILTER (WHERE kind = 'kill') AS kills, bool_or(kind = 'death') AS died, min(t) AS s, max(t) AS e FROM rd GROUP BY ALL HAVING count(*) FILTER (WHERE kind = 'kill') > 0")
def rounds_query(spark, sf_dir):
    out = rounds(spark, sf_dir).groupBy("cap", "round").agg(F.count_if(F.col("kind") == "kill").alias("kills"), F.bool_or(F.col("kind") == "death").alias("died"), F.min("t").alias("s"), F.max("t").alias("e"))
    return out.where("kills > 0")


@query("kill_groups", EV + GROUPS + " SELECT cap, grp, round, s, e, kills FROM gr")
def kill_groups_query(spark, sf_dir):
    return kill_groups(spark, sf_dir).select("cap", "grp", "round", "s", "e", "kills")


@query("group_outcome", EV + GROUPS + " SELECT cap, grp, traded, ace FROM oc")
def group_outcome(spark, sf_dir):
    return outcomes(spark, sf_dir).select("cap", "grp", "traded", "ace")


RANK = "kills + score / 10 + 0.3 * quick + CASE WHEN ace THEN 1.5 ELSE 0 END - CASE WHEN traded THEN 0.5 ELSE 0 END"


@query("group_rank", EV + GROUPS + f" SELECT cap, grp, round({RANK}, 6) AS rank FROM oc")
def group_rank(spark, sf_dir):
    return outcomes(spark, sf_dir).select("cap", "grp", F.round(F.expr(RANK), 6).alias("rank"))


@query("multi_kill_hist", EV + GROUPS + " SELECT cap, kills, count(*) AS n FROM gr WHERE kills >= 2 GROUP BY ALL")
def multi_kill_hist(spark, sf_dir):
    return kill_groups(spark, sf_dir).where("kills >= 2").groupBy("cap", "kills").agg(F.count("*").alias("n"))


@query("session_window_events", EV + f""", m AS (SELECT *, CASE WHEN t - lag(t) OVER o <= {48 * H} THEN 0 ELSE 1 END AS f FROM ev WINDOW o AS (PARTITION BY cap ORDER BY t, id)),
 s AS (SELECT *, sum(f) OVER (PARTITION BY cap ORDER BY t, id) AS grp FROM m) SELECT cap, min(t) AS s, count(*) AS n FROM s GROUP BY cap, grp""")  # fmt: skip
def session_window_events(spark, sf_dir):
    """Sessions by the built-in session window, whose gap merges at equality as well."""
    e = load_events(spark, sf_dir).withColumn("at", F.timestamp_micros("t"))
    return e.groupBy("cap", F.session_window("at", "48 hours")).agg(F.min("t").alias("s"), F.count("*").alias("n")).select("cap", "s", "n")


GAMES = f""", gm AS (SELECT *, CASE WHEN t - lag(t) OVER o <= {48 * H} THEN 0 ELSE 1 END AS f FROM ev WINDOW o AS (PARTITION BY cap ORDER BY t, id)),
 gs AS (SELECT *, CAST(sum(f) OVER (PARTITION BY cap ORDER BY t, id) AS BIGINT) AS game FROM gm),
 game AS (SELECT cap, game, min(t) AS s, max(t) - min(t) AS duration, count(*) FILTER (WHERE kind = 'kill') AS kills, CASE WHEN count(*) FILTER (WHERE kind IN ('death', 'shot')) > 0 THEN count(*) FILTER (WHERE kind = 'death') END AS deaths,
  nullif(count(*) FILTER (WHERE kind = 'headshot'), 0) AS headshots FROM gs GROUP BY ALL)"""


def games(spark, sf_dir: str) -> DataFrame:
    """Games with nullable measures: deaths are known where deaths or shots were seen, headshots where any was."""
    e = intervals.islands(load_events(spark, sf_dir), "cap", "t", 48 * HOUR, into="game")
    seen = F.count_if(F.col("kind").isin("death", "shot")) > 0
    return e.groupBy("cap", "game").agg(
        F.min("t").alias("s"), (F.max("t") - F.min("t")).alias("duration"), F.count_if(F.col("kind") == "kill").alias("kills"),
        F.when(seen, F.count_if(F.col("kind") == "death")).alias("deaths"), F.nullif(F.count_if(F.col("kind") == "headshot"), F.lit(0)).alias("headshots"),
    )


@query("game_stats", EV + GAMES + f""" SELECT cap, game, s, duration, kills, deaths, headshots, round(kills / greatest(deaths, 1), 6) AS kd, round(headshots / nullif(kills, 0), 6) AS headshot_rate,
 round(kills / nullif(duration / {H}.0, 0), 6) AS kills_per_hour FROM game""".replace("kills / greatest(deaths, 1)", "CASE WHEN deaths IS NOT NULL THEN kills / greatest(deaths, 1) END"))  # fmt: skip
def game_stats(spark, sf_dir):
    ratio = {"kd": F.when(F.col("deaths").isNotNull(), F.col("kills") / F.greatest("deaths", F.lit(1))), "headshot_rate": F.col("headshots") / F.nullif("kills", F.lit(0)), "kills_per_hour": F.col("kills") / F.nullif(F.col("duration") / F.lit(float(HOUR)), F.lit(0.0))}
    return games(spark, sf_dir).withColumns({k: F.round(x, 6) for k, x in ratio.items()})


EVENINGS = GAMES + f""", evn AS (SELECT cap, CAST(floor((s - {6 * H}) / {24 * H}.0) AS BIGINT) AS evening, count(*) AS games, CAST(sum(kills) AS BIGINT) AS kills, CAST(sum(deaths) AS BIGINT) AS deaths, CAST(sum(duration) AS BIGINT) AS played,
 round(sum(kills) FILTER (WHERE deaths IS NOT NULL) / greatest(sum(deaths), 1), 6) AS kd, max(kills) AS best FROM game GROUP BY ALL)"""


def evenings(spark, sf_dir: str) -> DataFrame:
    """Evening sums (a day begins at six); ratios only over games that know the measure."""
    evening = F.floor((F.col("s") - 6 * HOUR) / F.lit(24.0 * HOUR)).alias("evening")
    known = F.sum(F.when(F.col("deaths").isNotNull(), F.col("kills")))
    return games(spark, sf_dir).groupBy("cap", evening).agg(
        F.count("*").alias("games"), F.sum("kills").alias("kills"), F.sum("deaths").alias("deaths"), F.sum("duration").alias("played"),
        F.round(known / F.greatest(F.sum("deaths"), F.lit(1)), 6).alias("kd"), F.max("kills").alias("best"),
    )


@query("evening_stats", EV + EVENINGS + " SELECT * FROM evn")
def evening_stats(spark, sf_dir):
    return evenings(spark, sf_dir)


@query("evening_trend", EV + EVENINGS + """, r AS (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY evening DESC) AS n FROM evn)
 SELECT cap, max(kills) FILTER (WHERE n = 1) AS last_kills, round(avg(kills) FILTER (WHERE n > 1), 6) AS usual FROM r GROUP BY cap""")  # fmt: skip
def evening_trend(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("cap").orderBy(F.desc("evening")))
    return evenings(spark, sf_dir).withColumn("n", n).groupBy("cap").agg(F.max(F.when(F.col("n") == 1, F.col("kills"))).alias("last_kills"), F.round(F.avg(F.when(F.col("n") > 1, F.col("kills"))), 6).alias("usual"))


@query("best_game", EV + GAMES + """, r AS (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY kills DESC, game) AS n FROM game) SELECT cap, game, kills FROM r WHERE n = 1""")
def best_game(spark, sf_dir):
    best = Window.partitionBy("cap").orderBy(F.desc("kills"), "game")
    return games(spark, sf_dir).withColumn("n", F.row_number().over(best)).where("n = 1").select("cap", "game", "kills")


@query("moment_search", EV + GROUPS + f" SELECT cap, grp, kills, ace FROM oc WHERE kills >= 2 AND NOT traded AND floor((s - {6 * H}) / {24 * H}.0) BETWEEN 3 AND 20")
def moment_search(spark, sf_dir):
    return search(outcomes(spark, sf_dir), least_kills=2, traded=False, evenings=(3, 20)).select("cap", "grp", "kills", "ace")


def search(groups: DataFrame, least_kills: int | None = None, ace: bool | None = None, traded: bool | None = None, evenings: tuple[int, int] | None = None, cap: int | None = None) -> DataFrame:
    """Groups under a conjunction of the given terms; a term of None doesn't filter."""
    evening = F.floor((F.col("s") - 6 * HOUR) / F.lit(24.0 * HOUR))
    terms = [
        None if least_kills is None else F.col("kills") >= least_kills,
        None if ace is None else F.col("ace") == ace,
        None if traded is None else F.col("traded") == traded,
        None if evenings is None else evening.between(*evenings),
        None if cap is None else F.col("cap") == cap,
    ]
    for term in terms:
        if term is not None:
            groups = groups.where(term)
    return groups


@query("kind_counts", EV + " SELECT cap, kind, count(*) AS n, round(avg(v), 6) AS mean FROM ev GROUP BY ALL")
def kind_counts(spark, sf_dir):
    return load_events(spark, sf_dir).groupBy("cap", "kind").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"))


@query("counter_resets", EV + """, c AS (SELECT cap, id, t, kind, sum(CASE WHEN kind = 'death' THEN 1 ELSE 0 END) OVER (PARTITION BY cap ORDER BY t, id) AS life FROM ev WHERE kind IN ('kill', 'death'))
 SELECT cap, id, CAST(sum(CASE WHEN kind = 'kill' THEN 1 ELSE 0 END) OVER (PARTITION BY cap, life ORDER BY t, id) AS BIGINT) AS score FROM c""")  # fmt: skip
def counter_resets(spark, sf_dir):
    """A counter of kills that each death sets back to 0."""
    order = Window.partitionBy("cap").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = load_events(spark, sf_dir).where("kind in ('kill', 'death')").withColumn("life", F.sum((F.col("kind") == "death").cast("int")).over(order))
    within = Window.partitionBy("cap", "life").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("cap", "id", F.sum((F.col("kind") == "kill").cast("int")).over(within).alias("score"))


@query("calm_around", EV + """ SELECT cap, id, t - lag(t) OVER o AS before, lead(t) OVER o - t AS after FROM ev WHERE kind IN ('kill', 'death') WINDOW o AS (PARTITION BY cap ORDER BY t, id)""")
def calm_around(spark, sf_dir):
    """Silence before and after each kill or death."""
    o = Window.partitionBy("cap").orderBy("t", "id")
    return load_events(spark, sf_dir).where("kind in ('kill', 'death')").select("cap", "id", (F.col("t") - F.lag("t").over(o)).alias("before"), (F.lead("t").over(o) - F.col("t")).alias("after"))


@query("robust_offset", EV + """, m AS (SELECT cap, v, median(v) OVER (PARTITION BY cap) AS med FROM ev WHERE kind = 'shot') SELECT cap, round(min(med), 6) AS med, round(median(abs(v - med)), 6) AS mad, count(*) AS n FROM m GROUP BY cap HAVING count(*) >= 3""")
def robust_offset(spark, sf_dir):
    """Median and median absolute deviation of a capture's samples, from three on."""
    shots = load_events(spark, sf_dir).where("kind = 'shot'").withColumn("med", F.median("v").over(Window.partitionBy("cap")))
    return shots.groupBy("cap").agg(F.round(F.min("med"), 6).alias("med"), F.round(F.median(F.abs(F.col("v") - F.col("med"))), 6).alias("mad"), F.count("*").alias("n")).where("n >= 3")


@query("trait_preference", """WITH s AS (SELECT d.lang AS trait, l.quality AS q FROM documents d JOIN labels l USING (doc_id) WHERE quality IS NOT NULL), t AS (SELECT sum(q) / (count(*) + 4) AS base FROM s)
 SELECT trait, count(*) AS n, round(least(greatest(1.5 * (sum(q) / (count(*) + 4) - any_value(base)), -0.75), 0.75), 6) AS taste FROM s, t GROUP BY trait""")  # fmt: skip
def trait_preference(spark, sf_dir):
    """Shrunk mean label of each trait against all, scaled and clamped."""
    from momentis.session import table

    s = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("quality is not null").select(F.col("lang").alias("trait"), F.col("quality").alias("q"))
    base = s.agg((F.sum("q") / (F.count("*") + 4)).alias("base"))  # one row
    by = s.groupBy("trait").agg(F.count("*").alias("n"), (F.sum("q") / (F.count("*") + 4)).alias("own"))
    return by.crossJoin(F.broadcast(base)).select("trait", "n", F.round(F.least(F.greatest(1.5 * (F.col("own") - F.col("base")), F.lit(-0.75)), F.lit(0.75)), 6).alias("taste"))
