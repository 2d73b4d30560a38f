"""Roll-ups with every measure of a game, merged histograms, the whole search predicate, and settings resolved by precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentis.functions.events import HOUR, load_events
from momentis.operators import intervals, matching
from momentis.plans.moments import EV, SIGNAL, H, signals
from momentis.plans.registry import query
from momentis.plans.selection import clutch_fsm
from momentis.plans.sessions import GAMES, GROUPS, games, kill_groups, outcomes, rounds

ROLLUP = GAMES + GROUPS + """, gg AS (SELECT oc.*, game.game AS game FROM oc JOIN game ON game.cap = oc.cap AND oc.s BETWEEN game.s AND game.s + game.duration),
 rr AS (SELECT rs.cap, rs.round, round_kills, game.game AS game FROM (SELECT rs.*, a.t FROM rs JOIN (SELECT cap, round, min(t) AS t FROM rd GROUP BY ALL) a USING (cap, round)) rs JOIN game ON game.cap = rs.cap AND rs.t BETWEEN game.s AND game.s + game.duration)"""


def grouped_games(spark, sf_dir: str) -> DataFrame:
    """Groups with the game that they lie in: games don't overlap, so the last that began before a group is its own."""
    own = outcomes(spark, sf_dir).select("cap", "grp", "s", "e", "kills", "ace", "traded")
    starts = games(spark, sf_dir).select("cap", F.col("game").alias("id"), F.col("s").alias("t"), "game")
    found = matching.as_of(own.select("cap", F.col("grp").alias("id"), F.col("s").alias("t")), starts, "game")
    return own.join(found.select("cap", F.col("id").alias("grp"), F.col("as_of").alias("game")), ["cap", "grp"])


@query("game_rollup", EV + ROLLUP + """, h AS (SELECT cap, game, kills, count(*) AS n FROM gg WHERE kills > 1 GROUP BY ALL), m AS (SELECT cap, game, string_agg(kills || ':' || n, ',' ORDER BY kills) AS multi FROM h GROUP BY ALL),
 a AS (SELECT cap, game, count(*) FILTER (WHERE ace) AS aces FROM gg GROUP BY ALL), b AS (SELECT cap, game, max(round_kills) AS best, count(*) AS rounds FROM rr GROUP BY ALL)
 SELECT g.cap, g.game, g.kills, g.deaths, coalesce(multi, '') AS multi, coalesce(aces, 0) AS aces, CASE WHEN g.deaths IS NOT NULL THEN coalesce(best, 0) END AS best_round, CASE WHEN g.deaths IS NOT NULL THEN coalesce(rounds, 0) END AS rounds
 FROM game g LEFT JOIN m ON m.cap = g.cap AND m.game = g.game LEFT JOIN a ON a.cap = g.cap AND a.game = g.game LEFT JOIN b ON b.cap = g.cap AND b.game = g.game""")  # fmt: skip
def game_rollup(spark, sf_dir):
    """Kills, deaths, the histogram of multi-kills, aces, the best round and the rounds of each game; unknown deaths leave rounds unknown."""
    groups = grouped_games(spark, sf_dir)
    sizes = groups.where("kills > 1").groupBy("cap", "game", "kills").agg(F.count("*").alias("n"))
    multi = sizes.groupBy("cap", "game").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("kills", "n"))), lambda x: F.concat(x["kills"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",").alias("multi"))
    aces = groups.groupBy("cap", "game").agg(F.count_if("ace").alias("aces"))
    own = games(spark, sf_dir)
    per = rounds(spark, sf_dir).groupBy("cap", "round").agg(F.min("t").alias("t"), F.count_if(F.col("kind") == "kill").alias("round_kills"))
    starts = own.select("cap", F.col("game").alias("id"), F.col("s").alias("t"), "game")
    of = matching.as_of(per.select("cap", F.col("round").alias("id"), "t"), starts, "game").select("cap", F.col("id").alias("round"), F.col("as_of").alias("game"))
    best = per.join(of, ["cap", "round"]).groupBy("cap", "game").agg(F.max("round_kills").alias("best"), F.count("*").alias("n"))
    rows = own.join(multi, ["cap", "game"], "left").join(aces, ["cap", "game"], "left").join(best, ["cap", "game"], "left")
    known = lambda x: F.when(F.col("deaths").isNotNull(), F.coalesce(x, F.lit(0)))
    return rows.select("cap", "game", "kills", "deaths", F.coalesce("multi", F.lit("")).alias("multi"), F.coalesce("aces", F.lit(0)).alias("aces"), known("best").alias("best_round"), known("n").alias("rounds"))


@query("evening_histogram", EV + GROUPS + f""", e AS (SELECT cap, CAST(floor((s - {6 * H}) / {24 * H}.0) AS BIGINT) AS evening, kills, count(*) AS n FROM gr WHERE kills > 1 GROUP BY ALL) SELECT evening, kills, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY ALL""")
def evening_histogram(spark, sf_dir):
    """Histograms of captures merged by evening: maps are added up key by key, which is a sum by key."""
    evening = F.floor((F.col("s") - 6 * HOUR) / F.lit(24.0 * HOUR)).alias("evening")
    return kill_groups(spark, sf_dir).where("kills > 1").groupBy(evening, "kills").agg(F.count("*").alias("n"))


@query("kind_detectors", EV + " SELECT cap % 7 AS profile, kind, string_agg(DISTINCT 'd' || (id % 3), ',' ORDER BY 'd' || (id % 3)) AS detectors FROM ev GROUP BY ALL")
def kind_detectors(spark, sf_dir):
    """The detectors that have given a kind in any capture of a profile."""
    rows = load_events(spark, sf_dir).groupBy((F.col("cap") % 7).alias("profile"), "kind").agg(F.collect_set(F.concat(F.lit("d"), (F.col("id") % 3).cast("string"))).alias("d"))
    return rows.select("profile", "kind", F.array_join(F.sort_array("d"), ",").alias("detectors"))


@query("confident_boosts", EV + ", b(kind, boost) AS (VALUES ('kill', 0.8::DOUBLE), ('headshot', 0.5::DOUBLE)) SELECT id, round(coalesce(boost, 0.1) * least(greatest(v / 100, 0), 1), 6) AS boost FROM ev LEFT JOIN b USING (kind)")
def confident_boosts(spark, sf_dir):
    """Boosts from a table by kind, with one for all others, times each event's confidence."""
    table = F.broadcast(spark.createDataFrame([("kill", 0.8), ("headshot", 0.5)], "kind string, boost double"))
    confidence = F.least(F.greatest(F.col("v") / 100, F.lit(0.0)), F.lit(1.0))
    return load_events(spark, sf_dir).join(table, "kind", "left").select("id", F.round(F.coalesce("boost", F.lit(0.1)) * confidence, 6).alias("boost"))


@query("full_search", EV + GROUPS + f""", hs AS (SELECT kg.cap, kg.grp, bool_and(EXISTS (SELECT 1 FROM ev h WHERE h.cap = kg.cap AND h.kind = 'headshot' AND h.t BETWEEN kg.t - {48 * H} AND kg.t + {48 * H})) AS all_heads FROM kg GROUP BY ALL)
 SELECT oc.cap, oc.grp, kills, ace, all_heads FROM oc JOIN hs ON hs.cap = oc.cap AND hs.grp = oc.grp WHERE floor((s - {6 * H}) / {24 * H}.0) BETWEEN 1 AND 27 AND kills >= 1 AND NOT traded AND all_heads AND oc.cap % 3 <> 1""")  # fmt: skip
def full_search(spark, sf_dir):
    """Moments by all terms of a search: game (a capture's remainder), evenings, least kills, not traded, every kill a headshot."""
    return search_all(spark, sf_dir, games=(0, 2), evenings=(1, 27), least_kills=1, traded=False, all_headshots=True).select("cap", "grp", "kills", "ace", "all_heads")


@query("one_tap_search", EV + GROUPS + f""", tp AS (SELECT kg.cap, kg.grp, count(*) AS one_taps FROM kg WHERE EXISTS (SELECT 1 FROM ev h WHERE h.cap = kg.cap AND h.kind = 'headshot' AND h.t BETWEEN kg.t - {48 * H} AND kg.t + {48 * H})
 AND (SELECT count(*) FROM ev s WHERE s.cap = kg.cap AND s.kind = 'shot' AND s.t BETWEEN kg.t - {12 * H} AND kg.t + {3 * H}) = 1 GROUP BY ALL) SELECT oc.cap, oc.grp, kills, one_taps FROM oc JOIN tp ON tp.cap = oc.cap AND tp.grp = oc.grp WHERE kills >= 1""")  # fmt: skip
def one_tap_search(spark, sf_dir):
    """Groups with at least one kill of a single bullet to the head."""
    return search_all(spark, sf_dir, least_kills=1, least_one_taps=1).select("cap", "grp", "kills", "one_taps")


@query("clutch_search")
def clutch_search(spark, sf_dir):
    """Groups that win a last stand, with its enemies."""
    return search_all(spark, sf_dir, clutch=True).select("cap", "grp", "kills", "clutches", "enemies")


@query("game_clutches")
def game_clutches(spark, sf_dir):
    """Last stands won in each game, and the most enemies of one; unknown where the game's deaths are."""
    per = grouped_games(spark, sf_dir).join(group_clutches(spark, sf_dir), ["cap", "grp"]).groupBy("cap", "game").agg(F.sum("clutches").alias("n"), F.max("enemies").alias("most"))
    rows = games(spark, sf_dir).join(per, ["cap", "game"], "left")
    known = lambda x: F.when(F.col("deaths").isNotNull(), F.coalesce(x, F.lit(0)))
    return rows.select("cap", "game", "kills", known("n").alias("clutches"), known("most").alias("most_enemies"))


def group_clutches(spark, sf_dir: str) -> DataFrame:
    """(cap, grp, clutches, enemies): the last stands won by a kill of each group, and the most enemies of one. A last stand belongs to the group that its last kill lies in."""
    won = clutch_fsm(spark, sf_dir).select("cap", F.col("won").alias("id"), F.col("won").alias("t"), "enemies")
    own = kill_groups(spark, sf_dir)
    starts = own.select("cap", F.col("grp").alias("id"), F.col("s").alias("t"), "grp")
    of = matching.as_of(won.select("cap", "id", "t"), starts, "grp").select("cap", "id", F.col("as_of").alias("grp"))
    inside = won.join(of, ["cap", "id"]).join(own.select("cap", "grp", "e"), ["cap", "grp"]).where("t <= e")
    return inside.groupBy("cap", "grp").agg(F.count("*").alias("clutches"), F.max("enemies").alias("enemies"))


def search_all(spark, sf_dir: str, games=None, evenings=None, least_kills=None, ace=None, traded=None, all_headshots=None, clutch=None, least_one_taps=None) -> DataFrame:
    """Groups under a conjunction of terms; a term of None doesn't filter, and what only it needs isn't computed."""
    order = Window.partitionBy("cap").orderBy("t", "id")
    kills = rounds(spark, sf_dir).where("kind = 'kill'").withColumn("turn", F.col("round") != F.lag("round").over(order))
    kills = intervals.islands(kills, "cap", "t", 12 * HOUR, breaks=F.col("turn")).select("cap", "id", "t", "grp")
    heads = matching.near_events(kills, load_events(spark, sf_dir).where("kind = 'headshot'"), 48 * HOUR, 48 * HOUR).select("cap", F.col("lid").alias("id"), F.lit(True).alias("head")).distinct()
    all_heads = kills.join(heads, ["cap", "id"], "left").groupBy("cap", "grp").agg(F.bool_and(F.coalesce("head", F.lit(False))).alias("all_heads"))
    evening = F.floor((F.col("s") - 6 * HOUR) / F.lit(24.0 * HOUR))
    terms = [
        None if games is None else (F.col("cap") % 3).isin(*games), None if evenings is None else evening.between(*evenings), None if least_kills is None else F.col("kills") >= least_kills,
        None if ace is None else F.col("ace") == ace, None if traded is None else F.col("traded") == traded, None if all_headshots is None else F.col("all_heads") == all_headshots,
    ]
    rows = outcomes(spark, sf_dir).join(all_heads, ["cap", "grp"])
    if clutch is not None:
        rows = rows.join(group_clutches(spark, sf_dir), ["cap", "grp"], "left").where(F.col("clutches").isNotNull() == clutch)
    if least_one_taps is not None:
        # A kill of one bullet to the head: a headshot near it, and a single shot in its burst.
        shots = matching.near_events(kills, load_events(spark, sf_dir).where("kind = 'shot'"), 12 * HOUR, 3 * HOUR).groupBy("cap", F.col("lid").alias("id")).agg(F.count("*").alias("shots"))
        taps = kills.join(heads, ["cap", "id"]).join(shots, ["cap", "id"]).where("shots = 1").groupBy("cap", "grp").agg(F.count("*").alias("one_taps"))
        rows = rows.join(taps, ["cap", "grp"], "left").withColumn("one_taps", F.coalesce("one_taps", F.lit(0))).where(F.col("one_taps") >= least_one_taps)
    for term in terms:
        rows = rows if term is None else rows.where(term)
    return rows


@query("calm_breaks", EV + SIGNAL + """, q AS (SELECT cap, win, raw, row_number() OVER (PARTITION BY cap ORDER BY raw, win) AS r, count(*) OVER (PARTITION BY cap) AS n FROM sig WHERE kind = 'kill'), p AS (SELECT cap, max(raw) FILTER (WHERE r = floor(0.9 * (n - 1)) + 1) AS p90 FROM q GROUP BY cap),
 c AS (SELECT q.cap, win, CASE WHEN win - lag(win) OVER (PARTITION BY q.cap ORDER BY win) = 1 THEN 0 ELSE 1 END AS f FROM q JOIN p ON p.cap = q.cap WHERE raw <= p90 - 30), cr AS (SELECT *, sum(f) OVER (PARTITION BY cap ORDER BY win) AS run FROM c),
 b AS (SELECT cap, min(win) AS a, max(win) AS z FROM cr GROUP BY cap, run HAVING count(*) >= 3), k AS (SELECT cap, coalesce(lag(z) OVER (PARTITION BY cap ORDER BY a) + 1, 0) AS s, a - 1 AS e FROM b UNION ALL SELECT cap, max(z) + 1, 59 FROM b GROUP BY cap)
 SELECT cap, s, e FROM k WHERE e >= s""")  # fmt: skip
def calm_breaks(spark, sf_dir):
    """A song without its calm breaks: three bars or more that lie well under the floor-rank 90th percentile cut it into sections."""
    own = Window.partitionBy("cap")
    ranked = signals(spark, sf_dir).where("kind = 'kill'").withColumns({"r": F.row_number().over(own.orderBy("raw", "win")), "n": F.count("*").over(own)})
    level = F.max(F.when(F.col("r") == F.floor(F.lit(0.9) * (F.col("n") - 1)) + 1, F.col("raw"))).over(own)
    calm = intervals.islands(ranked.withColumn("p90", level).where("raw <= p90 - 30").select("cap", "win"), "cap", "win", 1, ties="win")
    breaks = calm.groupBy("cap", "grp").agg(F.min("win").alias("s"), (F.max("win") + 1).alias("e"), F.count("*").alias("n")).where("n >= 3")
    whole = breaks.select("cap").distinct().select("cap", F.lit(0).cast("long").alias("s"), F.lit(60).cast("long").alias("e"))
    return intervals.subtract(whole, breaks.select("cap", "s", "e"), "cap").select("cap", "s", (F.col("e") - 1).alias("e"))


@query("resolved_feel", EV + GROUPS + """, l AS (SELECT cap, count(*) AS n, CASE WHEN avg(score) > 60 THEN 'fast' ELSE 'slow' END AS learned FROM gr GROUP BY cap)
 SELECT cap, CASE WHEN cap % 5 = 0 THEN 'marked' WHEN n >= 8 THEN learned ELSE 'plain' END AS feel, CASE WHEN cap % 5 = 0 THEN 'user' WHEN n >= 8 THEN 'learned' ELSE 'default' END AS origin FROM l""")  # fmt: skip
def resolved_feel(spark, sf_dir):
    """What the user has marked holds, else what was learned from enough, else the default; with where it comes from."""
    rows = kill_groups(spark, sf_dir).groupBy("cap").agg(F.count("*").alias("n"), F.avg("score").alias("x"))
    marked = F.when(F.col("cap") % 5 == 0, F.struct(F.lit("marked").alias("feel"), F.lit("user").alias("origin")))
    learned = F.when(F.col("n") >= 8, F.struct(F.when(F.col("x") > 60, "fast").otherwise("slow").alias("feel"), F.lit("learned").alias("origin")))
    default = F.struct(F.lit("plain").alias("feel"), F.lit("default").alias("origin"))
    return rows.select("cap", F.coalesce(marked, learned, default).alias("x")).select("cap", "x.feel", "x.origin")


@query("held_out_gate", EV + f""", d AS (SELECT cap, t // {24 * H} AS day, count(*) FILTER (WHERE kind = 'kill') AS k, avg(v) AS x FROM ev GROUP BY ALL), s AS (SELECT cap, count(*) AS n, sum(k) AS sk, sum(x) AS sx, sum(k * x) AS skx, sum(x * x) AS sxx FROM d GROUP BY cap HAVING count(*) >= 4),
 o AS (SELECT d.cap, d.k, d.x, n - 1 AS m, sk - k AS a, sx - x AS b, skx - k * x AS c, sxx - x * x AS q FROM d JOIN s USING (cap)), p AS (SELECT cap, k, a / m + (c - a * b / m) / nullif(q - b * b / m + 0.1, 0) * (x - b / m) AS guess, a / m AS usual FROM o)
 SELECT cap, round(avg(CASE WHEN abs(k - guess) <= abs(k - usual) THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM p GROUP BY cap""")  # fmt: skip
def held_out_gate(spark, sf_dir):
    """How often a regularised line through all other days comes nearer to a day than their mean: from sums less the day's own, without fitting once for each day."""
    days = load_events(spark, sf_dir).groupBy("cap", F.floor(F.col("t") / (24 * HOUR)).alias("day")).agg(F.count_if(F.col("kind") == "kill").alias("k"), F.avg("v").alias("x"))
    own = Window.partitionBy("cap")
    k, x = F.col("k"), F.col("x")
    rows = days.withColumns({"n": F.count("*").over(own), "sk": F.sum("k").over(own), "sx": F.sum("x").over(own), "skx": F.sum(k * x).over(own), "sxx": F.sum(x * x).over(own)}).where("n >= 4")
    m, a, b, c, q = F.col("n") - 1, F.col("sk") - k, F.col("sx") - x, F.col("skx") - k * x, F.col("sxx") - x * x
    guess = a / m + (c - a * b / m) / (q - b * b / m + 0.1) * (x - b / m)
    return rows.select("cap", F.when(F.abs(k - guess) <= F.abs(k - a / m), 1.0).otherwise(0.0).alias("hit")).groupBy("cap").agg(F.round(F.avg("hit"), 6).alias("agreement"))
