"""Edits of moments and plans: filters, manual edits, matching of captures, slots, merging, reactions, beats and presets."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentis.functions.events import HOUR, TOTAL, clamp, load_events
from momentis.operators import grid, intervals, matching, slots
from momentis.operators.keyed import per_key
from momentis.plans.moments import EV, FUSED, GATED, ISLANDS, SIGNAL, H, fused, gated, moments, signals
from momentis.plans.registry import query
from momentis.plans.sessions import GAMES, GROUPS, games, kill_groups, outcomes, rounds
from momentis.session import table

#: Moments with their range, peak and a manual mark that follows from their number.
HL = ISLANDS + f""", hl AS (SELECT cap, grp, first_win * {12 * H} AS s, least(last_win * {12 * H} + {24 * H}, {720 * H}) AS e, peak_win * {12 * H} + {12 * H} AS peak, score, grp % 4 = 0 AS manual, grp % 5 <> 0 AS enabled FROM moments)"""


def highlights(spark, sf_dir: str) -> DataFrame:
    return moments(spark, sf_dir).select(
        "cap", "grp", (F.col("first_win") * grid.HOP).alias("s"), F.least(F.col("last_win") * grid.HOP + grid.SIZE, F.lit(TOTAL)).alias("e"),
        (F.col("peak_win") * grid.HOP + grid.HOP).alias("peak"), "score", (F.col("grp") % 4 == 0).alias("manual"), (F.col("grp") % 5 != 0).alias("enabled"),
    )


@query("enabled_moments", EV + HL + " SELECT cap, grp, s, e, score FROM hl WHERE enabled AND (manual OR score >= 0.6)")
def enabled_moments(spark, sf_dir):
    """Moments that are switched on, and made by hand or good enough."""
    return highlights(spark, sf_dir).where("enabled and (manual or score >= 0.6)").select("cap", "grp", "s", "e", "score")


@query("pinned_floor", EV + HL + """, q AS (SELECT *, score >= 0.8 OR grp % 7 = 0 AS ok, row_number() OVER (PARTITION BY cap ORDER BY score DESC, grp) AS n FROM hl),
 c AS (SELECT *, bool_or(ok) OVER (PARTITION BY cap) AS one FROM q) SELECT cap, grp, score FROM c WHERE ok OR (NOT one AND n <= 3)""")  # fmt: skip
def pinned_floor(spark, sf_dir):
    """Moments over the floor or pinned; the best three of a capture that has none."""
    ok = (F.col("score") >= 0.8) | (F.col("grp") % 7 == 0)
    rows = highlights(spark, sf_dir).withColumns({"ok": ok, "n": F.row_number().over(Window.partitionBy("cap").orderBy(F.desc("score"), "grp"))})
    return rows.withColumn("some", F.bool_or("ok").over(Window.partitionBy("cap"))).where("ok or (not some and n <= 3)").select("cap", "grp", "score")


@query("gated_events", EV + GATED + " SELECT DISTINCT cap, id, t, kind FROM g WHERE NOT EXISTS (SELECT 1 FROM gated b JOIN g o ON o.cap = b.cap AND o.win = b.win WHERE b.gate < 0.5 AND o.cap = g.cap AND o.id = g.id)")
def gated_events(spark, sf_dir):
    """Events that fall in no window whose gate is closed."""
    cells = grid.expand(load_events(spark, sf_dir)).select("cap", "id", "t", "kind", "win")
    closed = gated(spark, sf_dir).where("gate < 0.5").select("cap", "win", F.lit(True).alias("closed"))
    return cells.join(closed, ["cap", "win"], "left").groupBy("cap", "id", "t", "kind").agg(F.bool_or(F.coalesce("closed", F.lit(False))).alias("gone")).where("not gone").drop("gone")


DESIGNATED = f""", dg AS (SELECT cap, id, cap || '@' || CAST((t + (id % 3 - 1) * {H // 2}) // 60000000 AS VARCHAR) || ':' || lpad(CAST((t + (id % 3 - 1) * {H // 2}) // 1000000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST((t + (id % 3 - 1) * {H // 2}) // 1000 % 1000 AS VARCHAR), 3, '0') AS text
 FROM ev WHERE kind = 'kill' AND t > {H}),
 pd AS (SELECT id AS mark, CAST(regexp_extract(text, '^(\\d+)@', 1) AS BIGINT) AS cap, CAST(regexp_extract(text, '@(\\d+):', 1) AS BIGINT) * 60000000 + CAST(regexp_extract(text, ':(\\d+)\\.', 1) AS BIGINT) * 1000000 + CAST(regexp_extract(text, '\\.(\\d+)$', 1) AS BIGINT) * 1000 AS p FROM dg),
 nr AS (SELECT mark, pd.cap, p, k.id, row_number() OVER (PARTITION BY mark ORDER BY abs(k.t - p), k.t, k.id) AS n FROM pd JOIN ev k ON k.cap = pd.cap AND k.kind = 'kill' AND k.t BETWEEN p - {H} AND p + {H})"""


@query("designations", EV + DESIGNATED + " SELECT mark, cap, p, id FROM nr WHERE n = 1")
def designations(spark, sf_dir):
    """Kills named as `capture@m:ss.mmm`: the text is parsed, and the nearest kill within an hour is meant."""
    kills = load_events(spark, sf_dir).where("kind = 'kill'").select("cap", "id", "t")
    near = F.col("t") + (F.col("id") % 3 - 1) * (HOUR // 2)
    part = lambda x, unit, most: F.lpad((F.floor(x / unit) % most).cast("string"), 2 if most == 60 else 3, "0")
    text = F.concat(F.col("cap"), F.lit("@"), F.floor(near / 60_000_000).cast("string"), F.lit(":"), part(near, 1_000_000, 60), F.lit("."), part(near, 1000, 1000))
    marks = kills.where(f"t > {HOUR}").select("id", text.alias("text"))
    found = lambda pattern: F.regexp_extract("text", pattern, 1).cast("long")
    parsed = marks.select("id", found(r"^(\d+)@").alias("cap"), (found(r"@(\d+):") * 60_000_000 + found(r":(\d+)\.") * 1_000_000 + found(r"\.(\d+)$") * 1000).alias("t"))
    return matching.nearest(parsed, kills, HOUR).select(F.col("lid").alias("mark"), "cap", F.col("lt").alias("p"), F.col("rid").alias("id"))


@query("picked_groups", EV + GROUPS + f""" SELECT DISTINCT kg.cap, kg.grp FROM kg JOIN ev p ON p.cap = kg.cap AND p.kind = 'headshot' AND p.t + {H // 2} BETWEEN kg.t - {H} AND kg.t + {H}""")
def picked_groups(spark, sf_dir):
    """Groups with a kill within an hour of any pick (here headshots, half an hour late)."""
    order = Window.partitionBy("cap").orderBy("t", "id")
    kills = rounds(spark, sf_dir).where("kind = 'kill'").withColumn("turn", F.col("round") != F.lag("round").over(order))
    grouped = intervals.islands(kills, "cap", "t", 12 * HOUR, breaks=F.col("turn")).select("cap", "id", "t", "grp")
    picks = load_events(spark, sf_dir).where("kind = 'headshot'").select("cap", "id", (F.col("t") + HOUR // 2).alias("t"))
    return matching.having(grouped, picks, HOUR, HOUR).select("cap", "grp").distinct()


CAMS = GAMES + f""", cm AS (SELECT cap, game, s + (game % 3 - 1) * {24 * H} AS cs, duration AS cd, game % 4 <> 0 AS sure, CASE WHEN game % 2 = 0 THEN 'cap' || cap || '-' || game ELSE 'cam' || game END AS name FROM game WHERE game % 3 <> 2),
 al AS (SELECT g.cap, g.game, c.game AS cam, greatest(least(g.s + g.duration, cs + cd) - greatest(g.s, cs), 0) AS ov, sure, starts_with(name, 'cap' || g.cap || '-' || g.game) AS own, count(*) OVER (PARTITION BY g.cap, g.game) AS n FROM game g JOIN cm c ON c.cap = g.cap),
 rk AS (SELECT *, CASE WHEN sure AND ov > 0 THEN 1 WHEN own THEN 2 WHEN n = 1 THEN 3 END AS how FROM al),
 pk AS (SELECT *, row_number() OVER (PARTITION BY cap, game ORDER BY how, CASE WHEN how = 1 THEN -ov ELSE 0 END, cam) AS r FROM rk WHERE how IS NOT NULL)"""


@query("camera_choice", EV + CAMS + " SELECT cap, game, cam, how FROM pk WHERE r = 1")
def camera_choice(spark, sf_dir):
    """The camera recording of each game: the reliable one that overlaps it most, else the one named after it, else the only one."""
    own = games(spark, sf_dir).select("cap", "game", "s", "duration")
    name = F.when(F.col("game") % 2 == 0, F.concat(F.lit("cap"), "cap", F.lit("-"), "game")).otherwise(F.concat(F.lit("cam"), "game"))
    cams = own.where("game % 3 <> 2").select("cap", F.col("game").alias("cam"), (F.col("s") + (F.col("game") % 3 - 1) * 24 * HOUR).alias("cs"), F.col("duration").alias("cd"), (F.col("game") % 4 != 0).alias("sure"), name.alias("name"))
    both = own.join(cams, "cap")
    overlap = F.greatest(F.least(F.col("s") + F.col("duration"), F.col("cs") + F.col("cd")) - F.greatest("s", "cs"), F.lit(0))
    stem = F.concat(F.lit("cap"), "cap", F.lit("-"), "game")
    many = F.count("*").over(Window.partitionBy("cap", "game"))
    how = F.when(F.col("sure") & (F.col("ov") > 0), 1).when(F.col("name").startswith(stem), 2).when(F.col("n") == 1, 3)
    ranked = both.withColumns({"ov": overlap, "n": many}).withColumn("how", how).where("how is not null")
    best = Window.partitionBy("cap", "game").orderBy("how", F.when(F.col("how") == 1, -F.col("ov")).otherwise(0), "cam")
    return ranked.withColumn("r", F.row_number().over(best)).where("r = 1").select("cap", "game", "cam", "how")


@query("fallback_detectors", EV + """ SELECT cap, id, t, kind FROM ev e WHERE kind = 'headshot' UNION ALL SELECT cap, id, t, 'headshot' FROM ev e WHERE kind = 'shot' AND NOT EXISTS (SELECT 1 FROM ev h WHERE h.cap = e.cap AND h.kind = 'headshot')""")
def fallback_detectors(spark, sf_dir):
    """A detector's events; those of its fallback in captures where it found none."""
    e = load_events(spark, sf_dir)
    own = e.where("kind = 'headshot'")
    spare = e.where("kind = 'shot'").join(own.select("cap").distinct(), "cap", "left_anti").withColumn("kind", F.lit("headshot"))
    return own.select("cap", "id", "t", "kind").unionByName(spare.select("cap", "id", "t", "kind"))


#: A table of detectors with their weights, boosts and the detectors whose events they need.
DETECTORS = [("ammo", 0.5, 0.4, ["shot", "kill"]), ("style", 0.3, 0.8, ["headshot", "kill"]), ("voice", 0.2, 0.1, ["assist"])]
_CONFIG = ", ".join(f"('{n}', {w}::DOUBLE, {b}::DOUBLE, {k})" for n, w, b, k in DETECTORS)


def detector_table(spark) -> DataFrame:
    """The configuration as a table; a few rows, so joins broadcast it."""
    return F.broadcast(spark.createDataFrame(DETECTORS, "detector string, weight double, boost double, needs array<string>"))


@query("dependent_events", EV + f", cf AS (SELECT * FROM (VALUES {_CONFIG}) AS c(detector, weight, boost, needs)) SELECT cap, detector, count(*) AS n, min(t) AS first_t FROM ev JOIN (SELECT detector, unnest(needs) AS kind FROM cf) USING (kind) GROUP BY ALL")
def dependent_events(spark, sf_dir):
    """Events that each detector of the configuration needs, per capture."""
    needs = F.broadcast(detector_table(spark).select("detector", F.explode("needs").alias("kind")))
    return load_events(spark, sf_dir).join(needs, "kind").groupBy("cap", "detector").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))


@query("configured_fusion", EV + SIGNAL + f""", cf AS (SELECT * FROM (VALUES {_CONFIG}) AS c(detector, weight, boost, needs)), w AS (SELECT unnest(needs) AS kind, weight, boost FROM cf)
 SELECT cap, win, round(sum(weight * raw) / sum(weight), 6) AS total, round(max(boost), 4) AS boost FROM sig JOIN w USING (kind) GROUP BY ALL""")  # fmt: skip
def configured_fusion(spark, sf_dir):
    """Weights and boosts joined from the configuration table."""
    weights = F.broadcast(detector_table(spark).select(F.explode("needs").alias("kind"), "weight", "boost"))
    rows = signals(spark, sf_dir).join(weights, "kind")
    return rows.groupBy("cap", "win").agg(F.round(F.sum(F.col("weight") * F.col("raw")) / F.sum("weight"), 6).alias("total"), F.round(F.max("boost"), 4).alias("boost"))


@query("contributions", EV + FUSED + " SELECT cap, win, kind, round(w * norm / sum(w) OVER (PARTITION BY cap, win), 4) AS share FROM w WHERE w IS NOT NULL")
def contributions(spark, sf_dir):
    """What each signal adds to a window's weighted mean."""
    from momentis.plans.moments import WEIGHTS, normalised

    w = F.lit(None).cast("double")
    for kind, x in WEIGHTS.items():
        w = F.when(F.col("kind") == kind, x).otherwise(w)
    rows = normalised(spark, sf_dir).withColumn("w", w).where("w is not null")
    return rows.select("cap", "win", "kind", F.round(F.col("w") * F.col("norm") / F.sum("w").over(Window.partitionBy("cap", "win")), 4).alias("share"))


#: Marks in a song, as shares of its length, with their strength.
SONG = [(1, 0.1, 0.4), (2, 0.35, 0.8), (3, 0.6, 1.0), (4, 0.9, 0.6)]
_SONG = ", ".join(f"({k}, {p}::DOUBLE, {s}::DOUBLE)" for k, p, s in SONG)


@query("mark_choice", EV + GROUPS + f""", mk AS (SELECT * FROM (VALUES {_SONG}) AS m(mark, place, strength)),
 x AS (SELECT cap, grp, mark, round(strength - abs(s / {720 * H}.0 - place), 6) AS fit FROM gr, mk), r AS (SELECT *, row_number() OVER (PARTITION BY cap, grp ORDER BY fit DESC, mark) AS n FROM x) SELECT cap, grp, mark, fit FROM r WHERE n = 1""")  # fmt: skip
def mark_choice(spark, sf_dir):
    """Every group against every mark of a song (a fixed, small table); the best fit."""
    marks = F.broadcast(spark.createDataFrame(SONG, "mark int, place double, strength double"))
    fit = F.round(F.col("strength") - F.abs(F.col("s") / F.lit(720.0 * HOUR) - F.col("place")), 6)
    best = Window.partitionBy("cap", "grp").orderBy(F.desc("fit"), "mark")
    return kill_groups(spark, sf_dir).crossJoin(marks).withColumn("fit", fit).withColumn("n", F.row_number().over(best)).where("n = 1").select("cap", "grp", "mark", "fit")


@query("right_full_joins", "SELECT coalesce(CAST(n_nationkey AS BIGINT), -1) AS nation, coalesce(CAST(s_suppkey AS BIGINT), -1) AS supplier, 'full' AS how FROM nation FULL JOIN supplier ON s_nationkey = n_nationkey + 7 UNION ALL SELECT coalesce(CAST(n_nationkey AS BIGINT), -1), CAST(s_suppkey AS BIGINT), 'right' FROM nation RIGHT JOIN supplier ON s_nationkey = n_nationkey + 7")
def right_full_joins(spark, sf_dir):
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    on = F.col("s_nationkey") == F.col("n_nationkey") + 7
    keys = [F.coalesce(F.col("n_nationkey").cast("long"), F.lit(-1)).alias("nation"), F.coalesce(F.col("s_suppkey").cast("long"), F.lit(-1)).alias("supplier")]
    full = n.join(s, on, "full").select(*keys, F.lit("full").alias("how"))
    return full.unionByName(n.join(s, on, "right").select(*keys, F.lit("right").alias("how")))


@query("sorted_union", EV + f""", u AS (SELECT cap, t, kind, 'event' AS source FROM ev WHERE kind = 'kill' UNION ALL SELECT cap, s, 'moment', 'moment' FROM (SELECT cap, min(t) AS s FROM ev GROUP BY cap, t // {24 * H}) x)
 SELECT cap, t, kind, source, row_number() OVER (PARTITION BY cap ORDER BY t, source, kind) AS n FROM u""")  # fmt: skip
def sorted_union(spark, sf_dir):
    """Two sources as one list in time order per capture."""
    e = load_events(spark, sf_dir)
    own = e.where("kind = 'kill'").select("cap", "t", "kind", F.lit("event").alias("source"))
    days = e.groupBy("cap", F.floor(F.col("t") / (24 * HOUR)).alias("day")).agg(F.min("t").alias("t")).select("cap", "t", F.lit("moment").alias("kind"), F.lit("moment").alias("source"))
    both = own.unionByName(days)
    return both.withColumn("n", F.row_number().over(Window.partitionBy("cap").orderBy("t", "source", "kind")))


@query("slot_window", EV + SIGNAL + f""", b AS (SELECT cap, win, sum(raw) OVER w AS energy, count(*) OVER w AS n, max(win) OVER w AS last_win FROM sig WHERE kind = 'kill' WINDOW w AS (PARTITION BY cap ORDER BY win RANGE BETWEEN CURRENT ROW AND 6 FOLLOWING)),
 r AS (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY energy DESC, win) AS k FROM b) SELECT cap, win, last_win, n, round(energy, 4) AS energy FROM r WHERE k = 1""")  # fmt: skip
def slot_window(spark, sf_dir):
    """The stretch of slots of up to seven windows with the most energy, per capture; the first of equals."""
    within = Window.partitionBy("cap").orderBy("win").rangeBetween(0, 6)
    rows = signals(spark, sf_dir).where("kind = 'kill'").select("cap", "win", F.sum("raw").over(within).alias("energy"), F.count("*").over(within).alias("n"), F.max("win").over(within).alias("last_win"))
    best = Window.partitionBy("cap").orderBy(F.desc("energy"), "win")
    return rows.withColumn("k", F.row_number().over(best)).where("k = 1").select("cap", "win", "last_win", "n", F.round("energy", 4).alias("energy"))


@query("longest_window", EV + HL + f""", d AS (SELECT hl.cap, grp, abs(ev.t - peak) AS d, row_number() OVER (PARTITION BY hl.cap, grp ORDER BY abs(ev.t - peak), id) AS n FROM hl JOIN ev USING (cap))
 SELECT cap, grp, least(coalesce(min(d) FILTER (WHERE n = 6) - 1, {240 * H}), {240 * H}) AS half, count(*) FILTER (WHERE n <= 5) AS held FROM d GROUP BY ALL""")  # fmt: skip
def longest_window(spark, sf_dir):
    """The longest window around a moment's peak that costs at most five events.

    The cost grows with the length, so instead of halving the length step by step the distance of the sixth nearest event gives the answer at once.
    """
    # The sixth nearest is among six events before the peak and six after it, by their places in time: no moment meets more.
    order = Window.partitionBy("cap").orderBy("t", "later", "id")
    events = load_events(spark, sf_dir).select("cap", "id", "t", F.lit(0).alias("later"), F.lit(None).cast("long").alias("grp"))
    peaks = highlights(spark, sf_dir).select("cap", F.lit(None).cast("long").alias("id"), F.col("peak").alias("t"), F.lit(1).alias("later"), F.col("grp").cast("long").alias("grp"))
    placed = events.unionByName(peaks).withColumn("place", F.sum(1 - F.col("later")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    beside = placed.where("later = 1").select("cap", "grp", F.col("t").alias("peak"), F.explode(F.sequence(F.col("place") - 5, F.col("place") + 6)).alias("place"))
    pairs = beside.join(placed.where("later = 0").select("cap", "place", "id", "t"), ["cap", "place"])
    near = Window.partitionBy("cap", "grp").orderBy("d", "id")
    ranked = pairs.withColumn("d", F.abs(F.col("t") - F.col("peak"))).withColumn("n", F.row_number().over(near)).where("n <= 6")
    half = F.least(F.coalesce(F.min(F.when(F.col("n") == 6, F.col("d"))) - 1, F.lit(240 * HOUR)), F.lit(240 * HOUR))
    return ranked.groupBy("cap", "grp").agg(half.alias("half"), F.count_if(F.col("n") <= 5).alias("held"))


@query("slot_assignment", EV + GROUPS + f""", sl AS (SELECT cap, win, raw, row_number() OVER (PARTITION BY cap ORDER BY raw, win) AS build, row_number() OVER (PARTITION BY cap ORDER BY win) AS place FROM (SELECT cap, t // {24 * H} AS win, max(v) AS raw FROM ev WHERE kind = 'assist' GROUP BY ALL) x),
 rg AS (SELECT cap, grp, s, row_number() OVER (PARTITION BY cap ORDER BY kills + score / 10, grp) AS build, row_number() OVER (PARTITION BY cap ORDER BY s, grp) AS place FROM gr)
 SELECT rg.cap, rg.grp, b.win AS build_slot, c.win AS time_slot FROM rg LEFT JOIN sl b ON b.cap = rg.cap AND b.build = rg.build LEFT JOIN sl c ON c.cap = rg.cap AND c.place = rg.place""")  # fmt: skip
def slot_assignment(spark, sf_dir):
    """Groups laid into slots in two manners: weakest into the quietest up to strongest into the loudest, and in time order; null past the last slot."""
    by = lambda *order: F.row_number().over(Window.partitionBy("cap").orderBy(*order))
    slots = load_events(spark, sf_dir).where("kind = 'assist'").groupBy("cap", F.floor(F.col("t") / (24 * HOUR)).alias("win")).agg(F.max("v").alias("raw"))
    slots = slots.select("cap", "win", by("raw", "win").alias("build"), by("win").alias("place"))
    ranked = kill_groups(spark, sf_dir).select("cap", "grp", by(F.col("kills") + F.col("score") / 10, "grp").alias("build"), by("s", "grp").alias("place"))
    first = ranked.join(slots.select("cap", "build", F.col("win").alias("build_slot")), ["cap", "build"], "left")
    return first.join(slots.select("cap", "place", F.col("win").alias("time_slot")), ["cap", "place"], "left").select("cap", "grp", "build_slot", "time_slot")


@query("slot_plan")
def slot_plan(spark, sf_dir):
    """Groups laid into a capture's slots, building up and in time order, with slots that grow into free ones and exchanges that bring groups of as many kills together.

    A slot is a day with assists, of four beats, or eight where it is quiet; its importance is its loudest value, and the loudest is the drop. Only as many groups as there are slots take part,
    the best by rank, so a task holds two rows for each day of a capture.
    """
    by = lambda *order: F.row_number().over(Window.partitionBy("cap").orderBy(*order))
    days = load_events(spark, sf_dir).where("kind = 'assist'").groupBy("cap", F.floor(F.col("t") / (24 * HOUR)).alias("n")).agg(F.max("v").alias("x"))
    days = days.select("cap", F.lit(0).alias("side"), "n", "x", F.col("n").alias("t"), F.lit(0).cast("long").alias("kills"))
    groups = kill_groups(spark, sf_dir).withColumn("x", F.col("kills") + F.col("score") / 10)
    groups = groups.withColumn("place", by(F.desc("x"), "s", "grp")).join(days.groupBy("cap").agg(F.count("*").alias("room")), "cap").where("place <= room")
    rows = days.unionByName(groups.select("cap", F.lit(1).alias("side"), F.col("grp").alias("n"), "x", F.col("s").alias("t"), "kills"))

    def run(g: pd.DataFrame) -> list[tuple]:
        own, cells, at = g[g.side == 0], [], 0
        for x in own.x.tolist():
            cells.append(slots.Cell(at, at + (8 if x < 50 else 4), x / 100))
            at = cells[-1].stop
        drop = int(own.x.to_numpy().argmax())
        cells[drop] = replace(cells[drop], drop=True, importance=cells[drop].importance + 10)
        taking = [slots.Group(n, x, 2 + 2 * k, t, k, k) for n, x, t, k in g[g.side == 1][["n", "x", "t", "kills"]].itertuples(index=False, name=None)]
        board = slots.Board(cells, 12, apart=24.0 * HOUR)
        return [(how, c.group.key, c.start, c.stop) for how, laid in (("build", slots.build_up(board, taking)), ("time", slots.in_time(board, taking))) if taking for c in laid]

    return per_key(rows, "cap", run, {"manner": "string", "grp": "long", "start_beat": "long", "end_beat": "long"}, ["side", "t", "n"])


@query("margin_merge", EV + HL + f""", m AS (SELECT cap, grp, greatest(s - {18 * H}, 0) AS s, least(e + {18 * H}, {720 * H}) AS e, peak, score FROM hl),
 i AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY cap ORDER BY s, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM m), n AS (SELECT *, sum(f) OVER (PARTITION BY cap ORDER BY s, grp) AS island FROM i)
 SELECT cap, min(grp) AS grp, min(s) AS s, max(e) AS e, max(score) AS score, arg_min(peak, (-score, s, grp)) AS peak FROM n GROUP BY cap, island""".replace("arg_min(peak, (-score, s, grp))", "list_extract(list_sort(list((-score, s, grp, peak))), 1)[4]"))  # fmt: skip
def margin_merge(spark, sf_dir):
    """Moments with margins; those that then overlap (strictly) become one with the peak of the best, the first of equals."""
    rows = highlights(spark, sf_dir).select("cap", "grp", F.greatest(F.col("s") - 18 * HOUR, F.lit(0)).alias("s"), F.least(F.col("e") + 18 * HOUR, F.lit(TOTAL)).alias("e"), "peak", "score")
    order = Window.partitionBy("cap").orderBy("s", "grp")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("f", F.when(F.col("s") < reach, 0).otherwise(1)).withColumn("island", F.sum("f").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.min_by("peak", F.struct(-F.col("score"), "s", "grp"))
    return marked.groupBy("cap", "island").agg(F.min("grp").alias("grp"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("score").alias("score"), best.alias("peak")).drop("island")


#: A merged moment is as long as this at most, and the part of it that lies before the peak.
LONGEST = 96 * HOUR
BEFORE_PEAK = LONGEST * 6 // 10


def _refit_sql(a: str, b: str) -> str:
    """Two moments that overlap as one in SQL: their union around the peak of the better one (the first of equals), if it is too long."""
    best = f"CASE WHEN {b}.score > {a}.score THEN {b} ELSE {a} END"
    s, e = f"least({a}.s, {b}.s)", f"greatest({a}.e, {b}.e)"
    start = f"CASE WHEN {e} - {s} > {LONGEST} THEN greatest(least(({best}).peak - {BEFORE_PEAK}, {TOTAL - LONGEST}), 0) ELSE {s} END"
    return f"{{'s': {start}, 'grp': ({best}).grp, 'e': {start} + least({e} - {s}, {LONGEST}), 'peak': ({best}).peak, 'score': ({best}).score}}"


@query("refit_merge", EV + HL + f""", m AS (SELECT cap, list({{'s': greatest(s - {18 * H}, 0), 'grp': grp, 'e': least(e + {18 * H}, {720 * H}), 'peak': peak, 'score': score}} ORDER BY greatest(s - {18 * H}, 0), grp) AS x FROM hl GROUP BY cap),
 f AS (SELECT cap, list_reduce(list_transform(x, lambda y: [y]), lambda a, b: CASE WHEN b[1].s < a[len(a)].e THEN list_append(a[1:len(a) - 1], {_refit_sql("a[len(a)]", "b[1]")}) ELSE list_concat(a, b) END) AS y FROM m)
 SELECT cap, u.grp AS grp, CAST(u.s AS BIGINT) AS s, CAST(u.e AS BIGINT) AS e, u.peak AS peak, u.score AS score FROM (SELECT cap, unnest(y) AS u FROM f) z""")  # fmt: skip
def refit_merge(spark, sf_dir):
    """Moments with margins merged in order of time, each union fitted anew around the better peak before the next one is looked at, which a shorter or a moved union may no longer (or newly) meet.

    A fitted union reaches at most the longest length past its members, so groups that lie further apart are folded by themselves, within the row; no task folds a whole capture.
    """
    rows = highlights(spark, sf_dir).select("cap", F.greatest(F.col("s") - 18 * HOUR, F.lit(0)).alias("s"), "grp", F.least(F.col("e") + 18 * HOUR, F.lit(TOTAL)).alias("e"), "peak", "score")
    order = Window.partitionBy("cap").orderBy("s", "grp")
    reach = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    far = rows.withColumn("f", F.when(F.col("s") < reach + LONGEST, 0).otherwise(1)).withColumn("part", F.sum("f").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    moment = F.struct("s", "grp", "e", "peak", "score")

    def fitted(a, b):
        best = F.when(b["score"] > a["score"], b).otherwise(a)
        s, e = F.least(a["s"], b["s"]), F.greatest(a["e"], b["e"])
        start = F.when(e - s > LONGEST, F.greatest(F.least(best["peak"] - BEFORE_PEAK, F.lit(TOTAL - LONGEST)), F.lit(0))).otherwise(s)
        return F.struct(start.alias("s"), best["grp"].alias("grp"), (start + F.least(e - s, F.lit(LONGEST))).alias("e"), best["peak"].alias("peak"), best["score"].alias("score"))

    def step(kept, b):
        last = F.element_at(kept, -1)
        return F.when(b["s"] < last["e"], F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(fitted(last, b)))).otherwise(F.concat(kept, F.array(b)))

    lists = far.groupBy("cap", "part").agg(F.sort_array(F.collect_list(moment)).alias("x"))
    merged = F.aggregate(F.slice("x", 2, F.size("x")), F.slice("x", 1, 1), step)
    return lists.select("cap", F.inline(merged)).select("cap", "grp", "s", "e", "peak", "score")


# Reactions ----------------------------------------------------------------------------------------------------------------------------------------

BURSTS = f""", lv AS (SELECT cap, CAST(t // {6 * H} AS BIGINT) AS slot, max(v) AS db FROM ev WHERE kind IN ('shot', 'assist') AND t >= 0 GROUP BY ALL),
 hb AS (SELECT cap, list_extract(list_sort(list(db)), CAST(count(*) // 2 + 1 AS INTEGER)) AS usual FROM lv WHERE db > 5 GROUP BY cap),
 lo AS (SELECT lv.*, usual FROM lv JOIN hb USING (cap) WHERE db >= usual + 10),
 bi AS (SELECT *, CASE WHEN slot - lag(slot) OVER (PARTITION BY cap ORDER BY slot) <= 3 THEN 0 ELSE 1 END AS f FROM lo), bg AS (SELECT *, CAST(sum(f) OVER (PARTITION BY cap ORDER BY slot) AS BIGINT) AS burst FROM bi),
 bu AS (SELECT cap, burst, min(slot) * {6 * H} AS s, (max(slot) + 1) * {6 * H} AS e, max(db) - min(usual) AS rise FROM bg GROUP BY cap, burst HAVING max(slot) - min(slot) >= 1)"""


def bursts(spark, sf_dir: str) -> DataFrame:
    """Stretches of levels over the capture's usual one, over holes of two slots, two slots long at least."""
    levels = load_events(spark, sf_dir).where("kind in ('shot', 'assist') and t >= 0").groupBy("cap", F.floor(F.col("t") / (6 * HOUR)).alias("slot")).agg(F.max("v").alias("db"))
    own = Window.partitionBy("cap").orderBy("db", "slot")
    active = levels.where("db > 5").withColumns({"n": F.row_number().over(own), "all": F.count("*").over(Window.partitionBy("cap"))})
    usual = active.where(F.col("n") == F.floor(F.col("all") / 2) + 1).select("cap", F.col("db").alias("usual"))
    loud = levels.join(usual, "cap").where("db >= usual + 10")
    found = intervals.islands(loud, "cap", "slot", 3, ties="slot", into="burst").groupBy("cap", "burst")
    rows = found.agg((F.min("slot") * 6 * HOUR).alias("s"), ((F.max("slot") + 1) * 6 * HOUR).alias("e"), (F.max("db") - F.min("usual")).alias("rise"))
    return rows.where(F.col("e") - F.col("s") >= 12 * HOUR)


@query("loud_bursts", EV + BURSTS + " SELECT cap, burst, s, e, round(rise, 6) AS rise FROM bu")
def loud_bursts(spark, sf_dir):
    return bursts(spark, sf_dir).select("cap", "burst", "s", "e", F.round("rise", 6).alias("rise"))


@query("reaction_strength", EV + BURSTS + f""", ca AS (SELECT bu.cap, burst, max(t) AS cause FROM bu JOIN ev ON ev.cap = bu.cap AND kind IN ('kill', 'death') AND t <= s + {H} AND s - t <= {24 * H} GROUP BY ALL)
 SELECT bu.cap, bu.burst, cause, round(rise / 10 + 0.5 * least((e - s) / {24 * H}.0, 3.0) / 3 + CASE WHEN burst % 2 = 0 THEN 0.5 ELSE 0 END + CASE WHEN cause IS NOT NULL THEN 0.4 ELSE 0 END, 6) AS strength FROM bu LEFT JOIN ca USING (cap, burst)""")  # fmt: skip
def reaction_strength(spark, sf_dir):
    """A burst's rise, a little of its length, a laugh (here every other), and a cause in the game: the latest in the window before it."""
    rows = bursts(spark, sf_dir)
    causes = load_events(spark, sf_dir).where("kind in ('kill', 'death')").select("cap", "id", "t")
    starts = rows.select("cap", F.col("burst").alias("id"), F.col("s").alias("t"))
    latest = matching.near_events(starts, causes, 24 * HOUR, HOUR).groupBy("cap", F.col("lid").alias("burst")).agg(F.max("rt").alias("cause"))
    length = F.least((F.col("e") - F.col("s")) / F.lit(24.0 * HOUR), F.lit(3.0)) / 3
    strength = F.col("rise") / 10 + 0.5 * length + F.when(F.col("burst") % 2 == 0, 0.5).otherwise(0) + F.when(F.col("cause").isNotNull(), 0.4).otherwise(0)
    return rows.join(latest, ["cap", "burst"], "left").select("cap", "burst", "cause", F.round(strength, 6).alias("strength"))


@query("payoff_extension", EV + HL + BURSTS + f""", r AS (SELECT hl.cap, grp, max(bu.e) AS reacted FROM hl JOIN bu ON bu.cap = hl.cap AND bu.s BETWEEN peak - {6 * H} AND peak + {36 * H} GROUP BY ALL)
 SELECT hl.cap, grp, s, least(greatest(e, coalesce(reacted + {2 * H}, e)), e + {24 * H}, {720 * H}) AS e FROM hl LEFT JOIN r USING (cap, grp)""")  # fmt: skip
def payoff_extension(spark, sf_dir):
    """Moments that last until shortly after the reaction to their peak, by up to a day."""
    own = highlights(spark, sf_dir)
    peaks = own.select("cap", F.col("grp").alias("id"), F.col("peak").alias("t"))
    starts = bursts(spark, sf_dir).select("cap", F.col("burst").alias("id"), F.col("s").alias("t"), "e")
    met = matching.near_events(peaks, starts, 6 * HOUR, 36 * HOUR).join(starts.select("cap", F.col("id").alias("rid"), F.col("e").alias("reacted")), ["cap", "rid"])
    last = met.groupBy("cap", F.col("lid").alias("grp")).agg(F.max("reacted").alias("reacted"))
    end = F.least(F.greatest("e", F.coalesce(F.col("reacted") + 2 * HOUR, "e")), F.col("e") + 24 * HOUR, F.lit(TOTAL))
    return own.join(last, ["cap", "grp"], "left").select("cap", "grp", "s", end.alias("e"))


@query("nearest_reaction", EV + GROUPS + BURSTS + f""", p AS (SELECT gr.cap, gr.grp, bu.burst, row_number() OVER (PARTITION BY gr.cap, gr.grp ORDER BY abs(bu.s - gr.s), bu.s, bu.burst) AS n FROM gr JOIN bu ON bu.cap = gr.cap AND abs(bu.s - gr.s) <= {48 * H})
 SELECT gr.cap, gr.grp, p.burst, round(score / max(score) OVER (), 6) AS share FROM gr LEFT JOIN p ON p.cap = gr.cap AND p.grp = gr.grp AND p.n = 1""")  # fmt: skip
def nearest_reaction(spark, sf_dir):
    """Groups with the reaction nearest to their start, and their score as a share of the best of all."""
    own = kill_groups(spark, sf_dir)
    starts = bursts(spark, sf_dir).select("cap", F.col("burst").alias("id"), F.col("s").alias("t"))
    near = matching.nearest(own.select("cap", F.col("grp").alias("id"), F.col("s").alias("t")), starts, 48 * HOUR).select("cap", F.col("lid").alias("grp"), F.col("rid").alias("burst"))
    top = F.broadcast(load_events(spark, sf_dir).where("kind = 'kill'").agg(F.max("v").alias("top")))  # one row; a group's score is its best kill's
    return own.join(near, ["cap", "grp"], "left").crossJoin(top).select("cap", "grp", "burst", F.round(F.col("score") / F.col("top"), 6).alias("share"))


# Manual edits -------------------------------------------------------------------------------------------------------------------------------------

@query("moment_adjust", EV + HL + f""", a AS (SELECT *, (grp % 7 - 3) * {12 * H} AS d, greatest({72 * H}, e - s) AS longest, least({24 * H}, e - s) AS shortest FROM hl),
 n AS (SELECT *, CASE WHEN grp % 2 = 0 THEN s ELSE least(greatest(s + d, greatest(0, e - longest)), e - shortest) END AS s2, CASE WHEN grp % 2 = 0 THEN least(greatest(e + d, s + shortest), least({720 * H}, s + longest)) ELSE e END AS e2 FROM a)
 SELECT cap, grp, s2 AS s, e2 AS e, least(greatest(peak, s2), e2) AS peak, CASE WHEN s2 = s AND e2 = e THEN 'detected' ELSE 'adjusted' END AS origin FROM n""")  # fmt: skip
def moment_adjust(spark, sf_dir):
    """A boundary moved within the least and greatest length and the capture (starts of odd moments, ends of even ones); the peak stays inside."""
    d, longest, shortest = (F.col("grp") % 7 - 3) * 12 * HOUR, F.greatest(F.lit(72 * HOUR), F.col("e") - F.col("s")), F.least(F.lit(24 * HOUR), F.col("e") - F.col("s"))
    even = F.col("grp") % 2 == 0
    s2 = F.when(even, F.col("s")).otherwise(F.least(F.greatest(F.col("s") + d, F.greatest(F.lit(0), F.col("e") - longest)), F.col("e") - shortest))
    e2 = F.when(even, F.least(F.greatest(F.col("e") + d, F.col("s") + shortest), F.least(F.lit(TOTAL), F.col("s") + longest))).otherwise(F.col("e"))
    rows = highlights(spark, sf_dir).withColumns({"s2": s2, "e2": e2})
    origin = F.when((F.col("s2") == F.col("s")) & (F.col("e2") == F.col("e")), "detected").otherwise("adjusted")
    return rows.select("cap", "grp", F.col("s2").alias("s"), F.col("e2").alias("e"), F.least(F.greatest("peak", "s2"), "e2").alias("peak"), origin.alias("origin"))


@query("moment_insert", EV + HL + f""", dm AS (SELECT cap, id, t, least(greatest(t - {18 * H}, 0), {720 * H} - {36 * H}) AS s FROM ev WHERE kind = 'death' AND t BETWEEN 0 AND {720 * H}),
 ce AS (SELECT dm.cap, dm.id, f.win * {12 * H} + {12 * H} AS c, f.total, row_number() OVER (PARTITION BY dm.cap, dm.id ORDER BY f.total DESC, f.win) AS n FROM dm JOIN fused f ON f.cap = dm.cap AND f.win * {12 * H} + {12 * H} BETWEEN dm.s AND dm.s + {36 * H}),
 ic AS (SELECT dm.cap, dm.id, count(*) AS events FROM dm JOIN ev ON ev.cap = dm.cap AND ev.t BETWEEN dm.s AND dm.s + {36 * H} GROUP BY ALL),
 od AS (SELECT cap, max(grp) AS top FROM hl GROUP BY cap)
 SELECT dm.cap, dm.id, dm.s, coalesce(c, t) AS peak, coalesce(total, 0) AS score, events, coalesce(top, 0) + row_number() OVER (PARTITION BY dm.cap ORDER BY t, dm.id) AS place
 FROM dm LEFT JOIN ce ON ce.cap = dm.cap AND ce.id = dm.id AND n = 1 LEFT JOIN ic ON ic.cap = dm.cap AND ic.id = dm.id LEFT JOIN od ON od.cap = dm.cap""")  # fmt: skip
def moment_insert(spark, sf_dir):
    """Moments of 36 hours added around deaths: shifted into the capture, peak and score of the best window whose centre lies inside, events inside, next place in the order."""
    e = load_events(spark, sf_dir)
    own = e.where(f"kind = 'death' and t between 0 and {TOTAL}").select("cap", "id", "t", clamp(F.col("t") - 18 * HOUR, 0, TOTAL - 36 * HOUR).alias("s"))
    at_start = own.select("cap", "id", F.col("s").alias("t"))
    centres = fused(spark, sf_dir).select("cap", F.col("win").alias("id"), (F.col("win") * grid.HOP + grid.HOP).alias("t"), "total")
    met = matching.near_events(at_start, centres, 0, 36 * HOUR).join(centres.select("cap", F.col("id").alias("rid"), "total"), ["cap", "rid"])
    best = met.groupBy("cap", F.col("lid").alias("id")).agg(F.min_by(F.struct("rt", "total"), F.struct(-F.col("total"), "rid")).alias("best"))
    inside = matching.near_events(at_start, e, 0, 36 * HOUR).groupBy("cap", F.col("lid").alias("id")).agg(F.count("*").alias("events"))
    top = moments(spark, sf_dir).groupBy("cap").agg(F.max("grp").alias("top"))
    rows = own.join(best, ["cap", "id"], "left").join(inside, ["cap", "id"], "left").join(top, "cap", "left")
    place = F.coalesce("top", F.lit(0)) + F.row_number().over(Window.partitionBy("cap").orderBy("t", "id"))
    return rows.select("cap", "id", "s", F.coalesce("best.rt", "t").alias("peak"), F.coalesce("best.total", F.lit(0.0)).alias("score"), "events", place.alias("place"))


@query("reselection", EV + FUSED + f""", hot AS (SELECT cap, win, total, CASE WHEN win - lag(win) OVER o <= 1 THEN 0 ELSE 1 END AS f FROM fused WHERE total >= 0.7 WINDOW o AS (PARTITION BY cap ORDER BY win)), gp AS (SELECT *, sum(f) OVER (PARTITION BY cap ORDER BY win) AS grp FROM hot),
 mo AS (SELECT cap, CAST(grp AS BIGINT) AS grp, min(win) AS first_win, max(win) AS last_win, max(total) AS score FROM gp GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, cap, first_win) AS n FROM mo) SELECT cap, grp, first_win, last_win, score FROM r WHERE n <= 50""")  # fmt: skip
def reselection(spark, sf_dir):
    """The same timeline under another threshold, gap and shared target: the best fifty of all captures."""
    hot = intervals.islands(fused(spark, sf_dir).where("total >= 0.7"), "cap", "win", 1, ties="win")
    found = hot.groupBy("cap", "grp").agg(F.min("win").alias("first_win"), F.max("win").alias("last_win"), F.max("total").alias("score"))
    return found.orderBy(F.desc("score"), "cap", "first_win").limit(50)


@query("chosen_evening", EV + GAMES + " SELECT count(*) AS games, CAST(sum(kills) AS BIGINT) AS kills, CAST(sum(deaths) AS BIGINT) AS deaths, CAST(sum(duration) AS BIGINT) AS played, min(s) AS s FROM game WHERE kills >= 3 AND deaths >= 1")
def chosen_evening(spark, sf_dir):
    """An evening made of chosen games: neither split by date nor freed of copies."""
    rows = games(spark, sf_dir).where("kills >= 3 and deaths >= 1")
    return rows.agg(F.count("*").alias("games"), F.sum("kills").alias("kills"), F.sum("deaths").alias("deaths"), F.sum("duration").alias("played"), F.min("s").alias("s"))


@query("outdated_rows", "SELECT s_suppkey, substr(sha256('v' || (s_suppkey % 3) || '|' || s_nationkey), 1, 24) AS fp FROM supplier WHERE substr(sha256('v' || (s_suppkey % 3) || '|' || s_nationkey), 1, 24) <> substr(sha256('v2|' || s_nationkey), 1, 24)")
def outdated_rows(spark, sf_dir):
    """Index rows whose fingerprint isn't that of the present configuration."""
    own = F.substring(F.sha2(F.concat(F.lit("v"), F.col("s_suppkey") % 3, F.lit("|"), "s_nationkey"), 256), 1, 24)
    now = F.substring(F.sha2(F.concat(F.lit("v2|"), "s_nationkey"), 256), 1, 24)
    return table(spark, sf_dir, "supplier").select("s_suppkey", own.alias("fp"), now.alias("now")).where("fp <> now").drop("now")


@query("kept_manual", EV + HL + """, f AS (SELECT cap, grp, s + 21600000000 AS s, e + 21600000000 AS e, score FROM hl), m AS (SELECT * FROM hl WHERE manual)
 SELECT cap, grp, s, e, 'manual' AS origin FROM m UNION ALL SELECT cap, grp, s, e, 'detected' FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.cap = f.cap AND m.s < f.e AND f.s < m.e)""")  # fmt: skip
def kept_manual(spark, sf_dir):
    """After another analysis (here, moments six hours later): manual moments stay, and detected ones that overlap them go."""
    own = highlights(spark, sf_dir)
    manual = own.where("manual").select("cap", "grp", "s", "e")
    fresh = own.select("cap", "grp", (F.col("s") + 6 * HOUR).alias("s"), (F.col("e") + 6 * HOUR).alias("e"))
    left, right = fresh.select("cap", "grp", F.col("s").alias("ls"), F.col("e").alias("le")), manual.select("cap", F.col("s").alias("rs"), F.col("e").alias("re"))
    gone = intervals.bucketed_overlap(left, right, "cap", 96 * HOUR, (F.col("ls") < F.col("re")) & (F.col("rs") < F.col("le"))).select("cap", "grp").distinct()
    return manual.withColumn("origin", F.lit("manual")).unionByName(fresh.join(gone, ["cap", "grp"], "left_anti").withColumn("origin", F.lit("detected")))


# Beats and sections -------------------------------------------------------------------------------------------------------------------------------

BEATS = SIGNAL + """, bt AS (SELECT cap, row_number() OVER (PARTITION BY cap ORDER BY win) - 1 AS beat, win, raw AS accent FROM sig WHERE kind = 'kill')"""


def beats(spark, sf_dir: str) -> DataFrame:
    """The windows of a capture's kill signal as the beats of a song."""
    rows = signals(spark, sf_dir).where("kind = 'kill'")
    return rows.select("cap", (F.row_number().over(Window.partitionBy("cap").orderBy("win")) - 1).alias("beat"), "win", F.col("raw").alias("accent"))


@query("beat_realignment", EV + BEATS + f" SELECT cap, beat, win * {12 * H} + CAST(round({3 * H} * greatest(0.0, 1 - abs(beat - 10) / 8.0)) AS BIGINT) AS at_us FROM bt")
def beat_realignment(spark, sf_dir):
    """Beats shifted around the tenth, by less the further away, over eight beats."""
    shift = F.round(3 * HOUR * F.greatest(F.lit(0.0), 1 - F.abs(F.col("beat") - 10) / 8.0)).cast("long")
    return beats(spark, sf_dir).select("cap", "beat", (F.col("win") * grid.HOP + shift).alias("at_us"))


SECTIONS = BEATS + ", sc AS (SELECT cap, beat // 8 AS section, min(beat) AS first_beat, max(beat) AS last_beat, avg(accent) / 100 AS intensity FROM bt GROUP BY ALL)"


def sections(spark, sf_dir: str) -> DataFrame:
    rows = beats(spark, sf_dir).groupBy("cap", F.floor(F.col("beat") / 8).alias("section"))
    return rows.agg(F.min("beat").alias("first_beat"), F.max("beat").alias("last_beat"), (F.avg("accent") / 100).alias("intensity"))


@query("section_split", EV + SECTIONS + """ SELECT cap, section, CASE WHEN lag(section) OVER o IS NOT NULL AND 11 BETWEEN lag(first_beat) OVER o + 1 AND last_beat AND 11 BETWEEN lag(last_beat) OVER o - 3 AND first_beat + 3 THEN 11 ELSE first_beat END AS first_beat,
 CASE WHEN lead(section) OVER o IS NOT NULL AND 11 BETWEEN first_beat + 1 AND lead(last_beat) OVER o AND 11 BETWEEN last_beat - 3 AND lead(first_beat) OVER o + 3 THEN 10 ELSE last_beat END AS last_beat FROM sc WINDOW o AS (PARTITION BY cap ORDER BY section)""")  # fmt: skip
def section_split(spark, sf_dir):
    """The boundary between two sections moved to beat 11, where it lies within four beats of it."""
    o = Window.partitionBy("cap").orderBy("section")
    b = F.lit(11)
    start = F.lag("section").over(o).isNotNull() & b.between(F.lag("first_beat").over(o) + 1, F.col("last_beat")) & b.between(F.lag("last_beat").over(o) - 3, F.col("first_beat") + 3)
    stop = F.lead("section").over(o).isNotNull() & b.between(F.col("first_beat") + 1, F.lead("last_beat").over(o)) & b.between(F.col("last_beat") - 3, F.lead("first_beat").over(o) + 3)
    return sections(spark, sf_dir).select("cap", "section", F.when(start, 11).otherwise(F.col("first_beat")).cast("long").alias("first_beat"), F.when(stop, 10).otherwise(F.col("last_beat")).cast("long").alias("last_beat"))


DROPS = SECTIONS + """, dj AS (SELECT *, round(intensity - lag(intensity) OVER (PARTITION BY cap ORDER BY section) + 0.25 * intensity, 6) AS jump, max(intensity) OVER (PARTITION BY cap) AS top FROM sc),
 dc AS (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY section) AS n FROM dj WHERE jump IS NOT NULL AND intensity >= greatest(0.6, 0.85 * top))"""


@query("song_drop", EV + DROPS + """, fold AS (SELECT cap, list_reduce(list({'section': section, 'jump': jump} ORDER BY section), lambda a, b: CASE WHEN b.jump > a.jump + 0.05 THEN b ELSE a END) AS best FROM dc GROUP BY cap)
 SELECT cap, best.section AS section, best.jump AS jump FROM fold""")  # fmt: skip
def song_drop(spark, sf_dir):
    """The section where a song drops: of the intense ones the first whose jump no later one beats clearly. A song has a few sections, folded in order."""
    o = Window.partitionBy("cap").orderBy("section")
    jump = F.round(F.col("intensity") - F.lag("intensity").over(o) + 0.25 * F.col("intensity"), 6)
    rows = sections(spark, sf_dir).withColumns({"jump": jump, "top": F.max("intensity").over(Window.partitionBy("cap"))})
    good = rows.where("jump is not null").where(F.col("intensity") >= F.greatest(F.lit(0.6), 0.85 * F.col("top")))
    listed = good.groupBy("cap").agg(F.sort_array(F.collect_list(F.struct("section", "jump"))).alias("all"))
    best = F.aggregate(F.slice("all", 2, 1 << 20), F.element_at("all", 1), lambda a, b: F.when(b["jump"] > a["jump"] + 0.05, b).otherwise(a))
    return listed.select("cap", best.alias("best")).select("cap", "best.section", "best.jump")


@query("anchor_beats", EV + SECTIONS + """, x AS (SELECT bt.cap, section, beat, round(accent / 100 + CASE WHEN beat % 4 = 0 THEN 0.4 ELSE 0 END + 0.15 * (1 - (beat - first_beat) / 8.0), 6) AS fit FROM bt JOIN sc ON sc.cap = bt.cap AND beat BETWEEN first_beat AND last_beat),
 r AS (SELECT *, row_number() OVER (PARTITION BY cap, section ORDER BY fit DESC, beat) AS n FROM x) SELECT cap, section, beat, fit FROM r WHERE n = 1""")  # fmt: skip
def anchor_beats(spark, sf_dir):
    """The beat of each section to lay a kill on: its accent, more on the first of four, a little more early in the section."""
    first = F.min("beat").over(Window.partitionBy("cap", "section"))
    fit = F.round(F.col("accent") / 100 + F.when(F.col("beat") % 4 == 0, 0.4).otherwise(0) + 0.15 * (1 - (F.col("beat") - F.col("first_beat")) / 8.0), 6)
    rows = beats(spark, sf_dir).withColumn("section", F.floor(F.col("beat") / 8)).withColumn("first_beat", first).withColumn("fit", fit)
    best = Window.partitionBy("cap", "section").orderBy(F.desc("fit"), "beat")
    return rows.withColumn("n", F.row_number().over(best)).where("n = 1").select("cap", "section", "beat", "fit")


@query("syncopation", EV + BEATS + """ SELECT cap, beat, accent < 0.7 * lead(accent) OVER o AND lead(win) OVER o - win = 1 AS syncopated, CASE WHEN beat % 2 = 1 AND accent >= 0.9 * lag(accent) OVER o THEN 'half' ELSE 'full' END AS hit FROM bt WINDOW o AS (PARTITION BY cap ORDER BY beat)""")
def syncopation(spark, sf_dir):
    """Beats that are weak right before a strong one, and odd beats about as strong as the one before."""
    o = Window.partitionBy("cap").orderBy("beat")
    weak = (F.col("accent") < 0.7 * F.lead("accent").over(o)) & (F.lead("win").over(o) - F.col("win") == 1)
    hit = F.when((F.col("beat") % 2 == 1) & (F.col("accent") >= 0.9 * F.lag("accent").over(o)), "half").otherwise("full")
    return beats(spark, sf_dir).select("cap", "beat", weak.alias("syncopated"), hit.alias("hit"))


@query("merged_kills", EV + f""", k AS (SELECT cap, id, t, row_number() OVER (PARTITION BY cap ORDER BY t, id) * {10 * H} AS laid FROM ev WHERE kind = 'kill'),
 f AS (SELECT *, CASE WHEN abs((t - lag(t) OVER o) - (laid - lag(laid) OVER o)) <= {4 * H} AND laid - lag(laid) OVER o < {12 * H} THEN 0 ELSE 1 END AS f FROM k WINDOW o AS (PARTITION BY cap ORDER BY t, id)), g AS (SELECT *, sum(f) OVER (PARTITION BY cap ORDER BY t, id) AS clip FROM f)
 SELECT cap, CAST(clip AS BIGINT) AS clip, min(t) AS s, max(t) AS e, count(*) AS n FROM g GROUP BY cap, clip""")  # fmt: skip
def merged_kills(spark, sf_dir):
    """Kills that are laid as far apart in the song as in the capture become one clip."""
    o = Window.partitionBy("cap").orderBy("t", "id")
    rows = load_events(spark, sf_dir).where("kind = 'kill'").select("cap", "id", "t", (F.row_number().over(o) * 10 * HOUR).alias("laid"))
    near = (F.abs((F.col("t") - F.lag("t").over(o)) - (F.col("laid") - F.lag("laid").over(o))) <= 4 * HOUR) & (F.col("laid") - F.lag("laid").over(o) < 12 * HOUR)
    marked = rows.withColumn("f", F.when(near, 0).otherwise(1)).withColumn("clip", F.sum("f").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("cap", "clip").agg(F.min("t").alias("s"), F.max("t").alias("e"), F.count("*").alias("n"))


@query("virtual_beats", EV + SECTIONS + f""", nb AS (SELECT cap, win * {12 * H} AS at_us, beat, false AS virtual FROM bt UNION ALL SELECT cap, t, NULL, true FROM ev WHERE kind = 'death' AND t >= 0),
 ix AS (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY at_us, virtual, beat) - 1 AS n FROM (SELECT DISTINCT * FROM nb) d)
 SELECT sc.cap, sc.section, a.n AS first_beat, b.n AS last_beat FROM sc JOIN ix a ON a.cap = sc.cap AND a.beat = sc.first_beat JOIN ix b ON b.cap = sc.cap AND b.beat = sc.last_beat""")  # fmt: skip
def virtual_beats(spark, sf_dir):
    """Beats with further ones put between them, and the sections in the new numbering."""
    own = beats(spark, sf_dir).select("cap", (F.col("win") * grid.HOP).alias("at_us"), "beat", F.lit(False).alias("virtual"))
    more = load_events(spark, sf_dir).where("kind = 'death' and t >= 0").select("cap", F.col("t").alias("at_us"), F.lit(None).cast("int").alias("beat"), F.lit(True).alias("virtual")).distinct()
    index = own.unionByName(more).withColumn("n", F.row_number().over(Window.partitionBy("cap").orderBy("at_us", "virtual", "beat")) - 1).where("not virtual").select("cap", "beat", "n")
    first, last = (index.select("cap", F.col("beat").alias(x), F.col("n").alias(f"new_{x}")) for x in ("first_beat", "last_beat"))
    return sections(spark, sf_dir).join(first, ["cap", "first_beat"]).join(last, ["cap", "last_beat"]).select("cap", "section", F.col("new_first_beat").alias("first_beat"), F.col("new_last_beat").alias("last_beat"))


@query("one_taps", EV + GROUPS + f""", sh AS (SELECT k.cap, k.id, k.grp, count(s.id) AS shots, count(h.id) > 0 AS head FROM kg k LEFT JOIN ev s ON s.cap = k.cap AND s.kind = 'shot' AND s.t BETWEEN k.t - {12 * H} AND k.t LEFT JOIN ev h ON h.cap = k.cap AND h.kind = 'headshot' AND h.t BETWEEN k.t - {24 * H} AND k.t + {24 * H} GROUP BY ALL),
 st AS (SELECT cap, bool_or(kind = 'headshot') AS strict FROM ev GROUP BY cap) SELECT sh.cap, grp, any_value(strict) AS strict, count(*) AS kills FROM sh JOIN st USING (cap) GROUP BY sh.cap, grp HAVING bool_and(shots = 1) AND (NOT any_value(strict) OR bool_and(head))""".replace("count(s.id) AS shots, count(h.id) > 0", "count(DISTINCT s.id) AS shots, count(h.id) > 0"))  # fmt: skip
def one_taps(spark, sf_dir):
    """Groups all of whose kills took one shot, and hit the head too in captures that know of such hits."""
    e = load_events(spark, sf_dir)
    order = Window.partitionBy("cap").orderBy("t", "id")
    kills = rounds(spark, sf_dir).where("kind = 'kill'").withColumn("turn", F.col("round") != F.lag("round").over(order))
    kills = intervals.islands(kills, "cap", "t", 12 * HOUR, breaks=F.col("turn")).select("cap", "id", "t", "grp")
    shots = matching.near_events(kills, e.where("kind = 'shot'"), 12 * HOUR, 0).groupBy("cap", F.col("lid").alias("id")).agg(F.count("*").alias("shots"))
    heads = matching.near_events(kills, e.where("kind = 'headshot'"), 24 * HOUR, 24 * HOUR).select("cap", F.col("lid").alias("id"), F.lit(True).alias("head")).distinct()
    strict = e.groupBy("cap").agg(F.bool_or(F.col("kind") == "headshot").alias("strict"))
    rows = kills.join(shots, ["cap", "id"], "left").join(heads, ["cap", "id"], "left").join(strict, "cap")
    by = rows.groupBy("cap", "grp").agg(F.first("strict").alias("strict"), F.count("*").alias("kills"), F.bool_and(F.coalesce("shots", F.lit(0)) == 1).alias("one"), F.bool_and(F.coalesce("head", F.lit(False))).alias("head"))
    return by.where("one and (not strict or head)").select("cap", "grp", "strict", "kills")


@query("mark_pairing", EV + GROUPS + f""", mk AS (SELECT cap, t, v, CASE WHEN t - lag(t) OVER (PARTITION BY cap ORDER BY t, id) <= {6 * H} THEN 0 ELSE 1 END AS f FROM ev WHERE kind = 'assist'),
 mc AS (SELECT *, sum(f) OVER (PARTITION BY cap ORDER BY t) AS c FROM mk), cl AS (SELECT cap, min(t) AS at_us, max(v) AS strength FROM mc GROUP BY cap, c),
 cr AS (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY strength DESC, at_us) AS n FROM cl), gk AS (SELECT cap, grp, row_number() OVER (PARTITION BY cap ORDER BY kills + score / 10 DESC, grp) AS n FROM gr)
 SELECT cap, grp, at_us FROM gk JOIN cr USING (cap, n)""")  # fmt: skip
def mark_pairing(spark, sf_dir):
    """Marks within six hours of one another are one; the best group goes to the strongest mark, and so on."""
    marks = intervals.islands(load_events(spark, sf_dir).where("kind = 'assist'"), "cap", "t", 6 * HOUR, into="c").groupBy("cap", "c").agg(F.min("t").alias("at_us"), F.max("v").alias("strength"))
    ranked = marks.select("cap", "at_us", F.row_number().over(Window.partitionBy("cap").orderBy(F.desc("strength"), "at_us")).alias("n"))
    groups = kill_groups(spark, sf_dir).select("cap", "grp", F.row_number().over(Window.partitionBy("cap").orderBy(F.desc(F.col("kills") + F.col("score") / 10), "grp")).alias("n"))
    return groups.join(ranked, ["cap", "n"]).select("cap", "grp", "at_us")


@query("constraint_problems", EV + GROUPS + """, c AS (SELECT cap, grp, grp % 3 = 0 AS excluded, grp % 4 = 0 AS forced, CASE WHEN grp % 5 = 0 THEN grp % 2 END AS pin FROM gr),
 p AS (SELECT cap, grp, 'excluded and forced' AS problem FROM c WHERE excluded AND forced UNION ALL SELECT cap, grp, 'excluded and pinned' FROM c WHERE excluded AND pin IS NOT NULL
 UNION ALL SELECT cap, grp, 'place taken' FROM (SELECT *, row_number() OVER (PARTITION BY cap, pin ORDER BY grp) AS n FROM c WHERE pin IS NOT NULL) x WHERE n > 1) SELECT * FROM p""")  # fmt: skip
def constraint_problems(spark, sf_dir):
    """What contradicts itself in the edits of a plan: groups both excluded and forced or pinned, and places pinned twice."""
    c = kill_groups(spark, sf_dir).select("cap", "grp", (F.col("grp") % 3 == 0).alias("excluded"), (F.col("grp") % 4 == 0).alias("forced"), F.when(F.col("grp") % 5 == 0, F.col("grp") % 2).alias("pin"))
    taken = F.col("pin").isNotNull() & (F.row_number().over(Window.partitionBy("cap", "pin").orderBy("grp")) > 1)
    found = F.array(F.when(F.col("excluded") & F.col("forced"), "excluded and forced"), F.when(F.col("excluded") & F.col("pin").isNotNull(), "excluded and pinned"), F.when(F.col("taken"), "place taken"))
    return c.withColumn("taken", taken).select("cap", "grp", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))


@query("constrained_plan", EV + GROUPS + """, c AS (SELECT cap, grp, kills + score / 10 AS r, grp % 4 = 0 AND grp % 3 <> 0 AS forced FROM gr WHERE grp % 3 <> 0),
 k AS (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY forced DESC, r DESC, grp) AS n FROM c) SELECT cap, grp, forced, row_number() OVER (PARTITION BY cap ORDER BY grp) AS place FROM k WHERE n <= 3 OR forced""")  # fmt: skip
def constrained_plan(spark, sf_dir):
    """Excluded groups go, forced ones stay whatever their rank, the best fill up to three."""
    c = kill_groups(spark, sf_dir).where("grp % 3 <> 0").select("cap", "grp", (F.col("kills") + F.col("score") / 10).alias("r"), (F.col("grp") % 4 == 0).alias("forced"))
    ranked = c.withColumn("n", F.row_number().over(Window.partitionBy("cap").orderBy(F.desc("forced"), F.desc("r"), "grp"))).where("n <= 3 or forced")
    return ranked.select("cap", "grp", "forced", F.row_number().over(Window.partitionBy("cap").orderBy("grp")).alias("place"))


@query("held_poses", EV + SIGNAL + """, h AS (SELECT cap, kind, win, CASE WHEN win - lag(win) OVER (PARTITION BY cap, kind ORDER BY win) <= 2 THEN 0 ELSE 1 END AS f FROM sig WHERE raw >= 40), n AS (SELECT *, sum(f) OVER (PARTITION BY cap, kind ORDER BY win) AS run FROM h)
 SELECT cap, kind, min(win) AS first_win, max(win) AS last_win FROM n GROUP BY cap, kind, run HAVING max(win) - min(win) + 1 >= 3""")  # fmt: skip
def held_poses(spark, sf_dir):
    """Runs of windows over a level, over holes of one window, three windows long at least."""
    o = Window.partitionBy("cap", "kind").orderBy("win")
    rows = signals(spark, sf_dir).where("raw >= 40").withColumn("f", F.when(F.col("win") - F.lag("win").over(o) <= 2, 0).otherwise(1)).withColumn("run", F.sum("f").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("cap", "kind", "run").agg(F.min("win").alias("first_win"), F.max("win").alias("last_win")).where("last_win - first_win + 1 >= 3").drop("run")


@query("sampling_choice", EV + f""", d AS (SELECT cap, t - lag(t) OVER (PARTITION BY cap ORDER BY t, id) AS d FROM ev WHERE kind = 'shot'), r AS (SELECT cap, d, row_number() OVER (PARTITION BY cap ORDER BY d) AS n, count(*) OVER (PARTITION BY cap) AS c FROM d WHERE d IS NOT NULL)
 SELECT cap, d AS between_frames, CASE WHEN d <= {12 * H} THEN 'key frames' WHEN d <= {48 * H} THEN 'key frames, refined' ELSE 'all frames' END AS sampling FROM r WHERE n = c // 2 + 1""")  # fmt: skip
def sampling_choice(spark, sf_dir):
    """The upper median distance of key frames, and the way of reading that it allows."""
    rows = load_events(spark, sf_dir).where("kind = 'shot'").select("cap", (F.col("t") - F.lag("t").over(Window.partitionBy("cap").orderBy("t", "id"))).alias("d")).where("d is not null")
    ranked = rows.withColumns({"n": F.row_number().over(Window.partitionBy("cap").orderBy("d")), "c": F.count("*").over(Window.partitionBy("cap"))}).where(F.col("n") == F.floor(F.col("c") / 2) + 1)
    way = F.when(F.col("d") <= 12 * HOUR, "key frames").when(F.col("d") <= 48 * HOUR, "key frames, refined").otherwise("all frames")
    return ranked.select("cap", F.col("d").alias("between_frames"), way.alias("sampling"))


ROLES = """WITH tr AS (SELECT s_nationkey AS file, s_suppkey AS track, CASE s_suppkey % 6 WHEN 0 THEN 'Microphone' WHEN 1 THEN 'Game audio' WHEN 2 THEN 'Discord' WHEN 3 THEN NULL WHEN 4 THEN 'Track' ELSE 'Mix' END AS title FROM supplier),
 n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY track) AS i, count(*) OVER (PARTITION BY file) AS c FROM tr),
 r AS (SELECT *, CASE WHEN regexp_matches(lower(coalesce(title, '')), 'mic|voice') THEN 'mic' WHEN regexp_matches(lower(coalesce(title, '')), 'game|desktop') THEN 'game' WHEN regexp_matches(lower(coalesce(title, '')), 'discord|chat') THEN 'chat' WHEN regexp_matches(lower(coalesce(title, '')), 'mix') THEN 'mix'
  WHEN c = 1 THEN 'mix' WHEN c = 2 THEN CASE i WHEN 1 THEN 'game' ELSE 'mic' END ELSE CASE i WHEN 1 THEN 'mix' WHEN 2 THEN 'game' ELSE 'mic' END END AS role FROM n)
 SELECT file, role, min(track) AS track FROM r GROUP BY ALL UNION ALL SELECT file, 'game', min(track) FROM r GROUP BY file HAVING NOT bool_or(role = 'game') AND bool_or(role = 'mix')"""


@query("audio_roles", ROLES.replace("SELECT file, 'game', min(track) FROM r", "SELECT file, 'game', min(track) FILTER (WHERE role = 'mix') FROM r"))
def audio_roles(spark, sf_dir):
    """Roles of a file's tracks: by words in their titles, else by their place and number; the mix stands in for a missing game track."""
    title = F.element_at(F.array(F.lit("Microphone"), F.lit("Game audio"), F.lit("Discord"), F.lit(None).cast("string"), F.lit("Track"), F.lit("Mix")), (F.col("s_suppkey") % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("file"), F.col("s_suppkey").alias("track"), F.lower(F.coalesce(title, F.lit(""))).alias("title"))
    rows = rows.withColumns({"i": F.row_number().over(Window.partitionBy("file").orderBy("track")), "c": F.count("*").over(Window.partitionBy("file"))})
    role = F.lit(None).cast("string")
    by_place = F.when(F.col("c") == 1, "mix").when(F.col("c") == 2, F.when(F.col("i") == 1, "game").otherwise("mic")).otherwise(F.when(F.col("i") == 1, "mix").when(F.col("i") == 2, "game").otherwise("mic"))
    role = F.when(F.col("title").rlike("mic|voice"), "mic").when(F.col("title").rlike("game|desktop"), "game").when(F.col("title").rlike("discord|chat"), "chat").when(F.col("title").rlike("mix"), "mix").otherwise(by_place)
    found = rows.withColumn("role", role).groupBy("file", "role").agg(F.min("track").alias("track"))
    spare = found.groupBy("file").agg(F.bool_or(F.col("role") == "game").alias("game"), F.min(F.when(F.col("role") == "mix", F.col("track"))).alias("track")).where("not game and track is not null")
    return found.unionByName(spare.select("file", F.lit("game").alias("role"), "track"))


@query("first_success", "SELECT p_partkey % 200 AS job, min(p_size % 5) FILTER (WHERE p_size % 3 <> 0) AS encoder FROM part GROUP BY ALL")
def first_success(spark, sf_dir):
    """Of each job's encoders that work, the one first in the order of preference; null where none does."""
    return table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 200).alias("job")).agg(F.min(F.when(F.col("p_size") % 3 != 0, F.col("p_size") % 5)).alias("encoder"))


@query("report_comparison", EV + SIGNAL + """, o AS (SELECT cap, kind, round(avg(raw), 9) AS x FROM sig GROUP BY ALL), n AS (SELECT cap, kind, round(quantile_cont(raw, 0.5), 9) AS x FROM sig WHERE win > 5 GROUP BY ALL)
 SELECT coalesce(o.cap, n.cap) AS cap, coalesce(o.kind, n.kind) AS kind, o.x AS before, n.x AS after, round(n.x - o.x, 5) AS change FROM o FULL JOIN n ON o.cap = n.cap AND o.kind = n.kind""")  # fmt: skip
def report_comparison(spark, sf_dir):
    """Two score reports side by side, with the change; null where one of them lacks a row."""
    rows = signals(spark, sf_dir)
    old = rows.groupBy("cap", "kind").agg(F.round(F.avg("raw"), 9).alias("before"))
    new = rows.where("win > 5").groupBy("cap", "kind").agg(F.round(F.percentile("raw", 0.5), 9).alias("after"))
    return old.join(new, ["cap", "kind"], "full").withColumn("change", F.round(F.col("after") - F.col("before"), 5))


@query("death_kinds", EV + " SELECT cap, count(*) FILTER (WHERE kind IN ('death')) AS deaths, count(*) FILTER (WHERE kind IN ('death', 'assist')) AS with_downed FROM ev GROUP BY cap")
def death_kinds(spark, sf_dir):
    """Deaths alone, and with being downed where that counts (assists stand for it)."""
    kinds = {"deaths": ["death"], "with_downed": ["death", "assist"]}
    return load_events(spark, sf_dir).groupBy("cap").agg(*(F.count_if(F.col("kind").isin(*k)).alias(n) for n, k in kinds.items()))


@query("pace_and_recency", EV + GAMES + """, r AS (SELECT cap, game, duration, kills, row_number() OVER (PARTITION BY cap ORDER BY game DESC) <= 3 AS recent FROM game)
 SELECT cap, game, round(CASE WHEN recent THEN -0.5 ELSE 0 END + least(greatest((kills - 1) / 4.0, 0.0), 1.0) * 0.3 + CASE WHEN duration > 86400000000 THEN 0.2 ELSE 0 END, 6) AS bonus FROM r""")  # fmt: skip
def pace_and_recency(spark, sf_dir):
    """A penalty for the last three, a bonus for pace that grows between two bounds, and one for feel."""
    recent = F.row_number().over(Window.partitionBy("cap").orderBy(F.desc("game"))) <= 3
    bonus = F.when(recent, -0.5).otherwise(0) + F.least(F.greatest((F.col("kills") - 1) / 4.0, F.lit(0.0)), F.lit(1.0)) * 0.3 + F.when(F.col("duration") > 86_400_000_000, 0.2).otherwise(0)
    return games(spark, sf_dir).select("cap", "game", F.round(bonus, 6).alias("bonus"))


@query("calm_shots", EV + f""", c AS (SELECT cap, id, t, t - lag(t) OVER o AS before, lead(t) OVER o - t AS after FROM ev WHERE kind IN ('kill', 'death') WINDOW o AS (PARTITION BY cap ORDER BY t, id)),
 r AS (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY least(before, after) DESC, t, id) AS n FROM c WHERE before >= {24 * H} AND after >= {24 * H}) SELECT cap, id, t - {6 * H} AS s, t + {6 * H} AS e FROM r WHERE n <= 2""")  # fmt: skip
def calm_shots(spark, sf_dir):
    """The two calmest surroundings of each capture, as showcase shots."""
    o = Window.partitionBy("cap").orderBy("t", "id")
    rows = load_events(spark, sf_dir).where("kind in ('kill', 'death')").select("cap", "id", "t", (F.col("t") - F.lag("t").over(o)).alias("before"), (F.lead("t").over(o) - F.col("t")).alias("after"))
    best = Window.partitionBy("cap").orderBy(F.desc(F.least("before", "after")), "t", "id")
    return rows.where((F.col("before") >= 24 * HOUR) & (F.col("after") >= 24 * HOUR)).withColumn("n", F.row_number().over(best)).where("n <= 2").select("cap", "id", (F.col("t") - 6 * HOUR).alias("s"), (F.col("t") + 6 * HOUR).alias("e"))


@query("role_outcomes", EV + GROUPS + " SELECT cap, count(*) FILTER (WHERE ace) AS aces, count(*) FILTER (WHERE traded) AS traded, CAST(max(kills) AS BIGINT) AS best_group, count(*) FILTER (WHERE kills >= 2) AS multi FROM oc GROUP BY cap")
def role_outcomes(spark, sf_dir):
    """Aces, traded groups, the best group and the multi-kills of each capture."""
    return outcomes(spark, sf_dir).groupBy("cap").agg(F.count_if("ace").alias("aces"), F.count_if("traded").alias("traded"), F.max("kills").alias("best_group"), F.count_if(F.col("kills") >= 2).alias("multi"))
