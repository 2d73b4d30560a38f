"""Top-k, budgets, spacing, de-duplication and decoders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from momentis.functions.events import HOUR, load_events
from momentis.operators import decoders, folds
from momentis.operators.keyed import per_key
from momentis.plans.moments import EV, H, ISLANDS, moments
from momentis.plans.registry import query
from momentis.plans.sessions import GAMES, GROUPS, games, outcomes
from momentis.session import table


@query("top_moments", EV + GROUPS + " SELECT cap, grp, kills, score FROM oc ORDER BY score + 0.25 * (kills - 1) DESC, cap, s LIMIT 20")
def top_moments(spark, sf_dir):
    """The 20 best groups: score and a quarter for each further event."""
    rank = F.col("score") + 0.25 * (F.col("kills") - 1)
    return outcomes(spark, sf_dir).orderBy(rank.desc(), "cap", "s").limit(20).select("cap", "grp", "kills", "score")


@query("moments_across", EV + ISLANDS + """, top AS (SELECT *, row_number() OVER (ORDER BY score DESC, cap, first_win) AS n FROM moments), k AS (SELECT * FROM top WHERE n <= 50)
 SELECT cap, printf('h%03d', row_number() OVER (PARTITION BY cap ORDER BY first_win)) AS id, score FROM k""")  # fmt: skip
def moments_across(spark, sf_dir):
    """The best 50 moments of all captures, numbered anew within each."""
    best = moments(spark, sf_dir).orderBy(F.desc("score"), "cap", "first_win").limit(50)
    n = F.row_number().over(Window.partitionBy("cap").orderBy("first_win"))
    return best.select("cap", F.format_string("h%03d", n).alias("id"), "score")


@query("top_per_capture", EV + GROUPS + " SELECT cap, grp, kills FROM (SELECT *, rank() OVER (PARTITION BY cap ORDER BY kills DESC) AS r FROM oc) WHERE r <= 3")
def top_per_capture(spark, sf_dir):
    """At least three by rank, with ties."""
    r = F.rank().over(Window.partitionBy("cap").orderBy(F.desc("kills")))
    return outcomes(spark, sf_dir).withColumn("r", r).where("r <= 3").select("cap", "grp", "kills")


@query("share_selection", EV + GROUPS + " SELECT cap, grp FROM (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY score DESC, grp) AS n, count(*) OVER (PARTITION BY cap) AS c FROM oc) WHERE n <= ceil(0.2 * c)")
def share_selection(spark, sf_dir):
    """The best fifth of each capture, at least one."""
    n = F.row_number().over(Window.partitionBy("cap").orderBy(F.desc("score"), "grp"))
    c = F.count("*").over(Window.partitionBy("cap"))
    return outcomes(spark, sf_dir).withColumns({"n": n, "c": c}).where("n <= ceil(0.2 * c)").select("cap", "grp")


@query("max_normalise", EV + GROUPS + " SELECT cap, grp, round(score / nullif(max(score) OVER (), 0), 6) AS share FROM gr")
def max_normalise(spark, sf_dir):
    """Scores as a share of the best of all: the maximum is aggregated first and joined as one row."""
    groups = outcomes(spark, sf_dir).select("cap", "grp", "score")
    # A group's score is its best kill's, so the best of all needs no groups.
    top = load_events(spark, sf_dir).where("kind = 'kill'").agg(F.max("v").alias("top"))
    return groups.crossJoin(F.broadcast(top)).select("cap", "grp", F.round(F.col("score") / F.nullif("top", F.lit(0.0)), 6).alias("share"))


@query("cumulative_offsets", EV + GROUPS + " SELECT cap, grp, CAST(coalesce(sum(e - s + 1) OVER (PARTITION BY cap ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at FROM gr")
def cumulative_offsets(spark, sf_dir):
    before = Window.partitionBy("cap").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    return outcomes(spark, sf_dir).select("cap", "grp", F.coalesce(F.sum(F.col("e") - F.col("s") + 1).over(before), F.lit(0)).alias("start_at"))


@query("budget_moments", EV + GROUPS + f""", l AS (SELECT cap, list_prepend({{'grp': -1::BIGINT, 'len': 0::BIGINT, 'given': 0::BIGINT, 'rest': {48 * H}::BIGINT}}, list({{'grp': grp, 'len': e - s + {H}, 'given': 0::BIGINT, 'rest': 0::BIGINT}} ORDER BY score DESC, grp)) AS x FROM oc GROUP BY cap),
 f AS (SELECT cap, list_reduce(list_transform(x, lambda y: [y]), lambda a, b: list_concat(a, [{{'grp': b[1].grp, 'len': b[1].len, 'given': CASE WHEN a[len(a)].rest < {H} THEN 0 ELSE least(b[1].len, a[len(a)].rest) END, 'rest': CASE WHEN a[len(a)].rest < {H} THEN 0 ELSE a[len(a)].rest - least(b[1].len, a[len(a)].rest) END}}])) AS y FROM l)
 SELECT cap, u.grp AS grp, u.given AS given FROM (SELECT cap, unnest(y) AS u FROM f) z WHERE u.given > 0""")
def budget_moments(spark, sf_dir):
    """Each capture's groups by rank within 48 hours, the last trimmed; checked against the reference loop in the tests."""
    rows = outcomes(spark, sf_dir).select("cap", "grp", (F.col("e") - F.col("s") + HOUR).alias("length"), "score")

    def run(g: pd.DataFrame) -> list[tuple]:
        given = folds.budgeted(g.length.to_numpy(float), g.score.to_numpy(), 48.0 * HOUR, 1.0 * HOUR).astype("int64")
        return [(k, n) for k, n in zip(g.grp.tolist(), given.tolist(), strict=True) if n > 0]

    return per_key(rows, "cap", run, {"grp": "long", "given": "long"}, ["grp"])


@query("nms_spacing", EV + f""", l AS (SELECT cap, list({{'id': id, 't': t, 'v': v}} ORDER BY v DESC, t, id) AS x FROM ev WHERE kind = 'shot' GROUP BY cap),
 f AS (SELECT cap, list_reduce(list_transform(x, lambda y: [y]), lambda a, b: CASE WHEN list_bool_and(list_transform(a, lambda k: abs(k.t - b[1].t) >= {24 * H})) THEN list_concat(a, b) ELSE a END) AS y FROM l) SELECT cap, u.id AS id, u.t AS t, u.v AS v FROM (SELECT cap, unnest(y) AS u FROM f) z""")
def nms_spacing(spark, sf_dir):
    """Shots of a capture at least 24 hours apart, strongest first."""
    shots = load_events(spark, sf_dir).where("kind = 'shot'").select("cap", "id", "t", "v")
    run = lambda g: list(g[folds.spaced(g.t.to_numpy(float), g.v.to_numpy(), 24.0 * HOUR)][["id", "t", "v"]].itertuples(index=False, name=None))
    return per_key(shots, "cap", run, {"id": "long", "t": "long", "v": "double"}, ["t", "id"])


@query("distinct_games", EV + GAMES + f""", l AS (SELECT s // {24 * H} AS evening, list({{'cap': cap, 'game': game, 's': s, 'd': duration, 'kills': kills}} ORDER BY kills DESC, cap, game) AS x FROM game GROUP BY 1),
 f AS (SELECT evening, list_reduce(list_transform(x, lambda y: [y]), lambda a, b: CASE WHEN list_bool_or(list_transform(a, lambda k: k.cap % 3 = b[1].cap % 3 AND ((k.d > 0 AND k.d = b[1].d) OR (k.cap % 10 > 1 AND b[1].cap % 10 > 1 AND least(k.s + k.d, b[1].s + b[1].d) - greatest(k.s, b[1].s) > least(k.d, b[1].d) / 2)))) THEN a ELSE list_concat(a, b) END) AS y FROM l)
 SELECT evening, u.cap AS cap, u.game AS game, u.s AS s, u.d AS duration, u.kills AS kills FROM (SELECT evening, unnest(y) AS u FROM f) z""")
def distinct_games(spark, sf_dir):
    """Games of all captures of an evening that aren't the same game; richest kept. A capture's last digit names its game and tells whether its time is reliable."""
    name = F.col("cap") % 3
    rows = games(spark, sf_dir).withColumn("evening", F.floor(F.col("s") / (24 * HOUR))).withColumn("own", F.col("evening") * 3 + name)
    rows = rows.select("own", "evening", "cap", "game", "s", "duration", "kills")

    def run(g: pd.DataFrame) -> list[tuple]:
        keep = folds.distinct_games(g.s.to_numpy(float), g.duration.to_numpy(float), g.kills.to_numpy(), file=g.cap.to_numpy() * 1000 + g.game.to_numpy(), size=g.duration.to_numpy(), reliable=g.cap.to_numpy() % 10 > 1)
        return list(g[keep][["evening", "cap", "game", "s", "duration", "kills"]].itertuples(index=False, name=None))

    # Only games of one name can be the same game, so each name of an evening is a key of its own.
    return per_key(rows, "own", run, dict.fromkeys(["evening", "cap", "game", "s", "duration", "kills"], "long"), ["cap", "game"]).drop("own")


@query("counter_viterbi")
def counter_viterbi(spark, sf_dir):
    """Rises of a counter read from noisy values (here the tenth of each sample, one in seven unreadable)."""
    reads = load_events(spark, sf_dir).select("cap", "id", "t", F.when(F.col("id") % 7 == 0, -1).otherwise(F.floor(F.col("v") / 10) % 10).cast("int").alias("read"))
    return decoders.decode(reads, "cap", ["t", "id"], "id", ["read"], decoders.Counter(10), {"id": "long", "state": "long", "rise": "long"})


@query("own_deaths_in_order")
def own_deaths_in_order(spark, sf_dir):
    """Allies' deaths (shots) that are the player's own: each takes the nearest death within two hours that is still free, in order of time."""

    def run(g: pd.DataFrame) -> list[tuple]:
        shots, deaths = g[g.kind == "shot"], g[g.kind == "death"].t.tolist()
        return [(i, t) for i, t in zip(shots.id.tolist(), folds.own_among(shots.t.tolist(), deaths, 2 * HOUR), strict=True) if t is not None]

    return per_key(load_events(spark, sf_dir).where("kind in ('shot', 'death')").select("cap", "id", "t", "kind"), "cap", run, {"id": "long", "own": "long"}, ["t", "id"])


@query("clutch_fsm")
def clutch_fsm(spark, sf_dir):
    """Last stands by a state machine over deaths (shots stand for allies, kills for enemies, deaths for the player's, headshots for round starts)."""

    def run(g: pd.DataFrame) -> list[tuple]:
        at = {k: g[g.kind == k].t.tolist() for k in ("shot", "kill", "death", "headshot")}
        return folds.clutches(at["shot"], at["kill"], at["death"], 48 * HOUR, 3, 2, at["headshot"], 2 * HOUR)

    rows = load_events(spark, sf_dir).where("kind in ('kill', 'death', 'shot', 'headshot')").select("cap", "id", "t", "kind")
    return per_key(rows, "cap", run, {"alone": "long", "enemies": "long", "won": "long"}, ["t", "id"])


@query("diverse_topk", """WITH l AS (SELECT label, list({'id': vec_id, 'v': list_transform(embedding, lambda x: CAST(x AS DOUBLE))} ORDER BY vec_id) AS x FROM embeddings GROUP BY label),
 f AS (SELECT label, list_reduce(list_transform(x, lambda y: [y]), lambda a, b: CASE WHEN len(a) < 5 AND list_bool_and(list_transform(a, lambda k: list_distance(k.v, b[1].v) >= 0.25)) THEN list_concat(a, b) ELSE a END) AS y FROM l) SELECT label, u.id AS vec_id FROM (SELECT label, unnest(y) AS u FROM f) z""")
def diverse_topk(spark, sf_dir):
    """Up to five vectors of each label that lie apart, by id."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", "embedding")
    run = lambda g: [(int(g.vec_id.iloc[k]),) for k in folds.diverse(np.array(g.embedding.tolist(), float), np.arange(len(g)), 0.25, 5)]
    return per_key(rows, "label", run, {"vec_id": "long"}, ["vec_id"])


@query("lru_eviction", EV + f""", f AS (SELECT id, cap, t, CAST(floor(v * 1000) AS BIGINT) AS bytes FROM ev WHERE kind = 'assist'), r AS (SELECT *, sum(bytes) OVER (PARTITION BY cap ORDER BY t DESC, id ROWS UNBOUNDED PRECEDING) AS used FROM f)
 SELECT cap, id FROM r WHERE used > 200000""")  # fmt: skip
def lru_eviction(spark, sf_dir):
    """What falls out of each capture's cache when the most recently used stay within the limit."""
    used = F.sum("bytes").over(Window.partitionBy("cap").orderBy(F.desc("t"), "id").rowsBetween(Window.unboundedPreceding, 0))
    files = load_events(spark, sf_dir).where("kind = 'assist'").withColumn("bytes", F.floor(F.col("v") * 1000))
    return files.withColumn("used", used).where("used > 200000").select("cap", "id")
