"""Every detector by its name over the events, and what else works on a capture's own observations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentis import detectors
from momentis.functions.events import DAY, HOUR, TOTAL, load_events
from momentis.operators import learners, sequences
from momentis.operators.keyed import per_key
from momentis.plans.moments import EV, SPANS, H, positive
from momentis.plans.registry import query
from momentis.plans.sessions import GROUPS, kill_groups
from momentis.session import table

GRID24 = f"generate_series(CAST(greatest(ceil((t - {24 * H}) / {12 * H}.0 - 1e-9), 0) AS BIGINT), CAST(least(floor(t / {12 * H}.0 + 1e-9), 59) AS BIGINT))"


def _detect(name: str, sql: str | None = None, only: str | None = None):
    def run(spark, sf_dir: str) -> DataFrame:
        e = load_events(spark, sf_dir)
        return detectors.DETECTORS[name](e.where(only) if only else e)

    run.__name__, run.__module__, run.__doc__ = f"detect_{name.replace('-', '_')}", __name__, detectors.DETECTORS[name].__doc__
    query(run.__name__, sql)(run)


_detect("audio-loudness", EV + f""", s AS (SELECT cap, w.win, max(greatest(v, -70)) AS raw FROM ev, unnest({GRID24}) AS w(win) WHERE kind = 'assist' AND t BETWEEN 0 AND {720 * H} GROUP BY ALL)
 SELECT cap, win, round(0.7 * (raw - quantile_cont(raw, 0.5) OVER (PARTITION BY cap ORDER BY win ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)) + (1 - 0.7) * (raw - quantile_cont(raw, 0.5) OVER (PARTITION BY cap)), 4) AS raw FROM s""", "kind = 'assist'")  # fmt: skip
_detect("voice-activity", EV + f""", q AS (SELECT cap, greatest(t, 0) AS s, least(t + {6 * H}, {720 * H}) AS e, id FROM ev WHERE kind = 'death'), m AS (SELECT *, max(e) OVER (PARTITION BY cap ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM q),
 sp AS (SELECT cap, coalesce(p, 0) AS s, s AS e FROM m WHERE s > coalesce(p, 0) UNION ALL SELECT cap, max(e), {720 * H} FROM q GROUP BY cap),
 x AS (SELECT cap, w.win, greatest(least(e, w.win * {12 * H} + {24 * H}) - greatest(s, w.win * {12 * H}), 0) AS part, least(w.win * {12 * H} + {24 * H}, {720 * H}) - w.win * {12 * H} AS n FROM sp, unnest(generate_series(0, 59)) AS w(win))
 SELECT cap, win, round(CAST(sum(part) AS DOUBLE) / max(n), 6) AS raw FROM x GROUP BY ALL HAVING round(CAST(sum(part) AS DOUBLE) / max(n), 6) > 0""", "kind = 'death'")  # fmt: skip
_detect("outplayed-events", EV + f" SELECT cap, least(greatest(t + CASE WHEN kind = 'kill' THEN {-2 * H} ELSE 0 END, 0), {720 * H}) AS t, CASE kind WHEN 'assist' THEN 'support' ELSE kind END AS kind FROM ev WHERE kind IN ('kill', 'death', 'assist')")
_detect("game-sounds", EV + """, r AS (SELECT *, max(v) OVER (PARTITION BY cap ORDER BY t, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, row_number() OVER (PARTITION BY cap ORDER BY v, id) AS r, count(*) OVER (PARTITION BY cap) AS n FROM ev WHERE kind = 'shot'),
 l AS (SELECT *, max(v) FILTER (WHERE r = floor(0.9 * (n - 1)) + 1) OVER (PARTITION BY cap) AS level FROM r) SELECT cap, t, 'shot' AS kind FROM l WHERE v >= level - 30 AND (b IS NULL OR v - b >= 5)""", "kind = 'shot'")  # fmt: skip
_detect("audio-events", EV + f""", h AS (SELECT cap, id, t, kind, v, CASE WHEN t - max(t + {4 * H}) OVER (PARTITION BY cap ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {6 * H} THEN 0 ELSE 1 END AS f FROM ev WHERE v >= 60 AND kind IN ('shot', 'assist')),
 g AS (SELECT *, sum(f) OVER (PARTITION BY cap ORDER BY t, id) AS grp FROM h) SELECT cap, min(t) AS t, list_sort(list({{'v': -v, 't': t, 'i': id, 'k': kind}}))[1].k AS kind FROM g GROUP BY cap, grp""", "kind in ('shot', 'assist')")  # fmt: skip
_detect("hud-template", EV + f""", f AS (SELECT cap, t // {12 * H} AS frame, kind, max(v) AS v FROM ev WHERE v >= 50 AND t >= 0 GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY cap, frame ORDER BY v DESC, kind) AS n FROM f),
 r AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY cap, kind ORDER BY frame) <= 2 THEN 0 ELSE 1 END AS x FROM w WHERE n = 1), g AS (SELECT *, sum(x) OVER (PARTITION BY cap, kind ORDER BY frame) AS run FROM r) SELECT cap, min(frame) * {12 * H} AS t, kind FROM g GROUP BY cap, kind, run HAVING count(*) >= 2""", "t >= 0")  # fmt: skip
_detect("killfeed-headshot", EV + f""", n AS (SELECT k.cap, k.t, s.v, row_number() OVER (PARTITION BY k.cap, k.id ORDER BY abs(s.t - k.t), s.t, s.id) AS n FROM ev k JOIN ev s ON s.cap = k.cap AND s.kind = 'headshot' AND abs(s.t - k.t) <= {24 * H} WHERE k.kind = 'kill') SELECT cap, t, 'headshot' AS kind FROM n WHERE n = 1 AND v >= 40""")
for _name in ("killfeed", "killfeed-teams", "ammo-counter", "hud-counter", "hud-change", "round-score", "ocr-log"):
    _detect(_name)


@query("own_deaths", EV + f""", c AS (SELECT a.cap, a.id AS a, p.id AS p, abs(a.t - p.t) AS d, a.t AS at_us, p.t AS pt FROM ev a JOIN ev p ON p.cap = a.cap AND p.kind = 'death' AND abs(a.t - p.t) <= {6 * H} WHERE a.kind = 'shot'),
 b AS (SELECT *, row_number() OVER (PARTITION BY cap, a ORDER BY d, pt, p) AS x, row_number() OVER (PARTITION BY cap, p ORDER BY d, at_us, a) AS y FROM c) SELECT cap, a AS id, p AS death FROM b WHERE x = 1 AND y = 1""")  # fmt: skip
def own_deaths(spark, sf_dir):
    """Allies' deaths that are the player's own: nearest to one another on both sides, within six hours."""
    from momentis.operators import matching

    e = load_events(spark, sf_dir)
    pairs = matching.near_events(e.where("kind = 'shot'"), e.where("kind = 'death'"), 6 * HOUR, 6 * HOUR).withColumn("d", F.abs(F.col("lt") - F.col("rt")))
    first = lambda key, *order: F.row_number().over(Window.partitionBy("cap", key).orderBy("d", *order))
    return pairs.withColumns({"x": first("lid", "rt", "rid"), "y": first("rid", "lt", "lid")}).where("x = 1 and y = 1").select("cap", F.col("lid").alias("id"), F.col("rid").alias("death"))


@query("revived_players", EV + f""", c AS (SELECT r.cap, r.id AS r, d.id AS d, row_number() OVER (PARTITION BY r.cap, r.id ORDER BY abs(r.t - d.t), d.t, d.id) AS n FROM ev r JOIN ev d ON d.cap = r.cap AND d.kind = 'death' AND abs(r.t - d.t) <= {12 * H} WHERE r.kind = 'headshot')
 SELECT cap, id, t FROM ev WHERE kind = 'death' AND id NOT IN (SELECT d FROM c WHERE n = 1)""")  # fmt: skip
def revived_players(spark, sf_dir):
    """Deaths without those that a revival (here a headshot event) takes back: the nearest to each."""
    from momentis.operators import matching

    e = load_events(spark, sf_dir)
    deaths = e.where("kind = 'death'").select("cap", "id", "t")
    gone = matching.nearest(e.where("kind = 'headshot'"), deaths, 12 * HOUR).select("cap", F.col("rid").alias("id")).distinct()
    return deaths.join(gone, ["cap", "id"], "left_anti")


def live_ranges(s: float, e: float, dead: list[tuple[float, float]], keepers: list[tuple[float, float]], least_gap: float, breath: float, least_shot: float) -> list[tuple[float, float]]:
    """What stays of a range when dead stretches are cut out of it: never what keepers hold, only gaps long enough, with a breath on both sides, and pieces that are too
    short glued to the neighbour they are nearest to."""

    def without(a: float, b: float, holes: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out = []
        for x, y in sorted(holes):
            if y <= a or x >= b:
                continue
            if x > a:
                out.append((a, x))
            a = max(a, y)
        return [*out, (a, b)] if a < b else out

    cuts = []
    for x, y in dead:
        for a, b in without(max(x, s), min(y, e), keepers):
            if b - a >= least_gap:
                a, b = a if a <= s else a + breath, b if b >= e else b - breath
                if b > a:
                    cuts.append((a, b))
    pieces = without(s, e, cuts)
    while len(pieces) > 1:
        k = next((k for k, (a, b) in enumerate(pieces) if b - a < least_shot), None)
        if k is None:
            break
        before = pieces[k][0] - pieces[k - 1][1] if k else np.inf
        after = pieces[k + 1][0] - pieces[k][1] if k + 1 < len(pieces) else np.inf
        j = k - 1 if before <= after else k
        pieces[j : j + 2] = [(pieces[j][0], pieces[j + 1][1])]
    return pieces if sum(b - a for a, b in pieces) >= least_shot else [(s, e)]


@query("live_ranges", EV + SPANS + f""", mk AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY cap ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM pos), mg AS (SELECT *, sum(f) OVER (PARTITION BY cap ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS grp FROM mk),
 k AS (SELECT cap, min(s) AS s, max(e) AS e FROM mg GROUP BY cap, grp), g AS (SELECT cap, coalesce(lag(e) OVER (PARTITION BY cap ORDER BY s), 0) AS s, s AS e FROM k UNION ALL SELECT cap, max(e), {720 * H} FROM k GROUP BY cap),
 c AS (SELECT cap, CASE WHEN s <= 0 THEN 0 ELSE s + {2 * H} END AS s, CASE WHEN e >= {720 * H} THEN {720 * H} ELSE e - {2 * H} END AS e FROM g WHERE e - s >= {24 * H}),
 p AS (SELECT cap, coalesce(lag(e) OVER (PARTITION BY cap ORDER BY s), 0) AS s, s AS e FROM c UNION ALL SELECT cap, max(e), {720 * H} FROM c GROUP BY cap) SELECT cap, s, e FROM p WHERE e > s""")  # fmt: skip
def live_ranges_query(spark, sf_dir):
    """A capture without the long stretches in which nothing happens, with a breath around what is kept."""

    def run(g: pd.DataFrame) -> list[tuple]:
        total = float(720 * HOUR)
        keepers = list(zip(g.s.tolist(), g.e.tolist(), strict=True))
        return [(int(a), int(b)) for a, b in live_ranges(0.0, total, [(0.0, total)], keepers, 24 * HOUR, 2 * HOUR, HOUR)]

    return per_key(positive(spark, sf_dir).select("cap", "id", "s", "e"), "cap", run, {"s": "long", "e": "long"}, ["s", "id"])


@query("pcm_levels", """WITH e AS (SELECT vec_id, embedding AS v FROM embeddings) SELECT vec_id, CAST(64 AS BIGINT) AS samples, round(sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) / 64), 6) AS level FROM e""")
def pcm_levels(spark, sf_dir):
    """Samples read from bytes in pieces that cut them anywhere: what is left of a sample waits for the next piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, count, level = [], [], []
            for key, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = np.array(v, "<f4").tobytes()
                x = np.concatenate(list(pcm_samples(data[k : k + 7] for k in range(0, len(data), 7))))
                ids.append(key), count.append(len(x)), level.append(round(float(np.sqrt(np.mean(x.astype(float) ** 2))), 6))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(count, pa.int64()), pa.array(level, pa.float64())], ["vec_id", "samples", "level"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, "vec_id long, samples long, level double")


def pcm_samples(pieces: Iterator[bytes]) -> Iterator[np.ndarray]:
    """Little-endian floating-point samples of a stream of bytes, with a carry between its pieces."""
    left = b""
    for piece in pieces:
        data = left + piece
        whole = len(data) // 4 * 4
        left = data[whole:]
        yield np.frombuffer(data[:whole], "<f4")


class RingOnsets:
    """Onsets of a signal that comes in pieces, with memory for the last `size` levels only.

    Levels are added up one by one in order of time, as a running mean in SQL adds them, so that levels which lie exactly at the bound are judged alike; unknown levels count for nothing.
    """

    def __init__(self, size: int = 16, rise: float = 1.5):
        self.ring = [0.0] * size
        self.seen, self.rise = 0, rise

    def push(self, levels: np.ndarray) -> list[int]:
        out = []
        size = len(self.ring)
        for x in levels.tolist():
            total, known = 0.0, 0
            for k in range(max(self.seen - size, 0), self.seen):
                level = self.ring[k % size]
                if level == level:
                    total += level
                    known += 1
            if self.seen >= 4 and x > self.rise * max(total / max(known, 1), 1e-9):
                out.append(self.seen)
            self.ring[self.seen % size] = x
            self.seen += 1
        return out


@query("ring_onsets", EV + """, r AS (SELECT cap, v, row_number() OVER (PARTITION BY cap ORDER BY t, id) - 1 AS i, avg(v) OVER (PARTITION BY cap ORDER BY t, id ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING) AS usual FROM ev)
 SELECT cap, i AS place FROM r WHERE i >= 4 AND v > 1.5 * greatest(usual, 1e-9)""")  # fmt: skip
def ring_onsets(spark, sf_dir):
    """Levels half above the mean of the sixteen before, found piece by piece in constant memory."""

    def run(g: pd.DataFrame) -> list[tuple]:
        own, x = RingOnsets(), g.v.to_numpy()
        return [(k,) for a in range(0, len(x), 7) for k in own.push(x[a : a + 7])]

    return per_key(load_events(spark, sf_dir).select("cap", "id", "t", "v"), "cap", run, {"place": "long"}, ["t", "id"])


@query("name_clusters", EV + """, w AS (SELECT cap, substr(props, 2, 6) || CAST(CAST(floor(v / 20) AS BIGINT) AS VARCHAR) AS word, id FROM ev WHERE kind = 'shot'), c AS (SELECT cap, word, count(*) AS n, min(id) AS first FROM w GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY cap ORDER BY n DESC, first) AS k, sum(n) OVER (PARTITION BY cap) AS total FROM c)
 SELECT cap, word, n, round(n / total, 6) AS share FROM r WHERE k = 1 AND n >= 2""")  # fmt: skip
def name_clusters(spark, sf_dir):
    """The first word that comes back most often: the player's name, with the share of lines that hold it."""
    word = F.concat(F.substring("props", 2, 6), F.floor(F.col("v") / 20).cast("string"))
    counts = load_events(spark, sf_dir).where("kind = 'shot'").groupBy("cap", word.alias("word")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    own = Window.partitionBy("cap")
    ranked = counts.withColumns({"k": F.row_number().over(own.orderBy(F.desc("n"), "first")), "total": F.sum("n").over(own)})
    return ranked.where("k = 1 and n >= 2").select("cap", "word", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("digit_readings", """WITH t AS (SELECT label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS c FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) f WHERE n = 1),
 s AS (SELECT e.vec_id, t.label AS digit, list_cosine_similarity(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), t.c) AS fit FROM embeddings e, t), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(fit, 9) DESC, digit) AS n, lead(round(fit, 9)) OVER (PARTITION BY vec_id ORDER BY round(fit, 9) DESC, digit) AS second FROM s)
 SELECT vec_id, CASE WHEN fit - second >= 0.05 THEN CAST(digit AS BIGINT) END AS digit, round(fit, 5) AS fit FROM r WHERE n = 1""")  # fmt: skip
def digit_readings(spark, sf_dir):
    """The digit whose template is most like a glyph; none where a second comes too near. A digit's template is the first vector of its label, ten at most: they travel inside the expression."""
    from momentis.functions.events import cosine

    e = table(spark, sf_dir, "embeddings")
    shapes = e.where("label BETWEEN 0 AND 9").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c")).orderBy("label").collect()
    if not shapes:
        return e.select("vec_id", F.lit(None).cast("long").alias("digit"), F.lit(None).cast("double").alias("fit"))
    away = lambda c: -F.round(cosine(F.col("embedding"), F.array(*(F.lit(float(x)) for x in c))), 9)
    ranked = e.select("vec_id", F.sort_array(F.array(*(F.struct(away(r.c).alias("away"), F.lit(r.label).cast("long").alias("digit")) for r in shapes))).alias("r"))
    best, second = F.col("r")[0], F.get("r", F.lit(1))
    return ranked.select("vec_id", F.when(second["away"] - best["away"] >= 0.05, best["digit"]).alias("digit"), F.round(-best["away"], 5).alias("fit"))


@query("layout_taste", EV + GROUPS + """, h AS (SELECT cap, grp, (e - s) / 3600000000.0 AS len, kills / 5.0 AS density, score / 100 AS accent, row_number() OVER (PARTITION BY cap ORDER BY grp) % 2 = 0 AS edited FROM gr),
 a AS (SELECT cap, count(*) FILTER (WHERE edited) AS n, avg(accent) FILTER (WHERE edited) - avg(accent) FILTER (WHERE NOT edited) AS gain, avg(density) FILTER (WHERE edited) - avg(density) FILTER (WHERE NOT edited) AS density FROM h GROUP BY cap)
 SELECT cap, n, round(CASE WHEN n >= 4 AND abs(gain) >= 0.05 THEN least(greatest(gain, -0.3), 0.3) ELSE 0 END, 6) + 0.0 AS gain, round(CASE WHEN n >= 4 THEN density ELSE 0 END, 6) + 0.0 AS density FROM a""")  # fmt: skip
def layout_taste(spark, sf_dir):
    """How edited layouts differ from others in accent and density, capped, and 0 with too few or too little."""
    edited = F.row_number().over(Window.partitionBy("cap").orderBy("grp")) % 2 == 0
    rows = kill_groups(spark, sf_dir).select("cap", (F.col("kills") / 5.0).alias("density"), (F.col("score") / 100).alias("accent"), edited.alias("edited"))
    apart = lambda x: F.avg(F.when(F.col("edited"), F.col(x))) - F.avg(F.when(~F.col("edited"), F.col(x)))
    by = rows.groupBy("cap").agg(F.count_if("edited").alias("n"), apart("accent").alias("gain"), apart("density").alias("density"))
    gain = F.when((F.col("n") >= 4) & (F.abs("gain") >= 0.05), F.least(F.greatest("gain", F.lit(-0.3)), F.lit(0.3))).otherwise(0.0)
    return by.select("cap", "n", (F.round(gain, 6) + 0.0).alias("gain"), (F.round(F.when(F.col("n") >= 4, F.col("density")).otherwise(0.0), 6) + 0.0).alias("density"))


@query("cue_candidates", EV + f""", m AS (SELECT m.cap, m.id AS mark, e.kind, count(*) AS n, min(abs(e.t - m.t)) AS nearest FROM ev m JOIN ev e ON e.cap = m.cap AND e.kind <> 'kill' AND e.t BETWEEN m.t - {24 * H} AND m.t + {6 * H} WHERE m.kind = 'kill' GROUP BY ALL)
 SELECT cap, kind, count(*) AS marks, round(avg(nearest) / {H}.0, 6) AS hours FROM m GROUP BY ALL HAVING count(*) >= 2""")  # fmt: skip
def cue_candidates(spark, sf_dir):
    """Kinds of events that come with a capture's marks, with how many marks they come with and how near: candidates for a cue."""
    from momentis.operators import matching

    e = load_events(spark, sf_dir)
    others = e.where("kind <> 'kill'")
    near = matching.near_events(e.where("kind = 'kill'"), others, 24 * HOUR, 6 * HOUR).join(others.select("cap", F.col("id").alias("rid"), "kind"), ["cap", "rid"])
    by = near.groupBy("cap", "lid", "kind").agg(F.min(F.abs(F.col("rt") - F.col("lt"))).alias("nearest"))
    return by.groupBy("cap", "kind").agg(F.count("*").alias("marks"), F.round(F.avg("nearest") / F.lit(float(HOUR)), 6).alias("hours")).where("marks >= 2")


def day_choices(spark, sf_dir: str) -> DataFrame:
    """Each day of a capture with two events or more as a choice: its events as options (value, kill, assist, lateness), and the place of the strongest."""
    e = load_events(spark, sf_dir).select("cap", "id", "t", F.floor(F.col("t") / DAY).alias("day"), "v", "kind")
    flag = lambda kind: (F.col("kind") == kind).cast("double")
    option = F.array(F.col("v") / 100, flag("kill"), flag("assist"), (F.col("t") - F.col("day") * DAY) / DAY)
    strength = F.col("v") + F.when(F.col("kind") == "kill", 10).otherwise(0)
    rows = e.groupBy("cap", "day").agg(F.sort_array(F.collect_list(F.struct("t", "id", strength.alias("s"), option.alias("x")))).alias("o")).where(F.size("o") >= 2)
    chosen = F.array_position(F.transform("o", lambda x: x["s"]), F.array_max(F.transform("o", lambda x: x["s"]))) - 1
    return rows.select("cap", "day", F.transform("o", lambda x: x["x"]).alias("options"), chosen.alias("chosen"))


RULE = [1.0, 0.0, 0.0, 0.0]


@query("choice_learner")
def choice_learner(spark, sf_dir):
    """A choice model for each capture over all its days, drawn towards the rule (the highest value), with the days that models without them find and those that the rule finds."""

    def run(g: pd.DataFrame) -> list[tuple]:
        n = len(g)
        folds = min(n, learners.FOLDS)
        rows = [(k % folds, np.stack(o), c) for k, (o, c) in enumerate(zip(g.options, g.chosen.tolist(), strict=True))]
        task = learners.Choice(np.array(RULE))
        w = learners.fitted_here(task, rows, folds)
        hits, by_rule = (sum(task.right(r, w[r[0]] if own else task.rule) for r in rows) for own in (True, False))
        return [(*np.round(w[-1], 6).tolist(), n, hits, by_rule, n >= 6 and hits > by_rule)]

    return per_key(day_choices(spark, sf_dir), "cap", run, {"value": "double", "kill": "double", "assist": "double", "late": "double", "days": "long", "hits": "long", "rule_hits": "long", "active": "boolean"}, ["day"])


@query("library_choice_learner")
def library_choice_learner(spark, sf_dir):
    """One choice model over the days of all captures: slopes and curvatures are summed in Spark, pass by pass."""
    m = learners.choice_model(day_choices(spark, sf_dir), F.struct("cap", "day"), F.col("options"), F.col("chosen"), RULE)
    rows = [(n, round(x, 6), m["rows"], m["hits"], m["rule_hits"], m["active"]) for n, x in zip(["value", "kill", "assist", "late"], m["weights"], strict=True)]
    return spark.createDataFrame(rows, "feature string, weight double, days long, hits long, rule_hits long, active boolean")


@query("library_preference")
def library_preference(spark, sf_dir):
    """Weights of four criteria (the last unknown for every fourth event) under which the chosen events of all captures' days score highest, by slopes summed in Spark."""
    e = load_events(spark, sf_dir).where("cap IS NOT NULL")
    at = F.col("t") - F.floor(F.col("t") / DAY) * DAY
    criteria = F.array(F.col("v") / 100, (F.col("kind") == "kill").cast("double"), 1 - at / DAY, F.when(F.col("id") % 4 != 0, F.col("id") % 7 / 7.0))
    strength = F.col("v") * 0.3 + F.when(F.col("kind") == "kill", 20).otherwise(0)
    days = e.groupBy("cap", F.floor(F.col("t") / DAY)).agg(F.sort_array(F.collect_list(F.struct("t", "id", criteria.alias("x"), strength.alias("s")))).alias("o"))
    best = F.array_position(F.transform("o", lambda x: x["s"]), F.array_max(F.transform("o", lambda x: x["s"]))) - 1
    m = learners.preference_model(days, F.transform("o", lambda x: x["x"]), best, [0.4, 0.2, 0.2, 0.2])
    rows = [(k, round(w, 4), m["choices"], round(m["before"], 6), round(m["after"], 6)) for k, w in zip(["value", "kill", "early", "place"], m["weights"], strict=True)]
    return spark.createDataFrame(rows, "criterion string, weight double, choices long, before double, after double")


@query("quality_gate")
def quality_gate(spark, sf_dir):
    """The logistic model of all labelled documents, used only if models without a document get four of five right."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.greatest("n_chars", F.lit(1))
    x = F.array(F.log1p("n_chars"), F.length(F.regexp_replace("text", "[^|#*$%&]", "")) / n, F.size(F.split("text", "\n")) / n, F.length(F.regexp_replace("text", "[^A-Z!]", "")) / n)
    m = learners.logistic_model(d, F.col("doc_id"), x, F.col("quality"))
    rows = [(k, round(v, 6), m["rows"], m["accuracy"], m["active"]) for k, v in zip(["length", "symbols", "lines", "shouting", "bias"], [*m["weights"], m["bias"]], strict=False)]
    return spark.createDataFrame(rows, "feature string, weight double, documents long, accuracy double, active boolean")


@query("preference_learner")
def preference_learner(spark, sf_dir):
    """Weights of three criteria (one unknown for every fourth event) under which each day's chosen event scores highest, for each capture, and how often they and the first ones agree with it."""

    def run(g: pd.DataFrame) -> list[tuple]:
        base = np.array([0.5, 0.3, 0.2])
        choices = []
        # Rows are in order of time, so a day's lie together.
        g = g[g.day.notna()]
        v, place, day = g.v.to_numpy(), g.id.to_numpy(), g.day.to_numpy()
        criteria = np.column_stack([v / 100, (place % 10) / 10.0, np.where(place % 4 == 0, np.nan, (place % 7) / 7.0)])
        strength = v * 0.3 + (place % 10) * 7
        edges = [0, *(np.flatnonzero(day[1:] != day[:-1]) + 1).tolist(), len(day)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b - a > 1:
                choices.append((criteria[a:b], int(np.argmax(strength[a:b]))))
        if len(choices) < 3:
            return []
        w = sequences.preference_weights(choices, base, 60, 0.05, 6.0, 0.001)
        return [(*np.round(w, 6).tolist(), round(sequences.agreement(choices, base), 6), round(sequences.agreement(choices, w), 6))]

    rows = load_events(spark, sf_dir).select("cap", "id", "t", F.floor(F.col("t") / (24 * HOUR)).alias("day"), "v")
    return per_key(rows, "cap", run, {"level": "double", "place": "double", "kind": "double", "before": "double", "after": "double"}, ["t", "id"])


@query("rule_classes", """WITH n AS (SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN n_name ELSE replace(replace(left(n_name, 3) || 'X' || substr(n_name, 5 - n_nationkey % 2), 'O', '0'), 'I', '1') END AS text FROM nation),
 l AS (SELECT *, regexp_replace(translate(upper(text), '01|!5$8', 'OIIISSB'), '[^A-Z]', '', 'g') AS x FROM n), r(pos, kind, needle) AS (VALUES (1, 'south', 'NATIONOO'), (2, '', 'NATIONII'), (3, 'east', 'NATIONB'), (4, 'west', 'NATION'), (5, 'far', 'NATXIONS')),
 m AS (SELECT n_nationkey, kind, row_number() OVER (PARTITION BY n_nationkey ORDER BY pos) AS k FROM l JOIN r ON length(x) >= 5 AND levenshtein(x, needle) <= greatest(1, length(needle) // 5))
 SELECT l.n_nationkey, x AS letters, kind, kind = '' AS ignored FROM l LEFT JOIN m ON m.n_nationkey = l.n_nationkey AND k = 1""")  # fmt: skip
def rule_classes(spark, sf_dir):
    """Misread names by the first rule within a fifth of its length in edits: a rule without a kind says to ignore, no rule gives null, and so do texts under five letters."""
    from momentis.functions.events import letters

    rules = [(1, "south", "NATIONOO"), (2, "", "NATIONII"), (3, "east", "NATIONB"), (4, "west", "NATION"), (5, "far", "NATXIONS")]
    odd = F.replace(F.replace(F.concat(F.substring("n_name", 1, 3), F.lit("X"), F.expr("substring(n_name, cast(5 - n_nationkey % 2 as int))")), F.lit("O"), F.lit("0")), F.lit("I"), F.lit("1"))
    rows = table(spark, sf_dir, "nation").select("n_nationkey", letters(F.when(F.col("n_nationkey") % 4 == 0, F.col("n_name")).otherwise(odd)).alias("letters"))
    near = [F.when((F.length("letters") >= 5) & (F.levenshtein(F.col("letters"), F.lit(needle)) <= max(1, len(needle) // 5)), kind) for _, kind, needle in sorted(rules)]
    return rows.select("n_nationkey", "letters", F.coalesce(*near).alias("kind")).withColumn("ignored", F.col("kind") == "")


#: Settings of montages, and what each preset changes in them.
SETTINGS = {"shots": 20, "slow": 0.3, "least_kills": 1, "order": "build-up", "event": "kill"}
PRESETS = {"fast": {"slow": 0.0, "shots": 40}, "one-taps": {"least_kills": 1, "order": "time"}, "fails": {"event": "death", "slow": 0.5}, "reactions": {"event": "reaction", "shots": 12, "order": "time"}}


@query("derived_presets", "SELECT * FROM (VALUES ('fails', 20, 0.5::DOUBLE, 1, 'build-up', 'death'), ('fast', 40, 0.0::DOUBLE, 1, 'build-up', 'kill'), ('one-taps', 20, 0.3::DOUBLE, 1, 'time', 'kill'), ('reactions', 12, 0.3::DOUBLE, 1, 'time', 'reaction')) AS p(preset, shots, slow, least_kills, ord, event)")
def derived_presets(spark, sf_dir):
    """The settings of every preset: those it doesn't change are the common ones."""
    rows = [(name, *(SETTINGS | own).values()) for name, own in sorted(PRESETS.items())]
    return spark.createDataFrame(rows, "preset string, shots int, slow double, least_kills int, ord string, event string")


def glyph_frames(spark, sf_dir: str) -> DataFrame:
    """Pictures of each capture's kill counter (its last digit, from 0 again at mid-capture): eight samples after every event, one in five of them damaged. A digit's picture is the first vector of that label, lit where positive."""
    from momentis.operators import digits

    e = load_events(spark, sf_dir)
    # An event becomes eight pictures, so the events' own size doesn't say how many tasks they take.
    e = e.where("cap IS NOT NULL").repartition(digits.parts(8 * e.count(), 64), "cap")
    half = (F.col("t") >= TOTAL // 2).cast("int")
    order = Window.partitionBy("cap").orderBy("t", "id")
    kills = F.count_if(F.col("kind") == "kill").over(Window.partitionBy("cap", "half").orderBy("t", "id"))
    rows = e.withColumn("half", half).select("cap", "id", (kills % 10).cast("int").alias("truth"), F.row_number().over(order).alias("k"))
    shapes = table(spark, sf_dir, "embeddings").where("label BETWEEN 0 AND 9 AND size(embedding) = 64").groupBy(F.col("label").alias("truth")).agg(F.min_by("embedding", "vec_id").alias("shape"))
    samples = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("s")).join(F.broadcast(shapes), "truth")
    at = (F.col("k") - 1) * 8 + F.col("s")
    hurt = F.pmod(F.hash("id", "s"), F.lit(5)) == 0
    # A damaged sample loses a run of fourteen pixels that begins anywhere.
    first = F.pmod(F.hash("s", "id"), F.lit(64))
    pixels = F.transform("shape", lambda x, i: F.when(hurt & (F.pmod(i - first, F.lit(64)) < 14), 0.0).when(x > 0, 1.0).otherwise(0.0))
    return samples.select(F.col("cap").alias("key"), at.cast("long").alias("at"), pixels.alias("pixels"), "truth")


@query("learned_digits")
def learned_digits(spark, sf_dir):
    """The digits that each capture's own counter teaches: frames read as each digit after decoding, how many of them show it, and the frames that its template is cut from.

    A capture of a few kills fits several labellings; likeness to drawn digits, here the mean vector of each label, decides between them."""
    from momentis.operators import digits

    # Ten rows, as there are ten digits.
    means = table(spark, sf_dir, "embeddings").where("label BETWEEN 0 AND 9 AND size(embedding) = 64").groupBy("label").agg(*(F.avg(F.col("embedding")[i]) for i in range(64))).collect()
    drawn = np.zeros((10, 64))
    for label, *mean in means:
        drawn[label] = mean
    frames = glyph_frames(spark, sf_dir)
    templates, readings = digits.learn(frames, 64, 0.5, drawn)
    both = readings.join(digits.shuffled(frames.select("key", "at", "truth")), ["key", "at"]).groupBy("key", "digit").agg(F.count("*").alias("frames"), F.count_if(F.col("digit") == F.col("truth")).alias("right"), F.count_if(F.col("read") < 0).alias("unread"))
    cut = templates.select("key", "digit", F.col("n").cast("long").alias("cut"))
    return both.join(digits.shuffled(cut), ["key", "digit"], "left").select(F.col("key").alias("cap"), F.col("digit").cast("long").alias("digit"), "frames", "right", "unread", F.coalesce("cut", F.lit(0)).alias("cut"))
