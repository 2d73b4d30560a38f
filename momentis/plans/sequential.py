"""One-pass operators and kernels as queries: grouped maps over one capture's rows. The tests hold the functions against literal inputs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentis.functions.events import DAY, HOUR, load_events
from momentis.operators import decoders, folds, kernels, matching, sequences
from momentis.operators.keyed import per_key
from momentis.plans.moments import EV, H, SPANS, positive, signals
from momentis.plans.registry import query
from momentis.session import table


def per_capture(rows: DataFrame, fn: Callable[[pd.DataFrame], list[tuple]], columns: dict[str, str], order: list[str]) -> DataFrame:
    """Rows (cap, ...) that fn gives for each capture's ordered rows."""
    return per_key(rows, "cap", fn, columns, order)


SHOTS = EV + f""", k AS (SELECT cap, id, t, row_number() OVER (PARTITION BY cap ORDER BY t, id) AS n FROM ev WHERE kind = 'kill' AND cap IN (SELECT cap FROM ev WHERE kind = 'shot')),
 c AS (SELECT k.cap, k.id, s.t AS st, row_number() OVER (PARTITION BY k.cap, k.id ORDER BY abs(s.t - k.t), s.t) AS r FROM k JOIN ev s ON s.cap = k.cap AND s.kind = 'shot' AND s.t BETWEEN k.t - {12 * H} AND k.t + {6 * H}),
 f AS (SELECT k.*, c.st AS fatal FROM k LEFT JOIN c ON c.cap = k.cap AND c.id = k.id AND r = 1), l AS (SELECT *, lag(coalesce(fatal, t)) OVER (PARTITION BY cap ORDER BY n) AS last FROM f)
 SELECT e.cap, e.id, CASE WHEN any_value(l.fatal) IS NOT NULL THEN count(s.id) END AS shots FROM ev e LEFT JOIN l ON l.cap = e.cap AND l.id = e.id LEFT JOIN ev s ON s.cap = l.cap AND s.kind = 'shot' AND s.t <= l.fatal AND s.t > greatest(coalesce(l.last, l.fatal - {48 * H}), l.fatal - {48 * H}) WHERE e.kind = 'kill' GROUP BY e.cap, e.id"""


@query("shot_attribution", SHOTS)
def shot_attribution(spark, sf_dir):
    """Shots that each kill took: what a kill leaves behind for the next one is its own fatal shot, or its own time, so a lag carries it."""
    e = load_events(spark, sf_dir)
    kills, shots = e.where("kind = 'kill'").select("cap", "id", "t"), e.where("kind = 'shot'").select("cap", "id", "t")
    near = Window.partitionBy("cap", "lid").orderBy(F.abs(F.col("rt") - F.col("lt")), "rt")
    fatal = matching.near_events(kills, shots, 12 * HOUR, 6 * HOUR).withColumn("n", F.row_number().over(near)).where("n = 1").select("cap", F.col("lid").alias("id"), F.col("rt").alias("fatal"))
    order = Window.partitionBy("cap").orderBy("t", "id")
    rows = kills.join(fatal, ["cap", "id"], "left").withColumn("last", F.lag(F.coalesce("fatal", "t")).over(order))
    bursts = rows.where("fatal is not null").select("cap", "id", F.col("fatal").alias("t"), F.greatest(F.coalesce("last", F.col("fatal") - 48 * HOUR), F.col("fatal") - 48 * HOUR).alias("low"))
    counts = matching.near_events(bursts, shots, 48 * HOUR, 0).join(bursts.select("cap", F.col("id").alias("lid"), "low"), ["cap", "lid"]).where("rt > low").groupBy("cap", F.col("lid").alias("id")).agg(F.count("*").alias("shots"))
    known = bursts.select("cap", "id").join(counts, ["cap", "id"], "left").select("cap", "id", F.coalesce("shots", F.lit(0)).alias("shots"))
    return kills.select("cap", "id").join(known, ["cap", "id"], "left")


FUSION = EV + f""", l AS (SELECT cap, coalesce(list({{'id': id, 't': t, 'kind': kind}} ORDER BY t, id) FILTER (WHERE id % 2 = 0), []) AS icons, coalesce(list({{'id': id, 't': t, 'kind': kind}} ORDER BY t, id) FILTER (WHERE id % 2 = 1), []) AS log FROM ev WHERE kind IN ('kill', 'assist') GROUP BY cap),
 f AS (SELECT cap, log, list_reduce(list_prepend({{'used': []::BIGINT[], 'out': []::STRUCT(id BIGINT, t BIGINT, kind VARCHAR)[]}}, list_transform(icons, lambda i: {{'used': []::BIGINT[], 'out': [i]}})), lambda a, b:
  CASE WHEN len(list_filter(log, lambda x: x.t BETWEEN b.out[1].t - {6 * H} AND b.out[1].t + {12 * H} AND x.kind = b.out[1].kind AND NOT list_contains(a.used, x.id))) > 0
   THEN {{'used': list_append(a.used, list_filter(log, lambda x: x.t BETWEEN b.out[1].t - {6 * H} AND b.out[1].t + {12 * H} AND x.kind = b.out[1].kind AND NOT list_contains(a.used, x.id))[1].id), 'out': list_concat(a.out, b.out)}}
   WHEN len(list_filter(log, lambda x: x.t BETWEEN b.out[1].t - {6 * H} AND b.out[1].t + {12 * H} AND NOT list_contains(a.used, x.id))) = 0 THEN {{'used': a.used, 'out': list_concat(a.out, b.out)}} ELSE a END) AS r FROM l),
 u AS (SELECT cap, unnest(list_concat(r.out, list_filter(log, lambda x: NOT list_contains(r.used, x.id)))) AS u FROM f) SELECT cap, u.t AS t, u.kind AS kind FROM u"""


@query("event_fusion", FUSION)
def event_fusion(spark, sf_dir):
    """Icons (even ids) confirmed by log rows (odd ids)."""

    def run(g):
        rows = list(zip(g.t.tolist(), g.kind, g.id, strict=True))
        return sequences.fuse_sources([(t, k) for t, k, i in rows if i % 2 == 0], [(t, k) for t, k, i in rows if i % 2], 6.0 * HOUR, 12.0 * HOUR)

    return per_capture(load_events(spark, sf_dir).where("kind in ('kill', 'assist')").select("cap", "id", "t", "kind"), run, {"t": "long", "kind": "string"}, ["t", "id"])


MARKS = {"shot": "hit", "kill": "finish", "death": "wipe"}


OPEN = EV + f""", l AS (SELECT cap, list({{'t': t, 'kind': CASE kind WHEN 'shot' THEN 'hit' WHEN 'kill' THEN 'finish' ELSE 'wipe' END}} ORDER BY t, CASE kind WHEN 'shot' THEN 0 ELSE 1 END, id) AS x FROM ev WHERE kind IN ('kill', 'shot', 'death') GROUP BY cap),
 f AS (SELECT cap, list_reduce(list_prepend({{'w': []::BIGINT[], 'f': NULL::BIGINT, 'p': NULL::BIGINT, 'o': []::STRUCT(t BIGINT, kind VARCHAR)[]}}, list_transform(x, lambda y: {{'w': []::BIGINT[], 'f': NULL::BIGINT, 'p': NULL::BIGINT, 'o': [y]}})), lambda a, b:
  CASE WHEN b.o[1].kind = 'hit' THEN {{'w': list_append(list_filter(a.w, lambda h: b.o[1].t - h <= {48 * H}), b.o[1].t), 'f': a.f, 'p': a.p, 'o': list_concat(a.o, b.o)}}
   ELSE {{'w': CASE WHEN b.o[1].kind = 'wipe' THEN []::BIGINT[] ELSE list_filter(a.w, lambda h: b.o[1].t - h <= {48 * H})[2:] END, 'f': CASE WHEN b.o[1].kind = 'finish' THEN b.o[1].t ELSE a.f END, 'p': CASE WHEN b.o[1].kind = 'wipe' THEN b.o[1].t ELSE a.p END,
    'o': CASE WHEN len(list_filter(a.w, lambda h: b.o[1].t - h <= {48 * H})) > 0 OR coalesce(b.o[1].t - CASE b.o[1].kind WHEN 'finish' THEN a.f ELSE a.p END <= {12 * H}, false) THEN a.o ELSE list_append(a.o, {{'t': b.o[1].t, 'kind': 'hit'}}) END}} END) AS r FROM l)
 SELECT cap, u.t AS t, u.kind AS kind FROM (SELECT cap, unnest(r.o) AS u FROM f) z"""


@query("open_queue", OPEN)
def open_queue(spark, sf_dir):
    """Shots as hits, kills as the finishing blows of them, deaths as wipes."""

    def run(g):
        return sequences.open_queue([(t, MARKS[k]) for t, k in zip(g.t.tolist(), g.kind, strict=True)], 48 * HOUR, 12 * HOUR)

    return per_capture(load_events(spark, sf_dir).where("kind in ('kill', 'shot', 'death')").select("cap", "id", "t", "kind"), run, {"t": "long", "kind": "string"}, ["t", "id"])


CREDITS = EV + f""", c AS (SELECT cap, id, t, lag(t) OVER (PARTITION BY cap ORDER BY t, id) AS p FROM ev WHERE kind = 'assist'),
 n AS (SELECT c.cap, c.id, c.t, count(m.id) AS n, (SELECT max(x.t) FROM ev x WHERE x.cap = c.cap AND x.kind = 'shot' AND x.t BETWEEN c.t - {24 * H} AND c.t) AS mark FROM c LEFT JOIN ev m ON m.cap = c.cap AND m.kind = 'shot' AND m.t <= c.t AND m.t > greatest(coalesce(c.p, c.t - {48 * H}), c.t - {48 * H}) GROUP BY c.cap, c.id, c.t),
 l AS (SELECT cap, list({{'t': t, 'n': n, 'at_us': coalesce(mark, t)}} ORDER BY t, id) AS x FROM n GROUP BY cap),
 f AS (SELECT cap, list_reduce(list_transform(x, lambda y: [y]), lambda a, b: CASE WHEN b[1].n = 0 AND b[1].t - a[len(a)].t <= {24 * H} THEN a ELSE list_concat(a, b) END) AS y FROM l),
 g AS (SELECT cap, unnest(y) AS u FROM f) SELECT cap, t, kind FROM ev WHERE kind IN ('shot', 'kill') UNION ALL SELECT cap, u.at_us, 'assist' FROM g, unnest(generate_series(1, greatest(u.n, 1))) AS k(i)"""


@query("credit_marks", CREDITS)
def credit_marks(spark, sf_dir):
    """Assists as credits for the shots before them."""

    def run(g):
        return [(int(t), k) for t, k in sequences.credit_marks([(t, k, k == "assist") for t, k in zip(g.t.tolist(), g.kind, strict=True)], "shot", 24 * HOUR, 48 * HOUR)]

    return per_capture(load_events(spark, sf_dir).where("kind in ('assist', 'shot', 'kill')").select("cap", "id", "t", "kind"), run, {"t": "long", "kind": "string"}, ["t", "id"])


@query("log_tracks")
def log_tracks(spark, sf_dir):
    """Lines followed over frames of three hours: a sample's value is its place."""
    rows = load_events(spark, sf_dir).where("kind in ('shot', 'assist')").select("cap", "id", F.floor(F.col("t") / (3 * HOUR)).alias("frame"), "v", "kind")
    run = lambda g: [(int(t), k) for t, k in folds.track_log(list(zip(g.frame.tolist(), g.v.tolist(), g.kind, strict=True)), 16, 20.0, 2)]
    return per_capture(rows, run, {"frame": "long", "kind": "string"}, ["frame", "v", "id"])


PAIRS = EV + f""", l AS (SELECT cap, coalesce(list(t ORDER BY t) FILTER (WHERE kind = 'shot'), []) AS knocks, coalesce(list({{'t': t, 'n': CASE WHEN v > 75 THEN 2 ELSE 1 END}} ORDER BY t, id) FILTER (WHERE kind = 'kill'), []) AS rises FROM ev WHERE kind IN ('kill', 'shot') GROUP BY cap),
 f AS (SELECT cap, list_reduce(list_prepend({{'free': knocks, 'r': NULL, 'out': []::STRUCT(t BIGINT, how VARCHAR)[]}}, list_transform(rises, lambda x: {{'free': []::BIGINT[], 'r': x, 'out': []::STRUCT(t BIGINT, how VARCHAR)[]}})), lambda a, b: {{
  'free': list_filter(a.free, lambda x: NOT list_contains(list_slice(list_filter(a.free, lambda y: y BETWEEN b.r.t - {30 * H} AND b.r.t + {H}), 1, b.r.n), x)), 'r': b.r,
  'out': list_concat(a.out, list_transform(list_slice(list_filter(a.free, lambda y: y BETWEEN b.r.t - {30 * H} AND b.r.t + {H}), 1, b.r.n), lambda x: {{'t': x, 'how': 'paired'}}),
   list_transform(range(b.r.n - len(list_slice(list_filter(a.free, lambda y: y BETWEEN b.r.t - {30 * H} AND b.r.t + {H}), 1, b.r.n))), lambda x: {{'t': b.r.t, 'how': CASE WHEN b.r.n > 1 THEN 'wipe' ELSE 'lone' END}}))}}) AS r FROM l)
 SELECT cap, u.t AS t, u.how AS how FROM (SELECT cap, unnest(list_concat(r.out, list_transform(r.free, lambda x: {{'t': x, 'how': 'free'}}))) AS u FROM f) z"""


@query("knock_pairs", PAIRS)
def knock_pairs(spark, sf_dir):
    """Counter rises (kills, of two where the value is high) paired with the earliest free knocks (shots)."""

    def run(g):
        rises = [(t, 2 if v > 75 else 1) for t, v, k in zip(g.t.tolist(), g.v, g.kind, strict=True) if k == "kill"]
        return folds.fifo_pairs(rises, g[g.kind == "shot"].t.tolist(), 30 * HOUR, HOUR)

    return per_capture(load_events(spark, sf_dir).where("kind in ('kill', 'shot')").select("cap", "id", "t", "v", "kind"), run, {"t": "long", "how": "string"}, ["t", "id"])


@query("joint_viterbi")
def joint_viterbi(spark, sf_dir):
    """Two counters decoded together from noisy reads."""
    left = F.floor(F.col("v") / 12.5).cast("int") % 9
    right = F.when(F.col("id") % 5 == 0, -1).otherwise(F.floor(F.col("v") / 7).cast("int") % 9)
    reads = load_events(spark, sf_dir).where("kind = 'shot'").select("cap", "id", "t", left.alias("a"), right.alias("b"))
    return decoders.decode(reads, "cap", ["t", "id"], "id", ["a", "b"], decoders.Scores(8), {"id": "long", "left": "long", "right": "long"})


@query("scenes", EV + SPANS + f""", l AS (SELECT cap, list({{'s': s, 'e': e}} ORDER BY s, id) AS x FROM pos GROUP BY cap),
 f AS (SELECT cap, list_reduce(list_transform(x, lambda y: [y]), lambda a, b: CASE WHEN b[1].s >= a[len(a)].s AND b[1].s - a[len(a)].e <= {6 * H} AND greatest(b[1].e, a[len(a)].e) - a[len(a)].s <= {72 * H}
  THEN list_append(a[1:len(a) - 1], {{'s': a[len(a)].s, 'e': greatest(a[len(a)].e, b[1].e)}}) ELSE list_concat(a, b) END) AS y FROM l) SELECT cap, u.s AS s, u.e AS e FROM (SELECT cap, unnest(y) AS u FROM f) z""")
def scenes(spark, sf_dir):
    rows = positive(spark, sf_dir).select("cap", "id", "s", "e")
    return per_capture(rows, lambda g: sequences.scenes(list(zip(g.s.tolist(), g.e.tolist(), strict=True)), 6 * HOUR, 72 * HOUR), {"s": "long", "e": "long"}, ["s", "id"])


@query("segment_extension")
def segment_extension(spark, sf_dir):
    """Days extended so that they cut no protected span."""

    def run(g):
        spans = list(zip(g.s.tolist(), g.e.tolist(), strict=True))
        return [(k, *sequences.extend(k * DAY, (k + 1) * DAY, spans, 0, 0, HOUR, 12 * HOUR)) for k in range(0, 30, 5)]

    return per_capture(positive(spark, sf_dir).select("cap", "id", "s", "e"), run, {"day": "long", "s": "double", "e": "double"}, ["s", "id"])


#: A day around noon that holds what is left of the budget, six tenths of it before noon, within the day; in SQL, where a is the state before and b the day.
_AT = f"least(greatest(b.day * {DAY} + {DAY // 2} - a.rest * 0.6::DOUBLE, b.day * {DAY}), (b.day + 1) * {DAY} - a.rest)"
_CUTS = f"len(list_filter(spans, lambda w: (w.s < {_AT} AND {_AT} < w.e) OR (w.s < {_AT} + a.rest AND {_AT} + a.rest < w.e))) > 0"
BUDGET = EV + SPANS + f""", d AS (SELECT cap, s // {DAY} AS day, count(*) AS n FROM pos GROUP BY ALL), sp AS (SELECT cap, list({{'s': s, 'e': e}}) AS spans FROM pos GROUP BY cap),
 l AS (SELECT cap, list_prepend({{'day': -1::BIGINT, 'rest': {4 * DAY - 6 * H}::DOUBLE, 's': 0::DOUBLE, 'e': 0::DOUBLE, 'given': false}}, list({{'day': day, 'rest': 0::DOUBLE, 's': 0::DOUBLE, 'e': 0::DOUBLE, 'given': false}} ORDER BY n DESC, day)) AS x FROM d GROUP BY cap),
 f AS (SELECT cap, list_reduce(list_transform(x, lambda y: [y]), lambda p, q: list_append(p, list_transform([p[len(p)]], lambda a: list_transform([q[1]], lambda b:
  CASE WHEN a.rest < {6 * H} THEN {{'day': b.day, 'rest': a.rest, 's': 0::DOUBLE, 'e': 0::DOUBLE, 'given': false}}
       WHEN a.rest >= {DAY} THEN {{'day': b.day, 'rest': a.rest - {DAY}, 's': (b.day * {DAY})::DOUBLE, 'e': ((b.day + 1) * {DAY})::DOUBLE, 'given': true}}
       WHEN {_CUTS} THEN {{'day': b.day, 'rest': a.rest, 's': 0::DOUBLE, 'e': 0::DOUBLE, 'given': false}}
       ELSE {{'day': b.day, 'rest': 0::DOUBLE, 's': ({_AT})::DOUBLE, 'e': ({_AT} + a.rest)::DOUBLE, 'given': true}} END)[1])[1])) AS y FROM l JOIN sp USING (cap))
 SELECT cap, u.day AS day, CAST(trunc(u.s) AS BIGINT) AS s, CAST(trunc(u.e) AS BIGINT) AS e FROM (SELECT cap, unnest(y) AS u FROM f) z WHERE u.given"""


@query("budget_clips", BUDGET)
def budget_clips(spark, sf_dir):
    """Days of a capture by their number of events, within 96 hours: too long ones are trimmed around noon, unless that cuts a protected span."""

    def run(g):
        spans = list(zip(g.s.tolist(), g.e.tolist(), strict=True))
        counts = (g.s // DAY).value_counts()
        days = sorted(counts.index.tolist(), key=lambda d: (-counts[d], d))
        return [(int(days[k]), int(a), int(b)) for k, a, b in sequences.budget_clips([(d * DAY, (d + 1) * DAY, d * DAY + DAY // 2) for d in days], 4 * DAY - 6 * HOUR, 6 * HOUR, 0.6, spans)]

    return per_capture(positive(spark, sf_dir).select("cap", "id", "s", "e"), run, {"day": "long", "s": "long", "e": "long"}, ["s", "id"])


@query("plateau_segments")
def plateau_segments(spark, sf_dir):
    reads = load_events(spark, sf_dir).where("kind = 'assist'").select("cap", "id", "t", F.floor(F.col("v") / 34).alias("x"))
    return per_capture(reads, lambda g: kernels.plateaus([None if i % 7 == 0 else int(x) for i, x in zip(g.id, g.x, strict=True)], 3), {"place": "long", "value": "long"}, ["t", "id"])


@query("beat_tracking")
def beat_tracking(spark, sf_dir):
    """Beats over the windows of a capture's kill signal."""
    rows = signals(spark, sf_dir).where("kind = 'kill'").select("cap", "win", F.col("raw").cast("double").alias("raw"))
    return decoders.decode(rows, "cap", ["win"], "win", ["raw"], decoders.Beats(4), {"win": "long"})


@query("spectrum_peaks")
def spectrum_peaks(spark, sf_dir):
    """The strongest bin of each vector's power spectrum, by Arrow batches."""

    def peak(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            yield pd.Series([int(np.argmax(kernels.power_spectrum(np.asarray(v, float))[1:])) + 1 for v in vectors], dtype="int64")

    return table(spark, sf_dir, "embeddings").select("vec_id", F.pandas_udf(peak, "long")("embedding").alias("bin"))


@query("shape_clusters")
def shape_clusters(spark, sf_dir):
    """Online clusters of each label's vectors in order of their ids."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("cap"), "vec_id", "embedding")
    names = ["cap", "vec_id", "shape", "fresh"]

    def clustered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A label's rows follow each other; only its clusters are held from one batch to the next.
        cap, own = None, None
        for batch in batches:
            caps, ids, vectors = (batch.column(k).to_pylist() for k in range(3))
            edges = [0, *(k for k in range(1, len(caps)) if caps[k] != caps[k - 1]), len(caps)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if own is None or caps[a] != cap:
                    cap, own = caps[a], kernels.ShapeRun(0.5)
                before = own.frames
                states, changes = own.push(np.array(vectors[a:b], float))
                fresh = set(changes)
                # A shape of one frame is stable at once, so a change lies in its own batch.
                cells = [[cap] * (b - a), ids[a:b], states, [k in fresh for k in range(before, before + b - a)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cells, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names)

    return rows.repartition("cap").sortWithinPartitions("cap", "vec_id").mapInArrow(clustered, "cap long, vec_id long, shape long, fresh boolean")
