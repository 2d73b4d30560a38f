"""Sections by novelty: how unlike the windows before a place are to those after it, by a checkerboard over their self-similarity.

The checkerboard sums similarities of unit vectors over its quadrants, and a sum of u_i · u_j over two sets is the product of the two sets' sums. So each
quadrant follows from sliding sums of the vectors, in one pass whatever the kernel's width, and no matrix of pairs is made; the SQL beside it adds up the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from momentis.operators import folds
from momentis.operators.keyed import per_key
from momentis.plans.moments import EV, SIGNAL, signals
from momentis.plans.registry import query

KINDS = ("kill", "death", "headshot", "shot", "assist")
#: Windows of the kernel on each side, the least step of level that counts in full, and the least novelty of a boundary.
HALF = 4
STEP = 60.0
FLOOR = 0.25


def checkerboard(rows: DataFrame, key: str, at: str, vector: list[Column], level: Column, half: int = HALF, step: float = STEP) -> DataFrame:
    """(key, at, novelty) of the places with `half` rows on both sides: likeness within both sides less that across (0 at least), and how much the level steps.

    Vectors are centred on the key's mean and compared by cosine.
    """
    every, order = Window.partitionBy(key), Window.partitionBy(key).orderBy(at)
    dims = [f"x{k}" for k in range(len(vector))]
    own = rows.select(key, at, *(x.alias(n) for x, n in zip(vector, dims, strict=True)), level.alias("level"))
    own = own.withColumns({n: F.col(n) - F.avg(n).over(every) for n in dims} | {"k": F.row_number().over(order) - 1, "n": F.count("*").over(every)})
    norm = F.sqrt(sum(F.col(n) * F.col(n) for n in dims))
    own = own.withColumn("norm", norm).withColumns({n: F.when(F.col("norm") > 1e-9, F.col(n) / F.col("norm")).otherwise(0.0) for n in dims})
    past, next_ = order.rowsBetween(-half, -1), order.rowsBetween(0, half - 1)
    own = own.withColumns({f"p{n}": F.sum(n).over(past) for n in [*dims, "level"]} | {f"f{n}": F.sum(n).over(next_) for n in [*dims, "level"]})
    product = lambda a, b: sum(F.col(f"{a}{n}") * F.col(f"{b}{n}") for n in dims)
    timbre = F.greatest((product("p", "p") + product("f", "f")) / (2.0 * half * half) - product("p", "f") / float(half * half), F.lit(0.0))
    jump = F.least(F.abs(F.col("flevel") - F.col("plevel")) / (half * step), F.lit(1.0))
    return own.where((F.col("n") > 2 * half) & F.col("k").between(half, F.col("n") - half)).select(key, at, F.round(timbre + jump, 6).alias("novelty"))


VECTORS = SIGNAL + f""", v AS (SELECT cap, win, [{", ".join(f"coalesce(max(raw) FILTER (WHERE kind = '{k}'), 0)" for k in KINDS)}] AS x, max(raw) AS level FROM sig GROUP BY cap, win),
 mv AS (SELECT cap, [{", ".join(f"avg(x[{k}])" for k in range(1, 6))}] AS m FROM v GROUP BY cap),
 cv AS (SELECT v.cap, win, level, row_number() OVER (PARTITION BY v.cap ORDER BY win) - 1 AS k, count(*) OVER (PARTITION BY v.cap) AS n, [x[i] - m[i] FOR i IN range(1, 6)] AS c FROM v JOIN mv ON v.cap = mv.cap),
 uv AS (SELECT cap, win, level, k, n, CASE WHEN sqrt(list_inner_product(c, c)) > 1e-9 THEN [y / sqrt(list_inner_product(c, c)) FOR y IN c] ELSE [0.0::DOUBLE FOR y IN c] END AS u FROM cv),
 sm AS (SELECT a.cap, a.k AS i, b.k AS j, list_inner_product(a.u, b.u) AS s FROM uv a JOIN uv b ON a.cap = b.cap AND abs(a.k - b.k) < {2 * HALF}),
 tb AS (SELECT uv.cap, uv.k, any_value(win) AS win, greatest((coalesce(sum(s) FILTER (WHERE (i < uv.k) = (j < uv.k)), 0)) / {2.0 * HALF * HALF} - coalesce(sum(s) FILTER (WHERE i < uv.k AND j >= uv.k), 0) / {float(HALF * HALF)}, 0.0) AS timbre
  FROM uv JOIN sm ON sm.cap = uv.cap AND i BETWEEN uv.k - {HALF} AND uv.k + {HALF - 1} AND j BETWEEN uv.k - {HALF} AND uv.k + {HALF - 1} WHERE n > {2 * HALF} AND uv.k BETWEEN {HALF} AND n - {HALF} GROUP BY uv.cap, uv.k),
 lv AS (SELECT tb.cap, tb.k, least(abs(sum(CASE WHEN uv.k >= tb.k THEN level ELSE -level END)) / {HALF * STEP}, 1.0) AS jump FROM tb JOIN uv ON uv.cap = tb.cap AND uv.k BETWEEN tb.k - {HALF} AND tb.k + {HALF - 1} GROUP BY tb.cap, tb.k),
 nv AS (SELECT tb.cap, win, round(timbre + jump, 6) AS novelty FROM tb JOIN lv ON tb.cap = lv.cap AND tb.k = lv.k)"""


def novelty_of(spark, sf_dir: str) -> DataFrame:
    s = signals(spark, sf_dir)
    rows = s.groupBy("cap", "win").agg(*(F.coalesce(F.max(F.when(F.col("kind") == k, F.col("raw"))), F.lit(0.0)).alias(k) for k in KINDS), F.max("raw").alias("level"))
    return checkerboard(rows, "cap", "win", [F.col(k) for k in KINDS], F.col("level"))


@query("self_novelty", EV + VECTORS + " SELECT cap, win, novelty FROM nv")
def self_novelty(spark, sf_dir):
    """How much each window of a capture begins something new: the signals' self-similarity under a checkerboard, and the step of the level."""
    return novelty_of(spark, sf_dir)


@query("section_boundaries", EV + VECTORS + f""", th AS (SELECT cap, round(greatest({FLOOR}, avg(novelty) + 0.5 * stddev_pop(novelty)), 6) AS least FROM nv GROUP BY cap),
 pk AS (SELECT nv.cap, nv.win, novelty FROM nv JOIN th ON th.cap = nv.cap WHERE novelty >= least AND NOT EXISTS (SELECT 1 FROM nv o WHERE o.cap = nv.cap AND abs(o.win - nv.win) < {HALF} AND o.novelty > nv.novelty)),
 pl AS (SELECT cap, list({{'win': win}} ORDER BY novelty DESC, win) AS p FROM pk GROUP BY cap),
 pf AS (SELECT cap, list_reduce(list_transform(p, lambda y: [y]), lambda a, b: CASE WHEN list_bool_and(list_transform(a, lambda w: abs(w.win - b[1].win) >= {HALF})) THEN list_concat(a, b) ELSE a END) AS y FROM pl)
 SELECT cap, u.win AS win FROM (SELECT cap, unnest(y) AS u FROM pf) z""")  # fmt: skip
def section_boundaries(spark, sf_dir):
    """Where sections begin: peaks of novelty over a bound of the capture's own, the strongest first, none within four windows of another."""
    every, near = Window.partitionBy("cap"), Window.partitionBy("cap").orderBy("win").rangeBetween(1 - HALF, HALF - 1)
    least = F.round(F.greatest(F.lit(FLOOR), F.avg("novelty").over(every) + 0.5 * F.stddev_pop("novelty").over(every)), 6)
    peaks = novelty_of(spark, sf_dir).withColumns({"least": least, "top": F.max("novelty").over(near)}).where("novelty >= least and novelty >= top").select("cap", "win", "novelty")
    run = lambda g: [(int(w),) for w in g.win[folds.spaced(g.win.to_numpy(float), g.novelty.to_numpy(), float(HALF))]]
    return per_key(peaks, "cap", run, {"win": "long"}, ["win"])
