"""The detectors by name: what each makes of its observations, as functions of DataFrames.

A detector takes observations (cap, id, t, kind, v; what a frame reader, a model or a log has seen) and gives events (cap, t, kind) or signals (cap, win, raw). Decoding media isn't part of them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentis.functions.events import HOUR
from momentis.operators import decoders, folds, grid, intervals, kernels, matching, sequences
from momentis.operators.keyed import per_key

DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def detector(name: str) -> Callable:
    """Register a detector; a name can be taken once."""

    def put(fn: Callable) -> Callable:
        if name in DETECTORS:
            raise ValueError(f"two detectors are called {name}")
        DETECTORS[name] = fn
        return fn

    return put


@detector("audio-loudness")
def audio_loudness(levels: DataFrame, floor: float = -70.0) -> DataFrame:
    """Signals: the greatest level of each window over a floor, and its contrast with the windows around it and all of the capture."""
    level = F.when(F.col("v").isNull() | F.isnan("v"), floor).otherwise(F.greatest("v", F.lit(floor)))
    rows = grid.expand(levels.withColumn("level", level)).groupBy("cap", "win").agg(F.max("level").alias("raw"))
    return grid.local_contrast(rows, ["cap"], "win", "raw").select("cap", "win", F.round("contrast", 4).alias("raw"))


@detector("voice-activity")
def voice_activity(silences: DataFrame, length: int = 6 * HOUR) -> DataFrame:
    """Signals: the share of each window that lies in no silence; an observation begins a silence of a given length."""
    quiet = silences.select("cap", F.greatest("t", F.lit(0)).alias("s"), F.least(F.col("t") + length, F.lit(grid.TOTAL)).alias("e"))
    whole = silences.select("cap").distinct().select("cap", F.lit(0).cast("long").alias("s"), F.lit(grid.TOTAL).cast("long").alias("e"))
    speech = intervals.subtract(whole, quiet, "cap")
    low, high = F.greatest(F.floor((F.col("s") - grid.SIZE) / grid.HOP) + 1, F.lit(0)), F.least(F.ceil(F.col("e") / grid.HOP) - 1, F.lit(grid.COUNT - 1))
    cells = speech.where("s < e").select("cap", "s", "e", F.explode(F.sequence(low, high)).alias("win"))
    part = F.least("e", F.col("win") * grid.HOP + grid.SIZE) - F.greatest("s", F.col("win") * grid.HOP)
    length_of = F.least(F.col("win") * grid.HOP + grid.SIZE, F.lit(grid.TOTAL)) - F.col("win") * grid.HOP
    return cells.groupBy("cap", "win").agg(F.round(F.sum(F.greatest(part, F.lit(0))) / F.max(length_of), 6).alias("raw")).where("raw > 0")


@detector("outplayed-events")
def library_events(events: DataFrame, names: dict[str, str] | None = None, offset: int = -2 * HOUR) -> DataFrame:
    """Events of a library entry under the engine's names; kinds without one go, times are moved and kept within the capture."""
    names = {"kill": "kill", "death": "death", "assist": "support"} if names is None else names
    kind = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[F.col("kind")]
    rows = events.select("cap", F.least(F.greatest(F.col("t") + F.when(F.col("kind") == "kill", offset).otherwise(0), F.lit(0)), F.lit(grid.TOTAL)).alias("t"), kind.alias("kind"))
    return rows.where("kind is not null")


@detector("game-sounds")
def game_sounds(onsets: DataFrame, rise: float = 5.0, under: float = 30.0) -> DataFrame:
    """Shots among onsets: those that rise over the three before, and near the capture's loud ones (the floor-rank 90th percentile)."""
    own = Window.partitionBy("cap")
    before = F.max("v").over(own.orderBy("t", "id").rowsBetween(-3, -1))
    ranked = onsets.withColumns({"before": before, "r": F.row_number().over(own.orderBy("v", "id")), "n": F.count("*").over(own)})
    level = F.max(F.when(F.col("r") == F.floor(F.lit(0.9) * (F.col("n") - 1)) + 1, F.col("v"))).over(own)
    loud = ranked.withColumn("level", level).where(F.col("v") >= F.col("level") - under)
    return loud.where(F.col("before").isNull() | (F.col("v") - F.col("before") >= rise)).select("cap", "t", F.lit("shot").alias("kind"))


@detector("audio-events")
def audio_events(scores: DataFrame, least: float = 60.0, gap: int = 6 * HOUR, length: int = 4 * HOUR) -> DataFrame:
    """Events of sound classes: hits over a threshold, those of any class close together as one, named after its strongest."""
    hits = scores.where(F.col("v") >= least).withColumn("e", F.col("t") + length)
    grouped = intervals.islands(hits, "cap", "t", gap, "e")
    best = F.max_by("kind", F.struct("v", -F.col("t"), -F.col("id")))
    return grouped.groupBy("cap", "grp").agg(F.min("t").alias("t"), best.alias("kind")).select("cap", "t", "kind")


@detector("hud-template")
def hud_template(matches: DataFrame, least: float = 50.0, held: int = 2) -> DataFrame:
    """Events where one template wins a frame (twelve hours) by its score, alone, and holds for some frames."""
    frames = matches.where(F.col("v") >= least).groupBy("cap", F.floor(F.col("t") / (12 * HOUR)).alias("frame"), "kind").agg(F.max("v").alias("v"))
    order = Window.partitionBy("cap", "frame").orderBy(F.desc("v"), "kind")
    won = frames.withColumn("n", F.row_number().over(order)).where("n = 1").select("cap", "frame", "kind")
    run = Window.partitionBy("cap", "kind").orderBy("frame")
    marked = won.withColumn("f", F.when(F.col("frame") - F.lag("frame").over(run) <= 2, 0).otherwise(1)).withColumn("run", F.sum("f").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("cap", "kind", "run").agg((F.min("frame") * 12 * HOUR).alias("t"), F.count("*").alias("n")).where(F.col("n") >= held).select("cap", "t", "kind")


@detector("killfeed")
def killfeed(rows: DataFrame, spacing: int = 12 * HOUR) -> DataFrame:
    """Kills and deaths from rows seen in frames of six hours: tracked upwards in their column, dated at the first frame; deaths keep apart."""

    def run(g: pd.DataFrame) -> list[tuple]:
        g = g.assign(frame=g.t // (6 * HOUR))
        frames = {int(f): [(float(i % 4), v, k) for i, v, k in zip(x.id, x.v, x.kind, strict=True)] for f, x in g.groupby("frame")}
        if not frames:
            return []
        low = min(frames)
        found = kernels.track_rows([frames.get(k, []) for k in range(low, max(frames) + 1)], 0.5, 1, 4)
        out, last = [], None
        for first, kind in sorted(found):
            t = (first + low) * 6 * HOUR
            if kind == "death":
                if last is not None and t - last < spacing:
                    continue
                last = t
            out.append((t, kind))
        return out

    seen = rows.where("kind in ('kill', 'death') and t >= 0").select("cap", "id", "t", "v", "kind")
    return per_key(seen, "cap", run, {"t": "long", "kind": "string"}, ["t", "id"])


@detector("killfeed-teams")
def killfeed_teams(rows: DataFrame, apart: int = 6) -> DataFrame:
    """Deaths of either side from rows seen in frames of three hours, given once they hold and some frames after the last of their side."""

    def run(g: pd.DataFrame) -> list[tuple]:
        found = folds.track_log(list(zip((g.t // (3 * HOUR)).tolist(), g.v.tolist(), g.side, strict=True)), 8, 15.0, 1)
        out, last = [], {}
        for frame, side in sorted(found):
            if side not in last or frame - last[side] > apart:
                last[side] = frame
                out.append((int(frame) * 3 * HOUR, side))
        return out

    side = F.when(F.col("id") % 2 == 0, "ally").otherwise("enemy")
    seen = rows.where("kind in ('kill', 'death')").select("cap", "id", "t", "v", side.alias("side"))
    return per_key(seen, "cap", run, {"t": "long", "kind": "string"}, ["t", "id"])


@detector("killfeed-headshot")
def killfeed_headshot(rows: DataFrame, within: int = 24 * HOUR, least: float = 40.0) -> DataFrame:
    """Kills whose nearest frame shows the sign of a headshot strongly enough."""
    signs = rows.where("kind = 'headshot'").select("cap", "id", "t", "v")
    near = matching.nearest(rows.where("kind = 'kill'").select("cap", "id", "t"), signs, within)
    strong = near.join(signs.select("cap", F.col("id").alias("rid"), "v"), ["cap", "rid"]).where(F.col("v") >= least)
    return strong.select("cap", F.col("lt").alias("t"), F.lit("headshot").alias("kind"))


@detector("ammo-counter")
def ammo_counter(reads: DataFrame) -> DataFrame:
    """Shots and reloads from a counter's reads: plateaus by majority, a fall is a shot, a rise a reload."""

    def run(g: pd.DataFrame) -> list[tuple]:
        found = kernels.plateaus([int(x) for x in g.v // 25], 3)
        return [(int(g.t.iloc[b]), "shot" if y < x else "reload") for (_, x), (b, y) in zip(found, found[1:], strict=False)]

    return per_key(reads.where("kind = 'shot'").select("cap", "id", "t", "v"), "cap", run, {"t": "long", "kind": "string"}, ["t", "id"])


@detector("hud-counter")
def hud_counter(reads: DataFrame) -> DataFrame:
    """Kills from a counter's noisy reads, decoded, and paired with the knocks before them; a rise by several is a wipe."""

    def run(g: pd.DataFrame) -> list[tuple]:
        counter = g[g.kind == "assist"]
        if not len(counter):
            return []
        state = decoders.states(decoders.Counter(10), (counter.v // 10).astype(int).to_numpy() % 10)
        rise = np.maximum(np.diff(state, prepend=state[:1]), 0)
        rises = [(t, int(n)) for t, n in zip(counter.t.tolist(), rise, strict=True) if n]
        return [(int(t), how) for t, how in folds.fifo_pairs(rises, g[g.kind == "shot"].t.tolist(), 30 * HOUR, HOUR) if how != "free"]

    return per_key(reads.where("kind in ('assist', 'shot')").select("cap", "id", "t", "v", "kind"), "cap", run, {"t": "long", "kind": "string"}, ["t", "id"])


@detector("hud-change")
def hud_change(reads: DataFrame) -> DataFrame:
    """Changes between the shapes that a zone shows (here unit vectors at an angle that the value gives), once each until the first is back."""

    def run(g: pd.DataFrame) -> list[tuple]:
        angle = np.floor(g.v.to_numpy() / 12.5) * np.pi / 8
        _, changes = kernels.track_shapes([np.array([np.cos(a), np.sin(a)]) for a in angle], 0.95)
        return [(int(g.t.iloc[k]), "change") for k in changes]

    return per_key(reads.where("kind = 'assist'").select("cap", "id", "t", "v"), "cap", run, {"t": "long", "kind": "string"}, ["t", "id"])


@detector("round-score")
def round_score(reads: DataFrame) -> DataFrame:
    """Rounds won by either side, from two scores decoded together."""

    def run(g: pd.DataFrame) -> list[tuple]:
        both = decoders.states(decoders.Scores(8), (g.v // 12.5).astype(int).to_numpy() % 9, np.where(g.id % 5 == 0, -1, (g.v // 7).astype(int) % 9))
        states = [divmod(x, 9) for x in both.tolist()]
        return [(int(t), "won" if b[0] > a[0] else "lost") for t, a, b in zip(g.t.iloc[1:], states, states[1:], strict=False) if b[0] > a[0] or b[1] > a[1]]

    return per_key(reads.where("kind = 'shot'").select("cap", "id", "t", "v"), "cap", run, {"t": "long", "kind": "string"}, ["t", "id"])


@detector("ocr-log")
def ocr_log(lines: DataFrame) -> DataFrame:
    """Events of an on-screen log: classified lines are followed, finishing blows and credits are resolved, and icons confirm what is left."""

    def run(g: pd.DataFrame) -> list[tuple]:
        names = {"shot": "hit", "kill": "finish", "death": "wipe", "assist": "aid"}
        seen = g[g.kind.isin(list(names))]
        tracked = folds.track_log([(int(t // (3 * HOUR)), v, names[k]) for t, v, k in zip(seen.t, seen.v, seen.kind, strict=True)], 8, 20.0, 1)
        log = sequences.open_queue([(f * 3 * HOUR, k) for f, k in tracked], 48 * HOUR, 12 * HOUR)
        log = sequences.credit_marks([(t, k, k == "aid") for t, k in log], "hit", 24 * HOUR)
        icons = [(t, "hit") for t in g[g.kind == "headshot"].t.tolist()]
        return [(int(t), k) for t, k in sequences.fuse_sources(icons, log, 6 * HOUR, 12 * HOUR)]

    return per_key(lines.where("t >= 0").select("cap", "id", "t", "v", "kind"), "cap", run, {"t": "long", "kind": "string"}, ["t", "id"])
