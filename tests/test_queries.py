"""Every registered query with SQL against DuckDB on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from momentis.plans import registry
from tests.test_decoders import plain_beats, plain_scores

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(v[k] for k in order)) for v in values)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def captures(duck):
    """Each capture's events as plain rows in order: id, t, kind, v."""
    sql = """SELECT user_id, event_id, epoch_us(ts) - 1704067200000000 AS t, CASE event_type WHEN 'purchase' THEN 'kill' WHEN 'error' THEN 'death' WHEN 'signup' THEN 'headshot' WHEN 'click' THEN 'shot' WHEN 'view' THEN 'assist' END, value
             FROM events ORDER BY user_id, t, event_id"""
    out: dict = {}
    for cap, *row in duck.sql(sql).fetchall():
        out.setdefault(cap, []).append(tuple(row))
    return out


def of(rows_, *kinds):
    return [r for r in rows_ if r[2] in kinds]


def best_counter(reads, most=10, step=5):
    """The best path of a counter by trying every step from every state, last things first."""
    score, back = {s: (1 if reads[0] == s else -1) if reads[0] >= 0 else 0 for s in range(most + 1)}, []
    for x in reads[1:]:
        fresh, came = {}, {}
        top = min(s for s in score if score[s] == max(score.values()))
        for s in score:
            options = [(score[s], s), *((score[s - k] - 3 - 0.5 * (k - 1), s - k) for k in range(1, step + 1) if s - k >= 0)]
            if s == 0:
                options.append((score[top] - 25, top))
            best = max(o for o, _ in options)
            fresh[s], came[s] = next((o, c) for o, c in options if o == best)
        back.append(came)
        score = {s: v + (0 if x < 0 else 1 if s == x else -1) for s, v in fresh.items()}
    state = min(s for s in score if score[s] == max(score.values()))
    path = [state]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def plain_counter(rows_):
    path = best_counter([-1 if i % 7 == 0 else int(v // 10) % 10 for i, _, _, v in rows_])
    return [(r[0], s, max(0, s - p)) for r, s, p in zip(rows_, path, [path[0], *path], strict=False)]


def plain_pairs(rows_):
    knocks, out = [t for _, t, k, _ in rows_ if k == "shot"], []
    for _, t, _, v in of(rows_, "kill"):
        n = 2 if v > 75 else 1
        near = sorted(x for x in knocks if t - 30 * HOUR <= x <= t + HOUR)[:n]
        for x in near:
            knocks.remove(x)
        out += [(x, "paired") for x in near] + [(t, "wipe" if n > 1 else "lone")] * (n - len(near))
    return out + [(x, "free") for x in knocks]


def plain_credits(rows_):
    marks, latest, given, out = [t for _, t, k, _ in rows_ if k == "shot"], {}, None, []
    for _, t, k, _ in of(rows_, "assist", "shot", "kill"):
        if k != "assist":
            out.append((t, k))
            if k != "shot":
                latest[k] = t
            continue
        count = sum(1 for m in marks if max(latest.get(k, float("-inf")), t - 48 * HOUR) < m <= t)
        latest[k] = t
        if count or given is None or t - given > 24 * HOUR:
            given = t
            out += [(max((m for m in marks if t - 24 * HOUR <= m <= t), default=t), k)] * max(1, count)
    return out


def plain_common(rows_):
    half = len(rows_) // 2
    return [(common([r[2] for r in rows_[:half]], [r[2] for r in rows_[half:]]),)]


def common(a, b):
    table_ = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table_[i + 1][j + 1] = table_[i][j] + 1 if x == y else max(table_[i][j + 1], table_[i + 1][j])
    return table_[-1][-1]


def plain_distance(rows_):
    kills = of(rows_, "kill")
    if not kills:
        return []
    a, b = [r for r in kills if r[0] % 3 != 0], [r for r in kills if r[0] % 3 != 1]
    days = [{t // (24 * HOUR) for _, t, _, _ in x} for x in (a, b)]
    apart = 1 - common([r[0] for r in a], [r[0] for r in b]) / max(len(a), len(b), 1)
    shift = min(1.0, abs(a[0][1] - b[0][1]) / (96 * HOUR)) if a and b else 1.0
    return [(round(max(apart, 1 - len(days[0] & days[1]) / max(len(days[0] | days[1]), 1), shift), 6),)]


def plain_extension(rows_):
    spans = sorted((max(t - 4 * HOUR, 0), min(t + 8 * HOUR, 720 * HOUR), i) for i, t, k, _ in rows_ if k in ("kill", "shot"))
    spans = [(s, e) for s, e, _ in sorted(spans, key=lambda x: (x[0], x[2]))]
    out = []
    for day in range(0, 30, 5) if spans else ():
        s, e = day * 24 * HOUR, (day + 1) * 24 * HOUR
        low, high = s - 12 * HOUR, e + 12 * HOUR
        while True:
            before = s, e
            for a, b in spans:
                if a < s < b and a >= low:
                    s = a
                if (a < e < b or 0 <= a - e <= HOUR) and e < b <= high:
                    e = b
            if (s, e) == before:
                break
        out.append((day, float(s), float(e)))
    return out


def plain_joint(rows_):
    own = of(rows_, "shot")
    path = plain_scores([(int(v // 12.5) % 9, -1 if i % 5 == 0 else int(v // 7) % 9) for i, _, _, v in own], 8) if own else []
    return [(r[0], *s) for r, s in zip(own, path, strict=True)]


def plain_clutches(rows_):
    """Last stands told round by round: the marks of a round are cut first, then each round is judged by itself."""
    own = [t for _, t, _, _ in of(rows_, "death")]
    unmatched, marks = sorted(own), [(t, 1, "own") for t in own] + [(t, 2, "enemy") for _, t, _, _ in of(rows_, "kill")]
    for _, t, _, _ in of(rows_, "shot"):
        near = sorted((abs(x - t), x) for x in unmatched if abs(x - t) <= 2 * HOUR)
        if near:
            unmatched.remove(near[0][1])
        else:
            marks.append((t, 0, "ally"))
    starts, played = [t for _, t, _, _ in of(rows_, "headshot")], []
    for t, _, kind in sorted(marks):
        if played:
            last, now = played[-1][-1][0], [k for _, k in played[-1]]
            over = now.count("enemy") >= 3 or now.count("ally") + ("own" in now) >= 3
            if over or t - last > 48 * HOUR or any(last < x <= t for x in starts):
                played.append([])
        else:
            played.append([])
        played[-1].append((t, kind))
    out = []
    for marks_ in played:
        upto = next((k for k, (_, kind) in enumerate(marks_) if kind == "own"), len(marks_))
        living = marks_[:upto]
        stood = next((k for k in range(len(living)) if sum(kind == "ally" for _, kind in living[: k + 1]) >= 2), None)
        if stood is None:
            continue
        enemies = 3 - sum(kind == "enemy" for _, kind in living[: stood + 1])
        felled = [t for t, kind in living if kind == "enemy"]
        if len(felled) == 3 and enemies >= 2 and felled[2] >= living[stood][0]:
            out.append((living[stood][0], enemies, felled[2]))
    return out


def plain_own(rows_):
    free, out = {t: n for t, n in Counter(t for _, t, _, _ in of(rows_, "death")).items()}, []
    for i, t, _, _ in of(rows_, "shot"):
        for x in sorted((x for x, n in free.items() if n and abs(x - t) <= 2 * HOUR), key=lambda x: (abs(x - t), x))[:1]:
            free[x] -= 1
            out.append((i, x))
    return out


PLAIN = {"own_deaths_in_order": plain_own, "clutch_fsm": plain_clutches, "variant_distance": plain_distance, "joint_viterbi": plain_joint, "counter_viterbi": plain_counter, "knock_pairs": plain_pairs, "credit_marks": plain_credits, "common_subsequences": plain_common, "segment_extension": plain_extension}


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_query_equals_plain_loop(spark, captures, name):
    got = sorted(repr(tuple(r)) for r in registry.queries()[name](spark, SF).collect())
    assert got == sorted(repr((cap, *row)) for cap, rows_ in captures.items() for row in PLAIN[name](rows_))


def test_clutches_in_search_and_statistics(spark, captures):
    run = lambda name: registry.queries()[name](spark, SF).collect()
    groups = {}
    for r in run("kill_groups"):
        groups.setdefault(r.cap, []).append(r)
    found = {}
    for cap, rows_ in captures.items():
        for _, enemies, won in plain_clutches(rows_):
            grp = next(g.grp for g in groups[cap] if g.s <= won <= g.e)
            n, most = found.get((cap, grp), (0, 0))
            found[cap, grp] = n + 1, max(most, enemies)
    assert {(r.cap, r.grp): (r.clutches, r.enemies) for r in run("clutch_search")} == found and found
    rows_ = run("game_clutches")
    unknown = {(r.cap, r.game) for r in run("game_rollup") if r.deaths is None}
    assert {(r.cap, r.game) for r in rows_ if r.clutches is None} == unknown
    assert sum(r.clutches or 0 for r in rows_) <= sum(n for n, _ in found.values()) and all((r.clutches or 0) >= (r.most_enemies or 0) / 3 for r in rows_)


def test_beats_equal_a_plain_loop(spark):
    from momentis.plans.moments import signals

    curves = {}
    for r in signals(spark, SF).where("kind = 'kill'").orderBy("cap", "win").collect():
        curves.setdefault(r.cap, []).append((r.win, float(r.raw)))
    want = {(cap, x[k][0]) for cap, x in curves.items() for k in plain_beats([v for _, v in x], 4)}
    got = [tuple(r) for r in registry.queries()["beat_tracking"](spark, SF).collect()]
    assert set(got) == want and len(got) == len(want)


def test_shapes_of_other_queries(spark, captures):
    """Queries that neither SQL nor a short loop says: each keeps its keys, and its values lie where they can."""
    run = lambda name: registry.queries()[name](spark, SF).collect()
    assert {r.kind for r in run("log_tracks")} == {"shot", "assist"}
    vectors = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()}
    shapes = run("shape_clusters")
    assert {r.vec_id for r in shapes} == vectors and min(r.shape for r in shapes if r.shape is not None) == 0 and any(r.fresh for r in shapes)
    for name in ("spectrum_peaks", "mask_boxes", "own_lag", "cluster_labels", "section_novelty", "mel_levels", "onset_strength", "beat_tempo", "percussive_parts", "template_matches", "model_labels"):
        assert {r.vec_id for r in run(name)} == vectors, name
    assert all(30 <= r.value <= 300 for r in run("beat_tempo")) and all(0 <= r.value <= 1 for r in run("percussive_parts")) and all(-1 <= r.value <= 1 for r in run("template_matches"))
    assert all(sorted(str(r.value).zfill(4)) == list("0123") for r in run("cluster_labels")) and {r["class"] for r in run("model_labels")} <= set(range(10))
    for name, kinds in {"detect_killfeed": {"kill", "death"}, "detect_killfeed_teams": {"ally", "enemy"}, "detect_ammo_counter": {"shot", "reload"}, "detect_hud_counter": {"paired", "lone", "wipe"}, "detect_round_score": {"won", "lost"}, "detect_ocr_log": {"hit", "aid"}}.items():
        found = run(name)
        assert found and {r.kind for r in found} <= kinds and {r.cap for r in found} <= set(captures), name
    flat = run("plateau_segments")
    assert flat and all((a.cap, a.value) != (b.cap, b.value) for a, b in zip(flat, flat[1:], strict=False))
    assert {r.kind for r in run("detect_hud_change")} == {"change"} and {r.role for r in run("row_tracks")} <= {"kill", "death"}
    assert all(0.125 <= r.level <= 2 and abs(r.level + r.place + r.kind - 1) < 0.2 for r in run("preference_learner"))
    assert {r.feature for r in run("quality_learner")} >= {"bias", "agreement"}
    known = set(PLAIN) - {"knock_pairs", "credit_marks"} | {"clutch_search", "game_clutches", "log_tracks", "shape_clusters", "spectrum_peaks", "mask_boxes", "own_lag", "cluster_labels", "section_novelty", "mel_levels", "onset_strength", "beat_tempo", "percussive_parts", "template_matches", "model_labels"}
    known |= {"stream_log_tracks", "stream_row_tracks", "stream_shapes", "slot_plan", "learned_digits", "library_preference", "library_choice_learner", "quality_gate", "beat_tracking", "plateau_segments", "row_tracks", "choice_learner", "preference_learner", "quality_learner", "fuzzy_needles", *(f"detect_{x}" for x in ("killfeed", "killfeed_teams", "ammo_counter", "hud_counter", "hud_change", "round_score", "ocr_log"))}
    assert set(registry.queries()) - set(registry.oracle_sql()) == known
