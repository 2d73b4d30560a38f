"""More one-pass operators over the ordered rows of a key: attribution, fusion, queues, joint decoding, extension, scenes, kernels."""

from __future__ import annotations

from collections import deque

import numpy as np


def attribute_shots(kills: list[float], shots: list[float], before: float, after: float, burst: float) -> list[int | None]:
    """Shots that each kill took, by sorted times: the shot nearest to the kill, from `before` it to `after` it, is fatal, and the shots of the burst up to it
    count that come after the last target's fatal one. A kill without a shot near it is unknown, and the next counts from that kill."""
    heard = np.asarray(shots, float)
    out: list[int | None] = []
    last = -np.inf
    for k in kills:
        low, high = np.searchsorted(heard, k - before), np.searchsorted(heard, k + after, "right")
        if low == high:
            out.append(None)
            last = k if len(heard) else last
            continue
        fatal = heard[low + int(np.argmin(np.abs(heard[low:high] - k)))]
        first = np.searchsorted(heard, max(last, fatal - burst), "right")
        out.append(int(np.searchsorted(heard, fatal, "right") - first))
        last = fatal
    return out


def fuse_sources(icons: list[tuple[float, str]], log: list[tuple[float, str]], before: float, after: float) -> list[tuple[float, str]]:
    """Icons confirmed by log rows: each takes the earliest free row of its kind around it; one with only free rows of other kinds around it goes; one without
    any stays, and so do the free rows. Both lists are sorted by time."""
    times = np.array([t for t, _ in log])
    free = np.ones(len(log), bool)
    out = []
    for at, kind in icons:
        low, high = np.searchsorted(times, at - before), np.searchsorted(times, at + after, "right")
        near = low + np.flatnonzero(free[low:high])
        own = next((k for k in near.tolist() if log[k][1] == kind), None)
        if own is not None:
            free[own] = False
        if own is not None or not len(near):
            out.append((at, kind))
    return sorted(out + [row for row, k in zip(log, free, strict=True) if k])


def open_queue(marks: list[tuple[float, str]], window: float, repeat: float) -> list[tuple[float, str]]:
    """Events without finishing blows, from sorted marks of the kinds `hit`, `finish`, `wipe` and others.

    A finish closes the oldest hit that is open, for up to `window`; a wipe closes all. Either becomes a hit of its own where none is open, unless one
    of its sort was read up to `repeat` before. At one instant hits come first.
    """
    waiting: deque[float] = deque()
    read: dict[str, float] = {}
    out = []
    for t, kind in sorted(marks, key=lambda m: (m[0], m[1] != "hit")):
        while waiting and t - waiting[0] > window:
            waiting.popleft()
        if kind not in ("finish", "wipe"):
            if kind == "hit":
                waiting.append(t)
            out.append((t, kind))
            continue
        since = t - read.get(kind, -np.inf)
        read[kind] = t
        if kind == "wipe" and waiting:
            waiting.clear()
        elif waiting:
            waiting.popleft()
        elif since > repeat:
            out.append((t, "hit"))
    return out


def credit_marks(events: list[tuple[float, str, bool]], mark: str, within: float, since: float | None = None) -> list[tuple[float, str]]:
    """Events in which credits, (time, kind, True), stand for the marks before them.

    A credit is dated at the latest mark up to `within` before it, else at itself, and goes where no mark has come since the last event of its kind and another credit
    was given up to `within` before. With `since` it counts once for each mark since that event and within `since`, at least once.
    """
    marks = np.array(sorted(t for t, kind, _ in events if kind == mark))
    latest: dict[str, float] = {}
    given = -np.inf
    out = []
    for t, kind, credit in sorted(events, key=lambda e: e[0]):
        if not credit:
            out.append((t, kind))
            if kind != mark:
                latest[kind] = t
            continue
        upto = np.searchsorted(marks, t, "right")
        low = max(latest.get(kind, -np.inf), -np.inf if since is None else t - since)
        count = int(upto - np.searchsorted(marks[:upto], low, "right"))
        latest[kind] = t
        if not count and t - given <= within:
            continue
        given = t
        at = float(marks[upto - 1]) if upto and marks[upto - 1] >= t - within else t
        out += [(at, kind)] * (1 if since is None else max(1, count))
    return sorted(out, key=lambda e: e[0])


def extend(start: float, end: float, protected: list[tuple[float, float]], lead: float, tail: float, chain: float, most: float) -> tuple[float, float]:
    """A range grown until it cuts no protected segment, by up to `most` on each side; segments within `chain` of the end continue it."""
    low, high = start - most, end + most
    changed = True
    while changed:
        changed = False
        for s, e in protected:
            if s < start < e and s - lead >= low:
                start, changed = s - lead, True
            if (s < end < e or 0 <= s - end <= chain) and e + tail <= high and e + tail > end:
                end, changed = e + tail, True
    return start, end


def scenes(shots: list[tuple[float, float]], gap: float, longest: float) -> list[tuple[float, float]]:
    """Shots joined over gaps, as long as a scene stays within its greatest length."""
    out: list[tuple[float, float]] = []
    for s, e in shots:
        if out and s >= out[-1][0] and s - out[-1][1] <= gap and max(e, out[-1][1]) - out[-1][0] <= longest:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def paced(captions: list[tuple[float, str]], base: float = 0.4, per_sign: float = 0.045, most: float = 3.0) -> list[tuple[float, float]]:
    """Captions shown one after another, each long enough to be read."""
    out, free = [], -np.inf
    for at, text in captions:
        start = max(at, free)
        free = start + min(most, base + per_sign * len(text))
        out.append((start, free))
    return out


def _common_row(a: list, b: list) -> int:
    """The last row of the table of common subsequences, a bit for each item of a: a zero where the length grows."""
    places: dict = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        same = row & places.get(y, 0)
        row = (row + same | row - same) & full
    return row


def longest_common(a: list, b: list) -> int:
    """Length of the longest common subsequence: a row of the table at a time, as the bits of one number."""
    return len(a) - _common_row(a, b).bit_count()


def _prefix_lengths(a: list, b: list) -> np.ndarray:
    """Lengths common to b and each beginning of a, the empty one first."""
    row = _common_row(a, b)
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-max(len(a), 1) // 8), "little"), np.uint8), bitorder="little")[: len(a)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_places(a: list, b: list) -> list[tuple[int, int]]:
    """The places (i, j) of a longest common subsequence, in order: b is halved, and a cut where both halves have most in common, so no table is kept."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        if m == i or n == j:
            continue
        if n - j == 1:
            if (k := next((k for k in range(i, m) if a[k] == b[j]), None)) is not None:
                out.append((k, j))
            continue
        half = (j + n) // 2
        before = _prefix_lengths(a[i:m], b[j:half])
        after = _prefix_lengths(a[i:m][::-1], b[half:n][::-1])[::-1]
        cut = i + int((before + after).argmax())
        todo += [(cut, m, half, n), (i, cut, j, half)]
    return sorted(out)


def best_lag(a: np.ndarray, b: np.ndarray, most: int, margin: float) -> int | None:
    """The lag of b against a with the highest normalised correlation, if it beats all lags further than two away by the margin."""
    found = {}
    for lag in range(-most, most + 1):
        x, y = (a[max(0, -lag) : len(a) - max(0, lag)], b[max(0, lag) : len(b) - max(0, -lag)])
        n = min(len(x), len(y))
        x, y = x[:n] - x[:n].mean(), y[:n] - y[:n].mean()
        found[lag] = float(x @ y / max(np.sqrt((x @ x) * (y @ y)), 1e-12))
    best = max(found, key=lambda k: (found[k], -abs(k)))
    others = [v for k, v in found.items() if abs(k - best) > 2]
    return best if not others or found[best] - max(others) >= margin else None


def weighted_means(criteria: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted mean of each row's criteria that aren't null (NaN)."""
    known = ~np.isnan(criteria)
    return np.where(known, criteria, 0.0) @ w / np.maximum(known @ w, 1e-12)


def preference_weights(choices: list[tuple[np.ndarray, int]], base: np.ndarray, steps: int, rate: float, sharpness: float, penalty: float) -> np.ndarray:
    """Weights under which chosen variants (rows of criteria) score above the others of their choice.

    Descent on the mean of ln(1 + exp(-sharpness * difference)) over pairs plus penalty * ((w - base) / base)**2; each weight stays between a quarter of
    its base and four times that, and their sum stays.
    """
    w = base.astype(float).copy()
    low, high = base / 4, base * 4
    # All pairs at once: the places of the chosen and of the other variant among all rows.
    sizes = np.array([len(rows) for rows, _ in choices])
    begin = np.cumsum(sizes) - sizes
    rows = np.concatenate([rows for rows, _ in choices]) if choices else np.empty((0, len(base)))
    best = np.repeat(begin + [c for _, c in choices], sizes).astype(int)
    other = np.flatnonzero(best != np.arange(len(rows)))
    best = best[other]
    known = ~np.isnan(rows)
    x = np.where(known, rows, 0.0)
    for _ in range(steps):
        under = np.maximum(known @ w, 1e-12)
        total = x @ w / under
        # How a mean moves with a weight: the criterion's distance from the mean, over the weights that count.
        moves = np.where(known, x - total[:, None], 0.0) / under[:, None]
        wrong = sharpness / (1 + np.exp(np.clip(sharpness * (total[best] - total[other]), -500, 500)))
        slope = -wrong @ (moves[best] - moves[other])
        w = np.clip(w - rate * (slope / max(1, len(other)) + 2 * penalty * (w - base) / base**2), low, high)
        w = np.clip(w * base.sum() / w.sum(), low, high)
    return w


def agreement(choices: list[tuple[np.ndarray, int]], w: np.ndarray) -> float:
    """Share of choices whose chosen variant alone scores highest."""
    hits = 0
    for rows, chosen in choices:
        total = weighted_means(rows, w)
        hits += bool((np.delete(total, chosen) < total[chosen]).all())
    return hits / max(1, len(choices))


def budget_clips(items: list[tuple[float, float, float]], budget: float, least: float, before: float, protected: list[tuple[float, float]]) -> list[tuple[int, float, float]]:
    """Clips (index, start, end) of items (start, end, peak) by rank, until less than the least length is left of the budget.

    An item that is too long for what is left is trimmed around its peak, of which `before` is the share in front; one whose trimming would cut a
    protected span is passed over.
    """
    out, left = [], budget
    for k, (s, e, peak) in enumerate(items):
        if left < least:
            break
        if e - s > left:
            start = min(max(peak - left * before, s), e - left)
            if any(a < start < b or a < start + left < b for a, b in protected):
                continue
            s, e = start, start + left
        out.append((k, s, e))
        left -= e - s
    return out
