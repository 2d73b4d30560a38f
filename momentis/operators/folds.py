"""Order-dependent operators: one pass over the sorted rows of a key, as grouped-map functions."""

from __future__ import annotations

import bisect

import numpy as np


def spaced(times: np.ndarray, strength: np.ndarray, spacing: float) -> np.ndarray:
    """Strongest first; what lies closer than the spacing to a kept one goes. Ties by time."""
    kept: list[float] = []
    mask = np.zeros(len(times), bool)
    for k in np.lexsort((times, -strength)):
        at = bisect.bisect(kept, times[k])
        # Kept times are sorted: the nearest ones stand beside the place of this one.
        if all(abs(times[k] - t) >= spacing for t in kept[max(at - 1, 0) : at + 1]):
            kept.insert(at, times[k])
            mask[k] = True
    return mask


def budgeted(lengths: np.ndarray, rank: np.ndarray, budget: float, least: float) -> np.ndarray:
    """Length that each item gets: by rank until less than the least length is left; the last is trimmed."""
    given, left = np.zeros(len(lengths)), budget
    for k in np.lexsort((np.arange(len(rank)), -rank)):
        if left < least:
            break
        given[k] = min(lengths[k], left)
        left -= given[k]
    return given


def distinct_games(start: np.ndarray, length: np.ndarray, kills: np.ndarray, game=None, file=None, size=None, reliable=None) -> np.ndarray:
    """Richest first, in the order given among equals; a game goes that is one already kept: of the same name, and the same capture (the same file, or one of the same size, if known, and of
    a length within a second), or overlapping it, both times being reliable, by over half of the shorter. Times are in microseconds; one without a start goes."""
    n = len(start)
    game = np.zeros(n) if game is None else np.asarray(game)
    file = np.arange(n) if file is None else np.asarray(file)
    size = np.zeros(n, np.int64) if size is None else np.asarray(size)
    reliable = np.ones(n, bool) if reliable is None else np.asarray(reliable)
    start, length = np.asarray(start, float), np.asarray(length, float)
    keep = np.zeros(n, bool)
    held: dict = {}
    for k in np.argsort(-np.asarray(kills), kind="stable"):
        if np.isnan(start[k]):
            continue
        # What is kept of each name: files, lengths by size, and reliable spans by start with the longest of them, so that only what can overlap is looked at.
        of = held.setdefault(game[k], {"files": set(), "sizes": {}, "spans": [], "longest": 0.0})
        lengths = of["sizes"].get(size[k], []) if size[k] > 0 else []
        at = bisect.bisect(lengths, length[k])
        same = file[k] in of["files"] or any(abs(x - length[k]) < 1_000_000 for x in lengths[max(at - 1, 0) : at + 1])
        if not same and reliable[k]:
            a, b = start[k], start[k] + length[k]
            low, high = (bisect.bisect_left(of["spans"], (x,)) for x in (a - of["longest"], b))
            same = any(min(s + own, b) - max(s, a) > min(own, length[k]) / 2 for s, own in of["spans"][low:high])
        if same:
            continue
        keep[k] = True
        of["files"].add(file[k])
        if size[k] > 0:
            bisect.insort(of["sizes"].setdefault(size[k], []), length[k])
        if reliable[k]:
            bisect.insort(of["spans"], (start[k], length[k]))
            of["longest"] = max(of["longest"], length[k])
    return keep


def own_among(allies: list[float], own: list[float], same: float) -> list[float | None]:
    """For each ally's death in the order given, the nearest death of the player up to `same` away (the earlier of equals) that no earlier one has taken."""
    left, out = sorted(own), []
    for t in allies:
        near = min((x for x in left if abs(x - t) <= same), key=lambda x: abs(x - t), default=None)
        if near is not None:
            left.remove(near)
        out.append(near)
    return out


def clutches(allies: list[float], enemies: list[float], own: list[float], gap: float, team: int = 5, least: int = 2, starts: list[float] = (), same: float = 1.5) -> list[tuple[float, int, float]]:
    """Last stands won: when the player was left alone, against how many, and when the last enemy fell.

    An ally's death nearest to an unmatched death of the player, up to `same` away, is the player's own. A round ends where a side has lost all, after
    a silence over the gap, or at a start that was read; a dead player wins nothing until then.
    """
    marks = [(t, "own") for t in own] + [(t, "enemy") for t in enemies]
    marks += [(t, "ally") for t, taken in zip(allies, own_among(allies, own, same), strict=True) if taken is None]
    out = []
    order = {"ally": 0, "own": 1, "enemy": 2}
    lost, felled, dead, alone, last = 0, 0, False, None, None
    for t, kind in sorted(marks, key=lambda m: (m[0], order[m[1]])):
        if last is not None and (t - last > gap or felled >= team or lost + dead >= team or any(last < x <= t for x in starts)):
            lost, felled, dead, alone = 0, 0, False, None
        last = t
        lost += kind == "ally"
        felled += kind == "enemy"
        dead |= kind == "own"
        if dead:
            continue
        if alone is None and lost >= team - 1:
            alone = t, max(0, team - felled)
        if kind == "enemy" and felled == team and alone and alone[1] >= least:
            out.append((*alone, t))
    return out


def fifo_pairs(rises: list[tuple[float, int]], knocks: list[float], before: float, after: float) -> list[tuple[float, str]]:
    """Kills from counter rises and knocks: each rise by k takes the k earliest free knocks in its window; a wipe takes what there is."""
    free, out = sorted(knocks), []
    for at, k in rises:
        near = [x for x in free if at - before <= x <= at + after][:k]
        free = [x for x in free if x not in near]
        out += [(x, "paired") for x in near]
        out += [(at, "wipe" if k > 1 else "lone")] * (k - len(near))
    return sorted(out + [(x, "free") for x in free])


def diverse(vectors: np.ndarray, order: np.ndarray, least: float, k: int) -> list[int]:
    """The first k items in order that are at least so far from all kept."""
    kept: list[int] = []
    for i in order:
        if all(np.linalg.norm(vectors[i] - vectors[j]) >= least for j in kept):
            kept.append(int(i))
            if len(kept) == k:
                break
    return kept


def sellers(needle: str, text: str) -> int:
    """Least edit distance of the needle to any substring of the text."""
    if not needle:
        return 0
    row = list(range(len(needle) + 1))
    best = row[-1]
    for c in text:
        fresh = [0]
        for j, d in enumerate(needle, 1):
            fresh.append(min(row[j] + 1, fresh[j - 1] + 1, row[j - 1] + (c != d)))
        row = fresh
        best = min(best, row[-1])
    return best


def trigrams(text: str) -> set[str]:
    return {text[k : k + 3] for k in range(len(text) - 2)}


class Needle:
    """A text to be found within a fifth of its length in edits: `sellers` against that bound, a column of its table in one integer."""

    def __init__(self, needle: str):
        self.size = len(needle)
        self.bound = max(1, self.size // 5)
        self.places: dict[str, int] = {}
        for k, c in enumerate(needle):
            self.places[c] = self.places.get(c, 0) | 1 << k
        # An edit breaks one of these at most; the others stand in the text unchanged.
        self.pieces = [needle[k : k + 3] for k in range(0, self.size - 2, 3)]

    def within(self, text: str, grams: set[str]) -> bool:
        """Whether the least edit distance to a substring is within the bound; grams: the text's trigrams."""
        if self.size <= self.bound:
            return True
        if len(text) < self.size - self.bound or sum(map(grams.__contains__, self.pieces)) < len(self.pieces) - self.bound:
            return False
        mask, high = (1 << self.size) - 1, 1 << (self.size - 1)
        up, down, distance = mask, 0, self.size
        for c in text:
            same = self.places.get(c, 0)
            vertical = same | down
            across = (((same & up) + up) ^ up) | same
            more, less = down | (~(across | up) & mask), up & across
            if more & high:
                distance += 1
            elif less & high:
                distance -= 1
                if distance <= self.bound:
                    return True
            more, less = more << 1, less << 1
            up, down = (less | ~(vertical | more)) & mask, more & vertical & mask
        return False


class Needles:
    """Many needles sought in a text at once.

    A needle within its bound of edits has all but `bound` of its pieces unchanged in the text, on diagonals (place in the text less place in the needle) that lie within `bound`
    of one another, as each letter put in or left out moves the diagonal by one. Diagonals are taken in ranges a quarter of that wide; only needles of which enough different pieces
    stand in five neighbouring ranges are compared letter by letter, in the order given.
    """

    #: Places of pieces that are looked at at once.
    HITS = 1 << 20

    def __init__(self, needles: list[str], step: int = 4096):
        self.needles = [Needle(x) for x in needles]
        size = np.array([x.size for x in self.needles], np.int64)
        bound = np.array([x.bound for x in self.needles], np.int64)
        length = np.where(size < 6, np.maximum(size // 2, 1), 3)
        self.least = size // length - bound
        self.short, self.width = size - bound, (bound + 4) // 4
        self.lead, self.step, self.overlap = 4 - (-size // self.width), step, int((size + bound).max(initial=0))
        #: Of each length: the pieces' codes, needles and places.
        self.pieces = []
        for q in np.unique(length).tolist():
            own = [(k, np.arange(0, len(needles[k]) - q + 1, q)) for k in np.flatnonzero(length == q).tolist()]
            code = np.concatenate([self._codes(needles[k], q)[at] for k, at in own])
            self.pieces.append((q, code, np.repeat([k for k, _ in own], [len(at) for _, at in own]), np.concatenate([at for _, at in own])))

    @staticmethod
    def _codes(text: str, q: int) -> np.ndarray:
        """The strings of q plain capitals of a text, as numbers."""
        letters = np.frombuffer(text.encode("ascii"), np.uint8).astype(np.int64) - ord("A")
        n = max(len(letters) - q + 1, 0)
        code = np.zeros(n, np.int64)
        for k in range(q):
            code = code * 26 + letters[k : k + n]
        return code

    def first(self, text: str) -> int | None:
        """Number of the first needle within its bound. Long texts are looked at in parts, each with the overlap that a needle takes."""
        found = [self._first(text[a : a + self.step + self.overlap]) for a in range(0, max(len(text) - self.overlap, 1), self.step)]
        return min((x for x in found if x is not None), default=None)

    def _first(self, text: str) -> int | None:
        grams = trigrams(text)
        return next((k for k in self.likely(text).tolist() if self.needles[k].within(text, grams)), None)

    def likely(self, text: str) -> np.ndarray:
        """Numbers of the needles with enough different pieces on neighbouring diagonals of the text."""
        if not self.needles:
            return np.empty(0, np.int64)
        bins = self.lead + len(text) // self.width + 2
        base = np.cumsum(bins) - bins
        zero = base + self.lead
        change = np.zeros(int(bins.sum()), np.int64)
        for q, code, owner, place in self.pieces:
            codes = self._codes(text, q)
            order = np.argsort(codes, kind="stable")
            end = np.cumsum(np.bincount(codes, minlength=26**q))
            times = np.diff(end, prepend=0)[code]
            total = np.cumsum(times)
            cuts = np.searchsorted(total, np.arange(self.HITS, times.sum() + self.HITS, self.HITS)) + 1
            for a, b in zip([0, *cuts.tolist()], cuts.tolist(), strict=False):
                n = times[a:b]
                piece = np.repeat(np.arange(a, a + len(n)), n)
                held = owner[piece]
                at = order[np.arange(len(piece)) + np.repeat(end[code[a:b]] - np.cumsum(n), n)]
                last = (at - place[piece]) // self.width[held]
                # A piece in a range counts for the five starts from which that range is reached, once where it stands there several times.
                start = last - 4
                start[1:] = np.maximum(start[1:], np.where(piece[1:] == piece[:-1], last[:-1] + 1, start[1:]))
                change += np.bincount(zero[held] + start, minlength=len(change)) - np.bincount(zero[held] + last + 1, minlength=len(change))
        most = np.maximum.reduceat(np.cumsum(change), base)
        return np.flatnonzero(((most >= self.least) & (len(text) >= self.short)) | (self.short <= 0))


class LogLines:
    """Lines of a log seen in frames: `frame` takes a frame's rows (y, kind) and gives (first frame, kind) of the lines that have now been seen `sightings` times.

    A line is the nearest of its kind that was last seen up to `hold` before and that has risen by up to four and a half pitches or fallen by up to 0.6 of one and `drop`
    whole ones; a frame's lines are matched from the top, each with a line of its own. What is kept of a line is a plain tuple.
    """

    live = "kind string, y double, last double, first double, sightings long"
    found = {"frame": "long", "kind": "string"}

    def __init__(self, hold: float, pitch: float, sightings: int, drop: int = 0):
        self.hold, self.pitch, self.sightings, self.drop = hold, pitch, sightings, drop

    def kept(self, live: list[tuple], t: float) -> list[tuple]:
        """Lines that a row at t may still belong to."""
        return [x for x in live if t - x[2] <= self.hold]

    def frame(self, live: list[tuple], t: float, rows: list[tuple[float, str]]) -> tuple[list[tuple], list[tuple[float, str]]]:
        free, seen, out = self.kept(live, t), [], []
        for y, kind in sorted(rows, key=lambda r: r[0]):
            near = [x for x in free if x[0] == kind and -4.5 * self.pitch <= y - x[1] <= (0.6 + self.drop) * self.pitch]
            own = min(near, key=lambda x: abs(x[1] - y)) if near else (kind, y, t, t, 0)
            free = [x for x in free if x is not own]
            own = (kind, y, t, own[3], own[4] + 1)
            if own[4] == self.sightings:
                out.append((own[3], kind))
            seen.append(own)
        return seen + free, out


def track_log(rows: list[tuple[float, float, str]], hold: float, pitch: float, sightings: int, drop: int = 0) -> list[tuple[float, str]]:
    """(first time, kind) of lines seen in frames, given as (time, y, kind); see `LogLines`."""
    frames: dict[float, list[tuple[float, str]]] = {}
    for t, y, kind in rows:
        frames.setdefault(t, []).append((y, kind))
    lines, live, out = LogLines(hold, pitch, sightings, drop), [], []
    for t in sorted(frames):
        live, found = lines.frame(live, t, frames[t])
        out += found
    return out
