"""Numeric kernels over arrays: spectra, onsets, tempo, correlation, masks, decoders and small learners. Queries call them through
Arrow batches or grouped maps, one signal, image or history at a time."""

from __future__ import annotations

from collections import Counter, deque
from itertools import permutations

import numpy as np


def power_spectrum(x: np.ndarray) -> np.ndarray:
    """Power of the real transform of a windowed frame."""
    return np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2


def mel_bands(bands: int, size: int, rate: int, low: float, high: float) -> np.ndarray:
    """Triangular filters, equally spaced on the mel scale (1127 ln(1 + f / 700)), over the bins of a transform of `size`."""
    mel = lambda f: 1127 * np.log1p(np.asarray(f) / 700)
    edges = np.linspace(mel(low), mel(high), bands + 2)
    at = mel(np.arange(size // 2 + 1) * rate / size)
    up = (at[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - at[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down))


def log_mel(x: np.ndarray, rate: int = 16000, frame: int = 400, hop: int = 160, size: int = 512, bands: int = 64) -> np.ndarray:
    """Log-mel rows of a signal, a row per hop."""
    n = 1 + (len(x) - frame) // hop if len(x) >= frame else 0
    filters = mel_bands(bands, size, rate, 125, 7500)
    rows = [filters @ np.abs(np.fft.rfft(x[k * hop : k * hop + frame] * np.hanning(frame), size)) for k in range(n)]
    return np.log(np.array(rows).reshape(n, bands) + 0.001)


def onset_envelope(levels: np.ndarray, lag: int = 1, width: int = 1) -> np.ndarray:
    """Spectral rise: each band against the maximum of its neighbours a little before; falls count nothing."""
    wide = np.stack([np.roll(levels, k, axis=1) for k in range(-width, width + 1)]).max(axis=0)
    rise = np.maximum(0, levels[lag:] - wide[:-lag])
    return np.concatenate([np.zeros(lag), rise.sum(axis=1)])


def tempo(onset: np.ndarray, rate: float, usual: float = 120.0, spread: float = 1.0) -> float:
    """Beats a minute: the autocorrelation's best lag under a log-normal preference, refined by a parabola."""
    x = onset - onset.mean()
    auto = np.correlate(x, x, "full")[len(x) - 1 :]
    lags = np.arange(max(2, int(rate * 60 / 240)), min(len(x) - 1, int(rate * 60 / 40)))
    found = auto[lags] * np.exp(-0.5 * (np.log2(60 * rate / lags / usual) / spread) ** 2)
    k = lags[int(np.argmax(found))]
    a, b, c = auto[k - 1 : k + 2]
    shift = min(0.5, max(-0.5, 0.5 * (a - c) / (a - 2 * b + c))) if a - 2 * b + c else 0.0
    return 60 * rate / (k + shift)


def novelty(similarity: np.ndarray, half: int) -> np.ndarray:
    """A checkerboard kernel along the diagonal of a self-similarity matrix."""
    sign = np.sign(np.arange(-half, half) + 0.5)
    kernel = np.outer(sign, sign)
    n, out = len(similarity), np.zeros(len(similarity))
    for i in range(half, n - half + 1):
        out[min(i, n - 1)] = (kernel * similarity[i - half : i + half, i - half : i + half]).sum()
    return out


def percussive_share(magnitude: np.ndarray, width: int = 5) -> np.ndarray:
    """Share of energy per frame that lies across bands rather than along time, by median filters."""

    def median(x: np.ndarray, axis: int) -> np.ndarray:
        pad = [(width // 2,) * 2 if k == axis else (0, 0) for k in (0, 1)]
        return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, pad, mode="edge"), width, axis), axis=-1)

    along, across = median(magnitude, 0), median(magnitude, 1)
    return (across**2).sum(axis=1) / np.maximum((along**2 + across**2).sum(axis=1), 1e-12)


def locate(rise: np.ndarray, at: np.ndarray, expected: float, sigma: float) -> float:
    """Time of the strongest rise under a normal preference for the expected time."""
    return float(at[int(np.argmax(rise * np.exp(-0.5 * ((at - expected) / sigma) ** 2)))])


def profile_shift(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The shift with the least mean difference; the smallest of equals."""
    cost = {s: np.abs(a[max(0, s) : len(a) + min(0, s)] - b[max(0, -s) : len(b) + min(0, -s)]).mean() for s in range(-most, most + 1)}
    return min(cost, key=lambda s: (round(cost[s], 12), abs(s), s))


def correlation(image: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Normalised cross-correlation of a template at every place of an image."""
    views = np.lib.stride_tricks.sliding_window_view(image.astype(float), template.shape)
    t = template - template.mean()
    centred = views - views.mean(axis=(2, 3), keepdims=True)
    norm = np.sqrt((centred**2).sum(axis=(2, 3)) * (t**2).sum())
    return np.where(norm > 1e-9, (centred * t).sum(axis=(2, 3)) / np.maximum(norm, 1e-9), 0.0)


def dice(a: np.ndarray, b: np.ndarray) -> float:
    total = a.sum() + b.sum()
    return float(2 * (a & b).sum() / total) if total else 0.0


def boxes(mask: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Top, left, bottom and right of each eight-connected component, in reading order of their first pixel."""
    seen, out = np.zeros(mask.shape, bool), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x]:
            continue
        seen[y, x] = True
        queue, ys, xs = deque([(y, x)]), [], []
        while queue:
            cy, cx = queue.popleft()
            ys.append(cy), xs.append(cx)
            for ny in range(max(0, cy - 1), min(mask.shape[0], cy + 2)):
                for nx in range(max(0, cx - 1), min(mask.shape[1], cx + 2)):
                    if mask[ny, nx] and not seen[ny, nx]:
                        seen[ny, nx] = True
                        queue.append((ny, nx))
        out.append((int(min(ys)), int(min(xs)), int(max(ys)), int(max(xs))))
    return out


def bridged(row: np.ndarray, reach: int) -> np.ndarray:
    """Gaps of a scan line filled where lit pixels lie within the reach on both sides."""
    n = len(row)
    left = np.array([row[max(0, k - reach) : k + 1].any() for k in range(n)])
    right = np.array([row[k : k + reach + 1].any() for k in range(n)])
    return left & right


def runs(row: np.ndarray, hole: int = 0) -> list[tuple[int, int]]:
    """Lit runs (first, last) of a scan line, over holes of up to `hole`."""
    out: list[tuple[int, int]] = []
    for k in np.flatnonzero(row).tolist():
        if out and k - out[-1][1] <= hole + 1:
            out[-1] = (out[-1][0], k)
        else:
            out.append((k, k))
    return out


def sharpness(image: np.ndarray) -> tuple[float, float]:
    """Variance of the Laplacian, and mean brightness."""
    x = image.astype(float)
    lap = x[:-2, 1:-1] + x[2:, 1:-1] + x[1:-1, :-2] + x[1:-1, 2:] - 4 * x[1:-1, 1:-1]
    return float(lap.var()), float(x.mean())


def best_labelling(scores: np.ndarray, k: int = 1) -> list[tuple[float, tuple[int, ...]]]:
    """The k best one-to-one assignments of labels (columns) to clusters (rows), by trying all."""
    rows = range(len(scores))
    every = ((float(sum(scores[r, c] for r, c in zip(rows, p, strict=True))), p) for p in permutations(range(scores.shape[1]), len(scores)))
    return sorted(every, key=lambda x: (-x[0], x[1]))[:k]


def fill_gaps(values: list[tuple[float, int]], window: float) -> list[tuple[float, float, int]]:
    """Where v is followed by v + 2 within the window, what lies between is v + 1: (from, to, value)."""
    return [(a, b, v + 1) for (a, v), (b, w) in zip(values, values[1:], strict=False) if w == v + 2 and b - a <= window]


class Shapes:
    """Clusters of the stable shapes that frames show, frame by frame.

    A shape is stable in its `stable`th frame in a row; it belongs to the first cluster it is like, or makes one. The first cluster is the zero: back at it,
    all others are unseen again. Kept are the clusters with whether they were seen since, and the frame's own place: (current cluster, candidate, start, run).
    """

    def __init__(self, alike: float, stable: int = 1):
        self.alike, self.stable = alike, stable

    def push(self, clusters: dict[int, tuple[list[float], bool]], place: tuple, frame: int, x: np.ndarray) -> tuple[tuple, int | None]:
        """The next place, and the frame in which a shape began that hadn't been seen since the first one, if there's one now; changes clusters in place."""
        current, candidate, start, run = place
        x = x / max(float(np.linalg.norm(x)), 1e-12)
        if candidate is not None and float(np.dot(candidate, x)) >= self.alike:
            run += 1
        else:
            candidate, start, run = x.tolist(), frame, 1
        fresh = None
        if run == self.stable:
            own = next((k for k in sorted(clusters) if float(np.dot(clusters[k][0], candidate)) >= self.alike), None)
            if own is None:
                own = len(clusters)
                clusters[own] = candidate, False
            if own != current:
                current = own
                if own == 0:
                    for k, (c, _) in list(clusters.items()):
                        clusters[k] = c, k == 0
                elif not clusters[own][1]:
                    clusters[own] = clusters[own][0], True
                    fresh = start
        return (current, candidate, start, run), fresh


class ShapeRun:
    """`Shapes` over one long run of frames that comes in pieces, with equal results: a piece is compared with all clusters in one product of matrices, so only
    the frames that begin a candidate look at anything one by one, and what is held is the clusters."""

    def __init__(self, alike: float, stable: int = 1):
        self.alike, self.stable = alike, stable
        self.clusters, self.n, self.seen = np.zeros((16, 0)), 0, []
        self.current, self.candidate, self.start, self.run = None, None, 0, 0
        self.frames = 0

    def like(self, clusters: np.ndarray, x: np.ndarray, near: np.ndarray, first: int) -> int | None:
        """The first cluster that x is like; near: their products, of which those at the bound (but for rounding) are looked at anew."""
        for k in np.flatnonzero(near >= self.alike - 1e-9).tolist():
            if near[k] >= self.alike + 1e-9 or float(np.dot(clusters[k], x)) >= self.alike:
                return first + k
        return None

    def push(self, shapes: np.ndarray, piece: int = 256) -> tuple[list[int | None], list[int]]:
        """The cluster of the stable shape in each frame, and the frames in which a new shape began."""
        states, changes = [], []
        if not self.n:
            self.clusters = np.zeros((16, shapes.shape[1]))
        for at in range(0, len(shapes), piece):
            rows = [x / max(float(np.linalg.norm(x)), 1e-12) for x in shapes[at : at + piece]]
            old = self.n
            # A candidate from before this piece is not among its rows.
            near = np.stack(rows) @ self.clusters[:old].T
            place: int | None = None
            for k, x in enumerate(rows):
                if self.candidate is not None and float(np.dot(self.candidate, x)) >= self.alike:
                    self.run += 1
                else:
                    self.candidate, self.start, self.run, place = x, self.frames, 1, k
                if self.run == self.stable:
                    known = self.clusters[:old]
                    own = self.like(known, self.candidate, near[place] if place is not None else known @ self.candidate, 0)
                    if own is None and self.n > old:
                        new = self.clusters[old : self.n]
                        own = self.like(new, self.candidate, new @ self.candidate, old)
                    if own is None:
                        own = self.add(self.candidate)
                    if own != self.current:
                        self.current = own
                        if own == 0:
                            self.seen = [j == 0 for j in range(self.n)]
                        elif not self.seen[own]:
                            self.seen[own] = True
                            changes.append(self.start)
                states.append(self.current)
                self.frames += 1
        return states, changes

    def add(self, x: np.ndarray) -> int:
        if self.n == len(self.clusters):
            self.clusters = np.concatenate([self.clusters, np.zeros_like(self.clusters)])
        self.clusters[self.n] = x
        self.seen.append(False)
        self.n += 1
        return self.n - 1


def track_shapes(shapes: list[np.ndarray], alike: float, stable: int = 1) -> tuple[list[int | None], list[int]]:
    """The cluster of the stable shape in each frame (None before the first), and the frames in which a new shape began; see `Shapes`."""
    return ShapeRun(alike, stable).push(np.stack(shapes)) if len(shapes) else ([], [])


class FeedRows:
    """Rows of a feed seen in frames, given as (left, y, role): they only move up and keep their column; `frame` gives (first frame, role) of rows seen often enough.

    Frames are counted, not timed: a row is forgotten after `hold` frames without it. What is kept of a row is a plain tuple.
    """

    live = "first long, role string, left double, y double, last long, n long"
    found = {"first": "long", "role": "string"}

    def __init__(self, overlap: float, sightings: int, hold: int):
        self.overlap, self.sightings, self.hold = overlap, sightings, hold

    def kept(self, live: list[tuple], f: int) -> list[tuple]:
        return [x for x in live if f - x[4] <= self.hold]

    def frame(self, live: list[tuple], f: int, rows: list[tuple[float, float, str]]) -> tuple[list[tuple], list[tuple[int, str]]]:
        live, out = self.kept(live, f), []
        for left, y, role in rows:
            same = [k for k, x in enumerate(live) if x[1] == role and abs(x[2] - left) <= self.overlap and y <= x[3] + 1e-9 and x[4] < f]
            own = min(same, key=lambda k: (abs(live[k][2] - left), live[k][3] - y)) if same else None
            if own is None:
                own = len(live)
                live.append((f, role, left, y, f, 0))
            first, _, _, _, _, n = live[own]
            live[own] = first, role, left, y, f, n + 1
            if n + 1 == self.sightings:
                out.append((first, role))
        return live, out


def track_rows(frames: list[list[tuple[float, float, str]]], overlap: float, sightings: int, hold: int) -> list[tuple[int, str]]:
    """(first frame, role) of the rows of all frames; see `FeedRows`."""
    tracker, live, out = FeedRows(overlap, sightings, hold), [], []
    for f, rows in enumerate(frames):
        live, found = tracker.frame(live, f, rows)
        out += found
    return out


def plateaus(reads: list[int | None], least: int) -> list[tuple[int, int]]:
    """(first place, value) of stretches whose majority holds a value for `least` reads; unreadable ones are passed over."""
    seen = [(k, v) for k, v in enumerate(reads) if v is not None]
    out: list[tuple[int, int]] = []
    for i in range(len(seen) - least + 1):
        part = seen[i : i + least]
        value, n = Counter(v for _, v in part).most_common(1)[0]
        if n * 2 > least and part[0][1] == value and (not out or out[-1][1] != value):
            out.append((part[0][0], value))
    return out


def held_out_median_error(x: np.ndarray) -> tuple[float, float]:
    """Mean absolute error of the median of all others, and of no offset."""
    others = [abs(x[k] - np.median(np.delete(x, k))) for k in range(len(x))] if len(x) > 1 else [0.0]
    return float(np.mean(others)), float(np.mean(np.abs(x)))
