"""Numeric kernels on signals whose answer is known."""

import numpy as np
import pytest

from momentis.operators import kernels as k


def test_spectra():
    t = np.arange(1600) / 16000
    tone = np.sin(2 * np.pi * 1000 * t)
    assert np.argmax(k.power_spectrum(tone[:400])) == 25
    mel = k.log_mel(tone)
    assert mel.shape == (8, 64) and (mel.argmax(axis=1) == mel.argmax(axis=1)[0]).all()


def test_onsets_and_tempo():
    levels = np.zeros((400, 8))
    levels[::25] = 1.0
    onset = k.onset_envelope(levels)
    assert np.flatnonzero(onset).tolist() == list(range(25, 400, 25))
    assert k.tempo(onset, 50.0) == pytest.approx(120, abs=1)
    half = np.kron(np.eye(2), np.ones((20, 20)))
    assert np.argmax(k.novelty(half, 5)) == 20
    assert k.percussive_share(np.where(np.arange(30)[:, None] == 15, 1.0, 0.0) + np.zeros((30, 12)))[15] > 0.9
    assert k.locate(np.array([1.0, 0.9, 0.1]), np.array([0.0, 5.0, 6.0]), 5.0, 1.0) == 5.0
    a = np.random.default_rng(0).random(50)
    assert k.profile_shift(a, np.roll(a, -3), 6) == 3


def test_images():
    rng = np.random.default_rng(1)
    image = rng.random((20, 20))
    found = k.correlation(image, image[5:9, 7:12])
    assert np.unravel_index(found.argmax(), found.shape) == (5, 7) and found.max() == pytest.approx(1)
    mask = np.zeros((6, 8), bool)
    mask[0, 0] = mask[1, 1] = mask[4, 5:8] = True
    assert k.boxes(mask) == [(0, 0, 1, 1), (4, 5, 4, 7)]
    row = np.array([1, 0, 0, 1, 0, 0, 0, 0, 1], bool)
    assert k.bridged(row, 3).tolist()[:4] == [True] * 4 and not k.bridged(row, 2)[5]
    assert k.runs(row, 2) == [(0, 3), (8, 8)]
    assert k.sharpness(np.full((5, 5), 3))[0] == 0 and k.dice(mask, mask) == 1


def test_trackers():
    a, b = np.array([1.0, 0]), np.array([0, 1.0])
    assert k.track_shapes([a, b, b, a, b], 0.9) == ([0, 1, 1, 0, 1], [1, 4])  # back at the first, the other is new again
    assert k.track_shapes([a, a, b, a, b, b, b], 0.9, 2) == ([None, 0, 0, 0, 0, 1, 1], [4])
    frames = [[(0.0, 10.0, "kill")], [(0.0, 9.0, "kill")], [(0.0, 8.0, "kill"), (0.0, 10.0, "kill")], [(0.0, 9.0, "kill")]]
    assert k.track_rows(frames, 1, 2, 2)[0] == (0, "kill")
    assert k.plateaus([5, 5, None, 5, 4, 4, 4], 3) == [(0, 5), (4, 4)]
    assert k.fill_gaps([(0, 1), (2, 3), (9, 5)], 3) == [(0, 2, 2)]
    assert k.best_labelling(np.array([[1.0, 0.2, 0.1], [0.9, 0.8, 0.0]]))[0] == (pytest.approx(1.8), (0, 1))


def test_held_out_median():
    own, none = k.held_out_median_error(np.array([2.0, 2.1, 1.9, 2.0]))
    assert own < 0.2 < none


def test_a_run_of_shapes_in_pieces_equals_frame_by_frame():
    rng = np.random.default_rng(5)
    for stable in (1, 2, 3):
        seeds = np.round(rng.normal(size=(40, 4)) * 2)
        shapes = seeds[rng.integers(0, 40, 400).repeat(2)] + (rng.random((800, 1)) < 0.3) * rng.normal(size=(800, 4))
        tracker, clusters, place, states, changes = k.Shapes(0.8, stable), {}, (None, None, 0, 0), [], []
        for frame, x in enumerate(shapes):
            place, fresh = tracker.push(clusters, place, frame, x)
            states.append(place[0])
            changes += [fresh] if fresh is not None else []
        run = k.ShapeRun(0.8, stable)
        got = [run.push(shapes[a : a + 70], 32) for a in range(0, 800, 70)]
        assert ([s for g in got for s in g[0]], [c for g in got for c in g[1]]) == (states, changes) and len(clusters) > (16 if stable == 1 else 5)
