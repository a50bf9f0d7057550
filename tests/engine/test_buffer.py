"""The buffer's runs and the follower's against their plain steps."""

import numpy as np
import pytest

from arterion.functions.vitals import follow, Track
from arterion.streaming import buffer as b
from arterion.streaming.state import TrailingFrames


def wild(seed, n=1500, fps=30.0):
    """Frames with breaks, odd ones, steps of light and repeated times."""
    rng = np.random.default_rng(seed)
    steps = rng.choice([1 / fps, 1 / fps, 1 / fps, 1.2 / fps, 0.0, 0.7], n, p=[0.3, 0.3, 0.3, 0.09, 0.005, 0.005])
    x = 120 + rng.normal(0, 1, (n, 3)) + 0.3 * np.sin(np.cumsum(steps) * 7)[:, None]
    x[rng.random(n) < 0.01] += 40
    for at in rng.integers(0, n, 3):
        x[at:] += 25
    return np.column_stack([np.cumsum(steps), x])


@pytest.mark.parametrize("settings", [{}, {"window_s": 3.0}, {"fps": 10.0}, {"sigma": None}, {"patience": 3, "gap_s": 5.0}])
def test_runs_equal_plain_steps(settings):
    for seed in range(6):
        frames = wild(seed, 900, [30.0, 60.0, 24.0][seed % 3])
        plain = TrailingFrames(**settings)
        want = []
        for t, *rgb in frames:
            said = plain.push(t, rgb)
            want.append((said, len(plain.ts), plain.artifacts, plain.gaps, plain.adapted, plain.ready))
        runs = b.Buffer(b.Settings(**settings))
        got = []
        for part in np.array_split(frames, 7):  # over borders of batches
            s = runs.scan(part)
            got += list(zip(s.status, s.held, s.artifacts, s.gaps, s.adapted, (s.held > 1) & (s.span >= runs.settings.least_s)))
        assert got == want
        assert np.allclose(runs.rows[:, 0], plain.ts) and np.allclose(runs.rows[:, 1:], plain.rgb) and runs.end == sum(s != "ARTIFACT" for s, *_ in got)


def test_frames_from_before_are_taken_as_they_come():
    frames = wild(3, 400)
    frames[100:110, 0] -= 0.2
    plain, runs = TrailingFrames(), b.Buffer()
    want = [(plain.push(t, rgb), len(plain.ts)) for t, *rgb in frames]
    s = runs.scan(frames)
    assert list(zip(s.status, s.held)) == want


def test_following_equals_plain_steps():
    rng = np.random.default_rng(4)
    values = 70 + rng.normal(0, 2, 1200)
    values[rng.random(1200) < 0.05] += 60
    values[600:] += 30
    times = np.arange(1200.0)
    track, want = Track(), []
    for v, t in zip(values, times):
        track, smooth, out = follow(track, v, t)
        want.append((smooth, out))
    held, got = Track(), []
    for part, at in zip(np.array_split(values, 9), np.array_split(times, 9)):
        held, smooth, out = b.followed(held, part, at)
        got += list(zip(smooth, out))
    assert np.allclose([g[0] for g in got], [w[0] for w in want]) and [g[1] for g in got] == [w[1] for w in want] and np.allclose(held.values, track.values) and held.strikes == track.strikes
