"""The frames of a session that its signal is made of, and the followed level, many frames at a time.

A frame depends on the ones before it only through the window that is held.  So
a run of frames is judged at once as if all of them were taken, by prefix sums
within the window; the first odd one ends the run, is dealt with alone, and the
next run begins after it.  Breaks in time and odd frames are rare, so a frame
costs a few array operations' share, whatever the window holds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np

from arterion.functions.vitals import JUDGING, KEPT, LEAST_DEVIATION, RELOCK, TOO_FAR, Track

ACCEPTED, ARTIFACT, ADAPTED = "ACCEPTED", "ARTIFACT", "ADAPTED"
#: Frames that are judged together.
RUN = 512
JUDGED = 10
EDGE = 1e-6


class Settings(NamedTuple):
    window_s: float = 8.0
    least_s: float = 3.0
    fps: float = 30.0
    gap_s: float = 0.5
    sigma: float | None = 3.5
    patience: int = 10


def frame_rate(ts: np.ndarray, default: float) -> float:
    """Frames a second by the median positive step, within [5, 120]."""
    steps = np.diff(ts)
    steps = steps[steps > 0]
    return min(120.0, max(5.0, 1.0 / float(np.median(steps)))) if len(steps) else default


class Scanned(NamedTuple):
    """Of each frame what became of it, and the window after it: its size, its first place among all taken frames, span
    in seconds, and the counters."""

    status: np.ndarray
    held: np.ndarray
    first: np.ndarray
    span: np.ndarray
    artifacts: np.ndarray
    gaps: np.ndarray
    adapted: np.ndarray

    @property
    def taken(self) -> np.ndarray:
        return self.status != ARTIFACT


@dataclass
class Buffer:
    """The window that is held: rows (t, r, g, b, ...), the first of them being the ``first``-th frame ever taken."""

    settings: Settings = Settings()
    rows: np.ndarray = field(default_factory=lambda: np.empty((0, 4)))
    first: int = 0
    artifacts: int = 0
    in_a_row: int = 0
    gaps: int = 0
    adapted: int = 0

    @property
    def end(self) -> int:
        """Frames ever taken."""
        return self.first + len(self.rows)

    @property
    def span(self) -> float:
        return float(self.rows[-1, 0] - self.rows[0, 0]) if len(self.rows) > 1 else 0.0

    def counters(self) -> tuple[int, int, int, int]:
        return self.artifacts, self.in_a_row, self.gaps, self.adapted

    @property
    def ready(self) -> bool:
        return len(self.rows) > 1 and self.span >= self.settings.least_s

    def open(self) -> None:
        """Begins a new window."""
        self.first, self.rows = self.end, self.rows[:0]

    def scan(self, frames: np.ndarray) -> Scanned:
        """Takes ``frames``, rows (t, r, g, b) in their order; what columns follow these goes along."""
        n = len(frames)
        if not len(self.rows):
            self.rows = np.empty((0, frames.shape[1]))
        out = Scanned(np.full(n, ACCEPTED, object), *(np.zeros(n, t) for t in (np.int64, np.int64, float, np.int64, np.int64, np.int64)))
        at = 0
        while at < n:
            at = self._run(frames, at, min(n, at + RUN), out)
        return out

    def _note(self, out: Scanned, at: slice | int) -> None:
        out.artifacts[at], out.gaps[at], out.adapted[at] = self.artifacts, self.gaps, self.adapted

    def _run(self, frames: np.ndarray, at: int, end: int, out: Scanned) -> int:
        """Judges frames from ``at`` on up to the first that isn't plainly taken, or ``end``; where the next run begins."""
        s = self.settings
        if len(self.rows) and frames[at, 0] - self.rows[-1, 0] > s.gap_s:
            self.open()
            self.gaps, self.artifacts, self.in_a_row = self.gaps + 1, 0, 0
        steps = np.diff(frames[at:end, 0])
        broken = np.flatnonzero((steps > s.gap_s) | (steps < 0))
        if len(broken):
            end = at + int(broken[0]) + 1
        h, m = len(self.rows), end - at
        if h and frames[at, 0] < self.rows[-1, 0]:
            m = 1  # a frame from before: alone, as its window isn't sorted
        both = np.concatenate([self.rows, frames[at : at + m]])
        t, place = both[:, 0], np.arange(h, h + m)
        late = self._late(t, h, m)
        low = np.minimum(np.maximum.accumulate(late), place - 1).clip(0)
        before = np.concatenate([[0], low[:-1]])  # where the window of each frame begins when it comes
        m = self._uncapped(t, before, place, late)
        strange = self._strange(both, before[: max(m, 1)], place[: max(m, 1)])
        odd = np.flatnonzero(strange)
        if len(odd) or not m:
            return self._alone(both, h, low, int(odd[0]) if len(odd) else 0, at, bool(len(odd)), out)
        self._take(both, h, low, m, at, out)
        return at + m

    def _late(self, t: np.ndarray, h: int, m: int) -> np.ndarray:
        """How many of the first frames lie beyond the window of each of the ``m`` new ones."""
        if h and m == 1 and t[h] < t[h - 1]:
            kept = t[h] - t[:h] <= self.settings.window_s + EDGE
            return np.array([int(kept.argmax()) if kept.any() else h])
        found = np.searchsorted(t, t[h : h + m] - (self.settings.window_s + EDGE), "left")
        # The difference itself decides, as in the definition: rounding may move a border by one.
        found -= (found > 0) & (t[h : h + m] - t[np.maximum(found - 1, 0)] <= self.settings.window_s + EDGE)
        return found + (t[h : h + m] - t[np.minimum(found, len(t) - 1)] > self.settings.window_s + EDGE)

    def _uncapped(self, t: np.ndarray, before: np.ndarray, place: np.ndarray, late: np.ndarray) -> int:
        """How many of the new frames leave no more in the window than its rate gives it, once late ones have gone."""
        s = self.settings
        nominal = math.ceil(s.window_s * s.fps)
        held = place + 1 - before
        for k in np.flatnonzero((held > nominal) & (held - np.maximum(late - before, 0) > nominal)).tolist():
            if held[k] - max(int(late[k] - before[k]), 0) > math.ceil(s.window_s * frame_rate(t[before[k] : place[k] + 1], s.fps)):
                return k
        return len(place)

    def _strange(self, both: np.ndarray, before: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Of each new frame, whether two channels or more are far from the window that it meets."""
        sigma = self.settings.sigma
        if sigma is None:
            return np.zeros(len(place), bool)
        off = both[:, 1:4] - both[0, 1:4]
        sums = np.concatenate([np.zeros((1, 6)), np.cumsum(np.concatenate([off, off * off], axis=1), axis=0)])
        n = place - before
        part = (sums[place] - sums[before]) / np.maximum(n, 1)[:, None]
        spread = np.maximum(np.sqrt(np.maximum(part[:, 3:] - part[:, :3] ** 2, 0.0)), EDGE)
        return (n >= JUDGED) & ((np.abs(off[place] - part[:, :3]) / spread > sigma).sum(axis=1) > 1)

    def _take(self, both: np.ndarray, h: int, low: np.ndarray, m: int, at: int, out: Scanned) -> None:
        """The first ``m`` new frames join the window."""
        if not m:
            return
        where, place, low = slice(at, at + m), np.arange(h, h + m), low[:m]
        self.in_a_row = 0
        self._note(out, where)
        out.held[where], out.first[where] = place + 1 - low, self.first + low
        out.span[where] = both[place, 0] - both[low, 0]
        self.first, self.rows = self.first + int(low[-1]), both[low[-1] : h + m]

    def _alone(self, both: np.ndarray, h: int, low: np.ndarray, k: int, at: int, strange: bool, out: Scanned) -> int:
        """Takes the ``k`` frames before a frame that needs a look of its own, and then that one."""
        s, frame = self.settings, both[h + k]
        self._take(both, h, low, k, at, out)
        self.artifacts += strange
        self.in_a_row = self.in_a_row + 1 if strange else 0
        where = at + k
        if strange and self.in_a_row < s.patience:
            out.status[where] = ARTIFACT
        else:
            if strange:
                self.open()
                self.adapted, self.in_a_row = self.adapted + 1, 0
                out.status[where] = ADAPTED
            self.rows = np.concatenate([self.rows, frame[None]])
            held, nominal = len(self.rows), math.ceil(s.window_s * s.fps)
            if held > nominal:
                nominal = max(nominal, math.ceil(s.window_s * frame_rate(self.rows[:, 0], s.fps)))
            near = frame[0] - self.rows[:, 0] <= s.window_s + EDGE
            go = max(0, min(max(int(near.argmax()), held - nominal), held - 2))
            self.first, self.rows = self.first + go, self.rows[go:]
        self._note(out, where)
        out.held[where], out.first[where], out.span[where] = len(self.rows), self.first, self.span
        return where + 1


def followed(track: Track, values: np.ndarray, times: np.ndarray) -> tuple[Track, np.ndarray, np.ndarray]:
    """(track, smoothed, left out) after all ``values``, as one step after another would give."""
    n = len(values)
    smooth, out = np.empty(n), np.zeros(n, bool)
    at = 0
    while at < n:
        h, end = len(track.values), min(n, at + RUN)
        both = np.concatenate([track.values, values[at:end]])
        place = np.arange(h, len(both))
        size = np.minimum(place, KEPT)
        window = place[:, None] - KEPT + np.arange(KEPT)
        seen = np.where(window >= 0, both[np.maximum(window, 0)], np.inf)
        rows = np.arange(len(place))
        middle = lambda x: (x[rows, (size - 1) // 2] + x[rows, size // 2]) / 2
        level = middle(np.sort(seen, axis=1))
        with np.errstate(invalid="ignore"):
            spread = middle(np.sort(np.where(window >= 0, np.abs(seen - level[:, None]), np.inf), axis=1))
            far = (size >= JUDGING) & (np.abs(both[place] - level) > TOO_FAR * np.maximum(1.4826 * spread, LEAST_DEVIATION))
        hit = np.flatnonzero(far)
        k = int(hit[0]) if len(hit) else len(place)
        level_now = track.smooth
        for j in range(k):
            level_now = both[h + j] if level_now is None else (both[h + j] + level_now) / 2.0
            smooth[at + j] = level_now
        if k:
            all_times = np.concatenate([track.times, times[at : at + k]])
            track = Track(tuple(both[: h + k][-KEPT:].tolist()), tuple(all_times[-KEPT:].tolist()), level_now, 0)
        at += k
        if at < end:  # a far one
            strikes = track.strikes + 1
            if strikes < RELOCK:
                track, smooth[at], out[at] = track._replace(strikes=strikes), track.smooth, True
            else:
                track = Track((float(values[at]),), (float(times[at]),), float(values[at]), strikes)
                smooth[at] = track.smooth
            at += 1
    return track, smooth, out
