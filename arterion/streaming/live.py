"""Live measurement of sessions: frames in; status, warnings and gate of each frame out, and vitals once a second.

A batch of a session's frames is taken at once: runs with and without a face,
light and motion as windows over sorted times, the signal's windows by
:mod:`arterion.streaming.buffer`.  Only what is scored, a window's wave, is made
window by window.  The stream keeps the windows' rows as typed map state, of
which a batch writes what is new, and a few marks; event-time timers tell a
session that fell silent: after LOST_S its face counts as lost, after IDLE_S it
ends and its state goes.  A row whose ``control`` is "reset" begins it anew.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from arterion.functions import dsp, quality, rppg, vitals
from arterion.operators import frames as fixed
from arterion.streaming.buffer import Buffer, frame_rate, Scanned, Settings
from arterion.streaming.processors import Chunks, needs_store, STORE

__all__ = ["IDLE_S", "IN", "OUT", "STORE", "Session", "measure_live", "sessions", "stream_live"]

LOST_S, IDLE_S, SLOW_FPS, SLOW_FRAMES, EVERY_S, LONG_S, LONG_LEAST_S = 1.0, 1800.0, 20.0, 15, 1.0, 60.0, 8.0
IN = ("t", "r", "g", "b", "x", "y", "w", "h", "frame_w", "luma")
REGIONS = ("forehead", "left_cheek", "right_cheek")
_REGION_COLUMNS = tuple(f"{n}_{c}" for n in REGIONS for c in "rgb")
_NUMBERS = (*IN, *_REGION_COLUMNS)
T, R, X, W, FRAME_W, LUMA, REGION = 0, 1, 4, 6, 8, 9, 10
OUT = (
    "session_id long, t double, status string, warnings array<string>, state string, reasons array<string>, sqi double, progress double, luma double, agreement double, "
    "vitals array<struct<code:string,value:double,unit:string,status:string,quality:double,confidence:double,issues:array<string>,failure:string>>"
)
_VITAL = ("code", "value", "unit", "status", "quality", "confidence", "issues", "failure")


@dataclass
class Trail:
    """Rows (t, ...) of a trailing span; ``first``: how many have left it."""

    seconds: float
    width: int
    least: int = 1
    first: int = 0
    rows: np.ndarray = None

    def __post_init__(self) -> None:
        self.rows = np.empty((0, self.width)) if self.rows is None else self.rows

    @property
    def end(self) -> int:
        return self.first + len(self.rows)

    def clear(self) -> None:
        self.first, self.rows = self.end, self.rows[:0]

    def windows(self, new: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Adds ``new``; (all rows, first of each new row's window, last + 1), and lets go of what no later window has."""
        both = np.concatenate([self.rows, new])
        last = np.arange(len(self.rows), len(both)) + 1
        low = np.searchsorted(both[:, 0], new[:, 0] - self.seconds, "left")
        if len(both):
            go = min(int(np.searchsorted(both[:, 0], both[-1, 0] - self.seconds, "left")), max(0, len(both) - self.least))
            self.first, self.rows = self.first + go, both[go:]
        return both, low, last


def _over(x: np.ndarray, low: np.ndarray, last: np.ndarray, fill: float) -> np.ndarray:
    """The values of each window as a row, ``fill`` where it is shorter than the longest."""
    at = low[:, None] + np.arange(int((last - low).max(initial=0)))
    return np.where(at < last[:, None], x[np.minimum(at, len(x) - 1)], fill)


@dataclass
class Session:
    """One session.  ``method`` names the projection; frames come in order of time."""

    method: str = "POS"
    # A face may be lost for LOST_S without an end of the window.
    short: Buffer = field(default_factory=lambda: Buffer(Settings(gap_s=max(0.5, LOST_S))))
    long: Buffer = field(default_factory=lambda: Buffer(Settings(window_s=LONG_S, least_s=LONG_LEAST_S, sigma=None)))
    light: Trail = field(default_factory=lambda: Trail(fixed.LIGHT_S, 2, fixed.LIGHT_FRAMES))
    place: Trail = field(default_factory=lambda: Trail(fixed.MOTION_S, 4))
    dropped: Trail = field(default_factory=lambda: Trail(LONG_S, 2))
    since: float | None = None
    scored: float | None = None
    rejected: float | None = None
    computed: float | None = None
    gate: tuple[str, list[str]] = ("ACCEPTED", [])
    agreement: float | None = None
    vitals: vitals.Session = field(default_factory=vitals.Session)

    def __post_init__(self) -> None:
        self.project = rppg.method(self.method)

    # --- a batch of frames

    def advance(self, frames: np.ndarray) -> list[dict]:
        """Takes ``frames``, rows of _NUMBERS by time; what is to say of each."""
        if not len(frames):
            return []
        face = ~np.isnan(frames[:, [R, X]]).any(axis=1)
        borders = np.flatnonzero(np.diff(face)) + 1
        out: list[dict] = []
        for run in np.split(np.arange(len(frames)), borders):
            out += self._seen(frames[run]) if face[run[0]] else self._unseen(frames[run, T])
        return out

    def _said(self, t: float, status: str, warnings: list[str], **more: object) -> dict:
        return {"t": t, "status": status, "warnings": warnings, "state": None, "reasons": [], "sqi": None, "progress": 0.0, "luma": None, "agreement": None, "vitals": None} | more

    def _unseen(self, t: np.ndarray) -> list[dict]:
        """Frames without a face; beyond LOST_S the signal begins anew."""
        self.since = float(t[0]) if self.since is None else self.since
        progress = self._progress(self.short.span)
        over = t - self.since > LOST_S
        if over.any():
            self._forget()
        self.dropped.windows(np.column_stack([t, np.ones(len(t))]))
        return [self._said(float(x), "FACE_LOST", ["FACE_NOT_FOUND"], progress=0.0 if gone else progress) for x, gone in zip(t, over, strict=True)]

    def _forget(self) -> None:
        self.short.open()
        self.short = Buffer(self.short.settings, first=self.short.first)
        self.light.clear()
        self.place.clear()
        self._unscore()

    def _unscore(self) -> None:
        self.scored, self.gate, self.agreement = None, ("ACCEPTED", []), None

    def _progress(self, span: float) -> float:
        return min(1.0, max(0.0, span / self.short.settings.window_s))

    def _seen(self, frames: np.ndarray) -> list[dict]:
        self.since = None
        smooth, unstable = self._lit(frames[:, T], frames[:, LUMA])
        moving, jumped = self._moved(frames)
        out: list[dict] = []
        for part in np.split(np.arange(len(frames)), np.flatnonzero(jumped)):
            if len(part):
                if jumped[part[0]]:
                    self.short.open()
                    self.short = Buffer(self.short.settings, first=self.short.first)
                    self._unscore()
                out += self._signal(frames[part], smooth[part], unstable[part], moving[part])
        return out

    def _lit(self, t: np.ndarray, luma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(median of the last measured levels, does the light vary) of each frame."""
        smooth, unstable = np.zeros(len(t)), np.zeros(len(t), bool)
        some = np.flatnonzero(luma > 0)
        if len(some):
            both, low, last = self.light.windows(np.column_stack([t[some], luma[some]]))
            smooth[some] = np.nanmedian(_over(both[:, 1], np.maximum(last - fixed.LIGHT_FRAMES, 0), last, np.nan), axis=1)
            level = _over(both[:, 1], low, last, np.nan)
            mean, n = np.nanmean(level, axis=1), last - low
            wide = (n >= fixed.LIGHT_LEAST) & (both[last - 1, 0] - both[low, 0] >= fixed.LIGHT_S / 2) & (mean > 1e-6)
            unstable[some] = wide & (np.nanstd(level, axis=1) / np.maximum(mean, 1e-6) > fixed.UNSTABLE)
        # Frames without a measurement see the light as it was.
        seen = np.searchsorted(some, np.arange(len(t)), "right") - 1
        unmeasured = ~(luma > 0)
        unstable[unmeasured & (seen >= 0)] = unstable[some[seen[unmeasured & (seen >= 0)]]] if len(some) else False
        return smooth, unstable

    def _moved(self, frames: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(does the face move much, has its box jumped) of each frame."""
        moving, jumped = np.zeros(len(frames), bool), np.zeros(len(frames), bool)
        some = np.flatnonzero(frames[:, W] > 0)
        new = np.column_stack([frames[some, T], frames[some, X : X + 2] + frames[some, W : W + 2] / 2, frames[some, W]])
        chain = np.concatenate([self.place.rows[-1:], new])
        far = np.hypot(*np.diff(chain[:, 1:3], axis=0).T) > fixed.JUMP * np.maximum(chain[1:, 3], chain[:-1, 3])
        far = far if len(self.place.rows) else np.concatenate([[False], far])[: len(new)]
        for part in np.split(np.arange(len(new)), np.flatnonzero(far)):
            if not len(part):
                continue
            if far[part[0]]:
                self.place.clear()
            both, low, last = self.place.windows(new[part])
            reach = [_over(both[:, k], low, last, -np.inf).max(axis=1) - _over(both[:, k], low, last, np.inf).min(axis=1) for k in (1, 2)]
            width = np.nanmean(_over(both[:, 3], low, last, np.nan), axis=1)
            moving[some[part]] = (last - low >= fixed.MOTION_LEAST) & (np.maximum(*reach) / np.maximum(width, 1e-6) > fixed.AMPLITUDE)
        jumped[some[far]] = True
        return moving | jumped, jumped

    # --- the signal's windows

    def _signal(self, frames: np.ndarray, smooth: np.ndarray, unstable: np.ndarray, moving: np.ndarray) -> list[dict]:
        """Frames with a face between two jumps of its box."""
        before, gaps, adapted, start = self.short.rows, self.short.gaps, self.short.adapted, self.short.first
        centre = frames[:, X : X + 2] + frames[:, W : W + 2] / 2
        rows = np.column_stack([frames[:, T : R + 3], centre, frames[:, REGION:]])
        scan = self.short.scan(rows)
        taken = scan.taken
        every = np.concatenate([before.reshape(-1, rows.shape[1]), rows[taken]])  # from number ``start`` on
        end = start + len(before) + np.cumsum(taken)
        new_gap, new_level = np.diff(scan.gaps, prepend=gaps) > 0, np.diff(scan.adapted, prepend=adapted) > 0
        kept = np.column_stack([rows[:, :4], rows[:, 6:]])[taken]
        held, at = self.long.rows, self.long.first
        long = self.long.scan(kept) if len(kept) else None
        longer = np.concatenate([held.reshape(-1, kept.shape[1]), kept])
        lost, low, last = self.dropped.windows(np.column_stack([frames[:, T], ~taken]))
        share = np.nanmean(_over(lost[:, 1], low, last, np.nan), axis=1)
        out, n_taken = [], 0
        for k in range(len(frames)):
            t = float(frames[k, T])
            window = every[scan.first[k] - start : end[k] - start]
            warnings = self._warnings(frames[k], smooth[k], unstable[k], moving[k], new_gap[k], window)
            if new_gap[k] or new_level[k]:
                self._unscore()
            said = {"progress": self._progress(scan.span[k]), "luma": float(smooth[k])}
            if not taken[k]:
                out.append(self._said(t, "ARTIFACT", warnings, **said))
                continue
            n_taken += 1
            if scan.held[k] < 2 or scan.span[k] < self.short.settings.least_s:
                out.append(self._said(t, "BUFFERING", warnings, **said))
                continue
            row = self._scored(t, warnings, window, scan, k) | said
            place = n_taken - 1
            if long is not None and row["state"] != "REJECTED" and long.held[place] > 1 and long.span[place] >= LONG_LEAST_S and (self.computed is None or t - self.computed >= EVERY_S):
                self.computed = t
                row["vitals"] = self._vitals(longer[long.first[place] - at : len(held) + n_taken], row, t, float(share[k]))
            out.append(row)
        return out

    def _warnings(self, frame: np.ndarray, smooth: float, unstable: bool, moving: bool, gap: bool, window: np.ndarray) -> list[str]:
        slow = len(window) >= SLOW_FRAMES and frame_rate(window[:, 0], self.short.settings.fps) < SLOW_FPS
        small = frame[FRAME_W] > 0 and 0 < frame[W] / frame[FRAME_W] < fixed.SMALL
        marks = ((small, "FACE_TOO_SMALL"), (0 < smooth < fixed.DARK, "TOO_DARK"), (smooth > fixed.BRIGHT, "TOO_BRIGHT"), (unstable, "LIGHT_UNSTABLE"), (moving, "MOTION_HIGH"), (gap, "TIME_GAP"), (slow, "LOW_FPS"))
        return [code for yes, code in marks if yes]

    def _even(self, window: np.ndarray) -> tuple[np.ndarray, float]:
        """(the window's columns on even steps of time, their rate)."""
        rate = frame_rate(window[:, 0], self.short.settings.fps)
        return dsp.resample_uniform(window[:, 0], window[:, 1:], rate)[1], rate

    def _scored(self, t: float, warnings: list[str], window: np.ndarray, scan: Scanned, k: int) -> dict:
        x, fs = self._even(window[:, :4])
        wave = self.project(x, fs)
        sqi = quality.sqi(wave, fs)
        if self.scored is None or not 0 <= t - self.scored < EVERY_S:
            self.scored = t
            self._judge(t, wave, fs, sqi, window, int(scan.artifacts[k]))
        state, reasons = self.gate
        codes = list(dict.fromkeys([*warnings, *reasons]))
        ok = sqi >= fixed.LEAST_SQI and state != "REJECTED" and not any(fixed.SEVERITIES.get(c) == "block" for c in codes)
        return self._said(t, "OK" if ok else "LOW_QUALITY", codes, state=state, reasons=list(reasons), sqi=sqi, agreement=self.agreement)

    def _judge(self, t: float, wave: np.ndarray, fs: float, sqi: float, window: np.ndarray, artifacts: int) -> None:
        """The gate of the window, with its hold after a rejection, and how far the regions agree."""
        regions = window[:, 6:]
        self.agreement = None if np.isnan(regions).any() else float(quality.cross_roi({n: regions[:, 3 * k : 3 * k + 3] for k, n in enumerate(REGIONS)}, fs)["r_mean"])
        seen = {
            "artifact_ratio": artifacts / max(1, len(window) + artifacts), "snr": sqi, "periodicity": quality.periodicity(wave, fs)[0],
            "motion_score": quality.motion(window[:, 4:6], fs) if len(window) >= max(10, int(2 * fs)) else 0.0,
        }
        if self.agreement is not None:
            seen["r_mean"] = self.agreement
        far = {">": np.greater, "<": np.less}
        short = len(wave) < self.short.settings.least_s * fs
        reasons = ["WINDOW_TOO_SHORT"] if short else [code for code, (name, side, bound) in fixed.GATE.items() if name in seen and far[side](seen[name], bound)]
        if len(reasons) > 1 or {"WINDOW_TOO_SHORT", "HIGH_ARTIFACT"} & set(reasons):
            self.rejected = t
        held = self.rejected is not None and t - self.rejected < fixed.HOLD_S
        self.gate = ("REJECTED" if held else "SUSPICIOUS" if reasons else "ACCEPTED", reasons)

    def _vitals(self, window: np.ndarray, row: dict, t: float, missing: float) -> list[dict]:
        """The vitals of the long window: its wave, and those of the regions if they are there."""
        x, fs = self._even(window[:, :4])
        wave = self.project(x, fs)
        level = dsp.linear_detrend(-(x[:, 1] / max(float(x[:, 1].mean()), 1e-12) - 1.0))
        waves = {}
        if not np.isnan(window[:, 4:]).any():
            y, _ = self._even(window[:, [0, *range(4, window.shape[1])]])
            waves = {n: self.project(y[:, 3 * k : 3 * k + 3], fs) for k, n in enumerate(REGIONS)}
        w = vitals.Window(wave, fs, t - len(wave) / fs, min(1.0, max(0.0, row["sqi"])), missing, level, waves, self.agreement, tuple(row["warnings"]))
        return [{k: v[k] for k in _VITAL} for v in self.vitals.measure(w)]


def _numbers(frames: DataFrame) -> DataFrame:
    """(session_id, control, _NUMBERS): region colours come from ``roi``, a map of arrays (r, g, b), if there is one."""
    roi = lambda n, k: F.get(F.col("roi")[n], F.lit(k)) if "roi" in frames.columns else F.lit(None)
    regions = [roi(n, k).cast("double").alias(f"{n}_{c}") for n in REGIONS for k, c in enumerate("rgb")]
    control = F.col("control") if "control" in frames.columns else F.lit(None).cast("string")
    return frames.select("session_id", control.alias("control"), *[F.col(c).cast("double").alias(c) for c in IN], *regions)


def _table(session: int, rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([{"session_id": session} | r for r in rows], columns=_OUT_COLUMNS)


_OUT_COLUMNS = ["session_id", "t", "status", "warnings", "state", "reasons", "sqi", "progress", "luma", "agreement", "vitals"]


def _steps(session: Session, frames: pd.DataFrame, method: str) -> tuple[Session, list[dict]]:
    """What is to say of ``frames``, by time; a control row "reset" begins a new session."""
    frames = frames.sort_values("t", kind="stable")
    out: list[dict] = []
    resets = np.flatnonzero((frames["control"] == "reset").to_numpy())
    values = frames[list(_NUMBERS)].to_numpy(float)
    for k, part in enumerate(np.split(np.arange(len(frames)), resets)):
        if k:
            session = Session(method)
            out.append(session._said(float(values[part[0], T]), "RESET", []))
            part = part[1:]
        out += session.advance(values[part])
    return session, out


def measure_live(frames: DataFrame, method: str = "POS") -> DataFrame:
    """Batch form over frames (session_id, IN, and ``roi`` if regions are known; face columns null where there is none).

    One shuffle, sorted; what a session has left is carried over the borders of batches, so a task holds a batch and the
    windows.
    """
    rppg.method(method)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, session = None, Session(method)
        for pdf in batches:
            for key, part in pdf.groupby("session_id", sort=False):
                if key != name:
                    name, session = key, Session(method)
                session, rows = _steps(session, part, method)
                yield _table(int(key), rows)

    return _numbers(frames).repartition("session_id").sortWithinPartitions("session_id", "t").mapInPandas(run, OUT)


class LiveProcessor(StatefulProcessor):
    """Streaming form.  With ``late`` "drop", frames older than the last one taken are left out; with "accept" they are
    taken as they come."""

    #: The windows kept as rows, and their widths.
    KEPT = {"short": 15, "long": 13, "light": 2, "place": 4, "dropped": 2}

    def __init__(self, method: str = "POS", late: str = "drop"):
        self.method, self.late = method, late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = {k: Chunks(handle, k, w) for k, w in self.KEPT.items()}
        bounds = ", ".join(f"{k}_first long, {k}_end long" for k in self.KEPT)
        counters = ", ".join(f"{k}_{c} int" for k in ("short", "long") for c in ("artifacts", "in_a_row", "gaps", "adapted"))
        self.marks = handle.getValueState("marks", f"last double, since double, scored double, rejected double, computed double, state string, reasons array<string>, agreement double, tracks string, {bounds}, {counters}")

    def _restored(self) -> tuple[Session, float | None, dict[str, tuple[int, int]]]:
        session = Session(self.method)
        if not self.marks.exists():
            return session, None, dict.fromkeys(self.KEPT, (0, 0))
        last, session.since, session.scored, session.rejected, session.computed, state, reasons, session.agreement, tracks, *numbers = self.marks.get()
        session.gate = (state, list(reasons))
        session.vitals.tracks = {k: vitals.Track(tuple(v[0]), tuple(v[1]), v[2], v[3]) for k, v in json.loads(tracks).items()}
        bounds = {k: (numbers[2 * i], numbers[2 * i + 1]) for i, k in enumerate(self.KEPT)}
        counters = numbers[2 * len(self.KEPT) :]
        for k, (first, end) in bounds.items():
            held = getattr(session, k)
            held.first, held.rows = first, self.kept[k].read(first, end)
        for i, buffer in enumerate((session.short, session.long)):
            buffer.artifacts, buffer.in_a_row, buffer.gaps, buffer.adapted = counters[4 * i : 4 * i + 4]
        return session, last, bounds

    def _save(self, session: Session, last: float, was: dict[str, tuple[int, int]]) -> None:
        bounds: list[int] = []
        for k, (first, end) in was.items():
            held = getattr(session, k)
            if held.first < first or held.end < end:  # begun anew: numbers go on, so that no chunk is mistaken for an old one
                held.first += end
            self.kept[k].write((first, end), held.first, held.rows)
            bounds += [held.first, held.end]
        state, reasons = session.gate
        self.marks.update((last, session.since, session.scored, session.rejected, session.computed, state, list(reasons), session.agreement, json.dumps(session.vitals.tracks), *bounds, *session.short.counters(), *session.long.counters()))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        session, last, was = self._restored()
        pdf = pd.concat(list(rows))
        if self.late == "drop" and last is not None:
            pdf = pdf[pdf["t"] >= last]
        if len(pdf):
            session, out = _steps(session, pdf, self.method)
            last = float(pdf["t"].max()) if last is None else max(last, float(pdf["t"].max()))
            self._save(session, last, was)
            self._timer(last + LOST_S)
            yield _table(int(key[0]), out)
        else:
            yield _table(int(key[0]), [])

    def _timer(self, at: float) -> None:
        """The one timer that the session has, at ``at`` seconds."""
        for (other,) in [(x[0],) if isinstance(x, tuple) else (x,) for x in self.handle.listTimers()]:
            self.handle.deleteTimer(other)
        self.handle.registerTimer(math.ceil(at * 1000))

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        """Silence: the face is lost after LOST_S, the session ends after IDLE_S."""
        session, last, was = self._restored()
        at = expiredTimerInfo.getExpiryTimeInMs() / 1000
        if last is None:
            yield _table(int(key[0]), [])
        elif at >= last + IDLE_S:
            for held in self.kept.values():
                held.map.clear()
            self.marks.clear()
            yield _table(int(key[0]), [session._said(at, "EXPIRED", [])])
        else:
            session.since = last if session.since is None else session.since
            session._forget()
            self._save(session, last, was)
            self._timer(last + IDLE_S)
            yield _table(int(key[0]), [session._said(at, "FACE_LOST", ["FACE_NOT_FOUND"])])

    def close(self) -> None:
        pass


def stream_live(spark: SparkSession, frames: DataFrame, method: str = "POS", late: str = "drop", delay: str = "1 second") -> DataFrame:
    """``frames``, streaming, through the processor.  ``t`` is event time, in seconds; silence is told by the watermark,
    which stays ``delay`` behind the newest frame of any session.  Frames that come later than that are left out."""
    needs_store(spark)
    # A millisecond later than the frame, as Spark takes what equals the watermark, 0 at first, for late.
    timed = _numbers(frames).withColumn("at", F.timestamp_micros((F.col("t") * 1_000_000).cast("long") + 1000)).withWatermark("at", delay)
    return timed.groupBy("session_id").transformWithStateInPandas(statefulProcessor=LiveProcessor(method, late), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


def sessions(frames: DataFrame, now: float) -> DataFrame:
    """(session_id, first, last, frames, expired): the sessions there are; one without a frame for half an hour has expired."""
    out = frames.groupBy("session_id").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("frames"))
    return out.withColumn("expired", F.lit(now) - F.col("last") > IDLE_S)
