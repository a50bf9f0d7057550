"""State of one session, one frame at a time: pure steps that batch folds and streams share."""

from __future__ import annotations

import itertools
import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from arterion.functions import dsp


class TrailingFrames:
    """The frames of a session that its signal is made of: those of a trailing window, without breaks or odd ones.

    A break in time starts a new window.  A frame that is far off in two of three channels is odd and left out; the
    ``patience``-th in a row is the first of a new window, as the light has changed.  Running sums about the window's
    first frame give means and deviations, so a frame costs the same whatever the window holds.
    """

    def __init__(self, window_s: float = 8.0, least_s: float = 3.0, fps: float = 30.0, gap_s: float = 0.5, sigma: float | None = 3.5, patience: int = 10):
        self.settings = {"window_s": window_s, "least_s": least_s, "fps": fps, "gap_s": gap_s, "sigma": sigma, "patience": patience}
        self.artifacts = self.in_a_row = self.gaps = self.adapted = 0
        self._open()

    def _open(self) -> None:
        self.ts, self.rgb = deque(), deque()
        self.origin, self.sums = np.zeros(3), np.zeros((2, 3))

    def _count(self, rgb: np.ndarray, sign: int) -> None:
        off = rgb - self.origin
        self.sums += sign * np.stack([off, off * off])

    def _hold(self, t: float, rgb: np.ndarray) -> None:
        if not self.ts:
            self.origin = rgb
        self.ts.append(t)
        self.rgb.append(rgb)
        self._count(rgb, 1)

    def deviation(self, rgb: np.ndarray) -> np.ndarray:
        """Standard deviations from the window's mean, by channel."""
        mean, square = self.sums / len(self.ts)
        return np.abs(rgb - self.origin - mean) / np.maximum(np.sqrt(np.maximum(square - mean * mean, 0.0)), 1e-6)

    def rate(self) -> float:
        """Frames a second by the median positive step, within [5, 120]; as it is set without steps."""
        steps = np.diff(np.fromiter(self.ts, float, len(self.ts)))
        steps = steps[steps > 0]
        return min(120.0, max(5.0, 1.0 / float(np.median(steps)))) if len(steps) else self.settings["fps"]

    def push(self, t: float, rgb: tuple[float, float, float]) -> str:
        """ACCEPTED, ARTIFACT or ADAPTED."""
        s, rgb = self.settings, np.asarray(rgb, float)
        if self.ts and t - self.ts[-1] > s["gap_s"]:
            self._open()
            self.gaps, self.artifacts, self.in_a_row = self.gaps + 1, 0, 0
        strange = s["sigma"] is not None and len(self.ts) >= 10 and int((self.deviation(rgb) > s["sigma"]).sum()) > 1
        self.artifacts += strange
        self.in_a_row = (self.in_a_row + 1) if strange else 0
        if strange and self.in_a_row < s["patience"]:
            return "ARTIFACT"
        if strange:
            self._open()
            self.adapted, self.in_a_row = self.adapted + 1, 0
        self._hold(t, rgb)
        self._trim(t)
        return "ADAPTED" if strange else "ACCEPTED"

    def _trim(self, t: float) -> None:
        """Lets go of frames beyond the window, and beyond as many as its rate gives it; two stay."""
        s = self.settings
        nominal = math.ceil(s["window_s"] * s["fps"])
        if len(self.ts) > nominal:
            nominal = max(nominal, math.ceil(s["window_s"] * self.rate()))
        late = sum(1 for _ in itertools.takewhile(lambda x: t - x > s["window_s"] + 1e-6, self.ts))
        for _ in range(min(max(late, len(self.ts) - nominal), len(self.ts) - 2)):
            self.ts.popleft()
            self._count(self.rgb.popleft(), -1)

    @property
    def span(self) -> float:
        return self.ts[-1] - self.ts[0] if len(self.ts) > 1 else 0.0

    @property
    def ready(self) -> bool:
        return len(self.ts) > 1 and self.span >= self.settings["least_s"]

    @property
    def progress(self) -> float:
        """The part of the window that is filled."""
        return min(1.0, max(0.0, self.span / self.settings["window_s"]))

    def resampled(self) -> tuple[np.ndarray, float]:
        """(the window's frames on even steps, their rate)."""
        rate = self.rate()
        _, x = dsp.resample_uniform(np.fromiter(self.ts, float, len(self.ts)), np.array(self.rgb), rate)
        return x, rate

    def saved(self) -> dict:
        return {"settings": self.settings, "counts": [self.artifacts, self.in_a_row, self.gaps, self.adapted], "ts": list(self.ts), "rgb": [x.tolist() for x in self.rgb]}

    @classmethod
    def restored(cls, held: dict) -> TrailingFrames:
        out = cls(**held["settings"])
        out.artifacts, out.in_a_row, out.gaps, out.adapted = held["counts"]
        for t, rgb in zip(held["ts"], held["rgb"], strict=True):
            out._hold(t, np.array(rgb))
        return out


@dataclass
class BoxSmoother:
    """Exponential mean of face boxes; the last one is held for ten frames without a face."""

    alpha: float = 0.65
    hold: int = 10
    box: tuple[float, ...] | None = None
    missing: int = 0

    def update(self, box: tuple[float, ...] | None) -> tuple[int, ...] | None:
        if box is None:
            self.missing += 1
            if self.missing > self.hold:
                self.box = None
        else:
            self.missing = 0
            self.box = tuple(map(float, box)) if self.box is None else tuple(self.alpha * n + (1 - self.alpha) * o for n, o in zip(box, self.box, strict=True))
        return None if self.box is None else tuple(round(v) for v in self.box)


# Fixed values of the measurement protocol: by event, the states that take it and where it leads.
STATES = ("IDLE", "CAMERA_PERMISSION", "CAMERA_READY", "FACE_SEARCH", "FACE_LOCKED", "SIGNAL_ACQUIRING", "QUALITY_CHECK", "COMPUTING", "RESULT_READY", "FAILED", "CANCELLED")
EVENTS = {
    "REQUEST_CAMERA": {"IDLE": "CAMERA_PERMISSION"},
    "PERMISSION_GRANTED": {"CAMERA_PERMISSION": "CAMERA_READY"},
    "PERMISSION_DENIED": {"CAMERA_PERMISSION": "FAILED"},
    "START_MEASUREMENT": {"CAMERA_READY": "FACE_SEARCH"},
    "FACE_FOUND": {"FACE_SEARCH": "FACE_LOCKED"},
    "FACE_SEARCH_TIMEOUT": {"FACE_SEARCH": "FAILED"},
    "ACQUISITION_STARTED": {"FACE_LOCKED": "SIGNAL_ACQUIRING"},
    "WINDOW_FILLED": {"SIGNAL_ACQUIRING": "QUALITY_CHECK"},
    "QUALITY_PASSED": {"QUALITY_CHECK": "COMPUTING"},
    "QUALITY_FAILED": {"QUALITY_CHECK": "SIGNAL_ACQUIRING"},
    "RESULT_VALID": {"COMPUTING": "RESULT_READY"},
    "RESULT_INVALID": {"COMPUTING": "FAILED"},
    "CONTINUE_MEASUREMENT": {"RESULT_READY": "SIGNAL_ACQUIRING"},
    "FACE_LOST": dict.fromkeys(("FACE_LOCKED", "SIGNAL_ACQUIRING", "QUALITY_CHECK"), "FACE_SEARCH"),
    "CAMERA_ERROR": dict.fromkeys(("CAMERA_PERMISSION", "CAMERA_READY", "FACE_SEARCH", "FACE_LOCKED", "SIGNAL_ACQUIRING", "QUALITY_CHECK", "COMPUTING"), "FAILED"),
    "CANCEL": dict.fromkeys(("IDLE", "CAMERA_PERMISSION", "CAMERA_READY", "FACE_SEARCH", "FACE_LOCKED", "SIGNAL_ACQUIRING", "QUALITY_CHECK", "COMPUTING"), "CANCELLED"),
    "RESET": dict.fromkeys(("RESULT_READY", "FAILED", "CANCELLED"), "IDLE"),
}
FAILURES = {
    "PERMISSION_DENIED": "CAMERA_PERMISSION_DENIED", "CAMERA_ERROR": "CAMERA_UNAVAILABLE", "FACE_SEARCH_TIMEOUT": "FACE_NOT_FOUND", "QUALITY_FAILED": "SIGNAL_QUALITY_INSUFFICIENT", "RESULT_INVALID": "MEASUREMENT_INVALID",
}
RETRIES = 3
STORED = {"IDLE": "CREATED", "RESULT_READY": "COMPLETED", "FAILED": "FAILED", "CANCELLED": "STOPPED"}


def protocol() -> dict[tuple[str, int, str], tuple[str, int, str | None]]:
    """The protocol with its retries as one table: (state, retries, event) to (state, retries, failure).

    Retries are part of a state here, so that failing after too many of them is a move like any other.
    """
    table = {}
    for event, moves in EVENTS.items():
        for source, target in moves.items():
            for tries in range(RETRIES + 2):
                after = 0 if target == "IDLE" else min(tries + (event == "QUALITY_FAILED"), RETRIES + 1)
                end = "FAILED" if after > RETRIES and event == "QUALITY_FAILED" else target
                table[source, tries, event] = (end, after, FAILURES.get(event) if end == "FAILED" else None)
    return table


_PROTOCOL = protocol()


@dataclass
class Measurement:
    """Where a measurement stands in the protocol."""

    state: str = "IDLE"
    retries: int = 0
    failure: str | None = None

    def allowed(self) -> list[str]:
        return [e for s, n, e in _PROTOCOL if s == self.state and n == self.retries]

    def dispatch(self, event: str) -> str:
        if (self.state, self.retries, event) not in _PROTOCOL:
            raise ValueError(f"{event} is not allowed in {self.state}")
        self.state, self.retries, self.failure = _PROTOCOL[self.state, self.retries, event]
        return self.state


WALKED = "state string, retries int, refused long"


def walked(events: DataFrame, key: str, *order: str) -> DataFrame:
    """(key, state, retries, refused): where each key stands after its events (key, event, order), taken in their order;
    an event that isn't allowed is refused and changes nothing.

    One shuffle, sorted; a task holds a batch and where its last key stands.
    """
    kind = events.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, at, refused, began = None, ("IDLE", 0), 0, False
        for batch in batches:
            ids, done = [], []
            for now, event in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not began or now != name:
                    if began:
                        ids.append(name)
                        done.append((*at, refused))
                    name, at, refused, began = now, ("IDLE", 0), 0, True
                move = _PROTOCOL.get((*at, event))
                refused += move is None
                at = at if move is None else move[:2]
            yield table(ids, done, batch.schema.field(0).type)
        if began:
            yield table([name], [(*at, refused)], batch.schema.field(0).type)

    def table(ids: list, done: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
        columns = [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *columns], [key, "state", "retries", "refused"])

    rows = events.select(key, "event", *order).repartition(key).sortWithinPartitions(key, *order)
    return rows.mapInArrow(walk, f"`{key}` {kind}, {WALKED}")


def database_status(state: str) -> str:
    """The stored status of a state."""
    return STORED.get(state, "RUNNING")


def contract() -> dict:
    """The protocol as plain values, as it is handed to other programs."""
    return {
        "states": list(STATES), "events": list(EVENTS), "terminal_states": sorted(EVENTS["RESET"]),
        "transitions": [{"from": s, "event": e, "to": t} for s, e, t in sorted((s, e, t) for e, moves in EVENTS.items() for s, t in moves.items())],
        "failure_by_event": dict(FAILURES),
        "database_mapping": [{"state": s, "measurements_state": None if s in ("FAILED", "CANCELLED") else s, "measurements_status": database_status(s)} for s in STATES],
    }
