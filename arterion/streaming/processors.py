"""Frames in, buffer status and the followed green level out: as one pass over sorted partitions, and as a stream whose
state is typed and grows by what is new."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from arterion.functions.vitals import Track
from arterion.streaming.buffer import Buffer, followed, Settings

FRAME_OUT = "session_id long, t double, status string, held int, artifacts int, gaps int, adapted int, ready boolean, tracked double, outlier boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ORDER = ["t", "r", "g", "b"]


def _columns() -> list[str]:
    return [c.split()[0] for c in FRAME_OUT.split(", ")]


def _judged(session: int | None, frames: np.ndarray, buffer: Buffer, track: Track) -> tuple[Track, dict[str, np.ndarray | list]]:
    """The rows of FRAME_OUT of a session's next frames."""
    track, smooth, outlier = followed(track, frames[:, 2], frames[:, 0])
    s = buffer.scan(frames)
    ready = (s.held > 1) & (s.span >= buffer.settings.least_s)
    counts = {"held": s.held, "artifacts": s.artifacts, "gaps": s.gaps, "adapted": s.adapted}
    return track, {"session_id": [session] * len(frames), "t": frames[:, 0], "status": s.status, **{k: v.astype(np.int32) for k, v in counts.items()}, "ready": ready, "tracked": smooth, "outlier": outlier}


def fold_frames(frames: DataFrame, **settings: float) -> DataFrame:
    """Batch form over frames (session_id, t, r, g, b): one shuffle, sorted; what a session has left is carried over the
    borders of Arrow batches, so that a task holds a batch and a window, however long a session is."""
    limits = Settings(**settings)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, buffer, track = None, Buffer(limits), Track()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = np.column_stack([batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in range(1, 5)])
            borders = [0, *(k for k in range(1, len(ids)) if ids[k] != ids[k - 1]), len(ids)]
            parts = []
            for a, b in zip(borders, borders[1:], strict=False):
                if b > a:
                    if ids[a] != session or session is None:
                        session, buffer, track = ids[a], Buffer(limits), Track()
                    track, part = _judged(session, rows[a:b], buffer, track)
                    parts.append(part)
            columns = {k: [x for p in parts for x in (p[k].tolist() if isinstance(p[k], np.ndarray) else p[k])] for k in _columns()}
            yield pa.RecordBatch.from_pydict(columns, schema=_SCHEMA)

    rows = frames.select("session_id", *_ORDER).repartition("session_id").sortWithinPartitions("session_id", *_ORDER)
    return rows.mapInArrow(fold, FRAME_OUT)


_SCHEMA = pa.schema([("session_id", pa.int64()), ("t", pa.float64()), ("status", pa.string()), *[(k, pa.int32()) for k in ("held", "artifacts", "gaps", "adapted")], ("ready", pa.bool_()), ("tracked", pa.float64()), ("outlier", pa.bool_())])


class Chunks:
    """Rows of numbers of a session's window as map state: CHUNK rows under a key, by their number among all rows ever
    put, so that a batch writes the chunks that it adds to and removes those that the window has left."""

    CHUNK = 64

    def __init__(self, handle: StatefulProcessorHandle, name: str, width: int):
        self.width = width
        self.map = handle.getMapState(name, "chunk long", "start long, rows array<double>")

    def read(self, first: int, end: int) -> np.ndarray:
        """Rows ``first`` up to ``end``."""
        parts = []
        for key in range(first // self.CHUNK, -(-end // self.CHUNK)):
            start, values = self.map.getValue((key,))
            rows = np.array(values, float).reshape(-1, self.width)
            parts.append(rows[max(0, first - start) : end - start])
        return np.concatenate(parts) if parts else np.empty((0, self.width))

    def write(self, was: tuple[int, int], first: int, rows: np.ndarray) -> None:
        """``rows`` from number ``first`` on are the window now; ``was``: first and end of what is stored."""
        end = first + len(rows)
        for key in range(was[0] // self.CHUNK, -(-was[1] // self.CHUNK)):
            if (key + 1) * self.CHUNK <= first:
                self.map.removeKey((key,))
        for key in range(max(first, was[1]) // self.CHUNK, -(-end // self.CHUNK)):
            a, b = max(first, key * self.CHUNK), min(end, (key + 1) * self.CHUNK)
            if b > max(a, was[1]):
                self.map.updateValue((key,), (a, rows[a - first : b - first].ravel().tolist()))


class FrameProcessor(StatefulProcessor):
    """Streaming form.  Frames of a batch are taken by time; with ``late`` "drop", frames older than the last one taken
    are left out, with "accept" they are taken as they come."""

    def __init__(self, late: str = "drop", **settings: float):
        self.late, self.settings = late, Settings(**settings)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frames = Chunks(handle, "frames", 4)
        self.marks = handle.getValueState("marks", "first long, stop long, artifacts int, in_a_row int, gaps int, adapted int, last double, followed array<double>, followed_t array<double>, smooth double, strikes int")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        buffer, track, last, was = Buffer(self.settings), Track(), None, (0, 0)
        if self.marks.exists():
            first, stop, *counters, last, values, times, smooth, strikes = self.marks.get()
            was = (first, stop)
            buffer = Buffer(self.settings, self.frames.read(first, stop), first, *counters)
            track = Track(tuple(values), tuple(times), smooth, strikes)
        new = pd.concat(list(rows)).sort_values(_ORDER, kind="stable")[_ORDER].to_numpy(float)
        if self.late == "drop" and last is not None:
            new = new[new[:, 0] >= last]
        if len(new):
            last = float(new[:, 0].max()) if last is None else max(last, float(new[:, 0].max()))
        track, out = _judged(int(key[0]), new, buffer, track)
        self.frames.write(was, buffer.first, buffer.rows)
        self.marks.update((buffer.first, buffer.end, *buffer.counters(), last, list(track.values), list(track.times), track.smooth, track.strikes))
        yield pd.DataFrame(out, columns=_columns())

    def close(self) -> None:
        pass


def needs_store(spark: SparkSession) -> None:
    """Typed map state needs the RocksDB state store."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STORE}")


def stream_frames(spark: SparkSession, frames: DataFrame, late: str = "drop", **settings: float) -> DataFrame:
    """``frames`` (session_id, t, r, g, b), streaming, through the processor."""
    needs_store(spark)
    return frames.groupBy("session_id").transformWithStateInPandas(statefulProcessor=FrameProcessor(late, **settings), outputStructType=FRAME_OUT, outputMode="Update", timeMode="None")
