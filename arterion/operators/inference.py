"""Models over chunks of small frame tensors, as an operator: chunks are rows, a batch of them is one call of the model,
and pulses go back to the times of their frames.

Frames are rows (by, k, crop): ``k`` counts a session's frames, ``crop`` is a flat
array of size * size * 3 values.  A chunk is ``frames`` frames in a row, and a new
one begins every ``stride`` frames; the last, unfinished ones have no pulse.  A
frame's pulse is that of the newest chunk that it is in.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from arterion.functions.video import ModelSpec

Model = Callable[[np.ndarray], np.ndarray]
TINY = 1e-7


def _per_chunk(x: np.ndarray, how: Callable) -> np.ndarray:
    return how(x, axis=tuple(range(1, x.ndim)), keepdims=True)


def standard(chunks: np.ndarray) -> np.ndarray:
    """Chunks (n, frames, h, w, 3), each about its mean and over its deviation; a flat one is about its mean only."""
    spread = _per_chunk(chunks, np.std)
    return (chunks - _per_chunk(chunks, np.mean)) / np.where(spread > TINY, spread, 1.0)


def difference(chunks: np.ndarray) -> np.ndarray:
    """What each frame changes by until the next one, over the sum of both, and over the chunk's deviation of that; the
    last frame changes by nothing."""
    change = np.diff(chunks, axis=1) / (chunks[:, 1:] + chunks[:, :-1] + TINY)
    spread = _per_chunk(change, np.std)
    return np.concatenate([np.where(spread > TINY, change / np.where(spread > TINY, spread, 1.0), change), np.zeros_like(chunks[:, :1])], axis=1)


#: What a network may take, by name.
INPUTS: Mapping[str, Callable[[np.ndarray], np.ndarray]] = {"standard": standard, "difference": difference}


def tensors(chunks: np.ndarray, spec: ModelSpec) -> np.ndarray:
    """The network's input of chunks (n, frames, h, w, 3): its representations as channels; frames stand in stacks of
    ``depth`` under one another, or along the depth of a volume."""
    x = np.concatenate([INPUTS[name](chunks) for name in spec.inputs], axis=-1)
    if spec.layout == "volume":
        return np.ascontiguousarray(np.moveaxis(x, -1, 1))
    whole = x.shape[1] - x.shape[1] % (spec.depth or 1)
    return np.ascontiguousarray(np.moveaxis(x[:, :whole], -1, 2)).reshape(-1, x.shape[-1], *x.shape[2:4])


def pulses(outputs: np.ndarray, spec: ModelSpec) -> np.ndarray:
    """Waves (n, frames) of a network's outputs: summed up if it gives changes, and without their straight line."""
    waves = np.cumsum(outputs, axis=1) if spec.derivative else outputs
    at = np.arange(waves.shape[1]) - (waves.shape[1] - 1) / 2.0
    slope = (waves @ at) / max(float(at @ at), TINY)
    return waves - waves.mean(axis=1, keepdims=True) - slope[:, None] * at


def chunked(frames: DataFrame, spec: ModelSpec, stride: int, *by: str) -> DataFrame:
    """(by, chunk, crops): the whole chunks of frames (by, k, crop), their crops one after another.

    A frame goes to the chunks that it is in; a group is one chunk, so it is as large as ``spec.frames`` says, however
    long a session is.
    """
    first = F.greatest(F.lit(0), F.ceil((F.col("k") - (spec.frames - 1)) / stride))
    rows = frames.select(*by, "k", "crop", F.explode(F.sequence(first, F.floor(F.col("k") / stride))).alias("chunk"))
    held = rows.groupBy(*by, "chunk").agg(F.array_sort(F.collect_list(F.struct("k", "crop"))).alias("rows"))
    return held.where(F.size("rows") == spec.frames).select(*by, "chunk", F.flatten("rows.crop").alias("crops"))


def inferred(chunks: DataFrame, model: Callable[[], Model], spec: ModelSpec, batch: int = 32) -> DataFrame:
    """``chunks`` with pulse, array<double> of spec.frames values, in place of crops.

    ``model`` makes the network where it runs, once for each Python worker: it takes tensors() and gives a value for each
    frame; the frames beyond its last whole stack are given its last value.
    """
    shape = [spec.frames, spec.size, spec.size, 3]

    def loaded() -> Callable[[np.ndarray], np.ndarray]:
        network = model()

        def predict(crops: np.ndarray) -> np.ndarray:
            given = np.asarray(network(tensors(np.asarray(crops, float), spec)), float).reshape(len(crops), -1)
            return pulses(np.pad(given, ((0, 0), (0, spec.frames - given.shape[1])), mode="edge"), spec)

        return predict

    wave = predict_batch_udf(loaded, return_type=ArrayType(DoubleType()), batch_size=batch, input_tensor_shapes=[shape])
    return chunks.withColumn("pulse", wave("crops")).drop("crops")


def at_frames(chunks: DataFrame, stride: int, *by: str) -> DataFrame:
    """(by, k, pulse): the value of each frame, of the newest chunk (by, chunk, pulse) that it is in."""
    rows = chunks.select(*by, "chunk", F.posexplode("pulse").alias("at", "value")).withColumn("k", F.col("chunk") * stride + F.col("at"))
    return rows.groupBy(*by, "k").agg(F.max_by("value", "chunk").alias("pulse"))
