"""NumPy kernels over tables of windows, one Arrow pass for all that is computed of a window.

A window is a row; its samples are an array column.  Nothing is shuffled, except
where a session's state makes its windows follow each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arterion.functions import dsp, features, quality, rppg, vitals


def per_window(rows: DataFrame, keys: list[str], samples: str, schema: str, compute: Callable[[np.ndarray], tuple]) -> DataFrame:
    """``keys`` and what ``compute`` returns for each array of ``samples`` (null: all null)."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [compute(np.asarray(x, float)) if x is not None else (None,) * len(names) for x in pdf[samples]]
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(found, columns=names)], axis=1)

    return rows.select(*keys, F.col(samples)).mapInPandas(work, f"{kinds}, {schema}")


#: What spectrum() can tell of a window.
SPECTRUM = ("fft_bpm", "peak_bpm", "snr_db", "sqi", "periodicity", "acf_peak")


def spectrum(rows: DataFrame, keys: list[str], samples: str, fs: float = 30.0, wanted: tuple[str, ...] = SPECTRUM) -> DataFrame:
    """(keys, wanted): rates and quality of each window, only those that are asked for."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = {n: np.full(len(pdf), np.nan) for n in wanted}
            for at, stack in by_length(pdf[samples]):
                told = quality.stacked(stack, fs, wanted)
                if "peak_bpm" in wanted:
                    told["peak_bpm"] = np.array([vitals.peak_bpm(x, fs) for x in stack])
                for n, values in told.items():
                    found[n][at] = values
            whole = pdf[samples].notna().to_numpy()
            columns = {n: pd.Series(v).astype(object).where(whole, None) for n, v in found.items()}
            yield pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(columns)], axis=1)

    return rows.select(*keys, F.col(samples)).mapInPandas(work, f"{kinds}, {', '.join(f'{n} double' for n in wanted)}")


def by_length(windows: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, stack): the windows of each length of a batch, as rows of one array; nulls are left out."""
    data = [None if x is None else np.asarray(x, float) for x in windows]
    sizes = np.array([-1 if x is None else len(x) for x in data])
    for n in np.unique(sizes[sizes >= 0]):
        at = np.flatnonzero(sizes == n)
        yield at, np.stack([data[k] for k in at])


def agreement(rows: DataFrame, keys: list[str], part: str, samples: str) -> DataFrame:
    """(keys, r_mean, r_min): the mean and least Pearson of each two waves of a key; 0 where one is flat."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    centred = F.transform(samples, lambda v: v - total(F.col(samples)) / F.size(samples))
    waves = rows.select(*keys, F.struct(F.col(part).alias("part"), centred.alias("x")).alias("w")).groupBy(*keys).agg(F.array_sort(F.collect_list("w")).alias("w"))
    dot = lambda x, y: total(F.zip_with(x, y, lambda a, b: a * b))
    power = lambda a, b: F.sqrt(dot(a, a) * dot(b, b))
    pearson = lambda a, b: F.when((F.size(a) == F.size(b)) & (power(a, b) > 1e-12), dot(a, b) / power(a, b)).otherwise(0.0)
    # The few regions of a face.
    pairs = F.flatten(F.transform("w", lambda a: F.transform(F.filter("w", lambda b: b["part"] > a["part"]), lambda b: pearson(a["x"], b["x"]))))
    return waves.select(*keys, pairs.alias("r")).select(*keys, (total(F.col("r")) / F.size("r")).alias("r_mean"), F.array_min("r").alias("r_min"))


FEATURES = "valid_beat_count int, window_duration_s double, fs double, " + ", ".join(f"{n} double" for n in features.NAMES)


def waveform_features(rows: DataFrame, keys: list[str], samples: str, fs: float = 30.0) -> DataFrame:
    def compute(x: np.ndarray) -> tuple:
        found = features.extract(x, fs)
        return found["valid_beat_count"], found["window_duration_s"], fs, *(found[n] for n in features.NAMES)

    return per_window(rows, keys, samples, FEATURES, compute)


def project(rows: DataFrame, keys: list[str], method: str, red: str, green: str, blue: str, fs: float = 30.0) -> DataFrame:
    """(keys, bvp): the pulse wave of the traces by the named method."""
    of = rppg.method(method)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            waves = [of(np.column_stack([np.asarray(pdf[c].iloc[k], float) for c in (red, green, blue)]), fs) for k in range(len(pdf))]
            yield pdf[keys].reset_index(drop=True).assign(bvp=waves)

    return rows.select(*keys, red, green, blue).mapInPandas(work, f"{kinds}, bvp array<double>")


VITALS = "session_id long, at double, code string, value double, unit string, status string, quality double, confidence double, issues array<string>, failure string"


def measure_sessions(windows: DataFrame) -> DataFrame:
    """The five vitals of each window (session_id, start, fs, samples, raw, quality, missing), in order within a session.

    One shuffle, sorted: each window is judged by those before it, so what a session has left is carried on from window
    to window; a task holds a batch, however long a session is.
    """
    names = [c.split()[0] for c in VITALS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, session = None, vitals.Session()
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if name is None or r.session_id != name:
                    name, session = r.session_id, vitals.Session()
                raw = None if r.raw is None else np.asarray(r.raw, float)
                good = None if pd.isna(r.quality) else float(r.quality)
                w = vitals.Window(np.asarray(r.samples, float), float(r.fs), float(r.start), good, float(r.missing), raw)
                out += [{"session_id": r.session_id, **v} for v in session.measure(w)]
            yield pd.DataFrame(out, columns=names)

    rows = windows.select("session_id", "start", "fs", "samples", "raw", "quality", "missing")
    return rows.repartition("session_id").sortWithinPartitions("session_id", "start").mapInPandas(run, VITALS)


def filtered(rows: DataFrame, keys: list[str], samples: str, fs: float, low_hz: float, high_hz: float) -> DataFrame:
    """(keys, x): detrended and band-passed windows; those of one length in a batch go through one matrix product."""
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[np.ndarray | None] = [None] * len(pdf)
            for at, stack in by_length(pdf[samples]):
                for k, y in zip(at.tolist(), dsp.pulse_band_pass(dsp.linear_detrend(stack), low_hz, high_hz, fs), strict=True):
                    out[k] = y
            yield pdf[keys].reset_index(drop=True).assign(x=out)

    return rows.select(*keys, samples).mapInPandas(work, f"{kinds}, x array<double>")
