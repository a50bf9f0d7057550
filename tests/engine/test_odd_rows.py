"""Queries against their SQL on rows that the small tables don't have: values of 0, equal times, means on a threshold."""

import datetime
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from arterion.plans import catalog

START = datetime.datetime(2024, 1, 1)


def events(spark, tmp_path, rows):
    """Rows (event_id, seconds, user_id, event_type, value) as the events of a folder."""
    rows = [(k, START + datetime.timedelta(seconds=s), u, e, float(v), "{}") for k, s, u, e, v in rows]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    frame.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def both(spark, folder, name, key):
    con = duckdb.connect()
    for t in ("events", "lineitem", "part"):
        if Path(f"{folder}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got, want = catalog.queries()[name](spark, folder).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    got, want = (x.sort_values(key).reset_index(drop=True) for x in (got, want[got.columns]))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-12)
    return got


def test_f1_a_session_that_starts_with_zeros(spark, tmp_path):
    values = {1: [0, 0, 5, 7], 2: [3, 0, 4], 3: [-2, 2, 6]}
    folder = events(spark, tmp_path, [(10 * u + k, 60 * k, u, "view", v) for u, vs in values.items() for k, v in enumerate(vs)])
    got = both(spark, folder, "running_median7", "event_id").set_index("event_id")
    assert np.isnan(got.loc[10, "variation"]) and np.isnan(got.loc[11, "variation"]) and np.isinf(got.loc[31, "variation"]) and got.loc[12, "luma"] == 0


def frames_of(users, n=30, zeros=()):
    """Frames a sixth of a session's second apart, in pairs of equal time; those at ``zeros`` have no luma."""
    rng = np.random.default_rng(4)
    kinds = ["view", "click", "error", "signup"]
    return [(1000 * u + k, 50000 * (k // 2 * 2), u, kinds[int(rng.integers(4))], 0.0 if k in zeros else round(float(rng.integers(20, 300)), 2)) for u in users for k in range(n)]


def test_f3_frames_without_a_measured_luma_and_of_equal_time(spark, tmp_path):
    folder = events(spark, tmp_path, frames_of((1, 2, 3), zeros=(0, 5, 6, 17)))
    got = both(spark, folder, "frame_light", "event_id").set_index("event_id")
    assert (got.loc[[1000, 1005, 2017], "smooth_luma"] == 0).all() and not got.loc[[1000, 1005, 2017], "unstable"].any()
    assert (got.drop([1000 * u + k for u in (1, 2, 3) for k in (0, 5, 6, 17)])["smooth_luma"] > 0).all() and got["unstable"].any()


def test_f4_a_luma_that_was_not_measured_is_not_dark(spark, tmp_path):
    folder = events(spark, tmp_path, frames_of((1, 2), n=60, zeros=range(0, 60, 2)))
    got = both(spark, folder, "frame_status", "event_id").set_index("event_id")
    seen = got[~got["codes"].str.contains("FACE_NOT_FOUND")]
    assert len(seen) and not seen[seen.index % 2 == 0]["codes"].str.contains("TOO_DARK").any() and seen["codes"].str.contains("TOO_DARK").any()


def test_f2_a_mean_on_its_threshold_and_frames_of_equal_time(spark, tmp_path):
    # The clipped shares of eleven ids in a row have a mean of 0.05, however they are added up.
    orders = {u: np.random.default_rng(u).permutation(22) for u in range(1, 60)}
    rows = [(1100 * u + int(k), 50000 * (i // 2 * 2), u, "view", 100.0) for u, ks in orders.items() for i, k in enumerate(ks)]
    folder = events(spark, tmp_path, rows)
    got = both(spark, folder, "face_quality", "session_id")
    assert len(got) == len(orders) and not got["issues"].str.contains("PIXEL_CLIPPING").any()
