"""Windowed and per-session queries over the frame stream (events).

A session is a user, an ``error`` event a dropped frame, ``value`` the luma or
the heart rate of the frame.
"""

from __future__ import annotations

from arterion.plans.dialect import both

_E = "WITH e AS (SELECT user_id, event_id, ts, SECS(ts) AS t, value, event_type FROM events)"
_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"

QUERIES, ORACLES = both({
    # Successive differences and their statistics
    "hrv_time_domain": f"""{_E}, d AS (SELECT user_id, value, value - lag(value) {_W} AS step FROM e WHERE event_type <> 'error')
 SELECT user_id, count(*) AS n, round(sqrt(avg(step * step)), 6) AS rmssd, round(stddev_samp(value), 6) AS sdnn, round(avg(value), 6) AS mean_ibi FROM d GROUP BY user_id HAVING count(*) >= 3""",
    "hrv_pnn50": f"""{_E}, d AS (SELECT user_id, value - lag(value) {_W} AS step FROM e) SELECT user_id, round(100 * avg(CASE WHEN abs(step) > 50 THEN DBL(1) WHEN step IS NOT NULL THEN DBL(0) END), 6) AS pnn50 FROM d GROUP BY user_id HAVING count(*) >= 4""",
    # Interval in range and near its local median
    # Share of dropped frames over a trailing horizon
    "missing_ratio_range": f"""{_E} SELECT event_id, round(avg(CASE WHEN event_type = 'error' THEN DBL(1) ELSE DBL(0) END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAYS PRECEDING AND CURRENT ROW), 6) AS missing FROM e""",
    # Rate by the median gap, and the mean rate
    "fps_median_gap": f"""{_E}, g AS (SELECT user_id, t, t - lag(t) {_W} AS dt FROM e)
 SELECT user_id, round(greatest(5, least(120, 86400 / PCT(CASE WHEN dt > 0 THEN dt END, 0.5))), 6) AS fps, round((count(*) - 1) / nullif(max(t) - min(t), 0), 9) AS mean_rate FROM g GROUP BY user_id""",
    # Sessions that end at a gap
    "gap_sessions": f"""{_E}, g AS (SELECT user_id, event_id, ts, t, CASE WHEN t - lag(t) {_W} > 21600 THEN 1 ELSE 0 END AS new FROM e), s AS (SELECT user_id, t, LONG(sum(new) {_W}) AS session FROM g)
 SELECT user_id, session, count(*) AS frames, round(max(t) - min(t), 6) AS seconds FROM s GROUP BY user_id, session""",
    # Windows of 24 h every 6 h
    "hop_windows": f"""{_E}, h AS (SELECT user_id, value, LONG(floor(t / 21600) * 21600 - k * 21600) AS start_s FROM e CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) o)
 SELECT user_id, start_s, count(*) AS n, round(avg(value), 6) AS mean FROM h GROUP BY user_id, start_s""",
    # Running median of seven, and variation over a trailing span
    "running_median7": f"""{_E} SELECT event_id, PCT(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS luma,
 round(RATIO(coalesce(stddev_pop(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 0), avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)), 6) AS variation FROM e""",
    # Range of a position over a span, and jumps
    "motion_range": f"""{_E} SELECT event_id, round(max(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAYS PRECEDING AND CURRENT ROW) - min(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAYS PRECEDING AND CURRENT ROW), 6) AS reach,
 coalesce(abs(value - lag(value) {_W}) > 200, false) AS jump FROM e""",
    # Bounded trailing window
    "trailing_count": f"{_E} SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 8 HOURS PRECEDING AND CURRENT ROW) AS held FROM e",
    # W09
    "first_last": f"{_E} SELECT user_id, min_by(value, event_id) AS first_value, max_by(value, event_id) AS last_value FROM e GROUP BY user_id",
    # Last value carried forward over dropped frames
    "carried_forward": f"{_E} SELECT event_id, LAST_SEEN(CASE WHEN event_type <> 'error' THEN value END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM e",
    # Gate by thresholds, and hysteresis after a rejection
    # Change beyond a tolerance that grows with time
    "sudden_jump": f"""{_E}, j AS (SELECT event_id, value, t, lag(value) {_W} AS v0, lag(t) {_W} AS t0 FROM e)
 SELECT event_id, coalesce(abs(value - v0) > 8 + 0.003 * greatest(0, t - t0), false) AS jump FROM j""",
    # R07
    "temporal_stability": f"""{_E} SELECT event_id, CASE WHEN count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) >= 4
 THEN stddev_pop(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) > 120 ELSE false END AS unstable FROM e""",
    # Confidence from the components there are
    # Face quality of a session
    # Guard reasons of a session
    "guard_reasons": f"""{_E}, s AS (SELECT user_id, count(*) AS n, max(t) - min(t) AS seconds, stddev_pop(value) AS spread, avg(CASE WHEN event_type = 'error' THEN DBL(1) ELSE DBL(0) END) AS artifact, avg(value) / 500 AS sqi FROM e GROUP BY user_id)
 SELECT user_id, JOINED(COMPACT(CASE WHEN n / nullif(seconds, 0) * 86400 < 1.5 THEN 'LOW_FS' END, CASE WHEN seconds < 4 THEN 'SIGNAL_TOO_SHORT' END, CASE WHEN spread < 0.000000001 THEN 'SIGNAL_DEGENERATE' END, CASE WHEN sqi < 0.4 THEN 'LOW_SQI' END, CASE WHEN artifact > 0.25 THEN 'HIGH_ARTIFACT' END, CASE WHEN n < 3 THEN 'TOO_FEW_BEATS' END)) AS reasons FROM s""",
    # Run statistics
    # Q10, Q11, P15-P18
    # D01-D03
    "measurement_window": "SELECT event_id, round(SECS(ts), 6) AS start_s, round(SECS(ts + INTERVAL 30 SECONDS), 6) AS end_s, round(SECS(ts + INTERVAL 30 SECONDS) - SECS(ts), 3) AS duration_s FROM events",
    # Sessions of 30 minutes, by fixed windows of arrival
    "tumbling_sessions": f"{_E} SELECT user_id, LONG(floor(t / 1800)) AS slot, count(*) AS n, round(sum(value), 6) AS total FROM e GROUP BY user_id, LONG(floor(t / 1800))",
})
