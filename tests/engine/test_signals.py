"""Kernels, estimators and rules on analytic signals, seeded windows and degenerate input."""

import numpy as np
import pytest

from arterion.functions import dsp, features, quality, rppg, vitals
from arterion.sources import synthetic
from arterion.streaming.state import BoxSmoother, Measurement, TrailingFrames, contract, database_status

#: Expected vitals of the regression windows: heart rate, RMSSD, SDNN, mean interval, respiratory rate.
EXPECTED = {
    "rest_72bpm": (72.8, 43.7, 35.8, 830.6, 15.0), "low_54bpm": (54.3, 49.3, 38.9, 1113.9, 11.9), "high_118bpm": (116.2, 43.0, 34.8, 506.2, 19.9), "noisy_85bpm": (85.1, 94.5, 75.7, 697.3, 18.1),
}


def measured(name):
    return {v["code"]: v for v in vitals.Session().measure(synthetic.pulse_window(**synthetic.CASES[name]))}


@pytest.mark.parametrize("name", EXPECTED)
def test_regression_windows(name):
    found = [v["value"] for v in measured(name).values()]
    for got, want, slack in zip(found, EXPECTED[name], (0.5, 2.0, 2.0, 2.0, 0.5), strict=True):
        assert abs(got - want) <= slack


def test_regression_windows_that_are_refused():
    short = measured("short_12s")
    assert abs(short["heart_rate"]["value"] - 65.9) <= 0.5 and short["hrv_rmssd"]["issues"] == ["COMPUTATION_FAILED", "WINDOW_TOO_SHORT"]
    assert measured("low_fs_10hz")["heart_rate"]["status"] == measured("low_sqi_035")["heart_rate"]["status"] == "INVALID"
    assert measured("motion_high")["heart_rate"]["issues"] == ["SIGNAL_CONDITION_BLOCKING"]
    noisy = measured("noisy_85bpm")["hrv_rmssd"]
    assert noisy["status"] == "BAD" and noisy["issues"] == ["LOW_CONFIDENCE"]


def test_filters_pass_the_band_and_stop_the_rest():
    t = np.arange(900) / 30.0
    inside, slow = np.sin(2 * np.pi * 1.2 * t), np.sin(2 * np.pi * 0.05 * t)
    for band in (lambda x: dsp.butter_band_pass(x, 0.75, 2.5, 30.0, 2), lambda x: dsp.pulse_band_pass(x, 0.7, 3.0, 30.0)):
        assert np.abs(band(inside) - inside)[100:-100].max() < 0.05 and np.abs(band(slow))[100:-100].max() < 0.02
    long = np.sin(2 * np.pi * 1.2 * np.arange(3000) / 30.0)
    assert np.allclose(dsp.pulse_band_pass(long, 0.7, 3.0, 30.0)[200:400], long[200:400], atol=0.05)
    x = np.random.default_rng(1).normal(size=(4, 300))
    rows = dsp.pulse_band_pass(x, 0.7, 3.0, 30.0)
    assert np.allclose(rows[2], dsp.pulse_band_pass(x[2], 0.7, 3.0, 30.0))
    with pytest.raises(ValueError):
        dsp.pulse_band_pass(x[0], 0.7, 3.0, 1.0)
    assert dsp.butter_band_pass(np.arange(5.0), 0.75, 2.5, 30.0, 1).tolist() == [0, 1, 2, 3, 4]


def test_detrenders_take_trends_out():
    t = np.arange(200.0)
    assert np.abs(dsp.linear_detrend(3 * t + 5)).max() < 1e-9
    assert np.abs(dsp.smoothness_detrend(3 * t + 5)).max() < 1e-6
    x = np.cumsum(np.random.default_rng(4).normal(size=700))
    assert np.allclose(dsp.smoothness_detrend(x), dsp.smoothness_detrend(np.stack([x, x]))[0], atol=1e-8)
    assert np.allclose(dsp.pulse_band_pass(x, 0.7, 3.0, 30.0), dsp.pulse_band_pass(np.stack([x, x]), 0.7, 3.0, 30.0)[0], atol=1e-9)
    assert dsp.standardise(np.full(5, 2.0)).tolist() == [0] * 5 and dsp.smoothness_detrend(np.array([1.0, 2.0])).tolist() == [1, 2]


def test_peaks():
    x = np.array([0, 2, 2, 2, 0, 1, 0, 5, 0, 4.5, 0])
    assert dsp.find_peaks(x).tolist() == [2, 5, 7, 9]
    assert dsp.find_peaks(x, distance=3).tolist() == [2, 7]
    assert dsp.find_peaks(x, prominence=1.5).tolist() == [2, 7, 9]
    assert dsp.local_median(np.array([1.0, 9, 2, 3]), 4).tolist() == [1, 2, 3, 3] or len(dsp.local_median(np.array([1.0, 9, 2, 3]), 4)) == 4
    assert np.isclose(dsp.gaussian_smooth(np.full(20, 3.0), 1.0), 3.0).all()


@pytest.mark.parametrize("bpm", [54, 72, 118])
def test_a_sine_has_its_rate(bpm):
    t = np.arange(900) / 30.0
    x = np.sin(2 * np.pi * bpm / 60 * t) + np.random.default_rng(0).normal(0, 0.1, 900)
    assert abs(vitals.heart_rate(vitals.Window(x, 30.0)).bpm - bpm) < 0.7
    assert abs(vitals.fft_bpm(x) - bpm) < 2 and abs(vitals.peak_bpm(dsp.prepare_pulse(x, 30.0, 0.7, 3.0)) - bpm) < 3


def test_a_missing_beat_is_marked():
    at = [k for k in range(20) if k != 10]
    t = np.arange(0, 20, 1 / 30.0)
    x = sum(np.exp(-0.5 * ((t - 0.5 - k) / 0.08) ** 2) for k in at)
    assert abs(np.median(vitals.beats_of(x, 30.0).intervals()) - 1000) < 20
    marked = vitals.valid_intervals(np.array([1000.0, 1010, 990, 2000, 1000, 1005, 400, 1000]))
    assert marked.tolist() == [True, True, True, False, True, True, False, True]
    assert vitals.valid_intervals(np.empty(0)).tolist() == []


@pytest.mark.parametrize("method", ["green", "CHROM", "Pos"])
def test_methods_find_the_reference_rate(method):
    r = synthetic.record(synthetic.Scenario(seconds=20))
    wave = rppg.method(method)(np.mean(list(r.rgb.values()), 0), 30.0)
    assert abs(vitals.fft_bpm(wave) - r.reference(0, 20)["bpm"]) < 4 and quality.sqi(wave) > 0.6 and quality.periodicity(wave)[0] > 0.6
    assert rppg.method(method)(np.ones((5, 3)), 30.0).tolist() == [0] * 5
    with pytest.raises(ValueError):
        rppg.method("other")


def test_quality_of_noise_and_flat_signals():
    assert quality.sqi(quality.noise("white", 240, 1)) < 0.5 and quality.bvp_snr(np.zeros(100)) == -10.0 and quality.periodicity(np.zeros(100)) == (0.0, 0.0)
    assert quality.correlation(np.ones(5), np.arange(5)) == 0.0 and quality.periodicity(np.sin(2 * np.pi * 1.2 * np.arange(240) / 30))[0] > 0.8
    assert quality.cross_roi(synthetic.record(synthetic.Scenario(seconds=10)).rgb, 30.0)["r_min"] > 0.5


def test_features():
    w = synthetic.pulse_window()
    found, reasons = features.extract_checked(w.samples[-240:], 30.0)
    assert not reasons and found["valid_beat_count"] >= 6 and abs(found["ibi_mean_ms"] - 830) < 60 and 0 < found["mean_systolic_ratio"] < 1
    assert features.extract_checked(np.zeros(240), 30.0)[1] == ["SIGNAL_DEGENERATE"]
    assert features.extract_checked(w.samples[:60], 10.0, sqi=0.1, blocking=True, artifact=0.5)[1] == ["LOW_FS", "LOW_SQI", "BLOCKING_WARNING", "HIGH_ARTIFACT"]
    assert features.extract(np.array([1.0]), 30.0)["valid_beat_count"] == 0 and features.segment(np.full(50, np.nan), 30.0) == []


def test_sessions_do_not_share_state():
    a, b = vitals.Session(), vitals.Session()
    for _ in range(4):
        a.measure(synthetic.pulse_window())
    assert len(a.tracks["heart_rate"].values) == 4 and b.tracks["heart_rate"].values == ()


def test_tracker_rejects_and_relocks():
    track, said = vitals.Track(), []
    for k, v in enumerate([70.0] * 5 + [150.0, 151.0, 152.0, 150.0]):
        track, *rest = vitals.follow(track, v, k)
        said.append(tuple(rest))
    assert said[4:] == [(70.0, False), (70.0, True), (70.0, True), (152.0, False), (151.0, False)] and track.times == (7, 8)


def test_frame_buffer():
    b = TrailingFrames()
    for k in range(60):
        assert b.push(k / 30, (100 + k % 3, 90 + k % 3, 80 + k % 3)) == "ACCEPTED"
    assert b.push(2.0, (250, 250, 250)) == "ARTIFACT" and b.artifacts == 1 and not b.ready and abs(b.rate() - 30) < 0.1
    assert [b.push(2.0 + k / 30, (250, 250, 250)) for k in range(1, 10)][-1] == "ADAPTED" and len(b.ts) == 1
    b.push(9.0, (1, 2, 3))
    assert b.gaps == 1 and len(b.ts) == 1
    for k in range(400):
        b.push(9.0 + (k + 1) / 30, (1, 2, 3 + k % 2))
    assert b.span <= 8.0 + 1e-6 and b.ready and b.progress > 0.99
    again = TrailingFrames.restored(b.saved())
    assert again.saved() == b.saved() and np.allclose(again.deviation(np.ones(3)), b.deviation(np.ones(3)))


def test_progress_is_the_filled_part_of_the_window():
    b = TrailingFrames()
    for k in range(120):
        b.push(k / 30, (1, 2, 3))
    assert abs(b.progress - 119 / 30 / 8) < 1e-9 and b.ready


def test_frame_buffer_matches_plain_statistics():
    rng = np.random.default_rng(6)
    b, held, t = TrailingFrames(window_s=2.0), [], 0.0
    for k in range(600):
        t += rng.choice([0.02, 0.033, 0.05, 0.7], p=[0.3, 0.4, 0.295, 0.005])
        rgb = rng.normal((100, 90, 80), 2) + (60 if rng.random() < 0.05 or 300 < k < 330 else 0)
        if held and t - held[-1][0] > 0.5:
            held = []
        x = np.array([v for _, v in held])
        odd = len(held) >= 10 and (np.abs(rgb - x.mean(0)) > 3.5 * np.maximum(x.std(0), 1e-6)).sum() >= 2
        said = b.push(t, rgb)
        assert (said == "ACCEPTED") == (not odd)
        if said == "ADAPTED":
            held = []
        if said != "ARTIFACT":
            held = [*held, (t, rgb)]
            held = [x for x in held if t - x[0] <= 2.0 + 1e-6]
            held = held[-max(60, int(np.ceil(2.0 * b.rate()))) :]
        assert len(held) == len(b.ts)


def test_box_and_state_machine():
    s = BoxSmoother()
    assert s.update(None) is None and s.update((0, 0, 10, 10)) == (0, 0, 10, 10) and s.update((10, 10, 10, 10)) == (6, 6, 10, 10)
    assert [s.update(None) for _ in range(11)][-2:] == [(6, 6, 10, 10), None]
    m = Measurement()
    for e in ("REQUEST_CAMERA", "PERMISSION_GRANTED", "START_MEASUREMENT", "FACE_FOUND", "ACQUISITION_STARTED"):
        m.dispatch(e)
    for _ in range(3):
        m.dispatch("WINDOW_FILLED")
        assert m.dispatch("QUALITY_FAILED") == "SIGNAL_ACQUIRING"
    m.dispatch("WINDOW_FILLED")
    assert m.dispatch("QUALITY_FAILED") == "FAILED" and m.failure == "SIGNAL_QUALITY_INSUFFICIENT"
    assert m.dispatch("RESET") == "IDLE" and m.failure is None
    with pytest.raises(ValueError):
        m.dispatch("FACE_FOUND")
    assert m.allowed() == ["REQUEST_CAMERA", "CANCEL"] and m.dispatch("CANCEL") == "CANCELLED"
    assert [database_status(x) for x in ("IDLE", "COMPUTING", "RESULT_READY", "FAILED", "CANCELLED")] == ["CREATED", "RUNNING", "COMPLETED", "FAILED", "STOPPED"]
    assert len(contract()["transitions"]) == 34 and contract()["database_mapping"][-1] == {"state": "CANCELLED", "measurements_state": None, "measurements_status": "STOPPED"}
