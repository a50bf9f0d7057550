"""Exact quantiles by brackets, and all folds from one pass."""

import numpy as np
import pandas as pd

from arterion.operators import models
from arterion.operators.quantiles import medians, quantiles


def test_quantiles_equal_numpy_whatever_the_group(spark):
    rng = np.random.default_rng(1)
    parts = {"wide": rng.normal(size=4000) * 10.0 ** rng.integers(-9, 9, 4000), "tied": rng.integers(0, 3, 3000).astype(float), "one": np.full(900, 7.5), "few": rng.normal(size=3), "single": np.array([4.0]), None: rng.exponential(size=2500), "none": np.array([np.nan] * 5)}
    parts["hot"] = np.concatenate([np.full(5000, 1.0), rng.normal(size=40)])
    pdf = pd.concat([pd.DataFrame({"g": k, "x": v}) for k, v in parts.items()])
    rows = spark.createDataFrame(pdf, "g string, x double").repartition(5)
    shares = (0.0, 0.05, 0.5, 0.95, 1.0)
    got = {(r["g"], r["share"]): (r["n"], r["value"]) for r in quantiles(rows, "x", shares, "g", few=50).collect()}
    want = {(k, s): (len(v), float(np.quantile(v, s))) for k, v in parts.items() if k != "none" for s in shares}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) <= 1e-12 * max(1, abs(want[k][1])) for k in want)
    whole = quantiles(rows, "x", (0.5,), few=100).first()
    assert abs(whole["value"] - np.nanmedian(pdf["x"])) < 1e-12
    assert quantiles(rows.where("false"), "x", (0.5,), "g").count() == 0
    assert {r["name"]: r["value"] for r in medians(rows.where("g = 'few'").withColumn("y", -rows["x"]), ["x", "y"]).collect()} == {"x": float(np.median(parts["few"])), "y": -float(np.median(parts["few"]))}


def test_folds_from_one_pass_equal_a_fit_for_each(spark):
    data = models.synthetic_pressure(60, 3)
    names = ["age_years", "sex_male", "bmi", "aix_proxy", "mean_rise_time_ms"]
    rng = np.random.default_rng(3)
    data.loc[rng.random(len(data)) < 0.1, "bmi"] = np.nan
    rows = spark.createDataFrame(data)
    dealt = rows.join(models.group_folds(rows, "subject_id", 3), "subject_id").cache()
    found = models.fold_models(dealt, names, 3)
    for k, model in enumerate(found):
        plain = models.Ridge(names).fit(dealt.where(f"fold != {k}"))
        for part in ("middle", "low", "high", "mean", "scale", "level", "weights", "residual"):
            assert np.allclose(getattr(model, part), getattr(plain, part), rtol=1e-9, atol=1e-9), part
        assert model.n == plain.n
    out = models.cross_validated(rows, names, "subject_id", 3).toPandas()
    assert len(out) == len(data) and out["pred_sbp_mmhg"].notna().all()
