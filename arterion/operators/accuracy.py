"""Accuracy aggregates as Column builders, for any grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arterion.operators.quantiles import quantiles

CONFIDENCE_BINS = ((0.0, 0.3), (0.3, 0.6), (0.6, 0.8), (0.8, 1.0001))


def safe_pearson(a: Column, b: Column) -> Column:
    """Pearson over rows where both are there; null for a constant side."""
    both = a.isNotNull() & b.isNotNull()
    a, b = F.when(both, a), F.when(both, b)
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def error_metrics(est: Column, ref: Column, tolerance: float, where: Column | None = None, prefix: str = "") -> list[Column]:
    """Count, MAE, RMSE, MAPE, bias, limits of agreement, Pearson and share within tolerance, of pairs that are complete."""
    keep = est.isNotNull() & ref.isNotNull()
    keep = keep if where is None else keep & where
    e, r, s = F.when(keep, est - ref), F.when(keep, ref), F.when(keep, est)
    bias = F.avg(e)
    wide = 1.96 * F.coalesce(F.when(F.count(e) > 1, F.stddev_samp(e)), F.lit(0.0))
    out = {
        "count": F.count(e), "mae": F.avg(F.abs(e)), "rmse": F.sqrt(F.avg(e * e)), "mape": 100.0 * F.avg(F.abs(e) / F.greatest(F.abs(r), F.lit(1e-9))),
        "bias": bias, "loa_lower": bias - wide, "loa_upper": bias + wide, "pearson_r": F.when(F.count(e) >= 3, safe_pearson(s, r)),
        "within_tolerance": F.avg(F.when(keep, (F.abs(e) <= tolerance).cast("double"))),
    }
    return [(v if k == "count" else F.round(v, 4)).alias(prefix + k) for k, v in out.items()]


def legacy_metrics(est: Column, ref: Column) -> list[Column]:
    """MAE, RMSE, MAPE of non-zero labels, and Pearson that is 0 for a constant side."""
    e = est - ref
    return [F.round(x, 4).alias(n) for n, x in (("mae", F.avg(F.abs(e))), ("rmse", F.sqrt(F.avg(e * e))), ("mape", 100.0 * F.avg(F.when(ref != 0, F.abs(e) / F.abs(ref)))), ("pearson", F.coalesce(safe_pearson(est, ref), F.lit(0.0))))]


def confidence_bin(conf: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, high in CONFIDENCE_BINS:
        out = F.when((conf >= low) & (conf < high), f"{low:.1f}-{min(high, 1.0):.1f}").otherwise(out)
    return out


def calibration_error(rows: DataFrame, conf: str, hit: str, bins: int = 10) -> DataFrame:
    """Expected calibration error: the gap of mean confidence and hit rate by equal bins, weighted by size."""
    by = rows.groupBy(F.least(F.floor(F.col(conf) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(conf).alias("c"), F.avg(F.col(hit).cast("double")).alias("h"))
    return by.agg(F.round(F.sum(F.col("n") * F.abs(F.col("c") - F.col("h"))) / F.sum("n"), 6).alias("ece"), F.sum("n").alias("windows"))


def worst(rows: DataFrame, by: str, error: Column, tie: list[str], k: int = 5) -> DataFrame:
    """The k rows of the largest absolute error of each group.  Each task keeps k a group before anything is shuffled."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.abs(error).desc(), *tie)))
    return ranked.where(F.col("rank") <= k)


def percentiles(rows: DataFrame, columns: dict[str, Column], *by: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(by, name_p50, name_p95 ...): linear percentiles of each group by name.  They are exact, as reports compare them,
    and no task holds a group.  A group without any value has no row."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), c.cast("double").alias("x")) for name, c in columns.items()]))
    found = quantiles(rows.select(*by, pairs.alias("p")).select(*by, "p.name", "p.x"), "x", shares, *by, "name", nan=True)
    at = lambda name, q: F.max(F.when((F.col("name") == name) & (F.col("share") == q), F.col("value")))
    return found.groupBy(*by).agg(*[F.round(at(name, q), 4).alias(f"{name}_p{round(q * 100)}") for name in columns for q in shares])


def issue_counts(rows: DataFrame, by: list[str], codes: str) -> DataFrame:
    """(by, code, n): how often each single code occurs in the arrays ``codes``."""
    return rows.select(*by, F.explode(codes).alias("code")).groupBy(*by, "code").agg(F.count(F.lit(1)).alias("n"))


#: Bounds of a data set that is fit for training, by share of subjects: (side, pressure, least share).
SUFFICIENT = {
    "systolic_low": ("sbp", "<=", 100.0, 0.05), "systolic_high": ("sbp", ">=", 160.0, 0.05), "systolic_elevated": ("sbp", ">=", 140.0, 0.20),
    "diastolic_low": ("dbp", "<=", 60.0, 0.05), "diastolic_high": ("dbp", ">=", 100.0, 0.05), "diastolic_elevated": ("dbp", ">=", 85.0, 0.20),
}
LEAST_SUBJECTS, LEAST_SAMPLES = 85, 255


def sufficiency(rows: DataFrame, subject: str, sbp: str, dbp: str) -> DataFrame:
    """One row: subjects, samples, the six shares of subjects by their mean pressures, what is lacking, and if all is
    enough."""
    means = rows.groupBy(subject).agg(F.avg(sbp).alias("sbp"), F.avg(dbp).alias("dbp"), F.count(F.lit(1)).alias("n"))
    shares = {k: F.avg(((F.col(c) <= bound) if side == "<=" else (F.col(c) >= bound)).cast("double")).alias(k) for k, (c, side, bound, _) in SUFFICIENT.items()}
    out = means.agg(F.count(F.lit(1)).alias("subjects"), F.coalesce(F.sum("n"), F.lit(0)).alias("samples"), *shares.values())
    short = [F.when(F.col("subjects") < LEAST_SUBJECTS, "subjects"), F.when(F.col("samples") < LEAST_SAMPLES, "samples"), *[F.when(F.coalesce(k, F.lit(0.0)) < least, k) for k, (_, _, _, least) in SUFFICIENT.items()]]
    return out.withColumn("lacking", F.filter(F.array(*short), lambda x: x.isNotNull())).withColumn("passed", F.size("lacking") == 0)


def rank_auc(rows: DataFrame, score: str, label: str, tie: str, ranges: int = 200) -> DataFrame:
    """(auc) of label 1 by rank of ``score``, ties in the order of ``tie``.

    Scores are cut into ranges of about equal counts, which are ranked apart; the counts of the ranges before, a few
    hundred numbers, are added.
    """
    cuts = sorted(set(rows.approxQuantile(score, [k / ranges for k in range(1, ranges)], 0.001)))
    part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(score))) if cuts else F.lit(0)
    rows = rows.where(F.col(score).isNotNull()).select(part.alias("part"), F.col(score).alias("score"), F.col(label).alias("label"), F.col(tie).alias("tie"))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("score", "tie"))).join(F.broadcast(before), "part")
    p, n = F.sum("label"), F.count(F.lit(1))
    ranks = F.sum(F.when(F.col("label") == 1, (F.col("rank") + F.col("before")).cast("double")).otherwise(0.0))
    return ranked.agg(((ranks - p * (p + 1) / 2) / F.nullif(p * (n - p), F.lit(0))).alias("auc"))


def interval_means(windows: DataFrame, samples: DataFrame, key: str, seconds: int) -> DataFrame:
    """Windows (id, key, t), which last ``seconds``, with samples and reference: the number and mean of the samples
    (key, t, value) in each, ends included.  Both sides are cut into slots of a window's length, so a row only meets
    those of its own slot or the next, whatever a key holds."""
    slot = F.floor(F.col("t") / seconds)
    w = windows.select("id", key, F.col("t").alias("start"), F.explode(F.array(slot, slot + 1)).alias("slot"))
    s = samples.select(key, "t", "value", slot.alias("slot"))
    return w.join(s, [key, "slot"]).where(F.col("t").between(F.col("start"), F.col("start") + seconds)).groupBy("id").agg(F.count(F.lit(1)).alias("samples"), F.avg("value").alias("reference"))


def interpolated(samples: DataFrame, key: str, order: list[str], step: float) -> DataFrame:
    """(key, t, value) on a grid of ``step``, linearly between each two samples (key, t, value) in a row, ends included."""
    by = Window.partitionBy(key).orderBy(*order)
    end = F.max("t").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    pair = samples.select(key, "t", "value", F.lead("t").over(by).alias("t2"), F.lead("value").over(by).alias("v2"), end.alias("end")).where("t2 > t")
    on_end = (F.col("t2") == F.col("end")) & (F.ceil(F.col("t2") / step) == F.col("t2") / step)
    first, last = F.ceil(F.col("t") / step), F.ceil(F.col("t2") / step) - F.when(on_end, 0).otherwise(1)
    grid = pair.where(first <= last).withColumn("k", F.explode(F.sequence(first, last)))
    at = F.col("k") * step
    return grid.select(key, at.alias("t"), (F.col("value") + (F.col("v2") - F.col("value")) * (at - F.col("t")) / (F.col("t2") - F.col("t"))).alias("value"))
