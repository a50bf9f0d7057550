"""The eleven validation rules as Columns: a candidate row in, an array of issues and a status out.

Columns read: code, value, confidence, seconds, quality, missing, roi_values,
roi_agreement, warnings, previous_value, elapsed, recent_values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from arterion.functions import vitals as fixed

ISSUE = "struct<severity:string,code:string,detail:double>"


def by_code(values: dict[str, float], code: Column) -> Column:
    """A small fixed table as an expression; null for codes it doesn't list."""
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(code == k, F.lit(float(v))).otherwise(out)
    return out


def _issue(severity: str, code: str, detail: Column) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.bround(detail.cast("double"), 3).alias("detail")).cast(ISSUE)


def _two(value: Column, low: tuple[Column, str], high: tuple[Column, str]) -> Column:
    return F.when(low[0], _issue("ERROR", low[1], value)).when(high[0], _issue("WARNING", high[1], value))


class _Candidate:
    """The columns of a candidate row, by name."""

    def __call__(self, name: str) -> Column:
        return F.col(name)

    @property
    def value(self) -> Column:
        return F.col("value")

    @property
    def there(self) -> Column:
        return F.col("value").isNotNull()


Rule = Callable[[_Candidate], Column]


def spread(x: Column) -> Column:
    return F.array_max(x) - F.array_min(x)


def median(x: Column) -> Column:
    y, n = F.array_sort(x), F.size(x)
    return (F.get(y, ((n - 1) / 2).cast("int")) + F.get(y, (n / 2).cast("int"))) / 2


def std(x: Column) -> Column:
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mean = total(x) / F.size(x)
    return F.sqrt(total(F.transform(x, lambda v: (v - mean) * (v - mean))) / F.size(x))


def _computation(c: _Candidate) -> Column:
    return F.when(~c.there, _issue("ERROR", "COMPUTATION_FAILED", F.lit(None)))


def _window(c: _Candidate) -> Column:
    return F.when(c("seconds") < by_code(fixed.MIN_WINDOW_S, c("code")), _issue("ERROR", "WINDOW_TOO_SHORT", c("seconds")))


def _missing(c: _Candidate) -> Column:
    return _two(c("missing"), (c("missing") > fixed.MISSING[1], "MISSING_DATA_EXCESSIVE"), (c("missing") > fixed.MISSING[0], "MISSING_DATA_HIGH"))


def _quality(c: _Candidate) -> Column:
    return _two(c("quality"), (c.there & (c("quality") < fixed.QUALITY[0]), "SIGNAL_QUALITY_UNUSABLE"), (c.there & (c("quality") < fixed.QUALITY[1]), "SIGNAL_QUALITY_LOW"))


def _range(c: _Candidate) -> Column:
    low, high = (by_code({k: r[i] for k, r in fixed.RANGES.items()}, c("code")) for i in (0, 1))
    return F.when(c.there & ~c.value.between(low, high), _issue("ERROR", "OUT_OF_PHYSIOLOGICAL_RANGE", c.value))


def _jump(c: _Candidate) -> Column:
    slack = by_code({k: a for k, (a, _) in fixed.JUMP.items()}, c("code")) + by_code({k: b for k, (_, b) in fixed.JUMP.items()}, c("code")) * F.greatest(F.lit(0.0), c("elapsed"))
    step = F.abs(c.value - c("previous_value"))
    return F.when(c.there & (step > slack), _issue("WARNING", "SUDDEN_JUMP", step))


def _stability(c: _Candidate) -> Column:
    recent = F.concat(F.coalesce("recent_values", F.expr("cast(array() as array<double>)")), F.array(c.value))
    return F.when(c.there & (F.size(recent) >= fixed.STABLE_VALUES) & (std(recent) > by_code(fixed.STABLE_STD, c("code"))), _issue("WARNING", "TEMPORAL_UNSTABLE", std(recent)))


def _regions(c: _Candidate) -> Column:
    apart = F.greatest(spread(c("roi_values")), F.abs(median(c("roi_values")) - c.value))
    return F.when(c.there & (F.size("roi_values") >= 2) & (apart > by_code(fixed.ROI_SPREAD, c("code"))), _issue("WARNING", "CROSS_ROI_INCONSISTENT", apart))


def _agreement(c: _Candidate) -> Column:
    return F.when(c.there & (c("roi_agreement") < fixed.ROI_AGREEMENT), _issue("WARNING", "ROI_SIGNAL_DISAGREEMENT", c("roi_agreement")))


def _condition(c: _Candidate) -> Column:
    blocking = F.array_distinct(F.filter(F.coalesce("warnings", F.expr("cast(array() as array<string>)")), lambda w: w.isin(*fixed.BLOCKING)))
    return F.when(c.there & (F.size(blocking) > 0), _issue("WARNING", "SIGNAL_CONDITION_BLOCKING", F.size(blocking)))


def _confidence(c: _Candidate) -> Column:
    return _two(c("confidence"), (c.there & (c("confidence") < fixed.CONFIDENCE[0]), "VERY_LOW_CONFIDENCE"), (c.there & (c("confidence") < fixed.CONFIDENCE[1]), "LOW_CONFIDENCE"))


#: The rules in their order.  A rule takes a candidate and gives an issue or null; lists of one's own may hold others.
RULES: tuple[Rule, ...] = (_computation, _window, _missing, _quality, _range, _jump, _stability, _regions, _agreement, _condition, _confidence)


def issues(rules: tuple[Rule, ...] = RULES) -> Column:
    """All issues of a candidate, in the order of the rules."""
    return F.filter(F.array(*[rule(_Candidate()) for rule in rules]), lambda x: x.isNotNull())


def issue(severity: str, code: str, detail: Column | None = None) -> Column:
    """An issue, for rules of one's own."""
    return _issue(severity, code, F.lit(None) if detail is None else detail)


def status(found: Column) -> Column:
    return F.when(F.exists(found, lambda x: x["severity"] == "ERROR"), "INVALID").when(F.size(found) > 0, "BAD").otherwise("OK")
