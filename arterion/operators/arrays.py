"""Array expressions over windows: slices, differences, integrals, extrema and folds of a session's rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x: Column | str) -> Column:
    return F.aggregate(col(x), F.lit(0.0), lambda a, b: a + b)


def tail(x: Column | str, fs: float, seconds: float) -> Column:
    """The last seconds of a window; all of a shorter one."""
    n = max(1, round(fs * seconds))
    return F.slice(col(x), F.greatest(F.lit(1), F.size(col(x)) - n + 1), n)


def finite(x: Column | str) -> Column:
    """No null, NaN or infinite sample."""
    return F.forall(col(x), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def difference(x: Column | str) -> Column:
    x = col(x)
    return F.zip_with(F.slice(x, 2, F.size(x)), F.slice(x, 1, F.greatest(F.lit(0), F.size(x) - 1)), lambda a, b: a - b)


def gradient(x: Column | str) -> Column:
    """Central differences, one-sided at the ends."""
    x, last = col(x), F.size(col(x)) - 1

    def at(v: Column, i: Column) -> Column:
        return F.when(i == 0, F.get(x, i + 1) - v).when(i == last, v - F.get(x, i - 1)).otherwise((F.get(x, i + 1) - F.get(x, i - 1)) / 2)

    return F.transform(x, at)


def trapezoid(x: Column | str) -> Column:
    x = col(x)
    return total(x) - (F.get(x, F.lit(0)) + F.get(x, F.size(x) - 1)) / 2


def turning_points(x: Column | str) -> Column:
    """Places where the differences change sign."""
    d = difference(x)
    return F.filter(F.sequence(F.lit(1), F.size(col(x)) - 2), lambda i: F.get(d, i - 1) * F.get(d, i) < 0)


def width_above(x: Column | str, level: float) -> Column:
    """Last minus first place of at least ``level`` times the maximum."""
    x = col(x)
    at = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: F.get(x, i) >= level * F.array_max(x))
    return F.array_max(at) - F.array_min(at)


def min_max(x: Column | str, least: float = 1e-9) -> Column:
    """Scaled to [0, 1]; a flat one to zeros."""
    x = col(x)
    span = F.array_max(x) - F.array_min(x)
    return F.when(span > least, F.transform(x, lambda v: (v - F.array_min(x)) / span)).otherwise(F.transform(x, lambda _: F.lit(0.0)))


def arg_min(x: Column | str) -> Column:
    return F.array_position(col(x), F.array_min(col(x))) - 1


def state_walk(events: Column, protocol: dict[tuple[str, int, str], tuple[str, int, str | None]], start: str) -> Column:
    """struct<state,retries,failure,refused> after an ordered array of events; an event that isn't allowed where a
    measurement stands is refused: it is counted and changes nothing."""
    target = lambda x: F.struct(F.lit(x[0]).alias("state"), F.lit(x[1]).alias("retries"), F.lit(x[2]).cast("string").alias("failure"))
    table = F.create_map(*[c for (s, n, e), t in sorted(protocol.items()) for c in (F.lit(f"{s}|{n}|{e}"), target(t))])
    begin = F.struct(F.lit(start).alias("state"), F.lit(0).alias("retries"), F.lit(None).cast("string").alias("failure"), F.lit(0).cast("long").alias("refused"))

    def step(s: Column, e: Column) -> Column:
        to = F.try_element_at(table, F.concat_ws("|", s["state"], s["retries"].cast("string"), e))
        held = lambda c: F.when(to.isNull(), s[c]).otherwise(to[c]).alias(c)
        return F.struct(held("state"), held("retries"), held("failure"), (s["refused"] + to.isNull().cast("long")).alias("refused"))

    return F.aggregate(events, begin, step)


def where_mask(x: Column | str, mask: Column | str) -> Column:
    """The entries of ``x`` at which ``mask`` is true."""
    both = F.arrays_zip(col(x).alias("x"), col(mask).alias("m"))
    return F.transform(F.filter(both, lambda p: p["m"]), lambda p: p["x"])


def running_sum(x: Column | str) -> Column:
    """Sums of the first entries, one by one.  Each is a sum of its own, so this is for windows, not for whole sessions."""
    return F.transform(F.sequence(F.lit(1), F.size(col(x))), lambda n: total(F.slice(col(x), F.lit(1), n)))


def present(m: Column | str) -> Column:
    """A map without its null values."""
    return F.map_filter(col(m), lambda k, v: v.isNotNull())


def keys_in_order(m: Column | str) -> Column:
    return F.array_sort(F.map_keys(col(m)))


def green_intensity(g: Column | str) -> Column:
    """Minus the relative change of a green trace."""
    g = col(g)
    mean = F.greatest(total(g) / F.size(g), F.lit(1e-12))
    return F.transform(g, lambda v: -(v / mean - 1))
