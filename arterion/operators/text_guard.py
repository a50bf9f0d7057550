"""Guards over explanation texts: numbers that aren't among the allowed ones, and claims of a diagnosis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[0-9]+(?:[.,][0-9]+)?"
# Units of measurements and phrases of a claim, with the words that negate one.
MEASUREMENT = r"(?i)([0-9]+(?:[.,][0-9]+)?)\s*(?:bpm|brpm|mmhg|ms\b|mili\s*giây|nhịp\s*thở\s*/\s*phút|nhịp\s*/\s*phút|lần\s*/\s*phút)"
CLAIMS = ("chẩn đoán", "bạn bị", "bạn mắc", "mắc bệnh", "bị bệnh", "rối loạn nhịp", "suy tim", "bệnh tim", "tăng huyết áp", "diagnos", "you have")
NEGATIONS = ("không", "chưa", "not ", "no ")
BACK, TOLERANCE = 30, 0.051


def numbers(text: Column) -> Column:
    """All numbers of a text, a comma as a decimal point."""
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))


def unverified(text: Column, allowed: Column) -> Column:
    """The measured numbers of a text that are near none of the allowed ones."""
    found = F.transform(F.regexp_extract_all(text, F.lit(MEASUREMENT), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit(".")).cast("double"))
    return F.filter(found, lambda v: ~F.exists(allowed, lambda a: F.abs(v - a) <= TOLERANCE))


def claims(text: Column, phrases: tuple[str, ...] = CLAIMS, negations: tuple[str, ...] = NEGATIONS) -> Column:
    """The phrases that occur without a negation in the 30 characters before, once for each such place."""
    low = F.lower(text)

    def of(phrase: str) -> Column:
        parts = F.split(low, r"\Q" + phrase + r"\E", -1)
        # What stands before a place is the end of the parts up to it, put together again.
        before = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.right(F.array_join(F.slice(parts, 1, k), phrase), F.lit(BACK)))
        plain = F.filter(before, lambda b: ~F.exists(F.array(*[F.lit(n) for n in negations]), lambda n: F.contains(b, n)))
        return F.when(F.contains(low, F.lit(phrase)), F.transform(plain, lambda _: F.lit(phrase))).otherwise(F.expr("cast(array() as array<string>)"))

    return F.flatten(F.array(*[of(p) for p in phrases]))


def check(text: Column, allowed: Column) -> Column:
    """The violations of a text."""
    empty = F.coalesce(F.trim(text) == "", F.lit(True))
    found = F.array(F.when(F.size(unverified(text, allowed)) > 0, "UNVERIFIED_NUMBER"), F.when(F.size(claims(text)) > 0, "DIAGNOSTIC_CLAIM"))
    return F.when(empty, F.array(F.lit("EMPTY_OUTPUT"))).otherwise(F.filter(found, lambda x: x.isNotNull()))
