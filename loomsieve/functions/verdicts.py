"""Labels, scores and verdicts of reviews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label(verdict: Column) -> Column:
    """The leading lower-case word of a verdict, as ``include`` of ``include (junior:5,5)``."""
    word = F.regexp_extract(F.lower(F.coalesce(verdict, F.lit(""))), r"^\s*([a-z]+)", 1)
    return F.when(word != "", word)


def predicted(verdict: Column, positive_mode: str = "include_or_maybe", known_only: bool = False) -> Column:
    """1 or 0: include is positive in every mode, maybe by mode, exclude is not; others give null.

    ``known_only`` also takes discard as 0.
    """
    word = label(verdict)
    maybe = 0 if positive_mode == "include_only" else 1
    negative = ("exclude", "discard") if known_only else ("exclude",)
    return F.when(word == "include", 1).when(word == "maybe", maybe).when(word.isin(*negative), 0)


def lenient_boolean(value: Column, true: tuple = ("1", "true", "yes", "y"), false: tuple = ("0", "false", "no", "n")) -> Column:
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin(*true), True).when(text.isin(*false), False)


def score(value: Column, low: int = 1, high: int = 5) -> Column:
    """An integer score within bounds; null for anything else, also for fractions."""
    number = value.cast("string").try_cast("double")
    return F.when((number == F.floor(number)) & number.between(low, high), number.cast("int"))


def score_label(value: Column) -> Column:
    return F.when(value >= 4, "include").when(value == 3, "maybe").when(value <= 2, "exclude")


def panel_verdict(first: Column, second: Column, senior: Column, senior_first: bool = True) -> Column:
    """Verdict of two first-round scores and an optional senior score; null when nothing was scored."""
    by_senior = F.when(senior.isNotNull(), F.concat(score_label(senior), F.lit(" (senior:"), senior.cast("string"), F.lit(")")))
    both = first.isNotNull() & second.isNotNull()
    word = F.when((first >= 4) & (second >= 4), "include").when((first <= 2) & (second <= 2), "exclude").otherwise("maybe")
    agreed = word != "maybe"
    by_pair = F.concat(word, F.lit(" (junior:"), first.cast("string"), F.lit(","), second.cast("string"), F.lit(")"))
    by_pair = F.when(both, by_pair)
    if senior_first:
        return F.coalesce(by_senior, by_pair)
    return F.coalesce(F.when(both & agreed, by_pair), by_senior, by_pair)


def evidence_state(supports: Column, counters: Column) -> Column:
    """Of two flags (null counts as not): present, absent, mixed or insufficient."""
    s, c = F.coalesce(supports, F.lit(False)), F.coalesce(counters, F.lit(False))
    return F.when(s & c, "mixed").when(s, "present").when(c, "absent").otherwise("insufficient")


def delta_bucket(delta: Column, tolerance: float = 0.01) -> Column:
    return F.when(delta > tolerance, "better").when(delta < -tolerance, "worse").otherwise("same")


def ratio(numerator: Column, denominator: Column) -> Column:
    """0.0 on an empty denominator."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def rate(numerator: Column, denominator: Column, digits: int = 4) -> Column:
    """Null on an empty denominator, rounded half-even."""
    return F.when(denominator > 0, F.bround(F.try_divide(numerator, denominator), digits))
