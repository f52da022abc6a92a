"""Date expressions: partial dates as closed day intervals, and where an interval lies against a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
_NAMED = r"^([A-Za-z]+) (\d{1,2}), (\d{4})$"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def blank_to_null(text: Column) -> Column:
    """Trimmed text; null for blank text and for the word null."""
    t = F.trim(text.cast("string"))
    return F.when((t == "") | (F.lower(t) == "null"), F.lit(None)).otherwise(t)


def _parsed(iso: Column) -> Column:
    """A day of ``year-month-day``; null for days that don't exist and for the year 0."""
    return F.when(~iso.startswith("0000"), iso.try_cast("date"))


def _month_number(name: Column) -> Column:
    """Of a full or three-letter English month, in any case."""
    numbers = {m[:n]: str(k + 1) for k, m in enumerate(MONTHS) for n in (3, len(m))}
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in numbers.items() for x in pair)), F.lower(name))


def _day_text(t: Column) -> Column:
    """A full date or date-time as ``year-month-day``; null for other texts."""
    part = lambda k: F.regexp_extract(t, _NAMED, k)
    return (
        F.when(t.rlike(_ISO), F.substring(t, 1, 10))
        .when(t.rlike(r"^\d{8}$"), F.concat_ws("-", F.substring(t, 1, 4), F.substring(t, 5, 2), F.substring(t, 7, 2)))
        .when(t.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.translate(t, "/", "-"))
        .when(t.rlike(_NAMED), F.concat(part(3), F.lit("-"), _month_number(part(1)), F.lit("-"), part(2)))
    )


def exact_day(text: Column) -> Column:
    """The day of a full date or date-time; its offset doesn't move it. Null for anything else."""
    return _parsed(_day_text(blank_to_null(text)))


def _first_day(t: Column) -> Column:
    """Of a day, a ``YYYY-MM`` month or a ``YYYY`` year, by one parse."""
    return _parsed(F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01"))).when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01"))).otherwise(_day_text(t)))


def date_interval(text: Column) -> Column:
    """struct(start, end) of a day, a ``YYYY-MM`` month or a ``YYYY`` year; null where none can be read.

    Use ``with_interval`` where more than one expression needs it, and for any text that isn't a plain column.
    """
    t = blank_to_null(text)
    # The start is bound once; what it stands for shows in the text's length.
    end = lambda day: F.when(F.length(t) == 4, F.make_date(F.year(day), F.lit(12), F.lit(31))).when(F.length(t) == 7, F.last_day(day)).otherwise(day)
    both = F.transform(F.array(_first_day(t)), lambda day: F.when(day.isNotNull(), F.struct(day.alias("start"), end(day).alias("end"))))
    return F.get(both, F.lit(0))


def with_interval(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Add the interval of a text as a column that later expressions refer to, so that a row is parsed once; the text itself is
    a column first, since each branch of the parse refers to it."""
    named = f"__text_of_{out}"
    return df.withColumn(named, text).withColumn(out, date_interval(F.col(named))).drop(named)


def parse_status(text: Column, interval: Column | None = None) -> Column:
    """``interval`` is the text's, where it is at hand."""
    found = _first_day(blank_to_null(text)) if interval is None else interval
    return F.when(blank_to_null(text).isNull(), "missing_empty").when(found.isNull(), "unparseable").otherwise("parsed")


def month_of_id(identifier: Column) -> Column:
    """Interval of a ``YYMM.number`` identifier (optional version); null for others, and for months that don't exist."""
    t = F.trim(identifier)
    known = t.rlike(r"^\d{2}(0[1-9]|1[0-2])\.\d+(v\d+)?$")
    start = F.when(known, _parsed(F.concat(F.lit("20"), F.substring(t, 1, 2), F.lit("-"), F.substring(t, 3, 2), F.lit("-01"))))
    return F.when(known, F.struct(start.alias("start"), F.last_day(start).alias("end")))


def years_in(text: Column) -> Column:
    """All years 1900 to 2099 that stand apart from other digits."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<!\d)(19\d{2}|20\d{2})(?!\d)"), 1), lambda y: y.cast("int"))


def year_interval(year: Column) -> Column:
    day = lambda month, day: F.make_date(year, F.lit(month), F.lit(day))
    return F.when(year.between(1, 9999), F.struct(day(1, 1).alias("start"), day(12, 31).alias("end")))


def overlap_status(interval: Column, policy: dict[str, Column], missing: str) -> Column:
    """Whether a closed interval meets the window at all; the start is tested before the end.

    ``policy`` holds start, end (date or null), start_inclusive and end_inclusive.
    """
    iv = interval.getField
    start, end = policy["start"], policy["end"]
    return (
        F.when(interval.isNull(), missing)
        .when(policy["start_inclusive"] & (iv("end") < start), "before_start")
        .when(~policy["start_inclusive"] & (iv("end") <= start), "before_or_equal_start")
        .when(policy["end_inclusive"] & (iv("start") > end), "after_end")
        .when(~policy["end_inclusive"] & (iv("start") >= end), "after_or_equal_end")
        .otherwise("passed")
    )


def day_interval(day: Column) -> Column:
    return F.when(day.isNotNull(), F.struct(day.alias("start"), day.alias("end")))
