"""Date-window policies: decisions for records, splits, audits, and the intersection of policy clauses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsieve.functions import dates

#: Words in a comment that speak for a reviewed publication (fixed values).
REVIEW_SIGNALS = ("accepted", "published", "appears in", "journal", "conference", "proceedings?", r"proc(?:eedings?)?\.?", "transactions?", r"trans(?:actions?)?\.?")


@dataclass(frozen=True)
class Policy:
    """Literal bounds; an operator over many policies takes them as columns instead (``as_columns`` of a joined row)."""

    start: str | None = None
    end: str | None = None
    start_inclusive: bool = True
    end_inclusive: bool = False
    enabled: bool = True
    split_preprints: bool = False

    def columns(self) -> dict[str, Column]:
        day = lambda text: F.lit(text).cast("date")
        return {"start": day(self.start), "end": day(self.end), "start_inclusive": F.lit(self.start_inclusive), "end_inclusive": F.lit(self.end_inclusive)}


def window_status(raw: Column, interval: Column, policy: dict[str, Column], enabled: Column | bool = True) -> Column:
    """Plain mode: the first day of the published date, whose ``interval`` is a column, against the window."""
    return (
        F.when(~F.lit(enabled) if isinstance(enabled, bool) else ~enabled, "disabled")
        .when(dates.blank_to_null(raw).isNull(), "missing_published_date")
        .otherwise(dates.overlap_status(dates.day_interval(interval.getField("start")), policy, "unparseable_published_date"))
    )


def review_status(journal_ref: Column, doi: Column, comment: Column) -> Column:
    """struct(status, basis): reviewed by reference, DOI or a signal word in the comment, else a preprint."""
    full = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    signal = F.coalesce(comment, F.lit("")).rlike(r"(?i)\b(" + "|".join(REVIEW_SIGNALS) + r")\b")
    basis = F.when(full(journal_ref), "journal_ref").when(full(doi), "doi").when(signal, "comment_signal").otherwise("default_preprint")
    return F.struct(F.when(basis == "default_preprint", "preprint").otherwise("peer_reviewed").alias("status"), basis.alias("basis"))


def decide(records: DataFrame, policy: Policy) -> DataFrame:
    """Add struct ``cutoff`` (status, pass, basis, role, start, end) to records with columns key, source, source_id,
    published_date and source_metadata (struct of published, comment, doi, journal_ref).

    In split mode preprints are judged by their submission, reviewed ones by the latest year their reference, comment or
    key names (else the published date), then by their submission; other sources by the published interval.
    """
    bounds = policy.columns()
    raw = F.col("published_date")
    result = lambda status, basis, role, iv: F.struct(
        status.alias("status"), status.isin("passed", "disabled").alias("pass"), F.lit(basis).alias("basis"), F.lit(role).alias("role"),
        iv.getField("start").alias("start"), iv.getField("end").alias("end"))
    records = dates.with_interval(records, raw, "__published")
    if not policy.enabled or not policy.split_preprints:
        plain_iv = dates.day_interval(F.col("__published.start"))
        staged = records.withColumn("__status", window_status(raw, F.col("__published"), bounds, policy.enabled))
        return staged.withColumn("cutoff", result(F.col("__status"), "published_date", "plain", plain_iv)).drop("__published", "__status")
    meta = lambda name: F.col("source_metadata").getField(name)
    years = F.array_max(F.flatten(F.array(*(dates.years_in(c) for c in (meta("journal_ref"), meta("comment"), F.col("key"))))))
    staged = records.withColumn("__submitted", F.coalesce(dates.date_interval(meta("published")), dates.month_of_id(F.col("source_id"))))
    staged = staged.withColumn("__years", years).withColumn("__stated", F.coalesce(dates.year_interval(F.col("__years")), F.col("__published"))).withColumn("__review", review_status(meta("journal_ref"), meta("doi"), meta("comment")))
    status = lambda iv, missing: dates.overlap_status(F.col(iv), bounds, missing)
    by_submission = result(status("__submitted", "missing_submitted_date"), "submitted_date", "preprint", F.col("__submitted"))
    by_statement = result(status("__stated", "missing_published_date"), "published_date", "peer_reviewed", F.col("__stated"))
    fallback = result(status("__submitted", "missing_submitted_date"), "submitted_date_fallback", "peer_reviewed", F.col("__submitted"))
    reviewed = F.when(by_statement.getField("pass"), by_statement).when(fallback.getField("pass"), fallback).otherwise(by_statement)
    other = result(status("__published", "missing_published_date"), "published_date", "published_default", F.col("__published"))
    arxiv = F.lower(F.trim(F.coalesce("source", F.lit("")))) == "arxiv"
    cutoff = F.when(arxiv & (F.col("__review.status") == "preprint"), by_submission).when(arxiv, reviewed).otherwise(other)
    return staged.withColumn("cutoff", cutoff).drop("__published", "__submitted", "__years", "__stated", "__review")


def split(decided: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept rows, excluded rows, and counts by status."""
    counts = decided.groupBy(F.col("cutoff.status").alias("status")).agg(F.count("*").alias("n"))
    return decided.filter("cutoff.pass"), decided.filter("not cutoff.pass"), counts


EXCLUDED = "exclude (cutoff_time_window)"


def exclude_row(verdict: Column, state: Column, status: Column, keep_first: bool = True) -> dict[str, Column]:
    """Columns of a row that the window excludes; the verdict before is saved, once (``keep_first``) or every time."""
    already = F.coalesce(verdict, F.lit("")) == EXCLUDED
    saved = F.when(already, F.col("pre_cutoff_final_verdict")).otherwise(verdict) if keep_first else verdict
    saved_state = F.when(already, F.col("pre_cutoff_review_state")).otherwise(state) if keep_first else state
    return {
        "pre_cutoff_final_verdict": saved, "pre_cutoff_review_state": saved_state, "final_verdict": F.lit(EXCLUDED),
        "review_state": F.lit("cutoff_filtered"), "discard_reason": F.concat(F.lit("cutoff_time_window:"), status),
    }


def restore_row(verdict: Column, state: Column, reason: Column, inferred: Column) -> dict[str, Column]:
    """Columns of a row that passes the window: an earlier exclusion is undone from what was saved, else inferred."""
    hit = (F.coalesce(verdict, F.lit("")) == EXCLUDED) | (F.coalesce(state, F.lit("")) == "cutoff_filtered") | F.coalesce(reason, F.lit("")).startswith("cutoff_time_window:")
    saved = F.col("pre_cutoff_final_verdict")
    saved = F.when((saved != "") & (saved != EXCLUDED), saved)
    was = F.col("pre_cutoff_review_state")
    return {
        "final_verdict": F.when(hit, F.coalesce(saved, inferred, verdict)).otherwise(verdict),
        "review_state": F.when(hit & saved.isNotNull() & was.isNotNull() & ~was.isin("", "cutoff_filtered"), was).otherwise(state),
        "discard_reason": F.when(hit & (saved.isNotNull() | inferred.isNotNull()), F.lit(None)).otherwise(reason),
    }


def intersect_clauses(clauses: DataFrame, by: list[str]) -> DataFrame:
    """One window per group: latest start and earliest end of the projectable hard clauses; fallback clauses only bind
    where a group has no hard one. Columns: hardness, project (boolean), start, end."""
    live = clauses.filter("project").withColumn("has_hard", F.max((F.col("hardness") == "hard").cast("int")).over(Window.partitionBy(*by)))
    bound = live.filter((F.col("hardness") == "hard") | (F.col("has_hard") == 0))
    return bound.groupBy(*by).agg(F.max("start").alias("start"), F.min("end").alias("end"), (F.max("has_hard") == 0).alias("fallback_applied"), F.count("*").alias("n_clauses"))


def meetings(left: DataFrame, right: DataFrame, on: list[str], interval: str, window: str, days: int = 32) -> DataFrame:
    """Pairs of rows that agree in ``on`` and whose closed day intervals meet: records and the policies of their paper, each pair
    once. ``interval`` and ``window`` are structs (start, end); a window's null bound is open, a null interval meets nothing.

    Both sides are laid out in buckets of ``days``, and a pair is taken in the first bucket that both have. Open bounds reach to
    the ends of what the left side holds, which is one row. ``on`` may be empty.
    """
    day = lambda c: F.floor(F.unix_date(c) / days).cast("int")
    reach = left.agg(F.min(f"{interval}.start").alias("__low"), F.max(f"{interval}.end").alias("__high"))
    clipped = right.join(F.broadcast(reach)).withColumns({"__s": F.greatest(F.coalesce(f"{window}.start", "__low"), "__low"), "__e": F.least(F.coalesce(f"{window}.end", "__high"), "__high")}).filter("__s <= __e")
    r = clipped.select(*right.columns, "__s", "__e", day(F.col("__s")).alias("__first_r"), F.explode(F.sequence(day(F.col("__s")), day(F.col("__e")))).alias("__bucket"))
    known = left.filter(F.col(f"{interval}.start") <= F.col(f"{interval}.end"))
    l = known.select("*", day(F.col(f"{interval}.start")).alias("__first_l"), F.explode(F.sequence(day(F.col(f"{interval}.start")), day(F.col(f"{interval}.end")))).alias("__bucket"))  # noqa: E741
    met = l.join(r, [*on, "__bucket"]).filter((F.col("__bucket") == F.greatest("__first_l", "__first_r")) & (F.col(f"{interval}.start") <= F.col("__e")) & (F.col(f"{interval}.end") >= F.col("__s")))
    return met.drop("__bucket", "__first_l", "__first_r", "__s", "__e")
