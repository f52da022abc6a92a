"""Evaluation of predictions against labels: confusion, averages over runs, stability, histograms, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomsieve.functions.verdicts import ratio


def confusion(df: DataFrame, predicted: Column, gold: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn of two boolean columns, in one aggregate; rows with a null in either don't count."""
    cells = {"tp": predicted & gold, "fp": predicted & ~gold, "tn": ~predicted & ~gold, "fn": ~predicted & gold}
    return df.groupBy(*(by or [])).agg(*(F.count_if(test).alias(name) for name, test in cells.items()))


def with_ratios(counts: DataFrame, digits: int | None = 6) -> DataFrame:
    tp, fp, tn, fn = map(F.col, ("tp", "fp", "tn", "fn"))
    out = {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + tn + fn)}
    return counts.select("*", *((c if digits is None else F.round(c, digits)).alias(n) for n, c in out.items()))


def macro_micro(counts: DataFrame, digits: int = 6) -> DataFrame:
    """One row: mean of the runs' ratios, and the ratios of their summed counts."""
    each = with_ratios(counts, None)
    total = each.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")), *(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    micro = with_ratios(total, digits)
    return micro.select(*(F.round(f"macro_{c}", digits).alias(f"macro_{c}") for c in ("precision", "recall", "f1")), *(F.col(c).alias(f"micro_{c}") for c in ("precision", "recall", "f1", "accuracy")))


def mean_spread(df: DataFrame, value: Column, by: list[str], digits: int = 6) -> DataFrame:
    """Mean and population deviation; 0.0 for groups without a value."""
    return df.groupBy(*by).agg(F.round(F.coalesce(F.avg(value), F.lit(0.0)), digits).alias("mean"), F.round(F.coalesce(F.stddev_pop(value), F.lit(0.0)), digits).alias("spread"))


def stability(df: DataFrame, keys: list[str], predicted: Column) -> DataFrame:
    """Per key over runs: how often positive, and whether the runs disagree."""
    p = predicted.cast("int")
    return df.groupBy(*keys).agg(F.count(p).alias("n_runs"), F.round(F.avg(p), 6).alias("positive_rate"), (F.count_distinct(p) > 1).alias("unstable"))


def histogram(df: DataFrame, value: Column, buckets: dict[str, Column], by: list[str]) -> DataFrame:
    """Counts of named tests of a value, of missing ones, and of all."""
    return df.groupBy(*by).agg(*(F.count_if(test).alias(name) for name, test in buckets.items()), F.count_if(value.isNull()).alias("missing"), F.count("*").alias("total"))


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; the rank limit is applied before the shuffle as well."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def value_counts(df: DataFrame, value: str, key: str) -> DataFrame:
    """Distinct values with their count, their place by falling count and then by value, and their distinct keys, sorted.

    There are few values, so one small table is numbered.
    """
    counts = df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(key)), ",").alias("keys"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), F.asc("value"))))


def reasons_line(counts: DataFrame, by: list[str], reason: str, n: str, k: int = 3) -> DataFrame:
    """The k most frequent reasons of each group as ``reason:n | reason:n``."""
    top = top_per_group(counts, by, [F.desc(n), F.asc(reason)], k)
    pairs = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", F.col(reason), F.col(n).cast("string")).alias("text"))))
    return top.groupBy(*by).agg(F.array_join(F.transform(pairs, lambda x: x["text"]), " | ").alias("reasons"))


def before_after(before: DataFrame, after: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Counts of two snapshots side by side: resolved, partial, remaining, or new."""
    a, b = before.withColumnRenamed(n, "n_before"), after.withColumnRenamed(n, "n_after")
    both = a.join(b, keys, "full_outer").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_before", "n_after")})
    state = F.when(F.col("n_before") == 0, "new").when(F.col("n_after") == 0, "resolved").when(F.col("n_after") < F.col("n_before"), "partial").otherwise("remaining")
    return both.withColumn("delta", F.col("n_after") - F.col("n_before")).withColumn("state", state)
