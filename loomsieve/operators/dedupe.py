"""Keyed de-duplication; the order that decides is always an explicit column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_key(df: DataFrame, keys: list[str], pos: str, keep: str = "first") -> DataFrame:
    """One row per key. ``first`` and ``last`` by ``pos``; ``first_pos_last_val`` takes the last row at the first position.

    Rows whose key is null in any part are dropped. The choice is an aggregate, so copies shrink before the shuffle and
    one key's rows never sort in a single task.
    """
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*(F.col(f"`{c}`") for c in others))
    pick = F.min_by(row, pos) if keep == "first" else F.max_by(row, pos)
    known = df.dropna(subset=keys)
    grouped = known.groupBy(*keys).agg(pick.alias("__row"), F.min(pos).alias("__first"))
    columns = [F.col("__first").alias(c) if keep == "first_pos_last_val" and c == pos else F.col(f"__row.`{c}`").alias(c) for c in others]
    return grouped.select(*keys, *columns)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def first_with_counts(df: DataFrame, key: str, pos: str, allow: DataFrame | None = None, most: int | None = None, strict: bool = False) -> DataFrame:
    """The first row of each key with how many it has (n_rows); only keys on an allow list, and the first ``most`` by position,
    where those are given. ``strict`` makes a blank key an error; else such rows are dropped."""
    trimmed = F.nullif(F.trim(F.col(key).cast("string")), F.lit(""))
    known = df.withColumn(key, F.coalesce(trimmed, F.raise_error(F.lit("a row has no usable key")).cast("string")) if strict else trimmed)
    if allow is not None:
        known = known.join(allow.select(key).distinct(), key, "left_semi")
    counts = known.dropna(subset=[key]).groupBy(key).agg(F.count("*").alias("n_rows"))
    out = by_key(known, [key], pos).join(counts, key)
    return out if most is None else out.orderBy(pos, key).limit(most)


def disagreement(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: rows, distinct values (null is one), and whether they disagree."""
    seen = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), (F.count_distinct(value) + F.max(F.col(value).isNull().cast("int"))).alias("n_values"))
    return seen.withColumn("disagrees", F.col("n_values") > 1)


def unique_index(df: DataFrame, key: str, value: str) -> DataFrame:
    """key -> value, for keys that stand for exactly one value."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("__most")).filter(F.col(value) == F.col("__most")).drop("__most")


def numbered(df: DataFrame, by: list[str], pos: str, out: str, ranges: int = 64) -> DataFrame:
    """The number of each row in its group, from 1, in the order of the numeric ``pos``.

    Groups are cut into ranges at approximate quantiles of ``pos``, rows are numbered within a range and moved on by the
    counts of the ranges before, so a group of any size is spread over tasks.
    """
    place = F.col(pos).cast("double")
    cuts = sorted(set(df.select(place.alias("p")).approxQuantile("p", [i / ranges for i in range(1, ranges)], 0.5 / ranges)))
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= place)) if cuts else F.lit(0)
    rows = df.withColumn("__range", F.coalesce(at, F.lit(0)))
    sizes = rows.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    # Null groups and ranges meet as well.
    starts = sizes.select(F.struct(*by, "__range").alias("__group"), F.coalesce(before, F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(pos))
    both = rows.withColumns({"__nth": nth, "__group": F.struct(*by, "__range")}).alias("r").join(starts.alias("s"), F.col("r.__group").eqNullSafe(F.col("s.__group")))
    return both.select(*(F.col(f"r.{c}") for c in df.columns), (F.col("__before") + F.col("__nth")).alias(out))


def collision_free(df: DataFrame, base: str, pos: str, out: str, suffix: str = "__dup") -> DataFrame:
    """Names made unique: the first keeps the base, later ones get a number."""
    name = F.when(F.col("__k") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit(suffix), (F.col("__k") - 1).cast("string")))
    return numbered(df, [base], pos, "__k").withColumn(out, name).drop("__k")


def batches(df: DataFrame, pos: str, size: int, by: list[str], out: str = "batch") -> DataFrame:
    """Consecutive batches of ``size`` rows within each group."""
    if size <= 0:
        raise ValueError("size must be positive")
    return numbered(df, by, pos, "__k").withColumn(out, F.floor((F.col("__k") - 1) / size).cast("long")).drop("__k")
