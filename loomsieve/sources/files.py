"""Readers and writers of keyed records: JSON lines, JSON documents, CSV, key lists, whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomsieve.operators.dedupe import by_key


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, mode: str = "strict") -> DataFrame:
    """``strict`` fails on a malformed line, ``lenient`` drops it. The path of each row's file is in ``source_path``."""
    modes = {"strict": "FAILFAST", "lenient": "DROPMALFORMED"}
    return spark.read.schema(schema).option("mode", modes[mode]).json(path).select("*", F.col("_metadata.file_path").alias("source_path"))


def numbered_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(source_path, line_no from 1, row) of non-blank lines.

    Lines are counted within each split of a file as tasks read it, and numbered by the splits before, so a large file is
    not one task.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("split"))
    numbered = lines.mapInArrow(_within_splits, "value string, source_path string, split long, nth long")
    sizes = numbered.groupBy("source_path", "split").agg(F.max("nth").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source_path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("source_path", "split", before.alias("before"))
    rows = numbered.filter(F.trim("value") != "").join(starts, ["source_path", "split"])
    return rows.select("source_path", (F.col("before") + F.col("nth")).cast("int").alias("line_no"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row"))


def _within_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of each line within its split, from 1; a task reads the lines of a split in order."""
    seen: dict[tuple[str, int], int] = {}
    for batch in batches:
        nth = []
        for place in zip(batch.column("source_path").to_pylist(), batch.column("split").to_pylist(), strict=True):
            seen[place] = seen.get(place, 0) + 1
            nth.append(seen[place])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth, pa.int64())], [*batch.schema.names, "nth"])


def json_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of JSON documents: a list, or the first of records, items and data of an object. A malformed document is an
    error. A document is one row until it is parsed."""
    kind = T.ArrayType(schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema))
    boxed = T.StructType([T.StructField(name, kind) for name in ("records", "items", "data")])
    value, strict = F.col("value"), {"mode": "FAILFAST"}
    whole = spark.read.text(path, wholetext=True).filter(F.trim("value") != "")
    box = F.from_json(F.when(~F.ltrim(value).startswith("["), value), boxed, strict)
    rows = whole.select(F.from_json(F.when(F.ltrim(value).startswith("["), value), kind, strict).alias("list"), box.alias("box"))
    return rows.select(F.explode(F.coalesce("list", "box.records", "box.items", "box.data")).alias("r")).filter("r is not null").select("r.*")


def keyed(df: DataFrame, key: str, pos: str, keep: str = "last") -> DataFrame:
    """One row per non-blank trimmed key."""
    known = df.withColumn(key, F.nullif(F.trim(F.col(key).cast("string")), F.lit("")))
    return by_key(known, [key], pos, keep)


def csv(spark: SparkSession, path: str) -> DataFrame:
    """With a header; a byte order mark before it is dropped; all columns are text."""
    df = spark.read.option("header", True).option("multiLine", True).csv(path)
    return df.toDF(*(c.removeprefix("﻿") for c in df.columns))


def key_list(spark: SparkSession, path: str) -> DataFrame:
    """Keys of a list, one per line; blank lines and lines that begin with # don't count."""
    value = F.trim("value")
    return spark.read.text(path).select(value.alias("key")).filter((F.col("key") != "") & ~F.col("key").startswith("#")).distinct()


def binary_listing(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """(path, name, stem, length) of all files under a path; hidden ones, and those that begin with a dot and an underscore,
    don't count. Contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    found = found.select("path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "length")
    return found.filter(~F.col("name").startswith("._") & F.col("name").endswith(suffix))


def to_convert(sources: DataFrame, done: DataFrame, least: int = 1) -> DataFrame:
    """Listed files whose stem has no finished file of at least so many bytes yet."""
    return sources.join(done.filter(F.col("length") >= least).select("stem").distinct(), "stem", "left_anti")


def markdown_lines(df: DataFrame, columns: list[str], pos: str) -> DataFrame:
    """A Markdown table as (pos, line): heading and rule at -2 and -1, then the rows in the order of ``pos``. Bars in values
    are escaped, null values are empty; doubles have four digits."""

    def cell(c: str) -> Column:
        kind = df.schema[c].dataType
        shown = F.format_string("%.4f", F.col(c)) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.col(c).cast("string")
        return F.coalesce(F.replace(F.when(F.col(c).isNotNull(), shown), F.lit("|"), F.lit("\\|")), F.lit(""))

    line = lambda cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    rows = df.select(F.col(pos).cast("long").alias("pos"), line([cell(c) for c in columns]).alias("line"))
    head = df.sparkSession.createDataFrame([(-2, "| " + " | ".join(columns) + " |"), (-1, "| " + " | ".join("---" for _ in columns) + " |")], "pos long, line string")
    return head.unionByName(rows)


def by_folder(spark: SparkSession, pattern: str, schema: str, folder: str = r"/([^/]+)/metadata/[^/]+$") -> DataFrame:
    """JSON lines of many folders, with the folder's name as ``paper_id``."""
    rows = json_lines(spark, pattern, schema)
    return rows.withColumn("paper_id", F.regexp_extract("source_path", folder, 1))


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """JSON lines, nulls kept; a task's file appears when it is whole."""
    out = df.write.mode("errorifexists").option("ignoreNullFields", False)
    (out.partitionBy(*partition_by) if partition_by else out).json(path)


def write_report(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV in a fixed column order: booleans as true and false, doubles with two digits, commas in texts as semicolons."""
    shown = []
    for c in columns:
        kind = df.schema[c].dataType
        col = F.format_string("%.2f", F.col(c)) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.replace(F.col(c), F.lit(","), F.lit(";")) if isinstance(kind, T.StringType) else F.col(c).cast("string")
        shown.append(col.alias(c))
    df.select(*shown).write.mode("errorifexists").option("header", True).csv(path)
