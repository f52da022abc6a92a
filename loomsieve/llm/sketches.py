"""Document fingerprints as threshold-scaled sketches, in DataFrame functions only.

A sketch keeps every word-shingle hash below a fixed fraction of the hash space, so sketches of any sizes can be merged
(union) and compared, and its size follows the document's. A document of which no hash is that low keeps its least hash.

Defined results: a null text counts as empty; a text without words has an empty sketch; fewer words than a shingle make
one shingle; two empty sketches are alike (1), an empty and another aren't (0); repeated rows and ids each give a row,
rows with equal ids follow each other by text, null ids come first; an empty table gives an empty table.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomsieve.llm.common import documents, partitions

SHINGLE_WORDS = 5
#: One hash of so many is kept.
SCALE = 4


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def _shingles(words: Column, width: int) -> Column:
    """Hashes of all shingles of a column of words; an attribute, since its length and its slices are both used."""
    n = F.size(words)
    return F.when(n == 0, F.array().cast("array<bigint>")).when(n < width, F.array(F.xxhash64(words))).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - (width - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, width)))
    )


def _kept(hashes: Column, scale: int) -> Column:
    limit = -(1 << 63) + (1 << 64) // scale
    low = F.filter(hashes, lambda h: h <= F.lit(limit - 1))
    least = F.when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(hashes)
    return F.array_sort(F.array_distinct(F.when(F.size(low) > 0, low).otherwise(least)))


def with_sketch(df: DataFrame, text_col: str, out: str, width: int = SHINGLE_WORDS, scale: int = SCALE) -> DataFrame:
    """Add column ``out``: the sorted kept hashes (array<bigint>) of the text column."""
    w, h = f"__words_{out}", f"__hashes_{out}"
    df = df.withColumn(w, _words(F.coalesce(F.col(text_col), F.lit(""))))
    df = df.withColumn(h, _shingles(F.col(w), width))
    return df.withColumn(out, _kept(F.col(h), scale)).drop(w, h)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity as the two sketches estimate it, 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Share of ``a`` found in ``b``, 0 to 1; an empty ``a`` is contained."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a)).cast("double")


def merge(a: Column, b: Column) -> Column:
    """The sketch of two documents together."""
    return F.array_sort(F.array_union(a, b))


def as_string(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.hex(h))), ",")


def with_next(df: DataFrame, order_col: str, columns: list[str], tie: str, prepare: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Add ``next_<c>``: column c of the following row in ascending order, the first row's after the last. The order
    column is numeric.

    Rows are cut into ranges of the order column at approximate quantiles; each range also gets the first row of the next
    one, so every range is a bounded window and no task orders the whole table. ``prepare`` adds columns (some of
    ``columns`` may be among them) once the ranges' first rows are known, so that they aren't computed to find those.
    """
    spark = df.sparkSession
    wanted = 8 * partitions(spark)
    key = F.col(order_col).cast("double")
    cuts = sorted(set(df.select(key.alias("k")).approxQuantile("k", [i / wanted for i in range(1, wanted)], 1 / (4 * wanted))))
    raw = df.withColumn("__range", _position(cuts, key))
    rank = F.struct(F.col(order_col).alias("o"), F.col(tie).alias("t"))
    heads = raw.groupBy("__range").agg(F.min_by(F.struct(*(f"`{c}`" for c in df.columns)), rank).alias("__head"))
    heads, df = prepare(heads.select("__range", "__head.*")), prepare(raw)
    ranges = [r[0] for r in heads.select("__range").orderBy("__range").collect()]  # as many as ranges
    if not ranges:
        return df.select("*", *(F.col(c).alias(f"next_{c}") for c in columns)).drop("__range")
    follows = spark.createDataFrame([(r, ranges[i - 1]) for i, r in enumerate(ranges)], "__range int, __to int")
    heads = heads.join(F.broadcast(follows), "__range").select(F.col("__to").alias("__range"), *columns, F.lit(1).alias("__sentinel"))
    both = df.withColumn("__sentinel", F.lit(0)).unionByName(heads, allowMissingColumns=True)
    window = Window.partitionBy("__range").orderBy("__sentinel", order_col, tie)
    out = both.select("*", F.lead(F.struct(*columns)).over(window).alias("__next"))
    return out.filter("__sentinel = 0").select(*(c for c in df.columns if c != "__range"), *(F.col(f"__next.{c}").alias(f"next_{c}") for c in columns))


def _position(cuts: list[float], value: Column) -> Column:
    """How many of the sorted cuts are <= value (0 for null), by halving."""
    table = F.from_json(F.lit(json.dumps(cuts)), "array<double>")  # folded to one literal when the query is planned
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, len(cuts)).bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(table, low + step - 1) <= value, low + step).otherwise(low))


def op5_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(docs, "doc_id", ["text", "sketch"], tie="text", prepare=lambda d: with_sketch(d, "text", "sketch")).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half))
    docs = docs.select("doc_id", "n_chars", "sketch", "next_sketch", edited.alias("edited"))
    docs = with_sketch(docs, "edited", "edited_sketch")
    return docs.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"), as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


QUERIES = {"op5_sketches": op5_sketches}
