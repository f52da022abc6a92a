"""Feeds and policy documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

POLICY = "time_policy struct<enabled:boolean,date_field:string,start_date:string,start_inclusive:boolean,end_date:string,end_inclusive:boolean,timezone:string>"


def policies(spark: SparkSession, path: str, name: str = r"([^/]+)\.json$") -> DataFrame:
    """One row per policy document: its path's part that ``name`` takes (the file's stem) as paper_id, bounds as dates. A
    bound that isn't a date is an error."""
    docs = spark.read.text(path, wholetext=True).select("value", F.regexp_extract("_metadata.file_path", name, 1).alias("paper_id"))
    p = F.from_json("value", POLICY, {"mode": "FAILFAST"})["time_policy"]
    rows = docs.select("paper_id", p.alias("p"))
    bound = lambda c: F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("null")).cast("date")
    return rows.select(
        "paper_id", F.when(F.col("p").isNull(), F.raise_error(F.concat(F.lit("no time_policy in "), "paper_id"))).otherwise(F.coalesce("p.enabled", F.lit(False))).cast("boolean").alias("enabled"),
        F.coalesce("p.date_field", F.lit("published")).alias("date_field"), bound(F.col("p.start_date")).alias("start"), F.coalesce("p.start_inclusive", F.lit(True)).alias("start_inclusive"),
        bound(F.col("p.end_date")).alias("end"), F.coalesce("p.end_inclusive", F.lit(False)).alias("end_inclusive"), F.coalesce("p.timezone", F.lit("UTC")).alias("timezone"))


def feed_entries(xml: Column) -> Column:
    """array<struct> of an Atom feed's entries; namespaces are dropped first, so plain paths find them."""
    plain = F.regexp_replace(F.regexp_replace(xml, r'\sxmlns(:\w+)?="[^"]*"', ""), r"(</?)\w+:", "$1")
    entries = F.regexp_extract_all(plain, F.lit(r"(?s)(<entry>.*?</entry>)"), 1)
    one = lambda e, path: F.nullif(F.trim(F.regexp_replace(F.xpath_string(e, F.lit(f"entry/{path}")), r"\s+", " ")), F.lit(""))
    return F.transform(entries, lambda e: F.struct(*(one(e, p).alias(p) for p in ("id", "title", "summary", "published", "updated", "doi", "journal_ref", "comment")), F.xpath(e, F.lit("entry/author/name/text()")).alias("authors")))
