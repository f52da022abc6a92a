"""Nested records without a declared schema, as VARIANT columns: fields in order, leaves at any depth, pruning, changed fields."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a source says its year, in the order in which that counts (fixed names).
YEAR_FIELDS = ("year", "publicationYear", "published", "publicationDate", "date", "updated")


def field(record: Column, path: str, kind: str = "string") -> Column:
    """What stands at a path (as ``$.a[0].b``); null where there is nothing, or nothing of that kind."""
    return F.try_variant_get(record, path, kind)


def kind_of(record: Column) -> Column:
    """OBJECT, ARRAY, STRING and so on; VOID for a JSON null."""
    return F.regexp_extract(F.schema_of_variant(record), "^[A-Z]+", 0)


def first_year(record: Column, fields: tuple[str, ...] = YEAR_FIELDS) -> Column:
    """The year of the first field that has one: the first of an object's ``date-parts`` if that is a year, or the first 19xx
    or 20xx in any other value. An object without such parts is passed over."""
    found = []
    for name in fields:
        parts = F.regexp_extract(F.coalesce(field(record, f"$['{name}']['date-parts'][0][0]"), F.lit("")), r"^((?:19|20)\d{2})$", 1)
        plain = F.regexp_extract(F.coalesce(field(record, f"$['{name}']"), F.lit("")), r"((?:19|20)\d{2})", 1)
        value = field(record, f"$['{name}']", "variant")
        found.append(F.nullif(F.when(F.coalesce(kind_of(value), F.lit("")) == "OBJECT", parts).otherwise(plain), F.lit("")))
    return F.coalesce(*found)


def first_field(record: Column, paths: list[str]) -> Column:
    """The first of several paths whose text isn't blank, squeezed."""
    clean = lambda p: F.nullif(F.trim(F.regexp_replace(field(record, p), r"(?U)\s+", " ")), F.lit(""))
    return F.coalesce(*map(clean, paths))


def _explode(df: DataFrame, variant: str) -> DataFrame:
    """A row for each element or field of an object or array: pos, key (null in arrays), value; one of nulls where there is none."""
    return df.lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col(variant).outer()))


def leaves(df: DataFrame, ids: list[str], column: str, depth: int = 8) -> DataFrame:
    """Every scalar at any depth: the ids, path (as ``$.a[0].b``), kind and value (text; null for a JSON null).

    Records are walked level by level in one pass, whatever their fields are called. What lies deeper than ``depth`` comes as
    one row with its JSON; empty objects and arrays have no leaves.
    """
    rows = df.select(*ids, F.lit("$").alias("path"), F.col(column).alias("__v")).filter("__v is not null").withColumn("kind", kind_of(F.col("__v")))
    nested = F.col("kind").isin("OBJECT", "ARRAY")
    for _ in range(depth):
        inner = _explode(rows.withColumn("__n", F.when(nested, F.col("__v"))).withColumnsRenamed({"path": "__path"}), "__n").filter(~nested | F.col("value").isNotNull())
        step = F.when(~nested, "").when(F.col("kind") == "OBJECT", F.concat(F.lit("."), "key")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        rows = inner.select(*ids, F.concat("__path", step).alias("path"), F.when(nested, F.col("value")).otherwise(F.col("__v")).alias("__v")).withColumn("kind", kind_of(F.col("__v")))
    text = F.when(F.col("kind") != "VOID", F.coalesce(field(F.col("__v"), "$"), F.to_json("__v")))
    return rows.select(*ids, "path", "kind", text.alias("value"))


def _without(value, name: str):
    if isinstance(value, dict):
        return {k: _without(v, name) for k, v in value.items() if not (k == name and isinstance(v, list))}
    return [_without(v, name) for v in value] if isinstance(value, list) else value


def pruned(record: Column, drop: str = "reference") -> Column:
    """A record without the list-valued fields of that name, at any depth, whatever its schema. There is no built-in
    expression that walks a value of unknown depth, so records go through JSON in Arrow batches."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else json.dumps(_without(json.loads(t), drop), ensure_ascii=False) if f'"{drop}"' in t else t for t in texts.to_pylist()], pa.string())

    return F.parse_json(F.arrow_udf(run, "string")(F.to_json(record)))


def with_fields(record: Column, values: dict[str, Column]) -> Column:
    """A record with some top-level fields set to texts (null: a JSON null). What isn't an object becomes one."""
    none = F.from_json(F.lit("{}"), "map<string,variant>")
    known = F.coalesce(F.from_json(F.when(kind_of(record) == "OBJECT", F.to_json(record)), "map<string,variant>"), none)
    kept = F.map_filter(known, lambda k, _: ~k.isin(*values))
    new = F.map_from_entries(F.array(*(F.struct(F.lit(n).alias("k"), F.parse_json(F.coalesce(F.to_json(F.to_variant_object(F.array(v))), F.lit("[null]"))).alias("v")) for n, v in values.items())))
    new = F.transform_values(new, lambda _, v: F.coalesce(F.variant_get(v, "$[0]", "variant"), F.parse_json(F.lit("null"))))
    return F.parse_json(F.to_json(F.map_concat(kept, new)))
