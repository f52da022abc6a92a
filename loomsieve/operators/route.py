"""Routing of records through stages: ordered states, results of batches, constraint checks, snapshot differences."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_state(df: DataFrame, steps: list[tuple[str, Column]], otherwise: str, out: str = "state") -> DataFrame:
    """The first step whose test holds (a null test doesn't)."""
    state = None
    for name, test in steps:
        state = F.when(test, name) if state is None else state.when(test, name)
    return df.withColumn(out, state.otherwise(otherwise) if state is not None else F.lit(otherwise))


def batch_results(requests: DataFrame, outputs: DataFrame, errors: DataFrame, key: str, schema: str, valid: str) -> DataFrame:
    """Every request with ``status`` and parsed ``result``: an error beats an output; an output that doesn't parse or
    breaks the rule ``valid`` has failed. ``outputs`` has ``content`` (JSON text), ``errors`` has ``error``."""
    out = requests.join(outputs.select(key, "content"), key, "left").join(errors.select(key, "error"), key, "left")
    parsed = F.from_json("content", schema)
    fields = [f.split()[0] for f in schema.split(",")]
    out = out.withColumn("result", parsed).withColumns({f"__{f}": F.col(f"result.{f}") for f in fields})
    rule = valid
    for f in fields:
        rule = rule.replace(f, f"__{f}")
    ok = F.coalesce(F.expr(rule), F.lit(False))
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("content").isNull(), "missing").when(ok, "ok").otherwise("parse_or_validation_failed")
    return out.withColumn("status", status).withColumn("result", F.when(status == "ok", F.col("result"))).drop(*(f"__{f}" for f in fields))


def check(df: DataFrame, rules: dict[str, Column], out: str = "violations") -> DataFrame:
    """The names of all broken rules of each row; a rule that can't be decided counts as broken."""
    return df.withColumn(out, F.array_compact(F.array(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()))))


def hooked(df: DataFrame, column: str, hook: Callable[[dict], None], out: str = "error") -> DataFrame:
    """What a user's check says of a nested column: the message of the ValueError it raises for a record, null where it
    raises none. The check sees one record at a time, in Arrow batches; a null record isn't checked."""

    def run(values: pa.Array) -> pa.Array:
        found = []
        for record in values.to_pylist():
            try:
                found.append(None if record is None else hook(record))
            except ValueError as error:
                found.append(str(error))
        return pa.array(found, pa.string())

    return df.withColumn(out, F.arrow_udf(run, "string")(column))


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and the others with what they break."""
    checked = check(df, rules)
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Null-safe comparison by key: added, removed, changed (with the columns) or no_material_change."""
    a = old.select(key, F.lit(True).alias("__old"), *(F.col(c).alias(f"__a_{c}") for c in columns))
    b = new.select(key, F.lit(True).alias("__new"), *(F.col(c).alias(f"__b_{c}") for c in columns))
    out = a.join(b, key, "full_outer")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}")), F.lit(c)) for c in columns)))
    status = F.when(F.col("__new").isNull(), "removed").when(F.col("__old").isNull(), "added").when(F.size(differ) > 0, "changed").otherwise("no_material_change")
    return out.select(key, status.alias("status"), F.when(status == "changed", differ).otherwise(F.array().cast("array<string>")).alias("changed"))
