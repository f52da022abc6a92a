"""Merging of nested answers into one record per field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsieve.functions.verdicts import evidence_state


def by_field(answers: DataFrame, keys: list[str]) -> DataFrame:
    """Answers (pos, qid, fields, state, quotes) merged per key and field; an answer without fields belongs to its qid.

    ``state`` folds present and absent to mixed; quotes and qids are distinct, in order of first appearance. Quotes and
    qids are reduced to first positions by their own aggregates, so nothing but distinct values is collected.
    """
    field = F.explode(F.when(F.size("fields") > 0, F.col("fields")).otherwise(F.array("qid"))).alias("field")
    rows = answers.select(*keys, "pos", "qid", "state", "quotes", field)
    by = [*keys, "field"]

    def ordered(df: DataFrame, value: str, out: str) -> DataFrame:
        first = df.groupBy(*by, value).agg(F.min("pos").alias("p"))
        lists = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("p", value))).alias("x"))
        return lists.select(*by, F.transform("x", lambda s: s[value]).alias(out))

    state = rows.groupBy(*by).agg(evidence_state(F.bool_or(F.col("state") == "present"), F.bool_or(F.col("state") == "absent")).alias("state"), F.count("*").alias("n_answers"))
    quotes = ordered(rows.select(*by, "pos", F.explode("quotes").alias("quote")), "quote", "quotes")
    return state.join(quotes, by, "left").join(ordered(rows, "qid", "qids"), by, "left")
