"""Lines of texts with their context, weighted cues, and a diversified choice among them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no from 1, line)."""
    return df.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def with_context(df: DataFrame, id_col: str, text_col: str, around: int) -> DataFrame:
    """Every line with the non-blank lines around it, joined. Taken from the text's own array, without a shuffle."""
    split = df.select(id_col, F.split(text_col, "\n").alias("all"))
    out = split.select(id_col, "all", F.posexplode("all").alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)
    first = F.greatest(F.col("line_no") - around, F.lit(1))
    near = F.slice("all", first, F.col("line_no") + around - first + 1)
    return out.select(id_col, "line_no", "line", F.array_join(F.filter(near, lambda x: F.trim(x) != ""), "\n").alias("context"))


def score(line: Column, cues: dict[str, int]) -> Column:
    """Sum of the weights of all cues (patterns, any case) that a line shows."""
    return sum((F.when(line.rlike("(?i)" + p), w).otherwise(0) for p, w in cues.items()), F.lit(0))


def scored_lines(df: DataFrame, id_col: str, text_col: str, cues: dict[str, int]) -> DataFrame:
    return lines(df, id_col, text_col).withColumn("score", score(F.col("line"), cues))


def diversified(df: DataFrame, id_col: str, text_col: str, cues: dict[str, int], most: int) -> DataFrame:
    """At most so many lines of each text: first the best line of each cue, then the best others; lines that repeat a
    chosen one or stand within three lines of one are passed over. (id, line_no, score, rank).

    Lines without a cue never count, so a text sends only scored lines to its group.
    """
    names = list(cues)
    hits = F.array_compact(F.array(*(F.when(F.col("line").rlike("(?i)" + p), F.lit(i)) for i, p in enumerate(names))))
    scored = scored_lines(df, id_col, text_col, cues).withColumn("cues", hits).filter((F.size("cues") > 0) & (F.col("score") > 0))
    scored = scored.select(F.col(id_col).alias("id"), "line_no", F.md5(F.trim("line")).alias("quote"), "score", "cues")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(group.itertuples(index=False), key=lambda r: (-r.score, r.line_no))
        chosen: list = []

        def take(r) -> bool:
            if len(chosen) < most and all(r.quote != c.quote and abs(r.line_no - c.line_no) >= 3 for c in chosen):
                chosen.append(r)
                return True
            return False

        for cue in range(len(names)):
            any(take(r) for r in rows if cue in list(r.cues))
        for r in rows:
            take(r)
        return pd.DataFrame({id_col: [r.id for r in chosen], "line_no": [r.line_no for r in chosen], "score": [r.score for r in chosen], "rank": range(1, len(chosen) + 1)})

    kind = df.schema[id_col].dataType.simpleString()
    return scored.groupBy("id").applyInPandas(pick, f"{id_col} {kind}, line_no int, score int, rank int")


def latex_items(df: DataFrame, id_col: str, text_col: str, section: str) -> DataFrame:
    """Items of the first enumeration after a section's heading: (id, item_no from 1, item). Texts without one give none."""
    import re as _re

    body = F.regexp_extract(text_col, r"(?s)\\section\{\s*" + _re.escape(section) + r"\s*\}.*?\\begin\{enumerate\}[^\n]*\n(.*?)\\end\{enumerate\}", 1)
    parts = F.slice(F.split(body, r"(?m)^\s*\\item"), 2, 1_000_000_000)
    return df.select(id_col, F.posexplode(parts).alias("item_no", "item")).select(id_col, (F.col("item_no") + 1).alias("item_no"), F.trim(F.regexp_replace("item", r"\s+", " ")).alias("item"))


def item_title(item: Column) -> Column:
    """struct(title, mode): what stands in quotes, else the second sentence."""
    quoted = F.regexp_extract(item, "[“\"]([^”\"]+)[”\"]", 1)
    second = F.trim(F.get(F.filter(F.split(item, r"\.\s+"), lambda p: F.trim(p) != ""), F.lit(1)))
    second = F.regexp_replace(second, r"[ .]+$", "")
    return F.when(quoted != "", F.struct(F.trim(quoted).alias("title"), F.lit("quoted").alias("mode"))).when(second.isNotNull(), F.struct(second.alias("title"), F.lit("unquoted").alias("mode"))).otherwise(F.struct(F.lit(None).cast("string").alias("title"), F.lit("none").alias("mode")))
