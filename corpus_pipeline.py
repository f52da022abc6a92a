"""The corpus pipeline: toxicity, near-duplicates, repeated strings, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. Every
stage handles null ids, texts and languages, empty texts, repeated rows, empty tables and further columns as its operator
states; texts keep null where nothing is taken from them, and n_chars follows the text where the text changes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomsieve.llm import neardup, packing, pii, suffixes, toxicity
from loomsieve.llm.common import documents, materialise


#: Repeated strings of so many bytes go: fifty words of prose are seldom shorter, in any of the four languages.
PASSAGE_BYTES = 200


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars made to agree with the text, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language; the classifier learns from the labelled rows of the table."""
    model = toxicity.train(docs, documents(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the least id."""
    return neardup.drop_near_duplicates(docs)


def suffixes_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of PASSAGE_BYTES bytes or more that occur again, as passages of over fifty words do; a character cut in two goes as a whole.

    A text that is repeated altogether becomes empty; its row stays.
    """
    out = suffixes.remove_repeats(docs, PASSAGE_BYTES, as_text=True)
    text = F.when(~F.col("missing"), F.col("kept"))
    fields = [F.col(f"row.`{c}`").alias(c) if c != "text" else text.alias(c) for c in docs.columns]
    return _counted(out.select(*fields))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, as in <email>."""
    return _counted(pii.redact(docs, pii.train(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of power-of-two lengths with their token ids (binary, little-endian uint32)."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_stage), ("neardup", neardup_stage), ("suffixes", suffixes_stage), ("pii", pii_stage), ("packing", packing_stage)]
#: Not given: no stage can be stated in SQL (trained models, approximate candidates); the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
