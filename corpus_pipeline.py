"""Cleaning and packing of ``documents``: five stages, each on all that the one before has kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each stage's result
as Parquet in the shared folder and reads it back as the next one's ``docs``, and removes what the stage
itself had written there. All but the last stage return the columns of ``documents``.

Defined results: a null text counts as the empty one, which the quality rules reject. Rows without
``doc_id`` take part like others; of near-duplicates the row of the least ``doc_id`` stays, one without
id only where none has any. Of rows alike in id and text one stays. Columns of any names are carried
through unchanged, but for ``text`` and, where a stage cuts texts, ``n_chars``. An empty table gives no
pieces. Texts may be of any length; ties in what a stage decides by have no bearing on its result, but
for the layout of pieces in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import packing, repetition, secrets, simhash, suffixes
from sparkloom.llm.common import documents, scratch, stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return repetition.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the least id."""
    return simhash.keep_one_of_near(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes or more that also occur elsewhere are cut out of the texts."""
    return _measured(suffixes.without_repeats(docs), docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return _measured(secrets.redact(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts, tokenised and packed into sequences: one row a piece."""
    return packing.pack_documents(docs)


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` follows the text where the table has that column."""
    out = docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in columns else docs
    return out.select(*columns)


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("repeated strings", repeated_strings), ("secret scan", secret_scan), ("packing", pack)]

#: Tokenising and similarity groups have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        kept = []
        with scratch(spark, kept):
            docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
            kept.append(docs)
    return docs
