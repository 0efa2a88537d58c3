"""A corpus pipeline of five stages, each calling one of the training-data operators.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns the rows that the next stage gets, once they have been written and read.

Every stage stands nulls in any column, empty and very long texts, an empty table (which
stays empty to the end) and further columns of any name, which all but the last pass on.
Null and empty texts and those without letters go with the first stage.  Equal rows share
the fate of one another in the first two; of them and of near copies one row stays in the
third (smallest doc_id, then file order).  Equal draws in the mix are settled by size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import langid, mixing, packing, simhash, toxicity
from gristmill.llm.common import materialize, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those whose language isn't told by at least even odds."""
    return langid.keep_identified(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that score 0.3 or more; the model learns from the documents it gets."""
    return toxicity.drop_toxic(docs, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return simhash.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does: never, once or twice."""
    return mixing.take_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what the mix took into sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("packing", packed),
]

#: None of the models, fingerprints and plans can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
