"""Votes of several annotators, agreement and what follows from it.

Responses come as a long table: ``sample_id``, ``provider``, ``ord`` (place of the
provider), ``text`` and ``error``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import validation as V
from gristmill.functions.text import accuracy

MISSING = "missing provider batch result"


def fill_missing(items: DataFrame, responses: DataFrame, key: str = "custom_id") -> DataFrame:
    """Every item with its response; an error text stands in for one that is missing."""
    found = items.join(responses.withColumn("__found", F.lit(True)), key, "left")
    return found.withColumn("error", F.when(F.col("__found").isNull(), F.lit(MISSING)).otherwise(F.col("error"))).drop("__found")


def votes(responses: DataFrame, stage: int = 1, requires_compute: Column | None = None) -> DataFrame:
    """Adds ``valid``, ``vote`` (null unless valid) and ``norm`` (the vote normalised)."""
    out = responses.withColumn("valid", V.is_valid("text", stage, requires_compute))
    out = out.withColumn("vote", F.when(F.col("valid"), V.vote("text", stage)))
    return out.withColumn("norm", V.normalize_vote("vote"))


def agreed(voted: DataFrame, key: str = "sample_id") -> DataFrame:
    """The agreed vote of every sample that has one: the most frequent normalised vote,
    given twice at least, ties to the one that came first; as it was first given."""
    tally = voted.filter(F.col("norm").isNotNull()).groupBy(key, "norm").agg(F.count("*").alias("n"), F.min("ord").alias("first"), F.min_by("vote", "ord").alias("vote"))
    best = tally.groupBy(key).agg(F.min_by(F.struct("norm", "vote", "n"), F.struct(-F.col("n"), "first")).alias("b"))
    return best.filter("b.n >= 2").select(key, F.col("b.vote").alias("agreed_output"), F.col("b.norm").alias("agreed_norm"))


def dissenters(voted: DataFrame, agreed_: DataFrame, key: str = "sample_id") -> DataFrame:
    """For each sample with an agreed vote, the providers that didn't give it, in order."""
    wrong = F.col("norm").isNull() | (F.col("norm") != F.col("agreed_norm"))
    listed = F.sort_array(F.collect_list(F.when(wrong, F.struct("ord", "provider"))))
    return voted.join(agreed_, key).groupBy(key).agg(F.transform(listed, lambda x: x["provider"]).alias("dissenters"))


def pivot_texts(responses: DataFrame, key: str = "sample_id") -> DataFrame:
    """Maps of provider to text and of provider to error (only where there is one)."""
    pair = lambda c: F.collect_list(F.when(F.col(c).isNotNull(), F.struct("provider", c)))
    return responses.groupBy(key).agg(F.map_from_entries(pair("text")).alias("texts"), F.map_from_entries(pair("error")).alias("errors"))


def outcomes(samples: DataFrame, agreed_: DataFrame, *, valid_all: str, adjudicated: str, synthesised: str, key: str = "sample_id") -> DataFrame:
    """Adds ``agreed_output`` and ``skip_reason`` (null for samples that are written).

    ``samples`` has ``dataset`` and ``answer_type`` and boolean columns that say
    whether all traces are valid, adjudication went well and synthesis went well."""
    out = samples.join(agreed_.select(key, "agreed_output"), key, "left")
    open_ = V.numeric_adjudication("dataset", "answer_type") & F.col(valid_all)
    return out.withColumn(
        "skip_reason",
        F.when(F.col("agreed_output").isNull() & ~open_, "no_teacher_majority")
        .when(F.col("agreed_output").isNull() & ~F.col(adjudicated), "plotqa_numeric_adjudication_failed")
        .when(~F.col(synthesised), "synthesis_failed"),
    )


def generation_stats(results: DataFrame) -> DataFrame:
    """One row of counters and rates over all samples.

    From boolean columns ``written``, ``agreement``, ``contrastive`` and ``deduped``."""
    n = lambda c: F.count_if(c)
    counts = results.agg(
        F.count("*").alias("total"),
        n(F.col("written")).alias("written"),
        n(~F.col("written") & ~F.col("deduped")).alias("skipped"),
        n(F.col("agreement")).alias("agreement"),
        n(F.col("contrastive")).alias("contrastive"),
        n(F.col("deduped")).alias("deduped"),
    )
    rate = lambda c: accuracy(F.col(c), F.col("total"))
    return counts.withColumns({"agreement_rate": rate("agreement"), "write_rate": rate("written"), "skip_rate": rate("skipped")})


def top_votes(voted: DataFrame, key: str = "sample_id") -> DataFrame:
    """The leading normalised vote of every sample with its count, whether agreed or not."""
    tally = voted.filter(F.col("norm").isNotNull()).groupBy(key, "norm").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    return tally.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "first")
