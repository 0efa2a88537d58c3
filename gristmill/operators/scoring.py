"""Scoring of predictions and summaries of the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import structure as S
from gristmill.functions import text as X
from gristmill.sources import scratch


def score_typed(df: DataFrame) -> DataFrame:
    """Adds ``expected``, ``actual``, ``correct`` and ``score``: equality after
    normalising by ``answer_type``.  From ``gold`` and ``prediction``."""
    out = df.withColumns({"expected": X.normalize_by_type("answer_type", "gold"), "actual": X.normalize_by_type("answer_type", "prediction")})
    return out.withColumn("correct", F.col("expected") == F.col("actual")).withColumn("score", F.col("correct").cast("double"))


def score_decimal(df: DataFrame, task_type: Column | None = None) -> DataFrame:
    """Adds what :func:`score_typed` does, over exact decimals, and ``answer_mode``,
    ``gold_parse_ok``, ``prediction_parse_ok`` (null for types that aren't numeric),
    ``absolute_error`` and ``relative_error`` (0 if equal, null if gold is 0)."""
    numeric = F.col("answer_type") == "numeric"
    sides = (("gold", "g", "expected"), ("prediction", "p", "actual"))
    # Each text is stripped and parsed once; what follows names the columns.
    out = df.withColumns({f"__{c}": F.when(numeric, X.decimal_bare(side)) for side, c, _ in sides})
    out = out.withColumns({f"__{c}_value": X.bare_decimal(F.col(f"__{c}")) for _, c, _ in sides})
    number = lambda c: F.when(F.col(f"__{c}_value").isNotNull(), X.plain_decimal(F.col(f"__{c}"), F.col(f"__{c}_value")))
    other = lambda side: F.when(F.col("answer_type") == "yes_no", X.normalize_yes_no(side)).otherwise(X.normalize_text(side))
    out = out.withColumns({name: F.coalesce(number(c), other(side)) for side, c, name in sides})
    g, p = F.col("__g_value"), F.col("__p_value")
    error = F.abs(p.cast("decimal(37,12)") - g.cast("decimal(37,12)"))
    out = out.withColumn("__error", error)
    relative = F.when(F.col("__error") == 0, F.lit(0.0)).when(g != 0, F.col("__error").cast("double") / F.abs(g).cast("double"))
    out = out.withColumns(
        {
            "correct": F.col("expected") == F.col("actual"),
            "answer_mode": X.scorer_mode("answer_type", F.lit(None).cast("string") if task_type is None else task_type),
            "gold_parse_ok": F.when(numeric, g.isNotNull()),
            "prediction_parse_ok": F.when(numeric, p.isNotNull()),
            "absolute_error": F.col("__error").cast("double"),
            "relative_error": F.when(F.col("__error").isNotNull(), relative),
        }
    )
    return out.withColumn("score", F.col("correct").cast("double")).drop("__g", "__p", "__g_value", "__p_value", "__error")


def parse_structures(df: DataFrame) -> DataFrame:
    """Adds ``gold_series``, ``predicted_series``, ``gold_points`` and ``predicted_points``."""
    out = df.withColumns({"gold_series": S.parse("gold"), "predicted_series": S.parse("prediction")})
    return out.withColumns({"gold_points": S.facts(F.col("gold_series")), "predicted_points": S.facts(F.col("predicted_series"))})


def score_structures(df: DataFrame) -> DataFrame:
    """Adds ``score``, ``correct`` and all structure figures as ``plotqa_*`` columns."""
    parsed = parse_structures(df).withColumn("__exact", X.normalize_text("gold") == X.normalize_text("prediction"))
    sides = [F.col(c) for c in ("gold_series", "predicted_series", "gold_points", "predicted_points")]
    measured = S.metric_columns(*sides)
    parsed = parsed.withColumns({f"__{k}": v for k, v in measured.items()})
    figures = S.score_columns({k: F.col(f"__{k}") for k in measured}, *sides, F.col("__exact"))
    out = parsed.withColumns({f"plotqa_{k}": v for k, v in figures.items()})
    out = out.drop("gold_series", "predicted_series", "gold_points", "predicted_points", "__exact", *(f"__{k}" for k in measured))
    return out.withColumn("score", F.col("plotqa_model_quality_score")).withColumn("correct", F.col("score") == 1.0)


def bucketed(scored: DataFrame) -> DataFrame:
    """Adds ``bucket`` to scored structures."""
    flags = [F.col(f"plotqa_{k}") for k in ("gold_parse_ok", "prediction_parse_ok", "exact_match")]
    return scored.withColumn("bucket", S.bucket(F.col("score"), *flags, F.col("prediction")))


def score_predictions(df: DataFrame) -> DataFrame:
    """``correct`` and ``score`` for rows of any dataset, each by its own scorer."""
    kept = df.columns
    is_structure, is_decimal = F.col("dataset") == "plotqa_structure", F.col("dataset") == "plotqa_qa"
    known = F.coalesce(is_structure | is_decimal, F.lit(False))
    parts = [score_structures(df.filter(is_structure)), score_decimal(df.filter(is_decimal)), score_typed(df.filter(~known))]
    out = parts[0].select(*kept, "correct", "score")
    for p in parts[1:]:
        out = out.unionByName(p.select(*kept, "correct", "score"))
    return out


def summarize(scored: DataFrame, *by: str) -> DataFrame:
    """``total``, ``correct``, ``accuracy``, ``average_score`` and ``average_latency_ms``
    (over rows that have one) in all or by group; zeros for no rows."""
    return (
        scored.groupBy(*by)
        .agg(
            F.count("*").alias("total"),
            F.coalesce(F.sum(F.col("correct").cast("long")), F.lit(0)).alias("correct"),
            F.coalesce(F.avg("score"), F.lit(0.0)).alias("average_score"),
            F.avg("latency_ms").alias("average_latency_ms"),
        )
        .withColumn("accuracy", X.accuracy(F.col("correct"), F.col("total")))
    )


def running_accuracy(scored: DataFrame, order: str, by: str) -> DataFrame:
    """Adds ``running_correct``, ``running_total`` and ``running_accuracy`` in the order
    of a column within each group; null groups and nulls first in the order.

    Sums come in two steps, so a group with most of the rows isn't sorted in one task:
    rows are written by ranges of group and order, summed by range, and what the ranges
    before hold of a group is added to the sums within one.  Rows that are alike in both
    columns fall into one range and come in any order."""
    spark = scored.sparkSession
    path = scratch.folder(spark, "running")
    scored.repartitionByRange(by, order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    ranged = spark.read.parquet(path)
    sums = ranged.groupBy(F.col("__range").alias("__r"), F.col(by).alias("__by")).agg(F.sum(F.col("correct").cast("long")).alias("__c"), F.count("*").alias("__n"))
    w = Window.partitionBy("__by").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("__r", "__by", *(F.sum(c).over(w).alias(f"{c}_before") for c in ("__c", "__n")))
    w = Window.partitionBy("__range", by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.withColumns({"__c": F.sum(F.col("correct").cast("long")).over(w), "__n": F.count("*").over(w)})
    out = out.join(before, (out["__range"] == before["__r"]) & out[by].eqNullSafe(before["__by"]))
    # A sum is null as long as no row of the group has been judged.
    correct = F.when(F.col("__c").isNotNull() | F.col("__c_before").isNotNull(), F.coalesce("__c", F.lit(0)) + F.coalesce("__c_before", F.lit(0)))
    out = out.withColumns({"running_correct": correct, "running_total": F.col("__n") + F.coalesce("__n_before", F.lit(0))})
    out = out.withColumn("running_accuracy", X.accuracy(F.col("running_correct"), F.col("running_total")))
    return out.select(*scored.columns, "running_correct", "running_total", "running_accuracy")
