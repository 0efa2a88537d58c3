"""Grouped reports over scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import accuracy, metric_name

# Display names of datasets; others show as they are.
DISPLAY = {"chartqa": "ChartQA", "figureqa": "FigureQA", "plotqa_qa": "PlotQA QA", "plotqa_structure": "PlotQA Structure", "chartbench": "ChartBench", "mmc_benchmark": "MMC-Benchmark"}
#: Metrics of the structure report that are means over all rows, missing ones as 0.
MEANS = (
    "model_quality_score component_f1 value_f1 fact_coverage series_precision series_recall series_f1 "
    "x_label_precision x_label_recall x_label_f1 count_match gold_facts predicted_facts"
).split()


def display_name(dataset: Column | str) -> Column:
    name = F.col(dataset) if isinstance(dataset, str) else dataset
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in DISPLAY.items() for x in kv)), name), name)


def flag_rate(flag: str) -> Column:
    """Over all rows; a missing flag counts as false."""
    return F.avg(F.coalesce(F.col(flag), F.lit(False)).cast("double"))


def mean_or_zero(column: str) -> Column:
    """Over all rows; a missing value counts as 0."""
    return F.avg(F.coalesce(F.col(column).cast("double"), F.lit(0.0)))


def shares(df: DataFrame, column: str, default: str = "unknown") -> DataFrame:
    """``column``, ``n`` and ``share`` of all rows, by value."""
    counts = df.groupBy(F.coalesce(F.col(column), F.lit(default)).alias(column)).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(column, "n", accuracy(F.col("n"), F.col("total")).alias("share"))


def qa_report(scored: DataFrame) -> DataFrame:
    """One row: totals, exact-match rate, numeric rows, parse rate among these and the
    mean absolute error over the rows that have one (null if none has)."""
    numeric = F.col("prediction_parse_ok").isNotNull()
    return scored.agg(
        F.count("*").alias("total"),
        F.avg(F.col("correct").cast("double")).alias("exact_match"),
        F.count(F.when(numeric, 1)).alias("numeric_rows"),
        F.avg(F.when(numeric, F.col("prediction_parse_ok").cast("double"))).alias("numeric_parse"),
        F.avg("absolute_error").alias("mean_absolute_error"),
    )


def structure_report(bucketed: DataFrame) -> DataFrame:
    """One row with the figures of the four sections of the structure report."""
    g, p = F.coalesce("plotqa_gold_facts", F.lit(0)), F.coalesce("plotqa_predicted_facts", F.lit(0))
    rate = lambda c: F.avg(c.cast("double"))
    return bucketed.agg(
        F.count("*").alias("total"),
        flag_rate("plotqa_gold_parse_ok").alias("gold_parse"),
        flag_rate("plotqa_prediction_parse_ok").alias("prediction_parse"),
        flag_rate("plotqa_exact_match").alias("exact_match"),
        rate(F.col("score") == 1.0).alias("semantic_match"),
        F.avg("score").alias("semantic_mean"),
        *(mean_or_zero(f"plotqa_{m}").alias(m) for m in MEANS),
        rate(p > g).alias("over_extract"),
        rate(p < g).alias("under_extract"),
        *(rate(F.col("bucket") == b).alias(b) for b in ("empty_output", "placeholder_output", "unparsed_schema_variant")),
    )


def accuracy_by(scored: DataFrame, *by: str) -> DataFrame:
    out = scored.groupBy(*by).agg(F.count("*").alias("total"), F.sum(F.col("correct").cast("long")).alias("correct"))
    return out.withColumn("accuracy", accuracy(F.col("correct"), F.col("total")))


def accuracy_grid(scored: DataFrame, label: str, dataset: str) -> DataFrame:
    """Accuracy of every label on every dataset, 0 where there are no rows.

    The grid comes from two lists of distinct names, not from the rows."""
    found = accuracy_by(scored, label, dataset).select(label, dataset, "accuracy")
    names = found.agg(F.collect_set(label).alias("l"), F.collect_set(dataset).alias("d"))
    grid = names.select(F.explode("l").alias(label), "d").select(label, F.explode("d").alias(dataset))
    return grid.join(found, [label, dataset], "left").select(label, dataset, F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def row_metrics(rows: DataFrame, fields: tuple[str, ...], default: str = "unknown") -> DataFrame:
    """``field``, ``value``, ``count`` and ``ratio`` for each field on its own."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(F.col(f).cast("string"), F.lit(default)).alias("value")) for f in fields)))
    counts = rows.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("count"))
    total = counts.filter(F.col("field") == fields[0]).agg(F.sum("count").alias("total"))
    return counts.join(F.broadcast(total)).select("field", metric_name("value").alias("value"), "count", accuracy(F.col("count"), F.col("total")).alias("ratio"))


def row_mix(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def breakdown(scored: DataFrame, label: str) -> DataFrame:
    """For each run the share of parsed predictions and the means of six figures of scored structures."""
    means = ("model_quality_score", "component_f1", "fact_coverage", "value_f1", "series_f1", "x_label_f1")
    mean = lambda c: F.avg(F.coalesce(F.col(f"plotqa_{c}").cast("double"), F.lit(0.0)))
    return scored.groupBy(label).agg(F.count("*").alias("total"), mean("prediction_parse_ok").alias("prediction_parse"), *(mean(c).alias(c) for c in means))


def most_common(rows: DataFrame, value: str, first: str) -> DataFrame:
    """Values by falling count, ties by the first place (column ``first``) where they occur:
    ``value``, ``n`` and ``place`` from 1.  The values are few: they are a report's rows."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(first).alias("first"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first"))).drop("first")


def model_order(label: str, preferred: tuple[str, ...]) -> list[Column]:
    """Sort keys: preferred labels in their order, then the others by name."""
    at = F.array_position(F.array(*map(F.lit, preferred)), F.col(label))
    return [F.when(at > 0, at).otherwise(len(preferred) + 1), F.col(label)]


def metric_rows(log: DataFrame, step: str) -> DataFrame:
    """Numeric columns of a training log as ``step``, ``metric`` (a safe name) and ``value``;
    nulls give no row."""
    names = [c for c, kind in log.dtypes if c != step and kind in ("int", "bigint", "float", "double")]
    pairs = F.array(*(F.struct(metric_name(F.lit(c)).alias("metric"), F.col(c).cast("double").alias("value")) for c in names))
    return log.select(step, F.explode(pairs).alias("m")).select(step, "m.*").filter("value is not null")
