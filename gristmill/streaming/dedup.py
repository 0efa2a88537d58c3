"""Record generation as a stream: keyed deduplication against what was written before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from gristmill.sources import records
from gristmill.streaming import log


def gold_keys(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """Keys of the gold rows written so far, with repeats; None before the first batch."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.parquet(path).select(key)


def whole_number(rows: DataFrame, key: str) -> bool:
    return isinstance(rows.select(key).schema[0].dataType, IntegralType)


def unseen(rows: DataFrame, seen: DataFrame, key: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Rows whose key isn't among those seen.  Where ``low`` and ``high`` are the smallest
    and the largest key of ``rows``, whole numbers, only keys between them are read.

    Both sides are dealt by key.  Left to the planner, all keys ever written would go
    through the driver with each batch until their compressed files pass its limit."""
    if low is not None and whole_number(seen, key):
        seen = seen.filter(F.col(key).between(low, high))
    return rows.join(seen.distinct().hint("merge"), key, "left_anti")


def manifest_report(spark: SparkSession, dataset: str, split: str, command: dict, paths: dict[str, str], root: str) -> Callable[[dict, Exception | None], None]:
    """A report for :func:`run` that writes the manifest, whether the stream failed or not."""

    def report(stats: dict[str, int], _: Exception | None) -> None:
        records.write_manifest(spark, paths["manifest"], records.manifest(dataset, split, command, stats, paths, root))

    return report


def run(
    source: DataFrame,
    *,
    gold: str,
    checkpoint: str,
    key: str,
    written: Column,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    error: Column | None = None,
    skipped: str | None = None,
    report: Callable[[dict[str, int], Exception | None], None] | None = None,
) -> dict[str, int]:
    """Runs a stream to its end and returns counters.

    Each micro-batch leaves out rows whose key is among the gold rows and appends
    those for which ``written`` holds.  A key counts as seen once its row is
    written: repeats within a batch are both processed, and rows that were skipped
    come again on a later run.  A batch's rows go to a folder of its own, so a batch
    that runs again after a failure replaces what it left; an error ends the stream
    with the earlier batches in place.

    One bad row doesn't end the stream: where ``error`` (a string; null: none) tells
    what is wrong with a row, that row is skipped whatever ``written`` says and the
    rest of its batch goes on.  With ``skipped``, a folder, the rows that weren't
    written go there with their ``skip_error``, by batch as the others.  ``report``
    gets the counters and the error that ended the stream (None: none) before that
    error is raised again."""
    stats = {"total": 0, "written": 0, "skipped": 0, "deduped": 0}
    batches = 0

    def batch(rows: DataFrame, number: int) -> None:
        nonlocal batches
        spark = rows.sparkSession  # the stream's own
        spark.conf.set("spark.sql.optimizer.canChangeCachedPlanOutputPartitioning", "true")  # else a file for each shuffle partition
        rows = prepare(rows) if prepare else rows
        seen = gold_keys(spark, gold, key)
        wrong = F.lit(None).cast("string") if error is None else error
        flag = F.coalesce(written, F.lit(False)) & wrong.isNull()
        ends = [F.min(key), F.max(key)] if whole_number(rows, key) else []
        total, *ends = rows.agg(F.count("*"), *ends).first()
        fresh = rows if seen is None else unseen(rows, seen, key, *ends)
        fresh = fresh.select("*", flag.alias("__written"), wrong.alias("__error")).persist()
        try:
            counts = fresh.agg(F.count("*").alias("n"), F.count_if("__written").alias("w")).first()
            if skipped is not None:
                left = fresh.filter("NOT __written").drop("__written").withColumnRenamed("__error", "skip_error")
                left.write.mode("overwrite").parquet(f"{skipped}/batch={number}")
            fresh.filter("__written").drop("__written", "__error").write.mode("overwrite").parquet(f"{gold}/batch={number}")
        finally:
            fresh.unpersist()
        for k, n in (("total", total), ("written", counts.w), ("skipped", counts.n - counts.w), ("deduped", total - counts.n)):
            stats[k] += n
        batches += 1
        log.progress(batches, stats["total"])

    failure = None
    try:
        query = source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    except Exception as e:
        failure = e
        log.event("stream_failed", error=f"{type(e).__name__}: {e}", **stats)
        raise
    finally:
        if report is not None:
            report(stats, failure)
        log.event("stream_complete", failed=failure is not None, **stats)
    return stats
