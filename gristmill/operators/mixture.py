"""Reproducible train and validation mixtures.

Shuffles are orders by a seeded SHA-256 of the record key: a permutation that is
the same each time, on any number of machines, and in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The order in which datasets are joined, and the seed's step for validation rows.
DATASETS = ("chartqa", "figureqa", "plotqa_qa", "chartbench", "mmc_benchmark")
VALIDATION_STEP = 10_000


def shuffle_key(key: Column | str, seed: Column | int) -> Column:
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.sha2(F.concat(seed.cast("string"), F.lit(":"), (F.col(key) if isinstance(key, str) else key).cast("string")), 256)


def dataset_index(dataset: str, datasets=DATASETS) -> Column:
    return F.array_position(F.array(*map(F.lit, datasets)), F.col(dataset)).cast("int") - 1


def split(rows: DataFrame, *, key: str, dataset: str, seed: int = 13, val_split: float = 0.05, cap: int | None = None, datasets=DATASETS) -> DataFrame:
    """Adds ``split``, ``train`` or ``val``: each dataset is shuffled by its own seed,
    capped, and cut at ``int(n * (1 - val_split))``.

    Ranks come in two steps, so a dataset with most of the rows isn't sorted in one
    task: rows are counted by slices of the shuffle key, and ranked within a slice."""
    ordered = rows.withColumn("__k", shuffle_key(key, F.lit(seed) + dataset_index(dataset, datasets)))
    ordered = ordered.withColumn("__slice", F.substring("__k", 1, 3))
    sizes = ordered.groupBy(dataset, "__slice").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(dataset)
    before = sizes.withColumn("__before", F.sum("__n").over(w.orderBy("__slice")) - F.col("__n")).withColumn("__all", F.sum("__n").over(w)).drop("__n")
    local = F.row_number().over(Window.partitionBy(dataset, "__slice").orderBy("__k", key))
    ranked = ordered.join(before, [dataset, "__slice"]).withColumn("__rank", F.col("__before") + local)
    kept = F.col("__all") if cap is None else F.least("__all", F.lit(cap))
    cutoff = F.floor(kept * (F.lit(1.0) - F.lit(float(val_split))))
    out = ranked.filter(F.col("__rank") <= kept).withColumn("split", F.when(F.col("__rank") <= cutoff, "train").otherwise("val"))
    return out.drop("__k", "__slice", "__before", "__all", "__rank")


def critique(rows: DataFrame) -> DataFrame:
    """Counterexamples as critiques: the input asks about the proposed answer, the
    output fails it and gives the right one.  From ``input``, ``output`` and the
    metadata columns ``perturbed_answer``, ``gold_answer``, ``answer``, ``gold_output``."""
    text = lambda *c: F.coalesce(*(F.col(x).cast("string") for x in c), F.lit(""))
    asked = F.concat(F.col("input"), F.lit("\nProposed answer: "), text("perturbed_answer"), F.lit("\nIs the proposed answer faithful to the chart?"))
    told = F.concat(
        F.lit("<verdict>FAIL</verdict>\n<correct_answer>"),
        text("gold_answer", "answer"),
        F.lit("</correct_answer>\n<correction>\n"),
        text("gold_output"),
        F.lit("\n</correction>"),
    )
    return rows.withColumns({"input": asked, "output": told})


def attach_contrastive(mixture: DataFrame, contrastive: DataFrame, *, key: str = "record_key", order: str | None = None) -> DataFrame:
    """Adds to each split the counterexample of each of its gold rows, if it has one;
    of several with one key the last by ``order``."""
    last = contrastive if order is None else contrastive.groupBy(key).agg(F.max_by(F.struct(*[c for c in contrastive.columns if c != key]), order).alias("r")).select(key, "r.*")
    return mixture.unionByName(last.join(mixture.select(key, "split"), key), allowMissingColumns=True)


def final_order(mixture: DataFrame, key: str, seed: int = 13) -> DataFrame:
    """Rows with ``position``-giving ``shuffle``: each split shuffled by its own seed."""
    step = F.when(F.col("split") == "val", F.lit(seed + VALIDATION_STEP)).otherwise(F.lit(seed))
    return mixture.withColumn("shuffle", shuffle_key(key, step)).orderBy("split", "shuffle")
