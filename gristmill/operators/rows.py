"""Row selection: source-row offsets, limits after flattening, batches, shuffles, anti-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Logical to physical splits of the sources; a name not listed passes through.
SPLITS = {
    "chartqa": {"train": "train", "validation": "val", "test": "test"},
    "plotqa_structure": {"train": "train", "validation": "validation", "test": "test"},
    "plotqa_qa": {"train": "train", "validation": "train", "test": "train"},
    "figureqa": {"train": "train", "test": "train"},
    "chartbench": {"train": "train_data", "test": "test_data"},
    "mmc_benchmark": {"train": "test", "test": "test"},
}


def resolve_split(dataset: str, split: str = "train") -> str:
    return SPLITS[dataset].get(split, split)


def split_column(dataset: str, split: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in SPLITS[dataset].items() for x in kv))
    return F.coalesce(F.element_at(table, split), split)


def source_slice(rows: DataFrame, index: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Source rows by their index, before anything is flattened; the index stays, so
    ids made from it don't depend on the slice."""
    out = rows.filter(F.col(index) >= offset)
    return out if limit is None else out.filter(F.col(index) < offset + limit)


def first_rows(flat: DataFrame, limit: int, *order: str) -> DataFrame:
    """The first rows after flattening."""
    return flat.orderBy(*order).limit(limit)


def with_rank(rows: DataFrame, order: str, name: str = "rank", size: int = 1 << 16) -> DataFrame:
    """Adds the place of each row in the order of a whole-number column, from 1.

    Rows are counted by ranges of values first, so no task sorts them all; a range is
    as wide as holds ``size`` rows on average, however far apart the values are."""
    seen = rows.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count("*").alias("n")).first()
    if not seen.n or seen.low is None:
        return rows.withColumn(name, F.row_number().over(Window.orderBy(order)).cast("long"))
    step = max(1, (seen.high - seen.low + 1) * size // seen.n)
    sliced = rows.withColumn("__slice", F.coalesce(F.floor((F.col(order) - F.lit(seen.low)) / step), F.lit(-1)))
    sizes = sliced.groupBy("__slice").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.orderBy("__slice")) - F.col("__n")).drop("__n")
    local = F.row_number().over(Window.partitionBy("__slice").orderBy(order))
    return sliced.join(before, "__slice").withColumn(name, F.col("__before") + local).drop("__slice", "__before")


def batch_ids(rows: DataFrame, order: str, size: int) -> DataFrame:
    """Adds ``batch_id``: runs of ``size`` rows in order, the last one short."""
    return with_rank(rows, order, "__rank").withColumn("batch_id", F.floor((F.col("__rank") - 1) / size)).drop("__rank")


def shuffled(rows: DataFrame, key: str, seed: int | None) -> DataFrame:
    """A permutation that is the same for the same seed; none for no seed."""
    return rows if seed is None else rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)


def sample_limit(samples: int | None = None, all_samples: bool = False) -> int | None:
    """The limit that exactly one of the two arguments gives."""
    if all_samples == (samples is not None):
        raise ValueError("choose either a number of samples or all of them")
    if samples is not None and samples <= 0:
        raise ValueError("the number of samples must be positive")
    return samples


def not_seen(rows: DataFrame, existing: DataFrame, key: str = "record_key") -> DataFrame:
    """Rows whose key isn't among the existing ones; repeats within ``rows`` stay."""
    return rows.join(existing.select(key), key, "left_anti")
