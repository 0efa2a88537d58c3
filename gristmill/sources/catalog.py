"""Where the sources are and how they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.operators.adapters import adapt
from gristmill.operators.rows import resolve_split, source_slice

# The hub path, configuration and kind of supervision of each source.
CARDS = {
    "chartqa": ("HuggingFaceM4/ChartQA", None, "benchmark"),
    "plotqa_structure": ("achang/plot_qa", None, "structure"),
    "plotqa_qa": ("AsphyXIA/plotqa", None, "benchmark"),
    "figureqa": ("vikhyatk/figureqa", None, "qa"),
    "chartbench": ("SincereX/ChartBench", "chart_bench", "benchmark"),
    "mmc_benchmark": ("xywang1/MMC", "MMC-Benchmark", "benchmark"),
}


def card_table(spark: SparkSession) -> DataFrame:
    """The catalog as rows: ``dataset``, ``path``, ``config``, ``supervision``."""
    return spark.createDataFrame([(k, *v) for k, v in CARDS.items()], "dataset string, path string, config string, supervision string")


def numbered(rows: DataFrame, name: str = "source_index", small: int = 100_000) -> DataFrame:
    """Adds the number of each row of a scan, from 0, by file and place in the file.

    Parquet tells a row's place; of other formats the rows of a block of a file are
    counted in the order in which its task reads them.  Rows are counted by block
    first and these counts added up, so no task sees all rows; the counts are
    broadcast if there are at most ``small`` of them."""
    where = rows.metadataColumn("_metadata")
    fields = rows.select(where.alias("m")).schema["m"].dataType.names
    block = F.struct(where["file_path"].alias("file"), *([] if "row_index" in fields else [where["file_block_start"].alias("start")]))
    at = where["row_index"] if "row_index" in fields else F.monotonically_increasing_id()
    marked = rows.select(F.struct(*(rows[f"`{c}`"] for c in rows.columns)).alias("row"), block.alias("block"), at.alias("at"))
    blocks = marked.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = blocks.select("block", "first", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("before"))
    before = F.broadcast(before) if blocks.count() <= small else before
    return marked.join(before, "block").select("row.*", (F.col("before") + F.col("at") - F.col("first")).alias(name))


def raw(spark: SparkSession, root: str, dataset: str, split: str = "train", fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Source rows of a dataset that was copied below ``root``, with ``source_index``.

    The layout is ``root/dataset/split``.  The index numbers rows from 0 by file and
    place, so it is the same on every read of the same files."""
    if dataset not in CARDS:
        raise KeyError(f"Unknown dataset: {dataset}")
    reader = spark.read.format(fmt)
    rows = (reader.schema(schema) if schema else reader).load(f"{root}/{dataset}/{resolve_split(dataset, split)}")
    return rows if "source_index" in rows.columns else numbered(rows)


def samples(spark: SparkSession, root: str, dataset: str, split: str = "train", offset: int = 0, limit: int | None = None, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Core rows; ``offset`` and ``limit`` count source rows, before they are flattened."""
    return adapt(dataset, source_slice(raw(spark, root, dataset, split, fmt, schema), "source_index", offset, limit))
