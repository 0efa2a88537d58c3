"""Plumbing shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is chosen, which is only
    right for a local master; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of an application once, unless they
    find it by themselves in the working folder or on PYTHONPATH."""
    root, app = Path(__file__).resolve().parents[2], spark.sparkContext.applicationId
    known = {Path(p).resolve() for p in (os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)) if p}
    if app in _shipped or root in known:
        return
    folder = tempfile.mkdtemp(prefix="gristmill-code-")  # the driver serves the file from there
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/gristmill", "zip", root, Path(__file__).parents[1].name))
    _shipped.add(app)


_written: dict[str, list[str]] = {}


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, so a lost executor
    costs the tasks it ran and nothing that was already written.  Results are read
    from these tables, so they stay until :func:`remove_tables`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gristmill/{tag}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession) -> int:
    """Removes all tables that this application has materialized; results that read
    them must have been written before.  Returns their number."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def placed(df: DataFrame) -> DataFrame:
    """The rows of ``df`` as ``row`` (a struct) with the place each has in a file:
    ``file`` and ``place``, which tell even equal rows apart and are the same on every
    read.  What isn't a plain scan of files is materialized first."""
    scan = df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"
    rows = df if scan else materialize(df, "rows")
    where = rows.metadataColumn("_metadata")
    return rows.select(F.struct(*(rows[f"`{c}`"] for c in rows.columns)).alias("row"), where["file_path"].alias("file"), where["row_index"].alias("place"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def training_row(id_col: str, modulus: int) -> "F.Column":
    """True where ``crc32(id as text) mod modulus`` is not 2; a null id trains."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus != 2, F.lit(True))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of the splitmix64 generator, over unsigned 64-bit arrays."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Doubles in (0, 1) from unsigned 64-bit hashes."""
    return ((mix64(x) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def text_slices(batch, column: int, limit: int = 2 << 20):
    """Cuts an Arrow batch into runs of rows with about ``limit`` bytes of text;
    yields the run and its whole texts as bytes (None for null)."""
    texts = batch.column(column).cast("binary")
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    at, total = 0, len(sizes)
    ends = np.cumsum(sizes)
    while at < total:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at), texts.slice(at, to - at).to_pylist()
        at = to


def hashed_share(rows: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """Rows with ``h``, a hash of ``key``: all of them, or about twice ``size`` where
    there are more, so that a sort for the first ``size`` moves few rows."""
    hashed = rows.withColumn("h", F.xxhash64(key, F.lit(seed)))
    n = rows.count()
    if n <= 2 * size:
        return hashed
    return hashed.filter(F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * (2.0 * size + 1000) / n))


def settle() -> None:
    """Gives freed memory back to the system: a Python worker stays for later tasks,
    and what it holds on to counts against its executor all that time."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def streamed(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function over a task's Arrow batches that settles when the task is over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            settle()

    return run


def filter_rows(df: DataFrame, text_col: str, keep: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of ``df`` for which ``keep`` holds; it gets batches of row numbers and
    whole texts and yields the same batches in runs, each with a mask for its rows."""
    ship(df.sparkSession)
    place = df.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(place).cast(pa.string())], ["row", "text"])
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *keep(texts)])))

    return df.mapInArrow(streamed(run), df.schema)


def input_bytes(df: DataFrame, text_col: str) -> int:
    """The size of what ``df`` reads by Catalyst's estimate; where it has none (it
    then assumes the largest number), the bytes of the texts, counted."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 58:
        return size
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
