"""Vector columns shared by the exact and the approximate search.

Searching is block-wise: data vectors sit in blocks of bounded size, a query goes
to the blocks that may hold an answer, and each (block, run of queries) is solved
by one call.  A cell with very many vectors is cut into blocks by a hash of the
id, so no group grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import hashed_share, materialize

#: Vectors of a block, and queries that are solved against it at once.
BLOCK = 4096
RUN = 1024
#: Blocks up to which the list of those asked for is broadcast (three numbers each).
SMALL = 100_000


def usable(df: DataFrame, id_col: str, vector_col: str, nonzero: bool = False) -> DataFrame:
    """``vec_id`` and ``v`` (array<double>) of the rows that take part: the id and
    the vector aren't null, nor is any component, and all are finite."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad)
    return rows.filter(F.exists(v, lambda x: x != 0)) if nonzero else rows


def matrix(values, width: int | None = None) -> np.ndarray:
    """Rows of doubles; a shorter vector is filled up with zeros."""
    values = [np.asarray(x, np.float64) for x in values]
    width = max([width or 0, *map(len, values)])
    if all(len(x) == width for x in values):
        return np.stack(values) if values else np.zeros((0, width))
    out = np.zeros((len(values), width))
    for row, x in zip(out, values, strict=True):
        row[: len(x)] = x
    return out


def pair_up(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, b))


def bounded_sample(rows: DataFrame, size: int, seed: int) -> np.ndarray:
    """At most ``size`` vectors, by a hash of the id: the same ones each time."""
    picked = hashed_share(rows, "vec_id", size, seed).orderBy(F.pmod("h", F.lit(1 << 30)), "h", "vec_id").limit(size).select("v").collect()
    # Rows of one id stand or fall together; where none is in the share, any will do.
    return matrix([r.v for r in picked or rows.select("v").limit(size).collect()])


def blocked(rows: DataFrame, sizes: dict, cell: str = "cell") -> DataFrame:
    """Adds ``block``: the cells of more than ``BLOCK`` vectors are cut by a hash."""
    counts = {c: n for c, n in sizes.items() if n > BLOCK}
    if not counts:
        return rows.withColumn("block", F.lit(0))
    many = F.create_map(*(F.lit(x) for c, n in counts.items() for x in (c, -(-n // BLOCK))))
    k = F.coalesce(F.element_at(many, F.col(cell)), F.lit(1))
    return rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), k).cast("int"))


def sent(queries: DataFrame, sizes: dict) -> DataFrame:
    """Queries with a column ``cell``, one row for every block of that cell."""
    counts = {c: -(-n // BLOCK) for c, n in sizes.items() if n > BLOCK}
    if not counts:
        return queries.withColumn("block", F.lit(0))
    k = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in counts.items() for x in kv)), F.col("cell")), F.lit(1))
    return queries.withColumn("block", F.explode(F.sequence(F.lit(0), k - 1)))


def solve(data: DataFrame, queries: DataFrame, best: Callable, schema: str) -> DataFrame:
    """Runs ``best(data rows, query rows)`` for every block that queries were sent to.

    The queries of a block are cut into runs of about ``RUN`` by a hash, and the block
    is copied for each of its own runs: a block that none asks for goes nowhere."""
    keys = ["cell", "block"]
    runs = queries.groupBy(*keys).agg(F.ceil(F.count("*") / RUN).cast("int").alias("runs"))
    runs = materialize(runs, "runs")  # a row for each block
    runs = runs.hint("broadcast") if runs.count() <= SMALL else runs
    queries = queries.join(runs, keys).withColumn("run", F.pmod(F.xxhash64("vec_id", F.lit(11)), F.col("runs")).cast("int")).drop("runs")
    data = copies(data, runs)
    keys = [*keys, "run"]
    return data.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(best, schema)


def copies(data: DataFrame, runs: DataFrame) -> DataFrame:
    """Data rows of the blocks in ``runs``, one for each run."""
    return data.join(runs, ["cell", "block"]).withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1))).drop("runs")


def ranked(found: DataFrame, k: int, order: list) -> DataFrame:
    """The first ``k`` of each query by ``order`` and id, with their ``rank``."""
    w = Window.partitionBy("query_id").orderBy(*order, "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def first_k(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id, without rows of id ``own``."""
    at = np.flatnonzero(ids != own)
    if len(at) > k:
        edge = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= edge]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def frame(columns: dict) -> pd.DataFrame:
    return pd.DataFrame({k: np.concatenate(v) if v else np.empty(0) for k, v in columns.items()})
