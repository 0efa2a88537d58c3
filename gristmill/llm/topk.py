"""Exact top-k search by inner product: a Voronoi join.

Vectors are quantised to integers, and both queries and data go to the cell of
their nearest pivot.  Each cell is summarised by its size, radius and greatest
length.  Queries are first solved in their home cells (and in the next nearest
ones, until those hold ``k`` vectors), which bounds every query's k-th score from
below.  From that bound, the distance of the query to a pivot and the summary of
its cell follows which cells may still hold a better score; a query goes to the
blocks of those cells and of no others.  The pivots decide how much is pruned and
never what is found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import materialize, ship
from gristmill.llm.vectors import blocked, bounded_sample, first_k, frame, matrix, pair_up, ranked, sent, solve, usable

SCALE = 1024.0
#: Sums of products up to this are exact in doubles.
EXACT = 2.0**53


def quantise(v):
    return F.transform(v, lambda x: F.floor(F.lit(SCALE) * x).cast("double"))


def _nearest_batches(batches, pivots: np.ndarray):
    for batch in batches:
        x, p = pair_up(matrix(batch.column(1).to_pylist(), pivots.shape[1]), pivots)
        if len(x):
            square = (x * x).sum(1)[:, None] - 2 * x @ p.T + (p * p).sum(1)
            cell = square.argmin(1)
            distance = np.sqrt(((x - p[cell]) ** 2).sum(1))
            length = np.sqrt((x * x).sum(1))
        else:
            cell, distance, length = np.empty(0, np.int64), np.empty(0), np.empty(0)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(distance), pa.array(length)], ["vec_id", "v", "cell", "distance", "length"])


def inner_products(data: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products as longs.  Where doubles might round, Python integers
    are used, held within the range of a long."""
    reach = np.abs(data).max(initial=0) * np.abs(query).max(initial=0) * max(1, data.shape[1])
    if reach < EXACT:
        return (query @ data.T).astype(np.int64)
    exact = np.array([[int(c) for c in row] for row in query], object) @ np.array([[int(c) for c in row] for row in data], object).T
    return np.array([[max(-(2**63), min(2**63 - 1, c)) for c in row] for row in exact], np.int64).reshape(len(query), len(data))


def _best(k: int):
    def best(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: dict = {"query_id": [], "vec_id": [], "score": []}
        if len(data) and len(queries):
            x, q = pair_up(matrix(data.v), matrix(queries.v))
            ids = data.vec_id.to_numpy()
            for own, least, scores in zip(queries.vec_id, queries.least, inner_products(x, q), strict=True):
                at = first_k(scores, ids, own, k)
                at = at[scores[at] >= least] if not np.isnan(least) else at
                out["query_id"].append(np.full(len(at), own))
                out["vec_id"].append(ids[at])
                out["score"].append(scores[at])
        return frame(out).astype("int64")

    return best


_FOUND = "query_id long, vec_id long, score long"


def _bounds(pivots: np.ndarray, radius: np.ndarray, longest: np.ndarray, sizes: np.ndarray):
    """A function of query vectors: the highest score any vector of each cell can have.

    Both bounds hold: by Cauchy and Schwarz round the pivot, and by the triangle
    inequality on the distance to the cell."""

    def of(q: np.ndarray) -> np.ndarray:
        q, p = pair_up(q, pivots)
        norm = np.sqrt((q * q).sum(1))[:, None]
        near = q @ p.T + norm * radius
        apart = np.sqrt(np.maximum(0, norm**2 - 2 * q @ p.T + (p * p).sum(1)))
        far = (norm**2 + longest**2 - np.maximum(0, apart - radius) ** 2) / 2
        bound = np.minimum(near, far)
        return np.where(sizes > 0, bound + 1e-6 * np.abs(bound) + 1e-3, -np.inf)

    return of


def top_k(df: DataFrame, queries: DataFrame | None = None, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = 64) -> DataFrame:
    """The ``k`` rows of ``df`` with the highest integer inner product for each
    query: ``query_id``, ``rank``, ``vec_id``, ``score``.

    ``queries`` are rows of the same columns, by default those of ``df`` whose id
    is divisible by 100.  Components become ``floor(1024 x)``.  A row whose id or
    vector is null, or whose vector has a component that is null or not finite,
    takes no part.  A query finds every row but those of its own id; ties go to the
    smaller id.  Repeated rows are found as often as they occur; a query id that
    occurs several times is asked once, with its smallest vector.  Vectors of
    different length are compared as if the shorter ended in zeros.  An empty table
    gives an empty result.
    """
    ship(df.sparkSession)
    rows = usable(df, id_col, vector_col).withColumn("v", quantise(F.col("v")))
    centres = bounded_sample(rows, pivots, 17)
    if not len(centres):
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shape = "vec_id long, v array<double>, cell int, distance double, length double"
    data = materialize(rows.mapInArrow(lambda it: _nearest_batches(it, centres), shape), "cells")
    if queries is None:
        asked = data.filter(F.col("vec_id") % 100 == 0)
    else:
        asked = usable(queries, id_col, vector_col).withColumn("v", quantise(F.col("v"))).mapInArrow(lambda it: _nearest_batches(it, centres), shape)
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("v", "cell")).alias("q")).select("vec_id", "q.v", F.col("q.cell").alias("home"))
    sizes, radius, longest = np.zeros(len(centres), np.int64), np.zeros(len(centres)), np.zeros(len(centres))
    for r in data.groupBy("cell").agg(F.count("*").alias("n"), F.max("distance").alias("r"), F.max("length").alias("l")).collect():
        sizes[r.cell], radius[r.cell], longest[r.cell] = r.n, r.r, r.l
    by_cell = {c: int(n) for c, n in enumerate(sizes) if n}
    placed = blocked(data.select("vec_id", "v", "cell"), by_cell)
    # Home cells: the pivot's own and the next nearest, until they hold more than k.
    apart = ((centres[:, None] - centres[None]) ** 2).sum(2)
    homes = {}
    for c in range(len(centres)):
        near = np.argsort(apart[c], kind="stable")
        homes[c] = [int(x) for x in near[: int(np.searchsorted(np.cumsum(sizes[near]), k + 1)) + 1] if sizes[x]]
    home = F.element_at(F.create_map(*(x for c, near in homes.items() for x in (F.lit(c), F.array(*map(F.lit, near)).cast("array<int>")))), F.col("home"))
    asked = materialize(asked.withColumn("cells", home), "queries")
    first = solve(placed, sent(asked.select("vec_id", "v", F.lit(float("nan")).alias("least"), F.explode("cells").alias("cell")), by_cell), _best(k), _FOUND)
    first = materialize(ranked(first, k, [F.desc("score")]).drop("rank"), "first")
    least = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("least"))
    bound = _bounds(centres, radius, longest, sizes)

    @F.pandas_udf("array<int>")
    def others(v: pd.Series, least: pd.Series, seen: pd.Series) -> pd.Series:
        high = bound(matrix(v, centres.shape[1]))
        return pd.Series([[c for c in np.flatnonzero((h >= s) if s == s else np.isfinite(h)).tolist() if c not in set(done)] for h, s, done in zip(high, least, seen, strict=True)])

    again = asked.join(least, asked.vec_id == least.query_id, "left").select("vec_id", "v", "least", others("v", "least", "cells").alias("cells"))
    again = materialize(again, "rest")
    second = solve(placed, sent(again.select("vec_id", "v", F.coalesce("least", F.lit(float("nan"))).alias("least"), F.explode("cells").alias("cell")), by_cell), _best(k), _FOUND)
    return ranked(first.unionByName(second), k, [F.desc("score")]).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def topk_query(embeddings: DataFrame) -> DataFrame:
    return top_k(embeddings)


TOPK_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
