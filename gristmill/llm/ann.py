"""Approximate nearest neighbours with an inverted multi-index.

Each vector is cut in two halves, each half quantised by its own codebook, and
the pair of codes is the cell.  A query orders the codes of each half by distance
and a heap yields pairs of codes by summed distance; it visits cells until they
hold the share of all vectors that is to be looked at, and the entries of those
cells are ranked by their exact distance.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.common import materialize, ship
from gristmill.llm.vectors import blocked, bounded_sample, first_k, frame, matrix, pair_up, ranked, sent, solve, usable


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centroids by Lloyd's rounds from points picked at random; an empty one stays."""
    distinct = np.unique(points, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        code = codes(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, code, points)
        n = np.bincount(code, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum(0, (points * points).sum(1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(1))


def codes(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return squares(points, centres).argmin(1)


def halves(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of vectors of ``width`` components; longer ones put the rest in the second half."""
    if x.shape[1] < width:
        x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    return x[:, : width // 2], x[:, width // 2 : width]


def multi_sequence(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells (``i * len(b) + j``) by summed distance until they hold ``enough``.

    A pair enters the heap once both its neighbours with a smaller rank have left."""
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b = a[order_a], b[order_b]
    heap, left, out, held = [(float(a[0] + b[0]), 0, 0)], set(), [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        left.add((i, j))
        cell = int(order_a[i]) * len(b) + int(order_b[j])
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        if i + 1 < len(a) and (j == 0 or (i + 1, j - 1) in left):
            heapq.heappush(heap, (float(a[i + 1] + b[j]), i + 1, j))
        if j + 1 < len(b) and (i == 0 or (i - 1, j + 1) in left):
            heapq.heappush(heap, (float(a[i] + b[j + 1]), i, j + 1))
    return out


def _cell_batches(batches, first: np.ndarray, second: np.ndarray, width: int):
    for batch in batches:
        x = matrix(batch.column(1).to_pylist(), width)
        a, b = halves(x, width)
        one, two = (codes(a, first), codes(b, second)) if len(x) else (np.empty(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(one, pa.int32()), pa.array(two, pa.int32())], ["vec_id", "v", "cell", "second"])


def _best(k: int, n_second: int):
    """Ranks the entries of a block, all of one first code, for the queries that
    visit it; each looks only at the second codes it wants."""

    def best(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: dict = {"query_id": [], "vec_id": [], "score": []}
        if len(data) and len(queries):
            x, q = pair_up(matrix(data.v), matrix(queries.v))
            ids = data.vec_id.to_numpy()
            rough = squares(q, x)
            slack = 1e-9 * ((q * q).sum(1) + (x * x).sum(1).max())
            code = data.second.to_numpy()
            for own, wanted, row, vector, extra in zip(queries.vec_id, queries.wanted, rough, q, slack, strict=True):
                visited = np.zeros(n_second, bool)
                visited[np.asarray(wanted, np.int64)] = True
                at = np.flatnonzero((ids != own) & visited[code])
                if len(at) > k:
                    at = at[row[at] <= np.partition(row[at], k - 1)[k - 1] + 2 * extra]
                exact = np.sqrt(((x[at] - vector) ** 2).sum(1))
                kept = first_k(-exact, ids[at], own, k)
                out["query_id"].append(np.full(len(kept), own))
                out["vec_id"].append(ids[at][kept])
                out["score"].append(exact[kept])
        return frame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return best


def nearest(
    df: DataFrame,
    queries: DataFrame | None = None,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    codebook: int = 64,
    sample: int = 20_000,
    share: float = 0.5,
) -> DataFrame:
    """About the ``k`` nearest rows of ``df`` for each query, by Euclidean distance:
    ``query_id``, ``rank``, ``vec_id``, ``score`` (the exact distance).

    The codebooks are fitted on ``sample`` vectors at most; every vector is indexed.
    A query looks at cells until they hold ``share`` of all vectors, and more than ``k``
    of them, at every size of the table; that is what its recall depends on.

    ``queries`` are rows of the same columns, by default those of ``df`` whose id
    is divisible by 100.  A row whose id or vector is null, whose vector is zero, or
    has a component that is null or not finite, takes no part.  A query finds every
    row but those of its own id; ties go to the smaller id.  Repeated rows are found
    as often as they occur; a query id that occurs several times is asked once, with
    its smallest vector.  Vectors of different length are compared as if the shorter
    ended in zeros.  An empty table gives an empty result.
    """
    ship(df.sparkSession)
    rows = usable(df, id_col, vector_col, nonzero=True)
    points = bounded_sample(rows, sample, 23)
    if not len(points):
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = points.shape[1]
    first, second = (kmeans(x, codebook) for x in halves(points, width))
    assign = lambda frame_: frame_.mapInArrow(lambda it: _cell_batches(it, first, second, width), "vec_id long, v array<double>, cell int, second int")
    data = materialize(assign(rows), "multi-index")
    asked = data.filter(F.col("vec_id") % 100 == 0) if queries is None else usable(queries, id_col, vector_col, nonzero=True)
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = np.zeros((len(first), len(second)), np.int64)
    for r in data.groupBy("cell", "second").count().collect():
        sizes[r[0], r[1]] = r[2]
    by_cell = {c: int(n) for c, n in enumerate(sizes.sum(1)) if n}
    flat, enough = sizes.ravel(), max(k, int(np.ceil(share * sizes.sum()))) + 1

    @F.pandas_udf("array<struct<cell:int,wanted:array<int>>>")
    def visit(v: pd.Series) -> pd.Series:
        a, b = halves(matrix(v, width), width)
        out = []
        for x, y in zip(squares(a, first), squares(b, second), strict=True):
            by_first: dict[int, list[int]] = {}
            for cell in multi_sequence(x, y, flat, enough):
                by_first.setdefault(cell // len(second), []).append(cell % len(second))
            out.append([{"cell": i, "wanted": js} for i, js in by_first.items()])
        return pd.Series(out)

    asked = materialize(asked.select("vec_id", "v", visit("v").alias("visits")), "queries")
    placed = blocked(data, by_cell)
    visits = asked.withColumn("visit", F.explode("visits")).select("vec_id", "v", "visit.cell", "visit.wanted")
    found = solve(placed, sent(visits, by_cell), _best(k, len(second)), "query_id long, vec_id long, score double")
    return ranked(found, k, ["score"]).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def ann_query(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings)
