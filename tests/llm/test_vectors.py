import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import ann, topk, vectors

NAN, INF = float("nan"), float("inf")


def usable(rows, nonzero=False):
    return [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and (any(v) or not nonzero)]


def padded(a, b):
    n = max(len(a), len(b))
    return [*a, *[0.0] * (n - len(a))], [*b, *[0.0] * (n - len(b))]


def brute_topk(rows, k=10):
    rows = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in usable(rows)]
    out = {}
    for q in sorted({i for i, _ in rows if i % 100 == 0}):
        vector = min(v for i, v in rows if i == q)
        scored = sorted((-sum(a * b for a, b in zip(*padded(vector, v), strict=True)), i) for i, v in rows if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def brute_nearest(rows, k=10):
    rows = usable(rows, True)
    out = {}
    for q in sorted({i for i, _ in rows if i % 100 == 0}):
        vector = min(v for i, v in rows if i == q)
        out[q] = [i for _, i in sorted((math.dist(*padded(vector, v)), i) for i, v in rows if i != q)[:k]]
    return out


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.fixture
def odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(350)]
    rows += [(100, rows[100][1]), (7, rows[7][1]), (7, rows[7][1]), (400, None), (401, [1.0, None]), (402, [NAN] * 8), (403, [INF] * 8), (None, [1.0] * 8)]
    rows += [(500, [0.0] * 8), (501, [0.5] * 3), (502, []), (600, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as cell", "2 as v", "3 as run")
    return rows, df


def test_topk_against_brute_force(odd_vectors, monkeypatch):
    rows, df = odd_vectors
    expect = {q: x for q, x in brute_topk(rows).items()}
    assert by_query(topk.top_k(df, pivots=8)) == expect
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "RUN", 2)
    assert by_query(topk.top_k(df, pivots=5)) == expect
    assert topk.top_k(df.limit(0)).count() == 0


def test_blocks_are_copied_for_the_runs_that_ask(spark, monkeypatch):
    """Block (0, 0) is asked for by five queries, (0, 1) by one and (1, 0) by none."""
    monkeypatch.setattr(vectors, "RUN", 2)
    sent = []
    monkeypatch.setattr(vectors, "copies", lambda data, runs, f=vectors.copies: sent.append(f(data, runs)) or sent[-1])
    data = spark.createDataFrame([(i, [1.0], i // 20, i // 10 % 2) for i in range(30)], "vec_id long, v array<double>, cell int, block int")
    queries = spark.createDataFrame([(i, [1.0], 0, 0) for i in range(5)] + [(9, [1.0], 0, 1)], data.schema)
    found = vectors.solve(data, queries, lambda a, b: a.head(len(b))[["vec_id"]] if len(b) else a.head(0)[["vec_id"]], "vec_id long")
    found.collect()
    assert {(r.cell, r.block): r["count"] for r in sent[0].groupBy("cell", "block").count().collect()} == {(0, 0): 30, (0, 1): 10}


def test_topk_with_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert by_query(topk.top_k(df)) == {0: [(1, 1024 * 512), (2, 1024 * 512)]}


def test_large_components_keep_exact_products():
    a, b = np.array([[2.0**40, 1.0]]), np.array([[2.0**40, 3.0], [2.0**10, 5.0]])
    assert topk.inner_products(b, a).tolist() == [[2**63 - 1, 2**50 + 5]]


def test_ann_scores_and_order(odd_vectors):
    rows, df = odd_vectors
    got = by_query(ann.nearest(df, share=1.0, codebook=8))
    expect = brute_nearest(rows)
    assert {q: [i for i, _ in x] for q, x in got.items()} == expect
    vector = dict(reversed(usable(rows, True)))
    for q, found in got.items():
        for i, score in found:
            assert score == pytest.approx(math.dist(*padded(vector[q], vector[i])), rel=1e-12)
    assert ann.nearest(df.limit(0)).count() == 0


def test_ann_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = [(r.vec_id, list(r.embedding)) for r in rows.collect()]
    expect = brute_nearest(data)
    got = by_query(ann.ann_query(rows))
    hits = sum(len({i for i, _ in got[q]} & set(x)) for q, x in expect.items())
    assert hits >= 0.9 * sum(map(len, expect.values()))
    assert all(len(got[q]) == len(x) for q, x in expect.items())


def test_multi_sequence_is_in_order_of_distance():
    rng = np.random.default_rng(0)
    a, b, sizes = rng.random(9), rng.random(7), rng.integers(0, 5, 63)
    cells = ann.multi_sequence(a, b, sizes, 10**9)
    sums = [a[c // 7] + b[c % 7] for c in cells]
    assert sums == sorted(sums)
    assert sorted(cells) == np.flatnonzero(sizes).tolist()
    few = ann.multi_sequence(a, b, sizes, 20)
    assert few == cells[: len(few)] and sizes[few].sum() >= 20 > sizes[few[:-1]].sum()


def test_usable_keeps_only_whole_vectors(odd_vectors):
    rows, df = odd_vectors
    assert vectors.usable(df, "vec_id", "embedding").count() == len(usable(rows))
    assert vectors.usable(df, "vec_id", "embedding", nonzero=True).filter(F.col("vec_id").isin(500, 502)).count() == 0
