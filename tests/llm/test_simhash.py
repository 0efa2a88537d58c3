import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gristmill.llm import simhash as S


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, budget):
    """Smallest position reachable from each, by plain search over all pairs."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near(rng, fp, most):
    for b in rng.sample(range(64), rng.randint(0, most)):
        fp ^= 1 << b
    return fp


@pytest.mark.parametrize("seed", range(6))
def test_trie_links_give_the_components_of_all_pairs(seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(12)]
    fps = sorted({near(rng, rng.choice(centres), 7) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)})
    left, right = S.trie_links(np.array(fps, np.uint64), np.zeros(len(fps), np.int64), 4)
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == brute_components(fps, 4)


@pytest.mark.parametrize(("chunk", "estimate"), [(2048, 0), (16, 0), (2048, 10**8), (16, 10**12)])
def test_links_over_blocks_and_chunks(spark, chunk, estimate):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(5)]
    fps = sorted({near(rng, rng.choice(centres), 6) for _ in range(200)} | {near(rng, 0, 3) for _ in range(50)})
    signed = [fp - (1 << 64) if fp >> 63 else fp for fp in fps]
    found = S.components(S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4, chunk, estimate)).collect()
    roots = {r.node: r.root for r in found}
    expect = brute_components(signed_to_unsigned := [x & (2**64 - 1) for x in signed], 4)
    groups, own = {}, {}
    for x, r in zip(signed, expect, strict=True):
        groups.setdefault(r, []).append(x)
    for members in groups.values():
        for x in members:
            own[x] = min(members)
    assert signed_to_unsigned == fps
    assert {x: roots.get(x, x) for x in signed} == own


def test_fingerprints_are_those_of_the_definition():
    texts = ["A b C d e f", "a b", "", None, "  \t", "ein schönes Haus " * 50, "x"]
    got = S.fingerprint_many([t.encode() if t is not None else None for t in texts])
    assert got.tolist() == [brute_fingerprint(t) for t in texts]


def test_odd_rows(odd, empty):
    rows = {}
    for r in S.near_duplicates(odd).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, rows.values())) == odd.count()
    assert {r.component_id for i in (1, 2) for r in rows[i]} == {1}
    assert {r.component_id for i in (3, 4, 5) for r in rows[i]} == {3}
    assert rows[None][0].component_id is None
    assert all(r.fingerprint == f"{brute_fingerprint(None):016x}" for r in rows[3])
    assert S.near_duplicates(empty).count() == 0
    kept = S.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 6), (False, 7), (False, 8), (True, 0)]


def test_more_fingerprints_get_longer_keys():
    for n, keys in ((10**6, 5), (10**8, 15), (10**10, 35)):
        runs = S.cut_bits(4, n, 2048)
        assert len(runs) == keys
        assert n / 2.0 ** min(sum(w for _, w in x) for x in runs) <= 2 * 2048


def test_very_often_repeated_row_and_long_texts(spark, odd):
    many = spark.range(100_000).selectExpr("77L as doc_id", "'one and the same text again and again' as text", "'a' as file", "2 as place", "'r' as row", "3 as _metadata")
    long = spark.range(3).selectExpr("id as doc_id", "concat(id, repeat(concat(' long', id, ' words'), 200000)) as text", "'b' as file", "1 as place", "'r' as row", "4 as _metadata")
    kept = S.drop_near_duplicates(many.unionByName(long))
    assert kept.columns == many.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [0, 1, 2, 77]


def test_query_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    expect = {r.doc_id: (f"{fp:016x}", rows[c].doc_id) for r, fp, c in zip(rows, fps, brute_components(fps, 4), strict=True)}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got == expect


def test_long_chain_is_one_component(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in S.components(edges).collect()} == {0}
