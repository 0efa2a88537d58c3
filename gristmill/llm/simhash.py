"""SimHash near-duplicates: a binary-trie self-join over 64-bit fingerprints.

Fingerprints are computed from whole texts, exact copies collapse to one
fingerprint before anything else happens, and the distinct fingerprints are
joined with themselves under a Hamming budget.  The join walks pairs of trie
nodes together, adds up the bits in which the two branches differ and drops a
pair as soon as the budget is spent.

To spread the walk over tasks the 64 bits are cut into ``budget + 1`` blocks, or
into a few more if there are many fingerprints.  Two fingerprints within the budget
agree in all blocks but ``budget``, so the bits of any such choice of blocks key
sub-tries of their own; sub-tries over ``chunk`` fingerprints are cut into chunks by
hash and every pair of chunks is one task.  Nothing is dropped.

Only links that join two different runs are returned, which is all that the
components need; components come from alternating large and small stars, whose
state is an edge table in the shared folder.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.common import materialize, placed, ship, streamed, text_slices

_hash = partial(xxhash.xxh64_intdigest, seed=42)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(data: bytes, size: int) -> Iterator[bytes]:
    words = data.lower().split()
    if len(words) <= size:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))


def fingerprint_many(texts: list[bytes | None], size: int = 4) -> np.ndarray:
    """Fingerprints of whole texts; zero for a null text or one without words."""
    out = np.zeros(len(texts), np.uint64)
    hashed, owners = [], []
    for i, data in enumerate(texts):
        if data and len(h := np.fromiter(map(_hash, shingles(data, size)), np.uint64)):
            hashed.append(h)
            owners.append(i)
    step = 1 << 17  # rows of 64 bits unpacked at a time
    counts = np.zeros((len(owners), 64), np.int64)
    sizes = np.array([len(h) for h in hashed], np.int64)
    if len(owners):
        flat, row = np.concatenate(hashed), np.repeat(np.arange(len(owners)), sizes)
        for at in range(0, len(flat), step):
            bits = np.unpackbits(flat[at : at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            rows = row[at : at + step]
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            counts[rows[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        out[owners] = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprint_batches(batches, size: int):
    """Rows end with their text, in whose place they get the fingerprint."""
    for batch in batches:
        names = [*batch.schema.names[:-1], "fp"]
        for part, texts in text_slices(batch, batch.num_columns - 1):
            fp = fingerprint_many(texts, size)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fp.view(np.int64))], names)


def fingerprints(df: DataFrame, text_col: str, kept: list, size: int = 4) -> DataFrame:
    """The columns ``kept`` and ``fp`` (the 64 bits as a signed long) of every row."""
    ship(df.sparkSession)
    picked = df.select(*kept, F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("fp", T.LongType())])
    return picked.mapInArrow(streamed(lambda it: _fingerprint_batches(it, size)), schema)


def trie_links(fps: np.ndarray, groups: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between runs of fingerprints of one group.

    ``fps`` is sorted within each of the contiguous ``groups`` and has no
    repeats there.  Neighbours in that order within the budget form a run, whose
    members are linked to its first; a pair of nodes that lie in one run has
    nothing to add and is left out of the walk.
    """
    n = len(fps)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    fresh = np.r_[True, groups[1:] != groups[:-1]]
    joined = ~fresh
    joined[1:] &= np.bitwise_count(fps[1:] ^ fps[:-1]) <= budget
    run = np.cumsum(~joined) - 1
    head = np.flatnonzero(~joined)
    member = np.flatnonzero(joined)
    lefts, rights = [head[run[member]]], [member]
    starts = np.flatnonzero(fresh)
    ends = np.r_[starts[1:], n]
    keep = run[starts] != run[ends - 1]
    al = bl = starts[keep].astype(np.int32)
    ah = bh = ends[keep].astype(np.int32)
    err = np.zeros(len(al), np.int8)
    for bit in range(63, -1, -1):
        if not len(al):
            break
        ones = np.r_[0, np.cumsum((fps >> np.uint64(bit)) & np.uint64(1))].astype(np.int32)
        am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
        same = al == bl
        other = ~same
        al, ah, bl, bh, err = (
            np.concatenate(x)
            for x in (
                (al, am, al, am[other]),
                (am, ah, am, ah[other]),
                (bl, bm, bm, bl[other]),
                (bm, bh, bh, bm[other]),
                (err, err, err + 1, err[other] + 1),
            )
        )
        ok = (al < ah) & (bl < bh) & (err <= budget)
        al, ah, bl, bh, err = al[ok], ah[ok], bl[ok], bh[ok], err[ok]
        low, high = np.minimum(run[al], run[bl]), np.maximum(run[ah - 1], run[bh - 1])
        ok = low != high
        al, ah, bl, bh, err = al[ok], ah[ok], bl[ok], bh[ok], err[ok]
        leaf = (ah - al == 1) & (bh - bl == 1)
        a, b = al[leaf], bl[leaf]
        hit = np.bitwise_count(fps[a] ^ fps[b]) <= budget
        a, b = a[hit], b[hit]
        if len(a):
            _, first = np.unique(np.minimum(run[a], run[b]) * n + np.maximum(run[a], run[b]), return_index=True)
            lefts.append(a[first])
            rights.append(b[first])
        rest = ~leaf
        al, ah, bl, bh, err = al[rest], ah[rest], bl[rest], bh[rest], err[rest]
    left, right = np.concatenate(lefts), np.concatenate(rights)
    return left.astype(np.int64), right.astype(np.int64)


def _link_batches(batches, budget: int, flush: int = 1 << 14):
    """Rows come sorted by (task, fp); whole tasks are handed on once enough rows wait."""
    tasks, fps = np.empty(0, np.int64), np.empty(0, np.int64)

    def links(t, f):
        left, right = trie_links(f.view(np.uint64) ^ np.uint64(1 << 63), t, budget)
        return pa.RecordBatch.from_arrays([pa.array(f[left]), pa.array(f[right])], ["a", "b"])

    for batch in batches:
        tasks = np.r_[tasks, batch.column(0).to_numpy(zero_copy_only=False)]
        fps = np.r_[fps, batch.column(1).to_numpy(zero_copy_only=False)]
        if len(tasks) >= flush:
            cuts = np.flatnonzero(tasks[1:] != tasks[:-1]) + 1
            at = 0
            while len(later := cuts[cuts >= min(at + flush, cuts[-1] if len(cuts) else 0)]) and later[0] > at:
                yield links(tasks[at : later[0]], fps[at : later[0]])
                at = int(later[0])
            tasks, fps = tasks[at:], fps[at:]
    if len(tasks):
        yield links(tasks, fps)


def cut_bits(budget: int, distinct: int, chunk: int) -> list[list[tuple[int, int]]]:
    """The bits that key the sub-tries: lists of (first, number) runs of bits.

    With the 64 bits in ``n`` blocks, two fingerprints within the budget agree in
    ``n - budget`` blocks at least, so each choice of that many blocks is a key.
    More blocks make longer keys, thus smaller sub-tries, but more keys: the ``n``
    that sends the fewest copies of a fingerprint counts."""

    def copies(n: int) -> float:
        bits = 64 // n * (n - budget)
        return math.comb(n, budget) * max(1.0, distinct / 2.0**bits / chunk)

    n = min(range(budget + 1, min(64, budget + 5) + 1), key=copies)
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [[(edges[i], edges[i + 1] - edges[i]) for i in some] for some in itertools.combinations(range(n), n - budget)]


def _key(runs: list[tuple[int, int]]) -> Column:
    """The bits of ``fp`` in these runs, side by side."""
    out, at = F.lit(0).cast("long"), 0
    for first, width in runs:
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("fp", first).bitwiseAND((1 << width) - 1), at))
        at += width
    return out


def links(distinct: DataFrame, budget: int = 4, chunk: int = 2048, estimate: int = 0) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fp``) that are
    enough to tell which are connected by steps of ``budget`` bits or fewer.

    ``estimate`` is about how many there are; it decides how they are dealt and
    not what is found."""
    ship(distinct.sparkSession)
    value = F.array(*map(_key, cut_bits(budget, estimate, chunk)))
    rows = distinct.select("fp", F.posexplode(value).alias("block", "value"))
    sizes = rows.groupBy("block", "value").count().filter("count > 1")
    rows = rows.join(sizes.hint("merge"), ["block", "value"]).withColumn("k", F.ceil(F.col("count") / chunk).cast("int"))
    own = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("k")).cast("int")
    others = F.when(F.col("k") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("k") - 1), lambda j: j != F.col("own")))
    tasks = (
        rows.withColumn("own", own)
        .withColumn("other", F.explode(others))
        .select(F.xxhash64("block", "value", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "fp")
    )
    found = (
        tasks.repartition("task")
        .sortWithinPartitions("task", "fp")
        .mapInArrow(streamed(lambda it: _link_batches(it, budget)), "a long, b long")
    )
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) of every node in ``edges``.

    Alternates large and small stars until the edge table stays as it is, each
    round written to the shared folder.  A hub with very many edges costs partial
    minima and a join that adaptive execution can split.
    """
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    down, before = materialize(down, "edges"), None
    while True:
        state = down.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if not state[0] or state == before:
            return down.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = down.union(down.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = materialize(small.union(low).distinct(), "edges")


def _classes(marked: DataFrame, budget: int, chunk: int) -> DataFrame:
    """``fp`` and ``root`` (one fingerprint of its class) of every distinct ``fp`` of ``marked``."""
    distinct = marked.select("fp").distinct()
    estimate = marked.agg(F.approx_count_distinct("fp")).first()[0]
    found = components(links(distinct, budget, chunk, estimate))
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return materialize(rooted, "classes")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, budget: int = 4, chunk: int = 2048
) -> DataFrame:
    """The near-duplicate class of every row of ``df``.

    Returns ``id_col``, ``fingerprint`` (16 hex digits), ``component_id`` (the
    smallest id reachable over fingerprints ``budget`` bits apart or fewer, its
    own included) and ``component_key`` (one fingerprint of the class).

    A null text, an empty one and one of white space have fingerprint zero and
    are linked like any other.  Rows are kept as they are: a repeated row is
    returned as often as it occurs, and a row whose id is null gets the smallest
    id of its class that is not null (null if there is none).  An empty table
    gives an empty result.  Other columns of ``df`` are not looked at.
    """
    marked = materialize(fingerprints(df, text_col, [F.col(id_col).alias("id")], size), "fingerprints")
    rooted = _classes(marked, budget, chunk)
    least = marked.groupBy("fp").agg(F.min("id").alias("least"))
    smallest = rooted.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root")
    return marked.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.lower(F.lpad(F.hex("root"), 16, "0")).alias("component_key"),
    )


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, budget: int = 4, chunk: int = 2048) -> DataFrame:
    """The rows of ``df`` without near-duplicates: of each class (see
    :func:`near_duplicates`) one row with the smallest id stays, the first in file
    order if that id is repeated; a class without any id keeps its first row.

    Survivors are chosen on ids and places of rows alone.  Whole rows are dealt once,
    by their place, and neither sorted nor compared, so it doesn't matter how often
    a row is repeated.  Nulls, empty texts and an empty table are as there; columns of
    any name are passed on.
    """
    rows = placed(df)
    marked = rows.select(F.col(f"row.`{id_col}`").alias("id"), F.col(f"row.`{text_col}`").alias("text"), "file", "place")
    marked = materialize(fingerprints(marked, "text", ["id", "file", "place"], size), "fingerprints")
    first = marked.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("lost"), "id", "file", "place")).alias("first"))
    kept = _classes(marked, budget, chunk).join(first, "fp").groupBy("root").agg(F.min("first").alias("first")).select("first.file", "first.place")
    return rows.join(kept.hint("shuffle_hash"), ["file", "place"], "left_semi").select("row.*")
