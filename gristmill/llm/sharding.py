"""Sharding by extendible hashing, in DataFrame operations.

Every row has a 64-bit hash, of its key above and of its content below.  The
directory is a prefix tree over those bits: a bucket whose bytes pass the limit
is split on its next bit, any other stays as it is.  Bytes are summed by prefixes
of 16 more bits at a time, and only the rows of buckets that are still too large
go on to the next 16, so deep splits touch few rows.

A key with very many rows is split by the bits of their contents.  Rows that are
alike in all 64 bits can't be told apart by hashing: a bucket of such rows is laid
out in pages, in the order of their ranks, which are counted by file first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import materialize, placed

#: Bits that one round adds to the prefixes.
STEP = 16
LIMIT = 1 << 20


def hash_bits(key: str, content: str):
    """64 bits as an unsigned decimal string of hex digits: eight of the key's MD5, eight of the content's."""
    eight = lambda c: F.substring(F.md5(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.conv(F.concat(eight(key), eight(content)), 16, -10).cast("long")


def _prefix(bits, depth):
    """The first ``depth`` bits as a number; 0 for depth 0."""
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", bits, (F.lit(64) - depth).cast("int")))


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Buckets ``depth``, ``prefix``, ``bytes``, ``rows`` and ``cell_depth``, ``cell``: one
    row for each prefix of ``cell_depth`` bits below a bucket.  From columns ``bits`` and ``bytes``."""
    rest, parts, depth = rows.select("bits", "bytes"), [], 0
    while True:
        high = depth + STEP
        cells = materialize(
            rest.groupBy(F.shiftrightunsigned("bits", 64 - high).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")), "shard-cells"
        )
        # The bucket of the round before is known to be too large: its own prefix isn't a candidate.
        first = depth + (depth > 0)
        prefix = F.call_function("shiftrightunsigned", F.col("cell"), F.lit(high) - F.col("depth"))
        under = cells.select("cell", "bytes", "rows", F.explode(F.sequence(F.lit(first), F.lit(high))).alias("depth")).withColumn("prefix", prefix)
        sums = under.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        fits = (F.col("bytes") <= limit) | (F.col("rows") == 1) | (F.col("depth") == 64)
        large = sums.filter(~fits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
        small = sums.filter(fits).withColumn("up", F.shiftrightunsigned("prefix", 1))
        # A bucket is a prefix that fits and whose parent doesn't; a parent meets two rows at most.
        leaves = small.filter(F.col("depth") == first).unionByName(small.filter(F.col("depth") > first).join(large, ["depth", "up"], "left_semi")).drop("up")
        leaves = materialize(leaves, "shard-leaves")
        reach = leaves.agg(F.min("depth").alias("low"), F.max("depth").alias("high")).first()
        if reach.low is None:
            found = leaves.withColumns({"cell_depth": F.lit(high), "cell": F.lit(0).cast("long")})
        else:
            levels = F.explode(F.sequence(F.lit(reach.low), F.lit(reach.high))).alias("depth")
            found = cells.select("cell", levels).withColumn("prefix", prefix).join(leaves, ["depth", "prefix"])
            found = found.select("depth", "prefix", "bytes", "rows", F.lit(high).alias("cell_depth"), "cell")
        found = materialize(found, "shard-buckets")
        parts.append(found)
        left = cells.join(found.select("cell"), "cell", "left_anti").select("cell")
        if high == 64 or left.isEmpty():
            break
        rest = rest.withColumn("cell", F.shiftrightunsigned("bits", 64 - high)).join(left, "cell", "left_semi").drop("cell")
        depth = high
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shard(df: DataFrame, key_col: str = "doc_id", content_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """The shard of every row: ``key_col``, ``bytes`` (of the content in UTF-8),
    ``shard`` (the bits of its bucket as text, ``*`` for an only one), ``page`` (0 but
    for rows alike in all bits), ``shard_bytes`` and ``oversized``.

    A row larger than the limit is alone in its shard (or page), which is marked
    oversized; no other is larger than ``limit``.  A null content has no bytes; a
    null key is a key.  Repeated rows come out as often as they occur.  An empty
    table gives an empty result; other columns are not looked at.
    """
    found = _shards(df.select(F.col(key_col).alias("id"), F.col(content_col).cast("string").alias("content")), [], limit)
    return found.select(F.col("id").alias(key_col), "bytes", "shard", "page", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized"))


def _shards(df: DataFrame, kept: list[str], limit: int) -> DataFrame:
    """``id``, ``bytes``, ``shard``, ``page``, ``shard_bytes`` and the columns ``kept`` of
    rows of ``id`` and ``content``."""
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("long")
    rows = df.select("id", hash_bits("id", "content").alias("bits"), size.alias("bytes"), *kept)
    rows = materialize(rows.withColumn("part", F.spark_partition_id()), "shard-rows")
    buckets = materialize(directory(rows, limit), "shard-directory")
    depths = [r[0] for r in buckets.select("cell_depth").distinct().collect()]
    named = None
    for high in sorted(depths):
        own = buckets.filter(F.col("cell_depth") == high).select("cell", "depth", "prefix", F.col("bytes").alias("shard_bytes"), F.col("rows").alias("n"))
        part = rows.withColumn("cell", F.shiftrightunsigned("bits", 64 - high)).join(own, "cell").drop("cell")
        named = part if named is None else named.unionByName(part)
    if named is None:
        named = rows.withColumns({"depth": F.lit(0), "prefix": F.lit(0).cast("long"), "shard_bytes": F.lit(0).cast("long"), "n": F.lit(0).cast("long")})
    alike = (F.col("depth") == 64) & (F.col("shard_bytes") > limit) & (F.col("n") > 1)
    single = named.filter(~alike).withColumn("page", F.lit(0).cast("long"))
    by_part = named.filter(alike).groupBy("bits", "part").agg(F.count("*").alias("c"))
    before = by_part.withColumn("before", F.sum("c").over(Window.partitionBy("bits").orderBy("part")) - F.col("c")).drop("c")
    rank = F.row_number().over(Window.partitionBy("bits", "part").orderBy("id"))
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("bytes")))
    many = named.filter(alike).withColumn("rank", rank).join(before, ["bits", "part"]).withColumn("rank", F.col("rank") + F.col("before") - 1)
    many = (
        many.withColumn("page", F.floor(F.col("rank") / per_page).cast("long"))
        .withColumn("shard_bytes", F.least(per_page, F.col("n") - F.col("page") * per_page).cast("long") * F.col("bytes"))
        .drop("rank", "before")
    )
    both = single.unionByName(many)
    name = F.when(F.col("depth") == 0, F.lit("*")).otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    return both.select("id", "bytes", name.alias("shard"), "page", "shard_bytes", *kept)


def write_shards(df: DataFrame, path: str, key_col: str = "doc_id", content_col: str = "text", limit: int = LIMIT, shard_col: str = "shard_id") -> None:
    """Writes the rows of ``df`` as Parquet, a folder for each shard, and for each page of
    a shard that has pages: ``shard_col``, which must not be a column of ``df``, is ``s`` and
    the bits that :func:`shard` gives (none for an only shard), with ``-page`` behind from page 1.

    Nulls, repeated rows, oversized rows and an empty table (one that writes no folder)
    are as in :func:`shard`; other columns are passed on.  Whole rows are dealt by
    their place and then by folder, so no task gets more than the limit of a key."""
    rows = placed(df)
    named = _shards(rows.select(F.col(f"row.`{key_col}`").alias("id"), F.col(f"row.`{content_col}`").cast("string").alias("content"), "file", "place"), ["file", "place"], limit)
    folder = F.concat(F.lit("s"), F.when(F.col("shard") == "*", "").otherwise(F.col("shard")), F.when(F.col("page") > 0, F.concat(F.lit("-"), "page")).otherwise(""))
    out = rows.join(named.select("file", "place", folder.alias(shard_col)).hint("shuffle_hash"), ["file", "place"]).select("row.*", shard_col)
    out.repartition(shard_col).write.partitionBy(shard_col).parquet(path)


def sharding_query(documents: DataFrame) -> DataFrame:
    return shard(documents)


SHARDING_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS bytes, row_number() OVER () AS n,
    ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) || substr(md5(coalesce(text, '')), 1, 8))::UBIGINT AS bits
  FROM documents
), split AS (
  SELECT n, doc_id, bytes, bits, 0 AS depth, 0::UBIGINT AS prefix,
    sum(bytes) OVER () AS shard_bytes, count(*) OVER () AS members FROM sized
  UNION ALL
  SELECT n, doc_id, bytes, bits, depth + 1, bits >> (63 - depth),
    sum(bytes) OVER (PARTITION BY bits >> (63 - depth)), count(*) OVER (PARTITION BY bits >> (63 - depth))
  FROM split WHERE shard_bytes > {LIMIT} AND members > 1 AND depth < 64
), leaf AS (
  SELECT n, doc_id, bytes, depth, prefix, shard_bytes FROM split WHERE shard_bytes <= {LIMIT} OR members = 1
)
SELECT doc_id, CAST(bytes AS BIGINT) AS bytes, CASE WHEN depth = 0 THEN '*' ELSE lpad(bin(prefix), depth, '0') END AS shard,
  CAST(0 AS BIGINT) AS page, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_bytes > {LIMIT} AS oversized FROM leaf
"""
