"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target says how many of its words are expected in the mix.  Its documents
share them unequally: the expected number of copies of a document grows with the
square root of its length class (its number of binary digits), up to ``cap``, on a
level at which the source's expected words are its target.  The whole part of that
number is taken for certain, as whole copies.  The rest is the inclusion probability
``p`` of one more copy: every document draws a uniform ``u`` from a hash of its id
and is ranked by the Pareto variable, its odds over the inclusion odds
``(u / (1 - u)) / (p / (1 - p))``; documents of a source are taken in that order until
its words still missing are reached, so the sample has a fixed size in words.

Ranks are cut into ``buckets`` slices of each source; sums by slice find the one in
which the target falls, and only that slice is ranked row by row, equal ranks by
their files first, so neither a source nor an id with a third of all rows is
ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import WORD, materialize, placed

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Places at which the rows of one source are joined with its plan.
SALTS = 64


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, source_col: str = "source", weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source_size`` and ``target`` of every source, from a column ``size``.

    Targets share ``share`` times all sizes by weight; one that would pass ``cap``
    times its source stops there and the excess goes to the others by weight.
    Sources are ordered by cap over weight, the order in which they fill up, so
    the level at which the others stand comes from running sums; of sources that
    would fill up at once the first one's level holds, which is the highest.
    """
    sources = sized.groupBy(source_col).agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    full = F.col("source_size") * F.lit(float(cap))
    order = Window.orderBy("fills", F.col(source_col).asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.col("budget") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    return (
        sources.withColumn("w", w)
        .withColumn("full", full)
        .withColumn("fills", F.col("full") / F.col("w"))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("w").over(everything))
        .withColumn("level", level)
        .withColumn("at", -F.min(F.when(F.col("level") <= F.col("fills"), F.struct("fills", (-F.col("level")).alias("low")))).over(everything)["low"])
        .select(source_col, "source_size", F.when(F.col("at").isNull(), F.col("full")).otherwise(F.least("full", F.col("at") * F.col("w"))).alias("target"))
    )


def expected_copies(sized: DataFrame, targets: DataFrame, cap: float = 2.0, by_length: bool = True) -> DataFrame:
    """For each source ``__s`` and length class ``__k``: ``__whole`` copies for certain,
    the inclusion probability ``__p`` of one more, and ``__left``, the words of the source
    that this more adds up to, beside its ``source_size`` and ``target``.

    From the words of each class: classes reach ``cap`` from the longest down, so the
    level of the others comes from running sums, at most 64 for each source."""
    x = F.sqrt(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__k")).cast("double")) if by_length else F.lit(1.0)
    classes = sized.groupBy(F.col("source").alias("__s"), "__k").agg(F.sum("size").alias("words")).withColumn("x", x)
    classes = classes.join(targets, F.col("__s").eqNullSafe(F.col("source"))).drop("source")
    own = Window.partitionBy("__s")
    before = own.orderBy(F.desc("__k")).rowsBetween(Window.unboundedPreceding, -1)
    after = own.orderBy(F.desc("__k")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.col("target") - F.lit(float(cap)) * F.coalesce(F.sum("words").over(before), F.lit(0))
    level = F.when(F.col("weighed") > 0, rest / F.col("weighed"))
    fits = F.when(F.col("level") * F.col("x") <= F.lit(float(cap)), F.struct(-F.col("__k"), "level"))
    copies = F.when(F.col("source_size") == 0, F.lit(0.0)).when(F.col("at").isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.col("at") * F.col("x")))
    out = (
        classes.withColumn("weighed", F.sum(F.col("x") * F.col("words")).over(after))
        .withColumn("level", level)
        .withColumn("at", F.min(fits).over(own)["level"])
        .withColumn("copies", F.greatest(F.lit(0.0), copies))
        .withColumn("__whole", F.floor(F.col("copies") + 1e-12))
    )
    return out.select(
        "__s",
        "__k",
        "source_size",
        "target",
        "__whole",
        F.greatest(F.lit(0.0), F.col("copies") - F.col("__whole")).alias("__p"),
        (F.col("target") - F.sum(F.col("__whole") * F.col("words")).over(own)).alias("__left"),
    )


def draw(id_col: str, seed: int) -> Column:
    """A number between 0 and 1 from 52 bits of a hash of the id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0**52)


def _met(rows: DataFrame, plan: DataFrame, on: Column) -> DataFrame:
    """Joins rows with a plan of few rows; each of these is met in SALTS places, so that
    a source with very many rows doesn't come to a single task."""
    plan = plan.withColumn("__place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.join(plan, on & (F.pmod(F.xxhash64("__u", "__part"), F.lit(SALTS)) == F.col("__place"))).drop("__place")


def decide(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, buckets: int = 4096, by_length: bool = True) -> DataFrame:
    """Adds ``source_size``, ``target``, ``copies`` and ``taken`` to narrow rows with
    ``source``, ``size`` and ``__u``, the draw of the row."""
    sized = sized.withColumns({"__k": F.length(F.bin("size")), "__part": F.spark_partition_id()})
    sized = materialize(sized, "mix-sizes")
    targets = source_targets(sized.select("source", "size"), "source", weights, share, cap)
    plan = materialize(expected_copies(sized, targets, cap, by_length), "mix-plan")
    same_class = F.col("source").eqNullSafe(F.col("__s")) & (F.col("__k") == F.col("__class"))
    rows = _met(sized, plan.withColumnRenamed("__k", "__class"), same_class).drop("__class")
    pareto = (F.col("__u") / (1 - F.col("__u"))) / (F.col("__p") / (1 - F.col("__p")))
    rows = rows.withColumn("__q", F.when(F.col("__p") > 0, pareto)).withColumn("__slice", F.floor(F.col("__q") / (1 + F.col("__q")) * buckets))
    rows = materialize(rows.drop("__k", "__p"), "mix-ranks")
    sums = rows.filter("__slice is not null").groupBy("__s", "__slice", "__left").agg(F.sum("size").alias("__words"))
    running = F.sum("__words").over(Window.partitionBy("__s").orderBy("__slice")) - F.col("__words")
    reached = (F.col("__before") < F.col("__left")) & (F.col("__before") + F.col("__words") >= F.col("__left"))
    cut = sums.withColumn("__before", running).filter(reached).groupBy("__s").agg(F.min(F.struct("__slice", "__before")).alias("__cut"))
    # Every source has a row, so that none is lost in the join.
    cut = targets.select(F.col("source").alias("__t")).join(cut, F.col("__t").eqNullSafe(F.col("__s")), "left").select("__t", "__cut")
    rows = _met(rows, materialize(cut, "mix-cuts"), F.col("__s").eqNullSafe(F.col("__t"))).drop("__t")
    at = F.col("__cut")["__slice"]
    inside = F.col("__slice").isNotNull() & F.col("__slice").eqNullSafe(at)
    # Rows outside the boundary slices are decided on sight; those inside are counted by
    # rank, size and file and then ranked among their equals of one file.
    equal = ["__s", "__slice", "__q", "size", "__part"]
    edge = rows.filter(inside)
    groups = edge.groupBy(*equal).agg(F.sum("size").alias("__words"))
    order = Window.partitionBy("__s", "__slice").orderBy("__q", "size", "__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = groups.withColumn("__ahead", F.sum("__words").over(order) - F.col("__words")).drop("__words")
    groups = groups.select("__ahead", *(F.col(c).alias(f"__g{c}") for c in equal))
    same = F.col("__s").eqNullSafe(F.col("__g__s"))
    for c in equal[1:]:
        same &= F.col(c) == F.col(f"__g{c}")
    edge = edge.withColumn("__rank", F.row_number().over(Window.partitionBy(*equal).orderBy("__u"))).join(groups, same)
    middle = F.col("__cut")["__before"] + F.col("__ahead") + (F.col("__rank") - 0.5) * F.col("size")
    edge = edge.withColumn("__more", (middle <= F.col("__left")).cast("long")).drop("__rank", "__ahead", *(f"__g{c}" for c in equal))
    outer = rows.filter(~inside).withColumn("__more", F.coalesce(F.col("__slice") < at, F.lit(False)).cast("long"))
    out = outer.unionByName(edge).withColumn("copies", F.col("__whole").cast("long") + F.col("__more"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop("__u", "__part", "__s", "__whole", "__left", "__q", "__slice", "__cut", "__more")


_DECIDED = ("size", "source_size", "target", "copies", "taken")


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 13,
    buckets: int = 4096,
    by_length: bool = True,
) -> DataFrame:
    """How often the mix takes each row of ``df``.

    Adds ``size``, ``source_size``, ``target`` (of the row's source), ``copies``
    and ``taken`` (``copies * size``) to the columns of ``df``; a column of such a
    name there is replaced.  ``by_length=False`` gives all documents of a source the
    same chance.

    A null text has size 0, a null source is a source of its own that comes last, a
    null id is an id.  A row without words counts as one of a word and adds nothing.  A
    repeated row draws the same number as its twin and ranks beside it; ties end in
    the order of size.  The document at the boundary is taken if that brings the
    source nearer to its target.  An empty table gives an empty result.

    Decisions are made on narrow rows; whole rows are dealt once, by their place.
    """
    return _mixed(df, id_col, text_col, source_col, weights, share, cap, seed, buckets, by_length).select(
        *(F.col(f"row.`{c}`").alias(c) for c in df.columns if c not in _DECIDED), *_DECIDED
    )


def _mixed(df, id_col, text_col, source_col, weights=WEIGHTS, share=1.5, cap=2.0, seed=13, buckets=4096, by_length=True) -> DataFrame:
    """``row``, the whole row, and what was decided."""
    rows = placed(df)
    light = rows.withColumns({"source": F.col(f"row.`{source_col}`"), "__id": F.col(f"row.`{id_col}`"), "__text": F.col(f"row.`{text_col}`")})
    light = light.select("file", "place", "source", word_count("__text").alias("size"), draw("__id", seed).alias("__u"))
    decided = decide(light, weights, share, cap, buckets, by_length).drop("source")
    return rows.join(decided.hint("shuffle_hash"), ["file", "place"])


def take_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``df`` as the mix takes them: each as often as its copies, with the
    columns of ``df``.  Nulls, repeats, ties, empty texts and an empty table are as in
    :func:`mix_sources`; columns of any name are passed on."""
    mixed = _mixed(df, id_col, text_col, source_col, **options).filter("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def mix_query(df: DataFrame, seed: int = 13) -> DataFrame:
    """What the mix takes of each document; the texts are read once, for their sizes.
    Odd rows are as in :func:`mix_sources`."""
    sized = df.select("doc_id", "source", word_count("text").alias("size"), draw("doc_id", seed).alias("__u"))
    return decide(sized).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    (('0x' || substr(md5('13:' || CAST(doc_id AS VARCHAR)), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents
), sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS full_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
    1.5::DOUBLE * sum(source_size) OVER () AS budget FROM sources
), levels AS (
  SELECT *, full_size / w AS fills,
    (budget - coalesce(sum(full_size) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY full_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), cut AS (SELECT max(level) AS level FROM levels WHERE level <= fills AND fills = (SELECT min(fills) FROM levels WHERE level <= fills)),
targets AS (
  SELECT source, source_size, CASE WHEN cut.level IS NULL THEN full_size ELSE least(full_size, cut.level * w) END AS target
  FROM levels CROSS JOIN cut
), classes AS (
  SELECT d.source, t.source_size, t.target, length(bin(d.size)) AS k, sqrt((1::BIGINT << length(bin(d.size))::BIGINT)::DOUBLE) AS x, CAST(sum(d.size) AS BIGINT) AS words
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source GROUP BY ALL
), leveled AS (
  SELECT *, (target - 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY source ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(x * words) OVER (PARTITION BY source ORDER BY k DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level
  FROM classes
), chosen AS (SELECT source, arg_max(level, k) AS at FROM leveled WHERE level * x <= 2 GROUP BY source),
copied AS (
  SELECT l.*, CASE WHEN l.source_size = 0 THEN 0.0::DOUBLE WHEN c.at IS NULL THEN 2.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(2.0::DOUBLE, c.at * l.x)) END AS expected
  FROM leveled l LEFT JOIN chosen c ON l.source IS NOT DISTINCT FROM c.source
), plan AS (
  SELECT *, floor(expected + 1e-12::DOUBLE) AS whole, greatest(0.0::DOUBLE, expected - floor(expected + 1e-12::DOUBLE)) AS p,
    target - sum(floor(expected + 1e-12::DOUBLE) * words) OVER (PARTITION BY source) AS rest
  FROM copied
), drawn AS (
  SELECT d.*, m.source_size, m.target, m.whole, m.rest, CASE WHEN m.p > 0 THEN (d.u / (1 - d.u)) / (m.p / (1 - m.p)) END AS q
  FROM sized d JOIN plan m ON d.source IS NOT DISTINCT FROM m.source AND length(bin(d.size)) = m.k
), ranked AS (
  SELECT *, CASE WHEN q IS NULL THEN NULL ELSE sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, size ROWS UNBOUNDED PRECEDING) END AS after FROM drawn
)
SELECT doc_id, size, source_size, target, source,
  CAST(whole AS BIGINT) + CASE WHEN rest > 0 AND after - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END AS copies,
  (CAST(whole AS BIGINT) + CASE WHEN rest > 0 AND after - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) * size AS taken
FROM ranked
"""
