"""Image payloads: lookup, archive members and a content-addressed store."""

from __future__ import annotations

import io
import tarfile
import zipfile
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions.text import first_truthy


def extracted_candidates(root: str, dataset: str = "dataset", ref: str = "image_ref"):
    """Where an extracted image may be, the likeliest first."""
    bare = F.regexp_replace(F.col(ref), r"^\./", "")
    name = F.substring_index(F.col(ref), "/", -1)
    under = lambda *parts: F.concat_ws("/", F.lit(root), *parts)
    return F.array(F.col(ref), under(F.col(dataset), bare), under(bare), under(F.col(dataset), name), under(name))


def member_candidates(ref: str = "image_ref"):
    """Names an archive member may have: the reference, without its first folder, and alone."""
    bare = F.regexp_replace(F.col(ref), r"^\./", "")
    rest = F.when(bare.contains("/"), F.substring(bare, F.instr(bare, "/") + 1, 1 << 20)).otherwise("")
    return F.array_distinct(F.filter(F.array(bare, rest, F.substring_index(bare, "/", -1)), lambda x: x != ""))


def find_extracted(samples: DataFrame, listing: DataFrame, root: str, key: str = "id") -> DataFrame:
    """Adds ``found_path``: the first candidate that the listing (column ``path``) has."""
    tried = samples.select(key, F.posexplode(extracted_candidates(root)).alias("rank", "path"))
    found = tried.join(listing.select("path").distinct(), "path").groupBy(key).agg(F.min_by("path", "rank").alias("found_path"))
    return samples.join(found, key, "left")


def find_members(samples: DataFrame, members: DataFrame, key: str = "id") -> DataFrame:
    """Adds ``member``: the first candidate among an archive's names, else the only name
    that ends in one.  ``samples`` has ``archive`` and ``image_ref``; ``members`` has
    ``archive`` and ``member``."""
    tried = samples.select(key, "archive", F.posexplode(member_candidates()).alias("rank", "wanted"))
    exact = tried.join(members, (tried.archive == members.archive) & (tried.wanted == members.member)).groupBy(key).agg(F.min_by("member", "rank").alias("exact"))
    # Every candidate ends in the bare file name, so a name that ends in one ends in that;
    # names are met by their own ends, counted before they are joined.
    name = F.substring_index("image_ref", "/", -1)
    rest = samples.join(exact, key, "left_anti").select(key, "archive", name.alias("end"))
    last = F.substring_index("member", "/", -1)
    ends = members.select("archive", "member", F.explode(F.transform(F.sequence(F.lit(1), F.length(last)), lambda i: F.substr(last, i))).alias("end"))
    ends = ends.join(rest.select("archive", "end").distinct(), ["archive", "end"], "left_semi")
    single = ends.groupBy("archive", "end").agg(F.count("*").alias("n"), F.min("member").alias("near")).filter("n = 1").drop("n")
    near = rest.join(single, ["archive", "end"]).select(key, "near")
    return samples.join(exact, key, "left").join(near, key, "left").withColumn("member", F.coalesce("exact", "near")).drop("exact", "near")


def find_archives(samples: DataFrame, listing: DataFrame, root: str, key: str = "id") -> DataFrame:
    """Adds ``archive_path``: the archive as named, else below the folder of its dataset,
    if the listing (column ``path``) has it."""
    tried = samples.select(key, F.posexplode(F.array("archive", F.concat_ws("/", F.lit(root), "dataset", "archive"))).alias("rank", "path"))
    found = tried.join(listing.select("path").distinct(), "path").groupBy(key).agg(F.min_by("path", "rank").alias("archive_path"))
    return samples.join(found, key, "left")


def archive_kind(path: str) -> str:
    name = PurePosixPath(path)
    if name.suffix == ".zip":
        return "zip"
    if "".join(name.suffixes).endswith(".tar.gz") or name.suffix == ".tar":
        return "tar"
    raise ValueError(f"Unsupported image archive: {path}")


def _members(content: bytes, path: str):
    if archive_kind(path) == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield info.filename, z.read(info)
    else:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for info in t:
                if info.isfile():
                    yield info.name, t.extractfile(info).read()


def read_archives(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``archive``, ``member`` and ``content`` of every file in zip and tar archives,
    one row at a time, without extracting them."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")

    def unpack(batches):
        for frame in batches:
            for path, content in zip(frame.path, frame.content, strict=True):
                for name, data in _members(content, path):
                    yield pd.DataFrame({"archive": [path], "member": [name], "content": [data]})

    return files.mapInPandas(unpack, "archive string, member string, content binary")


def resolve(samples: DataFrame) -> DataFrame:
    """Adds ``image_path`` and ``image_error`` from ``found_path``, ``member``, ``archive``
    and the plain reference: extracted file, then archive member, then, for samples
    that name neither reference nor archive, the image as it is."""
    plain = F.col("image_ref").isNull() & F.col("archive").isNull()
    path = F.when(F.col("found_path").isNotNull(), F.col("found_path")).when(plain, F.col("image")).when(F.col("member").isNotNull(), F.concat_ws("!/", "archive", "member"))
    error = F.when(path.isNull(), F.concat(F.lit("Missing image: "), first_truthy("image_ref", "image")))
    return samples.withColumns({"image_path": path, "image_error": error})


def stored(payloads: DataFrame, content: str = "content", suffix: str | None = None) -> DataFrame:
    """Adds ``sha256`` and ``ref``, the name under which the content is stored."""
    end = F.lit(".png") if suffix is None else F.coalesce(F.nullif(F.lower(F.col(suffix)), F.lit("")), F.lit(".png"))
    digest = F.sha2(F.col(content), 256)
    return payloads.withColumn("sha256", digest).withColumn("ref", F.concat(F.lit("images/"), digest, end))


def first_of_each(rows: DataFrame, order: str, key: str = "sha256") -> DataFrame:
    """One row for each content, the first in order."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def write_store(rows: DataFrame, root: str) -> None:
    """Writes contents that aren't there yet under ``root``, by their ``ref``.  The root
    is a folder that all executors share.

    Each is written to a name of its own and renamed, so a task that runs twice
    leaves one whole file.  References must stay below the root."""
    import os

    def put(batches):
        base = os.path.realpath(root)
        for frame in batches:
            for ref, data in zip(frame.ref, frame.content, strict=True):
                target = os.path.realpath(os.path.join(base, ref))
                if not target.startswith(base + os.sep):
                    raise ValueError(f"{ref} isn't below the output root")
                if not os.path.exists(target):
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    part = f"{target}.{os.getpid()}.part"
                    with open(part, "wb") as f:
                        f.write(data)
                    os.replace(part, target)
            yield pd.DataFrame({"n": [len(frame)]})

    distinct = rows.select("ref", "content").dropDuplicates(["ref"])
    distinct.mapInPandas(put, "n long").agg(F.sum("n")).collect()
