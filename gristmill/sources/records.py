"""JSON-lines records: reading with a schema guard, routed writing, manifests, failures."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions.keys import ascii_json
from gristmill.functions.text import first_truthy
from gristmill.operators.mixture import critique

SCHEMA_VERSION = "sft-train-data-v1"
#: Columns of a failure in their order.
FAILURE = "sample_id dataset question gold prediction answer_type supervision image_ref chart_type task_type error_type metadata".split()
_FAILURE_SCHEMA = ", ".join(f"{c} string" for c in FAILURE[:-1]) + ", metadata map<string,string>"


def record_paths(root: str, dataset: str, split: str) -> dict[str, str]:
    """Where the three kinds of records, the manifest and the images of a run are."""
    return {
        "gold": f"{root}/{dataset}_{split}.jsonl",
        "contrastive": f"{root}/{dataset}_contrastive_{split}.jsonl",
        "skipped": f"{root}/{dataset}_skipped_{split}.jsonl",
        "manifest": f"{root}/{dataset}_{split}_manifest.json",
        "images": f"{root}/images",
    }


def json_line(df: DataFrame) -> Column:
    """Each row as JSON with its keys in order and nulls written out."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"})


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.select(json_line(df).alias("value")).write.mode("append" if append else "overwrite").text(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file or folder; blank lines are dropped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def guarded(df: DataFrame, version: str = "schema_version", key: str = "record_key") -> DataFrame:
    """The same rows; reading any column of them fails if one has another schema version."""
    message = F.concat(F.lit("Unsupported schema of record "), F.coalesce(F.col(key), F.lit("<missing>")))
    return df.filter(F.when(F.col(version).eqNullSafe(SCHEMA_VERSION), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def load_gold(spark: SparkSession, root: str, datasets, split: str, schema: str) -> DataFrame:
    """Gold records of datasets in their fixed order, with ``dataset`` and ``dataset_order``."""
    return _load(spark, root, datasets, split, schema, "gold")


def load_contrastive(spark: SparkSession, root: str, datasets, split: str, schema: str) -> DataFrame:
    """Counterexamples of datasets in their fixed order, as critiques."""
    return critique(_load(spark, root, datasets, split, schema, "contrastive"))


def _load(spark, root, datasets, split, schema, kind) -> DataFrame:
    parts = [guarded(read_jsonl(spark, record_paths(root, name, split)[kind], schema)).withColumns({"dataset": F.lit(name), "dataset_order": F.lit(i)}) for i, name in enumerate(datasets)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def bad_keys(df: DataFrame, version: str = "schema_version", key: str = "record_key", n: int = 3) -> list[str]:
    """The first keys with another schema version."""
    wrong = df.filter(~F.col(version).eqNullSafe(SCHEMA_VERSION)).select(F.coalesce(key, F.lit("<missing>")).alias("k")).orderBy("k").limit(n)
    return [r.k for r in wrong.collect()]


def write_routed(results: DataFrame, paths: dict[str, str], route: str = "route", append: bool = False) -> None:
    """Gold, contrastive and skipped rows to their own files."""
    for kind in ("gold", "contrastive", "skipped"):
        write_jsonl(results.filter(F.col(route) == kind).drop(route), paths[kind], append)


def manifest(dataset: str, split: str, command: dict, stats: dict, paths: dict[str, str], root: str) -> dict:
    relative = {k: v.removeprefix(f"{root}/") for k, v in paths.items() if k != "manifest"}
    return {"schema_version": SCHEMA_VERSION, "dataset": dataset, "split": split, "command": command, "stats": stats, "paths": relative}


def load_images(replayed: DataFrame, root: str, files: DataFrame) -> DataFrame:
    """Adds ``content`` to replayed failures: the bytes of the file ``root/image``, null
    where there is none, so that the reference stays.  ``files`` has ``path`` and ``content``."""
    plain = F.regexp_replace(F.col("path"), "^file:/+", "/")
    found = files.select(plain.alias("__path"), "content")
    at = F.regexp_replace(F.concat(F.lit(f"{root}/"), F.col("image")), "^file:/+", "/")
    return replayed.withColumn("__path", at).join(found, "__path", "left").drop("__path")


def bench_line(df: DataFrame) -> Column:
    """Each row as a line of a bench file: sorted keys, ``, `` and ``: `` between them, ASCII only."""
    name = lambda c: F.lit(json.dumps(c) + ": ")
    value = lambda c: F.coalesce(F.regexp_replace(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", "$1"), F.lit("null"))
    return ascii_json(F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(name(c), value(F.col(c))) for c in sorted(df.columns))), F.lit("}")))


def write_text(spark: SparkSession, path: str, text: str | bytes) -> None:
    """One small file through the file system that the path names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(text.encode() if isinstance(text, str) else text))
    out.close()


def write_manifest(spark: SparkSession, path: str, payload: dict) -> None:
    write_text(spark, path, json.dumps(payload, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def backfill(df: DataFrame, key: Column, column: str = "record_key") -> DataFrame:
    """Rows with the missing keys filled in."""
    return df.withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), key))


def failures(samples: DataFrame, error_type: Column | None = None) -> DataFrame:
    """Failure records of core rows with ``prediction`` and ``metadata`` (a map)."""
    m = lambda k: F.element_at("metadata", k)
    return samples.select(
        F.col("id").alias("sample_id"),
        "dataset",
        "question",
        F.col("answer").alias("gold"),
        "prediction",
        "answer_type",
        "supervision",
        first_truthy(m("image_ref"), m("image_archive"), F.col("image").cast("string")).alias("image_ref"),
        "chart_type",
        "task_type",
        (F.lit(None).cast("string") if error_type is None else error_type).alias("error_type"),
        merged(F.col("metadata"), F.map_from_arrays(F.array(F.lit("tag")), F.array("tag"))).alias("metadata"),
    )


def merged(first: Column, second: Column) -> Column:
    """Two maps in one; a key of both has the value of the second."""
    kept = F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k))
    return F.map_concat(kept, second)


def replay(failed: DataFrame) -> DataFrame:
    """Core rows of failures; the metadata tells prediction, error type and image."""
    added = F.map_from_arrays(F.array(*map(F.lit, ("prediction", "error_type", "image_ref"))), F.array("prediction", "error_type", "image_ref"))
    return failed.select(
        F.col("sample_id").alias("id"),
        "dataset",
        F.col("image_ref").alias("image"),
        "question",
        F.col("gold").alias("answer"),
        "answer_type",
        "supervision",
        "chart_type",
        "task_type",
        F.coalesce(F.element_at("metadata", "tag"), F.lit("synthetic")).alias("tag"),
        merged(F.col("metadata"), added).alias("metadata"),
    )


def write_failures(failed: DataFrame, root: str, name: str, now: dt.datetime | None = None) -> str:
    """A new folder ``root/failures/name_time`` with the records and a manifest; an
    error if it is there."""
    spark = failed.sparkSession
    stamp = (now or dt.datetime.now(dt.UTC)).strftime("%Y%m%dT%H%M%SZ")
    folder = f"{root}/failures/{name}_{stamp}"
    failed.select(json_line(failed).alias("value")).write.mode("errorifexists").text(f"{folder}/failures.jsonl")
    count = spark.read.text(f"{folder}/failures.jsonl").count()
    write_manifest(spark, f"{folder}/manifest.json", {"schema_version": 1, "name": name, "batch_name": f"{name}_{stamp}", "created_at": stamp, "count": count})
    return folder


def read_failures(spark: SparkSession, folder: str) -> DataFrame:
    return read_jsonl(spark, f"{folder}/failures.jsonl", _FAILURE_SCHEMA)


def read_labelled(spark: SparkSession, inputs: list[str], schema: str) -> DataFrame:
    """Records of ``label:path`` arguments, with ``label``; one dataset to a file."""
    out = None
    for value in inputs:
        label, _, path = value.partition(":")
        if not label.strip() or not path:
            raise ValueError(f"expected label:path, got {value!r}")
        part = read_jsonl(spark, path, schema).withColumn("label", F.lit(label.strip()))
        seen = part.agg(F.count_distinct("dataset").alias("d"), F.count("*").alias("n")).first()
        if seen.n == 0 or seen.d != 1:
            raise ValueError(f"{path} must have records of exactly one dataset")
        out = part if out is None else out.unionByName(part)
    return out
