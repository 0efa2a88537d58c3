"""Folders for what a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, tag: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which all executors share; where
    that isn't set, which is an error on a cluster, below a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="gristmill-")
        spark.conf.set("spark.checkpoint.dir", path)
    return f"{path.rstrip('/')}/gristmill/{tag}-{uuid.uuid4().hex}"
