"""Where working files go: the shared folder of spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and its name there; URLs of http and https are read by ranges."""
    if path.startswith(("http://", "https://")):
        from cellmosaic.sources.http import HttpStore

        return HttpStore(), path
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"file://{path}")
