"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; below a folder of our own only where that isn't set and Spark runs on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="laminaspark-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def local(path: str) -> str:
    """A path for Python's own file functions; other schemes than file: are refused."""
    if "://" in path or path.startswith("file:"):
        scheme, _, rest = path.partition(":")
        if scheme != "file":
            raise ValueError(f"{path}: containers are read and written through mounted paths; use scan_binary for other stores")
        return "/" + rest.lstrip("/")
    return path
