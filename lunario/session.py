"""Places and settings that operators take from the Spark session."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Where the session names none, a temporary folder is taken if all runs on one machine in one process; elsewhere
    each executor would write to a disk of its own, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named
    if not sc.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lunario-"))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def stable_path(spark: SparkSession, label: str, *of: object) -> str:
    """The same path below the shared folder for the same label and things."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{hashlib.sha256(repr(of).encode()).hexdigest()[:16]}"
