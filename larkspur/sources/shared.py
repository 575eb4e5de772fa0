"""The folder that driver and executors share, and what lies there while a session runs."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from larkspur.sources.store import Store

_built: dict[tuple, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only in local mode a temporary folder may stand in for it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if given is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="larkspur-"))
    return sc.getCheckpointDir()


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """The files under path go when the driver's JVM ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def session_store(spark: SparkSession, buckets: int = 16) -> Store:
    """A store of its own in the shared folder, until the driver ends."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    forget_at_exit(spark, path)
    return Store(spark, path, buckets)


def _files(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files at path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in [fs.getFileStatus(p), *fs.listStatus(p)]))


def built_once(spark: SparkSession, kind: str, path: str, build: Callable[[Store], object]) -> object:
    """What build makes of the table at path in a store of its own: made once in a session, as long as the table's files are the same."""
    key = (spark.sparkContext.applicationId, kind, path, _files(spark, path))
    if key not in _built:
        _built[key] = build(session_store(spark))
    return _built[key]
