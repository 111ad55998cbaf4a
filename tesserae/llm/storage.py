"""Where jobs put tables that several later steps read.

Lineage is cut by writing Parquet to the folder in ``spark.checkpoint.dir``, which every
executor and the driver share, so a lost executor costs a re-read and no recomputation.

Who deletes them.  A table kept within `scratch` goes when that ends, or before by `drop`,
once its last reader is done.  A *lasting* table is an operator's result and has to outlive
the call: it goes with the `owned` block around the call, or by `discard`, which a caller
runs when it has read what it wants.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Shuffle files of a finished query go at once: every table that is read again has been written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_open = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a local one only in local mode, where it names none."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not there:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        there = got.get() if got.isDefined() else ""
    if not there:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = f"{tempfile.gettempdir()}/tesserae-checkpoints"
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _lists(name: str) -> list[list[str]]:
    if not hasattr(_open, name):
        setattr(_open, name, [[]] if name == "lasting" else [])
    return getattr(_open, name)


def new_path(spark: SparkSession, name: str, *, lasting: bool = False) -> str:
    """A new folder's name, which goes with the innermost block that owns it."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    owners = _lists("lasting") if lasting or not _lists("paths") else _lists("paths")
    owners[-1].append(path)
    return path


def kept(df: DataFrame, name: str, *, lasting: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name, lasting=lasting)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._kept = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a kept table whose last reader is done."""
    delete(df.sparkSession, df._kept)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables kept in here go when it ends; nothing that is returned may still read them."""
    _lists("paths").append([])
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
        for path in _lists("paths").pop():
            delete(spark, path)


@contextmanager
def owned(spark: SparkSession) -> Iterator[None]:
    """Lasting tables made in here go when it ends: write what is wanted of them before."""
    _lists("lasting").append([])
    try:
        yield
    finally:
        for path in _lists("lasting").pop():
            delete(spark, path)


def discard(spark: SparkSession) -> None:
    """Delete all lasting tables of this thread outside of `owned` blocks."""
    for path in _lists("lasting")[0]:
        delete(spark, path)
    _lists("lasting")[0].clear()
