"""Cutting lineage through files in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

#: Folders of the tables that were written and not dropped yet, in order.
_kept: list[str] = []


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="roadlake-")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine gets a folder of its own; on a cluster that is
    an error, since no executor could read another's local files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = _own_folder()
    return named.rstrip("/")


def new_folder(spark: SparkSession) -> str:
    """A folder that isn't there yet, in the shared one; the ``scope`` deletes it too."""
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    _kept.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """``df``, written once as Parquet to the shared folder and read back.

    Later stages restart from these files if executors are lost. The files stay until
    ``drop_written`` or the end of the ``scope`` in which they were written.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written_to = path
    return back


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_written(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` returned and that nothing reads any more."""
    for df in tables:
        own = getattr(df, "_written_to", None)
        folders = [own] if own else [name.rsplit("/", 1)[0] for name in df.inputFiles()[:1]]
        for folder in folders:
            if "/tables/" in folder:
                _delete(df.sparkSession, folder)
                _kept[:] = [k for k in _kept if k.rsplit("/", 1)[1] != folder.rsplit("/", 1)[1]]


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all tables that were written inside; results must be read or saved by then."""
    before = set(_kept)
    try:
        yield
    finally:
        for path in [k for k in _kept if k not in before]:
            _delete(spark, path)
            _kept.remove(path)
