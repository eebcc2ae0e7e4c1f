"""Where a load may cut lineage: the shared folder the session names, and nowhere else."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session.

    ``spark.checkpoint.dir`` wins, then a folder set on the context. Only a local-mode
    session without either gets a temporary one; a cluster without a setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if context.master.startswith("local-cluster") or not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="driftwarden-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


_MADE: list[str] = []


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    path = f"{shared_folder(spark).rstrip('/')}/driftwarden/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def folders_made() -> int:
    """How many folders this process has asked for: where a job begins, for ``remove_folders``."""
    return len(_MADE)


def remove_folders(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> int:
    """Delete the folders asked for since then, but for those to keep: once a job's result is written, its steps are not needed.

    Frames that read from them cannot be computed any more. Returns how many there were.
    """
    gone = [path for path in _MADE[since:] if path not in keep]
    for path in gone:
        remove_matching(spark, path)
    _MADE[since:] = [path for path in _MADE[since:] if path in keep]
    return len(gone)


def cut(frame: DataFrame) -> DataFrame:
    """Materialise a frame in the shared folder so that lost executors do not recompute it."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def remove_matching(spark: SparkSession, pattern: str) -> None:
    """Delete the files and folders that a glob pattern of a path names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in files.globStatus(path) or ():
        files.delete(found.getPath(), True)


def partition_value(spark: SparkSession, value: str) -> str:
    """A partition value as it is spelled in a folder's name, for a glob pattern."""
    spelled = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
    return "".join(f"\\{c}" if c in "\\*?[]{}^" else c for c in spelled)


@contextmanager
def configured(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A number the session leaves at 0 is set for one action; one that it has chosen stays."""
    before = spark.conf.get(name, None)
    if before not in (None, "0"):
        yield
        return
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
