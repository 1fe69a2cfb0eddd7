"""Intermediate tables that several branches of a plan read."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that are still there, with the file system and path that delete them.
_folders: dict[str, tuple] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one only on a local master."""
    folder, known = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc().getCheckpointDir()
    if folder or known.isDefined():
        return folder or known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set, and a folder of this machine is not shared with the executors")
    folder = tempfile.mkdtemp(prefix="quillon-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back, so that branches do not compute it anew.

    Readers prune its columns and know its size. It is deleted by :func:`release`, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    _folders[path] = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables from :func:`settled` that nothing reads any more."""
    for t in tables:
        system, place = _folders.pop(getattr(t, "_settled_path", ""), (None, None))
        if system is not None:
            system.delete(place, True)


@atexit.register
def _release_rest() -> None:
    for system, place in _folders.values():
        with contextlib.suppress(Exception):  # the driver's Java may have ended before
            system.delete(place, True)
