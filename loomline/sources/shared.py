"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
#: Paths handed out by ``shared_dir`` and not removed since, of each thread: runs side by side keep their own.
_RUN = threading.local()


def _made() -> list[str]:
    if not hasattr(_RUN, "paths"):
        _RUN.paths = []
    return _RUN.paths


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A new path under ``spark.checkpoint.dir``.

    Where that setting is absent a temporary folder stands in for it in local mode (tests on one machine); on a
    cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        base = _OWN.get(app) or _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="loomline-"))
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"
    _made().append(path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: later plans start from the files."""
    spark = df.sparkSession
    path = shared_dir(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed(df: DataFrame, name: str = "row_key") -> DataFrame:
    """``df`` with a column that names each row, the same in every job that reads it.

    Rows of a file scan are named by file and position; any other frame is written to the shared folder first.
    """
    try:
        return df.withColumn(name, F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), "_metadata.row_index"))
    except AnalysisException:
        return keyed(written(df, "keyed"), name)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of ``shared_dir`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made():
        _made().remove(path)


def settled(df: DataFrame, tag: str, since: int = 0) -> DataFrame:
    """``written``, and afterwards every path handed out from number ``since`` (of ``made``) on but this one is removed.

    For a step whose result is whole in ``df``: what it wrote on the way is read no more.
    """
    spark = df.sparkSession
    out = written(df, tag)
    for path in _made()[since:-1]:
        remove(spark, path)
    return out


def made() -> int:
    """How many paths ``shared_dir`` has handed out that are not removed."""
    return len(_made())
