"""Intermediate tables in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from grainmill.graph import Graph

_PATHS: dict[str, SparkSession] = {}


def stored(df: DataFrame) -> DataFrame:
    """``df`` written under ``spark.checkpoint.dir`` and read back, which ends its lineage; files go with the driver."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith(("local[", "local,")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        folder = "file://" + tempfile.mkdtemp(prefix="grainmill-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/grainmill/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _PATHS[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def stored_edges(graph: Graph) -> Graph:
    """The graph with its edges written down, for operators that go through them again and again."""
    return graph.with_edges(stored(graph.edges))


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended before the interpreter
        pass


def discard(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote for ``df``, which can't be read any more."""
    path = getattr(df, "_stored_path", None)
    if path and _PATHS.pop(path, None):
        _delete(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for path, spark in _PATHS.items():
        _delete(spark, path)
