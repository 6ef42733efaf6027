"""Tables in the folder that driver and executors share, and loops over them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_scopes: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="spark-gneiss-"))
    return f"file://{_local[0]}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage is cut, it outlives executors, and the planner knows its size."""
    path = f"{shared_folder(df.sparkSession)}/gneiss/{name}-{uuid.uuid4().hex}"
    for scope in _scopes:
        scope.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def tables_removed(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that :func:`written` made inside, so results that read them are to be saved before.

    ``with tables_removed(spark): kcore(edges).write.parquet(path)`` leaves ``path`` alone. Scopes may be nested; a table goes with the first that ends.
    """
    made: list[str] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes[:] = [x for x in _scopes if x is not made]
        jvm = spark.sparkContext._jvm
        for path in made:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def until_settled(df: DataFrame, step: Callable[[DataFrame], DataFrame], mark: Callable[[DataFrame], object]) -> DataFrame:
    """``step`` again and again until ``mark`` (a small aggregate) stays the same; each round is written."""
    now = written(df)
    seen = mark(now)
    while True:
        now = written(step(now))
        got = mark(now)
        if got == seen:
            return now
        seen = got
