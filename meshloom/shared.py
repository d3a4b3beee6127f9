"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
#: Folders that each open scratch() has written.
_SCOPES: list[list[str]] = []
#: Bytes, as Spark estimates them, of a side of a join that it broadcasts unasked while a loop or a write runs.
MOST_BROADCAST = 256 << 10
_THRESHOLD, _ADAPTIVE = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="meshloom-")
    return _FALLBACK[app]


@contextmanager
def few_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark of its own accord broadcasts no side of a join above MOST_BROADCAST; F.broadcast is as ever.

    By default it does so up to 10 MB of a file, which as rows are several times as much. Each broadcast goes through the driver and is
    held there until it is collected, and a loop has hundreds of joins.
    """
    before = {_THRESHOLD: spark.conf.get(_THRESHOLD)}
    if adaptive := spark.conf.get(_ADAPTIVE, None):  # unset, it is the other one
        before[_ADAPTIVE] = adaptive
    bytes_of = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    lowered = {c: v for c, v in before.items() if not v.startswith("-") and bytes_of(v) > MOST_BROADCAST}  # below 0: none at all
    for c in lowered:
        spark.conf.set(c, MOST_BROADCAST)
    try:
        yield
    finally:
        for c, v in lowered.items():
            spark.conf.set(c, v)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = own_path(spark)
    with few_broadcasts(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.meshloom_path = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables that written() has made inside, but for those handed to the function that it gives.

    A table that is handed on belongs to the scratch around this one. What a lazy result still reads must be handed on.
    """
    mine: list[str] = []
    kept: list[str] = []
    _SCOPES.append(mine)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.meshloom_path)
        return df

    try:
        with few_broadcasts(spark):
            yield keep
    finally:
        _SCOPES.pop()
        for path in mine:
            if path not in kept:
                _delete(spark, path)
            elif _SCOPES:
                _SCOPES[-1].append(path)


def tidied(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, whose result is written, and whose own tables are deleted then. Its first argument is a DataFrame."""

    @wraps(f)
    def run(df: DataFrame, *args, **more) -> DataFrame:  # noqa: ANN002, ANN003
        with scratch(df.sparkSession) as keep:
            return keep(written(f(df, *args, **more)))

    return run


def drop(df: DataFrame) -> None:
    """Deletes the table of written() that df is; of no use to other frames."""
    if path := getattr(df, "meshloom_path", None):
        _delete(df.sparkSession, path)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/meshloom/{spark.sparkContext.applicationId}"


def own_path(spark: SparkSession) -> str:
    """A new path in this application's folder, which belongs to the innermost scratch()."""
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Deletes the tables that this application has written; results that are still to be read from them are lost."""
    _delete(spark, _own_folder(spark))
