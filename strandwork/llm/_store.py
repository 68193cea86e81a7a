"""Cutting lineage with Parquet tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LEFT: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="strandwork-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder; it is deleted when the session's process ends, or by release()."""
    path = f"{shared_root(spark)}/strandwork-{what}-{uuid.uuid4().hex}"
    _LEFT.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def release(path: str) -> None:
    for entry in [x for x in _LEFT if x[1] == path]:
        _LEFT.remove(entry)
        _delete(*entry)


@atexit.register
def _release_all() -> None:
    for _, path in list(_LEFT):
        release(path)


def cut(df: DataFrame, what: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: later stages restart from the files if an executor is lost."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandwork_path = path
    return out


def cuts() -> int:
    """A mark for drop_since()."""
    return len(_LEFT)


def drop_since(mark: int, *keep: DataFrame) -> None:
    """Deletes the tables cut since the mark, but for those to keep; only when no later plan reads them."""
    kept = {getattr(df, "_strandwork_path", None) for df in keep}
    for _, path in [x for x in _LEFT[mark:] if x[1] not in kept]:
        release(path)


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of cut(); only for tables that no later plan reads."""
    if path := getattr(df, "_strandwork_path", None):
        release(path)


def slices(df: DataFrame, text: str, each: int, least: int = 8) -> int:
    """How many groups of about `each` bytes of text the table makes."""
    total = df.agg(F.sum(F.octet_length(F.col(text))).alias("b")).first()["b"] or 0
    return max(least, -(-int(total) // each))


GROUPS = 8


def spread(df: DataFrame, key: str, groups: int) -> DataFrame:
    """df dealt by key to a task per GROUPS groups, where the session's shuffle partitions would hold more of them each."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if groups <= GROUPS * usual else df.repartition(-(-groups // GROUPS), key)


HOT = 4096


def join_hot(rows: DataFrame, one: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) to `one`, which has one row per key and in n how many of the `total` rows have it.

    Keys of more than HOT rows and of more than a thousandth of all, a thousand at most, are broadcast, so the rows of
    a hot key stay spread; the others meet by shuffle.
    """
    if total <= HOT:
        return rows.join(one, on, how)
    limit = max(HOT, total // 1000)
    hot = F.broadcast(one.where(F.col(n) > limit))
    rest = rows.join(hot.select(*on), on, "left_anti").join(one.where(F.col(n) <= limit), on, how)
    return rows.join(hot, on).unionByName(rest)
