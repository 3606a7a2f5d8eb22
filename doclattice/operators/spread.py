"""Tables between steps, and joins in which the rows of hot keys are spread over all tasks."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it has more rows than this, and more than a thousandth of all: fewer than a thousand keys can be.
LEAST_HOT, MOST_HOT = 10_000, 1000
#: What hot keys bring along is sent to all executors only up to so many bytes, which are counted.
SENT_BYTES = 32 << 20

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Without it a temporary one serves local masters; on others that is an error, as each
    executor would write to its own disk."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="doclattice-")
        atexit.register(shutil.rmtree, _LOCAL[app][7:], ignore_errors=True)
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-merge/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what follows reads it, whatever executors are lost. ``cleanup`` deletes all of them."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleanup(spark: SparkSession) -> None:
    """Deletes the tables that this application's merges have written, for when their results are written elsewhere."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-merge")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def hot_keys(counts: DataFrame, n: str = "n") -> tuple[DataFrame | None, int]:
    """The rows of ``counts`` (a row a key, with its number of rows in ``n``) of hot keys, and the number of all rows. None if there are no
    hot ones, or if they are too large to be sent, which only keys of many kilobytes are."""
    total, most = counts.agg(F.sum(n), F.max(n)).first()
    if (most or 0) <= max(LEAST_HOT, (total or 0) / MOST_HOT):
        return None, total or 0
    hot = counts.where(F.col(n) > max(LEAST_HOT, total / MOST_HOT))
    size = hot.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
    return (hot if size <= SENT_BYTES else None), total


def told(rows: DataFrame, table: DataFrame, keys: Sequence[str], spread: Sequence[Column | str], n: str = "n") -> DataFrame:
    """``rows`` with ``found``: the struct of the other columns of ``table`` for their ``keys``, null ones being equal; null without any.

    ``table`` has a row for each key of ``rows``, with their number in ``n``; it is read several times, so it is a written one. Hot keys' rows of
    it are sent to wherever rows are; the rows themselves go through the shuffle of the others by a hash of ``spread``, so
    that no task gets a hot key's rows. What differs among these isn't changed by it: a lost task's rows are dealt alike again."""
    rest = [c for c in table.columns if c not in keys]
    side = table.select(F.struct(*keys).alias("__k"), F.struct(*rest).alias("found"), F.col(n).alias("__n"))
    rows = rows.withColumn("__k", F.struct(*keys))
    hot, _ = hot_keys(side, "__n")
    if hot is None:
        return rows.join(side.drop("__n"), "__k", "left").drop("__k")
    rows = rows.join(F.broadcast(hot.select("__k", F.col("found").alias("__hot"))), "__k", "left")
    rows = rows.withColumn("__s", F.when(F.col("__hot").isNotNull(), F.xxhash64(*spread)).otherwise(F.lit(0).cast("long")))
    # hot keys have no row on this side, so that no hash meets one by chance; its 0 is computed, since a literal would be no key to deal by
    cold = side.join(F.broadcast(hot.select("__k")), "__k", "left_anti").select("__k", F.least(F.lit(0).cast("long"), "__n").alias("__s"), F.col("found").alias("__cold"))
    return rows.join(cold, ["__k", "__s"], "left").withColumn("found", F.coalesce("__hot", "__cold")).drop("__k", "__s", "__hot", "__cold")
