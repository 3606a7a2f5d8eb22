"""Results by key that are only computed again for keys whose rows have changed since the last run."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.operators.merge import least_rows
from doclattice.operators.spread import told, written
from doclattice.sources.sinks import opened, uri, write_text

CURRENT = "_current"


def fingerprints(rows: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """(input, *keys, total, n): of the rows of each key their number and the sum of a hash of each, which doesn't depend on their order
    and tells repeated rows; combined before the shuffle. Rows may be nested, but hold no maps."""
    own = F.xxhash64(*sorted(c for c in rows.columns if c not in keys), F.lit(name)).cast("decimal(20,0)")
    return rows.groupBy(*keys).agg(F.sum(own).alias("total"), F.count("*").alias("n")).select(F.lit(name).alias("input"), *keys, "total", "n")


def last_version(spark: SparkSession, folder: str) -> str | None:
    store, at = opened(uri(folder))
    from pyarrow import fs

    if store.get_file_info(f"{at}/{CURRENT}").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{at}/{CURRENT}") as f:
        return f.read().decode()


def incremental(inputs: dict[str, DataFrame], keys: Sequence[str], folder: str, compute: Callable[..., DataFrame]) -> DataFrame:
    """The rows of ``compute(**inputs)``, which has the ``keys``, with ``again``: whether they were computed now. ``folder`` keeps the results and the
    fingerprints of the last run; without one all are computed.

    What ``compute`` gives for a key has to depend on the rows of the inputs with that key alone: these are the rows that it gets of
    keys that came, went or changed in any input. Null keys are keys. The new version is complete before its name is written, so
    a run that fails leaves the last one; earlier versions stay for their readers."""
    spark = next(iter(inputs.values())).sparkSession
    target, version = uri(folder), f"v-{uuid.uuid4().hex}"
    last = last_version(spark, target)
    prints = None
    for name, rows in inputs.items():
        one = fingerprints(rows, keys, name)
        prints = one if prints is None else prints.unionByName(one)
    prints.write.parquet(f"{target}/{version}/fingerprints")
    if last is None:
        out = compute(**inputs).withColumn("again", F.lit(True))
    else:
        new, old = (spark.read.parquet(f"{target}/{v}/fingerprints").select(F.struct("input", *keys).alias("k"), "total", "n") for v in (version, last))
        both = new.select("k", "total", "n").join(old.select("k", F.col("total").alias("t"), F.col("n").alias("m")), "k", "full")
        differ = both.where(~(F.col("total").eqNullSafe(F.col("t")) & F.col("n").eqNullSafe(F.col("m"))))
        changed = written(differ.groupBy(*(F.col(f"k.{c}").alias(c) for c in keys)).agg(F.sum(F.coalesce("n", F.lit(0))).alias("n")).withColumn("hit", F.lit(True)), "changed-keys")
        plain = lambda df: [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
        some = {name: told(df, changed, keys, plain(df)).where("found.hit").drop("found") for name, df in inputs.items()}
        kept = spark.read.parquet(f"{target}/{last}/results").drop("again")
        kept = told(kept, changed, keys, plain(kept)).where("found.hit is null").drop("found").withColumn("again", F.lit(False))
        out = compute(**some).withColumn("again", F.lit(True)).unionByName(kept)
    out.write.parquet(f"{target}/{version}/results")
    write_text(version, target, CURRENT)
    return spark.read.parquet(f"{target}/{version}/results")


def delta_merge(rows: DataFrame, folder: str, key: str = "id", order: Sequence[str] = ("prio", "ord")) -> DataFrame:
    """The first row of each key, as ``least_rows`` gives them, with ``again``: only keys whose rows have changed since the run before are
    ranked again."""
    return incremental({"rows": rows}, [key], folder, lambda rows: least_rows(rows, [key], list(order)))
