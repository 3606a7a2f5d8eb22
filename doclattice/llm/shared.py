"""What the operators share: the shared folder, written tables, grouped Arrow passes, guarded broadcasts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is sent to every executor only when its rows were counted and stay below this many bytes.
BROADCAST_BYTES = 64 << 20
#: Rows travel to and from Python in batches of about this many bytes, so that a worker's memory doesn't depend on the texts' lengths.
ARROW_BYTES = 4 << 20
ROW_GROUP_BYTES = 32 << 20
#: A table of few files below this many bytes is dealt to all cores, a task for each ``TASK_BYTES``, before Python passes read it.
SMALL_BYTES = 64 << 20
TASK_BYTES = 1 << 20


_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where none is set, a temporary one of this process, on a
    local master only: on a cluster each executor would write to its own disk, so there it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="doclattice-")
        atexit.register(shutil.rmtree, _LOCAL[app][7:], ignore_errors=True)
    return _LOCAL[app]


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder in whatever store Spark reaches it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cleanup(spark: SparkSession) -> None:
    """Deletes all tables that operators of this application have written to the shared folder. DataFrames that operators returned
    read them, so call it when their results are written elsewhere."""
    delete_path(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


_SCRATCH: list[list[str]] = []


def table_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes the tables that operators write inside the block when it is left, also by an error: for results that are written
    elsewhere within it. A path that is taken out of the yielded list stays."""
    _SCRATCH.append([])
    try:
        yield _SCRATCH[-1]
    finally:
        for path in _SCRATCH.pop():
            delete_path(spark, path)


def small_batches(spark: SparkSession) -> SparkSession:
    """``spark`` with batches bounded by ``ARROW_BYTES``, unless it names a bound itself. It is a default that stays set, the only
    setting that operators touch: Spark reads it when a plan that an operator returned is run, which is the caller's moment."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, ARROW_BYTES)
    return spark


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, so a lost executor costs no recomputation beyond it."""
    spark = small_batches(df.sparkSession)
    path = table_path(spark, name)
    # writers hold a row group and readers a batch within one, so small ones bound the memory for rows of long values
    df.write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size.row.check.min", 10).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def places(df: DataFrame, names: Sequence[str]) -> list[int]:
    """Where the named columns are: by exact name, else in any case."""
    low = [c.lower() for c in df.columns]
    return [df.columns.index(n) if n in df.columns else low.index(n.lower()) for n in names]


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns that an operator reads, taken by their places, so that further ones of any name (in another case, too)
    can't clash."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{i}").alias(n) for i, n in zip(places(df, names), names, strict=True)))


def beside(df: DataFrame, names: Sequence[str], make: Callable[..., tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """``df`` with further columns. ``make`` takes a frame of the same rows, and the columns ``names`` there; it returns a frame with at
    least its columns and the new columns by name. Columns of ``df`` that have a new one's name, in any case, are left out."""
    own = [f"__own{i}" for i in range(len(df.columns))]
    plain = df.toDF(*own)
    got, new = make(plain, *(F.col(own[i]) for i in places(df, names)))
    taken = {n.lower() for n in new}
    kept = [(o, c) for o, c in zip(own, df.columns, strict=True) if c.lower() not in taken]
    return got.select(*(F.col(o) for o, _ in kept), *(c.alias(f"__new{i}") for i, c in enumerate(new.values()))).toDF(*(c for _, c in kept), *new)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are small; as it is, for a shuffle join, beyond that. ``row_bytes`` is what a
    row takes in the built hash relation, about 64 bytes more than its values."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def join_spread(rows: DataFrame, table: DataFrame, key: str, spread: Column, n: str = "n", most: int = 1000) -> DataFrame:
    """``rows`` with ``found``, the struct of the row of ``table`` (a written table with each key once) for their ``key``, or null.

    ``n`` of the table says how many rows a key has. A key with more than 1 / ``most`` of all of them is hot: fewer than ``most`` keys
    can be, so these are sent to the rows whatever the input. Rows of hot keys and of null ones go through the
    shuffle by ``spread``, a column of the key's type that differs from row to row; what they meet there isn't used."""
    total = table.agg(F.sum(n)).first()[0] or 0
    as_found = lambda df, name, at: df.select(F.col(key).alias(at), F.struct(*(c for c in df.columns if c != key)).alias(name))
    hot = table.where(F.col(n) > total / most)
    out = rows.join(F.broadcast(as_found(hot, "__hot", key)), key, "left")
    out = out.withColumn("__key", F.when(F.col(key).isNull() | F.col("__hot").isNotNull(), spread).otherwise(F.col(key)))
    out = out.join(as_found(table, "__cold", "__key"), "__key", "left")
    found = F.when(F.col("__hot").isNotNull(), F.col("__hot")).when(F.col(key).isNotNull(), F.col("__cold"))
    return out.withColumn("found", found).drop("__hot", "__cold", "__key")


def spread_small(df: DataFrame) -> DataFrame:
    """A scan of a few small files dealt to more tasks: a row group is read by one task, so one small file would occupy one core of
    all. Scans of over ``SMALL_BYTES`` (Spark's estimate) or of as many files as cores are left as they are: large texts
    aren't shuffled. The rows are the same either way."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = min(df.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return df.repartition(parts) if size <= SMALL_BYTES and 0 < len(df.inputFiles()) < parts else df


def schema_of(ddl: str) -> pa.Schema:
    """The Arrow schema of a few column types that the operators emit."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def arrow_rows(ddl: str, cols: Sequence, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Record batches of the given columns (lists, numpy or Arrow arrays)."""
    schema = schema_of(ddl)
    arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)]
    batch = pa.RecordBatch.from_arrays(arrays, schema=schema)
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_groups(df: DataFrame, keys: Sequence[str], fn: Callable[[dict], tuple | None], ddl: str, parts: int = 0) -> DataFrame:
    """Rows dealt and sorted by ``keys``, then ``fn`` over each group in a streaming Arrow pass.

    The caller bounds a group's rows (hot keys are split beforehand by adding a block number to the keys). ``parts`` deals
    the groups to that many tasks, where they are small but costly; else Spark puts small ones together. ``fn``
    takes a dict of Arrow arrays of one group and returns a tuple of output columns, or None. One pass over sorted
    batches costs far less for a group than a call of applyInPandas, so that many small groups are cheap.
    """
    names = df.columns

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        out: list[tuple] = []
        held = 0

        def flush():
            nonlocal out, held
            if out:
                schema = schema_of(ddl)
                cols = [pa.concat_arrays([pa.array(x[i], f.type) if not isinstance(x[i], pa.Array) else x[i] for x in out]) for i, f in enumerate(schema)]
                yield from arrow_rows(ddl, cols)
            out, held = [], 0

        def groups(table: pa.Table, last: bool):
            """Calls ``fn`` for all groups but the last, which may go on in the next batch; returns the rest."""
            nonlocal held
            n = table.num_rows
            if not n:
                return None
            table = table.combine_chunks()
            new = np.zeros(n, bool)
            new[0] = True
            for k in keys:
                v = table.column(k).combine_chunks() if isinstance(table.column(k), pa.ChunkedArray) else table.column(k)
                v = v.to_numpy(zero_copy_only=False)
                new[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], n)
            cols = {c: (x.chunk(0) if x.num_chunks == 1 else pa.concat_arrays(x.chunks)) for c in names for x in [table.column(c)]}
            for s, e in zip(starts if last else starts[:-1], ends if last else ends[:-1], strict=True):
                got = fn({c: x.slice(s, e - s) for c, x in cols.items()})
                if got is not None:
                    out.append(got)
                    held += len(got[0])
            return None if last else table.slice(starts[-1])

        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([*rest, b])
            left = groups(table, False)
            rest = left.to_batches() if left is not None else []
            if held >= 20_000:
                yield from flush()
        if rest:
            groups(pa.Table.from_batches(rest), True)
        yield from flush()

    dealt = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys).mapInArrow(passes, ddl)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
