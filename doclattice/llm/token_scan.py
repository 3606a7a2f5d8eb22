"""Token counts of documents in flat token files without an index: a vectorised scan for the end-of-document id by blocks."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclattice.llm.shared import arrow_rows, columns, table_path, written
from doclattice.llm.word_tokens import chunks


def write_flat(docs: DataFrame, folder: str, tokenizer: str, eod: int, dtype: str = "<u2") -> DataFrame:
    """Writes ``docs`` (doc_id, text) as flat files of ids, each document's closed by ``eod``, one file a task; returns a written
    table (shard, nth, doc_id) of what document is which of its file.

    Each attempt of a task writes a file of its own name, which it gets when it is whole, and names it in its rows of the
    table. So the table only names files of attempts that Spark has committed; a file of another attempt is whole, too, but
    no document's."""
    top = np.iinfo(np.dtype(dtype)).max
    if eod > top:
        raise ValueError(f"the id {eod} doesn't fit {dtype}")

    def write(batches):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        encode = chunks(tokenizer).ids
        nth, out = 0, None
        tmp = f"{at}/_{name}.tmp"
        for b in batches:
            out = out or store.open_output_stream(tmp)
            for t in b.column(1).to_pylist():
                ids = np.frombuffer(encode(t), "<u4")
                if len(ids) and (ids.max() > top or (ids == eod).any()):
                    raise ValueError("an id of the text doesn't fit the file or is the end-of-document id")
                out.write(np.append(ids, eod).astype(dtype).tobytes())
            yield from arrow_rows("shard string, nth long, doc_id long", [[f"{name}.bin"] * b.num_rows, np.arange(nth, nth + b.num_rows), b.column(0)])
            nth += b.num_rows
        if out:
            out.close()
            store.move(tmp, f"{at}/{name}.bin")

    return written(columns(docs, "doc_id", "text").mapInArrow(write, "shard string, nth long, doc_id long"), "manifest")


def scan_flat(spark: SparkSession, folder: str, eod: int, dtype: str = "<u2", block: int = 8 << 20) -> DataFrame:
    """(shard, nth, n_tokens, ended): the tokens of each document of the flat files ``*.bin`` of a folder, without its ``eod``.

    Each block of ``block`` tokens is searched on its own, wherever documents begin; it yields the lengths between ends. A running
    maximum over the earlier blocks' last ends and a running sum of their numbers (a prefix scan, one row a block) then
    give the part of a block's first document that lies before it, and its number. Tokens after a file's last end are
    a document with ended = false. Files without bytes hold no documents; a size that is no multiple of the
    id's is an error."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    width = np.dtype(dtype).itemsize
    files = [(f.base_name, f.size) for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.base_name.endswith(".bin")]
    if bad := [n for n, s in files if s % width]:
        raise ValueError(f"not a whole number of ids: {bad[:3]}")
    shards = spark.createDataFrame(files, "shard string, size long").where("size > 0")
    starts = shards.select("shard", (F.col("size") / width).cast("long").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), (F.col("size") / width).cast("long") - 1, F.lit(block).cast("long"))).alias("start"))
    starts = starts.repartition(F.col("shard"), F.col("start"))

    def search(batches):
        for b in batches:
            for shard, n, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, at = fs.FileSystem.from_uri(folder)
                with store.open_input_file(f"{at}/{shard}") as f:
                    f.seek(start * width)
                    ids = np.frombuffer(f.read(min(block, n - start) * width), dtype)
                ends = np.flatnonzero(ids == eod) + start
                yield from arrow_rows("shard string, start long, stop long, last long, lengths array<long>", [[shard], [start], [start + len(ids)], [int(ends[-1]) if len(ends) else None], [np.diff(ends, prepend=start - 1) - 1]])

    found = written(starts.mapInArrow(search, "shard string, start long, stop long, last long, lengths array<long>"), "ends")
    earlier = Window.partitionBy("shard").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    scan = found.select("shard", "start", "stop", F.size("lengths").alias("m"), "last")
    scan = scan.select("shard", "start", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("open"))
    blocks = found.join(scan, ["shard", "start"])
    each = blocks.select("shard", "start", "before", "open", F.posexplode("lengths").alias("i", "n"))
    n = F.col("n") + F.when(F.col("i") == 0, F.col("start") - F.col("open") - 1).otherwise(0)
    whole = each.select("shard", (F.col("before") + F.col("i")).alias("nth"), n.alias("n_tokens"), F.lit(True).alias("ended"))
    tail = found.groupBy("shard").agg(F.sum(F.size("lengths")).alias("nth"), (F.max("stop") - F.coalesce(F.max("last"), F.lit(-1)) - 1).alias("n_tokens")).where("n_tokens > 0")
    return whole.unionByName(tail.withColumn("ended", F.lit(False)))


def token_counts(docs: DataFrame, tokenizer: str, eod: int = 0xFFFF, dtype: str = "<u2") -> DataFrame:
    """(doc_id, n_tokens) for each row of ``docs``: written as flat files in the shared folder, then counted by scanning these.

    ``eod`` closes a document in the files; it has to be an id that no text has, so the default lies beyond the vocabulary. A null
    or empty text has 0 tokens. Repeated and null doc_ids keep their rows. Further columns are not read."""
    spark = docs.sparkSession
    folder = table_path(spark, "flat")
    names = write_flat(docs, folder, tokenizer, eod, dtype)
    return names.join(scan_flat(spark, folder, eod, dtype), ["shard", "nth"]).select("doc_id", "n_tokens")
