"""Edits of texts by places: an interval and what stands there afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def found_edits(df: DataFrame, key: str, text: str, pattern: str, replacement: str) -> DataFrame:
    """(key, start, end, new) of the matches of ``pattern``, in characters from 0, end exclusive: their places are sums of the lengths of the
    pieces between and the matches before. ``key`` is another one for each row; matches aren't empty."""
    zipped = F.arrays_zip(F.split(F.col(text), pattern, -1).alias("piece"), F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("match"))
    each = df.select(key, F.posexplode(F.transform(zipped, lambda z: F.struct(F.length(z["piece"]).alias("gap"), F.length(z["match"]).alias("n")))).alias("i", "x")).where("x.n is not null")
    end = F.sum(F.col("x.gap") + F.col("x.n")).over(Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return each.select(key, (end - F.col("x.n")).alias("start"), end.alias("end"), F.lit(replacement).alias("new"))


def apply_edits(df: DataFrame, edits: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with ``edited``, the ``text`` with its edits made, ``n_edits``, how many were, and ``n_rejected``, how many of the others overlap one that was
    made or lie outside the text.

    Edits are those of the text as it was, as if they were made from its end. In the order of their places an edit is made if it
    begins where the last one ended or later; at one place an insertion (start = end) comes before a replacement, of
    several of either kind the one with the least end, then text: these are chosen before the shuffle, so a row gathers at most two
    for each place of its text, whatever the number of edits. A null text stays null and rejects all of its edits. Edits of no
    row's key are left out; ``key`` is another one for each row of ``df``."""
    inside = edits.groupBy(key, "start", (F.col("start") == F.col("end")).alias("pure")).agg(F.min(F.struct("end", "new")).alias("x"), F.count("*").alias("n"))
    size = df.select(key, F.length(text).alias("__size"))
    placed = inside.join(size, key).withColumn("fits", F.coalesce((F.col("start") >= 0) & (F.col("start") <= F.col("x.end")) & (F.col("x.end") <= F.col("__size")), F.lit(False)))
    one = F.when(F.col("fits"), F.struct("start", F.col("x.end").alias("end"), F.col("x.new").alias("new")))
    lists = placed.groupBy(key).agg(F.sort_array(F.collect_list(one)).alias("__edits"), F.sum("n").alias("__all"))
    out = df.join(lists, key, "left")
    start = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<struct<start: bigint, end: bigint, new: string>>").alias("made"))

    def step(acc, e):
        e = F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end"), e["new"].alias("new"))
        took = e["start"] >= acc["last"]
        return F.struct(F.when(took, e["end"]).otherwise(acc["last"]).alias("last"), F.when(took, F.concat(acc["made"], F.array(e))).otherwise(acc["made"]).alias("made"))

    out = out.withColumn("__made", F.coalesce(F.aggregate("__edits", start, step, lambda acc: acc["made"]), F.array().cast("array<struct<start: bigint, end: bigint, new: string>>")))
    before = F.concat(F.array(F.lit(0).cast("long")), F.transform("__made", lambda e: e["end"]))
    pieces = F.transform("__made", lambda e, i: F.concat(F.substring(F.col(text), (F.get(before, i) + 1).cast("int"), (e["start"] - F.get(before, i)).cast("int")), e["new"]))
    n = F.size("__made")
    tail = F.substring(F.col(text), (F.get(before, n) + 1).cast("int"), F.length(text))
    edited = F.when(n == 0, F.col(text)).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return out.withColumns({"edited": edited, "n_edits": n.cast("long"), "n_rejected": (F.coalesce("__all", F.lit(0)) - n).cast("long")}).drop("__edits", "__all", "__made")
