"""References in texts, resolved by joins before the texts are rendered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclattice.operators.spread import told, written


def resolve_references(df: DataFrame, key: str, text: str, pattern: str, targets: DataFrame, write: Callable[[Column, Column, Column], Column], group: int = 1, ref: Callable[[Column], Column] = lambda r: r) -> DataFrame:
    """``df`` with ``resolved``, the ``text`` in which each match of ``pattern`` is what ``write(match, reference, target)`` makes of it, ``references``
    (how many there are) and ``hits`` (how many have a target). The ``group`` of a match, changed by ``ref``, is the reference; ``targets``
    (ref, target) has each once; the target is null where it has none.

    The references are exploded with their places, meet their targets by a join that spreads hot ones, and come back as a list a
    row, as long as its text has references; the text itself stays where it is until then, and is put together from the pieces
    between. ``key`` is another one for each row. A null text stays null without references."""
    refs = F.transform(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)), ref)
    each = df.select(key, F.posexplode(refs).alias("at", "ref"))
    asked = written(each.groupBy("ref").agg(F.count("*").alias("n")).join(targets, "ref"), "references")
    met = told(each, asked, ["ref"], [key, "at"]).select(key, F.struct("at", F.col("found.target").alias("target")).alias("x"))
    back = met.groupBy(key).agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["target"]).alias("__targets"))
    out = df.join(back, key, "left")
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.split(F.col(text), pattern, -1).alias("piece"), found.alias("match"), refs.alias("ref"), F.coalesce("__targets", F.array().cast("array<string>")).alias("target"))
    put = F.transform(zipped, lambda z: F.concat(z["piece"], F.when(z["match"].isNull(), "").otherwise(write(z["match"], z["ref"], z["target"]))))
    n = F.coalesce(F.size("__targets"), F.lit(0)).cast("long")
    hits = F.coalesce(F.size(F.filter("__targets", lambda t: t.isNotNull())), F.lit(0)).cast("long")
    return out.withColumns({"resolved": F.array_join(put, ""), "references": n, "hits": hits}).drop("__targets")
