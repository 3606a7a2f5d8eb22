"""Connected components of links, wholly as DataFrames: hook to the least neighbour, jump, contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.llm.shared import written


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id in ``links`` the least id that it reaches.

    Each round hooks every vertex that has a smaller neighbour to the least one, resolves the hooks to their roots by
    pointer jumping and contracts the links to the roots. The hooks point to smaller ids, so they form a forest; a
    round at least halves the vertices that still have links. Aggregates are minima (combined before the shuffle), so
    a vertex with very many neighbours needs no task of its own; every round's tables are written to the shared folder.
    Links with a null end and loops are ignored; repeated links and either direction are alike; no links give no rows.
    """
    hi, lo = F.greatest(a, b), F.least(a, b)
    rest = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(hi.alias("hi"), lo.alias("lo")).distinct()
    rest = written(rest, "links")
    found: DataFrame | None = None
    while not rest.isEmpty():
        hooks = written(rest.groupBy("hi").agg(F.min("lo").alias("root")).withColumnRenamed("hi", "id"), "hooks")
        while True:
            up = hooks.select(F.col("id").alias("root"), F.col("root").alias("up"))
            jumped = written(hooks.join(up, "root", "left").select("id", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")), "hooks")
            hooks = jumped.select("id", "root")
            if jumped.where("moved").isEmpty():
                break
        to = hooks.select(F.col("id").alias("root"), F.col("root").alias("up"))
        found = hooks if found is None else written(found.join(to, "root", "left").select("id", F.coalesce("up", "root").alias("root")).unionByName(hooks), "found")
        ends = rest.join(hooks.select(F.col("id").alias("hi"), F.col("root").alias("h")), "hi", "left").join(hooks.select(F.col("id").alias("lo"), F.col("root").alias("l")), "lo", "left")
        h, l = F.coalesce("h", "hi"), F.coalesce("l", "lo")
        rest = written(ends.select(F.greatest(h, l).alias("hi"), F.least(h, l).alias("lo")).where("hi != lo").distinct(), "links")
    if found is None:
        kind = links.schema[a].dataType
        return links.sparkSession.createDataFrame([], f"id {kind.simpleString()}, component {kind.simpleString()}")
    return found.select("id", F.col("root").alias("component")).unionByName(found.select(F.col("root").alias("id"), F.col("root").alias("component")).distinct())
