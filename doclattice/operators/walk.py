"""Walks: what is nested in what, however deep."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.operators.merge import least_rows
from doclattice.operators.spread import told, written


def walk(edges: DataFrame, roots: DataFrame, by: str = "/") -> DataFrame:
    """(node, depth, path) of all that is reached from ``roots`` (node, name) by ``edges`` (parent, child, name): each node once, at its
    least depth and there with the least path of names. So cycles end where they began, and a node in several containers is in
    the first. Null nodes are no nodes.

    A level is a join of the one before with the edges, in which a container's rows are told to its children, hot containers'
    by broadcast; nodes of earlier levels are left out. Each level is written, so there are as many rounds as the tree is
    deep, and one more."""
    spark = edges.sparkSession
    edges = edges.where("parent is not null and child is not null")
    sizes = edges.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n"))
    level = least_rows(roots.where("node is not null").select("node", F.col("name").alias("path")), ["node"], ["path"])
    level = written(level.withColumn("depth", F.lit(0).cast("long")).join(sizes, "node", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))), "level")
    done = level
    while not level.isEmpty():
        inner = told(edges.withColumnRenamed("parent", "node"), level, ["node"], ["child", "name"]).where("found is not null")
        found = inner.select(F.col("child").alias("node"), (F.col("found.depth") + 1).alias("depth"), F.concat("found.path", F.lit(by), "name").alias("path"))
        new = least_rows(found, ["node"], ["path"]).join(done.select("node"), "node", "left_anti")
        level = written(new.join(sizes, "node", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).select(*done.columns), "level")
        done = done.unionByName(level)
    return done.select("node", "depth", "path")


def leaves(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(*key, path, leaf) of the scalars in a VARIANT column, at any depth: paths as ``$.name[0]``, leaves as text, JSON null as null. A null value
    has none, an empty object or array none either. Each level is one join with the elements of its rows and is written;
    rows are dealt by their paths, so a value with most of all elements is spread from its second level on."""
    spark = df.sparkSession
    level = df.select(*key, F.lit("$").alias("path"), F.col(value).alias("v")).where("v is not null")
    kind = F.schema_of_variant("v")
    inner = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
    out = None
    while True:
        level = written(level.select(*key, "path", F.to_json("v").alias("j"), inner.alias("inner"), F.try_variant_get("v", "$", "string").alias("leaf")), "elements")
        flat = level.where("not inner").select(*key, "path", "leaf")
        out = flat if out is None else out.unionByName(flat)
        rest = level.where("inner")
        if rest.isEmpty():
            return out
        rest = rest.select(*key, "path", F.parse_json("j").alias("v")).repartition(*key, "path")
        # a side whose columns a lateral function reads has to be named
        names = ", ".join(f"`{c}`" for c in key)
        view = f"elements_{uuid.uuid4().hex}"
        rest.createTempView(view)
        level = spark.sql(f"SELECT {names}, concat(path, CASE WHEN e.key IS NULL THEN concat('[', e.pos, ']') ELSE concat('.', e.key) END) AS path, e.value AS v FROM {view}, LATERAL variant_explode(v) AS e")
        spark.catalog.dropTempView(view)
