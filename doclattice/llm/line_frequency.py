"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclattice.llm.shared import BROADCAST_BYTES, beside, columns, maybe_broadcast, written

SPACES = " \t\n\v\f\r"


def lines_of(text):
    """The lines of a text without the white space around them. An empty one stands for a blank line."""
    return F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)))


def line_counts(pages: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """(host, line, key, n_pages, ratio): for each host and non-blank line the pages of the host that contain it, and
    that number divided by all pages of the host. Rows with a null host share the host null."""
    rows = columns(pages, host, text).toDF("host", "text")
    key = F.unhex(F.md5(F.encode("line", "utf-8")))
    each = rows.where("text is not null").select("host", F.explode(F.array_distinct(F.filter(lines_of(F.col("text")), lambda x: x != ""))).alias("line")).select("host", key.alias("key"))
    n = each.groupBy("host", "key").agg(F.count("*").alias("n_pages"))
    total = rows.groupBy("host").agg(F.count("*").alias("host_pages"))
    # the hosts are aggregated to one row each; their number is counted before they are sent anywhere
    total = written(total, "hosts")
    t = maybe_broadcast(total.withColumnRenamed("host", "h"), total.count(), 100)
    return n.join(t, F.col("host").eqNullSafe(F.col("h"))).select("host", "key", "n_pages", "host_pages", (F.col("n_pages") / F.col("host_pages")).alias("ratio"))


def drop_frequent_lines(docs: DataFrame, max_ratio: float = 0.1, host: str = "source", text: str = "text", few_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with further columns kept_text, n_lines, n_dropped: without the lines that more than ``max_ratio`` of the
    pages of their host contain. A line on one page alone is no repeat, so it stays, whatever part of the host that page is; there is no
    other bound by a host's size. A line exactly at the ratio stays.

    Lines are compared without the white space around them; kept lines stay as they are and in order; blank lines are
    never dropped. Counts cover all rows: pages are combined per line before the shuffle, and a host with a third of
    all pages is spread by its lines. The frequent lines (at most average lines / max_ratio for each host) are grouped
    per host and sent to the scan if they are counted as few (``few_bytes``); else the documents are written with a number
    for each row and their lines are joined by host and line: both ways judge each row by its own lines and host.
    A null text stays null with 0 lines, an empty one empty; rows with a null host count as one host. Repeated rows count as
    pages. An empty table gives no rows; a very long text is split like any other. Columns of ``docs`` with a new one's name are left out.
    """
    frequent = written(line_counts(docs, host, text).where((F.col("ratio") > max_ratio) & (F.col("n_pages") > 1)).select("host", "key"), "frequent-lines")
    few = frequent.count() * 96 <= few_bytes

    def dropped(plain: DataFrame, host_: Column, text_: Column) -> tuple[DataFrame, dict[str, Column]]:
        if few:
            lines = F.split(text_, "\n")
            hashed = F.transform(lines, lambda x: F.unhex(F.md5(F.encode(F.btrim(x, F.lit(SPACES)), "utf-8"))))
            per_host = frequent.groupBy("host").agg(F.collect_list("key").alias("__keys")).withColumnRenamed("host", "__host")
            out = plain.join(F.broadcast(per_host), host_.eqNullSafe(F.col("__host")), "left")
            flags = F.when(F.col("__keys").isNull(), F.transform(lines, lambda x: F.lit(False))).otherwise(F.transform(hashed, lambda h: F.array_contains("__keys", h)))
            out = out.withColumn("__drop", flags)
        else:
            # the numbers depend on how rows fall into tasks, so both sides read them from one table
            out = written(plain.withColumn("__row", F.monotonically_increasing_id()), "numbered-rows")
            lines = F.split(text_, "\n")
            each = out.select(F.col("__row").alias("__id"), host_.alias("host"), F.posexplode(lines_of(text_)).alias("at", "line")).where("line != ''")
            each = each.select("__id", "host", "at", F.unhex(F.md5(F.encode("line", "utf-8"))).alias("key"))
            f = frequent.select(F.col("host").alias("h"), "key")
            found = each.join(f, (each["key"] == f["key"]) & each["host"].eqNullSafe(f["h"])).groupBy("__id").agg(F.collect_set("at").alias("__at"))
            out = out.join(found, F.col("__row") == F.col("__id"), "left")
            out = out.withColumn("__drop", F.transform(lines, lambda x, i: F.coalesce(F.array_contains("__at", i), F.lit(False))))
        kept = F.filter(F.arrays_zip(lines.alias("x"), F.col("__drop").alias("d")), lambda z: ~z["d"])
        gone = F.when(F.col("__drop").isNull(), F.lit(0)).otherwise(F.size(F.filter("__drop", lambda d: d))).cast("long")
        text_now = F.when(gone == 0, text_).otherwise(F.array_join(F.transform(kept, lambda z: z["x"]), "\n"))
        n_lines = F.when(text_.isNull(), F.lit(0)).otherwise(F.size(F.filter(lines_of(text_), lambda x: x != ""))).cast("long")
        return out, {"kept_text": text_now, "n_lines": n_lines, "n_dropped": gone}

    return beside(docs, [host, text], dropped)
