"""Queries over the driver's tables that apply the engine's operators by analogy, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.functions import markup, wikitext
from doclattice.functions.names import canon_type, folded, norm, split_top
from doclattice.functions.xml import escape, render
from doclattice.operators.coverage import coverage as covered
from doclattice.operators.delta import delta_merge
from doclattice.operators.edits import apply_edits, found_edits
from doclattice.operators.merge import least_rows, merge_counts, merge_steps, priority_merge
from doclattice.operators.references import resolve_references
from doclattice.operators.resolve import by_id, member_index, resolve_members, resolve_types, tier_counts, type_index
from doclattice.plans import merge_docs as layers_of
from doclattice.plans.merge_docs import first_texts, lost
from doclattice.sources.files import EXPORT, archive_entries, entries
from doclattice.operators.spread import new_path
from doclattice.operators.walk import leaves, walk
from doclattice.sources.sinks import write_documents, write_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def layers(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Three layers that document customers: urgent orders, filled orders, nations."""
    orders = table(spark, sf_dir, "orders") if orders is None else orders
    note = lambda prio, source, word: (F.lit(source).alias("source"), F.lit(prio).alias("prio"), F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("ord"), F.concat(F.lit(f"{word} "), F.col("o_orderkey").cast("string")).alias("text"))
    urgent = orders.where("o_orderpriority = '1-URGENT'").select(*note(0, "urgent", "urgent"))
    full = orders.where("o_orderstatus = 'F'").select(*note(1, "filled", "filled"))
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    nation = customers.select(F.lit("nation").alias("source"), F.lit(2).alias("prio"), F.col("c_custkey").alias("id"), F.lit(0).cast("long").alias("ord"), F.col("n_name").alias("text"))
    return urgent.unionByName(full).unionByName(nation)


LAYERS = """layers AS (
    SELECT 'urgent' AS source, 0 AS prio, o_custkey AS id, o_orderkey AS ord, 'urgent ' || CAST(o_orderkey AS VARCHAR) AS text FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT 'filled', 1, o_custkey, o_orderkey, 'filled ' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'nation', 2, c_custkey, 0, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prio, ord) AS place, first_value(source) OVER (PARTITION BY id ORDER BY prio, ord) AS winner FROM layers)"""


@query(f"WITH {LAYERS} SELECT id, source, text FROM placed WHERE place = 1")
def priority_merge_query(spark, sf_dir):
    return least_rows(layers(spark, sf_dir), ["id"], ["prio", "ord"]).select("id", "source", "text")


@query(f"WITH {LAYERS} SELECT source, step, CAST(count(*) AS BIGINT) AS n FROM (SELECT source, unnest(['symbols documented', CASE WHEN place = 1 THEN 'entries written' ELSE 'already documented by a higher-priority source' END]) AS step FROM placed) GROUP BY source, step")
def merge_funnel(spark, sf_dir):
    return merge_steps(merge_counts(layers(spark, sf_dir)))


@query(f"WITH {LAYERS} SELECT id, source, text, winner FROM placed WHERE place > 1")
def shadowed_entries(spark, sf_dir):
    rows = priority_merge(layers(spark, sf_dir), tell=["source"])
    return rows.where("not written").select("id", "source", "text", F.col("winner_source").alias("winner"))


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY source, md5(regexp_replace(text, '[\\s\\x1c-\\x1f]+', '', 'g')) ORDER BY doc_id) AS place FROM documents) WHERE place = 1")
def first_in_source(spark, sf_dir):
    """The texts travel as digests: whole ones would make a shuffle of the table."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.md5(F.encode(norm(F.col("text")), "utf-8")).alias("id"))
    return least_rows(rows, ["source", "id"], ["doc_id"]).select("doc_id", "lang", "source")


@query("""SELECT 'events' AS source, 'no customer in credit with this key' AS reason, CAST(event_id AS VARCHAR) AS entry FROM events WHERE user_id IS NULL OR user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'labels', 'no English document with this id', CAST(doc_id AS VARCHAR) FROM labels WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def unmatched_report(spark, sf_dir):
    """Entries whose id a table of symbols lacks, by the lookup and the list of the merge."""
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    english = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    as_symbols = lambda df: by_id(df.select("id", F.lit("all").alias("asm"), F.array().cast("array<string>").alias("pnames"), F.col("id").alias("ord")))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").cast("string").alias("entry")).join(as_symbols(customers), "id", "left")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("entry")).join(as_symbols(english), "id", "left")
    none = lambda df, source, reason: lost(df.where("asm is null"), source, F.lit(reason), "entry")
    return none(events, "events", "no customer in credit with this key").unionByName(none(labels, "labels", "no English document with this id"))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, p_brand, s_name FROM lineitem LEFT JOIN part ON regexp_replace('Part' || CAST(l_partkey AS VARCHAR), '\\s+', '', 'g') = 'Part' || CAST(p_partkey AS VARCHAR) LEFT JOIN supplier ON l_suppkey = s_suppkey")
def exact_lookup(spark, sf_dir):
    """Parts as types, looked up by a name that is written otherwise; suppliers as symbols, looked up by id."""
    line, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    none = F.array().cast("array<string>").alias("pnames")
    types = type_index(part.select(F.lit("NamedType").alias("kind"), F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("full"), F.col("p_brand").alias("id"), F.col("p_name").alias("name"), none, F.col("p_partkey").alias("ord")))
    symbols = by_id(supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("asm"), none, F.col("s_suppkey").alias("ord"))).withColumnRenamed("id", "l_suppkey")
    asked = line.select("l_orderkey", "l_linenumber", "l_suppkey", F.concat(F.lit(" Part"), F.col("l_partkey").cast("string")).alias("written"))
    out = resolve_types(asked, types, "written").join(symbols, "l_suppkey", "left")
    return out.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("t.id").alias("p_brand"), F.col("asm").alias("s_name"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted names region.nation.segment, as if they were types."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    full = F.concat_ws(".", norm(F.col("r_name")), norm(F.col("n_name")), F.col("c_mktsegment"))
    return rows.select(full.alias("full")).distinct()


@query("""WITH full_names AS (SELECT DISTINCT regexp_replace(r_name, '\\s+', '', 'g') || '.' || regexp_replace(n_name, '\\s+', '', 'g') || '.' || c_mktsegment AS fname FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
asked AS (SELECT fname AS name FROM full_names UNION SELECT string_split(fname, '.')[2] || '.' || string_split(fname, '.')[3] FROM full_names UNION SELECT string_split(fname, '.')[3] FROM full_names),
hits AS (SELECT name, count(*) AS n, min(fname) AS fname FROM asked JOIN full_names ON fname LIKE '%.' || name GROUP BY name)
SELECT a.name, coalesce(e.fname, CASE WHEN h.n = 1 THEN h.fname END) AS found FROM asked a LEFT JOIN full_names e ON e.fname = a.name LEFT JOIN hits h ON h.name = a.name""")
def suffix_lookup(spark, sf_dir):
    full = places(spark, sf_dir)
    types = full.select(F.col("full").alias("type_key"), F.struct("full").alias("t"))
    asked = full.select(F.explode(F.array(F.col("full"), F.substring_index("full", ".", -2), F.substring_index("full", ".", -1))).alias("name")).distinct()
    return resolve_types(asked, types, "name", F.lit(True)).select("name", F.col("t.full").alias("found"))


@query("""WITH members AS (SELECT p_brand AS scope, CASE WHEN p_partkey % 3 = 0 THEN 'IShop.' || p_type ELSE p_type END AS name, p_type, p_partkey AS id FROM part),
asked AS (SELECT DISTINCT scope, unnest([name, p_type, upper(p_type), lower(p_type), upper(name), string_split(p_type, ' ')[1]]) AS name FROM members),
hits AS (SELECT a.scope, a.name, CASE WHEN m.name = a.name THEN 1 WHEN contains(m.name, '.') AND string_split(m.name, '.')[-1] = a.name THEN 2 WHEN lower(m.name) = lower(a.name) THEN 3 END AS tier, id
    FROM asked a JOIN members m ON m.scope = a.scope),
best AS (SELECT scope, name, min(tier) AS tier FROM hits GROUP BY ALL)
SELECT b.scope, b.name, b.tier, min(h.id) AS first_id, CAST(count(h.id) AS BIGINT) AS n FROM best b LEFT JOIN hits h ON h.scope = b.scope AND h.name = b.name AND (h.tier = b.tier OR b.tier = 3 AND h.tier = 3) GROUP BY ALL""")
def tiered_candidates(spark, sf_dir):
    """Part types as member names, every third one implemented explicitly; asked as they are, by last part, in other cases."""
    part = table(spark, sf_dir, "part").withColumn("name", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("IShop."), "p_type")).otherwise(F.col("p_type")))
    none = F.lit(None).cast("array<string>")
    symbols = part.select(F.col("p_partkey").alias("ord"), F.col("p_partkey").cast("string").alias("id"), F.lit("Method").alias("kind"), "name", F.col("p_brand").alias("type"), none.alias("ptypes"), none.alias("pnames"), none.alias("prefs"), F.lit(0).alias("tparams"))
    names = F.array("name", "p_type", F.upper("p_type"), F.lower("p_type"), F.upper("name"), F.substring_index("p_type", " ", 1))
    out = tier_counts(part.select(F.col("p_brand").alias("scope"), F.explode(names).alias("name")), member_index(symbols))
    return out.withColumn("first_id", F.col("first_id").cast("long"))


@query("""WITH c0 AS (SELECT l_orderkey AS k, list({'n': l_linenumber, 'f': l_returnflag, 's': l_linestatus, 'q': CAST(l_quantity AS BIGINT)}) AS c FROM lineitem GROUP BY l_orderkey),
c1 AS (SELECT k, len(c) AS named, CASE WHEN len(c) > 1 AND len(list_filter(c, lambda x: x.f = 'R')) > 0 THEN list_filter(c, lambda x: x.f = 'R') ELSE c END AS c FROM c0),
c2 AS (SELECT k, named, CASE WHEN len(c) > 1 THEN list_filter(c, lambda x: x.s = 'O') ELSE c END AS c FROM c1),
c3 AS (SELECT k, named, CASE WHEN len(c) > 1 THEN list_filter(c, lambda x: x.q % 2 = 0) ELSE c END AS c FROM c2)
SELECT k AS l_orderkey, CASE WHEN len(c) = 1 THEN CAST(c[1].n AS BIGINT) END AS line,
CASE WHEN len(c) = 1 THEN '' WHEN len(c) = 0 THEN CAST(named AS VARCHAR) || ' members with this name, none fits the signature' ELSE CAST(named AS VARCHAR) || ' members with this name, ' || CAST(len(c) AS VARCHAR) || ' fit the signature equally' END AS reason FROM c3""")
def narrow_ladder(spark, sf_dir):
    """The lines of an order as overloads: kind (with its way back), parameter list by line status, modifiers by quantity."""
    line = table(spark, sf_dir, "lineitem")
    even = (F.col("l_quantity").cast("long") % 2).cast("string")
    symbols = line.select(F.monotonically_increasing_id().alias("ord"), F.col("l_linenumber").cast("string").alias("id"), F.col("l_returnflag").alias("kind"), F.lit("line").alias("name"), F.col("l_orderkey").cast("string").alias("type"), F.array("l_linestatus").alias("ptypes"), F.array(F.lit("x")).alias("pnames"), F.array(even).alias("prefs"), F.lit(0).alias("tparams"))
    # a status is a type name, so that only one of an order's candidates or all alike may pass the rung of types
    asked = line.select(F.col("l_orderkey").cast("string").alias("scope")).distinct().select("scope", F.lit("line").alias("name"), F.lit("R").alias("kind"), F.lit(1).alias("arity"), F.array(F.lit("O")).alias("ptypes"), F.lit(0).alias("tparams"), F.array(F.lit("0")).alias("prefs"))
    out = resolve_members(asked, member_index(symbols))
    return out.select(F.col("scope").cast("long").alias("l_orderkey"), F.col("sym.id").cast("long").alias("line"), "reason")


_HOT_ROWS = """rows AS (
    SELECT event_type AS source, CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS prio, CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id END AS id, event_id AS ord FROM events),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY prio, ord) AS place, first_value(source) OVER o AS winner, count(*) OVER (PARTITION BY id) AS n FROM rows WINDOW o AS (PARTITION BY id ORDER BY prio, ord))"""


@query(f"WITH {_HOT_ROWS} SELECT ord, id, source, place = 1 AS written, winner FROM placed")
def hot_id_merge(spark, sf_dir):
    """All events with what became of them, where one id has a third of them."""
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(kind.alias("source"), F.when(kind == "purchase", 0).when(kind == "click", 1).otherwise(2).alias("prio"), F.when(F.col("user_id") % 3 == 0, F.lit(0).cast("long")).otherwise(F.col("user_id")).alias("id"), F.col("event_id").alias("ord"))
    return priority_merge(rows, tell=["source"]).select("ord", "id", "source", "written", F.col("winner_source").alias("winner"))


@query("""WITH lines AS (SELECT l_orderkey AS k, l_linenumber AS n, l_linenumber % 4 = 0 AS e, l_linenumber % 4 IN (0, 1) OR l_linenumber % 4 = 2 AND l_suppkey % 2 = 0 AS s FROM lineitem WHERE l_returnflag = 'N'),
all_lines AS (SELECT l_orderkey AS k, count(*) AS named, min(l_linenumber) AS only_n FROM lineitem GROUP BY l_orderkey),
fit AS (SELECT k, count(*) AS nc, count(*) FILTER (WHERE e) AS ne, count(*) FILTER (WHERE s) AS ns, min(n) AS cn, min(n) FILTER (WHERE e) AS en, min(n) FILTER (WHERE s) AS sn FROM lines GROUP BY k),
ended AS (SELECT a.k, named, CASE WHEN named = 1 OR ne = 1 OR ns = 1 THEN 1 ELSE coalesce(nc, 0) END AS n, CASE WHEN named = 1 THEN only_n WHEN ne = 1 THEN en WHEN ns = 1 THEN sn WHEN nc = 1 THEN cn END AS line FROM all_lines a LEFT JOIN fit f ON f.k = a.k)
SELECT k AS l_orderkey, CAST(line AS BIGINT) AS line, CASE WHEN n = 1 THEN '' WHEN n = 0 THEN CAST(named AS VARCHAR) || ' members with this name, none fits the signature' ELSE CAST(named AS VARCHAR) || ' members with this name, ' || CAST(n AS VARCHAR) || ' fit the signature equally' END AS reason FROM ended""")
def scope_rung(spark, sf_dir):
    """Lines as overloads whose parameter type is named from inside an order: as written, in the order's scope, in one around it, or elsewhere;
    so the scope tells lines apart that are alike without qualifiers. Half of the scopes around are those of other orders."""
    line = table(spark, sf_dir, "lineitem")
    outer, key, at = F.concat(F.lit("G"), (F.col("l_orderkey") % 7).cast("string")), F.col("l_orderkey").cast("string"), F.col("l_linenumber") % 4
    scope = F.concat(outer, F.lit(".K"), key)
    around = F.when(F.col("l_suppkey") % 2 == 0, outer).otherwise(F.concat(F.lit("H"), key))
    written = F.when(at == 0, F.col("l_returnflag")).when(at == 1, F.concat(scope, F.lit("."), "l_returnflag")).when(at == 2, F.concat(around, F.lit(" . "), "l_returnflag")).otherwise(F.concat(F.lit("Z."), "l_returnflag"))
    symbols = line.select(F.col("l_linenumber").cast("long").alias("ord"), F.col("l_linenumber").cast("string").alias("id"), F.lit("Method").alias("kind"), F.lit("line").alias("name"), scope.alias("type"), F.array(written).alias("ptypes"), F.array(F.lit("x")).alias("pnames"), F.lit(None).cast("array<string>").alias("prefs"), F.lit(0).alias("tparams"))
    asked = line.select("l_orderkey", scope.alias("scope")).distinct().select("l_orderkey", "scope", F.lit("line").alias("name"), F.lit("Method").alias("kind"), F.lit(1).alias("arity"), F.array(F.lit("N")).alias("ptypes"), F.lit(0).alias("tparams"), F.lit(None).cast("array<string>").alias("prefs"))
    out = resolve_members(asked, member_index(symbols))
    return out.select("l_orderkey", F.col("sym.id").cast("long").alias("line"), "reason")


_BEFORE = """, before AS (
    SELECT 'urgent' AS source, 0 AS prio, o_custkey AS id, o_orderkey AS ord, 'urgent ' || CAST(o_orderkey AS VARCHAR) AS text FROM orders WHERE (o_orderpriority = '1-URGENT') <> (o_orderkey % 100 = 7)
    UNION ALL SELECT 'filled', 1, o_custkey, o_orderkey, 'filled ' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'nation', 2, c_custkey, 0, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
changed AS (SELECT DISTINCT id FROM ((SELECT source, prio, id, ord, text FROM layers EXCEPT ALL FROM before) UNION ALL (FROM before EXCEPT ALL SELECT source, prio, id, ord, text FROM layers)))"""


@query(f"WITH {LAYERS}{_BEFORE} SELECT id, source, text, id IN (SELECT id FROM changed) AS again FROM placed WHERE place = 1")
def delta_merge_query(spark, sf_dir):
    """The merge of customers' layers after one of a hundred orders has become urgent or has ceased to be: a run with what was before, then one
    with the tables as they are, which only ranks the customers again that this touches."""
    orders = table(spark, sf_dir, "orders")
    flip = F.col("o_orderkey") % 100 == 7
    was = F.when(flip & (F.col("o_orderpriority") == "1-URGENT"), "2-HIGH").when(flip, "1-URGENT").otherwise(F.col("o_orderpriority"))
    state = new_path(spark, "state")
    delta_merge(layers(spark, sf_dir, orders.withColumn("o_orderpriority", was)), state)
    return delta_merge(layers(spark, sf_dir), state).select("id", "source", "text", "again")


QUERIES["delta_merge"], ORACLES["delta_merge"] = QUERIES.pop("delta_merge_query"), ORACLES.pop("delta_merge_query")


@query("""WITH titles AS (SELECT '/' || regexp_extract(html, '<title>([^ <]+)', 1) AS ref, max(page_id) AS target FROM pages GROUP BY ref),
pieces AS (SELECT page_id, unnest(string_split_regex(html, '<a href="[^"]*">')) AS piece, unnest(range(1, 1 + len(string_split_regex(html, '<a href="[^"]*">')))) AS i FROM pages),
refs AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS ref, unnest(range(1, 1 + len(regexp_extract_all(html, '<a href="([^"]*)">', 1)))) AS i FROM pages),
put AS (SELECT p.page_id, p.i, r.ref, t.target, piece || CASE WHEN r.i IS NULL THEN '' WHEN t.target IS NULL THEN '<u>' ELSE '<a page="' || CAST(t.target AS VARCHAR) || '">' END AS text FROM pieces p LEFT JOIN refs r ON r.page_id = p.page_id AND r.i = p.i LEFT JOIN titles t ON t.ref = r.ref)
SELECT page_id, CAST(count(ref) AS BIGINT) AS n_links, CAST(count(target) AS BIGINT) AS hits, md5(string_agg(text, '' ORDER BY i)) AS resolved_md5 FROM put GROUP BY page_id""")
def page_references(spark, sf_dir):
    """The links of pages, resolved to the last page whose title begins with the word that they name, before anything is rendered."""
    pages = table(spark, sf_dir, "pages")
    title = F.concat(F.lit("/"), F.regexp_extract("html", "<title>([^ <]+)", 1))
    targets = pages.groupBy(title.alias("ref")).agg(F.max("page_id").cast("string").alias("target"))
    write = lambda match, ref, target: F.when(target.isNull(), "<u>").otherwise(F.concat(F.lit('<a page="'), target, F.lit('">')))
    out = resolve_references(pages.select("page_id", "html"), "page_id", "html", '<a href="([^"]*)">', targets, write)
    return out.select("page_id", F.col("references").alias("n_links"), "hits", F.md5(F.encode("resolved", "utf-8")).alias("resolved_md5"))


@query(r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z]{12,}|[0-9]+')) AS BIGINT) AS n_edits, CAST(0 AS BIGINT) AS again, md5(regexp_replace(text, '[A-Za-z]{12,}|[0-9]+', '[long]', 'g')) AS edited_md5 FROM documents""")
def text_edits(spark, sf_dir):
    """Long words and numbers of whole documents as a list of edits, which are made; the edited texts have none to make."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = apply_edits(docs, found_edits(docs, "doc_id", "text", "[A-Za-z]{12,}|[0-9]+", "[long]"), "doc_id", "text")
    again = F.size(F.regexp_extract_all("edited", F.lit("[A-Za-z]{12,}|[0-9]+"), F.lit(0))).cast("long")
    return made.select("doc_id", "n_edits", again.alias("again"), F.md5(F.encode("edited", "utf-8")).alias("edited_md5"))


@query("""WITH RECURSIVE edges AS (
    SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS parent, 'n' || CAST(n_nationkey AS VARCHAR) AS child, n_name AS name FROM nation
    UNION ALL SELECT 'n' || CAST(c_nationkey AS VARCHAR), 'c' || CAST(c_custkey AS VARCHAR), c_name FROM customer
    UNION ALL SELECT 'c' || CAST(o_custkey AS VARCHAR), 'o' || CAST(o_orderkey AS VARCHAR), CAST(o_orderkey AS VARCHAR) FROM orders),
tree AS (
    SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS node, CAST(0 AS BIGINT) AS depth, r_name AS path FROM region
    UNION ALL SELECT e.child, t.depth + 1, t.path || '/' || e.name FROM tree t JOIN edges e ON e.parent = t.node)
SELECT node, depth, path FROM tree""")
def nested_containers(spark, sf_dir):
    """Regions, their nations, these nations' customers and their orders, found by walking from the regions; an edge from each nation
    back to its region leads nowhere new."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nation, customer, orders = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    edges = nation.select(key("r", "n_regionkey").alias("parent"), key("n", "n_nationkey").alias("child"), F.col("n_name").alias("name"))
    edges = edges.unionByName(nation.select(key("n", "n_nationkey").alias("parent"), key("r", "n_regionkey").alias("child"), F.lit("back").alias("name")))
    edges = edges.unionByName(customer.select(key("n", "c_nationkey").alias("parent"), key("c", "c_custkey").alias("child"), F.col("c_name").alias("name")))
    edges = edges.unionByName(orders.select(key("c", "o_custkey").alias("parent"), key("o", "o_orderkey").alias("child"), F.col("o_orderkey").cast("string").alias("name")))
    return walk(edges, table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("node"), F.col("r_name").alias("name")))


@query("""SELECT event_id, path, leaf FROM (
    SELECT event_id, '$.props.k' AS path, json_extract_string(props, '$.k') AS leaf FROM events
    UNION ALL SELECT event_id, '$.at[0].user', CAST(user_id AS VARCHAR) FROM events UNION ALL SELECT event_id, '$.at[0].type', event_type FROM events
    UNION ALL SELECT event_id, '$.at[1]', CASE WHEN event_id % 3 <> 0 THEN '#autoLOC_' || CAST(event_id AS VARCHAR) END FROM events)
WHERE path <> '$.at[1]' OR leaf IS NOT NULL""")
def argument_leaves(spark, sf_dir):
    """Events as nested arguments, their props among them, walked to their scalars; strings that aren't keys of a dictionary don't
    count among the last."""
    last = F.when(F.col("event_id") % 3 == 0, F.lit('"plain"')).otherwise(F.concat(F.lit('"#autoLOC_'), F.col("event_id").cast("string"), F.lit('"')))
    text = F.concat(F.lit('{"props":'), "props", F.lit(',"at":[{"user":'), F.col("user_id").cast("string"), F.lit(',"type":"'), "event_type", F.lit('"},'), last, F.lit('],"none":{}}'))
    found = leaves(table(spark, sf_dir, "events").select("event_id", F.parse_json(text).alias("v")), ["event_id"], "v")
    return found.where((F.col("path") != "$.at[1]") | F.startswith(F.lower("leaf"), F.lit("#autoloc")))


@query("SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'assistant' AND text <> '') AS tooltip, arg_min(text, turn) FILTER (WHERE role = 'user' AND text <> '') AS label FROM conversations GROUP BY conv_id")
def first_tooltip_label(spark, sf_dir):
    """Turns as arguments of an attribute: the assistant's are sentences, the user's names."""
    arg = F.when(F.col("role") == "assistant", "toolTip").when(F.col("role") == "user", "guiName")
    return first_texts(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("at"), arg.alias("arg"), F.nullif("text", F.lit("")).alias("text")), ["conv_id"])


@query("SELECT p_partkey, lower(regexp_replace(p_name, '[\\W_]', '', 'g')) = lower(regexp_replace(split_part(p_name, ' ', 1) || '-' || split_part(p_name, ' ', 2), '[\\W_]', '', 'g')) AS echo, lower(regexp_replace(p_type, '[\\W_]', '', 'g')) AS folded FROM part")
def label_echo(spark, sf_dir):
    two = F.concat_ws("-", F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)), F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)))
    return table(spark, sf_dir, "part").select("p_partkey", (folded(F.col("p_name")) == folded(two)).alias("echo"), folded(F.col("p_type")).alias("folded"))


@query("""SELECT p_partkey, p_name || ' ' || p_type || ' is ' || CAST(p_size AS VARCHAR) || ' shop (http://x.example/' || CAST(p_partkey AS VARCHAR) || ') 2^' || CAST(p_size AS VARCHAR) || '& List<' || p_brand || '> ' || p_brand AS text FROM part""")
def markup_to_text(spark, sf_dir):
    """Wiki markup around the columns of parts, as plain text."""

    @F.pandas_udf("string")
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(wikitext.plain)

    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    parts = ("\'\'\'", "p_name", "\'\'\' [[API:Page|", "p_type", "]] is <b class=\'x\'>", size, "</b><br/>[http://x.example/", key, " \'\'shop\'\'] 2<sup>", size, "</sup>&amp;<!-- [[none]] -->\n List<", "p_brand", "> {{Type|", "p_brand", "}}")
    markup_ = F.concat(*(F.lit(x) if i % 2 == 0 else F.col(x) if isinstance(x, str) else x for i, x in enumerate(parts)))
    return table(spark, sf_dir, "part").select("p_partkey", plain(markup_).alias("text"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'List<int,' || p_brand || '>' WHEN 1 THEN 'string[' || repeat(',', p_size % 3) || ']' WHEN 2 THEN 'Strings<' || regexp_replace(p_type, '\\s+', '', 'g') || ',float>'
    WHEN 3 THEN 'Int32x' || p_brand ELSE repeat('List<', p_size % 4) || 'bool' || repeat('>', p_size % 4) END AS canon FROM part""")
def canon_name(spark, sf_dir):
    """Types in many spellings: white space and braces, by-reference marks, arrays, aliases that are only part of a name, nesting."""
    size = F.col("p_size")
    shapes = [
        joined("System . Collections.Generic.List{System.Int32, Shop.", F.col("p_brand"), "}@"), joined("System.String [", F.repeat(F.lit(","), size % 3), "]&"), joined("Outer.Strings<A.B.", F.col("p_type"), ", System.\tSingle>"),
        joined("Deep . Er.Int32x", F.col("p_brand")), joined(F.repeat(F.lit("A.List{ "), size % 4), "System.Boolean", F.repeat(F.lit("} "), size % 4), "@"),
    ]
    written = shapes[4]
    for i in (3, 2, 1, 0):
        written = F.when(F.col("p_partkey") % 5 == i, shapes[i]).otherwise(written)
    return table(spark, sf_dir, "part").select("p_partkey", canon_type(written).alias("canon"))


@query("""SELECT p_partkey, CAST(3 + p_size % 3 AS BIGINT) AS n, p_brand || repeat('<', p_size % 5) || CAST(p_size AS VARCHAR) || CASE WHEN p_size % 5 > 0 THEN ',x' ELSE '' END || repeat('>', p_size % 5) AS one, '(' || p_type || ',[y,z])' AS two, CASE WHEN p_size % 3 > 0 THEN '' ELSE p_name END AS three FROM part""")
def split_top_query(spark, sf_dir):
    """Lists whose parts are nested to any depth, with empty parts among them."""
    size, depth = F.col("p_size"), F.col("p_size") % 5
    text = joined(F.col("p_brand"), F.repeat(F.lit("<"), depth), size, F.when(depth > 0, ",x").otherwise(""), F.repeat(F.lit(">"), depth), ",(", F.col("p_type"), ",[y,z]),", F.repeat(F.lit(","), size % 3), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", split_top(text).alias("x")).select("p_partkey", F.size("x").cast("long").alias("n"), *(F.get("x", i).alias(c) for i, c in enumerate(("one", "two", "three"))))


@query("""SELECT p_partkey, '<summary>' || replace(replace(replace(p_name, '&', '&amp;'), '>', '&gt;'), '<', '&lt;') || '</summary><param name=' || CASE p_partkey % 4 WHEN 0 THEN '"' || p_brand || '"' WHEN 1 THEN '''"' || p_brand || '"''' WHEN 2 THEN '"' || p_brand || '''s"' ELSE '"&quot;' || p_brand || '''&quot;&#10;&lt;"' END || '>' || p_type || '</param><returns>' || CAST(p_size AS VARCHAR) || '</returns><remarks>' || p_type || '</remarks>' AS body FROM part""")
def render_member(spark, sf_dir):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.col("p_brand")).when(k == 1, joined('"', F.col("p_brand"), '"')).when(k == 2, joined(F.col("p_brand"), "'s")).otherwise(joined('"', F.col("p_brand"), "'\"\n<"))
    named = F.array(F.struct(name.alias("name"), F.col("p_type").alias("text")))
    doc = F.struct(escape(F.col("p_name")).alias("summary"), named.alias("params"), F.slice(named, 1, 0).alias("typeparams"), F.col("p_size").cast("string").alias("returns"), F.array("p_type").alias("remarks"), F.lit(None).cast("string").alias("raw"))
    return table(spark, sf_dir, "part").select("p_partkey", render(doc).alias("body"))


@query("""WITH entries AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN 'Main & more' ELSE n_name END AS asm, c_name AS id, '<summary>' || c_mktsegment || ' &amp; ' || n_name || '</summary>' AS body FROM customer JOIN nation ON c_nationkey = n_nationkey),
sizes AS (SELECT asm, count(*) AS n FROM entries GROUP BY asm),
heads AS (SELECT asm, unnest(range(0, 6)) AS place, unnest(['<?xml version="1.0" encoding="utf-8"?>', '<doc>', '  <assembly>', '    <name>' || replace(asm, '&', '&amp;') || '</name>', '  </assembly>', '  <members>']) AS line FROM sizes),
feet AS (SELECT asm, n + unnest(range(6, 8)) AS place, unnest(['  </members>', '</doc>']) AS line FROM sizes),
members AS (SELECT asm, row_number() OVER (PARTITION BY asm ORDER BY id) + 5 AS place, '    <member name="' || id || '">' || body || '</member>' AS line FROM entries)
SELECT asm || '.xml' AS file, CAST(place AS BIGINT) AS place, line FROM (FROM heads UNION ALL FROM feet UNION ALL FROM members)""")
def grouped_document(spark, sf_dir):
    """Customers as members of nations' assemblies, a third of them of one: the files as the tasks have written them, read again by
    lines with their places."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    body = F.concat(F.lit("<summary>"), escape(F.concat_ws(" & ", "c_mktsegment", "n_name")), F.lit("</summary>"))
    folder = new_path(spark, "files")
    write_documents(rows.select(F.when(F.col("c_custkey") % 3 == 0, F.lit("Main & more")).otherwise(F.col("n_name")).alias("asm"), F.col("c_name").alias("id"), body.alias("body")), folder)
    return numbered_lines(spark, f"{folder}/*.xml")


def numbered_lines(spark: SparkSession, paths: str) -> DataFrame:
    """(file, place, line) of text files: a line's place is that in the part of its file that a task reads, and the lines of the parts before."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("k"), F.col("value").alias("line"))
    parts = lines.groupBy("file", "start").agg(F.min("k").alias("first"), F.count("*").alias("n"))
    before = parts.alias("a").join(parts.alias("b"), F.expr("a.file = b.file AND b.start < a.start"), "left").groupBy("a.file", "a.start", "a.first").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    return lines.join(before, ["file", "start"]).select(F.regexp_replace(F.replace("file", F.lit("%20"), F.lit(" ")), "%26", "&").alias("file"), (F.col("before") + F.col("k") - F.col("first")).alias("place"), "line")


@query("SELECT d.lang AS asm, CAST(count(l.doc_id) AS BIGINT) AS documented, CAST(count(*) AS BIGINT) AS total FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY d.lang")
def coverage(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("asm"))
    return covered(docs, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))


@query("""SELECT what, kind, name, CAST(tparams AS BIGINT) AS tparams, CAST(count(*) AS BIGINT) AS n FROM (
SELECT 'members' AS what, CASE event_type WHEN 'click' THEN 'Method' WHEN 'view' THEN 'Field' WHEN 'purchase' THEN 'Property' END AS kind, CASE WHEN event_type = 'click' AND value > 50 THEN 'op_Implicit' ELSE event_type END AS name, CASE WHEN event_type = 'click' AND NOT value > 50 THEN 2 WHEN event_type = 'click' THEN 0 END AS tparams
FROM events WHERE user_id % 4 >= 2) GROUP BY ALL""")
def kind_filter(spark, sf_dir):
    """Events as elements of an archive: in pages, in namespaces and in classes; clicks as methods, some of them conversions."""
    outer = F.when(F.col("user_id") % 4 == 0, "page").when(F.col("user_id") % 4 == 1, "namespace").when(F.col("user_id").isNotNull(), "class").otherwise("dir")
    cast = (F.col("event_type") == "click") & (F.col("value") > 50)
    text, none = F.lit("").alias, lambda kind: F.lit(None).cast(kind).alias
    kind = F.when(F.col("event_type") == "click", "function").when(F.col("event_type") == "view", "variable").when(F.col("event_type") == "purchase", "property").otherwise("friend")
    raw = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("ord"), F.lit("member").alias("what"), outer.alias("outer"), F.lit("Deep::Place").alias("container"), kind.alias("kind"), F.when(cast, "operator Place").otherwise(F.concat("event_type", F.lit("<A, B>"))).alias("own"),
        none("string")("parent"), text("args"), F.when(cast, "implicit").otherwise("void").alias("type"), F.lit(True).alias("static"), F.array().cast("array<string>").alias("written"), text("ref"), none("string")("brief"), none("string")("detailed"), F.lit(False).alias("has_doc"),
    )
    return entries(raw).groupBy("what", "kind", "name", F.col("tparams").cast("long").alias("tparams")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_size % 3 <> 0 AND p_partkey % 5 <> 0 AS well_formed FROM part")
def wellformed_filter(spark, sf_dir):
    """Fragments of part names; some lack an end tag, some use a prefix that nothing binds."""

    @F.pandas_udf("boolean")
    def formed(texts: pd.Series) -> pd.Series:
        return texts.map(markup.well_formed)

    end, inner = F.when(F.col("p_size") % 3 == 0, F.lit("")).otherwise(F.lit("</b>")), F.when(F.col("p_partkey") % 5 == 0, F.lit("<x:y/>")).otherwise(F.lit("&amp;"))
    return table(spark, sf_dir, "part").select("p_partkey", formed(F.concat(F.lit("<b>"), escape(F.col("p_name")), inner, end)).alias("well_formed"))


@query("""SELECT p_partkey, '  /// <summary>' || chr(10) || '  /// ' || p_name || chr(10) || '  /// </summary>' || chr(10) || '  /// <returns>' || p_type || '</returns>' || chr(10) || '  /// <remarks>' || chr(10) || '  /// ' || rpad('', 94, 'w') || chr(10) || '  /// ' || p_brand || chr(10) || '  /// </remarks>' || chr(10) AS comment FROM part""")
def comment_lines(spark, sf_dir):
    """Members of part columns as source comments: a summary, a short element, one that is filled."""
    body = F.concat(F.lit("<summary> "), escape(F.col("p_name")), F.lit("\n</summary><returns>"), escape(F.col("p_type")), F.lit(f"</returns><remarks>{'w' * 94}  "), escape(F.col("p_brand")), F.lit("</remarks>"))
    return table(spark, sf_dir, "part").select("p_partkey", markup.comment(body, F.lit("  ")).alias("comment"))


QUERIES["priority_merge"] = QUERIES.pop("priority_merge_query")
ORACLES["priority_merge"] = ORACLES.pop("priority_merge_query")
QUERIES["split_top"] = QUERIES.pop("split_top_query")
ORACLES["split_top"] = ORACLES.pop("split_top_query")


def symbols_of(*parts: DataFrame) -> DataFrame:
    """Rows of symbols from (ord, id, kind, name, type, ptypes, pnames, loc), all in one assembly."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumns({"asm": F.lit("Shop"), "full": F.concat_ws(".", F.nullif("type", F.lit("")), "name"), "prefs": F.transform("ptypes", lambda t: F.lit("None")), "tparams": F.lit(0)})


def symbol(part: DataFrame, at: int, kind: str, id_, name, type_, ptypes=None, pnames=None, loc=None) -> DataFrame:
    text = lambda x: F.array(*map(F.lit, x)) if isinstance(x, list) else F.lit(None).cast("array<string>")
    return part.select((F.col("p_partkey") * 10 + at).alias("ord"), id_.alias("id"), F.lit(kind).alias("kind"), name.alias("name"), type_.alias("type"), text(ptypes).alias("ptypes"), text(pnames).alias("pnames"), (F.lit(None).cast("array<array<string>>") if loc is None else loc).alias("loc"))


@query("""WITH texts AS (
    SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN upper(split_part(p_name, ' ', 1)) || '-' ELSE p_name || ' <' || CAST(p_size AS VARCHAR) || '>' END AS t FROM part WHERE p_partkey % 4 <> 3 OR p_partkey % 5 = 0),
rows AS (
    SELECT p.p_partkey AS k, 'F:Shop.' || CAST(CASE WHEN p.p_partkey % 10 = 1 THEN p.p_partkey - 1 ELSE p.p_partkey END AS VARCHAR) AS id,
        CASE WHEN p_size % 3 = 0 THEN tip.t END AS tip, CASE WHEN lower(regexp_replace(own.t, '[^A-Za-z0-9]', '', 'g')) <> lower(split_part(p_name, ' ', 1)) THEN own.t END AS label
    FROM part p LEFT JOIN texts own ON own.k = p.p_partkey LEFT JOIN texts tip ON tip.k = p.p_partkey + 1),
last AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k DESC) AS place FROM rows WHERE tip IS NOT NULL OR label IS NOT NULL),
shown AS (SELECT id, replace(replace(replace(tip, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS tip, 'In-game label: ' || replace(replace(replace(label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS label FROM last WHERE place = 1)
SELECT id, '<summary>' || coalesce(tip, label) || '</summary>' || CASE WHEN tip IS NOT NULL AND label IS NOT NULL THEN '<remarks>' || label || '</remarks>' ELSE '' END || '<remarks>Source: game UI text (en-us localization).</remarks>' AS body FROM shown""")
def interface_texts(spark, sf_dir):
    """Parts' names as dictionaries of two stock folders and one that isn't, written as files; parts as fields whose attributes name
    their own key and the next one's: keys without a text, labels that only repeat a name, ids with two rows."""
    part = table(spark, sf_dir, "part")
    key, k = F.col("p_partkey"), F.col("p_partkey").cast("string")
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    line = lambda text: joined("\t\t#LOC_P", k, " = ", text, "\n")
    texts = part.where(key % 4 != 3).select(F.lit("Squad/Localization/d").alias("top"), key.alias("at"), line(joined(F.col("p_name"), "\\n<", F.col("p_size"), ">")).alias("line"))
    texts = texts.unionByName(part.where(key % 5 == 0).select(F.lit("SquadExpansion/More/Localization/e"), key.alias("at"), line(joined(F.upper(first), "-")).alias("line")).toDF("top", "at", "line"))
    texts = texts.unionByName(part.select(F.lit("Other/Localization/f"), key.alias("at"), line(F.lit("wrong")).alias("line")).toDF("top", "at", "line"))
    texts = texts.select(F.concat("top", (F.col("at") % 16).cast("string"), F.lit(".cfg")).alias("file"), "at", "line")
    ends = texts.select("file").distinct().select("file", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("at"), F.lit("\ufeffLocalization\n{\n\ten-us\n\t{\n").alias("line")), F.struct(F.lit(1 << 60).alias("at"), F.lit("\t}\n}\n").alias("line")))).alias("x")).select("file", "x.at", "x.line")
    folder = new_path(spark, "data")
    write_files(texts.unionByName(ends), ["at"], folder)
    same = F.when(key % 10 == 1, key - 1).otherwise(key)
    loc = F.filter(F.array(F.array(F.lit("Gui"), F.lit("guiName"), joined("#loc_p", k)), F.when(F.col("p_size") % 3 == 0, F.array(F.lit("Gui"), F.lit("toolTip"), joined("#LOC_P", key + 1)))), lambda x: x.isNotNull())
    symbols = symbols_of(symbol(part, 0, "Field", joined("F:Shop.", same), first, F.lit("Shop"), loc=loc))
    return layers_of.game_layer(spark, folder, symbols).docs.select("id", render(F.col("doc")).alias("body"))


@query("""WITH old AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS s, p_name, p_size FROM part),
asked AS (SELECT *, CASE k % 4 WHEN 0 THEN 'M:Shop.P' || s || '.Do(System.Int32)' WHEN 1 THEN 'M:P' || s || '.Do(System.Int32,System.Single@)' WHEN 2 THEN 'M:Shop.P' || s || '.Gone' ELSE 'M:Nowhere' || s || '.Do(System.Int32)' END AS old_id FROM old)
SELECT old_id AS entry, CASE k % 4 WHEN 0 THEN 'M:Shop.P' || s || '.Do(System.Int32)' WHEN 1 THEN 'M:Shop.P' || s || '.Do(System.Int32,System.Single)' END AS id,
    CASE k % 4 WHEN 2 THEN 'type exists, no member with this name' WHEN 3 THEN 'containing type not found' ELSE CAST(p_size AS VARCHAR) || ' &lt; 99 &amp; <summary>' || p_name || ' more</summary>' || CASE WHEN k % 4 = 0 THEN '' ELSE '<param name="x">kept</param>' END || '<remarks>Source: anatid community API documentation (2015).</remarks>' END AS text
FROM asked""")
def old_member_files(spark, sf_dir):
    """Parts as members of an older documentation, written as one file: ids that are still there, that have moved, whose member or whose type
    is gone; parameters that a symbol has lost go, too."""
    part = table(spark, sf_dir, "part")
    key, k = F.col("p_partkey") % 4, F.col("p_partkey")
    old = F.when(key == 0, joined("M:Shop.P", k, ".Do(System.Int32)")).when(key == 1, joined("M:P", k, ".Do(System.Int32,System.Single@)")).when(key == 2, joined("M:Shop.P", k, ".Gone")).otherwise(joined("M:Nowhere", k, ".Do(System.Int32)"))
    body = joined(" ", F.col("p_size"), " &lt; 99 &amp; <summary>", escape(F.col("p_name")), "\n   more</summary><param name=\"x\">kept</param><param name=\"lost\">y</param>")
    folder = new_path(spark, "old")
    write_documents(part.select(F.lit("Old").alias("asm"), old.alias("id"), body.alias("body")), folder)
    types = symbol(part, 0, "NamedType", joined("T:Shop.P", k), joined("P", k), F.lit("Shop"))
    one = symbol(part, 1, "Method", joined("M:Shop.P", k, ".Do(System.Int32)"), F.lit("Do"), joined("Shop.P", k), ["int"], ["n"])
    two = symbol(part, 2, "Method", joined("M:Shop.P", k, ".Do(System.Int32,System.Single)"), F.lit("Do"), joined("Shop.P", k), ["int", "float"], ["n", "x"])
    layer = layers_of.anatid_layer(spark, f"{folder}/Old.xml", symbols_of(types, one, two))
    names = part.select(old.alias("entry"), F.when(key == 0, joined("M:Shop.P", k, ".Do(System.Int32)")).when(key == 1, joined("M:Shop.P", k, ".Do(System.Int32,System.Single)")).alias("id"))
    docs = layer.docs.select("id", F.col("doc.raw").alias("text")).join(names, "id").select("entry", "id", "text")
    return docs.unionByName(layer.unmatched.select("entry", F.lit(None).cast("string").alias("id"), F.col("reason").alias("text")))


@query("""WITH p AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS s, p_name, p_type, p_brand, CAST(p_size AS VARCHAR) AS z FROM part),
found AS (SELECT *, '<remarks>Source: KSP wiki page API:P' || s || ', last edited 2020-01-' || lpad(CAST(k % 28 + 1 AS VARCHAR), 2, '0') || '.</remarks>' AS origin FROM p WHERE k % 5 <> 4)
SELECT 'T:Shop.P' || s AS id, '<summary>' || p_name || ' of ' || p_type || '</summary>' || origin AS body FROM found
UNION ALL SELECT 'M:Shop.P' || s || '.Do(System.Int32,System.Single)', '<summary>Does it &amp; more, <code>a &lt; ' || z || '</code></summary><param name="n">Needs &lt;' || p_brand || '&gt;</param>' || CASE WHEN k % 3 = 0 THEN '<returns>e^' || z || '</returns>' ELSE '' END || origin FROM found
UNION ALL SELECT 'F:Shop.P' || s || '.size', '<summary>' || z || '</summary>' || origin FROM found WHERE k % 2 = 0
UNION ALL SELECT 'API:P' || s, 'page title names no type' FROM p WHERE k % 5 = 4
UNION ALL SELECT 'Shop.P' || s || '.Gone()', 'type exists, no member with this name' FROM found WHERE k % 2 = 1""")
def wiki_pages(spark, sf_dir):
    """Parts as pages of a wiki export, written as one file: templates with nested ones, links, marks and code; placeholders; pages and
    members that no symbol has."""
    part = table(spark, sf_dir, "part")
    k, z = F.col("p_partkey"), F.col("p_size")
    returns = F.when(k % 3 == 0, joined("e<sup>", z, "</sup>")).otherwise(F.lit("? Summary goes here."))
    last = F.when(k % 2 == 0, joined("{{Field|name=size|desc=? ", z, "}} {{field |name=other|desc=description goes here}}")).otherwise(F.lit("{{Method|name=Gone|desc=None left|args=}}"))
    text = joined("{{Class|summary='''", F.col("p_name"), "''' of [[API:X|''", F.col("p_type"), "'']]}}\n== Methods ==\n{{method|name=Do|args={{arg|int|n|desc=Needs <", F.col("p_brand"), ">}}, float x|desc=Does<br/>it &amp; more, <source lang=c>a < ", z, "</source>|returndesc=", returns, "}}\n", last)
    page = joined("<page><title>API:P", k, "</title><revision><timestamp>2020-01-", F.lpad((k % 28 + 1).cast("string"), 2, "0"), "T00:00:00Z</timestamp><text>", escape(text), "</text></revision></page>\n")
    other = joined("<page><title>P", k, "</title><revision><timestamp>x</timestamp><text>{{Class|summary=wrong}}</text></revision></page>\n")
    ends = spark.createDataFrame([(-1, f'<mediawiki xmlns="{EXPORT}" xml:lang="en">\n'), (1 << 60, "</mediawiki>\n")], "at long, line string")
    lines = part.select(k.alias("at"), F.concat(page, other).alias("line")).unionByName(ends).withColumn("file", F.lit("export.xml.wiki"))
    folder = new_path(spark, "wiki")
    write_files(lines, ["at"], folder)
    types = symbol(part.where(k % 5 != 4), 0, "NamedType", joined("T:Shop.P", k), joined("P", k), F.lit("Shop"))
    do = symbol(part, 1, "Method", joined("M:Shop.P", k, ".Do(System.Int32,System.Single)"), F.lit("Do"), joined("Shop.P", k), ["int", "float"], ["n", "x"])
    size = symbol(part, 2, "Field", joined("F:Shop.P", k, ".size"), F.lit("size"), joined("Shop.P", k))
    layer = layers_of.wiki_layer(spark, f"{folder}/export.xml.wiki", symbols_of(types, do, size))
    return layer.docs.select("id", render(F.col("doc")).alias("body")).unionByName(layer.unmatched.select(F.col("entry").alias("id"), F.col("reason").alias("body")))


@query("""WITH p AS (SELECT p_partkey AS k, CAST(p_partkey AS VARCHAR) AS s, p_name, CAST(p_size AS VARCHAR) AS z, max(p_partkey) OVER () AS top FROM part),
good AS (SELECT * FROM p WHERE k % 7 <> 3)
SELECT 'T:Shop.P' || s AS id, '<summary>' || CASE WHEN k % 2 = 0 THEN '<para>' || p_name || ' R&amp;D</para><para>Size <b>' || z || '</b> - fine.</para>' ELSE p_name || ' R&amp;D' END || '</summary>' AS body FROM good
UNION ALL SELECT 'M:Shop.P' || s || '.Do(System.Int32,System.Single@)', '<summary>See ' || CASE WHEN k < top AND (k + 1) % 7 <> 3 THEN '<see cref="T:Shop.P' || CAST(k + 1 AS VARCHAR) || '"/>' ELSE 'next &gt;' END || ' &amp; rest.</summary><param name="n">How <i>many</i></param><returns>All ' || z || '</returns><remarks>See also: ' || z || '</remarks>' FROM good
UNION ALL SELECT 'F:Shop.P' || s || '.Mode.On', '<summary>Runs ' || z || '</summary>' FROM good
UNION ALL SELECT 'Shop.P' || s || '.Mode.Off', 'enum exists, no value with this name' FROM good
UNION ALL SELECT 'Shop.P' || s || '.Lost()', 'type exists, no member with this name' FROM good WHERE k % 3 = 0
UNION ALL SELECT 'files that are not well-formed', CAST(count(*) AS VARCHAR) FROM p WHERE k % 7 = 3""")
def described_files(spark, sf_dir):
    """Parts as files of descriptions: types, members and values of enums with marks, references to the next part's type, parameters that a
    symbol lacks, stray ampersands, and files that are cut off."""
    part = table(spark, sf_dir, "part")
    k, z = F.col("p_partkey"), F.col("p_size")
    more = F.when(k % 2 == 0, joined("<para>Size <bold>", z, "</bold> <ndash/> fine.</para>")).otherwise(F.lit("<para> </para>"))
    lost = F.when(k % 3 == 0, "<memberdef kind='function' id='l'><name>Lost</name><argsstring>()</argsstring><type>void</type><briefdescription><para>x</para></briefdescription></memberdef>").otherwise(F.lit(""))
    text = joined(
        "<?xml version='1.0' encoding='UTF-8'?><doxygen><compounddef kind='class' id='c", k, "'><compoundname>Shop::P", k, "</compoundname><location file='R&D/x'/><briefdescription><para>", escape(F.col("p_name")), " R&D</para></briefdescription><detaileddescription>", more, "</detaileddescription><sectiondef>",
        "<memberdef kind='function' id='m", k, "' static='no'><name>Do</name><argsstring>(int n, ref float x)</argsstring><type>void</type><param><type>int</type><declname>n</declname></param><param><type>ref float</type><declname>x</declname></param><briefdescription><para>See <ref kindref='compound' refid='c", k + 1, "'>next &gt;</ref> &amp; rest.</para></briefdescription>",
        "<detaileddescription><para><parameterlist kind='param'><parameteritem><parameternamelist><parametername>n</parametername></parameternamelist><parameterdescription><para>How <emphasis>many</emphasis></para></parameterdescription></parameteritem><parameteritem><parameternamelist><parametername>gone</parametername></parameternamelist><parameterdescription><para>y</para></parameterdescription></parameteritem></parameterlist><simplesect kind='return'><para>All ", z, "</para></simplesect><simplesect kind='author'><para>me</para></simplesect><simplesect kind='see'><para>", z, "</para></simplesect></para></detaileddescription></memberdef>", lost,
        "<memberdef kind='enum' id='e", k, "'><name>Mode</name><enumvalue id='v", k, "'><name>On</name><briefdescription><para>Runs ", z, "</para></briefdescription></enumvalue><enumvalue id='w'><name>Off</name><briefdescription><para>Not</para></briefdescription></enumvalue><briefdescription/></memberdef></sectiondef></compounddef>", F.when(k % 7 == 3, "").otherwise("</doxygen>"),
    )
    types = symbol(part, 0, "NamedType", joined("T:Shop.P", k), joined("P", k), F.lit("Shop"))
    modes = symbol(part, 1, "NamedType", joined("T:Shop.P", k, ".Mode"), F.lit("Mode"), joined("Shop.P", k))
    on = symbol(part, 2, "Field", joined("F:Shop.P", k, ".Mode.On"), F.lit("On"), joined("Shop.P", k, ".Mode"))
    do = symbol(part, 3, "Method", joined("M:Shop.P", k, ".Do(System.Int32,System.Single@)"), F.lit("Do"), joined("Shop.P", k), ["int", "float"], ["n", "x"])
    layer = layers_of.official_entries(archive_entries(part.select(k.cast("int").alias("i"), F.encode(text, "utf-8").alias("data"))), symbols_of(types, modes, on, do))
    bad = layer.steps.where("step = 'unparseable files'").agg(F.count("*").cast("string").alias("body")).select(F.lit("files that are not well-formed").alias("id"), "body")
    return layer.docs.select("id", render(F.col("doc")).alias("body")).unionByName(layer.unmatched.select(F.col("entry").alias("id"), F.col("reason").alias("body"))).unionByName(bad)
