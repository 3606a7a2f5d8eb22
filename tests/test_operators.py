"""Operators on rows with hot keys, ties, nulls and changes, against plain versions."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from doclattice.operators import spread
from doclattice.operators.delta import delta_merge, incremental
from doclattice.operators.edits import apply_edits, found_edits
from doclattice.operators.merge import least_rows, merge_counts, merge_steps, priority_merge
from doclattice.operators.references import resolve_references
from doclattice.operators.resolve import candidates, member_index, resolve_members, tier_counts
from doclattice.operators.walk import leaves, walk


@pytest.fixture
def any_is_hot(monkeypatch):
    monkeypatch.setattr(spread, "LEAST_HOT", 5)
    monkeypatch.setattr(spread, "MOST_HOT", 20)


def entries(spark, n=600):
    """A third of the rows have one id; some ids are null; some rows tie, some repeat."""
    r = random.Random(n)
    rows = [("hot" if r.random() < 0.34 else r.choice(["a", "b", "c", None]) or f"x{r.randrange(60)}", r.choice("pqr"), r.randrange(3), r.choice([None, *range(4)]), r.randrange(3)) for i in range(n)]
    rows += [(None, "p", 1, 1, 1)] * 7
    return spark.createDataFrame(rows, "id string, source string, prio int, ord int, t int").repartition(6), rows


def test_merge_of_hot_ids(spark, any_is_hot):
    df, rows = entries(spark)
    got = priority_merge(df, tell=["source"])
    assert "Window" not in got._jdf.queryExecution().toString()
    out = got.collect()
    assert sorted(map(repr, (tuple(x)[:5] for x in out))) == sorted(map(repr, rows))
    low = lambda x: (x[2], x[3] is not None, x[3] or 0)
    for key in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == key]
        first = [x for x in out if x.id == key and x.written]
        assert len(first) == 1 and low(first[0]) == min(map(low, own))
        assert {x.winner_source for x in out if x.id == key} == {first[0].source}
    least = least_rows(df, ["id"], ["prio", "ord"]).collect()
    assert len(least) == len({x[0] for x in rows}) and all(low(x) == min(low(y) for y in rows if y[0] == x.id) for x in least)
    assert least_rows(df.limit(0), ["id"], ["prio"]).count() == 0 and priority_merge(df.limit(0)).count() == 0


def test_merge_counts(spark):
    df, rows = entries(spark, 300)
    df = df.withColumn("ord", F.monotonically_increasing_id())
    df = spark.createDataFrame(df.collect(), df.schema)
    place = Window.partitionBy("id").orderBy("prio", "ord", "source")
    want = {(x.source): (x.n, x.w) for x in df.withColumn("k", F.row_number().over(place)).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("k") == 1).alias("w")).collect()}
    assert {x.source: (x.documented, x.written) for x in merge_counts(df).collect()} == want
    steps = {(x.source, x.step): x.n for x in merge_steps(merge_counts(df.where("id = 'hot' and source = 'p'"))).collect()}
    n = df.where("id = 'hot' and source = 'p'").count()
    assert steps == {("p", "symbols documented"): n, ("p", "entries written"): 1, ("p", "already documented by a higher-priority source"): n - 1}


def test_hot_rows_are_dealt_to_all_tasks(spark, any_is_hot):
    table = spread.written(spark.createDataFrame([("hot", "H", 3000), ("x", "X", 10), (None, "N", 8)], "k string, v string, n long"), "t")
    rows = spark.range(3018).select("id", F.when(F.col("id") < 3000, "hot").when(F.col("id") < 3010, "x").alias("k"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = spread.told(rows, table, ["k"], ["id"]).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(x.k, x.found.v) for x in got} == {("hot", "H"), ("x", "X"), (None, "N")} and len(got) == 3018
    by_task = [sum(x.task == t for x in got) for t in {x.task for x in got}]
    assert len(by_task) == 4 and max(by_task) < 1.5 * 3018 / 4


def test_hot_names_narrow_as_others(spark, monkeypatch):
    """One name with most of all members, asked for many times: the same answers, with and without salting."""
    r = random.Random(4)
    rows = [(i, f"id{i}", r.choice(["Method", "Field"]), "Run" if i % 3 else r.choice(["run", "IX.Run", "Go"]), "A.B" if i % 5 else "A.C", [r.choice(["int", "A.E", "E", f"T{i % 40}"])], ["p"], ["None"], 0) for i in range(400)]
    syms = spark.createDataFrame(rows, "ord long, id string, kind string, name string, type string, ptypes array<string>, pnames array<string>, prefs array<string>, tparams int")
    asks = [(i, "A.B", r.choice(["Run", "RUN", "Go", "Nix"]), r.choice([None, "Method"]), 1, [r.choice(["E", f"T{r.randrange(40)}"])], 0, None) for i in range(200)]
    df = spark.createDataFrame(asks, "ord int, scope string, name string, kind string, arity int, ptypes array<string>, tparams int, prefs array<string>")
    run = lambda: sorted((x.ord, x.sym.id if x.sym else "", x.reason) for x in resolve_members(df, member_index(syms)).collect())
    tiers = lambda: sorted(map(tuple, tier_counts(df, member_index(syms)).collect()), key=repr)
    plain, counted = run(), tiers()
    monkeypatch.setattr(spread, "LEAST_HOT", 5)
    monkeypatch.setattr(spread, "MOST_HOT", 20)
    assert run() == plain and tiers() == counted and sum(x[1] != "" for x in plain) > 5
    own = [x for x in rows if x[3] == "Run" and x[4] == "A.B"]
    assert [x for x in counted if x[1] == "Run"] == [("A.B", "Run", 1, own[0][1], len(own))]
    got = candidates(df, member_index(syms)).where("name = 'Run'").collect()
    assert sorted(x.member.id for x in got) == sorted(x[1] for x in own) and {x.tier for x in got} == {1}


def test_changes_are_ranked_alone(spark, tmp_path, any_is_hot):
    r = random.Random(9)
    rows = [("hot" if i % 3 == 0 else f"k{i % 50}", r.choice("pq"), r.randrange(9), i, f"t{i}") for i in range(400)] + [(None, "p", 0, 1000, "null")]
    frame = lambda rows: spark.createDataFrame(rows, "id string, source string, prio int, ord int, text string").repartition(3)
    state = str(tmp_path / "state")
    whole = lambda rows: sorted(map(repr, (tuple(x) for x in least_rows(frame(rows), ["id"], ["prio", "ord"]).collect())))
    first = delta_merge(frame(rows), state).collect()
    assert all(x.again for x in first) and sorted(repr(tuple(x)[:-1]) for x in first) == whole(rows)
    same = delta_merge(frame(rows[::-1]), state).collect()
    assert not any(x.again for x in same) and sorted(repr(tuple(x)[:-1]) for x in same) == whole(rows)
    new = [x for x in rows if x[0] not in ("k7", None)] + [("k1", "p", -1, 2000, "new"), ("k8", "p", 5, 3000, "more"), ("k8", "p", 5, 3000, "more"), ("came", "q", 1, 1, "x")]
    got = delta_merge(frame(new), state).collect()
    assert {x.id for x in got if x.again} == {"k1", "k8", "came"} and sorted(repr(tuple(x)[:-1]) for x in got) == whole(new)
    twice = [*new, ("k8", "p", 5, 3000, "more"), ("hot", "p", -5, 0, "first")]  # a row that repeats once more counts
    got = delta_merge(frame(twice), state).collect()
    assert {x.id for x in got if x.again} == {"k8", "hot"} and sorted(repr(tuple(x)[:-1]) for x in got) == whole(twice)


def test_changes_of_either_input_count(spark, tmp_path):
    """Entries are resolved again if they or the members of their name have changed; rows that are computed are those of these keys."""
    seen = []

    def compute(asked, known):
        seen.append((asked.count(), known.count()))
        return asked.join(known, "k", "left").groupBy("k").agg(F.max("v").alias("v"))

    asked = lambda ks: spark.createDataFrame([(k,) for k in ks], "k int").withColumn("w", F.lit("x"))
    known = lambda pairs: spark.createDataFrame(pairs, "k int, v string")
    run = lambda a, b: {x.k: (x.v, x.again) for x in incremental({"asked": asked(a), "known": known(b)}, ["k"], str(tmp_path / "s"), compute).collect()}
    assert run([1, 2, 3], [(1, "a"), (2, "b")]) == {1: ("a", True), 2: ("b", True), 3: (None, True)}
    assert run([1, 2, 3], [(1, "a"), (2, "c")]) == {1: ("a", False), 2: ("c", True), 3: (None, False)}
    assert run([1, 3, 4], [(1, "a"), (2, "c")]) == {1: ("a", False), 3: (None, False), 4: (None, True)}
    assert seen[1] == (1, 1) and seen[2] == (1, 1)


def test_references_are_put_back_in_their_places(spark, any_is_hot):
    texts = [(1, "a <r=x>b<r=y><r=x> c"), (2, "none"), (3, None), (4, ""), (5, "<r=z>"), (6, "<r=x>" * 30 + "!"), (7, "<r=>")]
    df = spark.createDataFrame(texts, "k int, text string")
    targets = spark.createDataFrame([("x", "X&"), ("y", "Y"), ("q", "Q")], "ref string, target string")
    got = {x.k: (x.resolved, x.references, x.hits) for x in resolve_references(df, "k", "text", "<r=([^>]*)>", targets, lambda m, r, t: F.coalesce(F.concat(F.lit("["), t, F.lit("]")), F.upper(r))).collect()}
    assert got == {1: ("a [X&]b[Y][X&] c", 3, 3), 2: ("none", 0, 0), 3: (None, 0, 0), 4: ("", 0, 0), 5: ("Z", 1, 0), 6: ("[X&]" * 30 + "!", 30, 30), 7: ("", 1, 0)}


def test_edits(spark):
    r = random.Random(3)
    docs = [(i, "".join(r.choice("abcé😀 ") for _ in range(r.randint(0, 25)))) for i in range(60)] + [(100, None)]
    edits = []
    for i, t in docs:
        for _ in range(r.choice([0, 1, 3, 8])):
            a = r.randint(0, 26)
            edits.append((i, a, a + r.choice([0, 0, 1, 2, 5]), r.choice(["", "X", "YY"])))
    edits += [(0, -1, 2, "x"), (1, 3, 2, "x"), (999, 0, 0, "x"), (2, None, 1, "x")] + [(5, 0, 0, "same")] * 9

    def plain(i, t):
        mine = [e[1:] for e in edits if e[0] == i]
        ok = sorted({(a, b, n) for a, b, n in mine if t is not None and a is not None and 0 <= a <= b <= len(t)})
        made, last, kinds = [], 0, set()
        for a, b, n in ok:
            if (a, a == b) not in kinds and a >= last:
                made.append((a, b, n))
                last = b
            kinds.add((a, a == b))
        for a, b, n in reversed(made):
            t = t[:a] + n + t[b:]
        return t, len(made), len(mine) - len(made)

    df = spark.createDataFrame(docs, "k int, text string")
    got = {x.k: (x.edited, x.n_edits, x.n_rejected) for x in apply_edits(df, spark.createDataFrame(edits, "k int, start int, end int, new string").repartition(3), "k", "text").collect()}
    assert got == {i: plain(i, t) for i, t in docs} and sum(x[1] for x in got.values()) > 40 and sum(x[2] for x in got.values()) > 20
    found = found_edits(df, "k", "text", "[ab]+", "-")
    once = apply_edits(df, found, "k", "text").select("k", F.col("edited").alias("text"))
    assert found_edits(once, "k", "text", "[ab]+", "-").count() == 0 and found.count() > 50
    assert all(x.text[x.start : x.end].strip("ab") == "" for x in df.join(found, "k").collect())


def test_walks(spark, any_is_hot):
    edges = [("r", "a", "a"), ("r", "b", "b"), ("a", "c", "c"), ("b", "c", "c"), ("c", "r", "up"), ("c", "d", "d"), ("d", "d", "self"), (None, "x", "x"), ("z", "y", "y"), ("b", None, "n")] + [("a", f"leaf{i}", f"l{i}") for i in range(40)]
    df = spark.createDataFrame(edges, "parent string, child string, name string")
    got = {x.node: (x.depth, x.path) for x in walk(df, spark.createDataFrame([("r", "R"), (None, "N")], "node string, name string")).collect()}
    assert got == {"r": (0, "R"), "a": (1, "R/a"), "b": (1, "R/b"), "c": (2, "R/a/c"), "d": (3, "R/a/c/d"), **{f"leaf{i}": (2, f"R/a/l{i}") for i in range(40)}}
    assert walk(df.limit(0), spark.createDataFrame([], "node string, name string")).count() == 0


def test_leaves_of_nested_values(spark):
    rows = [(1, '{"a":[1,{"b":null,"c":[[true]]}],"d":"x"}'), (2, "[]"), (3, None), (4, "7"), (5, '{"a.b":{"":2}}')]
    df = spark.createDataFrame(rows, "k int, j string").select("k", F.parse_json("j").alias("v"))
    got = sorted((x.k, x.path, x.leaf) for x in leaves(df, ["k"], "v").collect())
    assert got == [(1, "$.a[0]", "1"), (1, "$.a[1].b", None), (1, "$.a[1].c[0][0]", "true"), (1, "$.d", "x"), (4, "$", "7"), (5, "$.a.b.", "2")]
