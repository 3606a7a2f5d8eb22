"""The corpus pipeline's stages on made-up documents."""

import random
import re

import pytest
from test_brute_force import components, library, shingles

pytest.importorskip("public_tokenizers")

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def page(r, lines=6):
    return "\n".join(" ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(12)) for _ in range(lines))


def test_one_of_a_large_group_of_copies_stays(spark):
    """A third of one source is one document, and 5 pages of a small source are another: one copy of each stays, whole."""
    from corpus_pipeline import line_stage, near_dup_stage

    r = random.Random(8)
    first, second = page(r), page(r)
    rows = [(i, first if i % 3 == 0 else page(r) + "\nmenu", "en", "large") for i in range(60)] + [(100 + i, second if i < 5 else page(r), "en", "small") for i in range(40)]
    docs = spark.createDataFrame([(*x, len(x[1])) for x in rows], COLUMNS)
    lines = line_stage(spark, docs, "").cache()
    assert lines.count() == 100 and {x.text for x in lines.where("doc_id % 3 = 0 and source = 'large'").collect()} == {first}
    assert not any("menu" in x.text for x in lines.collect())
    got = {x.doc_id: (x.text, x.n_chars) for x in near_dup_stage(spark, lines, "").collect()}
    assert [i for i, (t, _) in got.items() if t == first] == [0] and [i for i, (t, _) in got.items() if t == second] == [100]
    assert len(got) == 40 + 1 + 35 + 1 and all(n == len(t) for t, n in got.values())


def without_frequent(rows):
    """(doc_id, text, source) with the lines gone that over a tenth and at least 2 of a source's rows hold, unless all would go."""
    pages, held = {}, {}
    for _, t, s in rows:
        pages[s] = pages.get(s, 0) + 1
        for x in {x.strip() for x in (t or "").split("\n")} - {""}:
            held[s, x] = held.get((s, x), 0) + 1
    out = []
    for i, t, s in rows:
        left = [x for x in t.split("\n") if not (held.get((s, x.strip()), 0) >= 2 and held[s, x.strip()] > 0.1 * pages[s])]
        out.append((i, "\n".join(left) if any(x.strip() for x in left) else t, s))
    return out


def without_copies(rows):
    """Of each group of near duplicates the rows of the least id; rows without an id stay."""
    ids = sorted({i for i, _, _ in rows if i is not None})
    text = {i: t for i, t, _ in rows}
    sets = [shingles(text[i]) for i in ids]
    links = [(a, b) for a in range(len(ids)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0]
    first = dict(zip(ids, (ids[c] for c in components(len(ids), links)), strict=True))
    return [x for x in rows if x[0] is None or first[x[0]] == x[0]]


def redacted(text):
    """Without the secrets of the fixture: labelled ones with their key word, bare hexadecimal and AKIA ones."""
    return re.sub(r"""(?i:token|secret)\x20?[:=]\x20?[0-9a-fx_]+|AKIA[A-Z0-9]{16}|[0-9a-f]{24,}""", "[SECRET]", text)


def test_all_stages(spark):
    """Every stage against a plain version, on copies, near copies, boilerplate, nulls, repeated rows and secrets."""
    from corpus_pipeline import STAGES

    r = random.Random(13)
    hexes = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    rows = []
    for i in range(90):
        secret = [f"\ntoken = {hexes()}", f"\n{hexes()} x", f"\nAKIA{hexes()[:16].upper()}", "", "", ""][i % 6]
        rows.append((i, f"  menu \n{page(r)}{secret}\n\nfoot{i % 3}", f"s{i % 3}"))
    first = page(r)
    rows += [(100 + i, first, "s0") for i in range(20)]  # exact copies, all lines frequent
    rows += [(130 + i, rows[7][1].replace("\nAKIA", f"\nextra{i} AKIA"), "s1") for i in range(3)]  # near copies of 7
    rows += [(None, page(r), "s2"), (None, rows[8][1], "s2"), (150, None, "s0"), (None, None, None), (151, "12 3 !", "s1"), (152, "", "s1"), (153, page(r), None), (154, " menu", "s2"), rows[11]]
    strange = "Ωψϖ ϗϙϛ ϝϟϡ ϣϥϧ ϩϫϭ ϯϰϱ"
    rows += [(155, strange, "s2"), (156, None, None)]
    docs = spark.createDataFrame([(i, t, None if i == 3 else "en", s, None if t is None else len(t), "x") for i, t, s in rows], COLUMNS + ", TEXT string").repartition(3)
    want = [x for x in rows if any(c.isalpha() for c in x[1] or "") and x[1] != strange]
    plain = {"language": want}
    plain["lines"] = without_frequent(plain["language"])
    plain["near_dups"] = without_copies(plain["lines"])
    plain["secrets"] = [(i, redacted(t), s) for i, t, s in plain["near_dups"]]
    for name, stage in STAGES:
        docs = stage(spark, docs, "").cache()
        if name in plain:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            got = [(x.doc_id, x.text, x.source) for x in docs.collect()]
            assert sorted(map(repr, got)) == sorted(map(repr, plain[name])), name
            assert all(x.n_chars == len(x.text) and x.lang == "en" for x in docs.collect()), name
    kept = {i for i, _, _ in plain["secrets"]}
    assert 100 in kept and not kept & set(range(101, 120)) and 7 in kept and not kept & {130, 131, 132}
    ids = library("word_bpe_49k.json")
    pieces = sorted((str(i), k, min(2048, n - at)) for i, t, _ in plain["secrets"] for n in [len(ids(t)) + 1] for k, at in enumerate(range(0, n, 2048)))
    rows = docs.collect()
    assert sorted((str(x.doc_id), x.piece, x.length) for x in rows) == pieces
    held = {}
    for x in rows:
        held.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for x in held.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(x[-1]) <= 2048


def test_run_and_empty_tables(spark, tmp_path):
    """``run`` gives the last stage's rows and leaves one table behind; without documents every stage gives none."""
    import corpus_pipeline as pipeline
    from doclattice.llm import shared

    r = random.Random(14)
    rows = [(i, page(r, 2), "en", "s", 5) for i in range(30)] + [(40, " ".join(["word"] * 300_000), "en", "s", 5)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    folder = f"{shared.shared_dir(spark)}/{spark.sparkContext.applicationId}".removeprefix("file://")
    import os

    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    got = pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in got} == {*range(30), 40} and sum(x.doc_id == 40 for x in got) > 100
    assert len(set(os.listdir(folder)) - before) == 1
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
