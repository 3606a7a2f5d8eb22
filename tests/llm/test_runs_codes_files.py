"""Word runs, vector codes and token files against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")


def plain_runs(w, exponent=4, least=6):
    """(start, length, period) by trying all periods."""
    found = set()
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - s
            if n >= max(least, exponent * q) and not any(all(w[s + k] == w[s + k + d] for k in range(n - d)) for d in range(1, q)):
                found.add((s, n, q))
            i += 1
    return found


def planted(doc_id, w):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_digests(doc_id, text, rewrite=True):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    w = planted(doc_id, w) if rewrite else w
    runs = sorted(plain_runs(w), key=lambda r: (r[0], r[2]))
    best = min(runs, key=lambda r: (-(r[1] * 10**12 // r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    text = " ".join(x for i, x in enumerate(w) if i not in gone)
    lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def periodic_words(r):
    n, k = r.randint(0, 90), r.choice([1, 2, 3, 5, 30])
    w = [f"w{r.randrange(k)}" for _ in range(n)]
    for _ in range(r.choice([0, 1, 2])):
        if n:
            a = r.randrange(n)
            p = r.randint(1, max(1, (n - a) // 3))
            b = min(n, a + r.randint(2, 9) * p)
            w = [w[i] if not a <= i < b else w[a + (i - a) % p] for i in range(n)]
    return w


def test_runs_of_small_sequences():
    from doclattice.llm.word_runs import lyndon_runs, stretches

    r = random.Random(5)
    n = 0
    for _ in range(500):
        texts = [periodic_words(r) for _ in range(r.randint(1, 4))]
        sizes = np.array(list(map(len, texts)))
        ends, doc = np.cumsum(sizes), np.repeat(np.arange(len(texts)), sizes)
        ids = np.array([int(x[1:]) for t in texts for x in t], np.int32)
        got = [set() for _ in texts]
        for s, e in stretches(ids, doc, ends):
            first = s - int(ends[doc[s]] - sizes[doc[s]])
            got[doc[s]] |= {(first + a, b, c) for a, b, c in lyndon_runs(ids[s:e].tolist())}
        want = [plain_runs(t) for t in texts]
        assert got == want
        assert [lyndon_runs([int(x[1:]) for x in t]) for t in texts] == want
        n += sum(map(len, want))
    assert n > 400


def test_runs_do_not_hang_on_hashes(monkeypatch):
    """With a base that makes most hashes equal the words decide, and the runs are the same."""
    from doclattice.llm import word_runs

    r = random.Random(6)
    texts = [[int(x[1:]) for x in periodic_words(r)] for _ in range(200)]
    want = [word_runs.lyndon_runs(t) for t in texts]
    monkeypatch.setattr(word_runs, "BASE", 0)
    monkeypatch.setattr(word_runs, "NEAR", 1)
    assert [{x for x in word_runs.lyndon_runs(t) if x not in w} for t, w in zip(texts, want, strict=True)] == [set()] * len(texts)


def test_runs_of_long_sequences():
    """In near to linear time: one word, two in turn, a Fibonacci word, a part of 30,000 words four times."""
    from doclattice.llm.word_runs import lyndon_runs

    a, b = [0], [0, 1]
    while len(b) < 60_000:
        a, b = b, b + a
    assert lyndon_runs([7] * 60_000) == {(0, 60_000, 1)}
    assert lyndon_runs([9, *[0, 1] * 30_000, 3]) == {(1, 60_000, 2)}
    assert lyndon_runs(b) == set()
    assert lyndon_runs([*range(30_000)] * 4 + [0, 1, 5]) == {(0, 120_002, 30_000)}


@pytest.fixture(scope="module")
def periodic(spark):
    r = random.Random(8)
    seps = [" ", "\n", "\t\v", "\f \r"]
    texts = ["".join(x + r.choice(seps) for x in periodic_words(r)) for _ in range(150)]
    texts += [None, "", " \n\t", "one", "la " * 500, "a b " * 50 + "é é é é é é é  x", "x\x1cy x\x1cy " * 9, "A a A a A a A a"]
    rows = [(i, t, "s", i) for i, t in enumerate(texts)] + [(None, "z " * 10, "s", 1), (5, texts[5], "s", 1), (5, "q " * 9, "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, TEXT_2 string, Start long").repartition(3)


def test_word_runs(spark, periodic):
    from doclattice.llm.word_runs import repeated_tail, run_digests, without_repeats, word_runs

    rows = periodic.collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[-1])
    for rewrite in (repeated_tail, None):
        got = sorted((tuple(x) for x in run_digests(periodic, rewrite).collect()), key=key)
        want = sorted((plain_digests(x.doc_id, x.text, rewrite is not None) for x in rows), key=key)
        assert got == want
        assert sum(x[1] for x in want) > 60
    each = word_runs(periodic)
    assert sorted((x.doc_id or -1, x.start, x.length, x.period) for x in each.collect()) == sorted((x.doc_id or -1, *q) for x in rows for q in plain_runs((x.text or "").split(" ") if x.text and set(x.text) <= set("laz q") else re.findall("[^\x20\x09-\x0d]+", x.text or "")))
    short = {x.doc_id: x.text for x in without_repeats(periodic.where("doc_id >= 150")).collect()}
    assert short[154] == "la" and short[155].startswith("a b é x") and short[153] == "one" and short[150] == ""
    empty = run_digests(periodic.limit(0))
    assert empty.count() == 0 and empty.columns[:2] == ["doc_id", "n_runs"]


def test_word_runs_of_the_test_data(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    from doclattice.llm.queries import QUERIES

    got = {x.doc_id: tuple(x) for x in QUERIES["op11_word_runs"](spark, "/root/testdata/sf0.001").collect()}
    rows = [x for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect() if len(x.text or "") < 6000]
    assert len(rows) > 100
    for x in rows:
        assert got[x.doc_id] == plain_digests(x.doc_id, x.text)


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error, digest) by whole Lloyd rounds in Python's integers; rows (vec_id, vector, label)."""
    import math

    kept = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = [[tuple(v[p * w : p * w + w]) for p in range(parts)] for _, v, _ in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda: [[min(range(len(books[p])), key=lambda e: (far(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        near = pick()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, n in zip(cut, near, strict=True) if n[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    near = pick()
    errors = [sum(far(c[p], books[p][n[p]]) for p in range(parts)) for c, n in zip(cut, near, strict=True)]
    total = {}
    for (_, _, c), e in zip(kept, errors, strict=True):
        total[c] = total.get(c, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{x:02x}" for x in n), e, total[c], digest) for (i, _, c), n, e in zip(kept, near, errors, strict=True)]


def vectors_of(seed, n, dim, grid):
    """Vectors of few or many values: those of few have many equal distances."""
    r = random.Random(seed)
    value = (lambda: r.choice([-1.0, -0.5, 0.0, 0.25, 1.0])) if grid else (lambda: r.gauss(0, 0.4))
    rows = [(i * 7 % (n + 9), [value() for _ in range(dim)], r.choice([1, 1, 1, 2, 3, None])) for i in range(n)]
    rows += [(10_000 + i, rows[0][1], 1) for i in range(60)]
    rows += [(3, None, 1), (4, [], 1), (5, [None] * dim, 2), (6, [float("nan")] * dim, 2), (7, [*[0.5] * (dim - 1), float("inf")], None), (None, [0.125] * dim, 2), (rows[5][0], rows[6][1], 3)]
    return rows


@pytest.mark.parametrize("n, dim, grid", [(300, 32, False), (400, 32, True), (20, 16, False), (250, 64, True)])
def test_vector_codes(spark, n, dim, grid):
    from doclattice.llm.vector_codes import code_digests

    rows = vectors_of(n, n, dim, grid)
    frame = spark.createDataFrame([(*x, "y", 1) for x in rows], "vec_id long, embedding array<float>, label int, Code string, ERROR int").repartition(5)
    rows = [(x.vec_id, x.embedding, x.label) for x in frame.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted((tuple(x) for x in code_digests(frame).collect()), key=key) == sorted(plain_codes(rows), key=key)


def test_vector_codes_of_odd_tables(spark):
    from doclattice.llm.vector_codes import code_digests, vector_codes

    kind = "vec_id long, embedding array<float>, label int"
    assert code_digests(spark.createDataFrame([], kind)).count() == 0
    assert code_digests(spark.createDataFrame([(1, None, 1), (2, [], None)], kind)).count() == 0
    assert code_digests(spark.createDataFrame([(1, [1.0] * 15, 1)], kind)).count() == 0
    one = code_digests(spark.createDataFrame([(4, [0.5] * 16, 1), (9, [0.5] * 32, 1)], kind)).collect()
    assert [(x.vec_id, x.code, x.error, x.label_error) for x in one] == [(4, "00" * 16, 0, 0)]
    huge = code_digests(spark.createDataFrame([(i, [3e38 * (-1) ** i] * 16, 1) for i in range(70)], kind)).collect()
    assert {x.error for x in huge} == {0} and len(huge) == 70
    with pytest.raises(ValueError):
        vector_codes(spark.createDataFrame([], kind), entries=300)


def test_bounds_prune_and_hold():
    """Through rounds of moving entries, with bounds as they are written, the entries are those of a full search, for fewer distances."""
    from doclattice.llm.vector_codes import State, nearest_by_bounds, nearest_of_all, shifted, squared

    r = np.random.default_rng(4)
    centres = r.integers(-300, 300, (12, 4))
    points = (centres[r.integers(0, 12, 4000)] + r.integers(-20, 20, (4000, 4))).astype(np.int64)
    points[:500] = r.integers(-2, 2, (500, 4))
    old = points[r.choice(4000, 32, False)]
    near, _, upper, lower = nearest_of_all(points, old)
    asked = 0
    for _ in range(6):
        new = np.array([points[near == e].sum(0) // max(1, (near == e).sum()) if (near == e).any() else old[e] for e in range(32)])
        state = State(1, 32)
        import pyarrow as pa

        near, upper, lower = (a[:, 0] for a in state.unpack(*(pa.array(x, pa.binary()) for x in state.pack(near[:, None], upper[:, None], lower[:, None]))))
        up, low = shifted(upper, lower, near, old, new)
        d = squared(points, new)
        assert (up >= np.sqrt(d[np.arange(4000), near])).all() and (low <= np.sqrt(d)).all()
        near, upper, lower, n = nearest_by_bounds(points, new, near, up, low)
        assert (near == d.argmin(1)).all()
        asked, old = asked + n, new
    assert asked < 6 * 4000 * 32 / 3


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def odd_texts(r):
    pieces = ["the", " and", "don't", "we'LL", "  ", "\n\n", "\t", " ", " ", "\x1c", "\x85", "é", "ß", "日本", "текст", "😀", "1234", "٣", "½", "!!", "<|endoftext|>", "<|end", "_", "a" * 60, "́", "ǅ", "﻿", "\x00"]
    return ["".join(r.choice(pieces) for _ in range(r.randint(0, 40))) for _ in range(300)]


def test_byte_words_as_the_library():
    from doclattice.llm.token_files import ByteWords

    words, plain = ByteWords(public_tokenizers.path("byte_bpe_50k.json")), library()
    for text in [*odd_texts(random.Random(11)), "", "a", " ", "x " * 3000]:
        assert np.frombuffer(words.ids(text), "<u2").tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.fixture(scope="module")
def texts_to_write(spark):
    r = random.Random(12)
    texts = [None, "", *odd_texts(r), "long text " * 20_000]
    rows = [(r.choice([i, i, -i, 7, None]), t, "s", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, Start long, FRAME int".replace("Start long", "Start string")).repartition(5)


def test_token_files(spark, texts_to_write, monkeypatch):
    from doclattice.llm import token_files as tf

    monkeypatch.setattr(tf, "READ_BYTES", 2000)
    plain = library()
    want = []
    for x in texts_to_write.collect():
        ids = [*plain.encode(x.text or "", add_special_tokens=False).ids, 0]
        want.append((x.doc_id is not None, x.doc_id or 0, len(ids), zlib.crc32(np.array(ids, "<u2").tobytes()), zlib.crc32(np.array(ids, "<u4").tobytes())))
    starts = 0
    rows = []
    for known, i, n, _, crc in sorted(want):
        rows.append((i if known else None, starts, n, crc))
        starts += n
    got = tf.token_files(texts_to_write, public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted(map(tuple, got.collect()), key=lambda x: x[1]) == rows
    assert tf.token_files(texts_to_write.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_documents_of_token_files_alone(spark, texts_to_write, tmp_path):
    from doclattice.llm import token_files as tf

    folder = f"file://{tmp_path}"
    files = tf.write_files(texts_to_write, folder, public_tokenizers.path("byte_bpe_50k.json"))
    names = [x.file for x in files.collect()]
    assert files.agg(F.sum("documents")).first()[0] == texts_to_write.count()
    plain, by = library(), {}
    for x in texts_to_write.collect():
        by.setdefault(x.doc_id, []).append([*plain.encode(x.text or "", add_special_tokens=False).ids, 0])
    for i in [7, 50, 51, 52, -53, 10**9]:
        found = [d.tolist() for n in names for d in tf.TokenFile(folder, n).find(i)]
        assert sorted(found) == sorted(by.get(i, []))
    assert len(by[7]) > 20
    # a changed dictionary or file is an error, never other ids
    at = next(tmp_path.glob("*.dictionary"))
    raw = at.read_bytes()
    tf.read_dictionary.cache_clear()
    at.write_bytes(raw[:-1] + b"x")
    with pytest.raises(ValueError):
        tf.TokenFile(folder, names[0])
    at.write_bytes(raw)
    (tmp_path / "short.tok").write_bytes(b"x" * 10)
    with pytest.raises(ValueError):
        tf.TokenFile(folder, "short.tok")


def test_dictionaries_of_few_samples():
    from doclattice.llm import token_files as tf

    for samples in ([], [b""], [b"ab" * 10], [bytes(range(256)) * 4] * 3):
        raw = tf.trained(samples)
        for x in (b"", b"abc", bytes(range(256)) * 9):
            import zstandard

            assert zstandard.ZstdDecompressor(dict_data=tf.shared_dictionary(raw)).decompress(tf.compressor(raw).compress(x)) == x
