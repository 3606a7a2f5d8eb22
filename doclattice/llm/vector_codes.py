"""Compression of vectors to codes of their parts: codebooks by Elkan's variant of Lloyd's rounds, in whole numbers.

Each part of a vector keeps an upper bound of its distance to its entry and a lower bound of that to every entry. Between rounds they
are shifted by what the entries moved, and written with the vectors; an entry is compared in whole numbers only where the bounds
and the triangle inequality leave open whether it is as near."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclattice.llm.shared import columns, delete_path, join_spread, small_batches, table_path, written

#: Beyond this number components are taken for it: squares of larger ones don't fit 64-bit integers.
LARGEST = 1 << 26
#: Steps that a written lower bound has for each part; rounded down, so it stays a bound.
STEPS = 63
#: Float roundings of a bound are less than this part of it.
SLACK = 1e-9
STATE = "vec_id long, label string, q binary, near binary, upper binary, lower binary, scale binary"
SUMS = "part int, entry int, place int, total long, n long"


def usable(values: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(values.isNotNull() & (F.size(values) > 0) & finite, F.lit(False))


def quantised(vectors: pa.Array, dim: int, scale: int) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.clip(np.floor(flat * scale), -LARGEST, LARGEST).astype(np.int64)


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of points (n, w) to entries (k, w), as integers."""
    out = np.zeros((len(points), len(entries)), np.int64)
    for j in range(points.shape[1]):
        out += (points[:, j, None] - entries[None, :, j]) ** 2
    return out


def nearest_of_all(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(near, squared distance, upper, lower) by comparing all entries: what the first round knows."""
    d = squared(points, entries)
    near = d.argmin(1)
    best = d[np.arange(len(d)), near]
    return near, best, np.sqrt(best) * (1 + SLACK), np.sqrt(d) * (1 - SLACK)


def nearest_by_bounds(points: np.ndarray, entries: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(near, upper, lower, distances computed) of points whose bounds hold for ``entries``.

    Entry c is out for a point of entry a if upper < lower[c], or upper < d(a, c) / 2, both strictly: then c is
    farther than a, never as near. The others are compared in integers, the lower index of equal ones first."""
    half = np.sqrt(squared(entries, entries)) / 2 * (1 - SLACK)
    np.fill_diagonal(half, np.inf)
    near, upper, lower = near.copy(), upper.copy(), lower.copy()
    at = np.flatnonzero(upper >= half.min(1, initial=np.inf)[near])
    own = ((points[at] - entries[near[at]]) ** 2).sum(1)
    upper[at] = np.sqrt(own) * (1 + SLACK)
    lower[at, near[at]] = np.sqrt(own) * (1 - SLACK)
    ask = (lower[at] <= upper[at, None]) & (half[near[at]] <= upper[at, None])
    row, entry = np.nonzero(ask)
    d = ((points[at[row]] - entries[entry]) ** 2).sum(1)
    lower[at[row], entry] = np.sqrt(d) * (1 - SLACK)
    table = np.full(ask.shape, np.iinfo(np.int64).max)
    table[row, entry] = d
    table[np.arange(len(at)), near[at]] = own
    near[at] = table.argmin(1) if len(at) else near[at]
    if len(at):
        upper[at] = np.sqrt(table.min(1)) * (1 + SLACK)
    return near, upper, lower, len(at) + len(row)


def shifted(upper: np.ndarray, lower: np.ndarray, near: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds that hold for the entries after they moved from ``old`` to ``new``."""
    moved = np.sqrt(((new - old) ** 2).sum(1)) * (1 + SLACK)
    return (upper + moved[near]) * (1 + SLACK), np.maximum(lower - moved, 0) * (1 - SLACK)


class State:
    """Bounds of a batch of vectors, and their written form: an upper bound as a float rounded up; lower bounds as steps of a part's
    largest, rounded down, which are small numbers that compress well."""

    def __init__(self, parts: int, entries: int):
        self.parts, self.entries = parts, entries

    def pack(self, near: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[list[bytes], ...]:
        """near, upper (n, parts), lower (n, parts, entries) as lists of bytes."""
        scale = np.nextafter((lower.max(2) / STEPS).astype(np.float32), np.float32(np.inf))
        steps = np.floor(lower / scale[:, :, None].astype(np.float64) * (1 - SLACK)).astype(np.uint8)
        up = np.nextafter(upper.astype(np.float32), np.float32(np.inf))
        return tuple([x.tobytes() for x in a] for a in (near.astype(np.uint16), up, steps, scale))

    def unpack(self, near, upper, lower, scale) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(near)
        joined = lambda a, kind: np.frombuffer(b"".join(a.to_pylist()), kind)
        sizes = joined(scale, np.float32).reshape(n, self.parts).astype(np.float64)
        low = joined(lower, np.uint8).reshape(n, self.parts, self.entries) * sizes[:, :, None] * (1 - SLACK)
        return joined(near, np.uint16).reshape(n, self.parts).astype(np.int64), joined(upper, np.float32).reshape(n, self.parts).astype(np.float64), low


def moved_entries(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after a round: each entry becomes the floor of the mean of its parts, one without parts stays. Tasks send sums
    for parts, entries and places, as many as the codebooks have numbers."""
    parts, k, w = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((parts, k, w), np.int64), np.zeros((parts, k), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            q = np.frombuffer(b"".join(b.column(0).to_pylist()), "<i4").reshape(-1, parts, w)
            near = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint16).reshape(-1, parts)
            for p in range(parts):
                np.add.at(total[p], near[:, p], q[:, p])
                n[p] += np.bincount(near[:, p], minlength=k)
        p, c = np.nonzero(n)
        each = [np.repeat(p, w), np.repeat(c, w), np.tile(np.arange(w), len(p)), total[p, c].ravel(), np.repeat(n[p, c], w)]
        if len(p):
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(each, kinds, strict=True)], names=["part", "entry", "place", "total", "n"])

    out = books.copy()
    found = state.select("q", "near").mapInArrow(sums, SUMS).groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    for r in found.collect():  # at most the numbers in the codebooks
        out[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return out


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of each usable row of (vec_id, embedding, label), and the codebooks (parts, entries, width).

    Components become floor(scale * x). A part's codebook begins as that part of the vectors with the ``entries`` smallest vec_ids (of
    all, if there are fewer); each of ``rounds`` rounds assigns the parts to their nearest entries, the lower index of equally near ones, and
    moves the entries to the floors of their parts' means. The code has an entry's index for each part as two hex digits (more than
    256 entries are an error), the error is the sum of the squared distances in the end.

    Rows whose vector is null or empty, holds null or non-finite components, or has another length than the first usable one's (least
    vec_id) are left out; so are all if ``parts`` doesn't divide that length. Components beyond +-2^26 after scaling count as that. Repeated
    vec_ids keep their rows, in the order of their vectors where it matters; null ones come last. An empty table gives no rows.
    Further columns are not read. The tables of a round are deleted when the next one's are whole."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits for each part")
    spark = small_batches(vectors.sparkSession)
    rows = columns(vectors, "vec_id", "embedding", "label").where(usable(F.col("embedding"))).withColumn("label", F.col("label").cast("string"))
    first = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    heads = rows.select("vec_id", "embedding").orderBy(*first).limit(1).collect()
    dim = len(heads[0]["embedding"]) if heads else 0
    result = "vec_id long, label string, code string, error long"
    if not dim or dim % parts:
        return spark.createDataFrame([], result), np.zeros((parts, 0, 0), np.int64)
    rows = rows.where(F.size("embedding") == dim)
    width = dim // parts
    heads = [r["embedding"] for r in rows.select("vec_id", "embedding").orderBy(*first).limit(entries).collect()]
    books = [quantised(pa.array(heads, pa.list_(pa.float64())), dim, scale).reshape(-1, parts, width).transpose(1, 0, 2).copy()]
    kept = State(parts, len(heads))
    kinds = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("q", pa.binary()), ("near", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("scale", pa.binary())])

    def begin(batches):
        book = books[0]
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                x = b.slice(at, 2000)
                q = quantised(x.column(1), dim, scale)
                each = [nearest_of_all(q[:, p * width : (p + 1) * width], book[p]) for p in range(parts)]
                near, _, upper, lower = (np.stack(a, 1) for a in zip(*each, strict=True))
                yield pa.RecordBatch.from_arrays([x.column(0).cast(pa.int64()), x.column(2), pa.array([v.tobytes() for v in q.astype("<i4")]), *(pa.array(a, pa.binary()) for a in kept.pack(near, upper, lower))], schema=kinds)

    def again(x, old, new):
        """(q, near, upper, lower) of rows of the state when the entries have moved."""
        q = np.frombuffer(b"".join(x.column(2).to_pylist()), "<i4").reshape(x.num_rows, parts, width).astype(np.int64)
        near, upper, lower = kept.unpack(*(x.column(i) for i in range(3, 7)))
        near, upper, lower = near.copy(), upper.copy(), lower.copy()
        for p in range(parts):
            up, low = shifted(upper[:, p], lower[:, p], near[:, p], old[p], new[p])
            near[:, p], upper[:, p], lower[:, p], _ = nearest_by_bounds(q[:, p], new[p], near[:, p], up, low)
        return q, near, upper, lower

    def step(old, new):
        def one(batches):
            for b in batches:
                for at in range(0, b.num_rows, 2000):
                    x = b.slice(at, 2000)
                    _, near, upper, lower = again(x, old, new)
                    yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), x.column(2), *(pa.array(a, pa.binary()) for a in kept.pack(near, upper, lower))], schema=kinds)

        return one

    def end(old, new):
        def one(batches):
            for b in batches:
                for at in range(0, b.num_rows, 2000):
                    x = b.slice(at, 2000)
                    q, near, _, _ = again(x, old, new)
                    error = sum(((q[:, p] - new[p][near[:, p]]) ** 2).sum(1) for p in range(parts))
                    yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array([v.tobytes().hex() for v in near.astype(np.uint8)]), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

        return one

    def saved(df: DataFrame) -> tuple[DataFrame, str]:
        path = table_path(spark, "codes")
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    state, path = saved(rows.select("vec_id", "embedding", "label").mapInArrow(begin, STATE))
    for r in range(rounds):
        books.append(moved_entries(state, books[-1]))
        if r < rounds - 1:
            last = path
            state, path = saved(state.mapInArrow(step(books[-2], books[-1]), STATE))
            delete_path(spark, last)
    if not rounds:
        books.append(books[0])
    return state.mapInArrow(end(books[-2], books[-1]), result), books[-1]


def code_digests(vectors: DataFrame, **how) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of ``vector_codes``: label_error is the sum of the errors of all rows with the
    same label, null ones together. The sums are a row a label, which goes to the rows by a join that spreads hot labels."""
    codes, books = vector_codes(vectors, **how)
    codes = written(codes, "coded")
    keyed = codes.withColumn("key", F.coalesce(F.concat(F.lit("l"), "label"), F.lit("n")))
    sums = written(keyed.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    out = join_spread(keyed, sums, "key", F.concat(F.lit("v"), F.xxhash64("vec_id", "code").cast("string")))
    return out.select("vec_id", "code", "error", F.col("found.label_error").alias("label_error"), F.lit(digest).alias("codebooks_sha256"))
