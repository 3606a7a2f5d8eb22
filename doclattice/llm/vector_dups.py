"""Near-duplicate vectors by p-stable hashing: quantised Gaussian projections in several tables, then exact cosines."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.llm.components import connected_components
from doclattice.llm.shared import arrow_rows, columns, join_spread, map_groups, places, written


def unit_rows(emb: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors, the indices of the usable rows (not null, not zero, all components finite) and their
    vectors as float64."""
    if isinstance(emb, pa.ListArray) and not emb.null_count and len(emb):
        sizes = np.diff(emb.offsets.to_numpy())
        if (sizes == sizes[0]).all() and sizes[0]:
            x = emb.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), -1)
            ok = np.isfinite(x).all(1) & x.any(1)
            return [(np.flatnonzero(ok), x[ok])]
    found: dict[int, tuple[list, list]] = {}
    for i, v in enumerate(emb.to_pylist()):
        if v:
            x = np.array([np.nan if c is None else c for c in v], np.float64)
            if np.isfinite(x).all() and x.any():
                at, rows = found.setdefault(len(x), ([], []))
                at.append(i)
                rows.append(x)
    return [(np.array(at, np.int64), np.array(rows, np.float64)) for at, rows in found.values()]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by their largest absolute component, so that squares neither overflow nor vanish; cosines stay what they are."""
    return x / np.abs(x).max(1, keepdims=True)


def layout(vectors: int, threshold: float, width: float, projections: int | None = None) -> tuple[int, int]:
    """(projections in a bucket, tables). Two unit vectors at distance c agree in one projection with probability
    1 - 2 Phi(-w/c) - 2 c / (sqrt(2 pi) w) (1 - exp(-w^2 / (2 c^2)))."""

    def agree(c: float) -> float:
        t = width / c
        return 1 - math.erfc(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))

    near, far = agree(math.sqrt(2 - 2 * threshold)), agree(math.sqrt(2))
    k = projections or 4 + max(0, math.floor(math.log(max(vectors, 1) / 100_000) / -math.log(far)) + 1)
    return k, math.ceil(math.log(1e-4) / math.log(1 - near**k))


def vector_near_dups(df: DataFrame, threshold: float = 0.98, projections: int | None = None, width: float = 1.2, seed: int = 11, block: int = 4096) -> DataFrame:
    """One row per row of ``df`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    h(v) = floor((a . v + u) / width) with Gaussian ``a`` over normalised vectors; several of them, the label and the length
    key a bucket, in as many tables as a miss of a pair at the threshold needs to be rarer than 1e-4 (``layout``), closer pairs
    being missed less. Unless ``projections`` are given, there are 4 in a bucket up to 100,000 vectors and more
    with their logarithm, so that a bucket holds about as many vectors at right angles at any size.

    Only numbers of rows go to the buckets; vectors follow to those with several members. There all cosines are computed in
    double precision, in blocks of ``block`` vectors and strips within them, so a hot bucket is many tasks of bounded memory. A
    pair counts in the first table where it meets. Links leave a block as counts and a spanning forest, never as pairs.

    Equal vectors of a label are compared once and count with their number. Null labels, null vectors, zero vectors
    and those with null or non-finite components link with nothing, and vectors of different lengths never with one another; rows
    with a null vec_id take no part and are returned with component null. Repeated vec_ids are separate rows that count as
    links of one another if their vectors are near. Very small and very large components are compared like others. Further columns are not read.
    """
    kind = np.dtype(np.float64 if "double" in df.schema[places(df, ["embedding"])[0]].dataType.simpleString() else np.float32)

    def pack(batches):
        for b in batches:
            known = np.array(b.column(0).is_valid()) & np.array(b.column(2).is_valid())
            vecs: list[bytes | None] = [None] * b.num_rows
            for at, x in unit_rows(b.column(1)):
                for i, r in zip(at.tolist(), x.astype(kind), strict=True):
                    if known[i]:
                        vecs[i] = r.tobytes()
            yield from arrow_rows("vec_id long, label long, vec binary", [b.column(0), b.column(2), vecs])

    packed = written(columns(df, "vec_id", "embedding", "label").mapInArrow(pack, "vec_id long, label long, vec binary"), "vectors")
    projections, tables = layout(packed.where("vec is not null").count(), threshold, width, projections)
    distinct = packed.where("vec is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))

    def hashed(batches):
        for b in batches:
            raw = b.column("vec").to_pylist()
            sigs: list[bytes] = [b""] * len(raw)
            for size in {len(r) for r in raw}:
                rows = [i for i, r in enumerate(raw) if len(r) == size]
                x = scaled(np.frombuffer(b"".join(raw[i] for i in rows), kind).reshape(len(rows), -1).astype(np.float64))
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                rng = np.random.default_rng(seed)
                a, u = rng.standard_normal((x.shape[1], tables * projections)), rng.uniform(0, width, tables * projections)
                q = np.floor((x @ a + u) / width).astype(np.int64).reshape(len(rows), tables, projections)
                weights = rng.integers(1, 2**62, projections) | 1
                for i, s in zip(rows, (q * weights).sum(2), strict=True):  # wraps; two cells of a table agree by chance with probability 2^-64
                    sigs[i] = s.tobytes()
            if raw:
                yield from arrow_rows("label long, vec binary, rep long, copies long, sig binary, buckets array<long>", [*b.columns, sigs, [np.frombuffer(s, np.int64) for s in sigs]])

    hashes = distinct.mapInArrow(hashed, "label long, vec binary, rep long, copies long, sig binary, buckets array<long>")
    hashes = written(hashes.withColumn("no", F.monotonically_increasing_id()), "distinct-vectors")

    keys = F.struct("label", F.length("vec").alias("size"), F.col("tab").cast("int").alias("tab"), "bucket").alias("key")
    thin = hashes.select("no", "label", "vec", F.posexplode("buckets").alias("tab", "bucket")).select("no", keys)
    sizes = written(thin.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
    spread = F.struct(F.col("no").alias("label"), F.lit(0).alias("size"), F.lit(0).alias("tab"), F.xxhash64("no").alias("bucket"))
    met = join_spread(thin, sizes, "key", spread).where("found is not null").withColumn("g", F.ceil(F.col("found.n") / block).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("no"), "g").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    met = written(met.select("no", "key.*", "own", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")), "buckets")
    rows = met.join(hashes.select("no", "copies", "vec", "sig"), "no")

    def linked(g: dict):
        no, copies, tab = g["no"].to_numpy(), g["copies"].to_numpy().astype(np.float64), g["tab"][0].as_py()
        x = scaled(np.frombuffer(b"".join(g["vec"].to_pylist()), kind).reshape(len(no), -1).astype(np.float64))
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        sig = np.frombuffer(b"".join(g["sig"].to_pylist()), np.int64).reshape(len(no), -1)
        own, p, q = g["own"].to_numpy(), g["p"][0].as_py(), g["q"][0].as_py()
        one, two = np.flatnonzero(own == p), np.flatnonzero(own == q)
        count, root, hit = np.zeros(len(no)), no.copy(), np.zeros(len(no), bool)
        forest = []
        for at in range(0, len(one), 256):
            part = one[at : at + 256]
            m = x[part] @ x[two].T >= threshold
            if p == q:
                m[np.arange(len(part)), np.arange(at, at + len(part))] = False
            i, j = np.nonzero(m)
            if not len(i):
                continue
            for k in range(0, len(i), 50_000):
                a, b = part[i[k : k + 50_000]], two[j[k : k + 50_000]]
                first = (sig[a] == sig[b]).argmax(1) == tab
                a, b = a[first], b[first]
                count += np.bincount(a, copies[b], len(no))
                if p != q:
                    count += np.bincount(b, copies[a], len(no))
            rows_hit, cols_hit = part[m.any(1)], two[m.any(0)]
            m, top = m[m.any(1)][:, m.any(0)], np.iinfo(np.int64).max
            near = {"r": np.minimum.reduce(np.where(m, no[cols_hit][None, :], top), 1), "c": no[cols_hit].copy()}
            near["r"] = np.minimum(near["r"], no[rows_hit])
            while True:  # the least number that is reached within the strip
                old = near["c"].copy(), near["r"].copy()
                near["c"] = np.minimum(near["c"], np.where(m, near["r"][:, None], top).min(0))
                near["r"] = np.minimum(near["r"], np.where(m, near["c"][None, :], top).min(1))
                if (old[0] == near["c"]).all() and (old[1] == near["r"]).all():
                    break
            hit[rows_hit] = hit[cols_hit] = True
            forest += [(no[rows_hit], near["r"]), (no[cols_hit], near["c"])]
        if not forest:
            return None
        ends = np.unique(np.concatenate([np.stack(f, 1) for f in forest]), axis=0)
        up = {int(v): int(v) for v in ends.ravel()}

        def find(v):
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        for u, v in ends.tolist():
            u, v = find(u), find(v)
            up[max(u, v)] = min(u, v)
        at = np.flatnonzero(hit)
        root = np.array([find(int(v)) for v in no[at]], np.int64)
        return no[at], count[at].astype(np.int64), root

    found = written(map_groups(rows, ["label", "size", "tab", "bucket", "p", "q"], linked, "no long, n long, root long"), "vector-links")
    degree = found.groupBy("no").agg(F.sum("n").alias("links"))
    roots = connected_components(found.select("no", "root").distinct(), "no", "root").withColumnRenamed("id", "no")
    known = written(hashes.select("no", "label", "vec", "rep", "copies").join(degree, "no", "left").join(roots, "no", "left").withColumn("component", F.coalesce("component", "no")), "vector-classes")
    # a component may hold most of all vectors: those of hot ones stay where they are
    least = written(known.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("n")), "vector-components")
    classes = join_spread(known, least, "component", F.xxhash64("no"))
    classes = classes.select(F.struct("label", "vec").alias("key"), F.col("copies").alias("n"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("found.least").alias("least"))
    each = packed.withColumn("key", F.when(F.col("vec").isNotNull(), F.struct("label", "vec")))
    none = F.struct(F.xxhash64("vec_id").alias("label"), F.unhex(F.md5(F.col("vec_id").cast("string").cast("binary"))).alias("vec"))
    each = join_spread(each, written(classes, "vector-results"), "key", none)
    each = each.select("vec_id", F.coalesce("found.n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("found.least", "vec_id").alias("component_id"))
    return each.withColumn("kept", F.col("vec_id") == F.col("component_id"))
