"""Nearest neighbours by an inverted multi-index: both halves quantised, cells visited by summed distance, entries reranked."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclattice.llm.shared import arrow_rows, beside, join_spread, map_groups, mix64, written
from doclattice.llm.vector_dups import unit_rows


def centroids(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """k-means of a bounded sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        for i in range(k):
            if (m := near == i).any():
                c[i] = x[m].mean(0)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (c * c).sum(1) - 2 * x @ c.T


class Halves:
    """The two codebooks, and the traversal of their pairs."""

    def __init__(self, sample: np.ndarray, k: int, seed: int = 5):
        self.cut = sample.shape[1] // 2
        self.k = k
        self.one, self.two = centroids(sample[:, : self.cut], k, seed), centroids(sample[:, self.cut :], k, seed + 1)

    def both(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.cut], self.one), distances(x[:, self.cut :], self.two)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.both(x)
        return a.argmin(1), b.argmin(1)

    def visit(self, a: np.ndarray, b: np.ndarray, counts: np.ndarray, budget: int):
        """Pairs of centroids by increasing sum of the two distances, until the cells hold ``budget`` entries."""
        p, q = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        x, y = a[p].tolist(), b[q].tolist()
        p, q = p.tolist(), q.tolist()
        heap, front, n, k = [(x[0] + y[0], 0, 0)], [0] * (self.k + 1), 0, self.k
        while heap and n < budget:
            _, i, j = heapq.heappop(heap)
            if m := counts[p[i]][q[j]]:
                n += m
                yield p[i], q[j]
            # a row begins when the row above has left its first column; each row holds one pair in the heap
            if j + 1 < k:
                heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
            if j == 0 and i + 1 < k:
                heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))


def needed_part(sample: np.ndarray, index: Halves, top: int, recall: float, queries: int = 200) -> float:
    """The part of all entries that must be visited for ``recall`` on average, measured on the sample against brute force."""
    q = sample[:: max(1, len(sample) // queries)]
    own = np.arange(0, len(sample), max(1, len(sample) // queries))
    s = q @ sample.T
    s[np.arange(len(q)), own] = -np.inf
    best = np.argsort(-s, axis=1)[:, :top]
    i, j = index.cells(sample)
    a, b = index.both(q)
    counts = np.bincount(i * index.k + j, minlength=index.k**2)
    order = np.argsort((a[:, :, None] + b[:, None, :]).reshape(len(q), -1), axis=1, kind="stable")
    before = np.empty_like(order)
    np.put_along_axis(before, order, np.cumsum(counts[order], 1) - counts[order], 1)
    at = before[np.arange(len(q))[:, None], (i * index.k + j)[best]] / len(sample)
    return float(min(1.0, np.quantile(at, recall) + 1 / len(sample)))


def codebook_size(rows: int, sample: int, most: int) -> int:
    """Centroids a half: as many as leave about eight entries to a cell, at most ``most`` and an eighth of the sample."""
    return max(1, min(most, sample // 8, int(np.ceil(np.sqrt(rows / 8)))))


def nearest(df: DataFrame, is_query: Column, top: int = 20, recall: float = 0.97, most_centroids: int = 256, sample_rows: int = 20_000, least: int | None = None, block: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` rows of ``df`` (vec_id, embedding) with the largest inner product for each row for
    which the column expression ``is_query`` holds, without the row itself.

    The codebooks (see ``codebook_size``) are fitted on a sample of at most ``sample_rows`` rows, those with the least hash
    of their id; every row is indexed. The same sample tells what part of the entries a query has to visit for
    ``recall``: with clustered vectors a small part, with vectors that fill the space evenly a large one. A query visits cells
    in the order of its heap until they hold that many entries, and 4 * ``top`` at least (or ``least``).

    Queries are dealt into blocks of about ``block`` in the order of their own cells, so that those of a block visit much the same cells. An entry
    goes to the blocks that visit its cell and to no other, and a query once to each first-half centroid that it
    visits; there they meet in blocks of 8 * ``block`` entries, so that a full cell is many tasks and inner products are bounded
    matrices. Scores are sums in double precision of the original vectors' products; equal scores go to the smaller vec_id.

    Vectors that are null, zero or hold null or non-finite components, those of another length than most such vectors of the
    whole table (of equally frequent lengths the least counts), and rows with a null vec_id, take no part. With fewer other rows than ``top``
    all are returned, with one row or none nothing. Rows that repeat a vec_id are entries and queries of their own: each query
    row has its own ranks, and leaves out itself only. Further columns are read by ``is_query`` alone.
    """
    spark = df.sparkSession
    marked = beside(df.withColumn("__q", is_query), ["vec_id", "embedding", "__q"], lambda plain, i, v, q: (plain, {"__id": i, "__emb": v, "__query": q})).select("__id", "__emb", "__query")

    # single precision travels as such; sums are in double precision
    kind = np.dtype(np.float64 if "double" in marked.schema["__emb"].dataType.simpleString() else np.float32)

    def matrix(raw: bytes, n: int) -> np.ndarray:
        return np.frombuffer(raw, kind).reshape(n, -1).astype(np.float64)

    def pack(batches):
        for b in batches:
            for ok, x in unit_rows(b.column(1)):
                yield from arrow_rows("vec_id long, q boolean, vec binary", [b.column(0).take(pa.array(ok)), b.column(2).take(pa.array(ok)), [r.tobytes() for r in x.astype(kind)]])

    rows = written(marked.where("__id is not null").mapInArrow(pack, "vec_id long, q boolean, vec binary").withColumn("no", F.monotonically_increasing_id()), "vectors")
    if common := rows.groupBy(F.length("vec").alias("size")).count().orderBy(F.desc("count"), "size").first():
        rows = rows.where(F.length("vec") == common["size"])
    names = "query_id long, rank int, vec_id long, score double"
    n, m = rows.count(), rows.where("q").count()
    if n < 2 or not m:
        return spark.createDataFrame([], names)
    sample = np.stack([matrix(r["vec"], 1)[0] for r in rows.orderBy(F.xxhash64("vec_id"), "no").limit(sample_rows).select("vec").collect()])
    index = Halves(sample, codebook_size(n, len(sample), most_centroids))
    k = index.k
    budget = max(4 * top if least is None else least, int(np.ceil(n * needed_part(sample, index, top, recall))))

    def place(batches):
        for b in batches:
            if b.num_rows:
                i, j = index.cells(matrix(b"".join(b.column("vec").to_pylist()), b.num_rows))
                yield from arrow_rows("vec_id long, q boolean, vec binary, no long, i int, j int", [*b.columns, i, j])

    placed = written(rows.mapInArrow(place, "vec_id long, q boolean, vec binary, no long, i int, j int"), "index")
    counts, asked = np.zeros((2, k, k), np.int64)
    for r in placed.groupBy("i", "j").agg(F.count("*").alias("n"), F.count_if("q").alias("m")).collect():  # at most k x k rows
        counts[r["i"], r["j"]], asked[r["i"], r["j"]] = r["n"], r["m"]
    held = counts.tolist()
    before = (np.cumsum(asked) - asked.ravel()).astype(np.int64)

    def numbered(batches):
        for b in batches:
            if b.num_rows:
                cell = b.column("i").to_numpy().astype(np.int64) * k + b.column("j").to_numpy()
                at = before[cell] + (mix64(b.column("no").to_numpy().astype(np.uint64)) % asked.ravel()[cell].astype(np.uint64)).astype(np.int64)
                yield from arrow_rows("w long, no long, vec_id long, vec binary", [at // block, b.column("no"), b.column("vec_id"), b.column("vec")])

    def visits(g: dict):
        """For each first-half centroid the queries of a block that visit cells there, with these cells as bits."""
        x = matrix(b"".join(g["vec"].to_pylist()), len(g["no"]))
        a, b = index.both(x)
        seen: dict[int, list[int]] = {}
        bits = np.zeros((len(x), k, k), bool) if len(x) * k * k <= 1 << 24 else None
        masks: dict[tuple[int, int], np.ndarray] = {}
        for q in range(len(x)):
            for i, j in index.visit(a[q], b[q], held, budget):
                if bits is not None:
                    bits[q, i, j] = True
                else:
                    masks.setdefault((i, q), np.zeros(k, bool))[j] = True
        if bits is not None:
            for q, i in zip(*np.nonzero(bits.any(2)), strict=True):
                masks[int(i), int(q)] = bits[q, i]
        for i, q in sorted(masks):
            seen.setdefault(i, []).append(q)
        out: list[list] = [[] for _ in range(8)]
        for i, at in seen.items():
            m = np.stack([masks[i, q] for q in at])
            cells = np.flatnonzero(m.any(0))
            size = int(counts[i, cells].sum())
            take = pa.array(at)
            for o, v in zip(out, (g["w"][0].as_py(), i, -(-size // (8 * block)), cells, g["no"].take(take).to_pylist(), g["vec_id"].take(take).to_pylist(), np.packbits(m, axis=1).tobytes(), b"".join(g["vec"].take(take).to_pylist())), strict=True):
                o.append(v)
        return tuple(out)

    ddl = "w long, i int, parts int, cells array<long>, nos array<long>, ids array<long>, masks binary, vecs binary"
    blocks = written(map_groups(placed.where("q").mapInArrow(numbered, "w long, no long, vec_id long, vec binary"), ["w"], visits, ddl, int(spark.conf.get("spark.sql.shuffle.partitions"))), "query-blocks")
    # each cell's blocks of queries; entries of a cell that many vectors share meet them by broadcast
    cells = blocks.select("w", "i", "parts", F.explode(F.col("cells").cast("array<int>")).alias("j")).groupBy("i", "j").agg(F.collect_list(F.struct("w", "parts")).alias("blocks"))
    sizes = placed.groupBy("i", "j").agg(F.count("*").alias("n"))
    cells = written(cells.join(sizes, ["i", "j"]).select(F.struct("i", "j").alias("cell"), "blocks", "n"), "visited-cells")
    entries = join_spread(placed.withColumn("cell", F.struct("i", "j")), cells, "cell", F.struct(F.hash("no").alias("i"), F.lit(-1).alias("j"))).where("found is not null")
    entries = entries.select("i", "j", "no", "vec_id", "vec", F.explode("found.blocks").alias("x"))
    none = lambda kind: F.lit(None).cast(kind)
    offered = entries.select("x.w", "i", F.pmod(F.xxhash64("no"), "x.parts").cast("int").alias("v"), "j", "no", "vec_id", "vec", none("array<long>").alias("nos"), none("array<long>").alias("ids"), none("binary").alias("masks"))
    queries = blocks.select("w", "i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("v"), F.lit(-1).alias("j"), none("long").alias("no"), none("long").alias("vec_id"), F.col("vecs").alias("vec"), "nos", "ids", "masks")

    def best(g: dict):
        j = g["j"].to_numpy()
        e, head = np.flatnonzero(j >= 0), int(np.flatnonzero(j < 0)[0])
        if not len(e):
            return None
        take = pa.array(e)
        own, ids, x = g["no"].take(take).to_numpy(), g["vec_id"].take(take).to_numpy(), matrix(b"".join(g["vec"].take(take).to_pylist()), len(e))
        nos, qids = (np.array(g[c][head].as_py(), np.int64) for c in ("nos", "ids"))
        y = matrix(g["vec"][head].as_py(), len(nos))
        masks = np.unpackbits(np.frombuffer(g["masks"][head].as_py(), np.uint8).reshape(len(nos), -1), axis=1, count=k)[:, j[e]].astype(bool)
        out = []
        for at in range(0, len(nos), 256):
            part = slice(at, at + 256)
            s = y[part] @ x.T
            s[~masks[part] | (nos[part, None] == own[None])] = -np.inf
            if len(e) > top:
                floor = np.partition(s, len(e) - top, axis=1)[:, len(e) - top] - 1e-9 * np.abs(s, where=np.isfinite(s), out=np.zeros_like(s)).max(1)
                a, b = np.nonzero((s >= floor[:, None]) & np.isfinite(s))
            else:
                a, b = np.nonzero(np.isfinite(s))
            score = (y[part][a] * x[b]).sum(1)  # the same sum for equal vectors, whatever the matrix product did
            order = np.lexsort((ids[b], -score, a))
            a, b, score = a[order], b[order], score[order]
            keep = np.arange(len(a)) - np.searchsorted(a, a) < top
            out.append((a[keep] + at, ids[b[keep]], score[keep]))
        q, v, s = map(np.concatenate, zip(*out, strict=True))
        cut = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
        ends = np.append(cut, len(q)).astype(np.int32)
        return nos[q[cut]], qids[q[cut]], pa.ListArray.from_arrays(ends, pa.array(v)), pa.ListArray.from_arrays(ends, pa.array(s))

    parts = map_groups(queries.unionByName(offered), ["w", "i", "v"], best, "no long, query_id long, ids array<long>, scores array<double>")

    def merged(g: dict):
        v, s = g["ids"].flatten().to_numpy(), g["scores"].flatten().to_numpy()
        order = np.lexsort((v, -s))[:top]
        return np.full(len(order), g["query_id"][0].as_py()), np.arange(1, len(order) + 1, dtype=np.int32), v[order], s[order]

    return map_groups(parts, ["no"], merged, names)
