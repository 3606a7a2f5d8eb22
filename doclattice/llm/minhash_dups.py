"""Near-duplicate documents by circulant MinHash: two permutations give the whole signature; banding, then exact Jaccard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclattice.llm.components import connected_components
from doclattice.llm.shared import arrow_rows, columns, join_spread, map_groups, maybe_broadcast, mix64, written
from doclattice.llm.shingles import common, shingle_sets

#: Fixed odd multipliers of the two bijections of 32-bit integers.
SIGMA = (0x9E3779B1, 0x7FEB352D, 0x846CA68B)
PI = (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)
#: Sets in one group of a comparison have about this many bytes at most (a single larger set is a group's all the same).
GROUP_BYTES = 8 << 20
SIGNED = "doc_id long, fp binary, n_shingles int, bands array<long>, sig binary"


def permuted(x: np.ndarray, m: tuple[int, int, int]) -> np.ndarray:
    """A bijection of the 32-bit integers, in place."""
    x *= np.uint32(m[0])
    x ^= x >> np.uint32(16)
    x *= np.uint32(m[1])
    x ^= x >> np.uint32(15)
    x *= np.uint32(m[2])
    return x


def circulant_signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Coordinate k is the least value of pi(sigma(s) + k mod 2^32) over the set: pi circularly shifted by k."""
    s = permuted((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32), SIGMA)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    sig = np.full(size, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 1024):
        np.minimum(sig, permuted(shift + s[None, at : at + 1024], PI).min(1), out=sig)
    return sig


def fingerprint(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def rows_of(column, width: int) -> np.ndarray:
    """A matrix of the bytes of a binary column of one width."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


class Union:
    """Components of a few numbers."""

    def __init__(self, values):
        self.up = {int(v): int(v) for v in values}

    def find(self, v: int) -> int:
        while self.up[v] != v:
            self.up[v] = self.up[self.up[v]]
            v = self.up[v]
        return v

    def join(self, u: int, v: int) -> None:
        self.up[max(u, v)] = min(u, v)


def minhash_near_dups(df: DataFrame, threshold_percent: int = 75, shingle: int = 5, bands: int = 20, rows: int = 4, block: int = 256) -> DataFrame:
    """One row per document of ``df`` (doc_id, text): n_shingles, component_id, kept.

    Links hold where 100 * |A and B| >= threshold_percent * |A or B| over full sets of ``shingle``-word shingles. With 20
    bands of 4 coordinates a pair at 0.75 shares no bucket with probability (1 - 0.75^4)^20 < 0.0006, closer pairs less.

    Work that a group of copies causes stays linear in it: documents with equal sets become one class first; then each
    bucket's members are verified against its least member only, which travels once for a block of members. In buckets whose other
    members still belong to several components, the most frequent component there meets the others in blocks, and the others
    meet one another; pairs are only looked at in memory, each in the first bucket that it shares. Whole sets come
    to these blocks only for members with a pair that signatures don't rule out (agreement under 0.6 of the threshold, 0.45 where
    0.75 is needed: 6.2 standard deviations of an 80-coordinate signature, probability 3e-9). A block holds at
    most about ``block`` members of a side and ``GROUP_BYTES`` of sets, whatever the group. Links leave a block, never pairs.

    Null texts and texts without words have empty sets and link with nothing. Rows with a null doc_id take no part in links
    and get a null component_id. Repeated rows are one document listed twice. Where a doc_id is repeated with other texts, each
    row is judged by its own text; texts whose least doc_id is the same belong together. Further columns are not read.
    """
    size = bands * rows
    docs = columns(df, "doc_id", "text")

    def signed(batches):
        for b in batches:
            ids, fp, n, keys, sigs = b.column(0), [], [], [], []
            for s in shingle_sets(b.column(1).to_pylist(), shingle):
                n.append(len(s))
                if not len(s):
                    fp.append(None), keys.append(None), sigs.append(None)
                    continue
                sig = circulant_signature(s, size)
                acc = np.arange(1, bands + 1, dtype=np.uint64)
                for k in range(rows):
                    acc = mix64(acc ^ sig[k::rows].astype(np.uint64))
                fp.append(fingerprint(s))
                keys.append(acc.view(np.int64))
                sigs.append(sig.astype(np.uint8).tobytes())
            yield from arrow_rows(SIGNED, [ids, fp, n, keys, sigs])

    signatures = written(docs.mapInArrow(signed, SIGNED), "signatures")
    # a class of equal sets: its least doc_id, and its number of documents
    least = F.min(F.struct(F.col("doc_id").alias("rep"), "n_shingles", "sig", "bands")).alias("x")
    classes = written(signatures.where("fp is not null and doc_id is not null").groupBy("fp").agg(least, F.count("*").alias("n")).select("fp", "x.*", "n"), "classes")

    # buckets with several members; what else is known of a member is joined to these few rows only
    placed = classes.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    centers = written(placed.groupBy("bucket").agg(F.min("rep").alias("center"), F.count("*").alias("n")).where("n > 1"), "centers")
    shared = join_spread(placed, centers, "bucket", F.xxhash64("rep", "bucket")).where("found is not null")
    shared = written(shared.select("bucket", "rep", "n_shingles", "found.center", "found.n"), "shared-buckets")
    known = written(classes.drop("n", "n_shingles").join(shared.select("rep").distinct(), "rep", "left_semi"), "shared-classes")

    stars = written(shared.where("rep != center").select(F.col("center").alias("a"), "rep", F.col("n_shingles").alias("nb")).distinct(), "stars")
    heads = stars.groupBy("a").agg(F.count("*").alias("n")).join(known.select(F.col("rep").alias("a"), F.struct("fp", "sig").alias("head")), "a").groupBy("a").agg(F.max("n").alias("n"), F.collect_list("head").alias("heads"))
    stars = join_spread(stars.join(known, "rep"), written(heads, "heads"), "a", F.xxhash64("rep", "a"))
    stars = stars.select("a", F.explode("found.heads").alias("h"), F.col("rep").alias("b"), F.col("fp").alias("fb"), "nb", F.col("sig").alias("sb")).select("a", F.col("h.fp").alias("fa"), "b", "fb", "nb", F.col("h.sig").alias("sa"), "sb")
    least_agreement = 0.6 * threshold_percent / 100

    def likely(batches):
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array((rows_of(b.column("sa"), size) == rows_of(b.column("sb"), size)).mean(1) >= least_agreement))

    stars = stars.mapInArrow(likely, stars.schema).select("a", "fa", "b", "fb", "nb")
    sure = verified(written(stars, "likely-stars"), docs, threshold_percent, shingle, block)
    comp = written(connected_components(sure), "star-components")

    # what the stars left open: buckets of three or more whose members are not all connected yet
    named = shared.where("n > 2 and rep != center").drop("n", "center").join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = written(named, "named-buckets")
    parts = named.groupBy("bucket", "component").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("s"))
    most = F.max(F.struct("m", "s", "component")).alias("top")
    split = parts.groupBy("bucket").agg(most, F.sum("m").alias("n"), F.sum("s").alias("s"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda m, s: F.ceil(F.greatest(m / block, s * 8 / GROUP_BYTES)).cast("int")
    split = split.select("bucket", "n", F.col("top.component").alias("main"), blocks(F.col("top.m"), F.col("top.s")).alias("gm"), blocks(F.col("n") - F.col("top.m"), F.col("s") - F.col("top.s")).alias("go"))
    left = join_spread(named, written(split, "open-buckets"), "bucket", F.xxhash64("rep", "bucket")).where("found is not null")
    left = left.join(known, "rep").where(F.array_contains("bands", F.col("bucket")))
    left = written(dealt(left).select("bucket", "kind", "p", "q", "side", "rep", "fp", "component", "sig", "bands"), "open-members")

    def pairs(g: dict) -> tuple[np.ndarray, np.ndarray]:
        """The members' pairs that other steps leave to this bucket and signatures don't rule out."""
        c, side = g["component"].to_numpy(), g["side"].to_numpy()
        within = g["kind"][0].as_py() == 1 and g["p"][0].as_py() == g["q"][0].as_py()
        i, j = np.nonzero(np.triu((c[:, None] != c[None, :]) & (within or side[:, None] != side[None, :]), 1))
        sig = rows_of(g["sig"], size)
        keys = g["bands"].flatten().to_numpy().reshape(len(c), -1)
        hit = np.zeros(len(i), bool)
        for at in range(0, len(i), 20_000):
            x, y = i[at : at + 20_000], j[at : at + 20_000]
            same = keys[x] == keys[y]
            # a pair belongs to the first bucket that it shares
            hit[at : at + 20_000] = (keys[x, same.argmax(1)] == g["bucket"][0].as_py()) & ((sig[x] == sig[y]).mean(1) >= least_agreement)
        return i[hit], j[hit]

    where = ["bucket", "kind", "p", "q"]

    def wanted(g: dict):
        hit = np.union1d(*pairs(g))
        return tuple(g[c].take(hit) for c in (*where, "side", "rep", "fp", "component", "sig", "bands")) if len(hit) else None

    few = written(map_groups(left, where, wanted, "bucket long, kind int, p int, q int, side int, rep long, fp binary, component long, sig binary, bands array<long>"), "open-pairs")

    def open_links(g: dict):
        c, union, a, b = g["component"].to_numpy(), Union(g["component"].to_pylist()), [], []
        sets: dict[int, np.ndarray] = {}
        for x, y in zip(*(k.tolist() for k in pairs(g)), strict=True):
            u, v = union.find(int(c[x])), union.find(int(c[y]))
            if u == v:  # connected meanwhile: such a pair can't change components
                continue
            one, two = (sets.setdefault(k, np.frombuffer(g["shingles"][k].as_py(), np.uint64)) if k not in sets else sets[k] for k in (x, y))
            n = common(one, two)
            if 100 * n >= threshold_percent * (len(one) + len(two) - n):
                union.join(u, v)
                a.append(int(c[x])), b.append(int(c[y]))
        return (a, b) if a else None

    texts = full_sets(few.select("rep", "fp").distinct(), docs, shingle)
    more = written(map_groups(few.join(texts, ["rep", "fp"]), where, open_links, "a long, b long"), "open-links")
    second = connected_components(more).select(F.col("id").alias("component"), F.col("component").alias("root"))
    roots = comp.join(second, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    # components of one document may have been linked as such
    roots = roots.unionByName(second.join(comp.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("id"), F.col("root").alias("component")))

    out = classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id"))
    out = join_spread(signatures.select("doc_id", "fp", F.col("n_shingles").cast("long").alias("n_shingles")), written(out, "class-components"), "fp", F.unhex(F.md5(F.col("doc_id").cast("string").cast("binary"))))
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("found.component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), (F.col("doc_id") == own).alias("kept"))


def dealt(rows: DataFrame) -> DataFrame:
    """The members of open buckets in groups (bucket, kind, p, q): blocks of the main component with blocks of the others (kind 0), and
    blocks of the others with one another (kind 1). Members of the main component are copied once for each block of the
    others, so a large group that is already connected costs its size, not its square."""
    hash_ = F.xxhash64("rep", "fp")
    gm, go = F.col("found.gm"), F.col("found.go")
    each = lambda g: F.sequence(F.lit(0), g - 1)
    group = lambda kind, p, q, side: F.struct(F.lit(kind).alias("kind"), p.cast("int").alias("p"), q.cast("int").alias("q"), side.cast("int").alias("side"))
    in_main, in_rest = F.pmod(hash_, gm).cast("int"), F.pmod(hash_, go).cast("int")
    main = F.transform(each(go), lambda o: group(0, in_main, o, F.lit(0)))
    rest = F.concat(F.transform(each(gm), lambda m: group(0, m, in_rest, F.lit(1))), F.transform(each(go), lambda o: group(1, F.least(o, in_rest), F.greatest(o, in_rest), in_rest > o)))
    return rows.withColumn("group", F.explode(F.when(F.col("component") == F.col("found.main"), main).otherwise(rest))).select("*", "group.*")


def full_sets(ids: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    """(rep, fp, shingles) of the classes ``ids`` (rep, fp), from the texts of ``docs``: only rows of their ids leave the scan, and these
    meet the ids at the scan if they are few (counted), else both are shuffled. Equal rows are combined before the shuffle."""
    ids = written(ids, "candidates")
    texts = docs.where("doc_id is not null").withColumnRenamed("doc_id", "rep").join(maybe_broadcast(ids, ids.count(), 104), "rep").select("rep", "fp", "text")

    def sets(batches):
        for b in batches:
            ids, fps, texts = (c.to_pylist() for c in b.columns)
            out = [(i, fp, s.tobytes()) for i, fp, s in zip(ids, fps, shingle_sets(texts, shingle), strict=True) if fingerprint(s) == fp]
            yield from arrow_rows("rep long, fp binary, shingles binary", list(zip(*out, strict=True)) or [[], [], []], 256)

    found = texts.mapInArrow(sets, "rep long, fp binary, shingles binary")
    return written(found.groupBy("rep", "fp").agg(F.first("shingles").alias("shingles")), "sets")


def verified(stars: DataFrame, docs: DataFrame, threshold_percent: int, shingle: int, block: int) -> DataFrame:
    """Those pairs (a, b) of centers and members (a, fa, b, fb, nb) whose full sets are similar enough. Members meet their center in
    blocks, to each of which the center's set is sent once."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("rep"), F.col("fa").alias("fp")), F.struct(F.col("b").alias("rep"), F.col("fb").alias("fp")))).alias("x")
    sets = full_sets(stars.select(ends).select("x.*").distinct(), docs, shingle)
    sizes = stars.groupBy("a", "fa").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("nb") * 8 / GROUP_BYTES)).cast("int").alias("g"), F.count("*").alias("n"))
    sizes = written(sizes, "star-sizes")
    place: Column = F.pmod(F.xxhash64("rep", "fp"), F.col("found.g")).cast("int")
    members = join_spread(stars.select(F.struct("a", "fa").alias("center"), F.col("b").alias("rep"), F.col("fb").alias("fp")), sizes.select(F.struct("a", "fa").alias("center"), "g", "n"), "center", F.struct(F.xxhash64("rep", "fp").alias("a"), F.col("fp").alias("fa")))
    members = members.select("center.a", "center.fa", place.alias("k"), "rep", "fp", F.lit(False).alias("first"))
    heads = sizes.select("a", "fa", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("k"), F.col("a").alias("rep"), F.col("fa").alias("fp"), F.lit(True).alias("first"))

    def similar(g: dict):
        first = g["first"].to_numpy(zero_copy_only=False)
        head = np.frombuffer(g["shingles"][int(np.flatnonzero(first)[0])].as_py(), np.uint64)
        out = []
        for i in np.flatnonzero(~first).tolist():
            other = np.frombuffer(g["shingles"][i].as_py(), np.uint64)
            n = common(head, other)
            if 100 * n >= threshold_percent * (len(head) + len(other) - n):
                out.append(g["rep"][i].as_py())
        return ([g["a"][0].as_py()] * len(out), out) if out else None

    both = members.unionByName(heads).join(sets, ["rep", "fp"])
    return written(map_groups(both, ["a", "fa", "k"], similar, "a long, b long"), "verified")
