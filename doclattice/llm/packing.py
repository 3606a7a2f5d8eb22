"""Packing documents into sequences by linear grouping: few rounded sizes, optimised configurations, real documents, best fit."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclattice.llm.shared import arrow_rows, columns, maybe_broadcast, written
from doclattice.llm.word_tokens import chunks

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 600) -> list[tuple[np.ndarray, int]]:
    """Configurations (how many of each size) with their numbers of bins, which hold at least ``need`` of each size.

    The linear programme over all configurations is solved by column generation: a basis of as many configurations as
    sizes, the sizes' prices from it, and the best configuration at these prices from a knapsack over the capacity. The
    whole parts of the solution are taken; the rest, fewer bins than sizes, is packed first fit decreasing."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x, price = inverse @ need, np.ones(k) @ inverse
        worth, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            fits = np.flatnonzero(sizes <= c)
            v = worth[c - sizes[fits]] + price[fits]
            i = int(v.argmax())
            worth[c], pick[c] = (v[i], fits[i]) if v[i] > worth[c - 1] + 1e-12 else (worth[c - 1], -1)
        if worth[capacity] <= 1 + 1e-7:
            break
        new, c = np.zeros(k), capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                new[pick[c]] += 1
                c -= sizes[pick[c]]
        d = inverse @ new
        out = np.flatnonzero(d > 1e-9)
        basis[:, out[np.argmin(np.maximum(x[out], 0) / d[out])]] = new
    x = np.maximum(np.linalg.solve(basis, need), 0)
    whole = np.floor(x + 1e-9).astype(np.int64)
    chosen, left = [], need.astype(np.int64).copy()
    for i in np.argsort(-x):
        if whole[i]:
            a = basis[:, i].astype(np.int64)
            chosen.append((a, int(whole[i])))
            left -= a * whole[i]
    bins: list[list] = []
    for g in np.argsort(-sizes):
        for _ in range(max(0, int(left[g]))):
            b = next((b for b in bins if b[0] >= sizes[g]), None)
            if b is None:
                bins.append(b := [capacity, np.zeros(k, np.int64)])
            b[0] -= sizes[g]
            b[1][g] += 1
    return chosen + [(b[1], 1) for b in bins]


def grouped_plan(counts: dict[int, int], capacity: int, groups: int, small: float) -> tuple[int, np.ndarray]:
    """The number of sequences, and places for the pieces of each length, as rows (length, first, n, sequence, each, offset).

    The ``first``-th to ``first + n - 1``-th piece of that length go to the sequences from ``sequence`` on, ``each`` in a row
    to one sequence, from ``offset`` on. Sequences that are filled alike are handled as one run, so that the
    plan's size and the time for it depend on the number of lengths (at most ``capacity``), not on that of documents.

    Lengths over ``small`` of the capacity are divided into ``groups`` of equal cardinality by size and rounded up to the
    largest of their group; after the configurations are found, the real lengths take the rounded places, and what that
    leaves free, together with the rest of the sequences, is filled by the small lengths, longest first, best fit."""
    rows: list[tuple[int, ...]] = []
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # space left -> runs (first sequence, sequences)

    def put(length: int, n: int, seq: int, each: int, offset: int) -> None:
        rows.append((length, taken[length], n, seq, each, offset))
        taken[length] += n

    large = sorted((x for x in counts if small * capacity < x < capacity and counts[x] > 0), reverse=True)
    total = sum(counts[x] for x in large)
    if total:
        share = -(-total // min(groups, total))
        members: list[list[list[int]]] = [[]]
        room = share
        for x in large:
            n = counts[x]
            while n:
                if not room:
                    members.append([])
                    room = share
                m = min(n, room)
                members[-1].append([x, m])
                n, room = n - m, room - m
        sizes = np.array([g[0][0] for g in members])
        need = np.array([sum(n for _, n in g) for g in members], float)
        unique, back = np.unique(sizes, return_inverse=True)  # groups that round to one length are one
        stock: list[list[list[int]]] = [[] for _ in unique]
        for g, i in zip(members, back, strict=True):
            stock[i] += g
        for s in stock:
            s.sort()  # the largest lengths are taken first, from the end
        for a, bins in configurations(unique, np.bincount(back, need), capacity):
            slots = [i for i in np.argsort(-unique) for _ in range(a[i])]
            at = 0
            while at < bins:  # a run of sequences in which each slot has one length
                here = [i for i in slots if stock[i]]
                use: dict[int, int] = defaultdict(int)
                run = bins - at
                for i in here:
                    use[i] += 1
                lengths = []
                for i, m in use.items():
                    # all m slots of a size take the same length if there are enough of it, else what is there, one sequence at a time
                    if stock[i][-1][1] >= m:
                        run = min(run, stock[i][-1][1] // m)
                    else:
                        run = 1
                if not use:
                    break
                used = 0
                for i, m in use.items():
                    if run > 1 or stock[i][-1][1] >= m:
                        lengths.append((i, stock[i][-1][0], m))
                    else:
                        left = m
                        for x, n in reversed(stock[i]):
                            k = min(left, n)
                            lengths.append((i, x, k))
                            left -= k
                            if not left:
                                break
                for i, x, m in lengths:
                    put(x, m * run, sequence, m, used)
                    used += m * x
                    stock[i][-1][1] -= m * run
                    if not stock[i][-1][1]:
                        stock[i].pop()
                free[capacity - used].append((sequence, run))
                sequence += run
                at += run
    for x in sorted((x for x in counts if 0 < x <= small * capacity), reverse=True):
        n = counts[x]
        while n:
            space = min((s for s, runs in free.items() if s >= x and runs), default=None)
            if space is None:
                each = capacity // x
                free[capacity].append((sequence, -(-n // each)))
                sequence += -(-n // each)
                continue
            seq, bins = free[space].pop()
            each = space // x
            full = min(bins, n // each)
            if full:
                put(x, full * each, seq, each, capacity - space)
                free[space - each * x].append((seq, full))
                n -= full * each
            if full < bins and n and n < each:
                put(x, n, seq + full, n, capacity - space)
                free[space - n * x].append((seq + full, 1))
                full, n = full + 1, 0
            if full < bins:
                free[space].append((seq + full, bins - full))
    if counts.get(capacity):
        put(capacity, counts[capacity], sequence, 1, 0)
        sequence += counts[capacity]
    return sequence, np.array(sorted(rows), np.int64).reshape(-1, 6)


def plan(counts: dict[int, int], capacity: int = 2048, groups: int = 48, borders: tuple[float, ...] = (0.2, 0.35, 0.5)) -> np.ndarray:
    """The places of the grouping with the fewest sequences, among several borders between small and large lengths: the more lengths
    count as large, the more rounding there is, the fewer, the more is left to best fit."""
    return min((grouped_plan(counts, capacity, groups, b) for b in borders), key=lambda x: x[0])[1]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """The documents' ids, each document's closed by ``end``, cut where they are longer than ``capacity``; with the task that made a
    piece (``part``) and the number of earlier pieces of the same length there (``nth``)."""
    ddl = PIECES + (", ids binary" if with_ids else "")

    def cut(batches):
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        encode, close = chunks(tokenizer).ids, int(end).to_bytes(4, "little")
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(t) + close
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    x = ids[at : at + 4 * capacity]
                    n = len(x) // 4
                    for o, v in zip(out, (i, k, at // 4, n, zlib.crc32(x), part, seen[n], x if with_ids else None), strict=True):
                        o.append(v)
                    seen[n] += 1
            yield from arrow_rows(ddl, out if with_ids else out[:7])

    return columns(docs, "doc_id", "text").mapInArrow(cut, ddl)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset (, ids).

    The pieces are written once; then only the numbers of pieces by length reach the driver (at most ``capacity`` rows),
    where the plan is made. A piece's place among those of its length is its number in its task plus a prefix sum
    over tasks, so no length's pieces need to meet in one task. A null text is like an empty one: one piece of ``end``
    alone. Every row counts, repeated and null doc_ids too. No rows give none. Further columns are not read.
    """
    table = written(pieces(docs, tokenizer, capacity, end, with_ids), "pieces")
    parts = written(table.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = plan(counts, capacity)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = parts.select("part", "length", before.alias("before"))
    rows = table.join(maybe_broadcast(base, parts.count(), 128), ["part", "length"]).withColumn("nth", F.col("nth") + F.col("before"))
    names = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    key = (places[:, 0] << 48) | places[:, 1]

    def place(batches):
        for b in batches:
            length, nth = b.column(3).to_numpy(), b.column(5).to_numpy()
            r = places[np.searchsorted(key, (length << 48) | nth, "right") - 1] if len(places) else np.empty((0, 6), np.int64)
            i = nth - r[:, 1]
            yield from arrow_rows(names, [b.column(c) for c in range(5)] + [r[:, 3] + i // r[:, 4], r[:, 5] + i % r[:, 4] * length] + ([b.column(6)] if with_ids else []))

    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "nth", *(["ids"] if with_ids else [])).mapInArrow(place, names)
