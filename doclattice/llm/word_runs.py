"""Runs of repeated words: maximal periodic stretches of whole texts, found from their Lyndon roots, and texts without the repeats.

Every run of exponent 2 or more begins, within its first period, a longest Lyndon word of its period's length under the order of
words or under the reverse one. A stack that is scanned from right to left gives these Lyndon words: suffixes are compared by their
longest common extension, which prefix hashes find by binary search and words confirm. There is no suffix array."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable
from itertools import count

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.llm.shared import arrow_rows, columns, small_batches

PRIME, BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E681
#: So many words are compared one by one before hashes are asked.
NEAR = 8


class Extensions:
    """Common extensions of a sequence of numbers at two places. What a hash says is confirmed on the numbers; a stretch
    in which words ``p`` apart were confirmed to be equal is kept by ``p`` while the scan moves on to the left, so that none
    is confirmed again at each of its places."""

    def __init__(self, words: list[int]):
        self.words, self.raw = words, np.array(words, np.int64).tobytes()
        self.sums: list[int] = []
        self.powers: list[int] = []
        self.spans: dict[int, tuple[int, int]] = {}

    def prepare(self) -> None:
        total, power, self.sums, self.powers = 0, 1, [0], [1]
        for w in self.words:
            total = (total * BASE + w + 1) % PRIME
            power = power * BASE % PRIME
            self.sums.append(total)
            self.powers.append(power)

    def same(self, i: int, j: int, n: int) -> bool:
        return self.raw[8 * i : 8 * (i + n)] == self.raw[8 * j : 8 * (j + n)]

    def longest(self, least: int, most: int, equal: Callable[[int], bool]) -> int:
        """The largest length from ``least`` on, where it holds, to ``most`` for which ``equal`` holds."""
        while least < most:
            mid = (least + most + 1) // 2
            if equal(mid):
                least = mid
            else:
                most = mid - 1
        return least

    def right(self, i: int, j: int) -> int:
        """How many words from ``i`` on equal those from ``j`` on; i < j."""
        w, n = self.words, len(self.words)
        most = n - j
        for k in range(min(NEAR, most)):
            if w[i + k] != w[j + k]:
                return k
        if most <= NEAR:
            return most
        p = j - i
        low, high = self.spans.get(p, (n, n))
        if low - NEAR <= i < high:
            self.spans[p] = (min(i, low), high)
            return high - i
        if not self.sums:
            self.prepare()
        s, powers = self.sums, self.powers
        by_hash = lambda k: (s[i + k] - s[j + k] - (s[i] - s[j]) * powers[k]) % PRIME == 0
        k = self.longest(NEAR, most, by_hash)
        until = min(k, low - i) if i < low <= i + k else k
        if not self.same(i, j, until):
            return self.longest(NEAR, until, lambda m: self.same(i, j, m))
        k = until if until == k else high - i
        self.spans[p] = (i, i + k)
        return k

    def left(self, i: int, j: int, most: int) -> int:
        """How many words before ``i`` equal those before ``j``, ``most`` of them at most; i < j."""
        w, most = self.words, min(most, i)
        for k in range(min(NEAR, most)):
            if w[i - 1 - k] != w[j - 1 - k]:
                return k
        if most <= NEAR:
            return most
        if not self.sums:
            self.prepare()
        s, powers = self.sums, self.powers
        by_hash = lambda k: (s[i] - s[j] - (s[i - k] - s[j - k]) * powers[k]) % PRIME == 0
        k = self.longest(NEAR, most, by_hash)
        return k if self.same(i - k, j - k, k) else self.longest(NEAR, k, lambda m: self.same(i - m, j - m, m))


def lyndon_runs(words: list[int], exponent: int = 4, least: int = 6) -> set[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence with length >= max(least, exponent * period); exponent >= 3.

    ``after[i]`` is the end of the longest Lyndon word that begins at i: the nearest later place whose suffix is smaller. Of
    the roots of a run only one in its first period is extended; from there the run goes on for exponent - 2 periods at least
    beyond the root, which is asked first."""
    n, found = len(words), set()
    ext = Extensions(words)
    for ascending in (True, False):
        ext.spans.clear()
        after = [n] * (n + 1)
        for i in range(n - 1, -1, -1):
            j, a = i + 1, words[i]
            while j < n:
                b = words[j]
                if a == b:
                    k = ext.right(i, j)
                    if j + k == n:
                        break
                    if (words[i + k] < words[j + k]) != ascending:
                        break
                elif (a < b) != ascending:
                    break
                j = after[j]
            after[i] = j
            p = j - i
            if j < n and a == words[j] and j + (exponent - 2) * p <= n and (k := ext.right(i, j)) >= (exponent - 2) * p:
                back = ext.left(i, j, p + 1)
                length = back + p + k
                if back <= p and length >= max(least, exponent * p):
                    found.add((i - back, length, p))
    return found


def stretches(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray, exponent: int = 4, least: int = 6) -> list[tuple[int, int]]:
    """Disjoint stretches (start, end) of the documents' words, one after the other, outside of which no run can reach.

    In a run of period q each word but the last q comes again within q words. So (exponent - 1) * q successive words at least
    come again within any t >= q; that is asked for t = 1, 2, 4, ..., each standing for the periods above t / 2. With t further
    words at its end such a stretch holds the run as a whole; stretches that overlap are one."""
    n = len(ids)
    order = np.lexsort((ids, doc)) if n else np.empty(0, np.int64)
    again = np.full(n, n + 1, np.int64)
    if n > 1:
        a, b = order[:-1], order[1:]
        same = (ids[a] == ids[b]) & (doc[a] == doc[b])
        again[a[same]] = (b - a)[same]
    longest = int(np.diff(ends, prepend=0).max(initial=0))
    pieces, t = [], 1
    while True:
        q = t // 2 + 1
        need = max(least - q, (exponent - 1) * q)
        if need + q > longest:
            break
        edges = np.flatnonzero(np.diff(np.concatenate([[False], again <= t, [False]]).astype(np.int8)))
        s, e = edges[::2], edges[1::2]
        hit = e - s >= need
        s, e = s[hit], e[hit]
        pieces += zip(s.tolist(), np.minimum(e + t, ends[doc[s]]).tolist(), strict=True)
        t *= 2
    out: list[tuple[int, int]] = []
    for s, e in sorted(pieces):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; of equal ones the first, then that of the least period."""
    best = None
    for r in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
RUN_DDL = "doc_id long, start long, length long, period long"


def passes(emit: Callable, ddl: str, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None, exponent: int, least: int):
    """An Arrow pass over (doc_id, text as bytes) that gives each document's words and runs to ``emit`` and yields its columns."""

    def each(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            # bytes.split() parts at 0x20 and 0x09 to 0x0D, and nowhere inside a character of UTF-8
            texts = [(t.as_py() or b"").split() for t in b.column(1)]
            if rewrite:
                texts = [rewrite(i, w) for i, w in zip(ids, texts, strict=True)]
            vocab: defaultdict[bytes, int] = defaultdict(count().__next__)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            ends = np.cumsum(sizes)
            words = np.fromiter((vocab[w] for t in texts for w in t), np.int32, int(sizes.sum()))
            doc = np.repeat(np.arange(len(texts)), sizes)
            runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for s, e in stretches(words, doc, ends, exponent, least):
                d = int(doc[s])
                first = s - int(ends[d] - sizes[d])
                runs[d] += [(first + at, length, p) for at, length, p in lyndon_runs(words[s:e].tolist(), exponent, least)]
            yield from arrow_rows(ddl, list(zip(*(x for i, t, r in zip(ids, texts, runs, strict=True) for x in emit(i, t, sorted(r, key=lambda x: (x[0], x[2])))), strict=True)) or [[]] * len(ddl.split(", ")))

    return each


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document whose decimal id has a crc32 that 10 divides, with a tail that repeats a part of them; others as they are."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * -(-(n - a) // p))[: n - a]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that a run repeats: its words after the first period."""
    if runs:
        depth = np.zeros(len(words) + 1, np.int64)
        for s, n, p in runs:
            depth[s + p] += 1
            depth[s + n] -= 1
        words = [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]
    return b" ".join(words)


def word_runs(docs: DataFrame, rewrite: Callable | None = None, exponent: int = 4, least: int = 6) -> DataFrame:
    """(doc_id, start, length, period): each run of the documents' words as a row, places counted from 0. Results as in ``run_digests``."""
    small_batches(docs.sparkSession)
    emit = lambda i, words, runs: [(i, *r) for r in runs]
    return columns(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(passes(emit, RUN_DDL, rewrite, exponent, least), RUN_DDL)


def without_repeats(docs: DataFrame, rewrite: Callable | None = None, exponent: int = 4, least: int = 6) -> DataFrame:
    """(doc_id, n_runs, text): the texts with the words of each run after its first period left out, words joined by one space."""
    small_batches(docs.sparkSession)
    emit = lambda i, words, runs: [(i, len(runs), collapsed(words, runs))]
    ddl = "doc_id long, n_runs long, text binary"
    out = columns(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(passes(emit, ddl, rewrite, exponent, least), ddl)
    return out.withColumn("text", F.col("text").cast("string"))


def run_digests(docs: DataFrame, rewrite: Callable | None = None, exponent: int = 4, least: int = 6) -> DataFrame:
    """One row for each row of ``docs``: (doc_id, n_runs; start, length, period, exponent_milli of the run with the greatest
    exponent, null without any; runs_sha256 of all runs' lines "start,length,period"; collapsed_sha256 of the text without repeats).

    Words are what lies between ASCII white space, compared by their bytes. A run is a maximal stretch of words with smallest
    period q and at least max(least, exponent * q) words. ``rewrite`` may change a document's words by its id first. Null and empty texts
    have no words and no runs; repeated and null doc_ids keep their rows; further columns are not read; an empty table gives an empty
    one. A text is held by one task as a whole, a very long one in a batch of its own: memory is in proportion to the longest text.
    Time is near to linear in its words, whatever their repeats: a text of one word alone included."""
    small_batches(docs.sparkSession)

    def emit(i, words, runs):
        best = greatest(runs)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        milli = 1000 * best[1] // best[2] if best else None
        return [(i, len(runs), *(best or (None,) * 3), milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs)).hexdigest())]

    return columns(docs, "doc_id", "text").select("doc_id", F.col("text").cast("binary").alias("t")).mapInArrow(passes(emit, DDL, rewrite, exponent, least), DDL)
