"""Secrets in texts: fixed patterns, and formats learned from them as probabilistic automata by merging prefix-tree states."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.llm.shared import arrow_rows, beside, columns, small_batches, written

KINDS = ("assign", "access", "hex", "format")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What may be a credential without a pattern of its own: runs from the shortest length that a labelled one has.
LEAST = 6
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
LONG = 20
#: Classes of characters, the automata's alphabet: digits, letters of hexadecimal numbers and others in both cases, signs, all else.
CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/_.=-")
ELSE = len(CLASSES)
CLASS_OF = np.full(256, ELSE, np.uint8)
for _i, _c in enumerate(CLASSES):
    CLASS_OF[list(_c.encode())] = _i
CLASS_TABLE = CLASS_OF.tobytes()


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, credential) of the fixed patterns, by start and kind. The searches for long runs are left out for texts
    without a long stretch between white space, in which they can't match."""
    low = text.lower()
    found = []
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST]
    if max(map(len, text.split()), default=0) >= LONG:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)] if "AKIA" in text else []
        found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def covered(spans: list[tuple]) -> list[tuple[int, int]]:
    """The stretches that spans (start, kind, end, ...) cover, in order; the spans are in the order of their starts."""
    out: list[tuple[int, int]] = []
    for start, _, end, *_ in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def replaced(text: str, spans: list[tuple], by: Callable[[int], str]) -> str:
    """The text with ``by(length)`` in the place of each covered stretch, put together once."""
    parts, at = [], 0
    for start, end in covered(spans):
        parts += [text[at:start], by(end - start)]
        at = end
    return "".join([*parts, text[at:]])


def class_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(CLASS_TABLE)


def classes(text: str) -> np.ndarray:
    return np.frombuffer(class_bytes(text), np.uint8)


@dataclass
class Automaton:
    """A deterministic probabilistic automaton: for each state the next states (-1: none), log weights of symbols and of the end."""

    step: list[list[int]]
    weight: list[list[float]]
    end: list[float]
    missing: float = math.log(1e-4)

    def log_likelihood(self, symbols: np.ndarray) -> float:
        """Unknown transitions cost ``missing`` and stay."""
        state, total = 0, 0.0
        for s in symbols.tolist():
            nxt = self.step[state][s]
            total += self.missing if nxt < 0 else self.weight[state][s]
            state = state if nxt < 0 else nxt
        return total + self.end[state]


def infer(strings: list[tuple[np.ndarray, int]], alpha: float = 0.01) -> Automaton:
    """State merging over the prefix tree of the strings (symbols, number): states in order of depth are merged into the first
    accepted state from which they don't differ, by Hoeffding's bound at level ``alpha``, in the share of ends and of each
    symbol, nor do the states below them; what no accepted state matches is accepted. The tree holds whole strings."""
    size = ELSE + 1
    seen, ends, child, flow = [0], [0], [[-1] * size], [[0] * size]
    for symbols, n in strings:
        at = 0
        for s in symbols.tolist():
            seen[at] += n
            flow[at][s] += n
            if child[at][s] < 0:
                child[at][s] = len(seen)
                seen.append(0), ends.append(0), child.append([-1] * size), flow.append([0] * size)
            at = child[at][s]
        seen[at] += n
        ends[at] += n
    spread = math.sqrt(0.5 * math.log(2 / alpha))

    def alike(a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = seen[a], seen[b]
            if not n or not m:
                continue
            bound = spread * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(ends[a] / n - ends[b] / m) > bound or any(abs(x / n - y / m) > bound for x, y in zip(flow[a], flow[b], strict=True)):
                return False
            stack += [(x, y) for x, y in zip(child[a], child[b], strict=True) if x >= 0 and y >= 0 and x != y]
        return True

    def fold(parent: int, symbol: int, into: int) -> None:
        start, child[parent][symbol] = child[parent][symbol], into
        stack = [(into, start)]
        while stack:
            a, b = stack.pop()
            seen[a] += seen[b]
            ends[a] += ends[b]
            for s in range(size):
                flow[a][s] += flow[b][s]
                if child[b][s] >= 0:
                    if child[a][s] < 0:
                        child[a][s] = child[b][s]
                    elif child[a][s] != child[b][s]:
                        stack.append((child[a][s], child[b][s]))

    accepted = [0]
    inside = {0}
    while True:
        border = next(((r, s) for r in accepted for s in range(size) if child[r][s] >= 0 and child[r][s] not in inside), None)
        if border is None:
            break
        r, s = border
        blue = child[r][s]
        into = next((a for a in accepted if alike(a, blue)), None)
        if into is None:
            accepted.append(blue)
            inside.add(blue)
        else:
            fold(r, s, into)
    number = {a: i for i, a in enumerate(accepted)}
    log = lambda x, n: math.log((x + 0.01) / (n + 0.01 * (size + 1)))
    return Automaton([[number[c] if c >= 0 else -1 for c in child[a]] for a in accepted], [[log(x, seen[a]) for x in flow[a]] for a in accepted], [log(ends[a], seen[a]) for a in accepted])


@dataclass
class Formats:
    """The automata of the labelled kinds, and the chain of classes in ordinary text that they are held against."""

    automata: list[Automaton]
    chain: np.ndarray
    margin: float
    #: Gains of short strings by their classes: ordinary words have few different ones.
    held: dict[bytes, float] = field(default_factory=dict)

    def gain(self, text: str) -> float:
        """By how much (in nats) the likeliest format explains the string better than ordinary text does."""
        if not self.automata:
            return -math.inf
        known = class_bytes(text)
        if (got := self.held.get(known)) is not None:
            return got
        c = np.frombuffer(known, np.uint8)
        around = np.concatenate([[ELSE], c, [ELSE]])
        got = max(a.log_likelihood(c) for a in self.automata) - float(self.chain[around[:-1], around[1:]].sum())
        if len(known) <= 64:
            if len(self.held) >= 100_000:
                self.held.clear()
            self.held[known] = got
        return got

    def spans(self, text: str | None) -> list[tuple[int, int, int, str]]:
        """The base spans, and candidates that no base span touches and that gain at least ``margin``, by start and kind."""
        text = text or ""
        found = base_spans(text)
        likely = {x for x in set(CANDIDATE.findall(text)) if self.gain(x) >= self.margin}
        if not likely:
            return found
        starts, ends = map(list, zip(*covered(found), strict=True)) if found else ([], [])
        more = []
        for m in CANDIDATE.finditer(text):
            if m[0] in likely:
                k = bisect_left(ends, m.start() + 1)  # the first stretch that ends after the candidate's start
                if k == len(ends) or starts[k] >= m.end():
                    more.append((m.start(), 3, m.end(), m[0]))
        return sorted(found + more)


def learn_formats(docs: DataFrame, strings_per_kind: int = 1000, margin: float = 10.0) -> Formats:
    """Formats from all texts of ``docs``: the credentials in base spans are the labelled strings, their kinds the labels.

    Distinct credentials are counted over all texts; of each kind the ``strings_per_kind`` with the least hash, a bounded sample
    of labelled rows, make the automaton. Pairs of neighbouring
    classes outside base spans are counted over all documents: the ordinary text."""

    def gather(batches):
        size = ELSE + 1
        pairs = np.zeros(size * size, np.int64)
        held: dict[tuple[int, str], int] = {}

        def flush():
            yield from arrow_rows("kind int, value string, n long", [[k for k, _ in held], [v for _, v in held], list(held.values())])
            held.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                found = base_spans(t or "")
                c = classes(replaced(t or "", found, lambda n: " " * n)).astype(np.int64)
                pairs += np.bincount(np.concatenate([[ELSE], c]) * size + np.concatenate([c, [ELSE]]), minlength=size * size)
                for _, kind, _, value in found:
                    held[kind, value] = held.get((kind, value), 0) + 1
                if len(held) > 10_000:
                    yield from flush()
        yield from flush()
        hit = np.flatnonzero(pairs)
        yield from arrow_rows("kind int, value string, n long", [[-1] * len(hit), [str(i) for i in hit], pairs[hit]])

    rows = columns(docs, "text").mapInArrow(gather, "kind int, value string, n long")
    rows = written(rows.groupBy("kind", "value").agg(F.sum("n").alias("n")), "credentials")
    size = ELSE + 1
    pairs = np.ones(size * size)
    for r in rows.where("kind = -1").collect():  # at most 49 rows
        pairs[int(r["value"])] += r["n"]
    pairs = pairs.reshape(size, size)
    automata = []
    for kind in range(3):
        got = rows.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(strings_per_kind).collect()
        if got:
            automata.append(infer([(classes(r["value"]), r["n"]) for r in got]))
    return Formats(automata, np.log(pairs / pairs.sum(1, keepdims=True)), margin)


def find_secrets(docs: DataFrame, formats: Formats | None = None) -> DataFrame:
    """``docs`` with further columns n_assign, n_access, n_hex, n_format, base, spans (kind:start:end joined by commas) and redacted.

    Positions are code points, ends exclusive; ``redacted`` has [SECRET] in the place of each stretch that spans cover; spans
    that only touch are stretches of their own. A null text has no spans and stays null; an empty one stays empty; each
    row counts on its own, repeated ones too. Work is linear in a text's length but for sorting its spans. Columns of
    ``docs`` with a new one's name are left out. Without rows nothing is learned and none returned."""
    small_batches(docs.sparkSession)
    formats = formats or learn_formats(docs)

    @F.pandas_udf("counts array<long>, base string, spans string, redacted string")
    def scan(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            found = formats.spans(t)
            named = [f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in found]
            counts = np.bincount([k for _, k, _, _ in found], minlength=4).tolist() if found else [0] * 4
            out.append((counts, ",".join(x for x in named if x[0] != "f"), ",".join(named), replaced(t, found, lambda n: "[SECRET]") if found else t))
        return pd.DataFrame(out, columns=["counts", "base", "spans", "redacted"])

    new = {f"n_{k}": F.col("__s.counts")[i] for i, k in enumerate(KINDS)} | {c: F.col(f"__s.{c}") for c in ("base", "spans", "redacted")}
    return beside(docs, ["text"], lambda plain, text: (plain.withColumn("__s", scan(text)), new))
