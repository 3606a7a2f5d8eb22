"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from doclattice.llm.shared import mix64

#: Bytes hashed at once, so that the arrays stay in a core's cache whatever a text's or a word's length.
STEP = 1 << 16
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
MASK = (1 << 64) - 1
#: Powers of the base and of its inverse modulo 2^64, and a number for each byte.
POWERS, INVERSES = (np.multiply.accumulate(np.array([1] + [b] * (STEP - 1), np.uint64)) for b in (BASE, UNBASE))
NUMBERS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
IN_WORD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words' 64-bit hashes and starts. A word's hash is the polynomial of its bytes' numbers in ``BASE``: the difference of
    two prefix sums over all bytes, divided by the power at its start."""
    data = np.frombuffer(raw, np.uint8)
    places, sums, shifts = [], [], []
    inside, total, power, unpower = False, 0, 1, 1
    for at in range(0, len(data), STEP):
        part = data[at : at + STEP]
        word = IN_WORD[part]
        edges = np.flatnonzero(np.diff(word, prepend=inside))
        terms = NUMBERS[part] * POWERS[: len(part)]
        upto = np.cumsum(terms)
        places.append(edges + at)
        sums.append((upto[edges] - terms[edges]) * np.uint64(power) + np.uint64(total))
        shifts.append(INVERSES[edges] * np.uint64(unpower))
        inside, total = bool(word[-1]), (total + int(upto[-1]) * power) & MASK
        power, unpower = (power * pow(BASE, STEP, 1 << 64)) & MASK, (unpower * pow(UNBASE, STEP, 1 << 64)) & MASK
    if inside:
        places.append(np.array([len(data)])), sums.append(np.array([total], np.uint64)), shifts.append(np.zeros(1, np.uint64))
    if not places:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    sums_, shifts_ = np.concatenate(sums), np.concatenate(shifts)
    return (sums_[1::2] - sums_[::2]) * shifts_[::2], np.concatenate(places)[::2]


def combined(h: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` neighbouring word hashes."""
    n = max(0, len(h) - size + 1)
    out = np.full(n, size, np.uint64)
    for at in range(0, n, STEP):
        part = out[at : at + STEP]
        for k in range(size):
            part = mix64(part ^ h[at + k : at + k + len(part)])
        out[at : at + STEP] = part
    return out


def shingle_sets(texts: Sequence[str | None], size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of the ``size``-word shingles of all of it; with fewer words the one of all words;
    none without words. Words are runs of other characters than space and the controls 9 to 13, A-Z lower-cased:
    which is what ``bytes.lower`` does with UTF-8. Different shingles share a 64-bit hash with negligible probability
    (under 1e-9 for a set of 50,000). All words of the texts are hashed in one pass."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    h, starts = word_hashes(b"\n".join(raw))
    bounds = np.searchsorted(starts, np.cumsum([0] + [len(r) + 1 for r in raw])).tolist()
    runs = combined(h, size)
    out = []
    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
        got = np.sort(runs[s : e - size + 1] if e - s >= size else combined(h[s:e], e - s) if e > s else h[:0])
        out.append(got[np.append(True, got[1:] != got[:-1])] if len(got) else got)
    return out


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    return shingle_sets([text], size)[0]


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted distinct arrays share."""
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())
