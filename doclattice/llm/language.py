"""Language identification by rank-order n-gram profiles and out-of-place distances."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclattice.llm.shared import arrow_rows, beside, columns, small_batches, written

#: N-grams in a profile, of a language and of a document.
PROFILE = 300
#: Part of the largest distance by which two languages must differ for the score to change by a factor of e.
SOFT = 0.05
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether code points below 0x250 are letters."""
    return np.array([chr(c).isalpha() for c in range(0x250)])


def letter_codes(text: str) -> np.ndarray:
    """The code points of letters in lower case, with one 0 for each run of other characters, and at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(points, 0x24F)]
    high = points >= 0x250
    if high.any():
        kinds = np.unique(points[high])
        letter[high] = np.array([chr(c).isalpha() for c in kinds])[np.searchsorted(kinds, points[high])]
    out = np.concatenate([[0], np.where(letter, points, 0).astype(np.int64), [0]])
    return out[np.append(True, (out[1:] != 0) | (out[:-1] != 0))]


def grams(c: np.ndarray) -> np.ndarray:
    """Letters, pairs and triples of letters within words as different numbers; a word's ends count as a letter of pairs and
    triples (of words of two letters or more). A code point has 21 bits: letters are numbers below 2^21, triples above, pairs below 0."""
    a, b = c[:-1], c[1:]
    two = -((a << 21) | b)[(a | b) != 0]
    x, y, z = c[:-2], c[1:-1], c[2:]
    three = ((x << 42) | (y << 21) | z)[(y != 0) & ((x | z) != 0)]
    return np.concatenate([c[c != 0], two, three])


def ranked(values: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent values, most frequent first, ties to the smaller value."""
    return values[np.lexsort((values, -counts))[:size]]


def counted(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    g.sort()
    at = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.empty(0, np.int64)
    return g[at], np.diff(np.append(at, len(g)))


def learn_profiles(df: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """The ``size`` most frequent n-grams of each non-null language over all rows of ``df``.

    Counts are combined in each task before they are shuffled by (language, n-gram). What comes to the driver has
    ``size`` numbers a language, for all of them: the model grows with the languages that the labels name, not with rows."""

    def count(batches):
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            texts: dict[str, list[str]] = {}
            for t, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts.setdefault(k, []).append(t)
            for k, group in texts.items():
                parts, chars = [], 0
                for i, t in enumerate(group):
                    parts.append(grams(letter_codes(t)))
                    chars += len(t)
                    if chars > 1_000_000 or i + 1 == len(group):
                        v, n = counted(np.concatenate(parts))
                        if k in held:
                            v, back = np.unique(np.concatenate([held[k][0], v]), return_inverse=True)
                            n = np.bincount(back, np.concatenate([held[k][1], n])).astype(np.int64)
                        held[k] = v, n
                        parts, chars = [], 0
        for k, (v, n) in held.items():
            yield from arrow_rows("lang string, gram long, n long", [[k] * len(v), v, n])

    rows = columns(df, text, lang).toDF("text", "lang").where("text is not null and lang is not null").mapInArrow(count, "lang string, gram long, n long")
    total = written(rows.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = total.withColumn("place", place).where(F.col("place") <= size)
    best = best.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "gram"))), lambda x: x["gram"]).alias("grams"))
    return {r["lang"]: r["grams"] for r in best.collect()}


def identify(text, profiles: dict[str, list[int]], size: int = PROFILE):
    """A struct column (lang, score, distance) for a text column.

    A document's ``size`` most frequent n-grams are held against each profile: an n-gram costs the difference of its two
    places, or ``size`` if the profile lacks it. The least sum wins, ties to the first language by name; the score is
    the winner's share of exp(-distance / SOFT), with distances as parts of the largest possible; the distance is the
    winner's. ``und`` with score 0 and distance 1 for null texts and texts without letters, and where nothing was learned."""
    names = sorted(profiles)
    keys = np.unique(np.array([g for k in names for g in profiles[k]], np.int64)) if names else np.empty(0, np.int64)
    ranks = np.full((len(names), len(keys) + 1), -1, np.int64)
    for i, k in enumerate(names):
        ranks[i, np.searchsorted(keys, profiles[k])] = np.arange(len(profiles[k]))

    @F.pandas_udf("lang string, score double, distance double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        langs, scores, distances = [], [], []
        for t in texts:
            c = letter_codes(t) if t else np.zeros(1, np.int64)
            if not names or not c.any():
                langs.append(UNKNOWN), scores.append(0.0), distances.append(1.0)
                continue
            g = ranked(*counted(grams(c)), size)
            at = np.searchsorted(keys, g)
            at[(at == len(keys)) | (keys[np.minimum(at, len(keys) - 1)] != g)] = len(keys)
            r = ranks[:, at]
            d = np.where(r < 0, size, np.abs(r - np.arange(len(g)))).sum(1) / (size * len(g))
            i = int(np.argmin(d))
            langs.append(names[i])
            scores.append(float(1 / np.exp((d[i] - d) / SOFT).sum()))
            distances.append(float(d[i]))
        return pd.DataFrame({"lang": langs, "score": scores, "distance": distances})

    # else Spark would run it once for a filter on it and once more for what passes
    return predict.asNondeterministic()(text)


def held_out(doc_id, folds: int, fold: int):
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; true for null ids, from which nothing is learned."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "utf-8")), F.lit(folds)) == fold, F.lit(True))


def language_id(df: DataFrame) -> DataFrame:
    """``df`` with lang_pred, score, distance and held_out: profiles learned from its text and lang outside the held-out fold.

    Every row is kept, with its other columns, but those with a new one's name; repeated rows are learned from and predicted
    each; rows with a null doc_id are held out. A null or empty text is ``und``; a table without any labelled row makes all ``und``, an
    empty one gives no rows. Very long texts count as a whole, in batches of their own."""
    small_batches(df.sparkSession)
    plain = columns(df, "doc_id", "text", "lang")
    profiles = learn_profiles(plain.where(~held_out(F.col("doc_id"), 3, 1)))
    new = {"lang_pred": F.col("__p.lang"), "score": F.col("__p.score"), "distance": F.col("__p.distance"), "held_out": F.col("__h")}
    return beside(df, ["doc_id", "text"], lambda rows, doc_id, text: (rows.withColumns({"__h": held_out(doc_id, 3, 1), "__p": identify(text, profiles)}), new))
