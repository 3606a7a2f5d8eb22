"""Document quality by regularised quadratic discriminant analysis of document statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.llm.language import held_out
from doclattice.llm.shared import arrow_rows, columns, written

NOISE = np.zeros(256, bool)
NOISE[list(b"#$%&*+=<>@^~\\{}[]_")] = True
WIDTH = 17


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of a whole text, all near 0 to 10; those of the empty text for a null one."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n, size = len(words) or 1, len(raw) or 1
    lower, upper = count[97:123].sum(), count[65:91].sum()
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, len(words))
    most = np.bincount(w).max() if len(w) else 0
    again = int((w[1:] == w[:-1]).sum())
    triples = (w[:-2] * 1_000_003 + w[1:-1]) * 1_000_003 + w[2:]
    triples.sort()
    repeated = int((triples[1:] == triples[:-1]).sum())
    lines = Counter(x for x in raw.split(b"\n") if x.strip())
    n_lines = sum(lines.values()) or 1
    caps = sum(map(bytes.isupper, words))
    root = np.sqrt
    return np.array([
        np.log1p(len(words)), np.log1p(len(raw)) - np.log1p(len(words)), root(upper / (lower + upper or 1)), root(count[33] / n), root(count[124] / n), root(count[NOISE].sum() / n),
        len(ids) / n, root(again / n), root(count[48:58].sum() / size), root(count[46] / n), root(count[44] / n), root(n_lines / n), root(1 - len(lines) / n_lines), root(most / n), root(repeated / n), root(caps / n), root(count[128:].sum() / size),
    ])


def statistics_of(text):
    """The statistics of a text column, as an array column."""

    @F.pandas_udf("array<double>")
    def each(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return each(text)


@dataclass
class Discriminant:
    """Two Gaussians: for each class the log prior, the mean and the inverse of its covariance's Cholesky factor."""

    prior: np.ndarray
    mean: np.ndarray
    inverse: np.ndarray
    logdet: np.ndarray
    temper: float

    @classmethod
    def of_moments(cls, n: np.ndarray, s: np.ndarray, ss: np.ndarray, shrink: float, ridge: float, temper: float) -> Discriminant:
        """Class covariances are moved by ``shrink`` to the pooled one and by ``ridge`` to a multiple of the identity."""
        d = s.shape[1]
        m = np.maximum(n, 1)[:, None]
        mean = s / m
        cov = ss / m[:, :, None] - mean[:, :, None] * mean[:, None, :]
        pooled = (cov * n[:, None, None]).sum(0) / max(n.sum(), 1)
        cov = (1 - shrink) * cov + shrink * pooled
        cov = (1 - ridge) * cov + ridge * np.eye(d) * (np.trace(cov, axis1=1, axis2=2)[:, None, None] / d + 1e-9)
        factor = np.linalg.cholesky(cov)
        inverse = np.stack([np.linalg.solve(f, np.eye(d)) for f in factor])
        return cls(np.log((n + 1) / (n.sum() + 2)), mean, inverse, 2 * np.log(np.diagonal(factor, axis1=1, axis2=2)).sum(1), temper)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The tempered probability of class 1."""
        z = np.einsum("kij,nkj->nki", self.inverse, x[:, None, :] - self.mean[None])
        dens = self.prior - 0.5 * (self.logdet + (z * z).sum(2))
        return 1 / (1 + np.exp(np.clip((dens[:, 0] - dens[:, 1]) / self.temper, -500, 500)))


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, sums and sums of products of the statistics of each class, over all rows (label 0 or 1, f). Each task sums its
    own rows; the sums are added by Spark, so that the driver gets 2 x (1 + d + d^2) numbers whatever the rows."""

    def sums(batches):
        acc = np.zeros((2, 1 + WIDTH + WIDTH * WIDTH))
        for b in batches:
            if b.num_rows:
                y, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                for k in (0, 1):
                    g = x[y == k]
                    acc[k] += np.concatenate([[len(g)], g.sum(0), (g.T @ g).ravel()])
        k, i = np.indices(acc.shape)
        yield from arrow_rows("label int, at int, v double", [k.ravel().astype(np.int32), i.ravel().astype(np.int32), acc.ravel()])

    out = np.zeros((2, 1 + WIDTH + WIDTH * WIDTH))
    for r in rows.select("label", "f").mapInArrow(sums, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect():
        out[r["label"], r["at"]] = r["v"]
    return out[:, 0], out[:, 1 : 1 + WIDTH], out[:, 1 + WIDTH :].reshape(2, WIDTH, WIDTH)


def quality_scores(docs: DataFrame, labels: DataFrame, shrink: float = 0.1, ridge: float = 0.01, temper: float = 4.0, cut: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The texts are read once: their statistics are written as a table, from which the classes' moments (over all labelled
    rows outside the held-out fold, no sample) and then all scores come. A null or empty text has the statistics of
    an empty one. Labels that are null or other than 0 and 1 are left out; several labels of a document all count; labels of
    null or unknown doc_ids none. Rows that repeat a doc_id are scored each, and each counts with the id's labels.
    ``temper`` divides the log odds: statistics of one text depend on one another beyond what two Gaussians can say, so that the odds
    of many of them are far too sure. It doesn't change the order of scores, but makes 0.7 a cut among them. Further columns are not read.
    Without labels of both classes all scores are the share of class 1 (0.5 without labels).
    """
    stats = written(columns(docs, "doc_id", "text").select("doc_id", statistics_of("text").alias("f")), "statistics")
    marks = columns(labels, "doc_id", "quality").where("quality in (0, 1)").where(~held_out(F.col("doc_id"), 4, 2)).select("doc_id", F.col("quality").cast("int").alias("label"))
    n, s, ss = moments(marks.join(stats, "doc_id"))
    model = Discriminant.of_moments(n, s, ss, shrink, ridge, temper) if n.min() > 0 else None
    flat = float((n[1] + 1) / (n.sum() + 2))

    @F.pandas_udf("double")
    def score(f: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.full(len(f), flat))
        return pd.Series(model.scores(np.stack(f.to_list())) if len(f) else np.empty(0))

    out = stats.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), score("f").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= cut).cast("int"))
