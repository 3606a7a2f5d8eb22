"""What op9's automata find of credentials whose key words are hidden, and what they add wrongly, among all documents of a folder."""

import os
import random

import pytest
from pyspark.sql import functions as F

from doclattice.llm.credentials import find_secrets

FOLDER = "/root/testdata/sf0.01"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Formats of planted credentials: parts of a length from an alphabet.
FORMATS = {
    "mixed": ((40, DIGITS + LOWER + UPPER),),
    "upper hex": ((40, DIGITS + "ABCDEF"),),
    "parts": ((3, LOWER), (1, "_"), (8, DIGITS), (1, "-"), (16, UPPER + DIGITS)),
}


def planted(rows: list[tuple[int, str]], seed: int = 9) -> tuple[list[tuple[int, str]], dict[int, tuple[str, str]]]:
    """The rows with a credential in every fifth one, at a space: after its key word in half of them, without one in the others; those of
    the others."""
    r = random.Random(seed)
    out, bare = [], {}
    for i, text in rows:
        if text and i % 5 == 0:
            kind = r.choice(sorted(FORMATS))
            value = "".join(r.choice(chars) for n, chars in FORMATS[kind] for _ in range(n))
            named = r.random() < 0.5
            at = text.find(" ", r.randrange(len(text)))
            at = at if at >= 0 else len(text)
            text = f"{text[:at]} {'api_key = ' if named else ''}{value}{text[at:] if at < len(text) else ' '}"
            if not named:
                bare[i] = (kind, value)
        out.append((i, text))
    return out, bare


def measured(spark, folder: str) -> tuple[dict[str, list[int]], int]:
    """For each format, how many bare credentials were found of how many; and the format spans that are none of them."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    texts, bare = planted(rows)
    got = find_secrets(spark.createDataFrame(texts, "doc_id long, text string").repartition(8)).where(F.col("n_format") > 0).select("doc_id", "text", "spans").collect()
    counts, added = {k: [0, 0] for k in FORMATS}, 0
    for kind, _ in bare.values():
        counts[kind][1] += 1
    for r in got:
        for name, start, end in (s.split(":") for s in r.spans.split(",")):
            if name == "format":
                kind, value = bare.get(r.doc_id, (None, None))
                if r.text[int(start) : int(end)] == value:
                    counts[kind][0] += 1
                else:
                    added += 1
    return counts, added


def test_hidden_credentials(spark):
    """Measured at sf0.01: all of the formats of one alphabet, 26 of 37 of the one of several parts, which some 37 labelled examples teach
    less well (at sf0.1: 344 of 348); nothing added wrongly."""
    if not os.path.exists(FOLDER):
        pytest.skip("no test data")
    counts, added = measured(spark, FOLDER)
    assert counts["mixed"][0] == counts["mixed"][1] > 20 and counts["upper hex"][0] == counts["upper hex"][1] > 20, counts
    assert counts["parts"][0] >= 0.5 * counts["parts"][1] > 10, counts
    assert added == 0
