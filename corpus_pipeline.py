"""A corpus pipeline of five operators: language, boilerplate lines, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor kept; all but the last return the columns of
``documents`` (further ones, and ones that only differ in case, are left out). ``run`` writes each stage's rows as a table in the
shared folder and reads them again for the next. Empty tables give empty ones in every stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.llm.credentials import find_secrets
from doclattice.llm.language import UNKNOWN, language_id
from doclattice.llm.line_frequency import drop_frequent_lines
from doclattice.llm.minhash_dups import minhash_near_dups
from doclattice.llm.packing import pack_documents
from doclattice.llm.queries import documents, tokenizer
from doclattice.llm.shared import columns, delete_path, scratch, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_text(docs: DataFrame, text) -> DataFrame:
    """The columns of documents with another text and its length."""
    return docs.withColumn("__t", text).select("doc_id", F.col("__t").alias("text"), "lang", "source", F.length("__t").cast("long").alias("n_chars"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, max_distance: float = 0.7) -> DataFrame:
    """Documents stay whose n-grams lie within ``max_distance`` of the predicted language's profile, as a part of the largest
    possible out-of-place distance; the others are in no learned language and go, as do texts without letters, empty ones
    and null ones. A null lang becomes the predicted one. Rows count on their own: repeated ones are judged alike, a null
    doc_id or source changes nothing. Equal distances to two languages don't matter to what stays."""
    found = language_id(columns(docs, *COLUMNS)).where((F.col("lang_pred") != UNKNOWN) & (F.col("distance") <= max_distance))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that more than a tenth of their source's documents hold go. Documents of nothing but such lines keep their text:
    they may be copies of one document, of which the next stage keeps one. Every row stays: null and empty texts as they
    are, rows with a null source as those of one source, repeated rows each; a line exactly at the ratio stays."""
    found = drop_frequent_lines(columns(docs, *COLUMNS))
    return with_text(found, F.when(F.col("n_dropped") < F.col("n_lines"), F.col("kept_text")).otherwise(F.col("text")))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least id; all documents without words stay, as do
    rows with a null doc_id. Rows that repeat a doc_id stay or go together: they stay if one of their texts is its
    group's first. A null lang, source or n_chars changes nothing."""
    docs = columns(docs, *COLUMNS)
    gone = minhash_near_dups(docs).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept").select("doc_id")
    # rows without an id have nothing to meet; a hash of their own deals them to all tasks
    key = [F.coalesce("doc_id", F.xxhash64("text", "source", "lang")).alias("__key"), F.col("doc_id").isNotNull().alias("__known")]
    gone = written(gone, "dropped").select(F.col("doc_id").alias("__key"), F.lit(True).alias("__known"))
    return docs.select("*", *key).join(gone, ["__key", "__known"], "left_anti").select(*COLUMNS)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by [SECRET]; every row stays, null and empty texts as they are, repeated rows each."""
    return with_text(find_secrets(columns(docs, *COLUMNS)), F.col("redacted"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of 2048 ids. Every row is packed, repeated ones and null doc_ids too;
    a null text is one piece of the end id alone."""
    return pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [("language", language_stage), ("lines", line_stage), ("near_dups", near_dup_stage), ("secrets", secret_stage), ("packing", packing_stage)]

#: The stages by MinHash, automata and tokens can't be said in SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way is deleted when its own table is whole, and that when the next one's is."""
    docs, last = documents(spark, sf_dir), None
    for name, stage in STAGES:
        with scratch(spark) as paths:
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
            now = paths.pop()
        if last:
            delete_path(spark, last)
        last = now
    return docs
