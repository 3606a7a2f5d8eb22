"""The operators' queries over the tables of a folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doclattice.llm.shared import spread_small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; with the session's setting ``doclattice.spread`` = true, which is the caller's choice for small tables of few files,
    dealt to all cores."""
    docs = table(spark, sf_dir, "documents")
    return spread_small(docs) if spreads(spark) else docs


def spreads(spark: SparkSession) -> bool:
    return spark.conf.get("doclattice.spread", "false") == "true"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_vector_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclattice.llm.vector_dups import vector_near_dups

    return vector_near_dups(table(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclattice.llm.token_scan import token_counts

    return token_counts(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op3_minhash_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclattice.llm.minhash_dups import minhash_near_dups

    return minhash_near_dups(documents(spark, sf_dir))


def op4_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclattice.llm.quality import quality_scores

    return quality_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclattice.llm.language import language_id

    return language_id(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


def op6_frequent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclattice.llm.line_frequency import drop_frequent_lines

    kept = drop_frequent_lines(documents(spark, sf_dir))
    return kept.select("doc_id", "source", "n_lines", "n_dropped", F.md5(F.encode("kept_text", "utf-8")).alias("kept_md5"))


def op7_grouped_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclattice.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


def op8_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclattice.llm.multi_index import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_secret_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclattice.llm.credentials import find_secrets

    found = find_secrets(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.encode("base", "utf-8"), 256).alias("base_sha256"), "spans", "n_format")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from doclattice.llm.byte_bpe import digests, encode_documents

    return digests(encode_documents(documents(spark, sf_dir), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op11_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclattice.llm.word_runs import repeated_tail, run_digests

    return run_digests(documents(spark, sf_dir), repeated_tail)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclattice.llm.vector_codes import code_digests

    return code_digests(table(spark, sf_dir, "embeddings"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from doclattice.llm.token_files import token_files

    return token_files(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_vector_near_dups, op2_token_counts, op3_minhash_near_dups, op4_quality_discriminant, op5_language_profiles, op6_frequent_lines, op7_grouped_packing, op8_multi_index_search, op9_secret_formats, op10_byte_bpe, op11_word_runs, op12_vector_codes, op13_token_files)
}

#: White space that the operator trims from lines, as DuckDB's chr() calls.
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES: dict[str, str] = {
    "op1_vector_near_dups": """
        WITH RECURSIVE usable AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
                AND len([x FOR x IN embedding IF x <> 0]) > 0),
        links AS (
            SELECT a.vec_id AS one, b.vec_id AS two FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
        reach AS (
            SELECT vec_id, vec_id AS root FROM embeddings
            UNION SELECT l.two, r.root FROM reach r JOIN links l ON l.one = r.vec_id),
        counts AS (SELECT one, count(*) AS n FROM links GROUP BY one)
        SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
        FROM embeddings e LEFT JOIN counts c ON c.one = e.vec_id JOIN (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id) m ON m.vec_id = e.vec_id""",
    "op3_minhash_near_dups": r"""
        WITH RECURSIVE texts AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        words AS (SELECT doc_id, len(w) AS total, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM texts WHERE len(w) >= 5),
        runs AS (
            SELECT doc_id, i, total, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS shingle
            FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        shingles AS (
            SELECT DISTINCT doc_id, shingle FROM runs WHERE i <= total - 4
            UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM texts WHERE len(w) BETWEEN 1 AND 4),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        shared AS (
            SELECT a.doc_id AS one, b.doc_id AS two, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        links AS (
            SELECT one, two FROM shared s JOIN sizes a ON a.doc_id = s.one JOIN sizes b ON b.doc_id = s.two WHERE 100 * s.n >= 75 * (a.n + b.n - s.n)),
        reach AS (
            SELECT doc_id, doc_id AS root FROM documents
            UNION SELECT l.two, r.root FROM reach r JOIN links l ON l.one = r.doc_id)
        SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
        FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) m ON m.doc_id = d.doc_id""",
    "op6_frequent_lines": f"""
        WITH lines AS (
            SELECT doc_id, source, i, raw[i] AS line, trim(raw[i], {_SPACES}) AS trimmed
            FROM (SELECT doc_id, source, string_split(text, chr(10)) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
        counts AS (SELECT source, trimmed, count(DISTINCT doc_id) AS n FROM lines WHERE trimmed <> '' GROUP BY source, trimmed),
        pages AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
        frequent AS (SELECT source, trimmed FROM counts JOIN pages USING (source) WHERE n / total > 0.1 AND n > 1),
        flagged AS (SELECT l.*, f.source IS NOT NULL AS dropped FROM lines l LEFT JOIN frequent f ON l.source = f.source AND l.trimmed = f.trimmed)
        SELECT doc_id, source, CAST(count(*) FILTER (WHERE trimmed <> '') AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
            md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_md5
        FROM flagged GROUP BY doc_id, source""",
}

#: Assignments of parts to the entries of a codebook, and the codebook that follows from them, for op12's SQL.
_NEAR = """near_{i} AS (
            SELECT no, p, arg_min(e, d * 64 + e) AS e, min(d) AS d FROM (
                SELECT o.no, o.p, b.e, list_sum(list_transform(list_zip(o.q, b.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts o JOIN books_{i} b ON b.p = o.p) GROUP BY no, p)"""
_MOVED = """sums_{i} AS (
            SELECT o.p, n.e, j, CAST(floor(sum(o.q[j]) / count(*)) AS BIGINT) AS x FROM near_{i} n JOIN parts o ON o.no = n.no AND o.p = n.p, unnest(range(1, len(o.q) + 1)) AS u(j) GROUP BY o.p, n.e, j),
        books_{k} AS (
            SELECT b.p, b.e, coalesce(m.q, b.q) AS q FROM books_{i} b LEFT JOIN (SELECT p, e, list(x ORDER BY j) AS q FROM sums_{i} GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)"""
_ROUNDS = ",\n        ".join([_NEAR.format(i=0), _MOVED.format(i=0, k=1), _NEAR.format(i=1), _MOVED.format(i=1, k=2), _NEAR.format(i=2)])

ORACLES["op12_vector_codes"] = f"""
        WITH usable AS (
            SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q, row_number() OVER (ORDER BY vec_id, embedding) AS no FROM embeddings
            WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        parts AS MATERIALIZED (SELECT no, p, q[p * (len(q) // 16) + 1 : (p + 1) * (len(q) // 16)] AS q FROM usable, unnest(range(0, 16)) AS u(p)),
        books_0 AS (SELECT p, no - 1 AS e, q FROM parts WHERE no <= 64),
        {_ROUNDS},
        coded AS (SELECT no, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near_2 GROUP BY no),
        digest AS (SELECT sha256(string_agg(array_to_string(q, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM books_2)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM usable JOIN coded USING (no), digest"""
