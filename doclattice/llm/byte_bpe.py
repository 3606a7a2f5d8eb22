"""Byte-level BPE by a global shuffle of distinct words, and decoding by the token-byte table."""

from __future__ import annotations

import base64
import re
import uuid
from collections import defaultdict
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclattice.llm.shared import ARROW_BYTES, arrow_rows, columns, small_batches, table_path, written
from doclattice.llm.word_tokens import latin

#: Characters of text in one block of documents.
BLOCK_CHARS = 32_000_000
#: Distinct words that a bucket is meant to have; its task holds them, some 20 MB.
BUCKET_WORDS = 100_000
#: Smallest hashes by which distinct words are estimated, to some 3 %.
LEAST_HASHES = 1024
#: Tasks that put blocks together; with more blocks, a task has several, one after another.
MOST_TASKS = 50_000
SPACE = "\\u0009-\\u000d\\u0020\\u0085\\u00a0"


@lru_cache(4)
def splitters(pattern: str):
    """Functions that list a text's matches of ``pattern``: for texts below U+0250 by explicit ranges in ``re``, and for all by
    ``regex``. White space is Unicode's, as in the library; Python's own also has 0x1C to 0x1F."""
    import regex

    letters, numbers = latin("L"), latin("N")
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACE}{letters}{numbers}]")
    plain = inside.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    rest = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    return re.compile("[\x00-ɏ]*").fullmatch, re.compile(plain).findall, regex.compile(rest).findall


def pre_tokens(text: str | None, pattern: str) -> list[str]:
    low, plain, full = splitters(pattern)
    text = text or ""
    return plain(text) if low(text) else full(text)


@lru_cache(2)
def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(w): int(i) for w, i in map(bytes.split, f)}


@lru_cache(2)
def word_encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})._core_bpe.encode_single_piece


@lru_cache(2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table as one buffer and the place of each id in it; as large as the vocabulary, whatever the input."""
    ranks = ranks_of(path)
    size = max(ranks.values()) + 1
    words = [b""] * size
    for w, i in ranks.items():
        words[i] = w
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """The bytes of ids: a gather from the token-byte table. An id without bytes is an error."""
    data, at = token_bytes(path)
    if len(ids) and int(ids.max()) >= len(at) - 1:
        raise ValueError(f"no such id: {int(ids.max())}")
    n = at[ids + 1] - at[ids]
    ends = np.cumsum(n)
    return data[np.repeat(at[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes() if len(ids) else b""


def packed(items: list[bytes]) -> bytes:
    """Byte strings in one: their number, lengths and bytes, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(items), *map(len, items)], "<u4").tobytes() + b"".join(items))


def unpacked(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    at = np.cumsum(np.append(4 + 4 * n, np.frombuffer(raw, "<u4", n, 4))).tolist()
    return [raw[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]


def planes(numbers: np.ndarray) -> bytes:
    """Numbers as 32-bit ones, byte after byte of all of them."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def frozen(ids: list, lists: list[np.ndarray], order: np.ndarray, codes: np.ndarray) -> bytes:
    """A block's documents: their number, lengths and ids, the places of the words by code, and the pre-tokens' codes; compressed."""
    head = np.array([len(ids), len(order), *map(len, lists)], "<u4").tobytes() + np.array([i is not None for i in ids], np.uint8).tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + planes(order) + planes(codes))


def thawed(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(ids, lengths, places of pre-tokens among the block's words) of a block's documents."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, words = np.frombuffer(raw, "<u4", 2).tolist()
    lens, known, ids = np.frombuffer(raw, "<u4", n, 8), np.frombuffer(raw, np.uint8, n, 8 + 4 * n), np.frombuffer(raw, "<i8", n, 8 + 5 * n)
    at = 8 + 13 * n
    order, codes = (np.ascontiguousarray(np.frombuffer(raw, np.uint8, z - a, a).reshape(4, -1).T).view("<u4").ravel() for a, z in ((at, at + 4 * words), (at + 4 * words, len(raw))))
    return [int(i) if k else None for i, k in zip(ids, known, strict=True)], lens, order[codes] if words else codes


def blocks(batches, pattern: str, block_chars: int):
    """Blocks of whole documents: (number, ids of documents, code lists, distinct words in order of first use). A word's code is its
    place among the block's distinct words, and the code lists are the block's pre-tokens with their positions."""
    number = 0
    vocab: defaultdict[str, int] = defaultdict(count().__next__)
    ids, lists, chars = [], [], 0
    for b in batches:
        for i, t, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words = pre_tokens(t, pattern)
            ids.append(i)
            lists.append(np.fromiter(map(vocab.__getitem__, words), np.uint32, len(words)))
            chars += len(t or "")
            if chars >= block_chars:
                yield (part << 32) + number, ids, lists, list(vocab)
                number += 1
                vocab = defaultdict(count().__next__)
                ids, lists, chars = [], [], 0
    if ids:
        yield (part << 32) + number, ids, lists, list(vocab)


def distinct_words(block_words: DataFrame) -> int:
    """About how many distinct words all blocks have, from the ``LEAST_HASHES`` smallest hashes of all (each block gives its own smallest). It
    decides the number of buckets, not what they hold."""
    smallest = block_words.select(F.explode("least").alias("h")).distinct().orderBy("h").limit(LEAST_HASHES).agg(F.count("*").alias("n"), F.max("h").alias("h")).first()
    return smallest["n"] if smallest["n"] < LEAST_HASHES else int((LEAST_HASHES - 1) * 2.0**64 / (smallest["h"] + 2**63 + 1))


def encode_documents(docs: DataFrame, ranks: str, pattern: str, bucket_words: int = BUCKET_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, ids, decoded) for each row of ``docs``: ids as little-endian unsigned 32-bit integers, and the bytes of their decoding.

    1. Texts are exploded into pre-tokens with positions, once, in blocks of documents of ``block_chars``. A block gives one row with
       its distinct words in the order of their hashes. The positions are lists of codes (frequent words have small ones), which
       stay in a file of the task in the shared folder, under its attempt's own name; the table of rows only names committed files.
    2. The words go to buckets, ranges of hashes: as many that each has about ``bucket_words`` distinct words, so their number grows with the
       vocabulary, and a task holds one bucket's words. A bucket encodes each distinct word once, by the merge ranks. A word
       that is everywhere adds one entry for each block.
    3. The ids go back to their blocks, where the positions are read and each document's ids are put together in order.
    4. Decoding joins the ids with the token-byte table, of the vocabulary's size, which every worker holds.

    Shuffled are the distinct words of blocks and their ids, neither texts nor positions. A task holds a block: ``block_chars`` of
    text, or one text that is longer, and its words. A null text is like an empty one: no ids. Every row is returned, repeated and null
    doc_ids too; an empty table gives no rows. Further columns are not read.
    """
    spark = small_batches(docs.sparkSession)
    folder = table_path(spark, "positions")
    rows = columns(docs, "doc_id", "text").withColumn("part", F.spark_partition_id())
    ddl = "block long, words binary, least array<long>, file string, at long, size long"

    def hashes(raw: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))

    def exploded(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        name, out, at = f"part-{uuid.uuid4().hex}", None, 0
        for block, ids, lists, words in blocks(batches, pattern, block_chars):
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/{name}")
            raw, codes = [w.encode("utf-8", "surrogatepass") for w in words], np.concatenate(lists)
            del words
            h = hashes(raw)
            by_hash = np.argsort(h, kind="stable")
            place = np.empty(len(raw), np.uint32)
            place[by_hash] = np.arange(len(raw), dtype=np.uint32)
            by_use = np.argsort(-np.bincount(codes, minlength=len(raw)), kind="stable")
            code = np.empty(len(raw), np.uint32)
            code[by_use] = np.arange(len(raw), dtype=np.uint32)
            blob = frozen(ids, lists, place[by_use], code[codes])
            out.write(blob)
            least = (np.unique(h)[:LEAST_HASHES] ^ np.uint64(1 << 63)).view(np.int64)
            yield from arrow_rows(ddl, [[block], [packed([raw[i] for i in by_hash.tolist()])], [least], [name], [at], [len(blob)]])
            at += len(blob)
        if out is not None:
            out.close()

    block_words = written(rows.mapInArrow(exploded, ddl), "block-words")
    buckets = -(-distinct_words(block_words) // bucket_words) or 1
    limits = np.array([2**64 * k // buckets for k in range(1, buckets)], np.uint64)
    dealt = "block long, bucket int, payload binary, file string, at long, size long"

    def dealt_words(batches):
        for b in batches:
            for block, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = unpacked(blob)
                at = [0, *np.searchsorted(hashes(raw), limits, "left").tolist(), len(raw)]
                for k, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    if x < y:
                        yield from arrow_rows("block long, bucket int, words binary", [[block], [k], [packed(raw[x:y])]])

    def encoded(batches):
        encode = word_encoder(ranks, pattern)
        known: dict[bytes, bytes] = {}
        now = None
        for b in batches:
            for block, bucket, blob in zip(*(b.column(c).to_pylist() for c in ("block", "bucket", "words")), strict=True):
                if bucket != now:
                    known, now = {}, bucket
                words = unpacked(blob)
                for w in words:
                    if w not in known:
                        known[w] = np.array(encode(w), "<u4").tobytes()
                yield from arrow_rows(dealt, [[block], [bucket], [packed([known[w] for w in words])], [None], [None], [None]])

    sent = block_words.select("block", "words").mapInArrow(dealt_words, "block long, bucket int, words binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    heads = block_words.select("block", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("payload"), "file", "at", "size")

    def whole(rows: list[dict]):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        with store.open_input_file(f"{base}/{rows[0]['file']}") as f:
            f.seek(rows[0]["at"])
            ids, lens, places = thawed(f.read(rows[0]["size"]))
        words = [w for r in rows[1:] for w in unpacked(r["payload"])]
        sizes = np.fromiter(map(len, words), np.int64, len(words)) // 4
        starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(words), "<u4")
        got, held, at = [], 0, 0
        for i, n in zip(ids, lens.tolist(), strict=True):
            c = places[at : at + n]
            at += n
            m = sizes[c]
            ends = np.cumsum(m)
            doc = flat[np.repeat(starts[c] - (ends - m), m) + np.arange(ends[-1])] if n else flat[:0]
            got.append((i, doc.tobytes(), decode_ids(doc, ranks)))
            held += len(got[-1][1]) + len(got[-1][2])
            if held > ARROW_BYTES:
                yield from arrow_rows("doc_id long, ids binary, decoded binary", list(zip(*got, strict=True)))
                got, held = [], 0
        if got:
            yield from arrow_rows("doc_id long, ids binary, decoded binary", list(zip(*got, strict=True)))

    def assembled(batches):
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and held[0]["block"] != r["block"]:
                    yield from whole(held)
                    held = []
                held.append(r)
        if held:
            yield from whole(held)

    tasks = min(max(block_words.count(), 1), MOST_TASKS)
    both = sent.mapInArrow(encoded, dealt).unionByName(heads)
    return both.repartition(tasks, "block").sortWithinPartitions("block", "bucket").mapInArrow(assembled, "doc_id long, ids binary, decoded binary")


def decode_documents(rows: DataFrame, ranks: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded): bytes of ids that are given as little-endian unsigned 32-bit integers; null ids give null. The token-byte table is
    held by every worker, and a batch of rows is looked up there at once."""

    @F.pandas_udf("binary")
    def decode(column: pd.Series) -> pd.Series:
        given = column.dropna()
        data = decode_ids(np.frombuffer(b"".join(given), "<u4"), ranks)
        _, at = token_bytes(ranks)
        sizes = [int((at[x + 1] - at[x]).sum()) for x in (np.frombuffer(v, "<u4").astype(np.int64) for v in given)]
        ends = np.cumsum([0, *sizes])
        return pd.Series([data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], given.index, object).reindex(column.index).replace({np.nan: None})

    return rows.select(key, decode(ids).alias("decoded"))


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoded documents."""
    return encoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
