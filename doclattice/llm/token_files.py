"""Token ids as files of documents that are compressed one by one with a shared dictionary.

A file holds a document's ids as a zstandard frame, so a short document can be read alone, and still compresses well, since the frames share
a dictionary that was trained on serialised ids. Its name stands in the file as a hash; behind the frames lies an index of
fixed width: doc_ids in ascending order, places of frames, numbers of ids before each document.

    frames | doc_ids (n x i8) | places (n + 1 x u8) | firsts (n + 1 x u8) | foot

The foot has the numbers of documents and of null doc_ids (which come first), the index's place, the width of an id in bytes, the
hash of the dictionary, and MAGIC."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclattice.llm.byte_bpe import splitters
from doclattice.llm.shared import arrow_rows, columns, small_batches, table_path, written

MAGIC = b"TOKFILE1"
FOOT = "<QQQQ32s8s"
LEVEL = 3
#: The dictionary's bytes; it is trained on about so many documents, drawn from all, of at most so many characters: it serves short ones.
DICTIONARY_BYTES, SAMPLE_DOCUMENTS, SAMPLE_CHARS = 1 << 16, 2000, 8192
#: Bytes of frames that one task reads.
READ_BYTES = 16 << 20
MANIFEST = "file string, documents long, ids long, bytes long, null_id boolean, least long, tokens long, crc long, salt long"


class ByteWords(dict):
    """Ids of a file of the ``tokenizers`` library with byte-level BPE, as bytes of 2 or 4 each: a text's pre-tokens are encoded once each by
    the file's own ranks in ``tiktoken``'s merge loop. Texts with the literal of a special token go to the library as a whole. A worker
    holds the ids of at most ``LIMIT`` words of at most ``LONGEST`` characters, about 40 MB."""

    LIMIT, LONGEST = 200_000, 40
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))
        step = model["pre_tokenizer"]
        if model["normalizer"] or (step["type"], step["add_prefix_space"], step["use_regex"]) != ("ByteLevel", False, True):
            raise ValueError(f"not a plain byte-level file: {path}")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        added = {t.content for t in self.library.get_added_tokens_decoder().values()}
        vocab = {w: i for w, i in model["model"]["vocab"].items() if w not in added}
        self.literals = tuple(sorted(added))
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        ranks = {bytes(byte[c] for c in w): i for w, i in vocab.items()}
        self.merge = tiktoken.Encoding("bytes", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.low, self.plain, self.full = splitters(self.PATTERN)

    def __missing__(self, word: str) -> bytes:
        got = array(self.kind, self.merge(word.encode())).tobytes()
        if len(word) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = got
        return got

    def ids(self, text: str | None) -> bytes:
        text = text or ""
        if any(x in text for x in self.literals):
            return array(self.kind, self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, self.plain(text) if self.low(text) else self.full(text)))


@lru_cache(2)
def byte_words(path: str) -> ByteWords:
    return ByteWords(path)


def trained(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary of ``samples``; where they are too few or too small to train one, their last bytes serve as it; without any, none."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@lru_cache(4)
def shared_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def compressor(raw: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=shared_dictionary(raw), write_dict_id=False)


def train_dictionary(docs: DataFrame, tokenizer: str, end: int, documents: int = SAMPLE_DOCUMENTS, size: int = DICTIONARY_BYTES) -> bytes:
    """Trains on the serialised ids of a bounded sample of rows. It decides how small the files are, not what they hold."""
    rows = columns(docs, "doc_id", "text").select("text").where(F.length("text").between(1, SAMPLE_CHARS))
    total = rows.count()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = byte_words(tokenizer)
        for b in batches:
            yield from arrow_rows("ids binary", [[words.ids(t) + array(words.kind, [end]).tobytes() for t in b.column(0).to_pylist()]])

    sample = rows.sample(min(1.0, documents / total), seed=13) if total > documents else rows
    return trained([bytes(r["ids"]) for r in sample.mapInArrow(encode, "ids binary").collect()], size)


def write_files(docs: DataFrame, folder: str, tokenizer: str, end: int = 0) -> DataFrame:
    """Writes all rows of (doc_id, text) as files of ``folder`` in ascending doc_id order, each document's ids closed by ``end``; returns a
    written table of the files: what they hold, and the least of their sort keys, by which files follow each other.

    1. The dictionary is trained on a sample and written beside the files under its hash.
    2. Each text is encoded and compressed where it is read; the frames are written as a table.
    3. Frames are sorted by range of doc_id; rows with the same one by their ids, and a row number, so that a doc_id of any number of rows
       is spread over files. Each task streams its range into a file of its attempt's own name; the table
       of files only names those of committed attempts."""
    spark = small_batches(docs.sparkSession)
    raw = train_dictionary(docs, tokenizer, end)
    digest = hashlib.sha256(raw).digest()
    put(f"{folder}/{digest.hex()}.dictionary", raw)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pack = byte_words(tokenizer), compressor(raw)
        last = array(words.kind, [end]).tobytes()
        for b in batches:
            ids = [words.ids(t) + last for t in b.column(1).to_pylist()]
            sizes = [len(x) // words.width for x in ids]
            yield from arrow_rows("doc_id long, tokens long, crc long, frame binary", [b.column(0), sizes, [zlib.crc32(x) for x in ids], [pack.compress(x) for x in ids]])

    frames = written(columns(docs, "doc_id", "text").mapInArrow(encode, "doc_id long, tokens long, crc long, frame binary"), "frames")
    order = ["doc_id", "tokens", "crc", "salt"]
    dealt = frames.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tok"
        out, first, ids, sizes, tokens = None, None, [], [], []
        for b in batches:
            if not b.num_rows:
                continue
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            if out is None:
                store.create_dir(at, recursive=True)
                out = store.open_output_stream(f"{at}/_{name}.tmp")
                first = [cols[k][0].as_py() for k in order]
            blobs = cols["frame"].to_pylist()
            for x in blobs:
                out.write(x)
            ids.append(cols["doc_id"])
            sizes.append(np.fromiter(map(len, blobs), np.uint64, len(blobs)))
            tokens.append(cols["tokens"].to_numpy())
        if out is None:
            return
        ids = pa.chunked_array(ids)
        places = np.append(0, np.cumsum(np.concatenate(sizes))).astype("<u8")
        firsts = np.append(0, np.cumsum(np.concatenate(tokens))).astype("<u8")
        out.write(ids.fill_null(0).to_numpy().astype("<i8").tobytes() + places.tobytes() + firsts.tobytes())
        out.write(struct.pack(FOOT, len(ids), ids.null_count, int(places[-1]), byte_words(tokenizer).width, digest, MAGIC))
        out.close()
        store.move(f"{at}/_{name}.tmp", f"{at}/{name}")
        kinds = ("string", "long", "long", "long", "boolean", "long", "long", "long", "long")
        yield from arrow_rows(", ".join(f"c{i} {k}" for i, k in enumerate(kinds)), [[x] for x in (name, len(ids), int(firsts[-1]), int(places[-1]), first[0] is None, *first)])

    named = "c0 string, c1 long, c2 long, c3 long, c4 boolean, c5 long, c6 long, c7 long, c8 long"
    return written(dealt.mapInArrow(write, named).toDF(*(x.split()[0] for x in MANIFEST.split(", "))), "files")


def put(path: str, data: bytes) -> None:
    from pyarrow import fs

    folder, _, name = path.rpartition("/")
    store, at = fs.FileSystem.from_uri(folder)
    store.create_dir(at, recursive=True)
    with store.open_output_stream(f"{at}/{name}") as f:
        f.write(data)


class TokenFile:
    """A file opened for reading some documents. The dictionary is looked for by its hash beside the file, and checked."""

    def __init__(self, folder: str, name: str):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        self.file = store.open_input_file(f"{at}/{name}")
        size = self.file.size()
        self.n, self.nulls, self.index, self.width, digest, magic = struct.unpack(FOOT, self.part(size - struct.calcsize(FOOT), struct.calcsize(FOOT))) if size >= struct.calcsize(FOOT) else (0,) * 5 + (b"",)
        if magic != MAGIC:
            raise ValueError(f"not a file of tokens: {name}")
        raw = read_dictionary(folder, digest.hex())
        self.unpack = zstandard.ZstdDecompressor(dict_data=shared_dictionary(raw))

    def part(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def numbers(self, table: int, first: int, count: int) -> np.ndarray:
        """Entries of the index: 0 doc_ids, 1 places of frames, 2 numbers of ids before."""
        start = self.index + 8 * (0, self.n, 2 * self.n + 1)[table]
        return np.frombuffer(self.part(start + 8 * first, 8 * count), "<i8")

    def documents(self, first: int, count: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, number of ids before it in the file, ids) of ``count`` documents from the place ``first`` on."""
        ids, places, before = self.numbers(0, first, count), self.numbers(1, first, count + 1), self.numbers(2, first, count + 1)
        kind = "<u2" if self.width == 2 else "<u4"
        self.file.seek(int(places[0]))
        for k in range(count):
            raw = self.unpack.decompress(self.file.read(int(places[k + 1] - places[k])))
            if len(raw) != self.width * int(before[k + 1] - before[k]):
                raise ValueError("a document's ids are not as many as the index says")
            yield None if first + k < self.nulls else int(ids[k]), int(before[k]), np.frombuffer(raw, kind)

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of the documents with this doc_id: a search in the index, then only their frames are read."""
        low, high = self.nulls, self.n
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.numbers(0, mid, 1)[0] < doc_id else (low, mid)
        end = low
        while end < self.n and self.numbers(0, end, 1)[0] == doc_id:
            end += 1
        return [ids for _, _, ids in self.documents(low, end - low)] if end > low else []


@lru_cache(4)
def read_dictionary(folder: str, digest: str) -> bytes:
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{at}/{digest}.dictionary") as f:
        raw = f.read()
    if hashlib.sha256(raw).hexdigest() != digest:
        raise ValueError(f"the dictionary {digest} was changed")
    return raw


def read_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of all documents of the files that ``files`` (as ``write_files`` returns it) names: start is the number of
    ids of all documents before, ids are little-endian unsigned 32-bit integers. A task reads some ``READ_BYTES`` of a file.

    What lies before a file is a running sum over the files, a row for each, so over one millionth of the documents or less."""
    earlier = Window.orderBy(F.col("null_id").desc(), "least", "tokens", "crc", "salt").rowsBetween(Window.unboundedPreceding, -1)
    based = files.withColumn("base", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))
    step = F.greatest(F.lit(1), F.floor(F.col("documents") * READ_BYTES / F.greatest("bytes", F.lit(1)))).cast("long")
    chunks = based.select("file", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("documents") - 1, step)).alias("first"), step.alias("n"), "documents")
    chunks = chunks.select("file", "base", "first", F.least("n", F.col("documents") - F.col("first")).alias("n")).repartition("file", "first")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base, first, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got, held = [], 0
                file = TokenFile(folder, name)
                for doc_id, before, ids in file.documents(first, n):
                    got.append((doc_id, base + before, ids.astype("<u4").tobytes()))
                    held += len(got[-1][2])
                    if held > 4 << 20 or len(got) >= 5000:
                        yield from arrow_rows("doc_id long, start long, ids binary", list(zip(*got, strict=True)))
                        got, held = [], 0
                file.file.close()
                if got:
                    yield from arrow_rows("doc_id long, start long, ids binary", list(zip(*got, strict=True)))

    return chunks.mapInArrow(read, "doc_id long, start long, ids binary")


def token_files(docs: DataFrame, tokenizer: str, end: int = 0) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each row of ``docs``, from files that are written into the shared folder and read again.

    Ids are those of the library's plain call ``encode(text, add_special_tokens=False)``, in which the literal of a special token is that
    token; ``end`` closes each document. A null or empty text is ``end`` alone. Documents follow by doc_id, null ones first; rows with
    the same one by the number of their ids, their crc, and, if these are equal, in any order. Every row is returned; further columns
    aren't read; an empty table gives no files and no rows. A text and its ids are held as a whole by the task that encodes,
    sorts or reads them, nothing more than a batch besides."""
    spark = docs.sparkSession
    folder = table_path(spark, "tokens")
    files = write_files(docs, folder, tokenizer, end)
    got = read_files(spark, folder, files)
    return got.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
