"""Ids of a lower-casing word BPE (a file of the ``tokenizers`` library), fast for texts of Latin letters.

Words repeat, so each distinct stretch between white space is encoded once per worker and kept. Its words are encoded by
the merge ranks of the same file in ``tiktoken``'s merge loop: the end-of-word mark is the byte 0xFF, which no UTF-8 text
holds. Texts with other characters than the table below, as they are or in lower case, and texts with the literal of a special
token go to the library itself: ids are those of the plain call ``encode(text, add_special_tokens=False)``, in which such a
literal is its token."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np

#: White space of Unicode below 0x250; texts above that, or with the separators 0x1C-0x1F that Python also splits at, take the library's way.
PLAIN = re.compile("[^ɐ-\U0010ffff]*")
SEPARATORS = "\x1c\x1d\x1e\x1f"


def below_0x100(text: str) -> bool:
    """Whether all code points are below 0x100, and so are those of the lower case: much faster than a pattern."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def latin(kind: str) -> str:
    """The ranges, for a regular expression, of the code points below 0x250 in a general category."""
    hit = [c for c in range(0x250) if unicodedata.category(chr(c))[0] == kind]
    return "".join(f"\\u{c:04x}" for c in hit)


class Chunks(dict):
    """Ids, as bytes of unsigned 32-bit integers, of stretches without white space; those of short ones are kept while there are not
    too many, so a worker holds at most about 25 MB."""

    LIMIT, LONGEST = 100_000, 40

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.literals = tuple(sorted(special))
        ranks = {bytes(byte[c] for c in w.removesuffix("</w>")) + b"\xff" * w.endswith("</w>"): i for w, i in vocab.items() if w not in special}
        self.merge = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        letters, numbers = latin("L"), latin("N")
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+").findall

    def __missing__(self, chunk: str) -> bytes:
        got = np.array([i for w in self.words(chunk) for i in self.merge(w.encode() + b"\xff")], "<u4").tobytes()
        if len(chunk) <= self.LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[chunk] = got
        return got

    def ids(self, text: str | None) -> bytes:
        """The whole text's ids without special tokens, as little-endian unsigned 32-bit integers."""
        text = text or ""
        low = text.lower()
        if (below_0x100(text) or PLAIN.fullmatch(text) and PLAIN.fullmatch(low)) and not any(x in text for x in (*SEPARATORS, *self.literals)):
            return b"".join(map(self.__getitem__, low.split()))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(2)
def chunks(path: str) -> Chunks:
    return Chunks(path)
