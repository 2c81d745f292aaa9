"""Whole texts to token ids with a ``tokenizers`` vocabulary, by cached chunks.

The vocabularies served here drop white space before anything else, so the ids of a text are the
ids of its white-space separated chunks, in order. Each distinct chunk goes through the library
once and is remembered as packed little-endian 32-bit ids; the table of remembered chunks is
bounded. A chunk of letters with ASCII punctuation after it is two pre-tokens in any of them, so
the two halves are remembered separately.
"""

from __future__ import annotations

import os
from array import array
from unicodedata import normalize

from pyspark import Broadcast
from pyspark.sql import SparkSession

from ..session import ship_package

#: Tokenizer files are at most this large; they go to the executors as a broadcast variable.
MAX_FILE_BYTES = 64 << 20

_ASCII_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_PUNCTUATION = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def broadcast_file(spark: SparkSession, path: str) -> Broadcast:
    ship_package(spark)
    with open(path, "rb") as f:
        data = f.read(MAX_FILE_BYTES + 1)
    if len(data) > MAX_FILE_BYTES:
        raise ValueError(f"{path} has more than {MAX_FILE_BYTES} bytes")
    return spark.sparkContext.broadcast((f"{path}:{len(data)}:{hash(data)}", data))


class ChunkEncoder:
    """Special tokens' strings inside a text are ordinary text. ``max_chunks`` bounds the memory."""

    def __init__(self, data: bytes, max_chunks: int = 450_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.encode_special_tokens = True
        self.max_chunks = max_chunks
        self.known: dict[bytes, bytes] = {}
        normal = str(self.tokenizer.normalizer)
        self.lower = "Lowercase" in normal
        if "Replace" not in normal and "Removed" not in str(self.tokenizer.pre_tokenizer):
            raise ValueError("this vocabulary keeps white space; chunks can't be encoded one by one")

    @property
    def vocabulary_size(self) -> int:
        return self.tokenizer.get_vocab_size()

    def _library(self, chunk: bytes) -> bytes:
        return array("I", self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids).tobytes()

    def _half(self, chunk: bytes) -> bytes:
        out = self.known.get(chunk)
        if out is None:
            out = self._library(chunk)
            if len(self.known) < self.max_chunks and len(chunk) <= 64:
                self.known[chunk] = out
        return out

    def _chunk(self, chunk: bytes) -> bytes:
        word = chunk.rstrip(_PUNCTUATION)
        if len(word) < len(chunk) and normalize("NFC", word.decode()).lower().isalpha():  # marks would join the punctuation
            return self._half(word) + self._half(chunk[len(word) :])
        return self._half(chunk)

    def packed(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        data = (text or "").encode()
        chunks = (data.translate(_ASCII_UPPER) if self.lower else data).split()
        known = self.known
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            get, make = known.get, self._chunk
            return b"".join([get(c) or make(c) for c in chunks])


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(file: Broadcast) -> ChunkEncoder:
    """One encoder for each Python worker and file."""
    name, data = file.value
    if name not in _ENCODERS:
        _ENCODERS[name] = ChunkEncoder(data)
    return _ENCODERS[name]
