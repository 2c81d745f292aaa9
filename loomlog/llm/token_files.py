"""Token ids in Arrow IPC files of equal-length sequences, for zero-copy random access.

Documents are dealt by ranges of their ids, and of a hash of the text where an id repeats or is null, so
that the files, taken in order, hold them in ascending order. Each part is one Arrow IPC file whose record batches have the same number of rows
and whose columns are fixed-size lists: ``ids`` (16-bit where the vocabulary allows, else 32-bit),
``mask`` (bits: real ids, not padding) and ``ends`` (bits: a document ends here). Sequence ``i`` is
row ``i % rows`` of batch ``i // rows``; a memory map gives its ids, and its masks as packed bits,
without a copy, since lengths are multiples of eight. Documents run on
from one sequence to the next; only the last sequence of a part is padded. Beside each file lies an
index of the same format: document, place of its first id in the part, number of ids.

A task writes under a name of its own attempt; a part counts only when its row is in the manifest,
which Spark commits once. So a lost executor or a second attempt leaves unused files, never mixed
ones. Files are written with ``pyarrow.fs`` to the folder given, which all executors must share.

Defined results: a null text counts as empty; an empty text is its end id alone; repeated rows are
written each, in the order of their texts' hashes; a null document id sorts first; an empty table gives an
empty manifest; other columns are ignored.
"""

from __future__ import annotations

import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, fresh_path, partitions, read_table, text_of
from .word_bpe import broadcast_file, encoder

MANIFEST = "part int, path string, index_path string, n_docs long, n_ids long, n_sequences long, length int"


class SequenceWriter:
    """Packs a stream of ids into record batches of ``rows`` sequences of ``length`` ids."""

    def __init__(self, sink, length: int, rows: int, wide: bool):
        if length % 8:
            raise ValueError("the length of sequences is a multiple of eight, so that masks begin at a byte")
        self.length, self.rows = length, rows
        self.kind, self.ids_type = (np.uint32, pa.uint32()) if wide else (np.uint16, pa.uint16())
        self.schema = pa.schema([("ids", pa.list_(self.ids_type, length)), ("mask", pa.list_(pa.bool_(), length)), ("ends", pa.list_(pa.bool_(), length))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.waiting = bytearray()
        self.last: list[int] = []  # places of end ids among the waiting ones
        self.n_ids = self.n_sequences = 0

    def add(self, packed: bytes) -> None:
        self.waiting += packed
        self.last.append(len(self.waiting) // 4 - 1)
        self.n_ids += len(packed) // 4
        block = self.rows * self.length
        while len(self.waiting) >= 4 * block:
            self._batch(block)

    def _batch(self, n: int) -> None:
        ids = np.frombuffer(bytes(self.waiting[: 4 * n]), "<u4")
        del self.waiting[: 4 * n]
        size = -(-n // self.length) * self.length
        values, real, ends = np.zeros(size, self.kind), np.zeros(size, bool), np.zeros(size, bool)
        values[:n], real[:n] = ids, True
        ends[[i for i in self.last if i < n]] = True
        self.last = [i - n for i in self.last if i >= n]
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (values, real, ends)]
        self.writer.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))
        self.n_sequences += size // self.length

    def close(self) -> None:
        if self.waiting:
            self._batch(len(self.waiting) // 4)
        self.writer.close()


class SequenceReader:
    """Random access to a file of :class:`SequenceWriter`; local files are memory-mapped."""

    def __init__(self, path: str):
        store, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        source = pa.memory_map(inner) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(inner)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size if "ids" in self.file.schema.names else 0

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return 0 if n == 0 else (n - 1) * self.file.get_batch(0).num_rows + self.file.get_batch(n - 1).num_rows

    def sequence(self, i: int) -> dict[str, np.ndarray]:
        """Views of sequence ``i``: ids, and masks as packed bits (see :func:`unpacked`)."""
        rows = self.file.get_batch(0).num_rows
        batch, at = self.file.get_batch(i // rows), i % rows * self.length
        out = {"ids": batch.column("ids").values.to_numpy()[at : at + self.length]}
        for name in ("mask", "ends"):
            bits = batch.column(name).values
            start = (bits.offset + at) // 8
            out[name] = np.frombuffer(bits.buffers()[1], np.uint8)[start : start + self.length // 8]
        return out

    def flat(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, as views into the batches that hold them."""
        block = self.file.get_batch(0).num_rows * self.length if n else 1
        while n > 0:
            view = self.file.get_batch(start // block).column("ids").flatten().to_numpy()
            view = view[start % block : start % block + n]
            yield view
            start, n = start + len(view), n - len(view)

    def tables(self) -> Iterator[pa.RecordBatch]:
        return (self.file.get_batch(i) for i in range(self.file.num_record_batches))


def unpacked(bits: np.ndarray) -> np.ndarray:
    """A mask of :meth:`SequenceReader.sequence` as booleans."""
    return np.unpackbits(bits, bitorder="little").view(bool)


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def write_token_files(df: DataFrame, tokenizer_path: str, end_id: int, folder: str, length: int = 2048, rows: int = 64) -> DataFrame:
    """Write ``df`` (doc_id, text) to ``folder``; returns the committed manifest, a row a part."""
    spark = df.sparkSession
    file = broadcast_file(spark, tokenizer_path)
    folder = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = encoder(file), int(end_id).to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        writer = store = None
        found: list[tuple] = []
        for batch in batches:
            if writer is None and batch.num_rows:
                store, inner = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith(("/", "file:")) else f"/{folder}")
                store.create_dir(inner, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}"
                sink = store.open_output_stream(posixpath.join(inner, f"{name}.arrow"))
                index_sink = store.open_output_stream(posixpath.join(inner, f"{name}.index.arrow"))
                writer = SequenceWriter(sink, length, rows, max(tokens.vocabulary_size, end_id + 1) > 1 << 16)
                index = pa.ipc.new_file(index_sink, INDEX)
                n_docs = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packed = tokens.packed(text) + end
                found.append((doc, writer.n_ids, len(packed) // 4))
                writer.add(packed)
            if found:
                index.write_batch(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], schema=INDEX))
                n_docs += len(found)
                found = []
        if writer is not None:
            writer.close()
            index.close()
            sink.close()
            index_sink.close()
            row = [part, f"{folder}/{name}.arrow", f"{folder}/{name}.index.arrow", n_docs, writer.n_ids, writer.n_sequences, length]
            kinds = [pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [x.split()[0] for x in MANIFEST.split(", ")])

    docs = df.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).withColumn("tid", F.xxhash64("text"))
    dealt = docs.repartitionByRange(partitions(spark), "doc_id", "tid").sortWithinPartitions("doc_id", "tid")
    return durable(dealt.select("doc_id", "text").mapInArrow(run, MANIFEST), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Read the files of a manifest back: doc_id, start over all parts, n_tokens, ids_crc32."""
    # a row a part: small however large the corpus, so one task may order it
    placed = manifest.withColumn("base", F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.select("path", "index_path", F.coalesce("base", F.lit(0)).cast("long").alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index_path, base in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids = SequenceReader(path)
                for docs in SequenceReader(index_path).tables():
                    starts, sizes = (docs.column(i).to_numpy() for i in (1, 2))
                    sums = []
                    for start, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                        crc = 0
                        for view in ids.flat(start, n):
                            crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                        sums.append(crc)
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts + base), docs.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = placed.repartition(partitions(manifest.sparkSession), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_files(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Write the ids of every whole text of ``documents`` to Arrow files and read them back."""
    import public_tokenizers

    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    docs = read_table(spark, sf_dir, "documents")
    return read_token_files(write_token_files(docs, path, 2, fresh_path(spark, "token-files")))
