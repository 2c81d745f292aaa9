"""Exact deduplication by composable polynomial fingerprints and a chunkwise comparison.

Two texts are equal if they are identical without white space (``[\\x20\\x09-\\x0D]``). The
fingerprint of bytes ``b0 .. bn`` is the polynomial ``sum b_i * 256**(n-i)`` modulo a 128-bit
prime, so the print of a whole follows from its parts: ``H(ab) = H(a) * 256**len(b) + H(b)``.
Chunks are hashed apart and combined; :func:`fingerprint_chunks` does so for documents that are
themselves stored as many chunk rows, each hashed in parallel.

Equal fingerprints are no proof: the rows of a fingerprint meet, the row that would stay first, and
a task streams through them, comparing each with the first chunk by chunk; it holds one reference
text. Fingerprints with over 1/1024 of all rows (so at most 1024 of them) are hot: their rows are
dealt over salts by their place in the table, whatever their ids, and a copy of the row that stays
goes to each salt, so that no group gathers in one task. Group sizes and the row that stays come
from aggregates, never from collected groups.

A text of ``HUGE`` characters or more doesn't take its print in one call: its chunks become rows,
hashed in parallel, and the prints combine.

Defined results: null counts as empty; all texts without a character other than white space are
equal; of equal texts the one with the most code points stays, then the smallest doc_id, then any
one of rows that repeat whole; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .common import SPACES, durable, forget, merge_join, partitions, read_table, text_of

#: The largest prime below 2**128.
MODULUS = (1 << 128) - 159
CHUNK = 1 << 16
#: A fingerprint is hot if it has more than this share of the rows.
HOT_SHARE = 1 / 1024
SALTS = 64
#: Characters from which on a text is hashed as chunk rows, and characters of such a row.
HUGE, CHUNK_CHARS = 1 << 24, 1 << 20

_DELETE = SPACES.encode()


def chunk_print(chunk: bytes) -> int:
    return int.from_bytes(chunk, "big") % MODULUS


def combine(left: int, right: int, right_length: int) -> int:
    """The print of a concatenation, from the prints of its halves."""
    return (left * pow(256, right_length, MODULUS) + right) % MODULUS


def fingerprint(data: bytes) -> bytes:
    out = 0
    for at in range(0, len(data), CHUNK):
        chunk = data[at : at + CHUNK]
        out = combine(out, chunk_print(chunk), len(chunk))
    return out.to_bytes(16, "big")


def same_bytes(a: bytes, b: bytes) -> bool:
    """Compare chunk by chunk; ends at the first that differs."""
    return len(a) == len(b) and all(a[i : i + CHUNK] == b[i : i + CHUNK] for i in range(0, len(a), CHUNK))


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, _DELETE)


def fingerprint_chunks(chunks: DataFrame) -> DataFrame:
    """Fingerprints of documents stored as rows (doc_id, chunk_no, chunk): doc_id, fingerprint, n_bytes.

    Chunks are hashed where they lie; only (number, print, length) meet. A null chunk is empty.
    """
    ship_package(chunks.sparkSession)
    id_kind = chunks.schema["doc_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [normalised(x) for x in batch.column(2).to_pylist()]
            prints = [chunk_print(x).to_bytes(16, "big") for x in data]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.binary()), pa.array(map(len, data), pa.int64())], ["doc_id", "chunk_no", "fingerprint", "n_bytes"])

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk_no")
        out = size = 0
        for part, n in zip(table.column("fingerprint").to_pylist(), table.column("n_bytes").to_pylist(), strict=True):
            out, size = combine(out, int.from_bytes(part, "big"), n), size + n
        return pa.table({"doc_id": table.column("doc_id")[:1], "fingerprint": pa.array([out.to_bytes(16, "big")], pa.binary()), "n_bytes": [size]})

    rows = chunks.select("doc_id", F.col("chunk_no").cast("long"), F.col("chunk").cast("string"))
    hashes = rows.mapInArrow(hashed, f"doc_id {id_kind}, chunk_no long, fingerprint binary, n_bytes long")
    return hashes.groupBy("doc_id").applyInArrow(joined, f"doc_id {id_kind}, fingerprint binary, n_bytes long")


def _documents(df: DataFrame, carry: bool = False) -> DataFrame:
    """(doc_id, tid, n_chars, text), and ``row`` with ``carry``."""
    row = [F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")] if carry else []
    docs = df.select(F.col("doc_id").cast("long"), text_of("text").alias("text"), *row)
    return docs.select("doc_id", F.xxhash64("text").alias("tid"), F.length("text").cast("long").alias("n_chars"), "text", *(["row"] if carry else []))


def _fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, tid, n_chars, fingerprint); null for huge texts, whose chunks are hashed apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [None if x is None else fingerprint(normalised(x)) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(prints, pa.binary())], ["doc_id", "tid", "n_chars", "fingerprint"])

    small = F.when(F.col("n_chars") < HUGE, F.col("text"))
    return docs.select("doc_id", "tid", "n_chars", small.alias("text")).mapInArrow(run, "doc_id long, tid long, n_chars long, fingerprint binary")


def _of_chunks(docs: DataFrame) -> DataFrame:
    """(tid, fingerprint) of huge texts, by chunk rows."""
    huge = docs.where(F.col("n_chars") >= HUGE).select("tid", "n_chars", "text").dropDuplicates(["tid"])
    numbers = F.sequence(F.lit(0), F.ceil(F.col("n_chars") / CHUNK_CHARS).cast("int") - 1)
    chunks = huge.select(F.col("tid").alias("doc_id"), "text", F.explode(numbers).alias("chunk_no"))
    chunks = chunks.select("doc_id", "chunk_no", F.substr("text", F.col("chunk_no") * CHUNK_CHARS + 1, F.lit(CHUNK_CHARS)).alias("chunk"))
    chunks = chunks.repartition(partitions(docs.sparkSession), "doc_id", "chunk_no")
    return fingerprint_chunks(chunks).select(F.col("doc_id").alias("tid"), "fingerprint")


def _dealt(docs: DataFrame) -> DataFrame:
    """``docs`` of :func:`_documents` -> with fingerprint, salt and reference: rows that may be equal
    have the first two in common, and a hot group has a reference in each salt, the row that stays."""
    spark = docs.sparkSession
    prints = durable(_fingerprints(docs), "fingerprints")
    of_chunks = None if prints.where("fingerprint is null").isEmpty() else durable(_of_chunks(docs), "huge-fingerprints")
    every = prints.where("fingerprint is not null").select("doc_id", "tid", "n_chars", "fingerprint")
    if of_chunks is not None:
        every = every.unionByName(merge_join(prints.where("fingerprint is null").drop("fingerprint"), of_chunks, "tid"))
    stays = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("minus_id"), "tid")).alias("stays")
    groups = every.groupBy("fingerprint").agg(F.count("*").alias("n"), stays)
    least = max(1000, int(prints.count() * HOT_SHARE))
    # fewer than 1 / HOT_SHARE, whatever the input
    hot = [(bytes(r.fingerprint), None if r.minus_id is None else -r.minus_id, r.tid) for r in groups.where(F.col("n") > least).select("fingerprint", "stays.minus_id", "stays.tid").collect()]
    forget(prints)
    known = spark.sparkContext.broadcast({key for key, _, _ in hot})

    columns = [f for f in docs.schema.fields if f.name != "print"]
    rows = docs.withColumn("print", F.lit(None).cast("binary"))
    if of_chunks is not None:
        huge = merge_join(docs.where(F.col("n_chars") >= HUGE), of_chunks.withColumnRenamed("fingerprint", "print"), "tid")
        rows = rows.where(F.col("n_chars") < HUGE).unionByName(huge)
    # a row's place in the table deals it, so that repeats of a row spread, too
    rows = rows.select("*", F.lit(0).alias("reference"), F.monotonically_increasing_id().alias("place"))
    if hot:
        those = F.broadcast(spark.createDataFrame(hot, "print binary, hot_id long, hot_tid long"))
        first = docs.join(those, docs["doc_id"].eqNullSafe(F.col("hot_id")) & (docs["tid"] == F.col("hot_tid"))).dropDuplicates(["print"])
        copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("place")
        rows = rows.unionByName(first.select(*docs.columns, "print", F.lit(1).alias("reference"), copies))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = known.value
        for batch in batches:
            keys, salts = [], []
            for text, given, place in zip(*(batch.column(c).to_pylist() for c in ("text", "print", "place")), strict=True):
                key = fingerprint(normalised(text)) if given is None else given
                keys.append(key)
                salts.append(place % SALTS if key in hot else 0)
            kept = [batch.column(f.name) for f in columns]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(salts, pa.int32()), batch.column("reference"), *kept], ["fingerprint", "salt", "reference", *(f.name for f in columns)])

    schema = T.StructType([T.StructField("fingerprint", T.BinaryType()), T.StructField("salt", T.IntegerType()), T.StructField("reference", T.IntegerType()), *columns])
    return rows.mapInArrow(run, schema)


def _met(dealt: DataFrame) -> DataFrame:
    """Rows that may be equal side by side, the row that stays first."""
    order = ["fingerprint", "salt", F.desc("reference"), F.desc("n_chars"), F.asc_nulls_last("doc_id")]
    return dealt.repartition(partitions(dealt.sparkSession), "fingerprint", "salt").sortWithinPartitions(*order)


def drop_exact_copies(df: DataFrame) -> DataFrame:
    """The rows of ``df`` (doc_id, text, more) that stay, whole and unchanged, with one shuffle.

    Of equal texts the row with the most code points stays, then the smallest doc_id (rows without
    one come last), then any one of rows that repeat whole. A text that differs from the reference
    of a hot fingerprint, which takes a collision of 128 bits, is compared within its salt only.
    """
    ship_package(df.sparkSession)
    docs = _documents(df, carry=True)
    kind = docs.schema["row"].dataType.simpleString()
    # the text is in the row already
    met = _met(_dealt(docs).drop("text", "tid"))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, references = None, []
        for batch in batches:
            stay = []
            texts = batch.column("row").field("text").to_pylist()
            for key, salt, reference, text in zip(*(batch.column(k).to_pylist() for k in ("fingerprint", "salt", "reference")), texts, strict=True):
                if at != (key, salt):
                    at, references = (key, salt), []
                body = normalised(text)
                new = not any(same_bytes(x, body) for x in references)
                if new:
                    references.append(body)
                stay.append(new and not (reference and salt))  # one salt's reference is the row itself
            yield batch.filter(pa.array(stay, pa.bool_())).select(["row"])

    return met.mapInArrow(streamed, f"row {kind}").select("row.*")


def exact_dedup(df: DataFrame) -> DataFrame:
    """Per row of ``df`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    ship_package(df.sparkSession)
    met = _met(_dealt(_documents(df)).drop("tid"))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, references = None, []
        for batch in batches:
            out = []
            for key, salt, reference, doc, n_chars, text in zip(*(batch.column(c).to_pylist() for c in ("fingerprint", "salt", "reference", "doc_id", "n_chars", "text")), strict=True):
                if at != (key, salt):
                    at, references = (key, salt), []
                body = normalised(text)
                same = next((i for i, x in enumerate(references) if same_bytes(x, body)), None)
                if same is None:
                    same = len(references)
                    references.append(body)
                if not reference:
                    digest = hashlib.sha256(body).hexdigest()
                    out.append((doc, n_chars, digest, f"{key.hex()}{'' if same == 0 else f' {digest}'}"))
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["doc_id", "n_chars", "text_sha256", "same_as"])

    rows = met.mapInArrow(streamed, "doc_id long, n_chars long, text_sha256 string, same_as string")
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()), "compared")
    stays = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("minus_id"), (-F.col("row")).alias("minus_row")))
    sizes = durable(rows.groupBy("same_as").agg(F.count("*").alias("group_size"), stays.alias("stays")), "groups")
    return merge_join(rows, sizes, "same_as").select(
        "doc_id",
        (-F.col("stays.minus_id")).alias("keep_id"),
        "group_size",
        (F.col("row") == -F.col("stays.minus_row")).alias("kept"),
        "text_sha256",
    )


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Exact duplicates among every whole text of ``documents``."""
    return exact_dedup(read_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, struct_pack(a := -n, b := doc_id)) AS keep_id
  FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
