"""Duplicate passages by relative Lempel-Ziv parsing against an index of reference blocks.

The reference of a document is all documents with a smaller id. A *window* is ``width``
consecutive words; a window is duplicate if its words also start somewhere in the reference.

**Blocks.** Each document cuts itself into reference blocks where its content says so: of the short
word runs (``gram`` words) in a window, the one of least hash is the window's anchor, and the
windows that share an anchor are a block. Equal windows have equal anchors wherever they stand, so
a duplicate window lies in blocks of the same anchor in both documents. A block is known by two
64-bit numbers, its anchor and all its words; an index row is the first document that has it.

**Factors.** Parsing goes greedily from left to right. A block that the index knows from an earlier
document is copied whole from the place where that document has it. At factor boundaries blocks
differ although some of their windows are equal, so there the windows are looked up one by one: the
first documents of all blocks that share an anchor with a different block index their windows, with
their places, and take what an earlier document has. A factor is a place in the document, a source, a
place in it and a number of words; it is extended as long as the next window is a copy of the very words
that follow in the source, so it is as long as the index lets it be. Factors of ``width`` words or more,
which all are, are the duplicate spans: just their words are cut.

Equality is that of two numbers: windows must have equal anchors and equal hashes of all words, 64
bits each. So only windows that share a run of ``gram`` words can be mistaken for each other, one pair in
2**64 of those.

Blocks and windows are aggregated to their first document before the shuffle, and joined back to
their places; so a passage that a third of all documents share is one index row, and no group is
ever collected: what is collected are the distinct copies of one text, however many rows repeat it.
Texts move twice: once for the windows at boundaries, once to cut the words out.

Defined results: null counts as empty; documents shorter than a window have no duplicate; copies
inside one document aren't duplicate; rows that share a doc_id are one document each and no
reference of each other; rows with a null doc_id are neither parsed nor a reference; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import durable, forget, merge_join, read_table, text_of
from .word_hash import WordHasher, shared_hasher

GRAM = 10

def blocks_of(words: list[bytes], width: int, gram: int, hasher: WordHasher) -> tuple[np.ndarray, ...]:
    """The blocks of a document: first window, number of windows, anchor, content."""
    n = len(words) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    prefix = hasher.prefix(hasher.hashes(words))
    starts = np.arange(len(words) - gram + 1)
    grams = hasher.runs(prefix, starts, starts + gram)
    span = width - gram + 1
    anchors = np.empty(n, np.int64)
    for at in range(0, n, 1 << 16):  # the first of the least, in slices of bounded size
        view = np.lib.stride_tricks.sliding_window_view(grams[at : min(at + (1 << 16), n) + span - 1], span)
        anchors[at : at + len(view)] = at + np.arange(len(view)) + view.argmin(axis=1)
    first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))
    last = first + count - 1
    # all words of the block, and where in it the anchor stands
    content = hasher.runs(prefix, first, last + width) ^ (count.astype(np.uint64) << np.uint64(8)) ^ (anchors[first] - first).astype(np.uint64)
    return first, count, grams[anchors[first]], content


def windows_of(words: list[bytes], width: int, starts: np.ndarray, hasher: WordHasher) -> np.ndarray:
    return hasher.runs(hasher.prefix(hasher.hashes(words)), starts, starts + width)


#: (first window, number of windows, source, first window in the source)
Copy = tuple[int, int, int, int]


def _blocks(docs: DataFrame, width: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = shared_hasher()
        for batch in batches:
            ids, tids, texts = (batch.column(i) for i in range(3))
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for doc, tid, text in zip(ids.to_pylist(), tids.to_pylist(), texts.to_pylist(), strict=True):
                found = blocks_of(text.encode().split(), width, gram, hasher)
                if len(found[0]):
                    for column, x in zip(out, (np.full(len(found[0]), doc), np.full(len(found[0]), tid), *found), strict=True):
                        column.append(x)
            if out[0]:
                doc, tid, first, count, anchor, content = (np.concatenate(x) for x in out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc), pa.array(tid), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64))],
                    ["doc_id", "tid", "first", "n", "anchor", "content"],
                )

    return docs.mapInArrow(run, "doc_id long, tid long, first int, n int, anchor long, content long")


def _boundary_windows(rows: DataFrame, width: int) -> DataFrame:
    """``rows`` (doc_id, tid, text, open: blocks to look into) -> their windows, one a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = shared_hasher()
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for doc, tid, text, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks.sort(key=lambda b: b["first"])
                sizes = np.array([b["n"] for b in blocks])
                starts = np.concatenate([np.arange(b["first"], b["first"] + b["n"]) for b in blocks])
                anchors = np.repeat(np.array([b["anchor"] for b in blocks], np.int64), sizes)
                hashes = windows_of(text.encode().split(), width, starts, hasher)
                for column, x in zip(out, (np.full(len(starts), doc), np.full(len(starts), tid), starts, anchors, hashes.view(np.int64)), strict=True):
                    column.append(x)
            if out[0]:
                doc, tid, start, anchor, window = (np.concatenate(x) for x in out)
                columns = [pa.array(doc), pa.array(tid), pa.array(start.astype(np.int32)), pa.array(anchor), pa.array(window)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tid", "first", "anchor", "window"])

    return rows.mapInArrow(run, "doc_id long, tid long, first int, anchor long, window long")


def factors_of(copies: list[Copy], width: int) -> list[tuple[int, int, int, int]]:
    """Copied windows, in any order -> greedy factors (start, words, source, start in the source).

    A factor goes on as long as the next window is a copy of what follows in its source.
    """
    out: list[list[int]] = []
    end = -1  # the first window after the last factor
    for first, n, source, at in sorted(copies):
        past = max(0, end - first)
        first, n, at = first + past, n - past, at + past
        if n <= 0:
            continue
        last = out[-1] if out else None
        if last and first == end and last[2] == source and last[3] + first - last[0] == at:
            last[1] += n
        else:
            out.append([first, n + width - 1, source, at])
        end = first + n
    return [tuple(x) for x in out]


def substring_dedup(df: DataFrame, width: int = 50, gram: int = GRAM, carry: bool = False) -> DataFrame:
    """Per row of ``df`` (doc_id, text): doc_id, n_words, n_removed, factors, kept (the text left).

    ``factors`` are (start, n_words, source, source_start) in words of the document and of the source
    (where a source has the words more than once, one of the places); every word of a factor is removed
    and the words kept are joined by one space. With ``carry``, ``row`` has the other columns, and ``kept``
    is the text as it was where nothing is removed.
    """
    spark = df.sparkSession
    ship_package(spark)
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns if c != "text")) if carry else F.lit(None).cast("boolean")
    docs = df.select(F.col("doc_id").cast("long"), text_of("text").alias("text"), row.alias("row"))
    docs = docs.withColumn("tid", F.xxhash64("text"))
    blocks = durable(_blocks(docs.where("doc_id is not null").select("doc_id", "tid", "text"), width, gram), "blocks")

    # anchors that two documents share, and whether their blocks differ
    anchors = blocks.groupBy("anchor").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.min("content").alias("c0"), F.max("content").alias("c1"))
    anchors = durable(anchors.where("d0 < d1").select("anchor", (F.col("c0") != F.col("c1")).alias("differ")), "anchors")
    shared = durable(merge_join(blocks, anchors, "anchor"), "shared")
    forget(blocks, anchors)
    index = durable(shared.groupBy("anchor", "content").agg(F.min("doc_id").alias("source"), F.min_by("first", "doc_id").alias("source_first")), "index")
    parsed = merge_join(shared, index, ["anchor", "content"])
    parsed = durable(parsed.where("source < doc_id or differ").select("doc_id", "tid", "first", "n", "anchor", "source", "source_first"), "parsed")
    forget(shared, index)
    copies = parsed.where("source < doc_id").select("doc_id", "tid", "first", "n", "source", "source_first")

    # at the boundaries: windows one by one, of each text once
    opened = parsed.where("source = doc_id").groupBy("doc_id", "tid").agg(F.collect_set(F.struct("first", "n", "anchor")).alias("open"))
    looked = merge_join(docs, opened, ["doc_id", "tid"]).dropDuplicates(["doc_id", "tid"])
    windows = durable(_boundary_windows(looked.select("doc_id", "tid", "text", "open"), width), "windows")
    known = windows.groupBy("anchor", "window").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.min_by("first", "doc_id").alias("source_first"))
    known = durable(known.where("source < last").drop("last"), "known-windows")
    more = merge_join(windows, known, ["anchor", "window"]).where("source < doc_id").select("doc_id", "tid", "first", F.lit(1).alias("n"), "source", "source_first")

    one = F.struct("first", "n", "source", "source_first")
    cuts = durable(copies.unionByName(more).groupBy("doc_id", "tid").agg(F.collect_set(one).alias("copies")), "copies")
    forget(parsed, windows, known)
    out = _cut(merge_join(docs, cuts, ["doc_id", "tid"], "left").select("doc_id", "text", "copies", "row"), width, reflow=not carry)
    return out if carry else out.drop("row")


def _cut(rows: DataFrame, width: int, reflow: bool = True) -> DataFrame:
    factor = pa.list_(pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, removed, factors, kept = [], [], [], [], []
            for doc, text, copies in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                words = text.encode().split()
                found = factors_of([(c["first"], c["n"], c["source"], c["source_first"]) for c in copies or ()], width)
                ids.append(doc)
                counts.append(len(words))
                left: list[bytes] = []
                end = 0
                for start, n, *_ in found:
                    left += words[end:start]
                    end = max(end, start + n)
                left += words[end:]
                removed.append(len(words) - len(left))
                factors.append([{"start": s, "n_words": n, "source": d, "source_start": at} for s, n, d, at in found])
                kept.append(b" ".join(left).decode() if found or reflow else text)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(factors, factor), pa.array(kept, pa.string()), batch.column(3)], ["doc_id", "n_words", "n_removed", "factors", "kept", "row"])

    names = "doc_id long, n_words long, n_removed long, factors array<struct<start: int, n_words: int, source: long, source_start: int>>, kept string"
    return rows.mapInArrow(run, f"{names}, row {rows.schema['row'].dataType.simpleString()}")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Duplicate 50-word windows of every whole text of ``documents``."""
    out = substring_dedup(read_table(spark, sf_dir, "documents"), 50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
