"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

**Sketch** (Dahlgaard, Knudsen and Thorup, 2017). A set fills ``t`` bins in rounds: in the first
``t`` rounds each element falls into a hashed bin, in the next ``t`` each element falls into the
round's own bin, so that every bin fills; a bin keeps its first round's smallest value. Bins agree
with the sets' Jaccard similarity as probability, with concentration bounds, after O(t log t + n)
work. Bands of ``rows`` bins make bucket keys; number and width follow from the similarity asked
for, such that a pair at the threshold shares no bucket with a probability of one in a million.

**Groups.** Documents with the same set form a class; one of its texts stands for it. Members of a
bucket are compared by the sketches themselves, of which 8 bits a bin are kept: two are tied if their bins
agree so often that a pair at the threshold fails with a probability of about one in a million. So a
common passage that puts unlike texts into a bucket doesn't bring their texts together, and no text moves
for this. Buckets with the same members count once. Ties make groups, in which links are decided on full sets.

**Meeting.** In a bucket, by sketches, and in a group, by full sets, the members meet twice. First all
are compared with one pivot, in a group the member with the most bucket neighbours: a task streams
through its rows and holds the pivot alone; groups with over 1/1024 of the rows are salted and the
pivot is copied to each salt. Then those that aren't tied to the pivot meet all others, block against
block. A block has a bounded number of rows and, on average, of shingles, and a block pair is one
task's working set; what comes out of it are the ties or links that its components need, never all
pairs. So each pair of a group is decided on full sets unless both are linked to its pivot anyway.
Links then make components.

Defined results: null counts as empty; a document without words has no set and is linked with
nothing; one with fewer words than a shingle has its whole word sequence as its only shingle;
rows that share a doc_id are one document: each of their texts is compared, what any of them is
linked with is linked with all, and they share the verdict; null document ids are unlinked and
kept; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import durable, forget, merge_join, partitions, read_table, text_of
from .components import connected_components
from .word_hash import WordHasher, mix, shared_hasher

HOT_SHARE = 1 / 1024
SALTS = 64
#: Shingles in a block of texts, on average; rows in a block of texts and in one of sketches.
BLOCK_SHINGLES, BLOCK_TEXTS, BLOCK_SKETCHES = 100_000, 256, 1024


def bands_for(similarity: float, miss: float = 1e-6, most_bins: int = 208) -> tuple[int, int]:
    """(bands, rows): the widest bands that miss a pair at ``similarity`` with probability ``miss``."""
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(miss) / math.log(1 - similarity**rows)) if similarity < 1 else 1
        if bands * rows <= most_bins:
            return bands, rows
    raise ValueError("no banding for this similarity")


def shingle_set(text: str | None, width: int, hasher: WordHasher) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; A-Z count as a-z."""
    hashes = hasher.hashes((text or "").encode().lower().split())
    n = len(hashes)
    if n == 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(max(1, n - width + 1))
    return np.unique(hasher.runs(hasher.prefix(hashes), starts, starts + min(width, n)))


class Sketcher:
    """Fast similarity sketching with ``bins`` bins."""

    def __init__(self, bins: int):
        self.bins = bins
        self.seeds = mix(np.arange(1, 2 * bins + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def sketch(self, elements: np.ndarray) -> np.ndarray:
        t = self.bins
        out = np.full(t, np.iinfo(np.uint64).max, np.uint64)
        step = max(1, -(-11 * t // max(1, len(elements))))
        for first in range(0, 2 * t, step):
            rounds = np.arange(first, min(first + step, 2 * t), dtype=np.uint64)
            hashes = mix(elements[None, :] ^ self.seeds[first : first + step, None])
            falls = (hashes >> np.uint64(48)) * np.uint64(t) >> np.uint64(16)
            own = rounds >= t
            falls[own] = (rounds[own] - np.uint64(t))[:, None]
            values = (rounds[:, None] << np.uint64(48)) | (hashes & np.uint64((1 << 48) - 1))
            np.minimum.at(out, falls.ravel().astype(np.int64), values.ravel())
            if out.max() != np.iinfo(np.uint64).max:
                break
        return out

    def keys(self, sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
        """A bucket key for each band."""
        out = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
        for column in sketch[: bands * rows].reshape(bands, rows).T:
            out = mix(out ^ column)
        return out.view(np.int64)


def similar(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def bins_in_common(similarity: float, bins: int) -> int:
    """Bins that agree in a pair at ``similarity``, less five standard deviations."""
    return max(1, math.floor(bins * similarity - 5 * math.sqrt(bins * similarity * (1 - similarity))))


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)


def _sketched(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, sketcher = shared_hasher(), Sketcher(bands * rows)
        for batch in batches:
            out = []
            for doc, tid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                elements = shingle_set(text, width, hasher)
                if len(elements):
                    digest = hashlib.blake2b(elements.tobytes(), digest_size=16).digest()
                    sketch = sketcher.sketch(elements)
                    out.append((doc, tid, len(elements), digest, (sketch & np.uint64(255)).astype(np.uint8).tobytes(), sketcher.keys(sketch, bands, rows)))
                else:
                    out.append((doc, tid, 0, None, None, None))
            yield _batch(out, ["doc_id", "tid", "n_shingles", "digest", "bins", "keys"], kinds)

    return docs.mapInArrow(run, "doc_id long, tid long, n_shingles long, digest binary, bins binary, keys array<long>")


class ByBins:
    """Meeting by sketches: two members are tied if enough of their bins agree."""

    kind = "binary"

    def __init__(self, least: int):
        self.least = least

    def load(self, payload: bytes) -> np.ndarray:
        return np.frombuffer(payload, np.uint8)

    def size(self, member: np.ndarray) -> int:
        return 0

    def close(self, a: np.ndarray, b: np.ndarray) -> bool:
        return int((a == b).sum()) >= self.least

    def many(self, members: list[np.ndarray]):
        """A function from a member to the places of those close to it."""
        every = np.stack(members)
        return lambda query: np.flatnonzero((every == query).sum(1) >= self.least)


class BySets:
    """Meeting by full shingle sets of texts."""

    kind = "string"

    def __init__(self, width: int, percent: int):
        self.width, self.percent = width, percent

    def load(self, payload: str) -> np.ndarray:
        return shingle_set(payload, self.width, shared_hasher())

    def size(self, member: np.ndarray) -> int:
        return len(member)

    def close(self, a: np.ndarray, b: np.ndarray) -> bool:
        return similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), self.percent)

    def many(self, members: list[np.ndarray]):
        """The same, through an inverted index of the members' shingles."""
        sizes = np.array([len(m) for m in members])
        every = np.concatenate(members)
        order = np.argsort(every, kind="stable")
        owner = np.repeat(np.arange(len(members)), sizes)[order]
        every = every[order]

        def found(query: np.ndarray) -> np.ndarray:
            low, high = np.searchsorted(every, query, "left"), np.searchsorted(every, query, "right")
            counts = high - low
            hits = np.repeat(low - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum()))
            shared = np.bincount(owner[hits], minlength=len(members))
            return np.flatnonzero(100 * shared >= self.percent * (len(query) + sizes - shared))

        return found


def _against_pivot(rows: DataFrame, hot: dict[int, int], by) -> DataFrame:
    """``rows`` (grp, node, rank, payload) -> (grp, salt, pivot, node, size, linked), by streaming. The
    member of least (rank, node) is the pivot; ``hot`` names it for groups that are salted."""
    hot_groups = rows.sparkSession.sparkContext.broadcast(hot)
    payload_kind = pa.binary() if by.kind == "binary" else pa.string()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = hot_groups.value
        for batch in batches:
            out = []
            for group, node, rank, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pivot = hot.get(group)
                if pivot is None:
                    out.append((group, 0, 0, rank, node, payload))
                elif pivot == node:
                    out += [(group, s, 0, rank, node, payload) for s in range(SALTS)]
                else:
                    out.append((group, zlib.crc32(b"%d" % node) % SALTS, 1, rank, node, payload))
            yield _batch(out, ["grp", "salt", "later", "rank", "node", "payload"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), payload_kind])

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pivot, reference = None, None, None
        for batch in batches:
            out = []
            for group, salt, _, _, node, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                member = by.load(payload)
                if at != (group, salt):
                    at, pivot, reference = (group, salt), node, member
                    if salt == 0:
                        out.append((group, salt, pivot, node, by.size(member), True))
                else:
                    out.append((group, salt, pivot, node, by.size(member), by.close(reference, member)))
            yield _batch(out, ["grp", "salt", "pivot", "node", "size", "linked"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()])

    met = rows.select("grp", "node", "rank", "payload").mapInArrow(dealt, f"grp long, salt int, later int, rank long, node long, payload {by.kind}")
    met = met.repartition(partitions(rows.sparkSession), "grp", "salt").sortWithinPartitions("grp", "salt", "later", "rank", "node")
    return met.mapInArrow(streamed, "grp long, salt int, pivot long, node long, size long, linked boolean")


def links_in_blocks(queries: list[tuple], members: list[tuple], by) -> list[tuple[int, int]]:
    """Links between two blocks of (node, label, member), of those with different labels: as few as
    make the same components."""
    if not queries or not members:
        return []
    found = by.many([m[2] for m in members])
    labels: dict = {}

    def root(x):
        while labels.get(x, x) != x:
            x = labels[x]
        return x

    out = []
    for node, label, member in queries:
        for i in found(member).tolist():
            a, b = root(label), root(members[i][1])
            if a != b:
                labels[max(a, b)] = min(a, b)
                out.append((node, members[i][0]))
    return out


def _among_rest(rows: DataFrame, by) -> DataFrame:
    """``rows`` (grp, q_blocks, m_blocks, unlinked, label, node, payload) -> links (a, b).

    A row joins every block pair of its side; a block pair is one task's working set.
    """
    payload_kind = pa.binary() if by.kind == "binary" else pa.string()
    names = ["grp", "q", "m", "query", "label", "node", "payload"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), payload_kind]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for group, q_blocks, m_blocks, unlinked, label, node, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                salt = zlib.crc32(b"%d" % node)
                out += [(group, q, salt % m_blocks, 0, label, node, payload) for q in range(q_blocks)]
                if unlinked:
                    out += [(group, salt % q_blocks, m, 1, label, node, payload) for m in range(m_blocks)]
            if out:
                yield _batch(out, names, kinds)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ([], [])
        for batch in batches:
            out = []
            for group, q, m, query, label, node, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (group, q, m):
                    out += links_in_blocks(sides[1], sides[0], by)
                    at, sides = (group, q, m), ([], [])
                sides[query].append((node, label, by.load(payload)))
            if out:
                yield _batch(out, ["a", "b"], [pa.int64(), pa.int64()])
        if out := links_in_blocks(sides[1], sides[0], by):
            yield _batch(out, ["a", "b"], [pa.int64(), pa.int64()])

    met = rows.select("grp", "q_blocks", "m_blocks", "unlinked", "label", "node", "payload").mapInArrow(dealt, f"grp long, q int, m int, query int, label long, node long, payload {by.kind}")
    met = met.repartition(partitions(rows.sparkSession), "grp", "q", "m").sortWithinPartitions("grp", "q", "m")
    return met.mapInArrow(compared, "a long, b long")


def _met(members: DataFrame, payloads: DataFrame, by, most_rows: int, hot: dict[int, int], hot_rows: int) -> DataFrame:
    """Links (a, b) in groups: ``members`` (grp, node, rank), ``payloads`` (node, payload)."""
    first = durable(_against_pivot(merge_join(payloads, members, "node"), hot, by), "against-pivot")
    links = first.where("linked and node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    left = first.groupBy("grp").agg(
        F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("open"), F.sum("size").alias("all_size"),
        F.sum(F.when(F.col("linked"), 0).otherwise(F.col("size"))).alias("open_size"),
    )
    blocks = lambda n, size: F.greatest(F.lit(1), F.ceil(F.col(n) / most_rows), F.ceil(F.col(size) / BLOCK_SHINGLES)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.when(F.col("n") > hot_rows, SALTS - 1).otherwise(0)))
    left = left.where("n > 2 and open > 0").select("grp", salts.alias("salt"), blocks("open", "open_size").alias("q_blocks"), blocks("n", "all_size").alias("m_blocks"))
    label = F.when(F.col("linked"), F.col("pivot")).otherwise(F.col("node"))
    state = first.join(left, ["grp", "salt"]).select("grp", "node", "q_blocks", "m_blocks", (~F.col("linked")).alias("unlinked"), label.alias("label"))
    links = durable(links.unionByName(_among_rest(merge_join(payloads, state, "node"), by)), "links")
    forget(first)
    return links


def near_dedup(df: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``df`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked if ``100 * shared shingles >= percent * all shingles``.
    """
    spark = df.sparkSession
    ship_package(spark)
    bands, rows = bands_for(percent / 100)
    docs = df.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).withColumn("tid", F.xxhash64("text"))
    sketched = durable(_sketched(docs.select("doc_id", "tid", "text"), width, bands, rows), "sketches")
    known = sketched.where("digest is not null and doc_id is not null")
    ids = known.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    repeats = ids.n != ids.ids
    classes = known.groupBy("digest").agg(F.min(F.struct("doc_id", "tid")).alias("stands"), F.first("bins").alias("bins"), F.first("keys").alias("keys"))
    # a class is known by its smallest document; where ids repeat, by a number that stays, since the table is written
    node = F.monotonically_increasing_id() if repeats else F.col("stands.doc_id")
    classes = durable(classes.select(node.alias("node"), "digest", "stands.doc_id", "stands.tid", "bins", "keys"), "classes")
    hot_rows = max(1000, int(sketched.count() * HOT_SHARE))

    # buckets that two members share, and of those with the same members one
    bucketed = classes.select("node", F.explode("keys").alias("key"))
    sums = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum")
    buckets = bucketed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n"), sums).where("first < last")
    buckets = durable(buckets.drop("last"), "buckets")
    members = durable(merge_join(bucketed, buckets.select("key", "n"), "key"), "members")
    # a bucket that is hot has over 1 / 1024 of the rows, and a row is in as many buckets as there are bands
    hot = {r.key: r.first for r in buckets.where(F.col("n") > hot_rows).select("key", "first").collect()}
    chosen = buckets.groupBy("first", "n", "sum").agg(F.min("key").alias("grp")).select("grp")
    in_buckets = members.select("node", F.col("key").alias("grp")).join(chosen, "grp").withColumn("rank", F.lit(0).cast("long"))
    bins = classes.select("node", F.col("bins").alias("payload"))
    ties = _met(in_buckets, bins, ByBins(bins_in_common(percent / 100, bands * rows)), BLOCK_SKETCHES, hot, hot_rows)

    # groups that are tied, and links of full sets
    degree = members.groupBy("node").agg((-F.sum("n")).alias("rank"))
    fine = connected_components(ties).withColumnRenamed("component", "grp")
    fine = durable(fine.join(degree, "node").select("grp", "node", "rank"), "fine")
    forget(buckets, members, ties)
    pivots = fine.groupBy("grp").agg(F.count("*").alias("n"), F.min(F.struct("rank", "node")).alias("least"))
    hot = {r.grp: r.node for r in pivots.where(F.col("n") > hot_rows).select("grp", "least.node").collect()}  # fewer than 1 / HOT_SHARE
    stands = merge_join(classes.select("node", "doc_id", "tid"), fine.select("node"), "node")
    texts = merge_join(docs, stands, ["doc_id", "tid"]).select("node", F.col("text").alias("payload"))
    texts = durable(texts.dropDuplicates(["node"]) if repeats else texts, "texts")
    links = _met(fine, texts, BySets(width, percent), BLOCK_TEXTS, hot, hot_rows)
    forget(fine, texts)

    # what an id's texts are linked with is linked
    if repeats:
        of_id = merge_join(known.select("doc_id", "digest").distinct(), classes.select("digest", "node"), "digest")
        least = of_id.groupBy("doc_id").agg(F.min("node").alias("least"), F.max("node").alias("last")).where("least < last")
        both = merge_join(of_id, least, "doc_id").where("node > least").select(F.col("node").alias("a"), F.col("least").alias("b"))
        whole = durable(links.unionByName(both), "links-of-ids")
        forget(links)
        links = whole
    components = durable(connected_components(links), "components")
    forget(links)
    if repeats:
        components = _named(components, classes, hot_rows)
    of_class = merge_join(classes.select("digest", "node", "doc_id"), components, "node", "left")
    of_class = durable(of_class.select("digest", F.coalesce("component", "doc_id").alias("component_id")), "of-class")
    forget(components, classes)
    alone = sketched.where("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    tied_rows = merge_join(known.drop("keys", "bins"), of_class, "digest").select("doc_id", "n_shingles", "component_id")
    return tied_rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _named(components: DataFrame, classes: DataFrame, hot_rows: int) -> DataFrame:
    """``components`` (node, component), each known by its smallest document instead of a number. The
    name is copied to salts where a component has many members."""
    named = durable(merge_join(components, classes.select("node", "doc_id"), "node"), "named")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    salts = F.explode(F.sequence(F.lit(0), F.when(F.col("n") > hot_rows, SALTS - 1).otherwise(0)))
    smallest = durable(smallest.select("component", "least", salts.alias("salt")), "smallest")
    hot = F.broadcast(smallest.where(F.col("salt") == 1).select("component", F.lit(True).alias("hot")))  # fewer than 1 / HOT_SHARE
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0).cast("int")
    rows = named.join(hot, "component", "left").select("node", "component", salt.alias("salt"))
    out = durable(merge_join(rows, smallest, ["component", "salt"]).select("node", F.col("least").alias("component")), "components")
    forget(components, named, smallest)
    return out


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near duplicates among every whole text of ``documents``: 3-word shingles, 85 per cent."""
    return near_dedup(read_table(spark, sf_dir, "documents"), 3, 85)
