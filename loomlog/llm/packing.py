"""Best-fit packing of documents into training sequences by a grouping genetic algorithm.

Documents become pieces of at most ``capacity`` tokens; only longer documents are cut. Pieces are
dealt at random into islands of a bounded number of pieces, which evolve on their own: an
individual is a list of bins, its fitness the number of bins, then how unevenly they are filled
(full bins are worth keeping). Crossover injects whole well-filled bins of one parent into the
other, drops the bins that hold a piece twice and puts the pieces they leave back by best fit,
largest first. Each island has a few demes, whose elites migrate in a ring between epochs; between
islands the badly filled bins of each elite migrate: their pieces are dealt to the next round's
islands, together with those of all others, until one island is left. A round sends few bins on to
the next, so rounds are few at any size: where more than half of the pieces would migrate again, since no
island can fill its bins to ``keep_fill``, later rounds have half as many islands each and send on the
weakest bin of each island only. So the rounds end without a bound on their number.

Plain best fit decreasing is the first individual. An island whose best fit needs no more bins than its
tokens alone require is finished there; README says how often that is so.

Defined results: a null text counts as empty; an empty text is its end id alone; repeated rows are
packed each; a null document id is kept; an empty table gives an empty table; extra columns are
ignored. The same table gives the same packing.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, read_table, text_of
from .word_bpe import broadcast_file, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(df: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """Encode (doc_id, text), end each document with ``end_id`` and cut it every ``capacity`` ids."""
    file = broadcast_file(df.sparkSession, tokenizer_path)
    names = [x.split()[0] for x in PIECES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = encoder(file), int(end_id).to_bytes(4, "little")
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                packed = tokens.packed(text) + end
                for at in range(0, len(packed), 4 * capacity):
                    ids = packed[at : at + 4 * capacity]
                    out.append((doc, at // (4 * capacity), at // 4, len(ids) // 4, zlib.crc32(ids)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return df.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).mapInArrow(run, PIECES)


class Individual:
    """A packing: bins as lists of pieces, with their loads."""

    __slots__ = ("bins", "loads")

    def __init__(self, bins: list[list[int]], loads: list[int]):
        self.bins, self.loads = bins, loads

    def fitness(self, capacity: int) -> tuple[int, float]:
        """Smaller is better: number of bins, then less of what squares of the fill reward."""
        return len(self.bins), -sum((x / capacity) ** 2 for x in self.loads)


def best_fit(pieces: list[int], size: list[int], capacity: int, bins: list[list[int]], loads: list[int]) -> Individual:
    """Put ``pieces`` in the order given each into the fullest bin with room, or a new one."""
    room = sorted((capacity - load, i) for i, load in enumerate(loads))
    for p in pieces:
        at = bisect_left(room, (size[p], -1))
        if at < len(room):
            free, i = room.pop(at)
            bins[i].append(p)
            loads[i] += size[p]
        else:
            free, i = capacity, len(bins)
            bins.append([p])
            loads.append(size[p])
        if free > size[p]:
            insort(room, (free - size[p], i))
    return Individual(bins, loads)


def crossover(a: Individual, b: Individual, size: list[int], capacity: int, rng: random.Random) -> Individual:
    """Inject well-filled bins of ``b`` into ``a``."""
    by_fill = sorted(range(len(b.bins)), key=b.loads.__getitem__, reverse=True)
    chosen = rng.sample(by_fill[: max(1, len(by_fill) // 2)], max(1, len(by_fill) // 8))
    given = {p for i in chosen for p in b.bins[i]}
    bins, loads = [list(b.bins[i]) for i in chosen], [b.loads[i] for i in chosen]
    homeless: list[int] = []
    for own, load in zip(a.bins, a.loads, strict=True):
        if given.isdisjoint(own):
            bins.append(list(own))
            loads.append(load)
        else:
            homeless += [p for p in own if p not in given]
    homeless.sort(key=size.__getitem__, reverse=True)
    return best_fit(homeless, size, capacity, bins, loads)


def mutate(a: Individual, size: list[int], capacity: int, rng: random.Random) -> Individual:
    """Empty the worst bins and a few others, and put their pieces back in a noisy order."""
    order = sorted(range(len(a.bins)), key=a.loads.__getitem__)
    n = max(2, len(order) // 50)
    out = set(order[:n]) | {rng.randrange(len(order)) for _ in range(n)}
    homeless = [p for i in out for p in a.bins[i]]
    homeless.sort(key=lambda p: size[p] * rng.uniform(0.9, 1.0), reverse=True)
    bins = [list(x) for i, x in enumerate(a.bins) if i not in out]
    return best_fit(homeless, size, capacity, bins, [x for i, x in enumerate(a.loads) if i not in out])


def evolve(size: list[int], capacity: int, seed: int, demes: int = 2, members: int = 3, epochs: int = 3, generations: int = 3) -> Individual:
    """The elite of an island; it stops as soon as no packing can have fewer bins."""
    rng = random.Random(seed)
    least = -(-sum(size) // capacity)
    order = sorted(range(len(size)), key=size.__getitem__, reverse=True)
    elite = best_fit(order, size, capacity, [], [])
    if len(elite.bins) <= least or len(elite.bins) < 3:
        return elite
    rank = lambda x: x.fitness(capacity)
    islands = [[elite] for _ in range(demes)]
    for deme in islands:
        while len(deme) < members:
            noisy = sorted(order, key=lambda p: size[p] * rng.uniform(0.8, 1.0), reverse=True)
            deme.append(best_fit(noisy, size, capacity, [], []))
    for _ in range(epochs):
        for deme in islands:
            for _ in range(generations):
                a, b = rng.sample(deme, 2)
                child = mutate(crossover(a, b, size, capacity, rng), size, capacity, rng)
                deme.append(child)
                deme.sort(key=rank)
                del deme[members:]
                if len(deme[0].bins) <= least:
                    return deme[0]
        best = [deme[0] for deme in islands]
        for i, deme in enumerate(islands):  # the ring
            deme[-1] = best[i - 1]
    return min((deme[0] for deme in islands), key=rank)


def _island_round(pieces: DataFrame, capacity: int, n_islands: int, number: int, final: bool, keep_fill: float) -> DataFrame:
    """One round: ``sequence_id`` is null for the pieces that migrate."""
    schema = PIECES + ", sequence_id long, offset long"

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        island = table.column("island")[0].as_py()
        # an order that doesn't depend on how the rows arrived
        table = table.sort_by([(n, "ascending") for n in ("length", "ids_crc32", "doc_id", "piece")])
        size = table.column("length").to_pylist()
        best = evolve(size, capacity, seed=island)
        stay = [True] * len(best.bins)
        if not final:
            weakest = min(range(len(best.bins)), key=best.loads.__getitem__)
            stay = [load >= keep_fill * capacity and i != weakest for i, load in enumerate(best.loads)]
        sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        migrates = np.zeros(len(size), bool)
        for i, members in enumerate(best.bins):
            at = 0
            for p in members:
                sequence[p], offset[p], migrates[p] = (number << 58) | (island << 24) | i, at, not stay[i]
                at += size[p]
        out = table.drop_columns(["island"])
        return out.append_column("sequence_id", pa.array(sequence, mask=migrates)).append_column("offset", pa.array(offset, mask=migrates))

    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id(), F.lit(number)), F.lit(n_islands))
    return pieces.withColumn("island", spread).groupBy("island").applyInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = 2048, island_pieces: int = 4096, keep_fill: float = 0.995) -> DataFrame:
    """Pack ``pieces`` (see :func:`cut_pieces`); adds ``sequence_id`` and a gapless ``offset``.

    ``island_pieces`` is the number of pieces an island gets on average, which bounds its task
    (a bin has no more pieces than tokens, so two bins an island are within the bound, too); bins filled
    to less than ``keep_fill`` migrate.
    """
    done: list[DataFrame] = []
    n, number, islands = pieces.count(), 0, 0
    while True:
        needed = max(1, -(-n // island_pieces))
        islands = needed if keep_fill else min(needed, max(1, islands // 2))
        out = durable(_island_round(pieces, capacity, islands, number, islands == 1, keep_fill), f"packing-{number}")
        done.append(out.where("sequence_id is not null"))
        if islands == 1:
            break
        pieces = out.where("sequence_id is null").drop("sequence_id", "offset")
        before, n, number = n, pieces.count(), number + 1
        if n == 0:
            break
        if n > 0.5 * before:  # no island could fill its bins
            keep_fill = 0.0
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    return pack(durable(cut_pieces(docs, tokenizer_path, end_id, capacity), "pieces"), capacity)


def op9_packing(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Pack every whole text of ``documents`` into sequences of at most 2048 tokens."""
    import public_tokenizers

    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    return pack_documents(read_table(spark, sf_dir, "documents"), path)
