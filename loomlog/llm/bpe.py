"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

**Encoding.** A token sequence is the BPE encoding of its bytes exactly if each pair of neighbours
is: merging the bytes of ``t1 t2`` alone must give ``[t1, t2]`` again. So BPE is a
non-deterministic transducer: reading a byte walks down the trie of the vocabulary's bytes, and a
node that ends a token may return to the root if the token may follow the one before. It is
determinised lazily: the set of live trie nodes is given by the longest of their paths, the state,
whose arcs and ends are made when first met. A register for each live border holds the one token
that may end there (each prefix has one encoding), and what all live borders have behind them in
common is emitted: lookahead is bounded by the longest token. Pieces within the lookahead bound, nearly
all, run in lockstep: arcs, ends and the pairs of neighbours are integer tables, and all new pieces
of a group of texts go one byte ahead at a time. Their ids are kept for the next time.

**Decoding.** An incremental UTF-8 machine whose state is the unfinished sequence (three bytes at
most); its arcs are made per (state, token) when first met. Malformed bytes become U+FFFD, as the
"replace" rule of UTF-8 decoders has it.

Defined results: a null text counts as empty and gives no ids; empty texts give an empty list;
very long texts pass through in one row with O(ids) memory; repeated rows are encoded each; an
empty table gives an empty table; extra columns are kept, those named like an output are replaced.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

#: Rank files are at most this large; they go to the executors as a broadcast variable.
MAX_VOCABULARY_BYTES = 64 << 20


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 30) -> list[int]:
    """Plain BPE with the ranks below a bound: the neighbouring pair of lowest rank merges first,
    the leftmost on a tie."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and rank < below and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class IntTable:
    """A hash table of 64-bit keys and 32-bit values that is asked for many keys at once."""

    def __init__(self, room: int = 1 << 12):
        self.clear(room)

    def clear(self, room: int = 1 << 12) -> None:
        self.keys, self.values, self.n = np.full(room, -1, np.int64), np.zeros(room, np.int32), 0

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        shift = np.uint64(65 - len(self.keys).bit_length())
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where a key is unknown."""
        at, out = self._slots(keys), np.full(len(keys), -1, np.int32)
        found = self.keys[at]
        hit = found == keys
        out[hit] = self.values[at[hit]]
        todo = np.flatnonzero(~hit & (found != -1))
        at = at[todo]
        while len(todo):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (found != -1)
            todo, at = todo[on], at[on]
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Add keys, all different and none of them known."""
        self.n += len(keys)
        if 2 * self.n > len(self.keys):
            old = self.keys >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self.clear(1 << (4 * self.n - 1).bit_length())
            self.n = len(keys)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]  # of keys that want one place, the last gets it
            placed = self.keys[at] == keys
            self.values[at[placed]] = values[placed]
            keys, values, at = keys[~placed], values[~placed], (at[~placed] + 1) & (len(self.keys) - 1)


class Growing:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def extend(self, more) -> None:
        end = self.n + len(more)
        if end > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(2 * end - self.n, self.data.dtype)])
        self.data[self.n : end] = more
        self.n = end


class MergeTransducer:
    """The transducer of one vocabulary. ``max_pieces`` and ``max_pairs`` bound its tables, which
    start anew when they are full; its states are at most the nodes of the vocabulary's trie."""

    #: Pieces up to this many bytes run in lockstep and wait undecided to their end; longer ones stream.
    LOOKAHEAD = 64

    def __init__(self, ranks: dict[bytes, int], max_pieces: int = 400_000, max_pairs: int = 1_000_000):
        self.ranks, self.max_pieces, self.max_pairs = ranks, max_pieces, max_pairs
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.length_of = np.zeros(max(self.bytes_of, default=0) + 1, np.int32)
        self.child: dict[int, int] = {}
        self.token, self.above, self.depth = [-1], [0], [0]  # of trie nodes; above: parent << 8 | byte
        for piece, rank in ranks.items():
            self.length_of[rank] = len(piece)
            node = 0
            for byte in piece:
                key = node << 8 | byte
                if (following := self.child.get(key)) is None:
                    following = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.above.append(key)
                    self.depth.append(self.depth[node] + 1)
                node = following
            self.token[node] = rank
        self.arcs: dict[int, int] = {}
        self.shorter: dict[int, int] = {0: 0}
        self.ends: dict[int, tuple[tuple[int, int], ...]] = {0: ()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.follows: dict[int, bool] = {}
        # the same for many pieces at once: arcs, where a state's ends lie, which pairs hold
        self.arc_table, self.pair_table = IntTable(), IntTable()
        self.first_end = np.full(len(self.token), -1, np.int32)
        self.end_tokens = Growing(np.int32)
        self._forget_pieces()

    def _forget_pieces(self) -> None:
        self.pieces: dict[str, int] = {}
        self.piece_ids, self.piece_start, self.piece_count = Growing(np.int32), Growing(np.int64), Growing(np.int32)

    # the deterministic walk: a state is the longest suffix of the input that begins a token

    def _suffix(self, node: int) -> int:
        """The longest proper suffix of a trie path that is one, too."""
        found = self.shorter.get(node)
        if found is None:
            parent, byte = self.above[node] >> 8, self.above[node] & 255
            found = self.shorter[node] = self._arc(self._suffix(parent), byte) if parent else 0
        return found

    def _arc(self, state: int, byte: int) -> int:
        key = state << 8 | byte
        found = self.arcs.get(key)
        if found is None:
            found = self.child.get(key)
            if found is None:
                found = self._arc(self._suffix(state), byte) if state else 0
            self.arcs[key] = found
            if found not in self.ends:
                self._make_ends(found)
        return found

    def _make_ends(self, state: int) -> tuple[tuple[int, int], ...]:
        """The tokens that may end here, longest first, with their lengths."""
        found = self.ends.get(state)
        if found is None:
            token, rest = self.token[state], self._make_ends(self._suffix(state))
            own = ((token, self.depth[state]),) if token >= 0 and self._may_follow(-1, token) else ()
            found = self.ends[state] = own + rest
        return found

    # which token may follow which

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``; a token that no merge makes is its own halves."""
        found = self.parts.get(token)
        if found is None:
            data = self.bytes_of[token]
            found = (token, token)
            if len(data) > 1:
                pair = merge_by_rank(data, self.ranks, below=token)
                if len(pair) == 2:
                    found = (pair[0], pair[1])
            self.parts[token] = found
        return found

    def _may_follow(self, last: int, token: int) -> bool:
        """Whether merging the bytes of both tokens gives both back; a token alone must be made by
        merges at all (``last`` is -1)."""
        if last < 0:
            return len(self.bytes_of[token]) == 1 or self._halves(token)[0] != token
        found = self._border_holds(last, token)
        if len(self.follows) > self.max_pairs:
            self.follows.clear()
        self.follows[last << 24 | token] = found
        return found

    def _border_holds(self, left: int, right: int) -> bool:
        """Undo the merges beside the border, the latest first; no pair across it may merge before
        the one undone."""
        bytes_of, ranks = self.bytes_of, self.ranks
        undone = 1 << 30
        while True:
            across = ranks.get(bytes_of[left] + bytes_of[right])
            if across is not None and across < undone and self._halves(across) == (left, right):
                return False
            left_single, right_single = len(bytes_of[left]) == 1, len(bytes_of[right]) == 1
            if left_single and right_single:
                return True
            # on a tie of ranks the left one merges first, so the right one is undone first
            if right_single or (not left_single and left > right):
                undone, left = left, self._halves(left)[1]
            else:
                undone, right = right + 1, self._halves(right)[0]

    def stream(self, chunks: Iterable[bytes], lookahead: int = 512) -> Iterator[int]:
        """Tokens of one piece that comes in chunks; at most about ``lookahead`` bytes, and those
        a token under way can still reach, wait undecided."""
        arcs, ends, follows, bytes_of = self.arcs, self.ends, self.follows, self.bytes_of
        state, last = 0, [-1]  # last[i]: the token that ends after i of the bytes that wait
        for chunk in chunks:
            for byte in chunk:
                state = arcs.get(state << 8 | byte) or self._arc(state, byte)
                at = len(last)
                for token, length in ends[state]:
                    before = last[at - length]
                    may = before < 0 or follows.get(before << 24 | token)
                    if may or may is None and self._may_follow(before, token):
                        last.append(token)
                        break
                if at >= lookahead + self.depth[state] and at % lookahead == 0:
                    settled = self._common(last, self.depth[state])
                    yield from self._spelled(last, settled)
                    del last[:settled]
        yield from self._spelled(last, len(last) - 1)

    # many short pieces in lockstep

    def _step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The arcs of many states; those met for the first time are made."""
        key = state.astype(np.int64) << 8 | byte
        found = self.arc_table.get(key)
        if len(new := np.unique(key[found < 0])):
            made = np.array([self._arc(k >> 8, k & 255) for k in new.tolist()], np.int32)
            self.arc_table.put(new, made)
            for reached in np.unique(made[self.first_end[made] < 0]).tolist():
                self.first_end[reached] = self.end_tokens.n
                self.end_tokens.extend([token for token, _ in self._make_ends(reached)])
            missing = found < 0
            found[missing] = made[np.searchsorted(new, key[missing])]
        return found

    def _hold(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Which pairs hold; those met for the first time are looked into."""
        key = before.astype(np.int64) << 24 | token
        found = self.pair_table.get(key)
        if len(new := np.unique(key[found < 0])):
            if self.pair_table.n > self.max_pairs:
                self.pair_table.clear()
            made = np.array([self._border_holds(k >> 24, k & 0xFFFFFF) for k in new.tolist()], np.int32)
            self.pair_table.put(new[self.pair_table.get(new) < 0], made[self.pair_table.get(new) < 0])
            missing = found < 0
            found[missing] = made[np.searchsorted(new, key[missing])]
        return found > 0

    def _lockstep(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """:meth:`stream` for many pieces, a byte of each at a time: all ids, and how many each has."""
        given = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-given, kind="stable")
        size, start = given[order], (np.cumsum(given) - given)[order]
        data = np.frombuffer(b"".join(pieces), np.uint8)
        last = np.full((int(size[0]) + 1, len(pieces)), -1, np.int32)
        state = np.zeros(len(pieces), np.int32)
        for at in range(int(size[0])):
            live = int(np.searchsorted(-size, -at))  # the pieces longer than ``at``
            state = self._step(state[:live], data[start[:live] + at])
            rows, end = np.arange(live), self.first_end[state].astype(np.int64)
            while len(rows):
                token = self.end_tokens.data[end]
                before = last[at + 1 - self.length_of[token], rows]
                holds = before < 0
                if len(inner := np.flatnonzero(~holds)):
                    holds[inner] = self._hold(before[inner], token[inner])
                last[at + 1, rows[holds]] = token[holds]
                rows, end = rows[~holds], end[~holds] + 1
        # spelled from their ends
        rows, steps = np.arange(len(pieces)), []
        count = np.zeros(len(pieces), np.int32)
        while len(rows):
            token = last[size[rows], rows]
            steps.append((rows, token))
            count[rows] += 1
            size[rows] -= self.length_of[token]
            rows = rows[size[rows] > 0]
        counts = np.empty_like(count)
        counts[order] = count
        ends = np.cumsum(counts, dtype=np.int64)[order]
        ids = np.empty(int(counts.sum()), np.int32)
        for back, (rows, token) in enumerate(steps):
            ids[ends[rows] - 1 - back] = token
        return ids, counts

    def _common(self, last: list[int], depth: int) -> int:
        """The last border that every live hypothesis passes."""
        at = len(last) - 1
        borders = set(range(at - depth, at + 1))
        while len(borders) > 1:
            top = max(borders)
            borders.remove(top)
            borders.add(top - len(self.bytes_of[last[top]]))
        return borders.pop()

    def _spelled(self, last: list[int], at: int) -> list[int]:
        out = []
        while at > 0:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return out[::-1]

    def _learn(self, pieces: list[str]) -> None:
        """Encode pieces met for the first time."""
        data = [p.encode() for p in pieces]
        known = [(self.ranks[d],) if d in self.ranks else tuple(self.stream((d,))) if len(d) > self.LOOKAHEAD else None for d in data]
        short = [d for d, ids in zip(data, known, strict=True) if ids is None]
        for at in range(0, len(short), 1 << 13):
            block = short[at : at + (1 << 13)]
            ids, counts = self._lockstep(block)
            starts = self.piece_ids.n + np.cumsum(counts, dtype=np.int64) - counts
            self.piece_ids.extend(ids)
            self.piece_start.extend(starts)
            self.piece_count.extend(counts)
        slots = iter(range(len(self.pieces), len(self.pieces) + len(short)))
        self.pieces.update((p, next(slots)) for p, ids in zip(pieces, known, strict=True) if ids is None)
        whole = [(p, ids) for p, ids in zip(pieces, known, strict=True) if ids is not None]
        counts = np.fromiter((len(ids) for _, ids in whole), np.int32, len(whole))
        self.piece_start.extend(self.piece_ids.n + np.cumsum(counts, dtype=np.int64) - counts)
        self.piece_count.extend(counts)
        self.piece_ids.extend(np.fromiter(chain.from_iterable(ids for _, ids in whole), np.int32, int(counts.sum())))
        n = len(self.pieces)
        self.pieces.update((p, n + i) for i, (p, _) in enumerate(whole))

    def encode_all(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of many pieces, and how many each has."""
        slots = np.fromiter(map(self.pieces.get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(missing := np.flatnonzero(slots < 0)):
            new = list(dict.fromkeys(pieces[i] for i in missing.tolist()))
            if len(self.pieces) + len(new) > self.max_pieces:
                self._forget_pieces()
                new, missing = list(dict.fromkeys(pieces)), np.arange(len(pieces))
            self._learn(new)
            slots[missing] = [self.pieces[pieces[i]] for i in missing.tolist()]
        counts = self.piece_count.data[slots]
        shift = self.piece_start.data[slots] - (np.cumsum(counts, dtype=np.int64) - counts)
        return self.piece_ids.data[np.repeat(shift, counts) + np.arange(int(counts.sum()))], counts

    def encode(self, pieces: list[str]) -> list[int]:
        return self.encode_all(pieces)[0].tolist()


class Utf8Machine:
    """Incremental UTF-8 decoding of token ids; the state is the unfinished byte sequence."""

    #: Bytes that the machine takes at once where there are many.
    CHUNK = 1 << 16

    def __init__(self, bytes_of: dict[int, bytes], max_arcs: int = 200_000):
        self.bytes_of, self.max_arcs = bytes_of, max_arcs
        self.arcs: dict[tuple[bytes, int], tuple[bytes, str]] = {}
        # the bytes of all tokens in a row
        self.size = np.zeros(max(bytes_of, default=0) + 1, np.int64)
        self.size[list(bytes_of)] = [len(x) for x in bytes_of.values()]
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(bytes_of[i] for i in sorted(bytes_of)), np.uint8)

    @staticmethod
    def advance(pending: bytes, data: bytes) -> tuple[bytes, str]:
        """Read ``data`` in the state ``pending``: the new state and the characters now complete."""
        data = pending + data
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 == 0x80:
                continue  # a continuation byte: the lead byte is further back
            need = 4 if byte >> 3 == 0b11110 else 3 if byte >> 4 == 0b1110 else 2 if byte >> 5 == 0b110 else 1
            if need > back:
                head, tail = data[:-back], data[-back:]
                if _may_go_on(tail):
                    return tail, head.decode("utf-8", "replace")
            break
        return b"", data.decode("utf-8", "replace")

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        pending, arcs = b"", self.arcs
        for token in ids:
            arc = arcs.get((pending, token))
            if arc is None:
                if len(arcs) > self.max_arcs:
                    arcs.clear()
                arc = arcs[pending, token] = self.advance(pending, self.bytes_of[token])
            pending, text = arc
            yield text
        if pending:
            yield pending.decode("utf-8", "replace")

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ``counts`` ids each, one after the other in ``ids``."""
        size = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        shift = self.start[ids] - ends[:-1]
        data = self.data[np.repeat(shift, size) + np.arange(int(ends[-1]))].tobytes()
        borders, out = ends[np.concatenate([[0], np.cumsum(counts)])].tolist(), []
        for low, high in zip(borders, borders[1:]):
            pending, parts = b"", []
            for at in range(low, high, self.CHUNK):
                pending, text = self.advance(pending, data[at : min(at + self.CHUNK, high)])
                parts.append(text)
            out.append("".join(parts) + pending.decode("utf-8", "replace"))
        return out

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([len(ids)]))[0]


def _may_go_on(tail: bytes) -> bool:
    """Whether an unfinished sequence can still become a character (no overlong forms, surrogates
    or code points above U+10FFFF)."""
    if tail[0] in (0xC0, 0xC1) or tail[0] > 0xF4:
        return False
    if len(tail) == 1:
        return True
    low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(tail[0], (0x80, 0xBF))
    return low <= tail[1] <= high


_MACHINES: dict = {}


def _machine(kind: str, ranks) -> MergeTransducer | Utf8Machine:
    """One machine for each Python worker and vocabulary."""
    key = (kind, ranks.value["name"])
    if key not in _MACHINES:
        table = parse_ranks(ranks.value["data"])
        _MACHINES[key] = MergeTransducer(table) if kind == "encode" else Utf8Machine({i: b for b, i in table.items()})
    return _MACHINES[key]


def _broadcast_ranks(df: DataFrame, ranks_path: str):
    ship_package(df.sparkSession)
    with open(ranks_path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{ranks_path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return df.sparkSession.sparkContext.broadcast({"name": f"{ranks_path}:{len(data)}:{hash(data)}", "data": data})


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*(f for f in schema.fields if f.name != name), T.StructField(name, kind)])


#: Characters of the texts that are encoded together, at least; a longer text is one group.
GROUP_CHARS = 1 << 20


def _groups(texts: list[str | None]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        group.append(text or "")
        size += len(group[-1])
        if size >= GROUP_CHARS:
            yield group
            group, size = [], 0
    if group:
        yield group


def _encoded(machine: MergeTransducer, split, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of ``texts``, and how many each has."""
    pieces, n_pieces = [], []
    for text in texts:
        found = split(text)
        n_pieces.append(len(found))
        pieces += found
    ids, counts = machine.encode_all(pieces)
    ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])[np.concatenate([[0], np.cumsum(n_pieces)])]
    return ids, np.diff(ends)


def _lists(ids: list[np.ndarray], counts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([*counts, np.zeros(0, np.int64)]))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))


def bpe_encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", out_col: str | None = None) -> DataFrame:
    """Add ``ids_col``: the BPE ids of ``text_col``, each match of ``pattern`` encoded separately.

    With ``out_col`` the ids are decoded again in the same pass, which saves a trip of the data.
    """
    ranks = _broadcast_ranks(df, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, split = _machine("encode", ranks), regex.compile(pattern).findall
        for batch in batches:
            found = [_encoded(machine, split, group) for group in _groups(batch.column(text_col).to_pylist())]
            out = _replaced(batch, ids_col, _lists(*map(list, zip(*found, strict=True))) if found else _lists([], []))
            if out_col:
                decode = _machine("decode", ranks).decode_all
                out = _replaced(out, out_col, pa.array(chain.from_iterable(decode(*x) for x in found), pa.string()))
            yield out

    schema = _with(df.schema, ids_col, T.ArrayType(T.IntegerType()))
    return df.mapInArrow(run, _with(schema, out_col, T.StringType()) if out_col else schema)


def bpe_decode(df: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col``: the text that ``ids_col`` spells. A null list counts as empty."""
    ranks = _broadcast_ranks(df, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine("decode", ranks)
        for batch in batches:
            lists = batch.column(ids_col)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            texts = machine.decode_all(pc.list_flatten(lists).to_numpy(), counts)
            yield _replaced(batch, out_col, pa.array(texts, pa.string()))

    return df.mapInArrow(run, _with(df.schema, out_col, T.StringType()))


def _replaced(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    kept = [i for i, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), column], [*(batch.schema.names[i] for i in kept), name])


def op1_bpe_roundtrip(spark, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    """Encode and decode every whole text of ``documents``; digests of ids and decoded bytes."""
    import public_tokenizers

    from .common import read_table, text_of

    path = ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = read_table(spark, sf_dir, "documents").select("doc_id", text_of("text").alias("text"))
    out = bpe_encode(docs, path, public_tokenizers.PATTERN, out_col="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
