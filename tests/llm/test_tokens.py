import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from loomlog.llm import bpe, packing, token_files
from loomlog.llm.word_bpe import ChunkEncoder

RANKS = bpe.parse_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
ORACLE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SPLIT = regex.compile(P.PATTERN).findall
WORDS = P.path("word_bpe_49k.json")


def mixed_texts(n, seed=1):
    rng = random.Random(seed)
    letters = "abcXYZ  \n\t'é漢\U0001f6000123ññ́.,!?-_#<|>\xa0 \x85\x1cΣİKſ̸"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_encoding_equals_the_library_and_decoding_inverts_it():
    machine = bpe.MergeTransducer(RANKS)
    decoder = bpe.Utf8Machine(machine.bytes_of)
    for text in [*mixed_texts(1500), "a" * 5000, " " * 3000, "=-" * 700, "", "it's we'll don't", "<|endoftext|>"]:
        ids = machine.encode(SPLIT(text))
        assert ids == ORACLE.encode_ordinary(text)
        assert decoder.decode(ids) == text


def test_streams_emit_before_the_end_and_bounded_tables_change_nothing():
    machine = bpe.MergeTransducer(RANKS, max_pieces=2, max_pairs=3)
    data = ("thetionaler" * 600).encode()
    read = 0

    def chunks():
        nonlocal read
        for i in range(0, len(data), 50):
            read += 1
            yield data[i : i + 50]

    stream = machine.stream(chunks())
    first = next(stream)
    assert read < len(data) // 50 and machine.bytes_of[first] == data[: len(machine.bytes_of[first])]
    assert [first, *stream] == bpe.merge_by_rank(data, RANKS)


def test_decoder_follows_the_replace_rule_on_any_ids():
    machine = bpe.Utf8Machine({i: b for b, i in RANKS.items()})
    rng = random.Random(5)
    for _ in range(1500):
        ids = [rng.randrange(50256) for _ in range(7)]
        assert machine.decode(ids) == b"".join(machine.bytes_of[i] for i in ids).decode("utf-8", "replace")


def test_op1_edge_rows(hard_docs, hard_rows, no_docs):
    path = P.path("byte_bpe_50k.tiktoken")
    rows = bpe.bpe_decode(bpe.bpe_encode(hard_docs, path, P.PATTERN), path).select("doc_id", "ids", "decoded", "kept").collect()
    assert len(rows) == len(hard_rows) and {r.kept for r in rows} == {2.5}
    want = sorted((d or 0, ORACLE.encode_ordinary(t or ""), t or "") for d, t in hard_rows)
    assert sorted((r.doc_id or 0, r.ids, r.decoded) for r in rows) == want
    assert bpe.bpe_encode(no_docs, path, P.PATTERN).count() == 0


def test_chunk_encoder_equals_the_library():
    encoder = ChunkEncoder(open(WORDS, "rb").read(), max_chunks=50)
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    for text in [*mixed_texts(1500, 2), "<|endoftext|> a<|startoftext|>", "it's don't. 'S 'LL", "WORD!! a*** b,%%%"]:
        assert np.frombuffer(encoder.packed(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def library_ids(text, end):
    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op6_round_trip_and_random_access(hard_docs, hard_rows, no_docs, tmp_path):
    manifest = token_files.write_token_files(hard_docs, WORDS, 2, f"file://{tmp_path}", length=64, rows=4)
    out = token_files.read_token_files(manifest).collect()
    order = sorted(hard_rows, key=lambda r: (r[0] is not None, r[0] or 0))  # one id repeats, with one text
    start, want = 0, []
    for doc, text in order:
        ids = library_ids(text, 2)
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == want
    every = []
    for part in sorted(manifest.collect(), key=lambda r: r.part):
        reader = token_files.SequenceReader(part.path)
        assert len(reader) == part.n_sequences
        for i in range(len(reader)):
            s = reader.sequence(i)
            mask, ends = token_files.unpacked(s["mask"]), token_files.unpacked(s["ends"])
            assert len(s["ids"]) == len(mask) == len(ends) == 64 and s["ids"].dtype == np.uint16
            assert not any(x.flags.owndata or x.flags.writeable for x in s.values())  # views of the map
            assert (s["ids"][ends] == 2).all()
            every += s["ids"][mask].tolist()
    assert every == [i for _, t in order for i in library_ids(t, 2)]
    assert token_files.read_token_files(token_files.write_token_files(no_docs, WORDS, 2, f"file://{tmp_path}/none")).count() == 0


def test_op6_repeated_and_null_ids_spread(spark, tmp_path):
    rows = [(None if i % 2 else 3, f"text number {i}") for i in range(400)]
    manifest = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, 2, f"file://{tmp_path}", length=64)
    assert manifest.count() == 4 and max(r.n_docs for r in manifest.collect()) <= 200
    out = sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == [None] * 200 + [3] * 200
    with pytest.raises(ValueError):
        token_files.SequenceWriter(None, 63, 4, True)


def test_op6_uncommitted_files_are_not_read(hard_docs, tmp_path):
    manifest = token_files.write_token_files(hard_docs, WORDS, 2, f"file://{tmp_path}", length=64)
    before = sorted(map(tuple, token_files.read_token_files(manifest).collect()), key=str)
    (tmp_path / "part-000000-lost.arrow").write_bytes(b"half a file")
    assert sorted(map(tuple, token_files.read_token_files(manifest).collect()), key=str) == before
    assert len(os.listdir(tmp_path)) > manifest.count()


def check_packing(rows, hard_rows, capacity):
    pieces = {}
    for doc, text in hard_rows:
        ids = library_ids(text, 0)
        for k in range(0, len(ids), capacity):
            key = (doc, k // capacity, k, len(ids[k : k + capacity]), crc(ids[k : k + capacity]))
            pieces[key] = pieces.get(key, 0) + 1
    got = {}
    bins = {}
    for r in rows:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == pieces
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("island_pieces", [4096, 4])
def test_op9_packs_every_piece_once(hard_docs, hard_rows, island_pieces):
    pieces = packing.cut_pieces(hard_docs, WORDS, 0, 256)
    out = packing.pack(pieces, 256, island_pieces).collect()
    n = check_packing(out, hard_rows, 256)
    assert n <= -(-sum(r.length for r in out) // 256) + 3


def test_op9_ends_where_no_island_can_fill_a_bin(spark):
    """Every island fits into one bin, so all pieces migrate in each round."""
    rows = [(i, 0, 0, 1 + i % 3, i) for i in range(60)]
    out = packing.pack(spark.createDataFrame(rows, packing.PIECES), 256, 4).collect()
    assert len(out) == 60 and len({r.sequence_id for r in out}) == 1


def test_op9_empty_and_genetic_search(no_docs):
    assert packing.pack_documents(no_docs, WORDS).count() == 0
    rng = random.Random(3)
    size = [rng.randint(201, 420) for _ in range(400)]
    order = sorted(range(400), key=size.__getitem__, reverse=True)
    plain = packing.best_fit(order, size, 1000, [], [])
    best = packing.evolve(size, 1000, seed=1)
    assert sorted(p for b in best.bins for p in b) == list(range(400))
    assert all(sum(size[p] for p in b) == load <= 1000 for b, load in zip(best.bins, best.loads, strict=True))
    assert len(best.bins) < len(plain.bins)  # the search gains here
    child = packing.crossover(plain, best, size, 1000, rng)
    assert sorted(p for b in child.bins for p in b) == list(range(400))


def test_op1_query_digests(spark, sf_dir):
    rows = bpe.op1_bpe_roundtrip(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        ids = ORACLE.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
