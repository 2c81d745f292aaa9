import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomlog.llm import exact_dedup as X
from loomlog.llm import minhash as M
from loomlog.llm import substring_dedup as S
from loomlog.llm.components import connected_components
from loomlog.llm.word_hash import WordHasher


@given(st.binary(max_size=300), st.binary(max_size=300))
@settings(max_examples=60, deadline=None)
def test_prints_of_parts_make_the_print_of_the_whole(a, b):
    whole = X.combine(X.chunk_print(a), X.chunk_print(b), len(b))
    assert whole == X.chunk_print(a + b) == int.from_bytes(X.fingerprint(a + b), "big")


def test_chunk_rows_combine_over_tasks(spark):
    text = "ab c\nd" * 50_000
    rows = [(7, i, text[k : k + 40_000]) for i, k in enumerate(range(0, len(text), 40_000))] + [(8, 0, None), (9, 0, "x")]
    out = X.fingerprint_chunks(spark.createDataFrame(rows, "doc_id long, chunk_no long, chunk string").repartition(4)).collect()
    got = {r.doc_id: (bytes(r.fingerprint), r.n_bytes) for r in out}
    assert got[7] == (X.fingerprint(X.normalised(text)), len(X.normalised(text))) and got[8][1] == 0 and got[9][1] == 1


def brute_exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(X.normalised(t), []).append((d, t or ""))
    out = []
    for key, members in groups.items():
        known = [m for m in members if m[0] is not None] or members
        keep = min(known, key=lambda m: (-len(m[1]), m[0]))[0]
        out += [(d, keep, len(members), hashlib.sha256(key).hexdigest()) for d, _ in members]
    return out


def test_op8_edge_rows(hard_docs, hard_rows, no_docs):
    rows = X.exact_dedup(hard_docs).collect()
    assert sorted((tuple(r[k] for k in ("doc_id", "keep_id", "group_size", "text_sha256")) for r in rows), key=str) == sorted(brute_exact(hard_rows), key=str)
    assert sum(r.kept for r in rows) == len({X.normalised(t) for _, t in hard_rows})
    assert X.exact_dedup(no_docs).count() == 0


def test_op8_hot_groups_are_salted_and_whole(spark, monkeypatch):
    monkeypatch.setattr(X, "HOT_SHARE", 1e-9)
    rows = [(i, "same text" if i % 3 else f"other {i}") for i in range(3000)]
    out = X.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same = [r for r in out if r.group_size > 1]
    assert len(same) == 2000 and {r.keep_id for r in same} == {1} and sum(r.kept for r in out) == 1001


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7])
def test_op8_hot_groups_without_ids_or_with_one(spark, monkeypatch, ids):
    """Rows are dealt by their place, so that one id, or none, doesn't hold a group together."""
    monkeypatch.setattr(X, "HOT_SHARE", 1e-9)
    rows = [(ids(i), "same text" if i % 3 else f"other {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    dealt = X._dealt(X._documents(df)).where("reference = 0").groupBy("fingerprint", "salt").count()
    assert dealt.agg({"count": "max"}).first()[0] < 100
    out = X.exact_dedup(df).collect()
    assert len(out) == 3000 and sum(r.kept for r in out) == 1001 and sorted({r.group_size for r in out}) == [1, 2000]
    assert X.drop_exact_copies(df).count() == 1001


def test_op8_huge_texts_are_hashed_by_chunks(spark, monkeypatch, hard_docs, hard_rows):
    monkeypatch.setattr(X, "HUGE", 100)
    monkeypatch.setattr(X, "CHUNK_CHARS", 64)
    rows = X.exact_dedup(hard_docs).collect()
    assert sorted((tuple(r[k] for k in ("doc_id", "keep_id", "group_size", "text_sha256")) for r in rows), key=str) == sorted(brute_exact(hard_rows), key=str)
    assert X.drop_exact_copies(hard_docs).count() == len({X.normalised(t) for _, t in hard_rows})


def test_op8_equal_prints_are_compared(spark, monkeypatch):
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "bb"), (5, "c")]
    monkeypatch.setattr(X, "MODULUS", 1)  # every print is 0
    import loomlog.llm.exact_dedup as module

    def forced(data):
        return b"\0" * 16

    monkeypatch.setattr(module, "fingerprint", forced)
    out = X.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in out} in ({1: (1, 2), 2: (2, 2), 3: (1, 2), 4: (2, 2), 5: (5, 1)}, {d: (k, n) for d, k, n, _ in brute_exact(rows)})


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute_near(rows, width, percent):
    sets = {d: shingles(t, width) for d, t in rows if d is not None}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_op4_edge_rows(hard_docs, hard_rows, no_docs):
    want = brute_near(hard_rows, 3, 85)
    rows = M.near_dedup(hard_docs, 3, 85).collect()
    assert len(rows) == len(hard_rows)
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert M.near_dedup(no_docs, 3, 85).count() == 0


def chained(n, seed, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    rows = [(seed * 1000, " ".join(base))]
    for i in range(1, n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((seed * 1000 + i, " ".join(words)))
    return rows


def test_op4_groups_whose_members_differ_more_than_the_base(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_SHINGLES", 2000)  # several blocks
    monkeypatch.setattr(M, "BLOCK_SKETCHES", 16)
    monkeypatch.setattr(M, "HOT_SHARE", 1e-9)
    rows = [r for seed in range(1, 5) for r in chained(60, seed, 6)]
    want = brute_near(rows, 3, 85)
    out = M.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want


def test_op4_texts_that_share_an_id_are_all_compared(spark):
    """In any order of rows: id 5 has two texts, each with a near copy of its own."""
    rng = random.Random(12)
    a, b = ([f"{x}{rng.randrange(10**6)}" for _ in range(90)] for x in "ab")
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*a, "end"])), (8, " ".join([*b, "end"])), (9, "alone in this table"), (8, " ".join([*b, "end"]))]
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        out = M.near_dedup(spark.createDataFrame(order, "doc_id long, text string").repartition(2), 3, 85).collect()
        assert len(out) == len(rows) and {(r.doc_id, r.component_id, r.kept) for r in out} == {(5, 5, True), (7, 5, False), (8, 5, False), (9, 9, True)}


def test_op4_a_shared_passage_puts_unlike_texts_into_buckets_only(spark):
    """Half of each text is common, so many share buckets; the sketches part them again."""
    rng = random.Random(13)
    common = [f"c{i}" for i in range(80)]
    rows = [(i, " ".join([*common, *(f"w{rng.randrange(10**6)}" for _ in range(60))])) for i in range(150)]
    rows += [(1000 + i, rows[i][1].replace("w", "v", 1)) for i in range(20)]
    want = brute_near(rows, 3, 85)
    out = M.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want


def test_sketches_fill_and_estimate(spark):
    hasher, sketcher = WordHasher(), M.Sketcher(180)
    rng = random.Random(2)
    for n in (1, 2, 5, 40, 700):
        a = [f"a{i}" for i in range(n + 2)]
        s = sketcher.sketch(M.shingle_set(" ".join(a), 3, hasher))
        assert len(set(s.tolist())) > 0 and s.max() < (1 << 64) - 1
    words = [f"x{rng.random()}" for _ in range(600)]
    a, b = M.shingle_set(" ".join(words), 3, hasher), M.shingle_set(" ".join(words[100:]), 3, hasher)
    import numpy as np

    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sketcher.sketch(a) == sketcher.sketch(b)).mean() - true) < 0.12
    for similarity in (0.8, 0.85, 0.95):
        bands, rows = M.bands_for(similarity)
        assert (1 - similarity**rows) ** bands <= 1e-6


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500), (None, 3), (602, 601), (601, 602)]
    out = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r.node: r.component for r in out}
    assert len(out) == len(got) and {got[i] for i in range(1, 41)} == {1} and {got[i] for i in range(100, 130)} == {100} and got[602] == 601 and 500 not in got


def brute_cut(rows, width):
    seen = {}
    out = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        words = (text or "").encode().split()
        windows = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)]
        gone = set()
        for i, w in enumerate(windows):
            if seen.get(w, doc) < doc:
                gone |= set(range(i, i + width))
        for w in windows:
            seen.setdefault(w, doc)
        out[doc] = (len(words), len(gone), b" ".join(w for i, w in enumerate(words) if i not in gone).decode())
    return out


@pytest.mark.parametrize("width,gram", [(50, 10), (8, 3), (5, 5)])
def test_op7_edge_rows(hard_docs, hard_rows, width, gram):
    want = brute_cut(hard_rows, width)
    rows = S.substring_dedup(hard_docs, width, gram).collect()
    assert len(rows) == len(hard_rows)
    texts = {}
    for d, t in hard_rows:
        texts.setdefault(d, []).append((t or "").encode().split())
    for r in rows:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id]
        end = 0
        for f in r.factors:  # what a factor copies is what its source has there, and it can't go on
            assert f.n_words >= width and f.source < r.doc_id and f.start + f.n_words > end
            own, source = texts[r.doc_id][0][f.start :], texts[f.source][0][f.source_start :]
            assert own[: f.n_words] == source[: f.n_words]
            end = f.start + f.n_words


def test_op7_windows_at_block_boundaries(spark, no_docs):
    rng = random.Random(9)
    words = [f"w{rng.randrange(30)}" for _ in range(400)]
    rows = []
    for i in range(40):
        a, n = rng.randrange(350), rng.randrange(5, 50)
        rows.append((i, " ".join([f"x{rng.random()}", *words[a : a + n], f"y{rng.randrange(3)}", *words[a + n : a + n + 9]])))
    out = S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 10, 4).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in out} == brute_cut(rows, 10)
    assert S.substring_dedup(no_docs).count() == 0


def test_op7_factors_are_extended_along_their_source(spark):
    """One long copy is one factor, though it spans many blocks; repeats of a row change nothing."""
    rng = random.Random(21)
    long = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    rows = [(1, " ".join(["a", "b", *long])), (2, " ".join(["x", *long[30:330], "y"]))] + [(3, " ".join([*long[100:180], "end"]))] * 60
    out = S.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 50).collect()
    got = {r.doc_id: [tuple(f) for f in r.factors] for r in out}
    assert got == {1: [], 2: [(1, 300, 1, 32)], 3: [(0, 80, 1, 102)]} and len(out) == 62


def test_op7_carry_keeps_columns_and_untouched_texts(hard_docs):
    out = S.substring_dedup(hard_docs, 50, carry=True).collect()
    assert {r.row.lang for r in out} == {"x"} and next(r for r in out if r.doc_id == 7).kept == " \t\n "


@pytest.mark.parametrize("share", [1 / 1024, 1e-9])
def test_copies_drop_whole_rows(spark, hard_docs, hard_rows, monkeypatch, share):
    monkeypatch.setattr(X, "HOT_SHARE", share)
    rows = X.drop_exact_copies(hard_docs).collect()
    assert rows[0].__fields__ == hard_docs.columns and {(r.lang, r.tid, r.kept) for r in rows} == {("x", 1, 2.5)}
    texts = {}
    for d, t in hard_rows:
        texts.setdefault(X.normalised(t), []).append((-len(t or ""), d is None, d or 0, t))
    assert sorted((r.doc_id or 0, r.text or "") for r in rows) == sorted((m[2], m[3] or "") for m in map(min, texts.values()))
    many = [(i, "same text" if i % 3 else f"other {i}") for i in range(2500)]
    left = X.drop_exact_copies(spark.createDataFrame(many, "doc_id long, text string").repartition(5)).collect()
    assert sorted(r.doc_id for r in left) == sorted([1, *(i for i in range(0, 2500, 3))])
