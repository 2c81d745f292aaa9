"""The pipeline against brute force on the smallest tables, and on rows made to be hard."""

from test_dedup import brute_cut, brute_exact, brute_near
from test_tokens import check_packing

import corpus_pipeline as P
from loomlog.llm import toxicity as T


def by_brute_force(rows, model):
    rows = [(d, t) for d, t in rows if model.tag(t or "")[0] < 0.3]
    keep = {k for _, k, _, _ in brute_exact([r for r in rows if r[0] is not None])}
    rows = [r for r in rows if r[0] is None or r[0] in keep]
    near = brute_near(rows, 5, 80)
    rows = [r for r in rows if r[0] is None or near[r[0]][1] == r[0]]
    cut = brute_cut(rows, 50)
    return [(d, t if d is None or cut[d][1] == 0 else cut[d][2]) for d, t in rows]


def staged(spark, docs, sf_dir, last):
    for name, stage in P.STAGES:
        if name == last:
            break
        columns = docs.columns
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
    return docs


def test_stages_equal_brute_force(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = T.fit_on_labels(docs, labels)
    want = by_brute_force([(r.doc_id, r.text) for r in docs.collect()], model)
    left = staged(spark, docs, sf_dir, "packing")
    got = [(r.doc_id, r.text) for r in left.collect()]
    assert sorted(got) == sorted(want) and len(got) < docs.count()
    out = P.run(spark, sf_dir).collect()
    check_packing(out, want, 2048)


def test_hard_rows_and_empty_tables(spark, sf_dir, hard_docs, no_docs):
    left = staged(spark, hard_docs, sf_dir, "packing")
    ids = [r.doc_id for r in left.select("doc_id").collect()]
    assert None in ids and {1, 7, 8, 14, 17, 18} <= set(ids) and not {2, 3, 5, 6, 15, 16} & set(ids) and ids.count(4) == 1
    empty = no_docs.selectExpr("*", "'en' as lang", "'s' as source", "0L as n_chars")
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_run_leaves_the_last_table_only(spark, sf_dir):
    import pathlib

    from loomlog.session import shared_dir

    folder = pathlib.Path(shared_dir(spark)) / f"loomlog-{spark.sparkContext.applicationId}"
    before = set(folder.iterdir()) if folder.exists() else set()
    out = P.run(spark, sf_dir)
    assert [p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before] == ["stage-packing"] and out.count() > 0
