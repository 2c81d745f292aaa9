"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``; all but the last return the columns of ``documents``.
Clean documents pass every filter: only toxic ones, copies, near copies and passages that stand in
an earlier document go. Rows that share a doc_id stay or go together in the near-copy stage.

Defined results: a null text counts as empty: it isn't toxic, is equal to all texts of white space alone,
of which one row stays, is near to nothing, and is packed as its end id; rows without a doc_id pass the
near-copy and passage stages as they are; extra columns are carried to the last stage, whatever their
names; empty tables give empty tables. A stage's own tables are deleted when it is written, and its
input when the next one is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm.common import delete, fresh_path, read_table, scratch
from loomlog.llm.exact_dedup import drop_exact_copies
from loomlog.llm.minhash import near_dedup
from loomlog.llm.packing import pack_documents
from loomlog.llm.substring_dedup import substring_dedup
from loomlog.llm.toxicity import fit_on_labels, reject_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity score is 0.3 or more."""
    return reject_toxic(docs, fit_on_labels(docs, read_table(spark, sf_dir, "labels")), 0.3)


def _only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ids are kept; rows without an id stay."""
    ids = kept.where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept_id"))
    matched = docs.join(ids.hint("merge"), docs["doc_id"] == ids["_kept_id"], "left_semi")
    return matched.unionByName(docs.where("doc_id is null"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one stays."""
    return drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 over five-word shingles, the first stays."""
    return _only(docs, near_dedup(docs, 5, 80))


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out 50-word windows that an earlier document has; other texts stay as they are."""
    out = substring_dedup(docs, 50, carry=True)
    new = {"text": F.col("kept"), "n_chars": F.length("kept")}
    columns = [(new[c].cast(docs.schema[c].dataType) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return out.select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_passages),
    ("packing", pack),
]

#: SQL can't express fitting, sketching and packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
