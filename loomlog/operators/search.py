"""Search over folded history: documents of blocks and covered messages, BM25, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import quarter_tokens, token_estimate, truncate_ellipsis
from .blocks import covered, owners
from .messages import assign_refs

K1, B = 1.2, 0.75
TERM = r"[a-z0-9À-ÿ]+"


def search_docs(messages: DataFrame, blocks: DataFrame, members: DataFrame) -> DataFrame:
    """(session_id, kind, ref, role, text, tokens, block_id, tier): all blocks, and the covered
    messages of two characters or more with the first block that has them."""
    refs = assign_refs(messages)
    found = covered(refs, members).where(F.length("text") >= 2).join(owners(members), ["session_id", "id"], "left")
    m = found.select("session_id", F.lit("message").alias("kind"), "ref", "role", "text", token_estimate("text").alias("tokens"), F.col("owner").alias("block_id"), "tier")
    text = F.concat_ws("\n", "topic", "summary")
    b = blocks.select("session_id", F.lit("block").alias("kind"), F.col("block_id").alias("ref"), F.lit("block").alias("role"), text.alias("text"), quarter_tokens("summary").alias("tokens"), "block_id", F.coalesce("tier", F.lit(1)).cast("long").alias("tier"))
    return m.unionByName(b)


def _equals(term: str):
    return lambda word: word == F.lit(term)


def bm25(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Score ``docs`` of each session for ``terms``; only documents with a term come back, with a
    ``preview`` in place of their text.

    Scores are rounded to six places, so that ties are ties everywhere.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(TERM), 0)
    # neither texts nor words are shuffled: only their counts and the preview are needed afterwards
    rows = docs.withColumn("words", words)
    counts = (F.size(F.filter("words", _equals(term))).alias(f"tf{i}") for i, term in enumerate(terms))
    preview = truncate_ellipsis(F.regexp_replace("text", r"[\r\n]+", " "), 80).alias("preview")
    kept = [c for c in docs.columns if c != "text"]
    rows = rows.select(*kept, preview, F.size("words").alias("n_words"), *counts)
    session = Window.partitionBy("session_id")
    dfs = (F.count_if(F.col(f"tf{i}") > 0).over(session).alias(f"df{i}") for i in range(len(terms)))
    rows = rows.select("*", F.count("*").over(session).alias("n"), F.avg("n_words").over(session).alias("mean"), *dfs)
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("n_words") / F.col("mean")))
    scored = rows.withColumn("score", F.round(score, 6)).where(F.col("score") > 0)
    return scored.select(*kept, "preview", "score")


def top_k(scored: DataFrame, k: int = 10) -> DataFrame:
    """The best ``k`` of each session; ties by reference."""
    order = Window.partitionBy("session_id").orderBy(F.desc("score"), "kind", "ref")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
