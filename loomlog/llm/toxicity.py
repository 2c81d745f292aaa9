"""Toxic spans and document scores from a linear-chain conditional random field.

Labels are given per document; tokens get theirs from them. Over the labelled documents some words,
and some beginnings of words that several words share, are significantly and mostly found in toxic
ones (near copies count as one document); a token of a toxic document is toxic if its word is or begins so, and every token of a clean
document is clean. The field has two tags, a weight for each such word or beginning (a token has
that of its longest) and one for all other words, and weights for the transitions and the start; it is fitted by gradient ascent on
the likelihood of segments of the labelled documents. Forward-backward gives each token's marginal:
tokens above one half are the offending offsets, and the expected number of toxic tokens makes the
document's score, calibrated by a logistic curve on the labelled documents.

All words without a weight share one transition matrix, so a run of them is a power of it and
costs one step. A word without a weight is clean in every labelled document, so its marginal tends
to nothing and isn't counted. Fitting takes a bounded sample (``max_documents``, ``max_chars``); scoring
takes whole texts and streams through them.

Defined results: null counts as empty; empty texts and texts without a weighted word get the
score of no evidence; without labels of both kinds every score is next to 0; repeated rows are scored each;
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import read_table, text_of
from .minhash import shingle_set, similar
from .word_hash import WordHasher

#: Labelled rows that the field is fitted on, at most, and their characters in all, at most.
MAX_DOCUMENTS, MAX_CHARS = 4000, 40_000_000
SEGMENT = 48
WORD = re.compile(r"[^\W\d_]+")


def lowered(text: str) -> str:
    """Lower case of the same length, so that offsets hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@dataclass
class Field:
    """The fitted field; ``weights`` has the log-odds for the toxic tag of ``word`` and ``begin*``."""

    weights: dict[str, float] = field(default_factory=dict)
    other: float = -4.0
    start: tuple[float, float] = (0.0, 0.0)
    moves: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))
    curve: tuple[float, float, float] = (-40.0, 0.0, 0.0)

    def __post_init__(self):
        self._runs: dict[int, tuple[float, ...]] = {}
        self._heads = frozenset(w.rstrip("*")[:SHORTEST] for w in self.weights)

    def _run(self, n: int) -> tuple[float, ...]:
        """The normalised product of ``n`` steps over words without a weight (row-major 2 x 2)."""
        found = self._runs.get(n)
        if found is None:
            (a, b), (c, d) = self.moves
            one = (math.exp(a), math.exp(b + self.other), math.exp(c), math.exp(d + self.other))
            found, base, k = (1.0, 0.0, 0.0, 1.0), one, n
            while k:
                if k & 1:
                    found = _times(found, base)
                base, k = _times(base, base), k >> 1
            if len(self._runs) > 20_000:
                self._runs.clear()
            self._runs[n] = found
        return found

    def marginals(self, places: list[int], scores: list[float], n: int) -> list[float]:
        """P(toxic) of the tokens at ``places``, of ``n`` in all; ``scores`` are their weights."""
        forward, at = [], -1
        f0 = f1 = 0.0
        (a, b), (c, d) = self.moves
        ea, eb, ec, ed = math.exp(a), math.exp(b), math.exp(c), math.exp(d)
        for place, score in zip(places, scores, strict=True):
            if at < 0:
                # the start stands for the move into the first token
                if place == 0:
                    f0, f1 = math.exp(self.start[0]), math.exp(self.start[1] + score)
                else:
                    g0, g1 = math.exp(self.start[0]), math.exp(self.start[1] + self.other)
                    r = self._run(place - 1)
                    g0, g1 = g0 * r[0] + g1 * r[2], g0 * r[1] + g1 * r[3]
                    e = math.exp(score)
                    f0, f1 = g0 * ea + g1 * ec, (g0 * eb + g1 * ed) * e
            else:
                r = self._run(place - at - 1)
                g0, g1 = f0 * r[0] + f1 * r[2], f0 * r[1] + f1 * r[3]
                e = math.exp(score)
                f0, f1 = g0 * ea + g1 * ec, (g0 * eb + g1 * ed) * e
            total = f0 + f1
            f0, f1, at = f0 / total, f1 / total, place
            forward.append((f0, f1))
        out, following = [0.0] * len(places), n
        b0 = b1 = 1.0
        for i in range(len(places) - 1, -1, -1):
            if following < n:  # step into the weighted token that follows
                e = math.exp(scores[i + 1])
                h0, h1 = ea * b0 + eb * e * b1, ec * b0 + ed * e * b1
            else:
                h0, h1 = b0, b1
            r = self._run(following - places[i] - 1)
            b0, b1 = r[0] * h0 + r[1] * h1, r[2] * h0 + r[3] * h1
            total = b0 + b1
            b0, b1, following = b0 / total, b1 / total, places[i]
            toxic = forward[i][1] * b1
            out[i] = toxic / (toxic + forward[i][0] * b0)
        return out

    def evidence(self, text: str) -> tuple[float, float, list[tuple[int, float]]]:
        """(one or more toxic tokens, their expected number, [(token number, marginal)])."""
        words = WORD.findall(lowered(text))
        heads, weights = self._heads, self.weights
        told = [(i, weights[c]) for i, w in enumerate(words) if w[:SHORTEST] in heads and (c := class_of(w, weights))]
        if not told:
            return 0.0, 0.0, []
        places = [i for i, _ in told]
        found = self.marginals(places, [s for _, s in told], len(words))
        none = 1.0
        for p in found:
            none *= 1.0 - p
        return 1.0 - none, sum(found), list(zip(places, found, strict=True))

    def score(self, some: float, number: float) -> float:
        z = self.curve[0] + self.curve[1] * some + self.curve[2] * math.log1p(number)
        return 1.0 / (1.0 + math.exp(-max(-700.0, min(700.0, z))))

    def tag(self, text: str) -> tuple[float, list[dict]]:
        """The document's score and its offending spans, in code points."""
        some, number, found = self.evidence(text)
        toxic = {i: p for i, p in found if p > 0.5}
        spans = []
        if toxic:
            for i, m in enumerate(WORD.finditer(lowered(text))):
                if i in toxic:
                    spans.append({"start": m.start(), "end": m.end(), "marginal": toxic[i]})
        return self.score(some, number), spans


def _times(x: tuple[float, ...], y: tuple[float, ...]) -> tuple[float, ...]:
    z = (x[0] * y[0] + x[1] * y[2], x[0] * y[1] + x[1] * y[3], x[2] * y[0] + x[3] * y[2], x[2] * y[1] + x[3] * y[3])
    top = max(z)
    return (z[0] / top, z[1] / top, z[2] / top, z[3] / top)


def near_copies(texts: Iterable[str], width: int = 5, percent: int = 80) -> list[int]:
    """A group number for each text: texts linked by a similarity of ``percent`` over their shingles
    are one, since words of a text that was copied are no more telling for it.

    Exact. A set's rarest shingles, enough of them that the others are less than ``percent`` of it,
    hold one that any similar set's have too; pairs that share one are compared on full sets.
    """
    hasher = WordHasher()
    sets = [shingle_set(text, width, hasher) for text in texts]
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
    holders: dict[int, list[int]] = {}
    for i, own in enumerate(sets):
        often = counts[np.searchsorted(values, own)]
        first = np.lexsort((own, often))[: len(own) - -(-percent * len(own) // 100) + 1]
        others: set[int] = set()
        for shingle in own[first[often[first] > 1]].tolist():
            others.update(held := holders.setdefault(shingle, []))
            held.append(i)
        for j in sorted(others):
            a, b, few, many = root(j), root(i), *sorted((len(sets[j]), len(own)))
            # sets of too different sizes can't be similar
            if a != b and similar(few, few, many, percent) and similar(len(np.intersect1d(sets[j], own, True)), few, many, percent):
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(sets))]


#: Lengths of the beginnings looked at.
SHORTEST, LONGEST = 3, 8


def class_of(word: str, lexicon) -> str | None:
    """The word itself, or its longest proper beginning, that the lexicon has."""
    if word in lexicon:
        return word
    for k in range(min(LONGEST, len(word) - 1), SHORTEST - 1, -1):
        if (begin := f"{word[:k]}*") in lexicon:
            return begin
    return None


def toxic_classes(documents: list[set[str]], labels: list[int], support: int = 5, share: float = 0.5, z: float = 6.0, words: int = 4) -> set[str]:
    """Words, and beginnings of ``words`` words or more, of at least ``support`` toxic documents,
    mostly found there and significantly so."""
    begins = lambda w: (f"{w[:k]}*" for k in range(SHORTEST, min(LONGEST, len(w) - 1) + 1))
    toxic: Counter = Counter()
    for found, label in zip(documents, labels, strict=True):
        if label:
            toxic.update(found)
            toxic.update({b for w in found for b in begins(w)})
    # clean documents are counted for what toxic ones have often enough
    toxic = Counter({name: k for name, k in toxic.items() if k >= support and len(name) >= SHORTEST})
    clean: Counter = Counter()
    under: dict[str, set[str]] = {}
    for found, label in zip(documents, labels, strict=True):
        if label:
            for w in found:
                for b in begins(w):
                    if b in toxic and len(known := under.setdefault(b, set())) < words:
                        known.add(w)
        else:
            clean.update(w for w in found if w in toxic)
            clean.update({b for w in found for b in begins(w) if b in toxic})
    rate = max(1, sum(labels)) / max(1, len(labels))
    out = set()
    for name, k1 in toxic.items():
        k = k1 + clean[name]
        if name.endswith("*") and len(under[name]) < words:
            continue
        if (k1 + 0.5) / (k + 1) >= share and (k1 - k * rate) / math.sqrt(k * rate * (1 - rate) + 1e-9) >= z:
            out.add(name)
    return out


def fit(texts: Iterable[str], labels: Iterable[int], rounds: int = 60, rate: float = 0.3, ridge: float = 1e-3) -> Field:
    """Fit the field and its curve on labelled documents; copies of a text count once."""
    kept = {t: int(y) for t, y in zip(texts, labels, strict=True)}
    words = [[intern(w) for w in WORD.findall(lowered(t))] for t in kept]
    labels = list(kept.values())
    if len(set(labels)) < 2:
        return Field()
    merged: dict[tuple[int, int], set[str]] = {}
    for group, ws, label in zip(near_copies(kept), words, labels, strict=True):
        merged.setdefault((group, label), set()).update(ws)
    lexicon = sorted(toxic_classes(list(merged.values()), [label for _, label in merged]))
    del merged
    number = {c: i + 1 for i, c in enumerate(lexicon)}
    of_word = {w: number.get(class_of(w, number) or "", 0) for ws in words for w in set(ws)}
    # segments of tokens as numbers, 0 for all other words; those without a known class have no toxic
    # tag and differ by their length alone, so one of each length stands for all, as often as they are
    told: list[tuple[list[int], int]] = []
    plain: Counter = Counter()
    for ws, label in zip(words, labels, strict=True):
        ids = [of_word[w] for w in ws]
        for at in range(0, len(ids), SEGMENT):
            part = ids[at : at + SEGMENT]
            if any(part):
                told.append((part, label))
            else:
                plain[len(part)] += 1
    if not told:
        return Field(curve=(_logit(sum(labels) / len(labels)), 0.0, 0.0))
    segments = told + [([0] * n, 0) for n in sorted(plain)]
    weight = np.array([1.0] * len(told) + [float(plain[n]) for n in sorted(plain)])
    x = np.full((len(segments), SEGMENT), 0)
    real = np.zeros((len(segments), SEGMENT), bool)
    y = np.zeros((len(segments), SEGMENT), np.int64)
    for i, (part, label) in enumerate(segments):
        x[i, : len(part)], real[i, : len(part)] = part, True
        y[i, : len(part)] = [int(k > 0 and label) for k in part]
    theta = _ascend(x, y, real, weight, len(lexicon) + 1, rounds, rate, ridge)
    emit, start, moves = theta
    model = Field({w: float(emit[i + 1]) for i, w in enumerate(lexicon)}, float(emit[0]), tuple(map(float, start)), tuple(tuple(map(float, r)) for r in moves))
    seen = [model.evidence(t)[:2] for t in kept]
    model.curve = _curve(np.array([(1.0, a, math.log1p(b)) for a, b in seen]), np.array(labels, float))
    return model


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def _ascend(x, y, real, weight, n_words, rounds, rate, ridge):
    """Gradient ascent with a running scale for each weight; returns emissions, start, moves."""
    n, length = x.shape
    size = n_words + 2 + 4
    theta, speed, scale = np.zeros(size), np.zeros(size), np.zeros(size)
    theta[0] = -3.0
    pairs = real[:, 1:] & real[:, :-1]
    per = weight.sum()
    want = np.zeros(size)
    want[:n_words] = np.bincount(x[real], (y * weight[:, None])[real], n_words)
    want[n_words : n_words + 2] = np.bincount(y[:, 0], weight * real[:, 0], 2)
    want[n_words + 2 :] = np.bincount((2 * y[:, :-1] + y[:, 1:])[pairs], np.broadcast_to(weight[:, None], pairs.shape)[pairs], 4)
    for step in range(1, rounds + 1):
        emit, start, moves = theta[:n_words], np.exp(theta[n_words : n_words + 2]), np.exp(theta[n_words + 2 :].reshape(2, 2))
        e = np.stack([np.ones(x.shape), np.exp(np.clip(emit, -30, 30))[x]], -1)
        alpha, beta = np.zeros((length, n, 2)), np.ones((length, n, 2))
        alpha[0] = start * e[:, 0]
        alpha[0] /= alpha[0].sum(1, keepdims=True)
        for i in range(1, length):
            a = (alpha[i - 1] @ moves) * e[:, i]
            a /= a.sum(1, keepdims=True)
            alpha[i] = np.where(real[:, i, None], a, alpha[i - 1])
        for i in range(length - 2, -1, -1):
            b = (beta[i + 1] * e[:, i + 1]) @ moves.T
            b /= b.sum(1, keepdims=True)
            beta[i] = np.where(real[:, i + 1, None], b, 1.0)
        both = alpha * beta
        both /= both.sum(2, keepdims=True)
        got = np.zeros(size)
        got[:n_words] = np.bincount(x[real], (both[:, :, 1].T * weight[:, None])[real], n_words)
        got[n_words : n_words + 2] = (both[0] * (weight * real[:, 0])[:, None]).sum(0)
        joint = alpha[:-1, :, :, None] * moves[None, None] * (beta[1:] * e.transpose(1, 0, 2)[1:])[:, :, None, :]
        joint /= joint.sum((2, 3), keepdims=True)
        got[n_words + 2 :] = (joint * (pairs.T * weight[None, :])[:, :, None, None]).sum((0, 1)).ravel()
        gradient = (want - got) / per - ridge * theta / max(1, n_words)
        speed, scale = 0.9 * speed + 0.1 * gradient, 0.99 * scale + 0.01 * gradient**2
        theta = theta + rate * (speed / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-8)
        rate *= 0.97
    return theta[:n_words], theta[n_words : n_words + 2], theta[n_words + 2 :].reshape(2, 2)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's method with a slight ridge."""
    w = np.array([_logit(y.mean()), 0.0, 0.0])
    pull = np.array([0.001, 0.1, 0.1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pull)
        step = np.linalg.solve(h, x.T @ (y - p) - pull * w)
        w = w + step * min(1.0, 1.0 / max(1e-12, np.abs(step).max()))  # no step above one
    return tuple(map(float, w))


def in_held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def fit_on_labels(docs: DataFrame, labels: DataFrame, max_documents: int = MAX_DOCUMENTS, max_chars: int = MAX_CHARS) -> Field:
    """Fit on labelled rows without the held-out quarter: the first ``max_documents`` by a hash of
    their ids, of these as many as have ``max_chars`` characters in all. So what the driver gathers
    is bounded, whatever rows an id has."""
    told = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    told = told.where(~in_held_out(F.col("doc_id")))
    sample = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_documents)
    spark = docs.sparkSession
    sample = spark.createDataFrame(sample.collect(), "doc_id long, toxic int")  # bounded; broadcast next
    texts = docs.select(F.col("doc_id").cast("long"), text_of("text").alias("text")).withColumn("tid", F.xxhash64("text"))
    # copies of a text in one id count once; numbers first, then the texts of those chosen
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "tid").agg(F.max(F.length("text")).alias("n"), F.max("toxic").alias("toxic"))
    chosen, left = [], max_chars
    for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "tid").limit(max_documents).collect():
        left -= r.n
        if left < 0:
            break
        chosen.append((r.doc_id, r.tid, r.toxic))
    chosen = spark.createDataFrame(chosen, "doc_id long, tid long, toxic int")
    found = texts.join(F.broadcast(chosen), ["doc_id", "tid"]).dropDuplicates(["doc_id", "tid"]).select("text", "toxic")
    rows = sorted((r.text, r.toxic) for r in found.collect())
    return fit((t for t, _ in rows), (y for _, y in rows))


def tag_toxicity(df: DataFrame, model: Field) -> DataFrame:
    """Per row of ``df`` (doc_id, text): doc_id, score, spans (start, end, marginal)."""
    spark = df.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag = sent.value.tag
        for batch in batches:
            found = [tag(text or "") for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([x for _, x in found], kind)], ["doc_id", "score", "spans"])

    rows = df.select(F.col("doc_id").cast("long"), text_of("text").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, spans array<struct<start int, end int, marginal double>>")


def reject_toxic(df: DataFrame, model: Field, threshold: float = 0.3) -> DataFrame:
    """The rows of ``df`` whose text scores below ``threshold``, unchanged."""
    spark = df.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            yield batch.filter(pa.array([model.score(*model.evidence(text or "")[:2]) < threshold for text in batch.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op3_toxicity(spark, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Score every whole text of ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit_on_labels(docs, read_table(spark, sf_dir, "labels"))
    out = tag_toxicity(docs, model)
    return out.select("doc_id", F.coalesce(in_held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))
