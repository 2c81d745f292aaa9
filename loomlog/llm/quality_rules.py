"""Quality rules: base checks and a learned decision list, as Spark expressions.

Statistics of a text are array expressions over its own words: no row leaves its task. Words in
repeated three-word windows are found by sorting hashes: each window becomes a number, the leading
bits of its hash followed by its place, so that after one sort equal windows are neighbours. Two
such sorts with different bits of the hash must agree, which leaves 64 bits in all. A decision list
is learned from labelled statistics by sequential covering: rules are conjunctions of thresholds,
grown on two thirds of the rows condition by condition (information gain), pruned on the last third
from the end, and rows that a rule covers are set aside. The list becomes one ordered conditional
expression: the first rule that holds rejects, no rule keeps.

Learning takes a bounded sample of labelled rows (``max_rows``), numbers only, and makes a list of
bounded length (``max_rules`` of ``max_conditions``), so that the expression stays small; everything
else covers all rows and whole texts.

Defined results: null counts as empty; an empty text has zero statistics and fails the base; no
labels of both kinds, no rules (all that pass the base are kept); repeated rows get the same
verdict; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, read_table, text_of

#: Labelled rows the list is learned from, conditions of a rule and rules of a list, at most.
MAX_ROWS, MAX_CONDITIONS, MAX_RULES = 8000, 6, 50
#: Place bits of a window's number; longer texts take a slower way.
PLACE_BITS = 24
_MASK = (1 << PLACE_BITS) - 1
_LONGS = "array<bigint>"


def _neighbours(sorted_keys: Column) -> Column:
    """Sorted window numbers -> the places of windows that are found twice, in any order."""
    pairs = F.zip_with(
        sorted_keys,
        F.slice(sorted_keys, 2, F.greatest(F.size(sorted_keys) - 1, F.lit(0))),
        lambda a, b: F.when(F.shiftrightunsigned(a.bitwiseXOR(b), PLACE_BITS) == 0, F.array(a.bitwiseAND(_MASK), b.bitwiseAND(_MASK))),
    )
    return F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))


def _neighbours_wide(sorted_pairs: Column) -> Column:
    """The same for (hash, place) structs."""
    pairs = F.zip_with(
        sorted_pairs,
        F.slice(sorted_pairs, 2, F.greatest(F.size(sorted_pairs) - 1, F.lit(0))),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])),
    )
    return F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))


def text_statistics(df: DataFrame) -> DataFrame:
    """``df`` (doc_id, text, ...) -> doc_id, the statistics, and ``carried``: other columns."""
    carried = [c for c in df.columns if c not in ("doc_id", "text")]
    docs = df.select("doc_id", *carried, text_of("text").alias("text"))
    words = F.array_remove(F.split("text", SPACE_CLASS + "+"), "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    docs = docs.select(
        "doc_id", *carried, words.alias("words"), lines.alias("lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"!")).cast("long").alias("n_marks"),
    )
    docs = docs.withColumn("n", F.size("words"))
    hashes = F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))
    docs = docs.select(
        "doc_id", *carried, "n", "n_symbols", "n_marks",
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("n") >= 3, hashes).otherwise(F.array().cast(_LONGS)).alias("hashes"),
    )
    short = F.col("n") < 1 << PLACE_BITS
    numbered = lambda shift: F.sort_array(F.transform("hashes", lambda h, i: F.shiftleft(h, shift).bitwiseAND(~_MASK).bitwiseOR(i.cast("long"))))
    docs = docs.withColumn("sorted", F.when(short, numbered(0)).otherwise(F.array().cast(_LONGS)))
    docs = docs.withColumn("maybe", _neighbours(F.col("sorted"))).drop("sorted")
    # few texts repeat a window; only those are sorted once more
    again = F.when(F.size("maybe") > 0, numbered(PLACE_BITS)).otherwise(F.array().cast(_LONGS))
    wide = F.when(~short, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:bigint>>"))
    docs = docs.withColumn("again", again).withColumn("wide", wide).drop("hashes")
    docs = docs.withColumn("places", F.sort_array(F.concat(F.array_intersect("maybe", _neighbours(F.col("again"))), _neighbours_wide(F.col("wide")))))
    # a window covers three words, or up to the next repeated window
    covered = F.zip_with("places", F.slice("places", 2, F.greatest(F.size("places") - 1, F.lit(0))), lambda a, b: F.least(F.lit(3).cast("long"), b - a))
    numbers = F.struct(
        F.col("n").cast("long").alias("n_words"), *(F.col(c) for c in ("word_chars", "n_symbols", "n_marks", "n_lines", "n_dup_lines")),
        F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x).alias("n_repeat_words"),
    )
    # a generator, so that no later filter is pushed into the array expressions and evaluates them again
    return docs.select("doc_id", *carried, F.inline(F.array(numbers)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: What rules may ask: name -> expression over the statistics.
FEATURES = {
    "words": lambda: F.col("n_words").cast("double"),
    "chars_per_word": lambda: _share("word_chars", "n_words"),
    "symbols_per_word": lambda: _share("n_symbols", "n_words"),
    "marks_per_word": lambda: _share("n_marks", "n_words"),
    "words_per_line": lambda: _share("n_words", "n_lines"),
    "duplicate_lines": lambda: _share("n_dup_lines", "n_lines"),
    "repeated_words": lambda: _share("n_repeat_words", "n_words"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, row: dict[str, float]) -> bool:
        return row[self.feature] > self.threshold if self.above else row[self.feature] <= self.threshold

    def expression(self) -> Column:
        value = FEATURES[self.feature]()
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _best_condition(rows: list[tuple[dict, int]]) -> Condition | None:
    """The condition of most information gain over the rows a rule covers so far."""
    p0 = sum(y for _, y in rows)
    n0 = len(rows) - p0
    base = math.log2(p0 / (p0 + n0))
    best, most = None, 1e-9
    for name in FEATURES:
        ordered = sorted(((x[name], y) for x, y in rows), key=lambda r: r[0])
        p = n = 0
        for (value, y), (following, _) in zip(ordered, ordered[1:]):
            p, n = p + y, n + 1 - y
            if value == following:
                continue
            for above, a, b in ((False, p, n), (True, p0 - p, n0 - n)):
                if a and (gain := a * (math.log2(a / (a + b)) - base)) > most:
                    best, most = Condition(name, above, (value + following) / 2), gain
    return best


def _covers(rule: Rule, row: dict[str, float]) -> bool:
    return all(c.holds(row) for c in rule)


def grow(rows: list[tuple[dict, int]], max_conditions: int = MAX_CONDITIONS) -> Rule:
    rule: Rule = ()
    while len(rule) < max_conditions and any(not y for _, y in rows) and any(y for _, y in rows):
        condition = _best_condition(rows)
        if condition is None:
            break
        rule += (condition,)
        rows = [r for r in rows if condition.holds(r[0])]
    return rule


def prune(rule: Rule, rows: list[tuple[dict, int]]) -> Rule:
    """Drop final conditions while that is as good on rows the rule was not grown on."""

    def worth(rule: Rule) -> float:
        covered = [y for x, y in rows if _covers(rule, x)]
        return (2 * sum(covered) - len(covered)) / len(covered) if covered else -1.0

    best = rule
    for k in range(len(rule) - 1, 0, -1):
        if worth(rule[:k]) >= worth(best):
            best = rule[:k]
    return best


def learn(rows: list[tuple[dict, int]], least_precision: float = 0.8, least_covered: int = 4, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS) -> list[Rule]:
    """Ordered rules for label 1 (reject) by sequential covering."""
    rules: list[Rule] = []
    left = list(rows)
    while any(y for _, y in left) and len(rules) < max_rules:
        growing = [r for i, r in enumerate(left) if i % 3 < 2]
        pruning = [r for i, r in enumerate(left) if i % 3 == 2]
        rule = grow(growing, max_conditions)
        if not rule:
            break
        rule = prune(rule, pruning)
        held = [y for x, y in pruning if _covers(rule, x)]
        covered = [y for x, y in left if _covers(rule, x)]
        if len(covered) < least_covered or sum(covered) < least_precision * len(covered) or 2 * sum(held) < len(held):
            break
        rules.append(rule)
        left = [r for r in left if not _covers(rule, r[0])]
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: true keeps."""
    out = None
    for rule in rules:
        condition = rule[0].expression()
        for c in rule[1:]:
            condition = condition & c.expression()
        out = F.when(condition, F.lit(False)) if out is None else out.when(condition, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def learn_rules(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS) -> list[Rule]:
    """Learn from the statistics of at most ``max_rows`` labelled rows, chosen by a hash of their
    ids (quality 0: reject)."""
    told = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 0).cast("int").alias("reject"))
    sample = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs.sparkSession.createDataFrame(sample.collect(), told.schema)  # bounded; broadcast next
    numbers = text_statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")).where(~base_failed())
    found = numbers.select("doc_id", "reject", *(f().alias(n) for n, f in FEATURES.items()))
    found = found.orderBy(F.xxhash64("doc_id"), *found.columns).limit(max_rows).collect()  # an id may have many rows
    found.sort(key=lambda r: (hash((r.doc_id * 2654435761) % (1 << 32)), tuple(r)))
    rows = [({n: r[n] for n in FEATURES}, r.reject) for r in found]
    return learn(rows, max_rules=max_rules, max_conditions=max_conditions) if len({y for _, y in rows}) == 2 else []


def apply_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` for each row of ``df`` (doc_id, text)."""
    out = text_statistics(df).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Judge every whole text of ``documents`` by the base and a list learned from ``labels``: of
    8000 rows at most, with 50 rules of 6 conditions at most."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = learn_rules(docs, read_table(spark, sf_dir, "labels"))
    return apply_rules(docs, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
