"""Quality rules: statistics of whole texts by built-in functions, and a learned decision list over them.

The statistics never leave the row: words, lines and windows are arrays, repeats are found by sorting. Sequential covering learns which texts
to drop from labelled statistics: a rule grows by the threshold that gains most, is pruned on rows that it did not grow on, and is kept if it
is precise enough on all; the rows it covers are set aside. The list becomes one ordered CASE expression, so filtering is a projection.

Defined results: a null text has no words and fails the base rule; rows without an id are kept as they are; labels outside 0 and 1, or null,
teach nothing; without labels no rule is learned and only the base rule drops; rows that repeat an id are judged each; other columns are
ignored. Windows are compared by 64-bit hashes, within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import sample

#: Labelled rows that learning reads at most.
SAMPLE_ROWS = 10_000
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: What thresholds are set on: names and SQL over the statistics.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeated_share": "n_repeat_words / greatest(n_words, 1)",
    "repeated_lines_per_word": "n_dup_lines / greatest(n_words, 1)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "capitals_per_char": "n_capitals / greatest(word_chars, 1)",
    "digits_per_char": "n_digits / greatest(word_chars, 1)",
    "exclamations_per_word": "n_exclamations / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "same_as_before_share": "n_same_as_before / greatest(n_words, 1)",
}


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id and the statistics) of every row, in one pass without a shuffle."""
    without = lambda signs: F.length("text") - F.length(F.translate("text", signs, ""))
    white = " \t\n\x0b\x0c\r"
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    d = d.select(
        "doc_id",
        F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"),
        F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, white, "")) > 0).alias("lines"),
        F.length(F.translate("text", white, "")).cast("long").alias("word_chars"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_capitals"),
        without("0123456789").cast("long").alias("n_digits"),
        without("!").cast("long").alias("n_exclamations"),
    )
    window = ", ".join(f"w[i + {k}]" for k in range(WINDOW))
    d = d.withColumns(
        {
            "n_words": F.expr("cast(size(w) as long)"),
            "n_dup_lines": F.expr("cast(size(lines) - size(array_distinct(lines)) as long)"),
            "n_distinct_words": F.expr("cast(size(array_distinct(w)) as long)"),
            "n_same_as_before": F.expr("cast(size(filter(w, (x, i) -> i > 0 and x = w[i - 1])) as long)"),
            "h": F.expr(f"CASE WHEN size(w) >= {WINDOW} THEN transform(sequence(0, size(w) - {WINDOW}), i -> xxhash64({window})) END"),
        }
    ).drop("w", "lines")
    d = d.withColumn("h", F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN sort_array(transform(h, (x, i) -> struct(x AS h, i AS i))) END"))
    d = d.withColumn("h", F.expr("CASE WHEN h IS NOT NULL THEN sort_array(transform(filter(h, (x, k) -> (k > 0 and h[k - 1].h = x.h) or (k + 1 < size(h) and h[k + 1].h = x.h)), x -> x.i)) END"))
    covered = f"aggregate(transform(h, (x, k) -> CASE WHEN k + 1 < size(h) THEN least({WINDOW}, h[k + 1] - x) ELSE {WINDOW} END), 0L, (a, x) -> a + x)"
    # never true: a nondeterministic term keeps filters above from being pushed down, which would put the arrays' making inside their lambdas
    fence = F.when(F.monotonically_increasing_id() < 0, 1).otherwise(0)
    return d.withColumn("n_repeat_words", F.expr(f"CASE WHEN h IS NULL THEN 0L ELSE {covered} END") + fence).drop("h")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold!r}D"

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold


def candidates(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 48) -> list[Condition]:
    """Thresholds between neighbouring quantiles of each class, both ways."""
    out = []
    for name, values in x.items():
        seen = np.unique(np.concatenate([np.quantile(values[bad == k], np.linspace(0, 1, most)) for k in (0, 1) if (bad == k).any()]))
        for t in (seen[1:] + seen[:-1]) / 2:
            out += [Condition(name, True, float(t)), Condition(name, False, float(t))]
    return out


def grow(masks: np.ndarray, bad: np.ndarray, live: np.ndarray, depth: int) -> list[int]:
    """Indices of conditions, each the one of greatest gain in bits for the bad rows that stay covered."""
    rule: list[int] = []
    covered = live.copy()
    while len(rule) < depth:
        p0, n0 = (covered & bad).sum(), (covered & ~bad).sum()
        if not p0 or not n0:
            break
        p = (masks & (covered & bad)).sum(1)
        n = (masks & (covered & ~bad)).sum(1)
        gain = p * (np.log2((p + 1e-9) / (p + n + 1e-9)) - np.log2(p0 / (p0 + n0)))
        best = int(np.argmax(np.where(p > 0, gain, -np.inf)))
        if gain[best] <= 1e-9:
            break
        rule.append(best)
        covered &= masks[best]
    return rule


def prune(rule: list[int], masks: np.ndarray, bad: np.ndarray, live: np.ndarray) -> list[int]:
    """The shortest beginning of the rule that is worth most on rows that it did not grow on."""
    best, worth = rule, -np.inf
    for k in range(1, len(rule) + 1):
        covered = live & masks[rule[:k]].all(0)
        p, n = (covered & bad).sum(), (covered & ~bad).sum()
        value = (p - n) / (p + n) if p + n else -np.inf
        if value > worth:
            best, worth = rule[:k], value
    return best


def merged(rule: list[int], tests: list[Condition]) -> list[int]:
    """Of conditions that bound one feature on one side only the narrowest."""
    narrowest: dict[tuple[str, bool], int] = {}
    for k in rule:
        side = (tests[k].feature, tests[k].above)
        if side not in narrowest or (tests[k].threshold > tests[narrowest[side]].threshold) == tests[k].above:
            narrowest[side] = k
    return [*narrowest.values()]


def learn(rows: list[dict], precision: float = 0.98, most_rules: int = 12, depth: int = 3, seed: int = 5) -> list[list[Condition]]:
    """An ordered list of rules, each a conjunction that drops; rows: features and label (1 good, 0 bad)."""
    if not rows or len({r["label"] for r in rows}) < 2:
        return []
    bad = np.array([r["label"] == 0 for r in rows])
    x = {f: np.array([float(r[f]) for r in rows]) for f in FEATURES}
    tests = candidates(x, bad)
    masks = np.stack([t.holds(x) for t in tests])
    growing = np.random.default_rng(seed).random(len(rows)) < 2 / 3
    live, rules = np.ones(len(rows), bool), []
    while (live & bad).any() and len(rules) < most_rules:
        rule = grow(masks, bad, live & growing, depth)
        if rule:
            rule = merged(prune(rule, masks, bad, live & ~growing), tests)
        covered = live & masks[rule].all(0) if rule else np.zeros(len(rows), bool)
        if not rule or covered.sum() < 3 or (covered & bad).sum() < precision * covered.sum():
            break
        rules.append([tests[k] for k in rule])
        live &= ~covered
    return rules


def verdict(rules: list[list[Condition]]) -> Column:
    """False for a text that a rule covers, the first that does."""
    if not rules:
        return F.lit(True)
    return F.expr("CASE " + " ".join(f"WHEN {' AND '.join(c.sql() for c in rule)} THEN false" for rule in rules) + " ELSE true END")


def base_failed() -> Column:
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


def learned(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> list[list[Condition]]:
    """Rules from at most so many labelled rows that the base rule lets pass; nine numbers of each reach the driver."""
    chosen = sample(labels, label, 1, -1, most, id_col).select("doc_id", "label", "place")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    stats = statistics(texts.select(F.struct("doc_id", "label", "place").alias("doc_id"), "text")).filter(~base_failed())
    rows = stats.select("doc_id.*", *[F.expr(sql).alias(name) for name, sql in FEATURES.items()]).collect()
    return learn(sorted((r.asDict() for r in rows), key=lambda r: (r["place"], *map(r.get, FEATURES))))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    rules = learned(docs, labels, id_col=id_col, text_col=text_col)
    stats = statistics(docs, id_col, text_col).select("*", *[F.expr(sql).alias(name) for name, sql in FEATURES.items()])
    return stats.select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
