"""Quality rules as a learned decision list.

Statistics of a document are column expressions. On a bounded sample of labelled documents,
sequential covering grows one conjunction of thresholds at a time (the literal of the highest
information gain until no kept document is covered or no literal gains), prunes it from the
end on rows it has not seen, and takes the covered rows away, until a rule is no better than
its floor of precision. The rules become one ordered conditional expression; nothing of the
scoring leaves the JVM.

Defined results: a null or empty text has no words and fails the base rule; repeated rows get
the same verdict; an empty table or no usable labels gives an empty list, which keeps what the
base rule keeps; null labels are not learned from; only id, text and label are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import balanced_sample, one_of_each

#: Labelled rows of each label that a list is learned from.
SAMPLE_PER_LABEL = 8_000
#: Candidate thresholds of a statistic.
THRESHOLDS = 48
MAX_RULES = 12
MAX_LITERALS = 4
#: Share of covered rows that must be of the rejected label.
LEAST_PRECISION = 0.9

_SPACE = r"[\x20\x09-\x0D]+"
_NOT_SPACE = r"[^\x20\x09-\x0D]"
_SYMBOLS = r"[#*$%&|<>]+"

RATIOS = (
    "n_words", "mean_chars", "symbol_share", "dup_lines", "repeat_share", "upper_share", "mark_share", "distinct_share",
)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts of a text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_upper, n_marks, n_distinct. The text column itself is not kept."""
    others = [c for c in docs.columns if c != text]
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(_NOT_SPACE))
    staged = docs.select(*others, F.array_remove(F.split(body, _SPACE), "").alias("words_"), lines.alias("lines_"))
    staged = staged.select(
        *others,
        F.size("words_").alias("n_"),
        F.transform("words_", lambda word: F.xxhash64(word)).alias("hashes_"),
        F.array_join("words_", "").alias("joined_"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).alias("dup_"),
    )
    windows = F.transform(
        F.when(F.col("n_") >= 5, F.sequence(F.lit(0), F.col("n_") - 5)).otherwise(F.array().cast("array<int>")),
        lambda at: F.xxhash64(*[F.get("hashes_", at + k) for k in range(5)]),
    )
    staged = staged.select("*", windows.alias("windows_"))
    # most texts repeat no window: only those that do are sorted
    repeats = F.size("windows_") > F.size(F.array_distinct("windows_"))
    ordered = F.sort_array(F.transform("windows_", lambda value, at: F.struct(value.alias("h"), at.alias("at"))))
    nothing = F.array().cast("array<struct<h:bigint,at:int>>")
    staged = staged.select("*", F.when(repeats, ordered).otherwise(nothing).alias("sorted_"))
    found = F.filter(
        "sorted_",
        lambda item, at: F.coalesce(F.get("sorted_", at - 1)["h"] == item["h"], F.lit(False))
        | F.coalesce(F.get("sorted_", at + 1)["h"] == item["h"], F.lit(False)),
    )
    staged = staged.select("*", F.sort_array(F.transform(found, lambda item: item["at"])).alias("starts_"))
    covered = F.aggregate(
        F.transform("starts_", lambda start, at: F.least(F.lit(5), F.coalesce(F.get("starts_", at + 1) - start, F.lit(5)))),
        F.lit(0), lambda total, size: total + size,
    )
    without = lambda pattern: F.length(F.regexp_replace("joined_", pattern, ""))
    chars = F.length("joined_")
    counts = {
        "n_words": F.col("n_"), "word_chars": chars, "n_symbols": chars - without(_SYMBOLS), "n_dup_lines": F.col("dup_"),
        "n_repeat_words": covered, "n_upper": without(r"[^\p{Lu}]+"), "n_marks": without(r"[\p{L}\p{N}.,]+"),
        "n_distinct": F.size(F.array_distinct("hashes_")),
    }
    # generated, not projected: a filter on a count stays above and does not copy the expressions
    made = F.array(F.struct(*[column.cast("long").alias(name) for name, column in counts.items()]))
    return staged.select(*others, F.inline(made))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """What rules test, by name; 0 where there is nothing to divide by."""
    per = lambda part, whole: F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))
    found = {
        "n_words": F.col("n_words").cast("double"),
        "mean_chars": per("word_chars", "n_words"),
        "symbol_share": per("n_symbols", "word_chars"),
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "mark_share": per("n_marks", "word_chars"),
        "distinct_share": per("n_distinct", "n_words"),
    }
    return {name: found[name] for name in RATIOS}


@dataclass(frozen=True)
class Literal:
    statistic: str
    at_least: bool
    threshold: float

    def holds(self, values: np.ndarray) -> np.ndarray:
        column = values[:, RATIOS.index(self.statistic)]
        return column >= self.threshold if self.at_least else column < self.threshold

    def column(self) -> Column:
        value = ratios()[self.statistic]
        return value >= F.lit(self.threshold) if self.at_least else value < F.lit(self.threshold)


Rule = tuple[Literal, ...]


def _covers(rule: Rule, values: np.ndarray) -> np.ndarray:
    held = np.ones(len(values), bool)
    for literal in rule:
        held &= literal.holds(values)
    return held


def _candidates(values: np.ndarray) -> list[Literal]:
    found = []
    for n, name in enumerate(RATIOS):
        edges = np.unique(np.quantile(values[:, n], np.linspace(0, 1, THRESHOLDS + 2)[1:-1]))
        for edge in edges:
            found += [Literal(name, True, float(edge)), Literal(name, False, float(edge))]
    return found


def _grow(values: np.ndarray, bad: np.ndarray, weight: np.ndarray) -> Rule:
    rule: list[Literal] = []
    inside = np.ones(len(values), bool)
    while len(rule) < MAX_LITERALS and (weight[inside & ~bad]).sum() > 0:
        own, own_bad, own_weight = values[inside], bad[inside], weight[inside]
        positive, negative = own_weight[own_bad].sum(), own_weight[~own_bad].sum()
        best, gain = None, 1e-9
        for literal in _candidates(own[own_bad]):
            held = literal.holds(own)
            p, n = own_weight[held & own_bad].sum(), own_weight[held & ~own_bad].sum()
            if p <= 0:
                continue
            value = p * (np.log2(p / (p + n)) - np.log2(positive / (positive + negative)))
            if value > gain:
                best, gain = literal, value
        if best is None:
            break
        rule.append(best)
        inside &= best.holds(values)
    return tuple(rule)


def _worth(rule: Rule, values: np.ndarray, bad: np.ndarray, weight: np.ndarray) -> float:
    held = _covers(rule, values)
    p, n = weight[held & bad].sum(), weight[held & ~bad].sum()
    return (p - n) / (p + n) if p + n else -1.0


def _prune(rule: Rule, values: np.ndarray, bad: np.ndarray, weight: np.ndarray) -> Rule:
    options = [rule[:n] for n in range(len(rule), 0, -1)]
    return max(options, key=lambda option: _worth(option, values, bad, weight))


def learn(values: np.ndarray, bad: np.ndarray, weight: np.ndarray) -> list[Rule]:
    """Ordered rules that reject. Two thirds of the rows grow a rule, one third prunes it."""
    rules: list[Rule] = []
    left = np.ones(len(values), bool)
    prunes = np.arange(len(values)) % 3 == 2
    while len(rules) < MAX_RULES and (left & bad & ~prunes).any():
        grow, check = left & ~prunes, left & prunes
        rule = _grow(values[grow], bad[grow], weight[grow])
        if rule and (check & bad).any():
            rule = _prune(rule, values[check], bad[check], weight[check])
        if not rule:
            break
        held = _covers(rule, values) & left
        p, n = weight[held & bad].sum(), weight[held & ~bad].sum()
        if p / max(p + n, 1e-12) < LEAST_PRECISION or (held & bad).sum() < 3:
            break
        rules.append(rule)
        left &= ~held
    return rules


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = SAMPLE_PER_LABEL) -> list[Rule]:
    """Learn from documents whose label is 0 (reject) or 1, and that pass the base rule.

    The driver gets the ratios of a sample of about 2 x `per_label` documents, no texts.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("id_"), F.col(label).cast("int").alias("label_"))
    totals = {row["label_"]: row["n"] for row in known.groupBy("label_").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = balanced_sample(known, "id_", "label_", per_label)
    own = docs.select(F.col(key).alias("id_"), F.col(text).alias("text_"))
    # the sample is bounded by its parameter, so this broadcast is too
    own = one_of_each(own.join(F.broadcast(drawn), "id_"), ["id_", "label_"], "text_")
    found = with_statistics(own, "text_").filter(~base_failed())
    rows = found.select(F.xxhash64(F.col("id_").cast("string")).alias("order_"), *[c.alias(f"r_{n}") for n, c in ratios().items()], "label_").collect()
    rows.sort(key=tuple)
    if not rows:
        return []
    values = np.array([[row[f"r_{name}"] for name in RATIOS] for row in rows], float)
    bad = np.array([row["label_"] == 0 for row in rows])
    weight = np.where(bad, totals.get(0, 0) / max(bad.sum(), 1), totals.get(1, 0) / max((~bad).sum(), 1))
    return learn(values, bad, weight)


def verdict(rules: list[Rule]) -> Column:
    """False where a rule rejects, tried in order; true otherwise."""
    conditions = [reduce(lambda a, b: a & b, (literal.column() for literal in rule)) for rule in rules]
    if not conditions:
        return F.lit(True)
    chain = F.when(conditions[0], False)
    for condition in conditions[1:]:
        chain = chain.when(condition, False)
    return chain.otherwise(True)


def described(rules: list[Rule]) -> list[str]:
    """The list as text, one line a rule."""
    sign = lambda x: ">=" if x.at_least else "<"
    return [" and ".join(f"{x.statistic} {sign(x)} {x.threshold:.6g}" for x in rule) + " -> reject" for rule in rules]


def judge(docs: DataFrame, rules: list[Rule], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, kept of every document row."""
    own = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text_"))
    found = with_statistics(own, "text_").withColumn("base_failed", base_failed())
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & verdict(rules)).alias("kept"),
    )
