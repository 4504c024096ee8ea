"""Toxicity by a weighted finite-state pattern grammar.

The insult lexicon is learned: words and word beginnings that labelled toxic documents hold far
more often than others (likelihood-ratio test), each with its log odds as weight. It is compiled
into one prefix automaton. Transducers read the words of a clause as classes (insult,
threat, target, negation, report): they are composed into one machine whose states say whether
a negation is in force, a target is near and the clause is reported speech, and which emits the
weight of each insult or threat into the context it stands in. A second machine reads the clause
backwards, so a target counts on either side ("you are a ...", "kill you"). Threat verbs
match in their inflected forms. Matches are summed by context over a text and over its strongest clause;
what a context is worth is not set but fitted: the weights of the arcs are those of a logistic
layer on the labelled documents. Clauses, not isolated words, are what is scored.

Clauses without a lexicon match emit nothing, so only clauses with matches are read word by word.

Model sizes: at most LEXICON entries, those of the highest ratio. On the tables tested some
hundreds pass the ratio, so the bound does not bind; it keeps the automaton small on others.

Defined results: null and empty texts have no matches and get the score of such texts; repeated rows get
equal scores; an empty table gives no rows; without labelled documents of both labels every score is 0;
null labels are not learned from; only id and text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import balanced_sample, mapped, one_of_each

#: Labelled documents of each label that lexicon and layer are fitted on.
SAMPLE_PER_LABEL = 4_000
#: Lexicon entries: likelihood ratio, documents, and how many at most (a model size).
LEAST_RATIO, LEAST_DOCUMENTS, LEXICON = 20.0, 4, 2_000
STEMS = range(4, 9)

#: Fixed word lists of the grammar: stems of threat verbs (inflected as ENDINGS say) and those that stand only as they are.
THREAT_STEMS = "kill hurt destroy beat burn shoot stab murder töt schlag erschieß tuer frapp brûl mat golpe".split()
THREATS = frozenset("die".split())
#: What may follow a stem, behind a doubled last letter too.
ENDINGS = frozenset("s es d ed ing er ers n en t st e et te ten test est ez ent é ée és ées ai as a ons ar o an é aré aron ando ado ear eo ea eas ean eé eó earé".split()) | {""}
TARGETS = frozenset("you your yours he she they them him her people du dich dein ihr euch sie tu toi vous ils elle tú usted ellos ella".split())
NEGATIONS = frozenset("not no never without isn't aren't don't nicht kein keine nie ne pas jamais sin nunca".split())
REPORTS = frozenset("said says called wrote quoted claimed sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())

_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_CLAUSE = re.compile(r"[.,;:!?|\n\r]")
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)


class Machine:
    """A deterministic transducer: start state and a step (state, symbol) -> (state, output)."""

    def __init__(self, start, step):
        self.start, self.step = start, step


def _scope(opener: int, words: int) -> Machine:
    """Emits 1 while within `words` words after the opener."""
    return Machine(0, lambda left, symbol: (words, 0) if symbol == opener else (max(left - 1, 0), int(left > 0)))


def _once(opener: int) -> Machine:
    """Emits 1 from the opener to the end of the clause."""
    return Machine(0, lambda seen, symbol: (1, 1) if symbol == opener else (seen, seen))


def _emit(symbol_read: int) -> Machine:
    return Machine(0, lambda state, symbol: (state, int(symbol == symbol_read)))


def compose(*machines: Machine) -> Machine:
    """The product of machines that read the same word classes; steps are remembered."""
    steps: dict = {}

    def step(state, symbol):
        found = steps.get((state, symbol))
        if found is None:
            moved = [machine.step(own, symbol) for machine, own in zip(machines, state, strict=True)]
            found = steps[state, symbol] = (tuple(x[0] for x in moved), tuple(x[1] for x in moved))
        return found

    return Machine(tuple(machine.start for machine in machines), step)


#: Words on either side of a target, and behind a negation, that it reaches within its clause.
NEAR, NEGATED = 5, 3


def grammar() -> Machine:
    """insult, threat, behind a target, negated, reported."""
    return compose(_emit(INSULT), _emit(THREAT), _scope(TARGET, NEAR), _scope(NEGATION, NEGATED), _once(REPORT))


def backward() -> Machine:
    """Before a target, for a clause read from its end."""
    return compose(_scope(TARGET, NEAR))


#: Contexts of matches: insults plain, negated, reported and aimed, threats aimed and others.
CONTEXTS = 6
PLAIN, DENIED, REPORTED, AIMED, THREATENED, VIOLENT = range(CONTEXTS)
#: by context over the text, by context in its strongest clause, insult weight per root of words, matches per word, any insult
FEATURES = 2 * CONTEXTS + 3


def contexts(symbols: list[int], weights: list[float], forward: Machine, back: Machine) -> list[float]:
    """Sums by context of one clause: word classes, and the weight of each word that is an insult."""
    before, state = [], back.start
    for symbol in reversed(symbols):
        state, (near,) = back.step(state, symbol)
        before.append(near)
    out, state = [0.0] * CONTEXTS, forward.start
    for symbol, weight, ahead in zip(symbols, weights, reversed(before), strict=True):
        state, (insult, threat, behind, negated, reported) = forward.step(state, symbol)
        aimed = behind or ahead
        if insult:
            out[DENIED if negated else REPORTED if reported else AIMED if aimed else PLAIN] += weight
        elif threat:
            out[THREATENED if aimed and not negated and not reported else VIOLENT] += 1.0
    return out


def is_threat(word: str) -> bool:
    """An inflected form of a threat verb, or a threat word itself."""
    if word in THREATS:
        return True
    for stem in THREAT_STEMS:
        if word.startswith(stem):
            rest = word[len(stem) :]
            if rest in ENDINGS or (rest[:1] == stem[-1] and rest[1:] in ENDINGS and len(rest) > 1):
                return True
    return False


@dataclass(frozen=True)
class Toxicity:
    #: stem, whole word only, weight
    lexicon: tuple[tuple[str, bool, float], ...]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = ((features - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Reader:
    """Features of texts under a lexicon."""

    def __init__(self, lexicon):
        import ahocorasick

        self.forward, self.back = grammar(), backward()
        self.automaton = ahocorasick.Automaton()
        best: dict[str, list] = {}
        for stem, whole, weight in lexicon:
            best.setdefault(stem, []).append((whole, weight))
        for stem, kinds in best.items():
            self.automaton.add_word(stem, (len(stem), tuple(kinds)))
        for word in (*THREATS, *THREAT_STEMS):
            if word not in best:
                self.automaton.add_word(word, (len(word), ((False, None),)))
        self.automaton.make_automaton()

    def matches(self, text: str) -> dict[int, tuple[int, float | None]]:
        """Begin of a word -> length and weight of its longest entry; weight None is a threat."""
        found: dict[int, tuple[int, float | None]] = {}
        for end, (size, kinds) in self.automaton.iter(text):
            start = end - size + 1
            if start and (text[start - 1].isalnum()):
                continue
            closed = end + 1 >= len(text) or not text[end + 1].isalnum()
            for whole, weight in kinds:
                if weight is None and not is_threat(_WORD.match(text, start).group()):
                    continue
                if (closed or not whole) and found.get(start, (0, 0.0))[0] <= size:
                    found[start] = (size, weight)
        return found

    def features(self, text: str) -> list[float]:
        out = [0.0] * FEATURES
        lowered = text.lower()
        found = self.matches(lowered)
        if not found:
            return out
        bounds = [m.start() for m in _CLAUSE.finditer(lowered)]
        clauses = sorted({bisect_right(bounds, at) for at in found})
        whole, strongest, strength = [0.0] * CONTEXTS, [0.0] * CONTEXTS, 0.0
        hits = 0
        for clause in clauses:
            begin = bounds[clause - 1] + 1 if clause else 0
            end = bounds[clause] if clause < len(bounds) else len(lowered)
            symbols, weights = [], []
            for word in _WORD.finditer(lowered, begin, end):
                name, match = word.group(), found.get(word.start())
                weight = 0.0 if match is None or match[1] is None else match[1]
                symbols.append(
                    INSULT if weight else THREAT if match is not None
                    else TARGET if name in TARGETS else NEGATION if name in NEGATIONS else REPORT if name in REPORTS else OTHER
                )
                weights.append(weight)
            own = contexts(symbols, weights, self.forward, self.back)
            hits += sum(s in (INSULT, THREAT) for s in symbols)
            whole = [a + b for a, b in zip(whole, own, strict=True)]
            if sum(own) > strength:
                strongest, strength = own, sum(own)
        words = lowered.count(" ") + 1
        insults = sum(whole[:THREATENED])
        return [*(log(1 + x) for x in whole), *strongest, insults / words**0.5, hits / words, float(insults > 0)]


def stems(text: str) -> set[str]:
    """Words (ending in a blank) and word beginnings of a text."""
    found = set()
    for word in set(_WORD.findall(text.lower())):
        found.add(word + " ")
        found.update(word[:n] for n in STEMS if n <= len(word))
    return found


def _ratio(a: Column, b: Column, toxic: int, clean: int) -> Column:
    """Likelihood ratio of a stem in a of `toxic` and b of `clean` documents."""
    def part(k: Column, n: int, p: Column) -> Column:
        p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(p) + (n - k) * F.log(1 - p)

    both = (a + b) / (toxic + clean)
    return 2 * (part(a, toxic, a / toxic) + part(b, clean, b / clean) - part(a, toxic, both) - part(b, clean, both))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = SAMPLE_PER_LABEL) -> Toxicity | None:
    """Learn lexicon and layer from about `per_label` documents of each label (three times as many of the label 0).

    The driver gets counted stems that pass the test and a few numbers a sampled document.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("id_"), F.col(label).cast("int").alias("label_"))
    totals = {r["label_"]: r["n"] for r in known.groupBy("label_").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        return None
    toxic_rows = balanced_sample(known.filter("label_ = 1"), "id_", "label_", per_label)
    clean_rows = balanced_sample(known.filter("label_ = 0"), "id_", "label_", 3 * per_label)
    drawn = F.broadcast(toxic_rows.unionByName(clean_rows))
    own = one_of_each(docs.select(F.col(key).alias("id_"), F.col(text).alias("text_")).join(drawn, "id_"), ["id_", "label_"], "text_")
    own = own.select("text_", "label_", F.xxhash64(F.col("id_").cast("string")).alias("order_")).repartition(32, "order_")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())
        n = [0, 0]
        for batch in batches:
            for body, mark in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                held[mark].update(stems(body.as_py() or ""))
                n[mark] += 1
        held[0][""], held[1][""] = n
        names = list(held[0].keys() | held[1].keys())
        yield pa.RecordBatch.from_pydict(
            {"stem": names, "clean": [held[0][x] for x in names], "toxic": [held[1][x] for x in names]}
        )

    counted = mapped(own, count, "stem string, clean long, toxic long").groupBy("stem").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")
    )
    # a stem that fails these cannot pass the test, so what is gathered is small
    size = counted.filter("stem = ''").first()
    if size is None or not size["toxic"] or not size["clean"]:
        return None
    toxic, clean = size["toxic"], size["clean"]
    likely = counted.filter((F.col("stem") != "") & (F.col("toxic") >= LEAST_DOCUMENTS) & (F.col("toxic") * clean > 4 * F.col("clean") * toxic))
    ratio = _ratio(F.col("toxic"), F.col("clean"), toxic, clean)
    passed = likely.withColumn("ratio", F.round(ratio, 6)).filter(F.col("ratio") >= LEAST_RATIO)
    lexicon = tuple(
        (r["stem"].rstrip(" "), r["stem"].endswith(" "), log((r["toxic"] + 0.5) / (toxic + 1)) - log((r["clean"] + 0.5) / (clean + 1)))
        for r in passed.orderBy(F.desc("ratio"), "stem").limit(LEXICON).collect()
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch in batches:
            found = [reader.features(x.as_py() or "") for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(found, pa.list_(pa.float64()))], ["label", "order", "found"]
            )

    rows = sorted(tuple(r) for r in mapped(own, measure, "label int, order long, found array<double>").collect())
    x = np.array([r[2] for r in rows], float)
    y = np.array([r[0] for r in rows], float)
    weight = np.where(y == 1, totals[1] / max((y == 1).sum(), 1), totals[0] / max((y == 0).sum(), 1))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    w = np.zeros(FEATURES + 1)
    ridge = np.diag([1e-3] * FEATURES + [1e-6])
    for _ in range(40):
        # Newton steps of the weighted logistic likelihood
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        v = weight * np.maximum(p * (1 - p), 1e-6)
        hessian = (z * v[:, None]).T @ z / weight.sum() + ridge
        gradient = z.T @ (weight * (p - y)) / weight.sum() + ridge @ w
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
    return Toxicity(lexicon, mean, scale, w[:-1], float(w[-1]))


def score(docs: DataFrame, model: Toxicity | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of every document row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.lexicon) if model is not None else None
        for batch in batches:
            if reader is None:
                found = np.zeros(batch.num_rows)
            else:
                found = model.probability(np.array([reader.features(x.as_py() or "") for x in batch.column(1)], float).reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text_"))
    return mapped(own, work, "doc_id long, score double")


