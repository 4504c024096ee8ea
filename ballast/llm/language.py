"""Language identification with a byte convolutional network.

A text is lower-cased, its UTF-8 bytes are mapped to letters, non-ASCII bytes and blanks, and
cut into windows of a fixed length that cover every byte. Filters of widths 2, 3 and 4 run
over the one-hot bytes of a window, rectified and max-pooled, and a softmax layer gives a
distribution over the learned languages. A document's distribution is the mean over its
windows, weighted by their letters.

Training is back-propagation in numpy (Adam) on windows of a bounded sample of labelled
documents. Applied, a filter is a table lookup: pairs of bytes index a table that holds the
filters' partial sums, so the cost is a few array operations a byte.

Defined results: a null text and a text without a letter give `und` with score 0; repeated
rows get equal results; an empty table gives no rows; without labels every text is `und`;
null labels are not learned from. `accepted` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import balanced_sample, mapped, one_of_each, text_blocks

WINDOW = 128
FILTERS = 8
WIDTHS = (2, 3, 4)
#: Labelled documents of each language, and windows of each, that the network is trained on.
SAMPLE_PER_LANGUAGE = 1_200
WINDOWS_EACH = 3
#: One sampled document in so many is held out, to tell how sure right answers are; the bound of a language is MARGIN of that.
HELD_OUT, MARGIN = 8, 0.75
EPOCHS = 8
BATCH = 256
UNKNOWN = "und"

_BYTE = np.arange(256)
_LETTER = ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
#: Everything but a-z and non-ASCII bytes is a blank, written 0.
_SYMBOL = np.where(_LETTER, _BYTE, 0).astype(np.uint8)


@dataclass(frozen=True)
class Network:
    languages: tuple[str, ...]
    #: by width: (width, 256, FILTERS)
    filters: tuple[np.ndarray, ...]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray
    #: by language: the score that `accepted` asks for
    least: tuple[float, ...] = ()


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, WINDOW) symbols, the text of each window, its letters. Windows cover all bytes;
    those without letters are left out."""
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    total = int(count.sum())
    if not total:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), np.zeros(0)
    text = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    first = offsets[:-1][text] + nth * WINDOW
    padded = np.concatenate([_SYMBOL[data], np.zeros(WINDOW, np.uint8)])
    place = np.arange(WINDOW)
    found = padded[first[:, None] + place[None, :]]
    # a window of one text must not see the next text
    found[first[:, None] + place[None, :] >= offsets[1:][text][:, None]] = 0
    letters = (found > 0).sum(axis=1)
    held = letters > 0
    return found[held], text[held], letters[held].astype(float)


class Scorer:
    """The network with filters as lookup tables on pairs of bytes."""

    def __init__(self, network: Network):
        self.network = network
        two, three, four = network.filters
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)
        self.pairs = np.concatenate(
            [pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1]), pair(four[2], four[3])], axis=1
        ).astype(np.float32)
        self.third = three[2].astype(np.float32)

    def pooled(self, found: np.ndarray) -> np.ndarray:
        n, f = len(found), FILTERS
        code = found[:, :-1].astype(np.int32) * 256 + found[:, 1:]
        sums = self.pairs[code]
        out = np.empty((n, 3 * f), np.float32)
        out[:, :f] = sums[:, :, :f].max(axis=1)
        out[:, f : 2 * f] = (sums[:, :-1, f : 2 * f] + self.third[found[:, 2:]]).max(axis=1)
        out[:, 2 * f :] = (sums[:, :-2, 2 * f : 3 * f] + sums[:, 2:, 3 * f :]).max(axis=1)
        return np.maximum(out + self.network.bias.astype(np.float32), 0)

    def probabilities(self, found: np.ndarray) -> np.ndarray:
        parts = []
        for start in range(0, len(found), 256):
            logits = self.pooled(found[start : start + 256]) @ self.network.dense + self.network.dense_bias
            logits = np.exp(logits - logits.max(axis=1, keepdims=True))
            parts.append(logits / logits.sum(axis=1, keepdims=True))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.network.languages)))


def train(found: np.ndarray, label: np.ndarray, languages: tuple[str, ...], seed: int = 3) -> Network:
    rng = np.random.Generator(np.random.PCG64(seed))
    k, f = len(languages), FILTERS
    shapes = [(w, 256, f) for w in WIDTHS] + [(3 * f,), (3 * f, k), (k,)]
    held = [rng.normal(0, 0.2, s) for s in shapes]
    held[3][:] = 0.1
    held[5][:] = 0.0
    moment = [(np.zeros_like(p), np.zeros_like(p)) for p in held]
    steps = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(found))
        for start in range(0, len(order), BATCH):
            pick = order[start : start + BATCH]
            x, y = found[pick], label[pick]
            n = len(pick)
            pooled = np.empty((n, 3 * f))
            best = np.empty((n, 3 * f), np.int64)
            for at, w in enumerate(WIDTHS):
                z = sum(held[at][j][x[:, j : WINDOW - w + 1 + j]] for j in range(w))
                top = z.argmax(axis=1)
                best[:, at * f : (at + 1) * f] = top
                pooled[:, at * f : (at + 1) * f] = np.take_along_axis(z, top[:, None, :], axis=1)[:, 0]
            active = np.maximum(pooled + held[3], 0)
            logits = active @ held[4] + held[5]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y] -= 1
            p /= n
            grads = [np.zeros_like(q) for q in held]
            grads[4], grads[5] = active.T @ p, p.sum(axis=0)
            back = (p @ held[4].T) * (active > 0)
            grads[3] = back.sum(axis=0)
            rows = np.arange(n)[:, None]
            for at, w in enumerate(WIDTHS):
                top, g = best[:, at * f : (at + 1) * f], back[:, at * f : (at + 1) * f]
                for j in range(w):
                    np.add.at(grads[at][j], (x[rows, top + j], np.arange(f)[None, :]), g)
            steps += 1
            for i, g in enumerate(grads):
                g = g + 1e-5 * held[i]
                a, b = moment[i]
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                held[i] -= 0.01 * (a / (1 - 0.9**steps)) / (np.sqrt(b / (1 - 0.999**steps)) + 1e-8)
    return Network(languages, tuple(held[:3]), held[3], held[4], held[5], (0.0,) * k)


def fit(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Network | None:
    """Train on about `per_language` documents of each label among the rows where `learn` holds.

    The driver gets up to WINDOWS_EACH windows of each sampled document.
    """
    known = docs.filter(learn & F.col(label).isNotNull()).select(F.col(key).alias("id_"), F.col(label).alias("label_"))
    drawn = F.broadcast(balanced_sample(known, "id_", "label_", per_language))
    own = docs.filter(learn).select(F.col(key).alias("id_"), F.col(text).alias("text_"), F.col(label).alias("label_"))
    own = one_of_each(own.join(drawn, ["id_", "label_"]), ["id_", "label_"], "text_").select("text_", "label_", F.xxhash64(F.col("id_").cast("string")).alias("order_"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lowered = pc.utf8_lower(pc.fill_null(batch.column(0), ""))
            for start, end, data, offsets in text_blocks(lowered):
                found, of, _ = windows(data, offsets)
                for row in range(end - start):
                    own_windows = found[of == row]
                    step = max(1, len(own_windows) // WINDOWS_EACH)
                    chosen = own_windows[::step][:WINDOWS_EACH]
                    if len(chosen):
                        yield pa.RecordBatch.from_pydict(
                            {
                                "label": [batch.column(1)[start + row].as_py()],
                                "order": [batch.column(2)[start + row].as_py()],
                                "cells": [chosen.tobytes()],
                            }
                        )

    rows = sorted(mapped(own, work, "label string, order long, cells binary").collect(), key=lambda r: (r["order"], r["label"], bytes(r["cells"])))
    if not rows:
        return None
    languages = tuple(sorted({r["label"] for r in rows}))
    found = [np.frombuffer(bytes(r["cells"]), np.uint8).reshape(-1, WINDOW) for r in rows]
    of = [languages.index(r["label"]) for r in rows]
    # one document in HELD_OUT is not trained on and tells how sure right answers are
    apart = [len(rows) >= 10 * HELD_OUT and r["order"] % HELD_OUT == 0 for r in rows]
    used = [n for n, out in enumerate(apart) if not out]
    label_of = np.concatenate([np.full(len(found[n]), of[n]) for n in used])
    network = train(np.concatenate([found[n] for n in used]), label_of, languages)
    scorer, sure = Scorer(network), [1.0] * len(languages)
    for n, out in enumerate(apart):
        if out:
            mean = scorer.probabilities(found[n]).mean(axis=0)
            if mean.argmax() == of[n]:
                sure[of[n]] = min(sure[of[n]], float(mean.max()))
    return replace(network, least=tuple(MARGIN * s if s < 1.0 else 0.0 for s in sure))


def predict(scorer: Scorer | None, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of every text of a column."""
    n = len(column)
    names = np.full(n, UNKNOWN, object)
    scores = np.zeros(n)
    if scorer is None or not n:
        return names, scores
    filled = pc.fill_null(column, "")
    lettered = np.asarray(pc.match_substring_regex(filled, r"\p{L}").to_numpy(zero_copy_only=False), bool)
    lowered = pc.utf8_lower(filled)
    k = len(scorer.network.languages)
    for start, end, data, offsets in text_blocks(lowered):
        found, of, letters = windows(data, offsets)
        own = scorer.probabilities(found) * letters[:, None]
        total = np.stack([np.bincount(of, weights=own[:, c], minlength=end - start) for c in range(k)], axis=1)
        share = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
        names[start:end] = np.asarray(scorer.network.languages, object)[share.argmax(axis=1)]
        scores[start:end] = share.max(axis=1)
    names[~lettered] = UNKNOWN
    scores[~lettered] = 0.0
    return names, np.clip(scores, 0.0, 1.0)


def identify(docs: DataFrame, network: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every document row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(network) if network is not None else None
        for batch in batches:
            names, scores = predict(scorer, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text_"))
    return mapped(own, work, "doc_id long, lang_pred string, score double")


def accepts(network: Network | None, names: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Whether a predicted language is one, with a score that right answers for it have."""
    bound = dict(zip(network.languages, network.least, strict=True)) if network is not None else {}
    return np.array([name != UNKNOWN and score >= bound[name] for name, score in zip(names, scores, strict=True)], bool)


def accepted(docs: DataFrame, network: Network | None, text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text is in a learned language.

    The bound of each language is MARGIN times the least score of a right answer for it among
    the sampled documents that were not trained on, whatever the number of languages.
    """
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(network) if network is not None else None
        for batch in batches:
            names, scores = predict(scorer, batch.column(at))
            yield batch.filter(pa.array(accepts(network, names, scores)))

    return mapped(docs, work, docs.schema)
