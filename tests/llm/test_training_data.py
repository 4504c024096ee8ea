"""Operators against brute force, exact round trips and held-out accuracy, with the odd rows of each."""

import collections
import hashlib
import os
import random
import re
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ballast.llm import (
    chat,
    common,
    decision_list,
    decontamination,
    language,
    near_duplicates,
    ordinal,
    packing,
    page_text,
    queries,
    sharding,
    toxicity,
)
from ballast.llm.common import crc_mod, table

FOLDER = "/root/testdata/sf0.001"
CLASHING = ["doc_id", "text", "lang", "source", "n_chars", "score", "piece", "k_id", "node"]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


# packing


def encoded(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


def test_encoder_equals_the_tokenizer():
    encode = packing.Encoder(BPE)
    texts = ["", " ", "a  b\n\n c  ", "don't they're \t\t x", "é²½ ªb <|endoftext|> hi", "日本 a\x85b", "12ab!!  \r\n x", "\x1c\x1dab"]
    texts += [r[0] for r in duckdb.sql(f"SELECT text FROM '{FOLDER}/documents.parquet'").fetchall()]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == encoded(text)[:-1]


def test_packing_is_whole_and_gapless(spark, documents, odd_rows):
    found = packing.pieces(documents(odd_rows), BPE)
    packed = packing.pack(found).collect()
    by_doc = collections.defaultdict(list)
    for row in packed:
        by_doc[row.doc_id].append(row)
    for key, text in odd_rows:
        ids = encoded(text)
        own = sorted(by_doc[key], key=lambda r: (r.piece, r.sequence_id))
        copies = sum(k == key for k, _ in odd_rows)
        assert len(own) == copies * len(packing.cut(len(ids), 1024))
        for row in own:
            part = np.asarray(ids[row.start : row.start + row.length], "<u4")
            assert (len(part), zlib.crc32(part.tobytes())) == (row.length, row.ids_crc32)
            assert row.length == 1024 or row.piece == 0
    bins = collections.defaultdict(list)
    for row in packed:
        bins[row.sequence_id].append((row.offset, row.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_best_fit_keeps_every_capacity(rule):
    lengths = np.random.default_rng(1).integers(1, 1000, 2000)
    capacity = (1024.0, 3.0, 600_000.0)
    bins, offsets = packing.best_fit(lengths, capacity, (1.0, 0.25, 0.25), rule)
    for name in np.unique(bins):
        own = lengths[bins == name]
        if len(own) > 1:
            assert own.sum() <= 1024 and len(own) <= 3 and (own.astype(float) ** 2).sum() <= 600_000
        order = np.argsort(offsets[bins == name])
        assert (np.cumsum(own[order]) - own[order] == offsets[bins == name][order]).all()
    loose, _ = packing.best_fit(lengths, (1024.0, 1024.0, 1024.0**2), (1.0, 0.25, 0.25), rule)
    assert loose.max() + 1 <= 1.02 * lengths.sum() / 1024 + 1


def test_sequences_hold_the_ids(spark, documents, odd_rows):
    found = packing.pieces(documents(odd_rows), BPE, with_ids=True)
    built = packing.sequences(packing.pack(found), found).collect()
    total = sum(len(encoded(text)) for _, text in odd_rows)
    assert sum(len(r.ids) // 4 for r in built) == total and all(len(r.ids) <= 4096 for r in built)


# sharding


def test_lookup_table_is_even_and_moves_little():
    names = sharding.shard_names(16)
    full = sharding.lookup_table(names, 1009)
    counts = collections.Counter(full)
    assert set(full) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    less = sharding.lookup_table(names[:-1], 1009)
    kept = [(a, b) for a, b in zip(full, less, strict=True) if a != 15]
    assert sum(a != b for a, b in kept) < 0.2 * len(kept)
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1008)


def test_placement(spark, documents, odd_rows):
    placed = sharding.place(documents(odd_rows), "doc_id", sharding.shard_names(4), 101).collect()
    slots = sharding.lookup_table(sharding.shard_names(4), 101)
    assert len(placed) == len(odd_rows)
    for row in placed:
        key = "null" if row.doc_id is None else str(row.doc_id)
        assert row.slot == int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101 and row.shard == slots[row.slot]
    hot = sharding.place(documents([(n, "x") for n in range(400)]), "source", sharding.shard_names(4), 101, ("doc_id",))
    assert hot.select("shard").distinct().count() == 4


# quality rules


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[n : n + 5]) for n in range(len(words) - 4)]
    count = collections.Counter(windows)
    covered = {n + k for n, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_statistics_match_brute_force(spark, documents, odd_rows):
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{FOLDER}/documents.parquet'").fetchall()]
    rows = odd_rows + [(100 + n, text) for n, text in enumerate(texts)] + [(50, "a b c d e a b c d e"), (51, "x " * 4000)]
    got = decision_list.judge(documents(rows), [])
    found = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got.collect())
    want = collections.Counter()
    for key, text in rows:
        counts = brute_counts(text)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        want[(key, *counts, failed, not failed)] += 1
    assert found == want


def test_rules_cover_and_prune(spark):
    rng = np.random.default_rng(3)
    values = np.zeros((3000, len(decision_list.RATIOS)))
    values[:, 2], values[:, 5] = rng.random(3000), rng.random(3000)
    bad = ((values[:, 2] > 0.7) & (values[:, 5] > 0.5)) | (values[:, 2] < 0.1)
    rules = decision_list.learn(values, bad, np.ones(3000))
    judged = np.zeros(3000, bool)
    for rule in rules:
        judged |= decision_list._covers(rule, values)
    assert (judged == bad).mean() > 0.97 and all(len(rule) <= decision_list.MAX_LITERALS for rule in rules)
    assert decision_list.learn(values[:0], bad[:0], np.ones(0)) == []
    assert len(decision_list.described(rules)) == len(rules)


def test_a_filter_on_verdicts_plans(spark):
    docs = table(spark, FOLDER, "documents")
    rules = decision_list.fit(docs, table(spark, FOLDER, "labels"))
    kept = decision_list.judge(docs, rules).filter("kept AND n_words > 3").count()
    assert 0 < kept < docs.count()


# language


def test_language_held_out(spark):
    got = queries.QUERIES["op4_language_id"](spark, "/root/testdata/sf0.01")
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.96
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, documents, odd_rows, said):
    found = {r.doc_id: r for r in language.identify(documents(odd_rows), None).collect()}
    assert {r.lang_pred for r in found.values()} == {"und"}
    rng = random.Random(1)
    docs = documents([(n, ("the and with " if n % 2 else "der und mit ") * 30 + said(rng, 5)) for n in range(60)])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    network = language.fit(docs, F.lit(True))
    got = {r.doc_id: r for r in language.identify(documents(odd_rows), network).collect()}
    assert {k for k, r in got.items() if r.lang_pred == "und"} == {1, 2, 3, 4}
    right = language.identify(docs, network).join(docs.select("doc_id", "lang"), "doc_id")
    assert right.filter("lang <> lang_pred").count() == 0
    assert language.accepted(documents(odd_rows), network).columns == CLASHING
    assert language.fit(docs.limit(0), F.lit(True)) is None


def test_lookup_tables_equal_the_convolution():
    rng = np.random.default_rng(5)
    f = language.FILTERS
    network = language.Network(
        ("a", "b"), tuple(rng.normal(size=(w, 256, f)) for w in language.WIDTHS), rng.normal(size=3 * f), rng.normal(size=(3 * f, 2)), np.zeros(2)
    )
    found = rng.integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    want = np.zeros((5, 3 * f))
    for row in range(5):
        for at, w in enumerate(language.WIDTHS):
            sums = [sum(network.filters[at][j][found[row, p + j]] for j in range(w)) for p in range(language.WINDOW - w + 1)]
            want[row, at * f : (at + 1) * f] = np.maximum(np.max(sums, axis=0) + network.bias[at * f : (at + 1) * f], 0)
    assert np.allclose(language.Scorer(network).pooled(found), want, atol=1e-4)


# quality classifier


def test_ordinal_order_and_accuracy(spark):
    rng = np.random.default_rng(8)
    row, feature, value, grades = [], [], [], []
    for n in range(600):
        grade = n % 3
        marks = rng.integers(0, 40, 30) + 40 * grade
        row += [n] * 30
        feature += marks.tolist()
        value += [0.3] * 30
        grades.append(grade)
    model = ordinal.train(np.array(row), np.array(feature), np.array(value), np.array(grades), np.ones(600), 3)
    score = np.bincount(row, weights=np.array(value) * model.weights[np.array(feature)], minlength=600)
    tails = model.tails(score)
    assert (np.diff(model.thresholds) > 0).all() and (tails[:, 0] >= tails[:, 1]).all()
    assert ((tails > 0.5).sum(axis=1) == np.array(grades)).mean() > 0.95
    got = queries.QUERIES["op5_quality_classifier"](spark, "/root/testdata/sf0.01")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    rows = got.join(labels, "doc_id").collect()
    assert sum((r.quality == 1) == r.accepted for r in rows) / len(rows) > 0.95


def test_ordinal_gradient():
    """One step of the fit lowers the loss along its own direction: the ratings are recovered better than by chance."""
    rng = np.random.default_rng(2)
    row, feature = np.repeat(np.arange(90), 4), rng.integers(0, 50, 360)
    grades = (np.bincount(row, weights=(feature > 25), minlength=90) > 2).astype(int)
    model = ordinal.train(row, feature, np.full(360, 0.5), grades, np.ones(90), 2)
    score = np.bincount(row, weights=0.5 * model.weights[feature], minlength=90)
    assert ((model.tails(score)[:, 0] > 0.5) == grades).mean() > 0.95


def test_ordinal_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    empty = spark.createDataFrame([], "doc_id long, grade int")
    model = ordinal.fit(docs, empty, 3)
    assert ordinal.accepted(docs, model).count() == len(odd_rows)
    scored = ordinal.score(docs, model).collect()
    assert len(scored) == len(odd_rows) and all(len(r.tail) == 2 for r in scored)
    assert ordinal.score(docs.limit(0), model).count() == 0


# pages


def test_page_parts():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body>"
        "<nav><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul></nav><div class='ad'>Buy now.</div>"
        "<article><h1>Tea &amp; milk</h1><p>First  line\n of <b>text<br>here.<p>Second &lt;b&gt; one, which is long enough.</p>"
        "<p>Third paragraph with <a href='/x'>a link</a> inside it.</p></article>"
        "<section class='comments'><p>Nice one, thanks.</p></section><footer>&copy; me</footer></body></html>"
    )
    text = page_text.extract([page], page_text.trained())[0]
    assert text == "Tea & milk\n\nFirst line of text here.\n\nSecond <b> one, which is long enough.\n\nThird paragraph with a link inside it."


def test_held_out_layouts():
    model = page_text.trained()
    wrong = total = 0
    for page, mark in page_text.labelled_pages(80, seed=901):
        got = set(page_text.extract([page], model)[0].split("\n\n")) - {""}
        want = {t for t in page_text.parse(page).text if t and mark in t}
        wrong += len(got ^ want)
        total += len(got | want)
    assert wrong / total < 0.08


def test_messages_equal_enumeration():
    tree = page_text.parse("<div class='nav'><p>One two.</p></div><article><p>Three four five.</p></article>")
    rng = np.random.default_rng(4)
    names = sorted({x for n in range(len(tree.tag)) for x in page_text.node_features(tree, n)})
    model = page_text.Model({x: n for n, x in enumerate(names)}, rng.normal(size=len(names)), rng.normal(size=(2, 2, 2)))
    got, _ = page_text.Forest([tree], model.features).marginals(model)
    n = len(tree.tag)
    weight, each = 0.0, np.zeros(n)
    for code in range(2**n):
        state = [(code >> k) & 1 for k in range(n)]
        energy = sum(model.unary[model.features[x]] for k in range(n) if state[k] for x in page_text.node_features(tree, k))
        energy += sum(model.pair[int(tree.tag[k] == "#text"), state[tree.parent[k]], state[k]] for k in range(1, n))
        weight += np.exp(energy)
        each += np.exp(energy) * np.array(state)
    assert np.allclose(got, each / weight)


def test_pages_table(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>cut <b>off &am"), (3, None, "<p>cut <b>off &am"), (None, "u", "no tags"), (4, "u", "<"), (5, "u", "<article><p>Text.</p><p"), (6, "u", "<div>" * 3000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = page_text.main_text(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 5] == ["Text."] and [r.text for r in got if r.page_id == 1] == [""]


class Article(HTMLParser):
    """The blocks inside <article> of the given pages, read with the standard library alone."""

    BLOCKS = {"p", "h1", "h2", "h3", "h4", "li", "ul", "ol", "blockquote", "pre", "div", "table", "tr", "td", "article"}

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside = 0
        self.hidden = 0
        self.blocks = [""]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.hidden += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.blocks.append("")
        self.inside -= tag == "article"
        self.hidden -= tag in ("script", "style")

    def handle_data(self, data):
        if self.inside and not self.hidden:
            self.blocks[-1] += data

    def text(self):
        return "\n\n".join(t for t in (re.sub(r"\s+", " ", b).strip() for b in self.blocks) if t)


def test_each_page_equals_its_article(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    html = {r.page_id: r.html for r in pages.collect()}
    found = page_text.main_text(pages).collect()
    assert len(found) == len(html) and {r.page_id: r.text for r in found} == {n: Article(page or "").text() for n, page in html.items()}


LAYOUT = (
    "<html><body><nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>News</a></li><li><a href=/c>More</a></li></ul></nav><article>"
    "<h1>A title of it.</h1><p>First paragraph with several words in it, and more of them.</p>{}"
    "<p>Second paragraph, which has to stay whole and readable here.</p><p>Third one.</p></article><footer>&copy; all rights</footer></body></html>"
)


@pytest.mark.parametrize(
    ("part", "kept"),
    [
        ('<svg width="1"/>', ""), ('<svg><path d="M0"/>', ""), ("<svg><svg></svg></svg>", ""), ("<math/>", ""), ("<noscript>", ""), ("<select>", ""),
        ("<select><option>a<option>b", ""), ("<p>Take <select><option>one</select></p>", "Take"), ("<noscript><img src=x></noscript>", ""),
        ("<noscript><p>Please enable it now.</p></noscript>", ""), ("<template><p>Never shown to anyone.</p></template>", ""),
        ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be so for this sentence.</p>", "Let x=2 be so for this sentence."),
        ('<p>An icon <svg><title>no</title><path d=""/></svg> inside a sentence of words.</p>', "An icon inside a sentence of words."),
        ("<p>A drawing <svg><svg></svg><text>with words</text></svg> in it, and the rest of it.</p>", "A drawing with words in it, and the rest of it."),
    ],
)
def test_parts_that_are_not_closed_take_nothing_along(part, kept):
    blocks = ["A title of it.", "First paragraph with several words in it, and more of them.", kept, "Second paragraph, which has to stay whole and readable here.", "Third one."]
    assert page_text.extract([LAYOUT.format(part)], page_text.trained())[0] == "\n\n".join(b for b in blocks if b)


# toxicity


def test_toxicity_held_out(spark):
    got = queries.QUERIES["op7_toxicity"](spark, "/root/testdata/sf0.1")
    rows = got.join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").filter("held_out").collect()
    hits = sum(r.toxic == 1 and r.predicted == 1 for r in rows)
    assert hits / sum(r.toxic for r in rows) > 0.85 and hits / sum(r.predicted for r in rows) > 0.9


def test_grammar_contexts():
    reader = toxicity.Reader((("idiot", True, 5.0), ("scum", False, 5.0)))
    at = lambda text: [n for n, x in enumerate(reader.features(text)[: toxicity.CONTEXTS]) if x]
    assert at("such an idiot there.") == [toxicity.PLAIN] and at("not an idiot there.") == [toxicity.DENIED] and at("he said idiot") == [toxicity.REPORTED]
    assert at("you are an idiot") == [toxicity.AIMED] and at("scumbag") == [0] and at("idiotic") == [] and at("no. idiot") == [0]
    # a target counts on either side, and threats in any form
    for text in ("they say you must kill", "I will kill you", "kill you", "I will hurt them", "she stabbed him", "destroying your people", "ich töte dich", "brûler vous"):
        assert at(text) == [toxicity.THREATENED], text
    assert at("idiot, they left") == [toxicity.PLAIN] and at("idiot like you") == [toxicity.AIMED]
    assert at("kill") == [toxicity.VIOLENT] and at("never kill you") == [toxicity.VIOLENT] and at("he said kill you") == [toxicity.VIOLENT]
    assert at("the skill of you") == [] and at("killjoys of you") == [] and at("diesen du") == []
    assert reader.features("") == [0.0] * toxicity.FEATURES


def test_machines_equal_a_naive_reading():
    rng = random.Random(6)
    forward, back = toxicity.grammar(), toxicity.backward()
    T = toxicity
    for _ in range(2000):
        symbols = [rng.choice([T.INSULT, T.THREAT, T.TARGET, T.NEGATION, T.REPORT, T.OTHER, T.OTHER]) for _ in range(rng.randint(0, 14))]
        weights = [float(rng.randint(1, 5)) if s == T.INSULT else 0.0 for s in symbols]
        want = [0.0] * T.CONTEXTS
        for n, s in enumerate(symbols):
            aimed = T.TARGET in symbols[max(0, n - T.NEAR) : n + T.NEAR + 1]
            negated = T.NEGATION in symbols[max(0, n - T.NEGATED) : n]
            reported = T.REPORT in symbols[:n]
            if s == T.INSULT:
                want[T.DENIED if negated else T.REPORTED if reported else T.AIMED if aimed else T.PLAIN] += weights[n]
            elif s == T.THREAT:
                want[T.THREATENED if aimed and not negated and not reported else T.VIOLENT] += 1
        assert T.contexts(symbols, weights, forward, back) == want


def test_toxicity_without_documents_or_labels(spark, documents):
    labels = spark.createDataFrame([(n, n % 2) for n in range(60)], "doc_id long, toxic int")
    none = documents([])
    model = toxicity.fit(none, labels)
    assert model is None and toxicity.score(none, model).count() == 0
    others = documents([(n + 1000, "some words") for n in range(5)])
    assert toxicity.fit(others, labels) is None
    assert toxicity.fit(documents([(0, "x"), (2, "y")]), labels) is None


def test_samples_are_bounded_under_one_hot_id(spark):
    rows = [(7, f"text {n}", "a") for n in range(3000)] + [(n + 100, f"t{n}", "ab"[n % 2]) for n in range(6000)] + [(None, "null", "a")] * 500
    frame = spark.createDataFrame(rows, "id long, text string, label string")
    drawn = common.balanced_sample(frame, "id", "label", 200)
    sizes = {r.label: r["count"] for r in drawn.groupBy("label").count().collect()}
    assert sizes["a"] <= 260 and 140 <= sizes["b"] <= 260
    assert drawn.count() == drawn.distinct().count()
    everything = common.one_of_each(frame, ["id", "label"], "text")
    assert everything.filter("id = 7").count() == 1 and everything.filter("id IS NULL").count() == 1 and everything.count() == 6002


def test_toxicity_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0}
    assert toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None
    labels = spark.createDataFrame([(n, n % 2) for n in range(60)] + [(None, None)], "doc_id long, toxic int")
    small = documents([(n, f"some {'dolt' if n % 2 else 'person'} came by here {n}") for n in range(60)])
    model = toxicity.fit(small, labels)
    scored = {r.doc_id: r.score for r in toxicity.score(small, model).collect()}
    assert all((scored[n] > 0.5) == bool(n % 2) for n in range(60))
    assert toxicity.score(docs, model).count() == len(odd_rows)


# decontamination and chat against SQL


@pytest.fixture(scope="module")
def duck():
    return duckdb.connect()


def same(spark_rows, sql_rows):
    return sorted(map(repr, map(tuple, spark_rows))) == sorted(map(repr, sql_rows))


def test_contamination_matches_sql(spark, documents, duck, odd_rows, said):
    rng = random.Random(6)
    items = [(n, said(rng, rng.choice([3, 12, 13, 14, 40]))) for n in range(12)] + [(20, None), (21, "!!"), (22, "the the the the the the the the the the the the the the")]
    items.append((1, items[1][1]))
    docs = list(odd_rows) + [(30 + n, said(rng, 20) + " " + text.upper() + ", " + said(rng, 20)) for n, (_, text) in enumerate(items) if text]
    docs += [(60, " ".join(["the"] * 300)), (61, "The THE " * 8), (62, " ".join(text or "" for _, text in items)), (63, items[3][1] + " " + items[3][1])]
    docs.append(docs[-1])
    frame, tests = documents(docs), spark.createDataFrame([(*r, "k") for r in items], "item_id long, text string, k_id string")
    got = decontamination.contamination(frame, tests).drop("k_id", "k_text")
    duck.register("documents", frame.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    duck.register("benchmark", tests.select("item_id", "text").toPandas())
    assert same(got.collect(), duck.execute(decontamination.ORACLE_SQL).fetchall())
    clean = decontamination.clean(frame, tests)
    assert clean.columns == frame.columns and clean.count() == got.filter("NOT contaminated").count()
    assert decontamination.contamination(frame, tests.limit(0)).filter("n_hit > 0").count() == 0
    assert decontamination.contamination(frame.limit(0), tests).count() == 0


def test_contamination_by_items_without_id(spark, documents, duck, said):
    rng = random.Random(19)
    one, two, three, four = (said(rng, n) for n in (20, 14, 5, 30))
    items = [(None, one), (None, two), (None, two), (None, three), (4, three), (4, one), (5, four)]
    docs = [(1, one), (2, two + " " + said(rng, 9)), (3, three), (4, said(rng, 40)), (None, one + " " + two), (5, one + " " + four), (6, four)]
    frame, tests = documents(docs), spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(frame, tests).drop("k_id", "k_text")
    duck.register("documents", frame.select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    duck.register("benchmark", tests.toPandas().astype({"item_id": "Int64"}))
    assert same(got.collect(), duck.execute(decontamination.ORACLE_SQL).fetchall())
    assert [r.doc_id for r in decontamination.clean(frame, tests).collect()] == [4]


def test_proximity(spark, documents):
    docs = documents([(1, "zeta one two eta"), (2, "zeta " + "x " * 60 + "eta"), (3, "eta zeta")])
    tests = spark.createDataFrame([(9, "eta zeta")], "item_id long, text string")
    assert {r.k_id for r in decontamination.proximity_matches(docs, tests, span=20).collect()} == {"1", "3"}


def test_chat_round_trip(spark, duck):
    rows = [
        (1, 0, "user", "hi <|end|> & [x] &lt;"), (1, 1, "assistant", "<|turn|>assistant<|says|>"), (1, 1, "assistant", "<|turn|>assistant<|says|>"),
        (2, None, None, None), (2, 3, "assistant", None), (None, 0, "system", "&amp;"), (3, 0, "user", "é" * 50_000), (4, 5, "assistant", "</s>[INST]"), (4, 5, "user", "tie"),
        # ties whose order would turn around if they were escaped first
        (5, 0, "user", "<a"), (5, 0, "user", "0a"), (5, 0, "user", "&"), (5, 0, "user", "z"),
    ]
    said_ = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_chat(said_.withColumn("parts", chat.text_part(F.col("text"))))
    got = chat.digest(chat.read_back(made))
    duck.register("conversations", said_.drop("formatted").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = [r for r in duck.execute(chat.ORACLE_SQL).fetchall() if r[0] != -1]
    assert same(got.collect(), want)
    assert chat.digest(chat.read_back(chat.format_chat(said_.limit(0).withColumn("parts", chat.text_part(F.col("text")))))).count() == 0


def test_chat_parts(spark):
    parts = [("text", "see <this> ", None, None), ("image", None, "a.png", 85.0), ("audio", None, "b.wav", 1.5), ("text", " and ", None, None), ("document", None, "c.pdf", None)]
    frame = spark.createDataFrame([(1, 0, "user", parts)], "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,units:double>>")
    row = chat.format_chat(frame).first()
    assert row.formatted == "<|turn|>user<|says|>see &lt;this> <|image:1|><|audio:2|> and <|document:3|><|end|>"
    assert [tuple(a) for a in row.attachments] == [(1, "image", "a.png", 87), (2, "audio", "b.wav", 40), (3, "document", "c.pdf", 2)]
    assert row.n_attachment_tokens == 129


# near duplicates


def weighted_classes(rows, least):
    """Brute force with the idf of every shingle 1: counts alone."""
    bags = {}
    for key, text in rows:
        w = words_of(text)
        if w:
            bags[key] = collections.Counter(tuple(w[n : n + 5]) for n in range(max(1, len(w) - 4)))
    root = {key: key for key in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(bags)
    for n, a in enumerate(keys):
        for b in keys[n + 1 :]:
            shared = sum(min(c, bags[b][s]) for s, c in bags[a].items() if s in bags[b])
            if shared >= least * (sum(bags[a].values()) + sum(bags[b].values()) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {key: find(key) for key in keys}


def test_near_duplicates_match_brute_force(spark, documents, said):
    rng = random.Random(11)
    rows = []
    for base in range(25):
        text = said(rng, rng.randint(60, 300)).split()
        for copy in range(rng.randint(1, 6)):
            edited = list(text)
            # clear of the threshold on both sides: no edit or one, or many
            for _ in range(rng.choice([0, 0, 1, len(text) // 8])):
                edited[rng.randrange(len(edited))] = "edit" + str(rng.random())[2:8]
            rows.append((len(rows), " ".join(edited)))
    rows += [(len(rows), "one two"), (len(rows) + 1, "One, two!"), (len(rows) + 2, "one two three")]
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(documents(rows)).collect()}
    assert got == weighted_classes(rows, 0.8)


def test_one_large_group_of_near_copies(spark, documents, said):
    rng = random.Random(13)
    text = said(rng, 200).split()
    rows = []
    for n in range(700):
        edited = list(text)
        edited[rng.randrange(200)] = f"v{n}"
        rows.append((n, " ".join(edited)))
    rows += [(1000 + n, said(rng, 100)) for n in range(50)]
    got = {r.doc_id: r.class_id for r in near_duplicates.classes(documents(rows)).collect()}
    assert {got[n] for n in range(700)} == {0} and all(got[1000 + n] == 1000 + n for n in range(50))


def test_near_duplicates_odd_rows(spark, documents, odd_rows):
    docs = documents(odd_rows)
    got = [(r.doc_id, r.class_id) for r in near_duplicates.classes(docs).collect()]
    assert sorted(map(repr, got)) == sorted(repr((k, k)) for k, _ in odd_rows)
    left = near_duplicates.deduplicated(docs)
    assert left.columns == docs.columns and left.count() == len(odd_rows) - 1
    assert near_duplicates.classes(docs.limit(0)).count() == 0 and near_duplicates.deduplicated(docs.limit(0)).count() == 0


def test_near_duplicates_null_and_shared_ids(spark, documents, said):
    rng = random.Random(17)
    one, two, three, four, five = (said(rng, 80) for _ in range(5))
    rows = [(None, one), (None, two), (None, two), (None, three), (7, three), (7, four), (3, five), (8, five), (8, one + " "), (7, "!")]
    docs = documents(rows)
    left = sorted((r.doc_id or 0, r.text) for r in near_duplicates.deduplicated(docs).collect())
    assert left == sorted([(8, one + " "), (0, two), (7, three), (7, four), (3, five), (7, "!")])
    of_root = collections.defaultdict(set)
    for r in near_duplicates.classes(docs).collect():
        of_root[r.root].add((r.doc_id, r.class_id, r.k_text))
    assert len(of_root) == 6
    ids = {frozenset((d, c) for d, c, _ in rows) for root, rows in of_root.items() if root}
    assert ids == {frozenset({(None, 8), (8, 8)}), frozenset({(None, None)}), frozenset({(None, 7), (7, 7)}), frozenset({(7, 7)}), frozenset({(3, 3), (8, 3)})}


def test_forest_is_exact():
    rng = np.random.default_rng(9)
    idf = np.tile(np.linspace(1, 1.5, 1 << near_duplicates.SKETCH_BITS), near_duplicates.SKETCH_ROWS).astype(np.float32)
    pool = rng.integers(0, 1 << 32, 60).astype(np.uint32)
    lists = [np.sort(rng.choice(pool, 40)).astype(np.uint32) for _ in range(12)]
    lists += [lists[0][:-1], np.sort(np.append(lists[1], 7)).astype(np.uint32)]
    weigh = lambda s: float(near_duplicates.idf_of(idf, np.array([s], np.uint32))[0])
    linked = set()
    for a in range(14):
        for b in range(a + 1, 14):
            x, y = collections.Counter(lists[a].tolist()), collections.Counter(lists[b].tolist())
            low = sum(min(x[s], y[s]) * weigh(s) for s in x)
            high = sum(max(x[s], y[s]) * weigh(s) for s in x | y)
            if low >= 0.6 * high:
                linked.add((a, b))
    every = np.ones(14, bool)
    found = near_duplicates.forest(lists, idf, every, every, 0.6)
    assert set(found) <= linked

    def groups(pairs):
        root = list(range(14))
        for a, b in pairs:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    assert groups(found) == groups(linked)


def test_idf_follows_exact_shares_at_any_size(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    texts = [r.text for r in docs.collect()]
    held = collections.Counter()
    for text in texts:
        _, _, data, offsets = next(iter(common.text_blocks(pa.array([text], pa.string()))))
        held.update(set((near_duplicates.shingles_of(data, offsets)[1] >> np.uint64(16)).tolist()))
    short = np.array(sorted(held), np.uint64)
    share = np.clip(np.array([held[s] for s in short.tolist()]) / len(texts), near_duplicates.RARE, 1.0)
    want = 1 + 0.5 * np.log(share) / np.log(near_duplicates.RARE)
    once = near_duplicates.idf_of(near_duplicates.idf_table(docs), short)
    assert np.abs(once - want).mean() < 0.005 and np.quantile(np.abs(once - want), 0.99) < 0.05
    # the same documents ten times over have the same shares
    copied = docs.select("text", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("doc_id"))
    assert np.abs(near_duplicates.idf_of(near_duplicates.idf_table(copied), short) - once).max() < 1e-5


def test_components(spark):
    edges = [(f"{n:04d}", f"{n + 1:04d}") for n in range(60)] + [("z1", "z2"), ("z3", "z2"), ("z3", "z1")]
    got = {r.node: r.root for r in near_duplicates.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {**{f"{n:04d}": "0000" for n in range(61)}, "z1": "z1", "z2": "z1", "z3": "z1"}


# folds, registration


def test_folds(spark):
    rows = spark.range(50).select("id", crc_mod(F.col("id"), 3).alias("fold")).collect()
    assert all(r.fold == zlib.crc32(str(r.id).encode()) % 3 for r in rows)


@pytest.mark.parametrize("key", sorted(queries.ORACLES))
def test_queries_match_sql(spark, key):
    from check_oracles import compare

    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    import check_oracles

    check_oracles.catalog.QUERIES.setdefault(key, queries.QUERIES[key])
    check_oracles.catalog.ORACLES.setdefault(key, queries.ORACLES[key])
    try:
        verdict, _ = compare(spark, connection, FOLDER, key)
    finally:
        check_oracles.catalog.QUERIES.pop(key)
        check_oracles.catalog.ORACLES.pop(key)
    assert verdict.startswith("ok"), verdict
