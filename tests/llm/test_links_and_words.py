"""Url verdicts, hard negatives and spelling variants against brute force, with the odd rows of each."""

import collections
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ballast.llm import hard_negatives, redirects, spelling
from ballast.llm.common import lookup
from ballast.llm.redirects import RULES, Rule

# url verdicts

PAGE = "page_id long, url string, html string, host string, rule string, node long"


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", "y", 1) for r in rows], PAGE)


def canonical(target):
    return f'<html><head><link href="{target}" rel="canonical"></head>'


def test_targets_read_links_as_browsers_do():
    read = redirects.targets
    assert read("http://a.b/c/d", "<LINK REL='x Canonical' HREF=../e?x=1&amp;y=2#f>") == ["http://a.b/e?x=1&y=2#f"]
    assert read("http://a.b/", "<!-- <link rel=canonical href=http://no/> --><script>'<link rel=canonical href=http://no/>'</script>") == []
    assert read("http://a.b/", '<meta content="0;URL=\'//c.d/e\'" http-equiv=Refresh>') == ["http://c.d/e"]
    assert read("http://a.b/", '<base href="http://z.y/q/"><link rel=canonical href=r>') == ["http://z.y/q/r"]
    assert read("http://a.b/", "<link rel=canonical href='mailto:x@y'><meta http-equiv=refresh content=5><link rel=canonical>") == []
    assert redirects.refresh_target("3, http://x.y/") == "http://x.y/"


def test_rules_and_parts(spark, pages):
    urls = [
        None, "", "no scheme", "x://", "HTTP://WWW.Example.ORG?q#f", "http://example.org/en/12", "http://a.example.org/en/1", "http://notexample.org/es/1",
        "https://example.org/es/?x", "http://b.com/fr/1", "http://b.com/de/://c.org/fr/", "http://com/de/x#y", "http://x.net/a", "http://É.com/fr/\n2",
    ]
    got = {r.page_id: r for r in redirects.judge(pages([(n, u, None) for n, u in enumerate(urls)]), RULES).collect()}
    for n, url in enumerate(urls):
        rest = url.partition("://")[2] if url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.translate({c: c + 32 for c in range(65, 91)})
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        found = got[n]
        assert (found.host, found.path, found.rule) == (host, path, best and best.name)
        assert found.verdict == (best.verdict if best else "allow")
    clash = [Rule("block", "a.b", "/c"), Rule("allow", "a.b", "/c")]
    assert redirects.judge(pages([(1, "http://a.b/c", None)]), clash).first().verdict == "allow"


def test_blocks_reach_aliases_but_not_allowed_urls(pages):
    rules = [Rule("block", "bad.net", "/"), Rule("allow", "good.net", "/")]
    rows = [
        (1, "http://a.net/1", canonical("http://b.net/")), (2, "http://B.net", canonical("http://c.net/x#top")),
        (3, "http://c.net/x", '<meta http-equiv="refresh" content="0; url=http://bad.net/q">'),
        (4, "http://good.net/y", canonical("http://c.net/x")), (5, "http://d.net/", canonical("http://e.net/")),
        (6, "http://e.net/", None), (7, "http://bad.net/z", None), (8, "http://a.net/1", None), (8, "http://a.net/1", None), (None, "http://c.net/x", ""),
    ]
    got = sorted((r.page_id or 0, r.verdict, r.by) for r in redirects.judge(pages(rows), rules).collect())
    assert got == [
        (0, "block", "alias"), (1, "block", "alias"), (2, "block", "alias"), (3, "block", "alias"), (4, "allow", "rule"),
        (5, "allow", "none"), (6, "allow", "none"), (7, "block", "rule"), (8, "block", "alias"), (8, "block", "alias"),
    ]
    assert redirects.judge(pages([]), rules).count() == 0


def test_components_with_chains_hubs_and_repeats(spark):
    rng = random.Random(3)
    pairs = [(n, n + 1) for n in range(60)] + [(100 + rng.randrange(900), 100) for _ in range(300)] + [(2000 + rng.randrange(80), 2000 + rng.randrange(80)) for _ in range(60)]
    pairs += pairs[:20] + [(5000, 5000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {(x, find(x)) for x in root if x != 5000}
    edges = spark.createDataFrame(pairs, "a long, b long").select(F.col("a").cast("decimal(38,0)"), F.col("b").cast("decimal(38,0)"))
    assert {(int(r.node), int(r.root)) for r in redirects.components(edges).collect()} == want


def test_lookup_of_hot_and_null_keys(spark):
    facts = spark.createDataFrame([(n, None if n % 7 == 0 else 1 if n % 2 else n) for n in range(2000)], "n long, k long")
    known = spark.createDataFrame([(k, k * 10) for k in range(0, 1000)], "k long, v long")
    got = {r.n: r.v for r in lookup(facts, "k", known).collect()}
    assert got == {n: None if n % 7 == 0 else 10 if n % 2 else n * 10 if n < 1000 else None for n in range(2000)}


# hard negatives


def brute_negatives(rows, every=50):
    held = []
    for uid, (key, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        held.append((uid, key, label, [math.floor(256 * int(x)) if abs(x) > 1e15 else math.floor(256 * x) for x in vector]))
    out = []
    for uid, key, label, vector in held:
        if key is None or key % every:
            continue
        scored = [
            (min(max(sum(a * b for a, b in zip(vector, v)), -(2**63) + 1), 2**63 - 1), k, own == label)
            for u, k, own, v in held if u != uid and len(v) == len(vector)
        ]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        negatives = [s for s in scored if not s[2]]
        for score, positive, _ in [s for s in scored if s[2]][:5]:
            fits = [n for n in negatives if 50 * score <= 100 * n[0] <= 95 * score][:3]
            out += [(key, positive, rank, n[1], score, n[0]) for rank, n in enumerate(fits, 1)]
    return sorted(out, key=str)


def mined(spark, rows, **options):
    frame = spark.createDataFrame([(k, v, n, 1.0, "x") for k, v, n in rows], "vec_id long, embedding array<double>, label int, score double, uid string")
    return sorted((tuple(r) for r in hard_negatives.mine(frame, **options).collect()), key=str)


def test_negatives_equal_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(n, [rng.gauss(0.1, 0.4) for _ in range(6)], rng.randrange(3)) for n in range(300)]
    rows += [(n, [rng.choice([0.0, 0.25, 0.5]) for _ in range(6)], rng.randrange(3)) for n in range(300, 500)]
    rows += [rows[350]] * 3 + [(None, [0.5] * 6, 1), (None, [0.25] * 6, 2), (50, [0.1] * 6, 1), (-100, [0.3] * 6, 2)]
    rows += [(600, None, 1), (650, [0.1] * 6, None), (700, [float("nan")] * 6, 1), (750, [float("inf")] + [0.0] * 5, 1), (800, [None] * 6, 0), (850, [], 0), (851, [], 0), (852, [], 1), (900, [1.0], 2), (901, [0.8], 1), (902, [1.0], 2)]
    want = brute_negatives(rows)
    assert mined(spark, rows) == want and len(want) > 50
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    assert mined(spark, rows) == want


def test_exact_with_large_components_and_no_rows(spark):
    rows = [(0, [1e9, 3.0], 1), (1, [1e9, 2.0], 1), (2, [9e8, 1.0], 2), (3, [7e8, 1.5], 3), (4, [1e300, 1.0], 2), (5, [-1e18, 4.0], 1)]
    assert mined(spark, rows) == brute_negatives(rows)
    assert mined(spark, []) == [] and mined(spark, [(50, [0.1], 1)]) == []


def test_keys_sort_as_their_parts():
    rng = random.Random(5)
    parts = [((rng.randrange(3), rng.choice([-50, 0, 50])), rng.choice([-(2**62), -3, 0, 7, 2**62]), rng.randrange(2), rng.choice([None, -9, 0, 2**60])) for _ in range(300)]
    order = lambda p: (p[0], -p[1], p[2], p[3] is None, p[3] or 0)
    packed = sorted(hard_negatives.pack_key(*p) for p in parts)
    assert [hard_negatives.unpack_key(k) for k in packed] == sorted(parts, key=order)
    assert hard_negatives.window(10) == (5, 9) and hard_negatives.window(-1) == (0, -1) and hard_negatives.window(0) == (0, 0)


# spelling variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    cuts = collections.defaultdict(set)
    for w in words:
        for i in range(len(w)):
            cuts[w[:i] + w[i + 1 :]].add(w)
        cuts[w].add(w)
    beside = collections.defaultdict(set)
    for group in cuts.values():
        for a in group:
            beside[a] |= {b for b in group if near(a, b)}
    form = {}
    for w, n in words.items():
        best = min(beside[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(beside[w]), words[form[w]] if w in form else None) for w, n in words.items())


def rows(frame):
    return sorted((tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()))


@pytest.mark.parametrize("letters", ["ab", "abc"])
def test_composition_accepts_each_pair_once(letters):
    rng = random.Random(1)
    for _ in range(400):
        base = rng.randint(0, 5)
        words = sorted({"".join(rng.choice(letters) for _ in range(base + rng.randint(0, 1))) for _ in range(rng.randint(0, 30))})
        want = {(a, b) for a in words for b in words if len(a) == base and near(a, b) and (len(b) == base + 1 or len(b) == base and a < b)}
        got = list(spelling.compose(words, base, False))
        assert len(got) == len(set(got)) and set(got) == want
        got = list(spelling.compose(words, base, True))
        assert len(got) == len(set(got)) and set(got) == {p for p in want if len(p[1]) == base or p[1][:base] != p[0]}


def test_acceptor_is_minimal():
    acceptor = spelling.Acceptor(sorted(["tap", "taps", "top", "tops"]))
    assert len(acceptor.arcs) == 5
    assert spelling.Acceptor([]).arcs == [{}] and spelling.Acceptor([""]).final == [True]


def test_pairs_whatever_the_limit(spark):
    rng = random.Random(7)
    words = {"".join(rng.choice("abß") for _ in range(rng.randint(1, 9))) for _ in range(700)} | {"q" * 400, "q" * 401, "q" * 200 + "r" + "q" * 200}
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n long").repartition(5)
    want = {tuple(sorted((a, b))) for a in words for b in words if a < b and abs(len(a) - len(b)) < 2 and near(a, b)}
    for limit in (100_000, 20, 1):
        got = [tuple(sorted((r.one, r.two))) for r in spelling.near_pairs(frame, limit=limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_forms_chain_and_ties(spark):
    words = {"abcdefg": 1, "abcdefh": 10, "abcdeih": 100, "abcdejh": 100, "zbcdeih": 1000, "abcdefgx": 9, "unrelated": 5}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows(spelling.variants(frame)) == brute_variants(words)


def test_variants_of_documents(spark, documents, odd_rows, said):
    rng = random.Random(8)
    vocabulary = [said(rng, 1) for _ in range(300)] + ["straßenbahn", "Ärgerliches", "ÄRGERLICHES", "abcdefghijk"]
    texts = [(n, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 120)))) for n in range(200)]
    texts = texts + odd_rows + texts[:10]
    counts = collections.Counter()
    for key, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    words = {w: n for w, n in counts.items() if n >= 2}
    found = spelling.vocabulary(documents(texts))
    assert {r.word: r.n for r in found.collect()} == words and len(words) > 50
    assert rows(spelling.variants(found, spelling.LEAST_LENGTH)) == brute_variants(words)
    assert spelling.variants(spelling.vocabulary(documents([]))).count() == 0
