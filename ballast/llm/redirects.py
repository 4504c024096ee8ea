"""URL verdicts: rules by host and path, spread over redirect and canonical-link classes.

`judge` gives each page the verdict of the longest rule that fits its url. A url that no rule
fits takes the verdict of its aliases: `links` reads refresh redirects and canonical links from
the pages, `components` joins urls that such links connect into classes (distributed connected
components), and a class with a blocked url blocks those of its urls that no rule allows. An
explicit rule of the url itself always comes first, so an allowed alias of a blocked url stays.
Without a rule and without a blocked alias a url is allowed.

A url is the part before `#`, its host lower-cased. Links count on whole pages, in any
attribute order and quoting; comments, scripts and raw text do not count. Targets that are no
pages are judged by the rules like pages. Links that name no host (`mailto:`) are left out.

Null html has no links; a null url, or one without `://`, has an empty host and path, fits no
rule and is allowed. Repeated rows come back as often as they are there. An empty table gives
no rows. Only id, url and html are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import lookup, mapped, pinned


class Rule(NamedTuple):
    """A rule fits `host` and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def ruled(pages: DataFrame, rules: list[Rule], host: str = "host", path: str = "path") -> DataFrame:
    """`pages` with rule and its verdict (null if none fits): the longest wins, allow before block."""
    order = sorted(rules, key=lambda r: (-len(r.name), r.verdict != "allow", r.name))
    rule = F.lit(None).cast("string")
    verdict = F.lit(None).cast("string")
    for r in reversed(order):
        fits = ((F.col(host) == r.host) | F.col(host).endswith("." + r.host)) & F.col(path).startswith(r.path)
        rule = F.when(fits, r.name).otherwise(rule)
        verdict = F.when(fits, r.verdict).otherwise(verdict)
    return pages.withColumn("rule", rule).withColumn("ruled", verdict)


class _Links(HTMLParser):
    """Collects canonical and refresh targets and the base of a page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.base: str | None = None
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in ("link", "meta", "base"):
            return
        held: dict[str, str] = {}
        for name, value in attrs:
            held.setdefault(name, value or "")
        if tag == "base" and self.base is None and held.get("href"):
            self.base = held["href"].strip()
        elif tag == "link" and "canonical" in held.get("rel", "").lower().split() and held.get("href", "").strip():
            self.found.append(held["href"].strip())
        elif tag == "meta" and held.get("http-equiv", "").strip().lower() == "refresh":
            target = refresh_target(held.get("content", ""))
            if target:
                self.found.append(target)


def refresh_target(content: str) -> str:
    """The url of `5; url='...'`, empty if there is none."""
    rest = content.partition(";")[2].strip() or content.partition(",")[2].strip()
    if rest[:3].lower() == "url" and rest[3:].lstrip().startswith("="):
        rest = rest[3:].lstrip()[1:].strip()
    for quote in "'\"":
        if rest.startswith(quote):
            return rest[1:].partition(quote)[0].strip()
    return rest


def targets(url: str, html: str) -> list[str]:
    """Absolute urls to which a page redirects or which it names as canonical, without fragments."""
    reader = _Links()
    reader.feed(html)
    reader.close()
    found = []
    for link in reader.found:
        try:
            full = urljoin(urljoin(url, reader.base) if reader.base else url, link)
        except ValueError:
            continue
        if "://" in full:
            found.append(full)
    return found


def node_of(url: Column) -> Column:
    """A 126-bit number of the url without fragment, its scheme and host lower-cased; null without a host.

    Numbers, not texts, so that minima are hash aggregations.
    """
    bare = F.regexp_replace(url, r"(?s)#.*", "")
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?]*)", 1)
    lowered = F.concat(F.translate(head, _UPPER, _UPPER.lower()), F.substring(bare, F.char_length(head) + 1, F.char_length(bare)))
    # the root path is often left out
    full = F.when(F.char_length(bare) == F.char_length(head), F.concat(lowered, F.lit("/"))).otherwise(lowered)
    high, low = F.xxhash64(full), F.xxhash64(F.lit(1), full).bitwiseAND(F.lit((1 << 62) - 1))
    number = high.cast("decimal(20,0)") * F.lit(1 << 62).cast("decimal(19,0)") + low.cast("decimal(20,0)")
    return F.when(head != "", number.cast("decimal(38,0)"))


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """source, target: the urls of each redirect and canonical link, repeated if repeated."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str]] = []
            for source, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(source, target) for target in targets(source, page)]
            columns = list(zip(*out, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["source", "target"])

    # most pages have neither word and never leave the JVM
    named = pages.select(F.col(url).alias("url_"), F.col(html).alias("html_")).filter(
        F.col("url_").contains("://") & F.col("html_").rlike(r"(?i)canonical|refresh")
    )
    return mapped(named, work, "source string, target string")


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its class) of every node of `edges` (a, b).

    Each round hooks the root of every edge's end to the least root among the edges that leave
    it, then shortens all chains by one step, until nothing moves; rounds grow with the logarithm
    of the longest chain. A node with very many links is an ordinary key: minima combine before
    they are moved, and looking up its root goes through `lookup`.
    """
    edges = pinned(edges.filter(F.col("a") != F.col("b")).distinct())
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    parents = pinned(nodes.select("node", F.col("node").alias("root")))
    while not edges.isEmpty():
        # the edges between roots; those within a class are done
        for side in ("a", "b"):
            known = parents.select(F.col("node").alias(side), F.col("root").alias("root_"))
            edges = pinned(lookup(edges, side, known).select(F.col("root_").alias(side), "b" if side == "a" else "a"))
        edges = pinned(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        hooks = edges.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("to"))
        # chains of hooks go down, so they end; halve them until all point to ends
        hooks = pinned(hooks)
        while True:
            step = lookup(hooks, "to", hooks.select(F.col("root").alias("to"), F.col("to").alias("further")))
            hooks = pinned(step.select("root", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")))
            if hooks.filter("moved").isEmpty():
                break
            hooks = hooks.drop("moved")
        parents = pinned(lookup(parents, "root", hooks.drop("moved")).select("node", F.coalesce("to", "root").alias("root")))
    return parents


def blocked_aliases(edges: DataFrame, rules: list[Rule]) -> DataFrame:
    """node: the urls of every class in which a rule blocks a url; `edges` has source and target."""
    edges = pinned(edges.distinct().withColumn("a", node_of(F.col("source"))).withColumn("b", node_of(F.col("target"))))
    edges = edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    roots = components(edges.select("a", "b"))
    urls = edges.select(F.col("a").alias("node"), F.col("source").alias("url")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("target").alias("url"))
    )
    judged = ruled(urls.select("node", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    bad = judged.filter(F.col("ruled") == "block").select("node").distinct()
    classes = roots.join(bad, "node", "left_semi").select("root").distinct()
    # one row a class on the right: classes of any size are looked up without gathering them
    return pinned(
        lookup(pinned(roots), "root", classes.withColumn("bad", F.lit(True))).filter("bad").select("node")
    )


def judge(pages: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block) and how it came about (rule, alias or none)."""
    blocked = blocked_aliases(links(pages, url, html), rules)
    own = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url_")).select(
        "page_id", "url_", host_of(F.col("url_")).alias("host"), path_of(F.col("url_")).alias("path")
    )
    named = ruled(own, rules)
    if blocked.isEmpty():
        aliased = named.withColumn("bad", F.lit(False))
    else:
        open_ = pinned(named.filter(F.col("ruled").isNull()).withColumn("node", node_of(F.col("url_"))))
        aliased = lookup(open_, "node", blocked.withColumn("bad", F.lit(True))).drop("node").unionByName(
            named.filter(F.col("ruled").isNotNull()).withColumn("bad", F.lit(False))
        )
    alias = F.coalesce("bad", F.lit(False))
    return aliased.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(alias, "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("ruled").isNotNull(), "rule").when(alias, "alias").otherwise("none").alias("by"),
    )


#: The rules of the registered query.
RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]

#: Links of the plainest form only: double quotes, rel or http-equiv first, absolute urls.
ORACLE_SQL = r"""
WITH RECURSIVE rules(verdict, host, path) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
),
links AS (
  SELECT DISTINCT url AS source, unnest(
    regexp_extract_all(html, '<link rel="canonical" href="([a-z]+://[^"]*)"', 1)
    || regexp_extract_all(html, '<meta http-equiv="refresh" content="[0-9]+; *url=([a-z]+://[^"]*)"', 1)) AS target
  FROM pages
),
urls AS (
  SELECT url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, split_part(url, '#', 1) AS node
  FROM (SELECT url FROM pages UNION SELECT target FROM links)
),
ruled AS (
  SELECT u.url, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY u.url
),
near AS (
  SELECT split_part(source, '#', 1) AS a, split_part(target, '#', 1) AS b FROM links
  UNION SELECT split_part(target, '#', 1), split_part(source, '#', 1) FROM links
),
bad(node) AS (
  SELECT u.node FROM urls u JOIN ruled USING (url) WHERE ruled.verdict = 'block' AND u.node IN (SELECT a FROM near)
  UNION SELECT near.b FROM bad JOIN near ON near.a = bad.node
)
SELECT p.page_id, coalesce(u.host, '') AS host, coalesce(u.path, '') AS path, r.rule,
  coalesce(r.verdict, CASE WHEN u.node IN (SELECT node FROM bad) THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN urls u ON u.url = p.url LEFT JOIN ruled r ON r.url = p.url
"""
