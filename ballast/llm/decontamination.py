"""Benchmark decontamination with a positional inverted index.

Training tokens are postings (term, document, position). A test window of `n`
consecutive words is looked up from its rarest term: the corpus counts of all test terms pick
for each window an anchor term, the postings of anchor terms are stored once
(`stored_index`; those of other terms are counted, never written), and each posting gives
an offset-adjusted place (the position its test item would begin at). Places of the items'
other rare terms are intersected with it, and what is left is checked against the document's
words, word for word, so phrase matches are exact.

`proximity_matches` is a function of its own, not part of the registered query: documents that hold
the rarest terms of an item within a span of words, in any order.

A word is a run of digits, ASCII letters (A-Z as a-z) and non-ASCII characters. Null or empty
texts have no words and are never hit; items without words have no windows. Repeated document
rows each get their own result row, repeated items with one id count as one item. Null ids are kept: items without an id count as
one item, which the list of ids does not name. An empty table on either side gives no hits. Only ids and texts are read, so other columns cannot clash. No side is
broadcast by hand: the anchors are a written table, so Spark knows their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ballast.llm.common import pinned, row_key

WINDOW = 13
#: Rare terms of a window whose places are intersected before the exact check.
RAREST = 2

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Characters outside ASCII that lower() might change.
_OTHER_CASE = r"[\u0080-\x{10FFFF}&&[\p{Lu}\p{Lt}\p{Nl}\p{So}]]"


def words(text: Column) -> Column:
    """Words of a text, only A-Z lower-cased.

    lower() is much faster than translate() and does the same unless a character outside
    ASCII has another case.
    """
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(text.rlike(_OTHER_CASE), F.translate(text, _CAPITALS, _CAPITALS.lower())).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, _NOT_WORD), "")


def with_words(frame: DataFrame, key: str, text: str) -> DataFrame:
    """k_id, k_text, words: one row per document row."""
    return frame.select(*row_key(F.col(key), F.col(text)), words(F.col(text)).alias("words"))


def item_key(key: Column) -> Column:
    """The id as text behind a mark, empty for the null id: never null, so plain equality joins work."""
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit(""))


def item_id(k_item: Column) -> Column:
    """The id as text that item_key holds; null for the null id."""
    return F.when(k_item != "", F.substring(k_item, F.lit(2), F.length(k_item)))


def item_words(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """k_item (see item_key), k_text, words, n_words of each test item that has words."""
    found = items.select(
        item_key(F.col(key)).alias("k_item"), F.xxhash64(F.col(text)).alias("k_text"), words(F.col(text)).alias("words")
    ).filter(F.size("words") > 0)
    return found.dropDuplicates(["k_item", "k_text"]).select(
        "*", F.size("words").alias("n_words")
    )


def build_index(docs: DataFrame, terms: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings (term, k_id, k_text, position from 0); only those of `terms` (term) where given."""
    postings = with_words(docs, key, text).select("k_id", "k_text", F.posexplode("words").alias("position", "term"))
    return postings if terms is None else postings.join(terms.select("term"), "term", "left_semi")


def stored_index(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The postings of `terms`, written once in the shared folder; later readers use the table."""
    return pinned(build_index(docs, terms, key, text))


def term_counts(docs: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """term, n: postings of each of the distinct terms in the corpus."""
    counted = build_index(docs, terms, key, text).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return terms.select("term").join(counted, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def anchors_of(items: DataFrame, counts: DataFrame, n: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """term, k_item, k_item_text, place, rank: for each window of each item its rarest terms.

    A window whose rarest term is absent from the corpus cannot occur and has no anchor.
    """
    placed = items.select("k_item", "k_text", "n_words", F.posexplode("words").alias("place", "term")).join(counts, "term")
    last = F.greatest(F.col("n_words") - n, F.lit(0))
    windowed = placed.withColumn(
        "first", F.explode(F.sequence(F.greatest(F.col("place") - (n - 1), F.lit(0)), F.least(F.col("place"), last)))
    )
    # windows of an item are bounded by its words, so this ranks at most n rows at a time
    order = Window.partitionBy("k_item", "k_text", "first").orderBy("n", "term", "place")
    ranked = windowed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= rarest)
    absent = F.min("n").over(Window.partitionBy("k_item", "k_text", "first")) == 0
    kept = ranked.withColumn("absent", absent).filter(~F.col("absent"))
    return kept.select("term", "k_item", F.col("k_text").alias("k_item_text"), "place", "first", "rank")


def phrase_matches(docs: DataFrame, items: DataFrame, n: int = WINDOW, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """k_id, k_text, k_item, begin, length: maximal runs of words that a document shares with an
    item along one alignment, each covered by whole windows of the item."""
    listed = pinned(item_words(items, item_key, item_text))
    terms = pinned(listed.select(F.explode("words").alias("term")).distinct())
    counts = pinned(term_counts(docs, terms, key, text))
    anchors = pinned(anchors_of(listed, counts, n))
    # one row per distinct term and place of an item: windows of an item share anchors
    lookup = pinned(anchors.select("term", "k_item", "k_item_text", "place").distinct())
    places = (
        stored_index(docs, lookup.select("term").distinct(), key, text)
        .join(lookup, "term")
        .select("k_id", "k_text", "k_item", "k_item_text", "place", (F.col("position") - F.col("place")).alias("begin"))
    )
    # intersection of the adjusted lists: both rare terms of some window at the same begin
    needed = anchors.groupBy("k_item", "k_item_text", "first").agg(
        F.sort_array(F.collect_set("place")).alias("needed")
    ).select("k_item", "k_item_text", "needed").distinct()
    alignments = (
        places.groupBy("k_id", "k_text", "k_item", "k_item_text", "begin")
        .agg(F.collect_set("place").alias("found"))
        .join(pinned(needed), ["k_item", "k_item_text"])
        .filter(F.size(F.array_except("needed", "found")) == 0)
        .select("k_id", "k_text", "k_item", "k_item_text", "begin")
        .distinct()
    )
    alignments = pinned(alignments)
    wanted = alignments.select("k_id", "k_text").distinct()
    texts = with_words(docs, key, text).join(wanted, ["k_id", "k_text"], "left_semi").withColumnRenamed("words", "doc_words")
    tests = listed.select("k_item", F.col("k_text").alias("k_item_text"), F.col("words").alias("item_words"), "n_words")
    compared = alignments.join(texts.dropDuplicates(["k_id", "k_text"]), ["k_id", "k_text"]).join(tests, ["k_item", "k_item_text"])
    # words of the item that the document has at their place
    equal = F.filter(
        F.sequence(F.lit(0), F.col("n_words") - 1),
        lambda at: (F.col("begin") + at >= 0) & F.get("doc_words", (F.col("begin") + at).cast("int")).eqNullSafe(F.get("item_words", at)),
    )
    width = F.least(F.lit(n), F.col("n_words"))
    # first words of whole windows: n equal places in a row
    firsts = F.filter(
        "equal", lambda at, nth: F.get("equal", (nth + F.col("width") - 1).cast("int")) == at + F.col("width") - 1
    )
    found = (
        compared.withColumn("equal", equal).withColumn("width", width)
        .withColumn("firsts", firsts).filter(F.size("firsts") > 0)
        .select("k_id", "k_text", "k_item", F.col("begin").alias("align"), "width", "firsts")
    )
    starts = F.filter("firsts", lambda at, nth: (nth == 0) | (F.get("firsts", nth - 1) != at - 1))
    ends = F.filter("firsts", lambda at, nth: (nth == F.size("firsts") - 1) | (F.get("firsts", nth + 1) != at + 1))
    runs = F.arrays_zip(starts.alias("first"), ends.alias("last"))
    return found.select("k_id", "k_text", "k_item", "align", "width", F.explode(runs).alias("run")).select(
        "k_id", "k_text", "k_item",
        (F.col("align") + F.col("run.first")).cast("long").alias("begin"),
        (F.col("run.last") - F.col("run.first") + F.col("width")).cast("long").alias("length"),
    ).distinct()


def proximity_matches(docs: DataFrame, items: DataFrame, terms_each: int = 4, span: int = 50, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """k_id, k_text, k_item: documents with the `terms_each` rarest terms of an item (all, if it
    has fewer) within `span` words, in any order."""
    listed = pinned(item_words(items, item_key, item_text))
    per_item = listed.select("k_item", F.explode(F.array_distinct("words")).alias("term")).distinct()
    counts = term_counts(docs, pinned(per_item.select("term").distinct()), key, text)
    order = Window.partitionBy("k_item").orderBy("n", "term")
    rare = per_item.join(counts, "term").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= terms_each)
    rare = pinned(rare.withColumn("needed", F.count(F.lit(1)).over(Window.partitionBy("k_item"))).select("term", "k_item", "needed"))
    placed = stored_index(docs, rare.select("term").distinct(), key, text).dropDuplicates().join(rare, "term")
    near = Window.partitionBy("k_id", "k_text", "k_item").orderBy("position").rangeBetween(0, span - 1)
    return (
        placed.withColumn("held", F.size(F.collect_set("term").over(near)))
        .filter(F.col("held") == F.col("needed")).select("k_id", "k_text", "k_item").distinct()
    )


def contamination(docs: DataFrame, items: DataFrame, n: int = WINDOW, one_in: int = 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document row.

    Contaminated: at least one word in `one_in` lies in an occurrence of a window."""
    runs = pinned(phrase_matches(docs, items, n, key, text, item_key, item_text))
    keys = ["k_id", "k_text"]
    # distinct places: counted with a partial aggregation by place, bounded by a document's words
    hit = runs.select(*keys, F.explode(F.sequence("begin", F.col("begin") + F.col("length") - 1)).alias("place"))
    hit = hit.distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_hit"))
    # the null id counts as an item and has no name to list, as in SQL
    tests = runs.select(*keys, "k_item").distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_list(item_id(F.col("k_item")))).alias("ids")
    )
    tests = tests.withColumn("ids", F.array_join("ids", ","))
    hits = hit.join(tests, keys)
    sized = docs.select(
        F.col(key).alias("doc_id"), *row_key(F.col(key), F.col(text)), F.size(words(F.col(text))).cast("long").alias("n_words")
    )
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return sized.join(hits, keys, "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * one_in >= F.col("n_words"))).alias("contaminated"),
        *[F.col(k) for k in keys],
    )


def clean(docs: DataFrame, items: DataFrame, n: int = WINDOW, one_in: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that are not contaminated."""
    found = contamination(docs, items, n, one_in, key, text)
    goes = pinned(found.filter("contaminated").select("k_id", "k_text").distinct())
    own = docs.columns
    inner = [f"c{at}" for at in range(len(own))]
    renamed = docs.toDF(*inner)
    at = {name: F.col(inner[own.index(name)]) for name in (key, text)}
    keyed = renamed.select("*", *row_key(at[key], at[text]))
    return keyed.join(goes, ["k_id", "k_text"], "left_anti").select(*inner).toDF(*own)


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, w, least(len(w), {WINDOW}) AS k FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark) WHERE len(w) > 0),
wins AS (
  SELECT DISTINCT item_id, k, array_to_string(w[(i + 1)::INT : (i + k)::INT], ' ') AS phrase
  FROM b, LATERAL (SELECT unnest(range(len(w) - k + 1)) AS i)),
widths AS (SELECT DISTINCT k FROM wins),
spots AS (
  SELECT r, i, k, array_to_string(w[(i + 1)::INT : (i + k)::INT], ' ') AS phrase
  FROM (SELECT r, w, k, unnest(range(greatest(len(w) - k + 1, 0))) AS i FROM d, widths)),
hits AS (SELECT r, i, spots.k, item_id FROM spots JOIN wins USING (phrase, k)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hits) GROUP BY r),
tests AS (
  SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN tests USING (r)
"""
