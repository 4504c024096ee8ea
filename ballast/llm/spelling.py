"""Spelling variants: composition of a vocabulary acceptor, a one-edit transducer and the acceptor again.

`vocabulary` counts words over whole texts. `near_pairs` enumerates every pair of words that
differ by one inserted, deleted or replaced code point. The composed machine is cut by initial
state: of two near words of L and L or L + 1 code points, either the first h = L // 2 code
points agree and the edit lies behind them, or the last L - h agree and the edit lies before
them. All words that share such a context (prefix or suffix) are one partition, whose initial
state is the one reached over the context. Its task builds the minimised acceptor of what the
context leaves of the words, composes it with the transducer and itself, and enumerates the
accepted pairs. A partition of more than `limit` words is cut again in the same way, at the
middle of what its context leaves, so no task holds more than `limit` words, except where
what is left is too short to cut, and then the alphabet bounds it.

The transducer is unambiguous (an inserted code point goes behind its run, and partitions
with a common suffix leave insertions at the very end of their part to their siblings), so
every pair comes out once and nothing has to be deduplicated.

`variants` gives a word's form (the most frequent near word, if it is `ratio` times as
frequent) and its root, the end of the chain of forms, by pointer doubling.

Null texts have no words; a null id counts as the empty text in the hash that deletes; repeated
rows count again; ties take the smallest word in code-point order; an empty table gives no
rows. Only id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import lookup, mapped, pinned

#: Least code points of a word, least occurrences, and how much more frequent a form is.
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
#: Words of a partition before it is cut again.
LIMIT = 20_000
#: The letters of words.
LETTERS = r"[A-Za-zÀ-ÿ]"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GROUP = ["base", "closed", "head", "tail"]


def lowered(word: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.when(word.rlike("[A-Z]"), F.translate(word, _UPPER, _UPPER.lower())).otherwise(word)


def vocabulary(
    docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 31,
    length: int = LEAST_LENGTH, count: int = LEAST_COUNT,
) -> DataFrame:
    """word, n: words of `length` code points and `count` occurrences or more.

    Of a run whose hash with the id is divisible by `every`, one code point is deleted first.
    Shorter runs cannot become words, so the pattern leaves them out.
    """
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id_"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(f"{LETTERS}{{{length},}}"), F.lit(0))).alias("run"),
    ).select("id_", lowered(F.col("run")).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id_", "run").cast("binary")).alias("hash"))
    at = (F.col("hash") % F.char_length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.col("hash") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    return (
        words.filter(F.char_length("word") >= length)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= count)
    )


class Acceptor:
    """Minimal deterministic acceptor of sorted, distinct words, built in one pass."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        # open states along the last word: (arcs so far, final)
        path: list[tuple[dict[str, int], bool]] = [({}, False)]
        last = ""
        for word in words:
            shared = 0
            limit = min(len(word), len(last))
            while shared < limit and word[shared] == last[shared]:
                shared += 1
            self._close(path, last, shared)
            path += [({}, False) for _ in word[shared:]]
            path[len(word)] = (path[len(word)][0], True)
            last = word
        self._close(path, last, 0)
        self.start = self._state(*path[0])

    def _close(self, path: list, word: str, keep: int) -> None:
        while len(path) > keep + 1:
            state = self._state(*path.pop())
            path[-1][0][word[len(path) - 1]] = state

    def _state(self, arcs: dict[str, int], final: bool) -> int:
        name = (final, *arcs.items())
        found = self._known.get(name)
        if found is None:
            found = self._known[name] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return found


def _common(acceptor: Acceptor, one: int, two: int, length: int, banned: str | None = None) -> Iterator[str]:
    """Words of `length` accepted from both states; `banned` may not be their first code point."""
    arcs, final = acceptor.arcs, acceptor.final
    stack = [(one, two, "")]
    while stack:
        a, b, word = stack.pop()
        if len(word) == length:
            if final[a] and final[b]:
                yield word
            continue
        mine, other = arcs[a], arcs[b]
        if len(other) < len(mine):
            mine, other = other, mine
        for symbol in mine:
            if symbol in other and not (banned == symbol and not word):
                stack.append((arcs[a][symbol], arcs[b][symbol], word + symbol))


def compose(words: list[str], base: int, closed: bool) -> Iterator[tuple[str, str]]:
    """Pairs that acceptor, one-edit transducer and acceptor accept: two words of `base` code points
    that differ in one, or one of `base` and one that has one more.

    `words` are sorted, distinct, of base or base + 1 code points. With `closed`, nothing is
    inserted behind the last code point.
    """
    acceptor = Acceptor(words)
    stack = [(acceptor.start, "")]
    while stack:
        # no edit yet: both tapes are in one state
        state, read = stack.pop()
        arcs = acceptor.arcs[state]
        left = base - len(read)
        symbols = list(arcs)
        for n, symbol in enumerate(symbols):
            to = arcs[symbol]
            if left > 0:
                stack.append((to, read + symbol))
                for other in symbols[n + 1 :]:
                    for rest in _common(acceptor, to, arcs[other], left - 1):
                        yield read + symbol + rest, read + other + rest
            if left > 0 or not closed:
                for rest in _common(acceptor, state, to, left, symbol):
                    yield read + rest, read + symbol + rest


def _parts(words: DataFrame) -> DataFrame:
    """Two rows for each of (base, closed, head, tail, middle, n): what is left behind and before a common part.

    `base` is the length of the group's shorter words; `head` and `tail` are the context so far.
    """
    inner = F.col("base") - F.char_length("head") - F.char_length("tail")
    size = F.char_length("middle")
    middle = F.col("middle")
    sized = words.withColumn("h", F.floor(inner / 2).cast("int")).withColumn("keep", size - inner + F.col("h"))
    front = F.struct(
        "base", "closed",
        F.concat("head", middle.substr(F.lit(1), F.col("h"))).alias("head"), "tail",
        middle.substr(F.col("h") + 1, size).alias("middle"), "n",
    )
    back = F.struct(
        "base", F.lit(True).alias("closed"), "head",
        F.concat(middle.substr(F.col("keep") + 1, size), "tail").alias("tail"),
        middle.substr(F.lit(1), F.col("keep")).alias("middle"), "n",
    )
    return sized.select(F.explode(F.array(front, back)).alias("part")).select("part.*")


def _enumerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and middle -> near pairs, one group in memory at a time."""
    fields = ["one", "one_n", "two", "two_n"]
    out: list[tuple] = []

    def found(group: tuple, words: list[str], counts: list[int]) -> None:
        base, closed, head, tail = group
        n_of = dict(zip(words, counts, strict=True))
        for one, two in compose(words, base - len(head) - len(tail), closed):
            out.append((head + one + tail, n_of[one], head + two + tail, n_of[two]))

    def emitted() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        out.clear()
        types = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], fields)

    group, words, counts = None, [], []
    for batch in batches:
        keys = zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)
        for key, word, n in zip(keys, batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
            if key != group:
                if len(words) > 1:
                    found(group, words, counts)
                group, words, counts = key, [], []
            words.append(word)
            counts.append(n)
            if len(out) > 20_000:
                yield emitted()
    if len(words) > 1:
        found(group, words, counts)
    yield emitted()


def near_pairs(words: DataFrame, shortest: int = 1, limit: int = LIMIT) -> DataFrame:
    """one, one_n, two, two_n: every pair of `words` (word, n; distinct) at one edit, once.

    Words under `shortest` code points are taken to be absent.
    """
    length = F.char_length("word")
    own = words.select(F.explode(F.array(length, length - 1)).alias("base"), F.col("word").alias("middle"), "n")
    none = F.lit("")
    parts = _parts(
        own.filter(F.col("base") >= shortest)
        .select("base", F.lit(False).alias("closed"), none.alias("head"), none.alias("tail"), "middle", "n")
    )
    whole = None
    while True:
        parts = pinned(parts)
        # what two code points or more can still be cut
        inner = F.col("base") - F.char_length("head") - F.char_length("tail")
        large = pinned(
            parts.filter(inner > 1).groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("size"))
            .filter(F.col("size") > limit).select(*_GROUP)
        )
        done = large.isEmpty()
        settled = parts if done else parts.join(large, _GROUP, "left_anti")
        whole = settled if whole is None else whole.unionByName(settled)
        if done:
            break
        parts = _parts(parts.join(large, _GROUP, "left_semi"))
    dealt = whole.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "middle").select(*_GROUP, "middle", "n")
    return mapped(dealt, _enumerate, "one string, one_n long, two string, two_n long")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): the end of each chain, in a logarithm of its length of rounds."""
    current = pinned(forms.select("word", F.col("form").alias("root")))
    while True:
        known = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = lookup(current, "root", known)
        current = pinned(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if current.filter("moved").isEmpty():
            return current.select("word", "root")
        current = current.select("word", "root")


def variants(words: DataFrame, shortest: int = 1, ratio: int = RATIO, limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n of `words` (word, n; distinct)."""
    words = pinned(words.select("word", F.col("n").cast("long").alias("n")))
    pairs = pinned(near_pairs(words, shortest, limit))
    directed = pairs.select(F.col("one").alias("word"), F.col("two").alias("near"), F.col("two_n").alias("near_n")).unionByName(
        pairs.select(F.col("two").alias("word"), F.col("one").alias("near"), F.col("one_n").alias("near_n"))
    )
    best = directed.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("best")
    )
    fits = -F.col("best.order") >= ratio * F.col("n")
    judged = pinned(
        words.join(best, "word", "left").select(
            "word", F.when(fits, F.col("best.near")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, -F.col("best.order")).alias("form_n"),
        )
    )
    ends = roots(judged.filter(F.col("form").isNotNull()))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


#: crc32 as a fold over bytes with the table of its polynomial; near words meet in their shortened forms.
ORACLE_SQL = r"""
WITH RECURSIVE letters AS (
  SELECT string_agg(chr(c::INTEGER), '' ORDER BY c) AS upper FROM range(65, 91) t(c)
),
polynomial AS (
  SELECT list(v ORDER BY i) AS entries FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) t(i))
),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(run, upper, lower(upper)) AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents), letters
  WHERE length(run) >= 7 GROUP BY ALL
),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + 2 * strlen(id || ':' || run), 2),
        lambda i: ('0x' || substr(hex(encode(id || ':' || run)), i, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, entries[1 + xor(c & 255, b)]))) AS h
  FROM runs, polynomial
),
words AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, 2 + h % length(run)) ELSE run END AS word, times
    FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
),
cut AS (
  SELECT word, unnest(list_distinct(list_transform(range(1, 1 + length(word)), lambda i: substr(word, 1, i - 1) || substr(word, i + 1)))) AS part
  FROM words
),
met AS (
  SELECT a.word AS one, b.word AS two FROM cut a JOIN cut b USING (part) WHERE a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT word, part FROM cut WHERE part IN (SELECT word FROM words)
  UNION SELECT part, word FROM cut WHERE part IN (SELECT word FROM words)
),
near AS (
  SELECT one, two FROM met
  WHERE length(one) <> length(two)
    OR len(list_filter(range(1, 1 + length(one)), lambda i: substr(one, i, 1) <> substr(two, i, 1))) = 1
),
judged AS (
  SELECT w.word, w.n, count(v.word) AS n_near, first(v.word ORDER BY v.n DESC, v.word) AS best, max(v.n) AS best_n
  FROM words w LEFT JOIN near ON near.one = w.word LEFT JOIN words v ON v.word = near.two
  GROUP BY ALL
),
forms AS (
  SELECT word, n, n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n FROM judged
),
chains(word, root) AS (
  SELECT word, word FROM forms
  UNION ALL SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n
FROM forms f JOIN chains c USING (word) JOIN forms e ON e.word = c.root WHERE e.form IS NULL
"""
