"""Hard negatives by a secondary-sort shuffle of scored pairs.

Every row is scored against every anchor (the stated query set), in blocks: rows are packed
into blocks where they lie, anchors are dealt to groups of about ANCHORS, and each group meets
each block once, spread over tasks. Pair scores are packed into keys (anchor, descending
score, id), `repartitionAndSortWithinPartitions` brings an anchor's keys together in order, and
an iterator walks them: a positive opens a window, negatives that lie in open windows are
emitted until each window has its number. It holds the windows of one anchor, never its pairs.

Pairs that cannot be in a result are left out before the shuffle, exactly. A first pass keeps
of each task's rows the best positives of each anchor, and the walk finds the anchor's
positives among them. A second pass scores again and keeps, of each task's rows, the first
negatives of each window; the walk finds the anchor's negatives among those. What is shuffled
is thus a few keys for each anchor and task, not one for each pair.

Rows with a null label, a null vector, or a null or non-finite component take no part. Equal
rows are separate rows; a null id comes last among ties and is no anchor. Vectors of different
length have no score. Scores are exact; one beyond 64 bits takes the nearest 64-bit value. An empty
table gives no rows. Only id, label and vector are read, so further columns cannot clash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import groupby, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import mapped, pinned

#: Positives of an anchor, negatives of a positive.
POSITIVES = 5
NEGATIVES = 3
#: Anchors of a group, rows of a block, scores held at once.
ANCHORS = 8192
ROWS = 4096
SCORES = 1 << 21
#: Integers up to here are exact as doubles.
_EXACT = 1 << 53
_LEAST = np.iinfo(np.int64).min
_MOST = np.iinfo(np.int64).max


class Block(NamedTuple):
    """Rows of one vector length: uid, id, id is null, label, integer components."""

    uid: np.ndarray
    key: np.ndarray
    unnamed: np.ndarray
    label: np.ndarray
    vector: np.ndarray

    def take(self, chosen: np.ndarray) -> Block:
        return Block(*(part[chosen] for part in self))


def _joined(blocks: list[Block]) -> list[Block]:
    """One block for each vector length."""
    out = []
    for dim in sorted({b.vector.shape[1] for b in blocks}):
        same = [b for b in blocks if b.vector.shape[1] == dim]
        wide = any(b.vector.dtype == object for b in same)
        vectors = [b.vector.astype(object) if wide else b.vector for b in same]
        out.append(Block(*(np.concatenate([getattr(b, f) for b in same]) for f in Block._fields[:4]), np.concatenate(vectors)))
    return out


def _floored(values: np.ndarray) -> np.ndarray:
    """floor(256 * x), as int64 if that is exact, else as Python integers."""
    if not values.size or np.abs(values).max() < 1 << 40:
        return np.floor(values * 256.0).astype(np.int64)
    whole = [[int(np.floor(x * 256.0)) if abs(x) < 1 << 60 else int(x) * 256 for x in row] for row in values]
    return np.array(whole, dtype=object).reshape(values.shape)


def prepared(vectors: DataFrame, key: str, label: Column, vector: str) -> DataFrame:
    """uid, key, label, vector of the rows that take part, written, so that uids stay."""
    held = vectors.select(
        F.col(key).cast("long").alias("key"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )
    good = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    taken = held.filter(F.col("label").isNotNull() & F.coalesce(good, F.lit(False)))
    return pinned(taken.select(F.monotonically_increasing_id().alias("uid"), "key", "label", "vector"))


def _blocks(rows: DataFrame):
    """RDD of blocks, packed where the rows lie."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_dump(batch.slice(start, ROWS))], pa.binary())], ["block"]
                )

    return mapped(rows, packed, "block binary").rdd.map(lambda row: bytes(row[0]))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of a batch packed by group; `first` is the least uid of a block and names it."""
    for batch in batches:
        groups = batch.column(0).to_numpy()
        rest = batch.select(batch.schema.names[1:])
        for group in np.unique(groups):
            block = rest.filter(pa.array(groups == group))
            yield pa.RecordBatch.from_arrays(
                [pa.array([group], pa.int32()), pa.array([block.column(0)[0].as_py()], pa.int64()), pa.array([_dump(block)], pa.binary())],
                ["group", "first", "block"],
            )


def _dump(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _load(packed: bytes) -> list[Block]:
    """The rows of a packed batch, a block for each vector length."""
    table = pa.ipc.open_stream(packed).read_all().combine_chunks()
    uid, label = (table.column(c).to_numpy() for c in ("uid", "label"))
    keys = table.column("key")
    unnamed = keys.is_null().to_numpy()
    key = keys.fill_null(0).to_numpy()
    vectors = table.column("vector").combine_chunks()
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.chunk(0)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    out = []
    for dim in np.unique(sizes):
        chosen = np.flatnonzero(sizes == dim)
        values = flat[starts[chosen][:, None] + np.arange(dim)] if dim else np.zeros((len(chosen), 0))
        out.append(Block(uid[chosen], key[chosen], unnamed[chosen], label[chosen], _floored(values)))
    return out


def _scores(anchors: Block, rows: Block) -> np.ndarray:
    """Inner products, exact, as int64."""
    a, b = anchors.vector, rows.vector
    if a.dtype != object and b.dtype != object:
        most = [int(max(abs(int(v.max(initial=0))), abs(int(v.min(initial=0))))) for v in (a, b)]
        if most[0] * most[1] * max(a.shape[1], 1) < _EXACT:
            return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, int(_LEAST) + 1, int(_MOST)).astype(np.int64)


def _first(scores: np.ndarray, fits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the first `most` fitting columns of each row: high scores first, then low columns."""
    width = scores.shape[1]
    if not width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = int(scores.min()), int(scores.max())
    if max(abs(low), abs(high)) < (1 << 62) // width:
        # one number orders score and column, so equal scores need no care
        order = np.where(fits, scores * width + (width - 1 - np.arange(width)), _LEAST)
        if width > most:
            columns = np.argpartition(order, width - most, axis=1)[:, width - most :]
        else:
            columns = np.broadcast_to(np.arange(width), scores.shape)
        good = np.take_along_axis(fits, columns, 1)
        at = np.nonzero(good)
        return at[0], columns[at]
    rows, columns = [], []
    for n in range(len(scores)):
        chosen = sorted(np.flatnonzero(fits[n]), key=lambda c: (-int(scores[n, c]), c))[:most]
        rows += [n] * len(chosen)
        columns += chosen
    return np.array(rows, np.int64), np.array(columns, np.int64)


# packed keys sort as bytes: anchor (uid, id), falling score, positives first, null ids last, id
_KEY = struct.Struct(">QQQBBQ")
_ANCHOR_BYTES = 16
_SIGN = 1 << 63
POSITIVE, NEGATIVE = 0, 1


def pack_key(anchor: tuple[int, int], score: int, kind: int, key: int | None) -> bytes:
    unnamed = key is None
    return _KEY.pack(anchor[0], anchor[1] + _SIGN, _SIGN - 1 - score, kind, unnamed, 0 if unnamed else key + _SIGN)


def unpack_key(packed: bytes) -> tuple[tuple[int, int], int, int, int | None]:
    """anchor, score, kind, id"""
    uid, anchor_id, score, kind, unnamed, key = _KEY.unpack(packed)
    return (uid, anchor_id - _SIGN), _SIGN - 1 - score, kind, None if unnamed else key - _SIGN


def anchor_partition(packed: bytes) -> int:
    """The same number for all keys of an anchor, in every process."""
    return zlib.crc32(packed[:_ANCHOR_BYTES])


def window(positive: int) -> tuple[int, int]:
    """Least and most score n with 50 * positive <= 100 * n <= 95 * positive."""
    return -(-positive // 2), 19 * positive // 20


def first_positives(stream: Iterator[bytes], most: int = POSITIVES) -> Iterator[tuple[int, int, list[tuple]]]:
    """uid and id of each anchor, its first positives (score, id) from sorted keys."""
    for anchor, keys in groupby(map(unpack_key, stream), key=lambda k: k[0]):
        yield *anchor, [(score, key) for _, score, _, key in islice(keys, most)]


def mined(stream: Iterator[bytes], most: int = NEGATIVES) -> Iterator[tuple]:
    """(anchor, positive id, rank, negative id, positive score, negative score) from sorted keys.

    Holds the open windows of one anchor: [positive score, positive id, least, most, rows so far].
    """
    current, windows = None, []
    for packed in stream:
        anchor, score, kind, key = unpack_key(packed)
        if anchor != current:
            current, windows = anchor, []
        if kind == POSITIVE:
            windows.append([score, key, *window(score), 0])
            continue
        for held in windows:
            if held[2] <= score <= held[3]:
                held[4] += 1
                yield anchor[1], held[1], held[4], key, held[0], score
        windows = [w for w in windows if w[4] < most and w[2] <= score]


def _best(anchors: list[Block], rows: list[Block], windows: dict[int, list[int]] | None) -> Iterator[bytes]:
    """Keys of the pairs of some rows that can be in a result: positives, or negatives of the windows."""
    for mine in anchors:
        for other in rows:
            if mine.vector.shape[1] != other.vector.shape[1]:
                continue
            # columns in the order of ids, null ids last
            other = other.take(np.lexsort((other.key, other.unnamed)))
            step = max(1, SCORES // max(len(other.uid), 1))
            for start in range(0, len(mine.uid), step):
                part = mine.take(slice(start, start + step))
                scores = _scores(part, other)
                same = part.label[:, None] == other.label[None, :]
                if windows is None:
                    fits = same & (part.uid[:, None] != other.uid[None, :])
                    found = [_first(scores, fits, POSITIVES)]
                else:
                    found = []
                    own = [windows.get(int(u), []) for u in part.uid]
                    for place in range(POSITIVES):
                        bounds = [window(w[place]) if place < len(w) else (1, 0) for w in own]
                        # bounds lie between score and 0, so 64 bits hold them
                        least, most = (np.array(side, np.int64)[:, None] for side in zip(*bounds, strict=True))
                        found.append(_first(scores, ~same & (scores >= least) & (scores <= most), NEGATIVES))
                at = np.unique(np.concatenate([r * len(other.uid) + c for r, c in found]))
                kind = POSITIVE if windows is None else NEGATIVE
                for r, c in zip(at // len(other.uid), at % len(other.uid), strict=True):
                    key = None if other.unnamed[c] else int(other.key[c])
                    yield pack_key((int(part.uid[r]), int(part.key[r])), int(scores[r, c]), kind, key)


def _candidates(stream: Iterator[tuple], with_windows: bool) -> Iterator[bytes]:
    """Keys of the pairs of one or more tasks' (anchors, windows, row blocks), sorted by group, kind and name."""
    for _, records in groupby(stream, key=lambda record: record[0][0]):
        pieces: list[Block] = []
        anchors: list[Block] = []
        waiting: list[Block] = []
        windows: dict[int, list[int]] | None = {} if with_windows else None
        for (_, kind, name), value in records:
            if kind == 0:
                pieces += _load(value)
            elif kind == 1:
                windows[name] = value
            else:
                waiting += _load(value)
                if sum(len(b.uid) for b in waiting) >= ROWS:
                    anchors = anchors or _joined(pieces)
                    yield from _best(anchors, _joined(waiting), windows)
                    waiting = []
        yield from _best(anchors or _joined(pieces), _joined(waiting), windows)


def mine(vectors: DataFrame, key: str = "vec_id", label: Column | None = None, vector: str = "embedding", every: int = 50) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by `every`. `label` overrides the column `label`.
    """
    spark = vectors.sparkSession
    rows = prepared(vectors, key, F.col("label") if label is None else label, vector)
    chosen = rows.filter(F.col("key") % every == 0)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-chosen.count() // ANCHORS))
    # each group of anchors meets the blocks in `slices` tasks
    slices = max(1, -(-tasks // groups))
    width = groups * slices

    def group_of(uid: str) -> Column:
        return F.pmod(F.xxhash64(uid), F.lit(groups)).cast("int")

    def to_slices(group: int, kind: int, name: int, value) -> Iterator[tuple]:
        for piece in range(slices):
            yield (group * slices + piece, kind, name), value

    def to_groups(numbered: tuple) -> Iterator[tuple]:
        block, n = numbered
        for group in range(groups):
            yield (group * slices + n % slices, 2, n), block

    anchors = mapped(chosen.select(group_of("uid").alias("group"), *rows.columns), _grouped, "group int, first long, block binary")
    anchor_blocks = anchors.rdd.flatMap(lambda r: to_slices(r[0], 0, r[1], bytes(r[2])))
    row_blocks = _blocks(rows).zipWithUniqueId().flatMap(to_groups)

    def met(blocks):
        return blocks.repartitionAndSortWithinPartitions(width, lambda name: name[0])

    def in_order(keys):
        return keys.map(lambda k: (k, None)).repartitionAndSortWithinPartitions(max(width, tasks), anchor_partition).keys()

    scored = met(anchor_blocks.union(row_blocks)).mapPartitions(lambda s: _candidates(s, False))
    positives = pinned(
        in_order(scored).mapPartitions(first_positives).toDF("uid long, id long, positives array<struct<score: long, id: long>>")
    )
    windows = positives.select(group_of("uid"), "uid", "positives.score").rdd.flatMap(lambda r: to_slices(r[0], 1, r[1], list(r[2])))
    scored = met(anchor_blocks.union(windows).union(row_blocks)).mapPartitions(lambda s: _candidates(s, True))
    opening = positives.rdd.flatMap(lambda r: (pack_key((r[0], r[1]), p[0], POSITIVE, p[1]) for p in r[2]))
    return in_order(opening.union(scored)).mapPartitions(mined).toDF(
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )


#: A scale of 256, labels of ids divisible by 7 moved on by one of ten, anchors divisible by 50.
ORACLE_SQL = """
WITH held AS (
  SELECT row_number() OVER () AS uid, vec_id AS id,
    CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
scored AS (
  SELECT a.uid, a.id AS anchor_id, r.id, a.label = r.label AS same,
    CASE WHEN len(a.v) = 0 THEN 0 ELSE list_inner_product(a.v, r.v)::BIGINT END AS score
  FROM held a JOIN held r ON len(a.v) = len(r.v) AND a.uid <> r.uid
  WHERE a.id % 50 = 0
),
positives AS (
  SELECT uid, anchor_id, id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY uid ORDER BY score DESC, id NULLS LAST) AS place
  FROM scored WHERE same QUALIFY place <= 5
),
found AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, n.id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.uid, p.place ORDER BY n.score DESC, n.id NULLS LAST) AS rank
  FROM positives p JOIN scored n ON n.uid = p.uid AND NOT n.same
    AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM found WHERE rank <= 3
"""
