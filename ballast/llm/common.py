"""What the operators share: tables, bounded training samples, words as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ballast.session import pinned, ship_package

__all__ = [
    "balanced_sample", "crc_mod", "lookup", "mapped", "one_of_each", "pinned", "row_key", "ship_package", "table", "text_blocks", "words_of",
]

#: Bytes of text that one numpy step works on; a longer text is a step of its own.
BLOCK_BYTES = 1 << 20
BLOCK_ROWS = 4096


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo: the fixed folds of the contract."""
    return F.crc32(key.cast("string").cast("binary")) % modulus


def row_key(key: Column, text: Column) -> list[Column]:
    """Identity of a row: rows that agree in it are copies of one document.

    None of the parts is null, so plain equality joins work.
    """
    return [
        F.coalesce(key.cast("string"), F.lit("null")).alias("k_id"),
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("k_text"),
    ]


def balanced_sample(labelled: DataFrame, key: str, label: str, per_label: int, seed: int = 7) -> DataFrame:
    """Distinct (key, label): about `per_label` keys of each label at most, the same ones on every run.

    A key stays where its hash falls under per_label / (rows of its label), so rows of rare labels
    all stay. The few counts are literals, so no row moves by its label. A key that repeats passes
    or falls with all its rows and is one row of the result: expected rows are at most `per_label`.
    """
    sizes = {row[0]: row[1] for row in labelled.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect() if row[0] is not None}
    if not sizes:
        return labelled.select(key, label).limit(0)
    share = F.element_at(F.create_map(*[F.lit(x) for name, n in sorted(sizes.items()) for x in (name, per_label / n)]), F.col(label))
    draw = (F.xxhash64(F.col(key).cast("string"), F.lit(seed)).bitwiseAND(F.lit((1 << 30) - 1))) / float(1 << 30)
    return labelled.filter(draw < share).select(key, label).distinct()


def one_of_each(sample: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row of each key of a drawn sample: the text of least hash. Combined before the shuffle, so
    an id under which a third of the documents lie is one document."""
    return sample.groupBy(*keys).agg(F.min_by(text, F.coalesce(F.xxhash64(text), F.lit(0))).alias(text)).select(*sample.columns)


#: A key is hot if it holds more than one in HOT_KEYS rows, so there are fewer hot keys than that.
HOT_KEYS = 200


def lookup(facts: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """`facts` left-joined to `known`, which has one row a key, without a task for a hot key.

    Rows of hot keys meet their row of `known` where they lie: at most HOT_KEYS rows are sent
    to the executors. The other rows are joined by key. `facts` is read three times.
    """
    sizes = facts.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("size_"))
    total = facts.count()
    hot = [row[0] for row in sizes.filter(F.col("size_") * HOT_KEYS > total).collect()]
    if not hot:
        return facts.join(known, key, "left")
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    near = facts.filter(is_hot).join(F.broadcast(known.filter(F.col(key).isin(hot))), key, "left")
    return near.unionByName(facts.filter(~is_hot).join(known, key, "left"))


#: Bytes of rows that go to a Python worker at once: long texts fill a batch long before its row limit does.
ARROW_BYTES = 16 << 20
_ARROW_SETTING, _ARROW_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", f"{64 << 20}b"


def mapped(frame: DataFrame, work, schema: str) -> DataFrame:
    """mapInArrow with this package on the workers, in batches of ARROW_BYTES where the session has Spark's own bound."""
    spark = frame.sparkSession
    ship_package(spark)
    if spark.conf.get(_ARROW_SETTING) == _ARROW_DEFAULT:
        spark.conf.set(_ARROW_SETTING, f"{ARROW_BYTES}b")
    return frame.mapInArrow(work, schema)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes: first row, end row, bytes, offsets (rows + 1). Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, start + BLOCK_ROWS, max(end, start + 1))
        yield start, end, data[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start]
        start = end


_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
LOWER = np.where(_UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
#: Word bytes: digits, ASCII letters, everything that is not ASCII.
WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | _UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
_RANDOM = np.random.Generator(np.random.PCG64(20260101))
_BYTE_MIX = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACE_MIX = _RANDOM.integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = values ^ (values >> np.uint64(33))
    values = values * np.uint64(0xFF51AFD7ED558CCD)
    return values ^ (values >> np.uint64(29))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a block, and where each text's words start (rows + 1).

    A word is a run of digits, letters or non-ASCII characters, A-Z taken as a-z.
    """
    inside = WORD[data]
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(inside)
    first = np.searchsorted(at, starts)
    lengths = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, lengths)
    values = _BYTE_MIX[LOWER[data[at]]] * _PLACE_MIX[place & 1023]
    return mix(np.add.reduceat(values, first)), np.searchsorted(starts, offsets)
