"""Sharding by a permutation-filled lookup table.

Every shard orders the slots of a prime-sized table by its own permutation (offset and
step from hashes of its name). Shards take turns; at its turn a shard claims the first
slot of its order that is free. The filled table is broadcast as one array, so a row finds
its shard with one hash and one lookup, every shard gets the same number of slots (plus or
minus one), and taking a shard away moves few rows of the others.

Hashes are the first 15 hexadecimal digits of md5, so any engine can repeat a placement.

Null keys are placed as the text 'null'; repeated rows go to the same place; an empty table
gives no rows; columns of the input do not clash, for only the key is read. A hot key (a
source with a third of the rows) is split by giving `spread`, further columns hashed with it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime; at least 100 slots a shard keep shares within one per cent of each other.
TABLE_SIZE = 4099
SHARDS = 32


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def is_prime(size: int) -> bool:
    return size > 1 and all(size % n for n in range(2, int(size**0.5) + 1))


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index of its shard. `size` must be prime and not under the number of shards."""
    if not is_prime(size) or not 0 < len(shards) <= size:
        raise ValueError("the table size must be a prime and hold every shard")
    place = [_number(f"{name}/offset") % size for name in shards]
    step = [_number(f"{name}/skip") % (size - 1) + 1 for name in shards]
    slots = [-1] * size
    left = size
    while left:
        for shard in range(len(shards)):
            while slots[place[shard]] >= 0:
                place[shard] = (place[shard] + step[shard]) % size
            slots[place[shard]] = shard
            left -= 1
            if not left:
                break
    return slots


def slot_of(key: Column, size: int, *spread: Column) -> Column:
    """The slot of a key; `spread` splits a hot key over several slots."""
    parts = [F.coalesce(part.cast("string"), F.lit("null")) for part in (key, *spread)]
    digits = F.substring(F.md5(F.concat_ws("/", *parts)), 1, 15)
    return F.conv(digits, 16, 10).cast("long") % size


def place(frame: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE, spread: tuple[str, ...] = ()) -> DataFrame:
    """key, slot, shard of every row. The table is a literal of `size` small integers."""
    slots = lookup_table(shards, size)
    table = F.array(*[F.lit(int(shard)) for shard in slots])
    placed = frame.select(F.col(key), slot_of(F.col(key), size, *[F.col(c) for c in spread]).alias("slot"))
    return placed.select(key, "slot", F.get(table, F.col("slot").cast("int")).cast("long").alias("shard"))


def shard_names(count: int = SHARDS) -> list[str]:
    return [f"shard-{n}" for n in range(count)]


ORACLE_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT s, ('0x' || substr(md5('shard-' || s || '/offset'), 1, 15))::BIGINT % {TABLE_SIZE} AS o,
         ('0x' || substr(md5('shard-' || s || '/skip'), 1, 15))::BIGINT % ({TABLE_SIZE} - 1) + 1 AS k
  FROM range({SHARDS}) AS t(s)),
orders AS (
  SELECT list([(o + j * k) % {TABLE_SIZE} FOR j IN range({TABLE_SIZE})] ORDER BY s) AS prefer FROM shards),
turns(turn, owner, pick) AS (
  SELECT 0::BIGINT, [-1::BIGINT FOR j IN range({TABLE_SIZE})], -1::BIGINT
  UNION ALL
  SELECT turn + 1,
         list_transform(owner, lambda x, i: CASE WHEN i - 1 = chosen THEN turn % {SHARDS} ELSE x END), chosen
  FROM (SELECT turn, owner,
               list_filter(prefer[(turn % {SHARDS} + 1)::INT], lambda x: owner[(x + 1)::INT] < 0)[1] AS chosen
        FROM turns, orders WHERE turn < {TABLE_SIZE})),
filled AS (SELECT owner FROM turns WHERE turn = {TABLE_SIZE})
SELECT doc_id, slot, owner[(slot + 1)::INT] AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % {TABLE_SIZE} AS slot
      FROM documents), filled
"""
