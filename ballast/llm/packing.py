"""Best-fit packing of tokenized documents into sequences.

`pieces` tokenizes whole texts and cuts only what is longer than a sequence. `pack` places
pieces by vector best fit: a bin has three residual capacities (tokens, documents, attention
cost = sum of squared lengths), a piece demands a share of each, and among the bins that
hold it under every constraint it goes to the one with the largest weighted dot product of
demand and residual, or the smallest weighted residual norm.

Pieces are dealt to blocks of about `block` pieces by a hash, each block is packed by one
task with its pieces in falling order, so memory is bounded by the block and a lost executor
costs its blocks. A block wastes one open bin at most on the tail.

Null texts are empty documents (they hold the end id alone). Repeated rows are packed as
separate documents. Rows with a null id come back with a null id. An empty table gives no
rows. Only the id and the text are read, so further columns cannot clash.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import mapped, pinned

SEQUENCE = 1024
END_ID = 2
#: Pieces in one packing block.
BLOCK = 20_000
#: The pre-token pattern of the byte-level vocabulary, and the part of it that only runs of white space need.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOOK_AHEAD = r"\s+(?!\S)|"
_SPACE_RUN = re.compile(r"\s\s")


def byte_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, from a tokenizer file whose tokens spell bytes as printable characters."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    added = {token["content"] for token in content["added_tokens"]}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(n): n for n in plain}
    spelled |= {chr(256 + at): n for at, n in enumerate(n for n in range(256) if n not in set(plain))}
    return {
        bytes(spelled[char] for char in token): number
        for token, number in content["model"]["vocab"].items()
        if token not in added
    }


class Encoder:
    """Token ids of texts, special tokens taken as ordinary text.

    The merges are those of the tokenizer file, run by tiktoken's core, several times as fast as
    the tokenizers library and equal to it id for id (tested). Where a text has no run of white
    space the pattern needs no look-ahead, which saves a third of the time.
    """

    def __init__(self, path: str):
        import tiktoken

        ranks = byte_ranks(path)
        self.full = tiktoken.Encoding("full", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        plain = _PATTERN.replace(_LOOK_AHEAD, "")
        self.plain = tiktoken.Encoding("plain", pat_str=plain, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        chosen = self.full if _SPACE_RUN.search(text) else self.plain
        return np.asarray(chosen.encode_ordinary(text), dtype="<u4").tobytes()


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One encoder a worker process, kept from task to task."""
    return Encoder(path)


def cut(length: int, limit: int) -> list[int]:
    """Lengths of the pieces of a document: full ones, the first may be shorter."""
    first = length % limit
    return [first] * bool(first) + [limit] * (length // limit)


def pieces(docs: DataFrame, tokenizer_path: str, limit: int = SEQUENCE, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids) of every piece of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(tokenizer_path)
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            doc, numbers, starts, lengths, crcs, held = [], [], [], [], [], []
            for row in range(batch.num_rows):
                ids = encode(batch.column(1)[row].as_py() or "") + end
                start = 0
                for n, length in enumerate(cut(len(ids) // 4, limit)):
                    own = ids[4 * start : 4 * (start + length)]
                    doc.append(row)
                    numbers.append(n)
                    starts.append(start)
                    lengths.append(length)
                    crcs.append(zlib.crc32(own))
                    if with_ids:
                        held.append(own)
                    start += length
            columns = [
                batch.column(0).take(pa.array(doc, pa.int64())), pa.array(numbers, pa.int32()),
                pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(held, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return mapped(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), work, schema)


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, pieces taken in falling order of length.

    Bins with equal residuals are alike, so they are held as classes (residual vector -> bins)
    and only the few classes are scored, all at once. Lengths over the token capacity, or over
    the attention capacity, get a bin of their own.
    """
    cap = np.asarray(capacity, float)
    scale = np.asarray(weights, float) / cap**2
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    residual = np.empty((64, 3))
    members: list[list[int]] = []
    index: dict[tuple[float, float, float], int] = {}
    free: list[int] = []
    filled: list[int] = []
    for at in np.argsort(-lengths, kind="stable"):
        demand = np.array((lengths[at], 1.0, float(lengths[at]) ** 2))
        used = len(members)
        chosen = -1
        if used:
            rest = residual[:used]
            left = rest - demand
            fits = (left >= 0).all(axis=1)
            if fits.any():
                score = (rest * scale) @ demand if rule == "dot" else -((left * left) @ scale)
                score[~fits] = -np.inf
                chosen = int(np.argmax(score))
        if chosen < 0:
            bin_id, rest_of = len(filled), cap
            filled.append(0)
        else:
            bin_id, rest_of = members[chosen].pop(), residual[chosen].copy()
            if not members[chosen]:
                del index[tuple(residual[chosen])]
                residual[chosen] = -1.0
                free.append(chosen)
        bins[at], offsets[at] = bin_id, filled[bin_id]
        filled[bin_id] += int(lengths[at])
        rest_of = rest_of - demand
        if (rest_of < 1).any():
            continue
        name = tuple(rest_of)
        spot = index.get(name)
        if spot is None:
            if free:
                spot = free.pop()
            else:
                spot = len(members)
                members.append([])
                if spot == len(residual):
                    residual = np.concatenate([residual, np.empty_like(residual)])
            residual[spot] = rest_of
            index[name] = spot
        members[spot].append(bin_id)
    return bins, offsets


def pack(found: DataFrame, limit: int = SEQUENCE, max_documents: int = SEQUENCE, max_attention: float = float(SEQUENCE) ** 2, weights: tuple[float, float, float] = (1.0, 0.25, 0.25), rule: str = "norm", block: int = BLOCK) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    Every sequence keeps within `limit` tokens, `max_documents` pieces and `max_attention` cost;
    a piece that alone exceeds a capacity gets a sequence of its own.
    """
    found = found.select("doc_id", "piece", "start", "length", "ids_crc32")
    total = found.agg(F.count(F.lit(1))).first()[0]
    blocks = max(1, -(-total // block))
    capacity = (float(limit), float(max_documents), float(max_attention))

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        # rows that agree in all of these are alike, so the order is the same on every run
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        bins, offsets = best_fit(frame["length"].to_numpy(), capacity, weights, rule)
        return frame.assign(sequence_id=frame["block"] * (1 << 32) + bins, offset=offsets).drop(columns=["block"])

    dealt = found.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "length"), F.lit(blocks)))
    return dealt.groupBy("block").applyInPandas(
        work, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )


def sequences(packed: DataFrame, with_ids: DataFrame) -> DataFrame:
    """The packed token ids: sequence_id, ids (little-endian 32-bit), n_pieces."""
    keys = ["doc_id", "piece", "ids_crc32"]
    ids = with_ids.select(*keys, "ids").dropDuplicates(keys)
    placed = packed.join(ids, [packed[k].eqNullSafe(ids[k]) for k in keys]).select("sequence_id", "offset", "ids")
    return placed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")
    ).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b"").cast("binary"), lambda held, part: F.concat(held, part["ids"])).alias("ids"),
        F.size("parts").alias("n_pieces"),
    )
