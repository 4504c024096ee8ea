"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the multiset of its five-word shingles (all its words as one shingle, if it has
fewer). A shingle weighs tf x idf. Documents are near duplicates when their weighted Jaccard
similarity, sum of minima over sum of maxima, is at least 0.8; classes are the connected
components of that relation.

1. The idf of a shingle in a share f of the documents is 1 + 0.5 ln(1 / f) / ln(1 / RARE), where a
   share under RARE = 1 % counts as RARE: how rare a rare shingle is does not matter, and a share
   means the same at every corpus size. One pass counts documents by hashed shingle into
   SKETCH_ROWS rows of 2^SKETCH_BITS counters, the same at every size, and a share is the least of its rows'
   loads above their means. Means and shares both grow in proportion to the corpus, so the
   estimate does not fade. The span from 1 to 1.5 is a parameter: a wide one would let the one
   changed word of a copy, which no other document has, outweigh all that its siblings share.
2. A second pass draws consistent weighted samples (for each sample and shingle r, c ~ Gamma(2,1)
   and b ~ U(0,1), read from a table by hash; t = floor(ln w / r + b), the least
   ln c - r (t - b) - r wins), so two documents agree in a sample with probability equal to their
   similarity. BANDS bands of ROWS samples are hashed into bucket keys.
3. Documents of equal word sequences collapse to one node. Buckets with two nodes or more are
   cut into blocks of bounded size, in the order of total weight; a pair of blocks meets only if
   the weights in them allow a similarity of 0.8. In each pair of blocks all exact similarities
   come from one sparse product, and only a spanning forest of the links is emitted, so a
   bucket of n near copies emits fewer than n links a pair of blocks and no pair is lost.
4. Components come from alternating star contraction, written between rounds.

A pair at exactly 0.8 shares a bucket with probability 0.99, at 0.9 with 0.9999.

Defined results: null and empty texts, and texts without a word, are in no relation, each row
is a class of its own (its id, no root); repeated rows are copies; an empty table gives no rows;
ties break by the digest of the words. A class is known by its root, the least digest in it; its
class_id is the least doc_id, null if it has none, and two classes share it if they share an id. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ballast.llm.common import mapped, mix, pinned, row_key, text_blocks, words_of

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 9, 4
#: Counters in a row of the document-frequency sketch, as a power of two, and rows.
SKETCH_BITS, SKETCH_ROWS = 18, 3
CHUNK = 1024
#: Share of the documents under which all shingles are equally rare.
RARE = 0.01
IDF_SPAN = 0.5
#: Nodes of a bucket, and shingles, that one block holds at most.
BLOCK = 512
BLOCK_SHINGLES = 400_000
#: Hexadecimal digits of a digest that number the bits of the filter of wanted nodes: 2 MB.
FILTER_DIGITS = 6

_RANDOM = np.random.Generator(np.random.PCG64(97))
_FACTORS = _RANDOM.integers(1, 1 << 62, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLOT_FACTORS = np.random.Generator(np.random.PCG64(41)).integers(1, 1 << 62, SKETCH_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SAMPLE_FACTORS = _RANDOM.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE_BITS = 18


def _sampling_table() -> np.ndarray:
    """Rows (1 / r, b, r, ln c - r + r b): the draws that a hash selects."""
    rng = np.random.Generator(np.random.PCG64(11))
    size = 1 << _TABLE_BITS
    r, c, b = rng.gamma(2.0, 1.0, size), rng.gamma(2.0, 1.0, size), rng.random(size)
    return np.stack([1 / r, b, r, np.log(c) - r + r * b], axis=1).astype(np.float32)


def shingles_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block of texts: text, hash and count of its distinct shingles, sorted by both; and
    two digests of each text's word sequence.

    Hashes have 48 bits; the high 16 bits carry the text while sorting.
    """
    words, cuts = words_of(data, offsets)
    n = len(cuts) - 1
    sizes = np.diff(cuts)
    if not len(words):
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    of = np.repeat(np.arange(n), sizes)
    nth = (np.arange(len(words)) - np.repeat(cuts[:-1], sizes)).astype(np.uint64)
    digests = []
    for seed in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
        part = mix(words ^ mix(nth * seed + seed))
        held = np.zeros(n, np.uint64)
        some = sizes > 0
        held[some] = np.add.reduceat(part, cuts[:-1][some])
        digests.append(mix(held + sizes.astype(np.uint64)))
    value = np.zeros(len(words), np.uint64)
    for k in range(min(SHINGLE, len(words))):
        value[: len(words) - k] += words[k:] * _FACTORS[k]
    whole = np.repeat(sizes >= SHINGLE, sizes)
    full = whole & (nth.astype(np.int64) + SHINGLE <= np.repeat(sizes, sizes))
    short = np.flatnonzero((sizes > 0) & (sizes < SHINGLE))
    own = np.array([(words[cuts[s] : cuts[s + 1]] * _FACTORS[: sizes[s]]).sum() + np.uint64(sizes[s]) for s in short], np.uint64)
    hashes = np.concatenate([value[full], own])
    texts = np.concatenate([of[full], short])
    # a block has fewer than 2^16 texts
    packed = (texts.astype(np.uint64) << np.uint64(48)) | (mix(hashes) >> np.uint64(16))
    packed.sort()
    first = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    counts = np.diff(np.append(first, len(packed)))
    packed = packed[first]
    return (packed >> np.uint64(48)).astype(np.int64), packed & np.uint64((1 << 48) - 1), counts, digests[0], digests[1]


def _slots(short: np.ndarray) -> np.ndarray:
    """Counter of each 32-bit shingle hash in each row of the sketch, rows numbered on."""
    spread = short.astype(np.uint64)[None, :] * _SLOT_FACTORS[:, None]
    rows = np.arange(SKETCH_ROWS, dtype=np.int64)[:, None] << SKETCH_BITS
    return (mix(spread) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64) + rows


def idf_of(idf: np.ndarray, short: np.ndarray) -> np.ndarray:
    """idf of 32-bit shingle hashes: of the rows, the one with the least count, so the largest idf."""
    return idf[_slots(short)].max(axis=0)


def idf_table(docs: DataFrame, text: str = "text", span: float = IDF_SPAN, rare: float = RARE) -> np.ndarray:
    """idf by sketch slot: SKETCH_ROWS x 2^SKETCH_BITS floats (3 MB), whatever the corpus size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH_ROWS << SKETCH_BITS, np.int64)
        rows = 0
        for batch in batches:
            for start, end, data, offsets in text_blocks(batch.column(0)):
                _, hashes, _, _, _ = shingles_of(data, offsets)
                total += np.bincount(_slots(hashes >> np.uint64(16)).ravel(), minlength=len(total))
                rows += end - start
        if rows:
            parts = total.reshape(-1, CHUNK)
            used = np.flatnonzero(parts.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*used.tolist(), -1], pa.int32()),
                    pa.array([*(parts[c].astype("<u4").tobytes() for c in used), np.array([rows], "<u8").tobytes()], pa.binary()),
                ],
                ["chunk", "counts"],
            )

    def add(key, held):
        chunk = key[0].as_py()
        kind = "<u8" if chunk < 0 else "<u4"
        total = sum(np.frombuffer(x.as_py(), kind).astype(np.uint64) for x in held.column("counts"))
        return pa.table({"chunk": pa.array([chunk], pa.int32()), "counts": pa.array([total.astype("<u8").tobytes()], pa.binary())})

    counted = mapped(docs.select(F.col(text).alias("text_")), count, "chunk int, counts binary")
    rows = counted.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect()
    table = np.zeros(((SKETCH_ROWS << SKETCH_BITS) // CHUNK, CHUNK))
    n = 1.0
    for row in rows:
        values = np.frombuffer(bytes(row["counts"]), "<u8").astype(float)
        if row["chunk"] < 0:
            n = max(values[0], 1.0)
        else:
            table[row["chunk"]] = values
    load = table.reshape(SKETCH_ROWS, -1)
    share = np.clip((load - load.mean(axis=1, keepdims=True)) / n, rare, 1.0)
    return (1 + span * np.log(share) / np.log(rare)).astype(np.float32).ravel()


def _samples(texts: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of the winning draw of each sample of each text that has shingles, and those texts."""
    first = np.flatnonzero(np.concatenate([[True], texts[1:] != texts[:-1]])) if len(texts) else np.zeros(0, np.int64)
    out = np.zeros((len(first), len(_SAMPLE_FACTORS)), np.uint32)
    ln_w = np.log(weights).astype(np.float32)
    # small slices keep a sample's temporaries in cache; a slice ends where a text ends
    edges = [0]
    bounds = np.append(first, len(texts))
    while edges[-1] < len(first):
        limit = bounds[edges[-1]] + 32_768
        edges.append(max(edges[-1] + 1, int(np.searchsorted(bounds, limit, side="right")) - 1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        lo, hi = bounds[a], bounds[b]
        own, ln_own, cuts = hashes[lo:hi], ln_w[lo:hi], first[a:b] - lo
        for j, factor in enumerate(_SAMPLE_FACTORS):
            draw = table[((own + np.uint64(1)) * factor) >> np.uint64(64 - _TABLE_BITS)]
            value = draw[:, 3] - draw[:, 2] * np.floor(ln_own * draw[:, 0] + draw[:, 1])
            out[a:b, j] = np.minimum.reduceat(value, cuts).view(np.uint32)
    return out, texts[first]


def signatures(docs: DataFrame, idf: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, k_text, node (digest of the words, null without words), weight, bands."""
    held = docs.sparkSession.sparkContext.broadcast(idf)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _sampling_table()
        for batch in batches:
            for start, end, data, offsets in text_blocks(batch.column(2)):
                texts, hashes, counts, one, two = shingles_of(data, offsets)
                n = end - start
                weights = counts * idf_of(held.value, hashes >> np.uint64(16))
                total = np.bincount(texts, weights=weights, minlength=n)
                bits, which = _samples(texts, hashes, weights, n, table)
                keys = np.zeros((n, BANDS), np.uint64)
                for band in range(BANDS):
                    value = np.full(len(which), band + 1, np.uint64)
                    for row in range(ROWS):
                        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + bits[:, band * ROWS + row])
                    keys[which, band] = value
                some = np.zeros(n, bool)
                some[which] = True
                nodes = [f"{a:016x}{b:016x}" if ok else None for a, b, ok in zip(one, two, some, strict=True)]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, n), batch.column(1).slice(start, n),
                        pa.array(nodes, pa.string()), pa.array(total, pa.float64()), flat,
                    ],
                    ["doc_id", "k_text", "node", "weight", "bands"],
                )

    own = docs.select(F.col(key).cast("long").alias("doc_id"), row_key(F.col(key), F.col(text))[1], F.col(text).alias("text_"))
    return mapped(own, work, "doc_id long, k_text long, node string, weight double, bands array<long>")


def _wanted_bits(wanted: DataFrame) -> np.ndarray:
    """Bits of the digests that occur in `wanted`: a filter of fixed size without false negatives."""
    slot = F.conv(F.substring("node", 1, FILTER_DIGITS), 16, 10).cast("long")
    rows = wanted.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")
    ).collect()
    # bucket numbers begin at 1, the slot 0 has the bucket 0
    held = np.zeros(16**FILTER_DIGITS // 8 + 3 * 4096, np.uint8)
    for row in rows:
        held[row["bucket"] * 4096 : (row["bucket"] + 1) * 4096] |= np.frombuffer(bytes(row["bits"]), np.uint8)
    return held


def _bit_of(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of a slot, as bitmap_bucket_number and bitmap_bit_position number them."""
    bucket = np.where(slots > 0, 1 + (slots - 1) // 32768, 0)
    position = np.where(slots > 0, (slots - 1) % 32768, 0)
    return bucket * 4096 + position // 8, (position % 8).astype(np.uint8)


def _shingle_rows(docs: DataFrame, text: str, bits: np.ndarray) -> DataFrame:
    """node, shingles: sorted 32-bit hashes, repeated as often as they occur, little-endian.

    Only texts whose digest passes the filter, so that few others are moved.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for start, end, data, offsets in text_blocks(batch.column(0)):
                texts, hashes, counts, one, two = shingles_of(data, offsets)
                spot, bit = _bit_of((one >> np.uint64(64 - 4 * FILTER_DIGITS)).astype(np.int64))
                chosen = np.flatnonzero((held[spot] >> bit) & 1)
                short = np.repeat((hashes >> np.uint64(16)).astype("<u4"), counts)
                cuts = np.searchsorted(np.repeat(texts, counts), np.arange(end - start + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{one[n]:016x}{two[n]:016x}" for n in chosen], pa.string()),
                        pa.array([short[cuts[n] : cuts[n + 1]].tobytes() for n in chosen], pa.binary()),
                    ],
                    ["node", "shingles"],
                )

    return mapped(docs.select(F.col(text).alias("text_")), work, "node string, shingles binary")


def forest(lists: list[np.ndarray], idf: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Spanning forest of the pairs (one in `left`, one in `right`) of similarity `least` or more.

    Occurrences of a shingle within a document are numbered, so sums of minima are weights of
    shared elements. Only elements of two documents or more enter the product.
    """
    sizes = np.array([len(x) for x in lists])
    of = np.repeat(np.arange(len(lists)), sizes)
    every = np.concatenate(lists)
    change = np.concatenate([[True], (every[1:] != every[:-1]) | (of[1:] != of[:-1])])
    begin = np.maximum.accumulate(np.where(change, np.arange(len(every)), 0))
    element = (every.astype(np.uint64) << np.uint64(24)) | (np.arange(len(every)) - begin).astype(np.uint64)
    weight = idf_of(idf, every).astype(np.float64)
    total = np.bincount(of, weights=weight, minlength=len(lists))
    order = np.argsort(element, kind="stable")
    sorted_ = element[order]
    fresh = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    group = np.cumsum(fresh) - 1
    repeated = np.bincount(group)[group] > 1
    rows, columns, values = of[order][repeated], group[repeated], weight[order][repeated]
    shared = np.zeros((len(lists), len(lists)))
    if len(rows):
        columns = np.cumsum(np.concatenate([[True], columns[1:] != columns[:-1]])) - 1
        width = int(columns[-1]) + 1
        for start in range(0, width, 2048):
            inside = (columns >= start) & (columns < start + 2048)
            dense = np.zeros((len(lists), min(2048, width - start)), np.float64)
            dense[rows[inside], columns[inside] - start] = np.sqrt(values[inside])
            shared += dense @ dense.T
    similar = shared >= (least - 1e-9) * (total[:, None] + total[None, :] - shared)
    root = list(range(len(lists)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = []
    for a, b in zip(*np.nonzero(np.triu(similar, 1)), strict=True):
        if not ((left[a] and right[b]) or (left[b] and right[a])):
            continue
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            found.append((int(a), int(b)))
    return found


def links(docs: DataFrame, nodes: DataFrame, idf: np.ndarray, text: str = "text", least: float = LEAST) -> DataFrame:
    """a, b: links that connect what similar nodes connect. `nodes` has node, weight, bands."""
    keyed = nodes.select("node", "weight", F.posexplode("bands").alias("band", "value"))
    own = ["band", "value"]
    sized = keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*own))).filter("n > 1").drop("n")
    sized = pinned(sized)
    wanted = sized.select("node").distinct()
    found = _shingle_rows(docs, text, _wanted_bits(wanted))
    shingles = pinned(found.join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    # block numbers by weight: a block is full at BLOCK nodes or BLOCK_SHINGLES of weight
    order = Window.partitionBy(*own).orderBy("weight", "node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    share = F.lit(1.0 / BLOCK) + F.col("weight") / F.lit(float(BLOCK_SHINGLES))
    blocked = sized.withColumn("block", F.floor(F.sum(share).over(order) - share).cast("int"))
    spans = blocked.groupBy(*own, "block").agg(F.min("weight").alias("least_w"), F.max("weight").alias("most_w"))
    spans = pinned(spans)
    one, two = spans.alias("one"), spans.alias("two")
    # blocks of one bucket that can hold a similar pair; one row a pair of blocks
    meets = one.join(two, own).filter(
        (F.col("one.block") <= F.col("two.block")) & (F.col("one.most_w") >= F.lit(least - 1e-9) * F.col("two.least_w"))
    ).select(*own, F.col("one.block").alias("low"), F.col("two.block").alias("high"))
    sides = meets.select(*own, "low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    members = blocked.select(*own, "block", "node").join(sides, [*own, "block"]).join(shingles, "node")
    group = [*own, "low", "high"]
    dealt = members.repartition(*group).sortWithinPartitions(*group, "node").select(*group, "block", "node", "shingles")
    held_idf = docs.sparkSession.sparkContext.broadcast(idf)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(name, rows):
            lists = [np.frombuffer(r[2], "<u4") for r in rows]
            block = np.array([r[0] for r in rows])
            found = forest(lists, held_idf.value, block == name[2], block == name[3], least)
            return [(rows[a][1], rows[b][1]) for a, b in found]

        def emit(pairs):
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], ["a", "b"]
            )

        name, rows, out = None, [], []
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
            blocks, ids, lists = batch.column(4).to_pylist(), batch.column(5).to_pylist(), batch.column(6)
            for at, current in enumerate(names):
                if current != name:
                    if len(rows) > 1:
                        out += linked(name, rows)
                    name, rows = current, []
                rows.append((blocks[at], ids[at], lists[at].as_py()))
            if len(out) > 10_000:
                yield emit(out)
                out = []
        if len(rows) > 1:
            out += linked(name, rows)
        yield emit(out)

    return mapped(dealt, work, "a string, b string").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node that has a link.

    Alternating large-star and small-star contraction until nothing changes; each round writes its edges, so lineage
    stays short and a lost executor costs a round. Rounds grow with the logarithm of the size.
    """
    current = pinned(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = lambda x: x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = mark(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours above a node go to the least of its neighbourhood
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below a node, and the node, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        following = pinned(small.filter("u <> v").distinct())
        now = mark(following)
        current = following
        if now == before:
            break
        before = now
    found = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """doc_id, k_text, node, class_id (the least id of the class), root of every document row.

    The root tells classes apart, also where ids are null or shared by unrelated texts; rows
    without a word have none and are each a class of their own."""
    idf = idf_table(docs, text)
    found = pinned(signatures(docs, idf, key, text))
    nodes = found.filter(F.col("node").isNotNull()).groupBy("node").agg(
        F.first("weight").alias("weight"), F.first("bands").alias("bands"), F.min("doc_id").alias("least_id")
    )
    nodes = pinned(nodes)
    roots = pinned(components(links(docs, nodes, idf, text, least)))
    # ids first gather by node, so a class of many copies is few rows here
    by_root = nodes.select("node", "least_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_ids = by_root.groupBy("root").agg(F.min("least_id").alias("class_id"))
    of_node = by_root.select("node", "root").join(least_ids, "root").select("node", "class_id", "root")
    return found.select("doc_id", "k_text", "node").join(of_node, "node", "left").select(
        "doc_id", "k_text", "node", F.coalesce("class_id", "doc_id").alias("class_id"), "root"
    )


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of `docs`, all columns, that stay: of each class the row of least id, null ids
    last, one of equal rows; rows without a word stay."""
    spark: SparkSession = docs.sparkSession
    found = pinned(classes(docs, key, text, least))
    names = row_key(F.col("doc_id"), F.lit(None).cast("string"))[0]
    worded = found.filter(F.col("node").isNotNull()).withColumn("k_id", names)
    # of rows of one id and several texts in a class, the least text hash stays
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k_text", "k_id")
    kept = worded.groupBy("root").agg(F.min(first).alias("kept")).select("kept.k_id", "kept.k_text")
    rows = worded.groupBy("k_id", "k_text").agg(F.count(F.lit(1)).alias("copies"))
    # a text has one root, so id and text alone tell which rows are kept
    decided = rows.join(kept.withColumn("stays", F.lit(True)), ["k_id", "k_text"], "left")
    # what goes, and what stays but is repeated; both are fewer than the documents
    goes = pinned(decided.filter(F.col("stays").isNull()).select("k_id", "k_text"))
    again = pinned(decided.filter(F.col("stays") & (F.col("copies") > 1)).select("k_id", "k_text"))
    own = docs.columns
    inner = [f"c{n}" for n in range(len(own))]
    renamed = docs.toDF(*inner)
    at = {name: inner[own.index(name)] for name in (key, text)}
    keyed = renamed.select("*", *row_key(F.col(at[key]), F.col(at[text])))
    # most rows are none of these and stay where they are; of the others whole texts are moved
    named, unnamed = _split_by_bits(keyed, goes.unionByName(again))
    stays = named.join(goes.hint("merge"), ["k_id", "k_text"], "left_anti")
    once = stays.join(again.hint("merge"), ["k_id", "k_text"], "left_anti")
    repeated = stays.join(again.hint("merge"), ["k_id", "k_text"], "left_semi").dropDuplicates(["k_id", "k_text"])
    return unnamed.select(*inner).unionByName(once.select(*inner)).unionByName(repeated.select(*inner)).toDF(*own)


def _split_by_bits(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`rows` (k_id, k_text, ...) that may have a key of `keys`, and those that surely have none.

    The bits of the keys are 2^24 at any size, at most 513 rows of 4 KB, so sending them to
    every executor is bounded; where they fill up, more rows count as possible and none is lost.
    """
    slot = F.xxhash64("k_id", "k_text").bitwiseAND(F.lit((1 << 24) - 1))
    bits = keys.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket_")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits_")
    )
    place = F.bitmap_bit_position(slot)
    cell = F.conv(F.hex(F.substring("bits_", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(cell, (place % 8).cast("int")) == 1, F.lit(False))
    marked = rows.withColumn("bucket_", F.bitmap_bucket_number(slot)).join(F.broadcast(pinned(bits)), "bucket_", "left")
    tested = marked.withColumn("held_", held).drop("bucket_", "bits_")
    return tested.filter("held_").drop("held_"), tested.filter(~F.col("held_")).drop("held_")
