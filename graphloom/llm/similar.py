"""Operator 6 for sets of shingles, without missed links: wide fingerprints first, then the similar pairs that these leave apart.

Wide fingerprints estimate a similarity, so some pairs at the least similarity (`NUMERATOR / DENOMINATOR`, 0.8) differ in more bits than a link
may. `whole_components` takes the components of `simhash.similar_components` and adds every link of two sets of different components whose
similarity is 0.8 or more, counted shingle by shingle. Sets of one component are not compared again, so families of near copies cost nothing here.

No pair is missed: two sets of a and b shingles with a similarity of 0.8 share at least 4 (a + b) / 9 of them, which is no less than 4 a / 5. So, with all
shingles in one order, the first a // 5 + 1 of one set and the first b // 5 + 1 of the other share one (the prefix filter). Any order is right;
rare shingles come first, so that those of common lines are seldom among the first. How often a shingle occurs is counted over all rows in
2^22 counters, which shingles share by their hashes. Of a set, 32 bits of the first shingles travel to the buckets that they name; those that several sets have come
back with their sets' components. Of pairs of different ones, whose sizes and places leave room for enough shared shingles, the parities are held against each
other (`simhash.parities`): where more bits differ than shingles may, the pair is not similar. The others are compared in full; only their texts, and those
that share a slot of a 1 MB bitmap with them, travel.

Shingles and sets are told apart by 64-bit hashes; that buckets tell first shingles apart by fewer bits only makes more pairs to look at. A shingle that is among the first of n sets of different components gives up to n^2 / 2 pairs of places in one
task. Defined results otherwise as in `simhash`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import chunks, dealt_to, keyed, longs_of, pack, row_batch, shuffle_partitions, texts_of, unpack
from graphloom.llm.simhash import BUCKET_BYTES, CHUNK_BYTES, WIDE, WIDE_SHINGLE, Index, headed, kept_rows, linked_groups, set_names, shingle_sets, wide_fingerprints
from graphloom.llm.windows import _SENT, _SENT_DDL, _dealt, by_bucket
from graphloom.operators.components import star_components
from graphloom.session import materialise, release

#: The least similarity.
NUMERATOR, DENOMINATOR = 4, 5
#: Counters of shingles, as a power of two; parts in which they are summed.
COUNTER_BITS, SLICES = 22, 64
#: First shingles sent at once; held by a bucket's owner before repeated ones are dropped.
SENT_ROWS, HELD_ROWS = 1 << 18, 1 << 20
#: Of larger groups one row at a time is compared with the others.
BY_STEPS = 32

#: Slots of rows whose texts are needed, as a power of two; in one bitmap of bitmap_construct_agg().
SLOT_BITS, BITMAP_SLOTS = 23, 1 << 15

#: Of a bucket's payload: 32 bits of a shingle, name of the set, its size, the shingle's place in it.
_FIRST = (np.uint32, np.int64, np.int32, np.int32)
_RANKS = pa.schema([("slice", pa.int32()), ("total", pa.int64()), ("ranks", pa.binary())])
_SHARED = pa.schema([("code", pa.int64()), ("name", pa.int64()), ("size", pa.int32()), ("place", pa.int32())])
_PAIR = pa.schema([(c, pa.int64()) for c in ("a", "b", "label_a", "label_b")])
_SET = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("hashes", pa.binary())])
_LINK = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


def enough(shared, a, b):
    """Whether sets of a and b shingles that share so many have the least similarity."""
    return shared * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (a + b)


def first_shingles(sizes: np.ndarray) -> np.ndarray:
    """How many of a set's shingles must be looked up."""
    return sizes - -(-NUMERATOR * sizes // DENOMINATOR) + (sizes > 0)


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << COUNTER_BITS, dtype=np.uint32)
    for texts, _ in chunks(batches, CHUNK_BYTES, ()):
        np.add.at(counts, _counter(shingle_sets(texts, words)[0]), 1)
    for k, own in enumerate(np.split(counts, SLICES)):
        if own.any():
            yield row_batch(_SENT, [k], [0], [pack(own)])


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for k, _, payloads in by_bucket(batches):
        total = np.zeros((1 << COUNTER_BITS) // SLICES, dtype=np.int64)
        for payload in payloads:
            total += unpack(payload, np.uint32)[0]
        ranks = np.minimum(255, np.rint(8 * np.log2(total + 1))).astype(np.uint8)
        yield row_batch(_RANKS, [k], [int(total.sum())], [ranks.tobytes()])


def ranks_of(docs: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """(rank of each counter, the rarer the smaller; number of shingles, each text's set counted)."""
    sent = docs.mapInArrow(partial(_counted, words=words), _SENT_DDL)
    rows = dealt_to(sent, SLICES).sortWithinPartitions("bucket", "kind").mapInArrow(_ranked, "slice int, total long, ranks binary").collect()
    ranks = np.zeros((SLICES, (1 << COUNTER_BITS) // SLICES), dtype=np.uint8)
    for r in rows:
        ranks[r["slice"]] = np.frombuffer(r["ranks"], np.uint8)
    return ranks.ravel(), sum(r["total"] for r in rows)


def in_order(hashes: np.ndarray, sizes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, set, place) of the first shingles of each set by rank."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((hashes, ranks[_counter(hashes)], owner))
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = place < first_shingles(sizes)[owner]
    return hashes[order[first]], owner[first], place[first]


def _send(batches: Iterator[pa.RecordBatch], words: int, ranks: bytes, n: int) -> Iterator[pa.RecordBatch]:
    table = np.frombuffer(zstandard.ZstdDecompressor().decompress(ranks), np.uint8)
    held: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        codes, *more = (np.concatenate(x) for x in zip(*held))
        short = (codes >> np.uint64(32 - COUNTER_BITS)).astype(np.uint32)  # bits below the counter's, as first shingles have few of the counters
        yield from _dealt((codes % np.uint64(n)).astype(np.int64), 1, [short, *more])

    for texts, _ in chunks(batches, CHUNK_BYTES, ()):
        hashes, sizes = shingle_sets(texts, words)
        codes, owner, place = in_order(hashes, sizes, table)
        held.append((codes, set_names(hashes, sizes)[owner], sizes[owner].astype(np.int32), place.astype(np.int32)))
        if sum(len(x[0]) for x in held) > SENT_ROWS:
            yield from flush()
            held = []
    if held:
        yield from flush()


def _once(held: list[list[np.ndarray]]) -> list[np.ndarray]:
    """The rows sorted by shingle and set, each once, with the first place."""
    cols = [np.concatenate(x) for x in zip(*held)]
    order = np.lexsort((cols[3], cols[1], cols[0]))
    cols = [c[order] for c in cols]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
    return [c[new] for c in cols]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of shingles that several sets have."""
    for bucket, _, payloads in by_bucket(batches):
        held, since = [], 0
        for payload in payloads:
            held.append(list(unpack(payload, *_FIRST)[:4]))
            since += len(held[-1][0])
            if since > HELD_ROWS:
                held, since = [_once(held)], 0
        codes, *more = _once(held)
        same = codes[1:] == codes[:-1]
        several = np.zeros(len(codes), dtype=bool)
        several[1:] = same
        several[:-1] |= same
        if several.any():
            yield row_batch(_SHARED, codes[several].astype(np.int64) | (bucket << 32), *(c[several] for c in more))


def pairs_of(code: np.ndarray, name: np.ndarray, size: np.ndarray, place: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Rows (a, b, label_a, label_b) of what may be linked, among rows sorted by code and size."""
    out = [np.zeros((0, 4), dtype=np.int64)]

    def add(i: np.ndarray, j: np.ndarray) -> None:
        room = np.minimum(size[i] - place[i], size[j] - place[j])  # the shared shingle, if it is their first, and what may follow it
        own = (label[i] != label[j]) & enough(room, size[i], size[j])
        i, j = i[own], j[own]
        i, j = np.where(name[i] < name[j], i, j), np.where(name[i] < name[j], j, i)
        out.append(np.stack([name[i], name[j], label[i], label[j]], axis=1))

    if not len(code):
        return out[0]
    heads = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    sizes = np.diff(heads, append=len(code))
    mixed = np.minimum.reduceat(label, heads) != np.maximum.reduceat(label, heads)
    for h, s in zip(heads[mixed & (sizes > BY_STEPS)].tolist(), sizes[mixed & (sizes > BY_STEPS)].tolist()):
        ends = h + np.searchsorted(size[h : h + s], size[h : h + s] * DENOMINATOR // NUMERATOR, "right")
        for i, end in enumerate(ends.tolist(), h):
            j = np.arange(i + 1, end)
            add(np.full(len(j), i), j)
            if len(out) > 1024:
                out[:] = [np.unique(np.concatenate(out), axis=0)]
    small = np.flatnonzero(np.repeat(mixed & (sizes <= BY_STEPS), sizes))
    for step in range(1, BY_STEPS):
        i = small[:-step][code[small[step:]] == code[small[:-step]]]
        if not len(i):
            break
        add(i, i + step)
    return np.unique(np.concatenate(out), axis=0)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pairs_of() over a stream sorted by code and size."""
    held: list[list[np.ndarray]] = []

    def found(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs = pairs_of(*cols)
        if len(pairs):
            yield row_batch(_PAIR, *pairs.T)

    for b in batches:
        cols = [longs_of(b, c).astype(np.int64) for c in ("code", "name", "size", "place", "label")]
        if not len(cols[0]):
            continue
        last = int(np.searchsorted(cols[0], cols[0][-1]))  # rows of the last code may go on in the next batch
        if last or (held and held[-1][0][-1] != cols[0][0]):
            yield from found([np.concatenate(x) for x in zip(*held, [c[:last] for c in cols])])
            held = []
        held.append([c[last:] for c in cols])
    if held:
        yield from found([np.concatenate(x) for x in zip(*held)])


def differing(a: bytes, b: bytes) -> int:
    """Differing bits of two of simhash.parities(), the larger folded to the smaller."""
    a, b = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose parities leave room for enough shared shingles."""
    for b in batches:
        size_a, size_b = longs_of(b, "size_a").astype(np.int64), longs_of(b, "size_b").astype(np.int64)
        apart = np.array([differing(x, y) for x, y in zip(texts_of(b, "parity_a"), texts_of(b, "parity_b"))], dtype=np.int64)
        own = enough((size_a + size_b - apart) // 2, size_a, size_b)
        yield row_batch(_PAIR, *(longs_of(b, c)[own] for c in ("a", "b", "label_a", "label_b")))


def possible_pairs(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs that may have the least similarity, by the sizes and parities of their sets."""
    needed = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct()
    sets = prints.select("name", "size", "parity").join(needed, "name", "left_semi").dropDuplicates(["name"])
    sets = materialise(sets, "parities")
    both = pairs.join(sets.toDF("a", "size_a", "parity_a"), "a").join(sets.toDF("b", "size_b", "parity_b"), "b")
    out = materialise(both.mapInArrow(_possible, "a long, b long, label_a long, label_b long"), "possible-pairs")
    release(sets)
    return out


def _slot():
    """The slot of a row (id, key), from 1."""
    return F.xxhash64("id", "key").bitwiseAND(F.lit((1 << SLOT_BITS) - 1)) + F.lit(1)


def _sets(batches: Iterator[pa.RecordBatch], words: int, slots: bytes) -> Iterator[pa.RecordBatch]:
    held = np.frombuffer(zstandard.ZstdDecompressor().decompress(slots), np.uint8)

    def needed() -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = longs_of(b, "slot") - 1
            own = np.flatnonzero(held[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            if len(own):
                yield b.take(pa.array(own))

    for texts, cols in chunks(needed(), CHUNK_BYTES):
        hashes, sizes = shingle_sets(texts, words)
        yield row_batch(_SET, cols["id"], cols["key"], [x.tobytes() for x in np.split(hashes, np.cumsum(sizes)[:-1])])


def sets_near(texts: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(id, key, hashes) of the texts that share a slot with one of rows: all of rows, and of n others about n * count(rows) / 2^23."""
    slots = np.zeros(1 << SLOT_BITS >> 3, dtype=np.uint8)
    parts = rows.select(_slot().alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    for r in parts.collect():  # at most 2^SLOT_BITS bits
        at = (r["part"] - 1) * BITMAP_SLOTS // 8
        slots[at : at + BITMAP_SLOTS // 8] = np.frombuffer(r["bits"], np.uint8)
    packed = zstandard.ZstdCompressor(level=3).compress(slots.tobytes())
    return texts.withColumn("slot", _slot()).mapInArrow(partial(_sets, words=words, slots=packed), "id long, key long, hashes binary")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        left, right = texts_of(b, "hashes_a"), texts_of(b, "hashes_b")
        own = []
        for x, y in zip(left, right):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            own.append(bool(enough(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
        own = np.array(own, dtype=bool)
        yield row_batch(_LINK, longs_of(b, "label_a")[own], longs_of(b, "label_b")[own])


def links_between(docs: DataFrame, prints: DataFrame, group: DataFrame, words: int = WIDE_SHINGLE) -> DataFrame | None:
    """(src, dst): labels of group (of linked_groups()) that a pair of sets with the least similarity joins; None if no pair comes near it."""
    texts = keyed(docs)
    ranks, total = ranks_of(texts, words)
    n = max(shuffle_partitions(docs.sparkSession), -(-total * 20 // (DENOMINATOR * BUCKET_BYTES)))
    sent = texts.mapInArrow(partial(_send, words=words, ranks=zstandard.ZstdCompressor(level=3).compress(ranks.tobytes()), n=n), _SENT_DDL)
    shared = dealt_to(sent, n).sortWithinPartitions("bucket", "kind").mapInArrow(_shared, "code long, name long, size int, place int")
    shared = materialise(shared, "shared-shingles")
    labels = prints.select("name", "print").distinct().join(group.select("print", "label"), "print").select("name", "label")
    near = shared.join(labels, "name").repartition(shuffle_partitions(docs.sparkSession), "code").sortWithinPartitions("code", "size")
    met = materialise(near.mapInArrow(_pairs, "a long, b long, label_a long, label_b long").distinct(), "similar-pairs")
    release(shared)
    pairs = possible_pairs(met, prints)
    release(met)
    if pairs.isEmpty():
        return None
    needed = pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct()
    rows = prints.join(needed, "name", "left_semi").groupBy("name").agg(F.min(F.struct("id", "key")).alias("row"))
    rows = materialise(rows.select("name", "row.id", "row.key"), "similar-rows")
    sets = sets_near(texts, rows, words).join(rows, ["id", "key"]).select("name", "hashes").dropDuplicates(["name"])
    sets = materialise(sets, "similar-sets")
    both = pairs.join(sets.toDF("a", "hashes_a"), "a").join(sets.toDF("b", "hashes_b"), "b")
    return both.select("label_a", "label_b", "hashes_a", "hashes_b").mapInArrow(_compared, "src long, dst long")


def whole_components(docs: DataFrame, words: int = WIDE_SHINGLE, index: Index = WIDE) -> DataFrame:
    """The columns of simhash.similar_components(), by its links and those of all pairs with the least similarity."""
    prints = wide_fingerprints(docs, words)
    group = linked_groups(prints, index)
    links = links_between(docs, prints, group, words)
    if links is not None:
        joined = star_components(links).select(F.col("id").alias("label"), F.col("label").alias("least"))
        group = group.join(joined, "label", "left").select("print", "first", F.coalesce("least", "label").alias("label"))
    return kept_rows(headed(prints, group))
