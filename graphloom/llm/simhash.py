"""Operator 6: SimHash near-duplicates by deletion-variant signatures.

At most `most_bits` of a fingerprint's bits may differ. Cut into most_bits // 2 + 1 segments, one of them differs by at most one bit; so
each segment is indexed once for each of its bits, with that bit taken out (a wildcard), and linked fingerprints meet in at least one of
these variants. A wildcard lies in one half of its segment and leaves the other half whole: so a row travels for each half, not for each
bit, to the bucket that the whole half names, and its owner forms the variants there, joins equal ones and compares the fingerprints in
full. Only distinct fingerprints take part.

Large groups of equal variants are divided before they are compared: at most `most_bits` bits differ, so of most_bits + 1 pieces of two
linked fingerprints one is equal, and the group is joined by pieces. Where many still share a variant and a piece, the owner walks through
them (each reached one is compared with those not reached yet) and sends a spanning forest of the links, not all pairs.

`near_components` has the 64-bit fingerprint of four-word shingles, at most four bits apart, and misses no link. `similar_components` is for
sets of five-word shingles with a similarity of 0.8 and more, which differ in more bits: it takes 512 bits, of which 15.2 % differ on average
at a similarity of 0.8, links fingerprints at most `WIDE_BITS` apart, and indexes 20 segments of 16 bits: by the binomial distribution, one of
them differs by at most one bit with a chance of 99.9 % at 0.8. Its similarity is thus an estimate, with a standard deviation of 0.037 at 0.8.

Defined results: A-Z are folded; null and empty texts have the fingerprint zero; texts of fewer words than a shingle are one shingle;
repeated rows and ids share a component; a null doc_id counts as the largest (a component_id is null only if all of its component's ids are).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BYTE_VALUES, chunks, dealt_to, keyed, longs_of, mix, real_id, row_batch, shuffle_partitions, span_hashes, texts_of, unpack, word_bounds
from graphloom.llm.windows import _SENT_DDL, _dealt, by_bucket
from graphloom.operators.components import star_components
from graphloom.session import materialise, release

#: Differing bits of a link, at most; words in a shingle; of 64-bit fingerprints and of wide ones.
MOST_BITS, SHINGLE_WORDS = 4, 4
WIDE_WORDS, WIDE_BITS, WIDE_SHINGLE = 8, 84, 5
#: Groups of at most so many rows are compared pairwise in numpy; larger ones are divided or walked. Bytes of rows for each bucket.
PAIRWISE, BUCKET_BYTES = 32, 4 << 20
#: Bytes of text hashed at once.
CHUNK_BYTES = 1 << 18

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_FOLDED = BYTE_VALUES.copy()
_FOLDED[65:91] = BYTE_VALUES[97:123]
_FACTORS = np.random.default_rng(5008).integers(0, 1 << 63, WIDE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: The eight bits of a byte, each in a byte of its own.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()

_PRINT = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("print", pa.int64())])
_WIDE = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("print", pa.int64()), ("bits", pa.binary()), ("name", pa.int64()), ("size", pa.int32()), ("parity", pa.binary())])
_WIDE_DDL = "id long, key long, print long, bits binary, name long, size int, parity binary"
_LINK = pa.schema([("src", pa.int64()), ("dst", pa.int64())])


@dataclass(frozen=True)
class Index:
    """How fingerprints are indexed: (first bit, width) of the segments, each within one 64-bit word; bits of a link, at most; 64-bit words."""

    segments: tuple[tuple[int, int], ...]
    most: int
    words: int = 1

    def halves(self) -> list[tuple[int, int, int, int]]:
        """(first bit and width of the half that stays whole, those of the half with the wildcard)."""
        out = []
        for first, width in self.segments:
            low = width // 2
            out += [(first, low, first + low, width - low), (first + low, width - low, first, low)]
        return out


NARROW = Index(((0, 21), (21, 21), (42, 22)), MOST_BITS)
WIDE = Index(tuple((16 * k, 16) for k in range(20)), WIDE_BITS, WIDE_WORDS)


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The 64 majority bits of the shingles' XXH64."""
    parts = text.translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    n = max(1, len(parts) - words + 1)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[min(words, len(parts)) - 1 :].tolist())], dtype=np.uint64)
    return int(majority(hashes[:, None], np.array([len(hashes)]))[0, 0])


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each run of rows (sizes, all positive) the bits set in over half of its rows."""
    ends = np.cumsum(sizes)
    blocks = -(-sizes // 255)  # so many rows can be summed in one byte for each bit
    first = np.cumsum(blocks) - blocks
    nth = np.arange(blocks.sum()) - np.repeat(first, blocks)
    heads = np.repeat(ends - sizes, blocks) + 255 * nth
    out = np.empty((len(sizes), hashes.shape[1]), dtype=np.uint64)
    for w in range(hashes.shape[1]):
        spread = _SPREAD[np.ascontiguousarray(hashes[:, w]).view(np.uint8)].reshape(-1, 8)
        sums = np.add.reduceat(spread, heads, axis=0).view(np.uint8).reshape(-1, 64)
        ones = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
        out[:, w] = np.packbits(ones * 2 > sizes[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.array([fingerprint(t) for t in texts_of(b)], dtype=np.uint64).view(np.int64)
        yield row_batch(_PRINT, longs_of(b, "id"), longs_of(b, "key"), prints)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, key, print) of each row; print is signed."""
    return keyed(docs).mapInArrow(_fingerprints, "id long, key long, print long")


def shingle_sets(texts: list[bytes], words: int = WIDE_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): the distinct shingle hashes of each text, ascending, one text after the other."""
    data = b"\n".join(texts) + b"\n"
    firsts = np.cumsum([0] + [len(t) + 1 for t in texts])
    buf = np.frombuffer(data, np.uint8)
    starts, ends = word_bounds(buf)
    base = np.searchsorted(starts, firsts)
    counts = np.diff(base)
    n = np.where(counts > 0, np.maximum(1, counts - words + 1), 0)
    owner = np.repeat(np.arange(len(texts)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + base[owner]
    hashes = span_hashes(span_hashes(_FOLDED[buf], starts, ends), at, np.minimum(at + words, base[owner + 1]))
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.bincount(owner[new], minlength=len(texts))


def set_names(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of each set of shingle_sets()."""
    ends = np.cumsum(sizes)
    return np.array([xxhash.xxh64_intdigest(hashes[a:b].tobytes()) - (1 << 63) for a, b in zip((ends - sizes).tolist(), ends.tolist())], dtype=np.int64)


def parities(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each set of shingle_sets() whether an odd number of its hashes names a bit, by their low bits: a power of two of 64-bit words, of about a bit for each
    hash. Two sets differ in at least as many hashes as these bits do."""
    width = 64 << np.ceil(np.log2(np.maximum(1, sizes / 64))).astype(np.int64)
    ends = np.cumsum(width)
    at = np.repeat(ends - width, sizes) + (hashes & np.repeat(width - 1, sizes).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(width.sum())).astype(np.uint8) & np.uint8(1)
    packed = np.packbits(odd, bitorder="little").tobytes()
    return [packed[a:b] for a, b in zip(((ends - width) // 8).tolist(), (ends // 8).tolist())]


def wide_prints(texts: list[bytes], words: int = WIDE_SHINGLE) -> np.ndarray:
    """The 512 majority bits of each text's set of shingles (rows of eight numbers; all zero for an empty set)."""
    return prints_of_sets(*shingle_sets(texts, words))


def prints_of_sets(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sizes), WIDE_WORDS), dtype=np.uint64)
    if len(hashes):
        out[sizes > 0] = majority(np.stack([mix(hashes * f) for f in _FACTORS], axis=1), sizes[sizes > 0])
    return out


def wide_names(bits: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of each wide fingerprint."""
    return np.array([xxhash.xxh64_intdigest(p.tobytes()) - (1 << 63) for p in bits], dtype=np.int64)


def _wide(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for texts, cols in chunks(batches, CHUNK_BYTES):
        sets = shingle_sets(texts, words)
        bits = prints_of_sets(*sets)
        yield row_batch(_WIDE, cols["id"], cols["key"], wide_names(bits), [p.tobytes() for p in bits], set_names(*sets), sets[1].astype(np.int32), parities(*sets))


def _field(prints: np.ndarray, first: int, width: int) -> np.ndarray:
    return (prints[:, first // 64] >> np.uint64(first % 64)) & np.uint64((1 << width) - 1)


def _halves(batches: Iterator[pa.RecordBatch], index: Index, n: int) -> Iterator[pa.RecordBatch]:
    """A row for each half of each segment of each fingerprint, packed by the bucket that the half's place and value name. The owner knows the names of wide ones by their bits."""
    for b in batches:
        names = longs_of(b, "print")
        for at in range(0, len(names), 4096):
            own = names[at : at + 4096]
            bits = np.frombuffer(b"".join(texts_of(b, "bits")[at : at + 4096]), np.uint64).reshape(len(own), -1) if index.words > 1 else own.view(np.uint64)[:, None]
            codes = np.concatenate([np.uint64(k << 32) | _field(bits, first, width) for k, (first, width, _, _) in enumerate(index.halves())])
            every = np.tile(np.arange(len(own)), len(index.halves()))
            more = [np.ascontiguousarray(bits[every, w]) for w in range(index.words)] if index.words > 1 else [own[every]]
            yield from _dealt((mix(codes) % np.uint64(n)).astype(np.int64), 1, [codes, *more])


def _walk(bits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints, as pairs of their places."""
    left, right = [], []
    rest, stack = np.arange(1, len(bits)), [0]
    while len(rest):
        if not stack:
            stack, rest = [int(rest[0])], rest[1:]
            continue
        one = stack.pop()
        near = _apart(bits[rest], bits[one]) <= most
        if near.any():
            found = rest[near]
            left.append(np.full(len(found), one))
            right.append(found)
            stack += found.tolist()
            rest = rest[~near]
    return tuple(np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (left, right))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _joined(key: np.ndarray, places: np.ndarray, bits: np.ndarray, most: int, large) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked places with equal keys (sorted): all pairs of small groups, of larger ones what large(places) yields."""
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    heads = np.flatnonzero(new)
    sizes = np.diff(heads, append=len(key))
    for h, s in zip(heads[sizes > PAIRWISE].tolist(), sizes[sizes > PAIRWISE].tolist()):
        yield from large(places[h : h + s])
    small = np.repeat((sizes > 1) & (sizes <= PAIRWISE), sizes)
    k, p = key[small], places[small]
    for step in range(1, PAIRWISE):
        same = np.flatnonzero(k[step:] == k[:-step])
        if not len(same):
            break
        near = same[_apart(bits[p[same]], bits[p[same + step]]) <= most]
        yield p[near], p[near + step]


def links_of(codes: np.ndarray, names: np.ndarray, bits: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Linked names among rows that meet in whole halves (codes): their variants are formed, joined and compared."""
    halves = index.halves()
    lefts, rights = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]

    def add(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> None:
        for a, b in pairs:
            lefts.append(np.minimum(names[a], names[b]))
            rights.append(np.maximum(names[a], names[b]))

    def walked(places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a, b = _walk(bits[places], index.most)
        yield places[a], places[b]

    def divided(places: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces of equal width, one more than bits may differ: some piece of two linked fingerprints is equal."""
        count, total = index.most + 1, 64 * index.words
        if total // count < 8:  # pieces of few bits divide little
            yield from walked(places)
            return
        cuts = [total * k // count for k in range(count + 1)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            value = _field(bits[places], a, b - a)
            order = np.argsort(value, kind="stable")
            yield from _joined(value[order], places[order], bits, index.most, walked)

    for half, (_, _, first, width) in enumerate(halves):
        own = np.flatnonzero(codes >> np.uint64(32) == half)
        if len(own) < 2:
            continue
        rest, whole = _field(bits[own], first, width), codes[own] << np.uint64(32)
        for k in range(width):
            variant = whole | (rest & ~np.uint64(1 << k))
            order = np.argsort(variant, kind="stable")
            add(_joined(variant[order], own[order], bits, index.most, divided))
        if len(lefts) > 64:
            pairs = np.unique(np.stack([np.concatenate(lefts), np.concatenate(rights)], axis=1), axis=0)
            lefts, rights = [pairs[:, 0]], [pairs[:, 1]]
    pairs = np.unique(np.stack([np.concatenate(lefts), np.concatenate(rights)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _links(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    for _, _, rows in by_bucket(batches):
        codes, *bits = (np.concatenate(x) for x in zip(*(unpack(payload, *[np.uint64] * (1 + index.words))[:-1] for payload in rows)))
        bits = np.stack(bits, axis=1)
        yield row_batch(_LINK, *links_of(codes, wide_names(bits) if index.words > 1 else bits[:, 0].view(np.int64), bits, index))


def linked_groups(prints: DataFrame, index: Index) -> DataFrame:
    """(print, first, label) of the distinct fingerprints of prints (written; id, key, print, for wide ones bits): the least (id, key) that has it, and its component."""
    more = [F.first("bits").alias("bits")] if index.words > 1 else []
    distinct = materialise(prints.groupBy("print").agg(F.min(F.struct("id", "key")).alias("first"), *more), "distinct-prints")
    row_bytes = 2 * len(index.segments) * (8 + 8 * index.words)
    n = max(shuffle_partitions(prints.sparkSession), -(-distinct.count() * row_bytes // BUCKET_BYTES))
    sent = distinct.select("print", *["bits"] * bool(more)).mapInArrow(partial(_halves, index=index, n=n), _SENT_DDL)
    links = dealt_to(sent, n).sortWithinPartitions("bucket", "kind").mapInArrow(partial(_links, index=index), "src long, dst long")
    labels = star_components(links).withColumnRenamed("id", "print")
    group = materialise(distinct.join(labels, "print", "left").select("print", "first", F.coalesce("label", "print").alias("label")), "print-groups")
    release(distinct)
    return group


def headed(prints: DataFrame, group: DataFrame) -> DataFrame:
    """prints with component, the smallest id of its group, and head_key, the smallest key of that id."""
    least = group.groupBy("label").agg(F.min("first").alias("head"))
    return prints.join(group.join(least, "label").select("print", F.col("head.id").alias("component"), F.col("head.key").alias("head_key")), "print")


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable) and text_key (xxhash64), one row for each row of docs."""
    prints = materialise(fingerprints(docs), "fingerprints")
    out = headed(prints, linked_groups(prints, NARROW))
    return out.select(real_id().alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), real_id("component").alias("component_id"), F.col("key").alias("text_key"))


def similar_components(docs: DataFrame, words: int = WIDE_SHINGLE, index: Index = WIDE) -> DataFrame:
    """doc_id, component_id (the smallest doc_id reachable by links of wide fingerprints), kept and text_key (xxhash64), one row for each row of docs.

    kept: whether the row's (doc_id, text_key) is the smallest of its component, so that also of equal or null ids one text stays.
    """
    prints = wide_fingerprints(docs, words)
    return kept_rows(headed(prints, linked_groups(prints, index)))


def wide_fingerprints(docs: DataFrame, words: int = WIDE_SHINGLE) -> DataFrame:
    """(id, key, print, bits, name, size, parity) of each row, written: print names the wide fingerprint, name the set of shingles."""
    return materialise(keyed(docs).mapInArrow(partial(_wide, words=words), _WIDE_DDL), "wide-fingerprints")


def kept_rows(rows: DataFrame) -> DataFrame:
    kept = (F.col("id") == F.col("component")) & (F.col("key") == F.col("head_key"))
    return rows.select(real_id().alias("doc_id"), real_id("component").alias("component_id"), kept.alias("kept"), F.col("key").alias("text_key"))
