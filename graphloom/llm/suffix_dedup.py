"""Operator 3: removes byte strings that an earlier document has too (suffix arrays).

Texts are dealt by minimiser (see windows.py), so that every 50-byte string has one owner. The owner cuts what it got into shards of
bounded size, builds the suffix array of each by Larsson-Sadakane refinement (only groups still tied are sorted again, at doubled depth),
takes Kasai's common prefixes, and so has each shard's distinct strings in order with the smallest id of each; it merges the shards by
binary search in the merged order, and looks the smallest ids up again the same way.

Defined results: a null text is empty; texts under 50 bytes keep all; rows of one doc_id never remove each other's bytes; a null doc_id
counts as larger than any other. Cuts fall between bytes, so the kept bytes of a text need not be valid UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import real_id
from graphloom.llm.windows import remove_repeats, runs_of, union_length

#: Bytes of a string, of the grams whose least hash is its minimiser, and of a shard.
STRING_BYTES, GRAM_BYTES, SHARD_BYTES = 50, 20, 1 << 18

_RESULT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
_DIGEST = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


#: The least numbers of two bytes, of three, and so on to eight.
_HEIGHTS = np.uint64(1) << np.arange(8, 64, 8, dtype=np.uint64)


def _eights(data: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes from each of the first n places as one number, big end first; data is padded."""
    out = np.zeros(n, dtype=np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= data[k : k + n]
    return out


def suffix_array(data: np.ndarray, margin: int, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of data in order, and the eight bytes from each place (and from `margin` places past the end).

    Larsson and Sadakane: sort by eight bytes, then sort each group that is still tied by the rank of what follows, at doubled depth,
    until none is tied or `depth` bytes are compared.
    """
    n = len(data)
    eights = _eights(np.concatenate([data, np.zeros(margin + 16, dtype=np.uint8)]), n + margin + 8)
    order = np.argsort(eights[:n])
    rank = np.zeros(n + 1, dtype=np.int64)  # at n: past the end, before all

    def heads_of(differs: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(differs, np.arange(len(differs)), 0))

    differs = np.concatenate([[True], eights[order[1:]] != eights[order[:-1]]])
    # the zeros past the end are no bytes: suffixes that reach them are told apart by their lengths in the next round
    short = np.flatnonzero(order > n - 8)
    rank[order] = heads_of(differs) + 1
    tied, have = np.flatnonzero(~(differs & np.append(differs[1:], True))), 8
    if len(short) and not data[-8:].all():  # real zero bytes near the end: begin at single bytes instead
        order = np.argsort(data)
        differs = np.concatenate([[True], data[order[1:]] != data[order[:-1]]])
        rank[order] = heads_of(differs) + 1
        tied, have = np.flatnonzero(~(differs & np.append(differs[1:], True))), 1
    while len(tied) and (depth is None or have < depth):
        own = order[tied]
        key = rank[own] * (n + 2) + rank[np.minimum(own + have, n)]
        again = np.argsort(key)
        order[tied], key = own[again], key[again]
        differs[tied] = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[tied]] = heads_of(differs)[tied] + 1
        tied = tied[~(differs & np.append(differs[1:], True))[tied]]
        have *= 2
    return order, eights


def common_prefixes(order: np.ndarray, eights: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, up to `most` (Kasai: at least one less than its left neighbour's).

    Works on every eighth place at once; the places after them start from their left neighbours' lengths. Neighbours that share `most` bytes
    may be tied in an order of limited depth (above `most`), where the bound fails, so what follows these starts from nothing.
    """
    n = len(order)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n + 1, dtype=np.int64)
    for first in range(8):
        p = np.arange(first, n, 8)
        length = np.where(shared[p - 1] < most, np.maximum(shared[p - 1] - 1, 0), 0) if first else np.zeros(len(p), dtype=np.int64)
        length[before[p] < 0] = 0
        live = np.flatnonzero((before[p] >= 0) & (length < most))
        while len(live):
            at, other = p[live] + length[live], before[p[live]] + length[live]
            differ = eights[at] ^ eights[other]
            high = np.where(differ == 0, 8, 7 - np.searchsorted(_HEIGHTS, differ, "right"))  # bytes equal from the big end
            length[live] += high
            live = live[(high == 8) & (length[live] < most)]
        shared[p] = np.minimum(length, most)
    return shared[order]


class _Shard:
    """The distinct strings of one shard in order, and where each occurs. Places and groups are 32-bit numbers, as a shard is small."""

    def __init__(self, strings: list[bytes], ids: np.ndarray, width: int):
        data = np.frombuffer(b"".join(strings), np.uint8)
        sizes = np.array([len(s) for s in strings], dtype=np.int32)
        self.ids, self.ends = ids, np.cumsum(sizes)
        owner = np.repeat(np.arange(len(strings), dtype=np.int32), sizes)
        order, eights = suffix_array(data, width, 2 * width)
        shared = common_prefixes(order, eights, width)
        del eights
        whole = order + width <= self.ends[owner[order]]  # others run past their string's end
        group = np.cumsum(shared < width)[whole]
        self.places = order[whole].astype(np.int32)
        new = np.diff(group, prepend=-1) != 0
        heads = np.flatnonzero(new)
        self.group = (np.cumsum(new) - 1).astype(np.int32)
        self.smallest = np.minimum.reduceat(ids[owner[self.places]], heads)
        views = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(width, dtype=np.uint8)]), width)
        self.heads = np.ascontiguousarray(views[self.places[heads]]).view(f"S{width}").ravel()

    def runs(self, smallest: np.ndarray) -> Iterator[tuple[int, int, int]]:
        owner = np.searchsorted(self.ends, np.arange(self.ends[-1]), "right")  # of each byte
        flags = np.zeros(len(owner), dtype=bool)
        flags[self.places] = self.ids[owner[self.places]] > smallest[self.group]
        first = np.concatenate([[0], self.ends[:-1]])
        yield from runs_of(flags, owner, np.arange(len(owner)) - first[owner])


def repeated_strings(strings: list[bytes], ids: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """(string, first place, places) of the runs of `width`-byte strings that also start in a string of a smaller id.

    Called for about PART_BYTES at a time (see windows.py), so the shards that live at once are few.
    """
    cuts, total = [0], 0
    for i, s in enumerate(strings):
        if total and total + len(s) > SHARD_BYTES:
            cuts.append(i)
            total = 0
        total += len(s)
    cuts.append(len(strings))
    shards = [_Shard(strings[a:b], ids[a:b], width) for a, b in zip(cuts[:-1], cuts[1:])]
    merged, smallest = shards[0].heads, shards[0].smallest
    for shard in shards[1:]:
        at = np.searchsorted(merged, shard.heads)
        known = (at < len(merged)) & (merged[np.minimum(at, len(merged) - 1)] == shard.heads)
        smallest[at[known]] = np.minimum(smallest[at[known]], shard.smallest[known])
        merged, smallest = np.insert(merged, at[~known], shard.heads[~known]), np.insert(smallest, at[~known], shard.smallest[~known])
    for shard, first in zip(shards, cuts[:-1]):
        for s, position, n in shard.runs(smallest[np.searchsorted(merged, shard.heads)]):
            yield first + s, position, n


def _kept(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, bytes]:
    if not len(starts):
        return len(text), 0, 0, text
    s, e = union_length(starts, ends)
    kept, at = [], 0
    for a, b in zip(s.tolist(), e.tolist()):
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return len(text), int((e - s).sum()), len(s), b"".join(kept)


def _kept_digest(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, int, str]:
    *counts, kept = _kept(text, starts, ends)
    return *counts, hashlib.sha256(kept).hexdigest()


def dedup_bytes(docs: DataFrame, width: int = STRING_BYTES, gram: int = GRAM_BYTES, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept bytes (with digest: kept_sha256 in their place), one row for each row of docs."""
    schema, last, kind = (_DIGEST, "kept_sha256", "string") if digest else (_RESULT, "kept", "binary")
    out = remove_repeats(docs, "byte", width, min(gram, width), repeated_strings, _kept_digest if digest else _kept, schema, f"id long, n_bytes long, n_removed long, n_spans long, {last} {kind}")
    return out.select(real_id().alias("doc_id"), "n_bytes", "n_removed", "n_spans", last)
