"""Super-k-mer exchange: what word-window and byte-window deduplication share.

A window is `width` consecutive units (words or bytes) of one text. The least hash among the short grams of a window, its minimiser,
depends on the window's content alone, so equal windows have equal minimisers. Consecutive windows of a text with one minimiser overlap
in all but a unit each; they travel as one packed string to the bucket that the minimiser names, where all copies of each window meet.

A string whose minimiser no other id has cannot hold a repeated window. So minimisers (32 bits of them) are matched first, and only
strings with a shared one travel: text that nothing repeats costs a few bytes for each super-k-mer.

Hot content is split. Of equal packed strings in one chunk of texts only that of the smallest id goes on, as the others are known to have
an equal beside them; the bucket's owner does the same with its stream of chunks. A minimiser that occurs over `MOST_ENTRIES` times in all,
or in over `MOST_LOCAL` texts of a chunk, is hot (variants of a common passage): its windows travel one by one as 128-bit BLAKE2b
digests, of each chunk's equal ones those of the smallest id, to the buckets that the digests name. So no bucket has more than so many
strings of a minimiser, and the windows of one hot passage are dealt over all tasks. The owner works through a bucket in parts of whole
minimisers of about `PART_BYTES`; memory follows the bucket size, never the copies.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import (
    BYTE_VALUES,
    chunks,
    dealt_to,
    keyed,
    longs_of,
    mix,
    pack,
    partitions_for,
    row_batch,
    sliding_min,
    span_hashes,
    unpack,
    word_bounds,
)
from graphloom.session import free_shuffles, materialise, release

#: Bytes of text worked on at once in numpy, those whose packed strings go out together, and those that an owner compares at once.
CHUNK_BYTES, FLUSH_BYTES, PART_BYTES = 1 << 20, 8 << 20, 1 << 20
#: Windows in one packed string at most, so that repetitive texts make no boundless strings.
MOST_WINDOWS = 256
#: Bytes of text for each bucket.
BUCKET_BYTES = 16 << 20
#: A minimiser is hot beyond so many occurrences in all, or so many texts of one chunk.
MOST_ENTRIES, MOST_LOCAL = 4096, 32
#: Removals that an owner holds before they go out.
MOST_CUTS = 200_000

_SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_SENT_DDL = "bucket int, kind int, payload binary"
#: Of a bucket's payload: minimiser, id, key, first unit, windows, bytes of the string.
_STRING = (np.uint64, np.int64, np.int64, np.int32, np.int32, np.int32)
#: Of hot windows: the digest's halves, id, key, first unit.
_WINDOW = (np.uint64, np.uint64, np.int64, np.int64, np.int32)
#: Of a removal's payload: id, key, first unit, unit after the last.
_CUT = (np.int64, np.int64, np.int32, np.int32)
#: Of minimisers: 32 bits of one, id, bucket of the document, occurrences (-1: of so many texts of a chunk that they know it is hot).
_ENTRY = (np.uint32, np.int64, np.int32, np.int32)
#: Of shared minimisers: 32 bits of one, id, whether it is hot.
_REPLY = (np.uint32, np.int64, np.bool_)

_SPACE = re.compile(rb"[\x20\x09-\x0d]")


class SuperKmers:
    """The super-k-mers of some texts: owner (index of the text), first unit, end (after the last window's first unit), minimiser."""

    def __init__(self, texts: list[bytes], unit: str, width: int, gram: int):
        self.width = width
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        joint = b"\n" if unit == "word" else b""
        self.data = joint.join(texts) + joint
        buf = np.frombuffer(self.data, np.uint8)
        firsts = np.concatenate([[0], np.cumsum(sizes + len(joint))])
        self.starts = self.ends = None
        if unit == "word":
            self.starts, self.ends = word_bounds(buf)
            owner = np.searchsorted(firsts, self.starts, "right") - 1
            values = span_hashes(BYTE_VALUES[buf], self.starts, self.ends)
            self.base = np.searchsorted(self.starts, firsts)
        else:
            owner, values, self.base = np.repeat(np.arange(len(texts), dtype=np.int32), sizes), BYTE_VALUES[buf], firsts
        n = len(values)
        if n < width:
            self.owner = self.heads = self.stops = np.zeros(0, dtype=np.int64)
            self.minimiser = np.zeros(0, dtype=np.uint64)
            return
        at = np.arange(n - gram + 1)
        least = sliding_min(span_hashes(values, at, at + gram), width - gram + 1)
        m = len(least)
        new = np.ones(m, dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (owner[1:m] != owner[: m - 1])
        runs = np.flatnonzero(new)
        whole = owner[runs] == owner[runs + width - 1]
        stops = np.append(runs[1:], m)[whole]
        self.heads = runs[whole]
        self.owner = owner[self.heads].astype(np.int64)
        # a run of windows of one text is valid up to the text's last whole window
        self.stops = np.minimum(stops, self.base[self.owner + 1] - width + 1)
        self.minimiser = least[self.heads]

    def strings(self, some: np.ndarray) -> Iterator[tuple[int, int, int, int, bytes]]:
        """(owner, first unit, windows, minimiser, packed string) of some super-k-mers."""
        owner = self.owner[some]
        for h, s, o, b, m in zip(self.heads[some].tolist(), self.stops[some].tolist(), owner.tolist(), self.base[owner].tolist(), self.minimiser[some].tolist()):
            while h < s:
                e = min(s, h + MOST_WINDOWS)
                yield o, h - b, e - h, m, self.data[h : e + self.width - 1] if self.starts is None else self.data[self.starts[h] : self.ends[e + self.width - 2]]
                h = e


def pieces(texts: list[bytes], unit: str, width: int) -> Iterator[tuple[list[bytes], int]]:
    """The texts of a chunk with the number of their first unit; one text over CHUNK_BYTES comes in pieces, which overlap so that each window is whole in just one."""
    if len(texts) != 1 or len(texts[0]) <= CHUNK_BYTES:
        yield texts, 0
        return
    text, at, units = texts[0], 0, 0
    if unit == "byte":
        for at in range(0, max(1, len(text) - width + 1), CHUNK_BYTES):
            yield [text[at : at + CHUNK_BYTES + width - 1]], at
        return
    while True:
        stop = at
        while True:
            stop += CHUNK_BYTES
            gap = _SPACE.search(text, stop) if stop < len(text) else None
            end = gap.start() if gap else len(text)
            starts, _ = word_bounds(np.frombuffer(text, np.uint8, end - at, at))
            if end == len(text) or len(starts) >= 2 * width:
                break
        yield [text[at:end]], units
        if end == len(text):
            return
        at, units = at + int(starts[len(starts) - width + 1]), units + len(starts) - width + 1


class _Strings:
    """Distinct packed strings with the places of the smallest id that has each; all other places are settled as removals."""

    def __init__(self, width: int):
        self.width, self.bytes = width, 0
        self.places: dict[bytes, list[tuple[int, int, int, int, int]]] = {}
        self.cuts: list[tuple[int, int, int, int]] = []

    def cut(self, place: tuple[int, int, int, int, int]) -> None:
        _, i, k, first, windows = place
        self.cuts.append((i, k, first, first + windows + self.width - 1))

    def add(self, string: bytes, place: tuple[int, int, int, int, int]) -> None:
        """place: minimiser, id, key, first unit, windows."""
        have = self.places.get(string)
        if have is None:
            self.places[string] = [place]
            self.bytes += len(string)
        elif place[1] > have[0][1]:
            self.cut(place)
        elif place[1] == have[0][1]:
            have.append(place)
        else:
            for p in have:
                self.cut(p)
            self.places[string] = [place]


def doc_bucket(ids: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each document, by id and key: repeated and null ids spread over all."""
    return (mix(ids.view(np.uint64) ^ mix(keys.view(np.uint64))) % np.uint64(n)).astype(np.int64)


def _cut_rows(cuts: np.ndarray, n_doc_buckets: int) -> Iterator[pa.RecordBatch]:
    """Removals (id, key, first, end) to their documents; touching ones of a document are merged before they travel."""
    if not len(cuts):
        return
    a = cuts[np.lexsort((cuts[:, 2], cuts[:, 1], cuts[:, 0]))]
    other = np.concatenate([[True], (a[1:, 0] != a[:-1, 0]) | (a[1:, 1] != a[:-1, 1])])
    reach = np.maximum.accumulate((np.cumsum(other) << 33) + a[:, 3]) & ((1 << 33) - 1)  # the furthest end so far in the document
    new = other.copy()
    new[1:] |= a[1:, 2] > reach[:-1]
    heads = np.flatnonzero(new)
    ids, keys = np.ascontiguousarray(a[heads, 0]), np.ascontiguousarray(a[heads, 1])
    ends = reach[np.append(heads[1:], len(a)) - 1]
    yield from _dealt(doc_bucket(ids, keys, n_doc_buckets), 0, [ids, keys, a[heads, 2].astype(np.int32), ends.astype(np.int32)])


def _dealt(bucket: np.ndarray, kind: int, arrays: list[np.ndarray], strings: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """One row with a payload for each bucket that has any."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    rows: tuple[list, list, list] = ([], [], [])
    for a, b in zip(edges[:-1], edges[1:]):
        own = order[a:b]
        rows[0].append(int(bucket[own[0]]))
        rows[1].append(kind)
        rows[2].append(pack(*(x[own] for x in arrays), tail=b"".join([strings[i] for i in own.tolist()]) if strings is not None else b""))
    if rows[0]:
        yield row_batch(_SENT, *rows)


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heads and sizes of the runs of equal rows."""
    if not len(columns[0]):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    heads = np.flatnonzero(new)
    return heads, np.diff(heads, append=len(new))


def _minimisers(batches: Iterator[pa.RecordBatch], unit: str, width: int, gram: int, n_buckets: int, n_doc_buckets: int) -> Iterator[pa.RecordBatch]:
    """Minimisers to their buckets (kind 1); those that many texts of a chunk have are hot, and these texts are told at once (kind 0)."""

    def flush(minimiser: np.ndarray, ids: np.ndarray, docs: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((docs, ids, minimiser))
        minimiser, ids, docs = minimiser[order], ids[order], docs[order]
        heads, count = _groups(minimiser, ids, docs)
        minimiser, ids, docs, count = minimiser[heads], ids[heads], docs[heads], count.astype(np.int32)
        heads, sizes = _groups(minimiser)
        hot = np.repeat(sizes > MOST_LOCAL, sizes)
        yield from _replies(minimiser[hot].astype(np.uint32), ids[hot], docs[hot], np.ones(np.count_nonzero(hot), dtype=bool))
        count[heads[sizes > MOST_LOCAL]] = -1
        sent = np.flatnonzero(~hot | (count < 0))
        sent = sent[np.argsort(ids[sent], kind="stable")]
        yield from _dealt(_bucket_of(minimiser[sent], n_buckets), 1, [minimiser[sent].astype(np.uint32), ids[sent], docs[sent].astype(np.int32), count[sent]])

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0
    for texts, cols in chunks(batches, CHUNK_BYTES):
        docs = doc_bucket(cols["id"], cols["key"], n_doc_buckets)
        for some, _ in pieces(texts, unit, width):
            found = SuperKmers(some, unit, width, gram)
            held.append((found.minimiser, cols["id"][found.owner], docs[found.owner]))
            size += sum(map(len, some))
            if size >= FLUSH_BYTES:
                yield from flush(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
    if held:
        yield from flush(*(np.concatenate(x) for x in zip(*held)))


def _bucket_of(minimiser: np.ndarray, n_buckets: int) -> np.ndarray:
    return (mix(minimiser) % np.uint64(n_buckets)).astype(np.int64)


def _replies(minimiser: np.ndarray, ids: np.ndarray, docs: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(ids, kind="stable")
    yield from _dealt(docs[order], 0, [minimiser[order], ids[order], hot[order]])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The owner of minimisers: tells the documents which of theirs another id has too, and which of these are hot."""
    for _, _, rows in by_bucket(batches):
        minimiser, ids, docs, count = (np.concatenate(x) for x in zip(*(unpack(payload, *_ENTRY)[:4] for payload in rows)))
        order = np.lexsort((ids, minimiser))
        minimiser, ids, docs, count = minimiser[order], ids[order], docs[order], count[order]
        heads, sizes = _groups(minimiser)
        known = np.minimum.reduceat(count, heads) < 0
        hot = np.repeat(known | (np.add.reduceat(count.astype(np.int64), heads) > MOST_ENTRIES), sizes)
        shared = np.repeat(known | (ids[heads] != ids[heads + sizes - 1]), sizes) & (count > 0)  # the others know
        yield from _replies(minimiser[shared], ids[shared], docs[shared].astype(np.int64), hot[shared])


def window_digests(string: bytes, unit: str, width: int) -> list[bytes]:
    """A 128-bit digest of each window of a packed string; words count, what separates them does not."""
    digest = hashlib.blake2b
    if unit == "byte":
        return [digest(string[k : k + width], digest_size=16).digest() for k in range(len(string) - width + 1)]
    words = string.split()
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [digest(joined[a:b], digest_size=16).digest() for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


def _hot_windows(strings: _Strings, unit: str) -> np.ndarray | None:
    """Rows (digest's halves, id, key, first unit) of the windows of the strings."""
    digests, rows = [], []
    for s, places in strings.places.items():
        own = window_digests(s, unit, strings.width)
        for _, i, k, first, windows in places:
            digests += own
            rows.append((i, k, first, windows))
    if not rows:
        return None
    halves = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    a = np.array(rows, dtype=np.int64)
    each = np.repeat(np.arange(len(a)), a[:, 3])
    first = a[each, 2] + np.arange(len(each)) - np.repeat(np.cumsum(a[:, 3]) - a[:, 3], a[:, 3])
    return np.concatenate([halves.view(np.int64), a[each, :2], first[:, None]], axis=1)


def _settle(windows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal windows: those of the smallest id, and the removals of all others."""
    a = windows[np.lexsort((windows[:, 2], windows[:, 1], windows[:, 0]))]
    heads, sizes = _groups(a[:, 0], a[:, 1])
    later = a[:, 2] > np.repeat(a[heads, 2], sizes)
    gone = a[later]
    return a[~later], np.column_stack([gone[:, 2], gone[:, 3], gone[:, 4], gone[:, 4] + width])


def _send(batches: Iterator[pa.RecordBatch], unit: str, width: int, gram: int, n_buckets: int, n_doc_buckets: int) -> Iterator[pa.RecordBatch]:
    """From documents' buckets (kind 0 shared minimisers, then kind 1 texts): strings (kind 1), hot windows (kind 2), and settled removals (kind 0)."""

    cuts: list[np.ndarray] = []

    def flush(strings: _Strings) -> Iterator[pa.RecordBatch]:
        flat = [(s, p) for s, ps in strings.places.items() for p in ps]
        if flat:
            mini = np.array([p[0] for _, p in flat], dtype=np.uint64)
            cols = [np.array([p[k] for _, p in flat], dtype=_STRING[k]) for k in range(1, 5)]
            yield from _dealt(_bucket_of(mini, n_buckets), 1, [mini, *cols, np.array([len(s) for s, _ in flat], dtype=np.int32)], [s for s, _ in flat])
        yield from settled(np.array(strings.cuts, dtype=np.int64).reshape(-1, 4))

    def flush_hot(strings: _Strings) -> Iterator[pa.RecordBatch]:
        windows = _hot_windows(strings, unit)
        if windows is not None:
            windows, gone = _settle(windows, width)
            cols = [np.ascontiguousarray(windows[:, k]) for k in range(5)]
            yield from _dealt(_bucket_of(cols[0].view(np.uint64), n_buckets), 2, [cols[0], cols[1], cols[2], cols[3], cols[4].astype(np.int32)])
            yield from settled(gone)
        yield from settled(np.array(strings.cuts, dtype=np.int64).reshape(-1, 4))

    def settled(some: np.ndarray, last: bool = False) -> Iterator[pa.RecordBatch]:
        cuts.append(some)
        if last or sum(map(len, cuts)) > MOST_CUTS:
            yield from _cut_rows(np.concatenate(cuts), n_doc_buckets)
            cuts.clear()

    strings, hot_strings = _Strings(width), _Strings(width)
    told: list[tuple[np.ndarray, ...]] = []
    for _, kind, rows in by_bucket(batches):
        if kind == 0:
            told = [unpack(payload, *_REPLY)[:3] for payload in rows]
            continue
        minis, owners, hots = (np.concatenate(x) for x in zip(*told)) if told else (np.zeros(0, t) for t in _REPLY)
        told = []
        order = np.argsort(owners, kind="stable")
        minis, owners, hots = minis[order].astype(np.int64), owners[order], hots[order]
        for payload in rows if len(minis) else ():
            ids, keys, sizes, data = unpack(payload, np.int64, np.int64, np.int64)
            ends = np.cumsum(sizes)
            at = 0
            while at < len(ids):
                stop = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + CHUNK_BYTES, "right")))
                texts = [data[e - z : e] for e, z in zip(ends[at:stop].tolist(), sizes[at:stop].tolist())]
                own = ids[at:stop]
                a, b = np.searchsorted(owners, own, "left"), np.searchsorted(owners, own, "right")
                allowed = np.concatenate([np.int64(k) << 32 | minis[x:y] for k, (x, y) in enumerate(zip(a.tolist(), b.tolist()))])
                hot = np.concatenate([hots[x:y] for x, y in zip(a.tolist(), b.tolist())])
                for some, units in pieces(texts, unit, width) if len(allowed) else ():
                    found = SuperKmers(some, unit, width, gram)
                    named = found.owner << 32 | found.minimiser.astype(np.uint32).astype(np.int64)
                    is_hot = np.isin(named, allowed[hot])
                    for held, which in ((strings, np.isin(named, allowed[~hot]) & ~is_hot), (hot_strings, is_hot)):
                        for o, first, windows, mini, string in found.strings(np.flatnonzero(which)):
                            held.add(string, (mini, int(own[o]), int(keys[at + o]), units + first, windows))
                    if strings.bytes >= FLUSH_BYTES:
                        yield from flush(strings)
                        strings = _Strings(width)
                    if hot_strings.bytes >= CHUNK_BYTES:
                        yield from flush_hot(hot_strings)
                        hot_strings = _Strings(width)
                at = stop
    yield from flush(strings)
    yield from flush_hot(hot_strings)
    yield from settled(np.zeros((0, 4), dtype=np.int64), last=True)


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, Iterator[bytes]]]:
    """(bucket, kind, payloads) of each bucket and kind, of a stream sorted by both."""

    def rows():
        for b in batches:
            payloads = b.column(2)
            for k, (bucket, kind) in enumerate(zip(longs_of(b, "bucket").tolist(), longs_of(b, "kind").tolist())):
                yield bucket, kind, payloads[k]

    for (bucket, kind), own in groupby(rows(), key=lambda r: r[:2]):
        yield bucket, kind, (payload.as_py() for _, _, payload in own)


def _own(batches: Iterator[pa.RecordBatch], width: int, n_doc_buckets: int, repeated: Callable) -> Iterator[pa.RecordBatch]:
    """The owner of buckets of minimisers (kind 1) or digests (kind 2): which windows of which places also start in a smaller id.

    Removals are gathered over a task's buckets and go out in few rows, a part of them at a time.
    """
    held: list[np.ndarray] = []
    for _, kind, rows in by_bucket(batches):
        for cuts in _hot_cuts(rows, width) if kind == 2 else _string_cuts(rows, width, repeated):
            held.append(cuts)
            if sum(map(len, held)) > MOST_CUTS:
                yield from _cut_rows(np.concatenate(held), n_doc_buckets)
                held = []
    if held:
        yield from _cut_rows(np.concatenate(held), n_doc_buckets)


def _hot_cuts(rows: Iterator[bytes], width: int) -> Iterator[np.ndarray]:
    parts = [np.column_stack([c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64) for c in unpack(payload, *_WINDOW)[:5]]) for payload in rows]
    yield _settle(np.concatenate(parts), width)[1]


def _string_cuts(rows: Iterator[bytes], width: int, repeated: Callable) -> Iterator[np.ndarray]:
    strings = _Strings(width)
    for payload in rows:
        *cols, data = unpack(payload, *_STRING)
        at = 0
        for *place, size in zip(*(c.tolist() for c in cols)):
            strings.add(data[at : at + size], tuple(place))
            at += size
        if strings.cuts:
            yield np.array(strings.cuts, dtype=np.int64)
            strings.cuts.clear()
    flat = [(s, p) for s, ps in strings.places.items() for p in ps]
    strings.places.clear()
    # equal windows have one minimiser: a string whose minimiser no other id has is clean
    mini = np.array([p[0] for _, p in flat], dtype=np.uint64)
    ids = np.array([p[1] for _, p in flat], dtype=np.int64)
    order = np.lexsort((ids, mini))
    heads, sizes = _groups(mini[order])
    part, total = [], 0
    for h, n in zip(heads.tolist(), sizes.tolist()):
        some = order[h : h + n].tolist()
        if ids[some[0]] != ids[some[-1]]:
            part += some
            total += sum(len(flat[k][0]) for k in some)
        if part and (total >= PART_BYTES or h == heads[-1]):
            yield np.array(list(_repeats([flat[k] for k in part], width, repeated)), dtype=np.int64).reshape(-1, 4)
            part, total = [], 0


def _repeats(some: list[tuple[bytes, tuple[int, int, int, int, int]]], width: int, repeated: Callable) -> Iterator[tuple[int, int, int, int]]:
    for string, first, windows in repeated([s for s, _ in some], np.array([p[1] for _, p in some], dtype=np.int64), width):
        _, i, k, start, _ = some[string][1]
        yield i, k, start + first, start + first + windows + width - 1


def runs_of(flags: np.ndarray, owner: np.ndarray, position: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(owner, first position, length) of the runs of set flags; owner and position as in the strings' order."""
    on = np.flatnonzero(flags)
    if not len(on):
        return
    new = np.ones(len(on), dtype=bool)
    new[1:] = (np.diff(on) != 1) | (owner[on][1:] != owner[on][:-1])
    heads = np.flatnonzero(new)
    yield from zip(owner[on[heads]].tolist(), position[on[heads]].tolist(), np.diff(heads, append=len(on)).tolist())


def _texts(batches: Iterator[pa.RecordBatch], n_doc_buckets: int) -> Iterator[pa.RecordBatch]:
    """Texts as compressed blobs, dealt to buckets of documents (kind 1)."""
    for texts, cols in chunks(batches, FLUSH_BYTES):
        yield from _dealt(doc_bucket(cols["id"], cols["key"], n_doc_buckets), 1, [cols["id"], cols["key"], np.array([len(t) for t in texts], dtype=np.int64)], texts)


def _finish(batches: Iterator[pa.RecordBatch], result: Callable, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    cuts: list[tuple[np.ndarray, ...]] = []
    for _, kind, rows in by_bucket(batches):
        if kind == 0:
            cuts = [unpack(payload, *_CUT)[:4] for payload in rows]
            continue
        ids, keys, begins, ends = (np.concatenate(x) for x in zip(*cuts)) if cuts else (np.zeros(0, dtype=t) for t in _CUT)
        cuts = []
        order = np.lexsort((begins, keys, ids))
        ids, keys, begins, ends = (c[order] for c in (ids, keys, begins, ends))
        heads, sizes = _groups(ids, keys)
        spans = dict(zip(zip(ids[heads].tolist(), keys[heads].tolist()), zip(heads.tolist(), (heads + sizes).tolist())))
        for payload in rows:
            i, k, sizes, data = unpack(payload, np.int64, np.int64, np.int64)
            out, at = [], 0
            for one_id, key, size in zip(i.tolist(), k.tolist(), sizes.tolist()):
                a, b = spans.get((one_id, key), (0, 0))
                out.append((one_id, *result(data[at : at + size], begins[a:b], ends[a:b])))
                at += size
            yield row_batch(schema, *zip(*out))


def remove_repeats(docs: DataFrame, unit: str, width: int, gram: int, repeated: Callable, result: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """One row of `schema` for each document: result(text, starts, ends of removed units).

    repeated(strings, ids, width) yields (string, first window, windows) of the runs of windows that also start in a string of a smaller id.
    """
    own = keyed(docs)
    n_buckets = n_doc_buckets = partitions_for(docs, BUCKET_BYTES)
    grams = {"unit": unit, "width": width, "gram": gram, "n_buckets": n_buckets, "n_doc_buckets": n_doc_buckets}

    def exchanged(rows: DataFrame, *order: str) -> DataFrame:
        return dealt_to(rows, n_buckets).sortWithinPartitions(*order)

    # rows of kind 0 are for documents' buckets and pass the owners of the others by
    minimisers = exchanged(own.mapInArrow(partial(_minimisers, **grams), _SENT_DDL), "kind", "bucket")
    shared = materialise(minimisers.mapInArrow(partial(_own_or_pass, own=_shared), _SENT_DDL), "shared")
    free_shuffles(docs.sparkSession)
    texts = own.mapInArrow(partial(_texts, n_doc_buckets=n_doc_buckets), _SENT_DDL)
    strings = exchanged(shared.unionByName(texts), "bucket", "kind").mapInArrow(partial(_send, **grams), _SENT_DDL)
    owners = partial(_own, width=width, n_doc_buckets=n_doc_buckets, repeated=repeated)
    cuts = materialise(exchanged(strings, "kind", "bucket").mapInArrow(partial(_own_or_pass, own=owners), _SENT_DDL), "cuts")
    release(shared)
    return exchanged(cuts.unionByName(texts), "bucket", "kind").mapInArrow(partial(_finish, result=result, schema=schema), ddl)


def _own_or_pass(batches: Iterator[pa.RecordBatch], own: Callable) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0, which come first in the order, pass as they come; those of the other kinds go through own()."""
    batches = iter(batches)
    for b in batches:
        first = int(np.count_nonzero(longs_of(b, "kind") == 0))
        if first:
            yield b.slice(0, first)
        if first < b.num_rows:
            yield from own(chain([b.slice(first)], batches))


def union_length(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint maximal spans of the union of spans, sorted; touching ones merge."""
    if not len(starts):
        return starts.astype(np.int64), ends.astype(np.int64)
    order = np.argsort(starts, kind="stable")
    s, e = starts[order].astype(np.int64), np.maximum.accumulate(ends[order].astype(np.int64))
    new = np.concatenate([[True], s[1:] > e[:-1]])
    heads = np.flatnonzero(new)
    return s[heads], e[np.append(heads[1:], len(s)) - 1]
