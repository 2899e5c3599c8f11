"""Operator 1: removes word windows that an earlier document has too (super-k-mer partitioning).

Consecutive windows that share a minimiser travel as one packed string to its bucket; the owner sorts the windows of each bucket, so that
equal ones stand together and are counted exactly: neighbours are compared word by word, not by hash.

Defined results: null and empty texts have no words; a text shorter than a window keeps every word; rows of one doc_id never remove each
other's words; a null doc_id counts as larger than any other. Words are compared unchanged; what separates them is not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import mix, powers, real_id
from graphloom.llm.windows import _SPACE, CHUNK_BYTES, remove_repeats, runs_of, union_length

#: Words in a window and in the grams whose least hash is the minimiser.
WINDOW_WORDS, GRAM_WORDS = 50, 8

_RESULT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
_DIGEST = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def repeated_windows(strings: list[bytes], ids: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """(string, first window, windows) of the runs of windows that also start in a string of a smaller id."""
    numbers: dict[bytes, int] = {}
    words = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in s.split()), dtype=np.int64) for s in strings]
    sizes = np.array([len(w) for w in words])
    flat = np.concatenate(words)
    owner = np.repeat(np.arange(len(strings)), sizes)
    first = np.cumsum(sizes) - sizes
    position = np.arange(len(flat)) - first[owner]
    starts = np.flatnonzero(position <= sizes[owner] - width)
    for seed in range(1, 9):
        up, down = powers(len(flat) + 1)
        total = np.zeros(len(flat) + 1, dtype=np.uint64)
        np.cumsum(mix(flat.astype(np.uint64) * np.uint64(2 * seed + 1) + np.uint64(seed)) * up[:-1], out=total[1:])
        hashed = (total[starts + width] - total[starts]) * down[starts]
        order = np.argsort(hashed, kind="stable")
        same = hashed[order][1:] == hashed[order][:-1]
        left, right = starts[order[:-1][same]], starts[order[1:][same]]
        if all(np.array_equal(flat[left[a : a + 20_000, None] + np.arange(width)], flat[right[a : a + 20_000, None] + np.arange(width)]) for a in range(0, len(left), 20_000)):
            break
    else:
        raise ArithmeticError("no hash of eight told the windows of a bucket apart")
    heads = np.flatnonzero(np.concatenate([[True], ~same]))
    smallest = np.minimum.reduceat(ids[owner[starts[order]]], heads)
    flags = np.zeros(len(starts), dtype=bool)
    flags[order] = ids[owner[starts[order]]] > np.repeat(smallest, np.diff(heads, append=len(order)))
    yield from runs_of(flags, owner[starts], position[starts])


def _kept(text: bytes, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(words, removed words, kept ones joined) of each piece of a text, cut between words, so that a very long text makes no long list."""
    s, e = union_length(starts, ends)
    at = base = 0
    while at < len(text):
        gap = _SPACE.search(text, at + CHUNK_BYTES)
        stop = gap.start() if gap else len(text)
        words = text[at:stop].split()  # of bytes: at x20 and x09-x0D
        kept, begin = [], 0
        a, b = np.searchsorted(e, base, "right"), np.searchsorted(s, base + len(words), "left")
        for x, y in zip((s[a:b] - base).tolist(), (e[a:b] - base).tolist()):
            kept += words[begin : max(x, 0)]
            begin = y
        kept += words[begin:]
        yield len(words), len(words) - len(kept), b" ".join(kept)
        at, base = stop, base + len(words)


def _kept_text(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, str]:
    parts = list(_kept(text, starts, ends))
    return sum(p[0] for p in parts), sum(p[1] for p in parts), b" ".join(p[2] for p in parts if p[2]).decode("utf-8", "replace")


def _kept_digest(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, int, str]:
    n = removed = 0
    digest, gap = hashlib.sha256(), b""
    for words, gone, kept in _kept(text, starts, ends):
        n, removed = n + words, removed + gone
        if kept:
            digest.update(gap + kept)
            gap = b" "
    return n, removed, digest.hexdigest()


def dedup_words(docs: DataFrame, width: int = WINDOW_WORDS, gram: int = GRAM_WORDS, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (with digest: kept_sha256 in its place), one row for each row of docs."""
    schema, last = (_DIGEST, "kept_sha256") if digest else (_RESULT, "kept_text")
    out = remove_repeats(docs, "word", width, min(gram, width), repeated_windows, _kept_digest if digest else _kept_text, schema, f"id long, n_words long, n_removed long, {last} string")
    return out.select(real_id().alias("doc_id"), "n_words", "n_removed", last)
