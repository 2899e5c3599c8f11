"""Operator 5: exact deduplication through an extendible-hash index on shared files.

The directory starts with one bucket; while a bucket holds more bytes of distinct texts than its capacity, it splits by one more bit of the hash,
and the directory doubles whenever a bucket outgrows its depth. Map tasks reduce each chunk of texts to its distinct ones and send them to
their buckets; an owner task works through a bucket's stream, chains texts whose hashes collide and compares their bytes. What the owners
find is the index: one row for each distinct text, in files of the shared folder, with which the documents are joined.

Defined results: a null text is the empty text; a null doc_id counts as the largest; rows that repeat both id and text are alike, so all
or none of them are kept (group_size counts each).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import chunks, dealt_to, keyed, real_id, row_batch, unpack
from graphloom.llm.windows import _SENT_DDL, FLUSH_BYTES, _dealt, by_bucket
from graphloom.session import materialise

#: Bytes of distinct texts (and TEXT_COST for each) that a bucket may hold, at least; buckets at most, as a power of two.
BUCKET_BYTES, TEXT_COST, MOST_BITS = 8 << 20, 200, 20

#: Of a bucket's payload: hash, largest id, rows, bytes of the text.
_TEXT = (np.int64, np.int64, np.int64, np.int64)
_INDEX = pa.schema([("bucket", pa.int32()), ("hash", pa.int64()), ("chained", pa.int32()), ("text_sha256", pa.string()), ("keep", pa.int64()), ("group_size", pa.int64())])
_INDEX_DDL = "bucket int, hash long, chained int, text_sha256 string, keep long, group_size long"


def grow_directory(fine: np.ndarray, capacity: int) -> np.ndarray:
    """The bucket of each value of the hash's first bits. fine: load for each value of the most bits that may be used.

    Overfull buckets are always of full depth (a bucket that fits is never looked at again), so each round doubles the directory once and
    splits all of them; a bucket that still overflows at the finest depth stays as it is, and its texts are chained.
    """
    directory, buckets = np.zeros(1, dtype=np.int32), 1
    while len(directory) < len(fine):
        load = np.bincount(np.repeat(directory, len(fine) // len(directory)), weights=fine, minlength=buckets)
        if not (load > capacity).any():
            break
        directory = np.repeat(directory, 2)
        upper = (np.arange(len(directory)) % 2 == 1) & (load > capacity)[directory]
        directory[upper] = buckets + np.arange(np.count_nonzero(upper), dtype=np.int32)
        buckets += int(np.count_nonzero(upper))
    return directory


def _send(batches: Iterator[pa.RecordBatch], directory: np.ndarray) -> Iterator[pa.RecordBatch]:
    shift = np.uint64(64 - int(math.log2(len(directory)))) if len(directory) > 1 else None
    for texts, cols in chunks(batches, FLUSH_BYTES):
        seen: dict[bytes, list[int]] = {}
        for t, i, h in zip(texts, cols["id"].tolist(), cols["key"].tolist()):
            have = seen.setdefault(t, [h, i, 0])
            have[1], have[2] = max(have[1], i), have[2] + 1
        rows = np.array(list(seen.values()), dtype=np.int64)
        slot = (rows[:, 0].view(np.uint64) >> shift).astype(np.int64) if shift is not None else np.zeros(len(rows), dtype=np.int64)
        yield from _dealt(directory[slot], 1, [rows[:, 0], rows[:, 1], rows[:, 2], np.array([len(t) for t in seen], dtype=np.int64)], list(seen))


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, _, rows in by_bucket(batches):
        chains: dict[int, list[list]] = {}
        for payload in rows:
            hashes, ids, counts, sizes, data = unpack(payload, *_TEXT)
            at = 0
            for h, i, n, size in zip(hashes.tolist(), ids.tolist(), counts.tolist(), sizes.tolist()):
                text, at = data[at : at + size], at + size
                chain = chains.setdefault(h, [])
                for link in chain:
                    if link[0] == text:
                        link[1], link[2] = max(link[1], i), link[2] + n
                        break
                else:
                    chain.append([text, i, n])
        flat = [(bucket, h, k, hashlib.sha256(t).hexdigest(), i, n) for h, chain in chains.items() for k, (t, i, n) in enumerate(chain)]
        if flat:
            yield row_batch(_INDEX, *zip(*flat))


def exact_groups(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, text_key (xxhash64): one row for each row of docs; the largest doc_id of equal texts stays."""
    own = keyed(docs)
    members = materialise(own.select("id", "key", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), (F.octet_length("text").cast("long") + TEXT_COST).alias("load")), "members")
    total = members.agg(F.sum("load")).first()[0] or 0
    capacity = max(bucket_bytes, total >> MOST_BITS)
    bits = max(1, math.ceil(math.log2(total / capacity + 1)) + 1)
    distinct = members.groupBy("key").agg(F.max("load").alias("load"))
    counted = distinct.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("prefix")).agg(F.sum("load").alias("load")).toArrow()  # at most 2^(MOST_BITS + 2) pairs
    fine = np.zeros(1 << bits, dtype=np.int64)
    fine[counted["prefix"].to_numpy()] = counted["load"].to_numpy()
    directory = grow_directory(fine, capacity)
    sent = own.mapInArrow(partial(_send, directory=directory), _SENT_DDL)
    n = max(1, min(int(directory.max()) + 1, -(-total // (8 << 20))))
    index = materialise(dealt_to(sent, n).sortWithinPartitions("bucket").mapInArrow(_own, _INDEX_DDL), "hash-index")
    found = members.drop("load").join(index.select("text_sha256", "keep", "group_size"), "text_sha256")
    return found.select(real_id().alias("doc_id"), real_id("keep").alias("keep_id"), "group_size", (F.col("id") == F.col("keep")).alias("kept"), "text_sha256", F.col("key").alias("text_key"))
