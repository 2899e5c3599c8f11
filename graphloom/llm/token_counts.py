"""Operator 7: token counts through a digest cache.

The cache is a table in a folder: content digest, tokenizer digest, tokens. Documents are joined with it by digest; texts whose digest it
lacks are brought together by digest, so that each distinct one is encoded once, and their counts are appended. Content is normalised in
that a null text is the empty text; nothing else may change, as counts are of the text as it stands.

Defined results: the empty text has no token; every row of docs has one row, repeated rows and ids too; a null doc_id stays null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import chunks, dealt_to, keyed, partitions_for, real_id, row_batch, unpack
from graphloom.llm.tokenizer import default_path, load, tokenizer_digest
from graphloom.llm.windows import _SENT_DDL, FLUSH_BYTES, _dealt, by_bucket
from graphloom.session import materialise, path_is_empty, shared_path

LIMIT_TOKENS = 1024

_CACHE_DDL = "content_sha256 string, tokenizer_sha256 string, n_tokens long"
_CACHE = pa.schema([("content_sha256", pa.string()), ("tokenizer_sha256", pa.string()), ("n_tokens", pa.int64())])


def _bucket(digest: bytes, n: int) -> int:
    return int.from_bytes(digest[:6], "big") % n


def _distinct_texts(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    for texts, _ in chunks(batches, FLUSH_BYTES):
        own = list(dict.fromkeys(texts))
        yield from _dealt(np.array([_bucket(hashlib.sha256(t).digest(), n_buckets) for t in own], dtype=np.int64), 1, [np.array([len(t) for t in own], dtype=np.int64)], own)


def _stored(batches: Iterator[pa.RecordBatch], n_buckets: int) -> Iterator[pa.RecordBatch]:
    """Digests that the cache has, to the buckets of their texts (kind 0)."""
    for b in batches:
        own = [bytes.fromhex(x) for x in b.column(0).to_pylist()]
        if own:
            yield from _dealt(np.array([_bucket(d, n_buckets) for d in own], dtype=np.int64), 0, [np.full(len(own), 32, dtype=np.int64)], own)


def _encode_misses(batches: Iterator[pa.RecordBatch], path: str, tokenizer: str) -> Iterator[pa.RecordBatch]:
    model = load(path)
    seen: set[bytes] = set()
    last = None
    for bucket, kind, rows in by_bucket(batches):
        if bucket != last:
            seen, last = set(), bucket
        for payload in rows:
            sizes, data = unpack(payload, np.int64)
            ends = np.cumsum(sizes)
            own = [data[e - z : e] for e, z in zip(ends.tolist(), sizes.tolist())]
            if kind == 0:
                seen.update(own)
                continue
            new = {d: t for t in own if (d := hashlib.sha256(t).digest()) not in seen}
            seen.update(new)
            if new:
                counts = [len(i) // 4 for i in model.ids([t.decode("utf-8", "replace") for t in new.values()])]
                yield row_batch(_CACHE, [d.hex() for d in new], [tokenizer] * len(new), counts)


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, cache_path: str | None = None, limit: int = LIMIT_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of docs. cache_path: a folder that lasts; without one, a new cache."""
    spark = docs.sparkSession
    path = tokenizer_path or default_path()
    tokenizer, cache = tokenizer_digest(path), cache_path or shared_path(spark, "token-cache")
    own = keyed(docs)
    members = materialise(own.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("content_sha256"), F.octet_length("text").cast("long").alias("n_bytes")), "contents")

    def stored() -> DataFrame:
        rows = spark.read.schema(_CACHE_DDL).parquet(cache).where(F.col("tokenizer_sha256") == tokenizer)
        return rows.groupBy("content_sha256").agg(F.max("n_tokens").alias("n_tokens"))  # two runs may have appended one text

    n = partitions_for(docs, 8 << 20)
    sent = own.select("text", "id", "key").mapInArrow(partial(_distinct_texts, n_buckets=n), _SENT_DDL)
    if not path_is_empty(spark, cache):
        have = stored().join(members.select("content_sha256").distinct(), "content_sha256", "left_semi").select("content_sha256")
        sent = sent.unionByName(have.mapInArrow(partial(_stored, n_buckets=n), _SENT_DDL))
    misses = dealt_to(sent, n).sortWithinPartitions("bucket", "kind")
    misses.mapInArrow(partial(_encode_misses, path=path, tokenizer=tokenizer), _CACHE_DDL).write.mode("append").parquet(cache)
    # written first: both sides of the join are then plain tables, of which Spark broadcasts a small one and splits hot digests of large ones
    out = members.join(materialise(stored().join(members.select("content_sha256").distinct(), "content_sha256", "left_semi"), "counts"), "content_sha256")
    return out.select(real_id().alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
