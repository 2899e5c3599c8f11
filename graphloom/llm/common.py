"""Helpers that the training-data operators share.

Conventions of every operator in this subpackage:

* a null text counts as the empty text; a null id sorts after every other id and comes back as null;
* rows are told apart by (id, xxhash64 of the text), so repeated rows and repeated ids are harmless;
* only the columns an operator names are read, so further columns cannot clash with its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import ship

#: Stands for a null id while an operator works: after every real one.
NULL_ID = (1 << 63) - 1

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of the texts. The planner's size will not do: it is that of compressed files."""
    return df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0


def partitions_for(df: DataFrame, bytes_each: int) -> int:
    """As many partitions as keep each at bytes_each of input, and no fewer than the session's shuffle partitions."""
    return max(shuffle_partitions(df.sparkSession), min(1_000_000, -(-input_bytes(df) // bytes_each)))


def dealt_to(rows: DataFrame, n: int, column: str = "bucket") -> DataFrame:
    """Rows in n partitions by bucket number, each bucket in one; consecutive numbers go to different partitions, without hash collisions."""
    return rows.repartitionById(n, F.pmod(F.col(column), F.lit(n)))


def smallest_hashes(rows: DataFrame, most: int, *columns: str) -> DataFrame:
    """The `most` rows with the smallest hashes of the columns. Of many rows only those below a bound, about twice as many as asked for, compete, so that what reaches the driver does not grow with the input."""
    n = rows.count()
    ranked = rows.withColumn("_hash", F.xxhash64(*columns))
    if n > 2 * most:
        below = ranked.where(F.col("_hash") < int((2 * most / n - 0.5) * (1 << 64)))
        ranked = below if below.count() >= most else ranked
    return ranked.orderBy("_hash", *columns).limit(most).drop("_hash")


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, text): no nulls; key tells rows of one id apart. The package goes to the executors with it."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("key"), text.alias("text")
    )


def real_id(name: str = "id"):
    """The id column as the caller knows it."""
    return F.when(F.col(name) != NULL_ID, F.col(name))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column's texts as UTF-8 bytes, without decoding."""
    col = batch.column(batch.schema.get_field_index(column))
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def longs_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)


def chunks(batches: Iterator[pa.RecordBatch], most_bytes: int, columns: tuple[str, ...] = ("id", "key")) -> Iterator[tuple[list[bytes], dict[str, np.ndarray]]]:
    """Texts with their long columns, in runs of at most most_bytes (one longer text comes alone)."""
    for batch in batches:
        texts, cols = texts_of(batch), {c: longs_of(batch, c) for c in columns}
        at, total = 0, 0
        for i, t in enumerate(texts):
            if total and total + len(t) > most_bytes:
                yield texts[at:i], {c: v[at:i] for c, v in cols.items()}
                at, total = i, 0
            total += len(t)
        if at < len(texts):
            yield texts[at:], {c: v[at:] for c, v in cols.items()}


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs outside x20 and x09-x0D in a byte buffer."""
    inside = np.empty(len(buf) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SEPARATOR[buf], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def pack(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    """Arrays of one length and a byte string as one compressed blob."""
    head = np.array([len(arrays[0]) if arrays else 0, len(tail)], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(b"".join([head, *(np.ascontiguousarray(a).tobytes() for a in arrays), tail]))


def unpack(blob: bytes, *kinds: type) -> tuple:
    """The arrays of pack(), by their dtypes, then the byte string."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, size = np.frombuffer(raw, np.int64, 2)
    out, at = [], 16
    for kind in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    return (*out, raw[at : at + int(size)])


def row_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads its bits (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: One random 64-bit value for each byte, from a fixed seed.
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd constant and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
            p = np.full(max(n, 1 << 16), base, dtype=np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, *ends: np.ndarray) -> np.ndarray | list[np.ndarray]:
    """A 64-bit hash of values[start:end] for each span, by one running sum; for several arrays of ends, a list."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    begun, scale = total[starts], down[starts]
    out = [mix((total[e] - begun) * scale + (e - starts).astype(np.uint64)) for e in ends]
    return out[0] if len(out) == 1 else out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each width consecutive values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
