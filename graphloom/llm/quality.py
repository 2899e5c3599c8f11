"""Operator 2: document quality by a regularised quadratic discriminant.

Each text is reduced to statistics of its bytes, words and lines, which are transformed (logarithms and logits) and standardised. Each class
has its mean and its covariance, shrunk towards the pooled covariance and that one's diagonal; a score is the logistic of the difference of
the classes' log densities, that is, of Mahalanobis distances through Cholesky factors computed once, plus the prior log-odds, scaled so
that scores of the learning rows are calibrated. Class moments are sums over all labelled rows that may be learned from, gathered as one row
of fixed size for each partition; no sample is taken.

Defined results: null and empty texts have statistics of their own and a score; with fewer than two rows of either class every score is the
share of positive labels (0.5 without any); repeated rows are scored alike; of several labels of a document the largest counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import keyed, longs_of, real_id, texts_of, word_bounds
from graphloom.llm.toxicity import held_out
from graphloom.session import materialise

#: Shares of the pooled covariance and of its diagonal in each class's covariance; threshold of `predicted`.
TO_POOLED, TO_DIAGONAL, THRESHOLD = 0.2, 0.05, 0.3

STATISTICS = (
    "bytes", "words", "word_bytes", "word_spread", "upper", "digits", "marks", "symbols", "high_bytes", "line_bytes", "distinct_words",
    "top_word", "repeated_pairs", "repeated_lines", "marked_words", "short_words", "long_words", "entropy", "sentence_words",
)
_STATS_DDL = "id long, key long, stats array<float>"
_STATS = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("stats", pa.list_(pa.float32()))])

_UPPER, _DIGIT, _MARK, _SYMBOL = (np.zeros(256, dtype=bool) for _ in range(4))
_UPPER[65:91] = _DIGIT[48:58] = True
_MARK[list(b".,;:!?'\"()-")] = True
_SYMBOL[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = True
_END = np.zeros(256, dtype=bool)
_END[list(b".!?")] = True


def _logit(share: float, n: float) -> float:
    """The log-odds of a share of n things, held off 0 and 1 by half a thing."""
    hits = share * n
    return float(np.log((hits + 0.5) / (n - hits + 0.5)))


def statistics(text: bytes) -> np.ndarray:
    """The transformed statistics of one text, in the order of STATISTICS."""
    if not text:
        return np.zeros(len(STATISTICS), dtype=np.float32)
    buf = np.frombuffer(text, np.uint8)
    counts = np.bincount(buf, minlength=256)
    n = len(buf)
    starts, ends = word_bounds(buf)
    sizes = ends - starts
    words = text.split()
    w = max(1, len(words))
    seen: dict[bytes, int] = {}
    numbers = np.fromiter((seen.setdefault(x, len(seen)) for x in words), dtype=np.int64, count=len(words))
    top = int(np.bincount(numbers).max()) if len(numbers) else 0
    pairs = numbers[:-1] * (len(seen) + 1) + numbers[1:]
    fours = pairs[:-2] * np.int64(1_000_003) + pairs[2:]
    lines = [x for x in text.split(b"\n") if x]
    last = buf[ends - 1] if len(ends) else buf[:0]
    shares = counts[counts > 0] / n
    some = sizes if len(sizes) else np.ones(1)
    return np.array([
        np.log1p(n), np.log1p(len(words)), np.log(some.mean()), np.log1p(some.std()),
        _logit(counts[_UPPER].sum() / n, n), _logit(counts[_DIGIT].sum() / n, n), _logit(counts[_MARK].sum() / n, n), _logit(counts[_SYMBOL].sum() / n, n), _logit(counts[128:].sum() / n, n),
        np.log(n / max(1, len(lines))), _logit(len(seen) / w, w), _logit(top / w, w),
        _logit(1 - len(np.unique(fours)) / max(1, len(fours)) if len(fours) else 0.0, max(1, len(fours))),
        _logit(1 - len(set(lines)) / max(1, len(lines)) if lines else 0.0, max(1, len(lines))),
        _logit(float((_MARK | _SYMBOL)[last].sum()) / w, w), _logit(float((sizes <= 3).sum()) / w, w), _logit(float((sizes >= 12).sum()) / w, w),
        float(-(shares * np.log2(shares)).sum()), np.log1p(w / max(1, int(_END[last].sum()))),
    ], dtype=np.float32)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = texts_of(b)
        flat = np.concatenate([statistics(t) for t in texts]) if texts else np.zeros(0, dtype=np.float32)
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(STATISTICS))
        yield pa.RecordBatch.from_arrays([pa.array(longs_of(b, "id")), pa.array(longs_of(b, "key")), pa.ListArray.from_arrays(offsets, pa.array(flat))], schema=_STATS)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(id, key, stats) of each row."""
    return keyed(docs).mapInArrow(_stats, _STATS_DDL)


def _matrix(b: pa.RecordBatch, column: str = "stats") -> np.ndarray:
    col = b.column(b.schema.get_field_index(column))
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), -1)


@dataclass
class Discriminant:
    """Means and scale of the statistics, class means, inverse Cholesky factors and log-determinants of class covariances, prior, calibration."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    logdets: tuple[float, float]
    prior: float
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def margin(self, stats: np.ndarray) -> np.ndarray:
        """The difference of the classes' log densities, positive towards class 1."""
        z = np.clip((stats - self.centre) / self.scale, -12, 12)
        dense = []
        for mean, factor, logdet in zip(self.means, self.factors, self.logdets):
            white = factor @ (z - mean).T  # factor: the cached inverse of the covariance's Cholesky factor
            dense.append(-0.5 * ((white**2).sum(axis=0) + logdet))
        return dense[1] - dense[0] + self.prior

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None or not len(stats):
            return np.full(len(stats), self.constant or 0.0)
        m = self.margin(stats)
        return 1 / (1 + np.exp(-np.clip(self.slope * np.sign(m) * np.sqrt(np.abs(m)) + self.shift, -30, 30)))


def discriminant(rows: np.ndarray, sums: np.ndarray, products: np.ndarray) -> Discriminant:
    """From each class's rows, sums (2 x d) and sums of products (2 x d x d)."""
    d = sums.shape[1]
    if rows.min() < 2:
        total = rows.sum()
        return Discriminant(np.zeros(d), np.ones(d), (np.zeros(d),) * 2, (np.eye(d),) * 2, (0.0, 0.0), 0.0, constant=float(rows[1] / total) if total else 0.5)
    n = rows.sum()
    centre = sums.sum(axis=0) / n
    scale = np.sqrt(np.maximum(np.diagonal(products.sum(axis=0)) / n - centre**2, 1e-6))
    means, own = [], []
    for c in (0, 1):
        mean = sums[c] / rows[c]
        covariance = products[c] / rows[c] - np.outer(mean, mean)
        means.append((mean - centre) / scale)
        own.append(covariance / np.outer(scale, scale))
    pooled = (rows[0] * own[0] + rows[1] * own[1]) / n
    factors, logdets = [], []
    for c in (0, 1):
        # the fewer rows a class has, the more it leans on the pooled covariance
        lean = max(TO_POOLED, d / (d + rows[c]))
        mixed = (1 - lean) * own[c] + lean * pooled
        mixed = (1 - TO_DIAGONAL) * mixed + TO_DIAGONAL * np.diag(np.diagonal(pooled)) + 1e-3 * np.eye(d)
        factor = np.linalg.cholesky(mixed)
        factors.append(np.linalg.inv(factor))
        logdets.append(2 * float(np.log(np.diagonal(factor)).sum()))
    return Discriminant(centre, scale, tuple(means), tuple(factors), tuple(logdets), float(np.log(rows[1] / rows[0])))


def _moments(batches: Iterator[pa.RecordBatch], shift: np.ndarray) -> Iterator[pa.RecordBatch]:
    d = len(STATISTICS)
    rows, sums, products = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for b in batches:
        x, y = _matrix(b) - shift, longs_of(b, "y")
        for c in (0, 1):
            own = x[y == c]
            rows[c] += len(own)
            sums[c] += own.sum(axis=0)
            products[c] += own.T @ own
    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([rows, sums.ravel(), products.ravel()])])], names=["moments"])


def fit(stats: DataFrame, labels: DataFrame, keep: Column | None = None, label: str = "quality") -> Discriminant:
    """Learns from all rows of stats with a label, where keep (of the id) allows it."""
    y = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("long").alias("y")).where("id is not null and y in (0, 1)")
    y = y.groupBy("id").agg(F.max("y").alias("y"))
    known = materialise(stats.join(y if keep is None else y.where(keep), "id").select("y", "stats"), "labelled-stats")
    d = len(STATISTICS)
    means = known.agg(*[F.avg(F.col("stats")[k].cast("double")).alias(f"m{k}") for k in range(d)]).first()
    shift = np.array([m or 0.0 for m in means])
    # one row of fixed size for each partition, summed by Spark
    parts = known.mapInArrow(partial(_moments, shift=shift), "moments array<double>").select(F.posexplode("moments").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
    flat = np.zeros(2 + 2 * d + 2 * d * d)
    for r in parts.collect():
        flat[r["at"]] = r["v"]
    model = discriminant(flat[:2], flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d))
    model.centre = model.centre + shift
    if model.constant is None:
        _calibrate(model, known)
    return model


def _calibrate(model: Discriminant, known: DataFrame, bins: int = 400) -> None:
    """Logistic regression on the margins' signed roots, from counts in bins of them; the margins' histogram is all that leaves the executors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = model.margin(_matrix(b))
            root = np.clip(np.round(np.sign(m) * np.sqrt(np.abs(m)) * 20), -bins, bins).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(root), pa.array(longs_of(b, "y"))], names=["bin", "y"])

    rows = known.mapInArrow(count, "bin long, y long").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("hits")).orderBy("bin").collect()
    x = np.array([r["bin"] / 20 for r in rows])
    n, hits = (np.array([r[c] for r in rows], dtype=np.float64) for c in ("n", "hits"))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        g = np.array([((n * p - hits) * x).sum() + 1e-2 * (slope - 1), (n * p - hits).sum()])
        w = n * p * (1 - p) + 1e-9
        h = np.array([[(w * x * x).sum() + 1e-2, (w * x).sum()], [(w * x).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-9:
            break
    if slope > 0:
        model.slope, model.shift = float(slope), float(shift)


def _scores(batches: Iterator[pa.RecordBatch], model: Discriminant) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(longs_of(b, "id")), pa.array(longs_of(b, "key")), pa.array(model.score(_matrix(b)))], names=["id", "key", "score"])


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: learns from labels of rows that are not held out (crc32 of the id modulo 5 is not 0)."""
    stats = materialise(document_statistics(docs), "document-stats")
    model = fit(stats, labels, ~held_out(F.col("id"), 5, 0))
    rows = stats.mapInArrow(partial(_scores, model=model), "id long, key long, score double").withColumn("doc_id", real_id())
    return rows.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
