"""Operator 8: toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the mean of hashed ones: of the word and of its first four, five and six bytes, so that unseen forms of a word share
most of it. Filters of several widths slide over a text's words, the largest response of each is pooled over the whole text, and a logistic
layer scores the pooled responses. The first coordinate of each embedding starts at its bucket's log-odds in the training sample, the rest
at random; all are then trained. Scores see nothing but the text. Each language's threshold, for the `toxic` flag of the general interface,
is the one with the best F1 on validation rows of that language (of all languages where it has too few).

Training takes a bounded sample of labelled rows: of each class those with the smallest hashes of their ids, at most `most_rows`, and of
these the texts of at most `most_bytes` bytes each, so that what reaches the driver is bounded. Longer texts are scored, whole, like all.

Defined results: null and empty texts are scored as texts without words; without labelled rows of both classes every score is the share of
positive labels (0.5 without any); repeated rows are scored alike; of several labels of a document the largest counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import BYTE_VALUES, keyed, longs_of, real_id, row_batch, smallest_hashes, span_hashes, texts_of
from graphloom.session import materialise, ship

#: Hash buckets, width of an embedding, widths of the filters, filters of each width; rows of each class in the sample, bytes of each; bytes scored at once.
BUCKETS, DEPTH, WIDTHS, FILTERS, MOST_ROWS, MOST_BYTES, SCORE_BYTES = 1 << 17, 8, (1, 2, 3), 8, 2000, 1 << 16, 1 << 19
#: Bytes of the prefixes; passes over the sample, and steps at least; rows of a step; learning rate; threshold; seed.
PREFIXES, EPOCHS, LEAST_STEPS, BATCH, RATE, THRESHOLD, SEED = (4, 5, 6), 3, 200, 64, 0.02, 0.3, 11

_SCORE = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("score", pa.float64())])

#: Letters and digits stay (A-Z as a-z), bytes above 127 are letters, all else parts words.
_FOLD = np.zeros(256, dtype=np.uint8)
_FOLD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = [*range(48, 58), *range(97, 123), *range(128, 256)]
_FOLD[65:91] = np.arange(97, 123)


def word_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word of the texts (a column for the word, then one for each prefix), and where each text's words begin, and the end."""
    data = b" ".join(texts) + b" "
    buf = _FOLD[np.frombuffer(data, np.uint8)]
    inside = np.concatenate([[False], buf != 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    values = BYTE_VALUES[buf]
    hashes = span_hashes(values, starts, ends, *(np.minimum(ends, starts + n) for n in PREFIXES))
    columns = [h + np.uint64(n) for h, n in zip(hashes, (0, *PREFIXES))]
    firsts = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
    return np.stack([(c & np.uint64(BUCKETS - 1)).astype(np.int32) for c in columns], axis=1), firsts


@dataclass
class ConvClassifier:
    """Embeddings (buckets x depth), filters (for each width: width x depth x filters), biases, logistic layer; or a constant score."""

    embed: np.ndarray | None
    filters: list[np.ndarray]
    offsets: list[np.ndarray]
    weights: np.ndarray
    bias: float
    constant: float | None = None
    thresholds: dict[str, float] | None = None

    def pooled(self, words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest response of each filter over each text (0 where the text is shorter than the filter)."""
        x = self.embed[words[:, 0]]
        for k in range(1, words.shape[1]):
            x = x + self.embed[words[:, k]]
        x *= 1 / words.shape[1]
        across = np.ascontiguousarray(x.T)  # filters work along contiguous rows
        n, out = len(firsts) - 1, []
        for w, b in zip(self.filters, self.offsets):
            width, _, count = w.shape
            own = np.zeros((n, count), dtype=np.float32)
            whole = len(x) - width + 1
            sizes = np.diff(firsts) - width + 1
            has = np.flatnonzero(sizes > 0)
            if len(has):
                conv = np.empty((count, whole + width), dtype=np.float32)
                conv[:, whole:] = -np.inf
                np.matmul(w[0].T, across[:, :whole], out=conv[:, :whole])
                for k in range(1, width):
                    conv[:, :whole] += w[k].T @ across[:, k : whole + k]
                # texts' whole windows are runs with gaps of width - 1 between; reduceat takes every second span
                bounds = np.stack([firsts[has], firsts[has] + sizes[has]], axis=1).ravel()
                own[has] = np.maximum(np.maximum.reduceat(conv, bounds, axis=1)[:, ::2].T + b, 0)
            out.append(own)
        return np.concatenate(out, axis=1), x

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out, at = [], 0
        sizes = np.cumsum([len(t) for t in texts])
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SCORE_BYTES, "right")))
            h, _ = self.pooled(*word_features(texts[at:stop]))
            out.append(1 / (1 + np.exp(-np.clip(h @ self.weights + self.bias, -30, 30))))
            at = stop
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def gradients(model: ConvClassifier, words: np.ndarray, firsts: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Of the mean log loss: by each text's logit; by filters, offsets and weights (with decay); by the embeddings of words (their places, one row each)."""
    h, x = model.pooled(words, firsts)
    p = 1 / (1 + np.exp(-np.clip(h @ model.weights + model.bias, -30, 30)))
    d = ((p - labels) / len(labels)).astype(np.float32)
    grads = [np.zeros_like(q) for q in (*model.filters, *model.offsets, model.weights)]
    grads[-1] = h.T @ d + 1e-4 * model.weights
    dh = np.outer(d, model.weights) * (h > 0)
    at_word, grad_x = [np.zeros(0, dtype=np.int64)], [np.zeros((0, model.embed.shape[1]), dtype=np.float32)]
    done = 0
    for j, w in enumerate(model.filters):
        width, _, count = w.shape
        own_d = dh[:, done : done + count]
        done += count
        grads[len(model.filters) + j] = own_d.sum(axis=0)
        for t in range(len(labels)):
            a, b = firsts[t], firsts[t + 1] - width + 1
            if b <= a or not own_d[t].any():
                continue
            conv = sum(x[a + k : b + k] @ w[k] for k in range(width))
            best = a + conv.argmax(axis=0)
            for k in range(width):
                grads[j][k] += x[best + k].T * own_d[t]
                at_word.append(best + k)
                grad_x.append(own_d[t][:, None] * w[k].T)
    return d, grads, (np.concatenate(at_word), np.concatenate(grad_x) / words.shape[1])


def train(texts: list[bytes], labels: np.ndarray, prior: float, seed: int = SEED) -> ConvClassifier:
    """prior: the positives' share among all labelled rows, to which the scores are shifted back."""
    if len(set(labels.tolist())) < 2:
        return ConvClassifier(None, [], [], np.zeros(0), 0.0, float(prior))
    rng = np.random.default_rng(seed)
    features = [word_features([t])[0] for t in texts]
    seen = np.zeros((2, BUCKETS), dtype=np.float32)
    for f, y in zip(features, labels.tolist()):
        seen[y, np.unique(f)] += 1
    rows = np.bincount(labels, minlength=2)
    odds = np.log((seen[1] + 0.5) / (rows[1] + 1)) - np.log((seen[0] + 0.5) / (rows[0] + 1))
    support = seen.sum(axis=0)
    embed = rng.normal(0, 0.1, (BUCKETS, DEPTH)).astype(np.float32)
    embed[:, 0] = np.clip(odds * support / (support + 20), -3, 3) / 2
    filters = [rng.normal(0, 0.3, (w, DEPTH, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w in filters:
        w[:, 0, : FILTERS // 2] = np.abs(w[:, 0, : FILTERS // 2]) + 0.5
    offsets = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
    model = ConvClassifier(embed, filters, offsets, rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), 0.0)
    dense = [*filters, *offsets, model.weights]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in dense]
    bias_moment = np.zeros(2)
    step = 0
    batch = BATCH if len(texts) >= 8 * BATCH else 16
    epochs = max(EPOCHS, -(-LEAST_STEPS * batch // len(texts)))
    for epoch in range(epochs):
        rate = RATE * (1 - epoch / epochs)
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            words = np.concatenate([features[k] for k in own])
            firsts = np.concatenate([[0], np.cumsum([len(features[k]) for k in own])])
            if not len(words):
                continue
            d, grads, (where, g) = gradients(model, words, firsts, labels[own])
            if len(where):
                np.subtract.at(embed, words[where].ravel(), np.repeat(g, words.shape[1], axis=0) * np.float32(rate * 50))
            step += 1
            for q, g, (m, v) in zip(dense, grads, moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
            bias_moment += np.array([0.1, 0.01]) * (np.array([d.sum(), d.sum() ** 2]) - bias_moment)
            model.bias -= rate * bias_moment[0] / (1 - 0.9**step) / (np.sqrt(bias_moment[1] / (1 - 0.99**step)) + 1e-7)
    if 0 < prior < 1:
        share = rows[1] / rows.sum()
        model.bias += float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return model


def calibrate(model: ConvClassifier, texts: list[bytes], labels: np.ndarray, languages: list[str | None], least: int = 20) -> None:
    """Sets the threshold of each language with `least` positive validation rows or more, and of all together (the key "")."""

    def best(scores: np.ndarray, y: np.ndarray) -> float:
        order = np.argsort(-scores, kind="stable")
        hits, taken = np.cumsum(y[order]), np.arange(1, len(y) + 1)
        last = np.append(np.diff(scores[order]) != 0, True)
        f1 = np.where(last, 2 * hits / (taken + y.sum()), 0)
        k = int(np.argmax(f1))
        below = scores[order][k + 1] if k + 1 < len(order) else 0.0
        return float(np.clip((scores[order][k] + below) / 2, 0.05, 0.95))

    scores = model.score(texts)
    model.thresholds = {"": best(scores, labels) if labels.any() and not labels.all() else THRESHOLD}
    for lang in sorted({x for x in languages if x}):
        own = np.array([x == lang for x in languages])
        if labels[own].sum() >= least and not labels[own].all():
            model.thresholds[lang] = best(scores[own], labels[own])


def held_out(ids: Column, parts: int, part: int) -> Column:
    """Whether a row is kept out of learning: crc32 of its id as text, modulo parts."""
    return F.coalesce(F.crc32(ids.cast("string").cast("binary")) % parts == part, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most_rows: int, most_bytes: int, columns: tuple[str, ...] = ()) -> tuple[list, float]:
    """At most most_rows rows of each class, those of the smallest hashes of their ids, with their texts of at most most_bytes; and the positives' share of all."""
    y = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    y = materialise(y.groupBy("id").agg(F.max("y").alias("y")).where(keep), "labels")
    counts = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = [smallest_hashes(y.where(F.col("y") == v), most_rows, "id") for v in (0, 1)]
    few = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * most_rows narrow rows
    own = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *columns)
    rows = own.where(F.octet_length("text") <= most_bytes).join(few, "id").groupBy("id", "y").agg(F.min(F.struct("text", *columns)).alias("d")).select("id", "y", "d.*").collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"]))
    return rows, counts.get(1, 0) / sum(counts.values()) if counts else 0.5


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, label: str = "toxic") -> ConvClassifier:
    """Trains on four fifths of the sample and sets the thresholds on the rest (a small sample is trained on as a whole)."""
    rows, prior = labelled_sample(docs, labels, label, F.lit(True) if keep is None else keep, most_rows, most_bytes, ("lang",) if "lang" in docs.columns else ())
    texts, y = [r["text"].encode() for r in rows], np.array([r["y"] for r in rows], dtype=np.int64)
    part = np.arange(len(rows)) % 5 == 0
    pick = lambda xs, on: [x for x, o in zip(xs, on) if o]
    model = train(pick(texts, ~part), y[~part], prior)
    calibrate(model, pick(texts, part), y[part], pick([r["lang"] if "lang" in docs.columns else None for r in rows], part))
    if len(rows) < most_rows:
        whole = train(texts, y, prior)
        whole.thresholds = model.thresholds
        return whole
    return model


def _scores(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield row_batch(_SCORE, longs_of(b, "id"), longs_of(b, "key"), model.value.score(texts_of(b)))


def score(docs: DataFrame, model: ConvClassifier) -> DataFrame:
    """(id, key, score) of each row. The model's size is fixed by its parameters, so it is broadcast."""
    return keyed(docs).mapInArrow(partial(_scores, model=docs.sparkSession.sparkContext.broadcast(model)), "id long, key long, score double")


def flagged(docs: DataFrame, model: ConvClassifier) -> DataFrame:
    """docs with _score and _toxic: whether the score reaches the threshold of the row's language. One pass, no shuffle. Input columns of these names are replaced."""
    limits = model.thresholds or {"": THRESHOLD}
    docs = docs.select(*[c for c in docs.columns if c.lower() not in ("_score", "_toxic")])
    schema = docs.schema
    ship(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch], held=docs.sparkSession.sparkContext.broadcast(model)) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = held.value.score([t or b"" for t in texts_of(b)])
            langs = b.column(names.index("lang")).to_pylist() if "lang" in names else [None] * len(s)
            on = s >= np.array([limits.get(x or "", limits[""]) for x in langs]) if len(s) else np.zeros(0, dtype=bool)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s), pa.array(on)], names=[*names, "_score", "_toxic"])

    return docs.mapInArrow(run, T.StructType([*schema.fields, T.StructField("_score", T.DoubleType()), T.StructField("_toxic", T.BooleanType())]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: learns from labels of rows that are not held out (crc32 of the id modulo 4 is not 2)."""
    model = fit(docs, labels, ~held_out(F.col("id"), 4, 2))
    rows = score(docs, model).withColumn("doc_id", real_id())
    return rows.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
