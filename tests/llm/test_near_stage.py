"""The near-dedup stage: wide fingerprints against brute force, and their links against exact similarity of five-word shingles."""

import random

import numpy as np

import corpus_pipeline as p
from graphloom.llm import simhash
from graphloom.llm.common import BYTE_VALUES, mix, span_hashes
from graphloom.session import materialise


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def invented():
    """Texts around the least similarity, short ones, and a family of over PAIRWISE texts that share most of their words."""
    rng, rows = random.Random(3), [None, "", " ", "one", "ONE", "one two", "a b c d", "A b  c d", "a b c d e"]
    for n, copies, most in ((60, 12, 4), (300, 8, 20), (90, 60, 3), (90, 60, 7)):
        base = [f"w{rng.randrange(500)}" for _ in range(n)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, most)):
                own[rng.randrange(n)] = f"x{rng.randrange(9999)}"
            rows.append(" ".join(own))
    return list(enumerate(rows))


def plain_wide_print(text):
    """The fingerprint bit by bit: of the set of shingles, each hashed by itself."""
    def one(data):
        values = BYTE_VALUES[np.frombuffer(data, np.uint8)]
        return span_hashes(values, np.array([0]), np.array([len(values)]))[0]

    own = set()
    for s in shingles(text):
        words = np.array([one(w) for w in s], dtype=np.uint64)
        own.add(int(span_hashes(words, np.array([0]), np.array([len(words)]))[0]))
    bits = []
    for f in simhash._FACTORS:
        hashed = [int(mix(np.array([h], dtype=np.uint64) * f)[0]) for h in own]
        bits += [2 * sum(h >> b & 1 for h in hashed) > len(hashed) for b in range(64)]
    return bits


def test_wide_prints_bit_by_bit():
    texts = [t or "" for _, t in invented()[:20]] + ["long " * 700 + " ".join(f"w{k}" for k in range(900))]
    got = simhash.wide_prints([t.encode() for t in texts])
    for t, g in zip(texts, got):
        assert np.unpackbits(g.view(np.uint8), bitorder="little").astype(bool).tolist() == plain_wide_print(t)


def linked(rows, index=simhash.WIDE):
    """The smallest id of each row's component by all pairs of fingerprints."""
    prints = simhash.wide_prints([(t or "").encode() for _, t in rows])
    label = np.arange(len(rows))
    for a in range(len(rows)):
        near = np.flatnonzero(np.bitwise_count(prints[:a] ^ prints[a]).sum(axis=1) <= index.most) if a else []
        for b in near:
            label[label == label[b]] = label[a]
    least = {}
    for (d, _), c in zip(rows, label.tolist()):
        least[c] = min(least.get(c, d), d)
    return [least[c] for c in label.tolist()]


def check(spark, rows):
    docs = materialise(spark.createDataFrame(rows, "doc_id long, text string"), "near-docs")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(docs).collect()}
    assert got == {d: c for (d, _), c in zip(rows, linked(rows))}
    return got


def test_components_of_invented(spark):
    check(spark, invented())


def test_components_of_table(spark, sf):
    """All pairs, by fingerprints as by exact similarity: pairs at 0.85 and more are linked, pairs under 0.6 are not."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = check(spark, rows)
    sets = [shingles(t) for _, t in rows]
    pairs = [(similarity(sets[a], sets[b]), rows[a][0], rows[b][0]) for a in range(len(rows)) for b in range(a)]
    assert all(got[a] == got[b] for s, a, b in pairs if s >= 0.85)
    near = {}
    for s, a, b in pairs:
        if s >= 0.6:
            near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    assert all(d in near for d, c in got.items() if d != c)


def test_stage_drops_what_is_similar(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {d for (d, _), c in zip(rows, linked(rows)) if d == c}
    assert {r["doc_id"] for r in p.drop_near_copies(spark, docs, sf).collect()} == want and len(want) < len(rows)
