"""No pair with a similarity of 0.8 is left out: the near-dedup stage against all pairs of sets of five-word shingles."""

import random

import numpy as np
import pyarrow as pa
from test_near_stage import shingles, similarity

import corpus_pipeline as p
from graphloom.llm import similar, simhash
from graphloom.llm.common import keyed
from graphloom.session import materialise


def near_the_least():
    """Texts of 8 to 400 words, each with copies that differ in an end or in a few words, so that similarities lie around 0.8; some with a common passage."""
    rng, rows = random.Random(11), ["", " "]
    common = " ".join(f"c{k}" for k in range(60))
    for n in (8, 8, 9, 9, 12, 13, 24, 40, 60, 60, 100, 100, 200, 200, 400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        rows += [" ".join(base), " ".join(base + [f"e{rng.randrange(10**6)}" for _ in range((n - 4) // 4)]), " ".join(base + ["over"] * ((n - 4) // 4 + 2))]
        for edits in {1, max(1, n // 45), n // 40 + 1}:
            own = list(base)
            for at in rng.sample(range(n), edits):
                own[at] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(own))
        rows.append(common + " " + " ".join(base[: n // 4]))
    return list(enumerate(rows))


def least_of_component(rows, links):
    label = list(range(len(rows)))
    for a, b in links:
        old, new = max(label[a], label[b]), min(label[a], label[b])
        label = [new if x == old else x for x in label]
    return label


def test_stage_leaves_no_similar_pair_out(spark, sf):
    rows = near_the_least()
    sets, prints = [shingles(t) for _, t in rows], simhash.wide_prints([t.encode() for _, t in rows])
    apart = {(a, b): int(np.bitwise_count(prints[a] ^ prints[b]).sum()) for a in range(len(rows)) for b in range(a)}
    alike = {(a, b) for a, b in apart if similarity(sets[a], sets[b]) >= 0.8}
    close = {pair for pair, bits in apart.items() if bits <= simhash.WIDE_BITS}
    want = least_of_component(rows, alike | close)
    assert len(set(want)) < len(set(least_of_component(rows, close))) - 5  # wide fingerprints alone leave out so many
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    assert {r["doc_id"] for r in p.drop_near_copies(spark, docs, sf).collect()} == set(want)
    got = {r["doc_id"]: r["component_id"] for r in similar.whole_components(docs).collect()}
    assert [got[i] for i, _ in rows] == want


def test_without_wide_links(spark):
    """With no bit of difference allowed, all links but those of equal fingerprints come from exact comparison."""
    rows = [*near_the_least(), (900, None), (901, "w1 w2"), (902, "W1  w2")]
    prints = simhash.wide_prints([(t or "").encode() for _, t in rows])
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if similarity(sets[a], sets[b]) >= 0.8 or (prints[a] == prints[b]).all()]
    want = [rows[k][0] for k in least_of_component(rows, links)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in similar.whole_components(docs, index=simhash.Index(simhash.WIDE.segments, 0, simhash.WIDE_WORDS)).collect()}
    assert [got[i] for i, _ in rows] == want


def test_first_shingles_meet():
    """Any two sets with the least similarity share one of their first shingles, at places that leave room, in whatever order of ranks."""
    rng = np.random.default_rng(4)
    for trial in range(400):
        a = int(rng.integers(1, 60))
        b = int(rng.integers(a, a * 5 // 4 + 1))
        shared = -(-4 * (a + b) // 9)
        pool = rng.integers(0, 1 << 63, a + b - shared, dtype=np.uint64) * np.uint64(2)
        sets = [np.sort(pool[:a]), np.sort(pool[a - shared :])]
        assert (len(sets[1]), similar.enough(shared, a, b)) == (b, True)
        ranks = rng.integers(0, 4, 1 << similar.COUNTER_BITS).astype(np.uint8) if trial % 100 == 0 else ranks  # noqa: F821
        code, owner, place = similar.in_order(np.concatenate(sets), np.array([a, b]), ranks)
        order = np.lexsort((np.array([a, b])[owner], code))
        pairs = similar.pairs_of(code[order], owner[order], np.array([a, b])[owner][order], place[order], owner[order] + 7)
        assert pairs.tolist() == [[0, 1, 7, 8]]


def test_pairs_of_large_groups():
    """Groups beyond BY_STEPS, streamed in batches that cut them, against all pairs."""
    rng = np.random.default_rng(5)
    n = 900
    size = rng.integers(5, 60, n)
    rows = np.stack([rng.choice([3, 3, 3, 4, -9], n), np.arange(n), size, (rng.random(n) * (size // 5 + 1)).astype(np.int64), rng.integers(0, 5, n)], axis=1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    want = set()
    for i, (c, a, s, q, x) in enumerate(rows.tolist()):
        for d, b, t, r, y in rows[:i].tolist():
            if c == d and x != y and similar.enough(min(s - q, t - r), s, t):
                want.add((a, b, x, y) if a < b else (b, a, y, x))
    kinds = ("code", "name", "size", "place", "label")
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in part.T], names=list(kinds)) for part in np.array_split(rows, 7)]
    got = [tuple(r.values()) for b in similar._pairs(iter(batches)) for r in b.to_pylist()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_parities_bound_what_differs():
    """Never more bits than hashes differ, whatever the sizes; sets of one size that share half are told apart by them."""
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 60, 64, 65, 100, 128, 129, 490, 3000):
        pool = rng.integers(0, 1 << 64, 3 * n, dtype=np.uint64)
        for a, b, shared in ((n, n, n), (n, n, n // 2), (n, n * 5 // 4, n), (n, n, n * 8 // 9), (n, 0, 0)):
            sets = [np.sort(pool[:a]), np.sort(pool[a - shared : a - shared + b])]
            one, two = simhash.parities(np.concatenate(sets), np.array([a, b]))
            apart = similar.differing(one, two)
            assert apart == similar.differing(two, one) <= len(np.setxor1d(*sets))
            if n >= 60 and shared == n // 2:
                assert not similar.enough((a + b - apart) // 2, a, b)


def test_texts_travel_for_possible_pairs_only(spark):
    """Texts that share a passage of a third, so that they meet by first shingles, are told apart without their texts."""
    rng, rows = random.Random(7), []
    for k in range(60):
        common = [f"c{rng.randrange(10**6)}" for _ in range(100)]
        rows += [(2 * k + e, " ".join(common + [f"w{rng.randrange(10**6)}" for _ in range(200)])) for e in (0, 1)]
    docs = materialise(spark.createDataFrame(rows, "doc_id long, text string"), "third")
    prints = simhash.wide_fingerprints(docs)
    assert similar.links_between(docs, prints, simhash.linked_groups(prints, simhash.WIDE)) is None
    texts = keyed(docs)
    some = texts.where("id % 40 = 3").select("id", "key")
    got = {r["id"]: bytes(r["hashes"]) for r in similar.sets_near(texts, some, 5).collect()}
    assert got == {i: simhash.shingle_sets([t.encode()])[0].tobytes() for i, t in rows if i % 40 == 3}
    assert similar.sets_near(texts, some.limit(0), 5).isEmpty()
