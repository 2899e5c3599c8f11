"""Each training-data operator against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import decontam, exact_dedup, packing, pii, quality, simhash, substring_dedup, suffix_dedup, token_counts, toxicity, windows
from graphloom.llm.tokenizer import default_path, load

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("id", "key", "bucket", "kind", "payload", "print", "score", "piece", "length", "variant", "label", "y", "_id", "_key")


def odd_texts():
    """Texts with shared passages, copies, near copies, blanks, a null and a long one."""
    rng = random.Random(4)
    vocab = ["ab", "cd", "efg", "hi", "é", "xyz", "Über,", "q."]
    words = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passages = [words(rng.randint(40, 130)) for _ in range(8)]
    rows = []
    for d in range(60):
        parts = [rng.choice(passages) if rng.random() < 0.5 else words(rng.randint(1, 90)) for _ in range(rng.randint(0, 5))]
        rows.append((d, "  \n".join(parts)))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, rows[5][1]), (103, rows[5][1]), (5, rows[5][1]), (104, rows[5][1].replace("efg", "hi", 1)), (None, rows[7][1]), (105, "ab " * 900), (106, "ab " * 700), (107, "a"), (108, "\x00" * 120 + "z" * 60), (109, "z" * 60)]
    rng.shuffle(rows)
    return rows


ROWS = odd_texts()
IDS = [d if d is not None else (1 << 63) - 1 for d, _ in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in ROWS], SCHEMA).repartition(3)
    return own.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def shown(rows):
    return sorted(((None, *r[1:]) if r[0] == (1 << 63) - 1 else tuple(r) for r in rows), key=repr)


def words_left(width):
    first, out = {}, []
    split = [(t or "").encode().split() for _, t in ROWS]
    for d, w in zip(IDS, split):
        for a in range(len(w) - width + 1):
            k = tuple(w[a : a + width])
            first[k] = min(first.get(k, d), d)
    for d, w in zip(IDS, split):
        gone = set()
        for a in range(len(w) - width + 1):
            if first[tuple(w[a : a + width])] < d:
                gone.update(range(a, a + width))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return shown(out)


def test_word_windows(docs):
    got = substring_dedup.dedup_words(docs, digest=True)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == words_left(50)
    assert sum(r[2] for r in words_left(50)) > 100
    small = substring_dedup.dedup_words(docs, width=9, gram=3, digest=True)
    assert rows_of(small, "doc_id", "n_words", "n_removed", "kept_sha256") == words_left(9)
    texts = substring_dedup.dedup_words(docs)
    assert {hashlib.sha256(r["kept_text"].encode()).hexdigest() for r in texts.collect()} == {r[3] for r in words_left(50)}


def bytes_left(width):
    first, out = {}, []
    data = [(t or "").encode() for _, t in ROWS]
    for d, b in zip(IDS, data):
        for a in range(len(b) - width + 1):
            first[b[a : a + width]] = min(first.get(b[a : a + width], d), d)
    for d, b in zip(IDS, data):
        gone = np.zeros(len(b), dtype=int)
        for a in range(len(b) - width + 1):
            if first[b[a : a + width]] < d:
                gone[a : a + width] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return shown(out)


def test_byte_strings(docs):
    got = suffix_dedup.dedup_bytes(docs, digest=True)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == bytes_left(50)


@pytest.mark.parametrize("unit", ["word", "byte"])
def test_hot_and_long_texts(unit, monkeypatch):
    """Hot minimisers, merged removals, pieces of long texts: the exchange's own steps, with small bounds, against brute force."""
    for name, bound in (("MOST_ENTRIES", 6), ("MOST_LOCAL", 3), ("CHUNK_BYTES", 400), ("FLUSH_BYTES", 3000), ("PART_BYTES", 500)):
        monkeypatch.setattr(windows, name, bound)
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 100)
    width, gram = (50, 8) if unit == "word" else (50, 20)
    repeated = substring_dedup.repeated_windows if unit == "word" else suffix_dedup.repeated_strings
    grams = {"unit": unit, "width": width, "gram": gram, "n_buckets": 3, "n_doc_buckets": 6}
    texts = [(t or "").encode() for _, t in ROWS]
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("text", pa.string())])
    keys = [xxhash.xxh64_intdigest(t, 42) - (1 << 63) for t in texts]
    own = [pa.RecordBatch.from_arrays([pa.array(IDS[a : a + 20]), pa.array(keys[a : a + 20]), pa.array([t.decode() for t in texts[a : a + 20]])], schema=schema) for a in range(0, len(IDS), 20)]

    def exchanged(batches, *order):
        rows = pa.Table.from_batches(list(batches), schema=windows._SENT)
        return rows.sort_by([(c, "ascending") for c in order]).to_batches(max_chunksize=5)

    to_owners = exchanged(windows._minimisers(iter(own), **grams), "kind", "bucket")
    shared = list(windows._own_or_pass(to_owners, own=windows._shared))
    blobs = list(windows._texts(iter(own), n_doc_buckets=6))
    sent = exchanged(windows._send(exchanged([*shared, *blobs], "bucket", "kind"), **grams), "kind", "bucket")
    kinds = {k for b in sent for k in b.column(1).to_pylist()}
    assert kinds == {0, 1, 2}
    cuts = list(windows._own_or_pass(sent, own=lambda rows: windows._own(rows, width, 6, repeated)))
    result, out_schema = (substring_dedup._kept_digest, substring_dedup._DIGEST) if unit == "word" else (suffix_dedup._kept_digest, suffix_dedup._DIGEST)
    done = windows._finish(iter(exchanged([*cuts, *blobs], "bucket", "kind")), result, out_schema)
    got = [tuple(r.values()) for b in done for r in b.to_pylist()]
    assert shown(got) == (words_left(50) if unit == "word" else bytes_left(50))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"bb", b"longword", b"\xc3\xa9"]), max_size=400), st.sampled_from([3, 7]), st.sampled_from(["word", "byte"]))
def test_pieces_hold_each_window_once(words, width, unit):
    text, own = b" ".join(words), windows.CHUNK_BYTES
    windows.CHUNK_BYTES = 50
    try:
        parts = list(windows.pieces([text], unit, width))
    finally:
        windows.CHUNK_BYTES = own
    split = (lambda t: t.split()) if unit == "word" else list
    whole, at = split(text), 0
    for (piece,), first in parts:
        assert split(piece) == whole[first : first + len(split(piece))] and first == at
        at = first + max(0, len(split(piece)) - width + 1)
    assert at == max(0, len(whole) - width + 1)


def test_shards_are_merged(monkeypatch):
    strings = [(t or "").encode() for _, t in ROWS if t]
    ids = np.array([i for i, (_, t) in zip(IDS, ROWS) if t])
    whole = sorted(suffix_dedup.repeated_strings(strings, ids, 50))
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 700)
    assert sorted(suffix_dedup.repeated_strings(strings, ids, 50)) == whole and whole


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=80) | st.lists(st.sampled_from([0, 97, 98]), min_size=1, max_size=120).map(bytes))
def test_suffix_array_and_prefixes(data):
    buf = np.frombuffer(data, np.uint8)
    order, eights = suffix_dedup.suffix_array(buf, 50)
    assert order.tolist() == sorted(range(len(data)), key=lambda k: data[k:])
    for depth in (None, 100):
        order, eights = suffix_dedup.suffix_array(buf, 50, depth)
        check_prefixes(data, order, suffix_dedup.common_prefixes(order, eights, 50))


def check_prefixes(data, order, shared):
    padded = data + bytes(200)
    for a, b, n in zip(order[:-1].tolist(), order[1:].tolist(), shared[1:].tolist()):
        want = 0
        while want < 50 and padded[a + want] == padded[b + want]:
            want += 1
        assert n == want


def test_exact_groups(docs):
    groups = {}
    for i, (_, t) in zip(IDS, ROWS):
        groups.setdefault(t or "", []).append(i)
    want = shown([(i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, (_, t) in zip(IDS, ROWS)])
    want = sorted(((d, None if k == (1 << 63) - 1 else k, *rest) for d, k, *rest in want), key=repr)
    for capacity in (1 << 20, 600):
        assert rows_of(exact_dedup.exact_groups(docs, capacity), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_directory_splits_overfull_buckets():
    fine = np.array([9, 1, 1, 0, 0, 0, 0, 1])
    directory = exact_dedup.grow_directory(fine, 4)
    loads = np.bincount(np.repeat(directory, len(fine) // len(directory)), weights=fine)
    assert len(directory) == 8 and sorted(loads.tolist()) == [1, 1, 1, 9] and len(set(directory[4:])) == 1
    assert exact_dedup.grow_directory(np.array([1, 1]), 4).tolist() == [0]


def plain_print(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text).encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    label = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = label[a], label[b]
                label = [y if q == x else q for q in label]
    return label


def test_simhash(docs):
    prints = [plain_print(t or "") for _, t in ROWS]
    label = components(prints)
    least = {}
    for i, c in zip(IDS, label):
        least[c] = min(least.get(c, i), i)
    want = shown([(i, f"{p:016x}", least[c]) for i, p, c in zip(IDS, prints, label)])
    want = sorted(((d, p, None if c == (1 << 63) - 1 else c) for d, p, c in want), key=repr)
    assert rows_of(simhash.near_components(docs), "doc_id", "fingerprint", "component_id") == want


def test_spark_hash_is_the_printed_one(spark):
    own = spark.createDataFrame([("a b c d",)], "t string").select(F.xxhash64("t")).first()[0]
    assert own & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c d", 42)


@settings(max_examples=40, deadline=None)
@given(seed=st.integers(0, 2**32), n=st.integers(2, 90))
@pytest.mark.parametrize("most", [32, 3])
def test_links_connect_what_brute_force_does(most, seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 3, dtype=np.int64)
    prints = np.unique(np.array([int(base[k % 3]) ^ sum(1 << int(b) for b in rng.integers(0, 63, rng.integers(0, 4))) for k in range(n)], dtype=np.int64))
    bits = prints.view(np.uint64)[:, None]
    codes = [np.uint64(k << 32) | simhash._field(bits, first, width) for k, (first, width, _, _) in enumerate(simhash.NARROW.halves())]
    every = np.tile(np.arange(len(prints)), len(codes))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(simhash, "PAIRWISE", most)
        links = list(zip(*(x.tolist() for x in simhash.links_of(np.concatenate(codes), prints[every], bits[every], simhash.NARROW))))
    assert all((a ^ b).bit_count() <= 4 if a >= 0 and b >= 0 else True for a, b in links)
    root = {p: p for p in prints.tolist()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    u = prints.view(np.uint64).tolist()
    for a in range(len(u)):
        for b in range(a):
            if (u[a] ^ u[b]).bit_count() <= 4:
                assert find(int(prints[a])) == find(int(prints[b]))


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text.lower()) if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_decontamination(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcde") for _ in range(3))
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 5, 9, 30, 60])))) for k in range(30)] + [(90, None), (91, ""), (3, "twice the same id with other words here")]
    docs = []
    for d in range(80):
        parts = [" ".join(word() for _ in range(rng.randint(0, 200)))]
        for _ in range(rng.randint(0, 2)):
            w = rng.choice(items)[1] or ""
            w = w.split()
            for _ in range(rng.randint(0, 2)):
                if w:
                    w[rng.randrange(len(w))] = word()
            parts.append(" ".join(w))
        docs.append((d, "\n\t ".join(parts).title() if d % 3 == 0 else " ".join(parts)))
    docs += [(500, None), (501, ""), docs[1], docs[2]]
    want = set()
    for d, t in docs:
        for i, x in items:
            s = shingles(x or "")
            if s and len(s & shingles(t or "")) * 5 >= 4 * len(s):
                want.add((d, i, len(s), len(s & shingles(t or ""))))
    ddf = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit(0).alias(c) for c in ("id", "key", "words", "hash", "item", "n")])
    got = decontam.contained_items(ddf, spark.createDataFrame(items, "item_id long, text string"))
    assert set(rows_of(got, "doc_id", "item_id", "n_shingles", "n_shared")) == want and got.count() == len(want) and len(want) > 20
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_decontamination_of_nothing(spark, nothing, docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contained_items(docs, items).count() == 0
    assert decontam.contained_items(nothing, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


TRICKY = ["", "a  b", "  ", "x\n y  ", "hi <|endoftext|> yo", "don't  stop", " lead", "tab\t x", "é ü", "x" * 300 + " y", "　 x", "ab" * 20000, "\r\n\r\n a", "🤖 1234567 ²½", " " * 3000]


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_the_library():
    got = [np.frombuffer(x, "<u4").tolist() for x in load(default_path()).ids(TRICKY)]
    assert got == library_ids(TRICKY)


@pytest.mark.parametrize("blank", [" ", "\n", "\t", " \n\u3000"])
def test_long_blanks(blank):
    run = (blank * 2_000_000)[:2_000_000]
    texts = [run, f"a{run}b", f"in a{run[:150_000]}word{run[:99_999]}<|endoftext|> x{run[:100_000]}"]
    assert [np.frombuffer(x, "<u4").tolist() for x in load(default_path()).ids(texts)] == library_ids(texts)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=200))
def test_ids_equal_the_library_on_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(load(default_path()).ids([text])[0], "<u4").tolist() == library_ids([text])[0]


def test_token_counts_and_cache(spark, docs, nothing, tmp_path):
    counts = [len(x) for x in library_ids([t or "" for _, t in ROWS])]
    want = shown([(i, len((t or "").encode()), c, c > 30) for i, (_, t), c in zip(IDS, ROWS, counts)])
    cache = str(tmp_path / "cache")
    for _ in range(2):
        assert rows_of(token_counts.count_tokens(docs, cache_path=cache, limit=30), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for _, t in ROWS})  # the second run found all in the cache
    more = docs.limit(0).unionByName(docs.limit(2).withColumn("text", F.lit("quite new")))
    assert {r["n_tokens"] for r in token_counts.count_tokens(more, cache_path=cache).collect()} == {len(library_ids(["quite new"])[0])}
    assert spark.read.parquet(cache).count() == stored.count() + 1 or spark.read.parquet(cache).count() == len({t or "" for _, t in ROWS}) + 1
    assert token_counts.count_tokens(nothing).count() == 0


def test_other_vocabularies(spark, docs):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = token_counts.count_tokens(docs.limit(5), tokenizer_path=path)
    assert got.count() == 5


def check_packing(rows, texts, size):
    ids = [np.array([*x, 0], dtype="<u4") for x in library_ids(texts)]
    pieces = Counter()
    for own in ids:
        n, begin, piece = len(own), 0, 0
        while begin < n:
            stop = begin + (n - begin - 1) % size + 1
            pieces[piece, begin, stop - begin, zlib.crc32(own[begin:stop].tobytes())] += 1
            begin, piece = stop, piece + 1
    assert Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(places), sum(k[2] * n for k, n in pieces.items())


def test_packing(docs, nothing):
    for small, groups in ((40, 8), (None, 64)):
        rows = packing.pack_documents(docs, size=256, small=small, groups=groups).collect()
        used, total = check_packing(rows, [t or "" for _, t in ROWS], 256)
        gaps = []
        for n in sorted((r["length"] for r in rows), reverse=True):
            fit = next((k for k, gap in enumerate(gaps) if gap >= n), None)
            if fit is None:
                gaps.append(256 - n)
            else:
                gaps[fit] -= n
        assert -(-total // 256) <= used <= len(gaps) * (1.25 if groups == 8 else 1)
    assert packing.pack_documents(nothing).count() == 0


def every_configuration(sizes, room):
    yield ()
    for k, s in enumerate(sizes):
        if s <= room:
            yield from ((s, *rest) for rest in every_configuration(sizes[k:], room - s))


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(9, 40), st.integers(1, 50), min_size=1, max_size=6), st.integers(0, 10**6))
def test_configurations_are_optimal(counts, seed):
    sizes = sorted(counts, reverse=True)
    every = list(every_configuration(sizes, 48))
    values = np.random.default_rng(seed).random(len(sizes))
    value, used = packing.best_configuration(sizes, values, 48)
    worth = dict(zip(sizes, values.tolist()))
    assert used @ np.array(sizes) <= 48 and abs(value - max(sum(worth[s] for s in c) for c in every)) < 1e-9
    runs = packing.configurations(counts, 48)
    placed = Counter()
    for n, c in runs:
        assert sum(c) <= 48 and n > 0
        for s in c:
            placed[s] += n
    assert placed == Counter(counts)
    assert sum(n for n, _ in runs) <= sum(-(-n // (48 // s)) for s, n in counts.items()) + len(sizes)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=40), st.integers(1, 30))
def test_plan_places_every_length(counts, groups):
    runs = packing.plan_runs(counts, 64, 16, groups)
    got = Counter()
    for n, lengths in runs:
        assert sum(lengths) <= 64
        for s in lengths:
            got[s] += n
    assert got == Counter(counts)
    places = packing.place_table(runs)
    assert len(set(zip(places["sequence"].tolist(), places["offset"].tolist()))) == len(places["sequence"])


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", ".", "1", "22", "+", "-", " ", "(", ")", "300", "000000000300", "9", "é", "４", "4111111111111111", "b.co", "+1", "127.0.0.1", "5500-0000-0000-0004"]), max_size=18).map("".join))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_personal_data(spark, nothing):
    rng = random.Random(2)
    rows = []
    for d in range(60):
        words = " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(12))
        rows.append((d, f"{words} {rng.choice(['bob', 'eve'])}.{d}@mail{d % 9}.example.com {words} +1 ({100 + d}) 555-{1000 + d} {words} 10.{d}.7.9 x 4111111111111111 {words}"))
    rows += [(90, None), (91, ""), (92, "no digits here"), (93, "é +1 (269) 555-3296 4111111111111111 z"), (94, "on 2020-01-02 at 12:30")]
    got = {r["doc_id"]: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        want = plain_spans(t or "")
        base = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        r = got[d]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == n for x in want) for n in range(4)]
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
    assert got[93]["spans"] == "phone:2:19,card:20:36" and got[93]["n_added"] == 2
    assert got[90]["spans"] == got[92]["spans"] == got[94]["spans"] == ""
    assert pii.personal_data(nothing).count() == 0


def test_column_order_of_personal_data(spark, nothing):
    assert pii.personal_data(nothing, np.zeros((len(pii._FEATURES), 4))).columns[:7] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


def labellings(n, segments, at=0):
    """All sets of segments that do not overlap, each with one of the kinds."""
    yield ()
    for i, j in segments:
        if i >= at:
            for k in range(4):
                for rest in labellings(n, segments, j):
                    if not rest or rest[0][0] >= j:
                        yield ((i, j, k), *rest)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(0, 5))
def test_semi_markov_against_all_labellings(seed, n, m):
    rng = np.random.default_rng(seed)
    segments = sorted({tuple(sorted(rng.choice(n + 1, 2, replace=False).tolist())) for _ in range(m)}) if n else []
    scores = rng.normal(0, 2, (len(segments), 4))
    value = lambda y: sum(scores[segments.index((i, j)), k] for i, j, k in y)
    every = list(set(labellings(n, segments)))
    best = max(every, key=value)
    got = pii.best_labelling(n, iter([(i, j, float(x.max()), int(x.argmax())) for (i, j), x in zip(segments, scores)]))
    assert abs(value(got) - value(best)) < 1e-9 and set(got) == set(best)
    alpha, beta = pii._forward(n, segments, scores)
    total = np.logaddexp.reduce([value(y) for y in every])
    assert abs(alpha[n] - total) < 1e-9 and abs(beta[0] - total) < 1e-9
    for s, (i, j) in enumerate(segments):
        with_it = [value(y) for y in every if any((a, b) == (i, j) for a, b, _ in y)]
        assert abs(alpha[i] + np.logaddexp.reduce(scores[s]) + beta[j] - np.logaddexp.reduce(with_it)) < 1e-9


def random_person(rng):
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    card = "4" + digits(14)
    card += next(c for c in "0123456789" if pii.luhn(card + c))
    area = rng.randint(200, 989)
    return rng.choice([(f"{rng.choice(['bob', 'eve', 'kim'])}.{digits(2)}@mail{digits(1)}.example.com", 0), (".".join(str(rng.randint(0, 255)) for _ in range(4)), 1), (" ".join(card[k : k + 4] for k in range(0, 16, 4)), 2), (f"+1 ({area}) 555-{digits(4)}", 3)])


def test_field_finds_rewritten_forms():
    """Precision and recall of the added spans on planted forms that the patterns do not know, among look-alikes; people and words not trained on."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))

    def text(people):
        out, spans = "", []
        for p, k in people:
            out += " ".join(word() for _ in range(rng.randint(3, 9))) + " "
            spans.append((len(out), k, len(out) + len(p)))
            out += p + " "
        return out + word(), spans

    people = [random_person(rng) for _ in range(900)]
    weights = pii.train([e for a in range(0, 600, 2) for e in pii.examples_of(text(people[a : a + 2])[0])])
    found = right = planted = 0
    for span, kind in people[600:]:
        form = rng.choice(pii.rewritten(span, kind))
        plain = pii.look_alikes(span, kind)
        t, want = text([(form, kind), *[(x, -1) for x in plain[:1]]])
        want = {s for s in want if s[1] >= 0}
        base, added = pii.find_spans(t, weights)
        got = set(base) | set(added)
        planted, found, right = planted + len(want), found + len(got), right + len(got & want)
    assert right >= 0.9 * planted and right >= 0.9 * found


@pytest.mark.parametrize("piece", ["bob@mail.example.com ", "a.b@c.de\t", "12 345 ", "1.2.3.4,", "@", "x", "+1 (269) 555-3296;", "4111 1111 1111 1111 "])
def test_long_texts_take_linear_time(piece):
    import time

    weights = np.zeros((len(pii._FEATURES), 4))
    weights[pii._FEATURES["bias"]] = -1

    def seconds(n):
        began = time.process_time()
        pii.find_spans(piece * n, weights)
        return time.process_time() - began

    n = 6_000 // len(piece)
    assert seconds(8 * n) < 30 * max(seconds(n), 0.02)  # 64 times if quadratic


def labelled(spark, n=400):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    docs, labels = [], []
    for d in range(n):
        words = [word() for _ in range(rng.randint(5, 120))]
        toxic, junk = d % 4 == 0, d % 3 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["nastyzz", "nastyqq", "vilekk"]))
        if junk:
            words = [w + "***" for w in words]
        docs.append((d, " ".join(words), "en" if d % 2 else "de"))
        labels.append((d, int(not junk), int(toxic)))
    docs += [(9000, None, None), (9001, "", "en"), (9002, "x " * 50_000, "xx"), (1, docs[1][1], "en")]
    labels += [(3, None, None), (None, 1, 1), (5, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score, label, parts, part", [(toxicity.toxicity_scores, 2, 4, 2), (quality.quality_scores, 1, 5, 0)])
def test_held_out_accuracy(spark, score, label, parts, part):
    docs, labels = labelled(spark)
    rows = score(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == part) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and truth.get(r["doc_id"]) is not None]
    right = sum(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert right >= 0.95 * len(held) and len(held) > 40
    # labels of held-out rows are not learned from
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn(
        "toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part, 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    again = {r["doc_id"]: r["score"] for r in score(docs, flipped).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in rows)


def test_discriminant_against_plain_formula():
    """Scores from cached inverse factors equal log densities of two normal distributions with the shrunk covariances."""
    rng = np.random.default_rng(5)
    d = len(quality.STATISTICS)
    own = [rng.normal(0, 1, (n, d)) @ rng.normal(0, 1, (d, d)) + rng.normal(0, 1, d) for n in (150, 90)]
    rows, sums = np.array([150.0, 90.0]), np.stack([x.sum(axis=0) for x in own])
    model = quality.discriminant(rows, sums, np.stack([x.T @ x for x in own]))
    both = np.concatenate(own)
    z = [(x - both.mean(axis=0)) / both.std(axis=0) for x in own]
    cov = [np.cov(x.T, bias=True) for x in z]
    pooled = (150 * cov[0] + 90 * cov[1]) / 240
    test = rng.normal(0, 2, (40, d))
    t = np.clip((test - both.mean(axis=0)) / both.std(axis=0), -12, 12)
    dense = []
    for c, n in ((0, 150), (1, 90)):
        lean = max(quality.TO_POOLED, d / (d + n))
        s = (1 - quality.TO_DIAGONAL) * ((1 - lean) * cov[c] + lean * pooled) + quality.TO_DIAGONAL * np.diag(np.diagonal(pooled)) + 1e-3 * np.eye(d)
        away = t - z[c].mean(axis=0)
        dense.append([-0.5 * (a @ np.linalg.inv(s) @ a + np.linalg.slogdet(s)[1]) for a in away])
    assert np.allclose(model.margin(test), np.array(dense[1]) - np.array(dense[0]) + np.log(90 / 150), atol=1e-6)


def test_statistics_by_plain_python():
    """Word and line statistics of odd texts, counted one by one."""
    for t in [t for _, t in ROWS if t]:
        got = dict(zip(quality.STATISTICS, quality.statistics(t.encode()).tolist()))
        words = t.encode().split()
        lines = [x for x in t.encode().split(b"\n") if x]
        odds = lambda hits, n: float(np.log((hits + 0.5) / (n - hits + 0.5)))
        w = max(1, len(words))
        assert abs(got["words"] - np.log1p(len(words))) < 1e-4 and abs(got["bytes"] - np.log1p(len(t.encode()))) < 1e-4
        assert abs(got["distinct_words"] - odds(len(set(words)), w)) < 1e-4 and abs(got["short_words"] - odds(sum(len(x) <= 3 for x in words), w)) < 1e-4
        assert abs(got["top_word"] - odds(max(Counter(words).values(), default=0), w)) < 1e-4
        assert abs(got["repeated_lines"] - odds(len(lines) - len(set(lines)), max(1, len(lines)))) < 1e-4


def small_model(seed=1):
    rng = np.random.default_rng(seed)
    filters = [rng.normal(0, 0.5, (w, toxicity.DEPTH, 3)) for w in toxicity.WIDTHS]
    return toxicity.ConvClassifier(rng.normal(0, 0.5, (toxicity.BUCKETS, toxicity.DEPTH)), filters, [rng.normal(0, 0.1, 3) for _ in toxicity.WIDTHS], rng.normal(0, 1, 9), 0.1)


def plain_scores(model, texts):
    """Convolution and pooling written out, a text, a filter and a place at a time."""
    out = []
    for t in texts:
        words, _ = toxicity.word_features([t])
        x = [sum(model.embed[b] for b in row) / len(row) for row in words.tolist()]
        pooled = []
        for w, b in zip(model.filters, model.offsets):
            for f in range(w.shape[2]):
                sums = [sum(float(x[a + k] @ w[k][:, f]) for k in range(len(w))) for a in range(len(x) - len(w) + 1)]
                pooled.append(max(0.0, max(sums) + b[f]) if sums else 0.0)
        out.append(1 / (1 + np.exp(-(np.dot(pooled, model.weights) + model.bias))))
    return out


def test_convolution_and_pooling_by_hand(monkeypatch):
    model = small_model()
    texts = [b"", b"one", b"one two", b"a b c d e f", b"Same WORDS same words", b"x " * 40, "é ü ß".encode(), b"  ,,, "]
    assert np.allclose(model.score(texts), plain_scores(model, texts), atol=1e-4)
    monkeypatch.setattr(toxicity, "SCORE_BYTES", 10)
    assert np.allclose(model.score(texts), plain_scores(model, texts), atol=1e-4)


def test_gradients_by_differences():
    model, labels = small_model(2), np.array([1, 0, 1, 0])
    texts = [b"a b c d", b"e f", b"g", b"h i j k l"]
    words, firsts = toxicity.word_features(texts)

    def loss():
        h, _ = model.pooled(words, firsts)
        m = (h.astype(np.float64) @ model.weights) + model.bias
        return float(np.mean(np.log1p(np.exp(m)) - labels * m)) + 0.5e-4 * float(model.weights @ model.weights)

    d, grads, (where, g) = toxicity.gradients(model, words, firsts, labels)
    for q, grad in zip((*model.filters, *model.offsets, model.weights), grads):
        at = np.unravel_index(int(np.argmax(np.abs(grad))), q.shape)
        q[at] += 1e-2
        up = loss()
        q[at] -= 2e-2
        down = loss()
        q[at] += 1e-2
        assert abs((up - down) / 2e-2 - grad[at]) < 0.02 * max(1, abs(grad[at]))
    total = np.zeros_like(model.embed)
    np.add.at(total, words[where].ravel(), np.repeat(g, words.shape[1], axis=0))
    at = np.unravel_index(int(np.argmax(np.abs(total))), total.shape)
    model.embed[at] += 1e-2
    up = loss()
    model.embed[at] -= 2e-2
    assert abs((up - loss()) / 2e-2 - total[at]) < 0.02 * max(1, abs(total[at]))
    assert abs(d.sum()) < 1


def test_flags_replace_columns_of_their_names(spark):
    docs, labels = labelled(spark, 120)
    odd = docs.select("*", F.lit("x").alias("_score"), F.lit("y").alias("_TOXIC"), F.lit(1).alias("y"))
    flags = toxicity.flagged(odd, toxicity.fit(odd, labels))
    assert flags.columns == ["doc_id", "text", "lang", "y", "_score", "_toxic"] and flags.count() == docs.count()


@pytest.mark.parametrize("score", [toxicity.toxicity_scores, quality.quality_scores])
def test_clashing_names_and_repeated_labels(spark, score):
    docs, labels = labelled(spark, 120)
    odd = docs.select("*", *[F.lit("c").alias(c) for c in ("id", "key", "y", "score", "stats", "held_out", "predicted", "_hash", "d")])
    plain = {r["doc_id"]: r["score"] for r in score(docs, labels).collect()}
    again = {r["doc_id"]: r["score"] for r in score(odd, labels.unionAll(labels).select("*", F.lit(1).alias("y"), F.lit(2).alias("id"))).collect()}
    assert all(abs(plain[d] - again[d]) < 1e-9 for d in plain) and len(plain) == len(again)


@pytest.mark.parametrize("score", [toxicity.toxicity_scores, quality.quality_scores])
def test_scores_without_labels_or_rows(spark, nothing, score):
    docs, labels = labelled(spark, 20)
    assert {r["score"] for r in score(docs, labels.limit(0)).collect()} == {0.5}
    assert score(nothing, labels.limit(0)).count() == 0


def test_language_thresholds(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    assert set(model.thresholds) <= {"", "en", "de"}
    flags = {r["doc_id"]: r["_toxic"] for r in toxicity.flagged(docs, model).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert sum(flags[d] == bool(t) for d, t in truth.items() if d in flags and t is not None) >= 0.95 * 400


@pytest.mark.parametrize("run", [lambda d: substring_dedup.dedup_words(d), lambda d: suffix_dedup.dedup_bytes(d), lambda d: exact_dedup.exact_groups(d), lambda d: simhash.near_components(d)])
def test_empty_tables(nothing, run):
    assert run(nothing).count() == 0
