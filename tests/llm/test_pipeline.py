"""The pipeline's stages against brute force on the smallest tables, and rows that stages must handle."""

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as p  # noqa: E402
from graphloom.llm import toxicity
from graphloom.session import materialise


@pytest.fixture(scope="module")
def docs(spark, sf):
    own = spark.read.parquet(f"{sf}/documents.parquet")
    more = [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "", "en", "s", 0), (903, "only here", "en", "s", 9), (903, "only here", "en", "s", 9), (903, "another text", "en", "s", 12)]
    return materialise(own.unionByName(spark.createDataFrame(more, own.schema)), "pipeline-docs")


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_columns_and_names(spark, docs, sf):
    assert [n for n, _ in p.STAGES] == ["toxicity", "exact dedup", "simhash near-dedup", "benchmark decontamination", "best-fit packing"]
    for _, stage in p.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == list(p.COLUMNS)


def test_toxicity_stage(spark, docs, sf):
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    limits = model.thresholds
    want = [(r["doc_id"], r["text"]) for r in docs.collect() if model.score([(r["text"] or "").encode()])[0] < limits.get(r["lang"] or "", limits[""])]
    assert texts(p.drop_toxic(spark, docs, sf)) == sorted(want, key=repr) and len(want) < docs.count()


def test_toxicity_stage_against_plain_convolution(spark, docs, sf):
    """The same decisions by a convolution written out place by place, in double precision; scores at the threshold may differ."""
    from test_operators import plain_scores

    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = [r for r in docs.collect() if len(r["text"] or "") < 1500][:60]
    plain = plain_scores(model, [(r["text"] or "").encode() for r in rows])
    kept = {(r["doc_id"], r["text"]) for r in p.drop_toxic(spark, docs, sf).collect()}
    for r, score in zip(rows, plain):
        limit = model.thresholds.get(r["lang"] or "", model.thresholds[""])
        assert abs(score - limit) < 1e-3 or (score < limit) == ((r["doc_id"], r["text"]) in kept)


def test_near_stage_keeps_one_of_null_and_equal_ids(spark, docs, sf):
    long = " ".join(f"w{k}" for k in range(200))
    rows = [(None, long + " a"), (None, long + " b"), (7, long.replace("w0 ", "x ") + " c"), (8, "quite another text"), (8, long + " d"), (9, ""), (10, None)]
    own = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], docs.schema)
    got = texts(p.drop_near_copies(spark, own, sf))
    assert got == sorted([rows[2], rows[3], (9, "")], key=repr)
    only_null = own.where("doc_id is null")
    assert len(texts(p.drop_near_copies(spark, only_null, sf))) == 1


def test_stages_without_labels_or_items(spark, docs, sf, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert texts(p.drop_toxic(spark, docs, str(tmp_path))) == texts(docs) == texts(p.drop_contaminated(spark, docs, str(tmp_path)))


def test_exact_stage(spark, docs, sf):
    most = {}
    for r in docs.collect():
        most[r["text"] or ""] = max(most.get(r["text"] or "", -1), r["doc_id"])
    got = texts(p.drop_exact_copies(spark, docs, sf))
    assert sorted((d, t or "") for d, t in got) == sorted((d, t) for t, d in most.items())


def test_decontamination_stage(spark, docs, sf):
    split = lambda t: (t or "").lower().split()
    shingles = lambda t: {tuple(split(t)[k : k + 5]) for k in range(len(split(t)) - 4)}
    items = [s for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() if (s := shingles(r["text"]))]
    want = sorted(((r["doc_id"], r["text"]) for r in docs.collect() if not any(5 * len(s & shingles(r["text"])) >= 4 * len(s) for s in items)), key=repr)
    assert texts(p.drop_contaminated(spark, docs, sf)) == want and len(want) < docs.count()


def test_packing_stage(spark, docs, sf):
    """Every piece once, with its ids' sum, gapless; no more sequences than first fit of descending lengths needs."""
    from test_operators import check_packing

    rows = p.pack(spark, docs, sf).collect()
    used, _ = check_packing(rows, [r["text"] or "" for r in docs.collect()], 2048)
    gaps = []
    for n in sorted((r["length"] for r in rows), reverse=True):
        fit = next((k for k, gap in enumerate(gaps) if gap >= n), None)
        if fit is None:
            gaps.append(2048 - n)
        else:
            gaps[fit] -= n
    assert used <= len(gaps)


def test_run(spark, sf):
    """The stages one after the other give what run() packs."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf), "by-hand")
    rows = p.run(spark, sf)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert {r["doc_id"] for r in rows.collect()} == {r["doc_id"] for r in docs.collect()}
    used = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert 0 < used.count() and used.agg(F.max("n")).first()[0] <= 2048
