"""The corpus pipeline: documents through five stages, each written as Parquet and read again as the next one's input.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents (`COLUMNS`; further ones are left
out). Clean documents stay. In every stage a null text is the empty text, a null doc_id is one more id, the largest of all, and rows are told
apart by doc_id and text: rows that share an id but differ in text are judged each by its own text, rows that repeat both go or stay together
(exact dedup leaves one of them). An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontam, exact_dedup, packing, similar, toxicity
from graphloom.llm.common import NULL_ID, table
from graphloom.session import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity (8): a document goes if its score reaches its language's threshold (that of all languages where lang is null or rare). Learns from the
    labelled documents of this input; without labels of both classes every score is the share of toxic labels, 0.5 without any, and the threshold 0.3:
    so without labels nothing can be told and no document goes."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    if model.constant is not None:
        return docs.select(*COLUMNS)
    return toxicity.flagged(docs.select(*COLUMNS), model).where(~F.col("_toxic")).select(*COLUMNS)


def _by_row(docs: DataFrame) -> DataFrame:
    """docs with what tells its rows apart: id and key of the text."""
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select(*COLUMNS, F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), key.alias("_key"))


def _drop(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """The rows of docs that are not in gone (doc_id, text_key). gone is written first, so that the planner knows its size."""
    ids = materialise(gone.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), F.col("text_key").alias("_key")).distinct(), name)
    return _by_row(docs).join(ids, ["_id", "_key"], "left_anti").select(*COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (5): of equal texts, the row with the largest doc_id stays; of rows that repeat id and text, one."""
    groups = exact_dedup.exact_groups(docs)
    groups = materialise(groups.select("doc_id", "kept", "text_key"), "exact-groups")
    again = materialise(groups.where("kept").groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"), "repeated-rows")
    gone = groups.where(~F.col("kept")).select("doc_id", "text_key")
    if again.isEmpty():
        return _drop(docs, gone, "exact-copies")
    ids = again.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), F.col("text_key").alias("_key"))
    once = _by_row(docs).join(ids, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]).select(*COLUMNS)
    return _drop(docs, gone.unionByName(again), "exact-copies").unionByName(once)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near dedup (6): of each component of documents, linked by wide fingerprints (an estimate of the five-word similarity) or by a similarity of 0.8 and
    more, the one with the smallest doc_id stays (of equal or null ids the one with the smallest xxhash64 of the text). No pair at 0.8 is missed. Texts
    without words are alike, so one of them stays."""
    return _drop(docs, similar.whole_components(docs).where(~F.col("kept")).select("doc_id", "text_key"), "near-copies")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decontamination (4): a document that contains a benchmark item goes. Items of under five words, null and empty ones are in no document."""
    found = decontam.contained_items(docs, table(spark, sf_dir, "benchmark"))
    return _drop(docs, found.select("doc_id", "text_key"), "contaminated")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing (10) of what is left. Null and empty texts are the end token alone."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: Learned scores, hashes and token ids have no SQL form; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
