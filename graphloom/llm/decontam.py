"""Operator 4: benchmark decontamination by size-partitioned MinHash containment search. DataFrame functions only.

A text contains a test item if it has at least `threshold` of the item's distinct shingles (five words, lower case). A text that does so
misses at most a fifth of them, hence not all of any n - ceil(threshold * n) + 1: the item's smallest hashes, its MinHash sketch, of just
that length, hit every text that contains it. Items are partitioned by size; each partition has the largest hash of its sketches, so of a
text only hashes up to the bound of the partitions that it is long enough for are looked up. Candidates are verified by the exact
containment of shingles, as strings. No text that contains an item is missed.

Defined results: null and empty texts, and items of fewer than five words, have no shingle and are in no result; repeated rows give one
row; null ids are kept apart from all others and come back as null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import keyed, real_id
from graphloom.session import materialise

SHINGLE_WORDS, THRESHOLD = 5, 0.8


def words_of(text: Column) -> Column:
    """Lower-case words: what stands between x20 and x09-x0D."""
    return F.array_remove(F.split(F.translate(F.lower(text), "\t\n\x0b\x0c\r", "     "), " "), "")


def _exploded(words: DataFrame, n: int, *columns: str, text: bool = False) -> DataFrame:
    """(columns, hash) of each shingle, on request with the shingle itself."""
    at = words.where(F.size("words") >= n).select(*columns, "words", F.explode(F.sequence(F.lit(0), F.size("words") - n)).alias("at"))
    own = [F.col("words")[F.col("at") + k] for k in range(n)]
    return at.select(*columns, F.xxhash64(*own).alias("hash"), *([F.concat_ws(" ", *own).alias("shingle")] if text else []))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, n: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment, text_key (xxhash64): the pairs of at least the threshold. items: item_id, text."""
    own = keyed(docs)
    item = keyed(items, "item_id").select(F.col("id").alias("item"), F.col("key").alias("item_key"), words_of(F.col("text")).alias("words")).distinct()
    hashes = _exploded(item, n, "item", "item_key").distinct()
    sizes = hashes.groupBy("item", "item_key").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("hash")).alias("hashes"))
    depth = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)) + 1
    sketch = materialise(
        sizes.select("item", "item_key", "n", F.floor(F.log2("n")).cast("int").alias("part"), F.explode(F.slice("hashes", F.lit(1), depth.cast("int"))).alias("hash")), "sketches"
    )
    # at most 64 partitions, as sizes double from one to the next
    parts = [(math.ceil((1 << r["part"]) * threshold - 1e-9), r["bound"]) for r in sketch.groupBy("part").agg(F.max("hash").alias("bound")).collect()]
    length = F.size("words") - n + 1
    lowest = F.lit(-(1 << 63))
    bound = F.greatest(lowest, lowest, *[F.when(length >= least, F.lit(b)).otherwise(lowest) for least, b in parts])
    words = own.select("id", "key", words_of(F.col("text")).alias("words")).select("id", "key", "words", bound.alias("bound"))
    looked_up = _exploded(words, n, "id", "key", "bound").where(F.col("hash") <= F.col("bound")).select("id", "key", "hash")
    candidates = materialise(looked_up.join(sketch, "hash").select("id", "key", "item", "item_key").distinct(), "candidates")
    # verification: the candidates' shingles against the items', as strings
    # the candidates' texts are written first: else the words of all texts would be split again, as Spark moves that below the join
    texts = materialise(own.join(materialise(candidates.select("id", "key").distinct(), "candidate-rows"), ["id", "key"], "left_semi"), "candidate-texts")
    some = texts.select("id", "key", words_of(F.col("text")).alias("words"))
    of_items = _exploded(item, n, "item", "item_key", text=True).distinct()
    met = _exploded(some, n, "id", "key", text=True).join(of_items, ["hash", "shingle"]).select("id", "key", "item", "item_key", "shingle").distinct()
    pairs = candidates.join(met, ["id", "key", "item", "item_key"]).groupBy("id", "key", "item", "item_key").agg(F.count("*").cast("int").alias("n_shared"))
    counted = pairs.join(sizes.select("item", "item_key", F.col("n").alias("n_shingles")), ["item", "item_key"])
    passed = counted.where(F.col("n_shared") >= F.ceil(F.col("n_shingles") * F.lit(threshold) - F.lit(1e-9))).distinct()
    return passed.select(
        real_id().alias("doc_id"), real_id("item").alias("item_id"), F.col("n_shingles").cast("long"), F.col("n_shared").cast("long"), F.round(F.col("n_shared") / F.col("n_shingles"), 6).alias("containment"), F.col("key").alias("text_key")
    )
