"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so an item is looked for by
containment: the share of the item's distinct five-word shingles that the
document holds. Shingles are hashed; the hash order is the min-wise
permutation. Items are partitioned by their size: one of q shingles that a
document holds to a share of at least ``least`` misses at most
m = floor((1 - least) q) of them, so its signature is its m + 1 minimum
hashes, of which the document must hold at least one. That loses no pair,
whatever the document's length. Documents of fewer shingles than the item's
size class needs are not compared. Candidates are then verified with the exact
shingles.

All of it is DataFrame expressions. Texts stay where they are for the search;
only documents with a candidate are verified.

Edge cases: words are runs of letters and digits in lower case; a text or item
of fewer than five words, or a null one, has no shingles and no pairs; repeated
items each get their pairs; of rows that repeat a doc_id the best counts; a
null doc_id or item_id has no pairs; an empty table gives an empty result;
further columns stay out of the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placard.llm.common import checkpointed, only, small, table

SHINGLE = 5
#: Signatures of up to this many hashes are broadcast (under 100 MB); more are joined by a shuffle.
BROADCAST_ROWS = 1 << 21


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != F.lit(""))


def _shingles(words: str, join) -> Column:
    """The distinct shingles of an array column (words, or their hashes); ``join`` makes one of its parts."""
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0)))
    return F.array_distinct(F.transform(starts, lambda first, i: join(first, *[F.get(words, i + k) for k in range(1, SHINGLE)])))


def _hashed(docs: DataFrame) -> DataFrame:
    """docs (text) with hashes: those of the distinct shingles. Each word is hashed once."""
    return docs.withColumn("words", _words(F.col("text"))).withColumn("each", F.transform("words", lambda w: F.xxhash64(w))).withColumn("hashes", _shingles("each", F.xxhash64))


def _exact(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def candidates(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, item_id) with every pair of at least this containment, and few others."""
    percent = round(100 * least)
    sized = _hashed(items).withColumn("hashes", F.array_sort("hashes")).withColumn("q", F.size("hashes"))
    signature = sized.select("item_id", F.expr(f"(q * {percent} + 99) div 100").alias("need"), F.explode_outer(F.expr(f"slice(hashes, 1, (q * {100 - percent}) div 100 + 1)")).alias("h"))
    signature = checkpointed(signature)
    # Outer: a plain explode's inferred filter would compute the hashes twice, within the lambda. Nulls join nothing.
    held = _hashed(docs).select("doc_id", F.size("hashes").alias("size"), F.explode_outer("hashes").alias("h"))
    found = held.join(small(signature, BROADCAST_ROWS), "h").filter("size >= need")
    return found.select("doc_id", "item_id").distinct()


def contained_items(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, n_shared, n_item: the items that documents hold to a share of at least ``least``."""
    docs = only(docs, "doc_id", "text").filter("doc_id is not null")
    items = only(items, "item_id", "text").filter("item_id is not null")
    found = checkpointed(candidates(docs, items, least).groupBy("doc_id").agg(F.collect_set("item_id").alias("item_ids")))
    held = docs.join(small(found), "doc_id").withColumn("words", _words(F.col("text"))).select("doc_id", "item_ids", _shingles("words", _exact).alias("held"))
    wanted = items.withColumn("item_words", _words(F.col("text"))).select("item_id", _shingles("item_words", _exact).alias("wanted"))
    pairs = held.select("doc_id", "held", F.explode("item_ids").alias("item_id")).join(wanted, "item_id")
    counted = pairs.select("doc_id", "item_id", F.size(F.array_intersect("held", "wanted")).cast("long").alias("n_shared"), F.size("wanted").cast("long").alias("n_item"))
    return counted.filter(f"100 * n_shared >= {round(100 * least)} * n_item").groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("n_item").alias("n_item"))


def drop_contaminated(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """docs without those that hold a test item.

    Rows that repeat a doc_id go together if one of them holds an item; rows
    without doc_id stay; null and empty texts hold nothing; an item table
    without rows leaves all.
    """
    found = checkpointed(contained_items(docs, items, least).select("doc_id").distinct())
    return docs.join(small(found), "doc_id", "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _duck_shingles(source: str, key: str) -> str:
    return f"""(select distinct {key}, array_to_string(ws[i:i + 4], ' ') as s from (
      select {key}, ws, unnest(range(1, len(ws) - 3)) as i from (
        select {key}, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') as ws from {source}) where len(ws) >= 5))"""


OP7_SQL = f"""
with d as {_duck_shingles("documents", "doc_id")}, b as {_duck_shingles("benchmark", "item_id")},
n as (select item_id, count(*) as n_item from b group by item_id)
select doc_id, item_id, count(*) as n_shared, n_item from d join b using (s) join n using (item_id)
group by doc_id, item_id, n_item having 100 * count(*) >= 80 * n_item
"""
