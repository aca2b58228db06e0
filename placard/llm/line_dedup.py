"""Line dedup by pairwise alignment of overlapping documents.

Overlapping documents are found through runs: from each line, and to each line,
the fewest consecutive lines that reach ``block_words`` words. Each line of a deleted block is in a run that the
earlier document holds too. A document is aligned with the first holder of each
of its runs; where a run isn't deleted by that, with its next holders, twice as
many each time, until it is or no earlier holder is left. So the result is that
of aligning all earlier documents, and the pairs of a run grow with its
documents, not with their square, unless alignment fails. The first of these
steps takes ``rare`` holders. Exact copies of a whole text are set aside first: all of their lines are aligned with
the first copy's, and only that one goes on.

Each pair is aligned by patience diff: the lines that are unique in both
documents and in longest increasing order are anchors, equal lines next to an
anchor extend it, and the gaps between anchors are aligned the same way. An
aligned block of at least ``block_words`` words is deleted from the later
document.

The work runs on 64-bit line hashes; texts are read for the hashes and for the
result only.

Edge cases: a null text has no line and stays null; blank lines never find a
block, but those that are aligned in one go with it; rows that repeat a doc_id
with the same text are one document, and each row gets its result; those with
different texts are aligned by the first of them, in order of text hash, and
the others stay; a null doc_id stays as it is; an empty table gives an empty
result; further columns are kept, but deleted and n_lines are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placard.llm.common import checkpointed, only, packed, small, table, words


def _anchors(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Pairs of places of lines unique in both ranges, longest increasing in both."""
    once_a = {h for h, n in Counter(a[a0:a1]).items() if n == 1}
    once_b = {h: j for j, h in enumerate(b[b0:b1], b0)} if once_a else {}
    twice = {h for h, n in Counter(b[b0:b1]).items() if n > 1} if once_a else set()
    pairs = [(i, once_b[a[i]]) for i in range(a0, a1) if a[i] in once_a and a[i] in once_b and a[i] not in twice]
    piles, tops, back = [], [], []
    for i, (_, j) in enumerate(pairs):
        at = bisect_left(piles, j)
        piles[at : at + 1], tops[at : at + 1] = [j], [i]
        back.append(tops[at - 1] if at else -1)
    out, i = [], tops[-1] if tops else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def common_blocks(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """(start in a, start in b, lines) of the blocks that patience diff aligns, in order."""
    matched: list[tuple[int, int]] = []
    ranges = [(0, len(a), 0, len(b))]
    while ranges:
        a0, a1, b0, b1 = ranges.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            matched.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            matched.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        anchors = _anchors(a, b, a0, a1, b0, b1)
        if not anchors:
            continue
        matched += anchors
        for (i, j), (k, m) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            ranges.append((i + 1, k, j + 1, m))
    blocks: list[list[int]] = []
    for i, j in sorted(matched):
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1][2] += 1
        else:
            blocks.append([i, j, 1])
    return [tuple(x) for x in blocks]


def deleted_lines(earlier: list[int], later: list[int], sizes: list[int], block_words: int) -> list[int]:
    """The later document's lines in aligned blocks of at least block_words words; sizes: words of its lines."""
    out = []
    for _, start, n in common_blocks(earlier, later):
        if sum(sizes[start : start + n]) >= block_words:
            out += range(start, start + n)
    return out


def runs_of(sizes: list[int], block_words: int) -> set[tuple[int, int]]:
    """(first, last) places of the shortest runs from each line, and to each line, of at least block_words words; sizes: words of the lines."""
    out, hi, total = set(), 0, 0
    for i in range(len(sizes)):  # the shortest from line i
        while hi < len(sizes) and total < block_words:
            total += sizes[hi]
            hi += 1
        if total < block_words:
            break
        out.add((i, hi - 1))
        total -= sizes[i]
    lo, total = 0, 0
    for i in range(len(sizes)):  # the shortest to line i
        total += sizes[i]
        while total - sizes[lo] >= block_words:
            total -= sizes[lo]
            lo += 1
        if total >= block_words:
            out.add((lo, i))
    return out


def document_runs(originals: DataFrame, block_words: int) -> DataFrame:
    """(doc_id, run, a, b): the hash and the first and last places of each run of originals (doc_id, hashes, sizes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            ids, runs, firsts, lasts = [], [], [], []
            for d, hashes, sizes in zip(batch.column("doc_id").to_pylist(), batch.column("hashes").to_pylist(), batch.column("sizes").to_pylist(), strict=True):
                data = np.array(hashes, np.int64).tobytes()
                for a, b in runs_of(sizes, block_words):
                    ids.append(d)
                    runs.append(xxh3_64_intdigest(data[8 * a : 8 * b + 8]))
                    firsts.append(a)
                    lasts.append(b)
            columns = [pa.array(ids, pa.int64()), pa.array(np.array(runs, np.uint64).view(np.int64)), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "run", "a", "b"])

    return originals.select("doc_id", "hashes", "sizes").mapInArrow(run, "doc_id long, run long, a int, b int")


def align(docs: DataFrame, rare: int = 8, block_words: int = 20) -> DataFrame:
    """docs with lines (array), deleted (places of deleted lines, ascending, from 0) and text without those lines."""
    split = only(docs, "doc_id", "text").filter("doc_id is not null").withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    one = split.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"), F.transform("lines", lambda x: F.size(words(x))).alias("sizes"))
    known = checkpointed(one.groupBy("doc_id").agg(F.min_by(F.struct("digest", "hashes", "sizes"), "digest").alias("d")).select("doc_id", "d.*"))
    repeated = checkpointed(known.groupBy("digest").agg(F.min("doc_id").alias("original"), F.count("*").alias("n")).filter("n > 1").select("digest", "original"))
    total = F.aggregate("sizes", F.lit(0), lambda s, n: s + n)
    copies = checkpointed(known.join(small(repeated), "digest").filter("doc_id <> original").select("doc_id", F.size("sizes").alias("lines"), total.alias("n")))
    originals = checkpointed(known.join(small(copies.select("doc_id")), "doc_id", "left_anti").select("doc_id", "hashes", "sizes"))
    copies = copies.filter(f"n >= {block_words}").select("doc_id", F.sequence(F.lit(0), F.col("lines") - 1).alias("gone"))
    later = originals.select(F.col("doc_id").alias("later"), F.col("hashes").alias("later_hashes"), F.col("sizes").alias("later_sizes"))
    earlier = originals.select(F.col("doc_id").alias("earlier"), F.col("hashes").alias("earlier_hashes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("later", "earlier_hashes", "later_hashes", "later_sizes"))
            found = [(d, deleted_lines(e, x, s, block_words)) for d, e, x, s in zip(*columns, strict=True)]
            found = [(d, gone) for d, gone in found if gone]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([g for _, g in found], pa.list_(pa.int32()))], ["doc_id", "gone"])

    def uncovered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"doc_id": [], "run": [], "a": [], "b": []}
            for d, runs, gone in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "runs", "gone")), strict=True):
                deleted = set(gone or ())
                for r in runs:
                    if not deleted.issuperset(range(r["a"], r["b"] + 1)):
                        for name, value in (("doc_id", d), ("run", r["run"]), ("a", r["a"]), ("b", r["b"])):
                            out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["run"], pa.int64()), pa.array(out["a"], pa.int32()), pa.array(out["b"], pa.int32())], list(out))

    def lines_gone(pairs: DataFrame) -> DataFrame:
        both = pairs.join(earlier, "earlier").join(later, "later").select("later", "earlier_hashes", "later_hashes", "later_sizes")
        return both.mapInArrow(run, "doc_id long, gone array<int>").select("doc_id", F.explode("gone").alias("i"))

    def grouped(found: DataFrame) -> DataFrame:
        return checkpointed(found.distinct().groupBy("doc_id").agg(F.sort_array(F.collect_list("i")).alias("gone")))

    all_runs = document_runs(originals, block_words)
    shared = all_runs.groupBy("run").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("run", "first")
    held = checkpointed(all_runs.join(shared, "run"))
    aligned = grouped(lines_gone(held.filter("doc_id > first").select(F.col("doc_id").alias("later"), F.col("first").alias("earlier")).distinct()))
    # Runs that the first holder's alignment leaves, as where blocks come in another order; upto: holders tried.
    left, upto, more = held.filter("doc_id > first"), 1, max(1, rare)
    ranked = None
    while True:
        by_doc = left.groupBy("doc_id").agg(F.collect_list(F.struct("run", "a", "b")).alias("runs")).join(aligned, "doc_id", "left")
        left = checkpointed(by_doc.select("doc_id", "runs", "gone").mapInArrow(uncovered, "doc_id long, run long, a int, b int"))
        if ranked is None:
            by = Window.partitionBy("run").orderBy("doc_id")
            ranked = checkpointed(held.join(left.select("run").distinct(), "run", "left_semi").select("run", "doc_id").distinct().select("run", F.col("doc_id").alias("earlier"), F.row_number().over(by).alias("rank")))
        reach = left.join(ranked.filter(f"rank > {upto} and rank <= {upto + more}"), "run").filter("earlier < doc_id")
        pairs = checkpointed(reach.select(F.col("doc_id").alias("later"), "earlier").distinct())
        if pairs.isEmpty():
            break
        aligned = grouped(aligned.select("doc_id", F.explode("gone").alias("i")).unionByName(lines_gone(pairs)))
        upto, more = upto + more, 2 * more
    gone = checkpointed(copies.unionByName(aligned).join(known.select("doc_id", "digest"), "doc_id")).withColumnsRenamed({"doc_id": "of_doc", "digest": "of_digest"})
    # The row travels as one struct, so its columns can't clash with the operator's own.
    same = (F.col("row.doc_id") == F.col("of_doc")) & (F.sha2(F.coalesce("row.text", F.lit("")), 256) == F.col("of_digest"))
    lined = packed(docs).join(gone, same, "left").select("row", F.coalesce("gone", F.array().cast("array<int>")).alias("deleted"), F.split("row.text", "\n").alias("all_lines"))
    stays = F.array_except(F.sequence(F.lit(0), F.size("all_lines") - 1), "deleted")
    kept = F.array_join(F.transform(stays, lambda i: F.get("all_lines", i)), "\n")
    text = F.when(F.size("deleted") > 0, kept).otherwise(F.col("row.text"))
    own = [(text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c not in ("deleted", "n_lines")]
    return lined.select(*own, "deleted", F.when(F.col("row.text").isNull(), 0).otherwise(F.size("all_lines")).cast("long").alias("n_lines"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("deleted").cast("long").alias("n_deleted"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
