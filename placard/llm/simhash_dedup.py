"""SimHash near-duplicates, found with vantage-point trees.

Fingerprints are 64-bit SimHashes. Two of them are linked when they differ in
at most ``threshold`` bits, and a document's class is the connected component
of its fingerprint.

The search is a forest of vantage-point trees. One tree over all 64 bits
can't prune here: distances between unrelated fingerprints lie within a few
bits of 32, so a ball of radius 4 crosses nearly every boundary. Instead the
bits are cut into blocks, and each tree measures Hamming distance on a choice
of blocks only. Such a distance never exceeds the whole one, so the triangle
bounds hold, and by the pigeonhole principle every pair within the threshold
is within a smaller radius in at least one tree. A fingerprint lives in one
leaf of each tree, and is also sent as a query to every leaf whose region its
ball crosses. Within a leaf, pairs are checked exactly on all 64 bits.

How many leaves a ball of positive radius crosses is measured on a sample for
the cuts of few blocks (``cut_costs``); for cuts of more blocks than bits may
differ the radius is 0. Such a tree would grow until all points of a leaf
agree on its bits, so these bits name the leaf. The cheapest cut is taken.

Leaves that hold too many points are compared in blocks, each pair of blocks
by a task of its own. A task returns a spanning forest of the links it finds,
not all pairs, so a group of n near copies costs n - 1 rows.

Edge cases: a null or empty text has fingerprint zero and is linked like any
other; fewer words than a shingle count as one shingle; repeated rows and
equal doc_ids share a class; a row without doc_id links nothing, and gets the
class of the documents with its very fingerprint, else null; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placard.llm.common import checkpointed, drops_shuffles, only, release, small, staged, sweep

BITS = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The SimHash of one text: a bit is 1 if set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    cuts = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in cuts), np.uint64, len(words) - shingle + 1)
    set_bits = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 1 << 16):  # bounds the unpacked bits of a very long text
        piece = hashes[part : part + (1 << 16)].astype("<u8")
        set_bits += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    on = np.packbits(2 * set_bits > len(hashes), bitorder="little")
    return int(on.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): every row's SimHash as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, shingle) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


class VantageTree:
    """A vantage-point tree's inner nodes over the bits of ``mask``.

    Node i has children 2i + 1 (distance at most the radius) and 2i + 2. The
    sample only places vantage points and radii; any fingerprint can be routed.
    """

    def __init__(self, sample: np.ndarray, mask: int, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.mask, self.depth = np.uint64(mask), depth
        nodes = (1 << depth) - 1
        bits = bin(mask).count("1")
        self.vantage = rng.integers(0, 1 << 64, nodes, dtype=np.uint64) & self.mask
        self.radius = np.full(nodes, bits // 2, np.int64)
        members = {0: sample & self.mask}
        for i in range(nodes):
            own = members.pop(i, sample[:0])
            if len(own) >= 4:
                choice = own[rng.integers(0, len(own), 8)]
                spread = [int(np.bitwise_count(own ^ v).var() * 1000) for v in choice]
                self.vantage[i] = choice[int(np.argmax(spread))]
                self.radius[i] = int(np.median(np.bitwise_count(own ^ self.vantage[i])))
            if len(own):
                near = np.bitwise_count(own ^ self.vantage[i]) <= self.radius[i]
                members[2 * i + 1], members[2 * i + 2] = own[near], own[~near]

    def home(self, fps: np.ndarray) -> np.ndarray:
        """The leaf in which each fingerprint lives."""
        at = np.zeros(len(fps), np.int64)
        for _ in range(self.depth):
            distance = np.bitwise_count((fps & self.mask) ^ self.vantage[at])
            at = 2 * at + 1 + (distance > self.radius[at])
        return at

    def overlapping(self, fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(index, leaf) of every leaf that a ball of this reach crosses.

        By the triangle inequality the inner side can hold a point within
        reach only if distance - reach <= radius, the outer side only if
        distance + reach > radius; other branches are pruned.
        """
        who, at = np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for _ in range(self.depth):
            distance = np.bitwise_count((fps[who] & self.mask) ^ self.vantage[at]).astype(np.int64)
            inner, outer = distance - reach <= self.radius[at], distance + reach > self.radius[at]
            who, at = np.concatenate((who[inner], who[outer])), np.concatenate((2 * at[inner] + 1, 2 * at[outer] + 2))
        return who, at


def sub_metrics(threshold: int, blocks: int) -> list[tuple[int, int]]:
    """(mask, reach) of each tree, such that every pair within the threshold is within reach in one of them."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in itertools.pairwise(edges)]
    if blocks <= threshold:
        return [(m, threshold // blocks) for m in masks]
    return [(sum(c), 0) for c in itertools.combinations(masks, blocks - threshold)]


def _trees(sample: np.ndarray, total: int, threshold: int, blocks: int, leaf_size: int) -> list[tuple[int, int, VantageTree | None]]:
    """(mask, reach, tree) of a cut; the tree is None where the mask's bits name the leaf."""
    out = []
    for n, (mask, reach) in enumerate(sub_metrics(threshold, blocks)):
        depth = min(16, bin(mask).count("1"), max(0, math.ceil(math.log2(max(1, total) / leaf_size))))
        out.append((mask, reach, VantageTree(sample, mask, depth, seed=n) if reach else None))
    return out


def cut_costs(sample: np.ndarray, total: int, threshold: int = 4, leaf_size: int = 64, cuts: tuple[int, ...] = (2, 3, 4, 5, 6, 7, 8)) -> dict[int, tuple[float, float]]:
    """For each number of blocks: rows sent to leaves, and comparisons there, for each fingerprint.

    Measured by ball queries of the sample where the radius is positive, else
    counted from the number of trees and of values that their bits can have.
    """
    out = {}
    for blocks in cuts:
        rows = pairs = 0.0
        for mask, reach, tree in _trees(sample, total, threshold, blocks, leaf_size):
            if tree is None:
                rows, pairs = rows + 1, pairs + total / 2 ** bin(mask).count("1")
            elif len(sample):
                lives = np.bincount(tree.home(sample)) / len(sample)
                _, leaf = tree.overlapping(sample, reach)
                rows, pairs = rows + len(leaf) / len(sample), pairs + total * float(lives[leaf[leaf < len(lives)]].sum()) / len(sample)
        out[blocks] = (rows, pairs)
    return out


def cheapest_cut(sample: np.ndarray, total: int, threshold: int = 4, leaf_size: int = 64, row_cost: float = 100.0) -> int:
    """The number of blocks whose rows and comparisons cost least; a row costs as much as ``row_cost`` comparisons."""
    costs = cut_costs(sample, total, threshold, leaf_size, tuple(range(max(1, threshold - 1), threshold + 5)))
    return min(costs, key=lambda b: row_cost * costs[b][0] + costs[b][1])


def _forest(fps: np.ndarray, near: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Links (positions) that connect what lies within the threshold: a spanning forest of fps x near."""
    label, links = np.arange(len(fps)), []
    for i in near.tolist():
        found = np.nonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= threshold)[0] + i + 1
        while len(found := found[label[found] != label[i]]):
            links.append((i, int(found[0])))
            label[label == label[found[0]]] = label[i]
    return links


def fingerprint_links(nodes: DataFrame, threshold: int = 4, blocks: int | None = None, leaf_size: int = 64, sample_size: int = 8192, block_rows: int = 20_000) -> DataFrame:
    """(a, b): links between node ids that keep all fingerprints within the threshold connected.

    nodes: (node, fp), one row per distinct fingerprint. ``sample_size``
    fingerprints, those of least hash, place the vantage points and measure
    the cuts; every fingerprint is indexed. ``blocks`` is the cut of the 64
    bits, always exact; None takes the cheapest.
    """
    spark = nodes.sparkSession
    total = nodes.count()
    sample = np.array([r.fp for r in nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample_size).collect()], np.int64).view(np.uint64)
    trees = _trees(sample, total, threshold, blocks or cheapest_cut(sample, total, threshold, leaf_size), leaf_size)
    shared = spark.sparkContext.broadcast(trees)  # at most 2^16 nodes a tree

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            node = batch.column("node").to_numpy(zero_copy_only=False)
            for n, (mask, reach, tree) in enumerate(shared.value):
                home = (fps & np.uint64(mask)).view(np.int64) if tree is None else tree.home(fps)
                who, leaf = (np.arange(len(fps)), home) if tree is None else tree.overlapping(fps, reach)
                out = [np.full(len(who), n, np.int32), leaf, leaf == home[who], node[who], fps[who].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["tree", "leaf", "lives", "node", "fp"])

    routed = nodes.select("node", "fp").mapInArrow(route, "tree int, leaf long, lives boolean, node long, fp long")
    # A crowded leaf is cut into k parts; each pair of parts meets in a task of its own.
    crowded = routed.groupBy("tree", "leaf").count().filter(F.col("count") > block_rows).select("tree", "leaf", F.ceil(F.col("count") / block_rows).alias("k"))
    part = F.pmod(F.xxhash64("node"), F.coalesce("k", F.lit(1)))
    placed = routed.join(crowded, ["tree", "leaf"], "left").withColumn("part", part).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))
    )
    grouped = placed.select("tree", "leaf", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "lives", "node", "fp")
    tasks = grouped.withColumn("cell", F.xxhash64("tree", "leaf", "p", "q")).select("cell", "lives", "node", "fp")

    def search(rows: pa.Table) -> pa.Table:
        fps, node = rows.column("fp").to_numpy().view(np.uint64), rows.column("node").to_numpy()
        lives = rows.column("lives").to_numpy(zero_copy_only=False)
        order = np.lexsort((node, fps, ~lives))  # points first, then what only asks
        fps, node, lives = fps[order], node[order], lives[order]
        links = _forest(fps, np.nonzero(lives)[0], threshold)
        a, b = np.array([x for x, _ in links], np.int64), np.array([y for _, y in links], np.int64)
        return pa.table({"a": pa.array(node[a], pa.int64()), "b": pa.array(node[b], pa.int64())})

    return tasks.groupBy("cell").applyInArrow(search, "a long, b long").filter("a <> b")


def components(links: DataFrame, sweeps: bool = False) -> DataFrame:
    """(node, component): the least node reachable, for every node that reaches a lesser one.

    Alternates large-star and small-star steps until the links are stars; each
    step is a map-side combined minimum and a join, written to the shared
    folder. Only two counters reach the driver.
    """
    links = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        links = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        if sweeps:
            sweep(links.sparkSession)
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == seen:
            return links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        seen = (now.n, now.h)


def simhash_components(docs: DataFrame, shingle: int = 4, threshold: int = 4, blocks: int | None = None, **search: int) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs (doc_id, text)."""
    marked = checkpointed(fingerprints(docs, shingle))
    nodes = checkpointed(marked.groupBy("fp").agg(F.min("doc_id").alias("node")).filter("node is not null"))
    found = components(fingerprint_links(nodes, threshold, blocks, **search))
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(named, "fp", "left").select("doc_id", "fp", "component_id")


WIDE = 4


def vantage_blocks(bits: np.ndarray, reach: np.ndarray, queries: np.ndarray, points: np.ndarray, most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaves of a vantage-point tree over points, each with the queries whose balls cross it: (queries, points), as positions in bits.

    Every point within a query's reach (bits that may differ) is in a leaf that
    the query is sent to. A node's radius lies in the widest gap between the
    distances from its vantage point, so a group of near copies is parted from
    what is unlike it. A node that would save less than a tenth of its
    comparisons is a leaf, and so is one of at most ``most`` of them.
    """
    stack = [(queries, points)]
    while stack:
        asks, has = stack.pop()
        if not len(asks) or not len(has):
            continue
        if len(asks) * len(has) > most:
            vantage = bits[has[len(has) // 2]]
            away, asked = (np.bitwise_count(bits[x] ^ vantage).sum(axis=1, dtype=np.int64) for x in (has, asks))
            steps = np.unique(away)
            if len(steps) > 1:
                at = int(np.argmax(np.diff(steps)))
                near = away <= steps[at]
                # By the triangle inequality; nothing lies between the two steps.
                sides = [(asks[asked - reach[asks] <= steps[at]], has[near]), (asks[asked + reach[asks] >= steps[at + 1]], has[~near])]
                if sum(len(a) * len(h) for a, h in sides) <= 0.9 * len(asks) * len(has):
                    stack += sides
                    continue
        yield asks, has


def _lowered(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def wide_fingerprint(words: list[bytes]) -> np.ndarray:
    """The 256-bit SimHash of a text's distinct words, as four 64-bit numbers."""
    from xxhash import xxh3_128_digest

    distinct = list(dict.fromkeys(words))
    if not distinct:
        return np.zeros(WIDE, np.uint64)
    counts = np.zeros(64 * WIDE, np.int64)
    for part in range(0, len(distinct), 1 << 12):
        digests = b"".join([xxh3_128_digest(w, 1) + xxh3_128_digest(w, 2) for w in distinct[part : part + (1 << 12)]])
        counts += np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8 * WIDE), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(distinct)).view("<u8").astype(np.uint64)


def shingle_similarity(a: list[bytes], b: list[bytes], shingle: int) -> float:
    """Jaccard similarity of two texts' shingles; fewer words than a shingle are one."""
    x, y = ({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} for w in (a, b))
    return len(x & y) / len(x | y)


def wide_links(nodes: DataFrame, threshold: int = 23, block_rows: int = 20_000) -> DataFrame:
    """(a, b): links of nodes (node, f0 to f3) within the threshold of 256 bits, at least a minimum spanning forest.

    If four words differ in ``threshold`` bits together, one of them differs in
    a quarter at most; each word is cut into blocks for that, and a choice of
    them names the leaf. Within a leaf, a vantage-point tree over all 256 bits
    finds who has a neighbour. A leaf's
    links come by distance, in steps of 4 bits, so two nodes are connected by
    links of their own step at most. The forest is of candidates: where one of
    them fails verification, a true link that it stands for is missing, and
    the search of ``near_copies`` over verified components finds it.
    """
    words = [f"f{i}" for i in range(WIDE)]
    total, each = nodes.count(), threshold // WIDE
    blocks = each + 1 + (total > 1 << 20) + (total > 1 << 27)  # more blocks: more bits agree, so leaves stay small
    masks = [(word, np.uint64(mask)) for word in range(WIDE) for mask, _ in sub_metrics(each, blocks)]

    def numbers(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
        return np.stack([np.asarray(rows.column(f)) for f in words], axis=1).view(np.uint64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = numbers(batch)
            for n, (word, mask) in enumerate(masks):
                leaf = ((fps[:, word] & mask) ^ np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), batch.column("node"), *[batch.column(f) for f in words]], ["leaf", "node", *words])

    fields = ", ".join(f"{f} long" for f in words)
    routed = nodes.select("node", *words).mapInArrow(route, f"leaf long, node long, {fields}")
    crowded = routed.groupBy("leaf").count().filter(F.col("count") > block_rows).select("leaf", F.ceil(F.col("count") / block_rows).alias("k"))
    parts = F.coalesce("k", F.lit(1))
    placed = routed.join(crowded, "leaf", "left").withColumn("part", F.pmod(F.xxhash64("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    tasks = placed.select(F.xxhash64("leaf", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), "node", *words)

    def search(rows: pa.Table) -> pa.Table:
        fps, node = numbers(rows), rows.column("node").to_numpy()
        order = np.argsort(node)
        fps, node = fps[order], node[order]
        label, links = np.arange(len(node)), []
        # Most nodes have no neighbour; those are set aside by a vantage-point tree of the leaf.
        everyone, close = np.arange(len(node)), np.zeros(len(node), bool)
        for asks, has in vantage_blocks(fps, np.full(len(node), threshold), everyone, everyone):
            step = max(1, (1 << 19) // len(has))
            for some in (asks[at : at + step] for at in range(0, len(asks), step)):
                distance = np.zeros((len(some), len(has)), np.uint16)
                for word in range(WIDE):
                    distance += np.bitwise_count(fps[some, word][:, None] ^ fps[has, word])
                close[some] |= ((distance <= threshold) & (has > some[:, None])).any(axis=1)
        rows_left = np.nonzero(close)[0]
        for limit in [*range(threshold % 4, threshold, 4), threshold]:  # closest first, in steps of 4 bits
            for i in rows_left.tolist():
                apart = np.nonzero(label[i + 1 :] != label[i])[0] + i + 1  # a dense group is soon one, and skipped
                if not len(apart):
                    continue
                distance = np.zeros(len(apart), np.uint16)
                for word in range(WIDE):
                    distance += np.bitwise_count(fps[apart, word] ^ fps[i, word])
                found = apart[distance <= limit]
                while len(found := found[label[found] != label[i]]):
                    links.append((i, int(found[0])))
                    label[label == label[found[0]]] = label[i]
        a, b = ([node[x[k]] for x in links] for k in (0, 1))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tasks.groupBy("cell").applyInArrow(search, "a long, b long").filter("a <> b").distinct()


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, ascending; a text without words has none."""
    from xxhash import xxh64_intdigest

    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(shingle, len(words))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + each[k : k + n]
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ out >> np.uint64(32))


BANDS, BAND_ROWS = 32, 4


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of MinHash values of a set of hashes.

    Two sets of Jaccard similarity s share the key of a band of 4 values with
    probability s^4, so at 0.8 and over they share none of 32 with less than 1e-7.
    """
    rng = np.random.default_rng(5)
    salt, odd = rng.integers(0, 1 << 64, (2, BANDS * BAND_ROWS), dtype=np.uint64)
    odd |= np.uint64(1)
    least = np.full(BANDS * BAND_ROWS, np.uint64((1 << 64) - 1))
    for at in range(0, len(hashes), 1 << 11):
        mixed = (hashes[at : at + (1 << 11), None] ^ salt) * odd
        np.minimum(least, (mixed ^ mixed >> np.uint64(31)).min(axis=0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for values in least.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ values) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    return keys


PARITY = 2048


def parity(hashes: np.ndarray) -> bytes:
    """``PARITY`` bits, each the parity of the hashes in its range: two sets differ in at least as many hashes as bits."""
    return np.packbits(np.bincount((hashes >> np.uint64(53)).astype(np.int64), minlength=PARITY).astype(np.uint8) & 1).tobytes()


def parity_pairs(bits: np.ndarray, size: np.ndarray, component: np.ndarray, queries: np.ndarray, points: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(i, j, compared): queries and points of different components whose sizes and parities allow the similarity, and how many parities were compared.

    Sets of sizes a and b that are as alike as ``least`` differ in at most
    (1 - least) / (1 + least) * (a + b) hashes, and b is at most a / least.
    """
    reach = np.floor(size * (1 - least) / least + 1e-9).astype(np.int64)
    out, compared = [], 0
    for asks, has in vantage_blocks(bits, reach, queries, points):
        step = max(1, (1 << 14) // len(has))
        for some in (asks[at : at + step] for at in range(0, len(asks), step)):
            a, b = size[some][:, None], size[has][None, :]
            i, j = np.nonzero((np.minimum(a, b) >= least * np.maximum(a, b) - 1e-9) & (component[some][:, None] != component[has]))
            i, j = some[i], has[j]
            compared += len(i)
            fits = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64) <= (1 - least) / (1 + least) * (size[i] + size[j]) + 1e-9
            out.append((i[fits], j[fits]))
    i, j = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
    return i, j, compared


def open_pairs(entries: DataFrame, found: DataFrame, facts: DataFrame, least: float, targets: int | None, whole: int = 32, block_rows: int = 2048) -> DataFrame:
    """(a, b): pairs of nodes of different components that share a key, and whose sizes and parities allow the similarity.

    entries: key, node; found: node, component; facts: node, size, parity. A
    key's nodes outside its largest component are paired with its nodes: with
    all of them where the key has at most ``whole``, else with about
    ``targets`` (None: all). A vantage-point tree over the key's parities finds
    them. Keys of few nodes share a task; one of over ``block_rows`` is cut
    into parts, and each pair of parts meets in a task of its own.
    """
    named = entries.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"))
    keys = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("components"), F.max_by("component", F.struct("n", "component")).alias("main")).filter("components > 1")
    asked = F.lit(True) if targets is None else F.expr(f"n <= {whole} or pmod(xxhash64(node), n) < {targets}")
    placed = named.join(keys.select("key", "n", "main"), "key").join(facts, "node").withColumn("asks", F.expr("component <> main")).withColumn("asked", asked).filter("asks or asked")
    parts = F.ceil(F.col("n") / block_rows)
    placed = placed.withColumn("part", F.when(parts > 1, F.pmod(F.xxhash64("node"), parts)).otherwise(F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    cell = F.when(F.col("n") <= whole, F.shiftright(F.xxhash64("key"), 52)).otherwise(F.xxhash64("key", low, high))
    tasks = placed.select(cell.alias("cell"), "key", (F.col("part") == low).alias("lower"), "node", "component", "asks", "asked", "size", "parity")

    def search(rows: pa.Table) -> pa.Table:
        key, node, component, size = (rows.column(c).to_numpy() for c in ("key", "node", "component", "size"))
        asks, asked, lower = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "asked", "lower"))
        bits = np.frombuffer(b"".join(rows.column("parity").to_pylist()), "<u8").reshape(len(node), -1)
        order = np.argsort(key, kind="stable")
        pairs = []
        for own in np.split(order, np.nonzero(np.diff(key[order]))[0] + 1):
            one, two = own[lower[own]], own[~lower[own]]
            for x, y in ((one, two), (two, one)) if len(two) else ((one, one),):
                i, j, _ = parity_pairs(bits, size, component, x[asks[x]], y[asked[y]], least)
                pairs.append(np.stack((np.minimum(node[i], node[j]), np.maximum(node[i], node[j]))))
        a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tasks.groupBy("cell").applyInArrow(search, "a long, b long").distinct()


@drops_shuffles
def near_copies(docs: DataFrame, shingle: int = 5, least: float = 0.8, threshold: int = 23, targets: tuple[int, ...] = (4, 64)) -> DataFrame:
    """(doc_id, component_id) for every row: classes of texts linked by a shingle similarity of at least ``least``.

    Two searches, and each candidate link is verified with the exact shingles
    of both texts. The first takes texts whose distinct words have 256-bit
    SimHashes within ``threshold`` bits; it joins most copies with changed
    words at little cost, whatever their number. The second completes the
    classes: texts that share a key of MinHash values are compared unless
    verified links join them already, as far as a vantage-point tree over the
    parities of their shingles doesn't rule them out. Keys of many texts are first compared
    with a few of these, then with more, and at last all that is still apart.

    A null text counts as empty, and texts without words are one class; rows
    that repeat a doc_id share the lesser of their classes' ids only if their
    texts are linked; a row without doc_id gets the class of the documents
    with its very words, else null.
    """

    texts = only(docs, "doc_id", "text")
    fields = [*[f"f{i}" for i in range(WIDE)], "size"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        release()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # few texts are cut into words at a time
                piece = batch.slice(at, 256)
                words = [_lowered(t) for t in piece.column("text").to_pylist()]
                digests = pa.array([xxh3_128_digest(b" ".join(w)) for w in words], pa.binary())
                hashes = [shingle_hashes(w, shingle) for w in words]
                numbers = np.array([np.concatenate((wide_fingerprint(w), [np.uint64(len(h))])) for w, h in zip(words, hashes, strict=True)], np.uint64).reshape(-1, len(fields)).view(np.int64)
                keys = pa.array([band_keys(h).view(np.int64) if len(h) else [] for h in hashes], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), digests, *[pa.array(np.ascontiguousarray(n)) for n in numbers.T], pa.array(map(parity, hashes), pa.binary()), keys], ["doc_id", "digest", *fields, "parity", "keys"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("a_text").to_pylist(), batch.column("b_text").to_pylist(), strict=True)
            alike = pa.array([shingle_similarity(_lowered(x), _lowered(y), shingle) >= least for x, y in pairs], pa.bool_())
            yield batch.select(["a", "b"]).filter(alike)

    def verified(links: DataFrame) -> DataFrame:
        ends = checkpointed(links.select(F.col("a").alias("doc_id")).union(links.select("b")).distinct())
        linked = staged(texts.join(small(ends), "doc_id", "left_semi"))
        both = links.join(linked.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")), "a").join(linked.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")), "b")
        done = checkpointed(both.select("a", "b", "a_text", "b_text").mapInArrow(compare, "a long, b long").distinct())
        sweep(done.sparkSession)
        return done

    known = staged(texts.mapInArrow(describe, f"doc_id long, digest binary, {', '.join(f'{c} long' for c in fields)}, parity binary, keys array<long>"))
    nodes = checkpointed(known.groupBy("digest").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in (*fields, "parity")]).filter("node is not null"))
    true = verified(checkpointed(wide_links(nodes, threshold)))
    found = components(true, sweeps=True)

    own = known.join(nodes.select("digest", "node"), "digest").filter("doc_id = node").select("node", F.explode("keys").alias("key")).distinct()
    entries, facts = checkpointed(own), nodes.select("node", "size", "parity")
    tried = None
    for some in (*targets, None):
        pairs = open_pairs(entries, found, facts, least, some)
        pairs = checkpointed(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        sweep(docs.sparkSession)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if not pairs.isEmpty():
            more = verified(pairs)
            if not more.isEmpty():
                true = true.unionByName(more)
                found = checkpointed(components(true, sweeps=True))
    named = nodes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    return known.select("doc_id", "digest").join(named, "digest", "left").select("doc_id", "component_id")


@drops_shuffles
def keep_one(docs: DataFrame, shingle: int = 5, least: float = 0.8, threshold: int = 23) -> DataFrame:
    """docs with one document of each class of near copies, that of the least doc_id.

    Rows that repeat the doc_id of a document that stays do stay, and so do
    rows without one, as neither can be told apart.
    """
    classes = near_copies(docs, shingle, least, threshold)
    dropped = classes.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("component_id")).alias("gone")).filter("gone").select("doc_id")
    return docs.join(small(checkpointed(dropped)), "doc_id", "left_anti").select(*[docs[f"`{c}`"] for c in docs.columns])


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    from placard.llm.common import table

    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
