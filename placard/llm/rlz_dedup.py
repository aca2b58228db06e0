"""Duplicate passages, found by relative Lempel-Ziv parsing.

Documents in doc_id order are cut into reference blocks, bounded in rows and
bytes. A document is factored greedily against the blocks before its own, and
within its own against smaller doc_ids: a factor is a place in the document, a
length, and a place in a reference document from which the same words go on;
of the references that can go on from a place the longest counts, and the next
factor begins where it ends. A factor of ``phrase`` words or more is a
duplicate span. Windows of ``phrase`` words that cross the end of a factor are
checked too, since a passage may go on in another block. So the spans cover
just the words of windows that also start in a smaller doc_id.

How it runs, as shuffles between blocks:

1. Each block hashes its windows, keeps each hash once (so a window in a third
   of all documents costs one entry a block) and sends the sorted hashes, split
   by range into cells, as delta-coded bytes.
2. Each cell finds the first block of each hash.
3. The answers meet the texts again. A stretch of windows that all have an
   earlier block is sent, as words, to each of these blocks; the same stretch
   of many documents is sent once. Matches within the own block are made here.
4. A block compares each stretch with its own texts, word by word, from the
   first place of its windows on, as far as both go on alike. Blocks that are
   asked for much (``BUSY`` bytes) are dealt out to several tasks.
5. The matches go back to the documents, which choose their factors.

Edge cases: a null or empty text has no words; fewer words than a phrase lose
none; equal doc_ids never make each other duplicates, nor does a row repeat
itself; a row without doc_id neither loses words nor serves as reference; an
empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placard.llm.common import checkpointed, only, small, staged, table

_BASE = 0x9E3779B97F4A7C15
#: Bytes of texts in a block, and of stretches that one task compares with it.
BLOCK_BYTES, BUSY = 48 << 20, 64 << 20


def split_words(text: str | None) -> list[bytes]:
    """The text's words; bytes.split cuts at just the six ASCII white-space characters."""
    return (text or "").encode("utf-8", "replace").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def phrase_hashes(each: np.ndarray, phrase: int) -> np.ndarray:
    """A 64-bit hash of each window of ``phrase`` words, from the words' hashes."""
    n = len(each) - phrase + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, base = np.zeros(n, np.uint64), np.uint64(_BASE)
    with np.errstate(over="ignore"):
        for i in range(phrase):
            out = out * base + each[i : i + n]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def _pack(values: np.ndarray) -> bytes:
    """Sorted numbers as compressed deltas, one byte plane after the other."""
    import zstandard

    deltas = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(deltas.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def _unpack(data: bytes, kind: type) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(kind).ravel(), dtype=kind)


class Block:
    """The texts of one block in order of (doc_id, text)."""

    def __init__(self, rows: pa.Table, phrase: int):
        order = pc.sort_indices(rows.select(["doc_id", "text"]), sort_keys=[("doc_id", "ascending"), ("text", "ascending")])
        rows = rows.take(order)
        self.phrase, self.doc_ids, self.texts = phrase, rows.column("doc_id").to_numpy(), rows.column("text")
        self.split = functools.lru_cache(64)(lambda i: split_words(self.texts[i].as_py()))

    def hashed(self) -> "Block":
        """Adds the words' hashes and the distinct windows with their first places; words themselves aren't kept."""
        each = [word_hashes(split_words(self.texts[i].as_py())) for i in range(len(self.texts))]
        windows = [phrase_hashes(e, self.phrase) for e in each]
        self.words = np.concatenate([*each, np.zeros(0, np.uint64)])
        self.ends = np.cumsum([len(e) for e in each], dtype=np.int64)
        self.counts = np.array([len(w) for w in windows], np.int64)
        place = np.concatenate([*[end - len(e) + np.arange(len(w)) for e, w, end in zip(each, windows, self.ends.tolist(), strict=True)], np.zeros(0, np.int64)]).astype(np.int64)
        self.hashes, first, self.inverse = np.unique(np.concatenate([*windows, np.zeros(0, np.uint64)]), return_index=True, return_inverse=True)
        self.first = place[first]
        return self

    def cells(self, cells: int) -> np.ndarray:
        """Where each cell's hashes begin; cells are equal ranges of the hash."""
        edges = [(c << 64) // cells for c in range(1, cells)]
        return np.concatenate(([0], np.searchsorted(self.hashes, np.array(edges, np.uint64)), [len(self.hashes)])).astype(np.int64)

    def matches(self, each: np.ndarray, words: list[bytes], places: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(start, words, row, offset) of the matches that cover all windows with a place: from the first one's place as far as words are alike, then from the first window that isn't inside.

        each, words: a stretch's words, hashed and plain; places: the place in
        this block where each of its windows first stands, -1 where it doesn't.
        """
        out, found = [], np.nonzero(places >= 0)[0]
        at = 0
        while at < len(found):
            i, p = int(found[at]), int(places[found[at]])
            row = int(np.searchsorted(self.ends, p, side="right"))
            begin = int(self.ends[row - 1]) if row else 0
            n = min(len(words) - i, int(self.ends[row]) - p)
            differ = np.nonzero(each[i : i + n] != self.words[p : p + n])[0]
            n = int(differ[0]) if len(differ) else n
            own = self.split(row)[p - begin : p - begin + n]
            while own[:n] != words[i : i + n]:  # hashes alike, words not
                n -= 1
            if n >= self.phrase:
                out.append((i, n, row, p - begin))
            at = int(np.searchsorted(found, max(i + 1, i + n - self.phrase + 1)))
        return out


def block_edges(docs: DataFrame, rows_per_block: int | None) -> list[int]:
    """The least doc_id of each block but the first.

    Blocks grow with the square root of the corpus, from 2048 to 65536 rows,
    so that neither they nor their number outgrow a task or the driver, and end
    sooner where their texts have ``BLOCK_BYTES``: they are put together from
    about 16 times as many ranges, whose rows and bytes are counted.
    """
    rows = docs.count()
    size = rows_per_block or min(1 << 16, max(2048, int(4 * rows**0.5)))
    ranges = -(-16 * rows // size)
    if ranges < 2:
        return []
    cuts = sorted(set(docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0]))
    counted = docs.groupBy(_range_of(cuts)("doc_id").alias("at")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")).orderBy("at").collect()
    edges, n, total = [], 0, 0
    for r in counted:
        if n and (n + r.n > size or total + r.size > BLOCK_BYTES):
            edges.append(cuts[r["at"] - 1])
            n = total = 0
        n, total = n + r.n, total + r.size
    return edges


def _range_of(edges: list[int]):
    at = np.array(edges, np.int64)

    @F.pandas_udf("int")
    def run(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, doc_id.to_numpy(np.int64), side="right").astype(np.int32))

    return run


def stretches(sources: np.ndarray, phrase: int) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """(first word, words, what to ask) of the longest stretches of windows that have an earlier block; sources: each window's first block, -1 where it has none.

    What to ask: (block, first word, words). A block gets the whole stretch,
    or where there are more than four of them what its own windows cover.
    """
    out, edges = [], np.concatenate(([0], np.nonzero(np.diff(sources >= 0))[0] + 1, [len(sources)]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b > a and sources[a] >= 0:
            blocks = np.unique(sources[a:b]).tolist()
            whole = (a, b - a + phrase - 1)
            if len(blocks) <= 4:
                asks = [(t, *whole) for t in blocks]
            else:
                own = {t: np.nonzero(sources[a:b] == t)[0] for t in blocks}
                asks = [(t, a + int(w[0]), int(w[-1] - w[0]) + phrase) for t, w in own.items()]
            out.append((*whole, asks))
    return out


def chosen(matches: list[tuple], phrase: int) -> list[tuple]:
    """Greedy factors (start, words, block, doc_id, offset) from matches of the same form: from each place on the one that reaches farthest, and the next from its end."""
    left, out, at = sorted(matches), [], 0
    i, going = 0, []
    while True:
        while i < len(left) and left[i][0] <= at:
            going.append(left[i])
            i += 1
        going = [m for m in going if m[0] + m[1] - at >= phrase]
        if going:
            best = max(going, key=lambda m: (m[0] + m[1], -m[2], -m[3]))
            skip = at - best[0]
            out.append((at, best[1] - skip, best[2], best[3], best[4] + skip))
            at = best[0] + best[1]
        elif i < len(left):
            at = max(at, left[i][0])
        else:
            return out


MATCH = "struct<start:int,words:int,block:int,doc_id:long,offset:long>"
MATCHES = pa.list_(pa.struct([("start", pa.int32()), ("words", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("offset", pa.int64())]))
RESULT = f"doc_id long, n_words long, n_removed long, spans array<{MATCH}>, kept string"


def _named(found: list[tuple], block: int, doc_ids: np.ndarray, shift: int = 0) -> list[dict]:
    return [{"start": i + shift, "words": n, "block": block, "doc_id": int(doc_ids[row]), "offset": p} for i, n, row, p in found]


def duplicate_spans(docs: DataFrame, phrase: int = 13, rows_per_block: int | None = None, busy: int = BUSY) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, n_words, n_removed, spans, kept.

    spans: the factors, an array of (start, words, block, doc_id, offset), the
    last two a place in the reference; kept: the words outside all matches,
    joined by one space.
    """
    docs = only(docs, "doc_id", "text")
    known = docs.filter("doc_id is not null")
    edges = block_edges(known, rows_per_block)
    cells = max(8, len(edges) + 1)
    blocks = known.withColumn("block", _range_of(edges)("doc_id"))

    def index(key: tuple, rows: pa.Table) -> pa.Table:
        own = Block(rows, phrase).hashed()
        cuts = own.cells(cells)
        full = [c for c in range(cells) if cuts[c] < cuts[c + 1]]
        return pa.table({"cell": pa.array(full, pa.int32()), "block": pa.array([key[0].as_py()] * len(full), pa.int32()), "entries": pa.array([_pack(own.hashes[cuts[c] : cuts[c + 1]]) for c in full], pa.binary())})

    def resolve(rows: pa.Table) -> pa.Table:
        order = np.argsort(rows.column("block").to_numpy(), kind="stable")
        block = rows.column("block").to_numpy()[order]
        lists = [_unpack(rows.column("entries")[int(i)].as_py(), np.uint64) for i in order]
        sizes = np.array([len(x) for x in lists])
        hashes, of = np.concatenate(lists), np.repeat(block, sizes)
        by_hash = np.argsort(hashes, kind="stable")  # blocks stay in order within a hash
        ranked = hashes[by_hash]
        lead = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        first = of[by_hash[np.nonzero(lead)[0]]][np.cumsum(lead) - 1]
        source = np.empty(len(hashes), np.int32)
        source[by_hash] = np.where(first < of[by_hash], first, -1)
        cell = rows.column("cell")[0].as_py()
        answers = np.split(source, np.cumsum(sizes)[:-1])
        kept = [i for i, a in enumerate(answers) if (a >= 0).any()]
        return pa.table({"block": pa.array(block[kept], pa.int32()), "cell": pa.array([cell] * len(kept), pa.int32()), "sources": pa.array([_pack(answers[i]) for i in kept], pa.binary())})

    def ask(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        """Stretches to be compared (target, digest, stretch; null where the matches are known) for rows of the block."""
        from xxhash import xxh3_128_digest

        out: dict[str, list] = {c: [] for c in ASKED.names}
        if rows.num_rows:
            block, own = key[0].as_py(), Block(rows, phrase).hashed()
            cuts = own.cells(cells)
            source = np.full(len(own.hashes), -1, np.int32)
            for cell, data in zip(answers.column("cell").to_pylist(), answers.column("sources").to_pylist(), strict=True):
                source[cuts[cell] : cuts[cell + 1]] = _unpack(data, np.int32)
            window_ends = np.cumsum(own.counts)

            def add(row: int, start: int, target: int | None, words: list[bytes], matches: list[dict]) -> None:
                stretch = None if target is None else b" ".join(words)
                for c, v in zip(ASKED.names, (block, row, start, target, stretch and xxh3_128_digest(stretch), stretch, matches), strict=True):
                    out[c].append(v)

            for row, (end, n) in enumerate(zip(window_ends.tolist(), own.counts.tolist(), strict=True)):
                which = own.inverse[end - n : end]
                here, begin = source[which], int(own.ends[row - 1]) if row else 0
                places = own.first[which]
                # Within the block: windows without an earlier block that stand first in a smaller doc_id.
                local = (here < 0) & (own.doc_ids[np.searchsorted(own.ends, places, side="right")] < own.doc_ids[row])
                if not (local.any() or (here >= 0).any()):
                    continue
                words = own.split(row)
                if local.any():
                    found = own.matches(own.words[begin : begin + len(words)], words, np.where(local, places, -1))
                    add(row, 0, None, [], _named(found, block, own.doc_ids))
                for _, _, asks in stretches(here, phrase):
                    for target, first, size in asks:
                        add(row, first, target, words[first : first + size], [])
        return pa.table([pa.array(out[f.name], f.type) for f in ASKED], schema=ASKED)

    def compare(key: tuple, asked: pa.Table, rows: pa.Table) -> pa.Table:
        """The matches of stretches with this block."""
        out = []
        if asked.num_rows and rows.num_rows:
            own = Block(rows, phrase).hashed()
            for stretch in asked.column("stretch").to_pylist():
                words = stretch.split(b" ")
                each = word_hashes(words)
                windows = phrase_hashes(each, phrase)
                at = np.minimum(np.searchsorted(own.hashes, windows), len(own.hashes) - 1)
                out.append(_named(own.matches(each, words, np.where(own.hashes[at] == windows, own.first[at], -1)), key[0].as_py(), own.doc_ids))
        else:
            asked = asked.slice(0, 0)
        return pa.table({"target": asked.column("target"), "digest": asked.column("digest"), "found": pa.array(out, MATCHES)})

    def parse(key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[dict] = []
        if rows.num_rows:
            own = Block(rows, phrase)
            found: dict[int, list[tuple]] = {}
            for row, start, matches in zip(*(answers.column(c).to_pylist() for c in ("row", "start", "matches")), strict=True):
                found.setdefault(row, []).extend((m["start"] + start, m["words"], m["block"], m["doc_id"], m["offset"]) for m in matches)
            for row, doc_id in enumerate(own.doc_ids.tolist()):
                words, matches = split_words(own.texts[row].as_py()), found.get(row, [])
                kept = words
                if matches:
                    stays = np.ones(len(words), bool)
                    for m in matches:
                        stays[m[0] : m[0] + m[1]] = False
                    kept = [words[i] for i in np.nonzero(stays)[0].tolist()]
                factors = [dict(zip(("start", "words", "block", "doc_id", "offset"), f, strict=True)) for f in chosen(matches, phrase)]
                out.append({"doc_id": doc_id, "n_words": len(words), "n_removed": len(words) - len(kept), "spans": factors, "kept": b" ".join(kept).decode()})
        return pa.Table.from_pylist(out, SCHEMA)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = [split_words(t) for t in batch.slice(at, 256).column("text").to_pylist()]
                yield pa.RecordBatch.from_pylist([{"doc_id": None, "n_words": len(w), "n_removed": 0, "spans": [], "kept": b" ".join(w).decode()} for w in texts], SCHEMA)

    SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", MATCHES), ("kept", pa.string())])
    ASKED = pa.schema([("block", pa.int32()), ("row", pa.int32()), ("start", pa.int32()), ("target", pa.int32()), ("digest", pa.binary()), ("stretch", pa.binary()), ("matches", MATCHES)])
    # All passes over texts group the very same rows, so Spark deals the texts out once and reads that shuffle again.
    entries = blocks.groupBy("block").applyInArrow(index, "cell int, block int, entries binary")
    answers = entries.groupBy("cell").applyInArrow(resolve, "block int, cell int, sources binary")
    asked = staged(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask, f"block int, row int, start int, target int, digest binary, stretch binary, matches array<{MATCH}>"))
    once = asked.filter("target is not null").groupBy("target", "digest").agg(F.first("stretch").alias("stretch"))
    loads = asked.filter("target is not null").select("target", "digest", F.length("stretch").alias("n")).distinct().groupBy("target").agg(F.sum("n").alias("n"))
    hot = checkpointed(loads.filter(f"n > {busy}").select("target", F.ceil(F.col("n") / busy).cast("int").alias("parts")))
    named = f"target int, digest binary, found array<{MATCH}>"
    found = once.join(small(hot), "target", "left_anti").groupBy("target").cogroup(blocks.groupBy("block")).applyInArrow(compare, named)
    if not hot.isEmpty():
        dealt = once.join(small(hot), "target").withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int"))
        copies = blocks.join(small(hot.withColumnRenamed("target", "block")), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        more = dealt.select("target", "part", "digest", "stretch").groupBy("target", "part").cogroup(copies.select("block", "part", "doc_id", "text").groupBy("block", "part")).applyInArrow(compare, named)
        found = found.unionByName(more)
    matched = asked.filter("target is not null").select("block", "row", "start", "target", "digest").join(found, ["target", "digest"]).select("block", "row", "start", F.col("found").alias("matches"))
    matched = matched.unionByName(asked.filter("target is null").select("block", "row", "start", "matches"))
    result = blocks.groupBy("block").cogroup(matched.groupBy("block")).applyInArrow(parse, RESULT)
    return result.unionByName(docs.filter("doc_id is null").mapInArrow(alone, RESULT))


def op6_rlz(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicate_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_factors"))
