"""A trie of conversations' prefixes: how many share each, and what sharing saves.

Conversations that begin with the same turns (role, text) share the nodes of
these turns. A node is named by a hash of its prefix: each turn's digest is
hashed together with its place, twice, to 64 bits, and a prefix has the exclusive
or of its turns' hashes, so prefixes come from running aggregates and a parent's
name from its child's without looking back.

* **Partial tries.** Each partition combines the nodes of its own conversations
  (members, least member) before anything is sent. What it sends is merged by
  hash of node and sender group, and the results by node: two rounds, so even the
  root, which every conversation shares, is a few rows for each task.
* **End lists** are sorted by ranges of node and conversation, packed into pieces
  of ``PACK`` ids there, and the pieces of a node are hashed in order. No list is
  held in memory.
* **Rollup.** The nodes with one least member are a path downward: its chain. Sums
  over a chain's lower part are running sums from its bottom up. All that hangs
  on a chain is credited, as one sum for each chain, to the nodes above the
  chain's top, which are prefixes of its own conversation; credits are merged as
  partial tries are. So the depth of the trie makes no rounds.

A conversation of any length is worked on in stretches, see ``common.running``.

Edge cases: turns are ordered by turn (null first), equal ones by the SHA-256 of
role and text, so ties and repeated rows have a fixed order and all count; null
roles and texts are empty; rows without conv_id belong to no conversation and
are left out; a conversation without turns is a member of the root alone; very
long texts are digested where they are read and not sent; an empty table gives
no node, not even a root; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placard.llm.common import only, ranked, running, small, staged, table

#: Rows of a conversation that one group holds, ids in a piece of an end list, sender groups of the first merge, children of a node that make it wide.
STRETCH, PACK, GROUPS, WIDE = 4096, 8192, 32, 4096
KEY = ["k1", "k2", "depth"]


def turn_digest(role: Column, text: Column) -> Column:
    """32 bytes that name a turn: the length of the role keeps role and text apart."""
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, said, chars) of conversations (conv_id, turn, role, text): each turn's rank, digest and length in code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    light = only(conversations, "conv_id", "turn", "role", "text").filter("conv_id is not null").select("conv_id", "turn", turn_digest(role, text).alias("said"), F.length(text).cast("long").alias("chars"))
    return ranked(light, "conv_id", F.col("turn").asc_nulls_first(), F.col("said")).drop("turn")


def paths(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, k1, k2, depth, p1, p2, chars, ends): each conversation's nodes from the root down.

    turns (conv_id, depth from 1 without gaps, said, chars) of the conversations ids (conv_id, length).
    """
    hashed = turns.select("conv_id", "depth", "chars", F.xxhash64("depth", "said").alias("h1"), F.xxhash64("said", "depth").alias("h2"))
    below = running(hashed, "conv_id", "depth", {"k1": "bit_xor(h1)", "k2": "bit_xor(h2)"}, STRETCH)
    # The end comes from the lengths, a conversation's row for each of its stretches.
    last = ids.select("conv_id", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / STRETCH))).alias("s"))
    below = below.withColumn("s", F.floor(F.col("depth") / STRETCH)).join(last, ["conv_id", "s"])
    below = below.selectExpr("conv_id", "k1", "k2", "depth", "k1 ^ h1 as p1", "k2 ^ h2 as p2", "chars", "depth = length as ends")
    root = ids.selectExpr("conv_id", "0L as k1", "0L as k2", "0L as depth", "cast(null as bigint) as p1", "cast(null as bigint) as p2", "0L as chars", "length = 0 as ends")
    return below.unionByName(root)


def merged(tables: DataFrame, sender: str, *sums: Column) -> DataFrame:
    """Rows of node tables combined by node: within partitions, then within groups of senders, then all. sums are aggregates named as what they combine."""
    grouped = tables.withColumn("g", F.pmod(F.xxhash64(sender), F.lit(GROUPS)))
    return grouped.groupBy(*KEY, "g").agg(*sums).groupBy(*KEY).agg(*sums)


def end_hashes(ends: DataFrame) -> DataFrame:
    """KEY and ends_sha256 of ends (KEY, conv_id): the SHA-256 of a node's ids, ascending and comma-joined."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []
        piece = lambda: pa.RecordBatch.from_pylist([dict(zip(KEY, node, strict=True)) | {"first": ids[0], "ids": ",".join(map(str, ids))}], PACKED)
        for batch in batches:
            for *key, conv_id in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != node or len(ids) == PACK:
                    if ids:
                        yield piece()
                    node, ids = key, []
                ids.append(conv_id)
        if ids:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, hashlib.sha256()
        row = lambda: pa.RecordBatch.from_pylist([dict(zip(KEY, node, strict=True)) | {"ends_sha256": sha.hexdigest()}], DIGEST)
        for batch in batches:
            for *key, ids in zip(*[batch.column(c).to_pylist() for c in (*KEY, "ids")], strict=True):
                if key != node:
                    if node is not None:
                        yield row()
                    node, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
        if node is not None:
            yield row()

    longs = [(c, pa.int64()) for c in KEY]
    PACKED, DIGEST = pa.schema([*longs, ("first", pa.int64()), ("ids", pa.string())]), pa.schema([*longs, ("ends_sha256", pa.string())])
    key = "k1 long, k2 long, depth long"
    packed = ends.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(pack, f"{key}, first long, ids string")
    return packed.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, f"{key}, ends_sha256 string")


def _with_parents(tops: DataFrame, nodes: DataFrame) -> DataFrame:
    """tops (a chain's highest node) with parent_conv_id.

    A node with many children would make one large group: these few (less than a
    node in ``WIDE``) are broadcast, if a count allows it.
    """
    parents = nodes.selectExpr("k1 as p1", "k2 as p2", "depth + 1 as depth", "conv_id as parent_conv_id", "n_children")
    wide = small(staged(parents.filter(F.col("n_children") > WIDE).drop("n_children")))
    found = tops.join(wide, ["p1", "p2", "depth"], "left")
    narrow = found.filter("parent_conv_id is null").drop("parent_conv_id").join(parents.filter(F.col("n_children") <= WIDE).drop("n_children"), ["p1", "p2", "depth"])
    return found.filter("parent_conv_id is not null").unionByName(narrow)


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """A row for each node: KEY, conv_id (least member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    turns (conv_id, depth, said, chars) and ids (conv_id, length) as for ``paths``.
    """
    rows = staged(paths(turns, ids))
    tries = rows.select(*KEY, "p1", "p2", "chars", "conv_id", F.lit(1).cast("long").alias("n_convs"))
    tries = merged(tries, "conv_id", F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), *[F.max(c).alias(c) for c in ("p1", "p2", "chars")])
    tries = staged(tries)
    children = tries.filter("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = staged(tries.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumn("saved", F.expr("(n_convs - 1) * chars")).withColumn("leaf", F.expr("if(n_children = 0, 1L, 0L)")))

    chains = staged(nodes.groupBy("conv_id").agg(F.min("depth").alias("top"), F.sum("saved").alias("all_saved"), F.sum("leaf").alias("all_leaves")))
    above = chains.filter("top > 0 and (all_saved > 0 or all_leaves > 0)").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("top") - 1) / STRETCH))).alias("s"))
    passed = rows.select(*KEY, "conv_id", F.floor(F.col("depth") / STRETCH).alias("s")).join(above, ["conv_id", "s"]).filter("depth < top")
    credits = merged(passed.select(*KEY, "conv_id", "all_saved", "all_leaves"), "conv_id", F.sum("all_saved").alias("all_saved"), F.sum("all_leaves").alias("all_leaves"))

    rolled = running(nodes, "conv_id", "depth", {"saved_tokens": "sum(saved)", "n_leaves": "sum(leaf)"}, STRETCH, backward=True)
    tops = _with_parents(nodes.join(chains.selectExpr("conv_id", "top as depth"), ["conv_id", "depth"]).filter("depth > 0").select(*KEY, "p1", "p2"), nodes).select(*KEY, "parent_conv_id")
    whole = rolled.join(credits, KEY, "left").join(tops, KEY, "left").join(end_hashes(rows.filter("ends")), KEY, "left")
    return whole.select(
        *KEY,
        "conv_id",
        F.expr("case when depth > 0 then coalesce(parent_conv_id, conv_id) end").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.expr("cast(n_leaves + coalesce(all_leaves, 0) as bigint)").alias("n_leaves"),
        F.expr("cast(saved_tokens + coalesce(all_saved, 0) as bigint)").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns and ids for ``prefix_trie``: every conversation c begins with the first h turns of c - c % 100, h being crc32(c) % 6, and goes on with its own after its first h."""
    own = staged(numbered_turns(conversations))
    counts = own.groupBy("conv_id").agg(F.count("*").alias("n")).selectExpr("conv_id", "n", "conv_id - conv_id % 100 as base", "crc32(cast(conv_id as string)) % 6 as h")
    bases = counts.filter("conv_id = base").selectExpr("base", "n as n_base")
    counts = staged(counts.join(bases, "base", "left").withColumn("k", F.expr("least(h, coalesce(n_base, 0))")).withColumn("length", F.expr("k + greatest(n - h, 0)")))
    heads = own.filter("rank <= 5 and conv_id = conv_id - conv_id % 100").selectExpr("conv_id as base", "rank as depth", "said", "chars")
    first = counts.select("conv_id", "base", "k").join(heads, "base").filter("depth <= k").select("conv_id", "depth", "said", "chars")
    spread = counts.select("conv_id", "h", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / STRETCH))).alias("s"))
    rest = own.withColumn("s", F.floor(F.col("rank") / STRETCH)).join(spread, ["conv_id", "s"]).filter("rank > h").selectExpr("conv_id", "rank - h + k as depth", "said", "chars")
    return first.unionByName(rest), counts.select("conv_id", "length")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    trie = prefix_trie(*rebuilt(table(spark, sf_dir, "conversations")))
    return trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of an ASCII string, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: list_transform(range(8), lambda k: (ascii(c)::bigint >> k::int) & 1)))"
    return f"xor(list_reduce({bits}, lambda crc, bit: xor(crc >> 1, (xor(crc, bit) & 1) * 3988292384), 4294967295::bigint), 4294967295::bigint)"


OP11_SQL = f"""
with t as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as body,
        row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as r
    from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 100 as base, {crc32_sql("conv_id::varchar")} % 6 as h from (select distinct conv_id from t)),
s as (select c.conv_id, r, role, body from c join t on t.conv_id = c.base where r <= h union all select conv_id, r, role, body from c join t using (conv_id) where r > h),
b as (select conv_id, list(struct_pack(role := role, body := body) order by r) as said from s group by conv_id),
f as (select c.conv_id, coalesce(said, said[1:0], []) as said from c left join b using (conv_id)),
p as (select conv_id, d as depth, said[1:d] as path, len(said) as n from f, unnest(range(0, len(said) + 1)) as u(d)),
n as (
    select path, depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(length(any_value(path[depth].body)), 0) as chars,
        sha256(coalesce(string_agg(case when n = depth then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256
    from p group by path, depth),
k as (select path[1:depth - 1] as path, depth - 1 as depth, count(*) as n_children from n where depth > 0 group by 1, 2),
w as (select n.*, coalesce(n_children, 0) as n_children from n left join k using (path, depth)),
a as (select path[1:d] as path, d as depth, sum((n_convs - 1) * chars)::bigint as saved_tokens, count(*) filter (n_children = 0) as n_leaves from w, unnest(range(0, depth + 1)) as u(d) group by 1, 2)
select w.conv_id, w.depth, u.conv_id as parent_conv_id, w.n_convs, w.n_children, a.n_leaves, a.saved_tokens, w.ends_sha256
from w join a using (path, depth) left join n u on u.depth = w.depth - 1 and u.path = w.path[1:w.depth - 1]
"""
