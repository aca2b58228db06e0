"""Piece encoding, prefix trie and turn repair against the library, brute force and SQL, on small made-up tables."""

import hashlib
import heapq
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from placard.llm import common, piece_codec, prefix_trie, simhash_dedup, turn_repair

TURNS = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def codec():
    return piece_codec.Pieces(piece_codec.default_model())


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=piece_codec.default_model())


# --- op12


def odd_texts(codec, n=4000, seed=3):
    rng = random.Random(seed)
    signs = [*" \t\n\r  ▁▁.,;ab eé日本語ゼ梦အ\U0001f600\0­ ", "</s>", "<s>", "<0x41>", "▁ the ing", *codec.alphabet[::9]]
    for _ in range(n):
        yield "".join(rng.choice(signs) if rng.random() < 0.5 else rng.choice(codec.text) for _ in range(rng.randint(0, 25)))


def test_encoding_equals_the_library(codec, library):
    memo = piece_codec.Parts(codec)
    texts = [*odd_texts(codec), "", " ", "  ", "\n", "▁", "a" * 5000, "日本語ing" * 3000, " " * 3001, "x y" * 2000]
    assert [memo.encode(t) for t in texts] == library.encode(texts)


def test_decoding_equals_the_library(codec, library):
    rng, memo = random.Random(4), piece_codec.Parts(codec)
    for text in odd_texts(codec, 1500, seed=5):
        ids = memo.encode(text)
        mixed = [rng.choice(ids) if ids and rng.random() < 0.6 else rng.randrange(1, 32000) for _ in range(rng.randint(0, 14))]
        assert codec.decode([*ids, 2]) == library.decode([*ids, 2])
        assert codec.decode(mixed) == library.decode(mixed)


def test_every_piece_and_pair_is_what_merging_makes(codec):
    rng = random.Random(6)

    def merge(text):  # the model's own way: the best pair first, the leftmost of equals
        parts = list(text)
        while True:
            pairs = [(-codec.score[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in codec.score]
            if not pairs:
                return parts
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    assert all(merge(codec.text[i]) == [codec.text[i]] for i in range(0, len(codec.text), 37))
    for _ in range(3000):
        a, b = rng.randrange(len(codec.text)), rng.randrange(len(codec.text))
        assert codec.compatible(a, b) == (merge(codec.text[a] + codec.text[b]) == [codec.text[a], codec.text[b]])


def test_backtracking_happens_and_fails_positions_once(codec, monkeypatch):
    tried = []
    monkeypatch.setattr(codec, "compatible", lambda a, b: tried.append((a, b)) or piece_codec.Pieces.compatible(codec, a, b))
    for known in codec.fits:
        known.clear()
    greedy = differs = 0
    for text in odd_texts(codec, 600, seed=8):
        for part in codec.parts(text.replace(" ", "▁")):
            if part[0] not in codec.inside:
                continue
            found, at = codec.backtrack(part), 0
            longest = []
            while at < len(part):
                longest.append(next(p for p in sorted(range(len(codec.text)), key=lambda p: -codec.size[p]) if part.startswith(codec.text[p], at)) if greedy < 30 else None)
                if longest[-1] is None:
                    break
                at += codec.size[longest[-1]]
            greedy += 1
            differs += longest[-1:] != [None] and found != longest
        if greedy > 30:
            break
    assert tried and differs  # taking the longest piece each time isn't enough


def test_pieces_query_equals_the_library_on_a_table(spark, library):
    got = {r.doc_id: r for r in piece_codec.op12_pieces(spark, "/root/testdata/sf0.001").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for doc_id, text in duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall():
        ids = [*library.encode(text or ""), 2]
        assert (got[doc_id].n_tokens, got[doc_id].ids_sha256, got[doc_id].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_pieces_edge_rows(spark):
    rows = [(None, "no id"), (1, None), (2, ""), (3, "same"), (3, "same"), (4, "x " * 30000), (5, "ß" * 50000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("ids", "n_tokens", "ids_sha256", "memo")})
    got = piece_codec.piece_digest(docs, piece_codec.default_model()).collect()
    assert len(got) == len(rows) and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {1} and {r.decoded_sha256 for r in got if r.doc_id in (1, 2)} == {EMPTY}
    encoded = piece_codec.encode_documents(docs, piece_codec.default_model())
    assert {(r.doc_id, r.text) for r in piece_codec.decode_documents(encoded, piece_codec.default_model()).collect()} == {(i, t or "") for i, t in rows}
    assert piece_codec.piece_digest(docs.limit(0), piece_codec.default_model()).count() == 0


# --- common


def test_ranks_and_running_sums_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.5 else rng.randrange(5), rng.choice([None, 1, 2, 3, 3, 3])) for _ in range(3000)]
    df = common.ranked(spark.createDataFrame(rows, "k long, v long"), "k", F.col("v").asc_nulls_first()).cache()
    got = sorted(((r.k, r["rank"], r.v) for r in df.collect()))
    want = [(k, i + 1, v) for k in range(5) for i, v in enumerate(sorted((v for a, v in rows if a == k), key=lambda v: (v is not None, v or 0)))]
    assert got == want
    for backward in (False, True):
        summed = common.running(df.filter("v is not null"), "k", "rank", {"s": "sum(v)", "x": "bit_xor(v)"}, stretch=64, backward=backward)
        back = {(r.k, r["rank"]): (r.s, r.x) for r in summed.collect()}
        for k in range(5):
            own = [(i, v) for a, i, v in want if a == k and v is not None]
            total = xor = 0
            for i, v in reversed(own) if backward else own:
                total, xor = total + v, xor ^ v
                assert back[k, i] == (total, xor)


# --- op11


def brute_trie(rows):
    by_conv = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            by_conv.setdefault(conv_id, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in by_conv.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        saved = sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        leaves = [p for p in below if not any(len(q) > len(p) and q[: len(p)] == p for q in below)]
        ends = ",".join(str(c) for c in sorted(convs) if whole[c] == path)
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(spark, rows, **extra):
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in extra.get("columns", ())})
    got = prefix_trie.prefix_trie(*prefix_trie.rebuilt(df)).collect()
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got), key=repr)


def test_trie_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 4)
    monkeypatch.setattr(prefix_trie, "WIDE", 3)
    monkeypatch.setattr(prefix_trie, "PACK", 5)
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hi", "yo", "", None, "Ünï\U0001f600"])) for c in [*range(60), 100, 105, 207, 1000] for t in range(rng.randint(1, 9))]
    rows += [(300, None, "user", "a"), (300, None, "user", "b"), (300, 0, "system", "c"), (300, 0, "system", "c"), (None, 0, "user", "lost"), (301, 0, "user", "z" * 100_000)]
    assert trie_rows(spark, rows, columns=("k1", "depth", "said", "rank", "ends", "s", "g", "n")) == brute_trie(rows)


def test_trie_of_a_hot_conversation_and_of_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 8)
    rows = [(7, t, "user", f"m{t % 3}") for t in range(150)] + [(c, t, "user", "same") for c in range(200, 260) for t in range(3)]
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert trie_rows(spark, []) == []
    assert trie_rows(spark, [(None, 1, "user", "x")]) == []


def test_first_merge_combines_within_partitions(spark):
    rows = spark.createDataFrame([(0, 0, 0, c, 1) for c in range(4000)], "k1 long, k2 long, depth long, conv_id long, n long").repartition(4)
    table = prefix_trie.merged(rows, "conv_id", F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"))
    assert table.collect() == [(0, 0, 0, 0, 4000)]
    plan = table._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("partial_sum") == 2 and plan.count("hashpartitioning") == 2


# --- op13


def brute_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) by a heap over whole audits: cheapest first, then least."""
    if not rows:
        return (0, 0, 0, 0, 0, 0, "", EMPTY)
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds = set(), []
    for _, role, text in rows:
        stripped = text.strip("\x20\t\n\v\f\r")
        kinds.append("b" if not stripped else "d" if (role, text) in seen else "" if stripped[-1] in ".!?" else "t")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    # states: what the roles so far end with; "" nothing, s, u, a
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if (i, last) in done:
            continue
        if i == len(rows) and last in ("", "a"):
            return (gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
        done.add((i, last))
        new = "assistant" if last == "u" else "user"
        heapq.heappush(heap, (cost + 3, audit + "I", i, new[0], (*lines, f"{new}:")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, lines))
            if kinds[i] in ("", "t"):
                more = 3 if kinds[i] else 0
                heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, new[0], (*lines, f"{new}:{text}")))
                if (last, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))


def random_rows(rng, n):
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "", " ", "ünï"], ["Done.", "Yes!", "Why?", "cut off", "", " \t", "Done.", "a. ", "nbsp. ", "日本。"]
    return [(rng.choice([None, *range(n + 2)]), rng.choice(roles), rng.choice(texts) + (str(rng.randrange(99)) + "." if rng.random() < 0.4 else "")) for _ in range(n)]


def repair_rows(spark, rows, columns=()):
    df = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in columns})
    return {r.conv_id: tuple(r)[1:] for r in turn_repair.repair(df).select(*turn_repair.COLUMNS).collect()}


@pytest.mark.parametrize("size", [4096, 3, 1])
def test_repair_equals_brute_force(spark, monkeypatch, size):
    """Whole conversations, and the same cut into small segments."""
    monkeypatch.setattr(turn_repair, "ROWS", size)
    rng = random.Random(size)
    convs = {c: random_rows(rng, rng.randint(1, 14)) for c in range(150 if size > 3 else 60)}
    got = repair_rows(spark, [(c, *r) for c, rows in convs.items() for r in rows], ("at", "goal", "seen", "lines", "n", "row", "kind"))
    assert got == {c: brute_repair(rows) for c, rows in convs.items()}


def test_repair_of_a_hot_conversation(spark, monkeypatch):
    monkeypatch.setattr(turn_repair, "ROWS", 50)
    rng = random.Random(9)
    hot = [(i, *r[1:]) for i, r in enumerate(random_rows(rng, 1500))] + [(5, "user", "Same.")] * 700
    got = repair_rows(spark, [(1, *r) for r in hot] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")])
    assert got == {1: brute_repair(hot), 2: (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:Hi.\nassistant:Yes.").hexdigest())}


def test_dial_finds_what_relaxation_finds():
    rng = random.Random(11)
    for _ in range(200):
        rows = random_rows(rng, rng.randint(0, 9))
        roles, found = [r[1] for r in rows], turn_repair.faults([r[1] for r in rows], [r[2] for r in rows], set())
        goal = tuple(rng.choice([None, rng.randrange(12)]) for _ in range(4))
        far = turn_repair.distances(roles, found, goal)
        want = [turn_repair.FAR] * len(far)
        for q, d in enumerate(goal):
            if d is not None:
                want[4 * len(rows) + q] = d
        for _ in range(4 * len(far)):
            for node in range(len(far)):
                i, q = divmod(node, 4)
                steps = [(4 * i + turn_repair.TURN[q], 3)]
                if i < len(rows):
                    steps += [(4 * i + 4 + after, cost) for _, after, cost in turn_repair.arcs(roles[i], found[i], q)]
                want[node] = min(want[node], *[want[to] + cost for to, cost in steps])
        assert [min(d, turn_repair.FAR) for d in far] == [min(d, turn_repair.FAR) for d in want]


def test_repair_query_edge_rows(spark, tmp_path):
    rng = random.Random(12)
    rows = [(c, t, rng.choice(["system", "user", "assistant", None]), rng.choice(["Done.", "cut", None, "A. B! C?"])) for c in range(80) for t in [None, *range(rng.randint(1, 6))]]
    rows += [(100, 0, "user", "x" * 200_000 + "."), (None, 0, "user", "lost")]
    spark.createDataFrame(rows, TURNS).withColumn("audit", F.lit("clash")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in turn_repair.op13_turn_repair(spark, str(tmp_path)).collect()}
    want = {}
    for c, turn, role, text in rows:
        if c is None:
            continue
        kept = want.setdefault(c, [])
        kind = zlib.crc32(f"{c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
        kept += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == {c: brute_repair(kept) for c, kept in want.items()}
    spark.createDataFrame([], TURNS).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert turn_repair.op13_turn_repair(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op13_turn_repair"])
def test_query_equals_sql(spark, name):
    from placard.llm.catalog import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.sql("create view conversations as select * from '/root/testdata/sf0.001/conversations.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, "/root/testdata/sf0.001").select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


# --- near-duplicates by vantage-point trees


def test_vantage_trees_prune_and_lose_nothing():
    """Balls around near copies cross few boundaries, and the pairs are those of brute force."""
    rng = np.random.default_rng(4)
    sets, groups = [], []
    for g in range(12):
        base = rng.integers(0, 1 << 64, 400, dtype=np.uint64)
        for _ in range(25):
            own = base.copy()
            own[rng.choice(400, rng.integers(5, 80), replace=False)] = rng.integers(0, 1 << 64, 1, dtype=np.uint64)
            sets.append(np.unique(own[: rng.integers(300, 401)]))
            groups.append(g)
    bits = np.frombuffer(b"".join(map(simhash_dedup.parity, sets)), "<u8").reshape(len(sets), -1)
    size, everyone = np.array(list(map(len, sets))), np.arange(len(sets))
    i, j, compared = simhash_dedup.parity_pairs(bits, size, everyone, everyone, everyone, 0.8)
    got = set(zip(i.tolist(), j.tolist(), strict=True))
    alike = {(a, b) for a in everyone.tolist() for b in everyone.tolist() if a != b and len(c := np.intersect1d(sets[a], sets[b])) >= 0.8 * (size[a] + size[b] - len(c))}
    assert alike and alike <= got and len(got) < 3 * len(alike)
    assert compared < len(sets) ** 2 / 4 and all(groups[a] == groups[b] for a, b in got)


def test_unlike_texts_of_one_key_are_ruled_out_unread(spark):
    """Versions of one text that are all but near copies share keys; none of their pairs goes on to the comparison of texts."""
    rng = np.random.default_rng(6)
    base, rows = rng.integers(0, 1 << 64, 400, dtype=np.uint64), []
    for n in range(80):
        own = base.copy()
        own[rng.choice(400, 70, replace=False)] = rng.integers(0, 1 << 64, 70, dtype=np.uint64)
        rows.append((n, 400, simhash_dedup.parity(np.unique(own))))
    facts = spark.createDataFrame(rows, "node long, size long, parity binary")
    entries, found = facts.selectExpr("7L as key", "node"), facts.selectExpr("node", "node as component").limit(0)
    for block_rows in (2048, 30):
        assert simhash_dedup.open_pairs(entries, found, facts, 0.8, None, block_rows=block_rows).count() == 0
    twins = facts.unionByName(facts.selectExpr("node + 100 as node", "size", "parity"))
    both = twins.selectExpr("7L as key", "node")
    for block_rows in (2048, 30):
        assert sorted(map(tuple, simhash_dedup.open_pairs(both, found, twins, 0.8, None, block_rows=block_rows).collect())) == [(n, n + 100) for n in range(80)]
