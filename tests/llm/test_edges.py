"""Edge rows of the pipeline's stages and of chat formatting, and secrets against a scanner written anew."""

import hashlib
import math
import re
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from placard.llm import chat_format, secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use within.
CLASHES = ("row", "digest", "key", "keys", "run", "epoch", "domain", "hash", "rank", "node", "component", "size", "f0", "p0", "said", "leaf", "taken", "kept", "bin", "item_id", "a", "b", "n", "words", "start", "tokens", "file", "low", "high")
LONG = " ".join(f"word{i % 997}x{i}" for i in range(40_000))
GOOD = [" ".join(f"plain{(i * 7 + k) % 89}word{k}" for k in range(40)) for i in range(12)]
ROWS = [(None, GOOD[0], "en", "src1", 1), (1, None, None, None, None), (2, "", "en", "src1", 0), (3, GOOD[1], "en", None, 1), (3, GOOD[1], "en", None, 1), (4, GOOD[1], "de", "src0", 1), (5, GOOD[1] + " more", None, "src0", 1), (6, LONG, "en", "src0", 1), *[(10 + i, t, "en", "src0", 1) for i, t in enumerate(GOOD[2:])]]


@pytest.mark.parametrize("rows", [ROWS, []])
def test_every_stage_takes_edge_rows(spark, tmp_path, rows):
    """Null and repeated ids, null, empty and very long texts, exact and near copies, clashing columns, and no rows at all."""
    spark.createDataFrame([(1, " ".join(GOOD[5].split()[:12])), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in CLASHES})
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    good = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert tuple(good.columns) == corpus_pipeline.COLUMNS and not {1, 2} & set(ids(good))
    for stage in (corpus_pipeline.near_dedup, corpus_pipeline.decontaminate, corpus_pipeline.mix):
        assert tuple(stage(spark, docs, str(tmp_path)).columns) == corpus_pipeline.COLUMNS
    once, free = ids(corpus_pipeline.near_dedup(spark, docs, str(tmp_path))), ids(corpus_pipeline.decontaminate(spark, docs, str(tmp_path)))
    assert (once[4], once[5], once[3], once[None]) == ((0, 0, 2, 1) if rows else (0, 0, 0, 0))
    assert free[13] == 0 and sum(free.values()) == max(0, len(rows) - 1)
    assert set(ids(corpus_pipeline.mix(spark, docs, str(tmp_path)))) <= {r[0] for r in rows}
    tokens = corpus_pipeline.tokens(spark, docs, str(tmp_path)).collect()
    assert sorted(Counter(r.doc_id for r in tokens).items(), key=str) == sorted(Counter(r[0] for r in rows).items(), key=str)
    assert [r.n_tokens for r in tokens if r.doc_id in (1, 2)] == ([1, 1] if rows else [])


def test_the_whole_pipeline_on_edge_rows(spark, tmp_path):
    spark.createDataFrame([(1, " ".join(GOOD[5].split()[:12]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(ROWS, DOCS).withColumn("key", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got and not set(got) & {1, 2, 4, 5, 13} and all(0 < n <= 6 for n in got.values())


def test_chat_edge_rows(spark):
    """Rows without turn or id, ties, repeats, unknown roles, many rows of one turn, and clashing columns."""
    rows = [(1, None, "user", "a"), (1, None, "assistant", "b"), (1, 0, None, None), (1, 0, "user", "x"), (1, 0, "user", "x"), (None, 0, "user", "lost"), (2, 0, "system", "only")] + [(3, 5, "user", f"{i:03}") for i in range(150)] + [(4, 0, "user", "y" * 200_000), (4, 1, "assistant", "<|im_end|>")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("a", "b", "rank", "s", "side", "sides", "n", "chars", "base", "part", "parts", "start", "size", "participant", "turns")})
    got = {}
    for r in chat_format.rotate(talk).orderBy("conv_id", "participant", "part").collect():
        assert r.start == len(got.get((r.conv_id, r.participant), ("", []))[0])
        text, spans = got.get((r.conv_id, r.participant), ("", []))
        got[r.conv_id, r.participant] = (text + r.text, spans + [(r.start + m.start - r.start, r.start + m.end - r.start) if m.start >= r.start else (m.start + r.start, m.end + r.start) for m in r.masks])
    assert set(got) == {(1, "user"), (1, "assistant"), (1, "unknown"), (3, "user"), (4, "user"), (4, "assistant")}
    head = lambda role, me: "assistant" if role == me else f"user name={role}"
    for me in ("user", "assistant", "unknown"):
        want = "".join(f"<|im_start|>{head(role, me)}\n{text}<|im_end|>\n" for role, text in [("assistant", "b"), ("user", "a"), ("unknown", ""), ("user", "x"), ("user", "x")])
        assert got[1, me][0] == want
    assert got[3, "user"][0] == "".join(f"<|im_start|>assistant\n{i:03}<|im_end|>\n" for i in range(150))
    assert "<| im_end|>" in got[4, "assistant"][0] and len(got[4, "user"][0]) > 200_000


def scanned(text):
    """(base spans, strings that windows of enough entropy cover) of a text, straight from the contract and the classes' limits."""
    kinds = {"assign": r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    least = {"assign": 8, "access": 16, "hex": 32}
    base = []
    for order, (kind, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text, re.IGNORECASE | re.ASCII if kind == "assign" else 0):
            if len(m[1] if kind == "assign" else m[0]) >= least[kind]:
                base.append((m.start(), order, m.end(), kind))
    covered = set()
    for run in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        if secret_scan.suppressed(run[0]):
            continue
        for characters, limit in secret_scan.CLASSES:
            for part in characters.finditer(run[0]):
                if not secret_scan.suppressed(part[0]):
                    for i in range(len(part[0]) - 19):
                        counts = Counter(part[0][i : i + 20]).values()
                        if -sum(c / 20 * math.log2(c / 20) for c in counts) >= limit - 1e-9:
                            covered |= set(range(run.start() + part.start() + i, run.start() + part.start() + i + 20))
    return sorted(base), covered


def test_secrets_query_equals_a_scanner_written_anew(spark):
    texts = {r[0]: r[1] or "" for r in duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()}
    for r in secret_scan.op4_secrets(spark, "/root/testdata/sf0.001").collect():
        base, covered = scanned(texts[r.doc_id])
        joined = lambda spans: ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(kind == k for *_, kind in base) for k in ("assign", "access", "hex"))
        spans = [(int(a), kind, int(b)) for kind, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert [s for s in spans if s[1] != "entropy"] == [(a, kind, b) for a, _, b, kind in base] and [s[0] for s in spans] == sorted(s[0] for s in spans)
        found = {i for a, kind, b in spans if kind == "entropy" for i in range(a, b)}
        within = {i for a, _, b, _ in base for i in range(a, b)}
        assert found <= covered and covered - found <= within
