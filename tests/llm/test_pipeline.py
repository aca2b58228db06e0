"""The pipeline's stages, each on its own input."""

import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from placard.llm import decontamination, mixing, quality_rules, simhash_dedup, token_files

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_their_effect(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = corpus_pipeline.quality(spark, docs, SF)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    clean = [r for r in docs.collect() if len(r.text.split()) >= 20 and labels.get(r.doc_id) and labels[r.doc_id].quality == 1]
    assert sum(r.doc_id in kept for r in clean) >= 0.99 * len(clean)
    once = corpus_pipeline.near_dedup(spark, good, SF)
    assert once.columns == docs.columns and 0 < once.count() < good.count()
    free = corpus_pipeline.decontaminate(spark, once, SF)
    assert free.columns == docs.columns and free.count() <= once.count()
    mixed = corpus_pipeline.mix(spark, free, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in free.collect()}


def test_every_stage_equals_brute_force(spark):
    from tokenizers import Tokenizer

    def sql(query, docs):
        con = duckdb.connect()
        con.register("documents", docs)
        con.sql(f"create view benchmark as select * from '{SF}/benchmark.parquet'")
        return con.sql(query).df()

    def step(stage, docs):
        return stage(spark, spark.createDataFrame(docs), SF).toPandas()

    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas()
    good = step(corpus_pipeline.quality, docs)
    judged = sql(quality_rules.OP5_SQL, docs)
    assert sorted(good.doc_id) == sorted(judged[judged.kept].doc_id)

    once = step(corpus_pipeline.near_dedup, good)
    words = {d: t.lower().encode().split() for d, t in zip(good.doc_id.tolist(), good.text, strict=True)}
    shingles = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    label = {d: d for d in words}
    for a in sorted(words):
        for b in sorted(words):
            if a < b and label[a] != label[b] and len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]):
                low, high = sorted((label[a], label[b]))
                label = {d: low if x == high else x for d, x in label.items()}
    assert sorted(once.doc_id) == sorted(set(label.values())) and simhash_dedup.BANDS == 32

    free = step(corpus_pipeline.decontaminate, once)
    assert set(free.doc_id) == set(once.doc_id) - set(sql(decontamination.OP7_SQL, once).doc_id)

    mixed = step(corpus_pipeline.mix, free)
    assert Counter(mixed.doc_id) == Counter(sql(mixing.OP1_SQL, free).doc_id)

    made = step(corpus_pipeline.tokens, mixed)
    whole, at = Tokenizer.from_file(token_files.default_tokenizer()), 0
    want = []
    for doc_id, text in sorted(zip(mixed.doc_id.tolist(), mixed.text, strict=True)):
        ids = np.array(whole.encode(text, add_special_tokens=False).ids + [2], "<u4").tobytes()
        want.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    assert sorted(made.itertuples(index=False, name=None)) == want


def test_run_returns_the_files_rows(spark):
    out = corpus_pipeline.run(spark, SF)
    rows = out.orderBy("start").collect()
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and rows
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens


@pytest.mark.parametrize("name", [*(f"op{n}_" for n in range(1, 11)), "pipeline"])
def test_registered(name):
    assert sum(q.startswith(name) for q in entry.queries()) == 1
