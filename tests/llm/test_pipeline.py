"""The pipeline's stages against brute force, one after the other, on a small fixture."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from quadloom.llm.quality import judge_quality

from test_exact_ops import brute_join
from test_judging_ops import brute_leaks, brute_words

SMALL = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept, columns = docs, docs.columns
    frames = []
    for _, stage in corpus_pipeline.STAGES:
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        frames.append(stage(spark, kept, SMALL))
        kept = frames[-1]
    assert all(f.columns == columns for f in frames[:-1])
    good = {r.doc_id for r in judge_quality(docs).filter("kept").collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in frames[0].collect()} == good and 0 < len(good) < len(rows)
    alone = {d for d, _, c in brute_join([(d, t) for d, t in rows.items() if d in good]) if d == c}
    assert {r.doc_id for r in frames[1].collect()} == alone and len(alone) < len(good)
    items = {r.item_id: brute_words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    leaks = {d for d, _ in brute_leaks({d: rows[d] for d in alone}, items)}
    clean = {d for d in alone if d not in leaks}
    assert {r.doc_id for r in frames[2].collect()} == clean and len(clean) < len(alone)
    copies = Counter(r.doc_id for r in frames[3].collect())
    assert set(copies) == clean and set(copies.values()) <= {1, 2}
    last = frames[4].collect()
    assert Counter(r.doc_id for r in last) == copies
    for s in range(16):
        slots = sorted(r.slot for r in last if r.shard == s)
        assert slots == list(range(len(slots)))
    assert Counter((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, SMALL).collect()) == Counter((r.doc_id, r.shard) for r in last)


def test_stages_take_empty_and_odd_tables(spark):
    schema = spark.read.parquet(f"{SMALL}/documents.parquet").schema
    odd = [(1, None, None, None, None), (None, "a b c d e f", "en", "s", 3), (2, "", "en", None, 0), (2, "x " * 200, "en", "s", 400), (2, "x " * 200, "en", "s", 400)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SMALL).count() <= 2 * len(rows)


def test_stages_keep_columns_with_clashing_names(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = ["epoch", "_source", "_block", "_start", "_common", "_m", "_id", "_key", "_gone", "order_key", "class"]
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{k}-"), F.col("doc_id").cast("string")))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        rows = docs.collect()
        assert rows and all(r[name] == f"{k}-{r.doc_id}" for r in rows for k, name in enumerate(names))
        docs = spark.createDataFrame(rows, docs.schema)
