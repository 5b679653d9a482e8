"""The corpus pipeline: documents through five of the operators, each stage on all that the one before it kept.

1. quality rules: rejected documents go. 2. n-gram Jaccard join: one document of each near-duplicate class stays.
3. benchmark decontamination: documents that hold a benchmark item go. 4. mixing: every document once for each epoch that
takes it, at least once. 5. sharding: rows get their shard and slot.

Stages 1 to 4 return the columns of documents, whatever else those are; sharding adds its own and replaces columns of their
names. A null or empty text has too few words and goes in stage 1. A null id is kept by stages 2 and 3 if its text is, for it
is linked with nothing, and has a shard like any key. Rows that repeat an id and text share every verdict; of near-duplicates
the smallest id stays, and all rows with it. A null source counts as the empty one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadloom.llm.decontaminate import drop_contaminated
from quadloom.llm.mixing import repeat_by_source
from quadloom.llm.ngram_join import keep_one_of_each
from quadloom.llm.quality import drop_rejected
from quadloom.llm.sharding import assign_shards
from quadloom.llm.shared import forget, stored

#: No SQL: tiling and the divergence rules are checked against brute force in tests/llm.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_rejected(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeat_by_source(docs, max_repetition=2.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return assign_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stored(docs, f"stage-{place}")
            if before is not None:
                forget(before)  # the next stage reads what was just written
            before = docs
    return docs
