"""Shards by rendezvous hashing: a record's key goes to the shard whose weighted score for that key is highest.

score(key, shard) = -weight / ln(u), with u in (0, 1) from the first 52 bits of md5("key:shard"). Adding a shard can only
give it rows: every other shard's score is as before. Slots number the rows of a shard without gaps; they are counted in
`bins` bins per shard (a small table), so no shard is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.llm.shared import fresh


def hash_bits(text: Column, digits: int = 13) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Number of the winning shard; the lower number wins a tie. A null key is hashed as the word null."""
    text = F.coalesce(key.cast("string"), F.lit("null"))

    def score(shard: int, weight: float) -> Column:
        u = (hash_bits(F.concat(text, F.lit(f":{shard}"))) + F.lit(0.5)) / F.lit(float(1 << 52))
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("low"))

    best = F.greatest(*[score(k, w) for k, w in enumerate(weights)]) if len(weights) > 1 else score(0, weights[0])
    return (-best["low"]).cast("int")


def assign_shards(docs: DataFrame, shards: int = 16, weights: list[float] | None = None, bins: int = 256, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs (any columns; key and text are read) plus size, text_crc32, law, shard, slot and grown_shard.

    The law is `key`: key and shard count decide. grown_shard is the shard with one more shard of weight 1. A null text
    has size 1 and the checksum of an empty text. Rows that repeat a key share a shard, each with its own slot; slots
    follow (bin of key and text, key, size, checksum), and rows alike in all of these are in no stated order. A column of docs with the name of an output is replaced, every other is kept; an empty table gives no rows.
    """
    weights = list(weights or [1.0] * shards)
    if len(weights) != shards or min(weights) <= 0:
        raise ValueError("one positive weight for each shard")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumns(
        {
            "size": (F.octet_length(body) + 1).cast("long"),
            "text_crc32": F.crc32(F.encode(body, "UTF-8")).cast("long"),
            "law": F.lit("key"),
            "shard": rendezvous(F.col(key), weights),
            "grown_shard": rendezvous(F.col(key), [*weights, 1.0]),
        }
    )
    bin_, start, place, rows = fresh(out, "_bin", "_start", "_place", "_rows")
    named = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    bin_key = F.concat_ws("/", named, F.col("text_crc32").cast("string"))
    spread = F.pmod(hash_bits(bin_key), F.lit(bins)).cast("int")
    out = out.withColumn(bin_, spread)
    counts = out.groupBy("shard", bin_).agg(F.count("*").alias(rows))
    before = Window.partitionBy("shard").orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", bin_, F.coalesce(F.sum(rows).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy("shard", bin_).orderBy(F.col(key).asc_nulls_first(), "size", "text_crc32")
    placed = out.withColumn(place, F.row_number().over(within) - 1)
    # at most (shards * bins) rows, whatever the input
    placed = placed.join(F.broadcast(starts), ["shard", bin_])
    return placed.withColumn("slot", (F.col(start) + F.col(place)).cast("long")).drop(bin_, start, place)
