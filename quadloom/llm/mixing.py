"""Temperature mixing of sources, in DataFrame functions only.

A source with share p of all tokens gets weight p ** a / sum of the same. The exponent a in [0, 1] is bisected: for a
repetition limit, to the smallest a (flattest mix) at which no source is repeated more often than `max_repetition` times
as often as the least repeated one; for a target entropy, to the largest a whose mix has it (as a share of the log of the
number of sources). Each round halves the bracket `2 ** BITS` times with one sum over the small source table.

The token budget is the smallest one that gives every source at least one whole epoch, times `budget`. It is realised in
blocks: a source's rows are dealt into `blocks` blocks by a hash of their id; each epoch visits the blocks in its own
permutation, and the last, partial epoch takes blocks while they stay within the source's budget. So with budget 1 no row is
ever lost, a source misses its budget by less than a block, and rows are decided by a table of sources times blocks. With a
target entropy, no source is taken for more than max_repetition times the epochs of the least repeated one: the exponent is the
smallest that keeps to both, so a tiny source beside a large one is not copied without bound.

Nulls and odd input: a null source counts as the empty one; a null text has
no tokens; a null id falls in one block; repeated rows are rows of their own. A source without tokens is kept once. An
empty table gives no rows. Columns of docs named as an output are replaced, all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.llm.sharding import hash_bits
from quadloom.llm.shared import fresh, small_side, stored
from quadloom.llm.text import words

BITS, ROUNDS = 6, 4


def mixing_exponent(sources: DataFrame, total: int, max_repetition: float, target_entropy: float | None) -> float:
    """Bisect the exponent over sources (source, tokens > 0). Every round is one sum for each point of a grid. The repetition
    limit asks for the smallest exponent that keeps to it; a target entropy for the largest that has it, but no smaller one."""
    low = _bisect(sources, total, F.col("most") <= F.lit(float(max_repetition)) * F.col("least"), True)
    if target_entropy is None:
        return low
    entropy = F.log("z") - F.col("wlog") / F.col("z")
    return max(low, _bisect(sources, total, entropy < F.lit(float(target_entropy)) * F.log("n"), False))


def _bisect(sources: DataFrame, total: int, holds, upper: bool) -> float:
    """The place in [0, 1] where a condition on the sums begins to hold: the first point where it does, or the last before."""
    steps, low, width = 1 << BITS, 0.0, 1.0
    for _ in range(ROUNDS):
        share = F.col("tokens") / F.lit(float(total))
        grid = sources.select(share.alias("p"), F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("k"))
        grid = grid.withColumn("w", F.pow("p", F.lit(low) + F.col("k") * F.lit(width / steps)))
        ratio = F.col("w") / F.col("p")
        sums = grid.groupBy("k").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wlog"), F.count("*").alias("n"), F.max(ratio).alias("most"), F.min(ratio).alias("least"))
        right = sums.filter(holds).agg(F.min("k")).first()[0]
        right = steps if right is None else right
        low, width = low + max(right - 1, 0) * width / steps, width / steps
    return low + width if upper else low


def dealt(id_column: Column, blocks: int) -> Column:
    return F.pmod(hash_bits(F.concat(F.lit("block:"), F.coalesce(id_column.cast("string"), F.lit("null")))), F.lit(blocks)).cast("int")


def mixing_plan(docs: DataFrame, max_repetition: float, target_entropy: float | None, budget: float, blocks: int) -> DataFrame:
    """The plan table: which blocks of which source are taken in which epoch, and in what order."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select(source.alias("source"), dealt(F.col("doc_id"), blocks).alias("block"), F.size(words(F.col("text").cast("string"))).cast("long").alias("tokens"))
    table = stored(rows.groupBy("source", "block").agg(F.sum("tokens").alias("tokens")), "source-blocks")
    sources = stored(table.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    spoken = sources.filter("tokens > 0")
    total = spoken.agg(F.sum("tokens")).first()[0] or 0
    a = mixing_exponent(spoken, total, max_repetition, target_entropy) if total else 1.0
    weighted = sources.withColumn("w", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(float(total or 1)), F.lit(a))))
    z = weighted.agg(F.max(F.col("tokens") / F.col("w"))).first()[0] or 1.0
    target = F.col("w") * F.lit(z * budget)
    epochs = F.when(F.col("tokens") > 0, F.floor(target / F.col("tokens") + F.lit(1e-9))).otherwise(F.lit(1)).cast("long")
    shares = weighted.withColumn("epochs", epochs)
    rest = F.when(F.col("tokens") > 0, F.greatest(F.floor(target - F.col("epochs") * F.col("tokens") + F.lit(1e-6)), F.lit(0))).otherwise(F.lit(-1)).cast("long")
    shares = shares.select("source", "epochs", rest.alias("rest"))
    visits = table.join(shares, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "epochs")))
    shuffled = hash_bits(F.concat(F.lit("visit:"), F.col("source"), F.lit(":"), F.col("block").cast("string"), F.lit(":"), F.col("epoch").cast("string")))
    order = Window.partitionBy("source", "epoch").orderBy("shuffled", "block")
    visits = visits.withColumn("shuffled", shuffled).withColumn("block_rank", F.row_number().over(order)).withColumn("so_far", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    taken = visits.filter((F.col("epoch") < F.col("epochs")) | (F.col("so_far") <= F.col("rest")))
    return stored(taken.select("source", "block", "epoch", "block_rank"), "mixing-plan")


def mix_sources(docs: DataFrame, max_repetition: float = 2.0, target_entropy: float | None = None, budget: float = 1.0, blocks: int = 128) -> DataFrame:
    """The rows of the mix: docs (doc_id, source, text are read), each row once for every epoch that takes its block, plus
    epoch (from 0), block_rank (place of its block in the source's epoch) and order_key (place within the block)."""
    return mixed(docs, mixing_plan(docs, max_repetition, target_entropy, budget, blocks), blocks)


def named(column: str) -> Column:
    """A column by its name, whatever signs that holds."""
    return F.col(f"`{column.replace('`', '``')}`")


def mixed(docs: DataFrame, plan: DataFrame, blocks: int, outputs: bool = True) -> DataFrame:
    """docs by a plan of mixing_plan; without outputs, with no column but its own, whatever their names."""
    columns = docs.columns
    source, block, epoch, rank = fresh(docs, "_source", "_block", "_epoch", "_rank")
    plan = small_side(plan, 50_000).toDF(source, block, epoch, rank)
    placed = docs.withColumns({source: F.coalesce(F.col("source").cast("string"), F.lit("")), block: dealt(F.col("doc_id"), blocks)})
    out = placed.join(plan, [source, block])
    if not outputs:
        return out.select(*map(named, columns))
    key = F.concat(F.lit("place:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col(epoch).cast("string"))
    kept = [named(c) for c in columns if c.lower() not in ("epoch", "block_rank", "order_key")]
    return out.select(*kept, F.col(epoch).alias("epoch"), F.col(rank).alias("block_rank"), hash_bits(key).alias("order_key"))


def repeat_by_source(docs: DataFrame, max_repetition: float = 2.0, target_entropy: float | None = None, budget: float = 1.0, blocks: int = 128) -> DataFrame:
    """The rows of mix_sources with the columns of docs only."""
    return mixed(docs, mixing_plan(docs, max_repetition, target_entropy, budget, blocks), blocks, outputs=False)
