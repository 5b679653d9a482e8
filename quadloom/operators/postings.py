"""A stored inverted index: postings with positions, and the best a block of documents can score for a word.

Postings lie in partitions by piece of the words (a hash), and inside by word and block, so a query opens the pieces of its words and,
by the files' statistics, little else of them. A block holds documents of similar length, whose scores for a word are alike.
Nothing is cut: a word of every document is spread over all blocks, and blocks are dealt to tasks one by one.

The index answers what filter_text, score_text and boost_phrase answer from the texts, with the same rows. For the first k only, a
block whose best possible score is below the k-th found so far is not opened.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.uris import query_words, tokens
from quadloom.operators.rank import K1, B

TABLES = ("stats", "terms", "maxima", "postings")


def build_postings(texts: DataFrame, path: str, pieces: int = 64, block_docs: int = 1000) -> Postings:
    """Write the index of texts (uid, field, text) to a new folder. A uid may have one text a field; further ones of the same
    uid and field are documents of their own to the counts, as in score_text, but share one posting a word and length.

    Null texts count as documents without words. An empty table makes an index that finds nothing. Extra columns are left out.
    """
    spark = texts.sparkSession
    rows = texts.select("uid", "field", tokens(F.col("text")).alias("w")).withColumn("length", F.size("w"))
    stats = rows.groupBy("field").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    stats.write.parquet(f"{path}/stats")
    stats = spark.read.schema(stats.schema).parquet(f"{path}/stats")
    # documents are gathered by length: two classes for each doubling, as many blocks a class as its documents fill
    kind = F.floor(2 * F.log2(F.col("length") + 1)).cast("int")
    classes = rows.filter("length > 0").groupBy(kind.alias("c")).count().collect()
    blocks = {r["c"]: -(-r["count"] // block_docs) for r in classes}
    many = F.element_at(F.create_map(*[F.lit(x) for c, n in blocks.items() for x in (c, n)]), kind) if blocks else F.lit(1)
    block = F.concat_ws(".", kind, F.pmod(F.xxhash64("uid"), many.cast("long")))
    words = rows.filter("length > 0").select("uid", "field", "length", block.alias("block"), F.posexplode("w").alias("pos", "term"))
    placed = words.withColumn("piece", piece_of(F.col("term"), pieces))
    # dealt by piece and block, which are among the keys of the sum: it needs no further shuffle, and no word meets in one task
    grouped = placed.repartition("piece", "block").groupBy("piece", "block", "field", "term", "uid", "length").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))
    impact = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    out = grouped.join(F.broadcast(stats.select("field", "mean")), "field").withColumn("impact", impact).drop("mean")  # a row a field
    out.sortWithinPartitions("piece", "term", "block").write.partitionBy("piece").parquet(f"{path}/postings")
    held = spark.read.schema(out.schema).parquet(f"{path}/postings")
    maxima = held.groupBy("piece", "field", "term", "block").agg(F.max("impact").alias("most"), F.count("*").alias("df"))
    maxima.repartition("piece", "block").sortWithinPartitions("piece", "term").write.partitionBy("piece").parquet(f"{path}/maxima")
    terms = spark.read.schema(maxima.schema).parquet(f"{path}/maxima").groupBy("piece", "field", "term").agg(F.sum("df").alias("df"))
    terms.repartition("piece").sortWithinPartitions("piece", "term").write.partitionBy("piece").parquet(f"{path}/terms")
    spark.createDataFrame([(pieces, dict(texts.dtypes)["uid"])], "pieces int, uid string").coalesce(1).write.parquet(f"{path}/layout")
    return Postings(spark, path)


def piece_of(term: Column, pieces: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(pieces)).cast("int")


_SCHEMAS = {
    "stats": "field string, n long, mean double",
    "terms": "field string, term string, df long, piece int",
    "maxima": "field string, term string, block string, most double, df long, piece int",
    "postings": "block string, field string, term string, uid {uid}, length int, tf int, positions array<int>, impact double, piece int",
}


class Postings:
    """An index written by build_postings."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.pieces, self.uid = spark.read.parquet(f"{path}/layout").first()

    def _of(self, table: str, wanted: list[str], fields: list[str] | None = None) -> DataFrame:
        """Rows of the words, from their pieces alone."""
        rows = self.spark.read.schema(_SCHEMAS[table].format(uid=self.uid)).parquet(f"{self.path}/{table}")
        if table == "stats":
            return rows
        pieces = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*[piece_of(F.lit(w), self.pieces) for w in wanted]))).distinct().collect()]
        rows = rows.filter(F.col("piece").isin(pieces) & F.col("term").isin(wanted))
        return rows if fields is None else rows.filter(F.col("field").isin(fields))

    def matches(self, query: str, operator: str = "and", min_match: int | None = None, fields: list[str] | None = None) -> DataFrame:
        """(uid) of the documents with all, any, or at least min_match of the distinct query words, as filter_text."""
        wanted = sorted(set(query_words(query)))
        if not wanted:
            raise ValueError("a query without words matches what the index does not hold; take the documents")
        least = min_match if min_match is not None else len(wanted) if operator == "and" else 1
        return self._of("postings", wanted, fields).groupBy("uid").agg(F.count_distinct("term").alias("n")).filter(F.col("n") >= least).select("uid")

    def _weights(self, wanted: list[str], field_weights: dict[str, float] | None) -> DataFrame:
        """(field, term, weight): weight of the field times the word's rarity; a row for each field and query word."""
        given = list(field_weights) if field_weights else None
        weight: Column = F.lit(1.0)
        for field, w in (field_weights or {}).items():
            weight = F.when(F.col("field") == field, F.lit(float(w))).otherwise(weight)
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        known = self._of("terms", wanted, given).join(F.broadcast(self._of("stats", wanted)), "field")
        return known.select("field", "term", (idf * weight).alias("weight"))

    def scores(self, query: str, field_weights: dict[str, float] | None = None, blocks: DataFrame | None = None) -> DataFrame:
        """(uid, score) as score_text, of all documents or those of the blocks (block)."""
        wanted = sorted(set(query_words(query)))
        if not wanted:
            return self._of("postings", [""]).select("uid", F.lit(0.0).alias("score")).limit(0)
        rows = self._of("postings", wanted, list(field_weights) if field_weights else None).select("block", "field", "term", "uid", "impact")
        if blocks is not None:
            rows = rows.join(blocks.select("block"), "block", "left_semi")
        # a row a field and query word: bounded by the query, not by the data
        return rows.join(F.broadcast(self._weights(wanted, field_weights)), ["field", "term"]).groupBy("uid").agg(F.sum(F.col("impact") * F.col("weight")).alias("score"))

    def bounds(self, query: str, field_weights: dict[str, float] | None = None) -> DataFrame:
        """(block, bound, docs): what no document of a block can exceed, and how many documents it has for its commonest word.
        Texts of one uid in several fields may lie in several blocks, so bounds of such documents are kept by `top`."""
        wanted = sorted(set(query_words(query)))
        best = self._of("maxima", wanted, list(field_weights) if field_weights else None).join(F.broadcast(self._weights(wanted, field_weights)), ["field", "term"])
        return best.groupBy("block").agg(F.sum(F.greatest(F.col("most") * F.col("weight"), F.lit(0.0))).alias("bound"), F.max("df").alias("docs"))

    def top(self, query: str, k: int, field: str, weight: float = 1.0, first: int = 8) -> DataFrame:
        """(uid, score) of the k best of one field, smaller uids first among equals. The `first` blocks with the highest bounds are
        scored; of the others only those are opened whose bound reaches the k-th score."""
        if not query_words(query):
            return self.scores(query)
        weights = {field: weight}
        bounds = self.bounds(query, weights)
        begun = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(first).collect()]
        found = self.scores(query, weights, self.spark.createDataFrame([(b,) for b in begun], "block string"))
        order = [F.desc("score"), F.asc("uid")]
        least = found.orderBy(*order).limit(k).agg(F.count("*"), F.min("score")).first()
        rest = bounds.filter(~F.col("block").isin(begun))
        if least[0] == k:
            rest = rest.filter(F.col("bound") >= F.lit(least[1]) - 1e-9)
        return found.union(self.scores(query, weights, rest)).orderBy(*order).limit(k)

    def phrase(self, query: str, field_weights: dict[str, float], slop: int = 0) -> DataFrame:
        """(uid, boost) as boost_phrase: the weight of each field in which all query words stand within a window of their number
        plus slop, found on positions alone."""
        words = query_words(query)
        wanted, width = sorted(set(words)), len(words) + slop
        rows = self._of("postings", wanted, list(field_weights))
        at = rows.groupBy("uid", "field", "length").agg(*[F.max(F.when(F.col("term") == w, F.col("positions"))).alias(f"p{i}") for i, w in enumerate(wanted)])
        places = [F.col(f"p{i}") for i in range(len(wanted))]
        all_there = reduce(Column.__and__, [p.isNotNull() for p in places])

        def within(start: Column) -> Column:
            return reduce(Column.__and__, [F.exists(p, lambda x: x.between(start, start + width - 1)) for p in places])

        near = F.exists(F.flatten(F.array(*places)), within)
        weight: Column = F.lit(0.0)
        for field, w in field_weights.items():
            weight = F.when(F.col("field") == field, F.lit(float(w))).otherwise(weight)
        hits = at.filter(all_there & near).select("uid", "field", weight.alias("w")).distinct()
        return hits.groupBy("uid").agg(F.sum("w").alias("boost"))
