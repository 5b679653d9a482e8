"""Reads of records: by key, anywhere, by language and attribute, with links back and statement metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.model import OBJECT, PART_OF, PREDICATE, STATEMENT, SUBJECT, TYPE
from quadloom.operators.lineage import few


def read_records(quads: DataFrame, keys: DataFrame) -> DataFrame:
    """All quads of the requested (s, g), each once, plus the dataset as isPartOf."""
    rows = quads.join(keys.select("s", "g").distinct(), ["s", "g"], "left_semi").select("g", "s", "p", "o", "o_kind", "o_type", "o_lang", "pos")
    rows = rows.groupBy("g", "s", "p", "o", "o_kind", "o_type", "o_lang").agg(F.min("pos").alias("pos"))
    none = F.lit(None).cast("string")
    part = rows.select("g", "s").distinct().select("g", "s", F.lit(PART_OF).alias("p"), F.col("g").alias("o"), F.lit("uri").alias("o_kind"), none.alias("o_type"), none.alias("o_lang"), F.lit(-1).cast("long").alias("pos"))
    return rows.unionByName(part)


def read_records_anywhere(quads: DataFrame, uris: DataFrame, datasets: DataFrame) -> DataFrame:
    """Quads of uris (s) over the readable datasets (g); equal triples stand once, with the first dataset. The datasets are
    counted first, and quads are not dealt by them while they are few; quads move once, by subject, and are not sorted by dataset."""
    rows = quads.join(few(datasets.select("g").distinct(), "datasets"), "g", "left_semi").join(uris.select("s").distinct(), "s", "left_semi")
    rest = F.struct(*[c for c in quads.columns if c not in ("s", "p", "o")])
    once = rows.groupBy("s", "p", "o").agg(F.min_by(rest, F.struct("g", "pos")).alias("_first"))
    return once.select("s", "p", "o", "_first.*").select(*quads.columns)


def keep_language(quads: DataFrame, lang: str | None) -> DataFrame:
    """Untagged values and those in the language; no language keeps all."""
    return quads.filter(F.col("o_lang").isNull() | (F.col("o_lang") == lang)) if lang else quads


def keep_attributes(quads: DataFrame, attrs: list[str]) -> DataFrame:
    return quads.filter(F.col("p").isin([*attrs, TYPE]))


def links_back(quads: DataFrame, uris: DataFrame, datasets: DataFrame | None = None) -> DataFrame:
    """(uri, p, s, g): who points at the records of uris (s), except those records themselves. A hub target is a hot key of
    a plain join, which Spark splits."""
    wanted = uris.select(F.col("s").alias("uri")).distinct()
    edges = quads.filter(F.col("o_kind") == "uri")
    if datasets is not None:
        edges = edges.join(datasets.select("g").distinct(), "g", "left_semi")
    hits = edges.join(wanted, edges["o"] == wanted["uri"]).select("uri", "p", "s", "g")
    return hits.join(wanted.select(F.col("uri").alias("s")), "s", "left_anti").distinct()


def attach_reification(quads: DataFrame, statements: DataFrame) -> DataFrame:
    """quads plus reify: metadata property -> sorted values; the statement's own four predicates are left out."""
    own = statements.filter(~F.col("rei_p").isin(SUBJECT, PREDICATE, OBJECT, TYPE) & (F.col("rei_o") != STATEMENT))
    meta = own.groupBy("s", "p", "o", "rei_p").agg(F.sort_array(F.collect_set("rei_o")).alias("v"))
    meta = meta.groupBy("s", "p", "o").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rei_p", "v")))).alias("reify"))
    return quads.join(meta, ["s", "p", "o"], "left")
