"""From source rows to quads: value splitting, linkage, references, statements, and the nested record view.

Source rows are long: rec, attr, value_pos, value (one row per cell or value). Linkage rows are kind ('attribute', 'type'
or 'prefix'), name, map_to, ord; linkage and prefix tables are small lookups, so joins leave the choice to Spark's measured
sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.functions.uris import base_of, is_valid_iri, local_name, resolve_reference
from quadloom.model import DESCRIPTIONS, LABELS, OBJECT, PREDICATE, RDFS, STATEMENT, SUBJECT, THING, TYPE


def split_values(rows: DataFrame, separator: str = "||") -> DataFrame:
    """A cell with separators becomes many values with their place; empty and null cells give none."""
    parts = F.split(F.col("value"), F.concat(F.lit("\\Q"), F.lit(separator), F.lit("\\E")))
    out = rows.select(*[c for c in rows.columns if c not in ("value", "value_pos")], F.posexplode(parts).alias("value_pos", "value"))
    return out.withColumn("value", F.trim("value")).filter("value != ''")


def attach_reify_columns(rows: DataFrame) -> DataFrame:
    """Cells of attribute `a&b` describe the value of `a` at the same place: rows of `a` get meta (map b -> values)."""
    name = F.split("attr", "&")
    about = rows.filter(F.size(name) == 2).select("rec", F.get(name, F.lit(0)).alias("attr"), "value_pos", F.get(name, F.lit(1)).alias("b"), F.col("value").alias("meta_value"))
    about = about.groupBy("rec", "attr", "value_pos", "b").agg(F.sort_array(F.collect_list("meta_value")).alias("v"))
    about = about.groupBy("rec", "attr", "value_pos").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("b", "v")))).alias("meta"))
    return rows.filter(F.size(name) == 1).join(about, ["rec", "attr", "value_pos"], "left")


def resolve_linkage(linkage: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Targets `pfx:name` expanded; absolute ones stay; error names an undefined prefix."""
    split = linkage.withColumn("prefix", F.when(~F.col("map_to").rlike("^https?://"), F.substring_index("map_to", ":", 1)))
    out = split.join(prefixes, "prefix", "left")
    rest = F.substring(F.col("map_to"), F.length("prefix") + 2, F.length("map_to"))
    full = F.when(F.col("prefix").isNull(), F.col("map_to")).otherwise(F.concat("uri", rest))
    error = F.when(F.col("prefix").isNotNull() & F.col("uri").isNull(), F.concat(F.lit("undefined prefix "), "prefix"))
    return out.select("kind", "name", full.alias("map_to"), "ord", error.alias("error"))


def merge_linkage(linkage: DataFrame) -> DataFrame:
    """The first definition of each name of a linked type wins."""
    first = Window.partitionBy("linked_type", "kind", "name").orderBy("ord", "map_to")
    return linkage.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def map_attributes(rows: DataFrame, linkage: DataFrame, base: str) -> DataFrame:
    """Adds p: the linked property, the attribute itself if it is a URI, else base + name."""
    known = linkage.filter("kind = 'attribute'").select(F.col("name").alias("attr"), F.col("map_to").alias("_to"))
    out = rows.join(known, "attr", "left")
    own = F.when(F.col("attr").rlike("^https?://"), F.col("attr")).otherwise(F.concat(F.lit(base), "attr"))
    return out.withColumn("p", F.coalesce("_to", own)).drop("_to")


def mapping_triples(linkage: DataFrame, target: str = f"{RDFS}subClassOf", sub_property: str = f"{RDFS}subPropertyOf") -> DataFrame:
    """(s, p, o) that say what a linkage added: a linked type is under its class, a linked attribute under its property, for
    names that are URIs of their own."""
    known = linkage.filter(is_valid_iri(F.col("name")) & (F.col("name") != F.col("map_to")))
    said = F.when(F.col("kind") == "type", target).otherwise(sub_property)
    return known.select(F.col("name").alias("s"), said.alias("p"), F.col("map_to").alias("o")).distinct()


def map_types(rows: DataFrame, linkage: DataFrame, default: str = THING) -> DataFrame:
    """rec, type -> rec, class: the linked class, else default. Names compare exactly."""
    known = linkage.filter("kind = 'type'").select(F.col("name").alias("type"), F.col("map_to").alias("class"))
    return rows.join(known, "type", "left").withColumn("class", F.coalesce("class", F.lit(default)))


def resolve_references(rows: DataFrame, base: str, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Adds o and o_kind from value by its @ and @@ marks; prefixes are expanded behind @@."""
    return rows.withColumns({"o": resolve_reference(F.col("value"), base, prefixes), "o_kind": F.when(F.col("value").startswith("@"), "uri").otherwise("literal")})


def statement_id(s: Column, p: Column, o: Column) -> Column:
    return F.md5(F.concat(s, p, o))


def reify_statements(rows: DataFrame) -> DataFrame:
    """s, p, o, meta (map) -> statement triples: subject, predicate, object, type, then one row per metadata value, each once.
    Rows are combined by statement before its triples are made, so one row a statement moves."""
    stmt = statement_id(F.col("s"), F.col("p"), F.col("o"))
    pairs = F.flatten(F.transform(F.map_entries("meta"), lambda e: F.transform(F.coalesce(e["value"], F.array()), lambda v: F.struct(e["key"].alias("rei_p"), v.alias("rei_o")))))
    said = rows.filter(F.size("meta") > 0).select(stmt.alias("stmt"), F.struct("s", "p", "o").alias("of"), F.inline_outer(pairs))
    pair = F.when(F.col("rei_p").isNotNull(), F.struct("rei_p", "rei_o"))
    one = said.groupBy("stmt").agg(F.collect_set("of").alias("of"), F.collect_set(pair).alias("pairs"))

    def parts(p: str, part: str) -> Column:
        return F.transform(F.array_distinct(f"of.{part}"), lambda v: F.struct(F.lit(p).alias("rei_p"), v.alias("rei_o")))

    kind = F.array(F.struct(F.lit(TYPE).alias("rei_p"), F.lit(STATEMENT).alias("rei_o")))
    one = one.select("stmt", F.concat(kind, parts(SUBJECT, "s"), parts(PREDICATE, "p"), parts(OBJECT, "o")).alias("fixed"), "pairs")
    more = F.filter("pairs", lambda x: ~F.exists("fixed", lambda y: y.eqNullSafe(x)))
    return one.select("stmt", F.inline(F.concat("fixed", more)))


def quads_to_records(quads: DataFrame, statements: DataFrame | None = None, labels: tuple[str, ...] = LABELS, descriptions: tuple[str, ...] = DESCRIPTIONS) -> DataFrame:
    """One nested row per (g, s): types in order, pref_label, alt_labels, description, attributes (map of value lists).
    The first value of the best ranked label property is preferred; equal values stand once."""
    if statements is None:
        return described_records(quads.withColumn("reify", F.lit(None).cast("map<string,array<string>>")), labels, descriptions)
    meta = statements.groupBy("s", "p", "o", "rei_p").agg(F.sort_array(F.collect_set("rei_o")).alias("v")).groupBy("s", "p", "o").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rei_p", "v")))).alias("reify"))
    return described_records(quads.join(meta, ["s", "p", "o"], "left"), labels, descriptions)


def described_records(quads: DataFrame, labels: tuple[str, ...] = LABELS, descriptions: tuple[str, ...] = DESCRIPTIONS) -> DataFrame:
    """quads_to_records of quads with reify (map), which depends on s, p and o alone. Quads move once, to their record."""

    def rank(of: tuple[str, ...]) -> Column:
        return F.array_position(F.array(*map(F.lit, of)), F.col("p"))

    literal = F.col("o_kind") == "literal"
    value = F.struct(F.when(literal, F.col("o")).alias("value"), F.when(~literal, F.col("o")).alias("uri"), F.col("o_lang").alias("lang"), F.col("o_type").alias("type"), F.to_json("reify").alias("reify"), "o_kind")
    kind = F.when(F.col("p") == TYPE, "type").when(rank(labels) > 0, "label").when(rank(descriptions) > 0, "description").otherwise("attribute")
    # sorted by value, so equal ones stand side by side, that of the least place first
    lists = quads.repartition("g", "s").groupBy("g", "s", "p").agg(F.sort_array(F.collect_set(F.struct(value.alias("x"), F.col("pos").isNull().alias("last"), "pos"))).alias("v"))
    lists = lists.withColumn("v", F.filter("v", lambda e, k: (k == 0) | ~e["x"].eqNullSafe(F.get("v", k - 1)["x"])))
    lists = lists.withColumn("v", F.sort_array(F.transform("v", lambda e: F.struct(e["pos"].alias("pos"), *[e["x"][c].alias(c) for c in ("value", "uri", "lang", "type", "reify")]))))
    lists = lists.select("g", "s", "p", kind.alias("kind"), "v", F.array_min(F.transform("v", lambda e: F.struct(e["pos"].alias("pos"), F.coalesce(e["value"], e["uri"]).alias("o")))).alias("first"))
    named = lists.withColumn("rank", F.when(F.col("kind") == "label", rank(labels)).when(F.col("kind") == "description", rank(descriptions)))
    entry = F.struct("rank", F.col("first.o").alias("o"))
    out = named.groupBy("g", "s").agg(
        F.flatten(F.collect_list(F.when(F.col("kind") == "type", F.transform("v", lambda x: x["uri"])))).alias("types"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "label", entry))).alias("l"),
        F.min(F.when(F.col("kind") == "description", entry))["o"].alias("description"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("kind") == "attribute", F.struct("p", "v"))))).alias("attributes"),
    )
    labelled = F.coalesce(F.get("l", F.lit(0))["o"], local_name(F.col("s")))
    return out.select("g", "s", "types", labelled.alias("pref_label"), F.transform(F.slice("l", F.lit(2), F.size("l")), lambda x: x["o"]).alias("alt_labels"), "description", "attributes")


def records_to_quads(records: DataFrame) -> DataFrame:
    """The attribute quads of nested records, the inverse of quads_to_records for attributes and types."""
    types = records.select("g", "s", F.posexplode("types").alias("pos", "o")).select("g", "s", F.lit(TYPE).alias("p"), "o", F.lit("uri").alias("o_kind"), F.lit(None).cast("string").alias("o_type"), F.lit(None).cast("string").alias("o_lang"), F.col("pos").cast("long").alias("pos"))
    values = records.select("g", "s", F.explode("attributes").alias("p", "v")).select("g", "s", "p", F.explode("v").alias("v"))
    values = values.select("g", "s", "p", F.coalesce("v.value", "v.uri").alias("o"), F.when(F.col("v.uri").isNull(), "literal").otherwise("uri").alias("o_kind"), F.col("v.type").alias("o_type"), F.col("v.lang").alias("o_lang"), F.col("v.pos").alias("pos"))
    return types.unionByName(values)


def prefixize(rows: DataFrame, column: str, namespaces: DataFrame) -> DataFrame:
    """Adds prefixed: `prefix:name`; bases that no namespace row has are numbered ns0, ns1 ... in the order of their URI."""
    split = rows.withColumns({"uri": base_of(F.col(column)), "_name": local_name(F.col(column))})
    # distinct bases are schema, not data: few rows, numbered in one small window
    unknown = split.select("uri").distinct().join(namespaces, "uri", "left_anti")
    unknown = unknown.select(F.concat(F.lit("ns"), (F.row_number().over(Window.orderBy("uri")) - 1).cast("string")).alias("prefix"), "uri")
    out = split.join(namespaces.select("prefix", "uri").unionByName(unknown), "uri")
    return out.withColumn("prefixed", F.concat_ws(":", "prefix", "_name")).drop("uri", "_name", "prefix")


def unprefixize(rows: DataFrame, column: str, namespaces: DataFrame) -> DataFrame:
    """Adds full: the URI of `prefix:name`, null for an unknown prefix; absolute URIs stay."""
    prefix = F.when(~F.col(column).rlike("^https?://"), F.substring_index(column, ":", 1))
    out = rows.withColumn("prefix", prefix).join(namespaces, "prefix", "left")
    rest = F.substring(F.col(column), F.length("prefix") + 2, F.length(column))
    return out.withColumn("full", F.when(F.col("prefix").isNull(), F.col(column)).otherwise(F.concat("uri", rest))).drop("prefix", "uri")


def _ranked(quads: DataFrame, properties: tuple[str, ...]) -> DataFrame:
    order = F.array_position(F.array(*map(F.lit, properties)), F.col("p"))
    return quads.filter(F.col("p").isin(*properties)).withColumn("rank", order)


def pref_label(quads: DataFrame, priority: tuple[str, ...] = LABELS) -> DataFrame:
    """(s, label): the first value of the best ranked property; without any, the local name."""
    best = _ranked(quads, priority).groupBy("s").agg(F.min(F.struct("rank", "pos", "o"))["o"].alias("label"))
    return quads.select("s").distinct().join(best, "s", "left").select("s", F.coalesce("label", local_name(F.col("s"))).alias("label"))


def description(quads: DataFrame, priority: tuple[str, ...] = DESCRIPTIONS) -> DataFrame:
    best = _ranked(quads, priority).groupBy("s").agg(F.min(F.struct("rank", "pos", "o"))["o"].alias("description"))
    return quads.select("s").distinct().join(best, "s", "left").select("s", F.coalesce("description", F.lit("No description available")).alias("description"))


def alt_labels(quads: DataFrame, priority: tuple[str, ...] = LABELS) -> DataFrame:
    """(s, label): the first value of each other label property."""
    firsts = _ranked(quads, priority).groupBy("s", "rank").agg(F.min(F.struct("pos", "o"))["o"].alias("label"))
    best = Window.partitionBy("s").orderBy("rank")
    return firsts.withColumn("_n", F.row_number().over(best)).filter("_n > 1").select("s", "label")
