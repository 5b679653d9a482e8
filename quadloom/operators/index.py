"""Search rows from quads: `docs` (a row per record) and long `doc_fields` (a row per value), never a column per attribute."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.functions.uris import doc_id, local_name, route_language, safe_date
from quadloom.model import ALT, DCTERMS, DESCRIPTIONS, LABELS, LAT, LAT_LONG, LOCATED_IN, LONG, POLYGON, POLYLINE, STATEMENT, THING, TYPE, URL, XSD

GEO_PROPERTIES = (LAT, LONG, ALT, LAT_LONG, POLYGON, POLYLINE, LOCATED_IN)
INTEGERS = tuple(f"{XSD}{t}" for t in ("int", "integer", "long", "short", "byte"))
REALS = tuple(f"{XSD}{t}" for t in ("float", "double", "decimal"))
DATES = (f"{XSD}dateTime", f"{XSD}date")


def with_uid(quads: DataFrame) -> DataFrame:
    return quads.withColumn("uid", doc_id(F.col("g"), F.col("s")))


def classify_subjects(quads: DataFrame) -> DataFrame:
    """(g, s, class): 'dataset', 'statement' or 'record'; blank nodes are left out."""
    def has(uri: str):
        return F.max(((F.col("p") == TYPE) & (F.col("o") == uri)).cast("int"))

    kinds = quads.filter(~F.col("s").startswith("_:")).groupBy("g", "s").agg(has(f"{DCTERMS}Dataset").alias("d"), has(STATEMENT).alias("t"))
    return kinds.select("g", "s", F.when(F.col("d") == 1, "dataset").when(F.col("t") == 1, "statement").otherwise("record").alias("class"))


def index_labels(quads: DataFrame, supported: list[str], labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(uid, lang, pref_label, alt_labels): per record and language the first label of the best property, then the others.
    A record without any label gets its local name in the default language."""
    rows = with_uid(quads).withColumns({"lang": route_language(F.col("o_lang"), supported), "rank": F.array_position(F.array(*map(F.lit, labels)), F.col("p"))})
    found = rows.filter("rank > 0").groupBy("uid", "lang").agg(F.sort_array(F.collect_list(F.struct("rank", "pos", "o"))).alias("l"))
    found = found.select("uid", "lang", F.get("l", F.lit(0))["o"].alias("pref_label"), F.transform(F.slice("l", F.lit(2), F.size("l")), lambda x: x["o"]).alias("alt_labels"))
    bare = rows.groupBy("uid").agg(F.first("s").alias("s"), F.max("rank").alias("rank")).filter("rank = 0")
    bare = bare.select("uid", F.lit(supported[0]).alias("lang"), local_name(F.col("s")).alias("pref_label"), F.array().cast("array<string>").alias("alt_labels"))
    return found.unionByName(bare)


def index_descriptions(quads: DataFrame, supported: list[str], descriptions: tuple[str, ...] = DESCRIPTIONS) -> DataFrame:
    """(uid, lang, description): every description value in its language."""
    return with_uid(quads.filter(F.col("p").isin(*descriptions))).select("uid", route_language(F.col("o_lang"), supported).alias("lang"), F.col("o").alias("description"))


def index_geo(quads: DataFrame) -> DataFrame:
    """(uid, kind, lat, long, alt): points from lat with long or from "lat,long"; polygon and polyline corners from
    "long,lat[,alt] ...". Decimal commas of single coordinates become dots; what is incomplete or not a number is left out."""
    rows = with_uid(quads.filter(F.col("p").isin(*GEO_PROPERTIES)))

    def number(text):
        return text.try_cast("double")

    single = F.when(F.col("p").isin(LAT, LONG, ALT), number(F.regexp_replace("o", ",", ".")))
    pairs = rows.withColumn("n", single).filter("n IS NOT NULL").groupBy("uid").agg(*[F.min(F.when(F.col("p") == p, F.col("n"))).alias(c) for c, p in (("lat", LAT), ("long", LONG), ("alt", ALT))])
    points = pairs.filter("lat IS NOT NULL AND long IS NOT NULL").select("uid", F.lit("point").alias("kind"), "lat", "long", "alt")
    cells = F.split("o", ",")
    both = rows.filter(F.col("p") == LAT_LONG).select("uid", F.lit("point").alias("kind"), number(F.trim(F.get(cells, F.lit(0)))).alias("lat"), number(F.trim(F.get(cells, F.lit(1)))).alias("long"), F.lit(None).cast("double").alias("alt"))
    corner = F.split("c", ",")
    shapes = rows.filter(F.col("p").isin(POLYGON, POLYLINE)).select("uid", F.when(F.col("p") == POLYGON, "polygon").otherwise("polyline").alias("kind"), F.explode(F.split(F.trim("o"), "\\s+")).alias("c"))
    shapes = shapes.select("uid", "kind", number(F.get(corner, F.lit(1))).alias("lat"), number(F.get(corner, F.lit(0))).alias("long"), number(F.get(corner, F.lit(2))).alias("alt"))
    return points.unionByName(both).unionByName(shapes).filter("lat IS NOT NULL AND long IS NOT NULL")


def index_literals(quads: DataFrame, properties: DataFrame, supported: list[str], labels: tuple[str, ...] = LABELS, descriptions: tuple[str, ...] = DESCRIPTIONS) -> DataFrame:
    """(uid, attr, kind, lang, value, date, int, float, single_valued, pos): kind by the property's range - date if it parses,
    int, float, else text in its language; the raw text stays as value."""
    named = (*labels, *descriptions, *GEO_PROPERTIES)
    rows = with_uid(quads.filter((F.col("o_kind") == "literal") & ~F.col("p").isin(*named)))
    rows = rows.join(properties.select(F.col("uri").alias("p"), "range", "max_card"), "p", "left").withColumn("d", F.when(F.col("range").isin(*DATES), safe_date(F.col("o"))))
    kind = F.when(F.col("d").isNotNull(), "date").when(F.col("range").isin(*INTEGERS), "int").when(F.col("range").isin(*REALS), "float").otherwise("text")
    rows = rows.withColumn("kind", kind)
    return rows.select(
        "uid", F.col("p").alias("attr"), "kind", F.when(F.col("kind") == "text", route_language(F.col("o_lang"), supported)).alias("lang"), F.col("o").alias("value"), F.col("d").alias("date"),
        F.when(F.col("kind") == "int", F.col("o").try_cast("long")).alias("int"), F.when(F.col("kind") == "float", F.col("o").try_cast("double")).alias("float"), (F.coalesce("max_card", F.lit(0)) == 1).alias("single_valued"), "pos",
    )


def single_valued(fields: DataFrame) -> DataFrame:
    """The first value only, for properties with at most one."""
    first = Window.partitionBy("uid", "attr").orderBy("pos", "value")
    return fields.withColumn("_n", F.when(F.col("single_valued"), F.row_number().over(first)).otherwise(1)).filter("_n = 1").drop("_n")


def target_labels(label_quads: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(target, label): the first value of each label property joined by blanks. Aggregated before the join with all the
    edges, so a target that most edges point at is still one row."""
    firsts = label_quads.filter(F.col("p").isin(*labels)).groupBy("s", "p").agg(F.min(F.struct("pos", "o"))["o"].alias("o"))
    rank = F.array_position(F.array(*map(F.lit, labels)), F.col("p"))
    out = firsts.groupBy("s").agg(F.sort_array(F.collect_list(F.struct(rank.alias("r"), "o"))).alias("l"))
    return out.select(F.col("s").alias("target"), F.array_join(F.transform("l", lambda x: x["o"]), " ").alias("label"))


def index_object_labels(quads: DataFrame, label_quads: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """(uid, attr, obj_uri, obj_label, facet): labels of the targets over the whole store, else the local name."""
    edges = with_uid(quads.filter((F.col("o_kind") == "uri") & (F.col("p") != TYPE))).select("uid", F.col("p").alias("attr"), F.col("o").alias("target"))
    out = edges.join(target_labels(label_quads, labels), "target", "left").withColumn("obj_label", F.coalesce("label", local_name(F.col("target"))))
    return out.select("uid", "attr", F.col("target").alias("obj_uri"), "obj_label", F.concat_ws("::", "target", "obj_label").alias("facet"))


def index_reified(quads: DataFrame, statements: DataFrame) -> DataFrame:
    """(uid, meta_attr, about_attr, about_value, value) for statements about triples of these quads."""
    rows = with_uid(quads).select("uid", "s", "p", "o")
    return rows.join(statements.select("s", "p", "o", "rei_p", "rei_o"), ["s", "p", "o"]).select("uid", F.col("rei_p").alias("meta_attr"), F.col("p").alias("about_attr"), F.col("o").alias("about_value"), F.col("rei_o").alias("value"))


def infer_types(types: DataFrame, class_closure: DataFrame) -> DataFrame:
    """(uid, type) -> (uid, inferred): own types, all super-classes, and owl:Thing."""
    supers = types.join(class_closure.select(F.col("sub").alias("type"), "super"), "type").select("uid", F.col("super").alias("inferred"))
    own = types.select("uid", F.explode(F.array("type", F.lit(THING))).alias("inferred"))
    return own.union(supers).distinct()


def property_metadata(properties: DataFrame, class_closure: DataFrame) -> DataFrame:
    """(uri, max_card, range): ranges widened with their super-classes."""
    wider = properties.join(class_closure.select(F.col("sub").alias("range"), "super"), "range").select("uri", "max_card", F.col("super").alias("range"))
    return properties.select("uri", "max_card", "range").union(wider).distinct()


def field_catalog(fields: DataFrame) -> DataFrame:
    """(attr, kind, lang, n): the fields in use and their numbers of documents."""
    return fields.groupBy("attr", "kind", "lang").agg(F.count_distinct("uid").alias("n"))


def field_in_use(catalog: DataFrame, name: str) -> bool:
    """Exact match of an attribute name."""
    return not catalog.filter(F.col("attr") == name).isEmpty()


def build_index(quads: DataFrame, statements: DataFrame, properties: DataFrame, class_closure: DataFrame, supported: list[str], published: DataFrame | None = None, label_quads: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(docs, doc_fields). docs has uid, dataset, uri, types, inferred_types, pref_label (default language first), labels (by
    language), alt_labels, description, located_in, pref_url (its first) and points. With `published` (g, s), only those records are
    indexed (a rebuild from the stored quads). Labels of linked records come from label_quads, by default the same quads."""
    records = classify_subjects(quads).filter("class = 'record'").select("g", "s")
    if published is not None:
        records = records.join(published.select("g", "s").distinct(), ["g", "s"], "left_semi")
    mine = quads.join(records, ["g", "s"], "left_semi")
    types = with_uid(mine.filter(F.col("p") == TYPE)).select("uid", F.col("o").alias("type"), "pos")
    own = types.groupBy("uid").agg(F.sort_array(F.collect_set(F.struct("pos", "type"))).alias("t")).select("uid", F.transform("t", lambda x: x["type"]).alias("types"))
    inferred = infer_types(types.select("uid", "type"), class_closure).groupBy("uid").agg(F.sort_array(F.collect_set("inferred")).alias("inferred_types"))
    best = F.min(F.struct(F.when(F.col("lang") == supported[0], 0).otherwise(1), "lang", "pref_label"))["pref_label"]
    by_lang = F.map_from_entries(F.sort_array(F.collect_list(F.struct("lang", "pref_label"))))
    names = index_labels(mine, supported).groupBy("uid").agg(best.alias("pref_label"), by_lang.alias("labels"), F.sort_array(F.flatten(F.collect_list("alt_labels"))).alias("alt_labels"))
    said = with_uid(mine.filter(F.col("p").isin(*DESCRIPTIONS, LOCATED_IN, URL))).groupBy("uid").agg(
        F.sort_array(F.collect_set(F.when(F.col("p").isin(*DESCRIPTIONS), F.col("o")))).alias("description"),
        F.sort_array(F.collect_set(F.when(F.col("p") == LOCATED_IN, F.col("o")))).alias("located_in"),
        F.min(F.when(F.col("p") == URL, F.struct("pos", "o")))["o"].alias("pref_url"),
    )
    points = index_geo(mine).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("kind", "lat", "long", "alt"))).alias("points"))
    docs = with_uid(records).withColumnsRenamed({"g": "dataset", "s": "uri"})
    for part in (own, inferred, names, said, points):
        docs = docs.join(part, "uid", "left")
    literals = single_valued(index_literals(mine, properties, supported))
    objects = index_object_labels(mine, quads if label_quads is None else label_quads)
    blank = {c: F.lit(None).cast(t) for c, t in (("lang", "string"), ("date", "timestamp"), ("int", "long"), ("float", "double"), ("pos", "long"))}
    as_fields = objects.select("uid", "attr", F.lit("object").alias("kind"), F.col("obj_label").alias("value"), "obj_uri", F.lit(False).alias("single_valued")).withColumns(blank)
    meta = index_reified(mine, statements).select("uid", F.concat_ws("&", "about_attr", "meta_attr").alias("attr"), F.lit("reify").alias("kind"), "value", F.col("about_value").alias("obj_uri"), F.lit(False).alias("single_valued")).withColumns(blank)
    fields = literals.withColumn("obj_uri", F.lit(None).cast("string")).unionByName(as_fields).unionByName(meta)
    return docs, fields
