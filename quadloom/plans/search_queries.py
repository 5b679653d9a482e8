"""Queries for filters, ranking, facets and record reads (F, R, G)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.uris import tokens
from quadloom.model import LABEL, LAT, LONG, PART_OF, TYPE
from quadloom.operators import index, rank, records, search
from quadloom.operators.ontology import class_closure
from quadloom.plans.fixtures import DS, ONTO, SUPPORTED, Tables
from quadloom.plans.record_queries import FIELDS, INFERRED, LOCAL, TYPES
from quadloom.plans.registry import query

TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
POINTS = f"SELECT md5('{DS}nation/' || '{DS}nation/' || n_nationkey) AS uid, CAST((n_nationkey * 7) % 120 - 60 AS DOUBLE) AS lat, CAST((n_nationkey * 13) % 300 - 150 AS DOUBLE) AS long FROM nation"
KM = "(2 * 6371.0 * asin(sqrt(least(pow(sin(radians({1} - lat) / 2), 2) + cos(radians(lat)) * cos(radians({1})) * pow(sin(radians({2} - long) / 2), 2), 1.0))))"


def docs_of(t: Tables, *names: str) -> DataFrame:
    """uid, dataset, uri, types, inferred_types, pref_label, points of the named sources."""
    quads = t.quads(*names)
    types = index.with_uid(quads.filter(F.col("p") == TYPE)).select("uid", F.col("g").alias("dataset"), F.col("s").alias("uri"), F.col("o").alias("type"))
    inferred = index.infer_types(types.select("uid", "type"), class_closure(t.class_edges)).groupBy("uid").agg(F.sort_array(F.collect_set("inferred")).alias("inferred_types"))
    labels = index.index_labels(quads, SUPPORTED).groupBy("uid").agg(F.min("pref_label").alias("pref_label"))
    points = index.index_geo(quads).groupBy("uid").agg(F.collect_list(F.struct("kind", "lat", "long", "alt")).alias("points"))
    rows = types.groupBy("uid", "dataset", "uri").agg(F.collect_set("type").alias("types"))
    return rows.join(inferred, "uid").join(labels, "uid").join(points, "uid", "left")


def fields_of(t: Tables, *names: str) -> DataFrame:
    quads = t.quads(*names)
    literals = index.index_literals(quads, t.properties, SUPPORTED).withColumn("obj_uri", F.lit(None).cast("string"))
    objects = index.index_object_labels(quads, t.quads("region", "nation", "customer", "part")).select("uid", "attr", F.lit("object").alias("kind"), F.col("obj_label").alias("value"), "obj_uri")
    return literals.unionByName(objects, allowMissingColumns=True)


def texts_of(t: Tables) -> DataFrame:
    return t.raw("documents").select(F.col("doc_id").cast("string").alias("uid"), "text")


WORD_ROWS = f"SELECT doc_id, unnest(list_distinct({TOKENS.format('text')})) AS w FROM documents"


@query("f1_filter_text", f"SELECT CAST(doc_id AS STRING) AS uid, 'and' AS op FROM ({WORD_ROWS}) WHERE w IN ('the', 'of', 'and') GROUP BY doc_id HAVING count(*) = 3 UNION ALL SELECT CAST(doc_id AS STRING), 'or::2' FROM ({WORD_ROWS}) WHERE w IN ('der', 'the', 'und', 'of') GROUP BY doc_id HAVING count(*) >= 2 UNION ALL SELECT CAST(doc_id AS STRING), 'or' FROM ({WORD_ROWS}) WHERE w IN ('der', 'une') GROUP BY doc_id")
def f1(t: Tables) -> DataFrame:
    texts = texts_of(t)
    parts = [search.filter_text(texts, "The of AND").withColumn("op", F.lit("and")), search.filter_text(texts, "der the und of", "or", 2).withColumn("op", F.lit("or::2")), search.filter_text(texts, "der une", "or").withColumn("op", F.lit("or"))]
    return parts[0].union(parts[1]).union(parts[2])


DOCS = f"SELECT md5(g || s) AS uid, g AS dataset, s AS uri, max(o) FILTER (p = '{TYPE}') AS type, coalesce(max(o) FILTER (p = '{LABEL}'), {LOCAL.format('s')}) AS label FROM quads GROUP BY g, s"


@query("f2_filter_dataset", f"SELECT uid FROM docs WHERE dataset IN ('{DS}part/', '{DS}nation/') AND dataset IN (SELECT a.dataset FROM access a JOIN memberships m ON m.\"group\" = a.\"group\" WHERE user_uri = '{DS}customer/7' AND r)", docs=DOCS)
def f2(t: Tables) -> DataFrame:
    from quadloom.operators.access import accessible_datasets

    return search.filter_dataset(docs_of(t, "region", "nation", "supplier", "part"), [f"{DS}part/", f"{DS}nation/"], accessible_datasets(t.access, t.memberships, f"{DS}customer/7"))


@query("f3_filter_type", f"SELECT DISTINCT uid FROM ({INFERRED}) WHERE inferred IN ('{ONTO}Agent', '{ONTO}Place')")
def f3(t: Tables) -> DataFrame:
    return search.filter_type(docs_of(t), [f"{ONTO}Agent", f"{ONTO}Place"])


@query("f4_filter_has_attribute", f"SELECT md5(g || s) AS uid FROM quads WHERE p IN ('{ONTO}acctbal', '{ONTO}nation') GROUP BY g, s HAVING count(DISTINCT p) = 2")
def f4(t: Tables) -> DataFrame:
    return search.filter_has_attribute(fields_of(t, "supplier", "customer", "part"), [f"{ONTO}acctbal", f"{ONTO}nation"], "and")


@query("f5_filter_attribute_text", f"SELECT md5(g || s) AS uid, 'words' AS way FROM quads WHERE p = '{ONTO}brand' AND list_contains({TOKENS.format('o')}, 'brand') AND list_contains({TOKENS.format('o')}, '12') UNION ALL SELECT md5(g || s), 'pattern' FROM quads WHERE p = '{ONTO}brand' AND lower(o) LIKE 'brand#1%'")
def f5(t: Tables) -> DataFrame:
    fields = fields_of(t, "part")
    return search.filter_attribute_text(fields, f"{ONTO}brand", "Brand 12").withColumn("way", F.lit("words")).union(search.filter_attribute_text(fields, f"{ONTO}brand", "BRAND#1*").withColumn("way", F.lit("pattern")))


SIZE = f"SELECT md5('{DS}part/' || '{DS}part/' || p_partkey) AS uid, p_size, p_brand, p_retailprice FROM part"


@query("f6_filter_attribute_number", "SELECT uid FROM size WHERE p_size BETWEEN 5 AND 20 UNION ALL SELECT uid FROM size WHERE p_size = 7 UNION ALL SELECT uid FROM size WHERE p_retailprice >= 1500", size=SIZE)
def f6(t: Tables) -> DataFrame:
    fields = fields_of(t, "part")
    return search.filter_attribute_number(fields, f"{ONTO}size", 5, 20).union(search.filter_attribute_number(fields, f"{ONTO}size", 7, 7)).union(search.filter_attribute_number(fields, f"{ONTO}retailprice", 1500, None))


@query("f7_filter_attribute_date", f"SELECT md5('{DS}orders/' || '{DS}orders/' || o_orderkey) AS uid FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-06-30' UNION ALL SELECT md5('{DS}orders/' || '{DS}orders/' || o_orderkey) FROM orders WHERE o_orderdate <= TIMESTAMP '1994-01-01'")
def f7(t: Tables) -> DataFrame:
    fields = fields_of(t, "orders")
    return search.filter_attribute_date(fields, f"{ONTO}orderdate", "1995-01-01", "1996-06-30").union(search.filter_attribute_date(fields, f"{ONTO}orderdate", None, "1994-01-01"))


@query("f8_filter_attribute_uri", f"SELECT md5(g || s) AS uid FROM quads WHERE p = '{ONTO}nation' AND o = '{DS}nation/3'")
def f8(t: Tables) -> DataFrame:
    return search.filter_attribute_uri(fields_of(t, "supplier", "customer"), f"{ONTO}nation", f"{DS}nation/3")


@query("f9_filter_core", f"SELECT uid FROM docs WHERE label = 'NATION_3' UNION ALL SELECT uid FROM ({TYPES}) WHERE type = '{ONTO}Supplier' UNION ALL SELECT uid FROM ({POINTS}) WHERE lat = -39 UNION ALL SELECT uid FROM docs WHERE dataset = '{DS}nation/' OR dataset = '{DS}supplier/'", docs=DOCS)
def f9(t: Tables) -> DataFrame:
    docs = docs_of(t, "nation", "supplier")
    out = search.filter_core(docs, "prefLabel", "NATION_3")
    for name, value in (("type", f"{ONTO}Supplier"), (LAT, "-39"), (LONG, "not a number")):
        out = out.union(search.filter_core(docs, name, value))
    return out


@query("f10_combine", f"SELECT uid, 'and' AS op FROM size WHERE p_size > 10 AND p_brand LIKE 'Brand#1%' UNION ALL SELECT uid, 'or' FROM size WHERE p_size > 10 OR p_brand LIKE 'Brand#1%'", size=SIZE)
def f10(t: Tables) -> DataFrame:
    fields = fields_of(t, "part")
    parts = [search.filter_attribute_number(fields, f"{ONTO}size", 11, None), search.filter_attribute_text(fields, f"{ONTO}brand", "Brand#1*")]
    return search.combine(parts, "and").withColumn("op", F.lit("and")).union(search.combine(parts, "or").withColumn("op", F.lit("or")))


@query("f11_filter_expression", "SELECT uid FROM size WHERE (p_size > 10 OR p_brand LIKE 'Brand#1%') AND NOT p_retailprice >= 1200", size=SIZE)
def f11(t: Tables) -> DataFrame:
    fields, docs = fields_of(t, "part"), index.with_uid(t.quads("part")).select("uid").distinct()
    size = search.Attr("size", search.filter_attribute_number(fields, f"{ONTO}size", 11, None))
    brand = search.Attr("brand", search.filter_attribute_text(fields, f"{ONTO}brand", "Brand#1*"))
    price = search.Attr("price", search.filter_attribute_number(fields, f"{ONTO}retailprice", 1200, None))
    return search.filter_expression(docs, search.And((search.Or((size, brand)), search.Not(price))), {"size", "brand", "price"})


@query("f12_autocomplete", "SELECT uid, label AS pref_label FROM docs WHERE starts_with(lower(label), 'nation_1') OR starts_with(lower(label), 'customer#00000001')", docs=DOCS)
def f12(t: Tables) -> DataFrame:
    docs = docs_of(t, "nation", "customer")
    return search.autocomplete(docs, "Nation_1").union(search.autocomplete(docs, "Customer#00000001"))


@query("f13_filter_distance", f"SELECT uid, 'km' AS unit FROM ({POINTS}) WHERE {KM.format('', '10.0', '20.0')} <= 6000 UNION ALL SELECT uid, 'miles' FROM ({POINTS}) WHERE {KM.format('', '10.0', '20.0')} <= 6000 * 1.60934")
def f13(t: Tables) -> DataFrame:
    docs = docs_of(t, "nation")
    return search.filter_distance(docs, 10, 20, 6000).withColumn("unit", F.lit("km")).union(search.filter_distance(docs, 10, 20, 6000, miles=True).withColumn("unit", F.lit("miles")))


@query("f14_filter_box", f"SELECT uid FROM ({POINTS}) WHERE lat BETWEEN -40 AND 30 AND long BETWEEN -100 AND 60")
def f14(t: Tables) -> DataFrame:
    return search.filter_box(docs_of(t, "nation"), 30, -100, -40, 60)


BM25 = f"""SELECT doc_id AS uid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score FROM (
SELECT t.doc_id, t.w, tf, len, count(*) OVER (PARTITION BY t.w) AS df, n, mean FROM (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS w FROM documents) WHERE w IN ('the', 'worthless', 'und') GROUP BY ALL) t
JOIN (SELECT doc_id, len({TOKENS.format('text')}) AS len FROM documents) l USING (doc_id), (SELECT count(*) AS n, avg(len({TOKENS.format('text')})) AS mean FROM documents)) GROUP BY doc_id"""


@query("r1_score_text", BM25)
def r1(t: Tables) -> DataFrame:
    texts = t.raw("documents").select(F.col("doc_id").alias("uid"), F.lit("text").alias("field"), "text")
    return rank.score_text(texts, "The worthless und").select("uid", F.round("score", 6).alias("score"))


@query("r2_boost", f"SELECT md5(g || s) AS uid, CAST(max(CASE WHEN p = '{TYPE}' AND o = '{ONTO}Supplier' THEN 2.0 ELSE 0 END) + max(CASE WHEN g = '{DS}customer/' THEN 0.5 ELSE 0 END) + max(CASE WHEN p = '{ONTO}acctbal' THEN 1.0 ELSE 0 END) + max(CASE WHEN p = '{ONTO}nation' AND o = '{DS}nation/1' THEN 4.0 ELSE 0 END) AS DOUBLE) AS boost FROM quads WHERE g IN ('{DS}supplier/', '{DS}customer/') GROUP BY g, s")
def r2(t: Tables) -> DataFrame:
    docs, fields = docs_of(t, "supplier", "customer"), fields_of(t, "supplier", "customer")
    return rank.boost(docs, {f"{ONTO}Supplier": 2}, {f"{DS}customer/": 0.5}, {f"{ONTO}acctbal": 1}, {(f"{ONTO}nation", "NATION_1"): 4}, fields)


@query("r3_boost_phrase", f"SELECT doc_id AS uid, CAST(3.0 AS DOUBLE) AS boost FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents)) WHERE list_contains(w[i:i + 2], 'of') AND list_contains(w[i:i + 2], 'the') GROUP BY doc_id")
def r3(t: Tables) -> DataFrame:
    fields = t.raw("documents").select(F.col("doc_id").alias("uid"), F.lit("text").alias("attr"), F.col("text").alias("value"))
    return rank.boost_phrase(fields, "of the", {"text": 3.0}, slop=1)


@query("r4_boost_near", f"SELECT uid, round(100.0 / greatest({KM.format('', '10.0', '20.0')}, 0.1), 6) AS boost FROM ({POINTS})")
def r4(t: Tables) -> DataFrame:
    return rank.boost_near(docs_of(t, "nation"), 10, 20).select("uid", F.round("boost", 6).alias("boost"))


SORTED = f"SELECT md5('{DS}part/' || '{DS}part/' || p_partkey) AS uid, p_size, p_name FROM part"


@query("r5_sort_records", "SELECT uid, p_name AS pref_label, row_number() OVER (ORDER BY p_size DESC, p_name, uid) AS rank FROM sorted", sorted=SORTED)
def r5b(t: Tables) -> DataFrame:
    """Every part with its place in the order; places are counted by sorted partition, not in one task."""
    ordered = rank.sort_records(docs_of(t, "part"), [f"{ONTO}size desc", "pref_label asc"], fields_of(t, "part")).select("uid", "pref_label")
    return t.spark.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + 1)), "uid string, pref_label string, rank long")


@query("r6_page", "SELECT uid, p_size FROM sorted ORDER BY p_size DESC, p_name, uid LIMIT 20 OFFSET 30", sorted=SORTED)
def r6(t: Tables) -> DataFrame:
    ordered = rank.page(rank.sort_records(docs_of(t, "part"), [f"{ONTO}size desc", "pref_label"], fields_of(t, "part")), 30, 20)
    return ordered.join(fields_of(t, "part").filter(F.col("attr") == f"{ONTO}size"), "uid").select("uid", F.col("int").cast("int").alias("p_size"))


@query("r7_project", f"SELECT md5(g || s) AS uid, p AS attr, o AS value FROM quads WHERE p IN ('{ONTO}size', '{ONTO}brand')")
def r7(t: Tables) -> DataFrame:
    return rank.project(fields_of(t, "part"), [f"{ONTO}size", f"{ONTO}brand"]).select("uid", "attr", "value")


@query("r8_count_hits", "SELECT count(*) AS n FROM part WHERE p_size BETWEEN 5 AND 20")
def r8(t: Tables) -> DataFrame:
    return rank.count_hits(search.filter_attribute_number(fields_of(t, "part"), f"{ONTO}size", 5, 20))


CORE = f"""SELECT 'type' AS kind, type AS value, count(*) AS n FROM docs GROUP BY ALL UNION ALL SELECT 'dataset', dataset, count(*) FROM docs GROUP BY dataset
UNION ALL SELECT 'attribute', p, count(DISTINCT g || s) FROM quads WHERE p NOT IN ('{TYPE}', '{LABEL}', '{LAT}', '{LONG}', 'http://example.org/vocab#description') GROUP BY p
UNION ALL SELECT 'inferred_type', inferred, count(*) FROM ({INFERRED}) WHERE inferred NOT IN (SELECT type FROM docs) GROUP BY inferred"""


@query("r9_facet_core", CORE, docs=DOCS)
def r9(t: Tables) -> DataFrame:
    return rank.facet_core(docs_of(t), fields_of(t))


FACETED = f"""SELECT q.p AS attr, CASE WHEN q.o_kind = 'uri' THEN q.o END AS uri, CASE WHEN q.o_kind = 'uri' THEN l.o ELSE q.o END AS label, q.g || q.s AS doc
FROM quads q LEFT JOIN (SELECT s, o FROM quads WHERE p = '{LABEL}') l ON l.s = q.o AND q.o_kind = 'uri' WHERE q.p IN ('{ONTO}brand', '{ONTO}nation', '{ONTO}priority')"""
FORM_SQL = "SELECT '{0}' AS form, attr, uri, label, n FROM (SELECT *, row_number() OVER (PARTITION BY attr ORDER BY n DESC, uri, label) AS r FROM (SELECT attr, {1} AS uri, {2} AS label, count(DISTINCT doc) AS n FROM faceted GROUP BY 1, 2, 3)) WHERE r <= 10"


@query(
    "r10_facet_values",
    " UNION ALL ".join(FORM_SQL.format(*x) for x in (("uri", "uri", "CASE WHEN uri IS NULL THEN label END"), ("literal", "CAST(NULL AS STRING)", "label"), ("uriliteral", "uri", "label"))),
    faceted=FACETED,
)
def r10(t: Tables) -> DataFrame:
    fields, attrs = fields_of(t, "part", "supplier", "customer", "orders"), [f"{ONTO}brand", f"{ONTO}nation", f"{ONTO}priority"]
    rows = [rank.facet_values(fields, attrs, form=form).select(F.lit(form).alias("form"), "attr", "uri", "label", "n") for form in rank.FORMS]
    return rows[0].union(rows[1]).union(rows[2])


@query("r11_search_results", f"SELECT uid, label AS pref_label, (SELECT count(DISTINCT attr) FROM ({FIELDS}) f WHERE f.uid = docs.uid) + (SELECT count(DISTINCT p) FROM quads WHERE o_kind = 'uri' AND p <> '{TYPE}' AND md5(g || s) = docs.uid) AS attrs FROM docs WHERE dataset IN ('{DS}nation/', '{DS}supplier/')", docs=DOCS)
def r11(t: Tables) -> DataFrame:
    out = rank.search_results(docs_of(t, "nation", "supplier"), fields_of(t, "nation", "supplier"))
    return out.select("uid", "pref_label", F.size("attributes").cast("long").alias("attrs"))


VOCABULARY = f"SELECT w AS term, count(*) AS freq FROM (SELECT unnest({TOKENS.format('text')}) AS w FROM documents) WHERE regexp_full_match(w, '[a-z]+') GROUP BY w"
WRONG = ("tha", "worthles", "zzzzz", "nicht", "eer", "quelle", "stupdi", "xhe", "bnd")


@query("r12_suggest", f"SELECT q.term, v.term AS suggestion, freq, levenshtein(q.term, v.term) AS edits FROM (VALUES {', '.join(f'({chr(39)}{w}{chr(39)})' for w in WRONG)}) q(term) JOIN vocabulary v ON abs(length(q.term) - length(v.term)) <= 2 WHERE levenshtein(q.term, v.term) <= 2 AND q.term NOT IN (SELECT term FROM vocabulary)", vocabulary=VOCABULARY)
def r12(t: Tables) -> DataFrame:
    vocabulary = t.raw("documents").select(F.explode(tokens(F.col("text"))).alias("term")).filter(F.col("term").rlike("^[a-z]+$")).groupBy("term").agg(F.count("*").alias("freq"))
    return rank.suggest(t.spark.createDataFrame([(w,) for w in WRONG], "term string"), vocabulary)


@query("r12_collate", f"SELECT term, suggestion FROM (SELECT q.term, v.term AS suggestion, row_number() OVER (PARTITION BY q.term ORDER BY levenshtein(q.term, v.term), -freq, v.term) AS r FROM (VALUES {', '.join(f'({chr(39)}{w}{chr(39)})' for w in WRONG)}) q(term) JOIN vocabulary v ON abs(length(q.term) - length(v.term)) <= 2 WHERE levenshtein(q.term, v.term) <= 2 AND q.term NOT IN (SELECT term FROM vocabulary)) WHERE r = 1", vocabulary=VOCABULARY)
def r12b(t: Tables) -> DataFrame:
    return rank.collate(r12(t))


KEYS = f"'{DS}nation/' || (n_nationkey * 2)"


@query("g1_read_records", f"SELECT g, s, p, md5(o) AS o FROM (SELECT DISTINCT g, s, p, o, o_kind, o_type, o_lang FROM quads) UNION ALL SELECT DISTINCT g, s, '{PART_OF}', md5(g) FROM quads")
def g1b(t: Tables) -> DataFrame:
    return records.read_records(t.quads(), t.quads().select("s", "g").distinct()).select("g", "s", "p", F.md5("o").alias("o"))


@query("g2_read_records_anywhere", "SELECT min(g) AS g, s, p, md5(o) AS o FROM quads GROUP BY s, p, o")
def g2b(t: Tables) -> DataFrame:
    quads = t.quads()
    twice = quads.withColumn("g", F.explode(F.array("g", F.lit(f"{DS}z/"))))
    return records.read_records_anywhere(twice, quads.select("s").distinct(), twice.select("g").distinct()).select("g", "s", "p", F.md5("o").alias("o"))


@query("g3_keep_language", "SELECT s, p, md5(o) AS o FROM quads WHERE o_lang IS NULL OR o_lang = 'fr'")
def g3(t: Tables) -> DataFrame:
    return records.keep_language(t.quads(), "fr").select("s", "p", F.md5("o").alias("o"))


@query("g4_keep_attributes", f"SELECT s, p, o FROM quads WHERE p IN ('{ONTO}brand', '{ONTO}nation', '{TYPE}')")
def g4(t: Tables) -> DataFrame:
    return records.keep_attributes(t.quads(), [f"{ONTO}brand", f"{ONTO}nation"]).select("s", "p", "o")


@query("g5_links_back", f"SELECT DISTINCT o AS uri, p, s, g FROM quads WHERE o_kind = 'uri' AND o IN (SELECT {KEYS} FROM nation) AND s NOT IN (SELECT {KEYS} FROM nation)")
def g5(t: Tables) -> DataFrame:
    uris = t.raw("nation").selectExpr(f"'{DS}nation/' || CAST(n_nationkey * 2 AS STRING) AS s")
    return records.links_back(t.quads(), uris)


@query("g6_attach_reification", f"SELECT q.s, q.o, string_agg(DISTINCT rei_o, '|' ORDER BY rei_o) AS quantities FROM quads q JOIN statements t ON t.s = q.s AND t.p = q.p AND t.o = q.o AND rei_p = '{ONTO}quantity' GROUP BY q.s, q.o")
def g6(t: Tables) -> DataFrame:
    out = records.attach_reification(t.quads("orders").filter(F.col("p") == f"{ONTO}part"), t.statements)
    return out.select("s", "o", F.concat_ws("|", F.col("reify")[f"{ONTO}quantity"]).alias("quantities"))
