"""Queries for sources, sinks, mapping and the index build (S, K, M, B)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions import uris
from quadloom.model import LABEL, LAT, LONG, PART_OF, POLYGON, THING, TYPE, VOCAB, XSD
from quadloom.operators import index, mapping
from quadloom.operators.ontology import class_closure
from quadloom.plans.fixtures import DS, ONTO, SUPPORTED, Tables
from quadloom.plans.registry import query
from quadloom.sinks import writers
from quadloom.sources import readers

LOCAL = "CASE WHEN contains({0}, '#') THEN regexp_extract({0}, '[^#]*$') ELSE regexp_extract({0}, '[^/]*$') END"
PLAIN = ("g", "s", "p", "o", "o_kind", "o_type", "o_lang")
COLUMNS = ", ".join(PLAIN)
QUOTED = "replace(replace(replace(o, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n')"
LINE = f"'<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'uri' THEN '<' || o || '>' ELSE '\"' || {QUOTED} || '\"' || CASE WHEN o_type IS NOT NULL THEN '^^<' || o_type || '>' WHEN o_lang IS NOT NULL THEN '@' || o_lang ELSE '' END END || ' .'"
IN = "g IN ('http://example.org/ds/part/', 'http://example.org/ds/nation/')"


def lang_sql(c: str) -> str:
    return f"CASE WHEN {c} IN ('en', 'fr') THEN {c} ELSE 'en' END"


@query("s1_read_ntriples", f"SELECT {COLUMNS} FROM quads WHERE {IN} OR g LIKE '{DS}documents/%'")
def s1(t: Tables) -> DataFrame:
    quads = t.quads("part", "nation", "documents")
    lines = writers.ntriples_lines(quads).withColumn("pos", F.lit(0))
    read, _ = readers.parse_ntriples(lines, "")
    home = F.when(F.col("s").contains("/documents/"), F.lit(None)).otherwise(F.concat(F.substring_index("s", "/", 5), F.lit("/")))
    docs = t.raw("documents").selectExpr(f"'{DS}documents/' || CAST(doc_id AS STRING) AS s", f"'{DS}documents/' || source || '/' AS dg")
    return read.join(docs, "s", "left").withColumn("g", F.coalesce("dg", home)).select(*PLAIN)


@query("s2_read_record_xml", f"SELECT {COLUMNS}, false AS said FROM quads WHERE {IN} AND o <> '' UNION ALL SELECT DISTINCT g, s, rei_p, rei_o, p, o, NULL, true FROM statements")
def s2(t: Tables) -> DataFrame:
    said = t.statements.select("g", "s", "p", "o", "rei_p", "rei_o")
    orders = t.quads("orders").filter(F.col("p") == f"{ONTO}part")
    lines = writers.record_xml_lines(t.quads("part", "nation").unionByName(orders), said)
    subjects = lines.select(F.from_xml("value", readers.SUBJECT_XML).alias("x")).select("x.*")
    quads, statements = readers.parse_record_xml(subjects)
    quads = quads.filter(F.col("p") != f"{ONTO}part").select(*PLAIN, F.lit(False).alias("said"))
    return quads.union(statements.select("g", "s", "rei_p", "rei_o", "p", "o", F.lit(None).cast("string"), F.lit(True)))


@query("s3_read_sectioned_csv", "SELECT p_partkey AS id, unnest(['name', 'size', 'note']) AS attr, unnest([p_name, CAST(p_size AS STRING), 'say \"' || p_brand || '\",' || chr(10) || 'twice']) AS cell FROM part")
def s3(t: Tables) -> DataFrame:
    part = t.raw("part")
    note = F.concat(F.lit('"say ""'), "p_brand", F.lit('"",\ntwice"'))
    row = F.concat_ws(",", F.col("p_partkey").cast("string"), F.concat(F.lit('"'), "p_name", F.lit('"')), F.col("p_size").cast("string"))
    body = part.groupBy("p_brand").agg(F.concat_ws("\n", F.collect_list(F.concat(row, F.lit("\n,,,"), note))).alias("body"))
    files = body.select(F.col("p_brand").alias("path"), F.concat(F.lit("&&recordList\n\n&id,&name,&size,&note\n"), "body").alias("content"))
    return readers.parse_sectioned_csv(files).select(F.col("id").cast("long").alias("id"), "attr", "cell")


NAMED = "SELECT c_custkey * 2 AS id, c_name AS name, 'nation/' || c_nationkey AS ref FROM customer UNION ALL SELECT doc_id * 2 + 1, text, 'source/' || source FROM documents WHERE text <> '' AND source IS NOT NULL"


@query("s4_read_record_json", "SELECT id, 'name' AS attr, 0 AS pos, md5(name) AS value, NULL AS ref, NULL AS near FROM named UNION ALL SELECT id, 'home', 0, NULL, '@' || ref, 'yes' FROM named UNION ALL SELECT id, 'tag', i, md5(ref || ' ' || i), NULL, NULL FROM named, range(3) r(i) UNION ALL SELECT id, 'type', 0, md5('Object'), NULL, NULL FROM named", named=NAMED)
def s4b(t: Tables) -> DataFrame:
    """Customers and documents in files of about 200 records, dealt by key."""
    customers = t.raw("customer").selectExpr("CAST(c_custkey AS LONG) * 2 AS id", "c_name AS name", "'nation/' || CAST(c_nationkey AS STRING) AS ref")
    named = customers.union(t.raw("documents").filter("text <> '' AND source IS NOT NULL").selectExpr("CAST(doc_id AS LONG) * 2 + 1", "text", "'source/' || source"))
    tags = F.array(*[F.concat("ref", F.lit(f" {i}")) for i in range(3)])
    record = F.struct(F.col("id").cast("string").alias("id"), "name", F.struct(F.concat(F.lit("@"), "ref").alias("ref"), F.lit("yes").alias("near")).alias("home"), tags.alias("tag"))
    bucket = F.pmod(F.xxhash64("id"), F.lit(named.count() // 200 + 1))
    files = named.groupBy(bucket.cast("string").alias("path")).agg(F.collect_list(record).alias("recordList"))
    files = files.select("path", F.to_json(F.struct(F.struct(F.lit("all").alias("prefLabel")).alias("dataset"), "recordList")).alias("content"))
    records, _, _ = readers.parse_record_json(files)
    return records.select(F.col("id").cast("long").alias("id"), "attr", "pos", F.md5("value").alias("value"), "ref", F.col("meta")["near"].alias("near"))


@query("s5_read_namespaces", f"SELECT DISTINCT 'p' || p_size AS prefix, '{DS}size/' || p_size || '#' AS uri FROM part WHERE p_size % 3 > 0")
def s5(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    line = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("p"), size, F.lit(",not an iri"))).otherwise(F.concat(F.lit("p"), size, F.lit(f",{DS}size/"), size, F.lit("#")))
    return readers.parse_namespaces(t.raw("part").select(line.alias("value"))).filter(F.col("uri").startswith(DS))


@query("k1_write_ntriples", f"SELECT {LINE} AS value FROM quads")
def k1(t: Tables) -> DataFrame:
    return writers.ntriples_lines(t.quads())


@query("k1_write_ntriples_statements", "SELECT count(*) AS n, count(DISTINCT split_part(value, ' ', 1)) AS nodes FROM (SELECT DISTINCT '_:b' || md5(s || p || o) || ' ' || x AS value FROM (SELECT s, p, o, unnest(['type', 'subject', 'predicate', 'object', rei_p || rei_o]) AS x FROM statements))")
def k1b(t: Tables) -> DataFrame:
    lines = writers.ntriples_lines(t.quads("region"), t.statements).filter(F.col("value").startswith("_:b"))
    return lines.agg(F.count("*").alias("n"), F.count_distinct(F.substring_index("value", " ", 1)).alias("nodes"))


XML = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query("k2_write_record_xml", f"""SELECT '<subject type="' || max(o) FILTER (p = '{TYPE}') || '" uri="' || s || '"><predicate type="{PART_OF}"><object uri="' || g || '"></object></predicate>' || string_agg('<predicate type="' || p || '"><object' || CASE WHEN o_kind = 'uri' THEN ' uri="' || {XML.format('o')} || '">' ELSE CASE WHEN o_type IS NULL THEN '' ELSE ' type="' || o_type || '"' END || '>' || {XML.format('o')} END || '</object></predicate>', '' ORDER BY p, pos, o) FILTER (p <> '{TYPE}') || '</subject>' AS value FROM quads WHERE {IN} GROUP BY g, s""")
def k2(t: Tables) -> DataFrame:
    return writers.record_xml_lines(t.quads("part", "nation"))


@query("k3_write_record_json", f"""SELECT '{{"uri":"' || s || '","type":"' || max(o) FILTER (p = '{TYPE}') || '","predicate":[' || string_agg('{{"' || p || '":' || CASE WHEN o_kind = 'uri' THEN '{{"uri":"' || o || '"}}' WHEN o_type IS NOT NULL THEN '{{"value":"' || o || '","type":"' || o_type || '"}}' ELSE '"' || o || '"' END || '}}', ',' ORDER BY p, pos, o) FILTER (p <> '{TYPE}') || ']}}' AS value FROM quads WHERE {IN} GROUP BY g, s""")
def k3(t: Tables) -> DataFrame:
    return writers.record_json_lines(t.quads("part", "nation"))


HOLDERS = f"""SELECT g, s, max(o) FILTER (p = '{TYPE}') AS cls, max(o) FILTER (p = '{LABEL}') AS name, max(o) FILTER (p = '{ONTO}acctbal') AS bal, max(o) FILTER (p = '{ONTO}nation') AS nation FROM quads WHERE g IN ('{DS}supplier/', '{DS}customer/') GROUP BY g, s"""


@query("k4_write_sectioned_csv", f"""SELECT s || ',@@onto:' || {LOCAL.format('cls')} || ',' || bal || ',@@' || nation || ',' || name AS value FROM holders
UNION ALL SELECT '&&recordList' UNION ALL SELECT '&id,&type,&onto:acctbal,&onto:nation,&v:prefLabel'""", holders=HOLDERS)
def k4b(t: Tables) -> DataFrame:
    prefixes = t.spark.createDataFrame([("onto", ONTO), ("v", VOCAB)], "prefix string, uri string")
    return writers.sectioned_csv_lines(t.quads("supplier", "customer"), prefixes)[0]


@query("k5_write_linked_json", f"""SELECT '{{"id":"' || {LOCAL.format('s')} || '","acctbal":["' || bal || '"],"name":["' || name || '"],"nation":["@@' || nation || '"],"type":["' || CASE WHEN cls = '{ONTO}Supplier' THEN 'Vendor' ELSE {LOCAL.format('cls')} END || '"]}}' AS value FROM holders""", holders=HOLDERS)
def k5b(t: Tables) -> DataFrame:
    linkage = t.spark.createDataFrame([("attribute", "name", LABEL), ("type", "Vendor", f"{ONTO}Supplier")], "kind string, name string, map_to string")
    return writers.linked_json_lines(t.quads("supplier", "customer"), linkage)


@query("k6_write_triple_tsv", "SELECT replace(s, '/', '%2F') || '/' || replace(p, '/', '%2F') || '/' || replace(o, '/', '%2F') AS value FROM quads")
def k6(t: Tables) -> DataFrame:
    return writers.triple_tsv_lines(t.quads(), "/")


def _tag(uri: str, head: str, body: str) -> str:
    name = f"'n:' || {LOCAL.format(uri)}"
    return f"'<' || {name} || ' xmlns:n=\"' || left({uri}, length({uri}) - length({LOCAL.format(uri)})) || '\"' || {head} || '>' || {body} || '</' || {name} || '>'"


RDF_VALUE = _tag("p", "CASE WHEN o_kind = 'uri' THEN ' rdf:resource=\"' || o || '\"' WHEN o_type IS NOT NULL THEN ' rdf:datatype=\"' || o_type || '\"' ELSE '' END", "CASE WHEN o_kind = 'uri' THEN '' ELSE " + XML.format("o") + " END")
RDF_RECORD = _tag("cls", "' rdf:about=\"' || s || '\"'", "body")


@query("k7_write_rdfxml", f"SELECT {RDF_RECORD} AS value FROM (SELECT s, max(o) FILTER (p = '{TYPE}') AS cls, string_agg({RDF_VALUE}, '' ORDER BY p, pos, o) FILTER (p <> '{TYPE}') AS body FROM quads WHERE {IN} GROUP BY g, s)")
def k7(t: Tables) -> DataFrame:
    return writers.rdfxml_lines(t.quads("part", "nation"))


def cells(t: Tables) -> DataFrame:
    """Cells of parts: names with their words as values, a reference, an external reference, and annotations."""
    words = F.regexp_replace("p_name", " ", "||")
    rows = F.array(*[F.struct(F.lit(a).alias("attr"), v.alias("value")) for a, v in (("word", words), ("word&n", F.regexp_replace(F.regexp_replace("p_name", "[a-z]", "x"), " ", "||")), ("brand", F.concat(F.lit("@brand/"), "p_brand")), ("size", F.col("p_size").cast("string")), ("seen", F.concat(F.lit("@@http://example.org/x/"), F.col("p_size").cast("string"))))])
    return t.raw("part").select(F.col("p_partkey").alias("rec"), F.inline(rows)).withColumn("value_pos", F.lit(0))


WORDS = "SELECT rec, i - 1 AS value_pos, w[i] AS value, x[i] AS n FROM (SELECT p_partkey AS rec, string_split(p_name, ' ') AS w, string_split(regexp_replace(p_name, '[a-z]', 'x', 'g'), ' ') AS x, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part)"


@query("m1_split_values", f"SELECT rec, value_pos, value FROM ({WORDS}) WHERE value <> ''")
def m1(t: Tables) -> DataFrame:
    return mapping.split_values(cells(t).filter("attr = 'word'")).select("rec", "value_pos", "value")


@query("m2_attach_reify_columns", f"SELECT rec, value_pos, value, n FROM ({WORDS}) WHERE value <> ''")
def m2(t: Tables) -> DataFrame:
    out = mapping.attach_reify_columns(mapping.split_values(cells(t).filter("attr LIKE 'word%'")))
    return out.select("rec", "value_pos", "value", F.col("meta")["n"][0].alias("n"))


def linkage(t: Tables) -> DataFrame:
    """A linkage row for each brand and size of the parts, some with a prefix that is not defined."""
    part = t.raw("part").select("p_brand", "p_size").distinct()
    return part.select(F.lit("attribute").alias("kind"), F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string")).alias("name"), F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("onto:size"), F.col("p_size").cast("string"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("foo:x"), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit(ONTO), "p_brand")).alias("map_to"), F.col("p_size").alias("ord"), F.col("p_brand").alias("linked_type"))


def prefixes(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("onto", ONTO), ("ds", DS)], "prefix string, uri string")


@query("m3_resolve_linkage", f"SELECT name, CASE WHEN s % 3 = 0 THEN '{ONTO}size' || s WHEN s % 3 = 2 THEN '{ONTO}' || b END AS map_to, CASE WHEN s % 3 = 1 THEN 'undefined prefix foo' END AS error FROM (SELECT DISTINCT p_brand AS b, p_size AS s, p_brand || '-' || p_size AS name FROM part)")
def m3(t: Tables) -> DataFrame:
    return mapping.resolve_linkage(linkage(t), prefixes(t)).select("name", "map_to", "error")


@query("m4_merge_linkage", "SELECT p_brand AS linked_type, min(p_size) AS ord FROM part GROUP BY p_brand")
def m4(t: Tables) -> DataFrame:
    return mapping.merge_linkage(linkage(t).withColumn("name", F.lit("size"))).select("linked_type", "ord")


@query("m5_map_attributes", f"SELECT rec, CASE attr WHEN 'brand' THEN '{ONTO}brand' WHEN 'size' THEN '{ONTO}size' ELSE '{DS}properties/' || attr END AS p, value FROM (SELECT p_partkey AS rec, unnest(['brand', 'size', 'seen']) AS attr, unnest(['@brand/' || p_brand, CAST(p_size AS STRING), '@@http://example.org/x/' || p_size]) AS value FROM part)")
def m5(t: Tables) -> DataFrame:
    known = t.spark.createDataFrame([("attribute", "brand", f"{ONTO}brand"), ("attribute", "size", f"{ONTO}size"), ("type", "seen", f"{ONTO}Seen")], "kind string, name string, map_to string")
    return mapping.map_attributes(cells(t).filter("attr IN ('brand', 'size', 'seen')"), known, f"{DS}properties/").select("rec", "p", "value")


@query("m6_map_types", f"SELECT c_custkey AS rec, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '{ONTO}' || c_mktsegment ELSE '{THING}' END AS class FROM customer")
def m6(t: Tables) -> DataFrame:
    known = t.spark.createDataFrame([("type", x, f"{ONTO}{x}") for x in ("BUILDING", "MACHINERY")], "kind string, name string, map_to string")
    return mapping.map_types(t.raw("customer").select(F.col("c_custkey").alias("rec"), F.col("c_mktsegment").alias("type")), known).select("rec", "class")


@query("m7_resolve_references", f"SELECT p_partkey AS rec, unnest(['{DS}part/brand/' || p_brand, CAST(p_size AS STRING), 'http://example.org/x/' || p_size]) AS o, unnest(['uri', 'literal', 'uri']) AS o_kind FROM part")
def m7(t: Tables) -> DataFrame:
    return mapping.resolve_references(cells(t).filter("attr IN ('brand', 'size', 'seen')"), f"{DS}part/").select("rec", "o", "o_kind")


@query("m8_reify_statements", f"SELECT md5(s || p || o) AS stmt, count(*) + 4 AS n FROM (SELECT DISTINCT s, p, o, rei_p, rei_o FROM statements WHERE rei_p = '{ONTO}quantity') GROUP BY s, p, o")
def m8(t: Tables) -> DataFrame:
    said = t.statements.filter(F.col("rei_p") == f"{ONTO}quantity")
    return mapping.reify_statements(said.select("s", "p", "o", F.create_map("rei_p", F.array("rei_o")).alias("meta"))).groupBy("stmt").agg(F.count("*").alias("n"))


@query("m9_quads_to_records", f"""SELECT g, s, string_agg(o, '|' ORDER BY pos) FILTER (p = '{TYPE}') AS types, coalesce(max(o) FILTER (p = '{LABEL}'), {LOCAL.format('s')}) AS label, count(DISTINCT p) FILTER (p NOT IN ('{TYPE}', '{LABEL}')) AS attributes, coalesce(count(*) FILTER (p NOT IN ('{TYPE}', '{LABEL}')), 0) AS n FROM quads WHERE g NOT LIKE '{DS}documents/%' GROUP BY g, s""")
def m9(t: Tables) -> DataFrame:
    records = mapping.quads_to_records(t.quads("region", "nation", "supplier", "customer", "part", "orders"))
    values = F.aggregate(F.map_values("attributes"), F.lit(0).cast("long"), lambda a, v: a + F.size(v))
    return records.select("g", "s", F.concat_ws("|", "types").alias("types"), F.col("pref_label").alias("label"), F.size("attributes").cast("long").alias("attributes"), values.alias("n"))


@query("m9_records_to_quads", f"SELECT g, s, p, o, o_kind, o_type FROM quads WHERE {IN} AND p <> '{LABEL}'")
def m9b(t: Tables) -> DataFrame:
    return mapping.records_to_quads(mapping.quads_to_records(t.quads("part", "nation"))).select("g", "s", "p", "o", "o_kind", "o_type")


@query("m10_prefixize", "SELECT p, count(*) AS n, CASE WHEN starts_with(p, '" + ONTO + "') THEN 'onto:' || substring(p, length('" + ONTO + "') + 1) ELSE x || ':' || " + LOCAL.format("p") + " END AS prefixed FROM quads LEFT JOIN (SELECT b, 'ns' || (row_number() OVER (ORDER BY b) - 1) AS x FROM (SELECT DISTINCT left(p, length(p) - length(" + LOCAL.format("p") + ")) AS b FROM quads WHERE NOT starts_with(p, '" + ONTO + "'))) u ON u.b = left(p, length(p) - length(" + LOCAL.format("p") + ")) GROUP BY ALL")
def m10(t: Tables) -> DataFrame:
    counted = t.quads().groupBy("p").agg(F.count("*").alias("n"))
    return mapping.prefixize(counted, "p", prefixes(t)).select("p", "n", "prefixed")


@query("m10_unprefixize", f"SELECT p_partkey AS k, CASE p_size % 3 WHEN 0 THEN '{ONTO}' || p_size WHEN 1 THEN NULL ELSE '{DS}' || p_size END AS \"full\" FROM part")
def m10b(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    short = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("onto:"), size)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("foo:"), size)).otherwise(F.concat(F.lit(DS), size))
    return mapping.unprefixize(t.raw("part").select(F.col("p_partkey").alias("k"), short.alias("c")), "c", prefixes(t)).select("k", "full")


@query("m11_local_name", f"SELECT DISTINCT o, {LOCAL.format('o')} AS name, trim(regexp_replace(regexp_replace({LOCAL.format('o')}, '[^A-Za-z0-9]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')) AS readable FROM quads WHERE o_kind = 'uri'")
def m11(t: Tables) -> DataFrame:
    rows = t.quads().filter("o_kind = 'uri'").select("o").distinct()
    return rows.select("o", uris.local_name(F.col("o")).alias("name"), uris.readable_name(F.col("o")).alias("readable"))


@query("m12_pref_label", f"SELECT s, coalesce(max(o) FILTER (p = '{LABEL}'), {LOCAL.format('s')}) AS label, coalesce(max(o) FILTER (p = '{VOCAB}description'), 'No description available') AS description, 0 AS alts FROM quads GROUP BY s")
def m12(t: Tables) -> DataFrame:
    quads = t.quads()
    alts = mapping.alt_labels(quads).groupBy("s").agg(F.count("*").cast("int").alias("alts"))
    return mapping.pref_label(quads).join(mapping.description(quads), "s").join(alts, "s", "left").select("s", "label", "description", F.coalesce("alts", F.lit(0)).alias("alts"))


@query("m13_is_valid_iri", """SELECT p, valid, count(*) AS n FROM (SELECT p, regexp_matches(o, '^[A-Za-z][A-Za-z0-9+.-]*:[^\\s<>"{}|^`\\\\]+$') AS valid FROM quads) GROUP BY ALL""")
def m13(t: Tables) -> DataFrame:
    return t.quads().select("p", uris.is_valid_iri(F.col("o")).alias("valid")).groupBy("p", "valid").agg(F.count("*").alias("n"))


@query("m14_safe_date", "SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(date_trunc('day', o_orderdate), '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(date_trunc('year', o_orderdate), '%Y-%m-%dT%H:%M:%SZ') END AS d FROM orders")
def m14(t: Tables) -> DataFrame:
    way = F.col("o_orderkey") % 4
    text = F.when(way == 0, uris.iso(F.col("o_orderdate"))).when(way == 1, F.date_format("o_orderdate", "yyyy/MM/dd")).when(way == 2, F.date_format("o_orderdate", "yyyy")).otherwise(F.lit("May 1"))
    return t.raw("orders").select(F.col("o_orderkey").alias("k"), uris.iso(uris.safe_date(text)).alias("d"))


@query("b1_doc_id", "SELECT DISTINCT g, s, md5(g || s) AS uid FROM quads")
def b1(t: Tables) -> DataFrame:
    return index.with_uid(t.quads()).select("g", "s", "uid").distinct()


@query("b2_classify_subjects", f"SELECT DISTINCT g, s, CASE WHEN s LIKE '%/part/1%' THEN 'dataset' WHEN s LIKE '%/nation/1%' THEN 'statement' ELSE 'record' END AS class FROM quads WHERE s NOT LIKE '{DS}region/%' AND {IN}")
def b2(t: Tables) -> DataFrame:
    quads = t.quads("part", "nation", "region").withColumn("o", F.when((F.col("p") == TYPE) & F.col("s").contains("/part/1"), "http://purl.org/dc/terms/Dataset").when((F.col("p") == TYPE) & F.col("s").contains("/nation/1"), "http://www.w3.org/1999/02/22-rdf-syntax-ns#Statement").otherwise(F.col("o")))
    return index.classify_subjects(quads.withColumn("s", F.regexp_replace("s", f"^{DS}region/", "_:")))


@query("b3_route_language", f"SELECT o_lang, {lang_sql('o_lang')} AS routed, count(*) AS n FROM quads GROUP BY ALL")
def b3(t: Tables) -> DataFrame:
    return t.quads().select("o_lang", uris.route_language(F.col("o_lang"), SUPPORTED).alias("routed")).groupBy("o_lang", "routed").agg(F.count("*").alias("n"))


@query("b4_index_labels", f"SELECT md5(g || s) AS uid, {lang_sql('max(o_lang) FILTER (p = ' + chr(39) + LABEL + chr(39) + ')')} AS lang, coalesce(max(o) FILTER (p = '{LABEL}'), {LOCAL.format('s')}) AS pref_label, 0 AS alts FROM quads GROUP BY g, s")
def b4(t: Tables) -> DataFrame:
    return index.index_labels(t.quads(), SUPPORTED).select("uid", "lang", "pref_label", F.size("alt_labels").alias("alts"))


@query("b5_index_descriptions", f"SELECT md5(g || s) AS uid, {lang_sql('o_lang')} AS lang, md5(o) AS description FROM quads WHERE p = '{VOCAB}description'")
def b5(t: Tables) -> DataFrame:
    return index.index_descriptions(t.quads("documents"), SUPPORTED).withColumn("description", F.md5("description"))




@query("b6_index_geo", f"""SELECT md5('{DS}nation/' || '{DS}nation/' || n_nationkey) AS uid, 'point' AS kind, CAST((n_nationkey * 7) % 120 - 60 AS DOUBLE) AS lat, CAST((n_nationkey * 13) % 300 - 150 AS DOUBLE) AS long FROM nation
UNION ALL SELECT md5('{DS}nation/' || '{DS}nation/' || n_nationkey), 'polygon', unnest([1.5, 2.5, 3.5]), unnest([CAST(n_nationkey AS DOUBLE), n_nationkey + 1.0, n_nationkey + 2.0]) FROM nation""")
def b6(t: Tables) -> DataFrame:
    quads = t.quads("nation")
    n = F.col("n_nationkey")
    corners = F.concat_ws(" ", *[F.concat((n + k).cast("string"), F.lit(f",{k + 1}.5,9")) for k in range(3)], F.lit("x,y"))
    none = F.lit(None).cast("string")
    shapes = t.raw("nation").select(F.lit(f"{DS}nation/").alias("g"), F.concat(F.lit(f"{DS}nation/"), n.cast("string")).alias("s"), F.lit(POLYGON).alias("p"), corners.alias("o"), F.lit("literal").alias("o_kind"), none.alias("o_type"), none.alias("o_lang"), F.lit(9).cast("long").alias("pos"))
    return index.index_geo(quads.unionByName(shapes)).select("uid", "kind", "lat", "long")


FIELDS = f"""SELECT md5(g || s) AS uid, p AS attr, CASE WHEN "range" = '{XSD}dateTime' THEN 'date' WHEN "range" = '{XSD}int' THEN 'int' WHEN "range" = '{XSD}float' THEN 'float' ELSE 'text' END AS kind, o AS value, coalesce(max_card, 0) = 1 AS single_valued, pos FROM quads LEFT JOIN properties ON uri = p WHERE o_kind = 'literal' AND p NOT IN ('{LABEL}', '{VOCAB}description', '{LAT}', '{LONG}')"""


@query("b7_index_literals", f"SELECT uid, attr, kind, value, CASE WHEN kind = 'date' THEN value END AS date, CASE WHEN kind = 'int' THEN CAST(value AS BIGINT) END AS \"int\", CASE WHEN kind = 'float' THEN round(CAST(value AS DOUBLE), 6) END AS \"float\", single_valued FROM ({FIELDS})")
def b7(t: Tables) -> DataFrame:
    rows = index.index_literals(t.quads(), t.properties, SUPPORTED)
    return rows.select("uid", "attr", "kind", "value", uris.iso(F.col("date")).alias("date"), "int", F.round(F.col("float"), 6).alias("float"), "single_valued")


@query("b8_single_valued", f"SELECT s AS uid, min(CAST(o AS INT)) AS first FROM quads WHERE p = '{ONTO}size' GROUP BY s")
def b8(t: Tables) -> DataFrame:
    sizes = t.quads("part").filter(F.col("p") == f"{ONTO}size")
    more = sizes.unionByName(sizes.withColumns({"o": F.lit("999"), "pos": F.col("pos") + 5}))
    rows = more.select(F.col("s").alias("uid"), F.col("p").alias("attr"), F.col("o").alias("value"), F.lit(True).alias("single_valued"), "pos")
    return index.single_valued(rows).select("uid", F.col("value").cast("int").alias("first"))


@query("b9_index_object_labels", f"SELECT md5(q.g || q.s) AS uid, q.p AS attr, q.o AS obj_uri, coalesce(l.o, {LOCAL.format('q.o')}) AS obj_label, q.o || '::' || coalesce(l.o, {LOCAL.format('q.o')}) AS facet FROM quads q LEFT JOIN (SELECT s, o FROM quads WHERE p = '{LABEL}') l ON l.s = q.o WHERE q.o_kind = 'uri' AND q.p <> '{TYPE}'")
def b9(t: Tables) -> DataFrame:
    return index.index_object_labels(t.quads("nation", "supplier", "customer", "part", "orders"), t.quads("region", "nation", "customer", "part"))


@query("b10_index_reified", "SELECT md5(q.g || q.s) AS uid, rei_p AS meta_attr, q.p AS about_attr, q.o AS about_value, rei_o AS value FROM quads q JOIN statements t ON t.s = q.s AND t.p = q.p AND t.o = q.o")
def b10(t: Tables) -> DataFrame:
    return index.index_reified(t.quads("orders"), t.statements)


TYPES = f"SELECT md5(g || s) AS uid, o AS type FROM quads WHERE p = '{TYPE}'"
INFERRED = f"SELECT uid, type AS inferred FROM ({TYPES}) UNION SELECT uid, '{THING}' FROM ({TYPES}) UNION SELECT uid, super FROM ({TYPES}) JOIN class_closure ON sub = type"


def type_rows(t: Tables, *names: str) -> DataFrame:
    return index.with_uid(t.quads(*names).filter(F.col("p") == TYPE)).select("uid", F.col("o").alias("type"))


@query("b11_infer_types", INFERRED)
def b11(t: Tables) -> DataFrame:
    return index.infer_types(type_rows(t), class_closure(t.class_edges))


@query("b12_property_metadata", "SELECT c || '-in' AS uri, 1 AS max_card, c AS \"range\" FROM (SELECT DISTINCT sub AS c FROM class_edges) UNION SELECT sub || '-in', 1, super FROM class_closure JOIN (SELECT DISTINCT sub AS c FROM class_edges) ON c = sub")
def b12(t: Tables) -> DataFrame:
    properties = t.class_edges.select(F.concat("sub", F.lit("-in")).alias("uri"), F.lit(1).alias("max_card"), F.col("sub").alias("range")).distinct()
    return index.property_metadata(properties, class_closure(t.class_edges))


@query("b13_field_catalog", f"SELECT attr, kind, count(DISTINCT uid) AS n FROM ({FIELDS}) GROUP BY ALL")
def b13(t: Tables) -> DataFrame:
    return index.field_catalog(index.index_literals(t.quads(), t.properties, SUPPORTED)).select("attr", "kind", "n")


@query("b14_build_index", f"""SELECT md5(g || s) AS uid, g AS dataset, s AS uri, coalesce(max(o) FILTER (p = '{LABEL}'), {LOCAL.format('s')}) AS pref_label, max(o) FILTER (p = '{TYPE}') AS type, (SELECT string_agg(inferred, '|' ORDER BY inferred) FROM ({INFERRED}) i WHERE i.uid = md5(g || s)) AS inferred FROM quads GROUP BY g, s""")
def b14c(t: Tables) -> DataFrame:
    docs, _ = index.build_index(t.quads(), t.statements, t.properties, class_closure(t.class_edges), SUPPORTED)
    return docs.select("uid", "dataset", "uri", "pref_label", F.get("types", F.lit(0)).alias("type"), F.concat_ws("|", "inferred_types").alias("inferred"))


@query("b14_build_index_fields", f"SELECT uid, attr, kind, md5(value) AS value FROM ({FIELDS}) WHERE kind <> 'x' UNION ALL SELECT md5(q.g || q.s), q.p, 'object', md5(coalesce(l.o, {LOCAL.format('q.o')})) FROM quads q LEFT JOIN (SELECT s, o FROM quads WHERE p = '{LABEL}') l ON l.s = q.o WHERE q.o_kind = 'uri' AND q.p <> '{TYPE}' UNION ALL SELECT md5(g || s), p || '&' || rei_p, 'reify', md5(rei_o) FROM statements")
def b14b(t: Tables) -> DataFrame:
    _, fields = index.build_index(t.quads(), t.statements, t.properties, class_closure(t.class_edges), SUPPORTED)
    return fields.select("uid", "attr", "kind", F.md5("value").alias("value"))
