"""Readers of record files. Each has a parse_* half that takes a DataFrame of file content, so tables can feed it too."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions.uris import is_valid_iri
from quadloom.model import PART_OF, TYPE
from quadloom.operators.lineage import written

#: A quote that no odd run of backslashes stands before.
_CLOSE = '"(?<!(?<!\\\\)(?:\\\\\\\\){0,99}\\\\")'
TRIPLE = '^\\s*(?:<([^>\\s]*)>|(_:\\S+))\\s+<([^>\\s]*)>\\s+(?:<([^>\\s]*)>|(_:\\S+?)|"(.*?)' + _CLOSE + '(?:@([A-Za-z0-9-]+)|\\^\\^<([^>\\s]*)>)?)\\s*\\.\\s*(?:#.*)?$'
#: Escapes of the format: single characters, and code points that are characters.
_CODE = "u(?![dD][89a-fA-F])[0-9A-Fa-f]{4}|U(?!0000[dD][89a-fA-F])00(?:0[0-9A-Fa-f]|10)[0-9A-Fa-f]{4}"
ESCAPE = f"""\\\\(?:[tbnrf"'\\\\]|{_CODE})"""
_PIECE = f"{ESCAPE}|[^\\\\]+"
_SIGNS = {"\\t": "\t", "\\b": "\b", "\\n": "\n", "\\r": "\r", "\\f": "\f"}
#: Prefixes that need no table.
BUILT_IN = {"rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", "xsd": "http://www.w3.org/2001/XMLSchema#", "dcterms": "http://purl.org/dc/terms/", "skos": "http://www.w3.org/2004/02/skos/core#", "foaf": "http://xmlns.com/foaf/0.1/", "geo": "http://www.w3.org/2003/01/geo/wgs84_pos#"}


def unescape(text: Column) -> Column:
    """The text with its escapes decoded, from left to right."""

    def decoded(piece: Column) -> Column:
        out = F.when(piece.rlike("^\\\\[uU]"), F.decode(F.unhex(F.lpad(F.substring(piece, 3, 8), 8, "0")), "UTF-32"))
        for code, sign in _SIGNS.items():
            out = out.when(piece == code, F.lit(sign))
        return out.when(piece.startswith("\\"), F.substring(piece, 2, 1)).otherwise(piece)

    pieces = F.transform(F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0)), decoded)
    return F.when(text.contains("\\"), F.array_join(pieces, "")).otherwise(text)


def parse_ntriples(lines: DataFrame, graph: str) -> tuple[DataFrame, DataFrame]:
    """(quads, errors) of lines (value, pos; file, if blank nodes of several files are to be kept apart): blank lines and comments
    are skipped, malformed lines and unknown escapes are errors."""
    lines = lines.filter(~F.col("value").rlike("^\\s*(#.*)?$"))
    # one match a line: no group holds a line break, so breaks keep the groups apart; behind an explode nothing is matched again
    groups = F.when(F.col("value").rlike(TRIPLE), F.split(F.regexp_replace("value", TRIPLE, "$1\n$2\n$3\n$4\n$5\n$7\n$8\n$6"), "\n"))
    lines = lines.withColumn("_groups", F.explode(F.array(groups)))
    found = [F.get("_groups", F.lit(k)) for k in (0, 1, 2, 3, 4, 7, 5, 6)]
    part, quoted = [F.nullif(x, F.lit("")) for x in found], F.coalesce(found[5], F.lit(""))
    # what is left without escapes holds no quote and no backslash
    bare = F.regexp_replace(F.concat_ws(" ", part[0], part[2], part[3], part[7], quoted), ESCAPE, "")
    good = F.col("_groups").isNotNull() & ~bare.contains('"') & ~bare.contains("\\")
    uri, blank = unescape(part[3]), part[4]
    kind = F.when(uri.isNotNull(), "uri").when(blank.isNotNull(), "bnode").otherwise("literal")
    if "file" in lines.columns:
        own = lambda node: F.concat(F.lit("_:"), F.md5("file"), F.lit("-"), F.substring(node, 3, 1 << 20))
    else:
        own = lambda node: node
    quads = lines.filter(good).select(
        F.lit(graph).alias("g"), F.coalesce(unescape(part[0]), own(part[1])).alias("s"), unescape(part[2]).alias("p"), F.coalesce(uri, own(blank), unescape(quoted)).alias("o"),
        kind.alias("o_kind"), unescape(part[7]).alias("o_type"), part[6].alias("o_lang"), F.col("pos").cast("long").alias("pos"),
    )
    return quads, lines.filter(~good).select(F.col("value").alias("line"), F.col("pos").cast("long").alias("pos"), F.lit("malformed triple").alias("error"))


def read_ntriples(spark: SparkSession, path: str, graph: str) -> tuple[DataFrame, DataFrame]:
    """parse_ntriples of all lines of the files; a blank node is one of its file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_ntriples(lines.withColumn("pos", F.monotonically_increasing_id()), graph)


SUBJECT_XML = "_type string, _uri string, predicate array<struct<_type:string,object:array<struct<_VALUE:string,_uri:string,_type:string,_lang:string,reify:array<struct<_type:string,_value:string>>>>,reify:array<struct<_type:string,_value:string>>>>"


def parse_record_xml(subjects: DataFrame, prefixes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(quads, statements) of subjects (columns of SUBJECT_XML, pos). The dataset is the record's isPartOf, else
    'unspecified'. reify stands inside URI objects and beside literals; all of them are kept. Subjects are parsed once and
    written into the shared folder, as both results read them twice."""
    subjects = written(subjects.select("_type", "_uri", "predicate"), "subjects")
    none, no_meta = F.lit(None).cast("string"), F.array().cast("array<struct<_type:string,_value:string>>")

    def entry(p: Column, x: Column, pos: Column, meta: Column) -> Column:
        return F.struct(p.alias("p"), x.alias("x"), pos.alias("pos"), meta.alias("meta"))

    def objects(q: Column, k: Column) -> Column:
        beside = F.coalesce(q["reify"], no_meta)
        return F.transform(F.coalesce(q["object"], F.array()), lambda x: entry(q["_type"], F.struct(x["_VALUE"], x["_uri"], x["_type"], x["_lang"]), k + 1, F.concat(beside, F.coalesce(x["reify"], no_meta))))

    own = F.struct(none.alias("_VALUE"), F.col("_type").alias("_uri"), none.alias("_type"), none.alias("_lang"))
    types = F.when(F.col("_type").isNotNull(), F.array(entry(F.lit(TYPE), own, F.lit(0), no_meta)))
    listed = F.flatten(F.transform("predicate", objects))
    rows = subjects.select(F.col("_uri").alias("s"), F.inline(F.concat(F.coalesce(types, F.array()), F.coalesce(listed, F.array()))))
    if prefixes is not None:
        for c in ("p",):
            m = prefixes.select(F.col("prefix"), F.col("uri").alias("_base"))
            rows = rows.withColumn("prefix", F.when(~F.col(c).rlike("^https?://"), F.substring_index(c, ":", 1))).join(m, "prefix", "left")
            rows = rows.withColumn(c, F.when(F.col("_base").isNotNull(), F.concat("_base", F.substring(F.col(c), F.length("prefix") + 2, F.length(c)))).otherwise(F.col(c))).drop("prefix", "_base")
    uri = F.col("x._uri").isNotNull()
    flat = rows.select("s", "p", F.coalesce("x._uri", "x._VALUE").alias("o"), F.when(uri, "uri").otherwise("literal").alias("o_kind"), F.when(~uri, F.col("x._type")).alias("o_type"), F.col("x._lang").alias("o_lang"), F.col("pos").cast("long").alias("pos"), "meta").filter("o IS NOT NULL")
    home = flat.filter(F.col("p") == PART_OF).groupBy("s").agg(F.min("o").alias("g"))
    flat = flat.filter(F.col("p") != PART_OF).join(home, "s", "left").withColumn("g", F.coalesce("g", F.lit("unspecified")))
    statements = flat.select("g", F.md5(F.concat("s", "p", "o")).alias("stmt"), "s", "p", "o", F.explode("meta").alias("m")).select("g", "stmt", "s", "p", "o", F.col("m._type").alias("rei_p"), F.col("m._value").alias("rei_o"))
    return flat.select("g", "s", "p", "o", "o_kind", "o_type", "o_lang", "pos"), statements


def read_record_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    subjects = spark.read.format("xml").option("rowTag", "subject").schema(SUBJECT_XML).load(path)
    prefixes = spark.read.format("xml").option("rowTag", "prefix").schema("_entity string, _uri string").load(path).select(F.col("_entity").alias("prefix"), F.col("_uri").alias("uri")).filter("prefix IS NOT NULL").distinct()
    return parse_record_xml(subjects, prefixes)


def _sections(file: str, content: str) -> Iterator[tuple]:
    """One file's rows: (file, section, rec_no, id, attr, cell, pos)."""
    section, header, rec, current, pos = None, None, 0, None, 0
    for cells in csv.reader(io.StringIO(content)):
        if not any(c.strip() for c in cells):
            continue
        first = cells[0].strip()
        if first.startswith("&&"):
            section, header, current = first[2:], None, None
        elif section and header is None and first.startswith("&"):
            header = [c.strip()[1:] for c in cells if c.strip()]
        elif header is None:
            yield file, section, rec, None, "_error", "a row before any header", pos
        elif len([c for c in cells[len(header) :] if c.strip()]):
            yield file, section, rec, None, "_error", "too many cells", pos
        else:
            row = dict(zip(header, [*cells, *[""] * len(header)]))
            own = row.get("id", "").strip()
            if section != "recordList" or (own and own != current):
                rec, current = rec + 1, own or None
            for attr, cell in row.items():
                if cell.strip() and attr != "id":
                    yield file, section, rec, current, attr, cell, pos
                    pos += 1


def parse_sectioned_csv(files: DataFrame) -> DataFrame:
    """Long rows of files (path, content). Sections start with &&, headers with &; short rows are padded, rows with too many
    cells are errors; a record row whose id is empty or repeated continues the record above. Section state is local to a
    file, so a file is read by one task."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for p, c in zip(frame["path"], frame["content"]) for r in _sections(p, c or "")]
            yield pd.DataFrame(rows, columns=["file", "section", "rec_no", "id", "attr", "cell", "pos"])

    return files.select("path", "content").mapInPandas(parse, "file string, section string, rec_no long, id string, attr string, cell string, pos long")


def read_sectioned_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_sectioned_csv(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


def parse_record_json(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, dataset, linkage) of files (path, content): records are (file, id, attr, pos, value, ref, meta). A value may
    be text, an object with ref and metadata, or a list of either. No type means Object; no id means md5(file, place)."""
    read = files.select("path", F.from_json("content", "dataset map<string,string>, recordList array<map<string,string>>").alias("j"))
    dataset = read.select("path", F.explode("j.dataset").alias("attr", "value")).filter("attr != 'linkage'")
    linked = read.select("path", F.from_json(F.col("j.dataset")["linkage"], "struct<linkedType:string,prefixList:map<string,string>,attributeList:map<string,map<string,string>>,typeList:map<string,map<string,string>>>").alias("l"))
    parts = [
        linked.select("path", F.lit("prefix").alias("kind"), F.explode("l.prefixList").alias("name", "map_to")),
        linked.select("path", F.lit("attribute").alias("kind"), F.explode("l.attributeList").alias("name", "m")).select("path", "kind", "name", F.col("m")["mapTo"].alias("map_to")),
        linked.select("path", F.lit("type").alias("kind"), F.explode("l.typeList").alias("name", "m")).select("path", "kind", "name", F.col("m")["mapTo"].alias("map_to")),
    ]
    linkage = parts[0].union(parts[1]).union(parts[2])
    records = read.select("path", F.posexplode("j.recordList").alias("rec", "r"))
    own = F.coalesce(F.col("r")["id"], F.md5(F.concat("path", F.lit("#"), F.col("rec").cast("string"))))
    filled = F.when(F.map_contains_key("r", "type"), F.col("r")).otherwise(F.map_concat("r", F.create_map(F.lit("type"), F.lit("Object"))))
    cells = records.select(F.col("path").alias("file"), own.alias("id"), F.explode(filled).alias("attr", "v")).filter("attr != 'id' AND v IS NOT NULL")
    listed = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>"))
    cells = cells.select("file", "id", "attr", F.posexplode(F.coalesce(listed, F.array("v"))).alias("pos", "v"))
    obj = F.when(F.col("v").startswith("{"), F.from_json("v", "map<string,string>"))
    cells = cells.withColumn("m", obj)
    meta = F.map_filter("m", lambda k, _: k != "ref")
    out = cells.select("file", "id", "attr", "pos", F.when(F.col("m").isNull(), F.col("v")).alias("value"), F.col("m")["ref"].alias("ref"), meta.alias("meta"))
    return out, dataset.withColumnRenamed("path", "file"), linkage.withColumnRenamed("path", "file")


def read_record_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return parse_record_json(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


def parse_namespaces(lines: DataFrame) -> DataFrame:
    """(prefix, uri) of two-column lines (value) with a valid IRI, over the built-in prefixes."""
    cells = F.split("value", ",")
    own = lines.filter(F.size(cells) == 2).select(F.trim(F.get(cells, F.lit(0))).alias("prefix"), F.trim(F.get(cells, F.lit(1))).alias("uri")).filter(is_valid_iri(F.col("uri")))
    built_in = lines.sparkSession.createDataFrame(list(BUILT_IN.items()), "prefix string, uri string")
    return own.groupBy("prefix").agg(F.min("uri").alias("uri")).unionByName(built_in.join(own.select("prefix"), "prefix", "left_anti"))


def read_namespaces(spark: SparkSession, path: str) -> DataFrame:
    return parse_namespaces(spark.read.text(path))
