"""Writers of record files. Each *_lines half gives the text rows (value); write_* saves them as text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.uris import base_of, local_name
from quadloom.model import RDF, TYPE


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.text(path)


def escape_literal(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, code in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def escape_xml(text: Column) -> Column:
    out = text
    for char, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def _node(uri: Column) -> Column:
    return F.when(uri.startswith("_:"), uri).otherwise(F.concat(F.lit("<"), uri, F.lit(">")))


def ntriples_lines(quads: DataFrame, statements: DataFrame | None = None) -> DataFrame:
    """One triple per line; a datatype goes before a language; a statement is a blank node named by md5(s + p + value)."""
    tag = F.when(F.col("o_type").isNotNull(), F.concat(F.lit("^^<"), "o_type", F.lit(">"))).when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).otherwise("")
    value = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), escape_literal(F.col("o")), F.lit('"'), tag)).otherwise(_node(F.col("o")))
    lines = quads.select(F.concat(_node(F.col("s")), F.lit(" <"), "p", F.lit("> "), value, F.lit(" .")).alias("value"))
    if statements is None:
        return lines
    # statements are combined before their lines are made; the key is binary, half of its text
    key = F.unhex(F.md5(F.concat("s", "p", "o")))
    pair = F.when(F.col("rei_p").isNotNull() & F.col("rei_o").isNotNull(), F.struct("rei_p", "rei_o"))
    one = statements.groupBy(key.alias("key")).agg(F.collect_set(F.struct("s", "p", "o")).alias("of"), F.collect_set(pair).alias("pairs"))
    one = one.filter("key IS NOT NULL").select(F.concat(F.lit("_:b"), F.lower(F.hex("key")), F.lit(" <")).alias("n"), "of", "pairs")

    def written(p: str | Column, v: Column) -> Column:
        return F.concat(F.lit(p) if isinstance(p, str) else p, F.lit("> "), v, F.lit(" ."))

    def parts(p: str, name: str) -> Column:
        return F.array_distinct(F.transform("of", lambda x: written(f"{RDF}{p}", nodes[name](x[name]))))

    quote = lambda v: F.concat(F.lit('"'), escape_literal(v), F.lit('"'))
    uri = lambda v: F.concat(F.lit("<"), v, F.lit(">"))
    nodes = {"s": _node, "p": uri, "o": lambda v: F.when(v.rlike("^https?://"), uri(v)).otherwise(quote(v))}
    fixed = F.concat(F.array(written(f"{RDF}type", F.lit(f"<{RDF}Statement>"))), parts("subject", "s"), parts("predicate", "p"), parts("object", "o"))
    said = one.select("n", F.explode(F.concat(fixed, F.transform("pairs", lambda x: written(x["rei_p"], quote(x["rei_o"]))))).alias("x")).select(F.concat("n", "x").alias("value"))
    return lines.union(said)


def _attribute_lists(quads: DataFrame, statements: DataFrame | None) -> DataFrame:
    """(g, s, type, more_types, attrs): per record its types in order and its values sorted by attribute, place and value."""
    meta = None
    if statements is not None:
        meta = statements.groupBy("s", "p", "o").agg(F.sort_array(F.collect_set(F.struct(F.col("rei_p").alias("type"), F.col("rei_o").alias("value")))).alias("reify"))
    rows = quads.filter("o IS NOT NULL AND o != ''")
    rows = rows.join(meta, ["s", "p", "o"], "left") if meta is not None else rows.withColumn("reify", F.lit(None).cast("array<struct<type:string,value:string>>"))
    entry = F.struct("p", "pos", "o", "o_kind", "o_type", "o_lang", "reify")
    out = rows.groupBy("g", "s").agg(
        F.sort_array(F.collect_set(F.when(F.col("p") == TYPE, F.struct("pos", "o")))).alias("t"), F.sort_array(F.collect_set(F.when(F.col("p") != TYPE, entry))).alias("attrs"))
    return out.select("g", "s", F.get("t", F.lit(0))["o"].alias("type"), F.transform(F.slice("t", F.lit(2), F.size("t")), lambda x: x["o"]).alias("more_types"), "attrs")


def record_xml_lines(quads: DataFrame, statements: DataFrame | None = None) -> DataFrame:
    """One <subject> per record: the first type as attribute, others as rdf:type predicates, then values with their metadata."""
    tag = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), escape_xml(value), F.lit('"'))).otherwise("")
    reify = lambda x: F.concat_ws("", F.transform(F.coalesce(x["reify"], F.array().cast("array<struct<type:string,value:string>>")), lambda m: F.concat(F.lit("<reify"), tag("type", m["type"]), tag("value", m["value"]), F.lit("/>"))))

    def predicate(x: Column) -> Column:
        linked = F.concat(F.lit("<object"), tag("uri", x["o"]), F.lit(">"), reify(x), F.lit("</object>"))
        literal = F.concat(F.lit("<object"), tag("type", x["o_type"]), tag("lang", x["o_lang"]), F.lit(">"), escape_xml(x["o"]), F.lit("</object>"), reify(x))
        return F.concat(F.lit("<predicate"), tag("type", x["p"]), F.lit(">"), F.when(x["o_kind"] == "literal", literal).otherwise(linked), F.lit("</predicate>"))

    types = F.concat_ws("", F.transform("more_types", lambda t: F.concat(F.lit(f'<predicate type="{TYPE}"><object'), tag("uri", t), F.lit("></object></predicate>"))))
    home = F.concat(F.lit('<predicate type="http://purl.org/dc/terms/isPartOf"><object'), tag("uri", F.col("g")), F.lit("></object></predicate>"))
    body = F.concat(F.lit("<subject"), tag("type", F.col("type")), tag("uri", F.col("s")), F.lit(">"), home, types, F.concat_ws("", F.transform("attrs", predicate)), F.lit("</subject>"))
    return _attribute_lists(quads, statements).select(body.alias("value"))


def record_json_lines(quads: DataFrame, statements: DataFrame | None = None) -> DataFrame:
    """{uri, type, predicate: [{attribute: value}]}: plain text without tags, else an object."""
    def value(x: Column) -> Column:
        plain = (x["o_kind"] == "literal") & x["o_type"].isNull() & x["o_lang"].isNull() & x["reify"].isNull()
        text = F.to_json(F.array(F.when(x["o_kind"] == "literal", x["o"])))
        text = F.substring(text, F.lit(2), F.length(text) - 2)
        full = F.to_json(F.struct(F.when(x["o_kind"] == "literal", x["o"]).alias("value"), F.when(x["o_kind"] != "literal", x["o"]).alias("uri"), x["o_type"].alias("type"), x["o_lang"].alias("lang"), x["reify"].alias("reify")))
        key = F.to_json(F.array(x["p"]))
        return F.concat(F.lit("{"), F.substring(key, F.lit(2), F.length(key) - 2), F.lit(":"), F.when(plain, text).otherwise(full), F.lit("}"))

    head = F.to_json(F.struct(F.col("s").alias("uri"), F.col("type")))
    body = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"predicate":['), F.concat_ws(",", F.transform("attrs", value)), F.lit("]}"))
    return _attribute_lists(quads, statements).select(body.alias("value"))


def _csv_cell(text: Column) -> Column:
    return F.when(text.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(text, F.lit("")))


def sectioned_csv_lines(quads: DataFrame, prefixes: DataFrame, most_attributes: int = 500) -> tuple[DataFrame, DataFrame]:
    """(record rows, linkage rows), each (value) with the header lines first. Attributes are named prefix:name; a base without
    a prefix gets ns1, ns2, ... in the order of the bases. Their list is schema, not data: it is collected for the header and
    refused above most_attributes. A subject that stands in several datasets has a row for each."""
    spark = quads.sparkSession
    known = quads.filter(F.col("p") != TYPE).select("p").distinct().withColumn("uri", base_of(F.col("p"))).join(prefixes, "uri", "left")
    named = known.select("p", "uri", "prefix", local_name(F.col("p")).alias("name")).orderBy("uri", "p").limit(most_attributes + 1).collect()
    if len(named) > most_attributes:
        raise ValueError(f"more than {most_attributes} attributes")
    made = {uri: f"ns{k}" for k, uri in enumerate(sorted({r.uri for r in named if r.prefix is None}), 1)}
    attr_of = {r.p: f"{r.prefix or made[r.uri]}:{r['name']}" for r in named}
    names = spark.createDataFrame(list(attr_of.items()), "p string, attr string")
    attrs = sorted(set(attr_of.values()))
    short = F.coalesce(F.concat("prefix", F.lit(":"), local_name(F.col("o"))), F.col("o"))
    cell = F.when(F.col("o_kind") == "literal", F.col("o")).otherwise(F.concat(F.lit("@@"), short))
    linked = quads.withColumn("uri", base_of(F.col("o"))).join(prefixes, "uri", "left").withColumn("cell", cell)
    cells = linked.drop("uri", "prefix").join(names, "p", "left").withColumn("attr", F.coalesce("attr", F.lit("type")))
    in_order = F.transform(F.sort_array(F.collect_set(F.struct("pos", "cell"))), lambda x: x["cell"])
    lists = cells.groupBy("g", "s", "attr").agg(F.array_join(in_order, "||").alias("cell"))
    wide = lists.groupBy("g", "s").pivot("attr", ["type", *attrs]).agg(F.first("cell"))
    row = F.concat_ws(",", _csv_cell(F.col("s")), *[_csv_cell(F.col(f"`{a}`")) for a in ["type", *attrs]])
    header = ["&&recordList", ",".join(["&id", "&type", *[f"&{a}" for a in attrs]])]
    records = spark.createDataFrame([(x,) for x in header], "value string").coalesce(1).union(wide.select(row))
    lines = ["&&linkage", "&linkedType,application/rdf+xml", "&attributeList,&mapTo", *sorted(f"{a},{p}" for p, a in attr_of.items())]
    return records, spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)


def linked_json_lines(quads: DataFrame, linkage: DataFrame) -> DataFrame:
    """One JSON record per line with short names: linked properties and classes by the inverse linkage, others by their
    local name; references are @local within the record's dataset, else @@external."""
    inverse = linkage.groupBy("map_to").agg(F.min("name").alias("name"))
    rows = quads.join(inverse.select(F.col("map_to").alias("p"), F.col("name").alias("attr")), "p", "left").withColumn("attr", F.coalesce("attr", local_name(F.col("p"))))
    rows = rows.join(inverse.select(F.col("map_to").alias("o"), F.col("name").alias("cls")), "o", "left")
    inside = F.col("o").startswith(F.col("g"))
    ref = F.when(inside, F.concat(F.lit("@"), F.substring(F.col("o"), F.length("g") + 1, F.length("o")))).otherwise(F.concat(F.lit("@@"), "o"))
    cell = F.when(F.col("p") == TYPE, F.coalesce("cls", local_name(F.col("o")))).when(F.col("o_kind") == "literal", F.col("o")).otherwise(ref)
    lists = rows.select("g", "s", F.when(F.col("p") == TYPE, "type").otherwise(F.col("attr")).alias("attr"), "pos", cell.alias("cell")).groupBy("g", "s", "attr").agg(F.transform(F.sort_array(F.collect_set(F.struct("pos", "cell"))), lambda x: x["cell"]).alias("v"))
    out = lists.groupBy("g", "s").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("attr", "v")))).alias("m"))
    own = F.when(F.col("s").startswith(F.col("g")), F.substring(F.col("s"), F.length("g") + 1, F.length("s"))).otherwise(F.col("s"))
    head = F.regexp_replace(F.to_json(F.struct(own.alias("id"))), "\\}$", ",")  # an id may hold quotes and backslashes
    return out.select(F.concat(head, F.substring(F.to_json("m"), 2, 1 << 30)).alias("value"))


def triple_tsv_lines(quads: DataFrame, delimiter: str = "\t", descriptions: DataFrame | None = None) -> DataFrame:
    """subject, predicate, object joined by the delimiter, which is URL-encoded inside cells."""
    code = "".join(f"%{b:02X}" for b in delimiter.encode())
    rows = quads if descriptions is None else quads.unionByName(descriptions)
    return rows.select(F.concat_ws(delimiter, *[F.replace(c, F.lit(delimiter), F.lit(code)) for c in ("s", "p", "o")]).alias("value"))


def rdfxml_lines(quads: DataFrame, statements: DataFrame | None = None) -> DataFrame:
    """One typed element per record with the namespace of each name declared on it; metadata as rdf:Statement elements."""
    def element(name: Column, head: Column, body: Column) -> Column:
        tag = F.concat(F.lit("n:"), local_name(name))
        return F.concat(F.lit("<"), tag, F.lit(' xmlns:n="'), escape_xml(base_of(name)), F.lit('"'), head, F.lit(">"), body, F.lit("</"), tag, F.lit(">"))

    def value(x: Column) -> Column:
        lang = F.when(x["o_lang"].isNotNull(), F.concat(F.lit(' xml:lang="'), x["o_lang"], F.lit('"'))).when(x["o_type"].isNotNull(), F.concat(F.lit(' rdf:datatype="'), x["o_type"], F.lit('"'))).otherwise("")
        linked = F.concat(F.lit(' rdf:resource="'), escape_xml(x["o"]), F.lit('"'))
        literal = x["o_kind"] == "literal"
        return element(x["p"], F.when(literal, lang).otherwise(linked), F.when(literal, escape_xml(x["o"])).otherwise(""))

    about = F.concat(F.lit(' rdf:about="'), escape_xml(F.col("s")), F.lit('"'))
    lists = _attribute_lists(quads, statements)
    body = element(F.coalesce("type", F.lit(f"{RDF}Description")), about, F.concat_ws("", F.transform("attrs", value)))
    said = F.transform(F.filter("attrs", lambda x: x["reify"].isNotNull()), lambda x: F.concat(F.lit('<rdf:Statement><rdf:subject rdf:resource="'), escape_xml(F.col("s")), F.lit('"/><rdf:predicate rdf:resource="'), escape_xml(x["p"]), F.lit('"/><rdf:object>'), escape_xml(x["o"]), F.lit("</rdf:object>"), F.concat_ws("", F.transform(x["reify"], lambda m: element(m["type"], F.lit(""), escape_xml(m["value"])))), F.lit("</rdf:Statement>")))
    return lists.select(F.concat(body, F.concat_ws("", said)).alias("value"))
