"""Class and property hierarchies: closures, lookups, entity lists, edits and the exported schema.

Closures double their path length each round, so depth 2 ** k takes k joins; every round is written by checkpoint(), so a
lost executor never replays the loop. Hierarchies are schema: they stay small while data grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions.uris import local_name
from quadloom.model import DESCRIPTIONS, LABELS, OWL, RDF, RDFS, THING, TYPE
from quadloom.operators.components import equivalence_classes
from quadloom.operators.lineage import cut
from quadloom.operators.mapping import description, pref_label
from quadloom.operators.writes import _without, update_records

SUB_CLASS, SUB_PROPERTY, DEFINED_BY = f"{RDFS}subClassOf", f"{RDFS}subPropertyOf", f"{RDFS}isDefinedBy"
DOMAIN, RANGE, EQUIVALENT, DISJOINT = f"{RDFS}domain", f"{RDFS}range", f"{OWL}equivalentClass", f"{OWL}disjointWith"
KINDS = {"class": f"{OWL}Class", "datatype": f"{RDFS}Datatype", "data_property": f"{OWL}DatatypeProperty", "object_property": f"{OWL}ObjectProperty", "annotation_property": f"{OWL}AnnotationProperty", "individual": f"{OWL}NamedIndividual", "ontology": f"{OWL}Ontology"}


def transitive(edges: DataFrame, max_rounds: int = 32) -> DataFrame:
    """All (sub, super) pairs reachable over edges, by doubling; cycles and repeats end like anything else."""
    pairs = cut(edges.select("sub", "super").filter("sub IS NOT NULL AND super IS NOT NULL").distinct())
    n = pairs.count()
    for _ in range(max_rounds):
        step = pairs.select(F.col("sub").alias("super"), F.col("super").alias("_far"))
        pairs = cut(pairs.union(pairs.join(step, "super").select("sub", F.col("_far").alias("super"))).distinct())
        if (now := pairs.count()) == n:
            return pairs
        n = now
    raise RuntimeError("the closure did not settle")


def class_closure(edges: DataFrame, top: str = THING) -> DataFrame:
    """transitive(edges) with every class under top."""
    every = edges.select(F.explode(F.array("sub", "super")).alias("sub")).distinct()
    return transitive(edges).union(every.filter(F.col("sub") != top).select("sub", F.lit(top).alias("super"))).distinct()


property_closure = transitive


def sub_classes(edges: DataFrame, closure: DataFrame, uri: str, direct: bool = False) -> DataFrame:
    return (edges if direct else closure).filter(F.col("super") == uri).select(F.col("sub").alias("uri")).distinct()


def super_classes(edges: DataFrame, closure: DataFrame, uri: str, direct: bool = False, top: str = THING) -> DataFrame:
    """Direct or all super-classes; a class without any, or unknown, has top."""
    found = (edges if direct else closure).filter(F.col("sub") == uri).select(F.col("super").alias("uri")).distinct()
    none = found.agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(top).alias("uri"))
    return found.union(none)


def is_subclass_of(pairs: DataFrame, closure: DataFrame) -> DataFrame:
    known = closure.select("sub", "super", F.lit(True).alias("_yes")).distinct()
    return pairs.join(known, ["sub", "super"], "left").withColumn("is_sub", F.coalesce("_yes", F.lit(False))).drop("_yes")


def edges_of(ontology: DataFrame, predicate: str = SUB_CLASS) -> DataFrame:
    return ontology.filter(F.col("p") == predicate).select(F.col("s").alias("sub"), F.col("o").alias("super")).distinct()


def hierarchy(ontology: DataFrame, kind: str = "class", labels: tuple[str, ...] = LABELS, descriptions: tuple[str, ...] = DESCRIPTIONS) -> DataFrame:
    """(uri, label, description, defined_by, parents, children, depth): depth is the number of super-classes."""
    edges = edges_of(ontology, SUB_CLASS if kind == "class" else SUB_PROPERTY)
    nodes = edges.select(F.explode(F.array("sub", "super")).alias("uri")).union(ontology.filter((F.col("p") == TYPE) & (F.col("o") == KINDS.get(kind, kind))).select("s")).distinct()
    said = description(ontology, descriptions).withColumn("description", F.trim(F.regexp_replace("description", "\\s+", " ")))
    parents = edges.groupBy(F.col("sub").alias("uri")).agg(F.sort_array(F.collect_set("super")).alias("parents"))
    children = edges.groupBy(F.col("super").alias("uri")).agg(F.sort_array(F.collect_set("sub")).alias("children"))
    depth = transitive(edges).groupBy(F.col("sub").alias("uri")).agg(F.count_distinct("super").alias("depth"))
    defined = ontology.filter(F.col("p") == DEFINED_BY).groupBy(F.col("s").alias("uri")).agg(F.min("o").alias("defined_by"))
    out = nodes
    for more in (pref_label(ontology, labels).withColumnRenamed("s", "uri"), said.withColumnRenamed("s", "uri"), defined, parents, children, depth):
        out = out.join(more, "uri", "left")
    none = F.array().cast("array<string>")
    return out.select("uri", F.coalesce("label", local_name(F.col("uri"))).alias("label"), F.coalesce("description", F.lit("No description available")).alias("description"), "defined_by", F.coalesce("parents", none).alias("parents"), F.coalesce("children", none).alias("children"), F.coalesce("depth", F.lit(0)).alias("depth"))


def _properties_with(ontology: DataFrame, closure: DataFrame, predicate: str, uri: str) -> DataFrame:
    said = ontology.filter(F.col("p") == predicate).select(F.col("s").alias("property"), F.col("o").alias("class"))
    wider = said.join(closure.select(F.col("super").alias("class"), "sub"), "class").select("property", F.col("sub").alias("class"))
    return said.union(wider).filter(F.col("class") == uri).select("property").distinct()


def in_domain_of(ontology: DataFrame, closure: DataFrame, uri: str) -> DataFrame:
    """Properties whose domain is the class or a super-class of it."""
    return _properties_with(ontology, closure, DOMAIN, uri)


def in_range_of(ontology: DataFrame, closure: DataFrame, uri: str) -> DataFrame:
    return _properties_with(ontology, closure, RANGE, uri)


def equivalence(ontology: DataFrame, predicate: str = EQUIVALENT) -> DataFrame:
    """(uri, class): every URI with an equivalent, and the smallest of its class. In memory of the edges, not of all pairs."""
    return equivalence_classes(edges_of(ontology, predicate).select(F.col("sub").alias("a"), F.col("super").alias("b"))).toDF("uri", "class")


def equivalents(ontology: DataFrame, uri: str, predicate: str = EQUIVALENT) -> DataFrame:
    """(uri): everything equivalent, over any number of steps."""
    classes = equivalence(ontology, predicate)
    mine = classes.filter(F.col("uri") == uri).select("class")
    return classes.join(mine, "class", "left_semi").filter(F.col("uri") != uri).select("uri")


def disjoints(ontology: DataFrame, uri: str, predicate: str = DISJOINT) -> DataFrame:
    edges = edges_of(ontology, predicate)
    both = edges.union(edges.select(F.col("super").alias("sub"), F.col("sub").alias("super")))
    return both.filter(F.col("sub") == uri).select(F.col("super").alias("uri")).distinct()


def list_entities(ontology: DataFrame, kind: str, offset: int = 0, limit: int = 20, mode: str = "uris") -> DataFrame:
    """Entities of a kind, paged by URI; with labels and descriptions in descriptions mode."""
    found = ontology.filter((F.col("p") == TYPE) & (F.col("o") == KINDS.get(kind, kind))).select(F.col("s").alias("uri")).distinct()
    paged = found.orderBy("uri").offset(offset).limit(limit)
    if mode == "uris":
        return paged
    mine = ontology.join(paged.select(F.col("uri").alias("s")), "s", "left_semi")
    return pref_label(mine).join(description(mine), "s").withColumnRenamed("s", "uri")


def named_individuals(types: DataFrame, closure: DataFrame, uri: str | None, direct: bool = False) -> DataFrame:
    """(uri) of types (s, class): individuals of the class, by default also of its sub-classes; None means any class."""
    if uri is None:
        return types.select(F.col("s").alias("uri")).distinct()
    own = types.filter(F.col("class") == uri).select("s")
    if not direct:
        subs = closure.filter(F.col("super") == uri).select(F.col("sub").alias("class")).distinct()
        own = own.union(types.join(subs, "class", "left_semi").select("s"))
    return own.distinct().withColumnRenamed("s", "uri")


def blank_closure(ontology: DataFrame, start: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(root, node): the blank nodes that each root (start: root, node) reaches through blank nodes, its own included. The
    frontier of each round is written, so a description of any depth takes as many rounds as it is deep; cycles end."""
    steps = ontology.filter(F.col("s").startswith("_:") & F.col("o").startswith("_:")).select(F.col("s").alias("node"), F.col("o").alias("next")).distinct()
    found = frontier = cut(start.select("root", "node").distinct())
    for _ in range(max_rounds):
        further = frontier.join(steps, "node").select("root", F.col("next").alias("node")).distinct()
        frontier = cut(further.join(found, ["root", "node"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = found.union(frontier)
    raise RuntimeError(f"blank nodes nest deeper than {max_rounds}")


def rdf_lists(ontology: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(head, pos, member): the members of every list (first / rest chains) in order, from 0. Each cell learns its head by
    doubling the way back to it, so a list of n cells takes about log n rounds. Cells of a cycle have no
    head and are left out."""
    cells = ontology.filter(F.col("p") == f"{RDF}first").groupBy(F.col("s").alias("cell")).agg(F.min("o").alias("member"))
    back = ontology.filter((F.col("p") == f"{RDF}rest") & (F.col("o") != f"{RDF}nil")).groupBy(F.col("o").alias("cell")).agg(F.min("s").alias("before"))
    now = cells.select("cell", "member").join(back, "cell", "left")
    now = cut(now.select("cell", "member", F.coalesce("before", "cell").alias("at"), F.when(F.col("before").isNull(), 0).otherwise(1).alias("pos"), F.col("before").isNull().alias("done")))
    open_before = None
    for _ in range(max_rounds):
        still = now.filter(~F.col("done")).count()
        if still in (0, open_before):  # a round that ends no list leaves cycles only
            break
        open_before = still
        ahead = now.select(F.col("cell").alias("at"), F.col("at").alias("_at"), F.col("pos").alias("_pos"), F.col("done").alias("_done"))
        now = cut(now.join(ahead, "at", "left").select("cell", "member", F.coalesce("_at", "at").alias("at"), (F.col("pos") + F.coalesce("_pos", F.lit(0))).alias("pos"), F.coalesce("_done", F.lit(True)).alias("done")))
    return now.filter("done").select(F.col("at").alias("head"), "pos", "member")


def describe_entity(ontology: DataFrame, uri: str) -> DataFrame:
    """(p, o, o_kind, restriction, pos): the entity's quads, with the quads of all blank nodes that it reaches through blank nodes, keyed
    by that node. A list is its members in order: one row for each, by the list's head, with `first` as p and its place as pos."""
    own = ontology.filter(F.col("s") == uri)
    start = own.filter(F.col("o").startswith("_:")).select(F.lit(uri).alias("root"), F.col("o").alias("node"))
    inner = ontology.join(blank_closure(ontology, start).select(F.col("node").alias("s")), "s", "left_semi")
    none = F.lit(None)
    cells = F.col("p").isin(f"{RDF}first", f"{RDF}rest")
    kinds = inner.filter(F.col("p") == f"{RDF}first").groupBy(F.col("o").alias("member")).agg(F.min("o_kind").alias("o_kind"))
    listed = rdf_lists(inner.filter(cells)).join(kinds, "member")
    rows = own.select("p", "o", "o_kind", none.cast("string").alias("restriction"), none.cast("int").alias("pos"))
    rows = rows.union(inner.filter(~cells).select("p", "o", "o_kind", "s", none.cast("int")))
    return rows.union(listed.select(F.lit(f"{RDF}first"), "member", "o_kind", "head", F.col("pos").cast("int")))


#: The predicates of restrictions that bound how many values a property has.
AT_MOST = (f"{OWL}maxCardinality", f"{OWL}cardinality", f"{OWL}maxQualifiedCardinality", f"{OWL}qualifiedCardinality")
AT_LEAST = (f"{OWL}minCardinality", f"{OWL}cardinality", f"{OWL}minQualifiedCardinality", f"{OWL}qualifiedCardinality")
VALUES = (f"{OWL}allValuesFrom", f"{OWL}someValuesFrom", f"{OWL}onClass", f"{OWL}onDataRange")


def restrictions(ontology: DataFrame) -> DataFrame:
    """(class, property, min_card, max_card, value): what the classes say about properties, by restrictions they are under. One row for
    each value class; a union of classes is one row for each member."""
    bound = lambda names: F.when(F.col("p").isin(*names), F.col("o").try_cast("int"))
    about = ontology.groupBy(F.col("s").alias("node")).agg(
        F.max(F.when(F.col("p") == f"{OWL}onProperty", F.col("o"))).alias("property"), F.max(bound(AT_LEAST)).alias("min_card"), F.min(bound(AT_MOST)).alias("max_card"),
        F.collect_set(F.when(F.col("p").isin(*VALUES), F.col("o"))).alias("values"),
    ).filter("property IS NOT NULL")
    classes = ontology.filter(F.col("p").isin(SUB_CLASS, EQUIVALENT)).select(F.col("s").alias("class"), F.col("o").alias("node")).distinct()
    rows = classes.join(about, "node").select("class", "property", "min_card", "max_card", F.explode_outer("values").alias("value"))
    return flattened(rows, unions(ontology), "value").distinct()


def unions(ontology: DataFrame) -> DataFrame:
    """(node, member): the classes of unions, given as lists."""
    heads = ontology.filter(F.col("p") == f"{OWL}unionOf").select(F.col("s").alias("node"), F.col("o").alias("head")).distinct()
    return heads.join(rdf_lists(ontology), "head").select("node", "member")


def flattened(rows: DataFrame, unions: DataFrame, column: str, max_rounds: int = 16) -> DataFrame:
    """rows with unions in `column` replaced by their members, unions in unions too."""
    for _ in range(max_rounds):
        if rows.join(unions.select(F.col("node").alias(column)), column, "left_semi").isEmpty():
            return rows
        members = unions.select(F.col("node").alias(column), F.col("member").alias("_m"))
        rows = cut(rows.join(members, column, "left").withColumn(column, F.coalesce("_m", column)).drop("_m").select(*rows.columns))
    raise RuntimeError("unions nest too deep, or in a cycle")


def properties_of(ontology: DataFrame) -> DataFrame:
    """(uri, range, max_card) for property_metadata and build_index, from the ontology's quads alone: ranges by `range` and by the values
    of restrictions, unions flattened; one value at most for functional properties and by the narrowest restriction."""
    said = restrictions(ontology)
    kinds = [KINDS[k] for k in ("data_property", "object_property", "annotation_property")]
    functional = F.max((F.col("o") == f"{OWL}FunctionalProperty").cast("int")) == 1
    named = ontology.filter((F.col("p") == TYPE) & F.col("o").isin(*kinds, f"{OWL}FunctionalProperty")).groupBy(F.col("s").alias("uri")).agg(F.when(functional, 1).alias("own"))
    narrow = said.groupBy(F.col("property").alias("uri")).agg(F.min("max_card").alias("said"))
    ranges = flattened(ontology.filter(F.col("p") == RANGE).select(F.col("s").alias("uri"), F.col("o").alias("range")), unions(ontology), "range")
    ranges = ranges.union(said.filter("value IS NOT NULL").select("property", "value")).distinct()
    return named.join(narrow, "uri", "left").join(ranges, "uri", "left").select("uri", "range", F.least("own", "said").alias("max_card"))


def upsert_entities(ontology: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming entities replace old ones kind by kind: of a URI that is several kinds at once, types of the kinds that do
    not come in stay."""
    kinds = list(KINDS.values())
    old = ontology.filter((F.col("p") == TYPE) & F.col("o").isin(kinds)).join(incoming.select("g", "s").distinct(), ["g", "s"], "left_semi")
    new = incoming.filter(F.col("p") == TYPE).select("g", "s", "p", "o").distinct()
    kept = old.join(new, ["g", "s", "p", "o"], "left_anti")
    return update_records(ontology, incoming).unionByName(kept)


def rename_entity(ontology: DataFrame, names: DataFrame) -> DataFrame:
    """names (old, new): the URI is replaced wherever it stands as s, p or a URI object."""
    out = ontology
    for c in ("s", "p", "o"):
        m = names.select(F.col("old").alias(c), F.col("new").alias("_new")).distinct()
        hit = F.col("_new").isNotNull() & ((F.col("o_kind") == "uri") | F.lit(c != "o"))
        out = out.join(m, c, "left").withColumn(c, F.when(hit, F.col("_new")).otherwise(F.col(c))).drop("_new")
    return out.select(*ontology.columns)


def delete_entities(ontology: DataFrame, uris: DataFrame) -> DataFrame:
    return _without(ontology, uris, ["s"])


def merged_kinds(ontology: DataFrame) -> DataFrame:
    """Ontology quads as records to index: each distinct triple of a URI once, whatever its kinds."""
    return ontology.groupBy("g", "s", "p", "o", "o_kind", "o_type", "o_lang").agg(F.min("pos").alias("pos"))


def export_schema(ontology: DataFrame, format: str = "json") -> DataFrame:
    """(kind, uri, line): one type or attribute per row with label, description, parents, domain and range."""
    def values(predicate: str):
        return F.sort_array(F.collect_set(F.when(F.col("p") == predicate, F.col("o"))))

    kind = F.max(F.when((F.col("p") == TYPE) & (F.col("o") == KINDS["class"]), "type").when((F.col("p") == TYPE) & F.col("o").isin(KINDS["data_property"], KINDS["object_property"], KINDS["annotation_property"]), "attribute"))
    rows = ontology.groupBy("s").agg(kind.alias("kind"), values(SUB_CLASS).alias("subTypeOf"), values(SUB_PROPERTY).alias("subPropertyOf"), values(DOMAIN).alias("domain"), values(RANGE).alias("allowedValue")).filter("kind IS NOT NULL")
    rows = rows.join(pref_label(ontology), "s").join(description(ontology), "s")
    fields = ["subTypeOf", "subPropertyOf", "domain", "allowedValue"]
    if format == "json":
        body = F.to_json(F.struct(F.col("s").alias("uri"), F.col("label").alias("prefLabel"), "description", *[F.when(F.size(f) > 0, F.col(f)).alias(f) for f in fields]))
    else:
        text = lambda c: F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;")
        lists = [F.concat_ws("", F.transform(f, lambda x, f=f: F.concat(F.lit(f"<{f}>"), text(x), F.lit(f"</{f}>")))) for f in fields]
        body = F.concat(F.lit('<entity uri="'), text(F.col("s")), F.lit('"><prefLabel>'), text(F.col("label")), F.lit("</prefLabel><description>"), text(F.col("description")), F.lit("</description>"), *lists, F.lit("</entity>"))
    return rows.select("kind", F.col("s").alias("uri"), body.alias("line"))


def index_ontology(quads: DataFrame, statements: DataFrame, properties: DataFrame, edges: DataFrame, supported: list[str]) -> tuple[DataFrame, DataFrame]:
    """(docs, doc_fields) of an ontology's entities: each is one record with the kinds that all its declarations give it, and
    types are inferred along edges (sub, super)."""
    from quadloom.operators.index import build_index

    return build_index(merged_kinds(quads), statements, properties, class_closure(edges), supported)
