"""Queries over an ontology with nested blank nodes: every class of the tables says, by a restriction, that its own property has at most one
value, which is of a union of two classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.model import OWL, RDF, RDFS, TYPE
from quadloom.operators import ontology, patterns
from quadloom.operators.closure_edits import edit_closure
from quadloom.plans.fixtures import DS, ONTO, Tables
from quadloom.plans.registry import query

CLASS_NAMES = "SELECT sub AS c FROM class_edges UNION SELECT super FROM class_edges"
#: (subject, predicate, object, kind) of each class c: SQL that both engines read.
NESTED = (
    ("c", f"'{TYPE}'", f"'{OWL}Class'", "uri"),
    ("c || '-of'", f"'{TYPE}'", f"'{OWL}ObjectProperty'", "uri"),
    ("c", f"'{RDFS}subClassOf'", "'_:r-' || c", "bnode"),
    ("'_:r-' || c", f"'{OWL}onProperty'", "c || '-of'", "uri"),
    ("'_:r-' || c", f"'{OWL}maxCardinality'", "'1'", "literal"),
    ("'_:r-' || c", f"'{OWL}allValuesFrom'", "'_:u-' || c", "bnode"),
    ("'_:u-' || c", f"'{OWL}unionOf'", "'_:l1-' || c", "bnode"),
    ("'_:l1-' || c", f"'{RDF}first'", f"'{ONTO}Part'", "uri"),
    ("'_:l1-' || c", f"'{RDF}rest'", "'_:l2-' || c", "bnode"),
    ("'_:l2-' || c", f"'{RDF}first'", "c", "uri"),
    ("'_:l2-' || c", f"'{RDF}rest'", f"'{RDF}nil'", "uri"),
)


def nested_quads(t: Tables) -> DataFrame:
    names = t.class_edges.select(F.explode(F.array("sub", "super")).alias("c")).distinct()
    rows = F.explode(F.array(*[F.struct(F.expr(s).alias("s"), F.expr(p).alias("p"), F.expr(o).alias("o"), F.lit(kind).alias("o_kind")) for s, p, o, kind in NESTED]))
    none = F.lit(None).cast("string")
    return names.select(rows.alias("x")).select(F.lit(f"{DS}onto/").alias("g"), "x.*", none.alias("o_type"), none.alias("o_lang"), F.lit(0).cast("long").alias("pos"))


@query("b12_properties_of_ontology", f"SELECT c || '-of' AS uri, unnest(['{ONTO}Part', c]) AS \"range\", 1 AS max_card FROM ({CLASS_NAMES}) WHERE c <> '{ONTO}Part' UNION ALL SELECT '{ONTO}Part-of', '{ONTO}Part', 1")
def b12_ontology(t: Tables) -> DataFrame:
    return ontology.properties_of(nested_quads(t))


@query("o9_restrictions", f"SELECT c AS \"class\", c || '-of' AS property, CAST(NULL AS INT) AS min_card, 1 AS max_card, unnest(list_distinct(['{ONTO}Part', c])) AS value FROM ({CLASS_NAMES})")
def o9_restrictions(t: Tables) -> DataFrame:
    return ontology.restrictions(nested_quads(t))


AGENT = f"SELECT '{ONTO}Agent' AS c"


@query(
    "o9_describe_nested",
    " UNION ALL ".join(f"SELECT {p} AS p, {o} AS o, {'CAST(NULL AS STRING)' if s == 'c' else s} AS restriction, CAST(NULL AS INT) AS pos FROM ({AGENT})" for s, p, o, _ in NESTED if s in ("c", "'_:r-' || c", "'_:u-' || c"))
    + f" UNION ALL SELECT '{RDF}first', '{ONTO}Part', '_:l1-' || c, 0 FROM ({AGENT}) UNION ALL SELECT '{RDF}first', c, '_:l1-' || c, 1 FROM ({AGENT})",
)
def o9_nested(t: Tables) -> DataFrame:
    """A class whose description nests restriction, union and list."""
    return ontology.describe_entity(nested_quads(t), f"{ONTO}Agent").select("p", "o", "restriction", "pos")


@query(
    "q1_match_star",
    f"""SELECT p.s AS part, b.o AS brand, z.o AS size FROM quads p JOIN quads b ON b.s = p.s AND b.p = '{ONTO}brand' JOIN quads z ON z.s = p.s AND z.p = '{ONTO}size' WHERE p.p = '{TYPE}' AND p.g = '{DS}part/'
UNION ALL SELECT DISTINCT o.s, o.o, x.o FROM quads o JOIN quads x ON x.s = o.s AND x.p = '{ONTO}part' WHERE o.p = '{ONTO}priority'""",
)
def q1_star(t: Tables) -> DataFrame:
    """All parts by three of their values, and all orders, which have many parts each, by priority and part."""
    parts = patterns.match(t.quads("part"), [("?part", TYPE, "?t"), ("?part", f"{ONTO}brand", "?brand"), ("?part", f"{ONTO}size", "?size")])
    orders = patterns.match(t.quads("orders"), [("?part", f"{ONTO}priority", "?brand"), ("?part", f"{ONTO}part", "?size")])
    return parts.select("part", "brand", "size").union(orders.select("part", "brand", "size"))


NAME_OF = "regexp_extract(sub, '[^#]*$')"
EDITED = f"""SELECT sub, super FROM class_edges WHERE NOT (super = '{ONTO}Part' AND {NAME_OF} < 'M') AND NOT (sub = '{ONTO}Supplier' AND super = '{ONTO}Agent')
UNION SELECT '{ONTO}Product', '{ONTO}Agent' UNION SELECT '{ONTO}Agent', '{ONTO}Being' UNION SELECT '{ONTO}Being', '{ONTO}Product'"""


@query(
    "o1_closure_after_edits",
    "SELECT sub, super FROM walked",
    **{"edited": EDITED, "walked(sub, super)": "SELECT sub, super FROM edited UNION SELECT w.sub, e.super FROM walked w JOIN edited e ON w.super = e.sub"},
)
def o1_edits(t: Tables) -> DataFrame:
    """Half the part types leave their parent, a supplier its agent, and three edges close a cycle; only their cones are derived again."""
    name = F.substring_index("sub", "#", -1)
    removed = t.class_edges.filter((F.col("super") == f"{ONTO}Part") & (name < "M") | (F.col("sub") == f"{ONTO}Supplier") & (F.col("super") == f"{ONTO}Agent"))
    added = t.spark.createDataFrame([(f"{ONTO}{a}", f"{ONTO}{b}") for a, b in (("Product", "Agent"), ("Agent", "Being"), ("Being", "Product"))], "sub string, super string")
    return edit_closure(ontology.transitive(t.class_edges), t.class_edges, added, removed)[0]
