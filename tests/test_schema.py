"""Closures under edits, nested descriptions, star patterns, facet forms and the escapes of the file formats."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadloom.model import LABEL, OWL, QUADS, RDF, RDFS, TYPE
from quadloom.operators import ontology, patterns, rank
from quadloom.operators.closure_edits import cone, edit_closure
from quadloom.sinks import writers
from quadloom.sources import readers


def quads(spark, rows):
    """rows: (s, p, o[, g])"""
    kind = lambda o: "bnode" if o.startswith("_:") else "uri" if o.startswith("x:") or o.startswith("http") else "literal"
    return spark.createDataFrame([(r[3] if len(r) > 3 else "g/", *r[:3], kind(r[2]), None, None, k) for k, r in enumerate(rows)], QUADS)


def pairs(df):
    return sorted((r["sub"], r["super"]) for r in df.collect())


def walk(edges):
    out = set(edges)
    while True:
        more = {(a, d) for a, b in out for c, d in edges if b == c} - out
        if not more:
            return sorted(out)
        out |= more


def test_edited_closure_equals_a_new_one(spark):
    rng = np.random.default_rng(7)
    frame = lambda e: spark.createDataFrame(sorted(e), "sub string, super string")
    edges = {(f"n{a}", f"n{b}") for a, b in rng.integers(0, 14, (16, 2)) if a != b}
    closure = frame(walk(edges))
    for _ in range(2):
        removed = {e for e in edges if rng.random() < 0.25} | {("n0", "nowhere")}
        added = {(f"n{a}", f"n{b}") for a, b in rng.integers(0, 16, (2, 2))}
        closure, classes = edit_closure(closure, frame(edges), frame(added), frame(removed))
        before, edges = walk(edges), (edges - removed) | added
        assert pairs(closure) == walk(edges)
        supers = lambda p: {a: {y for x, y in p if x == a} for a, _ in {*before, *walk(edges)}}
        assert {r["class"] for r in classes.collect()} == {a for a in supers(before) if supers(before)[a] != supers(walk(edges))[a]}


def test_an_edit_derives_its_cone_alone(spark):
    chain = [(f"a{i:02d}", f"a{i + 1:02d}") for i in range(20)] + [(f"b{i}", f"b{i + 1}") for i in range(5)]
    closure = spark.createDataFrame(walk(set(chain)), "sub string, super string")
    near_top = spark.createDataFrame([("a18", "a19")], "sub string, super string")
    assert cone(closure, near_top).count() == 19 * 2
    after, classes = edit_closure(closure, spark.createDataFrame(chain, "sub string, super string"), near_top.limit(0), near_top)
    assert pairs(after) == walk(set(chain) - {("a18", "a19")}) and classes.count() == 19


def test_nested_descriptions_lists_and_restrictions(spark):
    first, rest, nil = f"{RDF}first", f"{RDF}rest", f"{RDF}nil"
    members = [f"x:C{i}" for i in range(9)]
    cells = [r for i, m in enumerate(members) for r in ((f"_:l{i}", first, m), (f"_:l{i}", rest, f"_:l{i + 1}" if i < 8 else nil))]
    rows = [("x:A", f"{RDFS}subClassOf", "_:r"), ("x:A", LABEL, "a"), ("_:r", f"{OWL}onProperty", "x:p"), ("_:r", f"{OWL}cardinality", "1"), ("_:r", f"{OWL}allValuesFrom", "_:u")]
    rows += [("_:u", f"{OWL}unionOf", "_:l0"), ("_:u", "x:loop", "_:r"), ("x:p", TYPE, f"{OWL}ObjectProperty"), ("x:q", TYPE, f"{OWL}DatatypeProperty"), ("x:q", TYPE, f"{OWL}FunctionalProperty")]
    rows += [("x:q", f"{RDFS}range", "x:int"), ("_:other", f"{OWL}onProperty", "x:never"), ("_:c1", rest, "_:c2"), ("_:c2", rest, "_:c1"), ("_:c1", first, "x:cycle"), ("_:c2", first, "x:cycle")]
    held = quads(spark, rows + cells)
    listed = sorted((r["head"], r.pos, r.member) for r in ontology.rdf_lists(held).collect())
    assert listed == [("_:l0", i, m) for i, m in enumerate(members)]
    told = ontology.describe_entity(held, "x:A").collect()
    assert {r.restriction for r in told} == {None, "_:r", "_:u", "_:l0"}
    assert [r.o for r in sorted((r for r in told if r.pos is not None), key=lambda r: r.pos)] == members
    said = ontology.restrictions(held).collect()
    assert {(r["class"], r.property, r.min_card, r.max_card) for r in said} == {("x:A", "x:p", 1, 1)} and {r.value for r in said} == set(members)
    known = {(r.uri, r.range, r.max_card) for r in ontology.properties_of(held).collect()}
    assert known == {("x:p", m, 1) for m in members} | {("x:q", "x:int", 1)}
    assert ontology.describe_entity(held, "x:none").count() == 0 and ontology.properties_of(held.limit(0)).count() == 0


def test_star_patterns_equal_single_ones(spark):
    rng = np.random.default_rng(3)
    rows = [(f"x:s{rng.integers(0, 6)}", f"p{rng.integers(0, 3)}", str(rng.choice(["x:s1", "x:s2", "u", "v"])), f"g{rng.integers(0, 2)}/") for _ in range(60)] + [("x:s1", "p0", "x:s1"), ("x:s1", "p0", "x:s1")]
    held = quads(spark, rows)
    for wanted in ([("?a", "p0", "?b"), ("?a", "p1", "?c")], [("?a", "p0", "?b"), ("?a", "p1", "?b")], [("?a", "p0", "u"), ("?a", "p2", "?c"), ("?a", "p1", "?d")], [("?a", "p0", "?a"), ("?a", "p1", "?b")]):
        for per_graph in (False, True):
            got = patterns.match(held, wanted, per_graph=per_graph)
            alone = [patterns._one(held, p, per_graph) for p in wanted]
            want = alone[0]
            for more in alone[1:]:
                want = want.join(more, [c for c in more.columns if c in want.columns])
            columns = sorted(want.columns)
            assert sorted(got.columns) == columns
            assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_two_stars_need_one_join(spark):
    held = quads(spark, [("x:a", "near", "x:b"), ("x:a", "size", "1"), ("x:b", "name", "n"), ("x:b", "kind", "k"), ("x:b", "name", "m")])
    out = patterns.match(held, [("?a", "near", "?b"), ("?b", "name", "?n"), ("?a", "size", "?z"), ("?b", "kind", "?k")])
    assert sorted(r.n for r in out.collect()) == ["m", "n"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    with pytest.raises(ValueError):
        patterns.match(held, [("?a", "near", "?b"), ("?c", "name", "?n")])


def test_facets_in_each_form(spark):
    rows = [("1", "a", "Rome", "u:rome"), ("2", "a", "Rome", "u:rome"), ("3", "a", "Rome", "u:other"), ("3", "a", "text", None), ("4", "b", "red", None)]
    fields = spark.createDataFrame(rows, "uid string, attr string, value string, obj_uri string")
    found = {form: sorted((r.attr, r.uri, r.label, r.n) for r in rank.facet_values(fields, ["a", "b"], -1, form).collect()) for form in rank.FORMS}
    assert found["uri"] == [("a", "u:other", None, 1), ("a", "u:rome", None, 2), ("b", None, "red", 1)]
    assert found["literal"] == [("a", None, "Rome", 3), ("b", None, "red", 1)]
    assert found["uriliteral"] == [("a", "u:other", "Rome", 1), ("a", "u:rome", "Rome", 2), ("b", None, "red", 1)]
    with pytest.raises(ValueError):
        rank.facet_values(fields, ["a"], form="both")


def test_escapes_comments_and_blank_nodes_of_triples(spark):
    lines = [r'<a> <b> "café \U0001F600 \b\t\"q\" \\u0041 \\" .', r'<a> <b> "x" . # "note" .', r'<a> <b> "x \q" .', r'<a> <b> "a \" . # b" .', r'<a> <b> "" .', r"_:x <b> _:y . # c", r'<aé> <b> "x"@en . #', r'<a> <b> "\ud800" .', "<a> <b> \"u\u0001v\\n\" .", r'<a> <b> "x"y" .', '<a> <b> "' + "z\\n" * 20_000 + '" .']
    frame = spark.createDataFrame([(v, k) for k, v in enumerate(lines)], "value string, pos long")
    good, bad = readers.parse_ntriples(frame, "g")
    objects = {r.pos: r.o for r in good.collect()}
    assert objects == {0: 'café 😀 \b\t"q" \\u0041 \\', 1: "x", 3: 'a " . # b', 4: "", 5: "_:y", 6: "x", 8: "u\u0001v\n", 10: "z\n" * 20_000}
    assert sorted(r.pos for r in bad.collect()) == [2, 7, 9]
    assert {r.s for r in good.filter("pos IN (5, 6)").collect()} == {"_:x", "aé"}
    files = frame.withColumn("file", F.lit("one")).union(frame.withColumn("file", F.lit("two")))
    blanks = readers.parse_ntriples(files, "g")[0].filter("pos = 5").collect()
    assert len({r.s for r in blanks}) == 2 and all(r.s.startswith("_:") and r.o.startswith("_:") for r in blanks)


def test_linked_json_is_json(spark):
    held = quads(spark, [('http://g/a"b\\', "http://p/name", 'say "x"'), ("g/in", "http://p/name", "y")])
    lines = [json.loads(r.value) for r in writers.linked_json_lines(held, spark.createDataFrame([], "name string, map_to string")).collect()]
    assert sorted(x["id"] for x in lines) == ['http://g/a"b\\', "in"] and sorted(x["name"][0] for x in lines) == ['say "x"', "y"]


def test_a_line_of_triples_is_matched_once(spark):
    line = '<http://s> <http://p> "a \\\\ \\" b ' + "word " * 50_000 + '"@en .'
    frame = spark.createDataFrame([(line, 0), ("_:a <p> _:b . # c", 1), ("\n<s>\n<p>\n<o>\n.\n", 2), ("a\nb\nc\nd\ne\nf\ng\nh", 3), ("", 4)], "value string, pos long")
    good, bad = readers.parse_ntriples(frame, "g")
    plan = good._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\.\\s*(?:#.*)?$") == 2 and "regexp_extract(value" not in plan
    got = {r.pos: (r.s, r.p, r.o, r.o_kind, r.o_lang) for r in good.collect()}
    assert got == {0: ("http://s", "http://p", 'a \\ " b ' + "word " * 50_000, "literal", "en"), 1: ("_:a", "p", "_:b", "bnode", None), 2: ("s", "p", "o", "uri", None)}
    assert [r.pos for r in bad.collect()] == [3]
