"""Semantics of single operators on tiny rows: order, ties, nulls, refusals, and file round trips."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quadloom.functions import uris
from quadloom.functions.stemming import stem
from quadloom.model import LABEL, LAT, LONG, QUADS, RDFS, STATEMENT, STATEMENTS, TYPE
from quadloom.operators import access, index, mapping, ontology, patterns, rank, records, revisions, search, tagging, writes
from quadloom.plans.fixtures import DS, ONTO, Tables
from quadloom.sinks import writers
from quadloom.sources import readers

SMALL = "/root/testdata/sf0.001"


def quads(spark, rows):
    """rows: (s, p, o[, kind, lang, pos])"""
    full = [("g/", s, p, o, (r or ["literal"])[0], None, (r + [None] * 3)[1] if r else None, (r + [None] * 3)[2] if len(r) > 2 else k) for k, (s, p, o, *r) in enumerate(rows)]
    return spark.createDataFrame(full, QUADS)


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_label_falls_back_to_local_name_and_first_wins(spark):
    q = quads(spark, [("x/Big_Thing", "p", "1"), ("x/b", LABEL, "second", "literal", None, 5), ("x/b", LABEL, "first", "literal", None, 1), ("x/b", "http://www.w3.org/2000/01/rdf-schema#label", "other")])
    assert values(mapping.pref_label(q), "s", "label") == [("x/Big_Thing", "Big_Thing"), ("x/b", "first")]
    assert values(mapping.alt_labels(q), "label") == [("other",)]
    labels = {r.pref_label: r.alt_labels for r in index.index_labels(q, ["en"]).collect()}
    assert labels == {"Big_Thing": [], "first": ["second", "other"]}


def test_text_operators_and_at_least_n(spark):
    texts = spark.createDataFrame([("1", "a b c"), ("2", "a b"), ("3", "a a a"), ("4", None)], "uid string, text string")
    assert values(search.filter_text(texts, "a b c", "or", 2), "uid") == [("1",), ("2",)]
    assert values(search.filter_text(texts, "C A"), "uid") == [("1",)]
    assert search.filter_text(texts, "").count() == 4


def test_one_point_must_satisfy_both_axes(spark):
    docs = spark.createDataFrame([("1", [("point", 0.0, 50.0, None), ("point", 50.0, 0.0, None)]), ("2", [("point", 1.0, 1.0, None)])], "uid string, points array<struct<kind:string,lat:double,long:double,alt:double>>")
    assert values(search.filter_box(docs, 10, 10, -10, -10), "uid") == [("2",)]
    assert search.filter_core(docs, "lat", "none").count() == 2
    assert values(search.filter_distance(docs, 0, 50.1, 20), "uid") == [("1",)]


def test_incomplete_points_and_decimal_comma(spark):
    q = quads(spark, [("a", LAT, "1,5"), ("a", LONG, "2"), ("b", LAT, "3"), ("c", LAT, "x"), ("c", LONG, "1")])
    assert values(index.index_geo(q), "lat", "long") == [(1.5, 2.0)]


def test_all_datasets_must_be_permitted(spark):
    grants = spark.createDataFrame([("u1", "g1", "d1", ["search"], False, True, False, False)], "access_uri string, group string, dataset string, services array<string>, c boolean, r boolean, u boolean, d boolean")
    groups, members = spark.createDataFrame([("g1", "app")], "group string, app_id string"), spark.createDataFrame([("me", "g1")], "user string, group string")
    known = spark.createDataFrame([("d1",), ("d2",)], "dataset string")
    asked = [("one", ["d1"], True), ("both", ["d1", "d2"], True), ("unknown", ["d9"], True), ("none", [], True), ("write", ["d1"], False)]
    requests = spark.createDataFrame([(r, "me", "app", "search", d, not read, read, False, False) for r, d, read in asked], "request string, user string, app_id string, service string, datasets array<string>, c boolean, r boolean, u boolean, d boolean")
    assert values(access.authorize(requests, grants, groups, members, known), "request", "allowed") == [("both", False), ("none", False), ("one", True), ("unknown", False), ("write", False)]


def test_soft_delete_archives_only_published(spark):
    t = Tables(spark, SMALL)
    rev = spark.createDataFrame([("r1", "g/", "s1", 1, "p", "published"), ("r2", "g/", "s1", 2, "p", "staging"), ("r3", "g/", "s2", 1, "p", "published")], "rev_uri string, dataset string, record_uri string, rev_time long, performer string, status string")
    store = {"quads": quads(spark, [("s1", "p", "1"), ("s2", "p", "1")]), "statements": spark.createDataFrame([("g/", "x", "s1", "p", "1", "m", "v")], STATEMENTS), "revisions": rev, "revision_quads": t.revision_quads}
    keys = spark.createDataFrame([("g/", "s1")], "g string, s string")
    soft = writes.delete_records(store, keys)
    assert values(soft["revisions"], "rev_uri", "status") == [("r1", "archive"), ("r2", "staging"), ("r3", "published")]
    assert soft["statements"].count() == 0 and values(soft["quads"], "s") == [("s2",)]
    assert values(writes.delete_records(store, keys, "hard")["revisions"], "rev_uri") == [("r3",)]
    with pytest.raises(ValueError):
        writes.create_records(store, quads(spark, [("s1", TYPE, "c")]), store["statements"])
    with pytest.raises(ValueError):
        revisions.delete_revisions(rev, t.revision_quads, rev.filter("rev_uri = 'r1'").select("rev_uri"))


def test_update_twice_is_once(spark):
    old, new = quads(spark, [("s1", "p", "1"), ("s2", "p", "1")]), quads(spark, [("s1", "p", "2"), ("s3", "p", "3")])
    once = writes.update_records(old, new)
    assert values(once, "s", "o") == values(writes.update_records(once, new), "s", "o") == [("s1", "2"), ("s2", "1"), ("s3", "3")]


def test_diff_applied_to_left_gives_right(spark):
    t = Tables(spark, SMALL)
    pair = revisions.predecessors(t.revisions).limit(1).first()
    diff = revisions.diff_revisions(t.revision_quads, t.revisions, pair.before, pair.rev_uri).collect()
    content = lambda uri: {(r.p, r.o) for r in t.revision_quads.filter(F.col("rev_uri") == uri).collect()}
    gone, come = ({(r.p, r.o) for r in diff if r.change == c} for c in ("removal", "addition"))
    assert content(pair.before) - gone | come == content(pair.rev_uri)
    other = t.revisions.filter(F.col("record_uri") != pair.record_uri).first().rev_uri
    with pytest.raises(ValueError):
        revisions.diff_revisions(t.revision_quads, t.revisions, pair.rev_uri, other)


def test_closure_with_cycle_and_diamond(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "b"), ("d", "c"), (None, "x")], "sub string, super string")
    got = set(values(ontology.transitive(edges), "sub", "super"))
    assert got == {(x, y) for x in "abcd" for y in "abc"}
    assert {r.super for r in ontology.class_closure(edges).filter("sub = 'd'").collect()} == {"a", "b", "c", "http://www.w3.org/2002/07/owl#Thing"}
    assert ontology.transitive(edges.limit(0)).count() == 0


def test_reify_aligned_by_position_and_references(spark):
    rows = spark.createDataFrame([(1, "a", 0, "x||y||"), (1, "a&b", 0, "1||2"), (1, "r", 0, "@@http://e/z"), (1, "s", 0, "@z")], "rec int, attr string, value_pos int, value string")
    out = mapping.attach_reify_columns(mapping.split_values(rows)).filter("attr = 'a'").collect()
    assert sorted((r.value, r.meta["b"]) for r in out) == [("x", ["1"]), ("y", ["2"])]
    assert values(mapping.resolve_references(rows.filter("attr IN ('r', 's')"), "base/"), "o", "o_kind") == [("base/z", "uri"), ("http://e/z", "uri")]


def test_dates(spark):
    rows = spark.createDataFrame([("1960-02-29",), ("1995-03-04T05:06:07Z",), ("4 May",), (None,), ("12 Jan 2001",), ("1999",)], "d string")
    got = [r[0] for r in rows.select(uris.iso(uris.safe_date(F.col("d")))).collect()]
    assert got == ["1960-02-29T00:00:00Z", "1995-03-04T05:06:07Z", None, None, "2001-01-12T00:00:00Z", "1999-01-01T00:00:00Z"]


def test_sort_refuses_multi_valued_and_page_limits(spark):
    docs = spark.createDataFrame([("1", ["t"]), ("2", ["a"])], "uid string, types array<string>")
    fields = spark.createDataFrame([("1", "k", 2, False), ("2", "k", 1, True)], "uid string, attr string, int long, single_valued boolean")
    with pytest.raises(ValueError):
        rank.sort_records(docs, ["k asc"], fields)
    assert [r.uid for r in rank.sort_records(docs, ["type asc"]).collect()] == ["2", "1"]
    for bad in ((0, 301), (-1, 5)):
        with pytest.raises(ValueError):
            rank.page(docs, *bad)


def test_expression_and_patterns_refuse_unknown(spark):
    docs = spark.createDataFrame([("1",)], "uid string")
    with pytest.raises(ValueError):
        search.filter_expression(docs, search.Attr("x", docs), {"y"})
    with pytest.raises(ValueError):
        patterns.match(quads(spark, [("a", "p", "b")]), [("?x", "p", "?y"), ("?z", "p", "?w")])
    assert values(patterns.match(quads(spark, [("a", "p", "a"), ("a", "p", "b")]), [("?x", "p", "?x")]), "x") == [("a",)]


def test_tagging_prefers_longest_then_earliest(spark):
    docs = spark.createDataFrame([(1, "New York City hall, new york"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([("ny", "New York"), ("nyc", "new york city"), ("ch", "city hall"), ("e", "")], "concept string, label string")
    assert values(tagging.tag_concepts(docs, labels), "concept", "first", "last") == [("ny", 4, 6), ("nyc", 0, 3)]
    stems = spark.createDataFrame([("run", "running")], "concept string, label string")
    assert values(tagging.tag_concepts(spark.createDataFrame([(1, "runnings")], "doc_id long, text string"), stems, stemming=True), "concept") == [("run",)]


#: Words of the published description of the stemmer and their stems after all five steps.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor
sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail
filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit conformably conform radically radic
differently differ vilely vile analogously analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formality formal sensitivity sensit sensibility sensibl triplicate triplic
formative form formalize formal electricity electr electrical electr hopeful hope goodness good revival reviv allowance allow
inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac
adjustment adjust dependent depend adoption adopt communism commun activate activ angularity angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll running run runs run babies babi
baby babi generalizations gener oscillators oscil enjoying enjoi yes ye as as toying toi""".split()


def test_stems_of_the_published_examples(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2]))
    got = {r.w: r.s for r in spark.createDataFrame(pairs, "w string, want string").select("w", stem(F.col("w")).alias("s")).collect()}
    assert got == dict(pairs)


def test_tagging_equals_trying_every_label(spark):
    rng = random.Random(5)
    labels = {tuple(rng.choice("abc") for _ in range(rng.randint(1, 7))): f"c{k}" for k in range(25)}
    texts = [(k, " ".join(rng.choice("abcx") for _ in range(rng.randint(0, 60)))) for k in range(150)] + [(900, None), (901, "")]
    want = []
    for k, text in texts:
        words, taken = (text or "").split(), set()
        for n, first in sorted((-len(w), i) for w in labels for i in range(len(words)) if tuple(words[i : i + len(w)]) == w):
            if not taken & set(range(first, first - n)):
                taken |= set(range(first, first - n))
                want.append((k, labels[tuple(words[first : first - n])], first, first - n))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    names = spark.createDataFrame([(c, " ".join(w)) for w, c in labels.items()] + [("none", ""), ("null", None)], "concept string, label string")
    for most in (1 << 20, 0):  # the automaton, the joins
        assert sorted(values(tagging.tag_concepts(docs, names, broadcast_bytes=most), "doc_id", "concept", "first", "last")) == sorted(want)
    assert tagging.tag_concepts(docs, names.limit(0)).count() == 0 and tagging.tag_concepts(docs.limit(0), names).count() == 0


def test_hub_target_is_one_label_row(spark):
    q = quads(spark, [(f"s{i}", "to", "hub", "uri") for i in range(500)] + [("hub", LABEL, "Hub")])
    assert {r.obj_label for r in index.index_object_labels(q, q).collect()} == {"Hub"}
    assert records.links_back(q, spark.createDataFrame([("hub",)], "s string")).count() == 500


ODD = 'say "hi"\n\\back|| @x @@y é <&>'


def test_ntriples_files(spark, tmp_path):
    q = quads(spark, [("http://e/a", "http://e/p", ODD), ("http://e/a", "http://e/p", "salut", "literal", "fr"), ("http://e/a", "http://e/q", "http://e/b", "uri")])
    writers.write_lines(writers.ntriples_lines(q), f"{tmp_path}/out")
    (tmp_path / "out" / "more.txt").write_text('# note\n\n<http://e/a> <http://e/p> "broken .\n<http://e/a> <http://e/p> "a" b" .\n')
    got, errors = readers.read_ntriples(spark, f"{tmp_path}/out", "g/")
    assert values(got, "s", "p", "o", "o_kind", "o_lang") == values(q, "s", "p", "o", "o_kind", "o_lang") and errors.count() == 2


def test_record_xml_files(spark, tmp_path):
    text = '<resultset><prefix entity="ex" uri="http://e/"/><subject type="http://e/C" uri="http://e/a"><predicate type="ex:p"><object type="" lang="fr">un &amp; deux</object><reify type="m" value="1"/><reify type="m" value="2"/></predicate><predicate type="ex:q"><object uri="http://e/b"><reify type="n" value="3"/></object></predicate></subject></resultset>'
    (tmp_path / "a.xml").write_text(text)
    got, said = readers.read_record_xml(spark, f"{tmp_path}/a.xml")
    assert values(got, "g", "p", "o") == [("unspecified", "http://e/p", "un & deux"), ("unspecified", "http://e/q", "http://e/b"), ("unspecified", TYPE, "http://e/C")]
    assert values(said, "rei_p", "rei_o") == [("m", "1"), ("m", "2"), ("n", "3")]


def test_sectioned_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('&&dataset\n&id,&prefLabel\nd1,Data\n\n&&recordList\n&id,&type,&note\nr1,T,"two\nlines"\n,,more\nr2,T\nr3,T,x,too many\n&&linkage\n&attributeList,&mapTo\nnote,http://e/note\n')
    rows = readers.read_sectioned_csv(spark, f"{tmp_path}/a.csv").collect()
    assert [(r.id, r.attr, r.cell) for r in rows if r.section == "recordList"] == [("r1", "type", "T"), ("r1", "note", "two\nlines"), ("r1", "note", "more"), ("r2", "type", "T"), (None, "_error", "too many cells")]
    assert [(r.attr, r.cell) for r in rows if r.section == "linkage"] == [("attributeList", "note"), ("mapTo", "http://e/note")]


def test_record_json_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"dataset": {"id": "d", "linkage": {"linkedType": "x", "prefixList": {"ex": "http://e/"}, "attributeList": {"year": {"mapTo": "ex:year"}}, "typeList": {"Book": {"mapTo": "ex:Book"}}}}, "recordList": [{"id": "a", "type": "Book", "year": "1999", "keyword": ["x", "y"], "author": [{"ref": "@p", "role": "first"}, {"ref": "@@http://e/q"}]}, {"name": "no id"}]}')
    got, dataset, linkage = readers.read_record_json(spark, f"{tmp_path}/a.json")
    rows = [(r.attr, r.pos, r.value, r.ref, r.meta) for r in got.filter("id = 'a'").collect()]
    assert sorted(rows, key=str) == sorted([("type", 0, "Book", None, None), ("year", 0, "1999", None, None), ("keyword", 0, "x", None, None), ("keyword", 1, "y", None, None), ("author", 0, None, "@p", {"role": "first"}), ("author", 1, None, "@@http://e/q", {})], key=str)
    assert got.filter("id != 'a'").select("attr", "value").collect() and values(linkage, "kind", "name", "map_to") == [("attribute", "year", "ex:year"), ("prefix", "ex", "http://e/"), ("type", "Book", "ex:Book")]
    resolved = mapping.resolve_linkage(linkage.withColumn("ord", F.lit(0)).filter("kind != 'prefix'"), linkage.filter("kind = 'prefix'").select(F.col("name").alias("prefix"), F.col("map_to").alias("uri")))
    assert values(resolved, "map_to", "error") == [("http://e/Book", None), ("http://e/year", None)] and dataset.count() == 1


def test_namespace_files(spark, tmp_path):
    (tmp_path / "n.csv").write_text("ex,http://e/\nbad,not an iri\none\nskos,http://other/\n")
    got = dict(values(readers.read_namespaces(spark, f"{tmp_path}/n.csv"), "prefix", "uri"))
    assert got["ex"] == "http://e/" and got["skos"] == "http://other/" and "bad" not in got and "rdf" in got


def test_json_and_xml_escapes(spark):
    import json
    import xml.etree.ElementTree as xml

    q = quads(spark, [("http://e/a", TYPE, "http://e/C", "uri"), ("http://e/a", "http://e/p", ODD)])
    line = json.loads(writers.record_json_lines(q).first().value)
    assert line["predicate"] == [{"http://e/p": ODD}] and line["type"] == "http://e/C"
    assert xml.fromstring(writers.record_xml_lines(q).first().value).findall("predicate/object")[-1].text == ODD
    assert ODD in xml.fromstring("<r xmlns:rdf='http://r'>" + writers.rdfxml_lines(q).first().value + "</r>").itertext()


def test_plans_have_no_cross_join_and_no_python(spark):
    from quadloom.plans.catalogue import QUERIES

    for name in ("b14_build_index_fields", "r9_facet_core", "g5_links_back", "v8_diff_revisions", "q1_match"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "Python" not in plan and "NestedLoop" not in plan, name


def test_facets_sum_to_hits(spark):
    t = Tables(spark, SMALL)
    fields = index.with_uid(t.quads("part").filter(F.col("p") == f"{ONTO}brand")).select("uid", F.col("p").alias("attr"), F.col("o").alias("value"), F.lit(None).cast("string").alias("obj_uri"))
    assert rank.facet_values(fields, [f"{ONTO}brand"], -1).agg(F.sum("n")).first()[0] == t.raw("part").count()
    assert DS


def test_dates_take_offsets_and_ignore_the_session_zone(spark):
    rows = [("2020-05-01T10:00:00+02:00",), ("2020-05-01T10:00:00-0500",), ("2020-05-01T10:00:00Z",), ("2020-05-01 10:00:00",), ("1995-03-15",), ("x",)]
    frame = spark.createDataFrame(rows, "d string")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = [r[0] for r in frame.select(uris.iso(uris.safe_date(F.col("d")))).collect()]
            assert got == ["2020-05-01T08:00:00Z", "2020-05-01T15:00:00Z", "2020-05-01T10:00:00Z", "2020-05-01T10:00:00Z", "1995-03-15T00:00:00Z", None], zone
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_sectioned_csv_numbers_unknown_bases_and_keeps_datasets_apart(spark):
    rows = [("d1/", "s", "http://x.org/name", "A"), ("d1/", "s", "http://y.org/name", "B"), ("d2/", "s", "http://x.org/name", "C")]
    quads = spark.createDataFrame([(*r, "literal", None, None, 0) for r in rows], QUADS)
    records, linkage = writers.sectioned_csv_lines(quads, spark.createDataFrame([], "prefix string, uri string"))
    got = [r.value for r in records.collect()]
    assert got[:2] == ["&&recordList", "&id,&type,&ns1:name,&ns2:name"] and sorted(got[2:]) == ["s,,A,B", "s,,C,"]
    assert [r.value for r in linkage.collect()][3:] == ["ns1:name,http://x.org/name", "ns2:name,http://y.org/name"]


def test_one_cut_of_words_for_queries_and_texts(spark):
    texts = spark.createDataFrame([("1", "the nation_1 here", "en", "a"), ("2", "nation one", "fr", "b")], "uid string, text string, lang string, field string")
    assert [r.uid for r in search.filter_text(texts, "Nation_1").collect()] == ["1"]
    assert [r.uid for r in search.filter_text(texts, "nation", lang="fr").collect()] == ["2"]
    assert [r.uid for r in search.filter_text(texts, "nation", fields=["a"]).collect()] == ["1"]


def test_expressions_refuse_closed_datasets(spark):
    docs = spark.createDataFrame([("1", "a/"), ("2", "b/")], "uid string, dataset string")
    open_ = spark.createDataFrame([("a/",)], "dataset string")
    assert [r.uid for r in search.filter_expression(docs, search.Dataset("a/"), accessible=open_).collect()] == ["1"]
    with pytest.raises(ValueError):
        search.filter_expression(docs, search.Not(search.Dataset("b/")), accessible=open_)


def test_suggestions_reach_the_first_letter(spark):
    words = spark.createDataFrame([("house", 9), ("mouse", 4), ("hose", 1)], "term string, freq long")
    got = {(r.term, r.suggestion, r.edits) for r in rank.suggest(spark.createDataFrame([("xouse",), ("house",), ("",)], "term string"), words).collect()}
    assert got == {("xouse", "house", 1), ("xouse", "mouse", 1), ("xouse", "hose", 2)}


def test_references_and_mapping_triples(spark):
    rows = spark.createDataFrame([("@@x:a",), ("@b",), ("c",)], "value string")
    assert [(r.o, r.o_kind) for r in mapping.resolve_references(rows, "ds/", {"x": "http://x.org/"}).collect()] == [("http://x.org/a", "uri"), ("ds/b", "uri"), ("c", "literal")]
    linkage = spark.createDataFrame([("type", "http://x.org/T", "http://o.org/C"), ("attribute", "name", "http://o.org/p")], "kind string, name string, map_to string")
    assert [tuple(r) for r in mapping.mapping_triples(linkage).collect()] == [("http://x.org/T", f"{RDFS}subClassOf", "http://o.org/C")]


def test_reads_anywhere_move_quads_once_and_take_the_first_dataset(spark):
    rows = [(g, "a", "p", o, "literal", None, None, k) for k, (g, o) in enumerate([("g2/", "x"), ("g1/", "x"), ("g1/", "x"), ("closed/", "y"), ("g2/", "z" * 5000)])]
    q = spark.createDataFrame([*rows, ("g1/", "other", "p", "x", "literal", None, None, 0)], QUADS)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = records.read_records_anywhere(q, spark.createDataFrame([("a",), ("a",)], "s string"), spark.createDataFrame([("g1/",), ("g2/",)], "g string"))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out.columns == q.columns and "hashpartitioning(g" not in plan and "Window" not in plan
    assert values(out, "g", "s", "o", "pos") == [("g1/", "a", "x", 1), ("g2/", "a", "z" * 5000, 4)]


def test_phrases_compare_only_places_of_query_words(spark):
    """Against every window of every value, at random; a value of a million other words is no work for each of its places."""
    rng = random.Random(4)
    made = [(k, "a", " ".join(rng.choice("of the x y z Of,THE".split()) for _ in range(rng.randrange(12)))) for k in range(200)]
    long = [(1000, "a", "the " + "x " * 1_000_000 + "of x the"), (1001, "a", None), (1002, "a", "x"), (1003, "b", "of the")]
    fields = spark.createDataFrame(made + long, "uid long, attr string, value string")
    for query, slop in (("of the", 0), ("of the", 1), ("the of the", 2), ("x", 0), ("y of z", 3)):
        wanted, width = set(query.split()), len(query.split()) + slop
        words = {u: uris.query_words(v or "") for u, a, v in made + long if a == "a"}
        want = {u for u, w in words.items() if any(wanted <= set(w[i : i + width]) for i in range(len(w)))}
        assert {r.uid for r in rank.boost_phrase(fields, query, {"a": 2.0}, slop).collect()} == want, query
    assert rank.boost_phrase(fields, "", {"a": 2.0}).count() == sum(1 for w in words.values() if w)


def test_record_xml_is_parsed_once_for_both_results(spark):
    xml = ['<subject uri="a" type="T"><predicate type="http://purl.org/dc/terms/isPartOf"><object uri="g2"/><object uri="g1"/></predicate><predicate type="p"><object uri="b"><reify type="m" value="1"/></object><object>x</object><reify type="n" value="2"/></predicate></subject>',
           '<subject uri="a"><predicate type="q"></predicate><predicate type="p"><object>y</object></predicate></subject>', '<subject uri="c"></subject>']
    subjects = spark.createDataFrame([(x,) for x in xml], "value string").select(F.from_xml("value", readers.SUBJECT_XML).alias("x")).select("x.*")
    out = readers.parse_record_xml(subjects)
    assert not any("xml" in df._jdf.queryExecution().optimizedPlan().toString().replace("record_xml", "") for df in out)
    assert values(out[0], "g", "s", "p", "o", "o_kind", "pos") == [("g1", "a", TYPE, "T", "uri", 0), ("g1", "a", "p", "b", "uri", 2), ("g1", "a", "p", "x", "literal", 2), ("g1", "a", "p", "y", "literal", 2)]
    assert values(out[1], "o", "rei_p", "rei_o") == [("b", "m", "1"), ("b", "n", "2"), ("x", "n", "2")]


def test_statements_are_combined_before_their_triples_are_made(spark):
    rows = [("a", "p", "o", {"m": ["1", None], "n": ["1"]}), ("a", "p", "o", {"m": ["1", "2"], TYPE: [STATEMENT]}), ("ap", "", "o", {"m": ["1"]}), ("b", "p", "o", {}), ("c", "p", "o", None), ("d", "p", None, {"m": ["1"]})]
    made = spark.createDataFrame(rows, "s string, p string, o string, meta map<string,array<string>>")
    out = mapping.reify_statements(made.filter("o IS NOT NULL"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    rdf = TYPE.removesuffix("type")
    want = [(TYPE, STATEMENT), *((f"{rdf}subject", s) for s in ("a", "ap")), *((f"{rdf}predicate", p) for p in ("p", "")), (f"{rdf}object", "o"), ("m", "1"), ("m", "2"), ("m", None), ("n", "1")]
    assert values(out, "rei_p", "rei_o") == sorted(want, key=str) and out.select("stmt").distinct().count() == 1


def test_statement_lines_are_made_after_statements_are_combined(spark):
    rows = [("g", "m", "http://s", "p", 'say "x"', "by", o) for o in ("me", "you", "me", None)] + [("g", "m", "http://sp", "", 'say "x"', "by", "me"), ("g", "m", "_:s", "p", "http://o", "by", 'a\nb'), ("g", "m", None, "p", "o", "by", "x")]
    out = writers.ntriples_lines(quads(spark, []), spark.createDataFrame(rows, STATEMENTS))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    lines = sorted(r.value.split(" ", 1)[1].removeprefix("<http://www.w3.org/1999/02/22-rdf-syntax-ns#") for r in out.collect())
    said = ['object> "say \\"x\\"" .', "predicate> <> .", "predicate> <p> .", "subject> <http://s> .", "subject> <http://sp> .", "type> <http://www.w3.org/1999/02/22-rdf-syntax-ns#Statement> .", '<by> "me" .', '<by> "you" .']
    assert lines == sorted([*said, "object> <http://o> .", "predicate> <p> .", "subject> _:s .", "type> <http://www.w3.org/1999/02/22-rdf-syntax-ns#Statement> .", '<by> "a\\nb" .'])


def test_quads_move_once_to_their_record(spark):
    rows = [("a", "p", "2", "literal", None, 3), ("a", "p", "1", "literal", None, 9), ("a", "p", "2", "literal", None, 1), ("a", "p", "2", "literal", "en", 1), ("a", "p", "2", "uri", None, 2), ("a", TYPE, "T", "uri", None, 5), ("a", TYPE, "S", "uri", None, 4), ("b", LABEL, "z", "literal", None, 2), ("b", LABEL, "y", "literal", None, 3)]
    q = quads(spark, rows).unionByName(spark.createDataFrame([("g/", "a", "p", "1", "literal", None, None, None)], QUADS))
    out = mapping.quads_to_records(q)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    a, b = sorted(out.collect(), key=lambda r: r.s)
    assert [(v.value, v.uri, v.lang) for v in a.attributes["p"]] == [("2", None, None), ("2", None, "en"), (None, "2", None), ("1", None, None)]
    assert (a.types, a.pref_label, b.pref_label, b.types, b.attributes) == (["S", "T"], "a", "z", [], {})


def test_bindings_meet_their_statements_in_one_sum(spark):
    md5 = lambda *x: hashlib.md5("".join(x).encode()).hexdigest()
    made = [("g", "s", "p", "o", "uri", None, md5("spo"), "by", v) for v in ("2", "1", "2", None)] + [("g", "s", "p", "x", None, "en", None, None, None), ("g", "t", "p", "y", None, None, md5("spx"), "by", "far"), ("g", "t", "p", None, None, None, md5("none"), "by", "lost")]
    bindings = spark.createDataFrame(made, "g string, s string, p string, o string, otype string, olang string, rei_s string, rei_p string, rei_o string")
    out = patterns.bindings_to_records(bindings)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    got = {r.s: [(v.value or v.uri, v.reify) for v in r.attributes["p"]] for r in out.collect()}
    assert got == {"s": [("o", '{"by":["1","2"]}'), ("x", '{"by":["far"]}')], "t": [(None, None), ("y", None)]}
