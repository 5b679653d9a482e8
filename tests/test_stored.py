"""Stored tables: versions, the maintained index against rebuilds, the inverted index against the texts, large equivalences."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadloom.model import LABEL, QUADS, STATEMENTS, TYPE, XSD
from quadloom.operators import maintain, rank, search
from quadloom.operators.components import equivalence_classes
from quadloom.operators.index import build_index
from quadloom.operators.lineage import new_folder
from quadloom.operators.ontology import class_closure
from quadloom.operators.postings import Postings, build_postings
from quadloom.sources.versioned import GRAPH, VersionConflict, VersionedTable

SCHEMA = "g string, s string, o string"


def rows(df):
    return Counter(tuple(r) for r in df.select("g", "s", "o").collect())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_versions_replace_append_drop_and_vacuum(spark):
    path = new_folder(spark, "test")
    data = [(f"g{i % 3}", f"s{i % 40}", f"o{i}") for i in range(400)]
    first = VersionedTable.create(spark.createDataFrame(data, SCHEMA), path, "s", "g", slices=8, buckets=4)
    assert rows(first.read()) == Counter(data)
    new = [("g1", "s7", "new"), ("g1", "s7", "new"), ("g9", "s1000", "other")]
    second = first.replace(spark.createDataFrame([("g1", "s7"), ("g2", "s3"), ("g2", "none")], "g string, s string"), spark.createDataFrame(new, SCHEMA))
    want = [r for r in data if r[:2] not in {("g1", "s7"), ("g2", "s3")}] + new
    assert rows(second.read()) == Counter(want)
    assert rows(first.read()) == Counter(data)  # a reader of the old version is not disturbed
    written = [p for p in second.parts if p[2] == 2]
    assert len(written) <= 4 and set(second.parts) - set(written) < set(first.parts)
    third = second.append(spark.createDataFrame([("g1", "s7", "more")], SCHEMA)).drop_graph("g0")
    assert rows(third.read()) == Counter([r for r in want if r[0] != "g0"] + [("g1", "s7", "more")])
    assert rows(VersionedTable.open(spark, path, 2).read()) == Counter(want) and VersionedTable.open(spark, path).version == 4
    assert rows(third.of_keys(spark.createDataFrame([("s7",), ("s7",)], "s string"))) == Counter(r for r in rows(third.read()).elements() if r[1] == "s7")
    with pytest.raises(VersionConflict):
        second.append(spark.createDataFrame([("g1", "s1", "late")], SCHEMA))
    with pytest.raises(VersionConflict):
        VersionedTable.create(spark.createDataFrame(data, SCHEMA), path, "s", "g")
    before = rows(third.read())
    assert third.vacuum() > 0 and rows(third.read()) == before and third.versions() == [4]
    with pytest.raises(ValueError):
        VersionedTable.open(spark, path, 2)


def test_replacing_does_not_shuffle_what_is_stored(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = VersionedTable.create(spark.createDataFrame([("g", f"s{i}", "o") for i in range(100)], SCHEMA), new_folder(spark, "test"), "s", "g", 4, 4)
        graphs = spark.createDataFrame([("s1", ["g"])], "s string, gs array<string>")
        old = held._rows(held.parts, with_parts=True)
        plan = plan_of(old.join(graphs, (old.s == graphs.s) & F.array_contains(graphs.gs, old[GRAPH]), "left_anti"))
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_tables_and_changes(spark):
    none = spark.createDataFrame([], SCHEMA)
    empty = VersionedTable.create(none, new_folder(spark, "test"), "s", "g", 2, 2)
    assert empty.read().count() == 0
    one = empty.replace(none.select("g", "s"), spark.createDataFrame([("g", "s", "o")], SCHEMA))
    same = one.replace(none.select("g", "s"), none)
    assert same.version == 3 and rows(same.read()) == Counter([("g", "s", "o")])
    assert same.replace(spark.createDataFrame([("g", "s")], "g string, s string"), none).read().count() == 0


CLASSES = [("c1", "top"), ("c2", "c1"), ("c3", "c1")]


def random_records(rng, names):
    out = []
    for name in names:
        g = f"g{name % 2}/"
        made = [(TYPE, f"c{rng.integers(1, 4)}", "uri"), ("size", str(rng.integers(0, 50)), "literal")]
        made += [(LABEL, f"label {rng.integers(0, 1000)}", "literal")] * int(rng.integers(0, 2))
        made += [("near", f"r{rng.integers(0, 25)}", "uri") for _ in range(int(rng.integers(0, 4)))]
        out += [(g, f"r{name}", p, o, kind, None, None, k) for k, (p, o, kind) in enumerate(made)]
    return out


def index_rows(docs, fields):
    listed = docs.select("uid", "dataset", "uri", "types", "inferred_types", "pref_label", "alt_labels", "description")
    return sorted(map(str, listed.collect())), sorted(map(str, fields.select(*sorted(fields.columns)).collect()))


def test_maintained_index_equals_a_rebuild(spark):
    rng = np.random.default_rng(6)
    supported, path = ["en"], new_folder(spark, "test")
    properties = spark.createDataFrame([("size", f"{XSD}int", 1)], "uri string, range string, max_card int")
    closure = class_closure(spark.createDataFrame(CLASSES, "sub string, super string"))
    start = spark.createDataFrame(random_records(rng, range(25)), QUADS)
    about = [("g0/", "m1", "r2", "size", r.o, "by", "me") for r in start.filter("s = 'r2' AND p = 'size'").collect()]
    store = maintain.create_store(start, spark.createDataFrame(about, STATEMENTS), properties, closure, supported, path, slices=4, buckets=2)
    for k in range(3):
        names = rng.choice(30, 4, replace=False).tolist()
        gone = spark.createDataFrame([(f"g{n % 2}/", f"r{n}") for n in names[:2]], "g string, s string")
        incoming = spark.createDataFrame(random_records(rng, names[1:]), QUADS)
        classes = None
        if k == 1:  # an edit of the hierarchy reaches the records of its class
            closure = class_closure(spark.createDataFrame([*CLASSES, ("c3", "extra")], "sub string, super string"))
            classes = spark.createDataFrame([("c3",)], "class string")
        store = maintain.apply_changes(store, gone, incoming, properties, closure, classes=classes)
        rebuilt = build_index(store.quads.read(), store.statements.read(), properties, closure, supported)
        assert index_rows(store.docs.read(), store.fields.read()) == index_rows(*rebuilt)
    again = maintain.open_store(spark, path, supported)
    assert index_rows(again.docs.read(), again.fields.read()) == index_rows(*rebuilt)
    assert maintain.compact_edges(store).edges.read().count() <= store.edges.read().count()


def test_a_change_reaches_what_shows_it_and_no_more(spark):
    data = [("g/", f"r{i}", "near", f"r{i + 1}", "uri", None, None, 1) for i in range(40)] + [("g/", f"r{i}", LABEL, f"n{i}", "literal", None, None, 0) for i in range(41)]
    none = spark.createDataFrame([], STATEMENTS)
    properties = spark.createDataFrame([], "uri string, range string, max_card int")
    closure = class_closure(spark.createDataFrame(CLASSES, "sub string, super string"))
    store = maintain.create_store(spark.createDataFrame(data, QUADS), none, properties, closure, ["en"], new_folder(spark, "test"), 4, 2)
    same = [("g/", "r9", LABEL, "n9", "literal", None, None, 0)]
    other = [("g/", "r9", LABEL, "renamed", "literal", None, None, 0)]
    for change, names in ((same, {"r9"}), (other, {"r8", "r9"})):
        incoming = spark.createDataFrame(change, QUADS)
        store = maintain.create_store(spark.createDataFrame(data, QUADS), none, properties, closure, ["en"], new_folder(spark, "test"), 4, 2)
        quads = store.quads.replace(incoming.select("g", "s"), incoming)
        assert {r.s for r in maintain.reached(store, quads, incoming.select("g", "s")).collect()} == names


TEXTS = [(1, "a b c a"), (2, "b c d " * 30), (3, None), (4, ""), (5, "A-b, of the c"), (6, "the of"), (7, "the x y of"), (8, "rare word " + "fill " * 400), (9, "rare"), (9, "rare")]


@pytest.fixture(scope="module")
def held(spark):
    texts = spark.createDataFrame([(u, f, t if f == "text" else t and t.upper()[:9]) for u, t in TEXTS for f in ("text", "title")], "uid long, field string, text string")
    return texts, build_postings(texts, new_folder(spark, "test"), pieces=4, block_docs=2)


def same_scores(a, b):
    return sorted((r[0], round(r[1], 9)) for r in a.collect()) == sorted((r[0], round(r[1], 9)) for r in b.collect())


def test_postings_answer_as_the_texts(spark, held):
    texts, index = held
    for query, how in (("a b", ()), ("B c zz", ("or", 2)), ("rare the", ("or",)), ("zz", ())):
        assert sorted(r.uid for r in index.matches(query, *how).collect()) == sorted(r.uid for r in search.filter_text(texts, query, *how).collect())
    for query in ("rare word", "the of a", "zz", ""):
        assert same_scores(index.scores(query), rank.score_text(texts, query))
        assert same_scores(index.scores(query, {"text": 2.0, "title": 0.5}), rank.score_text(texts, query, {"text": 2.0, "title": 0.5}))
    fields = texts.select("uid", F.col("field").alias("attr"), F.col("text").alias("value"))
    for query, slop in (("of the", 0), ("the of", 2), ("b d", 1), ("a a", 0), ("zz a", 0)):
        assert same_scores(index.phrase(query, {"text": 3.0, "title": 1.0}, slop), rank.boost_phrase(fields, query, {"text": 3.0, "title": 1.0}, slop))


def test_top_of_postings(spark, held):
    texts, index = held
    for query, k in (("rare word fill", 2), ("a b c", 3), ("the of", 50)):
        every = rank.score_text(texts, query, {"text": 1.0}).collect()
        best = sorted(every, key=lambda r: (-round(r.score, 9), r.uid))[:k]
        assert [(r.uid, round(r.score, 9)) for r in index.top(query, k, "text", first=1).collect()] == [(r.uid, round(r.score, 9)) for r in best]


def test_postings_open_the_pieces_of_the_query_alone(spark, held):
    plan = plan_of(held[1]._of("postings", ["rare"]))
    assert re.search(r"PartitionFilters: \[[^\]]*piece#\d+ (=|IN)|PartitionFilters: \[[^\]]*piece#\d+", plan) and re.search(r"PushedFilters: \[[^\]]*(EqualTo|In)\(term", plan)
    empty = build_postings(spark.createDataFrame([], "uid long, field string, text string"), new_folder(spark, "test"), 2)
    assert empty.scores("a").count() == 0 and empty.top("a", 3, "text").count() == 0
    assert Postings(spark, held[1].path).matches("rare").count() == held[1].matches("rare").count()


def test_classes_of_a_long_chain_and_a_large_star(spark):
    n = 3000
    chain = spark.range(n).select(F.concat(F.lit("a"), F.format_string("%05d", "id")).alias("a"), F.concat(F.lit("a"), F.format_string("%05d", F.col("id") + 1)).alias("b"))
    star = spark.range(1, n).select(F.lit("b00000").alias("b"), F.concat(F.lit("b"), F.format_string("%05d", "id")).alias("a")).select("a", "b")
    odd = spark.createDataFrame([("x", "x"), (None, "y"), ("z", None), ("q", "p"), ("p", "q"), ("p", "q")], "a string, b string")
    got = {r.node: r.least for r in equivalence_classes(chain.union(star).union(odd)).collect()}
    assert got == {f"a{i:05d}": "a00000" for i in range(n + 1)} | {f"b{i:05d}": "b00000" for i in range(n)} | {"p": "p", "q": "p"}
    assert equivalence_classes(odd.limit(0)).count() == 0


def test_a_store_may_keep_one_index_table_alone(spark):
    data = [("g/", f"r{i}", "near", f"r{i + 1}", "uri", None, None, 1) for i in range(9)] + [("g/", f"r{i}", LABEL, f"n{i}", "literal", None, None, 0) for i in range(10)]
    none, properties = spark.createDataFrame([], STATEMENTS), spark.createDataFrame([], "uri string, range string, max_card int")
    closure, path = class_closure(spark.createDataFrame(CLASSES, "sub string, super string")), new_folder(spark, "test")
    store = maintain.create_store(spark.createDataFrame(data, QUADS), none, properties, closure, ["en"], path, 1, 1, ("docs",))
    store = maintain.apply_changes(store, none.select("g", "s"), spark.createDataFrame([("g/", "r9", LABEL, "new", "literal", None, None, 0)], QUADS), properties, closure)
    assert store.fields is None
    assert {r.pref_label for r in store.docs.read().select("pref_label").collect()} == {*(f"n{i}" for i in range(9)), "new"}
