"""Queries over the whole job: no row of the sources is left out of the results."""

from __future__ import annotations

from quadloom.plans.catalogue import QUERIES
from quadloom.plans.fixtures import Tables

SMALL = "/root/testdata/sf0.001"


def test_all_revisions_are_read_and_every_record_published(spark):
    t = Tables(spark, SMALL)
    assert QUERIES["v7_read_revision"](spark, SMALL).count() == 2 * t.revision_quads.count()
    assert QUERIES["v4_published_store"](spark, SMALL).select("s").distinct().count() == t.revisions.select("record_uri").distinct().count()


def test_all_parts_are_sorted(spark):
    rows = QUERIES["r5_sort_records"](spark, SMALL).collect()
    assert [r["rank"] for r in rows] == list(range(1, Tables(spark, SMALL).raw("part").count() + 1))


def test_record_queries_meet_every_source(spark):
    t = Tables(spark, SMALL)
    records = t.quads().select("g", "s").distinct().count()
    for name, keys in {"g1_read_records": ["g", "s"], "g2_read_records_anywhere": ["g", "s"], "b14_build_index": ["uid"]}.items():
        assert QUERIES[name](spark, SMALL).select(*keys).distinct().count() == records, name
    holders = t.raw("supplier").count() + t.raw("customer").count()
    assert QUERIES["k4_write_sectioned_csv"](spark, SMALL).count() == holders + 2 and QUERIES["k5_write_linked_json"](spark, SMALL).count() == holders
    named = t.raw("customer").count() + t.raw("documents").filter("text <> '' AND source IS NOT NULL").count()
    assert QUERIES["s4_read_record_json"](spark, SMALL).select("id").distinct().count() == named
    counts = {r.what: r.n for r in QUERIES["w1_create_records"](spark, SMALL).collect()}
    assert counts["kept"] + counts["added"] == t.quads().count()
