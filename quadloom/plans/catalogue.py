"""All registered queries: importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quadloom.operators import index, rank, search
from quadloom.operators.ontology import class_closure
from quadloom.plans import record_queries, schema_queries, search_queries, store_queries, stored_queries  # noqa: F401
from quadloom.plans.fixtures import DS, ONTO, SUPPORTED, Tables
from quadloom.plans.registry import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES"]


@query("facets_of_sized_parts", f"""SELECT 'dataset' AS kind, '{DS}part/' AS value, count(*) AS n FROM part WHERE p_size BETWEEN 5 AND 20
UNION ALL SELECT 'type', '{ONTO}' || replace(p_type, ' ', '_'), count(*) FROM part WHERE p_size BETWEEN 5 AND 20 GROUP BY p_type
UNION ALL SELECT 'attribute', '{ONTO}' || unnest(['brand', 'size', 'retailprice']), count(*) FROM part WHERE p_size BETWEEN 5 AND 20
UNION ALL SELECT 'inferred_type', unnest(['{ONTO}Part', '{ONTO}Product', 'http://www.w3.org/2002/07/owl#Thing']), count(*) FROM part WHERE p_size BETWEEN 5 AND 20""")
def facets_of_sized_parts(t: Tables) -> DataFrame:
    """The flagship: index the parts, filter by a number, count facets."""
    docs, fields = index.build_index(t.quads("part"), t.statements.limit(0), t.properties, class_closure(t.class_edges), SUPPORTED)
    hits = search.filter_attribute_number(fields, f"{ONTO}size", 5, 20)
    return rank.facet_core(docs.join(hits, "uid", "left_semi"), fields.join(hits, "uid", "left_semi"))
