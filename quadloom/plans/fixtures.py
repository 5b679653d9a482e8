"""The given tables as linked records: one specification makes the quads in Spark and the same quads in SQL."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.model import DESCRIPTION, LABEL, LAT, LONG, THING, TYPE, XSD

DS, ONTO = "http://example.org/ds/", "http://example.org/onto#"


@dataclass(frozen=True)
class Property:
    p: str
    value: str
    kind: str = "literal"
    type: str | None = None
    lang: str = "NULL"
    duck: str | None = None


def link(table: str, key: str) -> str:
    return f"'{DS}{table}/' || CAST({key} AS STRING)"


@dataclass(frozen=True)
class Source:
    key: str
    type: str
    properties: tuple[Property, ...]
    graph: str | None = None


ISO = "date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
ISO_DUCK = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')"
SOURCES = {
    "region": Source("r_regionkey", f"'{ONTO}Region'", (Property(LABEL, "r_name"),)),
    "nation": Source("n_nationkey", f"'{ONTO}Nation'", (Property(LABEL, "n_name"), Property(LAT, "CAST((n_nationkey * 7) % 120 - 60 AS STRING)"), Property(LONG, "CAST((n_nationkey * 13) % 300 - 150 AS STRING)"), Property(f"{ONTO}region", link("region", "n_regionkey"), "uri"))),
    "supplier": Source("s_suppkey", f"'{ONTO}Supplier'", (Property(LABEL, "s_name"), Property(f"{ONTO}acctbal", "CAST(s_acctbal AS STRING)", type=f"{XSD}float"), Property(f"{ONTO}nation", link("nation", "s_nationkey"), "uri"))),
    "customer": Source("c_custkey", f"'{ONTO}' || c_mktsegment", (Property(LABEL, "c_name"), Property(f"{ONTO}acctbal", "CAST(c_acctbal AS STRING)", type=f"{XSD}float"), Property(f"{ONTO}nation", link("nation", "c_nationkey"), "uri"))),
    "part": Source("p_partkey", f"'{ONTO}' || replace(p_type, ' ', '_')", (Property(LABEL, "p_name"), Property(f"{ONTO}brand", "p_brand"), Property(f"{ONTO}size", "CAST(p_size AS STRING)", type=f"{XSD}int"), Property(f"{ONTO}retailprice", "CAST(p_retailprice AS STRING)", type=f"{XSD}float"))),
    "orders": Source("o_orderkey", f"'{ONTO}Order'", (Property(f"{ONTO}status", "o_orderstatus"), Property(f"{ONTO}priority", "o_orderpriority"), Property(f"{ONTO}totalprice", "CAST(o_totalprice AS STRING)", type=f"{XSD}float"), Property(f"{ONTO}orderdate", ISO, type=f"{XSD}dateTime", duck=ISO_DUCK), Property(f"{ONTO}customer", link("customer", "o_custkey"), "uri"))),
    "documents": Source("doc_id", f"'{ONTO}Document'", (Property(LABEL, "substring(text, 1, 40)", lang="lang"), Property(DESCRIPTION, "text", lang="lang")), f"'{DS}documents/' || source || '/'"),
}
ORDER = tuple(SOURCES)
FLOATS, INTS, DATES = (f"{ONTO}acctbal", f"{ONTO}retailprice", f"{ONTO}totalprice"), (f"{ONTO}size",), (f"{ONTO}orderdate",)
SINGLE = (f"{ONTO}acctbal", f"{ONTO}size", f"{ONTO}retailprice", f"{ONTO}status", f"{ONTO}totalprice", f"{ONTO}orderdate")
STATUS = {"purchase": "published", "error": "archive", "view": "staging", "click": "experimental", "signup": "harvesting"}
SUPPORTED = ["en", "fr"]


def _rows(name: str) -> list[tuple[str, str, str | None, str, str]]:
    """(predicate, value, datatype, kind, lang) of a source, the type first; values as (spark, duck) pairs."""
    spec = SOURCES[name]
    return [Property(TYPE, spec.type, "uri"), *spec.properties]


def quads_sql() -> str:
    """The quads of every source as DuckDB SQL."""
    parts = []
    for name, spec in SOURCES.items():
        graph = spec.graph or f"'{DS}{name}/'"
        for pos, x in enumerate(_rows(name)):
            kind = f"'{x.type}'" if x.type else "NULL"
            parts.append(f"SELECT {graph} AS g, {link(name, spec.key)} AS s, '{x.p}' AS p, {x.duck or x.value} AS o, '{x.kind}' AS o_kind, {kind} AS o_type, {x.lang} AS o_lang, {pos} AS pos FROM {name}")
    parts.append(f"SELECT DISTINCT '{DS}orders/', {link('orders', 'l_orderkey')}, '{ONTO}part', {link('part', 'l_partkey')}, 'uri', NULL, NULL, 6 FROM lineitem")
    return "SELECT * FROM (" + "\nUNION ALL ".join(parts) + ") WHERE o IS NOT NULL"


PARTS = "replace(p_type, ' ', '_')"
EDGES_SQL = f"""SELECT DISTINCT '{ONTO}' || {PARTS} AS sub, '{ONTO}Part' AS super FROM part
UNION ALL SELECT DISTINCT '{ONTO}' || c_mktsegment, '{ONTO}Customer' FROM customer
UNION ALL SELECT '{ONTO}Part', '{ONTO}Product' UNION ALL SELECT '{ONTO}Customer', '{ONTO}Agent' UNION ALL SELECT '{ONTO}Supplier', '{ONTO}Agent'
UNION ALL SELECT '{ONTO}Supplier', '{ONTO}Product' UNION ALL SELECT '{ONTO}Nation', '{ONTO}Place' UNION ALL SELECT '{ONTO}Region', '{ONTO}Place'"""
STATUS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " ELSE 'unspecified' END"
GRANTS = ", ".join(f"({d}, '{DS}{name}/')" for d, name in enumerate(ORDER))


class Tables:
    """Given tables of one folder and the records made from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def quads(self, *names: str) -> DataFrame:
        """Quads of the named sources, by default all."""
        out = None
        for name in names or ORDER:
            spec = SOURCES[name]
            graph = spec.graph or f"'{DS}{name}/'"
            rows = [f"named_struct('p', '{x.p}', 'o', {x.value}, 'o_kind', '{x.kind}', 'o_type', {f"'{x.type}'" if x.type else 'CAST(NULL AS STRING)'}, 'o_lang', CAST({x.lang} AS STRING), 'pos', {pos}L)" for pos, x in enumerate(_rows(name))]
            made = self.raw(name).selectExpr(f"{graph} AS g", f"{link(name, spec.key)} AS s", f"inline(array({', '.join(rows)}))").filter("o IS NOT NULL")
            out = made if out is None else out.unionByName(made)
            if name == "orders":
                lines = self.raw("lineitem").select("l_orderkey", "l_partkey").distinct()
                out = out.unionByName(lines.selectExpr(f"'{DS}orders/' AS g", f"{link('orders', 'l_orderkey')} AS s", f"'{ONTO}part' AS p", f"{link('part', 'l_partkey')} AS o", "'uri' AS o_kind", "CAST(NULL AS STRING) AS o_type", "CAST(NULL AS STRING) AS o_lang", "6L AS pos"))
        return out

    @cached_property
    def statements(self) -> DataFrame:
        key = "md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, date_format(l_shipdate, 'yyyy-MM-dd')))"
        rows = f"inline(array(named_struct('rei_p', '{ONTO}quantity', 'rei_o', CAST(CAST(l_quantity AS INT) AS STRING)), named_struct('rei_p', '{ONTO}line', 'rei_o', CAST(l_linenumber AS STRING))))"
        return self.raw("lineitem").selectExpr(f"'{DS}orders/' AS g", f"{key} AS stmt", f"{link('orders', 'l_orderkey')} AS s", f"'{ONTO}part' AS p", f"{link('part', 'l_partkey')} AS o", rows)

    @cached_property
    def class_edges(self) -> DataFrame:
        pairs = [(f"{ONTO}{a}", f"{ONTO}{b}") for a, b in (("Part", "Product"), ("Customer", "Agent"), ("Supplier", "Agent"), ("Supplier", "Product"), ("Nation", "Place"), ("Region", "Place"))]
        fixed = self.spark.createDataFrame(pairs, "sub string, super string")
        parts = self.raw("part").select(F.expr(f"'{ONTO}' || {PARTS}").alias("sub"), F.lit(f"{ONTO}Part").alias("super")).distinct()
        kinds = self.raw("customer").select(F.expr(f"'{ONTO}' || c_mktsegment").alias("sub"), F.lit(f"{ONTO}Customer").alias("super")).distinct()
        return parts.union(kinds).union(fixed)

    @cached_property
    def properties(self) -> DataFrame:
        """Range and cardinality of the typed properties."""
        kinds = [(p, f"{XSD}float") for p in FLOATS] + [(p, f"{XSD}int") for p in INTS] + [(p, f"{XSD}dateTime") for p in DATES] + [(p, None) for p in SINGLE if p not in (*FLOATS, *INTS, *DATES)]
        return self.spark.createDataFrame([(p, k, 1 if p in SINGLE else None) for p, k in kinds], "uri string, range string, max_card int")

    @cached_property
    def revisions(self) -> DataFrame:
        return self.raw("events").selectExpr(f"'{DS}user/revisions/' || CAST(event_id AS STRING) AS rev_uri", f"'{DS}user/' AS dataset", f"'{DS}user/' || CAST(user_id AS STRING) AS record_uri", "unix_timestamp(ts) AS rev_time", f"'{DS}user/' || CAST(user_id AS STRING) AS performer", f"{STATUS_SQL} AS status")

    @cached_property
    def revision_quads(self) -> DataFrame:
        rows = f"inline(array(named_struct('p', '{ONTO}value', 'o', CAST(CAST(value AS DECIMAL(18,2)) AS STRING)), named_struct('p', '{ONTO}k', 'o', get_json_object(props, '$.k')), named_struct('p', '{ONTO}event', 'o', event_type)))"
        made = self.raw("events").selectExpr(f"'{DS}user/revisions/' || CAST(event_id AS STRING) AS rev_uri", rows)
        return made.filter("o IS NOT NULL").withColumns({"o_kind": F.lit("literal"), "o_type": F.lit(None).cast("string"), "o_lang": F.lit(None).cast("string")})

    @cached_property
    def access(self) -> DataFrame:
        grants = self.raw("nation").selectExpr("n_nationkey", f"inline(array({', '.join(f'named_struct({chr(39)}d{chr(39)}, {d}, {chr(39)}dataset{chr(39)}, {chr(39)}{DS}{name}/{chr(39)})' for d, name in enumerate(ORDER))}))").filter("(n_nationkey + d) % 3 = 0")
        group = f"'{DS}group/' || CAST(n_nationkey AS STRING)"
        return grants.selectExpr(f"md5({group} || dataset) AS access_uri", f"{group} AS `group`", "dataset", "CASE WHEN d % 2 = 0 THEN array('search', 'read') ELSE array('search') END AS services", "n_nationkey % 5 = 0 AS c", "n_nationkey % 2 = 0 OR d % 2 = 0 AS r", "n_nationkey % 5 = 0 AS u", "n_nationkey % 7 = 0 AS d")

    @cached_property
    def groups(self) -> DataFrame:
        return self.raw("nation").selectExpr(f"'{DS}group/' || CAST(n_nationkey AS STRING) AS `group`", "'app' || CAST(n_regionkey AS STRING) AS app_id")

    @cached_property
    def memberships(self) -> DataFrame:
        return self.raw("customer").selectExpr(f"'{DS}customer/' || CAST(c_custkey AS STRING) AS user", f"'{DS}group/' || CAST(c_nationkey AS STRING) AS `group`")

    @cached_property
    def datasets(self) -> DataFrame:
        """A description for each supplier's catalogue and each source table."""
        return self.raw("supplier").selectExpr(f"CASE WHEN s_suppkey BETWEEN 1 AND {len(ORDER)} THEN element_at(array({', '.join(repr(f'{DS}{n}/') for n in ORDER)}), CAST(s_suppkey AS INT)) ELSE '{DS}supplier/' || CAST(s_suppkey AS STRING) || '/' END AS dataset", "s_name AS title", "'catalogue of ' || s_name AS description", f"'{DS}nation/' || CAST(s_nationkey AS STRING) AS creator", "CAST(NULL AS STRING) AS modified", f"array('{DS}supplier/' || CAST(s_suppkey AS STRING), '{DS}nation/' || CAST(s_nationkey AS STRING)) AS contributors", "s_suppkey % 10 = 0 AS holds_ontology")


SQL = {
    "quads": quads_sql(),
    "statements": f"SELECT '{DS}orders/' AS g, md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d'))) AS stmt, {link('orders', 'l_orderkey')} AS s, '{ONTO}part' AS p, {link('part', 'l_partkey')} AS o, unnest(['{ONTO}quantity', '{ONTO}line']) AS rei_p, unnest([CAST(CAST(l_quantity AS INT) AS STRING), CAST(l_linenumber AS STRING)]) AS rei_o FROM lineitem",
    "class_edges": EDGES_SQL,
    "closure0(sub, super)": f"SELECT sub, super FROM class_edges UNION SELECT c.sub, e.super FROM closure0 c JOIN class_edges e ON c.super = e.sub",
    "class_closure": f"SELECT sub, super FROM closure0 UNION SELECT x, '{THING}' FROM (SELECT sub AS x FROM class_edges UNION SELECT super FROM class_edges)",
    "properties(uri, \"range\", max_card)": " UNION ALL ".join(f"SELECT '{p}', {repr(k) if k else 'NULL'}, 1" for p, k in [(p, f"{XSD}float") for p in FLOATS] + [(p, f"{XSD}int") for p in INTS] + [(p, f"{XSD}dateTime") for p in DATES] + [(f"{ONTO}status", None)]),
    "revisions": f"SELECT '{DS}user/revisions/' || event_id AS rev_uri, '{DS}user/' AS dataset, '{DS}user/' || user_id AS record_uri, CAST(floor(epoch(ts)) AS BIGINT) AS rev_time, '{DS}user/' || user_id AS performer, {STATUS_SQL} AS status FROM events",
    "revision_quads": f"SELECT * FROM (SELECT '{DS}user/revisions/' || event_id AS rev_uri, unnest(['{ONTO}value', '{ONTO}k', '{ONTO}event']) AS p, unnest([CAST(CAST(value AS DECIMAL(18,2)) AS STRING), json_extract_string(props, '$.k'), event_type]) AS o FROM events) WHERE o IS NOT NULL",
    "access": f"SELECT md5('{DS}group/' || n_nationkey || dataset) AS access_uri, '{DS}group/' || n_nationkey AS \"group\", dataset, CASE WHEN d % 2 = 0 THEN ['search', 'read'] ELSE ['search'] END AS services, n_nationkey % 5 = 0 AS c, n_nationkey % 2 = 0 OR d % 2 = 0 AS r, n_nationkey % 5 = 0 AS u, n_nationkey % 7 = 0 AS d FROM nation, (VALUES {GRANTS}) x(d, dataset) WHERE (n_nationkey + d) % 3 = 0",
    "groups": f"SELECT '{DS}group/' || n_nationkey AS \"group\", 'app' || n_regionkey AS app_id FROM nation",
    "memberships": f"SELECT '{DS}customer/' || c_custkey AS user_uri, '{DS}group/' || c_nationkey AS \"group\" FROM customer",
    "datasets": f"SELECT CASE WHEN s_suppkey BETWEEN 1 AND {len(ORDER)} THEN [{', '.join(repr(f'{DS}{n}/') for n in ORDER)}][CAST(s_suppkey AS INT)] ELSE '{DS}supplier/' || s_suppkey || '/' END AS dataset, s_name AS title, 'catalogue of ' || s_name AS description, '{DS}nation/' || s_nationkey AS creator, CAST(NULL AS STRING) AS modified, ['{DS}supplier/' || s_suppkey, '{DS}nation/' || s_nationkey] AS contributors, s_suppkey % 10 = 0 AS holds_ontology FROM supplier",
}


def with_records(body: str, **more: str) -> str:
    """body under WITH definitions of the records (unused ones cost nothing) and of `more` tables."""
    tables = ",\n".join(f"{name} AS ({sql})" for name, sql in (SQL | more).items())
    return f"WITH RECURSIVE {tables}\n{body}"
