"""Queries for writes, revisions, access, ontology, patterns and tagging (W, V, A, O, Q, T)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.model import LABEL, OWL, RDFS, THING, TYPE
from quadloom.operators import access, ontology, patterns, revisions, tagging, writes
from quadloom.operators.index import build_index
from quadloom.plans.fixtures import DS, ONTO, SUPPORTED, Tables
from quadloom.plans.record_queries import LOCAL
from quadloom.plans.registry import query

GROUP = '"group"'


def store_of(t: Tables, *names: str) -> writes.Store:
    return {"quads": t.quads(*names), "statements": t.statements, "revisions": t.revisions, "revision_quads": t.revision_quads, "datasets": t.datasets, "access": t.access}


def incoming(t: Tables) -> DataFrame:
    """New content for every third part."""
    rows = t.quads("part").filter((F.col("p") == TYPE) & (F.substring_index("s", "/", -1).cast("long") % 3 == 0))
    return rows.withColumns({"o": F.concat("o", F.lit("-new")), "pos": F.lit(7).cast("long")})


HELD = ", ".join(f"'{DS}{name}/'" for name in ("nation", "supplier", "part", "orders"))


@query("w1_create_records", f"SELECT 'kept' AS what, count(*) AS n FROM quads WHERE g IN ({HELD}) UNION ALL SELECT 'added', count(*) FROM quads WHERE g NOT IN ({HELD}) UNION ALL SELECT 'clash', count(DISTINCT s) FROM quads WHERE g IN ({HELD})")
def w1b(t: Tables) -> DataFrame:
    """Regions, customers and documents join a store of the other sources."""
    names = ("nation", "supplier", "part", "orders")
    store, none = store_of(t, *names), t.statements.limit(0)
    out = writes.create_records(store, t.quads("region", "customer", "documents"), none)["quads"]
    clash = writes.clashes(store, t.quads()).agg(F.lit("clash").alias("what"), F.count("*").alias("n"))
    kept = F.col("g").isin(*(f"{DS}{name}/" for name in names))
    return out.groupBy(F.when(kept, "kept").otherwise("added").alias("what")).agg(F.count("*").alias("n")).union(clash)


@query("w2_update_records", f"SELECT s, p, o FROM quads WHERE g = '{DS}part/' AND CAST({LOCAL.format('s')} AS BIGINT) % 3 <> 0 UNION ALL SELECT s, p, o || '-new' FROM quads WHERE g = '{DS}part/' AND p = '{TYPE}' AND CAST({LOCAL.format('s')} AS BIGINT) % 3 = 0")
def w2(t: Tables) -> DataFrame:
    return writes.update_records(t.quads("part"), incoming(t)).select("s", "p", "o")


ORDER_NO = f"CAST({LOCAL.format('s')} AS BIGINT)"


@query("w3_replace_statements", f"SELECT s, rei_p, rei_o FROM statements WHERE {ORDER_NO} % 5 <> 0 UNION ALL SELECT s, '{ONTO}checked', 'yes' FROM statements WHERE {ORDER_NO} % 10 = 0 AND rei_p = '{ONTO}line'")
def w3(t: Tables) -> DataFrame:
    number = F.substring_index("s", "/", -1).cast("long")
    new = t.statements.filter((number % 10 == 0) & (F.col("rei_p") == f"{ONTO}line")).withColumns({"rei_p": F.lit(f"{ONTO}checked"), "rei_o": F.lit("yes")})
    return writes.replace_statements(t.statements, t.statements.filter(number % 5 == 0).select("g", "s"), new).select("s", "rei_p", "rei_o")


USERS = f"SELECT DISTINCT record_uri FROM revisions WHERE CAST({LOCAL.format('record_uri')} AS BIGINT) % 4 = 0"


@query("w4_delete_records", f"SELECT 'soft' AS mode, status, count(*) AS n FROM (SELECT CASE WHEN status = 'published' AND record_uri IN ({USERS}) THEN 'archive' ELSE status END AS status FROM revisions) GROUP BY status UNION ALL SELECT 'hard', status, count(*) FROM revisions WHERE record_uri NOT IN ({USERS}) GROUP BY status")
def w4(t: Tables) -> DataFrame:
    store = store_of(t, "region")
    keys = t.revisions.filter(F.substring_index("record_uri", "/", -1).cast("long") % 4 == 0).select(F.col("dataset").alias("g"), F.col("record_uri").alias("s")).distinct()
    parts = [writes.delete_records(store, keys, m)["revisions"].groupBy("status").agg(F.count("*").alias("n")).select(F.lit(m).alias("mode"), "status", "n") for m in ("soft", "hard")]
    return parts[0].union(parts[1])


@query("w5_delete_dataset", f"""
SELECT 'quads' AS t, g || s || p || o AS what FROM quads WHERE g IN ('{DS}nation/', '{DS}part/')
UNION ALL SELECT 'statements', stmt || rei_p FROM statements
UNION ALL SELECT 'datasets', dataset FROM datasets WHERE dataset <> '{DS}supplier/'
UNION ALL SELECT 'access', access_uri FROM access WHERE dataset <> '{DS}supplier/'
UNION ALL SELECT 'docs', md5(g || s) FROM quads WHERE g = '{DS}nation/' AND p = '{TYPE}'
UNION ALL SELECT 'doc_fields', md5(g || s) || p FROM quads WHERE g = '{DS}nation/' AND p = '{ONTO}region'
UNION ALL SELECT 'revision_quads', rev_uri || p FROM revision_quads""")
def w5(t: Tables) -> DataFrame:
    docs, fields = build_index(t.quads("nation", "supplier"), t.statements.limit(0), t.properties, ontology.class_closure(t.class_edges), SUPPORTED)
    store = store_of(t, "nation", "part", "supplier") | {"docs": docs, "doc_fields": fields}
    out = writes.delete_dataset(store, f"{DS}supplier/")
    keys = {"quads": ["g", "s", "p", "o"], "statements": ["stmt", "rei_p"], "datasets": ["dataset"], "access": ["access_uri"], "docs": ["uid"], "doc_fields": ["uid", "attr"], "revision_quads": ["rev_uri", "p"]}
    rows = [out[name].select(F.lit(name).alias("t"), F.concat(*columns).alias("what")) for name, columns in keys.items()]
    return reduce(DataFrame.union, rows)


@query("w5_delete_user_dataset", f"""
SELECT 'revisions' AS t, count(*) AS n FROM revisions WHERE false UNION ALL SELECT 'revision_quads', count(*) FROM revision_quads WHERE false
UNION ALL SELECT 'quads', count(*) FROM quads WHERE g = '{DS}nation/'""")
def w5b(t: Tables) -> DataFrame:
    out = writes.delete_dataset(store_of(t, "nation"), f"{DS}user/")
    return reduce(DataFrame.union, [out[k].agg(F.lit(k).alias("t"), F.count("*").alias("n")) for k in ("revisions", "revision_quads", "quads")])


@query("w6_update_dataset", f"SELECT dataset, CASE WHEN k % 2 = 0 THEN title || ' (new)' ELSE title END AS title, CASE WHEN k % 3 = 0 THEN NULL ELSE description END AS description, CASE WHEN k % 2 = 0 THEN '{DS}nation/1' ELSE array_to_string(contributors, '|') END AS contributors FROM (SELECT *, CAST(string_split(contributors[1], '/')[-1] AS BIGINT) AS k FROM datasets) UNION ALL SELECT '{DS}extra/', 'extra', 'x', ''")
def w6(t: Tables) -> DataFrame:
    new = t.datasets.limit(1).select(F.lit(f"{DS}extra/").alias("dataset"), F.lit("extra").alias("title"), F.lit("x").alias("description"), F.array().cast("array<string>").alias("contributors"), F.lit(False).alias("holds_ontology"))
    k = F.substring_index(F.get("contributors", F.lit(0)), "/", -1).cast("long")
    changes = t.datasets.select("dataset", F.when(k % 2 == 0, F.concat("title", F.lit(" (new)"))).alias("title"), F.when(k % 3 == 0, "-delete-").alias("description"), F.when(k % 2 == 0, F.array(F.lit(f"{DS}nation/1"))).alias("contributors"))
    out = writes.update_dataset(writes.create_dataset(t.datasets, new), changes)
    return out.select("dataset", "title", "description", F.concat_ws("|", "contributors").alias("contributors"))


@query("w7_apply_access_changes", f"""SELECT 'access' AS what, count(*) AS n FROM access WHERE dataset <> '{DS}region/' AND {GROUP} NOT IN ('{DS}group/1', '{DS}group/2') UNION ALL SELECT 'new', 25 UNION ALL SELECT 'groups', 24 UNION ALL SELECT 'members', (SELECT count(*) FROM memberships WHERE {GROUP} <> '{DS}group/2' AND NOT (CAST({LOCAL.format('user_uri')} AS BIGINT) % 10 = 0)) + 25""")
def w7(t: Tables) -> DataFrame:
    none = F.lit(None)
    empty = {"dataset": none.cast("string"), "services": none.cast("array<string>"), "c": none.cast("boolean"), "r": none.cast("boolean"), "u": none.cast("boolean"), "d": none.cast("boolean"), "app_id": none.cast("string"), "user": none.cast("string"), "group": none.cast("string")}

    def change(rows: DataFrame, op: str, **given) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), *[given.get(c, default).alias(c) for c, default in empty.items()])

    one, user = t.raw("region").limit(1), F.col("user")
    group = F.concat(F.lit(f"{DS}group/"), F.col("n_nationkey").cast("string"))
    changes = change(one, "revoke_dataset", dataset=F.lit(f"{DS}region/")).union(change(one, "revoke_group", group=F.lit(f"{DS}group/1"))).union(change(one, "delete_group", group=F.lit(f"{DS}group/2")))
    changes = changes.union(change(t.raw("nation"), "grant", group=group, dataset=F.lit(f"{DS}new/"), services=F.array(F.lit("search")), r=F.lit(True)))
    changes = changes.union(change(t.memberships.filter(F.substring_index("user", "/", -1).cast("long") % 10 == 0), "leave", user=user, group=F.col("group"))).union(change(t.raw("nation"), "join", user=F.lit(f"{DS}customer/new"), group=group))
    grants, groups, members = writes.apply_access_changes(t.access, t.groups, t.memberships, changes)
    new = F.col("dataset") == f"{DS}new/"
    rows = [grants.filter(~new).agg(F.lit("access").alias("what"), F.count("*").alias("n")), grants.filter(new).agg(F.lit("new"), F.count("*")), groups.agg(F.lit("groups"), F.count("*")), members.agg(F.lit("members"), F.count("*"))]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY record_uri ORDER BY rev_time DESC, rev_uri DESC) AS k FROM revisions) WHERE k = 1"


@query("v1_latest_revision", f"SELECT record_uri, rev_uri, rev_time, status FROM ({LATEST})")
def v1(t: Tables) -> DataFrame:
    return revisions.latest_revision(t.revisions).select("record_uri", "rev_uri", "rev_time", "status")


@query("v2_check_publishable", f"SELECT record_uri, status = 'published' AS publishable FROM ({LATEST})")
def v2(t: Tables) -> DataFrame:
    return revisions.check_publishable(t.revisions, t.revisions.select("dataset", "record_uri").distinct()).select("record_uri", "publishable")


@query("v3_add_revisions", f"SELECT rev_uri, record_uri, rev_time, status FROM revisions UNION ALL SELECT '{DS}user/revisions/4000000000-' || md5(u), u, 4000000000, 'published' FROM (SELECT DISTINCT record_uri AS u FROM revisions UNION SELECT '{DS}user/x' || c_custkey FROM customer) UNION ALL SELECT '{DS}user/revisions/3999999999-' || md5('{DS}user/x' || c_custkey), '{DS}user/x' || c_custkey, 3999999999, 'archive' FROM customer")
def v3(t: Tables) -> DataFrame:
    new = t.raw("customer").selectExpr(f"'{DS}user/' AS dataset", f"'{DS}user/x' || CAST(c_custkey AS STRING) AS record_uri")
    out = revisions.add_revisions(t.revisions, t.revisions.select("dataset", "record_uri").union(new), "published", 4_000_000_000, f"{DS}user/0")
    return out.select("rev_uri", "record_uri", "rev_time", "status")


CHOSEN = f"SELECT rev_uri FROM revisions WHERE CAST({LOCAL.format('rev_uri')} AS BIGINT) % 50 = 0"


def chosen(t: Tables, n: int = 50) -> DataFrame:
    return t.revisions.filter(F.substring_index("rev_uri", "/", -1).cast("long") % n == 0).select("rev_uri")


@query("v4_publish_revisions", f"SELECT rev_uri, CASE WHEN rev_uri IN ({CHOSEN}) THEN 'published' WHEN status = 'published' AND record_uri IN (SELECT record_uri FROM revisions WHERE rev_uri IN ({CHOSEN})) THEN 'archive' ELSE status END AS status FROM revisions")
def v4(t: Tables) -> DataFrame:
    return revisions.publish_revisions(t.revisions, chosen(t)).select("rev_uri", "status")


@query("v4_published_store", f"SELECT DISTINCT record_uri AS s, q.p, q.o FROM revision_quads q JOIN revisions r USING (rev_uri) WHERE rev_uri IN (SELECT rev_uri FROM ({LATEST}))")
def v4c(t: Tables) -> DataFrame:
    """The latest revision of every record is published."""
    store = store_of(t, "region")
    return revisions.published_store(store, revisions.latest_revision(t.revisions).select("rev_uri"))["quads"].filter(F.col("g") == f"{DS}user/").select("s", "p", "o").distinct()


@query("v5_set_lifecycle", f"SELECT status, count(*) AS n, 5 AS records FROM (SELECT CASE WHEN rev_uri IN ({CHOSEN}) THEN 'staging' ELSE status END AS status FROM revisions) GROUP BY status")
def v5(t: Tables) -> DataFrame:
    store = store_of(t, "region")
    out = revisions.set_lifecycle(store, chosen(t), "staging")
    regions = out["quads"].select("s").distinct().agg(F.count("*").cast("int").alias("records"))
    return out["revisions"].groupBy("status").agg(F.count("*").alias("n")).join(F.broadcast(regions))


@query("v6_list_revisions", f"SELECT rev_uri, rev_time, performer, status FROM revisions WHERE record_uri = (SELECT min(record_uri) FROM revisions)")
def v6(t: Tables) -> DataFrame:
    record = t.revisions.agg(F.min("record_uri")).first()[0]
    return revisions.list_revisions(t.revisions, record, "long")


@query("v7_read_revision", "SELECT record_uri AS s, p, o, 'record' AS mode FROM revision_quads JOIN revisions USING (rev_uri) UNION ALL SELECT rev_uri, p, o, 'revision' FROM revision_quads")
def v7b(t: Tables) -> DataFrame:
    parts = [revisions.read_revision(t.revision_quads, t.revisions, t.revisions.select("rev_uri"), m).select("s", "p", "o", F.lit(m).alias("mode")) for m in ("record", "revision")]
    return parts[0].union(parts[1])


PAIRS = "SELECT record_uri, rev_uri, lag(rev_uri) OVER (PARTITION BY record_uri ORDER BY rev_time, rev_uri) AS before FROM revisions"


@query("v8_diff_revisions", f"SELECT pr.rev_uri, 'addition-' || md5(record_uri || q.p || q.o) AS stmt, 'addition' AS change, q.p, q.o FROM ({PAIRS}) pr JOIN revision_quads q ON q.rev_uri = pr.rev_uri WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM revision_quads x WHERE x.rev_uri = before AND x.p = q.p AND x.o = q.o) UNION ALL SELECT pr.rev_uri, 'removal-' || md5(record_uri || q.p || q.o), 'removal', q.p, q.o FROM ({PAIRS}) pr JOIN revision_quads q ON q.rev_uri = pr.before WHERE NOT EXISTS (SELECT 1 FROM revision_quads x WHERE x.rev_uri = pr.rev_uri AND x.p = q.p AND x.o = q.o)")
def v8(t: Tables) -> DataFrame:
    return revisions.diff_pairs(t.revision_quads, revisions.predecessors(t.revisions))


DELETABLE = f"SELECT rev_uri FROM revisions WHERE CAST({LOCAL.format('rev_uri')} AS BIGINT) % 3 = 0 AND status <> 'published'"


@query("v9_delete_revisions", f"SELECT rev_uri, p, o FROM revision_quads WHERE rev_uri NOT IN ({DELETABLE})")
def v9(t: Tables) -> DataFrame:
    gone = t.revisions.filter((F.substring_index("rev_uri", "/", -1).cast("long") % 3 == 0) & (F.col("status") != "published")).select("rev_uri")
    return revisions.delete_revisions(t.revisions, t.revision_quads, gone)[1].select("rev_uri", "p", "o")


@query("a1_accessible_datasets", f"SELECT DISTINCT dataset FROM access a JOIN memberships m ON a.{GROUP} = m.{GROUP} WHERE user_uri = '{DS}customer/7' AND r")
def a1(t: Tables) -> DataFrame:
    return access.accessible_datasets(t.access, t.memberships, f"{DS}customer/7")


@query("a2_list_groups", f"SELECT 'group' AS kind, {GROUP} AS a, app_id AS b FROM groups UNION ALL SELECT 'user', user_uri, {GROUP} FROM memberships WHERE {GROUP} = '{DS}group/3' UNION ALL SELECT 'of', user_uri, {GROUP} FROM memberships WHERE user_uri = '{DS}customer/9'")
def a2(t: Tables) -> DataFrame:
    users = access.group_users(t.memberships, f"{DS}group/3").select(F.lit("user"), "user", F.lit(f"{DS}group/3"))
    of = access.user_groups(t.memberships, f"{DS}customer/9").select(F.lit("of"), F.lit(f"{DS}customer/9"), "group")
    return access.list_groups(t.groups).select(F.lit("group").alias("kind"), F.col("group").alias("a"), F.col("app_id").alias("b")).union(users).union(of)


@query("a3_list_access", f"SELECT access_uri, dataset, c, r, u, d, array_to_string(list_sort(services), '|') AS services FROM access WHERE {GROUP} = (SELECT {GROUP} FROM memberships WHERE user_uri = '{DS}customer/7') UNION ALL SELECT access_uri, dataset, c, r, u, d, NULL FROM access WHERE dataset = '{DS}part/' UNION ALL SELECT access_uri, dataset, c, r, u, d, 'read|search' FROM access WHERE {GROUP} = '{DS}group/6' AND list_contains(services, 'read')")
def a3(t: Tables) -> DataFrame:
    columns = ["access_uri", "dataset", "c", "r", "u", "d"]
    parts = [access.list_access(t.access, t.memberships, by, target, service) for by, target, service in (("user", f"{DS}customer/7", "all"), ("dataset", f"{DS}part/", "none"), ("group", f"{DS}group/6", "read"))]
    shown = [p.select(*columns, (F.array_join("services", "|") if "services" in p.columns else F.lit(None).cast("string")).alias("services")) for p in parts]
    return shown[0].union(shown[1]).union(shown[2])


NAMES = f"['{DS}nation/', '{DS}part/']"


@query("a4_authorize", f"""SELECT user_uri AS request, bool_and(EXISTS (SELECT 1 FROM access a JOIN groups g ON g.{GROUP} = a.{GROUP} WHERE a.{GROUP} = m.{GROUP} AND g.app_id = 'app1' AND a.dataset = w.dataset AND list_contains(services, 'search') AND r) AND w.dataset IN (SELECT dataset FROM datasets)) AS allowed FROM (SELECT user_uri, {GROUP}, CASE WHEN CAST({LOCAL.format('user_uri')} AS BIGINT) % 2 = 0 THEN ['{DS}nation/'] ELSE {NAMES} END AS ds FROM memberships) m, unnest(ds) AS w(dataset) GROUP BY user_uri""")
def a4(t: Tables) -> DataFrame:
    wanted = F.when(F.substring_index("user", "/", -1).cast("long") % 2 == 0, F.array(F.lit(f"{DS}nation/"))).otherwise(F.array(F.lit(f"{DS}nation/"), F.lit(f"{DS}part/")))
    asked = t.memberships.select(F.col("user").alias("request"), "user", F.lit("app1").alias("app_id"), F.lit("search").alias("service"), wanted.alias("datasets"), F.lit(False).alias("c"), F.lit(True).alias("r"), F.lit(False).alias("u"), F.lit(False).alias("d"))
    return access.authorize(asked, t.access, t.groups, t.memberships, t.datasets)


@query("a5_dataset_catalog", f"SELECT dataset, title, array_to_string(list_sort(contributors), '|') AS contributors, holds_ontology FROM datasets WHERE dataset IN (SELECT dataset FROM access a JOIN memberships m ON a.{GROUP} = m.{GROUP} WHERE user_uri = '{DS}customer/7' AND r)")
def a5(t: Tables) -> DataFrame:
    return access.dataset_catalog(t.datasets, t.access, t.memberships, f"{DS}customer/7").select("dataset", "title", F.concat_ws("|", "contributors").alias("contributors"), "holds_ontology")


def ontology_quads(t: Tables) -> DataFrame:
    """The class hierarchy as quads, a property with domain and range for each class, equivalents and disjoints."""
    edges, none = t.class_edges, F.lit(None).cast("string")
    classes = edges.select(F.explode(F.array("sub", "super")).alias("c")).distinct()

    def rows(df: DataFrame, s, p: str, o) -> DataFrame:
        return df.select(F.lit(f"{ONTO}").alias("g"), s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.when(o.rlike("^http"), "uri").otherwise("literal").alias("o_kind"), none.alias("o_type"), none.alias("o_lang"), F.lit(0).cast("long").alias("pos"))

    c, prop = F.col("c"), F.concat("c", F.lit("-of"))
    name = F.substring_index("c", "#", -1)
    out = rows(edges, F.col("sub"), f"{RDFS}subClassOf", F.col("super")).union(rows(classes, c, TYPE, F.lit(f"{OWL}Class"))).union(rows(classes, c, LABEL, name))
    out = out.union(rows(classes, prop, TYPE, F.lit(f"{OWL}ObjectProperty"))).union(rows(classes, prop, f"{RDFS}domain", c)).union(rows(classes, prop, f"{RDFS}range", F.lit(f"{ONTO}Part")))
    return out.union(rows(classes.filter(name < "M"), c, f"{OWL}equivalentClass", F.lit(f"{ONTO}Same"))).union(rows(classes.filter(name >= "M"), c, f"{OWL}disjointWith", F.lit(f"{ONTO}Other")))


CLASSES = "SELECT DISTINCT unnest([sub, super]) AS c FROM class_edges"
NAME = "string_split(c, '#')[2]"


@query("o1_class_closure", "SELECT sub, super FROM class_closure")
def o1(t: Tables) -> DataFrame:
    return ontology.class_closure(t.class_edges)


@query("o2_sub_super_classes", f"SELECT 'sub' AS way, sub AS uri FROM class_closure WHERE super = '{ONTO}Agent' UNION ALL SELECT 'direct', sub FROM class_edges WHERE super = '{ONTO}Agent' UNION ALL SELECT 'super', super FROM class_closure WHERE sub = '{ONTO}Supplier' UNION ALL SELECT 'unknown', '{THING}'")
def o2(t: Tables) -> DataFrame:
    edges, closure = t.class_edges, ontology.class_closure(t.class_edges)
    parts = {"sub": ontology.sub_classes(edges, closure, f"{ONTO}Agent"), "direct": ontology.sub_classes(edges, closure, f"{ONTO}Agent", True), "super": ontology.super_classes(edges, closure, f"{ONTO}Supplier"), "unknown": ontology.super_classes(edges, closure, f"{ONTO}Nowhere")}
    out = [df.select(F.lit(k).alias("way"), "uri") for k, df in parts.items()]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("o3_is_subclass_of", f"SELECT o AS sub, '{ONTO}Product' AS super, o IN (SELECT sub FROM class_closure WHERE super = '{ONTO}Product') AS is_sub FROM (SELECT DISTINCT o FROM quads WHERE p = '{TYPE}')")
def o3(t: Tables) -> DataFrame:
    pairs = t.quads().filter(F.col("p") == TYPE).select(F.col("o").alias("sub"), F.lit(f"{ONTO}Product").alias("super")).distinct()
    return ontology.is_subclass_of(pairs, ontology.class_closure(t.class_edges)).select("sub", "super", "is_sub")


@query("o4_hierarchy", f"SELECT c AS uri, {NAME} AS label, coalesce((SELECT string_agg(super, '|' ORDER BY super) FROM class_edges WHERE sub = c), '') AS parents, coalesce((SELECT string_agg(sub, '|' ORDER BY sub) FROM class_edges WHERE super = c), '') AS children, (SELECT count(*) FROM closure0 WHERE sub = c) AS depth FROM ({CLASSES})")
def o4(t: Tables) -> DataFrame:
    return ontology.hierarchy(ontology_quads(t)).select("uri", "label", F.concat_ws("|", "parents").alias("parents"), F.concat_ws("|", "children").alias("children"), "depth")


@query("o5_in_domain_of", f"SELECT 'domain' AS way, c || '-of' AS property FROM (SELECT '{ONTO}Supplier' AS c UNION SELECT super FROM closure0 WHERE sub = '{ONTO}Supplier') UNION ALL SELECT 'range', c || '-of' FROM ({CLASSES}) WHERE (SELECT count(*) FROM closure0 WHERE super = '{ONTO}Part') > 0")
def o5(t: Tables) -> DataFrame:
    quads, closure = ontology_quads(t), ontology.transitive(t.class_edges)
    part = t.raw("part").selectExpr(f"min('{ONTO}' || replace(p_type, ' ', '_')) AS c").first()[0]
    return ontology.in_domain_of(quads, closure, f"{ONTO}Supplier").select(F.lit("domain").alias("way"), "property").union(ontology.in_range_of(quads, closure, part).select(F.lit("range"), "property"))


@query("o6_equivalents", f"SELECT 'equivalent' AS way, c AS uri FROM (SELECT c FROM ({CLASSES}) WHERE {NAME} < 'M' UNION SELECT '{ONTO}Same') WHERE c <> '{ONTO}Agent' UNION ALL SELECT 'disjoint', c FROM ({CLASSES}) WHERE {NAME} >= 'M'")
def o6(t: Tables) -> DataFrame:
    quads = ontology_quads(t)
    return ontology.equivalents(quads, f"{ONTO}Agent").select(F.lit("equivalent").alias("way"), "uri").union(ontology.disjoints(quads, f"{ONTO}Other").select(F.lit("disjoint"), "uri"))


@query("o7_list_entities", f"SELECT c AS uri, {NAME} AS label FROM ({CLASSES}) ORDER BY c LIMIT 8 OFFSET 3")
def o7(t: Tables) -> DataFrame:
    return ontology.list_entities(ontology_quads(t), "class", 3, 8, "descriptions").select("uri", "label")


@query("o8_named_individuals", f"SELECT s AS uri FROM quads WHERE p = '{TYPE}' AND o IN (SELECT sub FROM class_closure WHERE super = '{ONTO}Agent' UNION SELECT '{ONTO}Agent')")
def o8(t: Tables) -> DataFrame:
    types = t.quads().filter(F.col("p") == TYPE).select("s", F.col("o").alias("class"))
    return ontology.named_individuals(types, ontology.class_closure(t.class_edges), f"{ONTO}Agent")


@query("o9_describe_entity", f"SELECT p, o FROM quads WHERE s = '{DS}nation/3' UNION ALL SELECT p, o FROM quads WHERE s = '{DS}region/1' UNION ALL SELECT '{ONTO}only', '_:r' FROM region WHERE r_regionkey = 1")
def o9(t: Tables) -> DataFrame:
    one = t.quads("region").filter(F.col("s") == f"{DS}region/1")
    link = one.limit(1).withColumns({"s": F.lit(f"{DS}nation/3"), "p": F.lit(f"{ONTO}only"), "o": F.lit("_:r"), "o_kind": F.lit("bnode")})
    return ontology.describe_entity(t.quads("nation").union(link).union(one.withColumn("s", F.lit("_:r"))), f"{DS}nation/3").select("p", "o")


@query("o10_upsert_entities", f"SELECT c AS s, 'Class' AS kind FROM ({CLASSES}) UNION ALL SELECT c || '-of', 'ObjectProperty' FROM ({CLASSES}) UNION ALL SELECT c, 'NamedIndividual' FROM ({CLASSES})")
def o10(t: Tables) -> DataFrame:
    quads = ontology_quads(t)
    new = quads.filter((F.col("p") == TYPE) & (F.col("o") == f"{OWL}Class")).withColumn("o", F.lit(f"{OWL}NamedIndividual"))
    out = ontology.upsert_entities(quads, new)
    return out.filter(F.col("p") == TYPE).select("s", F.substring_index("o", "#", -1).alias("kind"))


@query("o11_rename_entity", f"SELECT replace(s, 'nation/1', 'country/1') AS s, CASE WHEN p = '{ONTO}nation' THEN '{ONTO}country' ELSE p END AS p, CASE WHEN o_kind = 'uri' THEN regexp_replace(o, '/nation/(1[0-9]*)$', '/country/\\1') ELSE o END AS o FROM quads WHERE g IN ('{DS}nation/', '{DS}customer/')")
def o11(t: Tables) -> DataFrame:
    names = t.raw("nation").selectExpr("CAST(n_nationkey AS STRING) AS k").filter("k LIKE '1%'").selectExpr(f"'{DS}nation/' || k AS old", f"'{DS}country/' || k AS new")
    names = names.union(t.raw("region").limit(1).select(F.lit(f"{ONTO}nation"), F.lit(f"{ONTO}country")))
    return ontology.rename_entity(t.quads("nation", "customer"), names).select("s", "p", "o")


@query("o12_delete_entities", f"SELECT s, p, o FROM quads WHERE g = '{DS}part/' AND {ORDER_NO} % 3 <> 0")
def o12(t: Tables) -> DataFrame:
    return ontology.delete_entities(t.quads("part"), incoming(t).select("s")).select("s", "p", "o")


@query("o13_index_ontology", f"SELECT md5('{ONTO}' || c) AS uid, {NAME} AS label FROM ({CLASSES}) UNION ALL SELECT md5('{ONTO}' || c || '-of'), {NAME} || '-of' FROM ({CLASSES})")
def o13(t: Tables) -> DataFrame:
    quads = ontology_quads(t)
    docs, _ = ontology.index_ontology(quads.union(quads), t.statements, t.properties, t.class_edges, SUPPORTED)
    return docs.select("uid", F.col("pref_label").alias("label"))


@query("o14_export_schema", f"""SELECT kind, uri, line FROM (SELECT 'attribute' AS kind, c || '-of' AS uri, '{{"uri":"' || c || '-of","prefLabel":"' || {NAME} || '-of","description":"No description available","domain":["' || c || '"],"allowedValue":["{ONTO}Part"]}}' AS line FROM ({CLASSES}) UNION ALL SELECT 'type', c, '{{"uri":"' || c || '","prefLabel":"' || {NAME} || '","description":"No description available"' || coalesce((SELECT ',"subTypeOf":["' || string_agg(super, '","' ORDER BY super) || '"]' FROM class_edges WHERE sub = c), '') || '}}' FROM ({CLASSES}))""")
def o14(t: Tables) -> DataFrame:
    return ontology.export_schema(ontology_quads(t))


@query("q1_match", f"SELECT c.s AS customer, n.o AS nation, r.o AS region FROM quads c JOIN quads n ON n.s = c.o AND n.p = '{LABEL}' JOIN quads x ON x.s = c.o AND x.p = '{ONTO}region' JOIN quads r ON r.s = x.o AND r.p = '{LABEL}' WHERE c.p = '{ONTO}nation' AND c.g = '{DS}customer/'")
def q1(t: Tables) -> DataFrame:
    wanted = [("?customer", f"{ONTO}nation", "?n"), ("?customer", f"{ONTO}acctbal", "?balance"), ("?n", LABEL, "?nation"), ("?n", f"{ONTO}region", "?r"), ("?r", LABEL, "?region")]
    return patterns.match(t.quads("customer", "nation", "region"), wanted).select("customer", "nation", "region")


@query("q2_modifiers", f"SELECT s AS x, max(o) FILTER (p = '{ONTO}size') AS size, max(o) FILTER (p = '{ONTO}priority') AS priority, (SELECT count(DISTINCT o) FROM quads WHERE p = '{ONTO}brand') AS brands FROM quads WHERE g IN ('{DS}part/', '{DS}orders/') GROUP BY s HAVING max(o) FILTER (p = '{ONTO}size') IN ('7', '8') OR max(o) FILTER (p = '{ONTO}priority') = '1-URGENT' ORDER BY s LIMIT 50")
def q2(t: Tables) -> DataFrame:
    quads = t.quads("part", "orders")
    parts = patterns.filter_in(patterns.match(quads, [("?x", f"{ONTO}size", "?size")]), "size", ["7", "8"])
    orders = patterns.filter_in(patterns.match(quads, [("?x", f"{ONTO}priority", "?priority")]), "priority", ["1-URGENT"])
    both = patterns.union_patterns(parts, orders)
    brands = patterns.count_distinct(patterns.match(quads, [("?x", f"{ONTO}brand", "?brand")]), "brand").first()[0]
    named = patterns.optional(both, patterns.match(quads, [("?x", f"{ONTO}nothing", "?y")]))
    return patterns.order_limit(named.select("x", "size", "priority").distinct(), ["x"], 50).withColumn("brands", F.lit(brands).cast("long"))


@query("q3_bindings_to_records", f"SELECT s, count(DISTINCT o) AS parts, count(DISTINCT o) FILTER (o IN (SELECT o FROM statements st WHERE st.s = quads.s)) AS described FROM quads WHERE p = '{ONTO}part' GROUP BY s")
def q3(t: Tables) -> DataFrame:
    rows = t.quads("orders").filter(F.col("p") == f"{ONTO}part").select("g", "s", "p", "o", F.col("o_kind").alias("otype"), F.col("o_lang").alias("olang"))
    said = t.statements.select("s", "p", "o", F.md5(F.concat("s", "p", "o")).alias("rei_s"), "rei_p", "rei_o")
    out = patterns.bindings_to_records(rows.join(said, ["s", "p", "o"], "left"))
    values = F.col("attributes")[f"{ONTO}part"]
    return out.select("s", F.size(values).cast("long").alias("parts"), F.size(F.filter(values, lambda v: v["reify"].isNotNull())).cast("long").alias("described"))


@query("q4_check_graph_access", f"SELECT graph, regexp_replace(graph, '(reification|revisions)/$', '') IN (SELECT dataset FROM access a JOIN memberships m ON a.{GROUP} = m.{GROUP} WHERE user_uri = '{DS}customer/7' AND r) AS allowed FROM (SELECT DISTINCT unnest([g, g || 'reification/']) AS graph FROM quads)")
def q4(t: Tables) -> DataFrame:
    graphs = t.quads().select(F.explode(F.array("g", F.concat("g", F.lit("reification/")))).alias("graph")).distinct()
    return patterns.check_graph_access(graphs, t.access, t.memberships, f"{DS}customer/7")


CONCEPTS = [
    ("the", "the"), ("of", "of"), ("of the", "of the"), ("trash", "trash"), ("und der", "und der"), ("une", "Une"),
    ("clown", "clown"), ("apache", "Apache License"),
]
TAGS = ", ".join(f"('{c}', '{label.lower()}', {len(label.split())})" for c, label in CONCEPTS)
WORD = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
STEMMED = [("clown", "clowns"), ("insult", "idiots"), ("waste", "trashed")]


@query("t1_tag_concepts", f"""
SELECT doc_id, concept, i - 1 AS "first", i - 1 + n AS "last"
FROM (
  SELECT doc_id, unnest(w) AS word, unnest([''] || w) AS before, unnest(w[2:]) AS after, unnest(range(1, len(w) + 1)) AS i
  FROM (SELECT doc_id, {WORD} AS w FROM documents)
)
JOIN (VALUES {TAGS}) l(concept, label, n) ON label = CASE n WHEN 1 THEN word ELSE word || ' ' || after END
WHERE NOT (label = 'of' AND coalesce(after, '') = 'the') AND NOT (label = 'the' AND before = 'of')""")
def t1(t: Tables) -> DataFrame:
    return tagging.tag_concepts(t.raw("documents"), t.spark.createDataFrame(CONCEPTS, "concept string, label string"))


@query("t1_tag_concepts_stemmed", f"""
SELECT * FROM (
  SELECT doc_id, i - 1 AS "first", i AS "last", CASE
    WHEN regexp_full_match(word, 'clown(e|s|es|ed|eds|ing|ings|ness|ful|fulness)?') THEN 'clown'
    WHEN regexp_full_match(word, 'idiot(ic|ical|ically|ism|er)?(e|s|es|ed|eds|ing|ings|ness|ful|fulness)?') THEN 'insult'
    WHEN regexp_full_match(word, 'trash(e|s|es|ed|eds|ing|ings|ness|ful|fulness)?') THEN 'waste' END AS concept
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, {WORD} AS w FROM documents))
)
WHERE concept IS NOT NULL""")
def t1b(t: Tables) -> DataFrame:
    return tagging.tag_concepts(t.raw("documents"), t.spark.createDataFrame(STEMMED, "concept string, label string"), stemming=True)
