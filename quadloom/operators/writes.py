"""Writes as pure functions of old tables and changes; the caller writes the new version to a new path. The same changes on a
stored table, in place of whole tables, are quadloom/sources/versioned.py, and with its index quadloom/operators/maintain.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.model import TYPE

Store = dict[str, DataFrame]


def _without(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(keys.select(*on).distinct(), on, "left_anti")


def clashes(store: Store, incoming: DataFrame) -> DataFrame:
    """(g, s) of incoming subjects that already have a type or a revision."""
    keys = incoming.select("g", "s").distinct()
    typed = keys.join(store["quads"].filter(F.col("p") == TYPE).select("g", "s"), ["g", "s"], "left_semi")
    old = store["revisions"].select(F.col("dataset").alias("g"), F.col("record_uri").alias("s"))
    return typed.union(keys.join(old, ["g", "s"], "left_semi")).distinct()


def create_records(store: Store, incoming: DataFrame, statements: DataFrame, index: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> Store:
    """The store with incoming quads and statements added (and index rows, by the caller's index function); the whole batch
    is refused if any subject exists."""
    if not clashes(store, incoming).isEmpty():
        raise ValueError("a record of the batch exists already")
    out = store | {"quads": store["quads"].unionByName(incoming), "statements": store["statements"].unionByName(statements)}
    if index is not None:
        docs, fields = index(incoming, statements)
        out |= {"docs": store["docs"].unionByName(docs), "doc_fields": store["doc_fields"].unionByName(fields)}
    return out


def update_records(quads: DataFrame, incoming: DataFrame) -> DataFrame:
    """All old quads of the incoming (g, s) go, the incoming ones come."""
    return _without(quads, incoming, ["g", "s"]).unionByName(incoming)


def replace_statements(statements: DataFrame, subjects: DataFrame, incoming: DataFrame) -> DataFrame:
    """Statements about the updated subjects (g, s) go, incoming ones come; without incoming they just go."""
    return _without(statements, subjects, ["g", "s"]).unionByName(incoming)


def delete_records(store: Store, keys: DataFrame, mode: str = "soft") -> Store:
    """soft: quads, statements and index rows of keys (g, s) go, published revisions become archived. hard: revisions go too."""
    of_record = keys.select(F.col("g").alias("dataset"), F.col("s").alias("record_uri")).distinct()
    out = dict(store) | {t: _without(store[t], keys, ["g", "s"]) for t in ("quads", "statements")}
    if "docs" in store:
        uids = store["docs"].join(keys.select(F.col("g").alias("dataset"), F.col("s").alias("uri")), ["dataset", "uri"], "left_semi").select("uid")
        out |= {t: _without(store[t], uids, ["uid"]) for t in ("docs", "doc_fields") if t in store}
    revisions = store["revisions"]
    if mode == "hard":
        kept = _without(revisions, of_record, ["dataset", "record_uri"])
        out["revisions"] = kept
        if "revision_quads" in store:
            out["revision_quads"] = store["revision_quads"].join(kept.select("rev_uri"), "rev_uri", "left_semi")
        return out
    hit = revisions.join(of_record.withColumn("_gone", F.lit(True)), ["dataset", "record_uri"], "left")
    status = F.when(F.coalesce("_gone", F.lit(False)) & (F.col("status") == "published"), "archive").otherwise(F.col("status"))
    out["revisions"] = hit.withColumn("status", status).select(*revisions.columns)
    return out


def delete_dataset(store: Store, dataset: str) -> Store:
    """Everything of the dataset goes; refused if it holds an ontology. store may hold datasets, access, quads, statements,
    revisions, revision_quads, docs and doc_fields; what has no dataset of its own goes with its revision or document."""
    if not store["datasets"].filter((F.col("dataset") == dataset) & F.col("holds_ontology")).isEmpty():
        raise ValueError("the dataset holds an ontology")
    column = {"quads": "g", "statements": "g"}
    out = {t: rows.filter(F.col(column.get(t, "dataset")) != dataset) if column.get(t, "dataset") in rows.columns else rows for t, rows in store.items()}
    for owner, owned, key in (("revisions", "revision_quads", "rev_uri"), ("docs", "doc_fields", "uid")):
        if owner in store and owned in store:
            gone = store[owner].filter(F.col("dataset") == dataset).select(key)
            out[owned] = store[owned].join(gone, key, "left_anti")
    return out


def create_dataset(datasets: DataFrame, new: DataFrame) -> DataFrame:
    if not datasets.join(new.select("dataset"), "dataset", "left_semi").isEmpty():
        raise ValueError("the dataset exists already")
    return datasets.unionByName(new, allowMissingColumns=True)


def update_dataset(datasets: DataFrame, changes: DataFrame) -> DataFrame:
    """Given fields replace old ones, null keeps, '-delete-' clears; contributors are replaced as a list."""
    new = changes.select("dataset", *[F.col(c).alias(f"_{c}") for c in changes.columns if c != "dataset"])
    out = datasets.join(new, "dataset", "left")
    for c in changes.columns:
        if c != "dataset":
            cleared = F.array_contains(f"_{c}", "-delete-") if c == "contributors" else F.col(f"_{c}") == "-delete-" if dict(changes.dtypes)[c] == "string" else F.lit(False)
            out = out.withColumn(c, F.when(F.coalesce(cleared, F.lit(False)), F.lit(None)).otherwise(F.coalesce(f"_{c}", c))).drop(f"_{c}")
    return out.select(*datasets.columns)


def apply_access_changes(access: DataFrame, groups: DataFrame, memberships: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """changes: op, group, dataset, services, c, r, u, d, app_id, user. Ops: grant (create or update), revoke, revoke_dataset,
    revoke_group, create_group, delete_group (with members and grants), join, leave."""
    of = lambda *ops: changes.filter(F.col("op").isin(*ops))
    key = F.md5(F.concat("group", "dataset"))
    left = _without(access, of("revoke_dataset"), ["dataset"])
    left = _without(left, of("revoke_group", "delete_group"), ["group"])
    grants = of("grant").select(key.alias("access_uri"), "group", "dataset", "services", "c", "r", "u", "d")
    left = _without(left, grants.select("access_uri").union(of("revoke").select(key.alias("access_uri"))), ["access_uri"]).unionByName(grants)
    new_groups = _without(groups, of("delete_group", "create_group"), ["group"]).unionByName(of("create_group").select("group", "app_id"))
    members = _without(memberships, of("delete_group"), ["group"])
    members = _without(members, of("leave", "join"), ["user", "group"]).unionByName(of("join").select("user", "group"))
    return left, new_groups, members
