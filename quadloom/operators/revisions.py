"""Revisions: revisions (rev_uri, dataset, record_uri, rev_time, performer, status) and revision_quads (rev_uri, p, o, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.model import REVISION, REVISION_META, TYPE
from quadloom.operators.writes import Store, delete_records, update_records

STAGES = ("published", "archive", "experimental", "pre_release", "staging", "harvesting", "unspecified")


def latest_revision(revisions: DataFrame) -> DataFrame:
    """Per record the newest by time (the larger URI on a tie); one map-side aggregate."""
    newest = F.max(F.struct("rev_time", "rev_uri", "performer", "status"))
    return revisions.groupBy("dataset", "record_uri").agg(newest.alias("m")).select("dataset", "record_uri", "m.rev_uri", "m.rev_time", "m.performer", "m.status")


def check_publishable(revisions: DataFrame, keys: DataFrame) -> DataFrame:
    """(dataset, record_uri, publishable) per key: false if the latest revision is not published."""
    latest = latest_revision(revisions).select("dataset", "record_uri", "status")
    return keys.join(latest, ["dataset", "record_uri"], "left").select("dataset", "record_uri", F.coalesce(F.col("status") == "published", F.lit(True)).alias("publishable"))


def add_revisions(revisions: DataFrame, incoming: DataFrame, lifecycle: str, time: int, performer: str) -> DataFrame:
    """revisions plus one per incoming (dataset, record_uri). A record without any also gets its initial state one second
    earlier, archived if this one is published, else published. The URI is the time and the record's key, so reruns agree."""
    keys = incoming.select("dataset", "record_uri").distinct()
    first = keys.join(revisions.select("dataset", "record_uri").distinct(), ["dataset", "record_uri"], "left_anti")

    def made(rows: DataFrame, when: int, status: str) -> DataFrame:
        uri = F.concat("dataset", F.lit(f"revisions/{when}-"), F.md5("record_uri"))
        return rows.select(uri.alias("rev_uri"), "dataset", "record_uri", F.lit(when).cast(dict(revisions.dtypes)["rev_time"]).alias("rev_time"), F.lit(performer).alias("performer"), F.lit(status).alias("status"))

    initial = made(first, time - 1, "archive" if lifecycle == "published" else "published")
    return revisions.unionByName(initial).unionByName(made(keys, time, lifecycle))


def publish_revisions(revisions: DataFrame, rev_uris: DataFrame) -> DataFrame:
    """Chosen revisions become published; others of their records that were published become archived."""
    chosen = rev_uris.select("rev_uri").distinct().withColumn("_new", F.lit(True))
    records = revisions.join(chosen, "rev_uri", "left_semi").select("dataset", "record_uri").distinct().withColumn("_hit", F.lit(True))
    rows = revisions.join(chosen, "rev_uri", "left").join(records, ["dataset", "record_uri"], "left")
    status = F.when(F.col("_new"), "published").when(F.col("_hit") & (F.col("status") == "published"), "archive").otherwise(F.col("status"))
    return rows.withColumn("status", status).select(*revisions.columns)


def published_store(store: Store, rev_uris: DataFrame) -> Store:
    """publish_revisions, and the records replaced by the content of the chosen revisions."""
    content = store["revision_quads"].join(store["revisions"].join(rev_uris, "rev_uri", "left_semi").select("rev_uri", F.col("dataset").alias("g"), F.col("record_uri").alias("s")), "rev_uri")
    content = content.filter(~F.col("p").isin(*REVISION_META) & ~((F.col("p") == TYPE) & (F.col("o") == REVISION))).select("g", "s", "p", "o", "o_kind", "o_type", "o_lang", F.lit(0).cast("long").alias("pos"))
    return store | {"revisions": publish_revisions(store["revisions"], rev_uris), "quads": update_records(store["quads"], content)}


def set_lifecycle(store: Store, rev_uris: DataFrame, stage: str) -> Store:
    """Another stage for the chosen revisions; a record whose published revision leaves publication is deleted softly."""
    if stage not in STAGES or stage == "published":
        raise ValueError(f"not a stage: {stage}")
    revisions = store["revisions"]
    hit = revisions.join(rev_uris.select("rev_uri").distinct().withColumn("_hit", F.lit(True)), "rev_uri", "left")
    leaving = hit.filter(F.col("_hit") & (F.col("status") == "published")).select(F.col("dataset").alias("g"), F.col("record_uri").alias("s")).distinct()
    changed = hit.withColumn("status", F.when(F.col("_hit"), stage).otherwise(F.col("status"))).select(*revisions.columns)
    return delete_records(store, leaving) | {"revisions": changed}


def list_revisions(revisions: DataFrame, record: str, mode: str = "short") -> DataFrame:
    """Newest first: uri and time, with performer and status in long mode."""
    columns = ["rev_uri", "rev_time"] + (["performer", "status"] if mode == "long" else [])
    return revisions.filter(F.col("record_uri") == record).select(*columns).orderBy(F.desc("rev_time"), F.desc("rev_uri"))


def read_revision(revision_quads: DataFrame, revisions: DataFrame, rev_uris: DataFrame, mode: str = "revision") -> DataFrame:
    """(s, p, o, ...) of revisions (rev_uri): as stored, or with the record's own URI and without revision metadata."""
    rows = revision_quads.join(rev_uris.select("rev_uri").distinct(), "rev_uri", "left_semi")
    if mode == "revision":
        return rows.withColumnRenamed("rev_uri", "s")
    rows = rows.filter(~F.col("p").isin(*REVISION_META) & ~((F.col("p") == TYPE) & (F.col("o") == REVISION)))
    return rows.join(revisions.select("rev_uri", F.col("record_uri").alias("s")), "rev_uri").drop("rev_uri")


def diff_revisions(revision_quads: DataFrame, revisions: DataFrame, left: str, right: str, strict: bool = False) -> DataFrame:
    """(stmt, change, p, o) from left to right; both must be of one record. Types, languages and datatypes are compared only
    if strict."""
    if revisions.filter(F.col("rev_uri").isin(left, right)).select("record_uri").distinct().count() != 1:
        raise ValueError("the revisions are not of one record")
    pairs = revisions.filter(F.col("rev_uri") == right).select("record_uri", F.col("rev_uri"), F.lit(left).alias("before"))
    return diff_pairs(revision_quads, pairs, strict).drop("rev_uri")


def diff_pairs(revision_quads: DataFrame, pairs: DataFrame, strict: bool = False) -> DataFrame:
    """(rev_uri, stmt, change, p, o) for many pairs (record_uri, rev_uri, before) in two anti joins."""
    keys = ["rev_uri", "p", "o", *(["o_kind", "o_type", "o_lang"] if strict else [])]
    rows = revision_quads if strict else revision_quads.filter(F.col("p") != TYPE)
    filled = rows.select("rev_uri", "p", "o", *[F.coalesce(c, F.lit("")).alias(c) for c in keys[3:]]).distinct()
    after = filled.join(pairs.select("rev_uri", "record_uri"), "rev_uri")
    before = filled.withColumnRenamed("rev_uri", "before").join(pairs, "before").select(*keys, "record_uri")
    added = after.join(before.select(*keys), keys, "left_anti").withColumn("change", F.lit("addition"))
    removed = before.join(after.select(*keys), keys, "left_anti").withColumn("change", F.lit("removal"))
    stmt = F.concat("change", F.lit("-"), F.md5(F.concat("record_uri", "p", "o")))
    return added.unionByName(removed).select("rev_uri", stmt.alias("stmt"), "change", "p", "o")


def predecessors(revisions: DataFrame) -> DataFrame:
    """(record_uri, rev_uri, before): each revision and the one before it."""
    order = Window.partitionBy("dataset", "record_uri").orderBy("rev_time", "rev_uri")
    return revisions.select("record_uri", "rev_uri", F.lag("rev_uri").over(order).alias("before")).filter("before IS NOT NULL")


def delete_revisions(revisions: DataFrame, revision_quads: DataFrame, rev_uris: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the chosen revisions; refused if one is published."""
    if not revisions.join(rev_uris, "rev_uri", "left_semi").filter("status = 'published'").isEmpty():
        raise ValueError("a published revision cannot be deleted")
    return tuple(t.join(rev_uris.select("rev_uri").distinct(), "rev_uri", "left_anti") for t in (revisions, revision_quads))
