"""Access resolution over access, groups and memberships, all joins; the small tables are broadcast by Spark's own measure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accessible_datasets(access: DataFrame, memberships: DataFrame, user: str, readable: bool = True) -> DataFrame:
    """(dataset): through any of the user's groups; readable keeps grants with read."""
    mine = memberships.filter(F.col("user") == user).select("group")
    rows = access.join(mine, "group", "left_semi")
    return (rows.filter("r") if readable else rows).select("dataset").distinct()


def list_groups(groups: DataFrame) -> DataFrame:
    return groups.select("group", "app_id").distinct()


def group_users(memberships: DataFrame, group: str) -> DataFrame:
    return memberships.filter(F.col("group") == group).select("user").distinct()


def user_groups(memberships: DataFrame, user: str) -> DataFrame:
    return memberships.filter(F.col("user") == user).select("group").distinct()


def list_access(access: DataFrame, memberships: DataFrame, by: str, target: str, service: str = "all") -> DataFrame:
    """Access records of a user, group or dataset with flags; services are sorted for 'all', left out for 'none', and a
    service name narrows to records that have it."""
    if by == "user":
        rows = access.join(memberships.filter(F.col("user") == target).select("group").distinct(), "group", "left_semi")
    elif by in ("group", "dataset"):
        rows = access.filter(F.col(by) == target)
    else:
        raise ValueError(f"by user, group or dataset, not {by}")
    if service not in ("all", "none"):
        rows = rows.filter(F.array_contains("services", service))
    out = rows.groupBy("access_uri", "group", "dataset", "c", "r", "u", "d").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("services")))).alias("services"))
    return out.drop("services") if service == "none" else out


def authorize(requests: DataFrame, access: DataFrame, groups: DataFrame, memberships: DataFrame, datasets: DataFrame) -> DataFrame:
    """(request, allowed) for requests (request, user, app_id, service, datasets, c, r, u, d): every dataset must be
    registered and have one grant, through a group of the user and the app, with the service and all wanted flags."""
    asked = requests.withColumn("dataset", F.explode_outer("datasets")).drop("datasets")
    asked = asked.join(datasets.select("dataset").distinct().withColumn("known", F.lit(True)), "dataset", "left")
    mine = memberships.join(groups, "group").select("user", "app_id", "group").distinct()
    grants = access.select("group", "dataset", F.col("services").alias("_s"), F.col("c").alias("_c"), F.col("r").alias("_r"), F.col("u").alias("_u"), F.col("d").alias("_d"))
    held = asked.join(mine, ["user", "app_id"]).join(grants, ["group", "dataset"])
    enough = F.array_contains("_s", F.col("service"))
    for flag in "crud":
        enough = enough & (~F.coalesce(flag, F.lit(False)) | F.col(f"_{flag}"))
    granted = held.filter(enough).select("request", "dataset").distinct().withColumn("granted", F.lit(True))
    each = asked.join(granted, ["request", "dataset"], "left")
    return each.groupBy("request").agg(F.bool_and(F.coalesce("known", F.lit(False)) & F.coalesce("granted", F.lit(False))).alias("allowed"))


def dataset_catalog(datasets: DataFrame, access: DataFrame, memberships: DataFrame, user: str) -> DataFrame:
    """Descriptions of what the user may see, ordered by title; contributors sorted, holds_ontology false if not said."""
    seen = datasets.join(accessible_datasets(access, memberships, user), "dataset", "left_semi")
    out = seen.withColumns({"contributors": F.sort_array(F.array_distinct("contributors")), "holds_ontology": F.coalesce("holds_ontology", F.lit(False))})
    return out.orderBy("title", "dataset")
