"""Filters of the faceted search. Each returns the distinct uids that match, so filters combine by set algebra; docs and
doc_fields are the tables of build_index."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.uris import great_circle_km, query_words, tokens

KM_PER_MILE = 1.60934
#: Short names of the core fields and the columns of docs they stand for.
CORE = {"uri": "uri", "dataset": "dataset", "prefLabel": "pref_label", "altLabel": "alt_labels", "description": "description", "type": "types", "inferred_type": "inferred_types", "located_in": "located_in"}


def term_rows(texts: DataFrame, column: str = "text") -> DataFrame:
    """(uid, term): distinct words of each document."""
    return texts.select("uid", F.explode(tokens(F.col(column))).alias("term")).distinct()


def filter_text(texts: DataFrame, query: str, operator: str = "and", min_match: int | None = None, column: str = "text", lang: str | None = None, fields: list[str] | None = None) -> DataFrame:
    """Documents of texts (uid, text) with all, any, or at least min_match of the distinct query words. With lang or fields,
    only texts of that language (column lang) or of those fields (column field) are searched; a document's fields count
    together. An empty query matches every document that has a text there. Rows are narrowed to the query's words before
    anything is shuffled."""
    texts = texts if lang is None else texts.filter(F.col("lang") == lang)
    texts = texts if fields is None else texts.filter(F.col("field").isin(fields))
    wanted = sorted(set(query_words(query)))
    if not wanted:
        return texts.select("uid").distinct()
    least = min_match if min_match is not None else len(wanted) if operator == "and" else 1
    hits = F.array_intersect(tokens(F.col(column)), F.array(*map(F.lit, wanted)))
    found = texts.select("uid", F.explode(hits).alias("term")).distinct()
    return found.groupBy("uid").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("uid")


def filter_dataset(docs: DataFrame, datasets: list[str] | None, accessible: DataFrame) -> DataFrame:
    """Only listed datasets (None: all) that are accessible; nothing allowed gives nothing."""
    kept = docs if datasets is None else docs.filter(F.col("dataset").isin(datasets))
    return kept.join(accessible.select("dataset").distinct(), "dataset", "left_semi").select("uid").distinct()


def filter_type(docs: DataFrame, types: list[str], inference: bool = True) -> DataFrame:
    wanted = F.array(*map(F.lit, types))
    hit = F.arrays_overlap("types", wanted)
    return docs.filter(hit | F.arrays_overlap("inferred_types", wanted) if inference else hit).select("uid").distinct()


def filter_has_attribute(fields: DataFrame, attrs: list[str], op: str = "or") -> DataFrame:
    found = fields.filter(F.col("attr").isin(attrs)).select("uid", "attr").distinct()
    return found.groupBy("uid").agg(F.count("*").alias("n")).filter(F.col("n") >= (len(set(attrs)) if op == "and" else 1)).select("uid")


def filter_attribute_text(fields: DataFrame, attr: str, value: str, op: str = "and") -> DataFrame:
    """Words of value in the attribute's text or object labels; with * in value, a pattern over the whole value."""
    rows = fields.filter((F.col("attr") == attr) & F.col("kind").isin("text", "object"))
    if "*" in value:
        pattern = value.lower().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
        return rows.filter(F.lower("value").like(pattern)).select("uid").distinct()
    return filter_text(rows, value, op, column="value")


def filter_attribute_number(fields: DataFrame, attr: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Values in [low, high]; None is open. One number twice is equality."""
    value = F.coalesce(F.col("int").cast("double"), F.col("float"))
    rows = fields.filter((F.col("attr") == attr) & value.isNotNull())
    for bound, test in ((low, value >= F.lit(low)), (high, value <= F.lit(high))):
        if bound is not None:
            if not isinstance(bound, (int, float)):
                raise ValueError(f"not a number: {bound!r}")
            rows = rows.filter(test)
    return rows.select("uid").distinct()


def filter_attribute_date(fields: DataFrame, attr: str, start: str | None, end: str | None) -> DataFrame:
    """Dates in [start, end], None is open; the caller passes its own now as end where a single date is meant."""
    rows = fields.filter((F.col("attr") == attr) & F.col("date").isNotNull())
    if start is not None:
        rows = rows.filter(F.col("date") >= F.to_timestamp(F.lit(start)))
    if end is not None:
        rows = rows.filter(F.col("date") <= F.to_timestamp(F.lit(end)))
    return rows.select("uid").distinct()


def filter_attribute_uri(fields: DataFrame, attr: str, uri: str) -> DataFrame:
    return fields.filter((F.col("attr") == attr) & (F.col("obj_uri") == uri)).select("uid").distinct()


def filter_core(docs: DataFrame, name: str, value: str) -> DataFrame:
    """A core field by its short name; a coordinate that is no number filters nothing."""
    short = name.rsplit("#", 1)[-1].rsplit("/", 1)[-1]
    if short in ("lat", "long", "alt"):
        try:
            number = float(value)
        except ValueError:
            return docs.select("uid").distinct()
        return docs.filter(F.exists("points", lambda p: p[short] == number)).select("uid").distinct()
    if short in ("polygon", "polyline"):
        return docs.filter(F.exists("points", lambda p: p["kind"] == short)).select("uid").distinct()
    column = CORE[short]
    is_list = dict(docs.dtypes).get(column, "").startswith("array")
    if column not in docs.columns:
        raise ValueError(f"docs has no column {column}; build_index makes it")
    return docs.filter(F.array_contains(column, value) if is_list else F.col(column) == value).select("uid").distinct()


def combine(filters: list[DataFrame], op: str = "and") -> DataFrame:
    if op == "or":
        return reduce(DataFrame.union, filters).distinct()
    return reduce(lambda a, b: a.join(b, "uid", "left_semi"), filters)


@dataclass(frozen=True)
class Attr:
    """A leaf: a frame of uids that match one attribute filter, and the attribute for the check against the catalogue."""

    name: str
    uids: DataFrame


@dataclass(frozen=True)
class And:
    parts: tuple


@dataclass(frozen=True)
class Or:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Dataset:
    """A leaf: the records of one dataset."""

    uri: str


def filter_expression(docs: DataFrame, expression, known: set[str] | None = None, accessible: DataFrame | None = None) -> DataFrame:
    """Set algebra on uids over a tree of And, Or, Not, Attr and Dataset. An attribute outside `known` is an error, and so is a
    dataset that `accessible` (dataset) does not hold."""
    if isinstance(expression, Dataset):
        if accessible is not None and accessible.filter(F.col("dataset") == expression.uri).isEmpty():
            raise ValueError(f"no access to {expression.uri}")
        return docs.filter(F.col("dataset") == expression.uri).select("uid").distinct()
    if isinstance(expression, Attr):
        if known is not None and expression.name not in known:
            raise ValueError(f"unknown attribute {expression.name}")
        return docs.join(expression.uids, "uid", "left_semi").select("uid").distinct()
    if isinstance(expression, Not):
        return docs.select("uid").distinct().join(filter_expression(docs, expression.part, known, accessible), "uid", "left_anti")
    parts = [filter_expression(docs, p, known, accessible) for p in expression.parts]
    return combine(parts, "and" if isinstance(expression, And) else "or")


def autocomplete(docs: DataFrame, prefix: str) -> DataFrame:
    return docs.filter(F.lower("pref_label").startswith(prefix.lower())).select("uid", "pref_label")


def _points(docs: DataFrame) -> DataFrame:
    return docs.select("uid", F.explode("points").alias("p")).select("uid", "p.lat", "p.long", "p.kind")


def distance_column(lat: float, long: float) -> Column:
    return great_circle_km(F.col("lat"), F.col("long"), F.lit(float(lat)), F.lit(float(long)))


def filter_distance(docs: DataFrame, lat: float, long: float, distance: float, miles: bool = False) -> DataFrame:
    """Documents with any point within the distance; a band of latitude is tested before the full formula."""
    km = distance * KM_PER_MILE if miles else distance
    band = km / 110.5
    near = _points(docs).filter(F.col("lat").between(lat - band, lat + band)).filter(distance_column(lat, long) <= km)
    return near.select("uid").distinct()


def filter_box(docs: DataFrame, lat1: float, long1: float, lat2: float, long2: float) -> DataFrame:
    """Documents with one point inside both ranges, corners in any order."""
    inside = F.col("lat").between(min(lat1, lat2), max(lat1, lat2)) & F.col("long").between(min(long1, long2), max(long1, long2))
    return _points(docs).filter(inside).select("uid").distinct()
