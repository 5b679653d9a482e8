"""Scores, boosts, sorting, paging, facets, nested results and spelling suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.functions.uris import query_words, tokens
from quadloom.model import RDFS
from quadloom.operators.search import distance_column

K1, B = 1.2, 0.75


def score_text(texts: DataFrame, query: str, field_weights: dict[str, float] | None = None) -> DataFrame:
    """(uid, score): sum over fields of weight * BM25 (k1 1.2, b 0.75). texts has uid, field and text; document counts and
    mean lengths are those of each field over the whole table. Term rows are narrowed to the query's words first; the
    document frequencies are one row per field and query word."""
    wanted = F.array(*map(F.lit, sorted(set(query_words(query)))))
    rows = texts.select("uid", "field", tokens(F.col("text")).alias("w")).select("uid", "field", F.size("w").alias("length"), F.filter("w", lambda x: F.array_contains(wanted, x)).alias("hits"))
    if field_weights:
        rows = rows.filter(F.col("field").isin(list(field_weights)))
    stats = rows.groupBy("field").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    tf = rows.filter(F.size("hits") > 0).select("uid", "field", "length", F.explode("hits").alias("term")).groupBy("uid", "field", "length", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("field", "term").agg(F.count("*").alias("df"))
    joined = tf.join(df, ["field", "term"]).join(stats, "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    weight: Column = F.lit(1.0)
    for field, w in (field_weights or {}).items():
        weight = F.when(F.col("field") == field, F.lit(float(w))).otherwise(weight)
    return joined.groupBy("uid").agg(F.sum(part * weight).alias("score"))


def boost(docs: DataFrame, types: dict[str, float] | None = None, datasets: dict[str, float] | None = None, attributes: dict[str, float] | None = None, attribute_values: dict[tuple[str, str], float] | None = None, fields: DataFrame | None = None) -> DataFrame:
    """(uid, boost): added weights of what a record has; never filters."""
    total: Column = F.lit(0.0)
    for t, w in (types or {}).items():
        total = total + F.when(F.array_contains("types", t) | F.array_contains("inferred_types", t), F.lit(float(w))).otherwise(0.0)
    for d, w in (datasets or {}).items():
        total = total + F.when(F.col("dataset") == d, F.lit(float(w))).otherwise(0.0)
    out = docs.select("uid", total.alias("boost"))
    if attributes or attribute_values:
        has = [F.max(F.when(F.col("attr") == a, F.lit(float(w))).otherwise(0.0)) for a, w in (attributes or {}).items()]
        has += [F.max(F.when((F.col("attr") == a) & (F.col("value") == v), F.lit(float(w))).otherwise(0.0)) for (a, v), w in (attribute_values or {}).items()]
        names = [*(attributes or {}), *(a for a, _ in attribute_values or {})]
        more = fields.filter(F.col("attr").isin(names)).groupBy("uid").agg(sum(has[1:], has[0]).alias("more"))
        out = out.join(more, "uid", "left").select("uid", (F.col("boost") + F.coalesce("more", F.lit(0.0))).alias("boost"))
    return out


def boost_phrase(fields: DataFrame, query: str, attr_weights: dict[str, float], slop: int = 0) -> DataFrame:
    """(uid, boost): weight for each value in which all query words stand within a window of their number plus slop. Only places
    of query words are compared, each with those that follow within the window; values without all words are not cut into words."""
    words = query_words(query)
    width = len(words) + slop
    rows = fields.filter(F.col("attr").isin(list(attr_weights)))
    for word in sorted(set(words)):
        rows = rows.filter(F.lower("value").contains(word))
    # a row is cut into words once: what stands behind an explode is not computed again by filters
    rows = rows.select("uid", "attr", F.explode(F.array(tokens(F.col("value")))).alias("w")).filter(F.size("w") > 0)
    if words:
        wanted = F.array(*map(F.lit, sorted(set(words))))
        places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array_contains(wanted, F.get("w", i)))
        hits = rows.select("uid", "attr", "w", F.explode(F.array(places)).alias("at")).filter(F.size("at") > 0)
        hits = hits.select("uid", "attr", "at", F.explode(F.array(F.transform("at", lambda i: F.get("w", i)))).alias("word"))

        def near(k: Column) -> Column:
            after = F.filter(F.sequence(k, F.least(k + width, F.size("at")) - 1), lambda j: F.get("at", j) < F.get("at", k) + width)
            return F.size(F.array_except(wanted, F.transform(after, lambda j: F.get("word", j)))) == 0

        rows = hits.filter(F.exists(F.sequence(F.lit(0), F.size("at") - 1), near))
    weight: Column = F.lit(0.0)
    for attr, w in attr_weights.items():
        weight = F.when(F.col("attr") == attr, F.lit(float(w))).otherwise(weight)
    return rows.select("uid", "attr", weight.alias("w")).distinct().groupBy("uid").agg(F.sum("w").alias("boost"))


def boost_near(docs: DataFrame, lat: float, long: float, floor_km: float = 0.1) -> DataFrame:
    """(uid, boost): 100 / distance of the nearest point, with the distance at least floor_km."""
    points = docs.select("uid", F.explode("points").alias("p")).select("uid", "p.lat", "p.long")
    return points.groupBy("uid").agg((F.lit(100.0) / F.greatest(F.min(distance_column(lat, long)), F.lit(floor_km))).alias("boost"))


def sort_records(docs: DataFrame, keys: list[str], fields: DataFrame | None = None) -> DataFrame:
    """Order by `key asc|desc` keys: a column of docs, type (the first one), or a single-valued attribute; uid settles ties."""
    order, out = [], docs
    for n, key in enumerate(keys):
        name, _, way = key.partition(" ")
        column = F.get("types", F.lit(0)) if name == "type" else None
        if column is None and name in docs.columns:
            column = F.col(name)
        if column is None:
            mine = fields.filter(F.col("attr") == name)
            if not mine.filter(~F.col("single_valued")).isEmpty():
                raise ValueError(f"cannot sort by {name}: it may have several values")
            value = mine.select("uid", F.struct("int", "float", "date", "value").alias(f"_k{n}"))
            out, column = out.join(value, "uid", "left"), F.col(f"_k{n}")
        order.append(column.desc_nulls_last() if way == "desc" else column.asc_nulls_last())
    return out.orderBy(*order, "uid").select(*docs.columns)


def page(ordered: DataFrame, offset: int = 0, limit: int = 10) -> DataFrame:
    """limit rows (0 to 300) from offset on; Spark keeps the top rows of each partition only."""
    if not 0 <= limit <= 300 or offset < 0:
        raise ValueError("limit must be 0 to 300 and offset 0 or more")
    return ordered.offset(offset).limit(limit)


def project(fields: DataFrame, attributes: list[str] | None) -> DataFrame:
    """Values of the listed attributes; None keeps all, an empty list none."""
    return fields if attributes is None else fields.filter(F.col("attr").isin(attributes)) if attributes else fields.limit(0)


def count_hits(uids: DataFrame) -> DataFrame:
    return uids.agg(F.count_distinct("uid").alias("n"))


def facet_core(docs: DataFrame, fields: DataFrame, inference: bool = True) -> DataFrame:
    """(kind, value, n): records by type, dataset, attribute and inferred type. Inferred types that stand as types, and
    rdfs:Class, are left out. docs and fields hold the matches only."""
    types = docs.select("uid", F.explode(F.array_distinct("types")).alias("value"))
    parts = types.groupBy("value").agg(F.count("*").alias("n")).select(F.lit("type").alias("kind"), "value", "n")
    parts = parts.union(docs.groupBy("dataset").agg(F.count("*").alias("n")).select(F.lit("dataset"), "dataset", "n"))
    parts = parts.union(fields.select("uid", "attr").distinct().groupBy("attr").agg(F.count("*").alias("n")).select(F.lit("attribute"), "attr", "n"))
    if inference:
        more = docs.select(F.explode(F.array_distinct("inferred_types")).alias("value")).groupBy("value").agg(F.count("*").alias("n")).filter(F.col("value") != f"{RDFS}Class")
        more = more.join(types.select("value").distinct(), "value", "left_anti")
        parts = parts.union(more.select(F.lit("inferred_type"), "value", "n"))
    return parts


#: How facet_values names a value that is another record.
FORMS = ("uri", "literal", "uriliteral")


def facet_values(fields: DataFrame, attrs: list[str], n: int = 10, form: str = "uriliteral") -> DataFrame:
    """(attr, uri, label, n): the n commonest values of each attribute (-1: all), ties by value. Values that are other records are
    counted and named in the form that is asked for: by their URI (label is null), by their label (uri is null), or by both.
    Plain values are labels in every form. Where an attribute has both sorts of values, its plain ones are left out. Counts are of
    distinct records and are combined before the shuffle."""
    if form not in FORMS:
        raise ValueError(f"form is one of {', '.join(FORMS)}")
    is_uri = F.col("obj_uri").isNotNull()
    uri = F.lit(None).cast("string") if form == "literal" else F.col("obj_uri")
    label = F.when(~is_uri, F.col("value")) if form == "uri" else F.col("value")
    rows = fields.filter(F.col("attr").isin(attrs)).select("uid", "attr", uri.alias("uri"), label.alias("label"), is_uri.alias("is_uri")).distinct()
    counts = rows.groupBy("attr", "uri", "label", "is_uri").agg(F.count("*").alias("n"))
    sorts = counts.groupBy("attr").agg(F.max("is_uri").alias("is_uri"))
    counts = counts.join(sorts, ["attr", "is_uri"])
    if n >= 0:
        best = Window.partitionBy("attr").orderBy(F.desc("n"), "uri", "label")
        counts = counts.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= n)
    return counts.select("attr", "uri", "label", "n")


def search_results(docs: DataFrame, fields: DataFrame, scores: DataFrame | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Nested results: labels, types, points (shapes suppress the plain point), attributes with object labels, score."""
    kept = fields if not exclude else fields.filter(~F.col("attr").isin(exclude))
    value = F.struct(F.coalesce("pos", F.lit(0)).alias("pos"), "value", "obj_uri", "lang", "kind")
    lists = kept.groupBy("uid", "attr").agg(F.sort_array(F.collect_list(value)).alias("v")).groupBy("uid").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("attr", "v")))).alias("attributes"))
    shape = F.exists("points", lambda p: p["kind"] != "point")
    out = docs.join(lists, "uid", "left").withColumn("points", F.when(shape, F.filter("points", lambda p: p["kind"] != "point")).otherwise(F.col("points")))
    return out if scores is None else out.join(scores, "uid")


def deletions(word: Column, most: int) -> Column:
    """The word and what is left of it without any 1 to `most` of its letters."""
    out = F.array(word)
    for _ in range(most):
        shorter = F.transform(out, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w)))))
        out = F.array_distinct(F.concat(out, F.flatten(F.filter(shorter, lambda x: F.size(x) > 0))))
    return out


def suggest(terms: DataFrame, vocabulary: DataFrame, distance: int = 2, longest: int = 40) -> DataFrame:
    """(term, suggestion, freq, edits) for terms (term) of 1 to `longest` letters that the vocabulary (term, freq) lacks: words
    within `distance` edits. Two words that near are equal after some deletions in either, so they meet in a join on those."""
    unknown = terms.select("term").distinct().join(vocabulary.select("term"), "term", "left_anti").filter(F.length("term").between(1, longest))
    left = unknown.select("term", F.explode(deletions(F.col("term"), distance)).alias("key"))
    words = vocabulary.select(F.col("term").alias("suggestion"), "freq").filter(F.length("suggestion").between(1, longest + distance))
    right = words.select("suggestion", "freq", F.explode(deletions(F.col("suggestion"), distance)).alias("key"))
    near = left.join(right, "key").select("term", "suggestion", "freq").distinct()
    return near.withColumn("edits", F.levenshtein("term", "suggestion", distance)).filter("edits >= 0")


def collate(suggestions: DataFrame) -> DataFrame:
    """The best word for each term."""
    return suggestions.groupBy("term").agg(F.min(F.struct("edits", -F.col("freq"), "suggestion"))["suggestion"].alias("suggestion"))
