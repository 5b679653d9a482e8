"""Conjunctive graph patterns over quads. Patterns about one subject are one pass over its values; only different subjects are
joined, on the variables that they share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.operators.access import accessible_datasets
from quadloom.operators.mapping import described_records, quads_to_records

Pattern = tuple[str, str, str]


def _one(quads: DataFrame, pattern: Pattern, per_graph: bool) -> DataFrame:
    """Bindings of one (s, p, o) pattern: ?name is a variable, anything else a constant pushed into the filter."""
    rows, names = quads, []
    for column, part in zip(("s", "p", "o"), pattern):
        if not part.startswith("?"):
            rows = rows.filter(F.col(column) == part)
        elif part[1:] in dict(names):
            rows = rows.filter(F.col(column) == F.col(dict(names)[part[1:]]))
        else:
            names.append((part[1:], column))
    columns = [F.col(c).alias(n) for n, c in names] + ([F.col("g").alias("_g")] if per_graph else [])
    return rows.select(*columns).distinct()


def _star(quads: DataFrame, patterns: list[Pattern], per_graph: bool) -> DataFrame:
    """Bindings of patterns about one subject variable with constant predicates: one conditional sum by subject. Several values of
    a record are combined within its row, so the wanted values of one record must fit a row."""
    subject = patterns[0][0][1:]
    wanted: list[tuple[str, Column]] = []
    for _, p, o in patterns:
        here = F.col("p") == p
        if o == f"?{subject}":
            here &= F.col("o") == F.col("s")
        elif not o.startswith("?"):
            here &= F.col("o") == o
        wanted.append((o, here))
    rows = quads.filter(F.col("p").isin([p for _, p, _ in patterns])).filter(reduce(Column.__or__, [here for _, here in wanted]))
    sets = [F.collect_set(F.when(here, F.col("o"))).alias(f"_{k}") for k, (_, here) in enumerate(wanted)]
    held = rows.groupBy("s", *(["g"] if per_graph else [])).agg(*sets)
    free: dict[str, Column] = {}
    for k, (o, _) in enumerate(wanted):
        held = held.filter(F.size(f"_{k}") > 0)
        if o.startswith("?") and o != f"?{subject}":
            name = o[1:]  # a variable that stands in two patterns has the values that both have
            free[name] = F.array_intersect(free[name], F.col(f"_{k}")) if name in free else F.col(f"_{k}")
    columns = [F.col("s").alias(subject)] + ([F.col("g").alias("_g")] if per_graph else [])
    out = held.select(*columns, *[values.alias(name) for name, values in free.items()])
    for name in free:
        out = out.withColumn(name, F.explode(name))
    return out


def _blocks(patterns: list[Pattern]) -> list[list[Pattern]]:
    """Patterns that one pass answers, together; in the order of their first ones."""
    out: dict[object, list[Pattern]] = {}
    for k, pattern in enumerate(patterns):
        star = pattern[0].startswith("?") and not pattern[1].startswith("?")
        out.setdefault(pattern[0] if star else k, []).append(pattern)
    return list(out.values())


def match(quads: DataFrame, patterns: list[Pattern], graphs: list[str] | None = None, per_graph: bool = False) -> DataFrame:
    """Bindings of all patterns, each once; per_graph wants every triple of a solution from one graph. Patterns that share no
    variable with the others are refused, as they would multiply."""
    rows = quads if graphs is None else quads.filter(F.col("g").isin(graphs))
    out, rest = None, _blocks(patterns)
    while rest:
        names = [{x[1:] for p in block for x in p if x.startswith("?")} for block in rest]
        at = 0 if out is None else next((k for k, found in enumerate(names) if found & set(out.columns)), None)
        if at is None:
            raise ValueError("patterns must share a variable")
        block = rest.pop(at)
        found = _one(rows, block[0], per_graph) if len(block) == 1 else _star(rows, block, per_graph)
        out = found if out is None else out.join(found, [c for c in found.columns if c in out.columns])
    return out


def optional(bindings: DataFrame, more: DataFrame) -> DataFrame:
    return bindings.join(more, [c for c in more.columns if c in bindings.columns], "left")


def union_patterns(*bindings: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), bindings)


def filter_in(bindings: DataFrame, variable: str, values: list[str]) -> DataFrame:
    return bindings.filter(F.col(variable).isin(values))


def order_limit(bindings: DataFrame, by: list[str], limit: int) -> DataFrame:
    return bindings.orderBy(*by).limit(limit)


def count_distinct(bindings: DataFrame, variable: str) -> DataFrame:
    return bindings.agg(F.count_distinct(variable).alias("n"))


def bindings_to_records(bindings: DataFrame) -> DataFrame:
    """Rows with s, p, o, g, otype, olang (and rei_s, rei_p, rei_o) as nested records; statements meet their triple by the
    md5 of its three parts."""
    kind = F.when(F.col("otype") == "uri", "uri").otherwise("literal")
    columns = ["g", "s", "p", "o", kind.alias("o_kind"), F.when(F.col("otype") != "uri", F.col("otype")).alias("o_type"), F.col("olang").alias("o_lang"), F.lit(0).cast("long").alias("pos")]
    if "rei_p" not in bindings.columns:
        return quads_to_records(bindings.select(*columns).distinct())
    # a row gives its triple and, if it is about another one, that one's statement; both meet under the statement's name
    name = F.md5(F.concat("s", "p", "o"))
    pair = F.when(F.col("rei_p").isNotNull(), F.struct("rei_p", "rei_o"))
    rows = bindings.select(F.struct(*columns).alias("quad"), name.alias("name"), "rei_s", pair.alias("pair"), F.coalesce(name, F.concat(F.lit("-"), F.xxhash64("g", "s", "p", "o").cast("string"))).alias("key"))
    about = F.col("rei_s") == F.col("name")
    own = F.struct("key", "quad", F.when(about, F.col("pair")).alias("pair"))
    other = F.when(F.col("pair").isNotNull() & F.col("rei_s").isNotNull() & ~F.coalesce(about, F.lit(False)), F.struct(F.col("rei_s").alias("key"), F.when(F.lit(False), F.col("quad")).alias("quad"), "pair"))
    met = rows.select(F.inline(F.filter(F.array(own, other), lambda x: x.isNotNull()))).groupBy("key").agg(F.collect_set("quad").alias("quads"), F.collect_set("pair").alias("pairs"))
    listed = F.transform(F.array_sort(F.array_distinct("pairs.rei_p")), lambda p: F.struct(p.alias("rei_p"), F.sort_array(F.transform(F.filter("pairs", lambda x: (x["rei_p"] == p) & x["rei_o"].isNotNull()), lambda x: x["rei_o"])).alias("v")))
    return described_records(met.select(F.when(F.size("pairs") > 0, F.map_from_entries(listed)).alias("reify"), F.inline("quads")))


def check_graph_access(graphs: DataFrame, access: DataFrame, memberships: DataFrame, user: str) -> DataFrame:
    """(graph, allowed): the dataset behind each graph named in a query must be readable."""
    dataset = F.regexp_replace("graph", "(reification|revisions)/$", "")
    readable = accessible_datasets(access, memberships, user).withColumn("_yes", F.lit(True))
    rows = graphs.withColumn("dataset", dataset).join(readable, "dataset", "left")
    return rows.select("graph", F.coalesce("_yes", F.lit(False)).alias("allowed"))
