"""Concepts in texts: the longest non-overlapping labels, case-folded, by an automaton over words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions.stemming import stem
from quadloom.functions.uris import tokens
from quadloom.operators.lineage import cut

#: Labels of at most so many bytes become an automaton that every executor holds; more are met by a shuffle.
BROADCAST_BYTES = 16 << 20


class WordAutomaton:
    """A trie of labels over word numbers, with failure links: one step a word finds every label that ends there."""

    def __init__(self, labels: Iterable[tuple[list[str], str]]):
        self.number: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.fail, self.depth, self.concept = [0], [0], [None]
        for words, concept in labels:
            node = 0
            for w in words:
                k = self.number.setdefault(w, len(self.number))
                if k not in self.next[node]:
                    self.next[node][k] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    self.depth.append(self.depth[node] + 1)
                    self.concept.append(None)
                node = self.next[node][k]
            self.concept[node] = concept
        self.ends = [0] * len(self.next)  # the longest label that ends at a node's words: the node or one behind its links
        level = [0]
        while level:
            level = [self._link(node, k, child) for node in level for k, child in self.next[node].items()]

    def _link(self, node: int, k: int, child: int) -> int:
        if node:
            at = self.fail[node]
            while at and k not in self.next[at]:
                at = self.fail[at]
            self.fail[child] = self.next[at].get(k, 0)
        self.ends[child] = child if self.concept[child] is not None else self.ends[self.fail[child]]
        return child

    def spans(self, places: list[int], numbers: list[int]) -> list[tuple[int, int, str]]:
        """(first, last, concept): longest first, then earliest, of the labels in a text whose label words stand at `places`."""
        found, node, before = [], 0, -2
        for place, k in zip(places, numbers):
            if place != before + 1:
                node = 0
            before = place
            while node and k not in self.next[node]:
                node = self.fail[node]
            node = self.next[node].get(k, 0)
            hit = self.ends[node]
            while hit:
                found.append((-self.depth[hit], place + 1 - self.depth[hit], self.concept[hit]))
                hit = self.ends[self.fail[hit]]
        if len(found) > 1:
            found.sort()
        taken: set[int] = set()
        out = []
        for n, first, concept in found:
            # what is taken already is at least as long, so one of its ends lies inside whatever overlaps it
            if first not in taken and first - n - 1 not in taken:
                taken.update(range(first, first - n))
                out.append((first, first - n, concept))
        return out


def _tag(shared):
    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        known = pa.array(automaton.number, pa.string())
        for batch in batches:
            words = batch.column("w")
            starts = words.offsets.to_numpy()
            numbers = pc.index_in(words.values, known).fill_null(-1).to_numpy()
            where = np.flatnonzero(numbers >= 0)
            where = where[(where >= starts[0]) & (where < starts[-1])]
            rows = np.searchsorted(starts, where, "right") - 1
            cuts = np.flatnonzero(np.diff(rows, prepend=-1, append=len(words)))
            owner, concepts, firsts, lasts = [], [], [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                row = int(rows[a])
                for first, last, concept in automaton.spans((where[a:b] - starts[row]).tolist(), numbers[where[a:b]].tolist()):
                    owner.append(row)
                    concepts.append(concept)
                    firsts.append(first)
                    lasts.append(last)
            ids = batch.column("doc_id").take(pa.array(owner, pa.int64()))
            columns = [ids, pa.array(concepts, pa.string()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "concept", "first", "last"])

    return tag


def tag_concepts(documents: DataFrame, labels: DataFrame, stemming: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, concept, first, last): word spans [first, last) of documents (doc_id, text) that equal a label of labels
    (concept, label), of any number of words. Longer matches win, then earlier ones; a place is in one match at most; of
    concepts with equal labels the smallest is named. With `stemming`, words that share an English stem are equal.

    Labels whose plain size is at most `broadcast_bytes` become one automaton, and texts are tagged where they are, without a
    shuffle. More labels are joined: each place of a text is one row of its next words, met with the first words of the labels
    and then with the labels, and lengths are taken from the longest down. A null text has no words; labels without words or
    concept are ignored; an id stands for one document (rows that repeat one are tagged each by itself, or merged in a join).
    """

    def read(text: str) -> Column:
        found = tokens(F.col(text))
        return F.transform(found, stem) if stemming else found

    names = labels.select(F.col("concept").cast("string").alias("concept"), read("label").alias("w")).filter((F.size("w") > 0) & F.col("concept").isNotNull())
    names = names.groupBy(F.array_join("w", " ").alias("gram"), F.get("w", F.lit(0)).alias("head"), F.size("w").alias("n")).agg(F.min("concept").alias("concept"))
    bytes_held = names.agg(F.sum(F.octet_length("gram") + F.octet_length("concept") + 50)).first()[0] or 0
    texts = documents.select("doc_id", F.coalesce(read("text"), F.array().cast("array<string>")).alias("w"))
    if bytes_held <= broadcast_bytes:
        automaton = WordAutomaton((r.gram.split(" "), r.concept) for r in names.select("gram", "concept").collect())
        kind = documents.schema["doc_id"].dataType.simpleString()
        return texts.mapInArrow(_tag(documents.sparkSession.sparkContext.broadcast(automaton)), f"doc_id {kind}, concept string, first int, last int")
    lengths = sorted((r.n for r in names.select("n").distinct().collect()), reverse=True)  # a row for each length
    longest, kind = lengths[0], "merge"
    heads = names.select("head", "n").distinct().hint(kind)
    following = F.transform("w", lambda _, i: F.slice("w", i + 1, longest))
    places = texts.select("doc_id", F.posexplode(following).alias("first", "next"))
    grams = places.withColumn("head", F.get("next", F.lit(0))).join(heads, "head").filter(F.col("n") <= F.size("next"))
    grams = grams.select("doc_id", "first", "n", F.array_join(F.slice("next", F.lit(1), F.col("n")), " ").alias("gram"))
    hits, taken = cut(grams.join(names.select("concept", "gram").hint(kind), "gram").select("doc_id", "first", "n", "concept")), None
    for n in lengths:
        mine = hits.filter(F.col("n") == n)
        span = F.explode(F.sequence("first", F.col("first") + n - 1)).alias("place")
        if taken is not None:
            covered = taken.select("doc_id", F.explode(F.sequence("first", F.col("last") - 1)).alias("place"))
            under = mine.select("doc_id", "first", span).join(covered, ["doc_id", "place"], "left_semi").select("doc_id", "first").distinct()
            mine = mine.join(under, ["doc_id", "first"], "left_anti")
        chosen = mine.select("doc_id", "concept", "first", (F.col("first") + n).alias("last"))
        if n > 1:
            chosen = cut(_leftmost(chosen, n))  # read again by every shorter length
        taken = chosen if taken is None else taken.union(chosen)
    return hits.select("doc_id", "concept", "first", F.col("n").alias("last")) if taken is None else taken


def _leftmost(spans: DataFrame, n: int) -> DataFrame:
    """Spans of one length without those that an earlier chosen span of their document overlaps: one pass over sorted places."""
    empty = F.array().cast("array<struct<first:int,concept:string>>")
    start = F.struct(F.lit(-n).alias("at"), empty.alias("kept"))

    def step(state, x):
        kept = F.when(x["first"] >= state["at"] + n, F.concat(state["kept"], F.array(x))).otherwise(state["kept"])
        return F.struct(F.when(x["first"] >= state["at"] + n, x["first"]).otherwise(state["at"]).alias("at"), kept.alias("kept"))

    lists = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "concept"))).alias("l"))
    return lists.select("doc_id", F.inline(F.aggregate("l", start, step)["kept"])).select("doc_id", "concept", "first", (F.col("first") + n).alias("last"))
