"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

Texts are lower-cased and cut into runs of letters and digits. Rolling hashes of `min_tile` words seed matches between a
document and a benchmark item; seeds on one diagonal join into maximal matches, which are marked longest first, never
twice over the same word of either side. The share of an item's words under tiles is its coverage, whatever the order of
the tiles, so reordered passages count as much as straight ones.

The benchmark is a stated query set held against all documents: it is taken in blocks of at most about `block_bytes`, each
broadcast to one pass over the documents, so nothing is shuffled but the hits and no side has to fit at once. A block is
sized from a sum over the table before anything is collected; with several blocks, one is alive at a time.

Null or wordless texts and items match nothing; items shorter than `min_tile` words cannot be told from chance and match
nothing; rows are judged one by one, so repeated rows repeat their hits; null ids are kept as null; ties between tiles go
to the earlier place in the item, then in the document. Empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.hashing import prefix_sums, window_hashes, word_hashes
from quadloom.llm.shared import small_side, stored

_ALNUM = bytes(b if b < 128 and chr(b).isalnum() else 32 for b in range(256))
_SIGNS = re.compile(r"[\W_]+")


def plain_words(text: str | None) -> np.ndarray:
    """Hashes of the runs of letters and digits of the lower-cased text, in order."""
    if not text:
        return np.zeros(0, np.uint64)
    low = text.lower()
    raw = low.encode().translate(_ALNUM) if low.isascii() else _SIGNS.sub(" ", low).encode()
    return word_hashes(np.frombuffer(raw, np.uint8))


class Side:
    """One of two texts that are tiled: its windows of any length that hold no marked word."""

    def __init__(self, words: np.ndarray):
        self.sums, self.marks = prefix_sums(words), np.zeros(len(words) + 1, np.int64)

    def free(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, places) of the free windows of `length` words, by place."""
        places = np.flatnonzero(self.marks[length:] == self.marks[: len(self.marks) - length])
        return window_hashes(self.sums, length)[places], places

    def mark(self, first: int, length: int) -> None:
        self.marks[first + 1 : first + length + 1] += np.arange(1, length + 1)
        self.marks[first + length + 1 :] += length


def tiles(item: np.ndarray, doc: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two texts given as word hashes: (place in item, place in document, length), longest tile first, ties
    by place in the item, then in the document. The longest free match is found by bisecting the length of the windows that
    both sides hold, so repeated words cost no list of all their pairs."""
    a, b, out = Side(item), Side(doc), []
    longest = min(len(item), len(doc))
    while longest >= min_tile:
        low, high = min_tile - 1, longest
        while low < high:
            length = (low + high + 1) // 2
            if np.isin(a.free(length)[0], b.free(length)[0]).any():
                low = length
            else:
                high = length - 1
        if low < min_tile:
            break
        mine, places = a.free(low)
        theirs, others = b.free(low)
        shared = np.isin(mine, theirs)
        order = np.argsort(theirs, kind="stable")
        theirs, others, reached, done = theirs[order], others[order], 0, {}
        for gram, i in zip(mine[shared].tolist(), places[shared].tolist()):
            if i < reached:
                continue
            at = done.get(gram)
            if at is None:
                at = done[gram] = int(np.searchsorted(theirs, np.uint64(gram)))
            while at < len(theirs) and int(theirs[at]) == gram:
                j = int(others[at])
                at += 1
                if b.marks[j + low] == b.marks[j]:
                    out.append((i, j, low))
                    a.mark(i, low)
                    b.mark(j, low)
                    reached = i + low
                    break
            done[gram] = at
        longest = low - 1
    return out


class Seeds:
    """Seed index of a block of benchmark items: sorted hashes and, for each, its (item, place)."""

    def __init__(self, items: list[tuple[int | None, str | None]], min_tile: int):
        self.min_tile, self.ids, self.words = min_tile, [i for i, _ in items], [plain_words(text) for _, text in items]
        found = [window_hashes(prefix_sums(w), min_tile) for w in self.words]
        grams = np.concatenate([*found, np.zeros(0, np.uint64)])
        order = np.argsort(grams, kind="stable")
        sizes = [len(f) for f in found]
        self.grams = grams[order]
        self.owner = np.repeat(np.arange(len(found)), sizes)[order]
        self.place = np.concatenate([*map(np.arange, sizes), np.zeros(0, np.int64)])[order]

    def matches(self, doc: np.ndarray, min_coverage: float) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Items (by number) whose coverage by tiles of the document reaches min_coverage. Every seed of an item counts once,
        however often the document holds it; only items with enough words under seeds are tiled."""
        grams = np.unique(window_hashes(prefix_sums(doc), self.min_tile))
        if not len(self.grams) or not len(grams):
            return
        low, high = np.searchsorted(self.grams, grams, "left"), np.searchsorted(self.grams, grams, "right")
        counts = high - low
        if not counts.any():
            return
        index = np.repeat(low, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        owner, place = self.owner[index], self.place[index]
        order = np.argsort(owner, kind="stable")
        owner, place = owner[order], place[order]
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        for k, places in zip(owner[first].tolist(), np.split(place, first[1:])):
            size = len(self.words[k])
            reach = np.zeros(size + 1, bool)
            for step in range(self.min_tile):
                reach[places + step] = True
            if reach.sum() < min_coverage * size:
                continue
            laid = tiles(self.words[k], doc, self.min_tile)
            if sum(n for _, _, n in laid) >= min_coverage * size:
                yield k, laid


def _search(block, min_coverage: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, min_tile = block.value
        seeds = Seeds(items, min_tile)
        tile = pa.struct([("item_first", pa.int32()), ("doc_first", pa.int32()), ("length", pa.int32())])
        schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int32()), ("matched_words", pa.int32()), ("tiles", pa.list_(tile))])
        for batch in batches:
            rows = []
            for doc, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_key", "text"))):
                for k, laid in seeds.matches(plain_words(text), min_coverage):
                    spans = [{"item_first": i, "doc_first": j, "length": n} for i, j, n in sorted(laid)]
                    rows.append({"doc_id": doc, "text_key": key, "item_id": seeds.ids[k], "item_words": len(seeds.words[k]), "matched_words": sum(n for _, _, n in laid), "tiles": spans})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return search


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, min_tile: int = 5, min_coverage: float = 0.5, block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, text_key, item_id, item_words, matched_words, tiles) for every document row of docs (doc_id, text) and item of
    benchmark (item_id, text) whose coverage is at least min_coverage. text_key is xxhash64 of the text."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 100)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    out = None
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).collect() if size else []
        block = spark.sparkContext.broadcast(([(r.item_id, r.text) for r in rows], min_tile))
        found = docs.mapInArrow(_search(block, min_coverage), "doc_id long, text_key long, item_id long, item_words int, matched_words int, tiles array<struct<item_first:int,doc_first:int,length:int>>")
        if n > 1:  # one block at a time: its hits are written and the block is given up before the next is read
            found = stored(found, "hits")
            block.destroy()
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows that hold a benchmark item; rows are matched by id and text, so null and repeated ids are safe."""
    hits = contaminated_pairs(docs, benchmark, **options).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    hits = small_side(stored(hits, "contaminated"))
    return docs.join(hits, docs["doc_id"].cast("long").eqNullSafe(hits["_id"]) & (F.xxhash64(docs["text"].cast("string")) == hits["_key"]), "left_anti")
