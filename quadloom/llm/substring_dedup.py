"""Duplicate word spans across a corpus by relative Lempel-Ziv parsing.

The reference of the parse is the corpus itself, cut into *blocks*: a block is a maximal run of `window`-word windows
whose smallest `seed`-word hash is the same seed occurrence, so equal text gives equal blocks wherever it stands and a
block's windows can only be repeated by a block with the same seed. Every block is indexed by its seed.

Parsing a document block by block then has three outcomes. A seed found once is a literal. A seed whose blocks are all
alike, and more than one, makes the whole block a factor. A seed with differing blocks is a factor boundary: there the
block's windows are compared one by one with those of the other blocks of that seed. Adjacent copied windows are one
long factor, and the words they cover are the duplicate spans. Only about one row per dozen words is shuffled, and hot
passages meet in map-side sums, never in one group.

Nulls and odd input: a null text has no words; a text with fewer words than a window has no window and keeps all; equal
rows (same id and text) each count as an occurrence and get the same result; a null id is a value like any other; extra
columns are ignored. Hashes have 64 bits for blocks (compared only within a seed) and 128 for single windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.hashing import hashed_rows, prefix_sums, signed, span_hashes, window_hashes
from quadloom.llm.shared import forget, stored

BLOCKS = "doc_id long, text_key long, seed long, block long, first int, windows int"


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of anything but space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.encode().split() if text else []


def _blocks(window: int, seed: int):
    span = window - seed + 1

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[np.ndarray]] = [[] for _ in range(6)]
            ids, keys = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist()
            rows: list[int] = []
            for k, words in enumerate(hashed_rows(batch.column("text"))):
                if len(words) < window:
                    continue
                sums = prefix_sums(words)
                seeds = window_hashes(sums, seed)
                at = np.lib.stride_tricks.sliding_window_view(seeds, span).argmin(axis=1)
                at += np.arange(len(at))
                first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
                last = np.concatenate((first[1:], [len(at)]))
                found = (signed(seeds[at[first]]), signed(span_hashes(sums, first, last + window - 1)), first.astype(np.int32), (last - first).astype(np.int32))
                for col, x in zip(cols[2:], found):
                    col.append(x)
                rows += [k] * len(first)
            if rows:
                arrays = [pa.array([ids[k] for k in rows], pa.int64()), pa.array([keys[k] for k in rows], pa.int64())]
                arrays += [pa.array(np.concatenate(x)) for x in cols[2:]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", "seed", "block", "first", "windows"])

    return parse


def _boundary_windows(window: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, rows = batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), []
            at, left, right = [], [], []
            both = zip(*(hashed_rows(batch.column("text"), family=k) for k in (0, 1)), batch.column("factors").to_pylist())
            for k, (words, others, blocks) in enumerate(both):
                starts = np.concatenate([np.arange(b["first"], b["first"] + b["windows"]) for b in blocks if b["differs"]])
                for hashes, out in ((words, left), (others, right)):
                    out.append(signed(span_hashes(prefix_sums(hashes), starts, starts + window)))
                at.append(starts.astype(np.int32))
                rows += [k] * len(starts)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[k] for k in rows], pa.int64()), pa.array([keys[k] for k in rows], pa.int64()), pa.array(np.concatenate(at)), pa.array(np.concatenate(left)), pa.array(np.concatenate(right))],
                    names=["doc_id", "text_key", "first", "left", "right"],
                )

    return compare


def _cut(window: int, with_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, spans, texts = [], [], [], [], []
            lists = zip(batch.column("text").to_pylist(), batch.column("factors").to_pylist(), batch.column("starts").to_pylist())
            for text, blocks, starts in lists:
                words = words_of(text)
                depth = np.zeros(len(words) + 1, np.int64)
                for b in blocks or ():
                    if not b["differs"]:
                        depth[b["first"]] += 1
                        depth[b["first"] + b["windows"] + window - 1] -= 1
                if starts:
                    np.add.at(depth, np.array(starts), 1)
                    np.add.at(depth, np.array(starts) + window, -1)
                covered = np.cumsum(depth)[:-1] > 0
                edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
                kept = b" ".join([w for w, gone in zip(words, covered.tolist()) if not gone]) if len(edges) else b" ".join(words)
                n_words.append(len(words))
                n_removed.append(int(covered.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                spans.append([{"first": int(a), "last": int(b)} for a, b in edges.reshape(-1, 2)])
                texts.append(kept.decode() if with_text else None)
            span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, span), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"],
            )

    return cut


def remove_repeated_spans(docs: DataFrame, window: int = 35, seed: int = 11, with_text: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): n_words, n_removed, kept_sha256, the removed word spans [first, last), and
    kept_text if asked for. A word goes if any window of `window` words over it also starts elsewhere in the corpus."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    blocks = stored(docs.mapInArrow(_blocks(window, seed), BLOCKS), "blocks")
    index = blocks.groupBy("seed").agg(F.count("*").alias("n"), F.min("block").alias("low"), F.max("block").alias("high")).filter("n > 1")
    index = index.select("seed", (F.col("low") != F.col("high")).alias("differs"))
    factors = blocks.join(index, "seed").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "windows", "differs")).alias("factors"))
    factors = stored(factors, "factors")
    forget(blocks)

    def on_row(a: DataFrame, b: DataFrame):
        return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])

    differing = factors.filter(F.exists("factors", lambda x: x["differs"]))
    open_docs = docs.join(differing, on_row(docs, differing)).select(docs["doc_id"], docs["text_key"], "text", "factors")
    windows = stored(open_docs.mapInArrow(_boundary_windows(window), "doc_id long, text_key long, first int, left long, right long"), "windows")
    # written, so that the join reads plain shuffles of both sides and Spark can split a hot window
    again = stored(windows.groupBy("left", "right").count().filter("count > 1").drop("count"), "repeated-windows")
    starts = windows.join(again, ["left", "right"]).groupBy("doc_id", "text_key").agg(F.collect_set("first").alias("starts"))
    found = factors.alias("f").join(starts.alias("s"), F.col("f.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("f.text_key") == F.col("s.text_key")), "left")
    found = stored(found.select("f.doc_id", "f.text_key", "factors", "starts"), "spans")
    forget(factors, windows, again)
    parsed = docs.join(found, on_row(docs, found), "left").select(docs["doc_id"], "text", "factors", "starts")
    return parsed.mapInArrow(_cut(window, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:int,last:int>>, kept_text string")
