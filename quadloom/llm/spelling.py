"""Spelling variants of the words of a corpus: PartEnum signatures of letter multisets, equi-joined and verified.

A word is the set of (letter, how often so far) pairs, a binary vector. A replaced letter changes two places of it, a letter more
or less one. Letters are partitioned, and as many parts as places may change are left out in every choice: the signatures of a word
are its letters in two of four parts (six choices, for words of its length) and in two of three (three choices, for words a letter
longer or shorter). They are sharpened by what else an edit leaves alone: with m the shorter length of two near words, the first
m // 2 characters or the last ones are alike, so each signature is made with either end. Near words share one of them, others
seldom do, and pairs that share one are verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.shared import forget, stored

#: Letters by falling frequency in European languages, dealt to the parts in turn, so that each part holds common ones.
_COMMON = "enisratdhulcgmobpwfkvzyjxq"
#: What a signature is for: words of the same length, and the shorter and the longer word of a pair that differs in length.
SAME, SHORTER, LONGER = 0, 1, 2


def partition(parts: int) -> dict[str, int]:
    return {c: i % parts for i, c in enumerate(_COMMON)}


#: For each number of places that differ: number of parts, the part of a letter, the choices that leave so many parts out.
_SCHEMES = {errors: (parts, partition(parts), list(combinations(range(parts), parts - errors))) for errors, parts in ((2, 4), (1, 3))}


def letters(word: str, errors: int) -> list[str]:
    """The letter multisets of a word by part, for each choice. Letters without a place in the list go by their code point."""
    parts, part, choices = _SCHEMES[errors]
    held = [""] * parts
    for c in sorted(word):
        held[part.get(c, ord(c) % parts)] += c
    return ["|".join([f"{p}{held[p]}" for p in choice]) for choice in choices]


def signatures(word: str) -> list[tuple[int, int]]:
    """(64-bit signature, what it is for); words one edit apart share one, of the same length or of a shorter and a longer."""
    out, two, one = [], letters(word, 2), letters(word, 1)
    for kind, shorter, held in ((SAME, len(word), two), (SHORTER, len(word), one), (LONGER, len(word) - 1, one)):
        half = shorter // 2
        for side in (f"{kind == SAME}{shorter}<{word[:half]}", f"{kind == SAME}{shorter}>{word[-half:]}"):
            out += [(xxhash.xxh64_intdigest(f"{side}|{x}"), kind) for x in held]
    return [(x - (1 << 64) if x >> 63 else x, kind) for x, kind in out]


def _counted(least: int, every: int):
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[str] = Counter()
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                found = Counter(runs.findall(text.encode().lower().decode())) if text else {}
                salt = zlib.crc32(f"{'null' if doc is None else doc}:".encode())
                for run, n in found.items():
                    h = zlib.crc32(run.encode(), salt)
                    if every and h % every == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least:
                            continue
                    total[run] += n
            yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    return count


def word_counts(docs: DataFrame, least: int = 7, every: int = 31, min_count: int = 2) -> DataFrame:
    """(word, n): maximal runs of Latin letters in whole texts, A-Z lower-cased, of at least `least` characters and min_count
    places. Where `every` divides the CRC-32 of "<doc_id>:<run>", the character at that number modulo the length is left out
    first (0: never). A null doc_id reads "null". Counts are summed by batch before the shuffle."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_counted(least, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), 5000):
            part = batch.slice(start, 5000)
            found = [signatures(w) for w in part.column("word").to_pylist()]
            at = pa.array([i for i, x in enumerate(found) for _ in x], pa.int32())
            keys, kinds = (pa.array([y[k] for x in found for y in x], t) for k, t in ((0, pa.int64()), (1, pa.int8())))
            yield pa.RecordBatch.from_arrays([keys, kinds, part.column("word").take(at)], names=["key", "kind", "word"])


def near_words(words: DataFrame) -> DataFrame:
    """(a, b): all pairs of distinct words that differ by one inserted, deleted or replaced character. A pair may share several
    signatures and is returned once, in either order. Words of under three characters may be near without a common end."""
    signed = words.select("word").mapInArrow(_signed, "key long, kind byte, word string")
    a, b = signed.toDF("key", "kind", "a"), signed.toDF("key", "kind_b", "b")
    roles = (F.col("kind") == SAME) & (F.col("kind_b") == SAME) & (F.col("a") < F.col("b")) | (F.col("kind") == SHORTER) & (F.col("kind_b") == LONGER)
    return a.join(b, "key").filter(roles & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): forms followed to the last. A form is counted ten times as often as its word, so there is
    no cycle and a chain of 63-bit counts has 19 steps at most; each round doubles the steps."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not after.filter("moved").isEmpty()
        forget(now)
        now = after
        if not moved:
            return now.select("word", "root")


def group_spellings(docs: DataFrame, least: int = 7, every: int = 31, min_count: int = 2, times: int = 10) -> DataFrame:
    """One row per word of word_counts: n, n_near (words one edit away), form (the near word of largest n, the smaller of ties,
    if that n is `times` the word's n or more, else null), form_n (its n), root (forms followed to the last; the word itself if
    it has no form).

    Null and empty texts have no words; repeated rows count again; extra columns change nothing; an empty table gives no rows.
    """
    if least < 3:
        raise ValueError("words of under three characters may be near without a common end")
    words = stored(word_counts(docs, least, every, min_count), "words")
    pairs = stored(near_words(words), "near")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    other = words.select(F.col("word").alias("other"), F.col("n").alias("m"))
    best = F.min_by(F.struct("other", "m"), F.struct(-F.col("m"), F.col("other")))
    near = both.join(other, "other").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    out = words.join(near, "word", "left")
    told = F.col("best.m") >= times * F.col("n")
    out = stored(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(told, F.col("best.other")).alias("form"), F.when(told, F.col("best.m")).alias("form_n")), "forms")
    forget(words, pairs)
    return out.join(roots(out.filter("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))
