"""Cross-tokenizer alignment: which tokens of a byte-level BPE (A) cover the same bytes as which of a piece BPE (B).

Both libraries say where a token lies: tokenizers as character offsets, sentencepiece as the spans of its proto. These are the
coarse cuts. Tokens that share a character (its bytes split over several entries, or byte fallback) have no span of their own;
they are refined by the bytes that they decode to. Where tokens of both end at one byte, a group ends.

A text is cut before each single space between two characters that are not white space, and between a letter and a sign behind
it. No token of either side crosses such a place: the pattern of A starts anew there, and B has no piece with a space mark behind
another character, or with that sign behind a letter (seen when the model loads). So the alignment of a text is that of its
chunks in order, and a Python worker does not encode again what is among the first words that it saw.

How often a pair of ids is linked in the corpus comes from the stored rows by plain sums. The commonest pairs, max_pairs at most,
go to all tasks as sorted arrays; what they leave is joined by a shuffle.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.shared import forget, stored

MARK = "▁"
#: A single space between two characters that are not white space.
_CUT = re.compile(r" (?<=\S )(?=\S)")
_BYTE = re.compile("<0x([0-9A-F]{2})>")
_LETTER, _SIGN = "[^\\W\\d_]", "[^\\w\\s]"
#: Chunks up to this length are kept.
SHARED = 48


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself where it prints, else counted on from 256."""
    prints = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


def refined_ends(starts: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Byte ends of tokens in a row, from their coarse spans: where a span is as long as what the token decodes to it holds, else
    the token is part of a character or a byte of a fallback, and ends its decoded bytes behind the token before."""
    return np.where(ends - starts == lengths, ends, np.cumsum(lengths))


#: An alignment: number of A tokens, of B tokens, the groups as text, the linked pairs (packed, one for each link). None: the
#: tokens of a side do not give the bytes back.
Chunk = tuple[int, int, str, list[int]] | None


def joined(parts: list[Chunk]) -> Chunk:
    """The alignment of neighbouring chunks; None if one of them has none."""
    if len(parts) == 1 or None in parts:
        return parts[0] if len(parts) == 1 else None
    return sum(c[0] for c in parts), sum(c[1] for c in parts), ";".join([c[2] for c in parts]), [x for c in parts for x in c[3]]


class Known:
    """Alignments of words by number, in flat arrays. `sizes` has A tokens, B tokens, links (-1: no alignment) and the place of
    the first link in `pairs`."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes, self.pairs, self.n_pairs, self.chars = np.zeros((1024, 4), np.int64), np.zeros(4096, np.int64), 0, 0

    def add(self, words: list[str], found: list[Chunk]) -> None:
        first = len(self.groups)
        self.number.update(zip(words, range(first, first + len(words))))
        self.groups += ["" if c is None else c[2] for c in found]
        links = np.array([-1 if c is None else len(c[3]) for c in found], np.int64)
        pairs = np.array([x for c in found if c is not None for x in c[3]], np.int64)
        while len(self.groups) > len(self.sizes):
            self.sizes = np.concatenate((self.sizes, np.zeros_like(self.sizes)))
        while self.n_pairs + len(pairs) > len(self.pairs):
            self.pairs = np.concatenate((self.pairs, np.zeros_like(self.pairs)))
        self.pairs[self.n_pairs : self.n_pairs + len(pairs)] = pairs
        counts = np.maximum(links, 0)
        tokens = [np.array([c[k] if c else 0 for c in found], np.int64) for k in (0, 1)]
        self.sizes[first : first + len(words)] = np.stack((*tokens, links, self.n_pairs + np.cumsum(counts) - counts), 1)
        self.n_pairs += len(pairs)

    def keep(self, most: int, new: list[str]) -> None:
        """Forget of the words added last those beyond the first `most`, or beyond 16 characters for each of so many."""
        held, at = len(self.groups) - len(new), 0
        while at < len(new) and held + at < most and self.chars + len(new[at]) <= 16 * most:
            self.chars += len(new[at])
            at += 1
        if at < len(new):
            for word in new[at:]:
                del self.number[word]
            self.n_pairs = int(self.sizes[held + at, 3])
            del self.groups[held + at :]


class Aligner:
    """Aligns the byte-level BPE of file_a (tokenizers) with the piece BPE of file_b (sentencepiece)."""

    def __init__(self, file_a: str, file_b: str, most: int = 450_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(file_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        place = byte_of_char()
        special = {t["id"] for t in json.loads(self.a.to_str())["added_tokens"]}
        self.bytes_a = {i: bytes(place[c] for c in entry) for entry, i in self.a.get_vocab(with_added_tokens=False).items() if i not in special}
        proto = sentencepiece_model_pb2.ModelProto.FromString(open(file_b, "rb").read())
        proto.normalizer_spec.add_dummy_prefix = False  # a chunk brings its own space
        self.b = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        entries = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in entries):
            raise ValueError("a piece of this model crosses a space, so chunks cannot be encoded one by one")
        self.bytes_b = [bytes([int(_BYTE.fullmatch(p)[1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(entries)]
        self.lengths_a, self.lengths_b = np.zeros(max(self.bytes_a) + 1, np.int64), np.array([len(x) for x in self.bytes_b], np.int64)
        for i, x in self.bytes_a.items():
            self.lengths_a[i] = len(x)
        plain = (p for i, p in enumerate(entries) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)))
        crossed = {sign for p in plain for sign in re.findall(f"(?<={_LETTER}){_SIGN}", p)}
        self._sign = re.compile(f"(?<={_LETTER})(?={_SIGN})" + (f"(?![{re.escape(''.join(sorted(crossed)))}])" if crossed else ""))
        self.most, self.known, self.chunks = most, Known(), {}

    def learn(self, words: list[str]) -> None:
        """Align a space and each of these words. Chunks of words with a sign in them are kept as long as there is room."""
        cut = [self._sign.split(f" {w}") for w in words]
        new = list(dict.fromkeys(c for parts in cut for c in parts if c not in self.chunks))
        gc.disable()  # many short-lived tuples and no cycles: looking for some costs a fifth of the time
        try:
            found = dict(zip(new, self._aligned(new)))
        finally:
            gc.enable()
        self.known.add(words, [joined([found[c] if c in found else self.chunks[c] for c in parts]) for parts in cut])
        if len(self.chunks) < self.most // 4:
            self.chunks.update((c, found[c]) for parts in cut if len(parts) > 1 for c in parts if len(c) <= SHARED and c in found)

    def _aligned(self, chunks: list[str]) -> Iterator[Chunk]:
        """Alignments of chunks, in portions that bound the memory of the libraries' answers."""
        for start in range(0, len(chunks), 2000):
            part = chunks[start : start + 2000]
            a, b = self.a.encode_batch(part, add_special_tokens=False), self.b.encode(part, return_type="proto", num_threads=1)
            tokens_a = [(e.ids, e.offsets) for e in a]
            tokens_b = [([x.id for x in p], [(x.begin, x.end) for x in p]) for p in (x.pieces for x in b)]
            yield from self._grouped(part, tokens_a, tokens_b)

    def _grouped(self, chunks: list[str], tokens_a: list[tuple], tokens_b: list[tuple]) -> Iterator[Chunk]:
        """Alignments from ids and spans (of A in characters, of B in bytes), all chunks laid end to end; None where the tokens of
        either side do not give the bytes back."""
        raw = [c.encode() for c in chunks]
        pieces = [[b"".join([known[i] for i in ids]) for ids, _ in tokens] for known, tokens in ((self.bytes_a, tokens_a), (self.bytes_b, tokens_b))]
        lost = [x != r or y != r for x, y, r in zip(*pieces, raw)]
        if any(lost):
            left = [k for k, gone in enumerate(lost) if not gone]
            found = iter(self._grouped([chunks[k] for k in left], [tokens_a[k] for k in left], [tokens_b[k] for k in left]) if left else ())
            for gone in lost:
                yield None if gone else next(found)
            return
        base, flat = np.concatenate(([0], np.cumsum([len(r) for r in raw]))), []
        for tokens, of_length in ((tokens_a, self.lengths_a), (tokens_b, self.lengths_b)):
            ids = np.fromiter(chain.from_iterable(x for x, _ in tokens), np.int64)
            spans = np.fromiter(chain.from_iterable(chain.from_iterable(x for _, x in tokens)), np.int64).reshape(-1, 2)
            count = np.array([len(x) for x, _ in tokens], np.int64)
            if tokens is tokens_a:
                upto = np.cumsum(count)
                for k, (text, r) in enumerate(zip(chunks, raw)):
                    if len(text) != len(r):  # characters to bytes
                        place = np.array([0, *accumulate(len(c.encode()) for c in text)])
                        here = spans[upto[k] - count[k] : upto[k]]
                        here[:] = place[here]
            spans += np.repeat(base[:-1], count)[:, None]
            flat.append((ids, refined_ends(spans[:, 0], spans[:, 1], of_length[ids]), count))
        (ids_a, ends_a, n_a), (ids_b, ends_b, n_b) = flat
        cuts = np.intersect1d(ends_a, ends_b)
        # tokens of each group, and groups of each chunk, as places in the flat arrays
        to_a, to_b = np.searchsorted(ends_a, cuts, "right"), np.searchsorted(ends_b, cuts, "right")
        last = np.searchsorted(cuts, base[1:], "right").tolist()
        a, b, to_a, to_b = ids_a.tolist(), ids_b.tolist(), to_a.tolist(), to_b.tolist()
        i = j = g = 0
        for k, (x, y) in enumerate(zip(n_a.tolist(), n_b.tolist())):
            groups, pairs = [], []
            while g < last[k]:
                of_a, of_b = a[i : to_a[g]], b[j : to_b[g]]
                i, j, g = to_a[g], to_b[g], g + 1
                if len(of_a) == 1 == len(of_b):
                    groups.append(f"{of_a[0]}|{of_b[0]}")
                    pairs.append(of_a[0] << 32 | of_b[0])
                else:
                    groups.append(f"{','.join(map(str, of_a))}|{','.join(map(str, of_b))}")
                    pairs += [s << 32 | t for s in of_a for t in of_b]
            yield x, y, ";".join(groups), pairs

    def texts(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """A row for each text with n_a, n_b, n_groups and n_links; its groups_sha256; the number of its distinct pairs; and of
        all texts in order the distinct pairs and how often each is linked."""
        cut = [_CUT.split(t) if t else [] for t in texts]
        number = self.known.number
        new = list(dict.fromkeys(w for parts in cut for w in parts if w not in number))
        if new:
            self.learn(new)
        groups, words = self.known.groups, np.fromiter((number[w] for parts in cut for w in parts), np.int64)
        row = np.repeat(np.arange(len(texts)), [len(parts) for parts in cut])
        sizes = self.known.sizes[words]
        lost = np.bincount(row, sizes[:, 2] < 0, len(texts)) > 0
        counts = np.stack([np.bincount(row, sizes[:, k], len(texts)).astype(np.int64) for k in (0, 1, 0, 2)], 1)
        counts[lost] = 0
        digests, at, numbers = [], 0, words.tolist()
        for i, parts in enumerate(cut):
            if parts and not lost[i]:
                said = ";".join([groups[k] for k in numbers[at : at + len(parts)]])
                counts[i, 2] = said.count("|")
                digests.append(hashlib.sha256(said.encode()).hexdigest())
            else:
                digests.append("")
            at += len(parts)
        kept = ~lost[row]
        # a word counts once for each text, with its number of places there
        once, places = np.unique(row[kept] * len(groups) + words[kept], return_counts=True)
        row, words = np.divmod(once, max(len(groups), 1))
        n, start = self.known.sizes[words, 2], self.known.sizes[words, 3]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
        pair, row, places = self.known.pairs[place], np.repeat(row, n), np.repeat(places, n)
        order = np.lexsort((pair, row))
        pair, row, places = pair[order], row[order], places[order]
        first = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])))) if len(pair) else np.zeros(0, np.int64)
        times = np.add.reduceat(places, first) if len(first) else np.zeros(0, np.int64)
        self.known.keep(self.most, new)  # the first words seen hold nearly all the common ones
        return counts, digests, np.bincount(row[first], minlength=len(texts)), pair[first], times


@lru_cache(1)
def aligner_for(file_a: str, file_b: str) -> Aligner:
    """One aligner for each Python worker, so its chunks serve all tasks of the worker; a task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Aligner(file_a, file_b)


_ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"


def _align(file_a: str, file_b: str):
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_for(file_a, file_b)
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                counts, digests, held, pairs, times = aligner.texts([t or "" for t in part.column("text").to_pylist()])
                offsets = pa.array(np.concatenate(([0], np.cumsum(held))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in (pairs, times)]
                columns = [part.column("doc_id"), *map(pa.array, np.ascontiguousarray(counts.T)), pa.array(digests, pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _ROWS.split(", ")])

    return align


def align_tokens(docs: DataFrame, file_a: str, file_b: str) -> DataFrame:
    """One row per row of docs (doc_id, text): n_a, n_b, n_groups, n_links, groups_sha256, and the distinct linked pairs
    (a << 32 | b) with the number of their links.

    A null or empty text, and one that the tokens of A or B do not give back byte for byte, has no tokens: zeros, an empty
    digest, no pairs. Rows are independent: repeats, null ids and extra columns change nothing. Both files must be readable
    on every executor.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_align(file_a, file_b), _ROWS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): in how many rows of align_tokens a pair is linked, and whether no pair of its A id has more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    a = F.shiftright("pair", 32).alias("a")
    top = counts.groupBy(a).agg(F.max("n").alias("most"))
    return counts.withColumn("a", F.shiftright("pair", 32)).join(top, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def commonest(counts: DataFrame, max_pairs: int) -> int | None:
    """The least power of two such that at most max_pairs pairs have that count or more; None if there is none of use. Sums by
    power of two go to the driver, so 63 rows at most."""
    rows = counts.groupBy(F.floor(F.log2("n")).alias("power")).count().collect()
    held, found = 0, None
    for power, n in sorted(((r["power"], r["count"]) for r in rows), reverse=True):
        held += n
        if held > max_pairs:
            break
        found = 1 << power
    return found


def _looked_up(arrays):
    """Sums over the pairs that the arrays hold; `rest` has the others, with their links."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = arrays.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            key, links = pairs.flatten().to_numpy(zero_copy_only=False), times.flatten().to_numpy(zero_copy_only=False)
            place = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
            hit = known[place] == key if len(known) else np.zeros(len(key), bool)
            place = np.where(hit, place, 0)
            row = np.repeat(np.arange(len(batch)), np.diff(pairs.offsets.to_numpy()))
            total = lambda x: np.bincount(row, x, len(batch)).astype(np.int64)  # noqa: E731  exact below 2 ** 53
            sums = [total(np.where(hit, links * x[place], 0)) if len(known) else np.zeros(len(batch), np.int64) for x in (best, n)]
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row[~hit], minlength=len(batch))))).astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x[~hit], pa.int64())) for x in (key, links)]
            kept = [c for c in batch.schema.names if c not in ("pairs", "times")]
            columns = [*map(batch.column, kept), *map(pa.array, sums), *rest]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_best", "count_sum", "pairs", "times"])

    return look_up


def scored_alignment(docs: DataFrame, file_a: str, file_b: str, max_pairs: int = 1_000_000) -> DataFrame:
    """align_tokens without the pairs, and n_best (links whose pair is linked in as many documents as any of its A id, ties
    included) and count_sum (documents of its pair, summed over the links).

    The commonest pairs are looked up in arrays of 17 bytes a pair, max_pairs at most, that every Python worker holds; links of
    rarer ones go to their counts by a join. The result does not depend on max_pairs. An empty table gives no rows.
    """
    aligned = stored(align_tokens(docs, file_a, file_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = stored(pair_counts(aligned), "pairs")
    least = commonest(counts, max_pairs)
    common = counts.filter(F.col("n") >= least) if least else counts.limit(0)
    held = common.select("pair", "n", "best").toArrow().sort_by("pair")
    arrays = tuple(held[c].to_numpy().astype(t) for c, t in (("pair", np.int64), ("n", np.int64), ("best", np.int8)))
    kinds = ", ".join(f"{c} {t}" for c, t in aligned.drop("pairs", "times").dtypes)
    shared = docs.sparkSession.sparkContext.broadcast(arrays)
    found = aligned.mapInArrow(_looked_up(shared), f"{kinds}, n_best long, count_sum long, pairs array<long>, times array<long>")
    if counts.count() == len(held):
        return found.drop("row", "pairs", "times")
    found = stored(found, "looked-up")
    forget(aligned)
    rare = counts.filter(F.col("n") < least) if least else counts
    left = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), "x.times").join(rare, "pair")
    more = left.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("times")).alias("more"))
    summed = {c: F.col(c) + F.coalesce(m, F.lit(0)) for c, m in (("n_best", "more_best"), ("count_sum", "more"))}
    return found.drop("pairs", "times").join(more, "row", "left").withColumns(summed).drop("row", "more_best", "more")
