"""SimHash near-duplicates through keys of the binary Golay code.

The code [23, 12, 7] is perfect: every 23-bit word is within three bits of exactly one codeword. A fingerprint is cut in segments
of 23, 23 and 18 bits (the last with five zeros). A segment decodes to its `own` codeword; the codewords that it or a word one bit
away decodes to are its `near` ones, one or six. Two segments share a near codeword if they differ in two bits at most, for both are
one bit away from a word between; and if they differ in one bit at most, the own one of either is a near one of the other.

With four differing bits at most over three segments, one of two things holds, and each gives keys:
  1. a segment is equal, and of the other two one differs in two bits at most: the segment itself and a near codeword of another;
  2. two segments differ in one bit each, the third in two at most, so that one of its three pieces is equal: the own codeword of
     the one, a near one of the other, and the piece; either may give its own.
Keys have 30 to 35 bits that tell fingerprints apart, so few meet by chance. What meets is verified.

Rows are dealt and sorted by key, so that the fingerprints of a key follow each other, and only true links leave a key's group: a tree
for each set that hangs together, never all pairs. A group of more than BLOCK fingerprints is compared in blocks, so a row is never held
against more than BLOCK others; what such a group may still hide is found by midpoints. Two fingerprints differ in four bits at most
exactly if a word is within two bits of either, so each fingerprint of such a group goes to all 2,081 words around it, and all that meet
at a word are linked. The work is at most BLOCK comparisons a key and 2,081 words a fingerprint, however large the groups are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.llm.components import components
from quadloom.llm.shared import stored

LENGTH, CHECKS = 23, 11
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the generator of the code (a fixed value).
GENERATOR = 0b110001110101
#: First bit and length of the segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
BITS = 4
#: Fingerprints of one key that are compared with each other; it takes about as long as their midpoints would.
BLOCK = 4096
#: Fingerprints that one task finds the keys of.
KEYED_ROWS = 10_000


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of each bit, and for each remainder the error patterns of up to four bits that lead to a codeword: the one of up
    to three bits first, then those of four, where there are any; filled up with the first."""
    rest = np.zeros(LENGTH, np.int64)
    for i in range(LENGTH):
        r = 1 << i
        for k in range(i, CHECKS - 1, -1):
            if r >> k & 1:
                r ^= GENERATOR << (k - CHECKS)
        rest[i] = r
    found: dict[int, list[int]] = {}
    for weight in range(BITS + 1):
        for places in combinations(range(LENGTH), weight):
            r = 0
            for i in places:
                r ^= int(rest[i])
            found.setdefault(r, []).append(sum(1 << i for i in places))
    patterns = np.array([found[r] + found[r][:1] * (6 - len(found[r])) for r in range(1 << CHECKS)], np.int64)
    return rest, patterns


def codewords(segments: np.ndarray) -> np.ndarray:
    """The six near codewords of each segment, its own first; where there is but one, it stands six times."""
    rest, patterns = tables()
    r = np.zeros(len(segments), np.int64)
    for i in range(LENGTH):
        r ^= np.where(segments >> i & 1 == 1, rest[i], 0)
    return segments[:, None] ^ patterns[r]


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64-bit SimHash: a bit is set if it is in over half the XXH64 of the word shingles, repeats included. A-Z count as a-z; the
    whole sequence if it is shorter; 0 without words."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts, stops)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        raw = np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += raw.sum(0, dtype=np.int64)
    return int("".join("1" if 2 * c > len(hashes) else "0" for c in counts), 2)


def _fingerprints(width: int, seed: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width, seed) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64), pa.int64())], names=["doc_id", "fp"])

    return of


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints (unsigned), each with the row it belongs to. Codewords and pieces are packed whole, not hashed."""
    segments = [(fp >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int64) for first, bits in SEGMENTS]
    near = [codewords(s) for s in segments]
    several = [np.flatnonzero(n[:, 1] != n[:, 0]) for n in near]
    everyone, rows, out = np.arange(len(fp)), [], []

    def add(kind: int, fixed: np.ndarray, place: int, other: int, start: int = 0) -> None:
        for k in range(start, 6):
            who = several[other] if k else everyone
            rows.append(who)
            out.append(fixed[who] | near[other][who, k] << place | np.int64(kind) << 58)

    for equal in range(3):
        for other in range(3):
            if other != equal:
                add(equal * 3 + other, segments[equal], LENGTH, other)
    for third in range(3):
        first, second = (i for i in range(3) if i != third)
        width = -(-SEGMENTS[third][1] // 3)
        for k in range(3):
            # the number of the piece stands above the piece, the number of the third segment in the kind
            piece = (segments[third] >> k * width & (1 << width) - 1 | k << 8) << 2 * LENGTH
            add(9 + third, piece | near[first][:, 0], LENGTH, second)
            add(9 + third, piece | near[second][:, 0] << LENGTH, 0, first, 1)  # both own ones are there already
    return np.concatenate(rows), np.concatenate(out)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), 5000):
            fp = batch.column("fp").slice(start, 5000).to_numpy()
            rows, found = keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(fp[rows])], names=["key", "fp"])


def tree_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): the links of a tree for each set of fps that hangs together. What is linked is not compared with the rest of its set
    again."""
    left, us, vs = fp, [fp[:0]], [fp[:0]]
    while len(left) > 1:
        near, left = left[:1], left[1:]
        while len(near) and len(left):
            some, near = near[:256], near[256:]
            linked = np.bitwise_count((left[:, None] ^ some).view(np.uint64)) <= BITS
            hit = linked.any(1)
            us.append(left[hit])
            vs.append(some[linked[hit].argmax(1)])
            near, left = np.concatenate((near, left[hit])), left[~hit]
    return np.concatenate(us), np.concatenate(vs)


def _group_links(block: int):
    """From rows sorted by key: the links of each group, block by block, and (fp, null) for each row of a group of several blocks."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = fp = np.zeros(0, np.int64)  # the rows of a last group that may go on, block at most
        cut = None  # the key of a last group that has been cut
        for batch in chain(batches, [None]):
            if batch is not None:
                key, fp = (np.concatenate((x, batch.column(c).to_numpy())) for x, c in ((key, "key"), (fp, "fp")))
            if not len(key):
                continue
            edges = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
            sizes, opens = np.diff(edges), edges[:-1]
            whole = batch is None or sizes[-1] > block
            wanted = np.flatnonzero((sizes > 1) | (key[opens] == cut))
            us, vs, crowded = [fp[:0]], [fp[:0]], [fp[:0]]
            for g in wanted[wanted < len(opens) - (not whole)].tolist():
                group = fp[edges[g] : edges[g + 1]]
                for start in range(0, len(group), block):
                    u, v = tree_links(group[start : start + block])
                    us.append(u)
                    vs.append(v)
                if len(group) > block or key[edges[g]] == cut:
                    crowded.append(group)
            cut = key[-1] if whole else cut
            key, fp = (key[:0], fp[:0]) if whole else (key[opens[-1] :], fp[opens[-1] :])
            us, vs, crowded = np.concatenate(us), np.concatenate(vs), np.unique(np.concatenate(crowded))
            if len(us) or len(crowded):
                ends = [pa.array(vs), pa.nulls(len(crowded), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((us, crowded))), pa.concat_arrays(ends)], names=["u", "v"])

    return of


def _midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fp under all words that differ from it in two bits at most."""
    masks = np.array([0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i, j in combinations(range(64), 2)], np.uint64).view(np.int64)
    for batch in batches:
        for start in range(0, len(batch), 200):
            fp, comp = (batch.column(c).slice(start, 200).to_numpy() for c in ("fp", "comp"))
            columns = [(fp[:, None] ^ masks).ravel(), np.repeat(comp, len(masks)), np.repeat(fp, len(masks))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["word", "comp", "fp"])


def simhash(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp), a row per row of docs; fp is the fingerprint as a signed long."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(_fingerprints(width, seed), "doc_id long, fp long")


def midpoint_links(fps: DataFrame) -> DataFrame:
    """(u, v): links between fps of different components (fp, comp: long) that join all components with a link between them."""
    at_word = Window.partitionBy("word").orderBy("comp", "fp")
    met = fps.mapInArrow(_midpoints, "word long, comp long, fp long")
    met = met.withColumn("before", F.lag(F.struct("comp", "fp")).over(at_word)).filter("before.comp <> comp")
    return met.groupBy("comp", F.col("before.comp").alias("other")).agg(F.min(F.struct("fp", "before.fp")).alias("x")).select("x.*").toDF("u", "v")


def fingerprint_links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v): true links between distinct fps (fp long) that join every two fps of at most four differing bits, if not directly
    then over others."""
    keyed = fps.select("fp").repartition(-(-fps.count() // KEYED_ROWS) or 1, "fp").mapInArrow(_keyed, "key long, fp long")
    found = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_group_links(block), "u long, v long")
    found = stored(found.distinct(), "links")
    links, crowded = found.filter("v is not null"), found.filter("v is null").select(F.col("u").alias("fp"))
    if crowded.isEmpty():
        return links
    comps = components(links).withColumnRenamed("node", "fp")
    late = stored(midpoint_links(crowded.join(comps, "fp", "left").select("fp", F.coalesce("component", "fp").alias("comp"))), "links")
    return links.union(late)


def fingerprint_classes(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """One row per row of docs (doc_id, text): fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links
    of at most four differing bits, itself included.

    Null and empty texts have fingerprint zero, linked like any other; fewer words than a shingle are one shingle. A null doc_id
    has the component of its fingerprint's other rows, null if there is none. Repeated rows are linked, as their bits are equal. Extra
    columns change nothing; an empty table gives no rows.
    """
    rows = stored(simhash(docs, width, seed), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    comps = components(fingerprint_links(fps)).withColumnRenamed("node", "fp")
    both = fps.join(comps, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = both.groupBy("component").agg(F.min("least").alias("component_id"))
    named = both.select("fp", "component").join(ids, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
