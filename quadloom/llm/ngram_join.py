"""Similarity join on word-shingle sets (Jaccard >= threshold) with signature trees, and the classes it links.

1. Every text becomes its set of distinct shingle hashes; equal sets are one *class*.
2. Two sets over the threshold share one of their first `n - ceil(t * n) + 1` shingles in any one global order, so only these
   are posted. The order takes commoner shingles later: those that repeat within a stretch of some thousand texts are
   counted, over all texts, and the COMMON commonest are known to every task. A poor order costs time, never a link.
3. Shingles posted by two classes or more are *lists*. Each class goes, with its set, to two of its lists: the longest, and
   one chosen by a hash, so what misses at one place can meet at the other. There the classes become a signature tree: nodes
   hold the OR of their members' bitmaps (of all and of the posted shingles), the range of set sizes, and the component if
   all members are joined. A dual traversal from the root against itself, closest nodes first, drops node pairs whose sizes
   or largest possible overlap rule a link out, or that are joined already; the sets that are left are compared at once, so a
   group of near copies costs about as many comparisons as members, not as pairs. Lists over GROUP shingles are split by a
   hash, another one for either place.
4. Lists whose members are in several components still hold pairs that were not compared. Their members meet again, bitmaps
   only, one tree a chunk: the list's largest component against the rest, and the rest against itself, so a large component is
   never paired with itself. Surviving pairs that share too few posted shingles over all lists to reach the threshold go, and
   what is left is compared exactly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.components import components
from quadloom.llm.hashing import hashed_rows, mix, prefix_sums, signed, span_hashes, window_hashes
from quadloom.llm.shared import forget, small_side, stored

BITS, POSTED_BITS = 1024, 4096
LEAF = 8
#: Shingles whose level is broadcast; shingles of a counted stretch; shingles of a tree's sets; bytes of a batch handed on.
COMMON, STRETCH, GROUP, BATCH_BYTES = 1 << 20, 1 << 21, 1 << 21, 4 << 20
SETS = "doc_id long, n int, class long, token long, seen long"


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of `width` words, A-Z lower-cased; a shorter text is one shingle."""
    for words in hashed_rows(texts, lower=True):
        if not len(words):
            yield np.zeros(0, np.uint64)
        elif len(words) < width:
            yield span_hashes(prefix_sums(words), np.array([0]), np.array([len(words)])) + np.uint64(len(words))
        else:
            tokens = np.sort(window_hashes(prefix_sums(words), width))
            yield tokens[np.concatenate(([True], tokens[1:] != tokens[:-1]))]


def class_of(tokens: np.ndarray) -> int:
    """64-bit key of a set: equal sets have equal keys."""
    total = mix(tokens).sum(dtype=np.uint64) + np.uint64(len(tokens))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _bitmap(tokens: np.ndarray, size: int) -> bytes:
    bits = np.zeros(size, np.uint8)
    bits[(tokens % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _repeated(stretch: list[np.ndarray]) -> pa.RecordBatch:
    tokens = np.sort(np.concatenate(stretch)) if stretch else np.zeros(0, np.uint64)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(tokens)), bool), tokens[1:] != tokens[:-1])))
    counts = np.diff(first, append=len(tokens))
    first, counts = first[counts > 1], counts[counts > 1]
    nothing = [pa.nulls(len(first), kind) for kind in (pa.int64(), pa.int32(), pa.int64())]
    return pa.RecordBatch.from_arrays([*nothing, pa.array(signed(tokens[first])), pa.array(counts, pa.int64())], names=["doc_id", "n", "class", "token", "seen"])


def _sets(width: int):
    """(doc_id, n, class) of each text, and (token, seen) of the shingles that several different sets of a stretch hold."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, held, known = [], 0, set()
        for batch in batches:
            sizes, classes = [], []
            for tokens in shingle_sets(batch.column("text"), width):
                key = class_of(tokens) if len(tokens) else None
                sizes.append(len(tokens))
                classes.append(key)
                if key is not None and key not in known:
                    known.add(key)
                    stretch.append(tokens)
                    held += len(tokens)
                    if held >= STRETCH:
                        yield _repeated(stretch)
                        stretch, held, known = [], 0, set()
            empty = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(classes, pa.int64()), empty, empty], names=["doc_id", "n", "class", "token", "seen"])
        yield _repeated(stretch)

    return read


def posted_count(n: int, percent: int) -> int:
    """Length of the prefix: two sets over the threshold share one of their posted_count first shingles."""
    return n - -(-percent * n // 100) + 1


class Order:
    """The global order of shingles: by level of how common they are known to be, then by hash."""

    def __init__(self, packed: tuple[bytes, bytes], percent: int):
        self.common, self.level, self.percent = np.frombuffer(packed[0], np.uint64), np.frombuffer(packed[1], np.uint8), percent

    def posted(self, tokens: np.ndarray) -> np.ndarray:
        """Which of a set's shingles are posted, as a mask."""
        mask, most = np.ones(len(tokens), bool), posted_count(len(tokens), self.percent)
        if most < len(tokens):
            order = tokens >> np.uint64(8)
            if len(self.common):
                at = np.minimum(np.searchsorted(self.common, tokens), len(self.common) - 1)
                order = order | (np.where(self.common[at] == tokens, self.level[at], 0).astype(np.uint64) << np.uint64(56))
            mask[np.argpartition(order, most - 1)[most:]] = False
        return mask


def _postings(width: int, percent: int, common):
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, done = Order(common.value, percent), set()
        for batch in batches:
            tokens, classes, sizes = [], [], []
            for found in shingle_sets(batch.column("text"), width):
                if not len(found) or (key := class_of(found)) in done:
                    continue
                if len(done) >= 50_000:
                    done.clear()
                done.add(key)
                posted = found[order.posted(found)]
                tokens.append(signed(posted))
                classes.append(np.full(len(posted), key, np.int64))
                sizes.append(np.full(len(posted), len(found), np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, classes, sizes)], names=["token", "class", "n"])

    return post


def _bitmaps(width: int, percent: int, common):
    """The token bitmaps of each wanted class: all its shingles in BITS bits, which tells short texts apart, and its posted
    shingles in POSTED_BITS bits, which tells long ones apart."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(common.value, percent)
        for batch in batches:
            classes, bits, posted = [], [], []
            for found, cls in zip(shingle_sets(batch.column("text"), width), batch.column("class").to_pylist()):
                if len(found) and class_of(found) == cls:
                    classes.append(cls)
                    bits.append(_bitmap(found, BITS))
                    posted.append(_bitmap(found[order.posted(found)], POSTED_BITS))
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.int64()), pa.array(bits, pa.binary()), pa.array(posted, pa.binary())], names=["class", "bits", "posted"])

    return read


def _group_sets(width: int, percent: int, common):
    """Each class with its shingles, the posted ones apart, under every list and part that it goes to."""
    names = ["token", "part", "class", "posted", "others"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(common.value, percent)
        for batch in batches:
            rows, held = [[] for _ in names], 0

            def out() -> pa.RecordBatch:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                return pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds)], names=names)

            for found, cls, homes in zip(shingle_sets(batch.column("text"), width), batch.column("class").to_pylist(), batch.column("homes").to_pylist()):
                if len(found) and class_of(found) == cls:
                    mask = order.posted(found)
                    for home in homes:
                        for column, x in zip(rows, (home["home"], home["part"], cls, signed(found[mask]), signed(found[~mask]))):
                            column.append(x)
                        held += 8 * len(found)
                    if held >= BATCH_BYTES:
                        yield out()
                        rows, held = [[] for _ in names], 0
            yield out()

    return read


def _sent_sets(width: int):
    """Each text's set, once for every key (the end of a pair) under which it is compared."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, classes, sets, held = [], [], [], 0

            def out() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(classes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["key", "class", "tokens"])

            for found, cls, to in zip(shingle_sets(batch.column("text"), width), batch.column("class").to_pylist(), batch.column("keys").to_pylist()):
                if not len(found) or class_of(found) != cls:
                    continue
                for key in to:
                    keys.append(key)
                    classes.append(cls)
                    sets.append(signed(found))
                    held += 8 * len(found)
                    if held >= BATCH_BYTES:
                        yield out()
                        keys, classes, sets, held = [], [], [], 0
            yield out()

    return read


def common_count(a: np.ndarray, b: np.ndarray) -> int:
    """Shared entries of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def over(same: int, a: int, b: int, percent: int) -> bool:
    return (100 + percent) * same >= percent * (a + b)


def _compare(percent: int):
    """Streams sets sorted by key with the key's own set first; holds that one set."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, np.zeros(0, np.int64)
        for batch in batches:
            u, v = [], []
            column = batch.column("tokens")
            values, edges = column.values.to_numpy(), column.offsets.to_numpy()
            for row, (k, cls) in enumerate(zip(batch.column("key").to_pylist(), batch.column("class").to_pylist())):
                tokens = np.sort(values[edges[row] : edges[row + 1]])  # sent in unsigned order
                if k == cls:
                    key, own = k, tokens
                elif k == key and over(common_count(tokens, own), len(own), len(tokens), percent):
                    u.append(k)
                    v.append(cls)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return compare


class Node:
    """Signature-tree node over rows (class, n, component, bits, posted): the OR of both bitmaps, the range of sizes, the
    largest excess of a row's shingles over its own bits in each, and the component if all members share one."""

    __slots__ = ("bits", "posted", "low", "high", "excess", "posted_excess", "component", "children", "row")

    def __init__(self, percent: int, children: list[Node] | None = None, row: tuple | None = None):
        self.children, self.row = children, row
        if row is not None:
            _, n, self.component, self.bits, self.posted = row
            self.low = self.high = n
            self.excess = n - self.bits.bit_count()
            self.posted_excess = posted_count(n, percent) - self.posted.bit_count()
        else:
            self.bits = self.posted = 0
            for c in children:
                self.bits |= c.bits
                self.posted |= c.posted
            self.low, self.high = min(c.low for c in children), max(c.high for c in children)
            self.excess, self.posted_excess = max(c.excess for c in children), max(c.posted_excess for c in children)
            self.component = children[0].component if len({c.component for c in children}) == 1 else None


def grow_tree(rows: list[tuple], percent: int, near=None) -> Node:
    """Bulk-load: rows in the order of `near` (by default size band, component, size and bitmap), grouped LEAF at a time up to
    one root."""
    nodes = [Node(percent, row=r) for r in sorted(rows, key=near or (lambda r: (int(16 * math.log2(r[1])), r[2], r[1], r[3])))]
    while len(nodes) > 1:
        nodes = [Node(percent, nodes[i : i + LEAF]) for i in range(0, len(nodes), LEAF)]
    return nodes[0]


def may_link(a: Node, b: Node, percent: int) -> bool:
    """False only if no pair under a and b can reach the threshold. Two sets share at most their common bits and the smaller
    excess; and what they share up to the end of the prefix that ends first is posted by both, behind it that set has only
    ceil(t * n) - 1 shingles left."""
    if 100 * a.high < percent * b.low or 100 * b.high < percent * a.low:
        return False
    needed = percent * (a.low + b.low)
    if (100 + percent) * min((a.bits & b.bits).bit_count() + min(a.excess, b.excess), a.high, b.high) < needed:
        return False
    rest = -(-percent * max(a.high, b.high) // 100) - 1
    return (100 + percent) * ((a.posted & b.posted).bit_count() + min(a.posted_excess, b.posted_excess) + rest) >= needed


def traverse(a: Node, b: Node, percent: int, joined=lambda x, y: x.component is not None and x.component == y.component) -> Iterator[tuple[tuple, tuple]]:
    """Dual traversal from two roots (or one root twice), nodes against themselves first: pairs of rows that survive the
    pruning and are not joined by the time they are met, each once."""
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if joined(x, y):
            continue
        if x is y:
            kids = x.children or []
            stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(len(kids) - 1, i, -1)]
            stack += [(k, k) for k in kids if k.children]
        elif may_link(x, y, percent):
            if x.row is not None and y.row is not None:
                yield (x.row, y.row) if x.row[0] < y.row[0] else (y.row, x.row)
            elif y.row is not None or (x.children is not None and x.high - x.low >= y.high - y.low):
                stack += [(c, y) for c in x.children]
            else:
                stack += [(x, c) for c in y.children]


class Joined(dict):
    """Components known so far: a forest over classes, its roots the smallest, and which nodes lie in one component."""

    def join(self, a: int, b: int) -> None:
        low, high = sorted((self.root(a), self.root(b)))
        self[high] = low

    def root(self, key: int) -> int:
        while (above := self.get(key, key)) != key:
            self[key] = self.get(above, above)
            key = above
        return key

    def of(self, node: Node) -> int | None:
        """The component of all rows under a node, or None. Nodes found to be in one component stay so."""
        if node.component is None:
            first = self.of(node.children[0])
            if first is not None and all(self.of(c) == first for c in node.children[1:]):
                node.component = first
        return None if node.component is None else self.root(node.component)

    def same(self, a: Node, b: Node) -> bool:
        return (one := self.of(a)) is not None and one == self.of(b)


def tree_links(rows: list[tuple[int, np.ndarray, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """(class, another class) for rows (class, posted, others): every class that is linked, over others if need be, with one
    of its component. The tree's leaves are ordered by the sets' least hashes, which puts near copies side by side."""
    sets = {cls: np.sort(np.concatenate((posted, others))) for cls, posted, others in rows}
    if len(sets) < 2:
        return []
    loaded = {}
    for cls, posted, _ in rows:
        whole = sets[cls]
        bits, marks = _bitmap(whole.view(np.uint64), BITS), _bitmap(posted.view(np.uint64), POSTED_BITS)
        loaded[cls] = (cls, len(whole), cls, int.from_bytes(bits), int.from_bytes(marks))
    root = grow_tree(list(loaded.values()), percent, lambda r: (*sets[r[0]][:2].tolist(), r[0]))
    known = Joined()
    for x, y in traverse(root, root, percent, known.same):
        if over(common_count(sets[x[0]], sets[y[0]]), x[1], y[1], percent):
            known.join(x[0], y[0])
    return [(cls, top) for cls in sets if (top := known.root(cls)) != cls]


def _tree_links(percent: int):
    """Streams rows sorted by (token, part) and holds those of one group."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, found = None, [], []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])
            found.clear()
            return batch

        for batch in batches:
            lists = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("posted"), batch.column("others"))]
            for k, (token, part, cls) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("token", "part", "class")))):
                if key != (token, part):
                    found += tree_links(rows, percent)
                    key, rows = (token, part), []
                rows.append((cls, *(values[edges[k] : edges[k + 1]].copy() for values, edges in lists)))
            yield out()
        found += tree_links(rows, percent)
        yield out()

    return links


def _tree_pairs(percent: int):
    """Streams rows sorted by (token, i, j): one signature tree per side of each chunk pair. Gives every surviving pair with
    the number of posted shingles that it shares here."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, weight, sides, shared = None, 0, {}, Counter()

        def table() -> pa.RecordBatch:
            columns = list(zip(*shared)) or [(), (), (), ()]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
            out = pa.RecordBatch.from_arrays([*arrays, pa.array(list(shared.values()), pa.int64())], names=["u", "v", "u_n", "v_n", "shared"])
            shared.clear()
            return out

        def close() -> Iterator[pa.RecordBatch]:
            left, right = (list(sides.get(s, {}).values()) for s in key[1:])
            if left and right and (key[1] != key[2] or len(left) > 1):
                root = grow_tree(left, percent)
                for x, y in traverse(root, root if key[1] == key[2] else grow_tree(right, percent), percent):
                    shared[x[0], y[0], x[1], y[1]] += weight
                    if len(shared) >= 50_000:
                        yield table()

        for batch in batches:
            for token, i, j, many, chunk, cls, n, comp, bits, posted in zip(*(batch.column(c).to_pylist() for c in ("token", "i", "j", "many", "chunk", "class", "n", "component", "bits", "posted"))):
                if key != (token, i, j):
                    if key:
                        yield from close()
                    key, weight, sides = (token, i, j), many, {}
                sides.setdefault(chunk, {})[cls] = (cls, n, comp, int.from_bytes(bits), int.from_bytes(posted))
        if key:
            yield from close()
        yield table()

    return pairs


def _may_reach(shared: str, a: str, b: str, percent: int) -> Column:
    """Whether two sets that share so many posted shingles can reach the threshold: what they share up to the end of the
    prefix that ends first is posted by both, and behind it that set has only ceil(t * n) - 1 shingles left."""
    rest = F.greatest(F.ceil(F.col(a) * percent / 100), F.ceil(F.col(b) * percent / 100)) - 1
    return (100 + percent) * (F.col(shared) + rest) >= percent * (F.col(a) + F.col(b))


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) of classes whose full sets reach the threshold. A set is read from its text where it lies and sent to
    the keys of its pairs: one shuffle, with one set for each pair and key. The key of a pair is its end with more pairs, so a
    class that meets very many others is sent once, and no class is sent to more keys than the square root of twice the pairs."""
    degree = pairs.select(F.explode(F.array("u", "v")).alias("class")).groupBy("class").agg(F.count("*").alias("d"))
    left, right = (degree.select(F.col("class").alias(k), F.struct("d", "class").alias(f"{k}_d")) for k in "uv")
    pairs = pairs.join(left, "u").join(right, "v").select(F.greatest("u_d", "v_d")["class"].alias("u"), F.least("u_d", "v_d")["class"].alias("v"))
    ends = pairs.select(F.col("v").alias("class"), F.col("u").alias("key")).union(pairs.select(F.col("u").alias("class"), F.col("u").alias("key")).distinct())
    wanted = stored(ends.groupBy("class").agg(F.collect_list("key").alias("keys")).join(classes.select("class", "rep"), "class"), "wanted")
    texts = docs.join(small_side(wanted), docs["doc_id"] == wanted["rep"]).select("text", "class", "keys")
    sent = texts.mapInArrow(_sent_sets(width), "key long, class long, tokens array<long>")
    sent = sent.repartition("key").sortWithinPartitions("key", F.col("key") != F.col("class"), "class")
    links = stored(sent.mapInArrow(_compare(percent), "u long, v long").distinct(), "links")
    forget(wanted)
    return links


def _common(read: DataFrame):
    """Hashes and levels (log2 of the count) of the commonest repeated shingles: COMMON at most, whatever the input. Whole
    levels are taken from the top, so equal counts are treated alike."""
    spark = read.sparkSession
    counts = read.filter("token is not null").groupBy("token").agg(F.sum("seen").alias("seen"))
    counts = stored(counts.select("token", F.floor(F.log2("seen")).cast("int").alias("level")), "common")
    least, held = 99, 0
    for r in counts.groupBy("level").agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # 64 levels at most
        if held + r.n > COMMON:
            break
        least, held = r.level, held + r.n
    kept = counts.filter(F.col("level") >= least).toArrow()
    forget(counts)
    tokens, levels = kept["token"].to_numpy().astype(np.int64).view(np.uint64), kept["level"].to_numpy().astype(np.uint8)
    order = np.argsort(tokens)
    return spark.sparkContext.broadcast((tokens[order].tobytes(), levels[order].tobytes()))


def _home_links(members: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int, common) -> DataFrame:
    """(u, v) of one component: each class goes to two of its lists, long lists in parts, and each part is one tree."""
    sizes = members.groupBy("token").agg(F.count("*").alias("size"))
    longest, other = F.max(F.struct("size", "token"))["token"], F.max(F.struct(F.xxhash64("token").alias("h"), "token"))["token"]
    homes = members.join(sizes, "token").groupBy("class").agg(F.array(longest, other).alias("homes"), F.first("n").alias("n"))
    homes = stored(homes.select("class", "n", F.posexplode("homes").alias("place", "home")), "homes")
    loads = homes.groupBy("home", "place").agg(F.sum("n").alias("load"), F.count("*").alias("held")).filter("held > 1")
    parts = loads.select("home", "place", F.ceil(F.col("load") / GROUP).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("class", "place"), "parts").cast("int") * 2 + F.col("place")
    dealt = homes.join(parts, ["home", "place"]).groupBy("class").agg(F.collect_set(F.struct("home", part.alias("part"))).alias("homes"))
    dealt = stored(dealt.join(classes, "class"), "dealt")
    texts = docs.join(small_side(dealt), docs["doc_id"] == dealt["rep"]).select("text", "class", "homes")
    sets = texts.mapInArrow(_group_sets(width, percent, common), "token long, part int, class long, posted array<long>, others array<long>")
    grouped = sets.repartition("token", "part").sortWithinPartitions("token", "part")
    links = stored(grouped.mapInArrow(_tree_links(percent), "u long, v long"), "links")
    forget(homes, dealt)
    return links


def _open_pairs(open_rows: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int, chunk: int, common) -> DataFrame:
    """Pairs (u, v) of classes in different components that the trees of the open lists leave and that share enough posted
    shingles. Chunk numbers below 0 are the list's largest component, the others the rest."""
    within = open_rows.groupBy("token", "component").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("class")).alias("who"))
    # lists with the same members are one list that counts many times
    lists = within.groupBy("token").agg(F.max(F.struct("size", "component")).alias("most"), F.sum("size").alias("size"), F.bit_xor("who").alias("who"))
    lists = lists.groupBy("size", "who").agg(F.min(F.struct("token", "most")).alias("one"), F.count("*").alias("many"))
    lists = lists.select(F.col("one.token").alias("token"), F.col("one.most.component").alias("major"), F.ceil(F.col("one.most.size") / chunk).cast("int").alias("majors"), F.ceil((F.col("size") - F.col("one.most.size")) / chunk).cast("int").alias("minors"), "many")
    rows = open_rows.join(lists, "token")
    is_major = F.col("component") == F.col("major")
    mine = F.pmod(F.xxhash64("class"), F.when(is_major, F.col("majors")).otherwise(F.col("minors"))).cast("int")
    minors = F.sequence(F.lit(0), F.col("minors") - 1)
    others = F.when(is_major, minors).otherwise(F.concat(minors, F.transform(F.sequence(F.lit(1), F.col("majors")), lambda k: -k)))
    rows = rows.withColumn("chunk", F.when(is_major, -1 - mine).otherwise(mine)).withColumn("with", F.explode(others))
    rows = rows.withColumn("i", F.least("chunk", "with")).withColumn("j", F.greatest("chunk", "with"))
    opened = stored(open_rows.select("class").distinct().join(classes, "class"), "open")
    texts = docs.join(small_side(opened), docs["doc_id"] == opened["rep"]).select("text", "class")
    bitmaps = texts.mapInArrow(_bitmaps(width, percent, common), "class long, bits binary, posted binary")
    rows = rows.join(bitmaps, "class").select("token", "i", "j", "many", "chunk", "class", "n", "component", "bits", "posted")
    pairs = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(_tree_pairs(percent), "u long, v long, u_n int, v_n int, shared long")
    pairs = pairs.groupBy("u", "v", "u_n", "v_n").agg(F.sum("shared").alias("shared")).filter(_may_reach("shared", "u_n", "v_n", percent)).select("u", "v")
    pairs = stored(pairs, "pairs")
    forget(opened)
    return pairs


def near_duplicate_classes(docs: DataFrame, width: int = 5, percent: int = 80, chunk: int = 4000) -> DataFrame:
    """One row per row of docs (doc_id, text): n_shingles and component_id (smallest doc_id linked, itself included).

    Two texts link when 100 * |A and B| >= percent * |A or B|. A null, empty or blank text has no shingles and links with
    nothing; a null doc_id gives a null component_id and links nothing; rows that repeat an id count as one document in
    links but each is returned with its own n_shingles. Extra columns are ignored; empty tables give no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = stored(docs.mapInArrow(_sets(width), SETS), "shingles")
    sets = read.filter("n is not null").select("doc_id", "n", "class")
    common = _common(read)
    classes = stored(sets.filter("n > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep")), "classes")

    posted = stored(docs.filter("doc_id is not null").mapInArrow(_postings(width, percent, common), "token long, class long, n int"), "posted")
    repeated = posted.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1").select("token")
    members = stored(posted.join(repeated, "token").distinct(), "members")
    forget(posted)
    links = _home_links(members, docs, classes, width, percent, common)
    joined = stored(components(links), "joined")
    known = members.join(joined, members["class"] == joined["node"], "left").select(*members.columns, F.coalesce("component", "class").alias("component"))
    open_lists = known.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a != b").select("token")
    open_rows = stored(known.join(open_lists, "token"), "open-rows")
    pairs = _open_pairs(open_rows, docs, classes, width, percent, chunk, common)
    links = joined.select(F.col("node").alias("u"), F.col("component").alias("v")).union(_linked(pairs, docs, classes, width, percent))

    found = stored(components(links), "found")
    named = classes.join(found, classes["class"] == found["node"], "left").select("class", "rep", F.coalesce("component", "class").alias("component"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = stored(named.join(smallest, "component").select("class", "component_id"), "named")
    forget(members, open_rows, pairs, found, classes, joined)
    out = sets.join(named, "class", "left")
    ids = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), ids.alias("component_id"))


def keep_one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows whose near-duplicate class holds a smaller doc_id; rows with a null id stay, and of rows that
    repeat an id all stay or go together."""
    found = near_duplicate_classes(docs, width, percent)
    gone = stored(found.filter("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(small_side(gone), docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
