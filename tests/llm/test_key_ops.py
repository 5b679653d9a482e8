"""Spelling groups, SimHash classes and token alignment against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import accumulate, combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quadloom.llm import golay, queries, spelling
from quadloom.llm.alignment import Aligner, scored_alignment

MEDIUM = "/root/testdata/sf0.01"
A_FILE, B_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [(1, None, 1, "x"), (2, "", 2, None), (None, "alone", 3, "y"), (5, "a b c", 4, "z"), (5, "a b c", 4, "z"), (7, " \n\t ", None, None), (8, "long " * 5000, 1, "q")]


def odd_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n long, word string")


def docs_of(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_spelling(docs, least=7, every=31):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least and c >= 2}
    holes, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i] + "\0" + w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in n:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {w: min(o, key=lambda x: (-n[x], x.encode())) for w, o in near.items() if o}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def test_spelling_groups_equal_brute_force(spark):
    got = sorted(tuple(r) for r in queries.op11_spelling(spark, MEDIUM).collect())
    assert got == brute_spelling(docs_of(spark, MEDIUM))
    assert any(r[1] for r in got)


def test_spelling_chains_ties_and_odd_rows(spark):
    words = ["abcdefghi"] * 400 + ["abcdefgh"] * 40 + ["abcdefghé"] * 400 + ["abcdefg"] * 4 + ["xbcdefg"] * 2 + ["zzzzzzz"] * 3
    docs = [(i, f"{w}, {w.upper()}.") for i, w in enumerate(words)] + [(None, "zzzzzzz"), (3, None), (4, ""), (5, "w" * 30_000 + " " + "w" * 30_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("x"))
    got = {r.word: r for r in spelling.group_spellings(frame, every=0).collect()}
    assert [(got[w].form, got[w].root) for w in ("abcdefgh", "abcdefg", "xbcdefg")] == [("abcdefghi", "abcdefghi"), ("abcdefgh", "abcdefghi"), (None, "xbcdefg")]
    assert got["abcdefghi"].form is None and got["abcdefghi"].n_near == 3 and got["w" * 30_000].n == 2  # É stays upper case
    assert spelling.group_spellings(odd_rows(spark, [])).count() == 0
    assert spelling.group_spellings(odd_rows(spark, ODD), least=3).count() == 1


def test_near_words_share_a_signature():
    rng = np.random.default_rng(4)
    alphabet = "enisratdhulcgmobpwfkvzyjxqéßÿ"
    for _ in range(3000):
        word = "".join(rng.choice(list(alphabet), rng.integers(3, 14)))
        at, sign = int(rng.integers(0, len(word))), str(rng.choice(list(alphabet)))
        for other in (word[:at] + sign + word[at:], word[:at] + sign + word[at + 1 :]):
            if other != word:
                a, b = set(spelling.signatures(word)), set(spelling.signatures(other))
                same = {k for k, kind in a if kind == spelling.SAME} & {k for k, kind in b if kind == spelling.SAME}
                shorter = {k for k, kind in a if kind == spelling.SHORTER} & {k for k, kind in b if kind == spelling.LONGER}
                assert same if len(word) == len(other) else shorter


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps):
    """Smallest id reachable of (id, fingerprint) rows, over links of at most four bits."""
    bits = np.array([f for _, f in fps], np.uint64)
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(bits[:i] ^ bits[i]) <= 4).tolist():
            parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(fps):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return [least[root(i)] for i in range(len(fps))]


def test_simhash_classes_equal_brute_force(spark):
    docs = docs_of(spark, MEDIUM)
    fps = [(d, brute_fingerprint(t)) for d, t in docs]
    want = sorted((d, f"{f:016x}", c) for (d, f), c in zip(fps, classes(fps)))
    got = sorted(tuple(r) for r in queries.op12_simhash(spark, MEDIUM).collect())
    assert got == want and any(c != d for d, _, c in got)


def test_golay_tables():
    _, patterns = golay.tables()
    words = golay.codewords(np.arange(1 << 12))
    assert set(np.bitwise_count(patterns[:, 0]).tolist()) == {0, 1, 2, 3} and patterns.shape == (2048, 6)
    assert len({int(w) for w in golay.codewords(np.arange(1 << 23))[:, 0]}) == 4096
    assert (np.bitwise_count(words ^ np.arange(1 << 12)[:, None]) <= 4).all()


def test_close_fingerprints_share_a_key():
    rng = np.random.default_rng(8)
    for errors in range(5):
        for _ in range(1500):
            fp = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
            other = fp
            for bit in rng.choice(64, errors, replace=False):
                other ^= 1 << int(bit)
            rows, found = golay.keys(np.array([fp, other], np.uint64))
            assert set(found[rows == 0].tolist()) & set(found[rows == 1].tolist())


def test_links_of_a_dense_cluster(spark):
    rng = np.random.default_rng(2)
    base, fps = 0x123456789ABCDEF0, set()
    while len(fps) < 1500:
        fp = base
        for bit in rng.choice(40, int(rng.integers(0, 9)), replace=False):
            fp ^= 1 << int(bit)
        fps.add(fp)
    fps |= {int(x) for x in rng.integers(0, 1 << 62, 300)} | {(1 << 64) - 1, 0, 0xF}
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for _, f in rows], "fp long")
    links = golay.fingerprint_links(frame).collect()
    assert all(bin((r.u ^ r.v) & (1 << 64) - 1).count("1") <= 4 for r in links) and len(links) < 60_000
    number = {f - (1 << 64) if f >> 63 else f: i for i, f in rows}
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        a, b = sorted((root(number[r.u]), root(number[r.v])))
        parent[b] = a
    assert [root(i) for i in range(len(rows))] == classes(rows)


def signed_frame(spark, fps):
    return spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")


@pytest.mark.parametrize("block", [3, 40])
def test_links_of_groups_larger_than_a_block(spark, block):
    """Groups of many times the block: what a key's blocks keep apart is joined over midpoints."""
    rng = np.random.default_rng(block)
    fps = {0x0F0F, 0x0F0F << 40}
    while len(fps) < 700:
        fp = 0xFEDCBA9876543210
        for bit in rng.choice(36, int(rng.integers(0, 13)), replace=False):
            fp ^= 1 << int(bit)
        fps.add(fp)
    fps = sorted(fps)
    links = golay.fingerprint_links(signed_frame(spark, fps), block).collect()
    pairs = [(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in links]
    assert all(0 < (u ^ v).bit_count() <= 4 for u, v in pairs)
    number = {f: i for i, f in enumerate(fps)}
    least = list(range(len(fps)))
    for _ in fps:
        before = list(least)
        for u, v in pairs:
            least[number[u]] = least[number[v]] = min(least[number[u]], least[number[v]])
        if least == before:
            break
    want = classes(list(enumerate(fps)))
    assert least == want and 20 < len(set(want)) < 600


def test_group_links_over_batches():
    """Groups that end, go on or are cut where a batch ends give the same trees and the same crowded rows."""
    rng = np.random.default_rng(5)
    sizes = [1, 2, 7, 8, 9, 1, 30, 1, 1, 16, 17, 3]
    key = np.repeat(np.arange(len(sizes)), sizes)
    fp = np.concatenate([rng.choice(1 << 12, n, replace=False) for n in sizes]).astype(np.int64)
    many = np.array(sizes)[key] > 8
    batch = pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], names=["key", "fp"])
    for step in (1, 2, 3, 8, 9, 50, 1000):
        rows = [r for out in golay._group_links(8)(batch.slice(i, step) for i in range(0, len(key), step)) for r in out.to_pylist()]
        assert {r["u"] for r in rows if r["v"] is None} == set(fp[many].tolist())
        linked = {frozenset(r.values()) for r in rows if r["v"] is not None}
        for k in np.flatnonzero(np.array(sizes) <= 8).tolist():
            group = fp[key == k].tolist()
            got = classes([(i, f) for i, f in enumerate(group)])
            trees = sum(frozenset(p) in linked for p in combinations(group, 2))
            assert trees >= len(group) - len(set(got))
        assert all((max(x) ^ min(x)).bit_count() <= 4 for x in linked)


def join_rows(spark, run):
    """Rows that the joins of a run put out, and the number of rows that run returns."""
    store = spark._jsparkSession.sharedState().statusStore()
    first = store.executionsCount()
    out, total = run(), 0
    for i in range(first, store.executionsCount()):
        execution = store.executionsList().apply(i)
        values = store.executionMetrics(execution.executionId())
        nodes = store.planGraph(execution.executionId()).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            metrics = (node.metrics().apply(j) for j in range(node.metrics().size()) if "Join" in node.name())
            total += sum(int(values.get(m.accumulatorId()).get().replace(",", "")) for m in metrics if m.name() == "number of output rows" and values.contains(m.accumulatorId()))
    return total, out


def test_far_fingerprints_of_a_key_make_no_rows(spark):
    """Fingerprints that share keys and are not linked leave no rows: no key's group is joined with itself or its ends."""
    rng = np.random.default_rng(9)
    fps = []
    while len(fps) < 400:
        fp = 0x123456 | int(rng.integers(0, 1 << 20)) << 23 | int(rng.integers(0, 1 << 4)) << 60
        if all((fp ^ other).bit_count() > 4 for other in fps):
            fps.append(fp)
    rows, found = join_rows(spark, lambda: golay.fingerprint_links(signed_frame(spark, fps)).count())
    assert found == 0 and rows < len(fps)


def test_simhash_odd_rows(spark):
    assert golay.fingerprint_classes(odd_rows(spark, [])).count() == 0
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in golay.fingerprint_classes(odd_rows(spark, ODD)).collect()}
    zero = "0" * 16
    assert {(1, zero, 1), (2, zero, 1), (7, zero, 1)} <= got and len(got) == 6 and {c for d, _, c in got if d is None} == {None}


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B_FILE), Aligner(A_FILE, B_FILE)


def brute_groups(text, tools):
    """Groups of the tokens of a whole text, by decoded bytes alone; None without tokens."""
    a, b, aligner = tools
    if not text:
        return None
    raw, ids = f" {text}".encode(), (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text))
    pieces = [aligner.bytes_a[i] for i in ids[0]], [aligner.bytes_b[i] for i in ids[1]]
    if any(b"".join(p) != raw for p in pieces):
        return None
    ends = [list(accumulate(map(len, p))) for p in pieces]
    groups, at = [], [0, 0]
    for cut in sorted(set(ends[0]) & set(ends[1])):
        group = []
        for k in (0, 1):
            first = at[k]
            while at[k] < len(ends[k]) and ends[k][at[k]] <= cut:
                at[k] += 1
            group.append(ids[k][first : at[k]])
        groups.append(tuple(group))
    return groups


def brute_alignment(docs, tools):
    found = [(d, brute_groups(t, tools)) for d, t in docs]
    linked = [Counter((x, y) for a, b in g or [] for x in a for y in b) for _, g in found]
    counts = Counter(pair for c in linked for pair in c)
    best = Counter()
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for (d, g), c in zip(found, linked):
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g) if g else None
        sums = sum(c.values()), sum(n for p, n in c.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in c.items())
        out.append((d, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), *sums, hashlib.sha256(said.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


HARD = ["héllo 你ᚠ <s> x <|endoftext|> y", "  a  b \n c  ", " ", "▁x ok", "a b 　c", "x\x00y", "\x1c a \x1f b", "🙂🙂 ᚠᚠ ᚠ", " <0x41> ok", "it's word*** (well...) éa²! x>y a_b", None, ""]
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_equals_brute_force(spark, tokenizers):
    got = sorted((tuple(r[c] for c in COLUMNS) for r in queries.op13_alignment(spark, MEDIUM).collect()), key=str)
    assert got == brute_alignment(docs_of(spark, MEDIUM), tokenizers)


@pytest.mark.parametrize("most", [1_000_000, 40, 0])
def test_alignment_of_hard_texts_whatever_is_looked_up(spark, tokenizers, most):
    docs = [(i % 9, t) for i, t in enumerate(HARD * 2)] + [(None, "the same, the same"), (None, "word " * 30_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"pairs": F.lit(1), "row": F.lit("x")})
    got = sorted((tuple(r[c] for c in COLUMNS) for r in scored_alignment(frame, A_FILE, B_FILE, most).collect()), key=str)
    assert got == brute_alignment(docs, tokenizers)


def test_alignment_keeps_few_words_and_odd_rows(spark, tokenizers):
    aligner, texts = Aligner(A_FILE, B_FILE, most=3), [t or "" for t in HARD] + ["plain words here, and more words!"]
    for t in texts * 2:
        counts, digests, *_ = aligner.texts([t])
        groups = brute_groups(t, tokenizers)
        assert counts[0, 2] == len(groups or []) and bool(digests[0]) == bool(groups)
    assert len(aligner.known.groups) == len(aligner.known.number) <= 3
    assert scored_alignment(odd_rows(spark, []), A_FILE, B_FILE).count() == 0
    assert scored_alignment(odd_rows(spark, ODD), A_FILE, B_FILE).count() == len(ODD)


def test_benchmark_words_are_letters_and_digits_of_any_alphabet(spark):
    from quadloom.llm.decontaminate import contaminated_pairs, plain_words

    plain, dressed = '"the" "quick" brown-fox jumps over été 42 Straße', "“The” «quick» brown—fox… jumps_over… été·42 Straße"
    assert plain_words(plain).tolist() == plain_words(dressed).tolist() and len(plain_words(plain)) == 9
    docs = spark.createDataFrame([(1, f"x {dressed} y"), (2, "nothing of it")], "doc_id long, text string")
    found = contaminated_pairs(docs, spark.createDataFrame([(7, plain)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.matched_words) for r in found] == [(1, 7, 9)]


def test_mixing_keeps_columns_of_any_name(spark):
    from quadloom.llm.mixing import mix_sources, repeat_by_source

    docs = spark.createDataFrame([(k, "a" if k % 3 else None, "some words here", "x", 5, "z") for k in range(9)], "doc_id long, source string, text string, `a.b` string, Epoch int, `c``d` string")
    assert repeat_by_source(docs).columns == docs.columns and repeat_by_source(docs).count() >= 9
    mixed = mix_sources(docs)
    assert [c for c in mixed.columns if c.lower() == "epoch"] == ["epoch"] and {r["a.b"] for r in mixed.collect()} == {"x"}
