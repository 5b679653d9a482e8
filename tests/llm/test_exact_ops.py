"""Sharding, token counts, span dedup and the n-gram join against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quadloom.llm import queries
from quadloom.llm.components import components
from quadloom.llm.ngram_join import grow_tree, near_duplicate_classes, posted_count, traverse, tree_links
from quadloom.llm.sharding import assign_shards
from quadloom.llm.substring_dedup import remove_repeated_spans
from quadloom.llm.tokens import PrefixCounter, longest_prefix, prefix_token_counts

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def docs_of(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def odd_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n long, shard string")


ODD = [(1, None, 1, "x"), (2, "", 2, None), (None, "alone", 3, "y"), (5, "a b c", 4, "z"), (5, "a b c", 4, "z"), (7, " \n\t ", None, None), (8, "long " * 5000, 1, "q")]


def brute_dedup(docs, width):
    words = [WORDS.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_span_dedup_equals_brute_force(spark):
    want = brute_dedup(docs_of(spark, MEDIUM), 35)
    got = [tuple(r) for r in queries.op3_substring_dedup(spark, MEDIUM).collect()]
    assert sorted(got, key=str) == want
    assert sum(r[2] for r in got) > 0


@pytest.mark.parametrize("width,seed", [(6, 3), (4, 4), (5, 1)])
def test_span_dedup_on_random_words(spark, width, seed):
    rng = np.random.default_rng(width)
    docs = [(i, " ".join(rng.choice(list("abc"), rng.integers(0, 60)))) for i in range(60)] + [(900, "x y z " * 30), (901, None), (901, None), (902, "p q r s t u v"), (902, "p q r s t u v")]
    got = remove_repeated_spans(spark.createDataFrame(docs, "doc_id long, text string"), width, seed, with_text=True)
    rows = got.collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=str) == brute_dedup(docs, width)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in rows)
    assert all(sum(s["last"] - s["first"] for s in r.spans) == r.n_removed for r in rows)


def test_span_dedup_odd_rows(spark):
    assert remove_repeated_spans(odd_rows(spark, []), 35).count() == 0
    got = remove_repeated_spans(odd_rows(spark, ODD), 2, 1)
    assert sorted(((r.doc_id, r.n_removed) for r in got.collect()), key=str) == sorted([(1, 0), (2, 0), (None, 0), (5, 3), (5, 3), (7, 0), (8, 5000)], key=str)


def shingles(text, k=5):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute_join(docs, percent=80):
    sets = {d: shingles(t) for d, t in docs}
    index, parent = {}, {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = set()
    for d, s in sets.items():
        for g in s:
            index.setdefault(g, []).append(d)
    for ds in index.values():
        pairs.update((a, b) for i, a in enumerate(ds) for b in ds[i + 1 :])
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return sorted((d, len(s), root(d)) for d, s in sets.items())


def test_ngram_join_equals_brute_force(spark):
    want = brute_join(docs_of(spark, MEDIUM))
    got = sorted(tuple(r) for r in queries.op8_ngram_join(spark, MEDIUM).collect())
    assert got == want
    assert any(c != d for d, _, c in got)


@pytest.mark.parametrize("chunk", [3, 4000])
def test_ngram_join_of_many_near_copies(spark, chunk):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(150):
        words = list(base) if i % 3 else [f"v{j}" for j in range(100)] + base[:20]
        for _ in range(int(rng.integers(0, 5))):
            words[int(rng.integers(0, len(words)))] = f"e{rng.integers(0, 40)}"
        docs.append((1000 - i, " ".join(words)))
    docs += [(1, "Same five words are here"), (2, "same FIVE words are here"), (3, "too short"), (4, "Too short"), (5, None), (6, "  ")]
    got = near_duplicate_classes(spark.createDataFrame(docs, "doc_id long, text string"), chunk=chunk)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_join(docs)


def test_ngram_join_odd_rows(spark):
    assert near_duplicate_classes(odd_rows(spark, [])).count() == 0
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicate_classes(odd_rows(spark, ODD)).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (None, 1, None), (5, 1, 5), (5, 1, 5), (7, 0, 7), (8, 1, 8)], key=str)


def test_tree_traversal_misses_no_pair():
    rng = np.random.default_rng(3)
    sets = [set(rng.choice(60, rng.integers(5, 30), replace=False).tolist()) for _ in range(80)]
    sets += [s | {99} for s in sets[:20]]
    posted = [sorted(s)[: posted_count(len(s), 80)] for s in sets]
    bits = lambda xs, size: sum({1 << (x % size): 0 for x in xs})
    rows = [(i, len(s), i, bits(s, 32), bits(p, 64)) for i, (s, p) in enumerate(zip(sets, posted))]
    root = grow_tree(rows, 80)
    found = {(x[0], y[0]) for x, y in traverse(root, root, 80)}
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert want <= found and len(found) < len(sets) * (len(sets) - 1) // 2


def test_tree_links_join_what_is_linked():
    rng = np.random.default_rng(9)
    base = np.sort(rng.choice(1 << 40, 200, replace=False))
    sets = {k: np.sort(np.concatenate((rng.choice(base, 185, replace=False), rng.choice(1 << 40, int(rng.integers(0, 25)))))) for k in range(1, 90)}
    rows = [(k, s[: posted_count(len(s), 80)], s[posted_count(len(s), 80) :]) for k, s in sets.items()]
    links = tree_links(rows, 80)
    parent = {k: k for k in sets}

    def root(parent, x):
        while parent[x] != x:
            x = parent[x]
        return x

    def linked(a, b):
        same = len(set(sets[a].tolist()) & set(sets[b].tolist()))
        return 180 * same >= 80 * (len(sets[a]) + len(sets[b]))

    want = dict(parent)
    for a in sets:
        for b in sets:
            if a < b and linked(a, b):
                want[root(want, b)] = root(want, a)
    for a, b in links:
        parent[root(parent, b)] = root(parent, a)
    groups = lambda p: {frozenset(k for k in sets if root(p, k) == r) for r in {root(p, k) for k in sets}}
    assert groups(parent) == groups(want) and 1 <= len(links) < len(sets)


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 140)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shards(spark):
    rows = assign_shards(spark.read.parquet(f"{MEDIUM}/documents.parquet")).collect()
    texts = dict(docs_of(spark, MEDIUM))
    for shard in range(16):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) > 30
    moved = [r for r in rows if r.grown_shard != r.shard]
    assert 0 < len(moved) < 0.12 * len(rows) and {r.grown_shard for r in moved} == {16}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


def brute_shard(key, weights):
    """Rendezvous hashing by hand: the highest -weight / ln(u), the lower shard of equal ones."""

    def score(k, w):
        bits = int(hashlib.md5(f"{'null' if key is None else key}:{k}".encode()).hexdigest()[:13], 16)
        return -w / math.log((bits + 0.5) / (1 << 52))

    return max(range(len(weights)), key=lambda k: (score(k, weights[k]), -k))


def test_shards_equal_brute_force(spark):
    rows = queries.op6_sharding(spark, MEDIUM).collect()
    assert len(rows) == 1000
    for r in rows:
        assert (r.shard, r.grown_shard) == (brute_shard(r.doc_id, [1.0] * 16), brute_shard(r.doc_id, [1.0] * 17)), r
    weights = [1.0, 2.5, 0.5]
    for r in assign_shards(odd_rows(spark, ODD), 3, weights).collect():
        assert (r.shard, r.grown_shard) == (brute_shard(r.doc_id, weights), brute_shard(r.doc_id, [*weights, 1.0]))


def test_shards_keep_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "x", 7, 8)], "doc_id long, text string, _start string, _bin int, _place int")
    row = assign_shards(docs).first()
    assert (row._start, row._bin, row._place, row.slot) == ("x", 7, 8, 0)


def test_shards_weights_and_odd_rows(spark):
    rows = assign_shards(spark.range(4000).selectExpr("id as doc_id", "'t' as text"), 2, [3.0, 1.0]).collect()
    assert 2850 < sum(r.shard == 0 for r in rows) < 3150
    got = assign_shards(odd_rows(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r.size for r in got if r.doc_id in (1, 2)} == {1}
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got))) for s in range(16))
    assert assign_shards(odd_rows(spark, [])).count() == 0
    with pytest.raises(ValueError):
        assign_shards(odd_rows(spark, []), 2, [1.0])


@pytest.fixture(scope="module")
def piece_model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_every_prefix_count_equals_an_encoding(piece_model):
    import sentencepiece

    model, counter = sentencepiece.SentencePieceProcessor(model_file=piece_model), PrefixCounter(piece_model)
    texts = ["Hello  world\n\nfoo <s> x", " lead and trail  ", "été à Zürich — naïve 東京 🙂🙂 x\ty", "aaaaaaaaaaaaaaaaaaaaaaaa" * 5, "=" * 70 + "a" * 33, "<unk></s>▁ ▁▁x", "the thethe" * 9, "\x00́a�", "    " * 9]
    for text in texts:
        want = [len(model.encode(text[: i + 1])) for i in range(len(text))]
        assert counter.prefix_counts(text).tolist() == want, text
    counts = counter.prefix_counts(texts[0])
    assert longest_prefix(counts, 3) == max(i + 1 for i, c in enumerate(counts) if c <= 3)
    assert longest_prefix(counts, 0) == 0


def test_token_counts_of_documents(spark, piece_model):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    texts = dict(docs_of(spark, MEDIUM))
    for r in queries.op10_token_counts(spark, MEDIUM).collect():
        n = len(model.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)


def test_token_counts_odd_rows(spark, piece_model):
    assert prefix_token_counts(odd_rows(spark, []), piece_model).count() == 0
    got = {(r.doc_id, r.n_tokens, len(r.prefix_tokens)) for r in prefix_token_counts(odd_rows(spark, ODD), piece_model).collect()}
    assert {(1, 0, 0), (2, 0, 0)} <= got and all(n == 25000 for d, _, n in got if d == 8)
