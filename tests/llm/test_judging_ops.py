"""Decontamination, mixing, personal data, toxicity, quality rules and chat formatting."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from quadloom.llm import queries
from quadloom.llm.chat import format_chats, loss_text
from quadloom.llm.decontaminate import contaminated_pairs, drop_contaminated, plain_words, tiles
from quadloom.llm.hashing import hashed_rows
from quadloom.llm.mixing import mix_sources
from quadloom.llm.pii import base_spans, entity_of, find_personal_data, sanitised
from quadloom.llm.quality import js_distance, judge_quality
from quadloom.llm.toxicity import Restorer, _trigrams, score_toxicity

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


ODD_SCHEMA = "doc_id long, text string, lang string, source string, epoch string, tiles int, kept string, spans string"
ODD = [(1, None, None, None, "x", 1, None, None), (2, "", "en", "s", None, 1, "k", "s"), (None, "alone here", "en", "s", None, None, None, None)] + [(5, "a b c", None, None, "e", 2, "k", "s")] * 2 + [(8, "long " * 5000, "de", "s", None, 1, None, None)]


def odd(spark, rows=ODD):
    return spark.createDataFrame(rows, ODD_SCHEMA)


def brute_tiles(item, doc, least):
    """Greedy tiling by trying every pair of places, again and again."""
    used_i, used_d, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in used_i and j + n not in used_d:
                    n += 1
                best = max(best, (n, -i, -j))
        if best[0] < least:
            return sorted(out)
        n, i, j = best[0], -best[1], -best[2]
        out.append((i, j, n))
        used_i.update(range(i, i + n))
        used_d.update(range(j, j + n))


def coded(words):
    return np.array([hash(w) % (1 << 64) for w in words], np.uint64)


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(1)
    for k in range(150):
        item, doc = rng.choice(list("abc")[: 2 + k % 2], 14).tolist(), rng.choice(list("abc"), 25).tolist()
        assert sorted(tiles(coded(item), coded(doc), 3)) == brute_tiles(item, doc, 3)


def test_tiles_of_one_repeated_word_stay_small():
    assert tiles(coded(["x"] * 500), coded(["x"] * 20_000), 5) == [(0, 0, 500)]


def brute_words(text):
    return re.findall("[0-9A-Za-z\u0080-\U0010ffff]+", (text or "").lower())


def brute_leaks(texts, items):
    """{(doc, item): words under tiles} where tiles cover half of the item; pairs with too few words in common are skipped."""
    out = {}
    for doc, text in texts.items():
        words = brute_words(text)
        held = Counter(words)
        for item, w in items.items():
            if 2 * (held & Counter(w)).total() >= len(w) >= 5:
                places = defaultdict(list)
                for j, x in enumerate(words):
                    places[x].append(j)
                if (n := sum(x for _, _, x in greedy(w, words, places, 5))) * 2 >= len(w):
                    out[doc, item] = n
    return out


def greedy(item, doc, places, least):
    """brute_tiles that only tries document places of the item's word."""
    used_i, used_d, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i, x in enumerate(item):
            for j in places.get(x, ()):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in used_i and j + n not in used_d:
                    n += 1
                best = max(best, (n, -i, -j))
        if best[0] < least:
            return out
        n, i, j = best[0], -best[1], -best[2]
        out.append((i, j, n))
        used_i.update(range(i, i + n))
        used_d.update(range(j, j + n))


def test_decontamination_equals_brute_force_and_blocks_agree(spark):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id, r.matched_words) for r in queries.op1_decontamination(spark, SMALL).collect()}
    assert got == {(r.doc_id, r.item_id, r.matched_words) for r in contaminated_pairs(docs, bench, block_bytes=2000).collect()}
    want = brute_leaks(texts_of(spark, SMALL), {r.item_id: brute_words(r.text) for r in bench.collect()})
    assert got == {(*pair, n) for pair, n in want.items()} and got


def test_word_hashes_follow_the_words():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    texts = [None, "", " ", "a", " a  b\t", "x" * 90 + " y", "\u00e9 \u00fc", *(" ".join(rng.choice(["aa", "bb", "c", "dd\n"], rng.integers(0, 40))) for _ in range(100))]
    for piece in (7, 64, 1 << 18):
        named, worded = {}, {}
        for text, hashes in zip(texts, hashed_rows(pa.array(texts), piece=piece), strict=True):
            for word, value in zip(WORDS.findall(text or ""), hashes.tolist(), strict=True):
                assert named.setdefault(word, value) == value and worded.setdefault(value, word) == word
    assert [len(h) for h in hashed_rows(pa.array(texts).slice(3, 4))] == [1, 2, 2, 2]


def test_reordered_passage_and_odd_rows(spark):
    item = " ".join(f"w{i}" for i in range(30))
    moved = " ".join(f"w{i}" for k in (20, 10, 0) for i in range(k, k + 10))
    docs = odd(spark, [*ODD, (20, "x y " + moved.upper(), "en", "s", None, 1, None, None), (21, " ".join(f"w{i}" for i in range(0, 30, 2)), "en", "s", None, 1, None, None)])
    bench = spark.createDataFrame([(1, item), (2, None), (3, "a b c")], "item_id long, text string")
    rows = contaminated_pairs(docs, bench).collect()
    assert [(r.doc_id, r.item_id, len(r.tiles)) for r in rows] == [(20, 1, 3)]
    assert drop_contaminated(docs, bench).count() == len(ODD) + 1
    assert contaminated_pairs(odd(spark, []), bench).count() == 0 and contaminated_pairs(docs, bench.limit(0)).count() == 0


def test_mixing_keeps_every_row_and_meets_the_limit(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").withColumn("source", __import__("pyspark.sql.functions", fromlist=["x"]).expr("case when doc_id % 3 = 0 then 'big' else source end"))
    out = mix_sources(docs, max_repetition=2.0).select("doc_id", "source", "epoch", "block_rank", "order_key").collect()
    copies = Counter(r.doc_id for r in out)
    assert set(copies) == set(texts_of(spark, MEDIUM)) and set(copies.values()) <= {1, 2}
    assert len({(r.source, r.epoch, r.block_rank, r.order_key, r.doc_id) for r in out}) == len(out)
    assert {r.epoch for r in out} == {0, 1}
    by_source = defaultdict(list)
    for r in out:
        by_source[r.source].append(copies[r.doc_id])
    assert max(by_source["big"]) == 1 and min(np.mean(v) for k, v in by_source.items() if k != "big") > 1.1
    orders = {e: [r.block_rank for r in sorted(out, key=lambda r: r.doc_id) if r.epoch == e and r.source == "src1"] for e in (0, 1)}
    assert orders[0] != orders[1]


def test_mixing_entropy_and_odd_rows(spark):
    rows = [(i, "w " * 10, "en", "a" if i % 10 else "b", None, 1, None, None) for i in range(400)]
    out = mix_sources(odd(spark, rows), max_repetition=8.0, target_entropy=0.9, blocks=8).groupBy("source").count().collect()
    p = {r["source"]: r["count"] / sum(x["count"] for x in out) for r in out}
    entropy = -sum(x * math.log(x) for x in p.values()) / math.log(2)
    assert abs(entropy - 0.9) < 0.05 and min(p.values()) > 0.2
    assert mix_sources(odd(spark)).count() >= len(ODD) and mix_sources(odd(spark, [])).count() == 0
    tiny = [(0, "one", "en", "tiny", None, 1, None, None)] + [(i, "w " * 100, "en", "big", None, 1, None, None) for i in range(1, 2001)]
    copies = Counter(r["source"] for r in mix_sources(odd(spark, tiny), max_repetition=4.0, target_entropy=1.0).collect())
    assert copies["big"] == 2000 and 1 <= copies["tiny"] <= 4


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits)))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(2)
    tried = ["a@b.c@d.e", "é.a@b-c.d..x@y.z_q@r.s", "@@a@b", "1.2.3.4.5.6.7.8.9", "300.1.1.1 1.1.1.300", "4111 1111 1111 1111", "4111-1111-1111-1111 5", "+1 (555) 123-4567.", "++49 30 1234567", "x" * 50 + "@" + "y" * 50, "00001.002.3.4", "5" * 3000]
    tried += ["".join(rng.choice(list("a1.@-+ ()é9_4"), rng.integers(1, 60))) for _ in range(4000)]
    for text in tried:
        assert base_spans(text) == brute_spans(text), text


def test_personal_data_of_documents(spark):
    texts = texts_of(spark, MEDIUM)
    found = queries.op4_personal_data(spark, MEDIUM).collect()
    assert len(found) == len(texts)
    for r in found:
        want = brute_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        kinds = Counter(k for k, _, _ in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)


def test_disclosing_terms(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 6))
    docs = [(i, f"{word()} the curator Zimmerfeld wrote from zim@museum.org today about {word()}") for i in range(6)]
    docs += [(100 + i, f"today the {word()} about {word()} wrote from {word()}") for i in range(60)]
    docs += [(200 + i, f"mail {word()} at u{i}@x.org about the {word()}") for i in range(20)]
    frame = spark.createDataFrame([*docs, (None, None), (300, "")], "doc_id long, text string")
    found = find_personal_data(frame)
    terms = {t for r in found.collect() if r.terms for t in [dict(docs)[r.doc_id][s["first"] : s["last"]] for s in r.terms]}
    assert terms == {"curator", "Zimmerfeld"}
    clean = {r.doc_id: r.text for r in sanitised(frame, found).collect()}
    assert "Zimmerfeld" not in clean[0] and "[EMAIL] today about" in clean[0] and clean[100] == dict(docs)[100] and len(clean) == len(docs) + 2
    assert find_personal_data(odd(spark, [])).count() == 0 and find_personal_data(odd(spark)).count() == len(ODD)


def test_entities_of_one_text_have_disclosing_terms(spark):
    docs = [(i, f"plain words about the day number {i}") for i in range(2000)] + [(5000 + k, "the day of Brandlhuber, reached by anna@b.org about the words") for k in range(9)]
    found = find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).filter("size(terms) > 0").collect()
    assert {dict(docs)[r.doc_id][t.first : t.last] for r in found for t in r.terms} == {"Brandlhuber", "reached"} and len(found) == 9
    assert queries.op4_personal_data(spark, "/root/testdata/sf0.1").filter("spans like '%term:%'").count() > 0


def test_every_place_of_a_disclosing_term(spark):
    far = " ".join(f"common{chr(97 + k % 20)}" for k in range(300))
    docs = [(i, f"number {far} as in text {i}") for i in range(60)] + [(60 + i, f"Wiesengrund {far} is at w@y.org {far} {i} again WIESENGRUND") for i in range(4)]
    docs += [(70, "Wiesengrund alone"), (71, None)]
    frame = spark.createDataFrame([*docs, docs[61]], "doc_id long, text string")
    found = find_personal_data(frame)
    places = Counter((r.doc_id, dict(docs)[r.doc_id][t.first : t.last]) for r in found.collect() for t in r.terms)
    assert places == {(60 + i, w): 1 + (i == 1) for i in range(4) for w in ("Wiesengrund", "again", "WIESENGRUND")}
    clean = sanitised(frame, found).collect()
    assert len(clean) == len(docs) + 1 and {r.doc_id for r in clean if "wiesengrund" in r.text.lower()} == {70}


def brute_disclosing(docs, prior=1.0, generalise=0.85, remove=0.95):
    """(doc_id, first, last, action) by trying every entity against every term of its texts."""
    texts = {t for _, t in docs}
    spans = {t: brute_spans(t or "") for t in texts}
    who, what = {t: {entity_of(k, t[a:b]) for k, a, b in spans[t]} for t in texts}, {}
    for t in texts:
        places = [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W\d_]{3,}", t or "")]
        what[t] = [(w, a, b) for w, a, b in places if not any(x < b and a < y for _, x, y in spans[t])]
    copies, df_e, df_t, told = Counter(t for _, t in docs), Counter(e for t in texts for e in who[t]), Counter(), {}
    for _, t in docs:
        df_t.update({m[0].lower() for m in re.finditer(r"[^\W\d_]{3,}", t or "")})
    beside = {t: {w for w, _, _ in what[t]} for t in texts}
    for e in df_e:
        for w in set().union(*(beside[t] for t in texts if e in who[t])):
            both = [t for t in texts if e in who[t] and w in beside[t]]
            chance = len(both) / (df_t[w] - sum(copies[t] for t in both) + len(both) + prior)
            share = math.log2(len(texts) * chance / df_e[e]) / max(math.log2(len(texts) / df_e[e]), 1e-9)
            if share >= generalise:
                for t in both:
                    told[t, w] = max(told.get((t, w), ""), "remove" if share >= remove else "generalise")
    return sorted((i, a, b, told[t, w]) for i, t in docs for w, a, b in what[t] if (t, w) in told)


def test_disclosing_terms_equal_all_pairs(spark):
    rng = np.random.default_rng(8)
    for size, vocabulary in ((120, 400), (300, 2000)):
        words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(vocabulary)]
        some = lambda few: [words[int(k)] for k in np.minimum(rng.zipf(1.3, few), vocabulary) - 1]
        docs = []
        for i in range(size):
            addresses = [f"u{int(k)}@x.org" for k in rng.integers(0, 25, int(rng.integers(0, 4)))]
            docs.append((i, " ".join(rng.permutation([*some(20), *addresses])) if i % 9 else None if i % 2 else docs[i - 1][1] if i else ""))
        docs += [(size + k, docs[7][1]) for k in range(5)]
        found = find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        got = sorted((r.doc_id, t["first"], t["last"], t["action"]) for r in found for t in r.terms or ())
        assert got == brute_disclosing(docs) and got


def test_thousands_of_entities_and_terms_in_one_text(spark):
    text = lambda x: " ".join([*(f"a{x}{k}@b{k}.org" for k in range(1500)), *(f"w{x}" + "".join(chr(97 + int(c)) for c in str(k)) for k in range(8000))])
    docs = [(1, text("x")), (2, text("y"))] + [(10 + k, f"plain {k}") for k in range(200)]
    found = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found[1].n_email == found[2].n_email == 1500 and len(found[1].terms) == len(found[2].terms) == 8000 and not found[10].terms


def test_small_corpora_have_disclosing_terms(spark):
    assert queries.op4_personal_data(spark, MEDIUM).filter("spans like '%term:%'").count() > 0


def test_viterbi_restores_disguised_words(spark):
    texts = list(texts_of(spark, MEDIUM).values())
    import pyarrow as pa

    from quadloom.llm.toxicity import SYMBOLS

    batch = next(iter(_trigrams(iter([pa.RecordBatch.from_arrays([pa.array([*texts, *["idiot stupid moron trash worthless"] * 300])], ["text"])]))))
    counts = np.full(SYMBOLS**3, 0.1)
    counts[batch.column("trigram").to_numpy()] += batch.column("n").to_numpy()
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    restorer = Restorer(np.log(counts / counts.sum(axis=2, keepdims=True)))
    for text, want in {"an 1d10t here": "an idiot here", "a stuuuupid one": "a stupid one", "you i d i o t now": "you idiot now", "m0r0n.": "moron.", "tr@sh": "trash", "$tupid": "stupid", "Plain words, 12 of them!": "plain words, 12 of them!", "i.d.i.o.t": "idiot"}.items():
        assert restorer.restore(text) == want


def auc(rows):
    pos, neg = ([s for s, y in rows if y == v] for v in (1, 0))
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_the_fast_test_changes_no_reading():
    """No text that it clears would be changed by decoding, whatever stands beside it."""
    rng = np.random.default_rng(12)
    restorer = Restorer(np.log(rng.dirichlet(np.ones(27), (27, 27))))
    for text in ("sh!7", "sh|7", "foo!1", "t!7", "s!$.", "ш!7ж", "a²²²b", "x#!(1", "what? (12) no!"):
        assert restorer.restore(text) == restorer.decoded(text.lower()), text
    signs = list("abst0123456789@$!|+(*#. -_?,éßшж²½\n")
    for alphabet in (signs, list("ab!(#|17 "), list("aé . -_b"), list("?aш!3 ")):
        for _ in range(20_000):
            text = "".join(rng.choice(alphabet, int(rng.integers(1, 12)))).lower()
            assert restorer.restore(text) == restorer.decoded(text), text


def test_toxicity_on_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = queries.op5_toxicity(spark, "/root/testdata/sf0.1").collect()
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    wrong = sum((s >= 0.5) != y for s, y in held)
    assert auc(held) > 0.9 and wrong < 0.04 * len(held), (auc(held), wrong, len(held))


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    assert score_toxicity(odd(spark), labels).count() == len(ODD) and score_toxicity(odd(spark, []), labels).count() == 0


def brute_base(text):
    w = WORDS.findall(text)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_base_equals_brute_force_and_clean_rows_stay(spark):
    texts = texts_of(spark, MEDIUM)
    rows = queries.op7_quality(spark, MEDIUM).collect()
    for r in rows:
        want = brute_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and (not r.kept or not r.base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    judged = [(r.kept, labels[r.doc_id]) for r in rows if r.doc_id in labels and not r.base_failed]
    assert np.mean([k for k, q in judged if q == 1]) > 0.99 and np.mean([k for k, q in judged if q == 0]) < 0.5


def test_quality_odd_rows(spark):
    assert judge_quality(odd(spark, [])).count() == 0
    rows = judge_quality(odd(spark)).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows) and {r.n_repeat_words for r in rows if r.doc_id == 8} == {5000}


def test_js_distance(spark):
    row = spark.sql("select array(1.0D, 0.0D) a, array(0.0D, 1.0D) b, array(0.5D, 0.5D) c").select(js_distance(*map(__import__("pyspark").sql.functions.col, "ab")).alias("ab"), js_distance(*map(__import__("pyspark").sql.functions.col, "aa")).alias("aa")).first()
    assert row.ab == pytest.approx(1.0) and row.aa == 0


def test_chat_round_trip(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "50% <| %3C| %253C|", "<|im_esc|>", "", None, "line\nbreak", "<", "|im_end|>", "%0A"]
    rows = [(k % 3, k, ["user", "assistant", "<|im_start|>", "a\nb", None][k % 5], t) for k, t in enumerate(hard * 4)] + [(7, 0, "user", "same"), (7, 0, "user", "same"), (None, 1, "assistant", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in format_chats(frame).withColumn("loss", loss_text(__import__("pyspark").sql.functions.col("segments"))).collect()}
    for conv, r in out.items():
        want = [(role or "", text or "") for c, _, role, text in sorted((x for x in rows if x[0] == conv), key=lambda x: x[1])]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
    assert out[7].formatted == "<|im_start|>user\nsame<|im_end|>\n" * 2
    assert format_chats(frame.limit(0)).count() == 0


def test_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{MEDIUM}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        want = con.execute(sql).fetchdf()
        got = queries.QUERIES[name](spark, MEDIUM).toPandas()
        assert sorted(want.columns) == sorted(got.columns), name
        cols = sorted(want.columns)
        assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].itertuples(index=False, name=None))), name
