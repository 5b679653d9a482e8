"""Personal data, and the terms that would reveal it, by information-theoretic sanitisation.

Four kinds of protected entities are found by pattern. Redacting them is not enough if the words around them tell who is
meant, so the corpus is asked: for an entity e and a term t, log2(N * c / (df(e) * (df(t) + prior))) says
how much of e's information log2(N / df(e)) the term discloses when both stand in c texts. A term that discloses at least
`generalise` of it becomes a placeholder, at least `remove` of it goes, wherever it stands in a text with e. No pair is dropped
for being rare, and the prior is the same in every corpus: one more text, in which t would stand without e.
c, df(e) and N count different texts, and df(t) takes copies of the pair's texts as one, so copies of one text prove nothing.

Only texts that hold an entity and one count per term are shuffled. A term can disclose e only if df(t) is at most
N^(1 - generalise) df(e)^generalise more than e's documents, so commoner terms of a text are left out before its terms
meet its entities: no pair that could disclose is lost, and no term of a third of all documents is a hot group unless an entity
is. Entities that stand in the same texts have the same counts, and so have terms with the same texts and df(t). Both are
grouped by a 128-bit digest of their texts (a sum, so no list is held), and only groups are paired: a text with thousands of
addresses and of words that occur nowhere else makes one pair.

A null text is empty. Rows are read one by one; repeated rows get the same spans; a null id is a value like any other. Spans
are in code points, end exclusive, of texts of any length. A term told by several entities is removed if any of them asks for
it. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.llm.shared import forget, measured_side, stored

KINDS = ("email", "ip", "card", "phone")
#: Possessive forms of the base patterns that find the same leftmost matches in linear time: a run of mailbox characters is
#: read as a whole with or without a domain behind it, and an address of numbers starts where a run of digits starts.
_EMAIL = regex.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)?")
_IP = regex.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = regex.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = regex.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = regex.compile(r"\p{L}{3,}")


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        at, place = 0, text.find("@")
        while place >= 0:  # only stretches of text that lead to an @ are searched
            start = max(at, place - 1)
            while start > at and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
                start -= 1
            at = place + 1
            for m in _EMAIL.finditer(text, start):
                if m.start() > place:
                    break
                if m[1]:
                    out.append(("email", *m.span()))
                    at = m.end()
                    break
            place = text.find("@", at)
    if any(map(text.__contains__, "0123456789")):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def entity_of(kind: str, value: str) -> str:
    """One name for every spelling of an entity."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _digits(value)}"


def outside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) for the terms outside all spans, by start."""
    taken, k = sorted((a, b) for _, a, b in spans), 0
    reached = 0  # end of the spans that start before the term
    for m in _TERM.finditer(text):
        a, b = m.span()
        while k < len(taken) and taken[k][0] < b:
            reached = max(reached, taken[k][1])
            k += 1
        if reached <= a:
            yield m[0].lower(), a, b


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _split(joined: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in joined.split(",") if x)]


_PLACE = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("action", pa.string())])


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, digests, joined, entities, held = [[] for _ in KINDS], [], [], [], []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text or "")
            for kind, col in zip(KINDS, counts):
                col.append(sum(k == kind for k, _, _ in spans))
            joined.append(_joined(spans))
            digests.append(hashlib.sha256(joined[-1].encode()).hexdigest())
            entities.append(sorted({entity_of(k, text[a:b]) for k, a, b in spans}))
            held.append(text if spans else None)
        arrays = [batch.column("doc_id"), batch.column("text_key"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(joined, pa.string()), pa.array(entities, pa.list_(pa.string())), pa.array(held, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text_key", *(f"n_{k}" for k in KINDS), "base_sha256", "base_spans", "entities", "held"])


def _count_terms(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """(term, df_t): documents by term, in parts of about `most` terms."""
    counts: Counter[str] = Counter()

    def part() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "df_t"])
        counts.clear()
        return out

    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts.update({t.lower() for t in set(_TERM.findall(text or ""))})
            if len(counts) >= most:
                yield part()
    yield part()


def _terms_of_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, term): the different terms outside the spans of each row that holds an entity, text by text."""
    for batch in batches:
        for key, text, joined in zip(*(batch.column(c).to_pylist() for c in ("text_key", "held", "base_spans"))):
            terms = sorted({t for t, _, _ in outside(text, _split(joined))})
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(terms), pa.int64()), pa.array(terms, pa.string())], names=["text_key", "term"])


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every place of the told terms."""
    for batch in batches:
        places = []
        for text, joined, told in zip(*(batch.column(c).to_pylist() for c in ("held", "base_spans", "told"))):
            actions = {t["term"]: t["action"] for t in told or ()}
            places.append([{"first": a, "last": b, "action": actions[t]} for t, a, b in outside(text, _split(joined)) if t in actions] if actions else [])
        kept = batch.select(["doc_id", "text_key", *(f"n_{k}" for k in KINDS), "base_sha256", "base_spans"])
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(places, pa.list_(_PLACE))], names=[*kept.schema.names, "terms"])


def _texts_digest(*more: str) -> Column:
    """A digest of the set of text_key values of a group, one row for each, and of the columns named."""
    sums = [F.bit_xor(F.xxhash64("text_key", F.lit(seed))).cast("string") for seed in (1, 2)]
    return F.unhex(F.md5(F.concat_ws(" ", F.count("*").cast("string"), *sums, *(F.first(c).cast("string") for c in more))))


def find_personal_data(docs: DataFrame, prior: float = 1.0, generalise: float = 0.85, remove: float = 0.95) -> DataFrame:
    """One row per row of docs (doc_id, text): counts and digest of the base spans, base_spans, terms (disclosing terms as
    array<struct<first, last, action>>) and spans (base, then term spans)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_key"))
    base = "doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base_spans string"
    found = stored(docs.mapInArrow(_detect, f"{base}, entities array<string>, held string"), "personal")
    held = found.filter("held is not null")
    n = F.lit(float(found.select("text_key").distinct().count()))
    copies = held.groupBy("text_key").agg(F.count("*").alias("docs"))
    named = stored(held.select("text_key", F.explode("entities").alias("entity")).distinct().join(copies, "text_key"), "named")
    sizes = named.groupBy("entity").agg(_texts_digest().alias("who"), F.count("*").alias("df_e"), F.sum("docs").alias("docs_e"))
    limit = F.pow(n, F.lit(1 - generalise)) * F.pow("df_e", F.lit(generalise)) + F.col("docs_e")
    sizes = stored(sizes.select("entity", "who", "df_e", limit.alias("limit")), "entities")
    groups = stored(named.join(measured_side(sizes), "entity").select("text_key", "who", "df_e", "limit", "docs").distinct(), "groups")
    counted = stored(docs.select("text").mapInArrow(_count_terms, "term string, df_t long").groupBy("term").agg(F.sum("df_t").alias("df_t")), "counted")
    most = sizes.agg(F.max("limit")).first()[0] or 0.0
    # at most a thousand times the terms of a document are commoner than this; without them no term is a hot key
    common = stored(counted.filter(F.col("df_t") > F.greatest(F.lit(most), n / 1000)).select("term"), "common")
    rare = stored(counted.filter(F.col("df_t") <= most), "rare")
    has = held.select("text_key", "held", "base_spans").mapInArrow(_terms_of_held, "text_key long, term string")
    terms = stored(has.join(measured_side(common), "term", "left_anti").join(measured_side(rare), "term").distinct(), "terms")
    alike = stored(terms.groupBy("term").agg(_texts_digest("df_t").alias("what")), "alike")
    has = terms.join(measured_side(alike), "term")
    pairs = has.select("text_key", "what", "df_t").distinct().join(groups.hint("merge"), "text_key").filter(F.col("df_t") <= F.col("limit"))
    pairs = stored(pairs.drop("limit"), "pairs")
    sums = pairs.groupBy("who", "what").agg(F.sum("docs").alias("c"), F.count("*").alias("texts"), F.first("df_e").alias("df_e"), F.first("df_t").alias("df_t"))
    chance = F.col("texts") / (F.col("df_t") - F.col("c") + F.col("texts") + prior)
    told = sums.withColumn("share", F.log2(n * chance / F.col("df_e")) / F.greatest(F.log2(n / F.col("df_e")), F.lit(1e-9)))
    told = stored(told.filter(F.col("share") >= generalise).select("who", "what", F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("action")), "disclosing")
    hits = pairs.select("who", "what", "text_key").join(measured_side(told), ["who", "what"]).groupBy("text_key", "what").agg(F.max("action").alias("action"))
    hits = has.select("text_key", "term", "what").join(hits.hint("merge"), ["text_key", "what"])
    hits = stored(hits.groupBy(F.col("text_key").alias("_key")).agg(F.collect_list(F.struct("term", "action")).alias("told")), "told")
    forget(named, sizes, groups, counted, common, rare, terms, alike, pairs, told)
    placed = held.drop("entities").join(measured_side(hits), held["text_key"] == hits["_key"], "left").drop("_key").mapInArrow(_place, f"{base}, terms array<struct<first:int,last:int,action:string>>")
    none = F.array().cast("array<struct<first:int,last:int,action:string>>")
    out = placed.unionByName(found.filter("held is null").drop("entities", "held").withColumn("terms", none))
    extra = F.transform("terms", lambda t: F.concat(F.lit("term:"), t["first"].cast("string"), F.lit(":"), t["last"].cast("string")))
    spans = F.array_join(F.concat(F.when(F.col("base_spans") != "", F.array("base_spans")).otherwise(F.array().cast("array<string>")), extra), ",")
    return out.select("doc_id", "text_key", *(f"n_{k}" for k in KINDS), "base_sha256", "base_spans", "terms", spans.alias("spans"))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, base, terms in zip(*(batch.column(c).to_pylist() for c in ("text", "base_spans", "terms"))):
            cuts = [(int(a), int(b), f"[{k.upper()}]") for k, a, b in (s.split(":") for s in base.split(",") if s)]
            cuts += [(t["first"], t["last"], "[TERM]" if t["action"] == "generalise" else "") for t in terms]
            out, at = [], 0
            for a, b, new in sorted(cuts):
                if a >= at:
                    out += [(text or "")[at:a], new]
                    at = b
            texts.append("".join(out) + (text or "")[at:])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def sanitised(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text) with spans of find_personal_data replaced: [KIND], [TERM], or nothing for removed terms. Where spans of
    two kinds overlap, the one that starts first is replaced."""
    spans = found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "base_spans", "terms").dropDuplicates(["_id", "_key"])
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    both = both.join(spans, both["doc_id"].eqNullSafe(spans["_id"]) & (F.xxhash64(both["text"]) == spans["_key"])).select("doc_id", "text", "base_spans", "terms")
    return both.mapInArrow(_write, "doc_id long, text string")
