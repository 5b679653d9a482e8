"""Toxicity of texts whose words may be disguised: a noisy channel is undone, then the restored text is scored.

1. A character trigram model is counted over every document of the corpus (27 symbols: a boundary and 26 letters; accents
   are folded), one small count table per task, summed in Spark.
2. Suspicious stretches - digits or signs in words, letters drawn out, three or more single letters with gaps, each of any
   length - become lattices: each position offers the letters it may stand for, at a channel cost, and a gap may close. Viterbi
   decoding under the trigram model picks the likeliest reading. Everything else is left as it is, so plain text costs one
   pattern search.
3. Words of the restored text, and their beginnings, are scored by a lexicon learnt from labelled documents: the share of
   toxic documents among those that hold the feature, shrunk towards the base rate. The score is the noisy-or of a text's
   three strongest words; a text without any gets a small constant.

Learning uses at most `max_training` labelled rows (those with the lowest hash of their id), and never a row that is held
out. Scores use the text alone.

A null or empty text gets the constant; rows are scored one by one; null ids are held out as the empty string would be;
a label given twice counts as toxic if any is; without labels the lexicon is empty. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = 27
#: What each sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "#": "aeiou"}
_SIGNS = re.escape("".join(LEET))
#: A maximal run of word characters and signs that holds a sign; possessive, so that runs of any length take linear time.
_SIGNED = re.compile(rf"(?<![\w{_SIGNS}])[^\W01345789]*+[{_SIGNS}][\w{_SIGNS}]*+")
#: Signs that end a word as punctuation; they are cut off before a word is decoded.
_ENDING = "!(#|"
_DRAWN = re.compile(r"(?<![^\W\d_])[^\W\d_]*?([^\W\d_])\1{2,}[^\W\d_]*")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_UNIT = rf"[^\W\d_]|[{_SIGNS}]"
_AFTER = rf"[^\W_]|[{_SIGNS.replace(re.escape('*'), '')}]"
#: Three or more single letters or signs with gaps between them, as many as there are.
_GAPS = re.compile(rf"(?<![\w{_SIGNS}])(?:{_UNIT})(?:[ .\-_*]{{1,2}}(?:{_UNIT})(?!{_AFTER})){{2,}}+")
_WORD = re.compile(r"[^\W\d_]+")
CHANNEL = {"same": 0.0, "stands_for": -0.5, "kept_sign": -4.0, "kept_star": -1.0, "closed_gap": -0.5, "kept_gap": -1.0, "shortened": -0.3}
BASELINE = 0.02


def _code_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for b in range(256):
        c = unicodedata.normalize("NFD", bytes([b]).decode("latin-1").lower())[0]
        table[b] = ord(c) - 96 if "a" <= c <= "z" else 0
    return table


_CODES = _code_table()


def _kind_table(unknown: bool) -> np.ndarray:
    """Bits of each Latin-1 character of a lower-case text: 1 letter, 2 digit or sign that no punctuation is, 4 sign, 8 letter or
    sign other than *, 16 sign that is punctuation at the end of a word. `unknown`: a question mark stands for any letter."""
    table = np.zeros(256, np.uint8)
    for b in range(256):
        c = bytes([b]).decode("latin-1")
        letter = bool(_WORD.match(c)) or c.isalpha() or unknown and c == "?"
        table[b] = letter + 2 * (c in "0123456789@$+") + 4 * (c in LEET) + 8 * (letter or c in LEET and c != "*") + 16 * (c in _ENDING)
    return table


_KINDS = {unknown: _kind_table(unknown) for unknown in (False, True)}
_LETTER_ENDING = re.compile(rf"[^\W\d_][{re.escape(_ENDING)}]++[01345789@$+]")


def may_be_disguised(text: str) -> bool:
    """A fast test of a lower-case text; where it says no, decoding would change nothing. A signed stretch is decoded only if it
    holds a sign before a letter, a digit or @$+ behind a letter, or one of these behind a letter and signs of punctuation; a
    drawn one holds a letter three times; one with gaps holds single letters two or three places apart. Texts with a * are never
    cleared, and characters outside Latin-1 count as letters."""
    raw = np.frombuffer(text.encode("latin-1", "replace"), np.uint8)
    if len(raw) < 3:
        return False
    kind = _KINDS[not text.isascii()][raw]
    letter = (kind & 1) != 0
    if (((kind[:-1] & 4) != 0) & letter[1:]).any() or (letter[:-1] & ((kind[1:] & 2) != 0)).any() or b"*" in raw.tobytes():
        return True
    if (((kind[:-1] & 16) != 0) & ((kind[1:] & 2) != 0)).any() and _LETTER_ENDING.search(text):
        return True
    same = raw[1:] == raw[:-1]
    if (same[1:] & same[:-1] & letter[2:]).any():
        return True
    unit = np.concatenate(([False], (kind & 8) != 0, [False]))
    alone = unit[1:-1] & ~unit[:-2] & ~unit[2:]
    return bool((alone[:-2] & alone[2:]).any() or (alone[:-3] & alone[3:]).any())


def words_in(text: str) -> set[str]:
    """Distinct runs of letters."""
    out: set[str] = set()
    for token in set(text.split()):
        if token.isalpha():
            out.add(token)
        else:
            out.update(_WORD.findall(token))
    return out


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            if text:
                code = _CODES[np.frombuffer(b" " + text.encode("latin-1", "replace") + b" ", np.uint8)].astype(np.int64)
                code = code[np.concatenate(([True], (code[1:] != 0) | (code[:-1] != 0)))]
                if len(code) > 2:
                    counts += np.bincount((code[:-2] * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:], minlength=len(counts))
    full = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(counts[full])], names=["trigram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) as an array [a, b, c]; at most SYMBOLS ** 3 sums reach the driver, whatever the corpus."""
    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_trigrams, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full(SYMBOLS**3, 0.1)
    counts[sums["trigram"].to_numpy(np.int64)] += sums["n"].to_numpy(np.float64)
    counts = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    return np.log(counts / counts.sum(axis=2, keepdims=True))


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """For each position of a lower-case stretch, the strings it may stand for and their channel costs."""
    out: list[list[tuple[str, float]]] = []
    gaps = bool(_GAPS.fullmatch(stretch))
    k = 0
    while k < len(stretch):
        c, run = stretch[k], 1
        while k + run < len(stretch) and stretch[k + run] == c:
            run += 1
        if gaps and c in " .-_*":
            out.append([("", CHANNEL["closed_gap"]), (" ", CHANNEL["kept_gap"])])
            k += run
        elif c in LEET:
            kept = CHANNEL["kept_star" if c == "*" and k == len(stretch) - 1 else "kept_sign"]
            out.append([(x, CHANNEL["stands_for"]) for x in LEET[c]] + [(c, kept)])
            k += 1
        elif run >= 3:
            out.append([(c, CHANNEL["shortened"]), (c * 2, CHANNEL["shortened"])])
            k += run
        else:
            out += [[(c, CHANNEL["same"])]] * run
            k += run
    return out


class Restorer:
    """Viterbi decoder of lattices; keeps up to `most` decoded stretches."""

    def __init__(self, model: np.ndarray, most: int = 100_000):
        self.model, self.most, self.known = model.tolist(), most, {}

    @staticmethod
    def symbol(c: str) -> int:
        c = unicodedata.normalize("NFD", c)[0]
        return ord(c) - 96 if "a" <= c <= "z" else 0

    def decode(self, stretch: str) -> str:
        known = self.known.get(stretch)
        if known is None:
            if len(self.known) >= self.most:
                self.known.clear()
            states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
            for choices in [*lattice(stretch), [(" ", 0.0)]]:
                following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
                for (a, b), (score, path) in states.items():
                    for text, cost in choices:
                        x, y, total = a, b, score + cost
                        for c in text:
                            z = self.symbol(c)
                            if z or y:
                                total += self.model[x][y][z]
                                x, y = y, z
                        best = following.get((x, y))
                        if best is None or total > best[0]:
                            following[(x, y)] = (total, (text, path))
                states = following
            path, read = max(states.values(), key=lambda state: state[0])[1], []
            while path is not None:
                read.append(path[0])
                path = path[1]
            known = "".join(reversed(read)).strip()
            if len(stretch) <= 100:  # longer ones are rare and would fill the table
                self.known[stretch] = known
        return known

    def _signed(self, found: re.Match) -> str:
        core = found[0].rstrip(_ENDING)
        plain = [c for c in core if c not in LEET]
        if len(core) < 3 or len(plain) == len(core) or not plain or not "".join(plain).isalpha():
            return found[0]
        return self.decode(core) + found[0][len(core) :]

    def _gaps(self, found: re.Match) -> str:
        return self.decode(found[0]) if sum(c.isalpha() for c in found[0]) >= 2 else found[0]

    def restore(self, text: str) -> str:
        """The text in lower case with its suspicious stretches decoded."""
        text = text.lower()
        return self.decoded(text) if may_be_disguised(text) else text

    def decoded(self, text: str) -> str:
        text = _SIGNED.sub(self._signed, _GAPS.sub(self._gaps, text))
        return _DRAWN.sub(lambda m: self.decode(m[0]), text) if _TRIPLE.search(text) else text


def features(word: str) -> list[str]:
    """A word and its beginnings of 3 to 8 letters (marked with a bar)."""
    return [word, *(f"{word[:k]}|" for k in range(3, min(9, len(word))))]


def _all_features(text: str, restorer: Restorer) -> set[str]:
    return {f for w in words_in(restorer.restore(text)) for f in features(w)}


def _count_features(shared, most: int = 200_000):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, counts = Restorer(shared.value), (Counter(), Counter())

        def tables() -> Iterator[pa.RecordBatch]:
            for toxic, held in enumerate(counts):
                n, none = pa.array(list(held.values()), pa.int64()), pa.array(np.zeros(len(held), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), n if toxic else none, none if toxic else n], names=["feature", "hits", "misses"])
                held.clear()

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                if text and toxic in (0, 1):
                    counts[toxic].update(_all_features(text, restorer))
                if len(counts[0]) + len(counts[1]) > most:
                    yield from tables()
        yield from tables()

    return count


def learn_lexicon(docs: DataFrame, labels: DataFrame, model, max_training: int, min_toxic: int = 4, shrink: float = 2.0, min_share: float = 0.8) -> dict[str, float]:
    """Feature -> share of toxic documents among its documents, from labelled rows that are not held out. Only features that
    reach min_share come to the driver; a word's beginning stays only if it holds without the documents that a stronger,
    longer feature explains."""
    known = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_training)
    sample = docs.join(F.broadcast(known), "doc_id").select("text", "toxic")  # max_training narrow rows at most
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return {}
    base = toxic / (toxic + clean)
    least = max(min_toxic, math.ceil(0.001 * toxic))
    rows = sample.mapInArrow(_count_features(model), "feature string, hits long, misses long").groupBy("feature").agg(F.sum("hits").alias("hits"), F.sum("misses").alias("misses"))
    share = (F.col("hits") + shrink * base) / (F.col("hits") + F.col("misses") + shrink)
    found = rows.filter((F.col("hits") >= least) & (share >= min_share)).orderBy(F.desc("hits"), "feature").collect()
    return strongest({r["feature"]: r["hits"] for r in found}, {r["feature"]: r["misses"] for r in found}, base, shrink, min_share)


def strongest(hits: dict[str, int], misses: dict[str, int], base: float, shrink: float, min_share: float) -> dict[str, float]:
    """The features that hold alone; no longer feature below min_share can explain one that reaches it."""

    def shrunk(toxic: int, clean: int) -> float:
        return (toxic + shrink * base) / (toxic + clean + shrink)

    share = {f: shrunk(n, misses.get(f, 0)) for f, n in hits.items()}
    longer: dict[str, str] = {}
    for f in share:
        for start in features(f.rstrip("|"))[1:]:
            if start != f and start in share and share[f] > share[start] and (start not in longer or hits[f] > hits[longer[start]]):
                longer[start] = f
    kept = []
    for f in share:
        c = longer.get(f)
        alone = share[f] if c is None else shrunk(max(0, hits[f] - hits[c]), max(0, misses.get(f, 0) - misses.get(c, 0)))
        if min(share[f], alone) >= min_share:
            kept.append(f)
    return {f: share[f] for f in kept}


def score_text(text: str | None, restorer: Restorer, lexicon: dict[str, float], starts: set[str]) -> float:
    best = []
    for word in words_in(restorer.restore(text or "")):
        if word[:3] in starts:
            hit = max((lexicon[f] for f in features(word) if f in lexicon), default=0.0)
            if hit:
                best.append(hit)
    clean = 1 - BASELINE
    for p in sorted(best, reverse=True)[:3]:
        clean *= 1 - p
    return 1 - clean if best else BASELINE


def _score(shared, lexicon):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, words = Restorer(shared.value), lexicon.value
        starts = {f[:3].rstrip("|") for f in words}
        for batch in batches:
            scores = [score_text(t, restorer, words, starts) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, max_training: int = 50_000) -> DataFrame:
    """One row per row of docs (doc_id, text): held_out, score and predicted; labels has doc_id and toxic."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(character_model(docs))
    lexicon = docs.sparkSession.sparkContext.broadcast(learn_lexicon(docs, labels, model, max_training))
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    out = docs.withColumn("held_out", held_out).mapInArrow(_score(model, lexicon), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
