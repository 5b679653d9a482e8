"""Exact token counts of every prefix of a text, by dynamic programming over a BPE piece table.

For a BPE that merges the best-scored pair first, leftmost on ties, a sequence of pieces is the encoding of its text if and
only if every two neighbours are the encoding of their own joint text: until the first merge across a border, each side
changes as it would alone. So the encoding of a prefix ends in the one piece that may follow the encoding of the shorter
prefix, and count[i] = count[i - len(piece)] + its tokens. The table of last pieces is filled left to right.

White space starts a new piece group: no piece has a space mark after another character (checked when the model loads),
so counts of earlier words are final and words can be solved once and kept.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Prefixes up to this length keep their tables.
SHARED = 8
_GROUPS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class _Groups(dict):
    """Steps of the prefix counts of each word seen (with its space mark), as packed 16-bit numbers."""

    def __init__(self, counter: PrefixCounter, most: int):
        super().__init__()
        self.counter, self.most = counter, most

    def __missing__(self, word: str) -> bytes:
        steps = self.counter.group_steps(MARK + word)
        if len(word) < 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = steps
        return steps


class PrefixCounter:
    """Prefix counts under a sentencepiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, model_file: str, most: int = 600_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece of this model crosses a space, so words cannot be solved one by one")
        self.reach: dict[str, int] = {}  # length of the longest piece by its last three characters
        for p in self.ids:
            self.reach[p[-3:]] = max(len(p), self.reach.get(p[-3:], 2))
        self.most, self._pairs, self._ends = most, {}, {}
        self._groups = _Groups(self, most)
        bare = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
        bare.normalizer_spec.add_dummy_prefix = False
        self._bare = sentencepiece.SentencePieceProcessor(model_proto=bare.SerializeToString())

    def may_follow(self, left: str, right: str) -> bool:
        """Whether two neighbouring pieces (or nothing and a piece) are the encoding of their joint text. A character that the
        model lacks merges with nothing."""
        key = (left, right)
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= self.most:
                self._pairs.clear()
            if right not in self.ids or left and left not in self.ids:
                known = True
            else:
                known = self._bare.EncodeAsIds(left + right) == ([self.ids[left]] if left else []) + [self.ids[right]]
            self._pairs[key] = known
        return known

    def group_steps(self, group: str) -> bytes:
        """Change of the token count with each character of one piece group. The table of a prefix (last pieces and counts) is
        the same in every word that begins with it, so tables of short prefixes are shared."""
        ids, pairs, ends, n = self.ids, self._pairs, self._ends, len(group)
        done, found = min(n, SHARED), None
        while done and (found := ends.get(group[:done])) is None:
            done -= 1
        last, counts = (list(found[0]), list(found[1])) if found else ([""], [0])
        for end in range(done + 1, n + 1):
            # only one piece fits, so likely ones come first: the last piece grown by a character, then that character alone
            char = group[end - 1]
            piece = last[-1] + char
            if piece in ids:
                start = end - len(piece)
                fits = pairs.get((last[start], piece))
                if fits is None:
                    fits = self.may_follow(last[start], piece)
            else:
                fits = False
            if not fits:
                piece, start = char, end - 1
                fits = pairs.get((last[start], piece))
                if fits is None:
                    fits = self.may_follow(last[start], piece)
            if not fits:
                start, piece = self._longer(group, end, last)
            last.append(piece)
            counts.append(counts[start] + (1 if piece in ids else len(piece.encode())))
            if end <= SHARED:
                if len(ends) >= self.most:
                    ends.clear()
                ends[group[:end]] = tuple(last), tuple(counts)
        return array("h", map(sub, counts[1:], counts)).tobytes()

    def _longer(self, group: str, end: int, last: list[str]) -> tuple[int, str]:
        ids, pairs = self.ids, self._pairs
        for start in range(max(0, end - self.reach.get(group[max(0, end - 3) : end], 2)), end - 1):
            piece = group[start:end]
            if piece in ids:
                fits = pairs.get((last[start], piece))
                if self.may_follow(last[start], piece) if fits is None else fits:
                    return start, piece
        raise RuntimeError("no piece can end this prefix")

    def prefix_counts(self, text: str) -> np.ndarray:
        """counts[i] = tokens of text[:i + 1]. The model puts one space mark before a text, so it starts a group."""
        if not text:
            return np.zeros(0, np.int32)
        if text[0] == " " or "  " in text or MARK in text:
            words = [g[1:] for g in _GROUPS.findall(MARK + text.replace(" ", MARK))]
        else:
            words = text.split(" ")
        steps = b"".join(map(self._groups.__getitem__, words))
        return np.cumsum(np.frombuffer(steps, np.int16), dtype=np.int32)[1:]


@lru_cache(1)
def counter_for(model_file: str) -> PrefixCounter:
    """One counter for each Python worker, so its tables serve all tasks of the worker."""
    return PrefixCounter(model_file)


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def _count(model_file: str, budget: int, with_prefixes: bool):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_for(model_file)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = [counter.prefix_counts(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n_bytes"),
                    pa.array([int(c[-1]) if len(c) else 0 for c in counts], pa.int64()),
                    pa.array([longest_prefix(c, budget) for c in counts], pa.int64()),
                    pa.array(counts if with_prefixes else [None] * len(counts), pa.list_(pa.int32())),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "budget_chars", "prefix_tokens"],
            )

    return count


def prefix_token_counts(docs: DataFrame, model_file: str, budget: int = 4096, with_prefixes: bool = True) -> DataFrame:
    """One row per row of docs (doc_id, text): n_bytes, n_tokens, budget_chars (characters of the longest prefix of at most
    `budget` tokens) and prefix_tokens (count at every prefix, from one character on; null unless with_prefixes).

    A null text counts as empty: 0 bytes, 0 tokens, an empty list. Rows are independent: repeats, null ids and extra
    columns change nothing. model_file must be readable on every executor.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"), F.octet_length(body).cast("long").alias("n_bytes"))
    return narrow.mapInArrow(_count(model_file, budget, with_prefixes), "doc_id long, n_bytes long, n_tokens long, budget_chars long, prefix_tokens array<int>")
