"""Quality rules by distribution divergence, in DataFrame functions only.

For each language the corpus gives two references: the share of each character class, and the shares of its most common
words (all other words together are one more bin). A document is compared with the references of its language by
Jensen-Shannon distance (base 2, 0 to 1). It is rejected if a distance passes its threshold; between min_words and full_words
the threshold widens with the square root of the shortness, as a histogram's noise does. Documents below min_words, and all of
a language with too few words for a stable reference, pass, as nothing can be said of them. Two base rules (few words, many
repeated three-word windows) reject on their own.

Null text: no words, so the base rule rejects it. A null language counts as the empty one. Rows are judged one by one:
repeats and null ids change nothing but the references' counts. Other columns are kept, but columns named as an output
are replaced. Ties of common words go to the smaller word. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadloom.llm.shared import fresh, small_side, stored
from quadloom.llm.text import SPACES, let, total, upto, words

SYMBOLS = "[#*$%&|<>]"
#: Characters counted by pattern; white space and "all the rest" (mostly small letters) complete the histogram.
CLASSES = {"capital": "[A-Z]", "digit": "[0-9]", "mark": "[!-/:-@\\[-`{-~]", "wide": "[^\\x00-\\x7F]"}
#: Fitted by fit_thresholds on labelled rows of sf0.1 whose crc32(doc_id) mod 5 is not 0.
CLASS_DISTANCE, WORD_DISTANCE = 0.216, 0.301


def repeat_words(w: Column) -> Column:
    """Words covered by three-word windows that stand at least twice in the text, first ones included."""

    def covered(h: Column) -> Column:
        def of_sorted(s: Column) -> Column:
            again = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]) | (x["h"] == F.get(s, j + 1)["h"]))
            places = F.sort_array(F.transform(again, lambda x: x["i"]))
            return let(places, lambda p: total(F.transform(p, lambda x, j: F.coalesce(F.least(F.lit(3), F.get(p, j + 1) - x), F.lit(3))), F.lit(0)))

        slow = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), of_sorted)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(slow)

    return let(F.transform(upto(F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), covered)


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, SPACES, ""))


def shares(counts: Column) -> Column:
    return let(counts, lambda c: let(F.greatest(total(c, F.lit(0).cast("long")), F.lit(1)), lambda n: F.transform(c, lambda x: x / n)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two share arrays of one length."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    return F.sqrt(F.greatest(total(F.zip_with(p, q, lambda x, y: part(x, y) + part(y, x))) / 2, F.lit(0.0)))


def common_words(docs: DataFrame, common: int, lang: str, best: str) -> DataFrame:
    """(lang, best): the commonest words of each language, over all words of all documents; sums are combined map-side, and
    Spark keeps only the best of each partition before it ranks."""
    split = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACES)
    counts = docs.select(_language().alias(lang), F.explode(split).alias("word")).filter("word != ''").groupBy(lang, "word").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(lang).orderBy(F.desc("n"), "word"))).filter(F.col("rank") <= common)
    lists = ranked.groupBy(lang).agg(F.sort_array(F.collect_list(F.struct("rank", "word"))).alias(best))
    return lists.select(lang, F.transform(best, lambda x: x["word"]).alias(best))


def _language() -> Column:
    return F.coalesce(F.col("lang").cast("string"), F.lit(""))


def histogram(w: Column, common: Column) -> Column:
    """How often each common word stands in w, and how many words are none of them, last. The words' places in `common` are
    sorted among one mark for each place, so a count is the distance of two marks."""
    n = F.size(common)
    places = F.concat(F.transform(w, lambda x: F.array_position(common, x)), F.sequence(F.lit(1).cast("long"), n.cast("long") + 1))

    def counts(s: Column) -> Column:
        each = F.transform(upto(n), lambda k: F.array_position(s, k.cast("long") + 2) - F.array_position(s, k.cast("long") + 1) - 1)
        return F.concat(each, F.array(F.array_position(s, F.lit(1).cast("long")) - 1))

    return let(F.sort_array(places), counts)


def measure(docs: DataFrame, common: DataFrame, names: list[str]) -> DataFrame:
    """docs with the base counts, and under the last two of names (lang, common, m, words, classes) the counts of the
    language's common words with all other words last, and of character classes."""
    lang, best, m, word_counts, class_counts = names
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def measured(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).cast("long").alias("repeats"), histogram(w, F.col(best)).alias("words"))

    joined = docs.withColumn(lang, _language()).join(common, lang, "left")
    joined = joined.withColumn(best, F.coalesce(best, F.array().cast("array<string>")))
    out = joined.withColumns({m: let(words(text), measured), "word_chars": word_chars(text).cast("long")})
    counted = [F.regexp_count(text, F.lit(p)).cast("long") for p in CLASSES.values()]
    out = out.withColumns(
        {
            "n_words": F.col(f"{m}.n"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": dup_lines(text).cast("long"),
            "n_repeat_words": F.col(f"{m}.repeats"),
            word_counts: F.col(f"{m}.words"),
            class_counts: let(F.array(*counted, F.length(text) - F.col("word_chars")), lambda c: F.concat(c, F.array(F.length(text).cast("long") - total(c, F.lit(0).cast("long"))))),
        }
    )
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.drop(m, best)


def references(measured: DataFrame, common: int, min_reference_words: int, names: list[str], shares_of: list[str]) -> DataFrame:
    """(lang, word shares, class shares) of the languages with enough words, summed over all their documents."""
    lang, _, _, word_counts, class_counts = names

    def summed(column: str, n: int) -> list[Column]:
        return [F.sum(F.coalesce(F.get(column, F.lit(k)), F.lit(0))) for k in range(n)]

    sums = measured.groupBy(lang).agg(
        F.sum("n_words").alias("n"), F.max(F.size(word_counts)).alias("size"), F.array(*summed(word_counts, common + 1)).alias("w"), F.array(*summed(class_counts, len(CLASSES) + 2)).alias("c"))
    return sums.filter(F.col("n") >= min_reference_words).select(lang, shares(F.slice("w", F.lit(1), F.col("size"))).alias(shares_of[0]), shares(F.col("c")).alias(shares_of[1]))


def judge_quality(docs: DataFrame, max_class_distance: float = CLASS_DISTANCE, max_word_distance: float = WORD_DISTANCE, min_words: int = 50, full_words: int = 100, common: int = 24, min_reference_words: int = 2000, with_text: bool = True) -> DataFrame:
    """docs (text and lang are read) plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, class_distance,
    word_distance (null where a guard says nothing), base_failed and kept. Each text is measured once and the measures are
    written; without with_text, the text is left out of what is written and returned."""
    names = fresh(docs, "_lang", "_common", "_m", "_words", "_classes")
    shares_of = fresh(docs, "_word_shares", "_class_shares")
    lang, best, _, word_counts, class_counts = names
    # a row for each language: broadcast only if few were counted
    known = small_side(stored(common_words(docs, common, lang, best), "common-words"), 10_000)
    measured = measure(docs, known, names)
    measured = stored(measured if with_text else measured.drop("text"), "measured")
    expected = small_side(stored(references(measured, common, min_reference_words, names, shares_of), "language-references"), 10_000)
    out = measured.join(expected, lang, "left")
    judged = (F.col("n_words") >= min_words) & F.col(shares_of[0]).isNotNull()
    out = out.withColumns(
        {
            "class_distance": F.when(judged, js_distance(shares(F.col(class_counts)), F.col(shares_of[1]))),
            "word_distance": F.when(judged, js_distance(shares(F.col(word_counts)), F.col(shares_of[0]))),
        }
    )
    wider = F.sqrt(F.greatest(F.lit(1.0), full_words / F.greatest(F.col("n_words"), F.lit(1))))
    close = (F.coalesce("class_distance", F.lit(0.0)) <= max_class_distance * wider) & (F.coalesce("word_distance", F.lit(0.0)) <= max_word_distance * wider)
    return out.withColumn("kept", ~F.col("base_failed") & close).drop(lang, word_counts, class_counts, *shares_of)


def fit_thresholds(docs: DataFrame, labels: DataFrame, keep: float = 0.999, **options) -> tuple[float, float]:
    """(max_class_distance, max_word_distance): a tenth above the `keep` quantile of the distances, at full length, of the
    documents that labels (doc_id, quality) calls good and whose crc32(doc_id) mod 5 is not 0."""
    judged = judge_quality(docs.select("doc_id", "text", "lang"), **options, with_text=False)
    good = labels.filter((F.col("quality") == 1) & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)).select("doc_id").distinct()
    at_length = F.sqrt(F.greatest(F.lit(1.0), 100 / F.greatest(F.col("n_words"), F.lit(1))))
    rows = judged.filter("not base_failed").join(good, "doc_id", "left_semi")
    found = rows.agg(*[F.percentile(F.col(c) / at_length, F.lit(keep)) for c in ("class_distance", "word_distance")]).first()
    return tuple(1.1 * (x if x is not None else 1.0) for x in found)


def drop_rejected(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that judge_quality does not keep. Verdicts are keyed by id, text and language, so null and
    repeated ids are safe; texts are not written again."""
    mine, theirs = fresh(docs, "_id", "_key"), fresh(docs, "_gone_id", "_gone_key")
    key = [F.col("doc_id").cast("string"), F.xxhash64(F.col("text").cast("string"), F.col("lang").cast("string"))]
    verdicts = judge_quality(docs.select("text", "lang", *[c.alias(n) for n, c in zip(mine, key)]), with_text=False, **options)
    gone = stored(verdicts.filter(~F.col("kept")).select(*[F.col(a).alias(b) for a, b in zip(mine, theirs)]).distinct(), "rejected")
    return docs.join(small_side(gone), key[0].eqNullSafe(F.col(theirs[0])) & (key[1] == F.col(theirs[1])), "left_anti")
