"""Quality rules: base rules and divergence from the language's usual histograms.

A document is described by two histograms: the classes of its characters and the common
words of its language. The references are the same histograms summed over all documents
of the language that pass the base rules. A document is rejected when it fails a base
rule, or when its Jensen-Shannon distance (base 2, 0 to 1) from a reference is above the
threshold and the document is long enough for that histogram to be judged.

Everything is built-in expressions; a row needs no other row apart from the references,
which are one row per language. The features are written once to the shared folder, as
the references need all of them first.

Defined results: a null text has no words, fails the base rules and is not kept; a null
or unknown language is compared by character classes only, against all documents of that
same (or no) language; repeated rows are judged alike and all returned; an empty table
gives an empty result. Other columns of the input are ignored by ``judge``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfprice.llm.common import SPACES, let, packed, unpacked, words
from shelfprice.operators.joins import fits_broadcast
from shelfprice.operators.staging import stage

# Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that it for on was as with be by are this from or",
    "de": "der die und in den von zu das mit des auf für ist im dem nicht ein eine als er",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au avec il",
    "es": "de la que el en y a los se del las un por con no una su para es al",
}

#: Character classes as the inside of regular expression brackets; the order of SPACE and SYMBOL is used below.
CLASSES = ["a-z", "\\x20\\x09-\\x0D", "#*$%&|<>", "0-9", "A-Z", ".,;:!?", "'\"()\\[\\]{}-"]
SPACE, SYMBOL = 1, 2
N_WORDS = 14


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules; distances are square roots of the divergence in bits."""

    least_words: int = 50
    most_repeated_pct: int = 50
    class_distance: float = 0.30
    class_least_chars: int = 200
    word_distance: float = 0.275
    word_least_words: int = 100


def repeated_words(tokens: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, the first occurrence included.

    Windows are compared by a 64-bit hash. Most texts repeat none, which a hash set shows.
    Of the others the windows are sorted with their positions; those equal to a neighbour
    repeat, and the words that they cover are counted in order of position.
    """
    hashes = F.slice(F.transform(tokens, lambda w, i: F.xxhash64(w, F.get(tokens, i + 1), F.get(tokens, i + 2))),
                     F.lit(1), F.greatest(F.size(tokens) - 2, F.lit(0)))

    def positions(windows: Column) -> Column:
        def twice(x: Column, k: Column) -> Column:
            after = F.get(windows, k + 1)["h"] == x["h"]
            before = F.when(k > 0, F.get(windows, k - 1)["h"] == x["h"]).otherwise(False)
            return F.coalesce(after, F.lit(False)) | before

        return F.sort_array(F.transform(F.filter(windows, twice), lambda x: x["i"]))

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        start = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            let(placed, positions), start,
            lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(p - acc["at"], F.lit(3))).alias("n")),
            lambda acc: acc["n"])

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(
        covered(h))).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line, compared by a 64-bit hash."""
    hashes = F.transform(
        F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0),
        lambda x: F.xxhash64(x))
    return let(hashes, lambda h: F.size(h) - F.size(F.array_distinct(h))).cast("long")


def class_counts(text: Column) -> Column:
    """Characters of each class, then all others.

    Each class is removed from what the earlier ones left, so only the first passes see the whole text.
    """
    def step(left: Column, rest: list[str]) -> list[Column]:
        after = F.regexp_replace(left, f"[{rest[0]}]+", "")
        own = (F.length(left) - F.length(after)).cast("long")
        if len(rest) == 1:
            return F.array(own, F.length(after).cast("long"))
        return let(after, lambda x: F.concat(F.array((F.length(left) - F.length(x)).cast("long")), step(x, rest[1:])))

    return step(text, CLASSES)


def common_counts(tokens: Column, lang: Column) -> Column:
    """Occurrences of each common word of the language, then all other words; null for unknown languages."""
    every = sorted({w for line in COMMON_WORDS.values() for w in line.split()})
    picks = None
    for code, line in COMMON_WORDS.items():
        own = F.array(*[F.lit(w) for w in line.split()[:N_WORDS]])
        picks = F.when(lang == code, own) if picks is None else picks.when(lang == code, own)
    counts = let(F.filter(tokens, lambda w: w.isin(every)), lambda found: F.transform(
        picks, lambda word: F.size(F.filter(found, lambda x: x == word)).cast("long")))
    return let(counts, lambda c: F.concat(
        c, F.array(F.size(tokens).cast("long") - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))))


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; null if either is empty."""
    def total(c: Column) -> Column:
        return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    def half(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    terms = F.zip_with(counts, reference, lambda a, b: half(a / total(counts), b / total(reference))
                       + half(b / total(reference), a / total(counts)))
    divergence = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2
    return F.when((total(counts) > 0) & (total(reference) > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def _measured(df: DataFrame, limits: Limits) -> DataFrame:
    """Adds the base measures and histograms to a table with ``text_`` and ``lang_``."""
    text, tokens = F.coalesce(F.col("text_"), F.lit("")), F.col("words_")
    rest = [c for c in df.columns if c != "text_"]
    n_words = F.col("n_words")
    return (
        df.withColumn("words_", words(F.col("text_")))
        .select(
            *rest,
            F.size(tokens).cast("long").alias("n_words"),
            F.length(text).cast("long").alias("chars_"),
            repeated_lines(text).alias("n_dup_lines"),
            repeated_words(tokens).alias("n_repeat_words"),
            class_counts(text).alias("classes_"),
            common_counts(tokens, F.col("lang_")).alias("common_"),
        )
        .withColumn("word_chars", F.col("chars_") - F.get("classes_", F.lit(SPACE)))
        .withColumn("n_symbols", F.get("classes_", F.lit(SYMBOL)))
        .drop("chars_")
        .withColumn("base_failed", (n_words < limits.least_words)
                    | (100 * F.col("n_repeat_words") > limits.most_repeated_pct * n_words))
    )


def references(measured: DataFrame) -> DataFrame:
    """Summed histograms per language, over all documents that pass the base rules."""
    sums = [F.sum(F.get(c, F.lit(k))).alias(f"{c}{k}")
            for c, n in (("classes_", len(CLASSES) + 1), ("common_", N_WORDS + 1)) for k in range(n)]
    return measured.where(~F.col("base_failed")).groupBy("lang_").agg(*sums).select(
        F.col("lang_").alias("of_"),
        F.array(*[f"classes_{k}" for k in range(len(CLASSES) + 1)]).alias("class_ref_"),
        F.array(*[f"common_{k}" for k in range(N_WORDS + 1)]).alias("common_ref_"))


def judge(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds the measures, ``class_distance``, ``word_distance`` and ``kept`` to a table.

    ``df`` has the columns ``text_`` and ``lang_``; the text is dropped from the result.
    """
    measured = stage(_measured(df, limits))
    learnt = stage(references(measured))  # one row per language
    if fits_broadcast(learnt):  # so that no document moves to those of its language
        learnt = F.broadcast(learnt)
    both = measured.join(learnt, F.col("lang_").eqNullSafe(F.col("of_")), "left")
    far = (
        (F.coalesce(F.col("class_distance"), F.lit(0.0)) > limits.class_distance)
        & (F.col("word_chars") >= limits.class_least_chars)
    ) | (
        (F.coalesce(F.col("word_distance"), F.lit(0.0)) > limits.word_distance)
        & (F.col("n_words") >= limits.word_least_words)
    )
    return (
        both.withColumn("class_distance", distance(F.col("classes_"), F.col("class_ref_")))
        .withColumn("word_distance", distance(F.col("common_"), F.col("common_ref_")))
        .withColumn("kept", ~F.col("base_failed") & ~far)
        .drop("of_", "class_ref_", "common_ref_", "classes_", "common_", "lang_")
    )


def quality(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Measures and verdict of every document, with its ``doc_id``."""
    return judge(docs.select("doc_id", F.col("text").alias("text_"), F.col("lang").alias("lang_")), limits)


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    rows = packed(docs, text_=F.col("text"), lang_=F.col("lang"))
    return unpacked(judge(rows, limits).where("kept"))
