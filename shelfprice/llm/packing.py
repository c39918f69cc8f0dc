"""Packing documents into sequences of a fixed length by cutting-stock column generation.

A document is its token ids and an end id. Longer ones are cut into full sequences and a
tail. The lengths of all pieces are counted by class (lengths rounded up to ``grain``
tokens), which is all that the driver needs: a histogram of ``length / grain`` numbers, however
many documents there are. On it the driver solves the linear program of the cutting-stock
problem by column generation: a revised simplex whose columns are patterns (how many
pieces of each class make up one sequence), priced by an unbounded knapsack that dynamic
programming solves. The patterns' multiples are rounded down and the few pieces left over
are packed first-fit by decreasing length. In Spark the pieces of a class are then ranked, and a
piece's rank tells its pattern, sequence and place.

How it scales: texts are tokenized once, in batches, into one small row per piece. Ranks come from
counts per class and bucket of hashed ids, so no task holds a whole class; the patterns'
slots are one row per class; sequences are summed up in groups of 2,048 pieces at most.

Defined results: a null or empty text is the end id alone; repeated rows are packed each for
itself; null ids are allowed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfprice.operators.staging import stage

END_ID = 1
MOST_CACHED = 250_000
ROWS_AT_ONCE = 500
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_TOKENIZERS: dict[str, WordTokenizer] = {}


class Remembered(dict):
    """A mapping that forgets what was not used lately: the older of two generations is dropped when the newer is full."""

    def __init__(self, make, most: int):
        super().__init__()
        self._make, self._most, self._older = make, most, {}

    def __missing__(self, key):
        if len(self) >= self._most:
            self._older = dict(self)
            self.clear()
        value = self._older.get(key)
        if value is None:
            value = self._make(key)
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self._older = {}


class WordTokenizer:
    """Ids of whole texts as little-endian bytes, put together from those of their words.

    The tokenizer's normaliser and splitting never join characters across ASCII white space,
    so a text's ids are those of its words in a row, and words are remembered. Most words are
    Latin letters with punctuation behind; these two parts are tokenized apart, so a word's
    forms share their work. Whether that holds for the tokenizer is tried when it is loaded.
    """

    TRIAL = ("Hello", "w\u00d6rld,", "x...", "THE!!", "\u00e9l\u00e8ve", "***", "a-", "don'", "")
    PARTS = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([!-&(-/:-@\\[-`{-~']*)")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenize = self._tokenizer.model.tokenize
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        others = iter(range(256, 512))
        self._characters = [chr(b) if b in printed else chr(next(others)) for b in range(256)]
        self._parts = Remembered(self._part, MOST_CACHED)
        self._words = Remembered(self._word, MOST_CACHED)
        self._split = all(self._in_parts(w) == self._whole(w) for w in self.TRIAL)

    def _whole(self, word: str) -> bytes:
        return np.array(self._tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _part(self, part: str) -> bytes:
        if not part:
            return b""
        characters = "".join([self._characters[b] for b in part.encode()])
        return np.array([t.id for t in self._tokenize(characters)], dtype="<u4").tobytes()

    def _in_parts(self, word: str) -> bytes | None:
        found = self.PARTS.fullmatch(word)
        return self._parts[found[1].lower()] + self._parts[found[2]] if found else None

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        found = self._in_parts(text) if self._split else None
        return self._whole(text) if found is None else found

    def encode(self, text: str | None) -> bytes:
        words = (text or "").encode().split()
        return b"".join(map(self._words.__getitem__, words))

    def forget(self) -> None:
        """Drops the remembered words."""
        self._words.forget()
        self._parts.forget()


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a file, loaded once in a worker. A task that is done lets it forget its words."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def cut_into_pieces(docs: DataFrame, path: str, length: int) -> DataFrame:
    """One row per piece: id, first token, tokens, checksum of the ids, tokens of the document."""
    end = np.asarray([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        try:
            for batch in batches:
                for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                    part = batch.slice(first, ROWS_AT_ONCE)
                    ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                    rows: list[tuple] = []
                    for doc_id, text in zip(ids, texts, strict=True):
                        tokens = words.encode(text) + end
                        n = len(tokens) // 4
                        rows += [(doc_id, k, min(length, n - k), zlib.crc32(tokens[4 * k:4 * (k + length)]), n)
                                 for k in range(0, n, length)]
                    columns = list(zip(*rows, strict=True)) or [()] * 5
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        finally:
            words.forget()  # the worker lives on, beside the tasks of later stages

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, PIECES)


# ---- the linear program, on the histogram of lengths


def best_pattern(prices: np.ndarray, widths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable filling of one sequence: unbounded knapsack by dynamic programming."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = np.searchsorted(widths, room, side="right")  # widths ascend
        value[room] = value[room - 1]
        if fits:
            gains = value[room - widths[:fits]] + prices[:fits]
            k = int(gains.argmax())
            if gains[k] > value[room] + 1e-12:
                value[room], choice[room] = gains[k], k
    pattern, room = np.zeros(len(widths)), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            pattern[choice[room]] += 1
            room -= widths[choice[room]]
    return value[capacity], pattern


def column_generation(widths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a column each) and their fractional multiples that cover the demand with fewest sequences.

    Stops when no pattern prices out, or when the bound of Farley shows that at most a share ``gap`` is left.
    """
    m = len(widths)
    patterns = np.diag(np.floor(capacity / widths))
    inverse, multiples = np.diag(1 / np.diag(patterns)), demand / np.diag(patterns)
    for _ in range(40 * m + 100):
        prices = inverse.sum(axis=0)
        value, pattern = best_pattern(np.maximum(prices, 0.0), widths, capacity)
        if value <= 1 + gap:
            break
        step = inverse @ pattern
        rows = np.flatnonzero(step > 1e-9)
        if not len(rows):
            break
        ratios = multiples[rows] / step[rows]
        leaving = rows[ratios.argmin()]
        amount = max(0.0, ratios.min())
        multiples = np.maximum(multiples - amount * step, 0.0)
        multiples[leaving] = amount
        pivot = inverse[leaving] / step[leaving]
        inverse -= np.outer(step, pivot)
        inverse[leaving] = pivot
        patterns[:, leaving] = pattern
    return patterns, multiples


def rounded(widths: np.ndarray, demand: np.ndarray, patterns: np.ndarray, multiples: np.ndarray,
            capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole multiples of patterns that take every piece exactly once."""
    left = demand.astype(np.int64).copy()
    plan: list[tuple[np.ndarray, int]] = []
    for k in range(patterns.shape[1]):
        pattern = patterns[:, k].astype(np.int64)
        used = pattern > 0
        times = min(int(multiples[k] + 1e-9), int((left[used] // pattern[used]).min())) if used.any() else 0
        if times:
            plan.append((pattern, times))
            left -= times * pattern
    while left.any():  # what rounding left: first fit by decreasing length, equal sequences at once
        pattern, room = np.zeros(len(widths), dtype=np.int64), capacity
        for i in range(len(widths) - 1, -1, -1):
            pattern[i] = min(left[i], room // widths[i])
            room -= pattern[i] * widths[i]
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        plan.append((pattern, times))
        left -= times * pattern
    return plan


def slots(widths: np.ndarray, plan: list[tuple[np.ndarray, int]]) -> list[tuple[int, list[int], list[int], list[int]]]:
    """Per class: the ranks at which its patterns begin, their first sequence, and its pieces in one sequence."""
    out = {int(w): ([], [], []) for w in widths}
    seen, sequence = np.zeros(len(widths), dtype=np.int64), 0
    for pattern, times in plan:
        for i in np.flatnonzero(pattern):
            starts, firsts, counts = out[int(widths[i])]
            starts.append(int(seen[i]))
            firsts.append(sequence)
            counts.append(int(pattern[i]))
        seen += pattern * times
        sequence += times
    return [(w, *lists) for w, lists in out.items()]


def pack(docs: DataFrame, path: str, length: int = 2048, grain: int = 8) -> DataFrame:
    """Every piece with its sequence and its offset there; ``length`` is a multiple of ``grain``."""
    if length % grain:
        raise ValueError("the length of a sequence is a multiple of the grain")
    session = docs.sparkSession
    pieces = stage(cut_into_pieces(docs, path, length).withColumn("class_", F.ceil(F.col("length") / grain).cast("int")))
    histogram = pieces.groupBy("class_").count().orderBy("class_").collect()  # length / grain rows at most
    total = sum(r["count"] for r in histogram)
    capacity = length // grain
    widths = np.array([r["class_"] for r in histogram], dtype=np.int64)
    demand = np.array([r["count"] for r in histogram], dtype=float)
    places = []
    if total:
        plan = rounded(widths, demand, *column_generation(widths, demand, capacity), capacity)
        places = slots(widths, plan)
    slot_table = session.createDataFrame(
        places, "class_ int, starts_ array<long>, firsts_ array<long>, counts_ array<long>")
    buckets = max(int(session.conf.get("spark.sql.shuffle.partitions")), total // 20_000)
    dealt = pieces.withColumn("bucket_", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("class_").orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("class_", "bucket_").agg(F.count(F.lit(1)).alias("n_")).select(
        "class_", "bucket_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    place = Window.partitionBy("class_", "bucket_").orderBy("doc_id", "start", "ids_crc32")
    rank = F.col("before_") + F.row_number().over(place) - 1
    at = F.size(F.filter("starts_", lambda s: s <= F.col("rank_"))) - 1
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start").rowsBetween(
        Window.unboundedPreceding, -1)
    return (
        dealt.join(counts, ["class_", "bucket_"]).withColumn("rank_", rank)
        .join(slot_table, "class_").withColumn("at_", at)
        .withColumn("sequence_id", F.get("firsts_", F.col("at_")) + F.floor(
            (F.col("rank_") - F.get("starts_", F.col("at_"))) / F.get("counts_", F.col("at_"))).cast("long"))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"))
    )
