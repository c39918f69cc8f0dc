"""Language-model scores of whole documents.

The words of all training documents are counted first. Words with at least a share ``FREQUENT``
of all tokens (so 1 / FREQUENT words at most, whatever the corpus) are sent to every task; the counts
of all rarer words stay a table, which is joined to the rare words of the documents. The model is a
gated recurrent net with a class-factored softmax (``gated_lm``): all frequent words that occur twice
or more have an input and an output of their own, so the vocabulary follows the counts, in
classes of equal shares of the roots of the counts. All others share an input and a class, inside which they
have their add-one share; in a small corpus these are the words seen once, which stand for those never seen.
At most 500,000 words are sent, about 200 MB with their weights.

Training covers all training documents once, in rounds: the documents are divided into as many
parts as there are rounds by a hash of their id, and in a round every task trains on its
documents of that part from the common weights. What comes out is averaged, weighted by tokens: a task
sends its changes as 16-bit numbers in pieces of ``PIECE``, and each piece is averaged by itself, over groups
of at most ``TOGETHER`` tasks first. The averages depend on which files share a task. Scoring carries the state
through a whole document, however long.

Defined results: a null text is an empty text, whose only token is the end; a null id counts as an empty
string and trains; repeated rows are scored each for itself; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil, log, log10

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfprice.llm import gated_lm
from shelfprice.llm.gated_lm import Shape
from shelfprice.operators.staging import stage

FREQUENT = 2e-6
ROUNDS = 2
LANES = 192
LONGEST = 2048
MOST_CACHED = 500_000
ROWS_AT_ONCE = 500
TOKENS_AT_ONCE = 4_000_000
PIECE = 1 << 18
TOGETHER = 64
END = b"\n"  # no word has a line break
FOLDS, HELD_OUT_FOLD = 7, 2


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def hash_of(word: bytes) -> int:
    """Signed 64-bit hash of a word."""
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def words_of(text: str | None) -> list[bytes]:
    """Tokens of a text: its words with A-Z in lower case, then the end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (hash) and ``n`` over all tokens of the documents."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([hash_of(w) for w in found], pa.int64()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
            found.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                found.update(words_of(text.as_py()))
                if len(found) > MOST_CACHED:
                    yield rows()
        yield rows()

    return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The frequent words: hashes and counts in order of falling count, and the sums over all words."""

    def __init__(self, rows: list[tuple[int, int]], tokens: int, distinct: int, shape: Shape | None = None):
        end = hash_of(END)
        rows = sorted(rows, key=lambda r: (r[0] != end, -r[1], r[0]))  # the end is always number 0
        if not rows or rows[0][0] != end:
            rows.insert(0, (end, 0))
        self.tokens, self.distinct = tokens, distinct
        self.hashes = np.array([r[0] for r in rows], np.int64)
        self.counts = np.array([r[1] for r in rows], np.float64)
        #: Without a given shape all words seen twice or more, and the end, have an output.
        self.shape = shape or Shape.following(self.counts[:1 + int((self.counts[1:] > 1).sum())])
        shape = self.shape
        self.place = np.argsort(self.hashes)
        self.sorted = self.hashes[self.place]
        own = self.counts[:shape.words]
        self.other_tokens = tokens - own.sum()
        #: What the counts plus one of all words without their own output, and of an unknown word, add up to.
        self.other_mass = tokens + distinct + 1 - (own + 1).sum() + (1 if rows[0][1] == 0 else 0)

    def initial(self) -> gated_lm.Weights:
        return gated_lm.initial(self.counts[:self.shape.words], self.other_tokens, self.shape)


class Coder:
    """Word numbers of texts: below ``len(counts)`` frequent words, from there on a task's own list of rare ones."""

    def __init__(self, vocabulary: Vocabulary):
        self._v, self._known, self.rare = vocabulary, {}, []

    def code(self, words: list[bytes]) -> np.ndarray:
        known = self._known
        try:
            return np.fromiter(map(known.__getitem__, words), np.int32, len(words))
        except KeyError:
            new = [w for w in dict.fromkeys(words) if w not in known]
            hashes = np.array([hash_of(w) for w in new], np.int64)
            at = np.minimum(np.searchsorted(self._v.sorted, hashes), len(self._v.sorted) - 1)
            hit = self._v.sorted[at] == hashes
            for w, h, i, ok in zip(new, hashes.tolist(), self._v.place[at].tolist(), hit.tolist(), strict=True):
                if ok:
                    known[w] = i
                else:
                    known[w] = len(self._v.counts) + len(self.rare)
                    self.rare.append(h)
            return np.fromiter(map(known.__getitem__, words), np.int32, len(words))

    def forget(self) -> None:
        """Starts a new list when many words are known; numbers given before lose their meaning."""
        if len(self._known) > MOST_CACHED:
            self._known.clear()
            self.rare = []


CODED = ("doc_id long, part int, codes array<int>, n_tokens long, n_frequent long, sum_frequent double, "
         "n_other long, sum_other double, rare array<long>, times array<int>")
SCORED = ("row_ long, doc_id long, n_tokens long, n_frequent long, sum_frequent double, n_other long, sum_other double, "
          "codes array<int>, model double")


def coded(docs: DataFrame, vocabulary: Vocabulary, rounds: int) -> DataFrame:
    """Word numbers of every text, its round of training (null: held out), and what its scores are made of besides.

    ``rare`` lists the words that are not sent, whose counts are joined.
    """
    words = docs.sparkSession.sparkContext.broadcast(vocabulary)
    own = vocabulary.shape.words

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value
        coder, logs, n = Coder(known), np.log10(known.counts + 1), len(known.counts)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                rows = batch.slice(start, ROWS_AT_ONCE)
                out: list[list] = [[] for _ in range(8)]
                for text in rows.column(2):
                    codes = coder.code(words_of(text.as_py()))
                    other = codes[(codes < n) & (codes >= own)]
                    rare, times = np.unique(codes[codes >= n], return_counts=True)
                    values = (np.minimum(codes, own), len(codes), int((codes < n).sum()), float(logs[codes[codes < n]].sum()),
                              int((codes >= own).sum()), float(logs[other].sum()), [coder.rare[i - n] for i in rare.tolist()], times)
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                    coder.forget()
                types = [pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(),
                         pa.list_(pa.int64()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), *[pa.array(c, t) for c, t in zip(out, types, strict=True)]],
                    [c.split()[0] for c in CODED.split(", ")])

    part = F.when(fold(F.col("doc_id")) != HELD_OUT_FOLD, F.pmod(F.xxhash64("doc_id"), F.lit(rounds)).cast("int"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), "text").mapInArrow(code, CODED)


def _portions(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First row and word numbers of the rows of a batch, some million tokens at once."""
    lists = batch.column(batch.schema.get_field_index(column))
    flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + TOKENS_AT_ONCE, side="right")) - 1)
        yield first, [flat[ends[i]:ends[i + 1]] for i in range(first, last)]
        first = last


def trained(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> gated_lm.Weights:
    """Weights after one pass over the coded training texts, averaged over the tasks after each round.

    Long texts are cut in pieces of ``LONGEST`` words, which are trained side by side.
    """
    context, weights, shape = texts.sparkSession.sparkContext, vocabulary.initial(), vocabulary.shape
    for k in range(rounds):
        start = context.broadcast(weights)

        def train(batches: Iterator[pa.RecordBatch], start=start, rate=0.01 / (k + 1)) -> Iterator[pa.RecordBatch]:
            trainer, tokens = gated_lm.Trainer(start.value, shape, rate), 0
            for batch in batches:
                for _, portion in _portions(batch, "codes"):
                    pieces, before = [], []
                    for text in portion:
                        tokens += len(text)
                        for into, new in zip((pieces, before), gated_lm.cut(text, LONGEST), strict=True):
                            into.extend(new)
                    trainer.learn(*gated_lm.laid_out(pieces, LANES, before)[:3])
            if tokens:
                change = gated_lm.as_vector(trainer.weights) - gated_lm.as_vector(start.value)
                pieces = [change[i:i + PIECE].astype(np.float16).tobytes() for i in range(0, len(change), PIECE)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary()),
                     pa.array([tokens] * len(pieces), pa.int64())], ["piece", "change", "tokens"])

        part = texts.where(F.col("part") == k).select("codes")
        groups = ceil(part.rdd.getNumPartitions() / TOGETHER) or 1
        changes = part.mapInArrow(train, CHANGES).withColumn("group", F.pmod(F.spark_partition_id(), F.lit(groups)))
        grouped = changes.groupBy("piece", "group").applyInPandas(_average, CHANGES)
        rows = grouped.groupBy("piece").applyInPandas(_average, CHANGES).collect()  # as many numbers as the model has
        if rows:
            change = np.concatenate([np.frombuffer(r["change"], np.float16) for r in sorted(rows, key=lambda r: r["piece"])])
            weights = gated_lm.from_vector(gated_lm.as_vector(weights) + change.astype(np.float32), weights)
    return weights


CHANGES = "piece int, change binary, tokens long"


def _average(rows):
    import pandas as pd

    rows = rows.sort_values("change")
    total, mean = int(rows["tokens"].sum()), 0.0
    for change, n in zip(rows["change"], rows["tokens"], strict=True):
        mean = mean + np.frombuffer(change, np.float16).astype(np.float32) * np.float32(n / total)
    return pd.DataFrame({"piece": [rows["piece"].iloc[0]], "change": [mean.astype(np.float16).tobytes()], "tokens": [total]})


def scored(texts: DataFrame, vocabulary: Vocabulary, weights: gated_lm.Weights) -> DataFrame:
    """``texts`` with the model's log10 score of their word numbers."""
    shape, columns = vocabulary.shape, [c.split()[0] for c in SCORED.split(", ")]
    shared = texts.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model = np.zeros(batch.num_rows)
            for first, portion in _portions(batch, "codes"):
                model[first:first + len(portion)] = gated_lm.score(
                    shared.value, shape, *gated_lm.laid_out(portion, LANES), len(portion)) / log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model, pa.float64())], columns)

    return texts.select(columns[:-1]).mapInArrow(score, SCORED).drop("codes")


def scores(docs: DataFrame, shape: Shape | None = None, frequent: float = FREQUENT, rounds: int = ROUNDS) -> DataFrame:
    """Base score and model score (log10) of every document, with its numbers of tokens.

    Without a ``shape`` the model has all frequent words that occur twice or more.
    """
    training = docs.where(fold(F.col("doc_id")) != HELD_OUT_FOLD)
    counts = stage(word_counts(training))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("words")).first()
    tokens, distinct = sums["tokens"], sums["words"]
    listed = counts.where(F.col("n") >= max(1.0, frequent * tokens)).collect()  # 1 / frequent words at most
    vocabulary = Vocabulary([(r["word"], r["n"]) for r in listed], tokens, distinct, shape)
    # texts are coded once; the number of a row is fixed by being written
    texts = stage(coded(docs, vocabulary, rounds).withColumn("row_", F.monotonically_increasing_id()))
    weights = trained(texts, vocabulary, rounds)
    rare = texts.select("row_", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row_", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = rare.join(counts.where(F.col("n") < max(1.0, frequent * tokens)), "word").groupBy("row_").agg(
        F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("sum_rare"))
    sum_rare, n_rare = F.coalesce("sum_rare", F.lit(0.0)), F.coalesce("n_rare", F.lit(0))
    return scored(texts, vocabulary, weights).join(found, "row_", "left").select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"), "n_tokens",
        (F.col("n_frequent") + n_rare).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("sum_frequent") + sum_rare - F.col("n_tokens") * log10(tokens + distinct + 1)).alias("base_score"),
        (F.col("model") + F.col("sum_other") + sum_rare
         - F.col("n_other") * log10(max(1.0, vocabulary.other_mass))).alias("score"))
