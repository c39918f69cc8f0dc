"""Spelling variants: words that differ by one inserted, deleted or replaced letter, and the form each stands for.

The dictionary of all words is held as two tries. Every node of the trie of the words (a prefix)
and of the trie of the reversed words (a suffix) has a number. A word of length L gives

* for each position i a *skip* pair (node of the i letters before it, node of the letters behind it),
* for each place i between letters a *split* pair (node of the first i letters, node of the rest).

Pairs are joined on both numbers. Words with the same skip pair differ in that letter only; a skip
pair that equals a split pair means that the letter was inserted in the one word or deleted from
the other. Within a run of equal letters only the first deletion counts, so every pair of near
words meets under exactly one key. The numbers stand for the letters exactly, there is nothing to verify.

How it scales:

* Words are counted in the tasks that read the texts and flushed at ``MOST_HELD`` words, so a
  frequent word is one row per flush.
* Tries are numbered over ranges of the sorted words: words that share a prefix are neighbours there.
  The only prefixes that can cross from one range to the next are those of its first word;
  these are named by the first range that begins with them. The driver sees two words of each range.
* A prefix or suffix that no other word has cannot join, so a word gives only the pairs
  whose both nodes are shared with a neighbour in sort order.
* Words with one skip pair differ in one letter, so there are at most as many as the alphabet
  has letters, and one split pair: no key is hot, and no pairs of words are made within a key.
* Forms are followed from the roots up, level by level; a form occurs at least twice as often as
  the word, so the levels are at most the logarithm of the largest count.

Defined results: a null text has no words; a null id is written as an empty string when a
word is hashed; repeated rows count once each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfprice.operators.numbering import in_ranges, numbered
from shelfprice.operators.staging import stage

LEAST_LENGTH, LEAST_COUNT = 5, 3
#: One in this many words of a document loses a letter before it is counted.
CUT_ONE_IN = 97
#: A form occurs at least this many times as often as the word.
FORM_RATIO = 2
MOST_HELD = 200_000
_BATCH = 4096
_PART_BITS = 40
#: Kinds of pairs: a skipped letter, one that equals the letter before it, a split between letters.
SKIP, SKIP_AGAIN, SPLIT = 0, 1, 2

#: Latin-1 bytes: capital A-Z become small, the other letters stay, all else separates words.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def words_of(doc_id: int | None, text: str | None) -> dict[bytes, int]:
    """Counts of the words of a document as Latin-1 bytes, a letter cut from one in ``CUT_ONE_IN``."""
    start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    out: dict[bytes, int] = {}
    runs = (text or "").encode("latin-1", "replace").translate(_LETTERS).split()
    for run, n in Counter(runs).items():
        plain = run if run.isascii() else run.decode("latin-1").encode()
        h = zlib.crc32(plain, start)
        if h % CUT_ONE_IN == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        if len(run) >= LEAST_LENGTH:
            out[run] = out.get(run, 0) + n
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """Words of all documents with at least ``LEAST_COUNT`` occurrences ``n``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def flushed() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for word, n in words_of(doc_id, text.as_py()).items():
                    held[word] = held.get(word, 0) + n
                if len(held) >= MOST_HELD:
                    yield flushed()
        yield flushed()

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def shared(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    if b.startswith(a):
        return len(a)
    at = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        at += 1
    return at


class RangeEnds:
    """First and last word of every range of a sorted list of words, and the names of the prefixes that cross ranges."""

    def __init__(self, ends: Iterable[tuple[int, str, str]]):
        self._ends = sorted(ends)
        self._index = {part: k for k, (part, _, _) in enumerate(self._ends)}
        #: For each range and depth the first range that begins with this prefix of its first word.
        self._begun: list[list[int]] = []
        for k, (_, first, _) in enumerate(self._ends):
            before = shared(self._ends[k - 1][1], first) + 1 if k else 0
            self._begun.append((self._begun[-1][:before] if k else []) + [k] * (len(first) + 1 - before))

    def around(self, part: int) -> tuple[str | None, str | None]:
        """Last word before the range and first word after it."""
        k = self._index[part]
        return (self._ends[k - 1][2] if k else None), (self._ends[k + 1][1] if k + 1 < len(self._ends) else None)

    def name(self, part: int, depth: int, following: bool) -> int:
        """Number of a prefix of the first word of the range, or of the one that follows."""
        return -(self._begun[self._index[part] + following][depth] << _PART_BITS) - depth - 1


def shared_prefixes(words: Iterator[str], part: int, ends: RangeEnds) -> Iterator[list[int]]:
    """For each word of a sorted range the numbers of its prefixes of length 0, 1, ... that another word has too."""
    before, after = ends.around(part)
    last, word = before, next(words, None)
    stack: list[int] = []
    made = 0
    while word is not None:
        following = next(words, None)
        beside = after if following is None else following
        with_last = -1 if last is None else shared(last, word)
        most = max(with_last, -1 if beside is None else shared(word, beside))
        if not stack:  # the first word of the range
            stack = [ends.name(part, d, False) for d in range(max(most, 0) + 1)]
        else:
            del stack[with_last + 1:]
            crossing = -1 if after is None else shared(word, after)
            for depth in range(len(stack), most + 1):
                if depth <= crossing:
                    stack.append(ends.name(part, depth, True))
                else:
                    stack.append((part << _PART_BITS) + made)
                    made += 1
        yield stack[:most + 1]
        last, word = word, following


def _ends(rows: DataFrame, word: str) -> RangeEnds:
    found = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.min(word).alias("first"), F.max(word).alias("last"))
    return RangeEnds([(r["part"], r["first"], r["last"]) for r in found.collect()])  # two words per range


def _with_nodes(rows: DataFrame, word: str, nodes: str) -> DataFrame:
    """``rows``, sorted in ranges of ``word``, with the numbers of its shared prefixes as a list of longs."""
    ends = _ends(rows, word)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        waiting: list[pa.RecordBatch] = []

        def listed() -> Iterator[str]:
            for batch in batches:
                if batch.num_rows:
                    waiting.append(batch)
                    yield from batch.column(word).to_pylist()

        found: list[list[int]] = []
        # the list runs one word ahead of what is found, so a batch is complete before the one behind the next is read
        for numbers in shared_prefixes(listed(), part, ends):
            found.append(numbers)
            if len(found) == waiting[0].num_rows:
                yield waiting.pop(0).append_column(nodes, pa.array(found, pa.list_(pa.int64())))
                found = []

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(number, f"{kinds}, {nodes} array<bigint>")


def word_pairs(word: str, prefixes: list[int], suffixes: list[int]) -> Iterator[tuple[int, int, int]]:
    """(prefix node, suffix node, kind) of the pairs of a word whose nodes are both shared."""
    length, deepest, longest = len(word), len(prefixes) - 1, len(suffixes) - 1
    for i in range(max(0, length - 1 - longest), min(deepest, length - 1) + 1):
        yield prefixes[i], suffixes[length - 1 - i], SKIP_AGAIN if i and word[i] == word[i - 1] else SKIP
    for i in range(max(0, length - longest), min(deepest, length) + 1):
        yield prefixes[i], suffixes[length - i], SPLIT


def _pairs(words: DataFrame) -> DataFrame:
    """(prefix, suffix, member) of all words; the member is four times the word's rank plus the kind."""
    forward = _with_nodes(in_ranges(words.select("word", "rank"), "word"), "word", "prefixes")
    backward = in_ranges(forward.withColumn("back", F.reverse("word")).drop("word"), "back")
    both = _with_nodes(backward, "back", "suffixes")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, _BATCH):
                part = batch.slice(k, _BATCH)
                columns = [part.column(c).to_pylist() for c in ("rank", "back", "prefixes", "suffixes")]
                rows = [(p, s, 4 * rank + kind) for rank, back, prefixes, suffixes in zip(*columns, strict=True)
                        for p, s, kind in word_pairs(back[::-1], prefixes, suffixes)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], ["prefix", "suffix", "member"])

    return both.mapInArrow(emit, "prefix long, suffix long, member long")


def near_words(words: DataFrame) -> DataFrame:
    """(rank, n_near, best) of the words that have near words; ``best`` is the least rank among these.

    ``words`` has ``word``, distinct, and ``rank``, distinct, the best word first.
    """
    members = F.sort_array(F.collect_list("member"))  # at most one per letter of the alphabet and a split
    groups = _pairs(words).groupBy("prefix", "suffix").agg(members.alias("members")).where(F.size("members") > 1)

    def linked(a, b):
        skips = (a % 4 < SPLIT) & (b % 4 < SPLIT) & (a != b)
        return skips | (F.abs(a % 4 - b % 4) == SPLIT - SKIP)

    each = F.transform("members", lambda a: F.struct(
        F.floor(a / F.lit(4)).alias("rank"), F.filter("members", lambda b: linked(a, b)).alias("near")))
    found = groups.select(F.inline(each)).where(F.size("near") > 0)
    return found.groupBy("rank").agg(
        F.sum(F.size("near")).alias("n_near"), F.min(F.shiftright(F.col("near")[0], 2)).alias("best"))


def forms(words: DataFrame) -> DataFrame:
    """Form and root of every word of a table of distinct words and their counts ``n``."""
    ranked = stage(numbered(words.select("word", "n"), F.col("n").desc(), "word", name="rank")[0])
    near = near_words(ranked)
    best = ranked.select(F.col("rank").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    fits = F.col("best_n") >= FORM_RATIO * F.col("n")
    table = stage(ranked.join(near, "rank", "left").join(best, "best", "left").select(
        "rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("best")).alias("form_rank"), F.when(fits, F.col("best_word")).alias("form"),
        F.when(fits, F.col("best_n")).alias("form_n")))
    children = table.where(F.col("form_rank").isNotNull())
    level = stage(table.where(F.col("form_rank").isNull()).withColumn("root", F.col("word")))
    done = level
    while not level.isEmpty():
        parents = level.select(F.col("rank").alias("form_rank"), "root")
        level = stage(children.join(parents, "form_rank").select(*done.columns))
        done = done.unionByName(level)
    return done.drop("rank", "form_rank")


def variants(docs: DataFrame) -> DataFrame:
    """``word``, its ``form`` and ``root``, and the counts ``n``, ``n_near`` and ``form_n``, over all ``docs``."""
    return forms(stage(word_counts(docs))).select("word", "form", "root", "n", "n_near", "form_n")
