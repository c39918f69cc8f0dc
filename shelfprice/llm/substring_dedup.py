"""Substring dedup: words that a run of 20 words repeats from earlier text are removed.

A window is 20 consecutive words. Every word of a window whose words also begin earlier (in a
document with a smaller id, or earlier in the same one) is removed. Matching is exact, by
suffix automata: a shard of the text is read in order of position, each piece is first run
through the automaton of the earlier ones, which gives its matching statistics (the longest
match that ends at each word), and then added to it.

Broadcasting the automata of all shards to all documents would cost shards times documents,
which grows with the square of the corpus. So shards are made of what can match at all:

* A window's anchor is the least hash among its 6-word runs, equal windows have equal anchors.
  The windows of a document with one anchor form a segment, and shards are keyed by anchor,
  so a window meets all its equals in one shard. Segments whose anchor occurs once are done.
* Very frequent runs (at least a share ``HOT`` of all, so at most 1 / HOT of them) are only
  anchors of windows that have no other run. The windows at the rims of a passage that very many
  documents share are then spread over other anchors, and what is left in the hot shards
  is the same few segments over and over.
* Equal segments are combined map-side first; all but the earliest are repeats as a whole, and most
  words are removed there, by the hash of the segment. Only the earliest of each goes to its shard's
  automaton, if other segments are there.

Words are compared by 64-bit hashes. Texts are moved compressed, twice; all else that is moved is a few
numbers per segment.

Defined results: a null text has no words; rows without id count as one document that comes
last; equal rows (same id and text) have equal results and do not count as earlier text of each
other; texts under 20 words stay whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfprice.llm.shingles import mixed, windows, word_hashes
from shelfprice.operators.staging import stage

WINDOW = 20
RUN = 6
HOT = 1e-5
SIZE_BITS = 8
LAST_DOC = (1 << 63) - 1
_HOT_BIT, _PLACE = np.uint64(1 << 63), np.uint64((1 << 24) - 1)


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self):
        self._next: list[dict[int, int]] = [{}]
        self._link, self._length = [-1], [0]

    def _state(self, length: int, link: int, after: dict[int, int]) -> int:
        self._next.append(after)
        self._link.append(link)
        self._length.append(length)
        return len(self._length) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """A state for the prefix of ``q`` that follows ``p``; ``q`` itself if it is that."""
        if self._length[q] == self._length[p] + 1:
            return q
        clone = self._state(self._length[p] + 1, self._link[q], dict(self._next[q]))
        self._link[q] = clone
        while p >= 0 and self._next[p].get(word) == q:
            self._next[p][word] = clone
            p = self._link[p]
        return clone

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            known = self._next[last].get(word)
            if known is not None:
                last = self._split(last, known, word)
                continue
            new, p = self._state(self._length[last] + 1, 0, {}), last
            while p >= 0 and word not in self._next[p]:
                self._next[p][word] = new
                p = self._link[p]
            if p >= 0:
                self._link[new] = self._split(p, self._next[p][word], word)
            last = new

    def matches(self, words: list[int]) -> list[int]:
        """Matching statistics: length of the longest known substring that ends at each word."""
        state, length, out = 0, 0, []
        for word in words:
            while state > 0 and word not in self._next[state]:
                state = self._link[state]
                length = self._length[state]
            after = self._next[state].get(word)
            state, length = (after, length + 1) if after is not None else (0, 0)
            out.append(length)
        return out


def _raw(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def _tag(raw: bytes) -> int:
    """Signed 64-bit hash of a text, which tells rows of one id (or of none) apart."""
    tag = xxhash.xxh3_64_intdigest(raw, seed=1)
    return tag - (1 << 64) if tag >> 63 else tag


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_DOC)).alias("doc"), "text")


def hot_runs(docs: DataFrame, share: float = HOT) -> np.ndarray:
    """Sorted hashes of the word runs that make up at least about a share of all; 1 / share of them at most.

    A run is counted where it is frequent in a portion of a task's texts; what is missed
    changes the balance of the shards, not the result.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, held, total = [], 0, 0
            found: list[tuple[np.ndarray, np.ndarray]] = []

            def counted(runs: list[np.ndarray], held: int) -> None:
                values, times = np.unique(np.concatenate(runs), return_counts=True)
                often = times >= max(2, int(share * held))
                found.append((values[often].astype(np.int64), times[often]))

            for text in batch.column(0):
                own = windows(word_hashes(_raw(text)), RUN)
                runs.append(own)
                held += len(own)
                total += len(own)
                if held > 400_000:
                    counted(runs, held)
                    runs, held = [], 0
            if held:
                counted(runs, held)
            values = [v for v, _ in found] + [np.array([0])]
            times = [t for _, t in found] + [np.array([total])]
            kinds = [np.zeros(len(v), bool) for v, _ in found] + [np.array([True])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(values), pa.int64()), pa.array(np.concatenate(times), pa.int64()),
                 pa.array(np.concatenate(kinds))], ["run", "n", "is_sum"])

    counts = stage(docs.select("text").mapInArrow(count, "run long, n long, is_sum boolean").groupBy("is_sum", "run").agg(
        F.sum("n").alias("n")))
    total = counts.where("is_sum").agg(F.sum("n")).first()[0] or 0
    rows = counts.where(~F.col("is_sum") & (F.col("n") >= max(64.0, share * total))).select("run").collect()
    return np.sort(np.array([r["run"] for r in rows], np.int64).astype(np.uint64))


def _segments_of(hashes: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchor, identity, first window and number of windows of the segments of a text of 20 words or more."""
    runs = windows(hashes, RUN)
    rank = runs >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, runs), len(hot) - 1)
        rank = np.where(hot[at] == runs, rank | _HOT_BIT, rank)
    # least of 15 neighbouring runs, the leftmost if equal, from least of 2, 4 and 8
    least = (rank & ~_PLACE) | (np.arange(len(runs), dtype=np.uint64) & _PLACE)
    for step in (1, 2, 4):
        least = np.minimum(least[:-step], least[step:])
    rest = WINDOW - RUN + 1 - 8
    least = np.minimum(least[:-rest], least[rest:])
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    last = np.append(first[1:], len(least)) - 1
    whole = windows(hashes, WINDOW)
    size = (last - first + 1).astype(np.uint64)
    place = (least[first] & _PLACE).astype(np.int64)
    place += (first - place + int(_PLACE)) // (int(_PLACE) + 1) * (int(_PLACE) + 1)
    return runs[place], mixed(whole[first] * np.uint64(3) + whole[last] * np.uint64(5) + size), first, size


def segments(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """One row per segment: anchor, identity, document, text tag, and packed first word and windows."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                keys, ids, docs_, tags, packed = [], [], [], [], []
                part = batch.slice(k, 500)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    raw = _raw(text)
                    hashes = word_hashes(raw)
                    if len(hashes) < WINDOW:
                        continue
                    anchor, identity, first, size = _segments_of(hashes, shared.value)
                    keys.append(anchor.view(np.int64))
                    ids.append(identity.view(np.int64))
                    docs_.append(np.full(len(first), doc, np.int64))
                    tags.append(np.full(len(first), _tag(raw), np.int64))
                    packed.append((first << SIZE_BITS) | size.astype(np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x)) for x in (keys, ids, docs_, tags, packed)],
                        ["anchor", "segment", "doc", "tag", "at"])

    return docs.mapInArrow(emit, "anchor long, segment long, doc long, tag long, at long")


def _start(at):
    return F.shiftright(at, SIZE_BITS)


def _size_of(at):
    return at.bitwiseAND(F.lit((1 << SIZE_BITS) - 1)).cast("int")


def repeats_and_rest(rows: DataFrame) -> DataFrame:
    """Per text (``doc``, ``tag``): its segments that repeat as a whole, and those to be matched, with their anchors."""
    # counts are written before they are joined: a join of two plain tables can split a frequent key
    again = stage(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"))
    near = stage(rows.join(again, "anchor", "left_semi"))  # read three times below
    first = stage(near.groupBy("segment").agg(F.min(F.struct("doc", "at", "tag")).alias("first"), F.min("anchor").alias("anchor")))
    mixed_ = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    later = near.drop("anchor").join(first.select("segment", "first"), "segment").where(
        (F.col("doc") > F.col("first.doc"))
        | ((F.col("doc") == F.col("first.doc")) & (_start(F.col("at")) > _start(F.col("first.at")))))
    rest = first.join(mixed_, "anchor").select("first.doc", "first.tag", "first.at", "anchor")
    every = later.select("doc", "tag", "at", F.lit(None).cast("long").alias("anchor")).unionByName(rest)
    entry = F.struct(_start(F.col("at")).alias("start"), _size_of(F.col("at")).alias("size"), "anchor")
    lists = every.groupBy("doc", "tag").agg(F.collect_list(entry).alias("entries"))
    return lists.select(
        "doc", "tag",
        F.transform(F.filter("entries", lambda e: e["anchor"].isNull()), lambda e: F.struct(e["start"], e["size"])).alias("again"),
        F.filter("entries", lambda e: e["anchor"].isNotNull()).alias("rest"))


def compressed(docs: DataFrame) -> DataFrame:
    """``doc``, ``tag`` and the compressed text."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            raws = [_raw(t) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_tag(r) for r in raws], pa.int64()), pa.array(map(squeeze, raws), pa.binary())],
                ["doc", "tag", "packed"])

    return docs.mapInArrow(pack, "doc long, tag long, packed binary")


def pieces(texts: DataFrame) -> DataFrame:
    """The words of the segments to be matched: ``anchor``, ``doc``, ``tag``, ``start`` and word hashes."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows: list[tuple] = []
            for doc, tag, packed, rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = word_hashes(unpack(packed))
                rows += [(e["anchor"], doc, tag, e["start"], own[e["start"]:e["start"] + e["size"] + WINDOW - 1].tobytes())
                         for e in rest]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                ["anchor", "doc", "tag", "start", "words"])

    return texts.select("doc", "tag", "packed", "rest").mapInArrow(
        cut, "anchor long, doc long, tag long, start long, words binary")


def matched(parts: DataFrame) -> DataFrame:
    """Windows (``doc``, ``tag``, ``start``, ``size`` of a row of them) that an earlier piece of their shard has."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton, waiting, place = None, SuffixAutomaton(), [], None
        for batch in batches:
            out: list[tuple] = []
            for anchor, doc, tag, start, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = np.frombuffer(raw, np.uint64).tolist()
                if anchor != shard:
                    shard, automaton, waiting = anchor, SuffixAutomaton(), []
                elif (doc, start) != place:  # what begins at the same place is not earlier
                    for piece in waiting:
                        automaton.add(piece)
                    waiting = []
                place = doc, start
                hit = np.flatnonzero(np.array(automaton.matches(words)[WINDOW - 1:]) >= WINDOW)
                if len(hit):
                    ends = np.flatnonzero(np.append(np.diff(hit) > 1, True))
                    begin = np.append(0, ends[:-1] + 1)
                    out += [(doc, tag, start + int(hit[b]), int(hit[e] - hit[b]) + 1) for b, e in zip(begin, ends, strict=True)]
                waiting.append(words)
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)],
                ["doc", "tag", "start", "size"])

    return parts.repartition("anchor").sortWithinPartitions("anchor", "doc", "start").mapInArrow(
        stream, "doc long, tag long, start long, size int")


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def removed(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``doc_id``, words, removed words, checksum of the kept words and, if asked for, the kept words themselves."""
    numbered = _numbered(docs)
    lists = stage(repeats_and_rest(stage(segments(numbered, hot_runs(docs)))))
    texts = compressed(numbered)
    to_match = lists.where(F.size("rest") > 0).select("doc", "tag", "rest")
    found = stage(matched(pieces(texts.join(to_match, ["doc", "tag"]))))
    spans = F.collect_list(F.struct("start", "size")).alias("spans")
    every = (
        lists.where(F.size("again") > 0).select("doc", "tag", F.explode("again").alias("s")).select(
            "doc", "tag", F.col("s.start").alias("start"), F.col("s.size").alias("size"))
        .unionByName(found).groupBy("doc", "tag").agg(spans))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for doc, packed, gone in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                words = unpack(packed).split()
                n = len(words)
                if gone:
                    change = np.zeros(n + 1, np.int64)
                    for s in gone:
                        change[s["start"]] += 1
                        change[s["start"] + s["size"] + WINDOW - 1] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:n]) == 0).tolist()]
                kept = b" ".join(words)
                rows.append((None if doc == LAST_DOC else doc, n, n - len(words), hashlib.sha256(kept).hexdigest(),
                             kept.decode("utf-8", "surrogatepass") if with_text else None))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
                [c.split()[0] for c in RESULT.split(", ")])

    return texts.join(every, ["doc", "tag"], "left").select("doc", "packed", "spans").mapInArrow(keep, RESULT)
