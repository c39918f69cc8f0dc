"""Mixing sources to target weights by Pareto order sampling.

Sources share the words of all documents by weight, none taking more than ``most`` times
what it has. Inside a source a document is expected ``c * x`` times, ``most`` at most, where
``x`` grows with the logarithm of its size (very short documents are repeated less often)
and ``c`` is set so that the source's expected words meet its target. The whole part is
certain copies; the rest, p, is drawn by Pareto order sampling: documents are ranked by
random odds u / (1 - u) divided by their inclusion odds p / (1 - p), and taken in that
order until the source has its words. The random numbers are hashes of id and text,
so reruns agree.

How it scales: sizes are summed per source and size level, and the mix is solved on the driver
for one row per source (a mixture is a table that people weigh; more than ``MOST_SOURCES``
raises an error). The cut in the ranking is found without sorting: ranks are counted in
cells of 12 bits, then those of the cell where the target falls, and so on, so no
task sees more than 4,096 cells of a source however many rows it has. Taking a document is
then a test on its own row.

Defined results: a null text has size 0 and takes nothing; a null source is a source, last in
order; rows alike in id and text share their rank and are all taken or all left; an
empty table gives an empty mix; other columns are kept by ``repeated`` and ignored by ``mix``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfprice.llm.common import packed, word_count
from shelfprice.operators.staging import stage

MOST_SOURCES = 100_000
CELL_BITS, RANK_BITS = 12, 48
TAKING = ["scale", "cut", "short", "late_cut"]


@dataclass
class Share:
    """The mix of one source: expected copies are ``scale`` times the level.

    Ranks up to ``cut`` are taken, and up to ``late_cut`` those of at most ``short`` words.
    """

    source: str | None
    size: int
    target: float
    scale: float = 0.0
    cut: int = -1
    short: int = 0
    late_cut: int = -1


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Words of each source: by weight, at most ``most`` times its size, the excess shared again by weight."""
    total = float(sum(sizes))
    got, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes)]
    left = total
    while open_ and left > 0:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * unit >= most * sizes[i]]
        if not full:
            for i in open_:
                got[i] = weights[i] * unit
            break
        for i in full:
            got[i] = most * sizes[i]
            left -= got[i]
        open_ = [i for i in open_ if i not in set(full)]
    return got


def scale_for(levels: dict[int, int], target: float, most: float = 3.0) -> float:
    """The c for which documents of level x, with the given words, are expected ``target`` words."""
    def words(c: float) -> float:
        return sum(min(most, c * x) * w for x, w in levels.items())

    low, high = 0.0, most
    if words(high) <= target:
        return high
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if words(mid) < target else (low, mid)
    return high


def _level(size: Column) -> Column:
    return (1 + F.floor(F.log2(1.0 + size))).cast("int")


def _expected(size: Column, scale: Column, most: float) -> Column:
    return F.least(F.lit(float(most)), scale * _level(size))


def _rank(share: Column, drawn: Column) -> Column:
    """Rank of Pareto sampling as a 48-bit number: the odds ratio q as q / (1 + q)."""
    u = (F.shiftrightunsigned(drawn, 11) + 0.5) / float(1 << 53)
    a, b = u * (1 - share), (1 - u) * share
    return F.floor(a / (a + b) * float(1 << RANK_BITS)).cast("long")


def _drawn(seed: int) -> Column:
    return F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")), F.lit(seed))


def _with_shares(rows: DataFrame, shares: list[Share], columns: list[str]) -> DataFrame:
    """``rows`` joined to their source's share, whose columns start with ``mix_``."""
    session = rows.sparkSession
    kinds = {"target": "double", "scale": "double"}
    table = session.createDataFrame(
        [(s.source, *[getattr(s, c) for c in columns]) for s in shares],
        "mix_source string, " + ", ".join(f"mix_{c} {kinds.get(c, 'long')}" for c in columns))
    # MOST_SOURCES rows at most, which shares_of has checked; no text moves to those of its source
    return rows.join(F.broadcast(table), F.col("source_").eqNullSafe(F.col("mix_source")), "left")


def _ranked(sizes: DataFrame, shares: list[Share], most: float) -> DataFrame:
    """Rank of every row that one more copy may be taken of, and the words that this takes on average."""
    expected = _expected(F.col("size_"), F.col("mix_scale"), most)
    part = expected - F.floor(expected)
    return _with_shares(sizes, shares, ["scale"]).withColumn("part_", part).where("part_ > 0 AND size_ > 0").select(
        "source_", "size_", _rank(F.col("part_"), F.col("drawn_")).alias("rank_"),
        F.round(F.col("part_") * F.col("size_") * 1000).cast("long").alias("due_"))


def _cut(ranked: DataFrame, wanted: dict[str | None, float]) -> dict[str | None, tuple[int, float]]:
    """Per source the rank up to which rows have about the wanted words, and the words up to there.

    The last rank is taken if its middle lies before the wanted sum. ``ranked`` has the columns
    ``source_``, ``size_`` and ``rank_``.
    """
    session = ranked.sparkSession
    at = {source: (0, 0) for source in wanted}  # cell that the sum ends in, words before it
    cut = {source: (-1, 0.0) for source in wanted}
    for shift in range(RANK_BITS - CELL_BITS, -1, -CELL_BITS):
        if not at:
            break
        limits = session.createDataFrame(
            [(source, cell, float(wanted[source] - before)) for source, (cell, before) in at.items()],
            "mix_source string, above_ long, left_ double")
        cells = (
            ranked.join(limits, F.col("source_").eqNullSafe(F.col("mix_source")))
            .where(F.shiftright("rank_", shift + CELL_BITS) == F.col("above_"))
            .groupBy("source_", "left_", F.shiftright("rank_", shift).alias("cell_")).agg(F.sum("size_").alias("words_")))
        window = Window.partitionBy("source_").orderBy("cell_").rowsBetween(Window.unboundedPreceding, -1)
        share = F.col("words_") / 2 if shift == 0 else F.lit(0.0)
        found = (
            cells.withColumn("before_", F.coalesce(F.sum("words_").over(window), F.lit(0)))
            .where(F.col("before_") + share <= F.col("left_"))
            .groupBy("source_").agg(F.max(F.struct("cell_", "before_", "words_")).alias("m")).collect())  # a row per source
        got = {r["source_"]: r["m"] for r in found}
        for source, (cell, before) in at.items():
            m = got.get(source)
            if m is None:  # not even the first cell: all that is below it
                cut[source] = ((cell << CELL_BITS << shift) - 1, float(before))
            elif shift == 0:
                cut[source] = (m["cell_"], float(before + m["before_"] + m["words_"]))
        at = {source: (got[source]["cell_"], before + got[source]["before_"])
              for source, (_, before) in at.items() if source in got}
    return cut


def _set_cuts(sizes: DataFrame, shares: list[Share], most: float) -> None:
    """Sets the rank up to which each source takes one more copy.

    One long document at the cut can leave a source short. What is missing is then taken, in
    the same order, from the later documents that are not longer than it.
    """
    ranked = stage(_ranked(sizes, shares, most))
    due = {r["source_"]: r["due"] / 1000 for r in ranked.groupBy("source_").agg(
        F.sum("due_").alias("due")).collect()}  # one row per source
    first = _cut(ranked, due)
    missing = {source: due[source] - words for source, (_, words) in first.items() if due[source] > words}
    for s in shares:
        s.cut = first.get(s.source, (-1, 0.0))[0]
        s.short = int(missing.get(s.source, 0.0))
    later = _with_shares(ranked, shares, ["cut", "short"]).where("rank_ > mix_cut AND size_ <= mix_short").select(
        "source_", "size_", "rank_")
    second = _cut(later, missing)
    for s in shares:
        s.late_cut = second.get(s.source, (-1, 0.0))[0]


def shares_of(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7) -> list[Share]:
    """The mix of each source; ``weights`` repeat over the sources in order of code points, null last."""
    sizes = stage(docs.select(F.col("source").alias("source_"), word_count(F.col("text")).alias("size_"),
                              _drawn(seed).alias("drawn_")))
    rows = sizes.groupBy("source_", _level(F.col("size_")).alias("level_")).agg(F.sum("size_").alias("words_"))
    rows = rows.groupBy("source_").agg(F.map_from_entries(F.collect_list(F.struct("level_", "words_"))).alias("levels_"))
    found = rows.limit(MOST_SOURCES + 1).collect()  # one row per source
    if len(found) > MOST_SOURCES:
        raise ValueError(f"a mix of more than {MOST_SOURCES} sources; group them first")
    found.sort(key=lambda r: (r["source_"] is None, r["source_"] or ""))
    totals = [sum(r["levels_"].values()) for r in found]
    wanted = targets(totals, [weights[i % len(weights)] for i in range(len(found))], most)
    shares = [Share(r["source_"], n, t, scale_for(r["levels_"], t, most))
              for r, n, t in zip(found, totals, wanted, strict=True)]
    if shares:
        _set_cuts(sizes, shares, most)
    return shares


def _copies(most: float) -> Column:
    expected = _expected(F.col("size_"), F.col("mix_scale"), most)
    part = expected - F.floor(expected)
    rank = _rank(part, F.col("drawn_"))
    late = (rank <= F.col("mix_late_cut")) & (F.col("size_") <= F.col("mix_short"))
    extra = (part > 0) & ((rank <= F.col("mix_cut")) | late)
    return F.when(F.col("size_") > 0, F.floor(expected) + F.when(extra, 1).otherwise(0)).otherwise(0).cast("long")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7) -> DataFrame:
    """Size, source, target and copies of every document, and the words that the mix takes of it."""
    shares = shares_of(docs, weights, most, seed)
    rows = docs.select("doc_id", F.col("source").alias("source_"), word_count(F.col("text")).alias("size_"),
                       _drawn(seed).alias("drawn_"))
    return _with_shares(rows, shares, ["size", "target", *TAKING]).select(
        "doc_id", F.col("size_").alias("size"), F.col("mix_size").alias("source_size"),
        F.col("mix_target").alias("target"), (_copies(most) * F.col("size_")).alias("taken"),
        F.col("source_").alias("source"), _copies(most).alias("copies"))


def repeated(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with all its columns."""
    shares = shares_of(docs, weights, most, seed)
    rows = packed(docs, source_=F.col("source"), size_=word_count(F.col("text")), drawn_=_drawn(seed))
    taken = _with_shares(rows, shares, TAKING).select("row_", _copies(most).alias("copies_"))
    return taken.where("copies_ > 0").select(
        "row_", F.explode(F.sequence(F.lit(1), F.col("copies_"))).alias("copy_")).select("row_.*")
