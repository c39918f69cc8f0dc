"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A fingerprint is a sum over the paragraphs (``\\n``-split) of a text, so it does not depend
on their order, and paragraphs can be added to it or taken from it without the text.
It has two parts, both sums of wide vectors modulo powers of two:

* ``dense``: 8 lanes modulo 2^32, the halves of four 64-bit hashes of the paragraph's
  SHA-256. Equal multisets of paragraphs have equal lanes; different ones differ except
  by chance.
* ``signs``: 120 lanes modulo 2^20 in 40 longs, to which each sentence of a paragraph gives
  a vector of plus or minus one. The scalar product of two such vectors estimates how many
  sentences two texts have in common, with a standard error of about 1/sqrt(120) of their
  number; ``likeness`` is that product over the mean square.

The pieces of a text are exploded and summed again by plain aggregates, which stay inside
generated code; a text's pieces never leave its task before they are summed.

Defined results: a null text is an empty text, an empty text has the zero fingerprint, and
two zero fingerprints have likeness 1. Repeated rows each get their own result. The lanes
wrap at 2^20 sentences, after which likeness is a rough figure; equality is not affected.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfprice.llm.common import let

DENSE_HASHES = 4
SIGN_HASHES = 2
LANE_BITS = 20
LANES_IN_LONG = 3
_LANE = (1 << LANE_BITS) - 1
_UNIT = sum(1 << (LANE_BITS * k) for k in range(LANES_IN_LONG))
_LOW32 = 0xFFFFFFFF
SENTENCE_END = "(?<=[.!?])[\\x20\\x09-\\x0D]+|\n"
SUMS = [f"d{k}" for k in range(2 * DENSE_HASHES)] + [f"s{k}" for k in range(SIGN_HASHES * LANE_BITS)]


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def pieces(text: Column) -> Column:
    """The paragraphs and the sentences of a text, as structs of the piece and whether it is a paragraph."""
    text = F.coalesce(text, F.lit(""))

    def marked(values: Column, paragraph: bool) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(paragraph).alias("whole"), x.alias("piece")))

    paragraphs = F.when(F.length(text) > 0, F.split(text, "\n", -1)).otherwise(F.array().cast("array<string>"))
    sentences = F.filter(F.split(text, SENTENCE_END, -1), lambda x: F.length(x) > 0)
    return F.concat(marked(paragraphs, True), marked(sentences, False))


def summed(rows: DataFrame, keys: list[str], parts: str) -> DataFrame:
    """Fingerprint (column ``lanes``) of each group of ``keys``, whose rows have an array ``parts`` of pieces."""
    whole, piece = F.col("part_.whole"), F.col("part_.piece")
    each = rows.select(*keys, F.explode_outer(parts).alias("part_")).select(
        *keys, (~F.coalesce(whole, F.lit(True))).alias("sentence_"),
        F.when(whole, F.sha2(piece, 256)).otherwise(piece).alias("value_"))
    hashes = [F.when(~F.col("sentence_"), F.xxhash64("value_", F.lit(k))).alias(f"dh{k}") for k in range(DENSE_HASHES)]
    hashes += [F.when(F.col("sentence_"), F.xxhash64("value_", F.lit(1000 + k))).alias(f"sh{k}")
               for k in range(SIGN_HASHES)]
    hashed = each.select(*keys, (F.col("sentence_") & F.col("value_").isNotNull()).cast("long").alias("n_"),
                         F.col("value_").isNull().alias("none_"), *hashes)
    dense, signs = [], []
    for k in range(DENSE_HASHES):
        h = F.when(~F.col("none_"), F.col(f"dh{k}"))
        dense += [F.try_sum(h.bitwiseAND(_long(_LOW32))), F.try_sum(F.shiftrightunsigned(h, 32))]
    for k in range(SIGN_HASHES):
        h = F.when(~F.col("none_"), F.col(f"sh{k}"))
        signs += [F.try_sum(F.shiftrightunsigned(h, j).bitwiseAND(_long(_UNIT))) for j in range(LANE_BITS)]
    sums = hashed.groupBy(*keys).agg(
        F.sum("n_").alias("n"), *[F.coalesce(c, _long(0)).alias(name) for c, name in zip(dense + signs, SUMS, strict=True)])
    lanes = F.struct(
        F.col("n"),
        F.array(*[F.col(c).bitwiseAND(_long(_LOW32)) for c in SUMS if c[0] == "d"]).alias("dense"),
        F.array(*[F.col(c) for c in SUMS if c[0] == "s"]).alias("raw"))
    return sums.select(*keys, lanes.alias("lanes")).withColumn("lanes", F.struct(
        "lanes.n", "lanes.dense", F.transform("lanes.raw", _wrapped).alias("signs")))


def _wrapped(packed: Column) -> Column:
    """Packed lanes, each modulo 2^20; carries between lanes are part of the sum and stay."""
    return packed.bitwiseAND(_long((1 << (LANE_BITS * LANES_IN_LONG)) - 1))


def _lanewise(a: Column, b: Column, sign: int) -> Column:
    return F.zip_with(a, b, lambda x, y: _wrapped(x + sign * y))


def added(a: Column, b: Column) -> Column:
    """Fingerprint of the paragraphs of ``a`` and of ``b``."""
    return _combined(a, b, 1)


def removed(a: Column, b: Column) -> Column:
    """Fingerprint of ``a`` without the paragraphs of ``b``."""
    return _combined(a, b, -1)


def _combined(a: Column, b: Column, sign: int) -> Column:
    return F.struct(
        (a["n"] + sign * b["n"]).alias("n"),
        F.zip_with(a["dense"], b["dense"], lambda x, y: (x + sign * y).bitwiseAND(_long(_LOW32))).alias("dense"),
        _lanewise(a["signs"], b["signs"], sign).alias("signs"))


def as_text(fp: Column) -> Column:
    """The lanes in lower-case hexadecimal, dense lanes first."""
    def hexed(values: Column, width: int) -> Column:
        return F.array_join(F.transform(values, lambda x: F.lpad(F.lower(F.hex(x)), width, "0")), "")
    return F.concat(hexed(fp["dense"], 8), hexed(fp["signs"], LANE_BITS * LANES_IN_LONG // 4))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common sentences of two fingerprints, 0 to 1; 1 if they are equal."""
    def vector(fp: Column) -> Column:
        return F.flatten(F.transform(fp["signs"], lambda x: F.array(*[
            (2 * F.shiftright(x, LANE_BITS * k).bitwiseAND(_long(_LANE)) - fp["n"]).cast("double")
            for k in range(LANES_IN_LONG)])))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    def ratio(va: Column, vb: Column) -> Column:
        size = total(F.zip_with(va, vb, lambda x, y: x * x + y * y))
        return F.when(size > 0, 2 * total(F.zip_with(va, vb, lambda x, y: x * y)) / size).otherwise(0.0)

    estimate = let(F.struct(vector(a).alias("a"), vector(b).alias("b")), lambda v: ratio(v["a"], v["b"]))
    same = (a["dense"] == b["dense"]) & (a["signs"] == b["signs"])
    return F.when(same, 1.0).otherwise(F.least(F.greatest(estimate, F.lit(0.0)), F.lit(1.0)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``lanes`` and printed ``fingerprint`` of every document; rows with one id are one multiset."""
    rows = docs.select("doc_id", pieces(F.col("text")).alias("parts"))
    return summed(rows, ["doc_id"], "parts").withColumn("fingerprint", as_text(F.col("lanes")))


# ---- the next document in order of doc_id

NULL_RANGES = 16


def _bounds(docs: DataFrame, n: int) -> list[int]:
    """At most n - 1 approximate quantiles of ``doc_id``: the ends of the ranges."""
    probes = [k / n for k in range(1, n)]
    if not probes:
        return []
    found = docs.select(F.percentile_approx("doc_id", probes, 100 * n).alias("q")).first()["q"]
    return sorted(set(found or []))


def _range_of(value: Column, bounds: list[int]) -> Column:
    """Number of bounds below ``value``, by a two-level search of the literal array."""
    if not bounds:
        return F.lit(0)
    step = isqrt(len(bounds)) + 1
    top = F.array(*[_long(b) for b in bounds[step - 1::step]])
    every = F.array(*[_long(b) for b in bounds])
    first = F.size(F.filter(top, lambda b: b < value)) * step
    return first + F.size(F.filter(F.slice(every, first + 1, F.lit(step)), lambda b: b < value))


def in_ranges(docs: DataFrame) -> DataFrame:
    """Text and id of every row, dealt out by ranges of ``doc_id`` that also hold the next range's first row.

    There are as many ranges as shuffle partitions (10,000 at most). The first row of a
    range is also sent to the range before it, as ``ghost_``, that of the first range to
    the last: each range then finds all successors by itself, and the text is shuffled
    once. Rows with equal ids are ordered by a hash of the text; rows without id come last, in
    order of that hash. ``at_`` numbers the rows of a range, ghosts last.
    """
    n = min(10_000, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = _bounds(docs, n)
    text = F.coalesce(F.col("text"), F.lit(""))
    order, has_id = F.xxhash64(text), F.col("doc_id").isNotNull()
    own = F.when(has_id, _range_of(F.col("doc_id"), bounds)).otherwise(
        F.lit(len(bounds) + 1 + NULL_RANGES // 2) + F.shiftright(order, 60).cast("int"))
    firsts = (  # one row per range
        docs.where(has_id).groupBy(own.alias("r")).agg(F.min("doc_id").alias("id"), F.lit(None).cast("long").alias("o"))
        .unionByName(docs.where(~has_id).groupBy(own.alias("r")).agg(
            F.lit(None).cast("long").alias("id"), F.min(order).alias("o"))).collect())
    starts = {r["r"]: r for r in firsts}
    filled = sorted(starts)
    size = len(bounds) + 1 + NULL_RANGES

    def looked_up(values: dict[int, int]) -> Column:
        return F.get(F.array(*[F.lit(values.get(k)).cast("long") for k in range(size)]), F.col("own_"))

    before = looked_up({r: filled[i - 1] for i, r in enumerate(filled)})
    first = F.coalesce(
        F.when(F.col("doc_id").isNotNull(), F.col("doc_id") == looked_up({r: x["id"] for r, x in starts.items()}))
        .otherwise(F.col("order_") == looked_up({r: x["o"] for r, x in starts.items()})), F.lit(False))
    here = F.struct(F.col("own_").cast("long").alias("r"), F.lit(False).alias("ghost"))
    there = F.struct(before.alias("r"), F.lit(True).alias("ghost"))
    return (
        docs.select("doc_id", text.alias("text_"), order.alias("order_"), own.cast("int").alias("own_"))
        .withColumn("to_", F.explode(F.when(first, F.array(here, there)).otherwise(F.array(here))))
        .select("doc_id", "text_", "order_", F.col("to_.r").alias("range_"), F.col("to_.ghost").alias("ghost_"))
        .withColumn("at_", F.row_number().over(Window.partitionBy("range_").orderBy("ghost_", "doc_id", "order_")))
    )


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next document in order of ``doc_id``; the first follows the last.
    Everything after the one shuffle of the text happens inside a range.
    """
    text, n = F.col("text_"), F.length("text_")
    half = F.floor(n / 2).cast("int")
    order = Window.partitionBy("range_").orderBy("at_")
    edited = F.concat(F.substring(text, F.lit(1), n - half), F.substring(F.col("next_"), F.lit(1), half))
    both = (
        in_ranges(docs).withColumn("next_", F.lead("text_").over(order))
        .select("range_", "at_", "doc_id", "ghost_", "text_", n.cast("long").alias("n_chars"), edited.alias("edited_"))
        .withColumn("edited_sha256", F.sha2(F.coalesce("edited_", F.lit("")), 256)))
    keys = ["range_", "at_", "side_", "ghost_", "doc_id", "n_chars", "edited_sha256"]
    sides = both.withColumn("version_", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("text_").alias("text")),
        F.struct(F.lit(1).alias("side"), F.col("edited_").alias("text")))))
    lanes = summed(sides.select(
        *[c for c in keys if c != "side_"], F.col("version_.side").alias("side_"),
        pieces(F.col("version_.text")).alias("parts_")), keys, "parts_")
    turn = Window.partitionBy("range_").orderBy("at_", "side_")
    return (
        lanes.withColumn("edited_lanes_", F.lead("lanes", 1).over(turn))
        .withColumn("next_lanes_", F.lead("lanes", 2).over(turn))
        .where("side_ = 0 AND NOT ghost_")
        .select("doc_id", "n_chars", "edited_sha256",
                as_text(F.col("lanes")).alias("fingerprint"), as_text(F.col("edited_lanes_")).alias("edited_fingerprint"),
                likeness(F.col("lanes"), F.col("edited_lanes_")).alias("near_edited"),
                likeness(F.col("lanes"), F.col("next_lanes_")).alias("near_next")))
