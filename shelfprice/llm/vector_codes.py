"""Vector codes: product quantisation in whole numbers over Hilbert-sorted flat blocks.

A vector is cut into 8 parts; a part position has a codebook of 16 entries, improved over 6
rounds of nearest entries and means, all in whole numbers, so the result is the same however
the rows are dealt.

The parts of a position are sorted along a Hilbert curve and kept in flat blocks of ``BLOCK`` parts,
each with its box (least and greatest value of every component) and the sums of its components.
In a round the least and greatest distance of the box from every entry bounds those of its
parts: an entry whose least distance exceeds the smallest greatest distance of any other is not the
nearest of any part. If one entry is left, the whole block counts for it by its stored sums
without being read part by part; otherwise its parts are compared with the entries that are left.

How it scales:

* Blocks are made once, by one shuffle by ranges of the curve, and written. A round reads them and
  returns the sums of every entry per task; these are added up by key and 128 sums come back to the driver.
* Codebooks (8 * 16 entries) are all that tasks receive. Ranges split within a position, and
  equal vectors are told apart by row number, so no value is hot.
* The codes of a vector come together by its row number; errors of a label are combined map-side.

Exactness: components beyond 32 bits are kept as whole numbers of any size; distances are
computed in 64-bit numbers where these suffice and in Python's otherwise.

Defined results: vectors with null or non-finite components are dropped, and those whose length is not
the commonest positive multiple of 8 (of equally common ones the smaller). Null ids come last when the first
entries are chosen, equal ids are ordered by their components; with fewer than 16
vectors the codebooks are shorter. Every repeated row has a row. An error that no long can hold is null. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfprice.operators.joins import lookup
from shelfprice.operators.staging import stage

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
BLOCK = 64
#: Components up to this size have squared distances that fit 64 bits, for parts of up to 2,048 components.
PLAIN = 1 << 24
#: Sums travel as digits of this many bits, so that adding up any number of tasks cannot overflow.
DIGIT_BITS = 40
_LONG = (1 << 63) - 1
#: Curve keys use at most 62 bits; of longer parts the first components.
_KEY_BITS, _MOST_DEPTH = 62, 8


def hilbert_keys(cells: np.ndarray, depth: int) -> np.ndarray:
    """Places along the Hilbert curve of grid cells (rows of whole numbers below ``2 ** depth``)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    # undo the rotations from the coarsest level to the finest, then take the Gray code
    q = 1 << (depth - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (depth - 1)
    while q > 1:
        turn ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(depth - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def packed(values: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers of any size as bytes of one width each, and that width."""
    width = 4 if values.dtype == np.int64 else max((int(v).bit_length() for v in values.ravel()), default=0) // 8 + 1
    if width <= 4:
        return 4, values.astype("<i4").tobytes()
    return width, b"".join(int(v).to_bytes(width, "little", signed=True) for v in values.ravel())


def unpacked(width: int, data: bytes) -> np.ndarray:
    if width == 4:
        return np.frombuffer(data, "<i4").astype(np.int64)
    return np.array([int.from_bytes(data[k:k + width], "little", signed=True) for k in range(0, len(data), width)], object)


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite numbers: 64-bit numbers if all are below ``PLAIN``, else Python's."""
    x = values.astype(np.float64)
    if not x.size or np.abs(x).max() < PLAIN // SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    # beyond 2 ** 60 a float is a whole number, and its product might be too large for a float
    exact = [int(v) * SCALE if abs(v) > 2.0 ** 60 else math.floor(v * SCALE) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


class Survey(NamedTuple):
    """Length of the vectors that are kept, and centre and spread of their components."""

    length: int
    centre: np.ndarray
    spread: np.ndarray


def survey(vectors: DataFrame) -> Survey | None:
    """One pass over the vectors; only sums per length and component are collected. None if there are no vectors."""
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = batch.column(0)
            lengths = lists.value_lengths().to_numpy()
            for length in np.unique(lengths):
                x = lists.filter(pa.array(lengths == length)).flatten().to_numpy().astype(np.float64).reshape(-1, length)
                with np.errstate(over="ignore"):
                    new = np.stack([np.full(length, len(x), np.float64), x.sum(axis=0), (x * x).sum(axis=0)])
                sums[length] = sums.get(length, 0) + new
        for length, s in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(length, length), pa.int32()), pa.array(np.arange(length), pa.int32()), *map(pa.array, s)],
                ["length", "component", "n", "total", "squares"])

    found = vectors.select("vector").mapInArrow(add_up, "length int, component int, n double, total double, squares double")
    summed = stage(found.groupBy("length", "component").agg(*[F.sum(c).alias(c) for c in ("n", "total", "squares")]))
    commonest = summed.where("component = 0").orderBy(F.col("n").desc(), "length").first()
    if commonest is None:
        return None
    rows = summed.where(F.col("length") == commonest["length"]).orderBy("component").collect()  # one per component
    n, total, squares = np.array([[r["n"], r["total"], r["squares"]] for r in rows]).T
    with np.errstate(over="ignore", invalid="ignore"):
        centre = total / n
        spread = np.sqrt(np.maximum(squares / n - centre * centre, 0))
    usable = np.isfinite(centre) & np.isfinite(spread) & (spread > 0)
    return Survey(commonest["length"], np.where(usable, centre, 0.0), np.where(usable, spread, 1.0))


def usable(vectors: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(vec_id, vector, label) of the rows whose vector has finite components only, a multiple of 8 of them."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("vector"), F.col(f"`{label}`").alias("label"))
    whole_parts = (F.size("vector") > 0) & (F.size("vector") % PARTS == 0)
    return rows.where(F.col("vector").isNotNull() & whole_parts & F.forall("vector", finite))


def first_codebooks(vectors: DataFrame) -> np.ndarray:
    """Codebooks (part, entry, component) from the vectors of the smallest ids."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    entries = whole(np.array([r["vector"] for r in rows]))
    return entries.reshape(len(rows), PARTS, -1).transpose(1, 0, 2).copy()


def blocks(vectors: DataFrame, seen: Survey) -> DataFrame:
    """Flat blocks of all parts, in order of position and curve."""
    size = seen.length // PARTS
    on_curve = min(size, _KEY_BITS)
    depth = min(_MOST_DEPTH, _KEY_BITS // on_curve)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("vector").flatten().to_numpy().astype(np.float64).reshape(-1, PARTS, size)
            values = whole(x)
            scaled = np.clip((x.reshape(-1, seen.length) - seen.centre) / seen.spread, -2, 2).reshape(x.shape)
            cells = np.minimum(((scaled + 2) * (1 << depth) / 4).astype(np.int64), (1 << depth) - 1)
            none = pa.nulls(len(x), batch.column("vec_id").type), pa.nulls(len(x), batch.column("label").type)
            for part in range(PARTS):
                if values.dtype == np.int64:
                    flat = np.ascontiguousarray(values[:, part], "<i4")
                    ends = pa.array(np.arange(len(x) + 1) * 4 * size, pa.int32())
                    data = pa.Array.from_buffers(pa.binary(), len(x), [None, ends.buffers()[1], pa.py_buffer(flat)])
                    width = np.full(len(x), 4)
                else:
                    width, data = zip(*(packed(v) for v in values[:, part]), strict=True)
                ids = (batch.column("vec_id"), batch.column("label")) if part == 0 else none
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), part), pa.int32()), pa.array(hilbert_keys(cells[:, part, :on_curve], depth), pa.int64()),
                     batch.column("row"), *ids, pa.array(width, pa.int32()), pa.array(data, pa.binary())],
                    ["part", "key", "row", "vec_id", "label", "width", "data"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, widths = batch.column("part").to_numpy(), batch.column("width").to_numpy()
            starts = np.flatnonzero(np.r_[True, (parts[1:] != parts[:-1]) | (widths[1:] != widths[:-1])])
            cuts = np.concatenate([np.arange(a, b, BLOCK) for a, b in zip(starts, [*starts[1:], len(parts)], strict=True)])
            ends = np.append(cuts[1:], len(parts))
            made = []
            for a, b in zip(cuts, ends, strict=True):
                data = b"".join(batch.column("data").slice(a, b - a).to_pylist())
                values = unpacked(int(widths[a]), data).reshape(b - a, size)
                made.append((int(parts[a]), int(b - a), int(widths[a]), data,
                             *packed(np.stack([values.min(axis=0), values.max(axis=0), values.sum(axis=0)]))))
            offsets = pa.array(np.append(cuts, len(parts)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, batch.column(c)) for c in ("row", "vec_id", "label")]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], *lists],
                ["part", "n", "width", "data", "box_width", "box", "rows", "vec_ids", "labels"])

    ids = {f.name: f.dataType.simpleString() for f in vectors.schema}
    rows = vectors.where(F.size("vector") == seen.length).withColumn("row", F.monotonically_increasing_id())
    parts = rows.mapInArrow(
        cut, f"part int, key long, row long, vec_id {ids['vec_id']}, label {ids['label']}, width int, data binary")
    order = ["part", "key", "row"]
    return stage(parts.repartitionByRange(*order).sortWithinPartitions(*order).drop("key").mapInArrow(
        gather, "part int, n int, width int, data binary, box_width int, box binary, rows array<long>, "
                f"vec_ids array<{ids['vec_id']}>, labels array<{ids['label']}>"))


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which entries can be the nearest of some part in a box; boxes (n, size), entries (n, entries, size)."""
    low, high = low[:, None], high[:, None]
    outside = np.maximum(np.maximum(low - entries, entries - high), 0)
    farthest = np.maximum(abs(entries - low), abs(entries - high))
    least, most = (outside * outside).sum(axis=2), (farthest * farthest).sum(axis=2)
    return least <= most.min(axis=1)[:, None]


class Kernel:
    """Nearest entries of the parts of flat blocks, exact for whole numbers of any size."""

    def __init__(self, codebooks: np.ndarray):
        self._plain = codebooks.dtype == np.int64
        self._books = codebooks
        self.size = codebooks.shape[2]

    def batches(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(indices of blocks, part, n, boxes, components) of the blocks of a batch, those of one width together."""
        widths = np.stack([batch.column(c).to_numpy() for c in ("width", "box_width")])
        for pair in np.unique(widths, axis=1).T:
            at = np.flatnonzero((widths == pair[:, None]).all(axis=0))
            some = batch.take(pa.array(at))
            values, boxes = (unpacked(int(w), b"".join(some.column(c).to_pylist())) for w, c in zip(pair, ("data", "box"), strict=True))
            if not self._plain or (values.size and abs(boxes.reshape(-1, 3, self.size)[:, :2]).max() >= PLAIN):
                values, boxes = values.astype(object), boxes.astype(object)
            yield (at, some.column("part").to_numpy(), some.column("n").to_numpy(),
                   boxes.reshape(-1, 3, self.size), values.reshape(-1, self.size))

    def settled(self, part: np.ndarray, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shortlists of blocks, and the only entry of a shortlist, or -1."""
        lists = shortlists(boxes[:, 0], boxes[:, 1], self._books[part])
        return lists, np.where(lists.sum(axis=1) == 1, lists.argmax(axis=1), -1)

    def nearest(self, block: np.ndarray, part: np.ndarray, lists: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each part (row of ``values``) from the shortlist of its block; ties to the lower entry."""
        code = np.full(len(values), -1)
        best = np.zeros(len(values), values.dtype)
        for entry in range(lists.shape[1]):
            rows = np.flatnonzero(lists[block, entry])
            apart = values[rows] - self._books[part[block[rows]], entry]
            distance = (apart * apart).sum(axis=1)
            closer = (code[rows] < 0) | (distance < best[rows])
            rows = rows[closer]
            code[rows], best[rows] = entry, distance[closer]
        return code, best


def digits(value: int) -> list[int]:
    """Digits of a whole number, least first, each with its sign."""
    sign, rest, out = (1 if value >= 0 else -1), abs(value), []
    while rest:
        out.append(sign * (rest & ((1 << DIGIT_BITS) - 1)))
        rest >>= DIGIT_BITS
    return out


def improved(table: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Codebooks after a round: the floored means of the parts that are nearest to each entry."""
    size, entries = codebooks.shape[2], codebooks.shape[1]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(codebooks)
        total = np.zeros((PARTS * entries, size + 1), object)  # the last column counts
        for batch in batches:
            for _, part, n, boxes, values in kernel.batches(batch):
                lists, only = kernel.settled(part, boxes)
                block = np.repeat(np.arange(len(part)), n)
                slot = part * entries + only
                done = only >= 0
                np.add.at(total, slot[done], np.column_stack([boxes[done, 2], n[done]]).astype(object))
                open_rows = ~done[block]
                block, values = block[open_rows], values[open_rows]
                code, _ = kernel.nearest(block, part, lists, values)
                slot = part[block] * entries + code
                if values.dtype == np.int64:  # sums of a batch are whole numbers below 2 ** 53, which floats hold exactly
                    sums = [np.bincount(slot, w, PARTS * entries) for w in (*values.T, np.ones(len(slot)))]
                    total += np.column_stack(sums).astype(np.int64).astype(object)
                else:
                    np.add.at(total, slot, np.column_stack([values, np.ones(len(slot), object)]))
        rows = [(slot, component, k, digit) for (slot, component), value in np.ndenumerate(total)
                for k, digit in enumerate(digits(int(value)))]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], ["slot", "component", "place", "digit"])

    found = table.select("part", "n", "width", "data", "box_width", "box").mapInArrow(
        add_up, "slot int, component int, place int, digit long")
    sums = np.zeros((PARTS * entries, size + 1), object)
    # a few numbers per component of the codebooks, whatever the size of the table
    for r in found.groupBy("slot", "component", "place").agg(F.sum("digit").alias("digit")).collect():
        sums[r["slot"], r["component"]] += r["digit"] << (DIGIT_BITS * r["place"])
    new = codebooks.astype(object).reshape(PARTS * entries, size)
    used = np.flatnonzero(sums[:, size])
    new[used] = sums[used, :size] // sums[used, size:]
    return as_books(new.reshape(codebooks.shape))


def as_books(entries: np.ndarray) -> np.ndarray:
    """64-bit numbers if all are below ``PLAIN``."""
    return entries.astype(np.int64) if not entries.size or abs(entries).max() < PLAIN else entries.astype(object)


def assigned(table: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of every vector by its nearest entries."""
    kinds = {f.name: f.dataType.elementType for f in table.schema if f.name in ("vec_ids", "labels")}

    def code_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(codebooks)
        for batch in batches:
            for at, part, n, boxes, values in kernel.batches(batch):
                lists, _ = kernel.settled(part, boxes)
                block = np.repeat(np.arange(len(part)), n)
                code, error = kernel.nearest(block, part, lists, values)
                some = batch.take(pa.array(at))
                if error.dtype == object:
                    error = [int(e) if e <= _LONG else None for e in error]
                shifted = code.astype(np.int64) << (8 * (PARTS - 1 - part[block])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*[some.column(c).flatten() for c in ("rows", "vec_ids", "labels")], pa.array(shifted), pa.array(error, pa.int64())],
                    ["row", "vec_id", "label", "code", "error"])

    coded = table.mapInArrow(
        code_rows, f"row long, vec_id {kinds['vec_ids'].simpleString()}, label {kinds['labels'].simpleString()}, code long, error long")
    per_row = coded.groupBy("row").agg(
        F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.sum("code").alias("code"),
        F.when(F.count("error") == PARTS, F.try_sum("error")).alias("error"))
    return per_row.select("vec_id", "label", F.lower(F.lpad(F.hex("code"), 2 * PARTS, "0")).alias("code"), "error")


def checksum(codebooks: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for v in codebooks.ravel()).encode()).hexdigest()


def decoded(code: str, codebooks: np.ndarray) -> list[float]:
    """The vector that a code stands for."""
    return [float(v) / SCALE for part, entry in enumerate(bytes.fromhex(code)) for v in codebooks[part, entry]]


def codes(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> tuple[DataFrame, np.ndarray | None]:
    """Code and error of every usable vector, with the error of its label, and the codebooks."""
    rows = usable(vectors, vec_id, vector, label)
    seen = survey(rows)
    if seen is None:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                           F.lit(0).cast("long").alias("label_error")), None
    books = first_codebooks(rows.where(F.size("vector") == seen.length))
    table = blocks(rows, seen)
    for _ in range(ROUNDS):
        books = improved(table, books)
    coded = stage(assigned(table, books).withColumn(
        "label_key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))))
    of_label = coded.groupBy("label_key").agg(
        F.when(F.count("error") == F.count("*"), F.try_sum("error")).alias("label_error"))
    return lookup(coded, stage(of_label), "label_key").drop("label_key"), books
