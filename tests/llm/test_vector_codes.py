"""Vector codes against the plain algorithm in whole numbers of Python."""

import hashlib
import math

import numpy as np
import pytest

from shelfprice.llm import vector_codes

TABLE = "vec_id long, embedding array<double>, label int"


def plain(rows):
    """All rounds part by part; rows are (vec_id, vector, label)."""
    kept = [r for r in rows if r[1] and len(r[1]) % 8 == 0 and all(v is not None and math.isfinite(v) for v in r[1])]
    if not kept:
        return [], None
    lengths = [len(r[1]) for r in kept]
    length = min(set(lengths), key=lambda n: (-lengths.count(n), n))
    kept = sorted((r for r in kept if len(r[1]) == length), key=lambda r: (r[0] is None, r[0], r[1]))
    size = length // 8

    def floored(v):
        return int(v) * 4096 if abs(v) > 1e15 else math.floor(v * 4096)

    cut = [[[floored(v) for v in r[1][p * size:(p + 1) * size]] for p in range(8)] for r in kept]
    books = [[cut[k][p] for k in range(min(16, len(kept)))] for p in range(8)]

    def best(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(6):
        for p in range(8):
            groups = {}
            for x in cut:
                groups.setdefault(best(p, x[p])[1], []).append(x[p])
            for k, of in groups.items():
                books[p][k] = [sum(c) // len(of) for c in zip(*of)]
    coded = []
    for r, x in zip(kept, cut):
        found = [best(p, x[p]) for p in range(8)]
        coded.append((r[0], r[2], "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    checksum = hashlib.sha256(",".join(str(v) for p in books for e in p for v in e).encode()).hexdigest()
    def long(v):
        return v if v < 1 << 63 else None

    return sorted(((i, code, long(error), long(sum(c[3] for c in coded if c[1] == label))) for i, label, code, error in coded),
                  key=str), checksum


def got(df):
    found, books = vector_codes.codes(df)
    rows = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found.collect()), key=str)
    return rows, None if books is None else vector_codes.checksum(books)


def vectors(n, size, seed, scale=1.0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(0, scale, (5, size))
    return [(int(k * 7 % n), (centres[draw.integers(5)] + draw.normal(0, scale / 4, size)).tolist(), int(draw.integers(3)) or None)
            for k in range(n)]


@pytest.mark.parametrize("size, scale", [(8, 1.0), (16, 1.0), (64, 0.1), (24, 1e5)])
def test_equals_plain(spark, size, scale):
    rows = vectors(300, size, size, scale)
    assert got(spark.createDataFrame(rows, TABLE).repartition(5)) == plain(rows)


def test_numbers_beyond_64_bits(spark):
    rows = vectors(60, 16, 4) + [(100, [1e30] * 16, 1), (101, [-1e300] + [0.5] * 15, 2), (103, [-2e300] + [0.5] * 15, 2), (102, [5e5] * 16, 1)]
    found = got(spark.createDataFrame(rows, TABLE))
    assert found == plain(rows)
    assert any(r[2] is None for r in found[0])


def test_awkward_rows(spark):
    base = vectors(40, 16, 9)
    rows = base + base[:5] + [
        (200, None, 1), (201, [], 1), (202, [None] + [0.0] * 15, 1), (203, [float("nan")] * 16, 1), (204, [float("inf")] + [0.0] * 15, None),
        (205, [0.25] * 15, 1), (206, [0.25] * 8, 1), (None, [0.5] * 16, None), (None, [0.5] * 16, 7), (5, [0.125] * 16, 0)]
    df = spark.createDataFrame(rows, TABLE).selectExpr("*", "'x' AS row", "1 AS part", "2 AS code", "3 AS label_key", "4 AS vector")
    assert got(df) == plain(rows)
    assert len(got(df)[0]) == 48


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    rows = vectors(20, 8, 2)[:n]
    assert got(spark.createDataFrame(rows, TABLE)) == plain(rows)


def test_equal_vectors(spark):
    """A third and more of one value: entries are equal, ties go to the lower one."""
    rows = [(k, [0.5] * 16, 1) for k in range(400)] + [(1000 + k, v, lab) for k, (_, v, lab) in enumerate(vectors(100, 16, 5))]
    found, checksum = got(spark.createDataFrame(rows, TABLE))
    assert (found, checksum) == plain(rows)


def test_all_null(spark):
    assert got(spark.createDataFrame([(1, None, 1), (2, None, None)], TABLE)) == ([], None)


def test_shortlists_hold_the_nearest():
    draw = np.random.default_rng(1)
    values = np.floor(draw.normal(0, 50, (200, 1, 4)) + draw.normal(0, 8, (200, 10, 4))).astype(np.int64)
    entries = np.floor(draw.normal(0, 50, (200, 16, 4))).astype(np.int64)
    lists = vector_codes.shortlists(values.min(axis=1), values.max(axis=1), entries)
    distance = ((values[:, :, None] - entries[:, None]) ** 2).sum(axis=3)
    nearest = distance == distance.min(axis=2, keepdims=True)
    assert not (nearest & ~lists[:, None]).any()
    assert lists.sum() < 0.5 * lists.size


@pytest.mark.parametrize("n, depth", [(2, 4), (3, 3), (8, 1)])
def test_curve_visits_neighbours(n, depth):
    side = 1 << depth
    cells = np.stack(np.meshgrid(*[np.arange(side)] * n, indexing="ij"), axis=-1).reshape(-1, n)
    keys = vector_codes.hilbert_keys(cells, depth)
    assert sorted(keys) == list(range(side ** n))
    walk = cells[np.argsort(keys)]
    assert (abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_decoded_is_near(spark):
    rows = vectors(300, 16, 6)
    found, books = vector_codes.codes(spark.createDataFrame(rows, TABLE))
    by_id = {r[0]: np.array(r[1]) for r in rows}
    for r in found.collect():
        lost = ((np.array(vector_codes.decoded(r["code"], books)) - by_id[r["vec_id"]]) ** 2).sum()
        assert abs(lost - r["error"] / 4096 ** 2) < 0.02
