"""Linear models from cross moments, against the rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfprice.models import linear
from shelfprice.operators.numbering import numbered, strided

INPUTS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    draw = np.random.default_rng(5)
    x = np.round(draw.normal(100, 20, (400, 3)), 2)
    y = np.round(5 + x @ [1.5, -0.7, 0.0] + draw.normal(0, 4, 400), 2)
    return x, y


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y = data
    return spark.createDataFrame([(k % 5, *map(float, v), float(t)) for k, (v, t) in enumerate(zip(x, y))], "fold int, a double, b double, c double, y double")


def gathered(rows, by="fold"):
    return linear.collected(linear.moment_table(rows, INPUTS, "y", by), INPUTS, by)


def whole_of(parts):
    first, *rest = parts.values()
    return sum(rest, first)


def fit(x, y, penalty):
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + penalty * np.eye(x.shape[1]), z.T @ (y - y.mean())) / x.std(0)
    return w, y.mean() - w @ x.mean(0)


def test_moments_are_exact(rows, data):
    x, y = data
    table = np.rint(np.column_stack([np.ones(400) / 100, x, y]) * 100).astype(int)
    parts = gathered(rows)
    total = whole_of(parts)
    assert (total.products == table.T @ table).all()
    again = gathered(rows.repartition(7, "a"))
    assert all((again[k].products == parts[k].products).all() for k in parts)


def test_large_and_negative_values(spark):
    rows = spark.createDataFrame([(0, -9e6, 1e7, 0.0, -1e7), (0, 9e6, -1e7, 0.01, 1e7), (0, 123.45, -0.01, 5.0, 1.0)], "fold int, a double, b double, c double, y double")
    got = gathered(rows)[0].products
    x = [[1, -9 * 10**8, 10**9, 0, -10**9], [1, 9 * 10**8, -10**9, 1, 10**9], [1, 12345, -1, 500, 100]]
    assert got.tolist() == [[sum(r[i] * r[j] for r in x) for j in range(5)] for i in range(5)]


@pytest.mark.parametrize("penalty", [0.001, 50.0])
def test_ridge_and_left_out_folds(rows, data, penalty):
    x, y = data
    parts = gathered(rows)
    total = whole_of(parts)
    w, bias = fit(x, y, penalty)
    line = total.ridge(penalty)
    assert line.coefficients == pytest.approx(w, rel=1e-9) and line.intercept == pytest.approx(bias, rel=1e-9)
    ((_, scores),) = linear.cross_validated(parts, [penalty])
    fold = np.arange(400) % 5
    for k, score in enumerate(scores):
        w, bias = fit(x[fold != k], y[fold != k], penalty)
        held = y[fold == k]
        error = held - bias - x[fold == k] @ w
        assert score == pytest.approx(1 - (error ** 2).sum() / ((held - held.mean()) ** 2).sum(), rel=1e-9)


def test_constant_inputs_and_nulls(spark, rows):
    wider = rows.withColumn("c", F.lit(3.0))
    total = gathered(wider.withColumn("fold", F.lit(1)))[1]
    assert total.ridge(0.001).coefficients[2] == 0.0
    with_null = wider.unionByName(wider.withColumn("a", F.lit(None).cast("double")))
    assert (gathered(with_null.withColumn("fold", F.lit(1)))[1].products == total.products).all()
    assert gathered(rows.limit(0)) == {}
    same = spark.createDataFrame([(0, 1.0, 2.0, 3.0, 4.0)] * 3, rows.schema)
    assert gathered(same)[0].r2(gathered(same)[0].ridge(0.001)) is None


def test_prediction_is_one_expression(rows, data):
    x, _ = data
    line = linear.Line(INPUTS, 3.0, [1.0, -4.0, 0.5])
    got = rows.select(line.column().alias("p"), line.column({"a": F.col("a") * 2}).alias("q")).collect()
    want = np.maximum(0, 3 + x @ [1.0, -4.0, 0.5])
    assert sorted(r["p"] for r in got) == pytest.approx(sorted(want))
    assert sorted(r["q"] for r in got) == pytest.approx(sorted(np.maximum(0, 3 + x @ [2.0, -4.0, 0.5])))


@pytest.mark.parametrize(("size", "n"), [(0, 5), (3, 5), (40, 40), (41, 40), (997, 40)])
def test_strided(spark, size, n):
    rows = spark.range(size).select((F.col("id") * 7919 % 1000003).alias("k")).repartition(5)
    got = sorted(r["k"] for r in strided(rows, n, "k").collect())
    every = sorted(k * 7919 % 1000003 for k in range(size))
    assert got == every[::max(1, size // n)][:n]


def test_numbers_need_no_single_task(spark):
    rows = spark.range(1000).select((F.col("id") % 10).alias("g"), "id").repartition(6)
    found, total = numbered(rows, F.col("g").desc(), "id")
    assert total == 1000
    got = {r["row_number"]: (r["g"], r["id"]) for r in found.collect()}
    assert [got[k] for k in range(1000)] == sorted(((k % 10, k) for k in range(1000)), key=lambda r: (-r[0], r[1]))
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
