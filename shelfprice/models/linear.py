"""Linear demand models from cross moments: one aggregation fits, validates and merges them.

The inputs are taken in whole hundredths, as money is elsewhere in this library, so the sums of their
products are exact whole numbers, whatever the order of the rows. Moments of parts of a table add up
to those of the whole and can be taken away again: a fold is left out by subtraction, a batch of new
rows is added without reading the old ones, and the error of a line on any part follows from that part's
moments. Only the moments, a few numbers per group, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HUNDREDTHS = 100.0
#: A sum of products is kept as two long sums, of the bits above this one and of those below.
_LOW_BITS = 20


def moment_table(rows: DataFrame, features: list[str], label: str, *by: str) -> DataFrame:
    """(by..., i, j, total): sums of products of inputs i <= j in hundredths; input 0 is the constant 1, the last the label.

    One aggregation of primitive sums, combined map-side. Rows with a null among the inputs are left out.
    """
    names = [*features, label]
    whole = rows.dropna(subset=names).select(*by, *[
        F.floor(F.col(c) * HUNDREDTHS + 0.5).cast("long").alias(f"x{k}") for k, c in enumerate(names, 1)])
    inputs = [F.lit(1).cast("long"), *[F.col(f"x{k}") for k in range(1, len(names) + 1)]]
    pairs = [(i, j) for i in range(len(inputs)) for j in range(i, len(inputs))]
    sums = []
    for i, j in pairs:
        product = inputs[i] * inputs[j]
        sums += [F.sum(F.shiftright(product, _LOW_BITS)).alias(f"high_{i}_{j}"),
                 F.sum(product.bitwiseAND(F.lit((1 << _LOW_BITS) - 1))).alias(f"low_{i}_{j}")]

    def total(i: int, j: int) -> Column:
        return F.col(f"high_{i}_{j}").cast("decimal(28,0)") * F.lit(1 << _LOW_BITS).cast("decimal(8,0)") + F.col(f"low_{i}_{j}")

    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), total(i, j).cast("decimal(38,0)").alias("total")) for i, j in pairs])
    return whole.groupBy(*by).agg(*sums).select(*by, F.inline(cells)).where(F.col("total").isNotNull())


class Line(NamedTuple):
    """``intercept`` plus the inputs times their coefficients, never below zero."""

    features: list[str]
    intercept: float
    coefficients: list[float]

    def column(self, changed: dict[str, Column] | None = None) -> Column:
        """Prediction as one expression; ``changed`` replaces input columns."""
        value = F.lit(self.intercept)
        for name, weight in zip(self.features, self.coefficients, strict=True):
            value = value + F.lit(weight) * (changed or {}).get(name, F.col(name)).cast("double")
        return F.greatest(value, F.lit(0.0))


class Moments:
    """Cross products of the constant 1, the inputs and the label, in hundredths, as whole numbers of any size."""

    def __init__(self, features: list[str], cells: Iterable[tuple[int, int, int]]):
        self.features = list(features)
        size = len(self.features) + 2
        self.products = np.zeros((size, size), object)
        for i, j, total in cells:
            self.products[i, j] = self.products[j, i] = int(total)

    def _with(self, products: np.ndarray) -> Moments:
        out = Moments(self.features, [])
        out.products = products
        return out

    def __add__(self, other: Moments) -> Moments:
        return self._with(self.products + other.products)

    def __sub__(self, other: Moments) -> Moments:
        return self._with(self.products - other.products)

    @property
    def n(self) -> int:
        return self.products[0, 0]

    def centred(self) -> np.ndarray:
        """n times the sums of products of deviations from the means, exact until the last step."""
        sums = self.products[0, 1:]
        return (self.n * self.products[1:, 1:] - np.outer(sums, sums)).astype(float)

    def means(self) -> np.ndarray:
        return self.products[0, 1:].astype(float) / self.n / HUNDREDTHS

    def ridge(self, penalty: float) -> Line:
        """Least squares on standardised inputs with ``penalty`` on the squares of their weights; constant inputs get none."""
        c = self.centred()
        spread = np.sqrt(np.diag(c)[:-1])
        used = np.flatnonzero(spread > 0)
        weights = np.zeros(len(spread))
        if len(used):
            scale = spread[used]
            gram = self.n * (c[np.ix_(used, used)] / np.outer(scale, scale)) + penalty * np.eye(len(used))
            weights[used] = np.linalg.solve(gram, c[used, -1] / scale) * self.n / scale
        means = self.means()
        return Line(self.features, float(means[-1] - weights @ means[:-1]), [float(w) for w in weights])

    def r2(self, line: Line) -> float | None:
        """Share of the label's variance that a line explains on these rows (without the cut at zero)."""
        c = self.centred()
        weights = np.array([*(-w for w in line.coefficients), 1.0])
        bias = self.means()[-1] - line.intercept - np.dot(line.coefficients, self.means()[:-1])
        if c[-1, -1] <= 0:
            return None
        return float(1.0 - (weights @ c @ weights + (self.n * bias * HUNDREDTHS) ** 2) / c[-1, -1])


def collected(table: DataFrame, features: list[str], by: str | None = None) -> dict:
    """Moments of each group of a moment table, or of all its rows under None; groups must be few."""
    key = F.col(by) if by else F.lit(None).cast("string")
    cells: dict = {}
    for r in table.groupBy(key.alias("group_"), "i", "j").agg(F.sum("total").alias("total")).collect():
        cells.setdefault(r["group_"], []).append((r["i"], r["j"], r["total"]))
    return {group: Moments(features, found) for group, found in cells.items()}


def cross_validated(folds: dict, penalties: Iterable[float]) -> list[tuple[float, list[float]]]:
    """For each penalty the R² of every fold under the line fitted to the other folds, from the folds' moments."""
    parts = [folds[k] for k in sorted(folds)]
    whole = sum(parts[1:], parts[0])
    return [(penalty, [part.r2((whole - part).ridge(penalty)) for part in parts]) for penalty in penalties]
