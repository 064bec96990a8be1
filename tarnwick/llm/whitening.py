"""Embedding whitening by upper-triangle column aggregates.

An entry c becomes the whole number x = floor(1024 * c) + 100000. Counts and sums are exact.
Each entry is centred before anything is multiplied: the whole number nearest to the mean is
taken off exactly, then the rest of the mean, which is below one. Spark SQL expressions,
one for each pair of dimensions of the upper triangle, sum the centred products in one
aggregation for every PAIRS pairs, so no row per pair is made
and a task sends one row. The driver gets those sums only, fills the matrix and decomposes
it with LAPACK. The whitened values are expressions again, and their covariance is measured
over all rows in one more aggregation.

Defined cases: a vector that is null, or holds a null or non-finite entry, is dropped, and so
is one that has not the number of entries that most vectors have (the larger one of equally
frequent ones). Components whose variance is zero (below 1e-12 of the trace) cannot be
scaled: their whitened values are 0, and identity_error leaves them out. Of one vector, or
of equal ones, all components are of that kind, and explained is 0. Repeated rows count each
time. Without rows the result is empty. Fewer dimensions than components give as many
components as dimensions. deviation is a decimal of 38 digits. Entries too large for
64-bit sums (beyond about 2^40) end in an arithmetic error, not in wrong numbers. Columns
other than the id and the vector, whatever their names, are not touched.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from fractions import Fraction
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Pairs of dimensions in one aggregation; plans of some thousand expressions take more of a small driver than it has.
PAIRS = 520
#: Share of the trace below which a component's variance counts as zero.
ZERO = 1e-12


@dataclass(frozen=True)
class Model:
    """What all rows tell: their number, each dimension's sum, the covariance, and its eigenvectors as rows by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    covariance: np.ndarray
    eigenvalues: np.ndarray
    eigenvectors: np.ndarray
    identity_error: float = 0.0

    @property
    def explained(self) -> np.ndarray:
        total = float(np.trace(self.covariance))
        return self.eigenvalues / total if total > 0 else np.zeros_like(self.eigenvalues)

    @property
    def scaled(self) -> np.ndarray:
        """The projections that whiten, a row for each component; zero where the variance is."""
        usable = self.usable
        size = np.sqrt(np.where(usable, self.eigenvalues, 1.0))
        return np.where(usable[:, None], self.eigenvectors / size[:, None], 0.0)

    @property
    def usable(self) -> np.ndarray:
        return self.eigenvalues > ZERO * float(np.trace(self.covariance))


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x, an array of whole numbers, of each usable vector; written, since every pass reads it."""
    usable = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    finite = F.forall("c", usable)
    good = vectors.select(F.col(id_col).alias("vec_id"), F.transform(vector_col, lambda c: c.cast("double")).alias("c")).filter(F.coalesce(finite, F.lit(False)))
    sizes = good.groupBy(F.size("c").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    dims = sizes["size"] if sizes else 0
    # asked again for each entry, since Spark may compute x before it filters
    whole = F.transform("c", lambda c: F.when(usable(c), F.floor(c * SCALE).cast("bigint") + SHIFT))
    return written(good.filter(F.size("c") == dims).select("vec_id", whole.alias("x")), "vectors")


def _array(values, kind: str) -> str:
    return f"array({', '.join(f'{v!r}{kind}' for v in values)})"


def _centred(n: int, sums: tuple[int, ...]) -> str:
    """SQL for z: each entry of x less its mean, as a double."""
    near = [round(Fraction(s, n)) for s in sums]
    rest = [float(Fraction(s, n) - k) for s, k in zip(sums, near)]
    whole = f"zip_with(x, {_array(near, 'L')}, (e, k) -> CAST(e - k AS DOUBLE))"
    return f"zip_with({whole}, {_array(rest, 'D')}, (e, k) -> e - k) AS z"


def fit(quantised: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of rows of quantised(); None without rows."""
    first = quantised.selectExpr("size(x) AS dims").first()
    if not first:
        return None
    dims = first["dims"]
    row = quantised.selectExpr("count(1)", *(f"sum(x[{i}])" for i in range(dims))).collect()[0]
    n, sums = row[0], tuple(row[1:])
    centred = quantised.selectExpr(_centred(n, sums))
    pairs = list(combinations_with_replacement(range(dims), 2))
    products: list[float] = []
    for k in range(0, len(pairs), PAIRS):
        products += centred.selectExpr(*(f"sum(z[{i}] * z[{j}])" for i, j in pairs[k : k + PAIRS])).collect()[0]
    covariance = np.zeros((dims, dims))
    for (i, j), total in zip(pairs, products):
        covariance[i, j] = covariance[j, i] = total / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    model = Model(n, sums, covariance, np.maximum(values[order], 0.0), vectors[:, order].T)
    return replace(model, identity_error=_identity_error(quantised, model))


def _with_whitened(quantised: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns keep of quantised(), and w: the whitened value of each component."""
    centred = quantised.selectExpr(*keep, _centred(model.n, model.sums))
    projected = [f"aggregate(zip_with(z, {_array(row.tolist(), 'D')}, (e, v) -> e * v), 0D, (total, e) -> total + e)" for row in model.scaled]
    return centred.selectExpr(*centred.columns[: len(keep)], f"array({', '.join(projected)}) AS w")


def _identity_error(quantised: DataFrame, model: Model) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, over components of some variance."""
    pairs = list(combinations_with_replacement(np.flatnonzero(model.usable).tolist(), 2))
    if not pairs:
        return 0.0
    found = _with_whitened(quantised, model).selectExpr(*(f"covar_pop(w[{a}], w[{b}])" for a, b in pairs)).collect()[0]
    return max(abs(x - (a == b)) for x, (a, b) in zip(found, pairs))


def whiten(quantised: DataFrame, model: Model) -> DataFrame:
    """vec_id, deviation and whitened (an array with the value of each component) of each row."""
    off = f"zip_with(x, {_array(model.sums, 'L')}, (e, s) -> CAST({model.n}L * e - s AS DECIMAL(19,0)))"
    deviation = f"aggregate({off}, CAST(0 AS DECIMAL(38,0)), (total, d) -> CAST(total + d * d AS DECIMAL(38,0))) AS deviation"
    rows = _with_whitened(quantised, model, "vec_id", deviation)
    return rows.withColumnRenamed("w", "whitened")


def components(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of each usable vector and component."""
    rows = quantised(vectors, id_col, vector_col)
    model = fit(rows, count)
    if model is None or not model.sums:
        kind = rows.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    share = F.array(*(F.lit(float(e)) for e in model.explained))
    each = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", share[F.col("at")].alias("explained"), F.lit(model.identity_error).alias("identity_error"))
