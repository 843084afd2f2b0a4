"""Whitening of embeddings by their exact spectrum.

Entries become whole numbers, so the sums and the scatter matrix are exact whatever the order in which tasks add them.
The scatter's characteristic polynomial, its largest roots and their components (``exact_spectrum``) come from that
matrix of d x d whole numbers, which alone meets on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exact_spectrum
from .common import map_batches, written

#: Units an entry of 1 is divided into.
UNITS = 256
COMPONENTS = 4
#: Exact sums leave a task in digits of this many bits, so that sums of them fit a long.
DIGIT = 30


@dataclass
class Whitening:
    """What is fitted: the number of distinct vectors, their sums by dimension, components as rows, and their eigenvalues
    as parts of the covariance; ``explained`` are their shares of its trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


def as_units(embeddings: DataFrame) -> DataFrame:
    """``vec_id, x``: entries times 256, rounded down; rows go whose vector is null or holds null, NaN or infinite
    entries, and those shorter than the longest vector, whose last entries are missing."""
    c = F.col("embedding").cast("array<double>")
    fine = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = embeddings.select("vec_id", c.alias("c")).where("c IS NOT NULL").where(fine)
    longest = rows.agg(F.max(F.size("c"))).first()[0] or 0  # one number
    return rows.where(F.size("c") == longest).select("vec_id", F.transform("c", lambda v: F.floor(v * UNITS)).alias("x"))


def matrix_of(column: pa.ListArray, object_beyond: int = 2**30) -> np.ndarray:
    """The vectors of a batch as rows of whole numbers; Python's own where products could leave 64 bits."""
    rows = column.flatten().to_numpy().reshape(len(column), -1)
    return rows if not rows.size or int(np.abs(rows.astype(float)).max()) < object_beyond else rows.astype(object)


def digits_of(value: int) -> list[int]:
    """Signed digits whose sum, each times its power of 2**DIGIT, is the value."""
    out = []
    while not -(1 << 60) < value < (1 << 60):
        out.append(value & ((1 << DIGIT) - 1))
        value >>= DIGIT
    return [*out, value & ((1 << DIGIT) - 1), value >> DIGIT]


def exact_sums(vectors: DataFrame, fields: int) -> dict[int, int]:
    """Sums over (place, digit, value) rows by place, exactly: {place: sum}. ``fields`` bounds the places."""
    found: dict[int, int] = {}
    for r in vectors.groupBy("place", "digit").agg(F.sum("value").alias("value")).where(F.col("place") < fields).collect():
        found[r.place] = found.get(r.place, 0) + (r.value << (DIGIT * r.digit))
    return found


def moments(distinct: DataFrame, d: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of vectors, sums by dimension and sums of products of dimensions, all exact.

    A task adds up its batches and gives d * (d + 3) / 2 + 1 sums; nothing else leaves it.
    """
    upper = np.triu_indices(d)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + d + len(upper[0]), object)
        for batch in batches:
            x = matrix_of(batch.column(0))
            if not len(x):
                continue
            if x.dtype == object:
                products = x.T @ x
            else:
                most = max(1, int(np.abs(x).max()))
                apart = max(1, (1 << 62) // most**2)
                products = sum(((x[i : i + apart].T @ x[i : i + apart]).astype(object) for i in range(0, len(x), apart)), np.zeros((d, d), object))
            total[0] += len(x)
            total[1 : 1 + d] += x.astype(object).sum(axis=0) if x.dtype == object else x.sum(axis=0).astype(object)
            total[1 + d :] += products[upper]
        rows = [(place, k, digit) for place, value in enumerate(total.tolist()) for k, digit in enumerate(digits_of(int(value))) if digit]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["place", "digit", "value"])

    sums = exact_sums(distinct.select("x").mapInArrow(work, "place long, digit long, value long"), 1 + d + len(upper[0]))
    products = [[0] * d for _ in range(d)]
    for at, (i, j) in enumerate(zip(*upper, strict=True)):
        products[i][j] = products[j][i] = sums.get(1 + d + at, 0)
    return sums.get(0, 0), [sums.get(1 + i, 0) for i in range(d)], products


def fit(units: DataFrame, count: int = COMPONENTS) -> tuple[Whitening | None, DataFrame]:
    """The whitening of vectors ``x``, and the distinct vectors that it was fitted on; None where no vector varies.

    A component needs a positive eigenvalue, so there may be fewer than ``count``.
    """
    distinct = written(units.select("x").distinct(), "whitening-distinct")
    d = distinct.agg(F.max(F.size("x"))).first()[0] or 0
    if not d:
        return None, distinct
    n, sums, products = moments(distinct, d)
    scatter = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]  # n * n times the covariance
    trace = sum(scatter[i][i] for i in range(d))
    if not trace:
        return None, distinct
    roots = exact_spectrum.largest_roots(exact_spectrum.characteristic_polynomial(units.sparkSession, scatter), trace, count)
    vectors = exact_spectrum.eigenvectors(scatter, roots)
    shares = np.array([a / (trace << b) for a, b in roots])  # quotients of whole numbers, rounded once
    values = np.array([a / ((n * n) << b) for a, b in roots])
    return Whitening(n, sums, vectors, values, shares), distinct


def apply(units: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id, deviation, whitened``: the exact sum of (n * x - sum) ** 2, and the whitened values of all components.

    A deviation beyond a long is null: it can't be told in the column's type.
    """
    n, sums = model.n, np.array(model.sums, object)
    scaled = model.components.T / np.sqrt(model.eigenvalues) / n
    small = max((abs(s) for s in model.sums), default=0) < 2**61

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix_of(batch.column("x"))
        most = max([1, *np.abs(x).ravel().tolist()]) if x.dtype == object else max(1, int(np.abs(x).max(initial=0)))
        reach = n * most + max((abs(s) for s in model.sums), default=0)
        if small and reach < 2**53 and reach * reach * len(model.sums) < 2**63:
            far = x * n - sums.astype("int64")
            deviation = (far * far).sum(axis=1).tolist()
        else:
            far = x.astype(object) * n - sums
            deviation = [v if v < 2**63 else None for v in (int((row * row).sum()) for row in far)]
        whitened = far.astype(float) @ scaled
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviation, pa.int64()), pa.array(list(whitened), pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])

    kind = units.schema["vec_id"].dataType.simpleString()
    return map_batches(units, work, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened distinct vectors less the identity, as measured on them."""
    k = len(model.eigenvalues)
    fitted = apply(distinct.withColumn("vec_id", F.lit(0).cast("long")), model)
    z = [F.get("whitened", i) for i in range(k)]
    means = fitted.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(z)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = fitted.agg(*[F.avg((z[i] - means[i]) * (z[j] - means[j])) for i, j in pairs]).first()  # k * (k + 1) / 2 numbers
    return max(abs(v - (i == j)) for v, (i, j) in zip(products, pairs, strict=True))


def whiten(embeddings: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    ``embeddings`` has ``vec_id`` and ``embedding``; other columns aren't read. Vectors that are null, hold null or
    non-finite entries, or are shorter than the longest one are left out. Repeated vectors count once in the fit, and
    each of their rows has its own result; a null ``vec_id`` stays null. Entries count up to what a long holds once
    multiplied; larger ones stop at its ends, as Spark's floor does. Equal eigenvalues have components at right angles to each other. Without a
    vector, or where none varies, there is no component and no row. Vectors of any length pass row by row; what
    meets on the driver are d * (d + 3) / 2 sums and, for each prime, d + 1 residues.
    """
    units = written(as_units(embeddings), "whitening-units")
    model, distinct = fit(units, count)
    spark = embeddings.sparkSession
    kind = units.schema["vec_id"].dataType.simpleString()
    if model is None:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(distinct, model)
    shares = F.array(*[F.lit(float(v)) for v in model.explained])
    rows = apply(units, model).select("vec_id", "deviation", F.posexplode("whitened").alias("_at", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("_at")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
