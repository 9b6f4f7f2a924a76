"""Whitening of embeddings by a distributed singular value decomposition.

Vectors become whole numbers (256ths, rounded down).  The fit list holds every
distinct one once, so that copies weigh nothing.  Its rows, centred, are the row
matrix of which MLlib's ``computeSVD`` finds the right singular vectors; with
``n`` rows, the singular value ``s`` belongs to the variance ``s * s / n``
(divisor n).  All components are asked for, as MLlib then solves its Gramian to
double precision and not to the tolerance of its iterative solver; beyond
``DENSE`` dimensions it has that one alone.  The total variance is not the sum of
these values: it comes from exact whole deviations.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Components returned for each row.
COMPONENTS = 4
#: Parts of one that entries are counted in.
PARTS = 256
#: Dimensions up to which MLlib solves the Gramian whole.
DENSE = 15_000
#: Entries of the matrices that a task works on at a time.
ENTRIES = 1 << 19
#: A component with a smaller share of the variance than this has none.
NO_VARIANCE = 2.0**-46
_EXACT = pa.decimal128(38, 0)
_SCHEMA = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def rounded(rows: DataFrame) -> DataFrame:
    """``vec_id`` and ``x`` of the rows whose vector is whole and finite."""
    entries = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return entries.where(F.col("e").isNotNull() & finite).select("vec_id", F.transform("e", lambda c: F.floor(c * PARTS).cast("long")).alias("x"))


def _padded(width: int) -> F.Column:
    return F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))).alias("x")


def fit_list(vectors: DataFrame) -> tuple[DataFrame, int, int]:
    """Every distinct vector once, staged; how many there are and how wide.
    Shorter ones are extended with zeros to the widest."""
    fit = staged(vectors.select("x").distinct(), "vectors")
    n, least, width = fit.agg(F.count("*"), F.min(F.size("x")), F.max(F.size("x"))).first()
    if n and least < width:
        fit = staged(fit.select(_padded(width)).distinct(), "vectors")
        n = fit.count()
    return fit, n, width or 0


def _matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of batches, each with its vectors as a matrix of whole numbers."""
    step = max(1, ENTRIES // width)
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            part = whole.slice(at, step)
            x = part.column(part.schema.get_field_index("x"))
            yield part, x.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def _exact(x: np.ndarray, most: int) -> np.ndarray:
    """The same numbers, of unbounded size where results may reach ``most``."""
    return x if most < 1 << 62 else x.astype(object)


def column_sums(fit: DataFrame, width: int) -> list[int]:
    """Exact sums of each dimension: one row of partial sums a task, added by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for _, x in _matrices(batches, width):
            total = [t + int(s) for t, s in zip(total, _exact(x, _most(x) * len(x)).sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([[Decimal(t) for t in total]], pa.list_(_EXACT))], names=["part"])

    parts = fit.mapInArrow(run, "part array<decimal(38,0)>").select(F.posexplode("part").alias("at", "part"))
    found = {r["at"]: int(r["total"]) for r in parts.groupBy("at").agg(F.sum("part").alias("total")).collect()}
    return [found[i] for i in range(width)]


def _numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * x - sums``, exactly."""
    large = _most(x) * n + max(map(abs, sums))
    return _exact(x, large) * n - np.array(sums, object if large >= 1 << 62 else np.int64)


def _deviations(y: np.ndarray) -> list[int]:
    y = _exact(y, _most(y) ** 2 * y.shape[1])
    return [int(v) for v in (y * y).sum(axis=1)]


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) if v < 10**38 else None for v in values], _EXACT)


def centred(fit: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """Of each vector of the fit list, the centred one and its exact deviation
    ``sum((n * x - sums) ** 2)`` (null from 10 ** 38 on), also as a double."""
    width = len(sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _matrices(batches, width):
            y = _numerators(x, n, sums)
            exact = _deviations(y)
            flat = (y / n).astype(np.float64).ravel()
            rows = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * width, pa.array(flat))
            yield pa.RecordBatch.from_arrays([rows, _decimals(exact), pa.array([float(v) for v in exact])], names=["centred", "deviation", "near"])

    return fit.mapInArrow(run, "centred array<double>, deviation decimal(38,0), near double")


def total_variance(rows: DataFrame, n: int) -> float:
    """The trace of the covariance, from exact deviations (by doubles where one
    or their sum needs more than 38 digits)."""
    total, known, near = rows.agg(F.expr("try_sum(deviation)"), F.count("deviation"), F.sum("near")).first()
    if total is None or known < n:
        return float(near) / float(n) ** 3
    return float(Fraction(int(total), n**3))


def components(rows: DataFrame, n: int, width: int, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest variances, falling, and their unit directions as columns,
    each with its largest entry positive."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector("centred").alias("row")), "row")
    found = RowMatrix(vectors, n, width).computeSVD(width if width <= DENSE else count)
    variance = np.zeros(min(count, width))
    scale = found.s.toArray()[: len(variance)]
    variance[: len(scale)] = scale * scale / n
    v = found.V.toArray()[:, : len(scale)]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(len(scale))])
    return variance, np.pad(v, ((0, 0), (0, len(variance) - len(scale))))


def _projected(vectors: DataFrame, n: int, sums: list[int], turn: np.ndarray) -> DataFrame:
    """``vec_id``, exact deviation and the centred vector times ``turn``."""
    width, k = turn.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches, width):
            y = _numerators(x, n, sums)
            flat = ((y / n).astype(np.float64) @ turn).ravel()
            whitened = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * k, pa.array(flat))
            ids = part.column(part.schema.get_field_index("vec_id"))
            yield pa.RecordBatch.from_arrays([ids, _decimals(_deviations(y)), whitened], names=["vec_id", "deviation", "whitened"])

    return vectors.mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(fit: DataFrame, k: int) -> float:
    """How far the covariance of the first ``k`` whitened columns is from the
    identity, by Spark's own centred population covariance."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    if not pairs:
        return 0.0
    found = fit.agg(*(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(float(found[f"c{i}_{j}"]) - float(i == j)) for i, j in pairs)


def whitened(rows: DataFrame, count: int = COMPONENTS) -> DataFrame:
    """Per remaining row and component: ``vec_id``, ``component`` from 1, ``n``,
    ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Rows whose vector is null or holds a null, a not-a-number or an infinity
    fall away; those without an id stay.  Copies are one vector of the fit list
    and get a row each; shorter vectors are extended with zeros to the widest;
    entries beyond the range of a long are cut to it.  Components are as many as
    there are dimensions, ``count`` at most.  One without variance (all vectors
    equal, or fewer than components) has null ``whitened`` and 0 ``explained``
    and takes no part in ``identity_error``; of equal variances either order may
    come.  Other columns fall away; an empty table gives no rows.

    The driver sees sums of dimensions and the components, which grow with the
    width of vectors, not with the table.
    """
    vectors = rounded(rows)
    fit, n, width = fit_list(vectors)
    spark = rows.sparkSession
    if not n or not width:
        return spark.createDataFrame([], _SCHEMA)
    sums = column_sums(fit, width)
    middle = centred(fit, n, sums)
    trace = total_variance(middle, n)
    variance, v = components(middle, n, width, count)
    real = variance > NO_VARIANCE * trace
    turn = np.where(real, v / np.sqrt(np.where(real, variance, 1.0)), 0.0)
    k = int(real.sum())
    error = identity_error(_projected(fit.select(F.lit(None).cast("long").alias("vec_id"), "x"), n, sums, turn), k)
    explained = [float(e / trace) if r else 0.0 for e, r in zip(variance, real, strict=True)]
    done = _projected(vectors.select("vec_id", _padded(width)), n, sums, turn)
    each = done.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "value"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(F.col("at") < k, F.col("value")).alias("whitened"),
        F.array(*map(F.lit, explained))[F.col("at")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
