"""PCA whitening of embeddings with distributed block matrices.

Entries become whole numbers, so sums per dimension and deviations are exact and rows are centred
before anything is multiplied. The centred rows are numbered without gaps and dealt into the
blocks of an MLlib ``BlockMatrix``; its transpose times itself is the scatter matrix, whose middle
dimension is cut so that no task holds more than ``SPLIT_BYTES`` of blocks. The scatter matrix, of
dimensions by dimensions, is the only thing the driver sees; its eigenvectors over the roots of the
eigenvalues are the whitening matrix, and a second block product projects all rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import keep

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
# larger entries, of which whole numbers cannot be kept exactly, count as not finite
LARGEST = float(1 << 42)
BLOCK_BYTES = 16 << 20
SPLIT_BYTES = 128 << 20
COLUMNS = 1024


def whole(vector: str | Column) -> Column:
    """``floor(1024 * entry) + 100000`` of every entry; null unless all entries are finite numbers."""
    v = F.col(vector) if isinstance(vector, str) else vector
    sound = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < LARGEST, F.lit(False)))
    return F.when(v.isNotNull() & sound, F.transform(v, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("bigint") + SHIFT))


@dataclass
class Centred:
    """``rows (idx, own, away, deviation)`` numbered from 0, with their number and dimensions.

    ``away`` is ``n * x - S`` of every dimension; ``deviation`` the sum of its squares.
    """

    rows: DataFrame
    n: int
    dims: int


def centred(rows: DataFrame, vector: str, carry: list[str]) -> Centred:
    """The rows with a vector, as whole numbers, numbered and centred; ``own`` holds the columns ``carry``.

    Rows whose vector is null or empty or has an entry that is null or not finite are left out, and
    so are vectors of another length than most have (the longest of equally frequent lengths).
    """
    own = F.struct(*[F.col(f"`{c}`").alias(c) for c in carry])
    all_rows = keep(rows.select(own.alias("own"), whole(F.col(f"`{vector}`")).alias("x")).filter(F.size("x") > 0), "embeddings")
    lengths = all_rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.col("count").desc(), F.col("dims").desc()).limit(1).collect()
    if not lengths:
        return Centred(all_rows.select(F.lit(0).cast("bigint").alias("idx"), "own", F.col("x").cast("array<double>").alias("away"), F.lit(0).cast("decimal(38,0)").alias("deviation")), 0, 0)
    dims, n = lengths[0]["dims"], lengths[0]["count"]
    # numbers without gaps: a row's place in its task, after the rows of the tasks before
    placed = keep(all_rows.filter(F.size("x") == dims).withColumn("_id", F.monotonically_increasing_id()), "placed")
    task, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = {r["task"]: r["count"] for r in placed.groupBy(task.alias("task")).count().collect()}  # one row for each task
    before, total = [], 0
    for key in sorted(counts):
        before.append((key, total))
        total += counts[key]
    offsets = placed.sparkSession.createDataFrame(before, "task bigint, before bigint")
    sums = {r["pos"]: r["s"] for r in placed.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col").alias("s")).collect()}
    total_of = F.lit([sums[i] for i in range(dims)]).cast("array<decimal(20,0)>")
    away = F.zip_with(F.col("x").cast("array<decimal(20,0)>"), total_of, lambda a, s: (a * F.lit(n).cast("decimal(18,0)") - s).cast("decimal(38,0)"))
    nil = F.lit(0).cast("decimal(38,0)")
    squares = F.aggregate("_away", nil, lambda acc, a: F.try_add(acc, F.try_multiply(a.try_cast("decimal(19,0)"), a.try_cast("decimal(19,0)"))).cast("decimal(38,0)"))
    numbered = placed.withColumn("task", task).join(offsets, "task").select((F.col("before") + at).alias("idx"), "own", away.alias("_away"))
    return Centred(keep(numbered.select("idx", "own", F.col("_away").cast("array<double>").alias("away"), squares.alias("deviation")), "centred"), n, dims)


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """``left`` times ``right``, with the middle dimension cut into ``splits``."""
    model = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(model, left.rowsPerBlock, right.colsPerBlock)


def block_matrix(rows: Centred) -> BlockMatrix:
    """The centred rows, ``away / n``, as a matrix of blocks of at most ``BLOCK_BYTES``."""
    spark = rows.rows.sparkSession
    values = rows.rows.select("idx", array_to_vector(F.transform("away", lambda a: a / F.lit(float(rows.n)))).alias("vector"))
    columns = min(rows.dims, COLUMNS)
    per_block = max(256, min(BLOCK_BYTES // (8 * columns), math.ceil(rows.n / (4 * spark.sparkContext.defaultParallelism))))
    return IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(values, "vector"), rows.n, rows.dims).toBlockMatrix(per_block, columns)


def spectrum(rows: Centred, matrix: BlockMatrix) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues of the covariance, falling, their unit eigenvectors as columns, and its trace."""
    blocks = math.ceil(rows.n / matrix.rowsPerBlock)
    splits = max(1, min(blocks, max(2 * rows.rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.n * rows.dims * 8 / SPLIT_BYTES))))
    scatter = _product(matrix.transpose(), matrix, splits).toLocalMatrix().toArray() / rows.n
    values, vectors = np.linalg.eigh((scatter + scatter.T) / 2)
    return values[::-1], vectors[:, ::-1], float(np.trace(scatter))


def project(rows: Centred, matrix: BlockMatrix, weights: np.ndarray) -> DataFrame:
    """``(idx, values)``: every row of ``matrix`` times ``weights``, dimensions by components."""
    width, step = weights.shape[1], matrix.colsPerBlock
    blocks = [((i // step, 0), Matrices.dense(len(w), width, w.ravel(order="F").tolist())) for i in range(0, rows.dims, step) for w in [weights[i : i + step]]]
    right = BlockMatrix(rows.rows.sparkSession.sparkContext.parallelize(blocks, 1), step, width, rows.dims, width)
    found = callMLlibFunc("getIndexedRows", _product(matrix, right, 1).toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return found.select(F.col("index").alias("idx"), vector_to_array("vector").alias("values"))


def identity_error(projected: DataFrame, n: int, width: int) -> float | None:
    """Largest entry of the covariance of the first ``width`` values less the identity; null without any."""
    if not width:
        return None
    mean = projected.agg(*[(F.sum(F.col("values")[i]) / n).alias(f"m{i}") for i in range(width)]).first()
    pairs = [(i, j) for i in range(width) for j in range(i + 1)]
    away = [F.col("values")[i] - F.lit(mean[i]) for i in range(width)]
    cov = projected.agg(*[(F.sum(away[i] * away[j]) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whiten(rows: DataFrame, vector: str, carry: list[str], components: int = COMPONENTS) -> DataFrame:
    """Every row with a sound vector, once for each of the first ``components`` components.

    Results: ``component`` from 1 by falling eigenvalue, ``n`` rows, ``deviation`` of the row (null
    past 64 bits), ``whitened``, ``explained`` share of the variance and ``identity_error``. Rows
    left out are named at ``centred``. A component without variance has a null ``whitened``, and
    ``explained`` is null where nothing varies, as in a table of one row. Repeated rows count as
    often as they occur; columns with the names of the results are replaced; an empty table gives
    no rows.
    """
    results = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    names = [c for c in carry if c not in results]
    fit = centred(rows, vector, names)
    own = [F.col("own").getField(c).alias(c) for c in names]
    if not fit.n:
        kinds = dict(zip(results, ("int", "bigint", "bigint", "double", "double", "double")))
        return fit.rows.select(*own, *[F.lit(None).cast(kinds[c]).alias(c) for c in results])
    matrix = block_matrix(fit)
    values, vectors, trace = spectrum(fit, matrix)
    width = min(components, fit.dims)
    live = int((values[:width] > max(values[0], 0) * fit.dims * np.finfo(float).eps).sum())
    weights = vectors[:, :width] / np.where(np.arange(width) < live, np.sqrt(np.where(values[:width] > 0, values[:width], 1)), 1)
    projected = keep(project(fit, matrix, weights), "projected")
    error = identity_error(projected, fit.n, live)
    parts = [
        F.struct(F.lit(i + 1).alias("component"), (F.col("values")[i] if i < live else F.lit(None).cast("double")).alias("whitened"),
                 F.lit(float(values[i]) / trace if trace > 0 else None).cast("double").alias("explained")) for i in range(width)]
    met = fit.rows.join(projected, "idx").withColumn("part", F.explode(F.array(*parts)))
    return met.select(
        *own, "part.component", F.lit(fit.n).cast("bigint").alias("n"), F.col("deviation").try_cast("bigint").alias("deviation"),
        "part.whitened", "part.explained", F.lit(error).cast("double").alias("identity_error"))
