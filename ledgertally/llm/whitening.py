"""Whitening of embeddings by distributed block matrices.

Vectors are put on an integer grid, so that counts, sums and deviations are exact. The distinct vectors, centred and indexed, make a block matrix A; its
scatter is the product of A's transpose with A, added up over groups of blocks. Only that square matrix, of the vectors' length, comes to the driver, which
finds its eigenvectors. The product of all rows' block matrix with the whitening matrix gives the projections, which rows take by their index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ledgertally.llm.tables import stored

#: Entries from here on have no exact place on the grid; they count as not finite.
TOO_LARGE = 2.0**46


@dataclass(frozen=True)
class Whitening:
    """An entry c becomes floor(scale * c) + shift. Eigenvalues below `least` of the largest are taken for zero and make no component. A block has about
    `block_values` values, and a partial scatter is the sum over so many blocks."""

    components: int = 16
    scale: int = 64
    shift: int = 1_000_000
    least: float = 1e-12
    block_values: int = 1 << 19
    blocks: int = 16


def _numbered(frame: DataFrame, label: str) -> DataFrame:
    """The rows, stored, with an index from 0 without gaps: places within partitions, and where each partition begins."""
    rows = stored(frame.withColumn("place", F.monotonically_increasing_id()), label)
    part = F.shiftright("place", 33)
    counts = [(r["part"], r["count"]) for r in rows.groupBy(part.alias("part")).count().orderBy("part").collect()]  # one row per partition
    begins = np.cumsum([0] + [count for _, count in counts]).tolist()
    starts = rows.sparkSession.createDataFrame([(part, begin) for (part, _), begin in zip(counts, begins)], "part bigint, begin bigint")
    return rows.withColumn("part", part).join(starts, "part").withColumn("index", F.col("begin") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "place", "begin")


def _blocks(rows: DataFrame, centred: Column, count: int, size: int, plan: Whitening) -> BlockMatrix:
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector(centred).alias("vector")), "vector")
    return IndexedRowMatrix(vectors, count, size).toBlockMatrix(max(1, plan.block_values // size), size)


def _gram(a: BlockMatrix, plan: Whitening) -> np.ndarray:
    """The transpose of `a` times `a`, in partial products over groups of blocks, so that no task sees all of them."""
    groups = -(-a.numRows() // a.rowsPerBlock // plan.blocks)
    turned = a.transpose()
    product = turned._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, max(1, groups))
    return BlockMatrix(product, turned.rowsPerBlock, a.colsPerBlock).toLocalMatrix().toArray()


def whitened(vectors: DataFrame, plan: Whitening = Whitening()) -> DataFrame:
    """Per row of a usable vector and component: vec_id, component (from 1), n (distinct vectors), deviation, whitened, explained, identity_error.

    Unusable, and left out, are vectors that are null or empty or hold null, non-finite or too large entries, and those of another length than most
    have (the longer one if two are as frequent). Repeated rows and null vec_ids stay, each with its own result. A deviation beyond 64 bits is null. Without two
    different vectors there is no component and no row. Columns other than vec_id and embedding are not read.
    """
    spark, kind = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    usable = F.forall("embedding", lambda c: c.isNotNull() & (F.abs(c) < TOO_LARGE))
    on_grid = F.transform("embedding", lambda c: F.floor(c.cast("double") * plan.scale) + F.lit(plan.shift).cast("bigint"))
    rows = stored(vectors.filter(usable).filter(F.size("embedding") > 0).select("vec_id", on_grid.alias("x")), "grid")
    lengths = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    size = lengths[0]["size"] if lengths else 0
    rows = _numbered(rows.filter(F.size("x") == size), "rows")
    fit = _numbered(rows.select("x").distinct(), "fit")
    sums = [int(r["total"]) for r in fit.select(F.posexplode("x")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total")).orderBy("pos").collect()]
    n, out = fit.count(), f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if n < 2:
        return spark.createDataFrame([], out)

    # n * x - S, exact: whole and rest of the mean apart, so that the products stay small.
    whole, rest = (F.lit([f(total, n) for total in sums]) for f in (lambda t, k: t // k, lambda t, k: t % k))
    apart = F.transform("x", lambda v, k: (v - F.get(whole, k)) * n - F.get(rest, k))
    centred = F.transform("apart", lambda d: d.cast("double") / n)
    matrix = _blocks(fit.withColumn("apart", apart), centred, n, size, plan)
    values, directions = np.linalg.eigh(_gram(matrix, plan) / n)
    values, directions = values[::-1], directions[:, ::-1]
    count = int((values[: plan.components] > plan.least * values[0]).sum())
    turn = directions[:, :count] / np.sqrt(values[:count])
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), Matrices.dense(size, count, turn.ravel("F")))], 1), size, count)
    error = float(np.abs(_gram(matrix.multiply(right), plan) / n - np.eye(count)).max())

    every = rows.withColumn("apart", apart)
    total = rows.count()
    projected = _blocks(every, centred, total, size, plan).multiply(right).toIndexedRowMatrix()
    found = callMLlibFunc("getIndexedRows", projected._java_matrix_wrapper._java_model).select("index", vector_to_array("vector").alias("places"))
    squares = F.aggregate("apart", F.lit(0).cast("decimal(38,0)"), lambda a, d: (a + d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast("decimal(38,0)"))
    joined = every.select("index", "vec_id", squares.try_cast("bigint").alias("deviation")).join(found, "index")
    shares = F.lit((values[:count] / values.sum()).tolist())
    long = joined.select("vec_id", "deviation", F.posexplode("places").alias("k", "whitened"))
    return long.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", F.get(shares, "k").alias("explained"), F.lit(error).alias("identity_error"))
