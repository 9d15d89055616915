"""Embedding whitening on MLlib's BlockMatrix.

Rows are centred on exact integer sums, indexed into distributed blocks of
rows, and the transposed matrix times the matrix gives the scatter; its
eigenvectors are taken on the driver, whose part is as large as the dimensions squared. Another
product of blocks, with the whitening matrix, projects every row.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from logsight.session import stage

#: Bytes of a block of rows.
BLOCK_BYTES = 32 << 20
#: Blocks of rows that one task multiplies and adds up.
_BLOCKS_A_TASK = 16

RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): vectors without nulls and non-finite entries, as whole numbers."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = "v IS NOT NULL AND size(v) > 0 AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))"
    return rows.filter(finite).select("id", F.expr("transform(v, c -> CAST(floor(64 * c) AS LONG) + 1000000)").alias("x"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with dense numbers ``index`` from 0: a block is a range of them. What
    the numbers follow from is written once, so a lost task finds them again."""
    spark = rows.sparkSession
    rows = stage(rows.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "embeddings")
    sizes = rows.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # one row per file split
    begin = np.cumsum([0, *(r.n for r in sizes)]).tolist()
    offsets = spark.createDataFrame([(r.part, b) for r, b in zip(sizes, begin)], "part int, begin long")
    return rows.join(offsets, "part").withColumn("index", F.col("begin") + F.col("nth")).drop("part", "nth", "begin")


def blocks(rows: DataFrame, n: int, dims: int) -> BlockMatrix:
    """Blocks of rows of (index, vector): as many as spread the work, none over ``BLOCK_BYTES``.

    The blocks are put together from Arrow batches. ``IndexedRowMatrix.toBlockMatrix`` shuffles
    an object for each entry instead, which took some hundred times as long.
    """
    a_block = int(min(max(256, n // 2048), max(1, BLOCK_BYTES // (8 * dims))))
    dealt = rows.select((F.col("index") / a_block).cast("int").alias("block"), "index", "vector").repartition("block").sortWithinPartitions("block", "index")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = None

        def matrix() -> pa.RecordBatch:
            values = pa.array(np.concatenate(held))
            shape = [pa.array([1], pa.int8()), pa.array([len(values) // dims], pa.int32()), pa.array([dims], pa.int32()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, pa.list_(pa.int32())), pa.ListArray.from_arrays([0, len(values)], values), pa.array([True])]
            place = pa.StructArray.from_arrays([pa.array([at], pa.int64()), pa.array([0], pa.int64())], ["_1", "_2"])
            return pa.RecordBatch.from_arrays([place, pa.StructArray.from_arrays(shape, ["type", "numRows", "numCols", "colPtrs", "rowIndices", "values", "isTransposed"])], ["_1", "_2"])

        for batch in batches:
            block, vector = batch.column(0).to_numpy(), batch.column(2).flatten().to_numpy()
            cuts = (np.flatnonzero(block[1:] != block[:-1]) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(block)]):
                if a < b:
                    if held and block[a] != at:
                        yield matrix()
                        held = []
                    at = int(block[a])
                    held.append(vector[a * dims:b * dims])
        if held:
            yield matrix()

    def schema(matrix: DataType) -> StructType:
        return StructType([StructField("_1", StructType([StructField("_1", LongType()), StructField("_2", LongType())])), StructField("_2", matrix)])

    # Arrow knows the matrix type only by its fields; the reader of the written blocks takes it by name
    made = stage(dealt.mapInArrow(work, schema(MatrixUDT.sqlType())), "embeddings-blocks", schema(MatrixUDT()))
    return BlockMatrix(callMLlibFunc("createBlockMatrix", made, a_block, dims, n, dims), a_block, dims)


def scatter(matrix: BlockMatrix) -> np.ndarray:
    """The transposed matrix times the matrix. The rows are the middle dimension of
    this product: it is cut into as many splits as tasks should share it."""
    splits = -(-matrix._java_matrix_wrapper.call("numRowBlocks") // _BLOCKS_A_TASK)
    own = matrix._java_matrix_wrapper
    product = own.call("transpose").multiply(own._java_model, int(splits))
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def project(spark: SparkSession, matrix: BlockMatrix, onto: np.ndarray) -> DataFrame:
    """(index, vector): every row times ``onto``."""
    dims, k = onto.shape
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(dims, k, onto.ravel(order="F").tolist()))], 1), dims, k)
    # the product's blocks are dealt to a grid of its own; one split keeps a block's row whole
    found = callMLlibFunc("getMatrixBlocks", matrix.multiply(right)._java_matrix_wrapper._java_model)
    a_block = matrix.rowsPerBlock

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, m in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = m["numRows"].as_py()
                values = np.asarray(m["values"].values).reshape((rows, k), order="C" if m["isTransposed"].as_py() else "F")
                index = int(place["_1"]) * a_block + np.arange(rows)
                yield pa.RecordBatch.from_arrays([pa.array(index), pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * k, pa.array(values.ravel()))], ["index", "vector"])

    return found.mapInArrow(work, "index long, vector array<double>")


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) by falling eigenvalue; the
    entry of largest size of each vector is positive. Values of no more than rounding count as 0."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    values = np.where(values > max(values[0], 0) * len(covariance) * np.finfo(float).eps, values, 0.0)
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values, vectors * np.where(top < 0, -1.0, 1.0)


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, most: int = 32) -> DataFrame:
    """One row per usable vector and component (the first ``most`` by variance):
    id, component from 1, n, deviation, whitened, explained, identity_error.

    Entries count as x = floor(64 c) + 1,000,000. ``deviation`` is the exact sum over
    dimensions of (n x - S)^2, ``whitened`` the centred vector on the component over its standard deviation,
    ``explained`` the component's share of the variance and ``identity_error`` the largest entry of the
    whitened rows' covariance minus the identity, one value.

    Rows with a null or empty vector or with a null or non-finite entry drop out. A vector with
    fewer entries than the longest lacks entries and drops out too. Rows that repeat an id
    stay rows of their own, also with a null id. A component without variance has whitened and explained 0
    and does not count for identity_error. No usable row: an empty result. Other columns are not read.
    """
    spark = rows.sparkSession
    data = numbered(usable(rows, id_col, vector_col))
    kind = dict(rows.dtypes)[id_col]
    dims = data.agg(F.max(F.size("x")).alias("d")).first().d
    if not dims:
        return spark.createDataFrame([], f"`{id_col}` {kind}, {RESULT}")
    if data.filter(F.size("x") < dims).limit(1).count():
        data = numbered(data.filter(F.size("x") == dims).drop("index"))
    # one row for each dimension
    each = data.select(F.posexplode("x").alias("d", "x")).groupBy("d").agg(F.count("*").alias("n"), F.sum("x").alias("s")).orderBy("d").collect()
    n, sums = each[0].n, F.lit(np.array([r.s for r in each], np.int64))
    # exact: whole numbers, divided last
    apart = F.zip_with("x", sums, lambda x, s: x * n - s)
    data = data.select("index", "id", apart.alias("apart"))
    deviation = F.expr("CAST(aggregate(apart, CAST(0 AS DECIMAL(38, 0)), (a, x) -> CAST(a + CAST(x AS DECIMAL(19, 0)) * CAST(x AS DECIMAL(19, 0)) AS DECIMAL(38, 0))) AS LONG)")
    matrix = blocks(data.select("index", F.transform("apart", lambda x: x / n).alias("vector")), n, dims)
    covariance = scatter(matrix) / n
    values, vectors = components(covariance, most)
    trace = float(np.trace(covariance))
    live = values > 0
    onto = np.where(live, vectors / np.sqrt(np.where(live, values, 1.0)), 0.0)
    white = stage(project(spark, matrix, onto), "embeddings-white")
    means = white.select(F.posexplode("vector").alias("c", "w")).groupBy("c").agg(F.avg("w").alias("m")).orderBy("c").collect()
    centred = white.select("index", F.zip_with("vector", F.lit(np.array([r.m for r in means])), lambda w, m: w - m).alias("vector"))
    off = np.abs(scatter(blocks(centred, n, len(values))) / n - np.eye(len(values)))[live][:, live]
    error = float(off.max()) if off.size else 0.0
    shares = F.lit(np.array([float(v / trace) if trace > 0 else 0.0 for v in values]))
    out = data.select("index", F.col("id").alias(id_col), deviation.alias("deviation")).join(white, "index")
    out = out.select(id_col, "deviation", F.posexplode("vector").alias("c", "whitened"))
    return out.select(
        id_col, (F.col("c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("c") + 1).alias("explained"), F.lit(error).alias("identity_error"))
