"""Embedding whitening with MLlib's distributed block matrices.

Components become integers; the distinct integer vectors are the fit list.  Its rows, centred by their exact sums, are
indexed into the blocks of a BlockMatrix; the transpose times the matrix is the scatter.  A local eigendecomposition of that
dimensions x dimensions matrix gives the whitening matrix, and the centred rows of all vectors, as a BlockMatrix, are
multiplied by it.

Two forms keep BlockMatrix from meeting whole inputs in one task.  The scatter is one block of a product, so its
middle dimension is split: each split adds up its own blocks.  The projection of a tall column of blocks would be
dealt to the square root of the tasks; its blocks are therefore folded into a square of block rows and columns, and the
other factor holds the whitening matrix once for each block column, on its diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import read_table, stage_table
from corvane.llm.vector_codes import finite

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Values of a block, about, and blocks that meet in one task of a product, about.
BLOCK, MEET = 1 << 16, 64
#: Integers beyond this size count as this size.
TOP = 1 << 40
#: Share of the total variance up to which an eigenvalue is one of rounding.
ROUNDING = 1e-13


def whole_vectors(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """((vec_id, x), length of x): vectors without null or non-finite entries as floor(SCALE * entry), filled with zeros to the longest; 0 if there are none.

    The offset of the integers takes no part: it cancels in n * x - S and in x - S / n.
    """
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e")).filter(finite("e"))
    most, least, n = kept.agg(F.max(F.size("e")), F.min(F.size("e")), F.count(F.lit(1))).first()
    x = F.transform("e", lambda c: F.floor(F.greatest(F.lit(-float(TOP)), F.least(F.lit(float(TOP)), c.cast("double") * SCALE))).cast("long"))
    length = max(1, most or 0)
    if n and least < length:
        x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("e")))
    return kept.select("vec_id", x.alias("x")), length if n else 0


_BLOCKS = "task int, k int, ids array<long>, x array<long>"


def _blocked(rows: int, length: int):
    """Rows (vec_id, x) of a task one after another in blocks of `rows`, numbered by the task and within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        held: list[np.ndarray] = []
        size = 0

        def block(n: int) -> pa.RecordBatch:
            nonlocal ids, held, size, k
            all_ids, all_x = pa.concat_arrays(ids), np.concatenate(held)
            out = pa.record_batch({"task": pa.array([task], pa.int32()), "k": pa.array([k], pa.int32()), "ids": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), all_ids[:n]), "x": pa.ListArray.from_arrays(pa.array([0, n * length], pa.int32()), pa.array(all_x[:n].ravel()))})
            ids, held, size, k = [all_ids[n:]], [all_x[n:]], size - n, k + 1
            return out

        for b in batches:
            ids.append(b.column("vec_id"))
            held.append(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, length))
            size += b.num_rows
            while size >= rows:
                yield block(rows)
        if size:
            yield block(size)

    return run


def blocks(vectors: DataFrame, rows: int, length: int, name: str) -> tuple[DataFrame, int]:
    """((i, ids, x), upper end of i): a table of blocks with numbers i that are nearly consecutive, whatever the tasks hold."""
    table = stage_table(vectors.select("vec_id", "x").mapInArrow(_blocked(rows, length), _BLOCKS), name)
    tasks, deep = table.agg(F.max("task") + 1, F.max("k") + 1).first()
    return table.select((F.col("k").cast("long") * tasks + F.col("task")).alias("i"), "ids", "x"), tasks * deep


def _sums(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(length, np.int64)
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
            n, total = n + len(x), total + x.sum(axis=0)
        yield pa.record_batch({"at": pa.array(np.arange(-1, length)), "value": pa.array(np.concatenate([[n], total]))})

    return run


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exactly: 64-bit integers where they are enough, else Python's."""
    top = max(int(np.abs(x).max(initial=0)) * n, int(np.abs(sums).max(initial=0)))
    return n * x - sums if top < 1 << 62 else n * x.astype(object) - sums.astype(object)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n: the division comes last, so nothing cancels."""
    return _deviations(x, n, sums).astype(np.float64) / n


def _centred_blocks(rows: int, n: int, sums: np.ndarray):
    """(i, centred rows in order of columns, filled with rows of zeros)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                x = b.column("x").slice(k, 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sums))
                full = np.zeros((rows, len(sums)), order="F")
                full[: len(x)] = centred(x, n, sums)
                yield pa.record_batch({"i": b.column("i").slice(k, 1), "values": pa.array([full.tobytes("F")], pa.binary())})

    return run


def block_matrix(table: DataFrame, most: int, rows: int, n: int, sums: np.ndarray, across: int) -> BlockMatrix:
    """The centred rows of a table of blocks as a BlockMatrix with `across` block columns: block i is at (i // across, i % across)."""
    length = len(sums)
    placed = table.select("i", "x").mapInArrow(_centred_blocks(rows, n, sums), "i long, values binary").rdd
    made = placed.map(lambda r: ((r[0] // across, r[0] % across), DenseMatrix(rows, length, np.frombuffer(bytes(r[1])))))
    return BlockMatrix(made, rows, length, rows * -(-most // across), length * across)


def scatter(fit: BlockMatrix, splits: int) -> np.ndarray:
    """The transpose times the matrix, its middle dimension in `splits` parts."""
    turned = fit.transpose()
    # Python's multiply lacks the second argument of the JVM's
    product = turned._java_matrix_wrapper.call("multiply", fit._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, fit.colsPerBlock, fit.colsPerBlock).toLocalMatrix().toArray()


def whitening(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrix, explained, null): columns are unit eigenvectors by falling eigenvalue, over the root of it; null marks eigenvalues of 0, whose columns are 0."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    null = values <= max(trace, 0) * ROUNDING
    return np.where(null, 0, vectors / np.sqrt(np.where(null, 1, values))), (np.where(null, 0, values) / trace if trace > 0 else np.zeros(len(values))), null


def _products(n: int, sums: np.ndarray, matrix: np.ndarray):
    """Sums over a task of the products of whitened components of the fit list, whose means are 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((matrix.shape[1], matrix.shape[1]))
        for b in batches:
            w = centred(b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sums)), n, sums) @ matrix
            total += w.T @ w
        yield pa.record_batch({"at": pa.array(np.arange(total.size)), "value": pa.array(total.ravel())})

    return run


def _marked(n: int, sums: np.ndarray):
    """(i, ids, deviation): the exact sum of squares of n * x - S for every row; null where 64 bits don't hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                d = _deviations(b.column("x").slice(k, 1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(sums)), n, sums)
                if float(np.abs(d).max(initial=0)) ** 2 * len(sums) < 2.0**62:
                    out.append((d * d).sum(axis=1).tolist())
                else:
                    out.append([v if v < 1 << 63 else None for v in (d.astype(object) ** 2).sum(axis=1)])
            yield pa.record_batch({"i": b.column("i"), "ids": b.column("ids"), "deviation": pa.array(out, pa.list_(pa.int64()))})

    return run


_ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _rows(n: int, explained: np.ndarray, null: np.ndarray, identity_error: float, trace: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(explained)
        for b in batches:
            for k in range(b.num_rows):
                ids, deviation = b.column("ids").slice(k, 1).flatten(), b.column("deviation").slice(k, 1).flatten()
                rows = len(ids)
                w = np.frombuffer(b.column("values")[k].as_py()).reshape(-1, size)[:rows]
                each = np.repeat(np.arange(rows), size)
                yield pa.record_batch(
                    {
                        "vec_id": ids.take(pa.array(each)),
                        "component": pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), rows)),
                        "n": pa.array(np.full(rows * size, n)),
                        "deviation": deviation.take(pa.array(each)),
                        "whitened": pa.array(w.ravel(), mask=np.tile(null, rows)),
                        "explained": pa.array(np.tile(explained, rows), mask=np.full(rows * size, not trace)),
                        "identity_error": pa.array(np.full(rows * size, identity_error)),
                    }
                )

    return run


def whitened_vectors(embeddings: DataFrame, components: int = COMPONENTS, block: int = BLOCK, meet: int = MEET) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), a row for each component of each vector without null or non-finite entries.

    There are as many components as dimensions, at most `components`.  Rows that repeat a vec_id or all of a row have rows of
    their own, a null vec_id stays null; equal integer vectors count once in the fit.  Vectors shorter than the longest are
    filled with zeros, integers beyond TOP count as TOP.  A component of no variance has a null `whitened` and takes no part in
    identity_error; with no variance at all `explained` is null.  deviation is exact, and null where it leaves 64 bits.
    Extra columns are ignored; a table without such vectors gives no rows.
    """
    spark, (vectors, length) = embeddings.sparkSession, whole_vectors(embeddings)
    if not length:
        return spark.createDataFrame([], _ROWS)
    rows = max(16, block // length)
    fit, fit_end = blocks(vectors.select("x").distinct().select(F.lit(None).cast("long").alias("vec_id"), "x"), rows, length, "fit")
    added = dict(map(tuple, fit.select("x").mapInArrow(_sums(length), "at long, value long").groupBy("at").agg(F.sum("value")).collect()))
    n, sums = added.pop(-1), np.array([added[k] for k in range(length)], np.int64)
    covariance = scatter(block_matrix(fit, fit_end, rows, n, sums, 1), -(-fit_end // meet)) / n
    matrix, explained, null = whitening(covariance, components)
    size = matrix.shape[1]
    products = dict(map(tuple, fit.select("x").mapInArrow(_products(n, sums, matrix), "at long, value double").groupBy("at").agg(F.sum("value")).collect()))
    apart = np.abs(np.array([products[k] for k in range(size * size)]).reshape(size, size) / n - np.eye(size))[~null][:, ~null]

    table, end = blocks(vectors, rows, length, "vectors")
    across = max(1, int(np.ceil(np.sqrt(end))))
    diagonal = [((k, k), DenseMatrix(length, size, matrix.ravel("F"))) for k in range(across)]
    other = BlockMatrix(spark.sparkContext.parallelize(diagonal, max(1, -(-end // meet))), length, size, length * across, size * across)
    projected = block_matrix(table, end, rows, n, sums, across).multiply(other)
    values = projected.blocks.map(lambda r: (r[0][0] * across + r[0][1], bytearray(np.ascontiguousarray(r[1].toArray()).tobytes())))
    values = spark.createDataFrame(values, "i long, values binary")
    marked = table.mapInArrow(_marked(n, sums), "i long, ids array<long>, deviation array<long>")
    return marked.join(values, "i").mapInArrow(_rows(n, explained, null, float(apart.max(initial=0)), bool(np.trace(covariance) > 0)), _ROWS)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every embedding, as whitened_vectors gives them: vectors with null or non-finite entries are left out."""
    return whitened_vectors(read_table(spark, sf_dir, "embeddings"))


SQL: dict[str, str] = {}
