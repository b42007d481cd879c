"""Whitening of embeddings with MLlib's BlockMatrix.

Vectors become whole numbers and are centred by the rounded mean of each dimension, so the
entries of the centred matrix are small whole numbers and every product and sum of the
scatter matrix is exact; the remainder of the mean, less than a half, is taken off the
covariance as a matrix of rank one and off the projections as a constant row. Rows are
numbered into dense blocks. Transpose times matrix, both BlockMatrix, gives the scatter, a
local ``eigh`` the components, and matrix times whitening matrix the projections.

The passes read the source again rather than keep its blocks; what a product shuffles is
removed as soon as its result is written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import only
from tessera.session import staged

COMPONENTS = 8
SCALE = 1024
OFFSET = 100_000
#: Entries whose whole number is beyond this count as not finite: their squares are no longer exact.
LARGEST = 1 << 40
#: Size of a block of doubles, and of what one task multiplies.
BLOCK_BYTES = 8 << 20
TASK_BYTES = 32 << 20
#: Components whose share of the largest eigenvalue is below this have no direction.
LEAST_SHARE = 1e-13
MOST_DIMENSIONS = 4096


def whole_numbers(column: pa.Array, dimensions: int | None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Usable vectors as whole numbers: {dimensions: (places in the batch, rows x dimensions)}.

    Left out: null, empty, null or non-finite entries, entries beyond LARGEST, and, where
    ``dimensions`` is given, vectors of another length.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    flat = column.flatten()
    values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    with np.errstate(invalid="ignore", over="ignore"):
        x = np.floor(values * SCALE) + OFFSET
        bad = ~(np.abs(x) <= LARGEST)
    wrong = np.zeros(len(values) + 1, np.int64)
    np.cumsum(bad, out=wrong[1:])
    good = (sizes > 0) & (wrong[ends] == wrong[ends - sizes])
    out = {}
    for d in [dimensions] if dimensions else np.unique(sizes[good]).tolist():
        rows = np.flatnonzero(good & (sizes == d))
        if len(rows):
            places = (ends[rows] - d)[:, None] + np.arange(d)
            out[d] = rows, x[places].astype(np.int64)
    return out


def _totals(vectors: DataFrame) -> DataFrame:
    """Rows and sums by task, vector length and dimension."""

    def run(batches):
        rows: dict[int, int] = {}
        sums: dict[int, list] = {}
        for batch in batches:
            for d, (_, x) in whole_numbers(batch.column(1), None).items():
                rows[d] = rows.get(d, 0) + len(x)
                # Python's integers, so that no sum is ever too large.
                sums[d] = [a + b for a, b in zip(sums.get(d, [0] * d), x.sum(axis=0).tolist())]
        task = TaskContext.get().partitionId()
        for d in rows:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([task] * d, pa.int32()),
                    pa.array([d] * d, pa.int32()),
                    pa.array(range(d), pa.int32()),
                    pa.array([rows[d]] * d, pa.int64()),
                    pa.array([str(s) for s in sums[d]], pa.string()),
                ],
                ["task", "d", "dimension", "n", "total"],
            )

    return vectors.mapInArrow(run, "task int, d int, dimension int, n bigint, total string")


class Plan:
    """Where each task's rows go: the first block of every task, and the numbers of the fit list."""

    def __init__(self, d: int, counts: dict[int, int], sums: list[int]):
        self.d, self.counts, self.sums = d, counts, sums
        self.n = sum(counts.values())
        self.centre = np.array([(2 * s + self.n) // (2 * self.n) for s in sums], np.int64)
        # s/n - centre, from whole numbers.
        self.rest = np.array([(s - int(c) * self.n) / self.n for s, c in zip(sums, self.centre)])
        most = max(1, BLOCK_BYTES // (8 * d))
        self.rows = min(most, max(counts.values()))
        self.first, at = {}, 0
        for task in sorted(counts):
            self.first[task] = at
            at += -(-counts[task] // self.rows)
        self.blocks = at


def measure(vectors: DataFrame) -> Plan | None:
    """The dimension that most vectors have (of equals the larger), its sums, and rows by task."""
    found = staged(_totals(vectors), "totals")
    sizes = found.filter("dimension = 0").groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return None
    d = sizes[0]["d"]
    if d > MOST_DIMENSIONS:
        raise ValueError(f"vectors of {d} dimensions: the scatter matrix is held on the driver up to {MOST_DIMENSIONS}")
    mine = found.filter(F.col("d") == d)
    counts = {r["task"]: r["n"] for r in mine.filter("dimension = 0").select("task", "n").collect()}
    sums = mine.groupBy("dimension").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dimension").collect()
    return Plan(d, counts, [int(r["total"]) for r in sums])


def _filled(plan: Plan, vectors: bool):
    """Blocks of one task: numbered, filled up with zero rows; with ids and deviations, or with vectors."""

    def run(batches):
        task = TaskContext.get().partitionId()
        number = plan.first.get(task, 0)
        held: list[tuple[pa.Array, np.ndarray]] = []
        size, seen = 0, 0

        def block():
            nonlocal held, size, number
            x = np.concatenate([h[1] for h in held])[: plan.rows]
            ids = pa.concat_arrays([h[0] for h in held])
            left = size - len(x)
            yield _block(number, x, ids.slice(0, len(x)), plan) if vectors else _names(number, x, ids.slice(0, len(x)), plan)
            rest = np.concatenate([h[1] for h in held])[len(x) :]
            held, size = ([(ids.slice(len(x)), rest)] if left else []), left
            number += 1

        for batch in batches:
            for _, (rows, x) in whole_numbers(batch.column(1), plan.d).items():
                held.append((batch.column(0).take(pa.array(rows)), x - plan.centre))
                size += len(x)
                seen += len(x)
                while size >= plan.rows:
                    yield from block()
        if size:
            yield from block()
        if seen != plan.counts.get(task, 0):
            raise RuntimeError(f"task {task} read {seen} vectors, {plan.counts.get(task, 0)} when counted: pass copy=True")

    return run


def _block(number: int, x: np.ndarray, ids: pa.Array, plan: Plan) -> pa.RecordBatch:
    full = np.zeros((plan.rows, plan.d))
    full[: len(x)] = x
    one = lambda v, kind: pa.array([v], kind)
    values = pa.ListArray.from_arrays(pa.array([0, full.size], pa.int32()), pa.array(full.ravel()))
    key = pa.StructArray.from_arrays([one(number, pa.int64()), one(0, pa.int64())], ["_1", "_2"])
    none = pa.array([None], pa.list_(pa.int32()))
    matrix = pa.StructArray.from_arrays(
        [one(1, pa.int8()), one(plan.rows, pa.int32()), one(plan.d, pa.int32()), none, none, values, one(True, pa.bool_())],
        ["type", "numRows", "numCols", "colPtrs", "rowIndices", "values", "isTransposed"],
    )
    return pa.RecordBatch.from_arrays([key, matrix], ["_1", "_2"])


def _names(number: int, x: np.ndarray, ids: pa.Array, plan: Plan) -> pa.RecordBatch:
    bounds = pa.array([0, len(x)], pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array([number], pa.int64()), pa.ListArray.from_arrays(bounds, ids), pa.ListArray.from_arrays(bounds, pa.array(deviations(x, plan), pa.int64()))],
        ["block", "ids", "deviations"],
    )


def deviations(x: np.ndarray, plan: Plan) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 of rows centred by ``plan``; null beyond a long."""
    shift = [int(c) * plan.n - s for c, s in zip(plan.centre, plan.sums)]
    far = plan.n * int(np.abs(x).max()) + max(map(abs, shift)) if len(x) else 0
    if far * far * plan.d < 1 << 63:
        away = plan.n * x + np.array(shift, np.int64)
        return (away * away).sum(axis=1).tolist()
    away = x.astype(object) * plan.n + np.array(shift, object)
    return [v if v < 1 << 63 else None for v in (away * away).sum(axis=1).tolist()]


_BLOCK_SCHEMA = T.StructType(
    [
        T.StructField("_1", T.StructType([T.StructField("_1", T.LongType(), False), T.StructField("_2", T.LongType(), False)]), False),
        T.StructField("_2", MatrixUDT(), False),
    ]
)


def block_matrix(rows: DataFrame, plan: Plan) -> BlockMatrix:
    """The centred rows as a BlockMatrix of one column of blocks."""
    blocks = rows.mapInArrow(_filled(plan, True), _BLOCK_SCHEMA)
    return BlockMatrix(callMLlibFunc("createBlockMatrix", blocks, plan.rows, plan.d, plan.blocks * plan.rows, plan.d), plan.rows, plan.d)


def product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """``left`` times ``right``, the inner dimension dealt to ``splits`` tasks for each block of the result."""
    wrapped = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(wrapped, left.rowsPerBlock, right.colsPerBlock)


def drop_shuffles(*matrices: BlockMatrix) -> None:
    """Remove the shuffle files of a product whose result has been taken."""
    for matrix in matrices:
        matrix._java_matrix_wrapper._java_model.blocks().cleanShuffleDependencies(True)


def components(scatter: np.ndarray, plan: Plan, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues and unit eigenvectors (columns) by falling eigenvalue, and shares of the trace.

    The sign is that which makes a component's largest entry positive.
    """
    cov = scatter / plan.n - np.outer(plan.rest, plan.rest)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = np.maximum(values[::-1][:most], 0.0), vectors[:, ::-1][:, :most]
    peak = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[peak, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(cov))
    return values, vectors, values / trace if trace > 0 else np.zeros_like(values)


def _pairs(shift: np.ndarray):
    """Ids with their projections: the rows of a block beside its ids."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ids, dev = batch.column(0).slice(i, 1).flatten(), batch.column(1).slice(i, 1).flatten()
                matrix = batch.column(2).slice(i, 1)
                rows, cols = matrix.field("numRows")[0].as_py(), matrix.field("numCols")[0].as_py()
                values = np.asarray(matrix.field("values")[0].values)
                table = values.reshape(rows, cols) if matrix.field("isTransposed")[0].as_py() else values.reshape(cols, rows).T
                whitened = np.ascontiguousarray(table[: len(ids)] - shift)
                bounds = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * cols)
                yield pa.RecordBatch.from_arrays([ids, dev, pa.ListArray.from_arrays(bounds, pa.array(whitened.ravel()))], ["vec_id", "deviation", "whitened"])

    return run


def _scatter_parts(k: int):
    """Rows, sums and products of whitened rows by task."""

    def run(batches):
        n, sums, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, k)
            n, sums, products = n + len(x), sums + x.sum(axis=0), products + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tolist()]), pa.array([products.ravel().tolist()])], ["n", "sums", "products"])

    return run


def identity_error(projected: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity."""
    parts = projected.select("whitened").mapInArrow(_scatter_parts(k), "n bigint, sums array<double>, products array<double>")
    total = parts.select(
        F.sum("n"),
        F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(k)]),
        F.array(*[F.sum(F.get("products", F.lit(i))) for i in range(k * k)]),
    ).first()
    mean = np.array(total[1]) / total[0]
    cov = np.array(total[2]).reshape(k, k) / total[0] - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k)).max())


def whiten(vectors: DataFrame, name: str = "vec_id", column: str = "embedding", most: int = COMPONENTS, copy: bool = False) -> DataFrame:
    """Per usable vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Left out are null and empty vectors, vectors with null, NaN, infinite or huge entries
    (beyond 2^30), and vectors of another length than most have (of equally frequent
    lengths the larger counts). Components without variance, as in constant vectors or fewer
    vectors than dimensions, have a null ``whitened`` and do not count for identity_error,
    which is null if no component has variance. deviation is null where no long holds it.
    Repeated rows are rows of their own, null ids stay; no vectors give no rows. Only the
    id and the vector are read; the id's column is called vec_id in the result. The table is
    read several times and must give every task the same rows each time, as files do; a
    task that finds another number of them ends with an error. ``copy`` writes the two
    columns first, for inputs that are computed in no fixed order. The driver
    holds the scatter matrix (dimensions squared, at most 4,096 of them), a number for each
    task and one for each block of 8 MB.
    """
    kind = vectors.schema[name].dataType.simpleString()
    schema = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    rows = only(vectors, name, column)
    rows = rows.select(F.col(name).alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
    if copy:
        rows = staged(rows, "vectors")
    plan = measure(rows)
    if plan is None:
        return spark.createDataFrame([], f"vec_id {kind}, {schema}")
    centred = block_matrix(rows, plan)
    in_task = max(1, TASK_BYTES // (16 * plan.rows * plan.d))
    scatter = product(centred.transpose(), centred, max(1, plan.blocks // in_task))
    values, directions, explained = components(scatter.toLocalMatrix().toArray(), plan, most)
    drop_shuffles(scatter)

    alive = np.flatnonzero(values > LEAST_SHARE * values[0]) if values[0] > 0 else np.zeros(0, int)
    if len(alive):
        weights = directions[:, alive] / np.sqrt(values[alive])
    else:
        weights = np.zeros((plan.d, 1))
    k = weights.shape[1]
    whitening = BlockMatrix(spark.sparkContext.parallelize([((0, 0), DenseMatrix(plan.d, k, weights.ravel(order="F").tolist()))], 1), plan.d, k)
    projected = product(centred, whitening, 1)
    blocks = callMLlibFunc("getMatrixBlocks", projected._java_matrix_wrapper._java_model)
    blocks = blocks.select(F.col("_1._1").cast("bigint").alias("block"), F.col("_2").alias("matrix"))
    names = rows.mapInArrow(_filled(plan, False), f"block bigint, ids array<{kind}>, deviations array<bigint>")
    both = names.join(blocks, "block").select("ids", "deviations", "matrix")
    found = staged(both.mapInArrow(_pairs(plan.rest @ weights), f"vec_id {kind}, deviation bigint, whitened array<double>"), "whitened")
    drop_shuffles(projected)

    error = identity_error(found, k) if len(alive) else None
    count = min(most, plan.d)
    place = {int(c): i for i, c in enumerate(alive)}
    entries = F.array(
        *[
            F.struct(
                F.lit(c + 1).alias("component"),
                (F.get("whitened", F.lit(place[c])) if c in place else F.lit(None).cast("double")).alias("whitened"),
                F.lit(float(explained[c])).alias("explained"),
            )
            for c in range(count)
        ]
    )
    exploded = found.select("vec_id", "deviation", F.explode(entries).alias("e"))
    return exploded.select(
        "vec_id", "e.component", F.lit(plan.n).cast("bigint").alias("n"), "deviation", "e.whitened", "e.explained",
        F.lit(error).cast("double").alias("identity_error"),
    )
