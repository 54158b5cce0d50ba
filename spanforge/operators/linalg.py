"""Distributed thin decompositions of tall matrices whose rows are a tensor's degrees of freedom.

Direct TSQR: every task factors blocks of a bounded number of rows and writes each block's Q and R as one row of a table
in the shared folder, so later passes see the same blocks whatever is lost and recomputed, and the data are not shuffled
to be factored. The R factors are reduced in a tree of bounded fan-in; the last ones, ``FAN`` at most, are factored on the
driver, whose work depends on the number of columns alone. Going down the tree gives each block the small matrix by
which its Q is multiplied; these matrices are a written table, so their size is known: they are broadcast as long as they
are small (a matrix of columns x modes for each 8192 rows), beyond that Q is shuffled once to meet them. Q is orthonormal whatever the rank. The Gram variant squares the condition number but reads
the data once and keeps nothing of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.plans.storage import written
from spanforge.plans.tensor import Extents, Tensor

BLOCK_ROWS, FAN = 8192, 256


def matrix_of(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n)


def _blocks(batches: Iterator[pa.RecordBatch], n: int, block_rows: int) -> Iterator[pa.RecordBatch]:
    """Factored blocks: block, var, x, q, r."""
    part, made, held, room = TaskContext.get().partitionId(), 0, [], 0

    def put(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        nonlocal made
        table = pa.Table.from_batches(rows).combine_chunks()
        q, r = np.linalg.qr(matrix_of(table["v"].chunk(0), n))
        values = [(part << 32) | made, table["var"].to_pylist(), table["x"].to_pylist(), q.ravel(), r.ravel()]
        made += 1
        types = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["block", "var", "x", "q", "r"])

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            held.append(batch.slice(at, block_rows - room))
            at, room = at + held[-1].num_rows, room + held[-1].num_rows
            if room == block_rows:
                yield put(held)
                held, room = [], 0
    if held:
        yield put(held)


class Tsqr:
    """The factored tensor: ``r`` on the driver (columns x columns at most), Q in blocks."""

    def __init__(self, tensor: Tensor, block_rows: int = BLOCK_ROWS, fan: int = FAN):
        n = tensor.extents.n_s
        self.extents, self.n = tensor.extents, n
        schema = "block long, var array<int>, x array<long>, q array<double>, r array<double>"
        self.blocks = written(tensor.rows.select("var", "x", "v").mapInArrow(lambda it: _blocks(it, n, block_rows), schema))
        levels: list[DataFrame] = []
        nodes = self.blocks.select(F.col("block").alias("id"), "r")
        while (count := nodes.count()) > fan:
            parents = -(-count // (fan // 2))
            grouped = nodes.withColumn("up", F.pmod(F.xxhash64("id"), F.lit(parents)))
            factored = written(grouped.groupBy("up").applyInPandas(_reducer(n), "up long, id long, q array<double>, r array<double>"))
            levels.append(factored.select("id", "up", "q"))
            nodes = factored.where("r is not null").select(F.col("up").alias("id"), "r")
        top = sorted(nodes.collect(), key=lambda row: row["id"])  # ``fan`` matrices at most
        parts = [np.array(row["r"]).reshape(-1, n) for row in top]
        q, self.r = np.linalg.qr(np.concatenate(parts)) if parts else (np.zeros((0, n)), np.zeros((0, n)))
        edges = np.cumsum([len(p) for p in parts])[:-1]
        self._top = [(row["id"], piece) for row, piece in zip(top, np.split(q, edges))] if parts else []
        self._levels = levels

    def _factors(self, right: np.ndarray) -> DataFrame:
        """id, m: the matrix by which each block's Q is multiplied so that Q @ right results."""
        spark = self.blocks.sparkSession
        down = spark.createDataFrame([(i, (piece @ right).ravel().tolist()) for i, piece in self._top], "id long, m array<double>")
        k, n = right.shape[1], self.n

        def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(np.array(q).reshape(-1, min(n, len(m) // k)) @ np.array(m).reshape(-1, k)).ravel() for q, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], ["id", "m"])

        for level in reversed(self._levels):
            down = level.join(down.withColumnRenamed("id", "up"), "up").select("id", "q", "m").mapInArrow(times, "id long, m array<double>")
        return down

    def times(self, right: np.ndarray) -> Tensor:
        """Q @ right as a tensor."""
        k = right.shape[1]

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in range(batch.num_rows):
                    var, x, q, m = (batch.column(c).slice(b, 1).flatten() for c in range(4))
                    u = q.to_numpy().reshape(len(var), -1) @ m.to_numpy().reshape(-1, k)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, u.size + 1, k, dtype=np.int32)), pa.array(u.ravel()))
                    yield pa.RecordBatch.from_arrays([var, x, lists], ["var", "x", "v"])

        joined = self.blocks.select(F.col("block").alias("id"), "var", "x", "q").join(written(self._factors(right)), "id")
        out = joined.select("var", "x", "q", "m").mapInArrow(rows, "var int, x long, v array<double>")
        return Tensor(out, Extents(self.extents.n_var, self.extents.n_x, k))

    def svd(self) -> tuple[Tensor, np.ndarray, np.ndarray]:
        """U, singular values (descending), V^T."""
        u, s, vt = np.linalg.svd(self.r, full_matrices=False)
        return self.times(u), s, vt

    def q(self) -> Tensor:
        return self.times(np.eye(len(self.r)))


def _reducer(n: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def reduce(children: pd.DataFrame) -> pd.DataFrame:
        children = children.sort_values("id")
        parts = [np.array(r).reshape(-1, n) for r in children["r"]]
        q, r = np.linalg.qr(np.concatenate(parts))
        pieces = np.split(q, np.cumsum([len(p) for p in parts])[:-1])
        first = [r.ravel()] + [None] * (len(parts) - 1)
        return pd.DataFrame({"up": children["up"], "id": children["id"], "q": [p.ravel() for p in pieces], "r": first})

    return reduce


def signed(u: Tensor) -> Tensor:
    """Each mode's entry of largest size, the one of the lowest row on ties, made positive.

    Every batch sends one candidate a mode. Sizes that differ by rounding alone count as ties.
    """
    n_x, k = u.extents.n_x, u.extents.n_s

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row_id = batch.column(0).to_numpy().astype(np.int64) * n_x + batch.column(1).to_numpy()
                order = np.argsort(row_id)
                m = matrix_of(batch.column(2), k)[order]
                size = np.round(np.abs(m), 9)
                at = size.argmax(axis=0)  # the first of equals, rows being in order
                modes = np.arange(k)
                yield pa.RecordBatch.from_arrays([pa.array(modes), pa.array(size[at, modes]), pa.array(-row_id[order][at]), pa.array(m[at, modes])], ["mode", "size", "place", "e"])

    best = u.rows.select("var", "x", "v").mapInArrow(candidates, "mode long, size double, place long, e double")
    signs = best.groupBy("mode").agg(F.max_by("e", F.struct("size", "place")).alias("e"))
    found = {r["mode"]: -1.0 if r["e"] < 0 else 1.0 for r in signs.collect()}  # one number a mode
    flips = F.array(*[F.lit(found.get(m, 1.0)) for m in range(k)])
    return u.with_values(F.zip_with("v", flips, lambda a, b: a * b))


def gram(tensor: Tensor) -> np.ndarray:
    """S^T S. Each task sends one partial sum for each pair of columns."""
    n = tensor.extents.n_s

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            m = matrix_of(batch.column(0), n)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n * n)), pa.array(total.ravel())], ["cell", "g"])

    out = np.zeros(n * n)
    for row in tensor.rows.select("v").mapInArrow(partial, "cell long, g double").groupBy("cell").agg(F.sum("g").alias("g")).collect():
        out[row["cell"]] = row["g"]
    return out.reshape(n, n)


def products(rows: DataFrame, n_var: int, k: int, n: int) -> dict[int, np.ndarray]:
    """``rows``: var, l, r. For each variable the sum of the outer products l r^T; each task sends one partial sum a cell."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            var = batch.column(0).to_numpy()
            left, right = matrix_of(batch.column(1), k), matrix_of(batch.column(2), n)
            for v in np.unique(var).tolist():
                total[v] = total.get(v, 0.0) + left[var == v].T @ right[var == v]
        for v, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k * n, v, np.int32)), pa.array(np.arange(k * n)), pa.array(m.ravel())], ["var", "cell", "p"])

    out = {v: np.zeros(k * n) for v in range(n_var)}
    for row in rows.mapInArrow(partial, "var int, cell long, p double").groupBy("var", "cell").agg(F.sum("p").alias("p")).collect():
        out[row["var"]][row["cell"]] = row["p"]
    return {v: m.reshape(k, n) for v, m in out.items()}


def times(tensor: Tensor, right: np.ndarray) -> Tensor:
    """S @ right, a narrow map with the small matrix in its closure."""
    n, k = right.shape

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = matrix_of(batch.column(2), n) @ right
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, u.size + 1, k, dtype=np.int32)), pa.array(u.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["var", "x", "v"])

    out = tensor.rows.select("var", "x", "v").mapInArrow(rows, "var int, x long, v array<double>")
    return Tensor(out, Extents(tensor.extents.n_var, tensor.extents.n_x, k))


def svd_tsqr(tensor: Tensor) -> tuple[Tensor, np.ndarray]:
    u, s, _ = Tsqr(tensor).svd()
    return u, s


def svd_gram(tensor: Tensor) -> tuple[Tensor, np.ndarray]:
    """Method of snapshots. Modes whose eigenvalue drowns in rounding are dropped, as they cannot be made unit length."""
    values, vectors = np.linalg.eigh(gram(tensor))
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    keep = values > np.finfo(float).eps * len(values) * max(values[0], 0.0) if len(values) else np.zeros(0, bool)
    s = np.sqrt(values[keep])
    return times(tensor, vectors[:, keep] / s), s


#: Named decompositions; any callable from a tensor to (U, singular values) may stand in their place.
DECOMPOSITIONS: dict[str, Callable[[Tensor], tuple[Tensor, np.ndarray]]] = {"tsqr": svd_tsqr, "gram": svd_gram}


def decompose(tensor: Tensor, svd: str | Callable = "tsqr", sign: str = "largest") -> tuple[Tensor, np.ndarray]:
    u, s = (svd if callable(svd) else DECOMPOSITIONS[svd])(tensor)
    return (signed(u) if sign == "largest" else u), s
