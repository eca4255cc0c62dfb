"""Exact top-k inner product search over an impact-ordered, score-at-a-time index.

Vectors are quantised to integers. Rows are dealt into blocks; a block's index holds, for each dimension, the
row numbers sorted by component and cut into segments of equal length. A query turns every segment into a
quantised impact, the most that it adds to a score or takes from it, and processes the segments by descending
impact. What a row can still gain is at most the length of the query times that of the row, both over the
dimensions in which the row hasn't been met yet (Cauchy-Schwarz); the k-th exact score of the rows that lead so far
is a floor. Processing stops only when these bounds prove that few rows, `FEW` of the block at most, can be among the
k best; those are rescored exactly.

Every block answers for each query; the k best of all blocks are the result. Queries meet blocks by
replication: a task has one block and one chunk of queries.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do rows without an id.
Only vectors of equal length meet. Ties go to the smaller id. Every row is a query or candidate of its own: with a
repeated id each of its rows asks for itself, and meets the others. Components and scores beyond 64 bits stop at the
limits of a long and are ties there; nothing overflows. Other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import materialize
from glossa.plans.session import ship

SEGMENT, STEP = 256, 64
FEW = 1 / 16
LIMIT = 2**63 - 1


class ImpactIndex:
    """The segments of one block; x: rows by dimensions, integers."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, (n, dims) = x, x.shape
        cuts = max(1, math.ceil(n / SEGMENT))
        order = np.argsort(-x, axis=0, kind="stable")
        rows = np.full((cuts * SEGMENT, dims), n)
        rows[:n] = order
        values = np.zeros((cuts * SEGMENT, dims))
        values[:n] = np.take_along_axis(x, order, axis=0)
        values[n:] = values[n - 1]
        self.rows = rows.T.reshape(dims, cuts, SEGMENT)
        self.values = values.T.reshape(dims, cuts, SEGMENT)
        self.reach = np.maximum(np.abs(self.values[:, :, 0]), np.abs(self.values[:, :, -1]))
        self.lengths = (x.astype(float) ** 2).sum(axis=1)
        self.most = int(np.abs(x.astype(float)).max(initial=0))
        self.share_read = 0.0

    def members(self, q: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best, none of those left out."""
        n, dims = self.x.shape
        self.share_read = 1.0
        if not dims or n <= k or self.most * int(np.abs(q.astype(float)).max()) * dims >= 2**53:
            return np.arange(n)
        impact = np.abs(q)[:, None] * self.reach
        order = np.argsort(-impact, axis=None, kind="stable")
        score, q_left, x_left = np.zeros(n + 1), np.full(n + 1, float(q @ q)), np.append(self.lengths, 0)
        least, cuts = -np.inf, impact.shape[1]
        for i in range(0, len(order), STEP):
            d, s = np.divmod(order[i : i + STEP], cuts)
            rows, values, at = self.rows[d, s].ravel(), self.values[d, s], q[d].astype(float)
            score += np.bincount(rows, (at[:, None] * values).ravel(), n + 1)
            q_left -= np.bincount(rows, np.repeat(at * at, SEGMENT), n + 1)
            x_left -= np.bincount(rows, (values * values).ravel(), n + 1)
            lead = np.argpartition(-score[:n], k)[:k]
            least = max(least, float((self.x[lead] @ q).min()))
            left = np.sqrt(np.maximum(q_left, 0) * np.maximum(x_left, 0))[:n] * (1 + 1e-9) + 1
            may = np.flatnonzero(score[:n] + left >= least)
            if len(may) <= max(4 * k, FEW * n):
                self.share_read = min(1.0, (i + STEP) / len(order))
                return may
        return may

    def top(self, q: np.ndarray, k: int, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows that `own` doesn't mark."""
        may = self.members(q, k + int(own.sum()))
        may = may[~own[may]]
        exact = self.most * int(np.abs(q.astype(float)).max(initial=0)) * len(q) < 2**62
        score = self.x[may] @ q if exact else np.array([max(-LIMIT, min(LIMIT, v)) for v in self.x[may].astype(object) @ q.astype(object)], np.int64)
        best = np.lexsort((ids[may], -score))[:k]
        return ids[may][best], score[best]


def quantise(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(row_no, id, vec, dims) of the vectors that take part, as a table of its own."""
    c = F.col(vector_col)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.where(c.isNotNull() & F.col(id_col).isNotNull()).where(finite).select(
        F.monotonically_increasing_id().alias("row_no"),
        F.col(id_col).cast("long").alias("id"),
        F.transform(c, lambda x: F.floor(x.cast("double") * scale)).alias("vec"),
        F.size(c).alias("dims"),
    )
    return materialize(rows, "vectors")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, block_rows: int = 8192, chunk: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score; rows as quantise gives them, queries some of them."""
    ship(rows.sparkSession)
    n, n_queries = rows.count(), queries.count()
    blocks, chunks = max(1, math.ceil(n / block_rows)), max(1, math.ceil(n_queries / chunk))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    dealt = rows.select("row_no", "id", "vec", "dims", F.pmod(F.xxhash64("row_no"), F.lit(blocks)).cast("int").alias("block"), each(chunks).alias("chunk"))
    asked = queries.select(
        "row_no", "id", "vec", "dims", F.pmod(F.xxhash64("row_no"), F.lit(chunks)).cast("int").alias("chunk"), each(blocks).alias("block")
    )

    def search(block: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        if len(block) and len(ask):
            block = block.sort_values(["id", "row_no"], kind="stable")
            ids, numbers = block["id"].to_numpy(), block["row_no"].to_numpy()
            index = ImpactIndex(np.stack(block["vec"].to_list()).astype(np.int64).reshape(len(block), -1))
            for number, own, vec in zip(ask["row_no"], ask["id"], ask["vec"], strict=True):
                found.append((number, own, *index.top(np.asarray(vec, np.int64), k, ids, numbers == number)))
        sizes = [len(f[2]) for f in found]
        return pd.DataFrame(
            {
                "query_no": np.repeat(np.array([f[0] for f in found], np.int64), sizes),
                "query_id": np.repeat(np.array([f[1] for f in found], np.int64), sizes),
                "vec_id": np.concatenate([f[2] for f in found] or [np.empty(0, np.int64)]),
                "score": np.concatenate([f[3] for f in found] or [np.empty(0, np.int64)]),
            }
        )

    by = ["dims", "block", "chunk"]
    parts = dealt.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(search, "query_no long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
