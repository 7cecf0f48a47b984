"""Exact top-k by inner product: no-random-access aggregation over sorted lists.

Each component of the candidate vectors of a block is a list sorted by value. A query reads
every list from the end that its own component's sign favours, entry after entry, to a depth
that doubles from round to round, and a block's queries read the lists together; nothing but the
entries read is touched. They give each
candidate a lower bound of its score (unread components at their list's worst value) and an upper
bound (unread components at the value where its list stands); candidates that no list has shown
share the bounds of none read. A query stops when few candidates remain whose upper bound
reaches the k-th best score that is sure, here or in blocks that its task saw before; the
scores of those few are then resolved, and equal scores keep the smaller id. Full depth
resolves every score, so results are exact whatever the data. (On vectors without structure
lists must be read deep: the method then costs more than a plain product would.)

Blocks of candidates are dealt over the tasks by a salt that each block of queries visits
once; no row meets another outside such a pair of blocks, and a query's best k of each block
are ranked at the end. Queries are dealt over groups of about ``query_bytes``, and a merge join
holds one group at a time, so a task's memory does not grow with the number of queries; each
block of candidates is sent once for each group.

Contract: vectors that are null or hold null, NaN or infinite components, and rows without
an id, take no part; vectors meet only vectors of as many components. A query never meets
its own row, but may meet another row with the same id. Fewer than k candidates give fewer
rows; no queries or an empty table give none. Vectors of any length are read whole; other
columns are ignored. Scores are exact while their terms stay below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, materialize

BLOCK = "dim int, row binary, id binary, matrix binary, salt int"
FOUND = "query_row long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """Usable vectors as whole numbers ``floor(scale * x)``, with a row number of their own."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    values = F.col(vector_col).cast("array<double>")
    return materialize(
        vectors.select(F.col(id_col).cast("long").alias("vec_id"), values.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(F.exists("v", bad), F.lit(False)))
        .select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"), F.monotonically_increasing_id().alias("row"))
    )


def blocks(rows: DataFrame, size: int, salts: int) -> DataFrame:
    """Rows packed into blocks of at most ``size`` vectors of one dimension."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        made = 0

        def block(dim: int, taken: list) -> pa.RecordBatch:
            nonlocal made
            made += 1
            row, ids, m = (np.concatenate([t[i] for t in taken]) for i in range(3))
            salt = int(row[0] % 1_000_003 + made) % salts
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "row": [row.tobytes()], "id": [ids.tobytes()], "matrix": [m.tobytes()], "salt": pa.array([salt], pa.int32())})

        for batch in batches:
            ids, lists, row = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            lengths = np.diff(np.asarray(lists.offsets))
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                m = values[(starts[at][:, None] + np.arange(dim)).astype(np.int64)]
                for i in range(0, len(at), size):
                    part = at[i : i + size]
                    waiting.setdefault(int(dim), []).append((row[part].astype(np.int64), ids[part].astype(np.int64), m[i : i + size]))
                    if sum(len(t[0]) for t in waiting[int(dim)]) >= size:
                        yield block(int(dim), waiting.pop(int(dim)))
        for dim, taken in waiting.items():
            yield block(dim, taken)

    return in_arrow(rows.select("vec_id", "v", "row"), pack, BLOCK)


class Lists:
    """One block's sorted lists: for each component the candidates in ascending order of value."""

    def __init__(self, row: bytes, ids: bytes, matrix: bytes, dim: int):
        self.row, self.ids = np.frombuffer(row, dtype=np.int64), np.frombuffer(ids, dtype=np.int64)
        self.m = np.frombuffer(matrix, dtype=np.float64).reshape(len(self.row), dim)
        self.order = np.ascontiguousarray(np.argsort(self.m, axis=0, kind="stable").T.astype(np.int32))
        self.sorted = np.take_along_axis(self.m.T, self.order, axis=1)

    def read(self, top: bool, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(candidates, values) of each list's entries from depth ``start`` to ``end``, from its top or its bottom."""
        n = len(self.row)
        part = slice(n - end, n - start) if top else slice(start, end)
        return self.order[:, part], self.sorted[:, part]


#: A query whose remaining candidates are at most this share of the block has them resolved.
FEW = 1 / 16


def best_of(lists: Lists, own_rows: np.ndarray, q: np.ndarray, k: int, sure: np.ndarray, first_depth: int = 64) -> list[tuple[list[tuple[int, int]], int]]:
    """For each query (a row of ``q``): (candidate position, score) of its k best in the block, and the number of entries it read.

    All queries read the lists together, those with a positive component from the top, the others from
    the bottom, and each stops for itself. Candidates that cannot reach a query's ``sure``, a k-th best
    score found elsewhere, may be left out.
    """
    n, done = len(lists.row), {}
    weights, ends = (np.maximum(q, 0), np.minimum(q, 0)), (lists.sorted[:, :1], lists.sorted[:, -1:])
    known = [np.repeat(end, n, axis=1) for end in ends]  # by list and candidate: the value read, or the list's worst
    unread = [np.ones(known[0].shape), np.ones(known[0].shape)]
    base = (np.arange(len(lists.order)) * n)[:, None]
    still, depth, lower = np.arange(len(q)), 0, None

    def keep(i: int, score: np.ndarray, left: np.ndarray) -> None:
        order = np.lexsort((lists.ids[left], -score))[:k]
        done[i] = [(int(left[o]), int(score[o])) for o in order], int(np.count_nonzero(q[i])) * depth

    while len(still) and depth < n:
        start, depth = depth, min(n, max(first_depth, 2 * depth))
        upto = []
        for side, top in enumerate((True, False)):
            which, values = lists.read(top, start, depth)
            at = base + which
            np.put(known[side], at, values)
            np.put(unread[side], at, 0.0)
            stands = values[:, :1] if top else values[:, -1:]  # what an unread component has at best
            upto.append(known[side] + unread[side] * (stands - ends[side]))
        lower = sum(w[still] @ x for w, x in zip(weights, known, strict=True))
        if depth == n:
            break
        upper = sum(w[still] @ x for w, x in zip(weights, upto, strict=True))
        for j, i in enumerate(still.tolist()):
            own = lists.row == own_rows[i]
            lower[j, own] = upper[j, own] = -np.inf
            kth = max(sure[i], np.partition(lower[j], n - k)[n - k] if n > k else -np.inf)
            left = np.flatnonzero(upper[j] >= kth)
            if len(left) <= max(8 * k, n * FEW):
                left = left[lists.row[left] != own_rows[i]]
                keep(i, lists.m[left] @ q[i], left)  # the few that are left
        still = np.array([i for i in still.tolist() if i not in done], dtype=np.int64)
    for j, i in enumerate(still.tolist()):  # read to the end
        left = np.flatnonzero(lists.row != own_rows[i])
        keep(i, lower[j, left], left)
    return [done[i] for i in range(len(q))]


def best(lists: Lists, own_row: int, q: np.ndarray, k: int, sure: float = -np.inf, first_depth: int = 64) -> tuple[list[tuple[int, int]], int]:
    """``best_of`` for one query."""
    return best_of(lists, np.array([own_row]), q[None, :].astype(np.float64), k, np.array([sure]), first_depth)[0]


#: Queries whose k-th best score a task remembers from block to block; what is forgotten costs time only.
REMEMBERED = 100_000


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 4096, query_rows: int = 256, query_bytes: int = 64 << 20) -> DataFrame:
    """The ``k`` highest inner products of each query row: ``query_id, rank, vec_id, score``.

    ``is_query`` selects the queries by the column ``vec_id``; all rows are candidates.
    """
    spark = vectors.sparkSession
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = quantised(vectors, id_col, vector_col, scale)
    queries = rows.where(is_query)
    size = queries.agg(F.coalesce(F.sum(F.size("v") * 8 + 16), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, -(-size // query_bytes))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = blocks(rows, block_rows, salts).withColumn("group", upto(groups))
    asked = blocks(queries.coalesce(max(1, salts // 8)), query_rows, salts).select("dim", F.col("row").alias("q_row"), F.col("id").alias("q_id"), F.col("matrix").alias("q_matrix"))
    asked = asked.withColumn("group", F.pmod(F.xxhash64("q_row"), F.lit(groups)).cast("int")).withColumn("salt", upto(salts))
    pairs = candidates.join(asked.hint("merge"), ["dim", "salt", "group"])  # a task holds one group at a time

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lists = None, None
        known: dict[int, list[int]] = {}  # by query row: its best scores so far
        for batch in batches:
            for x in (row for at in range(batch.num_rows) for row in batch.slice(at, 1).to_pylist()):
                if x["row"] != last:
                    last, lists = x["row"], Lists(x["row"], x["id"], x["matrix"], x["dim"])
                q_row, q_id = np.frombuffer(x["q_row"], dtype=np.int64), np.frombuffer(x["q_id"], dtype=np.int64)
                q = np.frombuffer(x["q_matrix"], dtype=np.float64).reshape(len(q_row), x["dim"])
                found = []
                scores = [known.get(row, []) for row in q_row.tolist()]
                sure = np.array([x[-1] if len(x) == k else -np.inf for x in scores])
                for i, (hits, _) in enumerate(best_of(lists, q_row, q, k, sure)):
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[int(q_row[i])] = sorted([*scores[i], *(s for _, s in hits)], reverse=True)[:k]
                    found += [(int(q_row[i]), int(q_id[i]), int(lists.ids[c]), s) for c, s in hits]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["query_row", "query_id", "vec_id", "score"])

    found = in_arrow(pairs.select("dim", "row", "id", "matrix", "q_row", "q_id", "q_matrix"), search, FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
