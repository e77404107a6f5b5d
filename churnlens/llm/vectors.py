"""Vector tables: usable rows, shards, and searches of all shards by blocks.

Rows are dealt to shards of about ``SHARD_ROWS`` by a hash of their id, so
copies of one vector spread evenly.  A search meets every shard with every
block of about ``QUERY_ROWS`` queries: a task holds one shard's index and
one block, both bounded, however large the table is.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlens.llm.common import stage

SHARD_ROWS = 8192
QUERY_ROWS = 8192


def finite(vector: str) -> Column:
    """Not null, not empty, and every component a finite number."""
    v = F.col(vector).cast("array<double>")
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def matrix(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, vectors) by dimension; vectors of different dimension
    are never compared."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    sizes = np.asarray(lists.value_lengths())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    out = []
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        out.append((rows, flat[starts[rows][:, None] + np.arange(d)] + 0.0))  # -0.0 becomes 0.0
    return out


class Distinct:
    """A shard's distinct vectors, each with the ids of its best rows.

    A query leaves out all rows of its own id.  Of equal vectors the k
    smallest other rows can be among its k nearest: these are among at most
    k rows of each of the k + 1 smallest ids, so a vector that many rows
    share costs one computation and a bounded number of places, and rows of
    one id never use up the room of others.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], np.ascontiguousarray(x[order])
        raw = x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
        _, first, where = np.unique(raw, return_index=True, return_inverse=True)
        self.x = x[first]
        by = np.argsort(where, kind="stable")
        owner, ids, at = where[by], ids[by], np.arange(len(by))
        begins = np.searchsorted(owner, np.arange(len(first)))
        fresh = np.ones(len(by), bool)  # the first row of an id of a vector
        fresh[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
        copy = at - np.maximum.accumulate(np.where(fresh, at, 0))
        seen = np.cumsum(fresh)
        other = seen - seen[begins][owner]
        # whether all rows of a vector have one id, and that (the least) id
        self.single = np.bincount(owner, weights=fresh, minlength=len(first)) == 1
        self.least = ids[begins]
        keep = (copy < k) & (other <= k)
        self.owner, self.ids = owner[keep], ids[keep]
        self.start = np.searchsorted(self.owner, np.arange(len(first) + 1))

    def own(self, vectors, query_ids: np.ndarray) -> np.ndarray:
        """(queries, vectors): whether only rows of the query's id hold it."""
        return self.single[vectors] & (self.least[vectors] == query_ids[:, None])

    def expand(self, vectors: np.ndarray, scores: np.ndarray):
        """(ids, scores) of the rows that hold the given vectors."""
        n = self.start[vectors + 1] - self.start[vectors]
        at = np.repeat(self.start[vectors] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.ids[at], np.repeat(scores, n)


def best_rows(ids: np.ndarray, scores: np.ndarray, own: int, k: int):
    """The k best rows but ``own``: highest score, ties to the smaller id."""
    other = ids != own
    ids, scores = ids[other], scores[other]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def long_scores(scores: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Integer scores as longs (null beyond a long) and keys (binary) that
    order those beyond a long; all others share one key between them."""
    if scores.dtype != object:
        return pa.array(scores, pa.int64()), pa.array([b"\x80"] * len(scores), pa.binary())
    fit, keys = [], []
    for n in map(int, scores):
        inside = -(1 << 63) <= n < 1 << 63
        size = (abs(n).bit_length() + 7) // 8
        if inside:
            key = b"\x80"
        elif n > 0:
            key = b"\x81" + size.to_bytes(2, "big") + n.to_bytes(size, "big")
        else:
            key = b"\x7f" + (0xFFFF - size).to_bytes(2, "big") + bytes(255 - b for b in (-n).to_bytes(size, "big"))
        fit.append(n if inside else None)
        keys.append(key)
    return pa.array(fit, pa.int64()), pa.array(keys, pa.binary())


def search_shards(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int,
                  build: Callable, search: Callable, score_type: str,
                  shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Index ``rows`` by shards and find every query's ``k`` best rows.

    ``build(ids, x)`` makes one shard's index of one dimension and
    ``search(index, query_ids, q)`` yields (query number, ids, scores);
    scores of type long may be Python integers of any size, and the score is
    null where it is beyond a long (its rank is still right).
    Rows with a null id take no part; of repeated query ids the least vector
    asks, and no row with the query's id is a candidate.
    """
    base = stage(rows.filter(F.col(id_col).isNotNull())
                 .select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("x")))
    asking = stage(queries.filter(F.col(id_col).isNotNull())
                   .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vector).alias("x")))
    shards = max(1, -(-base.count() // shard_rows))
    blocks = max(1, -(-asking.count() // query_rows))

    def make(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        parts = {x.shape[1]: build(ids[at], x) for at, x in matrix(group.column("x"))}
        return pa.table({"shard": group.column("shard").slice(0, 1),
                         "index": pa.array([pickle.dumps(parts, 5)], pa.binary())})

    # copies of one row (same id) are dealt by their vector as well
    dealt = base.withColumn("shard", F.pmod(F.xxhash64("id", "x"), F.lit(shards)).cast("int"))
    index = stage(dealt.groupBy("shard").applyInArrow(make, "shard int, index binary"))

    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_id, out_s = [], [], []
        if left.num_rows and right.num_rows:
            parts = pickle.loads(left.column("index")[0].as_py())
            ids = right.column("id").to_numpy()
            for at, q in matrix(right.column("x")):
                if q.shape[1] in parts:
                    for i, found, scores in search(parts[q.shape[1]], ids[at], q):
                        out_q.append(np.full(len(found), ids[at[i]]))
                        out_id.append(found)
                        out_s.append(scores)
        cat = lambda v, t: pa.array(np.concatenate(v) if v else [], t)
        out = {"query_id": cat(out_q, pa.int64()), "vec_id": cat(out_id, pa.int64())}
        if score_type == "double":
            return pa.table(out | {"score": cat(out_s, pa.float64())})
        score, beyond = long_scores(np.concatenate(out_s) if out_s else np.zeros(0, np.int64))
        return pa.table(out | {"score": score, "beyond": beyond})

    # every shard meets every block of queries; both sides of a task are bounded
    tiles = index.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "shard", "index")
    asked = asking.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
                          F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "id", "x")
    found = (tiles.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block"))
             .applyInArrow(ask, f"query_id long, vec_id long, score {score_type}"
                           + ("" if score_type == "double" else ", beyond binary")))
    best = [F.desc("score")] if score_type == "double" else [F.desc("beyond"), F.desc("score")]
    nearest = Window.partitionBy("query_id").orderBy(*best, "vec_id")
    return (found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
