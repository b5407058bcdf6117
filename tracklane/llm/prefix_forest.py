"""Approximate nearest neighbours by cosine with a hash-prefix forest.

Vectors lie in blocks. For each of `trees` trees a block keeps its vectors'
`bits`-bit strings (signs of random projections) as one sorted array, so that
all vectors sharing a prefix with a query are a range of it. A query descends in
every tree to its longest matching prefix; then all trees ascend together, one
bit less at a time, and the ranges' new members are compared exactly. It stops
at a prefix length x as soon as a vector nearer than the k-th found would have
been missed by all trees with a chance of at most `miss`: (1 - p**x)**trees,
where p is the chance of an equal bit at the k-th found cosine. Near neighbours
thus end the search high up; where the nearest are far, it goes on further down.

Queries are a stated set and meet all blocks, in blocks of at most
`query_block`; the best k of each block are merged by a window.

Edge cases: vectors that are null, zero, or hold null or non-finite numbers take
no part; vectors are compared with those of their own length only; each is scaled
by a power of two, so very large and very small numbers neither overflow nor
vanish; ties go to the smaller id; with fewer candidates than k all are returned;
rows of one id with different vectors are different rows, each a query and a
candidate of its own, while rows alike in both are one; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

FOUND = "query_id bigint, query_row bigint, vec_id bigint, score double"


def valid(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v: array of doubles, d: its length, row: a hash of both) of the rows that take part, once each."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(fine)
    return rows.select("vec_id", "v", F.size("v").alias("d"), F.xxhash64("vec_id", "v").alias("row"))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, rows, vectors) in the order of both, rows alike once; vectors scaled to a largest number from 1/2 to 1."""
    ids, rows = table["vec_id"].to_numpy(), table["row"].to_numpy()
    order = np.lexsort((rows, ids))
    order = order[np.flatnonzero(np.r_[True, (np.diff(ids[order]) != 0) | (np.diff(rows[order]) != 0)])]
    m = np.asarray(table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(table), -1)[order]
    return ids[order], rows[order], np.ldexp(m, -np.frexp(np.abs(m).max(1))[1][:, None])


def _codes(m: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Bit strings as numbers: a row for each tree."""
    trees, bits, _ = planes.shape
    signs = np.einsum("nd,tbd->tnb", m, planes, optimize=True) > 0
    return signs.astype(np.uint64) @ (np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64))


def search_block(ids, own, m, qids, qown, q, k: int, planes: np.ndarray, miss: float):
    """(query, its row, candidate, cosine): the best k found among the block's vectors for each query."""
    trees, bits, _ = planes.shape
    codes = _codes(m, planes)
    order = np.argsort(codes, axis=1, kind="stable")
    arrays = np.take_along_axis(codes, order, 1)
    wanted = _codes(q, planes)
    norm, qnorm = np.sqrt(np.einsum("ij,ij->i", m, m)), np.sqrt(np.einsum("ij,ij->i", q, q))
    lo, hi = np.zeros((bits + 1, trees, len(q)), np.int64), np.zeros((bits + 1, trees, len(q)), np.int64)
    for x in range(bits + 1):
        rest = np.uint64((1 << (bits - x)) - 1)
        for t in range(trees):
            lo[x, t] = np.searchsorted(arrays[t], wanted[t] & ~rest, "left")
            hi[x, t] = np.searchsorted(arrays[t], wanted[t] | rest, "right")
    some = (hi > lo).any(1)
    out = ([], [], [], [])
    for i in range(len(q)):
        seen = np.zeros(len(ids), bool)
        done = (ids == qids[i]) & (own == qown[i])
        best_id, best = np.zeros(0, np.int64), np.zeros(0)
        for x in range(int(np.flatnonzero(some[:, i]).max(initial=0)), -1, -1):
            for t in range(trees):
                seen[order[t, lo[x, t, i] : hi[x, t, i]]] = True
            new = np.flatnonzero(seen & ~done)
            if len(new):
                done[new] = True
                score = (m[new] @ q[i]) / (norm[new] * qnorm[i])
                if len(best) + len(new) > k:
                    least = np.partition(np.r_[best, score], -k)[-k] - 1e-9
                    new = new[score >= least]
                score = np.einsum("ij,j->i", m[new], q[i]) / (norm[new] * qnorm[i])
                best_id, best = np.r_[best_id, ids[new]], np.r_[best, score]
                top = np.lexsort((best_id, -best))[:k]
                best_id, best = best_id[top], best[top]
            if len(best) == k:
                p = 1 - math.acos(max(-1.0, min(1.0, best[-1]))) / math.pi
                if (1 - p**x) ** trees <= miss:
                    break
        out[0].append(np.full(len(best), qids[i]))
        out[1].append(np.full(len(best), qown[i]))
        out[2].append(best_id)
        out[3].append(best)
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in out)


def nearest(vectors: DataFrame, query: Column, k: int = 5, trees: int = 24, bits: int = 24, miss: float = 0.03, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = 20_000, query_block: int = 50_000, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for the rows that `query` selects (a condition on vec_id)."""
    rows = valid(vectors, id_col, vec_col)
    size = rows.agg(F.count("*").alias("n"), F.count_if(query).alias("q")).first()
    spark = vectors.sparkSession
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["n"] // block_rows))
    query_blocks = max(1, -(-size["q"] // query_block))
    deal = lambda c, of: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(of)).cast("int")
    spread = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    data = rows.select("vec_id", "row", "v", "d", deal("row", blocks).alias("b"), spread(query_blocks).alias("qb"))
    asked = rows.filter(query).select("vec_id", "row", "v", "d", spread(blocks).alias("b"), deal("row", query_blocks).alias("qb"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "query_row": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        (ids, own, m), (qids, qown, q) = _matrix(left), _matrix(right)
        planes = np.random.default_rng(seed).standard_normal((trees, bits, m.shape[1]))
        found = [search_block(ids, own, m, qids[i : i + 512], qown[i : i + 512], q[i : i + 512], k, planes, miss) for i in range(0, len(q), 512)]
        a, o, b, c = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query_id": pa.array(a.astype(np.int64)), "query_row": pa.array(o.astype(np.int64)), "vec_id": pa.array(b.astype(np.int64)), "score": pa.array(c.astype(np.float64))})

    found = data.groupBy("d", "b", "qb").cogroup(asked.groupBy("d", "b", "qb")).applyInArrow(search, FOUND)
    rank = F.row_number().over(W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
