"""Exact top-k by integer inner product: the threshold algorithm over sorted lists.

Every block of candidates keeps, for each dimension, its vectors sorted by that component. A
query walks all lists downwards together (from the other end where its own component is
negative). Vectors met so far are scored in full; those not met cannot score more than the
sum of the query's components times the list values reached. The walk ends when this bound is
below the kth best score: an equal score could still win by its smaller id.

Queries meet candidates block by block; each block returns at most k rows a query, and the
best k of those remain. The work is queries times candidates at worst, as the task demands;
memory is one block and one group of queries.

Defined results: vectors that are null, or hold a null or a non-finite component, take no
part; vectors of different lengths do not meet; rows that repeat a vec_id are candidates each
(never of their own id); ties go to the smaller vec_id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192  # candidates of a block
GROUP = 512  # queries of a group
DEPTHS = (64, 16, 4, 2, 1)  # the walk looks at the bound when 1/64, 1/16, ... of the lists is read
RESULT = "query_id bigint, vec_id bigint, score bigint"


def scaled_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """vec_id and `v`, floor(scale * x) of each component; vectors that take no part are left out."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("wide", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col("vec_id").cast("bigint"), wide.alias("wide"))
        .where(F.col("vec_id").isNotNull() & F.col("wide").isNotNull() & finite)
        .select("vec_id", F.transform("wide", lambda x: F.floor(x * scale)).alias("v"))
    )


class SortedLists:
    """One block: candidates, and per dimension and depth the set of those met, as bits.

    `longest` is the largest component of the queries, which need not be candidates of this block. Numbers are of a
    kind that holds all products and sums exactly.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: int):
        n, dims = vectors.shape
        self.ids = ids
        largest = max(1.0, float(np.abs(vectors).max(initial=0))) * max(1.0, float(longest)) * max(dims, 1)
        self.kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else object
        self.vectors = vectors.astype(self.kind)
        order = np.argsort(-vectors, axis=0, kind="stable")
        self.levels = sorted({max(1, -(-n // d)) for d in DEPTHS})
        self.met, self.reached = [], []
        for depth in self.levels:
            bits = np.zeros((2, dims, -(-n // 8)), np.uint8)
            for d in range(dims):
                for side, rows in enumerate((order[:depth, d], order[n - depth :, d])):
                    mark = np.zeros(n, bool)
                    mark[rows] = True
                    bits[side, d] = np.packbits(mark)
            self.met.append(bits)
            ends = np.stack([vectors[order[depth - 1], np.arange(dims)], vectors[order[n - depth], np.arange(dims)]])
            self.reached.append(ends.astype(self.kind))

    def search(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the best k, all ties at the kth score decided by id."""
        query = query.astype(self.kind)
        used = np.flatnonzero(query)
        side = (query[used] < 0).astype(np.intp)
        before = np.zeros(self.met[0].shape[2], np.uint8)
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, self.kind)
        for depth, met, reached in zip(self.levels, self.met, self.reached, strict=True):
            everything = depth == len(self.ids)
            now = np.full_like(before, 255) if everything else np.bitwise_or.reduce(met[side, used], axis=0, initial=0)
            new = np.flatnonzero(np.unpackbits(now & ~before, count=len(self.ids)))
            new = new[self.ids[new] != query_id]
            scores = self.vectors[new] @ query
            if len(best) >= k:  # a newcomer must reach the kth score
                good = scores >= best[-1]
                new, scores = new[good], scores[good]
            best_ids, best = np.concatenate([best_ids, self.ids[new]]), np.concatenate([best, scores])
            top = np.lexsort((best_ids, -best))[:k]
            best_ids, best = best_ids[top], best[top]
            before = before | now
            bound = (query[used] * reached[side, used]).sum()
            if everything or len(best) == k and bound < best[-1]:
                break
        return best_ids, best


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of every row where `is_query` holds."""
    spark = vectors.sparkSession
    scaled = scaled_vectors(vectors, scale).withColumn("dims", F.size("v"))
    n = max(1, scaled.count())
    blocks = -(-n // BLOCK)
    groups = max(1, -(-scaled.where(is_query).count() // GROUP))
    candidates = scaled.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    queries = scaled.where(is_query).withColumn("group", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))
    both = candidates.select("vec_id", "v", "dims", "block", "group", F.lit(False).alias("asks")).unionByName(
        queries.select("vec_id", "v", "dims", "block", "group", F.lit(True).alias("asks"))
    )

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        ask = rows[rows["asks"]]
        rest = rows[~rows["asks"]]
        if len(ask) and len(rest):
            longest = np.abs(np.stack(ask["v"].to_numpy())).max(initial=0)
            lists = SortedLists(rest["vec_id"].to_numpy(np.int64), np.stack(rest["v"].to_numpy()).reshape(len(rest), -1), longest)
            for query_id, query in zip(ask["vec_id"], ask["v"], strict=True):
                ids, scores = lists.search(query_id, np.asarray(query), k)
                found.append(pd.DataFrame({"query_id": query_id, "vec_id": ids, "score": scores.astype(np.int64)}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)

    parts = max(blocks * groups, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    local = both.repartition(parts, "block", "group", "dims").groupBy("block", "group", "dims").applyInPandas(walk, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
