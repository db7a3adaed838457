"""Exact top-k inner products by MaxScore.

Terms are vector components, floor(64 x). For each query the terms are ordered by the largest contribution
they can make within a shard. The last ones, whose bounds together stay below the score of the k-th
best so far, are non-essential: no document is competitive by them alone. A block's essential
postings are traversed first; the others are probed, a few terms at a time, only for documents
whose score so far plus the bounds still to come reaches the threshold. Shards meet query blocks in a grid of
bounded groups, and their lists are merged by a window per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.vectors import keyed

SHARD, QUERIES = 32_768, 4096  # vectors of a shard, queries of a block, on average
LEAST, MOST, DIGITS = -(2**63), 2**63 - 1, 700  # of 64 bits; digits of a larger score, of any doubles
BLOCK, PROBED = 8192, 8  # documents traversed together; terms probed together


def terms(vectors, width: int) -> np.ndarray:
    """floor(64 x), one row per term; a shorter vector has no postings for the terms it lacks."""
    out = np.zeros((width, len(vectors)))
    for i, v in enumerate(vectors):
        out[: len(v), i] = v
    return np.floor(64.0 * out)


def exact_type(q: np.ndarray, x: np.ndarray):
    """The narrowest type in which every partial sum is exact."""
    most = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * len(x)
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def maxscore(q: np.ndarray, own: int | None, x: np.ndarray, ids: np.ndarray, nodes: np.ndarray, k: int, high, low) -> list[tuple]:
    """The k best (score, id) of a shard for one query; x has one row per term, ids ascend."""
    bound = np.maximum(q * high, q * low)
    order = np.argsort(-bound.astype(np.float64), kind="stable")
    rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])
    best_score, best_at, threshold = np.zeros(0, x.dtype), np.zeros(0, np.int64), None
    for a in range(0, x.shape[1], BLOCK):
        b = min(a + BLOCK, x.shape[1])
        if threshold is None:
            first = len(order)
        else:
            short = np.flatnonzero(rest < threshold)
            first = max(1, int(short[0])) if len(short) else len(order)
        essential = order[:first]
        score, at = q[essential] @ x[essential, a:b], np.arange(a, b)
        while True:
            if threshold is not None:
                alive = score + rest[first] >= threshold
                score, at = score[alive], at[alive]
            if first == len(order) or not len(at):
                break
            probed = order[first : first + PROBED]
            score = score + q[probed] @ x[probed[:, None], at]
            first += len(probed)
        if own is not None:
            other = nodes[at] != own
            score, at = score[other], at[other]
        score, at = np.concatenate([best_score, score]), np.concatenate([best_at, at])
        if len(at) > k:
            edge = np.partition(score, len(score) - k)[len(score) - k] if score.dtype != object else sorted(score)[-k]
            keep = np.flatnonzero(score >= edge)
            keep = keep[np.lexsort((at[keep], -score[keep].astype(np.float64)))] if score.dtype != object else np.array(sorted(keep, key=lambda i: (-score[i], at[i])))
            score, at = score[keep[:k]], at[keep[:k]]
        best_score, best_at = score, at
        if len(at) == k:
            threshold = min(score)
    return [(int(s), int(ids[i])) for s, i in zip(best_score, best_at)]


def search(queries: pd.DataFrame, shard: pd.DataFrame, k: int) -> pd.DataFrame:
    rows = []
    if len(queries) and len(shard):
        shard = shard.sort_values(["id", "node"], na_position="last")
        width = max(max(map(len, queries["vec"])), max(map(len, shard["vec"])))
        q, x = terms(queries["vec"], width), terms(shard["vec"], width)
        kind = exact_type(q, x)
        if kind is object:
            q, x = (np.array([[int(v) for v in row] for row in m], dtype=object) for m in (q, x))
        else:
            q, x = q.astype(kind), x.astype(kind)
        high, low = x.max(axis=1), x.min(axis=1)
        ids, nodes = shard["id"].to_numpy(), shard["node"].to_numpy()
        for i, (node, query) in enumerate(zip(queries["node"], queries["id"])):
            for score, found in maxscore(q[:, i], node, x, ids, nodes, k, high, low):
                held = max(LEAST, min(MOST, score))
                rows.append((node, query, found, held, None if held == score else f"{abs(score):0{DIGITS}d}"))
    out = pd.DataFrame(rows, columns=["node", "query_id", "vec_id", "score", "beyond"])
    return out.astype(dict.fromkeys(["node", "query_id", "vec_id", "score"], "int64"))


def top_k(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query row, ties to the smaller id.

    Vectors that are null, empty or hold null or non-finite components, and rows of a null id, take no
    part. A query never finds its own row; repeated rows are rows of their own. Scores beyond 64 bits are
    ranked by their true values and given as the nearest 64-bit number. Fewer rows than k give fewer results; an empty table gives an empty one.
    """
    own = keyed(rows, id_col, vec_col).where("vec is not null and id is not null")
    queries = own.where(is_query)
    n, m = own.count(), queries.count()
    shards = max(1, -(-n // SHARD), min(own.sparkSession.sparkContext.defaultParallelism, -(-n // 4096)))
    blocks = max(1, -(-m // QUERIES))

    def at(parts: int, seed: int) -> Column:
        return F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(parts)).cast("int")

    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    asked = queries.select("node", "id", "vec", at(blocks, 1).alias("block"), every(shards).alias("shard"))
    held = own.select(*[F.col(c).alias(c) for c in ("node", "id", "vec")], at(shards, 2).alias("shard"), every(blocks).alias("block"))
    found = asked.groupBy("block", "shard").cogroup(held.groupBy("block", "shard")).applyInPandas(
        lambda q, s: search(q, s, k), "node long, query_id long, vec_id long, score long, beyond string"
    )
    above, below = (F.when(F.col("score") == edge, F.col("beyond")) for edge in (MOST, LEAST))
    order = Window.partitionBy("node").orderBy(F.desc("score"), above.desc_nulls_last(), below.asc_nulls_first(), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
