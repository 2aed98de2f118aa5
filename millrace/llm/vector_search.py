"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments; of each the mean and the deviation (norm of what the mean leaves) are known.
Within a segment the product of two vectors is length * mean * mean plus a rest of at most deviation *
deviation, so the statistics bound the whole product from above (for the distance: from below). The
bounds are taken coarse to fine, 4, 8, then 16 segments; pairs whose bound cannot reach a query's k-th
best score so far fall out, and survivors are computed exactly, in whole numbers.

Queries go in blocks and candidates in slices, of bounded sizes. Each block meets each slice in one task,
which returns k rows per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import store

K = 5
EVERY = 50
SCALE = 256
LEVELS = (4, 8, 16)
QUERY_BLOCK = 2048
SLICE = 8192
#: Rows of a slice that are looked at together.
STEP = 1024


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """``row, vec_id, v``: every component as floor(256 * x), and a number of the row that is its own once the
    table is stored. Vectors that are null or hold a null or non-finite component are left out, and rows
    without an id."""
    x = F.col("embedding")
    good = F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < F.lit(float("inf")))
    )
    return embeddings.filter(F.col("vec_id").isNotNull() & x.isNotNull() & good).select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("long")).alias("v"),
    )


def statistics(m: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments of rows, both times the root of the segment's length or so
    that products of means and of deviations add up to the bound."""
    cuts = np.linspace(0, m.shape[1], min(segments, max(m.shape[1], 1)) + 1).astype(int)
    sums = np.add.reduceat(m, cuts[:-1], axis=1) if m.shape[1] else np.zeros((len(m), 1))
    squares = np.add.reduceat(m * m, cuts[:-1], axis=1) if m.shape[1] else np.zeros((len(m), 1))
    sizes = np.maximum(np.diff(cuts), 1)
    means = sums / np.sqrt(sizes)
    return means, np.sqrt(np.maximum(squares - means * means, 0))


def _exact(a: np.ndarray, b: np.ndarray, largest: float) -> np.ndarray:
    """Products of rows, pair by pair. In floating point while every sum is below 2**53."""
    if largest * largest * a.shape[1] < 2.0**53:
        return np.einsum("ij,ij->i", a.astype(float), b.astype(float)).astype(np.int64)
    if largest * largest * a.shape[1] < 2.0**62:
        return np.einsum("ij,ij->i", a, b)
    sums = [sum(int(x) * int(y) for x, y in zip(p, q)) for p, q in zip(a, b)]
    return np.array(sums, dtype=np.int64)  # raises if a score is no long


def best_of(
    query_rows: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int = K
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query, its own row left out: places of queries, candidate ids, scores.
    Ties go to the smaller id."""
    order = np.argsort(ids, kind="stable")
    rows, ids, vectors = rows[order], ids[order], vectors[order]
    largest = float(max(np.abs(queries).max(initial=0), np.abs(vectors).max(initial=0)))
    q_stats = [statistics(queries.astype(float), s) for s in LEVELS]
    floor = np.full(len(queries), -np.inf)
    kept_q, kept_v, kept_s = (np.zeros(0, np.int64) for _ in range(3))
    for start in range(0, len(ids), STEP):
        part = vectors[start : start + STEP]
        alive = None
        for (qm, qd), s in zip(q_stats, LEVELS):
            m, d = statistics(part.astype(float), s)
            if alive is None:
                bound = qm @ m.T + qd @ d.T
                # A hair above the bound, for rounding.
                qi, vi = np.nonzero(bound * (1 + 1e-9 * np.sign(bound)) + 1e-6 > floor[:, None])
            else:
                qi, vi = alive
                if not len(qi):
                    break
                bound = np.einsum("ij,ij->i", qm[qi], m[vi]) + np.einsum("ij,ij->i", qd[qi], d[vi])
                live = bound * (1 + 1e-9 * np.sign(bound)) + 1e-6 > floor[qi]
                qi, vi = qi[live], vi[live]
            alive = qi, vi
            if len(qi) > 0.25 * bound.size and s == LEVELS[0]:
                break  # too few fell out: finer bounds would cost more than the products
        qi, vi = alive
        others = query_rows[qi] != rows[start + vi]
        qi, vi = qi[others], vi[others]
        if len(qi) > 0.25 * len(queries) * len(part) and largest * largest * vectors.shape[1] < 2.0**53:
            scores = (queries.astype(float) @ part.T.astype(float))[qi, vi].astype(np.int64)
        else:
            scores = np.concatenate(
                [np.zeros(0, np.int64)]
                + [
                    _exact(queries[qi[a : a + 65536]], part[vi[a : a + 65536]], largest)
                    for a in range(0, len(qi), 65536)
                ]
            )
        better = scores > floor[qi]  # later ids lose ties
        kept_q = np.concatenate([kept_q, qi[better]])
        kept_v = np.concatenate([kept_v, start + vi[better]])
        kept_s = np.concatenate([kept_s, scores[better]])
        order = np.lexsort((kept_v, -kept_s, kept_q))
        kept_q, kept_v, kept_s = kept_q[order], kept_v[order], kept_s[order]
        first = np.searchsorted(kept_q, np.arange(len(queries)))
        rank = np.arange(len(kept_q)) - first[kept_q]
        last = rank == k - 1
        floor[kept_q[last]] = kept_s[last]
        kept_q, kept_v, kept_s = kept_q[rank < k], kept_v[rank < k], kept_s[rank < k]
    return kept_q, ids[kept_v], kept_s


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` for stored whole vectors ``(row, vec_id, v)``.

    Vectors of different lengths do not match: a query is compared with those of its own length. Each row of
    ``queries`` asks, and each of ``candidates`` counts, also where ids repeat.
    """
    n_queries, n = queries.count(), candidates.count()
    blocks = max(1, -(-n_queries // QUERY_BLOCK))
    parts = max(1, -(-n // SLICE))
    asked = queries.select(
        F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("slice"),
        "row",
        "vec_id",
        "v",
    )
    given = candidates.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        # Not by the id's hash: copies of one id spread as well.
        F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("slice"),
        "row",
        "vec_id",
        "v",
    )

    def searched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            widths = left["v"].map(len), right["v"].map(len)
            for width in sorted({*widths[0]} & {*widths[1]}):
                q, c = left[widths[0] == width], right[widths[1] == width]
                places, ids, scores = best_of(
                    q["row"].to_numpy(np.int64),
                    np.array(q["v"].tolist(), np.int64).reshape(len(q), width),
                    c["row"].to_numpy(np.int64),
                    c["vec_id"].to_numpy(np.int64),
                    np.array(c["v"].tolist(), np.int64).reshape(len(c), width),
                    k,
                )
                asking = {n: q[n].to_numpy(np.int64)[places] for n in ("row", "vec_id")}
                out.append(
                    pd.DataFrame({"row": asking["row"], "query_id": asking["vec_id"], "vec_id": ids, "score": scores})
                )
        empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("row", "query_id", "vec_id", "score")})
        return pd.concat(out) if out else empty

    met = (
        asked.groupBy("block", "slice")
        .cogroup(given.groupBy("block", "slice"))
        .applyInPandas(searched, "row long, query_id long, vec_id long, score long")
    )
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return (
        met.withColumn("rank", rank.cast("int"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def searched(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The k best of every row whose id is divisible by ``every``, against all other rows. Where an id repeats
    each of its rows asks, and the others of that id are candidates. Queries with no other usable vector, and
    empty tables, give no rows; other columns are not read. A vector's length is bounded by memory only: a
    task holds a block of queries and a slice of candidates."""
    vectors = store(whole_vectors(embeddings), "vectors")
    return top_k(vectors.filter(F.col("vec_id") % every == 0), vectors, k)


ORACLE = """
WITH w AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id,
  list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM w q JOIN w c ON q.vec_id % 50 = 0 AND q.rid <> c.rid)
SELECT query_id, (row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
