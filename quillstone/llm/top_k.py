"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments, and each has a mean and a deviation. For two segments of m components their squared
distance is at least ``m (difference of means)**2 + m (difference of deviations)**2``; summed over the segments this
bounds the distance of the vectors from below, and so their inner product from above. The bounds are computed from
few long segments to many short ones, and only candidates that no bound has ruled out are scored exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.common import save

#: Largest sum of magnitudes that doubles, and keys of score and place, hold exactly.
_EXACT = 1 << 42
_PLACES = 1 << 20


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Rows of means and deviations of equal segments, each times the root of the segment's length.

    The inner product of two such rows is the bound for the inner product of the vectors, which are filled up with
    zeros to whole segments.
    """
    n, dims = vectors.shape
    length = -(-dims // segments)
    padded = np.zeros((n, segments * length))
    padded[:, :dims] = vectors
    parts = padded.reshape(n, segments, length)
    return np.concatenate([parts.mean(2), parts.std(2)], 1) * np.sqrt(length)


@dataclass
class Searched:
    """What a search has done: pairs of query and candidate; bounds computed; inner products computed."""

    pairs: int = 0
    bounds: int = 0
    products: int = 0


def block_top_k(
    queries: np.ndarray,
    own: np.ndarray,
    vectors: np.ndarray,
    ids: np.ndarray,
    k: int,
    levels: tuple[int, ...],
    step: int = 2048,
    searched: Searched | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best `k` candidates of each query among `vectors`, the query's `own` id left out: query row, id row, score.

    Vectors are integers. Ties go to the smaller id. Each query begins with the candidates that the means of the finest
    level make likely; the worst of the best `k` is its bar from then on. The others are taken some at a time: each level
    sees only those that no coarser one has ruled out, and only what is left in the end is multiplied.
    """
    searched = searched if searched is not None else Searched()
    order = np.argsort(ids, kind="stable")  # places follow the ids
    q, x = queries.astype(float), vectors[order].astype(float)
    n, dims = x.shape
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * dims
    if bound >= _EXACT or n >= _PLACES:
        return _plain_top_k(queries, own, vectors, ids, k)
    place = np.argsort(-(x * x).sum(1), kind="stable")  # likely winners first, so that the bar rises early
    x, sorted_ids, last = x[place], ids[order][place], _PLACES - 1 - place
    cuts = [s for s in levels if 2 * s <= dims]
    stats = [(segment_statistics(q, s).astype(np.float32), segment_statistics(x, s).astype(np.float32)) for s in cuts]
    slack = 1e-5 * (bound + 1)  # above what single precision loses
    none = np.int64(-(1 << 62))
    rows, places, scores = [], [], []
    for r in range(len(q)):
        best = np.full(k, none)  # keys: score and place, the larger the better

        def multiply(some: np.ndarray, r: int = r) -> None:
            nonlocal best
            searched.products += len(some)
            keys = (np.rint(x[some] @ q[r]).astype(np.int64) << 20) + last[some]
            best = np.partition(np.concatenate([best, keys]), len(keys))[len(keys) :]

        fresh = sorted_ids != own[r]
        searched.pairs += int(fresh.sum())
        if stats:
            sq, sx = stats[-1]
            likely = np.where(fresh, sx[:, : cuts[-1]] @ sq[r, : cuts[-1]], -np.inf)
            searched.bounds += n
            seeds = np.argpartition(-likely, min(4 * k, n - 1))[: 4 * k] if n else place
            multiply(seeds[fresh[seeds]])
            fresh[seeds] = False
        for at in range(0, n, step):
            bar, alive = float(best.min() >> 20) - slack, slice(at, min(at + step, n))
            for sq, sx in stats:
                some = sx[alive]  # all of the step as long as no bound has ruled one out
                searched.bounds += len(some)
                over = some @ sq[r] >= bar
                if not over.all():
                    alive = (np.arange(at, alive.stop) if isinstance(alive, slice) else alive)[over]
            alive = np.arange(at, alive.stop) if isinstance(alive, slice) else alive
            alive = alive[fresh[alive]]
            if len(alive):
                multiply(alive)
        found = best[best > none]
        rows.append(np.full(len(found), r))
        places.append(order[_PLACES - 1 - (found & (_PLACES - 1))])
        scores.append(found >> 20)
    columns = (np.concatenate([np.empty(0, np.int64), *c]) for c in (rows, places, scores))
    return tuple(columns)


def _plain_top_k(queries, own, vectors, ids, k):
    """The same in Python integers, for components too large for exact doubles."""
    rows, places, scores = [], [], []
    people = [[int(v) for v in x] for x in vectors]
    for r, query in enumerate(queries):
        query = [int(v) for v in query]
        all_ = ((sum(a * b for a, b in zip(query, x)), j) for j, x in enumerate(people) if ids[j] != own[r])
        for score, j in sorted(all_, key=lambda s: (-s[0], ids[s[1]]))[:k]:
            rows.append(r)
            places.append(j)
            scores.append(score)
    return np.array(rows, np.int64), np.array(places, np.int64), np.array(scores, object)


def exact_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "id",
    vector_col: str = "vector",
    levels: tuple[int, ...] = (1, 4, 16, 32),
    query_block: int = 4096,
    candidate_block: int = 16384,
) -> DataFrame:
    """The `k` candidates with the largest inner product for each query: query_id, rank (from 1), id, score.

    Both inputs have a long id and an array of integers (long). A candidate with the query's id is left out; ties
    go to the smaller id; vectors meet only vectors with as many components. Null ids, vectors or components take no
    part, and rows that repeat an id and a vector count once. Queries and candidates are dealt out to blocks by a
    hash, and each pair of blocks is one task's group of bounded size; it sends `k` rows a query at most to the
    final ranking. Fewer candidates give fewer rows, an empty input none. Scores must fit a long: a vector whose
    components have a sum of squares of 2**62 or more is an error. Other columns are not looked at.
    """

    def clean(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<bigint>").alias("v"))
        whole = F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda c: c.isNull())
        squares = F.aggregate("v", F.lit(0.0), lambda total, c: total + c.cast("double") * c.cast("double"))
        large = F.raise_error(F.concat(F.lit("vector too large for scores that fit a long: id "), F.col("id").cast("string")))
        rows = rows.where(whole).withColumn("v", F.when(squares < float(1 << 62), F.col("v")).otherwise(large))
        return rows.dropDuplicates(["id", "v"])

    asked, given = save(clean(queries), "queries"), save(clean(vectors), "vectors")
    wide = max(1, -(-asked.count() // query_block))
    tall = max(1, -(-given.count() // candidate_block))

    def block(n: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = asked.select(F.lit(True).alias("asks"), block(wide, 1).alias("row"), numbers(tall).alias("col"), "id", "v")
    right = given.select(F.lit(False).alias("asks"), numbers(wide).alias("row"), block(tall, 2).alias("col"), "id", "v")
    cells = left.unionByName(right).withColumn("dims", F.size("v"))

    def search(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        ids = table["id"].to_numpy()
        data = table["v"].combine_chunks()
        data = data.combine_chunks() if isinstance(data, pa.ChunkedArray) else data
        matrix = data.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        q, x, q_ids, x_ids = matrix[asks], matrix[~asks], ids[asks], ids[~asks]
        row, place, score = block_top_k(q, q_ids, x, x_ids, k, levels)
        columns = (q_ids[row], x_ids[place], score)
        return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "id", "score"])

    found = cells.groupBy("row", "col", "dims").applyInArrow(search, "query_id long, id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def quantise(vector: Column, scale: float = 64.0) -> Column:
    """floor(scale * x) of each component as a long; null if the vector or a component is null or not finite.

    Values beyond a long become the largest or least one, which `exact_top_k` refuses.
    """
    wide = vector.cast("array<double>")
    bad = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(wide, lambda x: F.floor(F.lit(scale) * x)))
