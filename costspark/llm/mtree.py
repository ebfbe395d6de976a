"""Exact top-k by inner product over integer vectors: best-first search in M-trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costspark.runtime import materialise, scratch_path

LARGEST = 2**27  # of a component, so that a sum of 64 and more products stays exact in 64 bits
PAGE = (
    "shard int, page int, leaf boolean, width int, ids array<bigint>, vectors binary, "
    "children array<int>, radii array<double>, parents array<double>"
)
RESULT = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) of every component; one row an id.

    Left out: null ids, null vectors, vectors with a null, non-finite or (after
    scaling) over-large component.  Of rows that repeat an id the smallest vector stands for it.
    """
    whole = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    bad = F.exists(
        F.col(vector_col),
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) * scale >= float(LARGEST)),
    )
    kept = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & ~bad)
    return kept.select(F.col(id_col).cast("long").alias("id"), whole.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _raised(x: np.ndarray, top: int) -> np.ndarray:
    """One more coordinate, so that all have the length sqrt(top) and the nearest has the largest product."""
    rest = top - (x * x).sum(axis=1)
    return np.hstack([x.astype(np.float64), np.sqrt(np.maximum(rest, 0).astype(np.float64))[:, None]])


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def build(ids: np.ndarray, whole: np.ndarray, top: int, leaf: int = 256, fan: int = 32, seed: int = 1) -> list[tuple]:
    """Pages of an M-tree, bottom up: (page, leaf, ids, vectors, children, radii, parents).

    A page holds the points nearest to its pivot, cut at ``leaf`` points (``fan`` pages for
    inner ones).  An entry of an inner page has its pivot, its covering radius and its distance
    to the page's own pivot; the root is the last page, with its first entry as pivot.
    """
    rng = np.random.default_rng(seed)
    pages: list[list] = []

    def grouped(x: np.ndarray, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
        pivots = x[rng.choice(len(x), max(1, -(-len(x) // max(1, most // 2))), replace=False)]
        near = _far(x, pivots).argmin(axis=1)
        out = []
        for k in range(len(pivots)):
            own = np.flatnonzero(near == k)
            out += [(pivots[k], own[i : i + most]) for i in range(0, len(own), most)]
        return out

    level = []  # pivot, radius, page
    points = _raised(whole, top)
    for pivot, own in grouped(points, leaf):
        own = own[np.argsort(ids[own])]
        away = _far(points[own], pivot[None, :])[:, 0]
        pages.append([len(pages), True, ids[own], whole[own], [], [], away])
        level.append((pivot, away.max(initial=0.0), len(pages) - 1))
    while True:
        pivots = np.array([p for p, _, _ in level])
        parts = [(pivots[0], np.arange(len(level)))] if len(level) <= fan else grouped(pivots, fan)
        above = []
        for pivot, own in parts:
            away = _far(pivots[own], pivot[None, :])[:, 0]
            radii = np.array([level[i][1] for i in own])
            pages.append([len(pages), False, np.empty(0, np.int64), pivots[own], [level[i][2] for i in own], radii, away])
            above.append((pivot, (away + radii).max(), len(pages) - 1))
        if len(parts) == 1:
            return [tuple(p) for p in pages]
        level = above


def search(pages: dict[int, tuple], root: int, query_ids: np.ndarray, queries: np.ndarray, top: int, k: int) -> list[list[tuple[int, int]]]:
    """For each query its ``k`` largest products as (score, -id), ids other than its own.

    Every query takes its most promising page next; queries that want the same page are
    served together.  Before a distance is computed, the stored distance to the parent must
    leave it possible: |d(query, parent) - d(parent, entry)| - radius <= the k-th distance.
    """
    n = len(queries)
    # A query keeps its own length and has no part in the raised coordinate.
    flat = np.hstack([queries.astype(np.float64), np.zeros((n, 1))])
    length = (queries * queries).sum(axis=1).astype(np.float64)
    best: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    limit = np.full(n, np.inf)
    lowest = np.full(n, np.iinfo(np.int64).min)
    start = _far(flat, pages[root][3][:1])[:, 0]
    todo = [[(0.0, root, d)] for d in start.tolist()]
    exact = float(np.abs(queries).max(initial=0)) * float(np.sqrt(top)) * queries.shape[1] < 2.0**52
    slack = 1e-6 * (1 + np.sqrt(float(top)))
    active = range(n)
    while active:
        wanted: dict[int, list[tuple[int, float]]] = {}
        rest = []
        for q in active:
            if todo[q] and todo[q][0][0] <= limit[q] + slack:
                _, page, parent = heapq.heappop(todo[q])
                wanted.setdefault(page, []).append((q, parent))
                rest.append(q)
        active = rest
        for page, asked in wanted.items():
            _, leaf, ids, vectors, children, radii, parents = pages[page]
            rows = np.array([q for q, _ in asked])
            parent = np.array([d for _, d in asked])
            bound = limit[rows][:, None] + slack
            away = np.abs(parent[:, None] - parents[None, :])
            if leaf:
                possible = away <= bound
                columns = np.flatnonzero(possible.any(axis=0))
                points = vectors[columns]
                if exact:
                    scores = np.rint(queries[rows].astype(np.float64) @ points.T.astype(np.float64)).astype(np.int64)
                else:
                    scores = queries[rows] @ points.T
                good = possible[:, columns] & (scores >= lowest[rows][:, None]) & (query_ids[rows][:, None] != ids[columns][None, :])
                for i in np.flatnonzero(good.any(axis=1)).tolist():
                    q, own = rows[i], best[rows[i]]
                    for c in np.flatnonzero(good[i]).tolist():
                        item = (int(scores[i, c]), -int(ids[columns[c]]))
                        if len(own) < k:
                            heapq.heappush(own, item)
                        elif item > own[0]:
                            heapq.heapreplace(own, item)
                    if len(own) == k:
                        lowest[q] = own[0][0]
                        limit[q] = np.sqrt(max(0.0, length[q] + top - 2.0 * own[0][0]))
            else:
                possible = away - radii[None, :] <= bound
                columns = np.flatnonzero(possible.any(axis=0))
                far = _far(flat[rows], vectors[columns])
                near = np.maximum(far - radii[columns][None, :], 0)
                good = possible[:, columns] & (near <= bound)
                for i, c in zip(*map(np.ndarray.tolist, np.nonzero(good))):
                    heapq.heappush(todo[rows[i]], (float(near[i, c]), children[columns[c]], float(far[i, c])))
    return best


def top_products(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    scale: float = 64.0,
    shard_rows: int = 20_000,
    block_rows: int = 2_000,
) -> DataFrame:
    """The ``k`` other vectors with the largest integer product for each query.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id.  ``is_query``
    is a condition on ``id_col``.  Vectors are scaled and floored by ``integer_vectors``; a
    shorter one counts as padded with zeros.

    The largest product is the nearest neighbour once all vectors are raised to equal length, so a
    metric tree serves.  Ids are dealt by hash to shards of about ``shard_rows``, whose trees are
    written as pages; blocks of queries search every shard and the results merge.
    """
    spark = vectors.sparkSession
    plain = materialise(integer_vectors(vectors, id_col, vector_col, scale), scratch_path(spark, "vectors"))
    square = F.aggregate("v", F.lit(0).cast("bigint"), lambda s, x: s + x * x)
    is_query = is_query.alias("q")
    asked = plain.select(F.col("id").alias(id_col), "v").where(is_query).select(F.col(id_col).alias("id"), "v")
    size = plain.agg(F.count("*").alias("n"), F.max(square).alias("top"), F.max(F.size("v")).alias("width")).first()
    top, width = size["top"] or 0, size["width"] or 0
    shards = max(1, -(-size["n"] // shard_rows))
    blocks = max(1, -(-asked.count() // block_rows))

    def pages_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: dict[int, list] = {}
        rows: dict[int, list] = {}
        for b in batches:
            for s, i, v in zip(b["shard"].tolist(), b["id"].tolist(), b["v"]):
                ids.setdefault(s, []).append(i)
                rows.setdefault(s, []).append(v)
        for s in ids:
            order = np.argsort(ids[s])
            whole = _matrix(rows[s], width)[order]
            for page, leaf, own, v, children, radii, parents in build(np.array(ids[s])[order], whole, top):
                row = (s, page, leaf, v.shape[1], own.tolist(), v.tobytes(), list(children), list(map(float, radii)), list(map(float, parents)))
                yield pd.DataFrame([row], columns=[c.split()[0] for c in PAGE.split(", ")])

    dealt = plain.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(shards)).cast("int"))
    pages = materialise(dealt.repartition(shards, "shard").mapInPandas(pages_of, PAGE), scratch_path(spark, "pages"))

    def found(key: tuple, tree: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(tree) or not len(queries):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
        own = {}
        for r in tree.itertuples():
            kind = np.int64 if r.leaf else np.float64
            v = np.frombuffer(r.vectors, kind).reshape(-1, r.width)
            own[r.page] = (r.page, r.leaf, np.array(r.ids, np.int64), v, list(r.children), np.array(r.radii), np.array(r.parents))
        ids = queries["id"].to_numpy()
        rows = search(own, max(own), ids, _matrix(list(queries["v"]), width), top, k)
        return pd.DataFrame([(i, -j, s) for i, best in zip(ids.tolist(), rows) for s, j in best], columns=names)

    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    trees = pages.select("*", every(blocks, "block"))
    questions = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(4)), F.lit(blocks)).cast("int")).select("*", every(shards, "shard"))
    pairs = trees.groupBy("shard", "block").cogroup(questions.groupBy("shard", "block")).applyInPandas(found, RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
