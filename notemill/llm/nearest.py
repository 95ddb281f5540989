"""Approximate nearest neighbours: stable projections under kd-trees, verified until a chi-square test holds.

Largest inner products become nearest points: with M the largest norm, a vector x is (x, sqrt(M^2 - |x|^2)) and a query q
is (q M / |q|, 0), and |q' - x'|^2 = 2 M^2 - 2 (M / |q|) q.x. Points are projected by DIMS Gaussian (2-stable) directions:
projected distance^2 / distance^2 is chi-square distributed with DIMS degrees of freedom. So if the k-th best distance so
far is d, a point nearer than d lies within d * sqrt(quantile(SURE)) of the query's projection with the probability SURE.

The projected space is cut by a kd-tree whose upper part, fitted on a bounded sample, deals the rows out to cells, and
whose lower part is built in each cell (or block of a cell that has many rows). A query first searches its own cell, then
other cells whose boxes come within that radius. In a cell, leaves are visited by rising distance of their boxes from
the projected query; their points are verified on the original vectors; the search stops as soon as the next leaf lies
beyond the radius for the k-th best found so far: the chi-square test is made after every leaf. Other cells are asked in
rounds (ROUNDS), the nearest boxes first, each under the radius that the rounds before have left.

Neither side of a cell is ever gathered whole: its rows lie in blocks, and queries that ask it are dealt out to parts;
every block meets every part in a group of its own. Blocks of cells that no query asks are not sent in that round.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import cut, table
from .vectors import common_size, lists, matrix, usable

#: Parameters: projections, chance not to miss a neighbour, rows of a cell and of a block, most cells, sample, leaf.
DIMS, SURE, CELL, BLOCK, MAX_CELLS, SAMPLE, LEAF, SEED = 8, 0.97, 4096, 8192, 4096, 8192, 128, 11
#: Parameters: about so many queries meet a block in one group; so many are routed at a time in a worker.
ASKED, ROUTED = 8192, 128
FOUND = "query_id long, id long, score double"
#: Parameter: so many cells of a query, by rising distance of their boxes, are searched by the end of each round; None: all.
ROUNDS = (1, 4, None)


def chi_square_quantile(p: float, dims: int) -> float:
    """By bisection on the closed form for even degrees of freedom."""
    if dims % 2:
        raise ValueError("an even number of projections is needed")

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))

    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


class Splits:
    """The upper part of the kd-tree: median splits of a sample, level by level along the widest side."""

    def __init__(self, points: np.ndarray, levels: int):
        self.levels, self.axis, self.at = levels, np.zeros(2**levels, np.int64), np.zeros(2**levels)
        groups = {1: points}
        for node in range(1, 2**levels):
            p = groups.pop(node)
            if len(p):
                self.axis[node] = k = int(np.ptp(p, axis=0).argmax())
                self.at[node] = np.median(p[:, k])
            k, high = self.axis[node], p[:, self.axis[node]] > self.at[node]
            groups[2 * node], groups[2 * node + 1] = p[~high], p[high]

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.levels):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node - 2**self.levels


def leaves_of(points: np.ndarray, size: int) -> np.ndarray:
    """An order of the points in which every ``size`` in a row are a leaf of a kd-tree."""
    stack, out = [np.arange(len(points))], []
    while stack:
        at = stack.pop()
        if len(at) <= size:
            out.append(at)
            continue
        half = size * max(1, round(len(at) / 2 / size))
        part = at[np.argpartition(points[at][:, int(np.ptp(points[at], axis=0).argmax())], min(half, len(at) - 1))]
        stack += [part[half:], part[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def search(points: np.ndarray, ids: np.ndarray, proj: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, query_proj: np.ndarray, bound: np.ndarray, k: int, limit: float, top: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, inner product) of the k best of each query among points, by the incremental search.

    bound: the k-th best inner product known of each query, or -inf. limit: the chi-square quantile. top: M. Each query takes
    its leaves by rising distance, one at a time; after each, the k-th best moves its radius in, and it stops at the first
    leaf beyond. Queries that are at the same leaf are verified together.
    """
    order = leaves_of(proj, LEAF)
    points, ids, proj = points[order], ids[order], proj[order]
    starts = np.arange(0, len(order), LEAF)
    low, high = np.minimum.reduceat(proj, starts), np.maximum.reduceat(proj, starts)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(queries), 256):
        q, qp, qid = queries[at : at + 256], query_proj[at : at + 256], query_ids[at : at + 256]
        norm, known = np.linalg.norm(q, axis=1), bound[at : at + 256].copy()
        gap = (np.maximum(0, np.maximum(low[None] - qp[:, None], qp[:, None] - high[None])) ** 2).sum(2)
        turn = np.argsort(gap, axis=1, kind="stable")
        gap = np.take_along_axis(gap, turn, 1)
        score = np.full((len(q), len(points)), -np.inf)
        best = np.full((len(q), k), -np.inf)
        active = np.arange(len(q))
        for step in range(len(starts)):
            far = np.maximum(0, 2 * top * top - 2 * (top / norm[active]) * known[active])  # squared distance of the k-th best so far
            active = active[~np.isfinite(known[active]) | (gap[active, step] <= limit * far)]
            if not len(active):
                break
            leaf = turn[active, step]
            by_leaf = np.argsort(leaf, kind="stable")
            for rows in np.split(active[by_leaf], np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
                here = slice(starts[turn[rows[0], step]], starts[turn[rows[0], step]] + LEAF)
                value = q[rows] @ points[here].T
                value[qid[rows][:, None] == ids[here]] = -np.inf
                score[rows, here] = value
                both = np.concatenate((best[rows], value), axis=1)
                best[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
            known[active] = np.maximum(known[active], best[active].min(1))
        row, col = np.nonzero((score >= known[:, None] - 1e-9 * top * norm[:, None]) & np.isfinite(score))
        exact = (q[row] * points[col]).sum(1)  # summed alike for copies, so that equal vectors tie
        rank = np.lexsort((ids[col], -exact, row))
        row, col, exact = row[rank], col[rank], exact[rank]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < k
        found.append((row[keep] + at, ids[col[keep]], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def asked_cells(p: np.ndarray, own: np.ndarray, reach: np.ndarray, cells: np.ndarray, low: np.ndarray, high: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(how many cells each query asks, these cells): of the places begin to end by rising distance of their boxes, its own
    cell first, those whose squared distance is at most ``reach``."""
    gap = np.zeros((len(p), len(cells)))
    for axis in range(p.shape[1]):
        side = p[:, axis, None]
        gap += np.maximum(0, np.maximum(low[:, axis] - side, side - high[:, axis])) ** 2
    gap[own[:, None] == cells] = -1
    order = np.argsort(gap, axis=1, kind="stable")[:, begin:end]
    going = np.take_along_axis(gap, order, 1) <= reach[:, None]
    return going.sum(1), cells[order[going]]


def dealt(points: DataFrame, routed: DataFrame, rows_of: dict[int, int]) -> tuple[DataFrame, DataFrame] | None:
    """Points and queries by (cell, block, part), so that every point of a cell meets every query that asks it once, about BLOCK
    points and ASKED queries at a time; None if nothing is asked. rows_of: points of each cell. Points carry a number ``row`` by
    which equal ids, too, are dealt out."""
    load = {r["cell"]: r["n"] for r in routed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most MAX_CELLS rows
    if not load:
        return None
    plan = [(cell, -(-n // BLOCK), -(-load[cell] // ASKED)) for cell, n in rows_of.items() if cell in load]
    plan = F.broadcast(points.sparkSession.createDataFrame(plan, "cell int, n_blocks int, n_parts int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    sent = routed.withColumn("cell", F.explode("cells")).join(plan, "cell").withColumn("part", deal("n_parts", "id"))
    here = points.join(plan, "cell").withColumn("block", deal("n_blocks", "id", "row"))
    return here.select("cell", "block", every("n_parts").alias("part"), "id", "vector", "proj"), sent.select("cell", every("n_blocks").alias("block"), "part", "id", "vector", "proj", "bound")


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): for each row for which is_query (over the column ``id``) holds, its k best other rows
    found by inner product, in double precision on the original vectors; ties go to the smaller id.

    Vectors that are null, empty, zero, of another than the most common length, or hold null or non-finite components, and
    rows with a null id, take no part. A row that repeats an id is a candidate as often as it stands there but never its
    own id's; a query id with several vectors asks with the one of the least hash. Other columns are not read. With fewer candidates than k all are returned; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable("vector") & F.col("id").isNotNull())
    size = common_size(base, "vector")
    base = base.where(F.size("vector") == size)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    total = base.agg(F.count("*").alias("n"), F.max(norm).alias("top")).first()
    if not total["n"]:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    top = float(total["top"]) * (1 + 1e-12)
    frame = np.random.default_rng(SEED).standard_normal((size + 1, DIMS))
    limit = chi_square_quantile(SURE, DIMS)

    def projected(v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, top * top - (v * v).sum(1)))
        return v @ frame[:-1] + rest[:, None] * frame[-1]

    sample = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toPandas()["vector"]
    levels = max(0, min(int(math.log2(MAX_CELLS)), math.ceil(math.log2(total["n"] / CELL))))
    splits = Splits(projected(np.array([np.asarray(v) for v in sample])), levels)

    def index(batches):
        for batch in batches:
            p = projected(matrix(batch.column(1), size))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(p, pa.float64()), pa.array(splits.cells(p).astype(np.int32))], names=["id", "vector", "proj", "cell"])

    points = cut(base.mapInArrow(index, "id long, vector array<double>, proj array<double>, cell int"))
    boxes = points.groupBy("cell").agg(F.count("*").alias("n"), *[f(F.col("proj")[k]).alias(f"{f.__name__}{k}") for k in range(DIMS) for f in (F.min, F.max)]).collect()
    rows_of = {b["cell"]: b["n"] for b in boxes}
    cells = np.array([b["cell"] for b in boxes])  # at most MAX_CELLS rows
    low = np.array([[b[f"min{k}"] for k in range(DIMS)] for b in boxes])
    high = np.array([[b[f"max{k}"] for k in range(DIMS)] for b in boxes])
    shared = spark.sparkContext.broadcast((cells, low, high))
    # equal ids, too, are dealt out to the blocks: points are a checkpoint, so a row keeps its number
    numbered = points.withColumn("row", F.monotonically_increasing_id())
    queries = points.where(is_query).select("id", "vector")

    def route(begin: int, end: int | None):
        def run(batches):
            cells, low, high = shared.value
            last = len(cells) if end is None else end
            for batch in batches:
                for at in range(0, batch.num_rows, ROUTED):
                    part = batch.slice(at, ROUTED)
                    v, bound = matrix(part.column(1), size), part.column(2).to_numpy(zero_copy_only=False)
                    norm = np.linalg.norm(v, axis=1)
                    p = (v * (top / norm)[:, None]) @ frame[:-1]
                    far = np.where(np.isfinite(bound), limit * np.maximum(0, 2 * top * top - 2 * (top / norm) * bound), np.inf)
                    n, to = asked_cells(p, splits.cells(projected(v)), far, cells, low, high, begin, last)
                    to = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(to, pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists(p, pa.float64()), part.column(2), to], names=["id", "vector", "proj", "bound", "cells"])

        return run

    def verify(key, x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows or not y.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        qid = y.column("id").to_numpy()
        row, i, s = search(matrix(x.column("vector"), size), x.column("id").to_numpy(), matrix(x.column("proj"), DIMS), matrix(y.column("vector"), size), qid, matrix(y.column("proj"), DIMS), y.column("bound").to_numpy(), k, limit, top)
        return pa.table({"query_id": pa.array(qid[row.astype(np.int64)], pa.int64()), "id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64())})

    def round_of(asked: DataFrame, begin: int, end: int | None) -> DataFrame | None:
        """Each block of a cell that is asked meets the queries that ask it, in parts of about ASKED queries; None if none is asked."""
        routed = cut(asked.mapInArrow(route(begin, end), "id long, vector array<double>, proj array<double>, bound double, cells array<int>"))
        if not (sides := dealt(numbered, routed, rows_of)):
            return None
        here, sent = (side.groupBy("cell", "block", "part") for side in sides)
        return here.cogroup(sent).applyInArrow(verify, FOUND)

    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    once = queries.groupBy("id").agg(F.min_by("vector", F.xxhash64("vector")).alias("vector"))
    found: DataFrame | None = None
    begin = 0
    for end in ROUNDS:
        if begin >= len(cells):
            break
        asked = once.withColumn("bound", F.lit(float("-inf")))
        if found is not None:
            bound = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("bound"))
            asked = once.join(bound.withColumnRenamed("query_id", "id"), "id", "left").select("id", "vector", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
        more = round_of(asked, begin, end)
        if more is None:  # boxes farther off are beyond every radius, too
            break
        more = more if found is None else found.unionByName(more)
        found = cut(more.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))
        begin = len(cells) if end is None else end
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    return found.withColumn("rank", F.row_number().over(best)).select("query_id", "rank", "id", "score")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
    return found.withColumnRenamed("id", "vec_id")
