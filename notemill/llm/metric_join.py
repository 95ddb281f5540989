"""Embedding near-dedup as an exact metric range join: pivots, cells, boundary replication by the triangle inequality.

On unit vectors a cosine of at least t is a distance of at most r = sqrt(2 - 2t). Each distinct vector lies in the cell of
its nearest pivot. A vector y visits another cell j only if some vector within r of it can lie there, that is unless
|y - p_j| > radius_j + r (radius_j: the largest distance in cell j), or |y - p_j| - |y - p_i| > 2r for its own pivot i,
or (|y - p_j|^2 - |y - p_i|^2) / (2 |p_i - p_j|) > r, its distance to the plane between both pivots. All three follow from
the triangle inequality and drop no pair. Cells are then joined independently, in blocks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .components import connected_components
from .vectors import common_size, matrix, usable

#: Parameters: rows of the sample that pivots come from, rows for which a label gets a pivot and most pivots of a label, rows
#: of a block of a cell. SLACK covers rounding in the bounds; links are checked exactly. A label that the sample lacks, or
#: of few rows, is one cell. Where no bound prunes (directions at random), the cells are a join in blocks, no more.
SAMPLE, CELL, PIVOTS, BLOCK, SLACK = 65_536, 8192, 4096, 4096, 1e-6
#: Parameter: bytes of the sample's vectors on the driver, so that long vectors make a smaller sample.
SAMPLE_BYTES = 256 << 20


def _roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index of each index's component, by hooking and pointer jumping."""
    root = np.arange(n)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            x, y = root[a], root[b]
            if (differ := x != y).any():
                changed = True
                low, high = np.minimum(x[differ], y[differ]), np.maximum(x[differ], y[differ])
                np.minimum.at(root, high, low)
        while (jumped := root[root] != root).any():
            root = root[root]
            del jumped
    return root


def cosine_links(nodes: DataFrame, size: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(counts, links) for distinct vectors (node, label, copies, vector): how many rows each node is linked with besides
    its own copies, and pairs (a, b) of nodes whose components are those of all links, of which each cell sends at most
    one a member."""
    spark = nodes.sparkSession
    r = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    total = nodes.count()
    some = min(SAMPLE, SAMPLE_BYTES // (8 * max(1, size)), 16 * math.ceil(total / CELL) + 1024)
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(some).select("label", "vector").toArrow()
    labels = sample.column("label").to_pandas()
    pivots: dict = {}
    for label, at in labels.groupby(labels).indices.items():
        want = math.ceil(len(at) / len(labels) * total / CELL)
        if min(want, PIVOTS) > 1:
            v = matrix(sample.column("vector").take(pa.array(at[: min(want, PIVOTS)])), size)
            pivots[label] = np.unique(v / np.linalg.norm(v, axis=1, keepdims=True), axis=0)
    shared = spark.sparkContext.broadcast(pivots)

    def distances(v: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * (v / np.linalg.norm(v, axis=1, keepdims=True)) @ p.T))

    def by_label(batch, column):
        """(label, its pivots, rows) of a batch; a label without pivots is one cell."""
        labels = batch.column(column).to_pylist()
        groups: dict = {}
        for row, label in enumerate(labels):
            groups.setdefault(label, []).append(row)
        for label, rows in groups.items():
            yield label, shared.value.get(label), np.array(rows)

    def homes(batches):
        for batch in batches:
            v = matrix(batch.column(1), size)
            for label, p, rows in by_label(batch, 0):
                if p is not None:
                    d = distances(v[rows], p)
                    take = pa.array([label] * len(rows), batch.column(0).type)
                    yield pa.RecordBatch.from_arrays([take, pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], names=["label", "home", "away"])

    kind = nodes.schema["label"].dataType.simpleString()
    radii = nodes.select("label", "vector").mapInArrow(homes, f"label {kind}, home int, away double").groupBy("label", "home").agg(F.max("away").alias("radius")).collect()
    radius = {label: np.full(len(p), -np.inf) for label, p in pivots.items()}
    for row in radii:  # at most one row for each vector of the sample
        radius[row["label"]][row["home"]] = row["radius"]
    bounds = spark.sparkContext.broadcast(radius)

    def places(batches):
        for batch in batches:
            v = matrix(batch.column(3), size)
            rows_, cells_, home_ = [], [], []
            for label, p, rows in by_label(batch, 1):
                if p is None:
                    rows_.append(rows)
                    cells_.append(np.zeros(len(rows), np.int64))
                    home_.append(np.ones(len(rows), bool))
                    continue
                d, at = distances(v[rows], p), np.arange(len(rows))
                home = d.argmin(1)
                met, back = np.unique(home, return_inverse=True)
                own = d[at, home][:, None]
                visit = (d <= bounds.value[label] + r) & (d - own <= 2 * r) & (d**2 - own**2 <= 2 * r * distances(p[met], p)[back] + SLACK)
                visit[at, home] = True
                row, cell = np.nonzero(visit)
                rows_.append(rows[row])
                cells_.append(cell)
                home_.append(home[row] == cell)
            if rows_:
                take = pa.array(np.concatenate(rows_))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(4)), pa.array(np.concatenate(cells_).astype(np.int32)), pa.array(np.concatenate(home_))], names=["node", "label", "copies", "vector", "cell", "home"])

    kinds = nodes.select("node", "label", "copies", "vector")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds.schema) + ", cell int, home boolean"
    placed = cut(kinds.mapInArrow(places, schema))
    blocks = placed.groupBy("label", "cell").agg(F.count("*").alias("n"), F.count_if("home").alias("h")).where("h > 0 and n > 1")
    blocks = blocks.select("label", "cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("nb"), F.ceil(F.col("h") / BLOCK).cast("int").alias("na"))
    rows = placed.join(blocks, ["label", "cell"])
    salt = F.xxhash64("node", F.lit("block"))
    left = rows.where("home").withColumn("a", F.pmod(salt, F.col("na")).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    right = rows.withColumn("b", F.pmod(salt, F.col("nb")).cast("int")).withColumn("a", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
    key, data = ["label", "cell", "a", "b"], ["node", "copies", "vector"]

    def join(x: pa.Table, y: pa.Table) -> pa.Table:
        nodes_x, nodes_y = x.column("node").to_numpy(), y.column("other_node").to_numpy()
        out_n, out_a, out_b, out_c = [], [], [], []
        if len(nodes_x) and len(nodes_y):
            vx, vy, copies = matrix(x.column("vector"), size), matrix(y.column("other_vector"), size), y.column("other_copies").to_numpy()
            norm_x, norm_y = np.linalg.norm(vx, axis=1), np.linalg.norm(vy, axis=1)
            names, place = np.unique(np.concatenate((nodes_x, nodes_y)), return_inverse=True)
            px, py = place[: len(nodes_x)], place[len(nodes_x) :]
            counts, root = np.zeros(len(nodes_x), np.int64), np.arange(len(names))
            for at in range(0, len(vx), 512):
                cos = vx[at : at + 512] @ vy.T
                cos /= norm_x[at : at + 512, None]
                cos /= norm_y
                i, j = np.nonzero(cos >= threshold)
                other = px[at + i] != py[j]
                i, j = i[other] + at, j[other]
                counts += np.bincount(i, copies[j], minlength=len(nodes_x)).astype(np.int64)
                if len(i):
                    root = _roots(len(names), [(px[i], py[j]), (np.arange(len(names)), root)])
            moved = np.flatnonzero(root != np.arange(len(names)))
            out_n, out_c, out_a, out_b = nodes_x, counts, names[moved], names[root[moved]]
        n, m = len(out_n), len(out_a)
        return pa.table({"node": pa.array([*out_n, *out_a], pa.int64()), "other": pa.array([*([None] * n), *out_b], pa.int64()), "n": pa.array([*out_c, *([0] * m)], pa.int64())})

    right = right.select(*[F.col(c).alias(f"other_{c}") for c in (*key, *data)])  # new names: both sides are of one frame
    both = left.select(*key, *data).groupBy(*key).cogroup(right.groupBy(*[f"other_{c}" for c in key]))
    found = cut(both.applyInArrow(join, "node long, other long, n long"))
    counts = found.where("other is null").groupBy("node").agg(F.sum("n").alias("n"))
    return counts, found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))


def near_vectors(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept), one row for each row.

    Two vectors are linked if their labels are equal and not null and their cosine, in double precision, is at least
    threshold (above 0). Vectors that are null, empty, zero, of another than the most common length, or hold null or
    non-finite components link with nothing, as do rows with a null id (their component is null, kept false). Copies are
    one node with a number of rows, so a vector that a third of the rows share is joined once. Rows that repeat an id with
    the same vector count as one vector; rows of one id with different vectors each have their own links and component, and
    more than one of them may be kept. Other columns are not read; an empty table gives an empty result.
    """
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    good = base.where(usable("vector") & F.col("label").isNotNull() & F.col("id").isNotNull())
    size = common_size(good, "vector")
    hashed = good.where(F.size("vector") == size).select("id", "label", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit("second"), "vector").alias("h2"))
    nodes = hashed.groupBy("label", "h1", "h2").agg(F.min("id").alias("least"), F.count_distinct("id").alias("copies"), F.any_value("vector").alias("vector"))
    nodes = cut(nodes.withColumn("node", F.xxhash64("label", "h1", "h2")))  # not an id: an id may have several vectors
    if not size:
        return base.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    counts, links = cosine_links(nodes, size, threshold)
    groups = connected_components(links).withColumnRenamed("id", "node")
    placed = nodes.select("label", "h1", "h2", "node", "least", "copies").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    result = placed.join(least, "component").join(counts, "node", "left")
    result = result.select("label", "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    keyed = base.select("id", "label", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit("second"), "vector").alias("h2"), (usable("vector") & F.col("label").isNotNull() & F.col("id").isNotNull() & (F.size("vector") == size)).alias("in"))
    result = result.withColumn("in", F.lit(True))
    out = keyed.join(result, ["label", "h1", "h2", "in"], "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op9_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS r FROM embeddings UNION SELECT l.a, reach.r FROM links l JOIN reach ON reach.a = l.b),
c AS (SELECT a AS vec_id, min(r) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n ON n.vec_id = c.vec_id
"""
