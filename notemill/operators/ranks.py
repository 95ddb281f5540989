"""Rows by their place in a sorted group, found by counts: no group is gathered anywhere."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..sources.sinks import stored


def in_parts(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """rows with _part: their part of all rows in the order of group and ``order``. Spark draws the bounds from a sample, so a large
    group lies in many parts; they are written down once, as another sample would draw others."""
    return stored(rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), "parts")


def sizes_of(parted: DataFrame, group: str) -> DataFrame:
    """(group, _part, n, _before): the rows of a group in each part, and how many lie in earlier parts."""
    sizes = parted.groupBy(group, "_part").agg(F.count("*").alias("n"))
    return sizes.withColumn("_before", F.sum("n").over(W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))


def rows_at(parted: DataFrame, sizes: DataFrame, places: DataFrame, group: str, *order: str) -> DataFrame:
    """The rows of in_parts at places (group, place from 0, more columns), with these columns. Only parts that hold a place are ranked."""
    here = sizes.join(places, group).where((F.col("place") >= F.col("_before")) & (F.col("place") < F.col("_before") + F.col("n")))
    here = here.withColumn("_k", F.col("place") - F.col("_before")).drop("n", "_before")
    some = parted.join(here.select(group, "_part").distinct(), [group, "_part"], "left_semi")
    ranked = some.withColumn("_k", F.row_number().over(W.partitionBy(group, "_part").orderBy(*order)) - 1)
    return ranked.join(here, [group, "_part", "_k"]).drop("_part", "_k")


def drawn_places(totals: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """(group, place, pick from 1 in the order of places) for totals (group, size): n places of each group, drawn by Python's generator
    seeded with 'seed:group'. It draws places from a number, so it needs no keys. All places if a group has n or fewer, or n is 0."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if 0 < n < size:
                    places = sorted(random.Random(f"{seed}:{name}").sample(range(size), n))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, batch.schema.field(0).type), pa.array(places, pa.int64()), pa.array(range(1, n + 1), pa.int32())], names=[group, "place", "pick"])

    kind = totals.schema[group].dataType.simpleString()
    drawn = totals.select(group, "size").mapInArrow(draw, f"`{group}` {kind}, place long, pick int")
    if n <= 0:
        return drawn
    small = totals.where(F.col("size") <= n).select(group, F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("pick", "place"))
    return drawn.unionByName(small.select(group, "place", (F.col("pick") + 1).cast("int").alias("pick")))


def drawn_rows(rows: DataFrame, group: str, n: int, seed: int, *order: str) -> DataFrame:
    """n rows of each group with their pick, as drawn_places draws them from the rows in ``order``; n must be positive."""
    parted = in_parts(rows, group, *order)
    sizes = sizes_of(parted, group)
    totals = sizes.groupBy(group).agg(F.sum("n").alias("size"))
    return rows_at(parted, sizes, drawn_places(totals, group, n, seed), group, *order).drop("place")
