from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from notemill.plans import adapters
from notemill.runtime import BATCH

SF = "/root/testdata/sf0.001"


def test_batches_of_long_texts_are_bounded_once_a_table_is_loaded(spark):
    was = {key: spark.conf.get(key) for key in BATCH}

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["n", "size"])

    def rows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([len(b)] * len(b), pa.int64())

    try:
        for key in BATCH:
            spark.conf.unset(key)
        adapters.load(spark, SF, "region")
        texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("0123456789"), 1000 + (F.col("id") % 2).cast("int")).alias("text"))
        found = texts.mapInArrow(sizes, "n long, size long").agg(F.max("n").alias("n"), F.max("size").alias("size"), F.sum("n").alias("all")).first()
        assert found["all"] == 4000 and found["n"] <= 1000 and found["size"] < 12 << 20
        assert texts.select(F.arrow_udf(rows, "long")("text").alias("n")).agg(F.max("n")).first()[0] <= 1000
    finally:
        for key, value in was.items():
            spark.conf.set(key, value)
