"""Restartable runs over a landing folder: each new file is processed once, results are appended per batch.

The checkpoint of Structured Streaming holds which files are done and, in a state store partitioned by key, which keys are: a
batch looks up the keys of its own rows only, whatever has been done before, so the same record in two files is processed
once. A batch that is repeated after a failure starts from the state before it and replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..runtime import reach
from ..sources.sinks import append_partial


#: Spark's setting for the state store, and the store that keeps state on disk.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_new_files(spark: SparkSession, landing: str, out: str, checkpoint: str, schema: StructType, work: Callable[[DataFrame], DataFrame], keys: tuple[str, ...], files_a_batch: int = 100, audit: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """work() on the rows of all new JSON files in landing; what it returns lies under out, a folder for each batch, and the lines
    that audit() makes of it (one column, value) under out's sibling <out>_audit, batch by batch too.

    Of rows with the same keys one is processed, ever; null is a key like others. Keys stay in the checkpoint's state store
    (RocksDB, so they need not fit in memory) and are looked up where they lie; neither out nor the audit is read for that.
    """

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        append_partial(work(rows), out, number)
        if audit:
            audit(session.read.parquet(f"{out}/batch={number}")).write.mode("overwrite").text(f"{out}_audit/batch={number}")

    stream = reach(spark).readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(landing)
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        new = stream.dropDuplicates(list(keys))
        query = new.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)
    query.awaitTermination()
