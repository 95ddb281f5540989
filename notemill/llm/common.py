"""What the training-data operators share.

Rules that hold for every operator of this subpackage unless its docstring says otherwise:

* only the named columns are read; other columns, whatever their names, are carried in one struct or ignored;
* a null text counts as an empty text;
* rows whose id is null are kept in the result and never linked with, or counted as, another document;
* rows that repeat an id are treated alike, and the result does not depend on the order of the rows.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import reach

#: The white space that separates words, as characters and as a Java pattern.
WHITE = " \t\n\x0b\f\r"
WHITE_RUN = "[ \\t\\n\\x0B\\f\\r]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, in batches of runtime.BATCH for Python workers."""
    return reach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def lower_ascii(col: Column) -> Column:
    """A-Z lowered, every other character as it is."""
    return F.translate(col, UPPER, UPPER.lower())


def n_words(col: Column) -> Column:
    """How many runs of characters other than white space a text has, as a long; 0 for null."""
    text = F.btrim(F.coalesce(col, F.lit("")), F.lit(WHITE))
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, WHITE_RUN))).cast("long")


def id_remainder(col: str | Column, modulus: int) -> Column:
    """crc32 of the id written as text, modulo modulus. A null id counts as an empty text (crc32 0)."""
    return F.crc32(F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))) % modulus


def ready_to_checkpoint(spark: SparkSession) -> None:
    """The cluster names the shared folder in spark.checkpoint.dir; only where it is unset on a local master, as in tests, one is made."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="notemill-checkpoint-"))


def shared_folder(spark: SparkSession) -> str:
    """The folder in which driver and executors see the same files."""
    ready_to_checkpoint(spark)
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: no lineage before it, and it outlives executors."""
    ready_to_checkpoint(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder as Parquet and read from there: as cut, but compressed and with columns apart."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
