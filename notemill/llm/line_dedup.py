"""Line dedup in built-in expressions only: explode, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, lower_ascii, table, text_of


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def _hashes(key: Column) -> list[Column]:
    """128 bits: two hashes of different seeds."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def repeated_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(lines, keys): the hashed lines (id, t, pos, h1, h2), and (h1, h2, keeper) of the keys found in min_docs documents.

    keeper is the smallest id that holds the key. Counting is a partial aggregation before its shuffle, so a line that
    a third of all documents share sends one row a task.
    """
    lines = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
        .select("id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("id", "t", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "t", "pos", *_hashes(F.col("key")))
    )
    if min_docs == 2:  # two distinct documents: the smallest id is not the largest
        keys = lines.groupBy("h1", "h2").agg(F.min("id").alias("keeper"), F.max("id").alias("last")).where("keeper <> last")
    else:
        keys = lines.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one")).groupBy("h1", "h2")
        keys = keys.agg(F.min("id").alias("keeper"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    return lines, keys.select("h1", "h2", "keeper")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """Every row of docs as a struct ``row``, with n_lines, n_dropped (long) and kept_text.

    A text is split at \\n (null or empty: one empty line). A line's key is the line without white space at its ends,
    A-Z lowered; keys of at least min_chars code points found in at least min_docs documents lose all their lines but
    those of the smallest id that holds the key. Rows with a null id keep every line and count for nothing. Rows that
    repeat an id are one document; each of the rows loses its own lines. A very long text is split and joined in
    linear time; a very common line meets a one-row table in a join that adaptive execution splits.
    """
    lines, keys = repeated_keys(docs, id_col, text_col, min_chars, min_docs)
    # under another name the counted keys are dealt out anew, so adaptive execution can split the lines of a very common key
    again = F.col("h2").bitwiseXOR(F.lit(1)).alias("g")
    drops = (
        lines.select("id", "t", "pos", "h1", again)
        .join(keys.select("h1", again, "keeper"), ["h1", "g"])
        .where("id <> keeper")
        .groupBy("id", "t")
        .agg(F.collect_set("pos").alias("drops"))
        .select(F.col("id").alias("_id"), F.col("t").alias("_t"), "drops")
    )
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("_i"), text_of(text_col).alias("_text"))
    rows = rows.withColumn("_x", F.xxhash64("_text"))
    joined = rows.join(drops, (F.col("_i") == F.col("_id")) & (F.col("_x") == F.col("_t")), "left")
    parts = F.split("_text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("drops"))
    kept = F.when(F.col("drops").isNull(), F.col("_text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(F.col("_parts"), i)), "\n")
    )
    return joined.withColumn("_parts", parts).select(
        "row",
        F.size("_parts").cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_dropped"),
        kept.alias("kept_text"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH lines AS (
  SELECT d.doc_id, u.line, u.pos,
         translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
       LATERAL (SELECT unnest(parts) AS line, generate_subscripts(parts, 1) AS pos) u),
dups AS (SELECT k, min(doc_id) AS keeper FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT l.*, coalesce(p.keeper <> l.doc_id, false) AS gone FROM lines l LEFT JOIN dups p ON p.k = l.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
