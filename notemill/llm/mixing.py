"""Mixing sources to target weights: hash-random keys, distributed prefix sums of sizes, an exact cut per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import WHITE, WHITE_RUN, n_words, table, text_of

#: Parameters: key ranges per source, which bound the rows of the prefix over ranges, and the most epochs of a document.
RANGES, MAX_EPOCHS, SEED = 4096, 3, 20
#: Parameter: repeats of one row that are counted out at a time.
REPEATS = 4096


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from one row a source (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the sum of all sizes. A target stops at
    max_epochs times its source's size and the excess is reshared by weight until none is above. That fixed point has
    a closed form: ordered by size / weight (equals by source), the stopped sources are a prefix, and the others share
    what is left at the level of the first of them.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("w", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = W.partitionBy(F.lit(1))
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    ranked = ranked.withColumn("level", level).withColumn("place", F.row_number().over(by_ratio))
    stopped = F.col("level") * F.col("w") > F.col("cap")
    share = F.min(F.when(~stopped, F.struct("place", "level"))).over(everything)["level"]
    target = F.when(share.isNull() | (share * F.col("w") > F.col("cap")), F.col("cap")).otherwise(share * F.col("w"))
    return ranked.select("source", "source_size", target.alias("target"))


def _hash_key(id_col: str, text_col: str) -> Column:
    """128 bits by which rows lie in random order: equal for rows of the same id and text only."""
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(text_of(text_col))))


def _placed(entries: DataFrame, ranges: int, max_epochs: int) -> DataFrame:
    """entries (source, key, tie, size, n: rows that are equal) with source_size, target, and for the k-th of an entry's
    equal rows what it gives: ``whole`` times its size, and the part of ``left`` - k * size that lies in 0..size."""
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * ranges
    entries = entries.withColumn("range", F.shiftright(place, 32).cast("int"))
    entries = entries.withColumn("named", F.coalesce("source", F.lit(""))).withColumn("absent", F.col("source").isNull())
    all_of = F.col("size") * F.col("n")
    parts = entries.groupBy("absent", "named", "range").agg(F.sum(all_of).alias("words"), F.min("source").alias("source"))
    in_source = W.partitionBy("absent", "named")
    parts = parts.withColumn("before", F.sum("words").over(in_source.orderBy("range").rowsBetween(W.unboundedPreceding, 0)) - F.col("words"))
    totals = parts.groupBy("absent", "named").agg(F.sum("words").alias("source_size"), F.min("source").alias("source"))
    targets = source_targets(totals.select("source", "source_size"), max_epochs)
    targets = targets.select(F.col("source").isNull().alias("absent"), F.coalesce("source", F.lit("")).alias("named"), "source_size", "target")
    parts = parts.join(targets, ["absent", "named"]).select("absent", "named", "range", "before", "source_size", "target")
    rows = entries.join(parts, ["absent", "named", "range"])
    here = W.partitionBy("absent", "named", "range").orderBy("key", "tie", "size").rowsBetween(W.unboundedPreceding, 0)
    start = F.col("before") + F.sum(all_of).over(here) - all_of
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(budget / F.greatest(F.col("source_size"), F.lit(1)))).cast("long")
    rows = rows.withColumn("start", start).withColumn("whole", F.least(whole, F.lit(max_epochs)))
    return rows.withColumn("left", budget - F.col("whole") * F.col("source_size") - F.col("start")).drop("range", "named", "absent", "start", "before")


def _each_equal_row(placed: DataFrame) -> DataFrame:
    """One row for each of an entry's n equal rows, with ``taken``."""
    some = placed.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(REPEATS).cast("long"))))
    each = some.withColumn("k", F.explode(F.sequence("first", F.least(F.col("first") + REPEATS, F.col("n")) - 1)))
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.col("k") * F.col("size")))
    return each.withColumn("taken", (F.col("whole") * F.col("size") + more).cast("long"))


def mix(docs: DataFrame, size: Column, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", ranges: int = RANGES, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(id, source, size, source_size, target, taken), one row for each row of docs.

    A source's budget is its target, rounded. Its documents lie in the order of a hash (MD5 of seed, id and text); the mix takes them
    whole, again from the start if needed, and cuts the last one at the exact budget, so taken sums to the budget and is
    at most max_epochs times a document's size. The prefix sums are two-level: over key ranges of a source (at most
    ``ranges`` rows each) and inside a range; a source with a third of all rows spreads over ``ranges`` groups.
    Rows of the same id, text and source, however many, are summed before the shuffle and are one entry of a range.
    Null sources are a source of their own; null ids hash as an empty text; a source without words has the target 0 and
    takes nothing; an empty table gives an empty result. Reruns agree, as the keys depend on the rows alone.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), _hash_key(id_col, text_col).alias("key"))
    entries = keyed.groupBy("id", "source", "size", "key").agg(F.count("*").alias("n")).withColumn("tie", F.lit(0))
    return _each_equal_row(_placed(entries, ranges, max_epochs)).select("id", "source", "size", "source_size", "target", "taken")


def first_words(text: Column, n: Column) -> Column:
    """The first n words of a text, joined by single spaces."""
    return F.array_join(F.slice(F.split(F.btrim(text, F.lit(WHITE)), WHITE_RUN), F.lit(1), n.cast("int")), " ")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs as the mix takes them: a row as often as it is taken whole, and the one at a source's cut with its first
    words up to the exact budget. Rows without words, which no budget counts, stay once. Columns are those of docs; other
    columns, whatever their names, go with their row, and an n_chars follows the text.

    Each row is taken on its own, so rows that repeat an id sum to the budget like others. Equal rows are summed before
    texts are shuffled. Null texts are without words; an empty table gives an empty result.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), _hash_key(id_col, text_col).alias("key"), F.xxhash64(row).alias("tie"))
    entries = keyed.groupBy("source", "size", "key", "tie").agg(F.count("*").alias("n"))
    taken = _each_equal_row(_placed(entries, RANGES, MAX_EPOCHS)).select(*(F.col(c).alias(f"t_{c}") for c in ("source", "key", "tie", "size", "taken")), "k")
    times = F.when(F.col("t_size") == 0, F.lit(1)).otherwise(F.floor(F.col("t_taken") / F.greatest(F.col("t_size"), F.lit(1)))).cast("int")
    rest = F.when(F.col("t_size") == 0, F.lit(0)).otherwise(F.col("t_taken") - times * F.col("t_size")).cast("long")
    whole = F.array_repeat(F.lit(-1).cast("long"), times)
    taken = taken.withColumn("copy", F.explode(F.when(rest > 0, F.concat(whole, F.array(rest))).otherwise(whole))).drop("t_size", "t_taken", "k")
    one = keyed.groupBy("source", "key", "tie").agg(F.any_value("row").alias("row"))
    copies = one.join(taken, F.expr("key = t_key and tie = t_tie and source <=> t_source"))
    text = F.when(F.col("copy") < 0, F.col("row")[text_col]).otherwise(first_words(F.col("row")[text_col], F.col("copy")))
    copies = copies.select("row", "copy", text.alias("text"))
    changed = {text_col: F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("copy") < 0, F.col("row.n_chars")).otherwise(F.char_length("text"))
    return copies.select(*[changed.get(c, F.col("row")[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), n_words(F.col("text")))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


#: Targets are found by resharing step by step: each step stops the sources above their cap and shares the rest again.
OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w, CAST(source_size AS DOUBLE) * 3 AS cap FROM s),
step AS (
  SELECT 0 AS n, list({'source': source, 'w': w, 'cap': cap, 'stopped': false}) AS every, CAST(sum(source_size) AS DOUBLE) AS total, true AS moved FROM r
  UNION ALL
  SELECT n + 1, again, total, list_sum(list_transform(again, lambda x: CAST(x.stopped AS INT))) > list_sum(list_transform(every, lambda x: CAST(x.stopped AS INT)))
  FROM (SELECT n, every, total, moved,
               list_transform(every, lambda x: {'source': x.source, 'w': x.w, 'cap': x.cap, 'stopped': x.stopped OR
                 (total - coalesce(list_sum(list_transform(list_filter(every, lambda y: y.stopped), lambda y: y.cap)), 0))
                 / list_sum(list_transform(list_filter(every, lambda y: NOT y.stopped), lambda y: y.w)) * x.w > x.cap}) AS again
        FROM step WHERE moved) u),
final AS (SELECT every, total FROM step ORDER BY n DESC LIMIT 1),
share AS (SELECT (total - coalesce(list_sum(list_transform(list_filter(every, lambda y: y.stopped), lambda y: y.cap)), 0))
               / list_sum(list_transform(list_filter(every, lambda y: NOT y.stopped), lambda y: y.w)) AS level FROM final),
t AS (SELECT r.source, r.source_size, CASE WHEN e.stopped THEN r.cap ELSE share.level * r.w END AS target
      FROM r JOIN (SELECT unnest(every) AS e FROM final) f ON f.e.source IS NOT DISTINCT FROM r.source CROSS JOIN share),
p AS (SELECT d.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
      FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
q AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(budget // greatest(source_size, 1), 3) END AS whole FROM p)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, budget - whole * source_size - start)) AS BIGINT) AS taken FROM q
"""
