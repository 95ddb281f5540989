"""Reference notes of a professor: which may be used, which are chosen, and what their style is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.text import ABBREVIATION, DATE, clean_scalar, lines, truncate_middle
from ..sources.sinks import stored
from .ranks import drawn_rows


def usable(pool: DataFrame, targets: DataFrame | None = None, least: int = 10) -> DataFrame:
    """References of at least ``least`` characters that are no targets of their own professor."""
    out = pool.withColumn("output", clean_scalar("output")).where(F.length("output") >= least)
    return out if targets is None else out.join(targets.select("professor", "record_id").distinct(), ["professor", "record_id"], "left_anti")


def length_quantiles(pool: DataFrame, at: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """professor, n, quantiles of the notes' lengths (exact, linear between ranks)."""
    return pool.groupBy("professor").agg(F.count("*").alias("n"), F.percentile(F.length("output"), F.array(*map(F.lit, at))).alias("quantiles"))


def quantile_lengths(slim: DataFrame, k: int) -> DataFrame:
    """(professor, j, at): the j-th of k even quantiles of the lengths n, linear between ranks, from a histogram with prefix sums."""
    own = W.partitionBy("professor")
    bins = slim.groupBy("professor", "n").agg(F.count("*").alias("c"))
    bins = bins.withColumn("upto", F.sum("c").over(own.orderBy("n").rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("c").over(own))
    step = F.col("j") / F.lit(float(max(1, k - 1)))
    each = bins.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("place", (F.col("total") - 1) * step)
    low = F.floor("place")
    holds = lambda rank: (rank >= F.col("upto") - F.col("c")) & (rank < F.col("upto"))
    length = lambda rank: F.max(F.when(holds(rank), F.col("n").cast("double")))
    found = each.groupBy("professor", "j").agg(length(low).alias("a"), length(F.least(low + 1, F.col("total") - 1)).alias("b"), F.max(F.col("place") - low).alias("t"))
    wide = F.col("b") - F.col("a")
    between = F.when(F.col("t") >= 0.5, F.col("b") - wide * (1 - F.col("t"))).otherwise(F.col("a") + wide * F.col("t"))
    return found.select("professor", "j", between.alias("at"))


def nearest_picks(slim: DataFrame, k: int) -> DataFrame:
    """(professor, record_id, pick): for each of k even quantiles of length in turn the nearest note not chosen before; among equally
    near ones the smaller id. At most k - 1 notes are taken before, so the k nearest of each quantile are all that can
    be chosen: these few meet per professor, the others stay where they are."""
    rows = stored(slim.withColumn("_u", F.monotonically_increasing_id()), "lengths")
    near = rows.join(quantile_lengths(rows, k), "professor").withColumn("far", F.abs(F.col("n") - F.col("at")))
    first = W.partitionBy("professor", "j").orderBy("far", "record_id", "n", "_u")
    near = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k)
    lists = near.groupBy("professor").agg(F.array_sort(F.collect_list(F.struct("j", "r", "_u", "record_id"))).alias("all"))
    none = F.array().cast(lists.schema["all"].dataType)

    def choose(taken: Column, x: Column) -> Column:
        free = ~F.exists(taken, lambda y: (y["j"] == x["j"]) | (y["_u"] == x["_u"]))
        return F.when(free, F.concat(taken, F.array(x))).otherwise(taken)

    chosen = lists.select("professor", F.explode(F.aggregate("all", none, choose)).alias("x"))
    return chosen.select("professor", "x.record_id", (F.col("x.j") + 1).alias("pick"))


def selected(pool: DataFrame, k: int = 3, mode: str = "deterministic", seed: int = 1225) -> DataFrame:
    """k references of each professor with their pick (from 1). Deterministic: the nearest to even quantiles of length, one after
    another; random: drawn by a generator seeded with 'seed:professor', in the order of ids. A professor with k or fewer gives
    all, by id. Both count over ids and lengths; no professor's notes come together."""
    slim = pool.select("professor", "record_id", F.length("output").alias("n"))
    if mode != "deterministic":
        return drawn_rows(slim, "professor", k, seed, "record_id", "n").select("professor", "record_id", "pick")
    totals = slim.groupBy("professor").agg(F.count("*").alias("_n"))
    few, many = (slim.join(totals.where(which).select("professor"), "professor", "left_semi") for which in (F.col("_n") <= k, F.col("_n") > k))
    few = few.withColumn("pick", F.row_number().over(W.partitionBy("professor").orderBy("record_id", "n")))
    return few.select("professor", "record_id", "pick").unionByName(nearest_picks(many, k))


def style_references(pool: DataFrame, most: int = 12) -> DataFrame:
    """Up to ``most`` references of each professor at even ranks of (length, id): professor, record_id, output, pick. Ids and lengths
    are ranked; the notes of the chosen are joined to them."""
    own = W.partitionBy("professor")
    slim = pool.select("professor", "record_id", F.length("output").alias("_l"), F.xxhash64("output").alias("_h"))
    ranked = slim.withColumn("_r", F.row_number().over(own.orderBy("_l", "record_id", "_h")) - 1).withColumn("_n", F.count("*").over(own))
    steps = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i / F.lit(float(max(1, most - 1))) * (F.col("_n") - 1)).cast("int"))
    kept = ranked.where((F.col("_n") <= most) | F.array_contains(steps, F.col("_r")))
    kept = kept.withColumn("pick", F.row_number().over(own.orderBy("_r"))).select("professor", "record_id", "_h", "pick")
    texts = pool.withColumn("_h", F.xxhash64("output")).dropDuplicates(["professor", "record_id", "_h"])
    return texts.join(kept, ["professor", "record_id", "_h"]).select(*pool.columns, "pick")


def shortest_references(pool: DataFrame, most: int) -> DataFrame:
    """The ``most`` shortest references of each professor, ties by id: professor, record_id, output, pick."""
    ranked = pool.withColumn("pick", F.row_number().over(W.partitionBy("professor").orderBy(F.length("output"), "record_id")))
    return ranked.where(F.col("pick") <= most)


def reference_blocks(records: DataFrame, references: DataFrame, count: int = 3, limit: int = 8000) -> DataFrame:
    """professor, record_id, block: the first ``count`` references of the professor but for the record itself."""
    refs = references.select("professor", F.col("record_id").alias("ref_id"), F.col("output").alias("ref"), "pick")
    met = records.select("professor", "record_id").join(refs.where(F.col("pick") <= count + 1), "professor").where(F.col("ref_id") != F.col("record_id"))
    met = met.withColumn("_k", F.row_number().over(W.partitionBy("professor", "record_id").orderBy("pick"))).where(F.col("_k") <= count)
    one = F.concat(F.lit("[Reference "), F.col("_k").cast("string"), F.lit("]\n"), truncate_middle("ref", limit, unescaped=False))
    blocks = met.groupBy("professor", "record_id").agg(F.array_sort(F.collect_list(F.struct("_k", one.alias("b")))).alias("b"))
    out = records.select("professor", "record_id").join(blocks, ["professor", "record_id"], "left")
    text = F.array_join(F.transform("b", lambda x: x["b"]), "\n\n")
    return out.select("professor", "record_id", F.coalesce(F.nullif(text, F.lit("")), F.lit("(no reference)")).alias("block"))


def note_stats(notes: DataFrame, note: str = "output") -> DataFrame:
    """Style of each professor's notes: lengths, lines, how many have dates, short forms, bullets, numbered lines."""
    own, each = F.col(note), lines(note)
    rate = lambda c: F.avg(c.cast("int"))
    bullet = F.exists(each, lambda x: F.left(x, F.lit(1)).isin("-", "*", "•"))
    return notes.where(clean_scalar(note) != "").groupBy("professor").agg(
        F.count("*").alias("n_examples"),
        F.avg(F.length(own)).alias("mean_chars"),
        F.percentile(F.length(own), F.lit(0.5)).alias("median_chars"),
        F.avg(F.size(each)).alias("mean_lines"),
        F.percentile(F.size(each), F.lit(0.5)).alias("median_lines"),
        rate(own.rlike(DATE)).alias("date_rate"),
        rate(own.rlike(ABBREVIATION)).alias("abbreviation_rate"),
        rate(bullet).alias("bullet_rate"),
        rate(own.rlike("(?m)^\\s*\\d+[.)]")).alias("numbered_rate"),
    )


def top_values(values: DataFrame, most: int) -> DataFrame:
    """professor, value, n, rank of each professor's most frequent values (professor, value, at); ties: the first seen."""
    counted = values.groupBy("professor", "value").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy("professor").orderBy(F.col("n").desc(), "at", "value")))
    return ranked.where(F.col("rank") <= most).drop("at")


def first_lines(notes: DataFrame, note: str = "output", at: str = "row_index") -> DataFrame:
    return notes.select("professor", F.get(lines(note), F.lit(0)).alias("value"), F.col(at).alias("at")).where(F.col("value").isNotNull())


def abbreviations(notes: DataFrame, note: str = "output", at: str = "row_index") -> DataFrame:
    found = F.regexp_extract_all(F.col(note), F.lit(ABBREVIATION), F.lit(0))
    return notes.select("professor", F.explode(found).alias("value"), F.col(at).alias("at"))


def opening_line(notes: DataFrame, note: str = "output", at: str = "row_index") -> DataFrame:
    """professor, line: the first line that all notes of the professor share; no row where they don't."""
    counted = first_lines(notes, note, at).groupBy("professor", "value").agg(F.count("*").alias("n"))
    totals = notes.groupBy("professor").agg(F.count("*").alias("all"))
    return counted.join(totals, "professor").where(F.col("n") == F.col("all")).select("professor", F.col("value").alias("line"))

