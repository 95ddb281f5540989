"""Judging notes: cache keys, verdict counts, pairwise style, and the three metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.text import text_hash

#: Methods in the order of the tables, and the method that style is compared with.
METHODS = (("raw_to_note", "Raw-to-Note"), ("raw_fact_to_note", "Raw-to-Fact-to-Note"), ("chunk_fact_to_note", "Chunk-to-Fact-to-Note"), ("iterative_fact_to_note", "Iterative Multi-Agent Fact-to-Note"), ("ours", "Ours"))
PASS = 4


def cache_key(model: Column, task: Column, system: Column, user: Column) -> Column:
    """SHA-256 of the call as JSON with sorted keys."""
    return text_hash(F.to_json(F.struct(model.alias("model"), system.alias("system"), task.alias("task"), user.alias("user"))), bom=False)


def with_cache(calls: DataFrame, cache: DataFrame) -> DataFrame:
    """calls (with key) and their remembered response, null where there is none. The first response of a key counts."""
    first = cache.groupBy("key").agg(F.min("response").alias("response"))
    return calls.join(first, "key", "left")


def digest(task: Column | str, user: Column) -> Column:
    """A number below 2^32 from a call, by which the offline judge answers."""
    task = F.lit(task) if isinstance(task, str) else task
    return F.conv(F.left(text_hash(F.concat(task, user), bom=False), F.lit(8)), 16, 10).cast("bigint")


def offline_faithfulness(user: Column) -> Column:
    """struct<likert, n_claims, n_unsupported>."""
    n = digest("faithfulness", user)
    bad = n % 5 == 0
    return F.struct(F.when(bad, 2).otherwise(3 + n % 3).cast("int").alias("likert"), F.when(bad, 2).otherwise(1).alias("n_claims"), F.when(bad, 1).otherwise(0).alias("n_unsupported"))


def offline_completeness(user: Column) -> Column:
    """struct<n_critical, n_absent, n_partial>."""
    absent = digest("completeness", user) % 4 == 0
    return F.struct(F.lit(2).alias("n_critical"), F.when(absent, 1).otherwise(0).alias("n_absent"), F.lit(0).alias("n_partial"))


def offline_winner(user: Column) -> Column:
    return F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("tie")), (digest("style", user) % 3 + 1).cast("int"))


def likert(v: Column) -> Column:
    """1 to 5 from a reply's number, 1 for anything else; text is no number."""
    n = F.when(F.schema_of_variant(v).isin("BIGINT", "DOUBLE") | F.schema_of_variant(v).startswith("DECIMAL"), F.try_variant_get(v, "$", "double"))
    whole = F.floor(n)
    return F.when(whole.between(1, 5), whole).otherwise(1).cast("int")


def faithfulness(v: Column) -> Column:
    """struct<likert, n_claims, n_unsupported, n_mixing> of a reply (variant)."""
    items = F.coalesce(F.try_variant_get(v, "$.claims", "array<variant>"), F.array().cast("array<variant>"))
    bad = F.filter(items, lambda c: F.try_variant_get(c, "$.verdict", "string") == "unsupported")
    mixed = F.filter(bad, lambda c: F.lower(F.trim(F.try_variant_get(c, "$.error_type", "string"))) == "patient_mixing")
    return F.struct(likert(F.try_variant_get(v, "$.faithfulness_likert", "variant")).alias("likert"), F.size(items).alias("n_claims"), F.size(bad).alias("n_unsupported"), F.size(mixed).alias("n_mixing"))


def completeness(v: Column) -> Column:
    """struct<n_critical, n_absent, n_partial, complete_strict, complete_lenient>; without facts neither is complete."""
    items = F.coalesce(F.try_variant_get(v, "$.critical_facts", "array<variant>"), F.array().cast("array<variant>"))
    status = F.transform(F.filter(items, lambda x: F.schema_of_variant(x).startswith("OBJECT")), lambda x: F.lower(F.trim(F.coalesce(F.try_variant_get(x, "$.status", "string"), F.lit("")))))
    count = lambda s: F.size(F.filter(status, lambda x: x == s))
    some = F.size(status) > 0
    return F.struct(F.size(status).alias("n_critical"), count("absent").alias("n_absent"), count("partial").alias("n_partial"), (some & (count("absent") == 0) & (count("partial") == 0)).alias("complete_strict"), (some & (count("absent") == 0)).alias("complete_lenient"))


def style_score(note: Column, other: Column, winner_first: Column, winner_second: Column) -> Column:
    """Mean of two rounds with swapped places: win 1, tie 0.5; an empty note loses, two empty ones tie."""
    won = lambda w, own: F.when(F.upper(w) == "TIE", 0.5).when(F.upper(w) == own, 1.0).otherwise(0.0)
    return F.when((note == "") & (other == ""), 0.5).when(note == "", 0.0).when(other == "", 1.0).otherwise((won(winner_first, "A") + won(winner_second, "B")) / 2)


def with_verdicts(judged: DataFrame, passing: int = PASS) -> DataFrame:
    """Flags of a judged note (likert, n_unsupported, n_absent, n_partial, empty_note); an empty note passes nothing."""
    full = ~F.col("empty_note")
    return judged.withColumns({
        "hallucination_free": full & (F.col("n_unsupported") == 0),
        "faithful_pass": full & (F.col("likert") >= passing),
        "faithful_borderline": full & (F.col("likert") == 3),
        "complete_strict": full & (F.col("n_absent") == 0) & (F.col("n_partial") == 0),
        "complete_lenient": full & (F.col("n_absent") == 0),
    })


def _percent(c) -> Column:
    return F.round(100 * F.avg(F.col(c).cast("int") if isinstance(c, str) else c.cast("int")), 6)


def quality_table(judged: DataFrame, by: str = "method") -> DataFrame:
    """Faithfulness, completeness and style of each method; style scores that are null don't count."""
    return judged.groupBy(by).agg(
        F.count("*").alias("n"),
        _percent("faithful_pass").alias("faithful_pass_pct"),
        _percent("faithful_borderline").alias("faithful_borderline_pct"),
        _percent("hallucination_free").alias("hallucination_free_pct"),
        F.round(F.avg("n_unsupported"), 6).alias("unsupported_per_note"),
        _percent("complete_strict").alias("critical_complete_pct"),
        _percent("complete_lenient").alias("critical_complete_lenient_pct"),
        F.round(100 * F.avg("style_score"), 6).alias("style_win_pct"),
        F.count("style_score").alias("style_n"),
    )


def error_table(judged: DataFrame, by: str = "method") -> DataFrame:
    """Errors of each method: per note, and the share of notes that have any. Counts that are no numbers are 0."""
    kinds = (("n_unsupported", "unsupported", "unsupported"), ("n_absent", "missing", "missing"), ("n_mixing", "patient_mixing", "mixing"))
    number = lambda c: F.coalesce(F.col(c).cast("string").try_cast("int"), F.lit(0))
    out = [F.count("*").alias("n"), F.count_distinct("record_id").alias("n_records")]
    for column, name, short in kinds:
        out += [F.round(F.avg(number(column)), 6).alias(f"{name}_per_note"), _percent(number(column) > 0).alias(f"notes_with_{short}_pct")]
    return judged.groupBy(by).agg(*out)


def worst_examples(judged: DataFrame, most: int = 5) -> DataFrame:
    """The worst notes of each method by 100 mixing + 10 unsupported + missing; ties by record id."""
    severity = 100 * F.col("n_mixing") + 10 * F.col("n_unsupported") + F.col("n_absent")
    ranked = judged.withColumn("severity", severity).withColumn("rank", F.row_number().over(W.partitionBy("method").orderBy(F.col("severity").desc(), "record_id")))
    return ranked.where(F.col("rank") <= most)


def in_order(table: DataFrame, order: list[str], by: str = "method") -> DataFrame:
    """Rows in the declared order of methods, with it as ``ord``."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(by)).cast("int")
    return table.withColumn("ord", place).where(F.col("ord") > 0).orderBy("ord")
