"""What a note writer sees of one record: bundles of facts or of the raw text, with a hash over their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_col, clean_scalar, strict_json, text_hash, truncate_middle
from . import facts as f
from .records import head, record_id, require

#: Columns that hold facts, best first; readable columns that go along; parts of names of raw sources that do not.
FACT_COLUMNS = ("Extracted_Facts", "extracted_facts", "facts", "fact_json", "Fact_JSON")
READABLE_COLUMNS = ("Extracted_Facts_Readable", "Stage2_Final_Summary", "Verification_Summary")
SOURCE_HINTS = ("input", "sorted_timeline", "verification_report")
#: Characters of a readable column and of a fact's evidence.
READABLE_CHARS, EVIDENCE_CHARS = 2500, 260


def json_cell(c: Column | str, trusted: bool = False) -> Column:
    """VARIANT of a cleaned cell that begins with [ or { and is JSON as a whole, else null. ``trusted`` skips the strict parse of
    cells that are known to be JSON as a whole if they begin so."""
    t = as_col(c)
    text = F.when(F.left(t, F.lit(1)).isin("[", "{"), t)
    return F.try_parse_json(text if trusted else strict_json(text))


def is_fact_cell(x: Column) -> Column:
    """Whether a parsed cell (struct of v, known: a preferred name, named: fact in its name) holds facts: by its name, by the key
    all_facts, by what the first items of a list have, or by fact in its name."""
    kind = F.schema_of_variant(x["v"])
    first = F.slice(F.coalesce(F.try_variant_get(x["v"], "$", "array<variant>"), F.array().cast("array<variant>")), 1, 3)
    has = lambda item, k: F.try_variant_get(item, f"$.{k}", "variant").isNotNull()
    listed = f.bound(first, lambda ys: (F.size(ys) > 0) & F.forall(ys, f.is_fact) & F.exists(ys, lambda y: has(y, "fact") | has(y, "evidence") | has(y, "category")))
    named = x["named"] & (kind.startswith("OBJECT") | kind.startswith("ARRAY"))
    all_facts = kind.startswith("OBJECT") & F.try_variant_get(x["v"], "$.all_facts", "variant").isNotNull()
    return x["v"].isNotNull() & (x["known"] | F.coalesce(all_facts | listed | named, F.lit(False)))


def compact_item(item: Column, evidence_chars: int) -> Column:
    """A fact as JSON text with its known fields that are not empty, keys in order; what is no object as it is. A fact is read by
    one cast, and each field is bound before it is cut and before it is written."""
    names = sorted(f.FIELDS)

    def written(fact: Column) -> Column:
        clean = F.transform(F.array(*(fact[k] for k in names)), lambda x: F.when(x.isNull(), "").otherwise(clean_scalar(x)))
        cut = F.transform(clean, lambda x, i: F.when((i == names.index("evidence")) & (x != ""), truncate_middle(x, evidence_chars)).otherwise(x))
        text = f.bound(cut, lambda xs: _object_of({k: xs[i] for i, k in enumerate(names)}))
        return F.when(fact.isNotNull(), text).otherwise(F.to_json(item))

    return f.bound(F.try_variant_get(item, "$", f.FACT), written)  # null for what is no object


def _object_of(cells: dict[str, Column]) -> Column:
    """JSON of an object of texts, keys in order; null and empty texts are left out."""
    return F.to_json(F.struct(*(F.when(cells[k] != "", cells[k]).alias(k) for k in sorted(cells))), {"ignoreNullFields": "true"}) if cells else F.lit("{}")


def selected(df: DataFrame, professor: str | None, most: int | None, column: str = "Professor_ID", index: str = "row_index") -> DataFrame:
    """Rows of one professor, and of these the first ``most``; an error if none is left."""
    out = df
    if professor:
        out = require(df, column).where(clean_scalar(column) == professor)
    if most is not None:
        if most < 0:
            raise ValueError("the number of rows must not be negative")
        out = head(out, most, index) if most else out.where("false")
    if out.isEmpty():
        raise ValueError("no rows are selected")
    return out


def fact_bundles(df: DataFrame, index: str = "row_index", professor: str = "Professor_ID", with_professor: bool = True, most_facts: int = 0, evidence_chars: int = EVIDENCE_CHARS, trusted: bool = False) -> DataFrame:
    """row_index, record_id, professor, primary_fact_column, n_facts, n_sent, evidence (JSON that the writer sees), bundle_hash.

    Cells are cleaned; empty ones are not seen. Facts are those of the primary fact column, compacted, the first most_facts if
    positive. Readable columns go along cut to READABLE_CHARS, and all other cells but JSON and raw sources.
    with_professor=False leaves the professor out of what the writer sees. ``trusted``: cells that begin as JSON are JSON.
    """
    columns = [c for c in df.columns if c != index]
    clean = df.select(index, *(clean_scalar(F.col(f"`{c}`")).alias(c) for c in columns))
    known = {x.lower() for x in FACT_COLUMNS}
    hidden = [c for c in columns if any(h in c.lower() for h in SOURCE_HINTS)]
    # cell k of a row is c<k>, its text cleaned again t<k>, its JSON v<k>; each select binds what the next one uses several times
    at = {c: k for k, c in enumerate(columns)}
    value, parsed = {c: F.col(f"c{k}") for c, k in at.items()}, {c: F.col(f"v{k}") for c, k in at.items()}
    rows = clean.select(
        F.col(index).alias("row_index"), record_id(clean.drop(index)).alias("record_id"), (F.col(f"`{professor}`") if professor in columns else F.lit("")).alias("professor"),
        *(F.col(f"`{c}`").alias(f"c{k}") for c, k in at.items()), *(clean_scalar(F.col(f"`{c}`")).alias(f"t{k}") for c, k in at.items()),
    )
    rows = rows.select("row_index", "record_id", "professor", *value.values(), *(json_cell(f"t{k}", trusted).alias(f"v{k}") for k in at.values()))
    holds = lambda c: is_fact_cell(F.struct(parsed[c].alias("v"), F.lit(c.lower() in known).alias("known"), F.lit("fact" in c.lower()).alias("named")))
    ranked = sorted(columns, key=lambda c: FACT_COLUMNS.index(c) if c in FACT_COLUMNS else len(FACT_COLUMNS))
    rows = rows.withColumn("primary", F.coalesce(*(F.when(holds(c), c) for c in ranked)))
    rows = rows.withColumn("primary_v", F.coalesce(*(F.when(F.col("primary") == c, parsed[c]) for c in ranked)))
    rows = rows.withColumn("items", f.fact_list(F.col("primary_v")))
    sent = F.slice("items", 1, most_facts) if most_facts > 0 else F.col("items")
    # a text that is empty only once cut goes along, unlike one that is not seen
    short = lambda c: F.when(value[c] != "", truncate_middle(value[c], READABLE_CHARS)).alias(c)
    readable = [short(c) for c in sorted(READABLE_COLUMNS) if c in at]
    rows = rows.select(
        "row_index", "record_id", "professor", F.coalesce("primary", F.lit("")).alias("primary_fact_column"), F.size("items").alias("n_facts"), F.size(sent).alias("n_sent"),
        F.concat(F.lit("["), F.array_join(F.transform(sent, lambda x: compact_item(x, evidence_chars)), ","), F.lit("]")).alias("facts"),
        _object_of({c: F.when(parsed[c].isNull(), value[c]) for c in columns if c not in hidden}).alias("fields"),
        (F.to_json(F.struct(*readable), {"ignoreNullFields": "true"}) if readable else F.lit("{}")).alias("texts"),
        F.to_json(F.array_compact(F.array(*(F.when(value[c] != "", c) for c in columns)))).alias("seen"),
    )
    text = lambda x: F.regexp_extract(F.to_json(F.array(x)), "(?s)^.(.*).\\z", 1)
    parts = {
        "extracted_fact_count_sent": F.col("n_sent").cast("string"), "extracted_fact_count_total": F.col("n_facts").cast("string"), "extracted_facts": F.col("facts"), "primary_fact_column": text(F.col("primary_fact_column")),
        "readable_fact_summaries": F.col("texts"), "row_fields": F.col("fields"), "schema_observed_columns": F.col("seen"),
    }
    named = lambda c: text(F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown")))
    told = parts | {"record_id": named("record_id"), "row_index": F.col("row_index").cast("string")} | ({"professor": named("professor")} if with_professor else {})
    material = {"facts": _object(parts), "professor": text(F.col("professor")), "record_id": text(F.col("record_id")), "row_index": F.col("row_index").cast("string")}
    if not with_professor:
        del material["professor"]
    return rows.select("row_index", "record_id", "professor", "primary_fact_column", "n_facts", "n_sent", _object(told).alias("evidence"), text_hash(_object(material)).alias("bundle_hash"))


def _object(parts: dict[str, Column]) -> Column:
    """JSON of an object from the JSON of its values, keys in order."""
    inner = [F.concat(F.lit(f'"{k}":'), parts[k]) for k in sorted(parts)]
    return F.concat(F.lit("{"), F.concat_ws(",", *inner), F.lit("}"))


def raw_bundles(df: DataFrame, method: str, index: str = "row_index", professor: str = "Professor_ID", record: str = "수술ID", text: str = "Input", most_chars: int = 0) -> DataFrame:
    """row_index, record_id, professor, evidence (the raw text, cut in its middle if longer than most_chars > 0), chars,
    truncated, bundle_hash."""
    require(df, professor, record, text)
    whole = clean_scalar(F.col(text))
    rows = df.select(F.col(index).alias("row_index"), clean_scalar(F.col(record)).alias("record_id"), clean_scalar(F.col(professor)).alias("professor"), whole.alias("_whole"))
    long = F.length("_whole") > most_chars if most_chars > 0 else F.lit(False)
    cut = F.when(long, truncate_middle("_whole", most_chars)).otherwise(F.col("_whole")) if most_chars > 0 else F.col("_whole")
    rows = rows.select("row_index", "record_id", "professor", cut.alias("evidence"), F.length("_whole").alias("chars"), long.alias("truncated"))
    material = F.to_json(F.struct(F.lit(method).alias("method"), F.col("evidence").alias("raw_text"), "record_id", "row_index"))
    return rows.withColumn("bundle_hash", text_hash(material))
