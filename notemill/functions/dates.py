"""Dates in clinical text: calendar checks, mentions with a role, the date of a document, spellings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col, clean_scalar, match_normalize

MENTION = "struct<start:int,normalized_date:string,raw_text:string,role:string,context:string>"
#: Characters of context on either side, and for a year.
NEAR, YEAR_NEAR = 90, 500
#: Fixed value: the source of a missing date.
NO_DATE = "No explicit representative document date found."


def once(value: Column, step: Callable[[Column], Column]) -> Column:
    """step(value) with value computed once, where step uses it several times."""
    return F.get(F.transform(F.array(value), step), F.lit(0))


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """yyyy-MM-dd of a calendar date from 1900 to 2099, else null."""
    number = lambda x: x.try_cast("int")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")

    def of(x: Column) -> Column:
        y, m, d = x["y"], x["m"], x["d"]
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
        return F.when(y.between(1900, 2099) & m.between(1, 12) & (d >= 1) & (d <= days), F.concat(y.cast("string"), F.lit("-"), two(m), F.lit("-"), two(d)))

    return once(F.struct(number(year).alias("y"), number(month).alias("m"), number(day).alias("d")), of)


#: Fixed values: (role, terms of the lowered context, a term of the document's type), in the order of their precedence.
ROLES = (
    ("discharge_date", ("퇴원일",), ""),
    ("operation_date", ("수술일", "surg start", "operation date"), ""),
    ("operation_date", ("일자:",), "operative"),
    ("study_date", ("pft", "pulmonary function", "fvc", "fev1"), ""),
    ("prior_measurement_date", ("wt:", "bmi:", "weight"), ""),
    ("study_date", ("chest ct", "c.i.>", "[finding]"), ""),
    ("note_date", ("상담기록", "통화"), ""),
)
COMPARED, PLAIN = "comparison_date", "date_mention"


def role_in(context: str, raw: str, document_type: str) -> str:
    """What a mention is the date of: of a comparison, else the first of ROLES that holds, else a plain mention."""
    low, kind, said = context.lower(), document_type.lower(), raw.split()[0]
    if "compar" in low and (f"compared with {said}" in low or said in low.partition("comparison ")[2]):  # contexts have single spaces
        return COMPARED
    return next((role for role, terms, of_kind in ROLES if of_kind in kind and any(t in low for t in terms)), PLAIN)


def is_plain(text: Column) -> Column:
    """Whether all digits of a text are ASCII, as the scanner needs."""
    return (F.octet_length(text) == F.char_length(text)) | ~F.rlike(text, F.lit("[\\p{Nd}&&[^0-9]]"))


# ---------------------------------------------------------------- all spellings


def _iso(year: int | None, month: str, day: str) -> str | None:
    try:
        return date(year, int(month), int(day)).isoformat() if year and 1900 <= year <= 2099 else None
    except ValueError:
        return None


#: Spellings in order of precedence; a later one never overlaps an accepted mention.
SPELLINGS = (
    ("dashed", re.compile(r"(?<!\d)(20\d{2}|19\d{2})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)")),
    ("spaced", re.compile(r"(?<!\d)(20\d{2}|19\d{2})\s+(\d{1,2})\s+(\d{1,2})(?!\d)")),
    ("six", re.compile(r"(?<!\d)(\d{2})(\d{2})(\d{2})(?!\d)")),
    ("bracketed", re.compile(r"(?<=\()(?<![\d.])(\d{1,2})[.](\d{1,2})(?![\d.])(?=\))")),
)
_YEAR = re.compile(r"(?<!\d)(20\d{2}|19\d{2})(?!\d)")


def year_near(text: str, at: int) -> int | None:
    """The last year written within reach; else that of the last six-digit date there."""
    around = text[max(0, at - YEAR_NEAR) : at + YEAR_NEAR]
    if written := _YEAR.findall(around):
        return int(written[-1])
    six = [2000 + int(y) for y, m, d in SPELLINGS[2][1].findall(around) if _iso(2000 + int(y), m, d)]
    return six[-1] if six else None


def mentions_of(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, ISO date, raw text) of every accepted mention, by position."""
    taken: list[tuple[int, int, str, str]] = []
    for name, pattern in SPELLINGS:
        for m in pattern.finditer(text):
            if name != "dashed" and any(m.start() < end and m.end() > start for start, end, _, _ in taken):
                continue
            if name == "bracketed":
                found, raw = _iso(year_near(text, m.start()), m[1], m[2]), f"{m[0]} (year inferred)"
            else:
                found, raw = _iso(int(m[1]) + (2000 if name == "six" else 0), m[2], m[3]), m[0]
            if found:
                taken.append((m.start(), m.end(), found, raw))
    return sorted(taken, key=lambda x: x[0])


def distinct_mentions(text: str, document_type: str) -> list[dict]:
    """Mentions in text order, the first of each (date, raw text, role)."""
    out: dict[tuple[str, str, str], dict] = {}
    for a, b, day, raw in mentions_of(text):
        context = " ".join(text[max(0, a - NEAR) : b + NEAR].split())
        role = role_in(context, raw, document_type)
        out.setdefault((day, raw, role), {"start": a, "normalized_date": day, "raw_text": raw, "role": role, "context": context})
    return list(out.values())


def all_mentions(text: Column, document_type: Column) -> Column:
    """array of mentions in text order, the first of each (date, raw text, role). A null text has none, a null type counts as empty.

    Texts with digits go to Python in Arrow batches: a scan for each spelling there is faster by far than lambdas, which Spark interprets.
    """
    text, kind = F.coalesce(text, F.lit("")), F.coalesce(document_type, F.lit(""))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        fields = [("start", pa.int32()), ("normalized_date", pa.string()), ("raw_text", pa.string()), ("role", pa.string()), ("context", pa.string())]
        for texts, kinds in batches:
            yield pa.array([distinct_mentions(t, k) if t else [] for t, k in zip(texts.to_pylist(), kinds.to_pylist())], pa.list_(pa.struct(fields)))

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, f"array<{MENTION}>")(F.when(F.rlike(text, F.lit("\\p{Nd}")), text), kind)


def document_date(mentions: Column, document_type: Column) -> Column:
    """struct<document_date, date_confidence, date_source>: by the document's type, else the first mention that is neither
    a comparison nor an earlier measurement, else missing."""
    kind = F.lower(document_type)
    has = lambda *terms: F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(kind, t))

    def first(role: str) -> Column:
        return F.get(F.filter(mentions, lambda m: m["role"] == role), F.lit(0))

    def picked(m: Column, why: Column) -> Column:
        return F.when(m.isNotNull(), F.struct(m["normalized_date"].alias("document_date"), why.alias("date_confidence"), m["context"].alias("date_source")))

    other = F.get(F.filter(mentions, lambda m: ~m["role"].isin("comparison_date", "prior_measurement_date")), F.lit(0))
    missing = F.struct(F.lit(None).cast("string").alias("document_date"), F.lit("missing").alias("date_confidence"), F.lit(NO_DATE).alias("date_source"))
    return F.coalesce(
        F.when(has("operative", "operation"), picked(first("operation_date"), F.lit("explicit_operation_date"))),
        F.when(has("discharge"), picked(first("discharge_date"), F.lit("explicit_discharge_date"))),
        F.when(has("outpatient", "consult", "clinic"), picked(first("note_date"), F.lit("explicit_note_date"))),
        picked(other, F.concat(F.lit("fallback_"), other["role"])),
        missing,
    )


def date_variants(c: Column | str) -> Column:
    """Spellings under which a date may stand in the evidence, as a distinct array."""
    return F.array_distinct(_spellings(c, lambda t: t))


def _spellings(c: Column | str, shown: Callable[[Column], Column]) -> Column:
    """The same with repeats; the date as given goes through shown. Each step binds what the next one uses often."""
    cleaned = F.regexp_replace(clean_scalar(c), "^'+|'+\\z", "")
    return once(once(cleaned, lambda t: F.struct(shown(t).alias("t"), F.split(t, "[-./]").alias("parts"))), _spelled_apart)


def _spelled_apart(x: Column) -> Column:
    t, parts = x["t"], x["parts"]
    part = lambda k: F.try_element_at(parts, F.lit(k))
    seen = F.struct(F.size(parts).alias("n"), *(part(k).try_cast("int").alias(f"v{k}") for k in (1, 2, 3)), *(F.length(part(k)).alias(f"l{k}") for k in (1, 3)))

    def dated(s: Column) -> Column:
        four_last = (s["n"] >= 3) & (s["l3"] == 4)
        year = F.when(s["l1"] == 4, s["v1"]).when(four_last, s["v3"]).otherwise(2000 + s["v1"])
        day = F.when((s["n"] >= 3) & ((s["l1"] == 4) | ~four_last), s["v3"])
        readable = s["v1"].isNotNull() & s["v2"].isNotNull() & F.coalesce((s["n"] < 3) | s["v3"].isNotNull(), F.lit(False))
        return F.struct(readable.alias("readable"), year.cast("string").alias("y"), s["v2"].cast("string").alias("m"), day.cast("string").alias("d"))

    def more(p: Column) -> Column:
        y, m, d, yy = p["y"], p["m"], p["d"], F.substring(p["y"], 3, 10)
        two = lambda v: F.lpad(v, 2, "0")
        short = F.array(*(F.concat(a, F.lit(s), b) for a, s, b in ((y, "-", two(m)), (y, ".", two(m)), (yy, ".", m), (yy, "-", m))))
        full = F.array(*(F.concat_ws(s, y, two(m), two(d)) for s in "-./"), *(F.concat_ws(s, yy, m, d) for s in ".-/"))
        return F.when(~p["readable"], F.array().cast("array<string>")).when(d.isNull(), short).otherwise(full)

    basic = F.array(t, F.replace(t, F.lit("."), F.lit("-")), F.replace(t, F.lit("."), F.lit("/")), F.replace(t, F.lit("-"), F.lit(".")), F.replace(t, F.lit("/"), F.lit(".")))
    return F.when(F.size(parts) < 2, F.array(t)).otherwise(F.concat(basic, once(once(seen, dated), more)))


def date_supported(claim: Column | str, evidence: Column | str) -> Column:
    """Whether normalised evidence holds the date in any of its spellings. Both are computed once, not for each spelling, and the
    date is normalised before it is spelled: other spellings are digits and signs, which normalising leaves as they are."""

    def held(x: Column) -> Column:
        return F.contains(x["e"], match_normalize(x["c"])) | F.exists(_spellings(x["c"], match_normalize), lambda v: F.contains(x["e"], v))

    return once(F.struct(as_col(claim).alias("c"), as_col(evidence).alias("e")), held)
