"""Scalar text functions as Column expressions; two that Spark lacks (NFC, strict JSON) run over Arrow batches."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Python's str.strip, as a Java class and as characters, and the line ends of str.splitlines.
SPACE = "[\\s\\x1C-\\x1F]"
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"
#: Words that stand for a missing cell.
MISSING = ("nan", "none", "nat")
MARK = "\n...[TRUNCATED]...\n"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim(c: Column | str) -> Column:
    return F.btrim(as_col(c), F.lit(BLANKS))


def ltrim(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANKS))


def rtrim(c: Column) -> Column:
    return F.rtrim(c, F.lit(BLANKS))


def collapse(c: Column | str) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(as_col(c), f"(?U){SPACE}+", " ")


def unescape(c: Column) -> Column:
    """Escapes written out in letters become the characters."""
    for literal, char in (("\\r\\n", "\n"), ("\\n", "\n"), ("\\t", "\t")):
        c = F.replace(c, F.lit(literal), F.lit(char))
    return c


def clean_scalar(c: Column | str, unescaped: bool = True) -> Column:
    """Trimmed text; null and the words for a missing cell become empty."""
    t = trim(F.coalesce(as_col(c).cast("string"), F.lit("")))
    return F.when(F.lower(t).isin(*MISSING), "").otherwise(unescape(t) if unescaped else t)


def match_normalize(c: Column | str) -> Column:
    """For comparison: case folded (sharp s included), white space collapsed, trimmed."""
    folded = F.replace(F.replace(F.lower(as_col(c)), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))
    return trim(collapse(folded))


def truncate_middle(c: Column | str, limit: int, unlimited: bool = False, unescaped: bool = True) -> Column:
    """At most about ``limit`` characters of a cleaned text: its start, a mark, its end. limit <= 0 gives an empty text,
    or with ``unlimited`` the whole text. Limits too small for an end keep the start and the mark."""
    t = clean_scalar(c, unescaped)
    if limit <= 0:
        return t if unlimited else F.when(t.isNotNull(), "")
    left = limit // 2
    right = max(0, limit - left - 32)
    end = ltrim(F.right(t, F.lit(right))) if right else F.lit("")
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(rtrim(F.left(t, F.lit(left))), F.lit(MARK), end))


def lines(c: Column | str) -> Column:
    """Trimmed lines that are not empty, as an array."""
    return F.filter(F.transform(F.split(as_col(c), LINE_END), trim), lambda x: x != "")


def strip_thinking(c: Column | str) -> Column:
    """Without think blocks (an open one reaches to the end) and without a code fence around the rest."""
    t = trim(F.regexp_replace(as_col(c), "(?is)<think>.*?(?:</think>|\\z)", ""))
    t = trim(F.regexp_replace(t, f"(?U)^```[a-zA-Z0-9_-]*{SPACE}*", ""))
    return trim(F.regexp_replace(t, f"(?U){SPACE}*```\\z", ""))


def strict_json(c: Column | str) -> Column:
    """The text as canonical JSON if all of it is JSON (NaN allowed, the last of equal keys wins), else null. No function of an
    iterator of batches: of those, each cell's would pass all rows through a worker of its own."""
    write = json.JSONEncoder(ensure_ascii=False).encode

    def canonical(text):
        try:
            return write(json.loads(text))
        except (ValueError, TypeError, RecursionError):
            return None

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else canonical(t) for t in texts.to_pylist()], pa.string())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(as_col(c))


def nfc(c: Column | str) -> Column:
    """Unicode normal form C."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(as_col(c))


#: Keys under which a model wraps its note, best first.
NOTE_KEYS = ("Description", "description", "note", "outpatient_note", "generated_note", "output", "Output")


def unwrap_note(c: Column | str, trusted: bool = False) -> Column:
    """struct<note, warning> of a model's reply that may be JSON around the note. ``trusted`` skips the strict parse of
    replies that are known to be either JSON as a whole or no JSON at all."""
    t = strip_thinking(c)
    json_text = F.when(F.left(t, F.lit(1)).isin("{", '"', "["), t) if trusted else strict_json(t)
    v = F.try_parse_json(json_text)
    kind = F.schema_of_variant(v)
    fields = F.from_json(F.when(kind.startswith("OBJECT"), F.to_json(v)), "map<string,variant>")
    words = lambda x: clean_scalar(F.try_variant_get(x, "$", "string"))
    texts = F.map_filter(fields, lambda k, x: (F.schema_of_variant(x) == "STRING") & (words(x) != ""))
    found = F.lit(None).cast("struct<note:string,warning:string>")
    note = lambda x, why: F.struct(x.alias("note"), F.lit(why).alias("warning"))
    for key in reversed(NOTE_KEYS):
        value = F.try_element_at(texts, F.lit(key))
        found = F.when(value.isNotNull(), note(words(value), f"unwrapped JSON field: {key}")).otherwise(found)
    single = F.when(F.size(texts) == 1, note(words(F.map_values(texts)[0]), "unwrapped single-string JSON object"))
    plain = F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))
    whole = F.when(clean_scalar(plain) != "", note(clean_scalar(plain), "unwrapped JSON string"))
    return F.coalesce(found, single, whole, F.struct(t.alias("note"), F.lit(None).cast("string").alias("warning")))


#: What a style prompt must not tell the note writer.
META_RULES = ("ensure output is valid json only", "return valid json only", "output valid json only", "no markdown")


def sanitize_style(c: Column | str) -> Column:
    t = clean_scalar(c)
    for rule in META_RULES:
        t = F.regexp_replace(t, f"(?i)\\b{rule}\\.?", "")
    return trim(F.regexp_replace(t, "\\n{3,}", "\n\n"))


#: Fragments of lines that say nothing about a patient.
GENERIC = ("<|section_start|>", "<|section_end|>", "description <-", "description", "소견", "postop 1st visit")


def is_generic(line: Column) -> Column:
    out = F.lit(False)
    for fragment in GENERIC:
        out = out | F.contains(line, F.lit(fragment))
    return out


def tail(c: Column | str, n: int = 6000) -> Column:
    return F.right(as_col(c), F.lit(n))


def html_escape(c: Column | str) -> Column:
    c = as_col(c)
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def slug(c: Column | str, default: str = "run", longest: int = 64, normalized: bool = False) -> Column:
    """A name for files that keeps Hangul. ``normalized``: the text is in normal form C already."""
    c = F.coalesce(as_col(c), F.lit(""))
    t = trim(c if normalized else nfc(c))
    t = F.regexp_replace(collapse(t), " ", "_")
    t = F.regexp_replace(t, "(?U)[^\\w가-힣.-]+", "_")
    t = F.regexp_replace(t, "^[._-]+|[._-]+\\z", "")
    return F.left(F.when(t == "", default).otherwise(t), F.lit(longest))


def short_hash(c: Column | str, n: int = 10) -> Column:
    """The first digits of the SHA-256 of a text in UTF-8 with a byte order mark."""
    return F.left(text_hash(c), F.lit(n))


def text_hash(c: Column | str, bom: bool = True) -> Column:
    return F.sha2(F.concat(F.lit("\ufeff"), as_col(c)) if bom else as_col(c), 256)


def redacted(c: Column | str) -> Column:
    t = F.coalesce(as_col(c).cast("string"), F.lit(""))
    return F.when(t == "", "").otherwise(F.concat(F.lit("[redacted, "), F.length(t), F.lit(" chars]")))


#: Fixed values.
MIME = {
    "csv": "text/csv",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "json": "application/json",
    "jsonl": "application/x-ndjson",
}


def mime(name: Column | str) -> Column:
    suffix = F.lower(F.regexp_extract(as_col(name), "\\.([^./]+)\\z", 1))
    out = F.lit("application/octet-stream")
    for k, v in MIME.items():
        out = F.when(suffix == k, v).otherwise(out)
    return out


def professor_of(file_name: Column | str) -> Column:
    """A workbook's professor: its name without suffix and a closing _All."""
    return F.regexp_replace(F.regexp_replace(as_col(file_name), "^.*/|\\.[^.]*\\z", ""), "_All\\z", "")


#: Patterns of clinical notes.
DATE = "(?U)\\b(?:\\d{4}[-./]\\d{1,2}(?:[-./]\\d{1,2})?|\\d{1,2}[-./]\\d{1,2}[-./]\\d{2,4}|'\\d{2}[.-]\\d{1,2}[.-]\\d{1,2})\\b"
NUMBER = "(?iU)(?<![A-Za-z])\\b\\d+(?:\\.\\d+)?\\s*(?:cm|mm|mg|g|ml|l|%|회|일|주|개월|년)?\\b"
TERMS = (
    "cancer", "carcinoma", "adenocarcinoma", "sarcoma", "tumou?r", "mass", "lesion", "nodule", "metastasis", "metastatic", "recurrence", "recurrent",
    "stage", "staging", "tnm", "benign", "malignant", "pathology", "biopsy", "margin", "lymph", "node", "hypertension", "diabetes", "hbv", "hcv", "tbc",
    "tuberculosis", "vats", "thoracotomy", "lobectomy", "segmentectomy", "wedge", "resection", "enucleation", "operation", "surgery", "postop", "preop",
    "chemotherapy", "radiotherapy", "radiation", "ct", "mri", "pet", "egd", "pft", "usg", "x-ray", "xray",
    "[A-Za-z]+(?:mab|cillin|cycline|azole|pril|sartan|statin|platin)",
)
MEDICAL_TERM = f"(?iU)\\b({'|'.join(TERMS)})\\b"
SHORT_FORMS = (
    "s/p", "d/t", "R/O", "r/o", "postop", "post-op", "POD", "f/u", "F/U", "BCS", "SLNB", "ALND", "MRM", "TM", "TE", "ADM", "NAC", "RTx", "CTx", "HTx",
    "LAR", "AR", "APR", "RHC", "LHC", "TC", "IRA", "TME", "ISR", "stoma", "AVF", "AVG", "VATS", "RUL", "RML", "RLL", "LUL", "LLL", "LN", "Bx", "OP", "op",
    "rec", "fu",
)
ABBREVIATION = f"(?iU)\\b({'|'.join(SHORT_FORMS)})\\b"
