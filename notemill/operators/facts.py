"""Extracted facts: parsed from JSON, compacted, categorised, completed, pruned, verified, rolled up and rendered."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import as_col, clean_scalar, strict_json, trim, truncate_middle

FIELDS = ("category", "date", "fact", "evidence", "confidence", "source_document")
FACT = f"struct<{','.join(f'{x}:string' for x in FIELDS)}>"
NO_FACTS = f"array<{FACT}>"
ISSUES = ("unsupported_facts", "missing_facts", "contradictions", "date_errors", "clinical_accuracy_issues")
COVERAGE, EVIDENCE = 0.85, 0.95


# ---------------------------------------------------------------- parsing


def json_object(c: Column | str, trusted: bool = False) -> Column:
    """VARIANT of the object in a model's reply, stray strings joined where that makes it JSON: the whole text, else from the
    first { to the last }."""
    t = trim(F.regexp_replace(as_col(c), "<unused\\d+>", ""))
    inner = F.regexp_extract(t, "(?s)\\{.*\\}", 0)
    read = (lambda x: x) if trusted else repaired_json
    whole, part = F.try_parse_json(read(t)), F.try_parse_json(read(F.when(inner != "", inner)))
    is_object = lambda v: F.schema_of_variant(v).startswith("OBJECT")
    return F.coalesce(F.when(is_object(whole), whole), F.when(is_object(part), part))


_STRAY = re.compile(r'("[A-Za-z_][^"]*")\s*:\s*"((?:[^"\\]|\\.)*)"\s*,\s*"((?:[^"\\]|\\.)*)"\s*,(?=\s*"[A-Za-z_][^"]*"\s*:)', re.S)


def join_stray_strings(text: str) -> str:
    """A string that stands alone after a string value becomes the end of that value, until nothing changes."""
    while True:
        better = _STRAY.sub(lambda m: f"{m[1]}: {json.dumps(' '.join(f'{m[2]} {m[3]}'.split()), ensure_ascii=False)},", text)
        if better == text:
            return text
        text = better


def repaired_json(c: Column | str) -> Column:
    """Canonical JSON of a text that is JSON as it is or once stray strings are joined, else null."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def read(text):
            for attempt in (lambda: text, lambda: join_stray_strings(text)):
                try:
                    return json.dumps(json.loads(attempt()), ensure_ascii=False)
                except (ValueError, TypeError, RecursionError):
                    continue
            return None

        for texts in batches:
            yield pa.array([read(t) for t in texts.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(as_col(c))


def fact_list(v: Column) -> Column:
    """array<variant>: under all_facts, else facts, else the value itself if a list, else none."""
    items = lambda path: F.try_variant_get(v, path, "array<variant>")
    return F.coalesce(items("$.all_facts"), items("$.facts"), items("$"), F.array().cast("array<variant>"))


def parse_facts(c: Column | str, trusted: bool = False) -> Column:
    """struct<items array<variant>, error string> of a cell; the error is null where a list was found."""
    t = clean_scalar(c)

    def read(x: Column) -> Column:
        t, v = x["t"], x["v"]
        kind = F.schema_of_variant(v)
        named = F.coalesce(F.try_variant_get(v, "$.all_facts", "array<variant>"), F.try_variant_get(v, "$.facts", "array<variant>"))
        error = (
            F.when(t == "", "the cell is empty")
            .when(v.isNull(), "the cell is not JSON")
            .when(kind.startswith("OBJECT") & named.isNull(), "the object has no list of facts")
            .when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), "the value is no list")
        )
        return F.struct(F.when(error.isNull(), fact_list(v)).otherwise(F.array().cast("array<variant>")).alias("items"), error.alias("error"))

    return bound(F.struct(t.alias("t"), F.try_parse_json(t if trusted else strict_json(t)).alias("v")), read)  # parsed once


def is_fact(item: Column) -> Column:
    return F.schema_of_variant(item).startswith("OBJECT")


def uncertain_items(v: Column) -> Column:
    """array of text: what a reply lists as uncertain_or_conflicting; a single value that is not empty is a list of one."""
    listed = F.try_variant_get(v, "$.uncertain_or_conflicting", "array<variant>")
    text = lambda x: F.coalesce(F.try_variant_get(x, "$", "string"), F.to_json(x))
    alone = F.try_variant_get(v, "$.uncertain_or_conflicting", "variant")
    one = F.when(alone.isNull() | is_falsy(alone), F.array().cast("array<string>")).otherwise(F.array(text(alone)))
    return F.coalesce(F.transform(listed, text), one)


def is_falsy(v: Column) -> Column:
    return F.schema_of_variant(v).isin("VOID") | F.coalesce(F.try_variant_get(v, "$", "string").isin("", "0", "false", "0.0"), F.lit(False)) | F.to_json(v).isin("{}", "[]")


def payload(v: Column, document_type: Column) -> Column:
    """struct<source_document, facts, uncertain_or_conflicting> of an extractor's reply, whatever its shape: facts that are no list
    are none, categories are allowed ones that fit, the document's type stands in for a missing source."""
    facts = F.coalesce(F.try_variant_get(v, "$.facts", "array<variant>"), F.array().cast("array<variant>"))
    source = F.nullif(F.try_variant_get(v, "$.source_document", "string"), F.lit(""))
    return F.struct(F.coalesce(source, document_type).alias("source_document"), with_categories(typed_facts(facts), document_type).alias("facts"), uncertain_items(v).alias("uncertain_or_conflicting"))


def typed_facts(items: Column) -> Column:
    """array of fact structs; items that are no objects go (a list may mix them)."""
    return F.transform(F.filter(items, is_fact), lambda x: F.try_variant_get(x, "$", FACT))


def compact_facts(facts: Column, evidence_limit: int = 260, most: int = 0) -> Column:
    """Facts with cleaned fields, empty ones as null, evidence cut in its middle; the first ``most`` if positive."""
    kept = F.slice(facts, 1, most) if most > 0 else facts
    clean = lambda f, k: F.nullif(truncate_middle(f[k], evidence_limit) if k == "evidence" else clean_scalar(f[k]), F.lit("")).alias(k)
    return F.transform(kept, lambda f: F.struct(*(clean(f, k) for k in FIELDS)))


def fact_text(f: Column, *keys: str) -> Column:
    return F.concat_ws(" ", *(F.coalesce(f[k], F.lit("")) for k in keys))


def with_categories(facts: Column, document_type: Column) -> Column:
    """Facts whose category is allowed and fits their words."""
    kind = lambda f: rules.fact_category(trim(F.coalesce(f["category"], F.lit(""))), fact_text(f, "fact", "evidence"), document_type)
    return F.transform(facts, lambda f: f.withField("category", kind(f)))


# ---------------------------------------------------------------- guardrails

#: Completions in order, as (source phrase, a second phrase that must stand there too, only in operative reports,
#: category, fact, evidence, terms). The phrases must stand in the lower-cased source; the fact is added unless all terms stand in the facts.
COMPLETIONS = (
    ("lul ggos", (), False, "Key Imaging/Test", "Chest CT noted left upper lobe ground-glass opacities.", "LUL GGOs", ("lul", "ggo")),
    ("vats enucleation", ("로봇", "robot"), False, "Procedure Change", "Surgical plan changed from robot enucleation to VATS enucleation due to cost concerns.", "로봇수술아닌 다른 방법으로 수술받기 원한다고 하심. -> VATS enucleation", ("vats", "enucleation")),
    ("mass completely is enucleated", (), True, "Intraoperative Findings", "Complete enucleation of the esophageal mass/tumor was achieved.", "Mass completely is enucleated", ("complete", "enucleat")),
    ("without entering mucosal layer", (), True, "Intraoperative Findings", "Complete enucleation was achieved without entering the mucosal layer.", "without entering mucosal layer", ("mucosal",)),
    ("mucosal injury: none", (), True, "Intraoperative Findings", "No mucosal injury occurred.", "Mucosal injury: none", ("mucosal", "none")),
    ("lacerated lung surface is", (), True, "Intraoperative Findings", "Lacerated lung surface was repaired primarily.", "Lacerated lung surface is reparied primarily", ("lung surface", "repair")),
    ("azygos vein: divided", (), True, "Intraoperative Findings", "Azygos vein was divided intraoperatively.", "Azygos vein: divided", ("azygos", "divided")),
    ("chest tube (20 fr", (), True, "Intraoperative Findings", "A 20 Fr chest tube was placed.", "Chest tube (20 Fr. straight, x1) is placed", ("chest tube",)),
)

#: What a verification of an operative report finds missing, as (source phrase, fact, evidence, terms).
REQUIREMENTS = (
    ("mass completely is enucleated", "Complete enucleation of the esophageal mass/tumor", "Mass completely is enucleated", ("complete", "enucleat")),
    ("without entering mucosal layer", "Complete enucleation without entering the mucosal layer", "without entering mucosal layer", ("mucosal",)),
    ("mucosal injury: none", "No mucosal injury", "Mucosal injury: none", ("mucosal", "none")),
    ("lacerated lung surface is", "Lacerated lung surface repair", "Lacerated lung surface is repaired", ("lung surface", "repair")),
    ("azygos vein: divided", "Azygos vein divided", "Azygos vein: divided", ("azygos", "divided")),
    ("chest tube (20 fr", "Chest tube placement", "Chest tube (20 Fr.) placed", ("chest tube",)),
)

#: Issues of clinical accuracy, source words and a pattern of facts that must not stand beside them, and what is told the extractor.
TAXONOMY = "VATS-to-thoracotomy conversion must not be categorized as a complication when source says Complication: No."
SWAPPED = "PFT values are swapped. Correct mapping is FVC 2.50 L (101%), FEV1 1.99 L (116%), FEV1/FVC 80%."
TAXONOMY_EVIDENCE, SWAPPED_EVIDENCE = "Complication: No", "PFT: 2.50(101)/1.99(116)=80%; Pulmonary Function Lab Report"
FORBIDDEN = ((("pft", "pulmonary function", "fev1", "fvc"), "fvc[^0-9]{0,12}1[.]99|fev1[^0-9]{0,12}2[.]50", SWAPPED, SWAPPED_EVIDENCE),)
APPROVED = "Approved."
SAY_BLOCKED = "Address deterministic clinical guardrail issues: preserve operative core details (complete enucleation, mucosal status, lung repair, azygos vein division, chest tube) and correct PFT mapping."
SAY_PASSED = "Approved. Minor low-priority omissions, if any, are non-blocking."


def searchable(facts: Column) -> Column:
    """Lower-cased category, fact and evidence of all facts."""
    return F.lower(F.array_join(F.transform(facts, lambda f: fact_text(f, "category", "fact", "evidence")), " "))


def add_if_missing(kept: Column, due: Column, category: Column, fact: Column, evidence: Column, terms: Column) -> Column:
    """Facts with one more where it is due and not all of its terms stand in them."""
    cells = {"category": category, "date": F.lit("Unknown date"), "fact": fact, "evidence": evidence, "confidence": F.lit("high"), "source_document": F.lit(None).cast("string")}
    new = F.struct(*(cells[k].alias(k) for k in FIELDS))
    return F.when(due & ~rules.has_all(searchable(kept), terms), F.concat(kept, F.array(new))).otherwise(kept)


def completed(facts: Column, document_type: Column, source: Column) -> Column:
    """Facts with those that literal phrases of the source demand, rule by rule, each seeing what was added before."""
    low, operative = F.lower(source), F.contains(F.lower(document_type), F.lit("operative report"))
    texts = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    step = F.array(*(F.struct(F.lit(p).alias("phrase"), texts(also).alias("also"), F.lit(only).alias("only"), F.lit(c).alias("category"), F.lit(f).alias("fact"), F.lit(e).alias("evidence"), texts(t).alias("terms")) for p, also, only, c, f, e, t in COMPLETIONS))

    def apply(kept: Column, r: Column) -> Column:
        second = (F.size(r["also"]) == 0) | F.exists(r["also"], lambda x: F.contains(low, x))
        due = F.contains(low, r["phrase"]) & second & (~r["only"] | operative)
        return add_if_missing(kept, due, r["category"], r["fact"], r["evidence"], r["terms"])

    return F.aggregate(step, facts, apply)


def pruned(facts: Column, source: Column) -> Column:
    """Without measurements of low priority and what only prompts mention."""
    text = lambda f: fact_text(f, "fact", "evidence")
    return F.filter(facts, lambda f: ~(rules.is_low_priority(text(f)) | rules.is_leaked(text(f), source)))


#: A verification: verdict, scores, feedback and lists of issues. missing_facts has a null severity where the verifier gave plain
#: text; plain_unsupported repeats those of unsupported_facts that it gave as plain text, which no rule drops.
VERIFICATION = {
    "verdict": "string", "coverage_score": "double", "evidence_support_score": "double", "unsupported_facts": "array<string>", "plain_unsupported": "array<string>",
    "missing_facts": "array<struct<severity:string,fact:string,evidence:string>>", "contradictions": "array<string>", "date_errors": "array<string>",
    "clinical_accuracy_issues": "array<struct<issue:string,evidence:string>>", "feedback": "string",
}


def without_nulls(v: Column) -> Column:
    """A verification whose lists that are null are empty."""
    out = v
    for k in (*ISSUES, "plain_unsupported"):
        out = out.withField(k, F.coalesce(v[k], F.array().cast(VERIFICATION[k])))
    return out


def issue_texts(v: Column, kind: str) -> Column:
    field = {"missing_facts": "fact", "clinical_accuracy_issues": "issue"}.get(kind)
    return F.transform(v[kind], lambda x: x[field]) if field else v[kind]


def issue_records(v: Column, kind: str) -> Column:
    """array<struct<fact,issue,severity,evidence>>: what is known of each issue, the rest null."""
    known = {"missing_facts": ("fact", "severity", "evidence"), "clinical_accuracy_issues": ("issue", "evidence")}.get(kind)
    none = F.lit(None).cast("string")
    pick = lambda x, k: (x[k] if known and k in known else x if not known and k == "fact" else none).alias(k)
    return F.transform(v[kind], lambda x: F.struct(*(pick(x, k) for k in ("fact", "issue", "severity", "evidence"))))


def sanitized(v: Column, source: Column) -> Column:
    """Without leaked unsupported facts (evidence at least 0.95 if that was all); low-priority omissions are minor. Issues
    given as plain text stay as they are."""
    kept = F.filter(v["unsupported_facts"], lambda x: ~rules.is_leaked(x, source) | F.array_contains(v["plain_unsupported"], x))
    emptied = (F.size(kept) == 0) & (F.size(v["unsupported_facts"]) > 0)
    minor = lambda m: rules.is_low_priority_missing(F.concat_ws(" ", m["fact"], m["evidence"]))
    missing = F.transform(v["missing_facts"], lambda m: m.withField("severity", F.when(m["severity"].isNotNull() & minor(m), "minor").otherwise(m["severity"])))
    evidence = F.when(emptied, F.greatest(v["evidence_support_score"], F.lit(EVIDENCE))).otherwise(v["evidence_support_score"])
    return v.withField("unsupported_facts", kept).withField("missing_facts", missing).withField("evidence_support_score", evidence)


def add_missing(v: Column, due: Column, fact: str, evidence: str) -> Column:
    there = F.exists(v["missing_facts"], lambda m: F.coalesce(m["severity"].isNotNull() & (F.lower(m["fact"]) == fact.lower()), F.lit(False)))
    new = F.struct(F.lit("critical").alias("severity"), F.lit(fact).alias("fact"), F.lit(evidence).alias("evidence"))
    return v.withField("missing_facts", F.when(due & ~there, F.concat(v["missing_facts"], F.array(new))).otherwise(v["missing_facts"]))


def add_accuracy(v: Column, due: Column, issue: str, evidence: str) -> Column:
    there = F.exists(v["clinical_accuracy_issues"], lambda x: F.coalesce(F.lower(x["issue"]) == issue.lower(), F.lit(False)))
    new = F.struct(F.lit(issue).alias("issue"), F.lit(evidence).alias("evidence"))
    return v.withField("clinical_accuracy_issues", F.when(due & ~there, F.concat(v["clinical_accuracy_issues"], F.array(new))).otherwise(v["clinical_accuracy_issues"]))


def n_critical(v: Column) -> Column:
    return F.coalesce(F.size(F.filter(v["missing_facts"], lambda m: F.lower(m["severity"]) == "critical")), F.lit(0))


def is_blocked(v: Column) -> Column:
    n = lambda k: F.coalesce(F.size(v[k]), F.lit(0))
    return (n("unsupported_facts") + n("contradictions") + n("date_errors") + n("clinical_accuracy_issues") + n_critical(v)) > 0


def is_passed(v: Column, coverage: float = COVERAGE, evidence: float = EVIDENCE) -> Column:
    return ~is_blocked(v) & (F.coalesce(v["evidence_support_score"], F.lit(0.0)) >= evidence) & (F.coalesce(v["coverage_score"], F.lit(0.0)) >= coverage)


def bound(v: Column, step) -> Column:
    """step(v) with v computed once: each step uses it several times, and steps build on each other."""
    return F.get(F.transform(F.array(v), lambda x: step(x)), F.lit(0))


def guarded(v: Column, facts: Column, document_type: Column, source: Column) -> Column:
    """A verification after the deterministic checks: what literal phrases demand is missing, complications that are none,
    swapped values; blocked ones get capped scores (null: 0) and NEEDS_REVISION, passed ones PASS, others keep their verdict.
    Null lists are empty ones."""
    low, said = F.lower(source), searchable(facts)
    operative = F.contains(F.lower(document_type), F.lit("operative report"))
    v = bound(bound(v, without_nulls), lambda x: sanitized(x, source))
    for phrase, fact, evidence, terms in REQUIREMENTS:
        due = operative & F.contains(low, F.lit(phrase)) & ~rules.has_all(said, F.array(*map(F.lit, terms)))
        v = bound(v, partial(add_missing, due=due, fact=fact, evidence=evidence))
    no_complication = operative & F.contains(low, F.lit("complication: no")) & F.contains(said, F.lit("complication")) & F.contains(said, F.lit("conversion"))
    v = bound(v, lambda x: add_accuracy(x, no_complication, TAXONOMY, TAXONOMY_EVIDENCE))
    for words, pattern, issue, evidence in FORBIDDEN:
        due = rules.has_any(low, words) & F.rlike(said, F.lit(pattern))
        v = bound(v, partial(add_accuracy, due=due, issue=issue, evidence=evidence))

    def verdict(x: Column) -> Column:
        blocked = is_blocked(x)
        capped = lambda k, most: F.when(blocked, F.least(F.coalesce(x[k], F.lit(0.0)), F.lit(most))).otherwise(x[k])
        coverage, evidence = capped("coverage_score", 0.84), capped("evidence_support_score", 0.94)
        passed = is_passed(x)
        said = F.when(blocked, "NEEDS_REVISION").when(passed, "PASS").otherwise(x["verdict"])
        own = trim(F.coalesce(x["feedback"], F.lit("")))
        told = F.when(own.isin("", APPROVED), SAY_BLOCKED).otherwise(F.concat(own, F.lit(" " + SAY_BLOCKED)))
        told = F.when(blocked, told).when(passed & (own != APPROVED), SAY_PASSED).otherwise(x["feedback"])
        return x.withField("verdict", said).withField("coverage_score", coverage).withField("evidence_support_score", evidence).withField("feedback", told)

    return bound(v, verdict)


def feedback(v: Column) -> Column:
    """What the extractor is told: the verifier's words, else the whole verification as JSON."""
    return F.coalesce(F.nullif(trim(v["feedback"]), F.lit("")), F.to_json(v.dropFields("plain_unsupported")))


# ---------------------------------------------------------------- roll-up and rendering


def score_mean(score: Column) -> Column:
    """Mean of scores that may be no numbers (0), rounded to 4; 0 without rows."""
    return F.coalesce(F.round(F.avg(F.coalesce(score.try_cast("double"), F.lit(0.0))), 4), F.lit(0.0))


def fact_line(f: Column) -> Column:
    part = lambda k, default="": trim(F.coalesce(F.nullif(f[k], F.lit("")), F.lit(default)))
    some = lambda k, before, after="": F.when(part(k) != "", F.concat(F.lit(before), part(k), F.lit(after)))
    return F.concat_ws(" ", F.concat(F.lit("["), part("category", "Other"), F.lit("]")), F.concat(F.lit("["), part("date", "Unknown date"), F.lit("]")), F.nullif(part("fact"), F.lit("")), some("confidence", "(confidence: ", ")"), some("source_document", "- source: "))


def readable(facts: Column) -> Column:
    """Fact lines under a heading for each source document, in the order of first appearance, numbered from 1."""
    name = lambda f: trim(F.coalesce(F.nullif(f["source_document"], F.lit("")), F.lit("Unknown Document")))
    names = F.array_distinct(F.transform(facts, name))

    def section(n: Column) -> Column:
        own = F.filter(facts, lambda f: name(f) == n)
        numbered = F.transform(own, lambda f, i: F.concat((i + 1).cast("string"), F.lit(". "), fact_line(f)))
        return F.concat(F.lit("## "), n, F.lit("\n"), F.array_join(numbered, "\n"))

    return F.array_join(F.transform(names, section), "\n")


def category_counts(facts: Column) -> Column:
    """name: n of each category, sorted by name; None without facts."""
    names = F.array_sort(F.array_distinct(F.transform(facts, lambda f: F.coalesce(F.nullif(f["category"], F.lit("")), F.lit("Other")))))
    count = lambda n: F.size(F.filter(facts, lambda f: F.coalesce(F.nullif(f["category"], F.lit("")), F.lit("Other")) == n))
    text = F.array_join(F.transform(names, lambda n: F.concat(n, F.lit(": "), count(n).cast("string"))), ", ")
    return F.when(text == "", "None").otherwise(text)


def final_summary(facts: Column, approved: Column, coverage: Column, evidence: Column, n_unresolved: Column) -> Column:
    rows = (("Extracted fact count", F.size(facts)), ("Category counts", category_counts(facts)), ("Approved", F.initcap(approved.cast("string"))), ("Coverage score", coverage), ("Evidence support score", evidence), ("Unresolved issue groups", n_unresolved))
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), x.cast("string")) for k, x in rows))


def verification_summary(approved: Column, coverage: Column, evidence: Column, iterations: Column, chunks: Column) -> Column:
    """A record's verification as text: scores, a verdict for each document, what is unresolved in those not approved.

    chunks: array<struct<document_type, v (verification), iterations_used, approved>> in order.
    """
    head = (("Approved", F.initcap(approved.cast("string"))), ("Coverage score", coverage), ("Evidence support score", evidence), ("Total iterations", iterations))
    verdict = lambda c: F.concat(F.lit("- "), c["document_type"], F.lit(": "), F.coalesce(c["v"]["verdict"], F.lit("UNKNOWN")), F.lit(" (coverage="), c["v"]["coverage_score"].cast("string"), F.lit(", evidence="), c["v"]["evidence_support_score"].cast("string"), F.lit(", iterations="), c["iterations_used"].cast("string"), F.lit(")"))

    def issues(c: Column) -> Column:
        said = lambda kind: F.transform(issue_texts(c["v"], kind), lambda x: F.concat(F.lit("- "), c["document_type"], F.lit(f" / {kind}: "), x))
        return F.flatten(F.array(*map(said, ISSUES)))

    open_issues = F.flatten(F.transform(F.filter(chunks, lambda c: ~c["approved"]), issues))
    lines = F.when(F.size(open_issues) > 0, open_issues).otherwise(F.array(F.lit("- None.")))
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), x.cast("string")) for k, x in head), F.lit(""), F.lit("## Chunk Verdicts"), F.transform(chunks, verdict), F.lit(""), F.lit("## Unresolved Issues"), lines)
