"""Ordered rule tables as CASE expressions: substring tests on lower-cased text, the first rule that holds wins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories of facts.
CATEGORIES = (
    "Primary Diagnosis", "Past Medical History", "Key Imaging/Test", "Operation", "Intraoperative Findings", "Pathology",
    "Hospital Course", "Discharge Plan", "Medication", "Complication", "Procedure Change", "Other",
)

#: Clinical phase by document type.
PHASES = ((10, ("initial", "first")), (20, ("preoperative", "pre-op", "outpatient")), (30, ("admission",)), (40, ("operative", "operation")), (50, ("discharge",)), (60, ("follow",)))
LAST_PHASE = 90

#: Terms that correct a valid category.
CORRECTIONS = (
    ("Discharge Plan", ("return to clinic", "rtc", "follow-up", "follow up", "discharged home", "wound check")),
    ("Key Imaging/Test", ("ggo", "ground glass", "ground-glass", "pft", "fvc", "fev1", "chest ct", "abd.usg", "ultrasound")),
    ("Procedure Change", ("conversion", "converted", "vats enucleation", "robot enucleation")),
    ("Intraoperative Findings", ("mucosal", "chest tube", "lung surface", "azygos vein")),
)

#: Terms that give a category where the stated one is not allowed.
INFERENCES = (
    ("Procedure Change", ("conversion", "converted", "thoracotomy conversion", "vats-to-thoracotomy")),
    ("Intraoperative Findings", ("mucosal", "chest tube", "lung surface", "azygos", "adhesion", "pleural", "intraoperative", "complete enucleation")),
    ("Primary Diagnosis", ("diagnosis", "leiomyoma", "primary diagnosis", "r/o")),
    ("Operation", ("operation", "surgery", "enucleation", "thoracotomy", "vats", "procedure")),
    ("Medication", ("medication", "drug", "arb", "htn medication")),
    ("Past Medical History", ("history", "s/p", "prior", "past", "hypertension", "hbv", "hemangioma", "tbc", "tuberculosis", "cbd dilatation", "tah", "bso")),
    ("Key Imaging/Test", ("ct", "pft", "fvc", "fev1", "ultrasound", "usg", "finding", "test")),
    ("Pathology", ("pathology", "biopsy", "tissue")),
    ("Complication", ("complication", "mucosal injury", "no complications")),
    ("Hospital Course", ("hospital course", "diet", "improved", "home")),
)
#: Terms of a plan, where nothing else gives a category.
PLAN_TERMS = ("discharged", "follow-up", "follow up", "plan", "home")

#: Measurements that are no core facts, omissions that do not matter, and what prompts may leak.
LOW_PRIORITY = ("weight", "wt:", "bmi")
LOW_PRIORITY_MISSING = ("weight", "bmi", "baseline", "liver function test", "lft", "tb 1.4", "pt 114")
LEAKED = ("hypertension", "htn", "arb")


def has_any(text: Column, terms: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(t)) for t in terms))


def has_all(text: Column, terms: Column) -> Column:
    return F.forall(terms, lambda t: F.contains(text, t))


def first_rule(text: Column, rules, default: Column) -> Column:
    out = default
    for value, terms in reversed(rules):
        out = F.when(has_any(text, terms), F.lit(value)).otherwise(out)
    return out


def phase_rank(document_type: Column) -> Column:
    return first_rule(F.lower(document_type), PHASES, F.lit(LAST_PHASE))


def fact_category(category: Column, text: Column, document_type: Column) -> Column:
    """The category of a fact whose fact and evidence are ``text``: corrected if allowed, inferred if not."""

    def of(x: Column) -> Column:
        low, stated = x["low"], x["stated"]
        plan = F.when(F.contains(F.lower(document_type), F.lit("discharge")) | has_any(low, PLAN_TERMS), "Discharge Plan").otherwise("Other")
        return F.when(stated.isin(*CATEGORIES), first_rule(low, CORRECTIONS, stated)).otherwise(first_rule(low, INFERENCES, plan))

    return F.get(F.transform(F.array(F.struct(F.lower(text).alias("low"), category.alias("stated"))), of), F.lit(0))  # lowered once, not for each rule


def is_low_priority(text: Column) -> Column:
    return has_any(F.lower(text), LOW_PRIORITY)


def is_low_priority_missing(text: Column) -> Column:
    return has_any(F.lower(text), LOW_PRIORITY_MISSING)


def is_leaked(text: Column, source: Column) -> Column:
    """A fact on what the source does not mention but prompts do."""
    return has_any(F.lower(text), LEAKED) & ~has_any(F.lower(source), LEAKED)


def mode_name(extract_only: Column, whole_input: Column) -> Column:
    return (
        F.when(whole_input & extract_only, "raw_input_agent1_only")
        .when(whole_input, "raw_input_iterative_verified")
        .when(extract_only, "agent1_only")
        .otherwise("iterative_verified")
    )


def run_tag(k: Column, mode: Column, seed: Column) -> Column:
    return F.concat(F.lit("k"), k, F.lit("_"), mode, F.when(mode == "random", F.concat(F.lit("_seed"), seed)).otherwise(""))


def note_status(note: Column, n_warnings: Column, dry_run: Column) -> Column:
    return F.when(dry_run, "dry_run").when(note == "", "fail").when(n_warnings > 0, "needs_review").otherwise("pass")
