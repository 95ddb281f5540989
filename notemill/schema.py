"""Record types as struct types: what tables of the pipeline hold."""

from __future__ import annotations

from pyspark.sql.types import StructType


def _type(ddl: str) -> StructType:
    return StructType.fromDDL(" ".join(ddl.split()))


RECORD = _type("Professor_ID string, `수술ID` string, Input string, Output string")
FILE_SUMMARY = _type("source_file string, professor_id string, input_rows long, output_rows long, skipped_rows long")
MENTION = _type("start int, normalized_date string, raw_text string, role string, context string")
DOCUMENT = _type("source_index int, document_type string, raw_text string, body string, document_date string, date_confidence string, date_source string, phase_rank int, sort_group string")
FACT = _type("category string, date string, fact string, evidence string, confidence string, source_document string")
VERIFICATION = _type("""verdict string, coverage_score double, evidence_support_score double, unsupported_facts array<string>, plain_unsupported array<string>, missing_facts array<struct<severity:string,fact:string,evidence:string>>,
    contradictions array<string>, date_errors array<string>, clinical_accuracy_issues array<struct<issue:string,evidence:string>>, feedback string""")
BUNDLE = _type("row_index long, record_id string, professor string, evidence string, bundle_hash string")
NOTE = _type("""record_id string, professor string, generated_note string, validation_status string, validation_warnings array<string>, unsupported_terms_or_claims array<string>,
    generation_prompt_hash string, style_prompt_hash string, backend string, error string""")
STYLE = _type("professor string, opening string, abbreviation_rate double, style_prompt string, warnings array<string>")
JUDGED = _type("""method string, record_id string, professor string, error string, empty_note boolean, likert int, n_claims int, n_unsupported int, n_mixing int, n_critical int, n_absent int,
    n_partial int, style_score double, hallucination_free boolean, faithful_pass boolean, faithful_borderline boolean, complete_strict boolean, complete_lenient boolean""")
