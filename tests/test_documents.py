import random

from pyspark.sql import functions as F

from notemill.functions import dates, rules
from notemill.operators import documents as d

RECORD = "ignored head\n[3] Operative Report: {{ 수술일 2024-01-05 done }}\n[4]  First  Visit: {{ }}\n[7] Discharge Summary: {{ 퇴원일 2024/1/9 a }} b }}\n[8] Note: {{ x }} tail"


def split(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "row_index int, input string")
    return d.split_documents(df, "row_index").orderBy("row_index", "doc_no").collect()


def test_split(spark):
    got = split(spark, RECORD, "no header", "  ", None, "[1] : {{ a }}", " [1] A: {{ b }}")
    assert [(r.row_index, r.doc_no, r.source_index, r.document_type) for r in got] == [(0, 1, 3, "Operative Report"), (0, 2, 7, "Discharge Summary"), (0, 3, 8, "Note"), (1, 1, None, d.UNKNOWN), (4, 1, None, d.UNKNOWN), (5, 1, None, d.UNKNOWN)]
    assert [r.body for r in got[:3]] == ["수술일 2024-01-05 done", "퇴원일 2024/1/9 a }} b", "x }} tail"]


def test_timeline_order_and_metamorphic(spark):
    df = spark.createDataFrame([(1, RECORD)], "row_index int, input string")
    row = d.record_timelines(df, "row_index").first()
    assert [(x["phase_rank"], x["date"], x["doc_no"]) for x in row["documents"]] == [(40, "2024-01-05", 1), (50, "2024-01-09", 2), (90, "", 3)]
    again = d.record_timelines(spark.createDataFrame([(1, row["timeline"])], "row_index int, input string"), "row_index").first()
    assert again["timeline"] == row["timeline"]  # sorting what is sorted changes nothing


def test_phase_ranks(spark):
    kinds = {"Initial visit": 10, "Preoperative operative note": 20, "Admission": 30, "postoperative follow-up": 40, "DISCHARGE": 50, "Follow note": 60, "x": 90}
    df = spark.createDataFrame([(k,) for k in kinds], "k string").select("k", rules.phase_rank(F.col("k")).alias("r"))
    assert {r.k: r.r for r in df.collect()} == kinds


def test_calendar(spark):
    days = [(2024, 2, 29, "2024-02-29"), (2024, 2, 30, None), (1899, 12, 31, None), (2100, 1, 1, None), (1900, 1, 1, "1900-01-01")]
    df = spark.createDataFrame(days, "y int, m int, d int, want string")
    assert all(r.want == r.got for r in df.select("want", dates.iso_date(F.col("y"), F.col("m"), F.col("d")).alias("got")).collect())


def test_mentions():
    found = lambda x: [(a, iso, raw) for a, _, iso, raw in dates.mentions_of(x)]
    assert found("20240101") == []
    assert found("240230 240229") == [(7, "2024-02-29", "240229")]
    assert found("(3.5)") == []
    assert found("2023 2024 (3.5)") == [(11, "2024-03-05", "3.5 (year inferred)")]
    assert found("2024-13-40 (240105)") == [(12, "2024-01-05", "240105")]
    assert found("2024-1-2 2024 1 3") == [(0, "2024-01-02", "2024-1-2"), (9, "2024-01-03", "2024 1 3")]


def test_roles_and_pick(spark):
    texts = [
        ("Chest note", "compared with 2024-01-02", "comparison_date", None),
        ("Operative Report", "일자: 2024-01-02", "operation_date", "explicit_operation_date"),
        ("Clinic", "통화 2024-01-02", "note_date", "explicit_note_date"),
        ("Clinic", "wt: 70 2024-01-02", "prior_measurement_date", None),
        ("Clinic", "chest CT 2024-01-02", "study_date", "fallback_study_date"),
        ("Discharge", "2024-01-02", "date_mention", "fallback_date_mention"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(texts)], "i int, document_type string, raw_text string")
    got = d.dated(df).orderBy("i").collect()
    assert [r.mentions[0]["role"] for r in got] == [x[2] for x in texts]
    assert [None if r.document_date is None else r.date_confidence for r in got] == [x[3] for x in texts]


def test_repeated_dates_and_other_spellings_date_a_document(spark):
    far = " " + "word " * 40
    texts = [
        ("Operative Report", f"compared with 2020-01-02{far}수술일 2020-01-02", "2020-01-02", "explicit_operation_date"),
        ("Discharge Summary", "퇴원일 200305", "2020-03-05", "explicit_discharge_date"),
        ("Clinic", f"in 2021 seen{far}통화 (3.5)", "2021-03-05", "explicit_note_date"),
        ("Note", None, None, "missing"),
        (None, "2020-01-02", "2020-01-02", "fallback_date_mention"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(texts)], "i int, document_type string, raw_text string")
    assert [(r.document_date, r.date_confidence) for r in d.dated(df).orderBy("i").collect()] == [x[2:] for x in texts]


def test_generated_code_and_arrow_pass_agree(spark):
    rng = random.Random(4)
    parts = ["2020-01-02", "2020/1/2", "2020-1-2", "2020-1-29", "2020.13.40", "2020 01 02", "200305", "(3.5)", "수술일 ", "퇴원일 ", "compared with ", "comparison  of ", "wt: 70 ", "PFT ", "통화 ", "일자: ", "word " * 30, "12020-01-02", "2020-01-023", " ", "\n", "２０２０-01-02", "2020\u30001\xa02", "2021", "19", "(12.31)", "((2.29)", "(3.5", ".", "1", "é😀", "İ", "Compared with", "190229", "991231"]
    rows = [(i, rng.choice(("Operative Report", "Clinic")), "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))) for i in range(1500)]
    df = spark.createDataFrame(rows, "i int, k string, t string")
    got = df.select("i", dates.is_plain(F.col("t")).alias("plain"), dates.all_mentions(F.col("t"), F.col("k")).alias("m")).collect()
    for r, (_, kind, text) in zip(sorted(got), rows):
        assert [m.asDict() for m in r.m] == dates.distinct_mentions(text, kind), text
    assert 500 < sum(r.plain for r in got) < 1450


def test_mentions_are_scanned_in_one_pass_outside_lambdas(spark):
    df = spark.createDataFrame([("seen 2024-01-05", "Note")], "t string, k string")
    plan = df.select(dates.all_mentions(F.col("t"), F.col("k")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "lambda" not in plan
    assert dates.role_in("comparison of 2023-01-01 and 2024-01-05", "2024-01-05", "") == dates.role_in("compared with 2024-01-05", "2024-01-05", "") == dates.COMPARED


def test_date_variants(spark):
    df = spark.createDataFrame([("2024-01-05",), ("12-5-2024",), ("'24.1.5",), ("2024.3",), ("x",)], "x string")
    got = [set(r[0]) for r in df.select(dates.date_variants("x")).collect()]
    assert {"2024.01.05", "2024/01/05", "24.1.5", "24-1-5", "24/1/5"} <= got[0]
    assert {"2024-05", "24.5"} <= got[1]  # the middle part counts as month, the day is left out
    assert {"2024-01-05", "24.1.5"} <= got[2]
    assert {"2024-03", "2024.03", "24.3"} <= got[3] and got[4] == {"x"}


def test_a_claimed_date_is_split_and_cleaned_once(spark):
    df = spark.createDataFrame([("2024-01-05", "seen 24.1.5 here"), ("'2024.01'", "in 24-1"), ("2024-01-06", "seen 24.1.5 here"), ("Mai  7", "on mai 7"), (None, "x"), ("2024-01-05", None)], "c string, e string")
    out = df.select(dates.date_supported("c", "e").alias("s"))
    assert [r.s for r in out.collect()] == [True, True, False, True, True, None]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("regexp_replace(") <= 4, "spellings must not repeat how the date is read"
