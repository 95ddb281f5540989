import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from notemill.functions import text as t


def values(spark, texts, *columns):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_clean_scalar(spark):
    got = values(spark, [None, " nan ", "None", "NaT", " a\\nb\\t", "　x　", "nano"], t.clean_scalar("x"), t.clean_scalar("x", False))
    assert got == [("", ""), ("", ""), ("", ""), ("", ""), ("a\nb\t", "a\\nb\\t"), ("x", "x"), ("nano", "nano")]


def middle(text, limit):
    if limit <= 0:
        return ""
    if len(text) <= limit:
        return text
    left, right = limit // 2, max(0, limit - limit // 2 - 32)
    return text[:left].rstrip() + t.MARK + (text[len(text) - right :].lstrip() if right else "")


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab \n　é漢", max_size=120), min_size=1, max_size=8))
def test_truncate_and_lines_match_plain_python(spark, texts):
    texts = [x.strip() for x in texts]
    for limit in (0, 1, 64, 65):
        assert [r[0] for r in values(spark, texts, t.truncate_middle("x", limit, unescaped=False))] == [middle(x, limit) for x in texts]
    got = values(spark, texts, t.lines("x"), t.match_normalize("x"))
    assert [r[0] for r in got] == [[y.strip() for y in x.splitlines() if y.strip()] for x in texts]
    assert [r[1] for r in got] == [" ".join(x.casefold().split()) for x in texts]


def test_truncate_middle_unlimited(spark):
    assert values(spark, ["abc"], t.truncate_middle("x", 0, unlimited=True)) == [("abc",)]


def test_thinking_and_fences(spark):
    got = values(spark, ["<think>a</think> b", "<THINK>never closed", "```json\n{}\n```", "a ``` b"], t.strip_thinking("x"))
    assert [r[0] for r in got] == ["b", "", "{}", "a ``` b"]


def test_unwrap_note(spark):
    replies = ['{"note": "n", "x": 1}', '{"a": "only"}', '"text"', '{"a": "x", "b": "y"}', "plain", '{"a": 1} tail', '{"note": "", "Output": " o "}', "[1]"]
    got = values(spark, replies, t.unwrap_note("x").alias("n"))
    assert [r[0]["note"] for r in got] == ["n", "only", "text", '{"a": "x", "b": "y"}', "plain", '{"a": 1} tail', "o", "[1]"]
    assert [bool(r[0]["warning"]) for r in got] == [True, True, True, False, False, False, True, False]


def test_strict_json_and_nfc(spark):
    got = values(spark, ['{"a":1,"a":2}', '{"a":1} x', "NaN", None, "{"], t.strict_json("x"))
    assert [r[0] for r in got] == ['{"a": 2}', None, "NaN", None, None]
    assert values(spark, ["é", None], t.nfc("x")) == [("é",), (None,)]
    assert json.loads(got[0][0]) == {"a": 2}


def test_slug_mime_escape_redact(spark):
    assert values(spark, ["  a b/c ", "", "한글 파일", "--.", None], t.slug("x")) == [("a_b_c",), ("run",), ("한글_파일",), ("run",), ("run",)]
    assert values(spark, ["A.CSV", "x", "b.jsonl"], t.mime("x")) == [("text/csv",), ("application/octet-stream",), ("application/x-ndjson",)]
    assert values(spark, ["<a href='x'>&"], t.html_escape("x")) == [("&lt;a href=&#x27;x&#x27;&gt;&amp;",)]
    assert values(spark, ["", None, "abc"], t.redacted("x")) == [("",), ("",), ("[redacted, 3 chars]",)]
    assert values(spark, ["/a/Kim_All.xlsx", "Lee.xlsx"], t.professor_of("x")) == [("Kim",), ("Lee",)]


def test_sanitize_style(spark):
    assert values(spark, ["Be short.\n\n\n\nReturn valid JSON only. No markdown"], t.sanitize_style("x")) == [("Be short.",)]


def test_hash_has_a_byte_order_mark(spark):
    import hashlib

    assert values(spark, ["é"], t.text_hash("x"), t.text_hash("x", bom=False)) == [(hashlib.sha256("é".encode("utf-8-sig")).hexdigest(), hashlib.sha256("é".encode()).hexdigest())]
