import json
import unicodedata

import pytest

from notemill.operators import uploads as u
from notemill.sources import readers, sinks


def xlsx(**sheets):
    return sinks.workbook_bytes(sheets)


def docx(*paragraphs):
    return sinks.document_bytes(paragraphs)


def put(folder, **content):
    folder.mkdir()
    for name, data in content.items():
        (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(folder)


def test_merged_workbooks(spark, tmp_path):
    head = ["수술ID", "Input", "Output", "more"]
    folder = put(tmp_path / "in", **{
        "나_All.xlsx": xlsx(a=[head, ["2", " x ", "o", "z"], ["1", "y", ""], ["", "lost", "o"], ["3", " ", "o"]], b=[head, ["9", "other sheet", "o"]]),
        unicodedata.normalize("NFD", "가") + ".xlsx": xlsx(a=[head, ["7", unicodedata.normalize("NFD", "한"), "n"]]),
        "empty.xlsx": xlsx(a=[head]), "lacks.xlsx": xlsx(a=[["수술ID", "Input"], ["1", "x"]]), "broken.xlsx": b"no zip", "x.csv": "수술ID,Input,Output\n1,2,3",
    })
    records, summary, warnings = u.merged_workbooks(spark, folder)
    assert [tuple(r) for r in records.collect()] == [("가", "7", "한", "n"), ("나", "1", "y", ""), ("나", "2", "x", "o")]
    assert sorted((r.professor_id, r.input_rows, r.output_rows, r.skipped_rows) for r in summary.collect()) == [("empty", 0, 0, 0), ("가", 1, 1, 0), ("나", 4, 2, 2)]
    found = {r.name: r.warning for r in warnings.collect()}
    assert found["lacks.xlsx"] == "lacks.xlsx: missing columns Output" and "cannot be read" in found["broken.xlsx"]
    assert u.merged_workbooks(spark, folder, keep_empty_output=False)[0].count() == 2
    with pytest.raises(RuntimeError, match="none of the workbooks"):
        u.merged_workbooks(spark, put(tmp_path / "bad", **{"a.xlsx": b"x"}))
    with pytest.raises(FileNotFoundError):
        u.merged_workbooks(spark, put(tmp_path / "none", **{"a.csv": "x"}))


UPLOADS = {
    "records.csv": "Professor_ID,수술ID,Input,Output\n김,a1,\"first\nline\",out\n,,second,\n김,a3,nan,x\n",
    "like.csv": "Medical Record,patient_id,note\nbody,,N1\n,p2,N2\nother,p3,\n",
    "plain.csv": "a,b\n1,2\n,x\\ny\n",
    "many.json": json.dumps({"rows": [{"input": "from json", "record_id": 5, "GT": None}]}),
    "one.json": json.dumps({"k": [1, "é"]}, ensure_ascii=False),
    "bad.json": "{not json",
    "note.txt": "한글".encode("cp949"),
    "blank.md": "  \n",
    "scan.pdf": b"%PDF",
    "doc.docx": docx("first", " ", "second"),
    "book.xlsx": xlsx(s1=[["Input", "No"], ["sheet text", "7"]], s2=[["x"], ["y"]]),
    "bad.docx": b"no zip",
}


def test_input_rows_of_any_upload(spark, tmp_path):
    rows, warnings = u.input_rows(readers.files(spark, put(tmp_path / "up", **UPLOADS)), "prof", "note")
    got = {(r.Source_File, r["수술ID"]): (r.Professor_ID, r.Input, r.Output) for r in rows.collect()}
    assert got.pop(("records.csv", "a1")) == ("김", "first\nline", "out") and got.pop(("records.csv", "records_2")) == ("prof", "second", "")
    assert got.pop(("like.csv", "like_1")) == ("prof", "body", "N1") and got.pop(("like.csv", "p3")) == ("prof", "other", "")
    assert got.pop(("many.json", "5")) == ("prof", "from json", "") and got.pop(("book.xlsx#s1", "7")) == ("prof", "sheet text", "")
    singles = {source: (name.rsplit("_", 1)[0], text) for (source, name), (_, text, _) in got.items()}
    assert singles == {
        "plain.csv": ("plain", "[Source table: plain.csv]\n\nRow 1\n- a: 1\n- b: 2\n\nRow 2\n- b: x\ny"), "one.json": ("one", '{\n  "k": [\n    1,\n    "é"\n  ]\n}'),
        "bad.json": ("bad", "{not json"), "note.txt": ("note", "한글"), "doc.docx": ("doc", "first\nsecond"), "book.xlsx#s2": ("book", "[Source table: book.xlsx#s2]\n\nRow 1\n- x: y"),
    }
    assert sorted(r.name for r in warnings.collect()) == ["bad.docx", "scan.pdf"]
    nothing, why = u.input_rows(readers.files(spark, put(tmp_path / "empty", **{"a.txt": " "})), "prof", "note")
    assert nothing.count() == 0 and "No usable input rows" in why.first().warning


def test_style_samples(spark, tmp_path):
    folder = put(tmp_path / "st", **UPLOADS)
    samples, warnings = u.style_samples(readers.files(spark, folder), most=20)
    got = {(r.source_file, r.source_row): (r.Input, r.Output, r.reference_id) for r in samples.collect()}
    assert got["like.csv", "1"] == ("body", "N1", "like_1") and got["like.csv", "2"] == ("", "N2", "p2") and ("like.csv", "3") not in got
    assert got["doc.docx", "1"] == ("", "first\nsecond", "doc_1") and got["records.csv", "1"][1] == "out"
    said = [r.warning for r in warnings.collect()]
    assert "plain.csv: no output/reference-note column detected" in said and not any("Only the first" in x for x in said)
    samples, warnings = u.style_samples(readers.files(spark, folder), most=2)
    assert samples.count() <= 2 and any(r.warning == "Only the first 2 style sample uploads were used." for r in warnings.collect())


def test_a_json_style_sample_is_one_indented_text(spark):
    found = spark.createDataFrame([("a.json", "json", b'[{"note": "a"}, {"note": "b"}]'), ("b.json", "json", b"{broken"), ("c.json", "json", b'{"rows": [{"note": "x"}]}')], "name string, suffix string, content binary")
    samples, warnings = u.style_samples(found)
    got = {r.source_file: r.Output for r in samples.collect()}
    assert got == {"a.json": json.dumps([{"note": "a"}, {"note": "b"}], indent=2), "b.json": "{broken", "c.json": json.dumps({"rows": [{"note": "x"}]}, indent=2)}
    assert warnings.count() == 0
