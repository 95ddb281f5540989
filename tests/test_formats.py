import io
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from notemill.sources import formats as f, readers, sinks

ODD = ["", " x ", "a\r\nb\tc", "<&>\"'", "_x000D_ as text", "\x01\x0b\x1f", "한글 é", "\ufffe", "a" * 40000, None]


def cells(df):
    return sorted((r["cells"]["k"], r["cells"]["t"]) for r in df.where("row_index >= 0").collect())


def shared_book(n, prefix="", encoding="utf-8", dimension=""):
    """A workbook of shared strings, numbers and gaps, as spreadsheet programs write it."""
    p, rows = prefix, []
    for k in range(n):
        rows.append(f'<{p}row r="{k + 1}"><{p}c r="A{k + 1}" t="s"><{p}v>{k}</{p}v></{p}c>' + (f'<{p}c r="C{k + 1}"><{p}v>{k}</{p}v></{p}c>' if k else f'<{p}c r="C1" t="inlineStr"><{p}is><{p}t>C</{p}t></{p}is></{p}c>') + f"</{p}row>")
    name = f'xmlns:{p[:-1]}="urn:m"' if p else 'xmlns="urn:m"'
    sheet = f'<?xml version="1.0" encoding="{encoding}"?><{p}worksheet {name}>{dimension}<{p}sheetData>{"".join(rows)}</{p}sheetData><{p}rowBreaks/></{p}worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="urn:m" xmlns:r="urn:r"><sheets><sheet name="One" r:id="a"/><sheet name="Two" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/x.xml"/><Relationship Id="b" Target="/xl/worksheets/y.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><r><t>s</t></r><r><t>{k}</t></r></si>" for k in range(n)) + "</sst>")
        z.writestr("xl/worksheets/x.xml", sheet.encode(encoding))
        z.writestr("xl/worksheets/y.xml", '<worksheet><sheetData><row><c t="inlineStr"><is><t>H</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


@pytest.mark.parametrize("per_task", [1, 97, 5000, 1 << 24])
@pytest.mark.parametrize("prefix", ["", "x:"])
def test_every_row_once_at_any_cut(prefix, per_task, tmp_path):
    data = shared_book(60, prefix)
    (tmp_path / "b.xlsx").write_bytes(data)
    reader = f.WorkbookReader({"path": str(tmp_path), "bytesPerTask": str(per_task), "smallFile": "0"})
    pieces = reader.partitions()
    assert len(pieces) > 60 if per_task < 97 else pieces
    rows = [r for p in pieces for b in reader.read(p) for r in b.to_pylist()]
    whole = [dict(zip(reader_row(r), r)) for r in want(data)]
    key = lambda r: (r["part"], r["row_index"])
    assert [(r["part"], r["header"], r["row_index"], r["cells"]) for r in sorted(rows, key=key)] == [(r["part"], r["header"], r["row_index"], r["cells"]) for r in sorted(whole, key=key)]


def reader_row(_):
    return ("part", "header", "row_index", "cells")


def want(data):
    """By the reader that parses a whole workbook at once."""
    for part, (_, rows) in enumerate(readers.workbook(data)):
        yield part, rows[0], -1, None
        for k, row in enumerate(rows[1:]):
            yield part, rows[0], k, [(h, row[j] if j < len(row) else "") for j, h in enumerate(rows[0]) if h]


def test_sheets_in_other_encodings_and_small_files(tmp_path):
    for k, data in enumerate((shared_book(5), shared_book(5, encoding="utf-16"))):
        (tmp_path / f"{k}.xlsx").write_bytes(data)
    (tmp_path / ".hidden.xlsx").write_bytes(b"")
    for small in ("0", "100000"):
        reader = f.WorkbookReader({"path": str(tmp_path), "smallFile": small, "firstSheet": "true", "bytesPerTask": "100"})
        pieces = reader.partitions()
        assert len(pieces) == 1 if small != "0" else len(pieces) > 10
        rows = [r for p in pieces for b in reader.read(p) for r in b.to_pylist()]
        by_name = {n: sorted((r["row_index"], str(r["cells"])) for r in rows if r["name"] == n) for n in ("0.xlsx", "1.xlsx")}
        assert len(by_name["0.xlsx"]) == 5 and by_name["0.xlsx"] == by_name["1.xlsx"]


def test_workbooks_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([(str(k), ODD[k % len(ODD)]) for k in range(200)], "k string, t string").repartition(3)
    folder = str(tmp_path / "books")
    f.save(df, "workbook", folder, rowsPerFile=30)
    files = sorted(p.name for p in (tmp_path / "books").iterdir() if p.suffix == ".xlsx")
    assert len(files) >= 7 and not any(p.name.startswith("_temporary") for p in (tmp_path / "books").iterdir())
    back = f.workbook_parts(spark, folder, decodeEscapes="true", smallFile="0", bytesPerTask="2000")
    assert back.rdd.getNumPartitions() > 10 and back.where("warning is not null").count() == 0
    assert cells(back) == sorted((r.k, r.t or "") for r in df.collect())
    assert {tuple(r.header) for r in back.where("row_index = -1").collect()} == {("k", "t")}
    f.save(df.limit(3), "workbook", folder, "overwrite")
    assert f.workbook_parts(spark, folder).where("row_index >= 0").count() == 3
    f.save(df.limit(2), "workbook", f"file:{folder}")
    assert f.workbook_parts(spark, f"file://{folder}").where("row_index >= 0").count() == 5
    f.save(df.where("false"), "workbook", folder, "overwrite")
    assert [(r.header, r.row_index) for r in f.workbook_parts(spark, folder).collect()] == [(["k", "t"], -1)]


def test_csv_with_byte_order_marks(spark, tmp_path):
    plain = [t for t in ODD if t != "\ufffe" and "\x01" not in (t or "")]
    df = spark.createDataFrame([(k, plain[k % len(plain)]) for k in range(90)], "k int, t string").repartition(4)
    folder = tmp_path / "csv"
    f.save(df, "spreadsheet_csv", str(folder))
    parts = list(folder.glob("part-*.csv"))
    assert len(parts) == 4 and all(p.read_bytes().startswith(b'\xef\xbb\xbf"k","t"\n') for p in parts) and (folder / "_SUCCESS").exists()
    back = readers.csv(spark, str(folder), ["k", "t"])
    assert sorted((int(r.k), r.t) for r in back.collect()) == sorted((r.k, r.t or "") for r in df.collect())
    f.save(df.where("false"), "spreadsheet_csv", str(folder), "overwrite")
    assert [p.read_bytes() for p in folder.glob("part-*")] == [b'\xef\xbb\xbf"k","t"\n']


def test_an_aborted_write_leaves_what_was_there(spark, tmp_path):
    folder = tmp_path / "csv"
    f.save(spark.range(3), "spreadsheet_csv", str(folder))
    before = sorted((p.name, p.read_bytes()) for p in folder.iterdir())
    failing = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("id"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="no"):
            f.save(failing, "spreadsheet_csv", str(folder), mode)
        assert sorted((p.name, p.read_bytes()) for p in folder.iterdir()) == before
    writer = f.CsvWriter({"path": str(folder)}, f.StructType().add("id", "string"), False)
    tried = [writer.write(iter([f.pa.RecordBatch.from_pydict({"id": ["9"]})])) for _ in range(2)]
    writer.commit([tried[1], None])  # the first attempt was not reported
    assert len(list(folder.glob("part-*.csv"))) == len([n for n, _ in before if n.startswith("part")]) + 1 and not list(folder.glob("_temporary*"))
    with pytest.raises(ValueError, match="must be text"):
        f.CsvWriter({"path": "/x"}, f.StructType().add("n", IntegerType()), False)


def test_damaged_and_missing_workbooks(spark, tmp_path):
    good = sinks.workbook_bytes({"s": [["k", "t"], ["1", "x"]]})
    no_strings = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(shared_book(4))) as a, zipfile.ZipFile(no_strings, "w") as b:
        for n in a.namelist():
            b.writestr(n, b"<sst/>" if "shared" in n else a.read(n))
    for name, data in {"good.xlsx": good, "cut.xlsx": good[:200], "not.xlsx": b"no zip", "empty.xlsx": b"", "strings.xlsx": no_strings.getvalue()}.items():
        (tmp_path / name).write_bytes(data)
    for small in ("0", "1000000"):
        got = f.workbook_parts(spark, str(tmp_path), smallFile=small)
        assert cells(got) == [("1", "x")]
        assert sorted({r.name for r in got.where("warning is not null").collect()}) == ["cut.xlsx", "empty.xlsx", "not.xlsx", "strings.xlsx"]
    with pytest.raises(FileNotFoundError):
        f.workbook_parts(spark, str(tmp_path), pathGlobFilter="*.none")


def test_a_large_sheet_is_never_held_whole(spark, tmp_path):
    rows = 150_000
    df = spark.range(0, rows, 1, 1).select(F.col("id").cast("string").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("t"))
    f.save(df, "workbook", str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("*.xlsx"))) == 1
    got = f.workbook_parts(spark, str(tmp_path / "one"), bytesPerTask=str(2 << 20))
    sizes = [r["count"] for r in got.where("row_index >= 0").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 8 and sum(sizes) == rows and max(sizes) < rows / 8
    same = got.where("row_index >= 0").select((F.col("cells")["t"] == F.sha2(F.col("row_index").cast("string"), 256)).alias("same")).where("same").count()
    assert same == rows
