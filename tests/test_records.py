import hashlib
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.operators import judge as j, notes as n, pipeline, records as r, references as ref
from notemill.operators.backends import Config
from notemill.plans.registry import queries
from notemill.sources import readers, sinks
from notemill.streaming.incremental import run_new_files


def rows(df, *order):
    return [tuple(x) for x in df.orderBy(*order).collect()]


def test_merge_and_metrics(spark):
    df = spark.createDataFrame([("b", "1", "x", "o"), ("a", "2", " nan ", ""), ("a", "1", "y", None), ("a", "1", "y", "o")], "professor string, record_id string, input string, output string")
    assert r.merged(df).count() == 3 and r.merged(df, keep_empty_output=False).count() == 2
    assert tuple(r.merge_metrics(df).first()) == (4, 2, 3, 1, 1)


def test_ids_and_columns(spark):
    df = spark.createDataFrame([(" ", "v", "z"), ("r", "v", "z"), (None, "", "z")], "record_id string, visit_id string, my_id string")
    assert [x[0] for x in df.select(r.record_id(df)).collect()] == ["v", "r", "z"]
    assert r.resolve(["in_put", "In put", "in\tPUT", "x"], ("Input",)) == "in\tPUT"
    assert r.resolve(["Patient ID", "x"], ("patient_id",)) == "Patient ID" and r.resolve(["a"], ("b",)) is None
    with pytest.raises(ValueError, match="missing"):
        r.require(df, "nope")
    assert r.with_default(df, "Input").columns[-1] == "Input"
    with pytest.raises(ValueError):
        r.head(df, -1)


def test_keep_first_range_resume(spark):
    df = spark.createDataFrame([(2, "k", "b"), (1, "k", "a"), (3, "l", "c")], "row_index int, key string, v string")
    assert rows(r.keep_first(df, "key", "row_index"), "key") == [("k", 1, "a"), ("l", 3, "c")]
    assert rows(r.row_range(df, 2, 1), "row_index") == [(2, "k", "b")]
    done = df.where("row_index = 1")
    assert rows(r.pending(df, done, "key"), "key") == [(3, "l", "c")]


def test_samples_do_not_depend_on_other_groups(spark):
    df = spark.createDataFrame([(g, str(k)) for g in "ab" for k in range(30)], "g string, k string")
    for draw in (r.hash_sample, r.seeded_sample):
        both = {x for x in rows(draw(df, "g", "k", 5, 7), "k") if x[0] == "a"}
        assert both == set(rows(draw(df.where("g = 'a'"), "g", "k", 5, 7), "k")) and len(both) == 5
    assert r.seeded_sample(df, "g", "k", 0, 7).count() == 60


def test_references(spark):
    notes = [("p", f"{k:02d}", "x" * length) for k, length in enumerate((10, 20, 30, 40, 50, 60, 60, 5))]
    pool = spark.createDataFrame(notes, "professor string, record_id string, output string")
    use = ref.usable(pool, spark.createDataFrame([("p", "03"), ("q", "01")], "professor string, record_id string"))
    assert use.count() == 6
    assert rows(ref.selected(use, 3), "pick") == [("p", "00", 1), ("p", "02", 2), ("p", "05", 3)]
    assert ref.selected(use, 9).count() == 6
    assert rows(ref.selected(use, 3, "random", 1), "pick") == rows(ref.selected(use, 3, "random", 1), "pick")
    chosen = ref.style_references(pool, 3)
    assert [x.record_id for x in chosen.orderBy("pick").collect()] == ["07", "03", "06"]
    blocks = {x.record_id: x.block for x in ref.reference_blocks(pool, chosen, 2).collect()}
    assert blocks["03"].startswith("[Reference 1]\nxxxxx\n") and "[Reference 2]" in blocks["03"]


def test_style_stats(spark):
    df = spark.createDataFrame([(0, "p", "Head\n- VATS 2024-01-02"), (1, "p", "Head\n1. x")], "row_index int, professor string, output string")
    s = ref.note_stats(df).first()
    assert (s.n_examples, s.mean_lines, s.date_rate, s.abbreviation_rate, s.bullet_rate, s.numbered_rate) == (2, 2.0, 0.5, 0.5, 0.5, 0.5)
    assert rows(ref.opening_line(df), "line") == [("p", "Head")]
    assert ref.opening_line(df.union(spark.createDataFrame([(2, "p", "Other")], df.schema))).count() == 0
    assert rows(ref.top_values(ref.abbreviations(df), 3), "rank") == [("p", "VATS", 1, 1)]


def test_reference_leaks(spark):
    line = "the patient came back with a long and special story"
    notes = spark.createDataFrame([(1, "p", f"x {line.upper()} y", ""), (2, "p", line, line), (3, "q", line, ""), (4, "p", "abc" + line, "")], "note_id int, professor string, note string, evidence string")
    refs = spark.createDataFrame([(9, "p", f"short\n{line}\ndescription {line}")], "ref_id int, professor string, output string")
    assert rows(n.reference_leaks(notes, refs), "note_id") == [(1, 9), (4, 9)]


def test_reference_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["ab", "c", "pneumonoultra", "thoracotomy", "enucleation", "x" * 30, "segmentectomy", "straße", "Σίσυφος", "in", "of"]
    rows_of = lambda n, lo, hi: [" ".join(rng.choice(words) for _ in range(rng.randrange(lo, hi))) for _ in range(n)]
    refs = [(k, rng.choice("pq"), "\n".join(rows_of(3, 1, 7))) for k in range(40)]
    notes = [(k, rng.choice("pq"), t, "" if k % 5 else t) for k, t in enumerate(rows_of(60, 5, 60))]
    for k, (_, p, out) in enumerate(refs[:20]):  # whole lines inside longer words
        notes.append((100 + k, p, f"zz{rng.choice(out.split(chr(10)))}yy tail", ""))
    fold = lambda t: " ".join(t.casefold().split())
    want = set()
    for i, p, note, evidence in notes:
        for k, q, out in refs:
            if p == q and any(len(x) >= n.COPIED and x in fold(note) and x not in evidence for x in map(fold, out.split("\n"))):
                want.add((i, k))
    got = n.reference_leaks(spark.createDataFrame([(i, p, t, fold(e)) for i, p, t, e in notes], "note_id int, professor string, note string, evidence string"), spark.createDataFrame(refs, "ref_id int, professor string, output string"))
    found = sorted(map(tuple, got.collect()))
    assert len(want) > 40 and found == sorted(want)


def test_style_prompts(spark):
    row = spark.range(1).select(n.repaired_style(F.lit(""), F.lit("Kim"), F.lit("Head"), F.lit(0.9)).alias("a"), n.repaired_style(F.lit("x"), F.lit("Kim"), F.lit(None), F.lit(0.0)).alias("b")).first()
    assert "Kim" in row.a and "Head" in row.a and row.b.startswith("x\n\nRules") and row.b.count("\n- ") == 3


def test_judge_replies(spark):
    v = lambda x: F.parse_json(F.lit(x))
    like = [spark.range(1).select(j.likert(v(x))).first()[0] for x in ('"5"', "0", "6", "4.7", "5", "null")]
    assert like == [1, 1, 1, 4, 5, 1]
    reply = v('{"claims":[{"verdict":"unsupported","error_type":"Patient_Mixing"},{"verdict":"supported"},"x"],"faithfulness_likert":4}')
    assert tuple(spark.range(1).select(j.faithfulness(reply)).first()[0]) == (4, 3, 1, 1)
    facts = v('{"critical_facts":[{"status":"Present"},{"status":"partial"}]}')
    assert tuple(spark.range(1).select(j.completeness(facts)).first()[0]) == (2, 0, 1, False, True)
    assert tuple(spark.range(1).select(j.completeness(v("{}"))).first()[0]) == (0, 0, 0, False, False)
    score = lambda a, b: spark.range(1).select(j.style_score(F.lit(a), F.lit(b), F.lit("A"), F.lit("tie"))).first()[0]
    assert (score("", ""), score("", "x"), score("x", ""), score("x", "y")) == (0.5, 0.0, 1.0, 0.75)


def xlsx(rows_):
    cell = lambda k, i, x: f'<c r="{chr(65 + k)}{i}" t="inlineStr"><is><t>{x}</t></is></c>'
    data = "".join(f'<row r="{i}">' + "".join(cell(k, i, x) for k, x in enumerate(row) if x) + "</row>" for i, row in enumerate(rows_, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{data}</sheetData></worksheet>")
    return out.getvalue()


def test_files(spark, tmp_path):
    (tmp_path / "Kim_All.xlsx").write_bytes(xlsx([["수술ID", "Input", "Output"], ["1", "in", "out"], ["2", "", "x"]]))
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    (tmp_path / "ko.txt").write_bytes("수술".encode("cp949"))
    (tmp_path / "a.bin").write_bytes(b"x")
    docx = io.BytesIO()
    with zipfile.ZipFile(docx, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:p><w:r><w:t>a</w:t></w:r><w:r><w:t>b</w:t></w:r></w:p><w:p/></w:document>')
    (tmp_path / "d.docx").write_bytes(docx.getvalue())
    found = readers.files(spark, str(tmp_path))
    books = readers.workbooks(found.where("suffix = 'xlsx'")).cache()
    assert books.where("warning is not null").count() == 1
    assert rows(readers.as_columns(books, "수술ID", "Input", "Output"), "row_index") == [("Kim_All.xlsx", "S", 0, "1", "in", "out"), ("Kim_All.xlsx", "S", 1, "2", "", "x")]
    text = {x.name: x.text or x.warning for x in readers.texts(found.where("suffix <> 'xlsx'")).collect()}
    assert text["ko.txt"] == "수술" and text["d.docx"] == "ab" and "no text" in text["a.bin"]
    assert readers.manifest(found).where("original_name = 'ko.txt'").first().bytes == 4
    with pytest.raises(FileNotFoundError):
        readers.files(spark, str(tmp_path), "*.none")


def test_csv_json_markdown(spark, tmp_path):
    df = spark.createDataFrame([("007", 'a "q"\nb'), ("NA", "")], "id string, t string")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert rows(readers.csv(spark, str(tmp_path / "c"), ["id", "t"]), "id") == [("007", 'a "q"\nb'), ("NA", "")]
    with pytest.raises(ValueError):
        readers.csv(spark, str(tmp_path / "c"), ["nope"])
    assert sinks.export_csv(df, str(tmp_path / "x.csv")) == 2 and (tmp_path / "x.csv").read_bytes()[:3] == b"\xef\xbb\xbf"
    (tmp_path / "l.jsonl").write_text('{"id":"1","t":"x"}\nbroken\n{"id":"2","error":"e"}\n')
    assert rows(readers.jsonl(spark, str(tmp_path / "l.jsonl"), ["id", "t"]), "id") == [("1", "x")]
    up = spark.createDataFrame([('{"rows":[{"a":1}]}',), ('[{"a":2},3]',), ("{",)], "j string")
    assert readers.json_records(up, "j").count() == 2
    report = sinks.markdown(df.withColumn("k", F.lit(1)), "R", {"Id": "id"}, {"Text": "t"}, "k")
    assert "### Text" in report.first().value


def test_offline_notes(spark):
    pool = spark.createDataFrame([("p", str(k), "Dx\ns/p VATS " + "x" * k) for k in range(6)], "professor string, record_id string, output string")
    profiles = pipeline.style_profiles(pool, Config())
    assert profiles.first().opening == "Dx"
    bundles = spark.createDataFrame([("1", "p", "facts"), ("2", "p", " "), ("3", "q", "facts")], "record_id string, professor string, evidence string")
    with pytest.raises(ValueError, match="without a style profile"):
        pipeline.write_notes(bundles, profiles, Config())
    got = {x.record_id: x for x in pipeline.write_notes(bundles, profiles, Config(), skip_unmatched=True).collect()}
    assert got["2"].validation_status == "fail" and got["2"].backend == "skipped_no_evidence"
    assert got["1"].validation_status == "needs_review" and "3" not in got


def test_stream_resumes(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    land, out, check = (str(tmp_path / x) for x in ("land", "out", "check"))
    (tmp_path / "land").mkdir()
    work = lambda df: df.withColumn("w", F.col("v") * 2)
    (tmp_path / "land/a.json").write_text('{"k":"a","v":1}\n{"k":"a","v":1}\n')
    run_new_files(spark, land, out, check, schema, work, ("k",))
    (tmp_path / "land/b.json").write_text('{"k":"a","v":5}\n{"k":"b","v":2}\n')
    for _ in range(2):  # the second run has nothing new
        run_new_files(spark, land, out, check, schema, work, ("k",), audit=sinks.stable_json)
    assert [x.value for x in spark.read.text(f"{out}_audit").collect()] == ['{"k":"b","v":2,"w":4}']
    assert rows(spark.read.parquet(out).select("k", "w"), "k") == [("a", 2), ("b", 4)]


def test_stream_state_holds_what_is_done(spark, tmp_path):
    """Keys are known from the state alone: with the results gone they are not done again; a failed batch is repeated whole."""
    import shutil

    schema = T.StructType([T.StructField("p", T.StringType()), T.StructField("k", T.StringType())])
    land, out, check = (str(tmp_path / x) for x in ("land", "out", "check"))
    (tmp_path / "land").mkdir()
    (tmp_path / "land/a.json").write_text('{"p":"x","k":"1"}\n{"p":"y","k":"1"}\n{"p":null,"k":"1"}\n')
    run_new_files(spark, land, out, check, schema, lambda df: df, ("p", "k"))
    assert spark.read.parquet(out).count() == 3
    shutil.rmtree(out)
    (tmp_path / "land/b.json").write_text('{"p":"x","k":"1"}\n{"p":"x","k":"2"}\n{"p":null,"k":"1"}\n')

    def broken(df):
        df.collect()
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run_new_files(spark, land, out, check, schema, broken, ("p", "k"))
    run_new_files(spark, land, out, check, schema, lambda df: df, ("p", "k"))
    assert rows(spark.read.parquet(out).select("p", "k"), "k") == [("x", "2")]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")


def test_manifest_hashes_files_piece_by_piece(spark, tmp_path):
    content = {"a b.bin": bytes(range(256)) * 500, "ko.TXT": "수술".encode()}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    found = readers.files(spark, str(tmp_path))
    plan = readers.manifest(found)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan, "no operator takes a file's content as a whole"
    want = {(k, len(v), hashlib.sha256(v).hexdigest()) for k, v in content.items()}
    assert {(r.original_name, r.bytes, r.sha256) for r in readers.manifest(found).collect()} == want
    assert {(r.original_name, r.bytes, r.sha256) for r in readers.manifest(found.drop("path")).collect()} == want


def test_reference_blocks_of_a_professor_with_very_many_references(spark, tmp_path):
    """The shortest references, also where a professor has more than 1,024."""
    n = 2500
    docs = [(k, f"note number {k:05d} " + "x" * (1 + k * 37 % n), "en", "src1") for k in range(n)]
    spark.createDataFrame([(*d, len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, 0) for k in range(n)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    best = sorted(docs, key=lambda d: (len(d[1]), str(d[0])))[:4]
    block = lambda k: "\n\n".join(f"[Reference {i}]\n{d[1]}" for i, d in enumerate([d for d in best if d[0] != k][:3], 1))
    got = {r.record_id: r.block_sha256 for r in queries()["reference_blocks"](spark, str(tmp_path)).collect()}
    assert got == {str(k): hashlib.sha256(block(k).encode()).hexdigest() for k in range(n)}
