import random

from pyspark.sql import functions as F

from notemill.functions.text import is_generic, match_normalize
from notemill.operators import backends, notes as n, pipeline

LINES = ["the patient was seen on the ward and is well today", "no complaints since the operation last month", "short line", "Plan: return to the clinic in three months time", "description of a very common line that counts for nothing", "에스 검사 결과 이상 없음 환자 상태 양호함 외래 추적 관찰 예정임"]


def normal(t):
    return " ".join((t or "").casefold().split())


def copied(note, evidence, professor, shown):
    """The references, in the order of picks, of which a long line that is not generic stands in the note but not in its evidence."""
    out = []
    for owner, record, pick, text in sorted(shown, key=lambda s: s[2]):
        lines = [normal(x) for x in text.splitlines() if x.strip()]
        generic = lambda x: any(g in x for g in ("description", "소견", "postop 1st visit"))
        if owner == professor and any(len(x) >= 28 and not generic(x) and x in normal(note) and x not in normal(evidence) for x in lines):
            out.append(n.COPY + record)
    return out


def test_copies_are_warned_of_in_the_order_of_picks(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda most: "\n".join(rng.choice(LINES) if rng.random() < 0.8 else "own words %d" % rng.randrange(9) for _ in range(rng.randrange(0, most)))
    shown = [(f"p{k % 3}", f"r{k}", k // 3 + 1, text(4)) for k in range(9)]
    rows = [(k, f"p{k % 4}", text(5).upper() if k % 2 else f"x {text(5)} y", text(3), k % 3, 2) for k in range(80)] + [(80, "p0", None, "", 0, 1), (81, "p0", " nan ", LINES[0], 0, 1), (82, None, LINES[0], None, 2, 2)]
    df = spark.createDataFrame(rows + rows[:5], "i int, professor string, generated_note string, evidence string, n_sent int, n_facts int").repartition(3)
    refs = spark.createDataFrame(shown, "professor string, record_id string, pick int, output string")
    assert refs.where(is_generic(match_normalize("output"))).count() < 9
    for most in (200_000, 0):  # keys of references sent to all tasks, and shuffled
        monkeypatch.setattr(n, "SENT_KEYS", most)
        got = n.validated(df, n.excerpts(refs), strict=True).select("i", "w.warnings").collect()
        assert len(got) == len(rows) + 5
        for r in got:
            _, professor, note, evidence, sent, facts = rows[r.i]
            if (note or "").strip() in ("", "nan"):
                assert r.warnings == ["the note is empty"]
                continue
            told = [w for w in r.warnings if w.startswith(n.COPY) or w == n.LEFT_OUT]
            assert told == copied(note, evidence, professor, shown) + [n.LEFT_OUT] * (sent < facts), (note, evidence)
            assert r.warnings[len(r.warnings) - len(told) :] == told


def test_validation_without_references_or_counts(spark):
    df = spark.createDataFrame([("p", LINES[0], ""), ("p", "", "")], "professor string, generated_note string, evidence string")
    assert [r.w.warnings for r in n.validated(df, strict=True).collect()] == [[], ["the note is empty"]]
    none = spark.createDataFrame([], "professor string, record_id string, pick int, output string")
    assert n.validated(df, none).count() == 2 and n.validated(df.where("false"), none).count() == 0


def test_written_notes_report_copies_and_cut_bundles(spark, monkeypatch):
    pool = spark.createDataFrame([("p", f"r{k}", f"{LINES[k % 2]}\nown {k}", k) for k in range(4)], "professor string, record_id string, output string, row_index int")
    config = backends.Config(pause=0)
    profiles = pipeline.style_profiles(pool, config)
    shown = pipeline.style_excerpts(pool)
    assert shown.count() == 3 and shown.columns == ["professor", "record_id", "pick", "output"]

    class Copyist:
        def __init__(self, config):
            pass

        def chat(self, system, user):
            return LINES[0]

    real = pipeline.ask
    monkeypatch.setattr(pipeline, "ask", lambda calls, config: real(calls, config, Copyist))
    bundles = spark.createDataFrame([("a", "p", "nothing of it", 1, 2), ("b", "p", f"facts: {LINES[0]}", 2, 2), ("c", "p", "", 0, 1)], "record_id string, professor string, evidence string, n_sent int, n_facts int")
    got = {r.record_id: r for r in pipeline.write_notes(bundles, profiles, config, shown=shown, strict=True).collect()}
    first = [r.record_id for r in shown.orderBy("pick").collect() if LINES[0] in r.output]
    assert [w for w in got["a"].validation_warnings if w.startswith(n.COPY)] == [n.COPY + r for r in first] and first
    assert got["a"].validation_warnings[-1] == n.LEFT_OUT and got["a"].validation_status == "needs_review"
    assert not any(w.startswith(n.COPY) or w == n.LEFT_OUT for w in got["b"].validation_warnings) and got["c"].validation_status == "fail"
    plain = pipeline.write_notes(bundles, profiles, config).where("record_id = 'a'").first()
    assert not any(w.startswith(n.COPY) or w == n.LEFT_OUT for w in plain.validation_warnings)


def test_long_excerpts_are_cut_in_their_middle(spark):
    df = spark.createDataFrame([("p", "r", 1, "a" * 100 + "b" * 100)], "professor string, record_id string, pick int, output string")
    assert n.excerpts(df, 90).first().output.startswith("aa") and n.excerpts(df, 90).first().output.endswith("bb")


def test_evidence_is_normalised_once_not_for_each_claim(spark):
    df = spark.createDataFrame([("mass 3 cm on 2024-01-05", "MASS seen 24.1.5", "keep 3 cm")], "n string, e string, s string")
    out = df.select(n.note_warnings(F.col("n"), match_normalize("e"), style=F.col("s")).alias("w"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(e#") == 1 and plan.count("lower(s#") == 1
    assert "3 cm" in out.first().w.unsupported and "2024-01-05" not in out.first().w.unsupported
