import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from notemill.llm import line_dedup as ld, mixing as mx

WHITE = " \t\n\x0b\f\r"
TEXTS = [
    (5, "A common line here\nown one", "extra"), (3, "  a COMMON line here\t\nx\nx", "e"), (9, "a common line here\na common line here\n", "e"),
    (1, None, "e"), (2, "", "e"), (None, "a common line here", "e"), (7, "nine char\nten chars!", "e"), (8, "nine char\nTEN CHARS!", "e"), (4, "ééééééééÉÉ\n", "e"), (6, "ééééééééÉÉ", "e"), (10, "ééééééééëë", "e"),
    (11, "\n".join(["long text line %d" % (k % 700) for k in range(3000)]), "e"), (9, "a common line here\na common line here\n", "e"),
]


def brute(rows, min_docs=2):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(WHITE).translate(low)
    owners = defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 10:
                owners[key(x)].add(i)
    gone = {k: min(v) for k, v in owners.items() if len(v) >= min_docs}
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or gone.get(key(x), i) == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup_matches_brute_force(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, h1 string")
    for n in (2, 3):
        got = ld.dedup_lines(df, min_docs=n).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256))
        assert sorted(map(tuple, got.collect()), key=repr) == brute(TEXTS, n)
    assert ld.dedup_lines(df).select("row.*").columns == df.columns
    assert ld.dedup_lines(df.where("false")).count() == 0


def fill(sizes, epochs=3):
    """Targets by resharing what stopped sources leave, round after round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free = {}, set(order)
    while True:
        left = sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > epochs * sizes[s] + 1e-9}
        if not over:
            return target | share
        target |= {s: float(epochs * sizes[s]) for s in over}
        free -= over


def docs(spark):
    rows = [(k, "hot", "w " * (k % 9)) for k in range(300)] + [(1000 + k, s, "a b c") for s in ("aa", "b", "c") for k in range(4)] + [(2000, None, "x y"), (None, "b", "q"), (7, "hot", "w"), (2001, "none", ""), (2002, "none", None)]
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, n long")


def test_mixing(spark):
    df = docs(spark)
    got = mx.mix(df, mx.n_words(F.col("text"))).collect()
    assert len(got) == df.count()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        assert 0 <= r.taken <= 3 * r.size
    want = fill(sizes)
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    assert all(taken[s] == round(want[s]) for s in sizes)
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    again = mx.mix(df.repartition(7), mx.n_words(F.col("text")), ranges=16).collect()
    total = lambda rows: {s: sum(r.taken for r in rows if r.source == s) for s in sizes}
    assert total(again) == total(got)
    assert mx.mix(df.where("false"), mx.n_words(F.col("text"))).count() == 0


def test_mixed_documents(spark):
    df = docs(spark)
    got = mx.mixed_documents(df)
    assert got.columns == df.columns
    words = defaultdict(int)
    for r in got.collect():
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    targets = {r.source: r.target for r in mx.mix(df, mx.n_words(F.col("text"))).collect()}
    assert all(words[s] == round(t) for s, t in targets.items())


def test_word_count(spark):
    texts = [None, "", " \x0b", "a", " a\tb\r\nc ", "a\xa0b c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(mx.n_words(F.col("t"))).collect()] == [0, 0, 0, 1, 3, 2]


def test_targets_of_equal_sources(spark):
    for sizes in ({s: 100 for s in "abcdef"}, {"a": 300, "b": 600}, {"a": 1, "b": 2, "c": 3, "d": 600}, {"a": 0, "b": 5}, {"a": 0}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mx.source_targets(df).collect()}
        want = fill(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes), (sizes, got)
        assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6


def test_mix_sql_agrees_on_ties(spark, tmp_path):
    import duckdb

    rows = [(k, s, "w " * n) for k, (s, n) in enumerate([("a", 3), ("b", 6), ("a", 3), ("b", 6), (None, 9), ("d", 1), ("e", 2), ("f", 3), ("g", 100)])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, text string, more string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = mx.op6_mixing(spark, str(tmp_path))
    want = duck.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mx.OP6_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and got.columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_mixed_documents_of_repeated_rows_and_clashing_names(spark):
    rows = [(1, "s", "a b c d e f g h i j", "x", 5)] * 60 + [(2, "t", "a " * 447, "y", 6)] + [(None, None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size string, taken int")
    got = mx.mixed_documents(df)
    assert got.columns == df.columns
    target = {r.source: r.target for r in mx.mix(df, mx.n_words(F.col("text"))).collect()}
    words = defaultdict(int)
    for r in got.collect():
        words[r.source] += len((r.text or "").split())
        assert r.source is None or (r.size, r.taken) in (("x", 5), ("y", 6))
    assert words["s"] == round(target["s"]) and words["t"] == round(target["t"])
    assert sum(r.source is None for r in got.collect()) == 3
    assert mx.mixed_documents(df.where("false")).count() == 0
