"""Each opN_ query as it is registered, over whole small tables, against plain Python."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from notemill.llm import bpe, queries as q

WORDS = {
    "en": "the quick brown fox jumps over a lazy dog and runs from every house in town".split(),
    "de": "der schnelle braune fuchs springt über den faulen hund und läuft weg vom haus".split(),
}
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def held(i, modulus):
    return zlib.crc32(str(i).encode()) % modulus


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, folder = random.Random(12), tmp_path_factory.mktemp("tables")
    docs, labels = [], []
    for k in range(240):
        lang = ("en", "de")[k % 2]
        text = "\n".join(" ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 5)))
        if k % 6 == 0:
            text += " you 1d10t idiot"
        docs.append((k, text, lang if k % 20 else None, ("hot", "b", None)[min(k % 5, 2)], len(text)))
        labels.append((k, 1, int(k % 6 == 0)))
    docs += [(300, None, None, "b", 0), (301, "", "en", "c", 0), (302, " \n\t", "en", "c", 3), (303, docs[3][1], "de", "c", 0), (304, docs[3][1].upper() + "!", "de", "b", 0), (305, "½ ²", "en", "b", 3), (-1, "ÀÉ <|endoftext|> " * 40, "zz", "b", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    gen = np.random.default_rng(3)
    centres = gen.standard_normal((5, 16))
    vectors = [(k, (centres[k % 5] + 0.15 * gen.standard_normal(16)).astype(np.float32).tolist(), k % 3 if k % 11 else None) for k in range(130)] + [(200, None, 1), (220, [0.0] * 16, 1), (240, [float("nan")] * 16, 2)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder), {d[0]: d[1:] for d in docs}, vectors


def rows(spark, tables, name, columns):
    df = q.queries()[name](spark, tables[0])
    assert [(f.name, f.dataType.simpleString()) for f in df.schema if f.name in columns] == list(columns.items())
    return df.collect()


def test_every_query_has_an_operator():
    assert sorted(q.queries(), key=lambda n: int(n[2:].split("_")[0])) == list(q.queries()) and len(q.queries()) == 13
    assert set(q.oracle_sql()) <= set(q.queries())


def test_op1(spark, tables):
    got = rows(spark, tables, "op1_nearest", {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"})
    usable = {i: np.array(v, np.float64) for i, v, _ in tables[2] if i < 200}
    found = 0
    asked = [i for i in usable if i % 20 == 0]
    assert {r.query_id for r in got} == set(asked)
    for i in asked:
        best = sorted(((-float(usable[i] @ v), k) for k, v in usable.items() if k != i))[:20]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i)
        assert [r for r, _, _ in mine] == list(range(1, 21)) and all(abs(s - float(usable[i] @ usable[k])) < 1e-9 for _, k, s in mine)
        found += len({k for _, k in best} & {k for _, k, _ in mine})
    assert found >= 0.9 * 20 * len(asked)


def test_op2(spark, tables):
    got = rows(spark, tables, "op2_context_mixing", {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"})
    tokens = {i: [*TOKEN.findall(lower(d[0])), None] for i, d in tables[1].items()}
    counts: dict = {}
    for i, words in tokens.items():
        for w in words if held(i, 7) != 2 else ():
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    assert {r.doc_id for r in got} == set(tokens)
    for r in got:
        words = tokens[r.doc_id]
        base = sum(math.log10((counts.get(w, 0) + 1) / (total + len(counts) + 1)) for w in words)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id, 7) == 2, len(words), sum(w in counts for w in words), total)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0 and math.isfinite(r.score)


@pytest.mark.parametrize("name", ["op3_line_dedup", "op6_mixing", "op9_metric_join"])
def test_sql_agrees(spark, tables, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tables[0]}/{t}.parquet/*.parquet'")
    want = duck.sql(q.oracle_sql()[name])
    got = q.queries()[name](spark, tables[0])
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert sorted(map(plain, got.select(*sorted(got.columns)).collect()), key=repr) == sorted(map(plain, want.select(", ".join(sorted(got.columns))).fetchall()), key=repr)


def test_op4_and_op10(spark, tables):
    library = Tokenizer.from_file(bpe.word_file())
    ids = {i: library.encode(d[0] or "", add_special_tokens=False).ids for i, d in tables[1].items()}
    start, want = 0, {}
    for i in sorted(ids):
        all_ids = [*ids[i], 1]
        want[i] = (start, len(all_ids), zlib.crc32(np.array(all_ids, "<u4").tobytes()))
        start += len(all_ids)
    files = rows(spark, tables, "op4_token_files", {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"})
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in files} == want
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = rows(spark, tables, "op10_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == {i: (len(x), digest(" ".join(map(str, x))), digest(library.decode(x, skip_special_tokens=False))) for i, x in ids.items()}


def test_op5(spark, tables):
    got = rows(spark, tables, "op5_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert {r.doc_id for r in got} == set(tables[1])
    assert all(r.held_out == (held(r.doc_id, 5) == 0) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 6 == 0) for r in got if 0 <= r.doc_id < 240]) > 0.98


def test_op7(spark, tables):
    got = {r.doc_id: r for r in rows(spark, tables, "op7_language_id", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})}
    assert set(got) == set(tables[1]) and all(r.held_out == (held(i, 3) == 1) and 0 <= r.score <= 1 for i, r in got.items())
    assert {got[i].lang_pred for i in (300, 301, 302, 305)} == {"und"}
    assert np.mean([got[k].lang_pred == ("en", "de")[k % 2] for k in range(240) if len(tables[1][k][0].split()) > 3]) > 0.97


def test_op8(spark, tables):
    def fingerprint(text):
        w = TOKEN.findall(lower(text))
        shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = rows(spark, tables, "op8_simhash", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    marks = {i: fingerprint(d[0]) for i, d in tables[1].items()}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{m:016x}" for i, m in marks.items()}
    reach = {i: i for i in marks}
    changed = True
    while changed:
        changed = False
        for i in marks:
            least = min(reach[k] for k in marks if (marks[i] ^ marks[k]).bit_count() <= 3)
            if least < reach[i]:
                reach[i], changed = least, True
    assert {r.doc_id: r.component_id for r in got} == reach
