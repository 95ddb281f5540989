import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from notemill.llm import collocations as co

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=3, least=10, cover=50, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    frequent = {(x, p): a for (x, p), a in f.items() if a >= least and len(p) > 1}
    covered = Counter()
    for (x, p), a in frequent.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                covered[x, p[i : i + size]] = max(covered[x, p[i : i + size]], a)
    found = {}
    for (x, p), a in frequent.items():
        cuts = [(10**6 * a * a // (f[x, p[:k]] * f[x, p[k:]]), k, f[x, p[:k]], f[x, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        if 100 * covered[x, p] < cover * a or not covered[x, p]:
            found.setdefault(x, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((x, r, p.decode(), -a, left, right, n[x], -s) for x, rows in found.items() for r, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


def corpus():
    rng = random.Random(9)
    words = ["The", "the", "of", "new", "york", "city", "é", "l'état", "x", "y", "z", "日本", "-", "a\xa0b"] + [f"w{k}" for k in range(30)]
    rows = []
    for k in range(500):
        text = "".join(rng.choice(words) + rng.choice([" "] * 12 + ["  ", "\t", ". ", ",", "!?", "\n", "\x0b", ": "]) for _ in range(rng.randrange(0, 60)))
        rows.append((rng.choice(["en", "en", "de", None, ""]), text))
    rows += [("en", "new york city"), ("fr", None), ("fr", ""), ("fr", " \t\n."), ("de", "hapax legomenon")]
    return rows + [("en", "new york city hall. of the new york")] * 40 + [("xx", "ha ha ha ha " * 2000), ("xx", "one two three four five\n" * 30)]


@pytest.mark.parametrize("longest,least,cover,top", [(3, 10, 50, 2000), (2, 1, 50, 7), (4, 3, 100, 2000), (3, 10, 1, 3)])
def test_collocations_match_brute_force(spark, longest, least, cover, top):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "q") for r in rows], "lang string, text string, rank int, phrase string").repartition(3)
    got = co.collocations(df, longest, least, cover, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, longest, least, cover, top)


def test_full_buckets_lose_nothing(spark, monkeypatch):
    """With few buckets, small blocks and small holdings the bitmaps let nearly all through and the counts stay exact."""
    monkeypatch.setattr(co, "HELD", 50)
    monkeypatch.setattr(co, "TOGETHER", 200)
    rows = corpus()
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for bits in (17, 26):
        assert sorted(map(tuple, co.collocations(df, bits=bits).collect())) == brute(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert co.collocations(df).count() == 0
    assert co.collocations(spark.createDataFrame([("en", "only once here")], df.schema)).count() == 0


def test_bitmaps_rule_out_what_is_rare(spark):
    df = spark.createDataFrame([("en", "a b. " * 10 + "c d")], "lang string, text string")
    phrases, totals = co.frequent_phrases(df)
    assert {(r.phrase, r.a) for r in phrases.collect()} == {("a", 10), ("b", 10), ("a b", 10)} and totals.first().n == 22
    words = co.Words(pa.array(["a b c"]), pa.array(["en"]))
    marks = co.bitmap(spark.createDataFrame([], co.ROWS), 1, 20)
    assert not marks.any() and not co.is_set(marks, words.buckets(np.arange(2), 2, 20)).any()


def test_long_texts_are_cut_between_pieces_only(monkeypatch):
    monkeypatch.setattr(co, "TOGETHER", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "en"]), pa.array(["aa bb cc dd ee ff. gg hh", "x"])], names=["lang", "text"])
    got = [w.words.take(pa.array(w.codes)).to_pylist() for w in co.gathered(iter([batch]))]
    assert got == [["aa", "bb", "cc", "dd", "ee", "ff"], ["gg", "hh", "x"]] or sum(got, []) == "aa bb cc dd ee ff gg hh x".split()


def test_least_is_bounded(spark):
    with pytest.raises(ValueError):
        co.collocations(spark.createDataFrame([], "lang string, text string"), least=256)
