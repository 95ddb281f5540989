import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from notemill.llm import resampling as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest):
    words = WORD.findall((text or "").translate(UPPER))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=10, min_words=20, longest=1, buckets=10000, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in features(text, longest)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        words, found = features(text, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= min_words])
    ranked = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(ranked[: percent * len(ranked) // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in out]


def corpus():
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gämma", "δ", "e1", "it's", "x-y", "😀"] + [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 60)))) for k in range(400)]
    docs += [(None, "alpha " * 30), (None, None), (900, None), (901, ""), (902, " .,\n"), (903, "one " * 19), (904, "one " * 20)]
    docs += [(77, "beta alpha " * 12)] * 150 + [(77, "beta gamma " * 12)] * 5 + [(905, "long word " * 30_000)]
    return docs, ["alpha beta gamma " * 5, None, "", "beta w1 w2 w3 δ"]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resample_matches_brute_force(spark, monkeypatch, longest):
    docs, target = corpus()
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, weight string, rank int").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    want = brute(docs, target, 40, longest=longest)
    for rows in (1 << 16, 20):  # one range, and many: ranges that equal rows lie across
        monkeypatch.setattr(rs, "RANGE_ROWS", rows)
        got = rs.resample(df, aim, 40, longest=longest)
        assert got.columns == ["id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_resample_of_nothing(spark):
    docs, _ = corpus()
    df, none = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "text string")
    assert sorted(map(tuple, rs.resample(df, none).collect()), key=repr) == sorted(brute(docs, []), key=repr)
    assert rs.resample(df.where("false"), none).count() == 0
    assert all(r.rank is None for r in rs.resample(df, none, percent=0).collect())
    assert rs.resample(df, none, percent=100).where("rank is not null").count() == rs.resample(df, none).where("n_features >= 20").count()


def test_tournament_merges_any_number_of_runs():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 5, 8, 13, 64):
        runs = [sorted((rng.randrange(50), r) for _ in range(rng.randrange(0, 9))) for r in range(k)]
        assert list(rs.tournament([((x, None) for x in run) for run in runs])) == [(x, None) for x in sorted(x for run in runs for x in run)]


def test_a_merge_reads_no_further_than_the_last_draw():
    taken = []

    def run(values):
        for v in values:
            taken.append(v)
            yield ((v,), 0)

    it = rs.tournament([run(range(k, 1000, 7)) for k in range(7)])
    assert [next(it)[0][0] for _ in range(10)] == list(range(10)) and len(taken) <= 17


def test_slices_lie_between_fences():
    rows = sorted((-random.Random(k).randrange(30), False, k, 1, k) for k in range(300))
    block = rs.Block({"score": [-r[0] for r in rows], **{c: [r[j] for r in rows] for j, c in enumerate(rs.COLUMNS[1:5], 1)}, "weight": [0] * 300})
    for fences in ([], rows[10:11], rows[::7], [(-99, False, 0, 0, 0), *rows[5:9], (9, True, 0, 0, 0)]):
        got = [(r, p.key(i)) for r, p in block.slices(fences) for i in range(len(p))]
        assert got == [(sum(f <= key for f in fences), key) for key in rows]


def test_noise_and_gain_are_those_of_the_query(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.id: r for r in rs.scored(df, [5, -3], 1, 2024, "doc_id", "text").collect()}
    assert got[2].weight == 0 and got[2].n_words == 0
    assert got[1].weight == sum((5, -3)[zlib.crc32(w) % 2] for w in (b"a", b"b"))
    assert df.select(F.size(rs.words_of(F.lit("--A1é b\x7f")))).first()[0] == 2
