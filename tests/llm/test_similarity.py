import random
import tracemalloc

import numpy as np
import xxhash
from pyspark.sql import functions as F

from notemill.llm import components as cc, metric_join as mj, nearest as ne, simhash as sh


def roots(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(500 + k, 501 + k) for k in range(60)] + [(0, k) for k in range(100, 160)]
    want = roots(600, pairs)
    df = spark.createDataFrame([*pairs, (None, 3), (3, None), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in cc.connected_components(df).collect()}
    assert got == {x: want[x] for p in pairs if p[0] != p[1] for x in p}
    assert cc.connected_components(df.where("false")).count() == 0


def brute_fingerprint(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in hashes) * 2 > len(hashes))


def texts():
    rng = random.Random(5)
    words = ["Wort%d" % k for k in range(60)]
    base = [[rng.choice(words) for _ in range(rng.choice((1, 2, 3, 40, 300)))] for _ in range(40)]
    out = [" ".join(x) for x in base]
    for x in base[:30]:
        for _ in range(3):
            y = list(x)
            for _ in range(rng.choice((0, 1, 2))):
                y[rng.randrange(len(y))] = rng.choice(words)
            out.append("\n".join(y) + " ")
    return [*out, None, "", " \t", "ÀÉ é"]


def test_simhash_links_equal_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([*[(*r, "x") for r in rows], (None, "a b c", "x"), (5, rows[5][1], "x")], "doc_id long, text string, fp string")
    marks = [brute_fingerprint(t, 3) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if bin(marks[a] ^ marks[b]).count("1") <= 3]
    want = roots(len(rows), pairs)
    got = sh.near_duplicates(df).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.id is None:
            assert r.component_id is None
        else:
            assert (r.fp % 2**64, r.component_id) == (marks[r.id], want[r.id])
    assert sh.near_duplicates(df.where("false")).count() == 0


def test_ring_links_find_every_pair_within_three_bits(spark):
    rng = random.Random(1)
    points = {rng.getrandbits(64) for _ in range(150)}
    for x in list(points):
        for d in (1, 2, 3, 4):
            y = x
            for b in rng.sample(range(64), d):
                y ^= 1 << b
            points.add(y)
    signed = [int(np.uint64(x).astype(np.int64)) for x in points]
    for distance in (0, 1, 2, 3):
        want = {(min(a, b), max(a, b)) for k, a in enumerate(signed) for b in signed[:k] if bin((a ^ b) % 2**64).count("1") <= distance}
        got = sh.ring_links(spark.createDataFrame([(x,) for x in signed], "fp long"), distance=distance).distinct().collect()
        assert {tuple(r) for r in got} == want


def test_similar_documents(spark):
    rng = random.Random(8)
    rows, near = [], []
    for k in range(60):
        words = ["w%d" % rng.randrange(5000) for _ in range(400)]
        rows.append((10 * k, " ".join(words)))
        edited = list(words)
        for at in rng.sample(range(400), 4 if k % 2 else 60):  # 4 of 400: similarity about 0.9; 60: below 0.4
            edited[at] = "new%d" % rng.randrange(5000)
        rows.append((10 * k + 1, " ".join(edited)))
        near.append(bool(k % 2))
    rows += [(9001, ""), (9002, None), (None, "a")]
    got = {r.id: r.component_id for r in sh.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [got[10 * k + 1] == 10 * k for k in range(60)]
    assert sum(f for f, n in zip(found, near) if n) >= 29 and not any(f for f, n in zip(found, near) if not n)
    assert got[9002] == 9001 and got[None] is None


def similar_groups(spark, texts, words=5):
    """Ids of the rows and the smallest id of each one's group, from similar_documents and by brute force."""
    sets = [{tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} for w in (t.split() for t in texts)]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    got = {r.id: r.component_id for r in sh.similar_documents(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id").collect()}
    return [got[k] for k in range(len(texts))], roots(len(texts), pairs)


def test_similar_documents_at_the_threshold(spark):
    rng, texts = random.Random(21), []
    for _ in range(250):  # Jaccard 0.80 to 0.82
        words = ["w%d" % rng.randrange(9000) for _ in range(rng.choice((204, 205, 206, 208)))]
        cut = len(words) - rng.choice((20, 21, 22))
        texts += [" ".join(words), " ".join(words[:cut] + ["n%d" % rng.randrange(9000) for _ in range(len(words) - cut)])]
    got, want = similar_groups(spark, texts)
    assert got == want and len(set(want)) < 420


def test_similar_documents_in_a_crowd(spark):
    rng = random.Random(22)
    shared = ["s%d" % k for k in range(240)]
    texts = [" ".join(shared + ["w%d" % rng.randrange(9000) for _ in range(60)]) for _ in range(700)]  # Jaccard about 0.66
    for k in range(300, 400):  # near copies (0.81 to 0.88) in the middle, so that others have the least and the greatest id
        words = texts[k].split()
        changed = rng.randrange(20, 32)
        texts.insert(350, " ".join(words[:-changed] + ["n%d" % rng.randrange(9000) for _ in range(changed)]))
    got, want = similar_groups(spark, texts)
    assert got == want and 600 < len(set(want)) < 720


def test_similar_documents_are_not_linked_below_the_threshold(spark):
    rng, texts = random.Random(23), []
    for _ in range(100):  # Jaccard 0.75 to 0.79, and repeated lines that a set holds once
        words = ["w%d" % rng.randrange(9000) for _ in range(204)]
        new = rng.choice((24, 26, 28))
        texts += [" ".join(words), " ".join(words[:-new] + ["n%d" % rng.randrange(9000) for _ in range(new)])]
        line = ["r%d" % rng.randrange(9000) for _ in range(12)]
        texts += [" ".join(line * 30 + words[:20]), " ".join(line * 30 + words[20:40])]
    got, want = similar_groups(spark, texts)
    assert got == want == list(range(len(texts)))


def vectors(seed=0, clusters=6, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dims))
    v = np.concatenate([c + s * rng.standard_normal((40, dims)) for c, s in zip(centres, (0.05, 0.1, 0.2, 0.3, 0.5, 1.0))])
    return np.concatenate((v, v[:30], 3 * v[5:15])).astype(np.float32)


BAD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [float("inf")] + [1.0] * 15, 1), (9005, [None] + [1.0] * 15, 1), (9006, [1.0] * 3, 1), (9007, [], 1)]
KIND = "vec_id long, embedding array<float>, label int"


def test_metric_join_equals_brute_force(spark, monkeypatch):
    v = vectors()
    label = [None if k % 50 == 49 else k % 2 for k in range(len(v))]
    rows = [(k, x.tolist(), lab) for k, (x, lab) in enumerate(zip(v, label))] + BAD + [(None, v[0].tolist(), 0), (3, v[3].tolist(), label[3])]
    u = v.astype(np.float64)
    cos = u @ u.T / np.linalg.norm(u, axis=1)[:, None] / np.linalg.norm(u, axis=1)
    ok = np.array([[a is not None and a == b for b in label] for a in label]) & (cos >= 0.93)
    np.fill_diagonal(ok, False)
    want = roots(len(v), list(zip(*np.nonzero(ok))))
    for cell, block in ((8192, 4096), (10, 7)):
        monkeypatch.setattr(mj, "CELL", cell)
        monkeypatch.setattr(mj, "BLOCK", block)
        got = mj.near_vectors(spark.createDataFrame(rows, KIND)).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.id is None:
                assert (r.n_links, r.component_id, r.kept) == (0, None, False)
            elif r.id > 9000:
                assert (r.n_links, r.component_id, r.kept) == (0, r.id, True)
            else:
                assert (r.n_links, r.component_id, r.kept) == (ok[r.id].sum(), want[r.id], want[r.id] == r.id)
    assert mj.near_vectors(spark.createDataFrame(BAD, KIND)).count() == len(BAD)
    assert mj.near_vectors(spark.createDataFrame([], KIND)).count() == 0


def test_nearest(spark, monkeypatch):
    v = vectors(1)
    rows = [(k, x.tolist(), 0) for k, x in enumerate(v)] + BAD + [(None, v[0].tolist(), 0)]
    s = v.astype(np.float64) @ v.astype(np.float64).T
    np.fill_diagonal(s, -np.inf)
    ids = np.arange(len(v))
    for cell, block in ((4096, 8192), (40, 16)):
        monkeypatch.setattr(ne, "CELL", cell)
        monkeypatch.setattr(ne, "BLOCK", block)
        got = ne.nearest(spark.createDataFrame(rows, KIND), F.col("id") % 10 == 0).collect()
        hits = total = 0
        for q in range(0, len(v), 10):
            mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
            assert [r.rank for r in mine] == list(range(1, 21))
            assert all(abs(r.score - s[q, r.id]) < 1e-9 for r in mine)
            assert mine == sorted(mine, key=lambda r: (-r.score, r.id))
            best = set(np.lexsort((ids, -s[q]))[:20])
            hits, total = hits + len(best & {r.id for r in mine}), total + 20
        assert hits / total >= 0.9
    few = spark.createDataFrame(rows[:5], KIND)
    assert ne.nearest(few, F.col("id") == 0).count() == 4
    assert ne.nearest(spark.createDataFrame([], KIND), F.col("id") == 0).count() == 0


def test_cells_that_all_queries_ask_are_met_in_parts(spark, monkeypatch):
    for name, value in (("CELL", 200), ("BLOCK", 256), ("ASKED", 128)):
        monkeypatch.setattr(ne, name, value)
    one = spark.range(6000).select((F.col("id") % 4000).alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0), F.lit(-1.0)).alias("embedding"))
    got = ne.nearest(one, F.col("id") % 10 == 0).collect()  # one vector, 2,000 ids twice, so all lie in one cell and every query asks it
    by_query = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by_query.setdefault(r.query_id, []).append(r.id)
    twice = [k for k in range(30) for _ in range(2)]
    assert len(by_query) == 400 and all(abs(r.score - 6) < 1e-9 for r in got)
    assert all(ids == [k for k in twice if k != q][:20] for q, ids in by_query.items())

    points = spark.range(6000).select(F.lit(3).alias("cell"), F.lit(5).cast("long").alias("id"), F.col("id").alias("row"), F.lit(None).alias("vector"), F.lit(None).alias("proj"))
    routed = spark.range(2000).select("id", F.lit(None).alias("vector"), F.lit(None).alias("proj"), F.lit(0.0).alias("bound"), F.array(F.lit(3)).alias("cells"))
    here, sent = ne.dealt(points.unionByName(points.withColumn("cell", F.lit(4))), routed, {3: 6000, 4: 6000})
    blocks = {tuple(r)[:3]: r[3] for r in here.groupBy("cell", "block", "part").count().collect()}
    parts = {tuple(r)[:3]: r[3] for r in sent.groupBy("cell", "block", "part").count().collect()}
    assert blocks.keys() == parts.keys() and {k[0] for k in blocks} == {3} and len(blocks) == 24 * 16
    assert max(blocks.values()) < 2 * 256 and max(parts.values()) < 2 * 128
    assert sum(n * parts[k] for k, n in blocks.items()) == 6000 * 2000  # each point meets each query once
    assert ne.dealt(points, routed.withColumn("cells", F.array().cast("array<int>")), {3: 6000}) is None


def test_routing_through_all_cells_takes_little_memory():
    rng = np.random.default_rng(1)
    low = rng.standard_normal((ne.MAX_CELLS, ne.DIMS))
    high, cells = low + rng.random(low.shape), rng.permutation(ne.MAX_CELLS)
    p, own, far = rng.standard_normal((ne.ROUTED, ne.DIMS)), rng.integers(0, ne.MAX_CELLS, ne.ROUTED), np.full(ne.ROUTED, 4.0)
    far[0] = np.inf
    tracemalloc.start()
    n, to = ne.asked_cells(p, own, far, cells, low, high, 0, ne.MAX_CELLS)
    assert tracemalloc.get_traced_memory()[1] < 64 << 20
    tracemalloc.stop()
    assert n[0] == ne.MAX_CELLS and sorted(to[: n[0]]) == list(range(ne.MAX_CELLS))
    for k, mine in enumerate(np.split(to, np.cumsum(n)[:-1])):
        gap = (np.clip(p[k], low, high) - p[k]) ** 2
        near = {int(c) for c, g in zip(cells, gap.sum(1)) if g <= far[k]} | {int(own[k])}
        assert mine[0] == own[k] and set(mine.tolist()) == near


def test_chi_square():
    assert abs(ne.chi_square_quantile(0.95, 8) - 15.507) < 1e-3 and abs(ne.chi_square_quantile(0.5, 2) - 1.386) < 1e-3


def test_similar_documents_of_empty_tables_repeats_and_clashing_names(spark):
    text = " ".join("w%d" % k for k in range(50))
    rows = [(3, text, 1), (3, text, 2), (3, text + " more", 3), (1, text, 4), (None, text, 5), (7, "other words here", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x int").withColumn("component", F.lit("c")).withColumn("n", F.lit(None).cast("int"))
    got = sorted(((r.id, r.component_id) for r in sh.similar_documents(df).collect()), key=repr)
    assert got == sorted([(3, 1), (3, 1), (3, 1), (1, 1), (None, None), (7, 7)], key=repr)
    assert sh.similar_documents(df.where("false")).count() == 0
    assert sh.similar_documents(df.where("id is null") if "id" in df.columns else df.where("doc_id is null")).collect() == [(None, None)]


def test_ids_with_several_vectors(spark):
    v = vectors()
    rows = [(1, v[0].tolist(), 0), (1, v[200].tolist(), 0), (2, v[1].tolist(), 0), (3, v[200].tolist(), 0), (4, (-v[200]).tolist(), 0)]
    got = sorted((r.id, r.n_links, r.component_id) for r in mj.near_vectors(spark.createDataFrame(rows, KIND)).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]
    asked = [(r.query_id, r.id) for r in ne.nearest(spark.createDataFrame(rows, KIND), F.col("id") == 1).collect()]
    assert sorted(i for _, i in asked) == [2, 3, 4] and all(q == 1 for q, _ in asked)


def test_the_search_stops_at_the_first_leaf_beyond_the_radius(monkeypatch):
    rng = np.random.default_rng(5)
    points = np.concatenate([c + 0.01 * rng.standard_normal((300, 8)) for c in 3 * rng.standard_normal((20, 8))])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    proj, ids = points @ rng.standard_normal((8, 8)), np.arange(len(points))
    at, seen = np.arange(0, 6000, 300), []
    split = np.split
    monkeypatch.setattr(ne.np, "split", lambda x, *a: seen.append(len(x)) or split(x, *a))
    row, i, s = ne.search(points, ids, proj, points[at], ids[at], proj[at], np.full(len(at), -np.inf), 20, ne.chi_square_quantile(ne.SURE, 8), 1.0)
    assert len(row) == 20 * len(at) and sum(seen) < 0.4 * len(at) * (len(points) / ne.LEAF)  # far from all leaves are verified
    truth = points[at] @ points.T
    truth[np.arange(len(at)), at] = -np.inf
    assert np.mean([len(set(np.argsort(-truth[k])[:20]) & set(i[row == k])) for k in range(len(at))]) >= 18
