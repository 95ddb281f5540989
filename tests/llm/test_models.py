import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from notemill.llm import context_mixing as cm, language_id as li, toxicity as tx

WORDS = {
    "en": "the quick brown fox jumps over lazy dog and runs away from every house in town".split(),
    "de": "der schnelle braune fuchs springt über den faulen hund und läuft weg vom großen haus".split(),
    "fr": "le rapide renard brun saute par dessus le chien paresseux et court très loin déjà".split(),
}


def corpus(n=400, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        lang = list(WORDS)[k % 3]
        out.append((k, " ".join(rng.choice(WORDS[lang], rng.integers(5, 60))), lang))
    return out


def test_base_score_and_counts_equal_brute_force(spark, monkeypatch):
    rows = [(k, t) for k, t, _ in corpus(120)] + [(500, None), (501, ""), (502, "  \n "), (None, "the Fox"), (503, "x" * 3000), (503, "x" * 3000), (504, "ÀÉ \x00\x01 the THE")]
    words = re.compile(r"[^\x20\x09-\x0D]+")
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    counts = Counter()
    for k, t in rows:
        if zlib.crc32(("" if k is None else str(k)).encode()) % 7 != 2:
            counts.update([*words.findall(low(t)), None])
    total = sum(counts.values())
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, token string")
    seen = []
    for bucket, chunk in ((cm.BUCKET, cm.CHUNK), (2000, 40)):
        monkeypatch.setattr(cm, "BUCKET", bucket)
        monkeypatch.setattr(cm, "CHUNK", chunk)
        got = cm.score_texts(df).collect()
        assert len(got) == len(rows)
        texts = {(k, len(words.findall(t or ""))): t for k, t in rows}
        for r in got:
            tokens = [*words.findall(low(texts[r.id, r.n_tokens - 1])), None]
            base = sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in tokens)
            assert r.held_out == (zlib.crc32(("" if r.id is None else str(r.id)).encode()) % 7 == 2)
            assert (r.n_known, r.train_tokens) == (sum(counts[w] > 0 for w in tokens), total)
            assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0 and math.isfinite(r.score)
        seen.append(sum(r.score for r in got if r.held_out) / sum(r.base_score for r in got if r.held_out))
    assert max(seen) < 1.1
    assert cm.score_texts(df.where("false")).count() == 0
    assert cm.score_texts(df.where("doc_id = 501")).count() == 1


def test_chunks_never_part_a_words_rows(monkeypatch):
    monkeypatch.setattr(cm, "CHUNK", 6)
    monkeypatch.setattr(cm, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("Now", (), {"partitionId": lambda self: 0})())}))
    rows = [(w, b) for w, n in ((b"a ", 2), (b"b ", 3), (b"c ", 1), (b"d ", 9), (b"e ", 2), (b"f ", 1)) for b in range(n)]  # c alone after b's rows

    def batches():
        for at in range(0, len(rows), 3):
            part = rows[at : at + 3]
            one = pa.array([np.array([1], "<i4").tobytes()] * len(part), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([b for _, b in part], pa.int64()), pa.array([0] * len(part), pa.int32()), pa.array([1] * len(part), pa.int32()), one], names=["token", "bucket", "code", "mask", "n"])

    found = []
    for out in cm.pack_chunks(batches()):
        row = out.to_pylist()[0]
        found += zip(cm.tokens_of(row["data"], row["lengths"]).to_pylist(), cm.grow(row["n"], np.int64).tolist())
    assert found == [(b"a ", 2), (b"b ", 3), (b"c ", 1), (b"d ", 9), (b"e ", 2), (b"f ", 1)]


def chunk(pairs, trained=False):
    """A chunk of {(word, state): training count}."""
    words, n_states = sorted({w for w, _ in pairs}), max(s for _, s in pairs) + 1
    n, mask = np.zeros((len(words), n_states), np.int64), np.zeros(len(words), np.int32)
    for (w, s), c in pairs.items():
        n[words.index(w), s], mask[words.index(w)] = c, mask[words.index(w)] | 1 << s
    out = cm.Chunk(*map(cm.squeeze, (np.frombuffer(b"".join(words), np.uint8), np.array(list(map(len, words)), np.int32), n, mask)), trained)
    out.pairs = pairs
    return out


def counted_only(part):
    part = chunk({(w, s): c for (w, s), c in part.pairs.items()}, True)
    assert (part.count > 0).all()
    return part


def some_pairs():
    rng = random.Random(7)
    words = sorted({b"a ", b"ab ", b"abc ", b"b ", b"ba ", "é ".encode(), b"\n", b"x" * 90 + b" ", b"x" * 60 + b" "})
    return {(w, s): rng.randrange(6) for w in words for s in range(3) if rng.random() < 0.7 or s == 1}


def bits(w, n):
    return "".join(f"{b:08b}" for b in w)[:n]


def counted(pairs, w, state, n):
    """How often the first n bits of w start a word, in all states and in one."""
    same = [(s, c) for (x, s), c in pairs.items() if len(x) * 8 >= n and bits(x, n) == bits(w, n)]
    return sum(c for _, c in same), sum(c for s, c in same if s == state)


def test_chunk_counts_are_prefix_counts():
    pairs = some_pairs()
    names, words = sorted(pairs), sorted({w for w, _ in pairs})

    def check(part, totals, own):
        for rows, p, b, bit, node, before, after in part.walk(totals):
            for k, row in enumerate(rows):
                (w, s), at = own[row], 8 * p + b
                assert bit[k] == int(bits(w, at + 1)[-1])
                assert (before[0][k], before[1][k]) == counted(pairs, w, s, at) and (after[0][k], after[1][k]) == counted(pairs, w, s, at + 1)

    check(chunk(pairs), {}, names)
    check(chunk(pairs, True), {}, [x for x in names if pairs[x]])
    for k in range(1, len(words)):  # two chunks with their edges' sums give the same
        halves = [{x: c for x, c in pairs.items() if (x[0] < words[k]) == first} | {} for first in (True, False)]
        wide = [chunk(h | {(sorted(h)[0][0], 2): h.get((sorted(h)[0][0], 2), 0)}) for h in halves]  # all states in both
        totals, shared = {}, Counter()
        for h in wide:
            for x, n in h.edge_sums().items():
                totals[x] = totals.get(x, 0) + n
                shared[x] += 1
        for h, own in zip(wide, halves):
            check(h, {x: n for x, n in totals.items() if shared[x] > 1}, sorted(own | {(sorted(own)[0][0], 2): 0}))


def test_scores_equal_brute_force():
    pairs = some_pairs()
    part = chunk(pairs)
    low = cm.LowCounts()
    low.add(part)
    zeros, ones = low.counts()
    stretch = np.log((ones + 0.4) / (zeros + 0.4)).astype(np.float32)
    m = cm.Mixer()
    m.weights, _, m.ones, m.all = cm.learn(counted_only(part), {}, stretch)
    refined = m.map()
    counts = Counter()  # hashed cells, bit by bit
    for (w, s), c in pairs.items():
        for at in range(8 * len(w)):
            p, b = divmod(at, 8)
            for k, (order, _) in enumerate(cm.ORDERS):
                context = cm.hashed([np.array([w[p - j - 1] if p > j else 0x100 + s], np.uint32) for j in range(order)], 1)
                node = np.array([(1 << b) | (w[p] >> (8 - b))])
                counts[k, int(cm.cells(context, node, k)[0]), (w[p] >> (7 - b)) & 1] += c
    for k in range(len(cm.ORDERS)):
        for cell in range(cm._FIRST[k], cm._FIRST[k + 1]):
            if zeros[cell] or ones[cell]:
                assert (zeros[cell], ones[cell]) == (counts[k, cell - cm._FIRST[k], 0], counts[k, cell - cm._FIRST[k], 1])
    got = cm.scores(part, {}, stretch, m.weights, refined)
    for row, (w, s) in enumerate(sorted(pairs)):
        if len(w) > cm.DEEP:
            continue
        value = 0.0
        for at in range(8 * len(w)):
            p, b = divmod(at, 8)
            here = [counted(pairs, w, s, at), counted(pairs, w, s, at + 1)]
            y = int(bits(w, at + 1)[-1])
            n, ns = [(here[0][k] - here[1][k], here[1][k])[:: 1 if y else -1] for k in (0, 1)]
            gate = min(sum(ns).bit_length(), 7) * 4 + 2 * (0 in ns) + (sum(n) > 4 * sum(ns))
            odds = m.weights[gate, -1] * 0.3 + sum(m.weights[gate, k] * math.log((c[1] + 0.1) / (c[0] + 0.1)) for k, c in ((-3, n), (-2, ns)))
            for k, (order, _) in enumerate(cm.ORDERS):
                context = cm.hashed([np.array([w[p - j - 1] if p > j else 0x100 + s], np.uint32) for j in range(order)], 1)
                odds += m.weights[gate, k] * stretch[cm._FIRST[k] + int(cm.cells(context, np.array([(1 << b) | (w[p] >> (8 - b))]), k)[0])]
            odds = max(-12.0, min(12.0, odds))
            one = 0.5 / (1 + math.exp(-odds)) + 0.5 * refined[gate * cm.STEPS + min(cm.STEPS - 1, max(0, int((odds + 8) * 4)))]
            value += math.log10(min(1, max(1e-6, one if y else 1 - one)))
        assert abs(got[row] - value) < 1e-3 * abs(value) + 1e-4


def test_a_words_probabilities_sum_to_at_most_one_in_each_state():
    words = sorted({bytes([a, b, 32]) for a in b"abc" for b in b"abc"})
    part = chunk({(w, s): (k * (s + 1)) % 5 for k, w in enumerate(words) for s in range(2)})
    low = cm.LowCounts()
    low.add(part)
    zeros, ones = low.counts()
    stretch = np.log((ones + 0.4) / (zeros + 0.4)).astype(np.float32)
    m = cm.Mixer()
    m.weights, _, m.ones, m.all = cm.learn(counted_only(part), {}, stretch)
    value = 10 ** cm.scores(part, {}, stretch, m.weights, m.map())
    assert all(0.2 < value[part.state == s].sum() <= 1 + 1e-9 for s in range(2))


def test_adaptive_part_is_a_distribution():
    codes = np.array([1, 2, 1, 2, 1, 2, 3])
    logs = np.full(8, -math.log(8))
    last = [10 ** (cm.adapted(np.append(codes, x), np.full(len(codes) + 1, logs[0])) - cm.adapted(codes, np.full(len(codes), logs[0]))) for x in range(8)]
    assert abs(sum(last) - 1) < 1e-9


def test_adaptive_part_of_many_texts(monkeypatch):
    rng = np.random.default_rng(8)
    lengths = np.array([1, 30, 2, 1, 400, 7, 90])
    codes, logs = rng.integers(0, 9, lengths.sum()), -rng.random(lengths.sum()) * 9 - 1
    ends = np.cumsum(lengths)
    want = [cm.adapted(codes[b - n : b], logs[b - n : b]) for n, b in zip(lengths, ends)]
    for bits in (18, 6, 2):
        monkeypatch.setattr(cm, "PLACE", bits)
        assert np.allclose(cm.adapted_texts(codes, logs, lengths), want)


def test_states_follow_the_words_before(monkeypatch):
    rng = np.random.default_rng(0)
    counts = np.vstack((rng.poisson([5, 5, 0, 0], (50, 4)), rng.poisson([0, 0, 5, 5], (50, 4))))
    model = cm.start_classes(counts, [b"a ", b"b ", b"c ", b"d "], 2)
    for _ in range(3):
        doc, word = np.nonzero(counts)
        model = cm.updated_classes([b"a ", b"b ", b"c ", b"d "], *cm.expected(model, doc, word, counts[doc, word]))
    assert np.allclose(np.exp(model.words).sum(0), 1) and np.isclose(np.exp(model.share).sum(), 1)
    best = (counts @ model.words + model.share).argmax(1)
    assert len(set(best[:50])) == len(set(best[50:])) == 1 and best[0] != best[99]
    word = np.array([-1, 0, 1, 0, -1, 2, 2, -1, 3, 2, 1, -1] + [0] * 9 + [-1, 3, 3])
    lengths = np.array([5, 1, 6, 0, 10, 2])
    want, at = [], 0
    for n in lengths:
        value, seen = model.share.copy(), False
        for w in word[at : at + n]:
            want.append(1 + int(value.argmax()) if seen else 0)
            if w >= 0:
                value, seen = value + model.words[w], True
        at += n
    for size in (1 << 16, 4, 1):
        monkeypatch.setattr(cm, "SLICE", size)
        assert cm.states(model, word, lengths).tolist() == want
    assert cm.start_classes(np.zeros((0, 0)), [], 5).states == 2


def test_the_mixer_beats_the_base_on_held_out_texts(spark):
    df = spark.createDataFrame([(k, t) for k, t, _ in corpus(900)], "doc_id long, text string")
    got = [r for r in cm.score_texts(df).collect() if r.held_out]
    base = sum(r.base_score for r in got)
    assert sum(r.model_score for r in got) / base < 0.95 and sum(r.score for r in got) / base < 0.97


def test_language(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 0.5) for r in rows] + [(9000, None, "en", 0.5), (9001, "12 !?", "en", 0.5), (None, "the fox", "en", 0.5), (9002, "der hund", None, 0.5), (9003, "", "zz", 0.5)], "doc_id long, text string, lang string, score double")
    model = li.fit(df)
    got = {r.doc_id: r for r in li.with_language(df.select("doc_id", "text"), model).collect()}
    held = [(got[k].lang_pred, lang) for k, _, lang in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) > 0.97
    assert (got[9000].lang_pred, got[9001].lang_pred, got[9003].lang_pred) == ("und",) * 3 and got[9002].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert li.fit(df.where("lang = 'none'")) is None
    none = li.with_language(df.select("doc_id", "text"), None)
    assert {r.lang_pred for r in none.collect()} == {"und"} and li.with_language(df.where("false").select("text"), model).count() == 0


def test_numerals_are_no_letters_and_clashing_names_are_replaced(spark):
    model = li.fit(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    df = spark.createDataFrame([("½ ² Ⅷ 12", 1.0, "x"), ("😀 !", 2.0, "y"), ("", 3.0, "z"), (None, 4.0, "z"), ("der hund", 5.0, "z")], "text string, score double, lang_pred string").withColumn("_found", F.lit(7))
    got = li.with_language(df, model)
    assert sorted(got.columns) == sorted(df.columns)
    assert [r.lang_pred for r in got.collect()] == ["und"] * 4 + ["de"] and {r._found for r in got.collect()} == {7}


def test_samples_of_tied_rows_are_bounded(spark, monkeypatch):
    rows = [(None, f"the fox {k}", "en") for k in range(4000)] + [(None, "der hund", "de")] * 6000 + [(k, "le renard %d" % k, "fr") for k in range(30)]
    seen = []
    monkeypatch.setattr(li, "Classifier", lambda languages, landmarks, weights, offset: seen.append(languages))
    count = li.kernel
    monkeypatch.setattr(li, "kernel", lambda x, y: seen.append(len(x)) or count(x, y))
    li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert seen[-1] == ["de", "en", "fr"] and sum(x for x in seen[1:-1]) <= 2 * li.SAMPLE + 30


def test_with_all_rows_as_landmarks_the_regression_is_kernel_ridge(spark, monkeypatch):
    rows = corpus(90, 3)
    train = [(t, lang) for k, t, lang in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    monkeypatch.setattr(li, "LANDMARKS", 3 * len(train))
    model = li.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    x = np.stack([li.grams(t) for t, _ in train]).astype(np.float64)
    k = (x @ x.T) / np.sqrt(np.outer(x.sum(1), x.sum(1)))
    names = sorted({lang for _, lang in train})
    place = np.array([names.index(lang) for _, lang in train])
    y = np.where(place[:, None] == np.arange(3), 1.0, -1.0)
    share = 1 / np.bincount(place)[place]
    share *= len(share) / share.sum()
    s = share / share.sum()
    centred = k - (s @ k)[None] - (k @ s)[:, None] + s @ k @ s
    alpha = np.linalg.solve(share[:, None] * centred + li.RIDGE * np.eye(len(k)), share[:, None] * (y - s @ y))
    for text in ["the dog and der hund", "le chien", "fox", *[t for _, t, _ in rows[:20]]]:
        g = li.grams(text).astype(np.float64)
        kx = (x @ g) / np.sqrt(x.sum(1) * g.sum())
        want = s @ y + (kx - s @ kx - k @ s + s @ k @ s) @ alpha
        got = g.astype(np.float32) @ model.matrix / np.sqrt(g.sum()) + model.offset
        assert np.allclose(got, want, atol=0.02), (got, want)


def test_kernel_counts_common_grams():
    a, b = li.grams("ab"), li.grams("abc")
    k = li.kernel(np.stack([a]).astype(np.float32), np.stack([b]).astype(np.float32))[0, 0]
    assert abs(k - (a & b).sum() / math.sqrt(a.sum() * b.sum())) < 1e-6 and li.grams("").sum() <= 2


def toxic_rows():
    rng = np.random.default_rng(4)
    bad, rows, labels = ["idiot", "moron", "worthless"], [], []
    for k in range(600):
        words = list(rng.choice(WORDS["en"], 30))
        toxic = int(k % 5 == 0)
        for at in rng.integers(0, 30, 3 * toxic):
            words[at] = bad[rng.integers(3)]
        rows.append((k, " ".join(words)))
        labels.append((k, toxic))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    hidden = [(5000, "such an 1d10t he is"), (5001, "m 0 r o n in town"), (5002, "idiooooot"), (5003, "w0rthl3ss dog"), (5004, "i.d.i.o.t and fox")]
    clean = [(6000, "the year 2024, page 10 and 3.5 of every house"), (6001, None), (6002, ""), (None, "the dog"), (6003, "a a a a in in!!"), (6004, "x" * 5000)]
    df = spark.createDataFrame([(*r, 1) for r in rows + hidden + clean], "doc_id long, text string, score int")
    ys = spark.createDataFrame([*labels, (None, 1), (7000, None), (7001, 5)], "doc_id long, toxic int")
    model = tx.fit(df.select("doc_id", "text"), ys)
    got = {r.doc_id: r.s for r in tx.with_scores(df, model, name="s").collect()}
    assert all(got[k] >= 0.5 for k, _ in hidden), {k: got[k] for k, _ in hidden}
    assert all(got[k] < 0.5 for k, _ in clean) and all(0 <= s <= 1 for s in got.values())
    held = [(got[k] >= 0.5) == bool(y) for k, y in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum(held) / len(held) > 0.97
    for only in (0, 1):
        flat = tx.fit(df.select("doc_id", "text"), ys.where(F.col("toxic") == only))
        assert abs(tx.with_scores(df.where("doc_id = 6002"), flat, name="s").first().s - (0.001 if only == 0 else 0.999)) < 1e-9
    assert tx.with_scores(df.where("false"), model).count() == 0


def word_model(words):
    counts = np.zeros(1 << 20)
    for w in words:
        np.add.at(counts, tx.sequence_counts(w), 1)
    return tx.CharModel(counts).log


def test_restore_prefers_known_words():
    r = tx.Restorer(word_model("idiot moron scum stupid trash shit cunt ass worthless you are so".split() * 50))
    for disguised, word in (
        ("1d10t", "idiot"), ("m0r0n", "moron"), ("$cum", "scum"), ("st-up-id", "stupid"), ("tr@sh", "trash"), ("i d i o t", "idiot"), ("idioooot", "idiot"),
        ("shi7", "shit"), ("cun7", "cunt"), ("a$$", "ass"), ("idi0+", "idiot"), ('"1d10t"', "idiot"), ("(m0r0n)", "moron"), ("and/1d10t/or", "idiot"),
        ("1d10t" + "!" * 40, "idiot"), ("w . o . r . t . h . l . e . s . s", "worthless"), ("m   o   r   o   n", "moron"), ("m\n0\nr\n0\nn", "moron"),
        (" ".join("youaresostupid" * 4), "stupid"), ("1di0" + "o" * 300 + "t", "idiot"),
    ):
        assert word in r.words(f"and {disguised} then"), (disguised, r.words(f"and {disguised} then"))
    assert r.words("clean words, only 12 of them. (so) 3.5") == {"clean", "words", "only", "of", "them", "so"}
    nine = "m0r0n" * 9
    assert "moron" * 9 in r.words(f"x {nine} y")


def test_restore_equals_an_exhaustive_search():
    log = word_model("idiot moron scum stupid trash sit tot it is no".split() * 20)

    def every(stretch, at=0, context=0, last="", score=0.0, out=""):
        if at == len(stretch):
            yield score + (float(log[context << 5]) if context & 31 else 0.0), out
            return
        ch = stretch[at]
        if ch == tx.GAP:
            yield from every(stretch, at + 1, context, last, score, out)
            if context & 31:
                yield from every(stretch, at + 1, (context << 5) & 0x7FFF, "", score - tx.BREAK + float(log[context << 5]), out + " ")
            return
        for letter, cost in [(ch, 0.0)] if ch.isalpha() else [(x, tx.SWAP) for x in tx.LOOKS_LIKE.get(ch, "")]:
            cell = (context << 5) | tx.class_of(letter)
            yield from every(stretch, at + 1, cell & 0x7FFF, letter, score - cost + float(log[cell]), out + letter)
            if letter == last:
                yield from every(stretch, at + 1, context, last, score - cost - tx.REPEAT, out)
        if not ch.isalpha():
            yield from every(stretch, at + 1, context, last, score - tx.DROP, out)

    rng = random.Random(6)
    for _ in range(150):
        stretch = "".join(rng.choice("idotmrnsu1!0$7@*-iott" + tx.GAP) for _ in range(rng.randrange(1, 9)))
        best = max(v for v, _ in every(stretch))
        assert any(abs(v - best) < 1e-4 for v, out in every(stretch) if out == tx.restore(stretch, log)), stretch


def test_toxicity_without_documents_and_with_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    ys = spark.createDataFrame([(1, 1), (2, 0), (1, 0)], "doc_id long, toxic int")
    flat = tx.fit(none, ys)
    assert tx.with_scores(none, flat).count() == 0
    rows, labels = toxic_rows()
    df = spark.createDataFrame([*rows, *rows[:50], *[(0, "idiot")] * 500, (None, "idiot")], "doc_id long, text string")
    model = tx.fit(df, spark.createDataFrame([*labels, *labels], "doc_id long, toxic int"))
    got = tx.with_scores(df.withColumn("score", F.lit("own")), model).collect()
    assert len({(r.text, r.score) for r in got}) == len({r.text for r in got}) and len(got) == len(rows) + 551
