import random

import corpus_pipeline as cp
from notemill.llm import simhash

from .test_similarity import roots


def test_stages_on_planted_cases(spark, tmp_path):
    rng = random.Random(2)
    words = ["w%d" % k for k in range(3000)]
    text = lambda n: "\n".join(" ".join(rng.choice(words) for _ in range(40)) for _ in range(n))
    rows, labels = [], []
    for k in range(400):
        toxic = int(k % 8 == 0)
        t = text(5)
        if toxic:
            t = t.replace(" ", " idiot ", 2).replace("\n", "\nscum ", 2)
        rows.append((k, t, "en", f"s{k % 3}"))
        labels.append((k, 1, toxic))
    rows += [(1000, rows[1][1], "en", "s1"), (1001, rows[3][1].rsplit(" ", 2)[0] + " other end", "en", "s0"), (1002, "an 1d10t\nand scum here", "en", "s0"), (1003, None, None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        now = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen[name] = now
        if name != "bpe":
            assert now.columns == docs.columns
    kept = {r.doc_id for r in seen["toxicity"].select("doc_id").collect()}
    toxic = {k for k, _, y in labels if y} | {1002}
    assert not kept & toxic and len(kept) >= 0.98 * (len(rows) - len(toxic))
    lines = {r.doc_id: r for r in seen["line_dedup"].collect()}
    assert lines.keys() == kept and lines[1000].text == "" and lines[1].text and lines[1].n_chars == len(lines[1].text)
    left = {r.doc_id for r in seen["simhash"].select("doc_id").collect()}
    assert 1 in left and 3 in left and left <= kept
    assert len([k for k in (1000, 1003) if k in left]) == 1  # both are empty by now
    assert seen["mixing"].count() > 0 and {r.doc_id for r in seen["mixing"].collect()} <= left
    last = seen["bpe"].collect()
    assert all(r.n_tokens == len(r.ids) for r in last) and len(last) == seen["mixing"].count()
    assert cp.run(spark, str(tmp_path)).count() == len(last)


def test_simhash_stage_links_by_fingerprints(spark, tmp_path):
    """As op8: three words, three bits; a pair that shares under 0.8 of its runs of five words is linked if its fingerprints are close."""
    rng = random.Random(4)
    texts = []
    for _ in range(60):
        words = ["w%d" % rng.randrange(900) for _ in range(220)]
        texts.append(" ".join(words))
        for at in range(5, 220, 37):
            words[at] = "x%d" % rng.randrange(900)
        texts.append(" ".join(words))
    marks = [simhash.fingerprint(t.encode(), 3) for t in texts]
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if bin(marks[a] ^ marks[b]).count("1") <= 3]
    assert any(len(shingles[a] & shingles[b]) < 0.8 * len(shingles[a] | shingles[b]) for a, b in pairs)
    found = roots(len(texts), pairs)
    docs = spark.createDataFrame([*enumerate(texts), (None, texts[0])], "doc_id long, text string")
    left = cp.simhash_stage(spark, docs, str(tmp_path)).select("doc_id").collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == sorted(set(found)) and len(left) == len(set(found)) + 1
