import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notemill.llm import bpe, token_files as tf

ALPHABET = list("abthe 'sdTHE.,!?01\n\t") + ["é", "ß", "Σ", "İ", "é", "한", "각", "中", "😀", "\xa0", "　", "\x1c", "<|endoftext|>", "<|", "'ll", "ing", "the", "\x00"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.word_file())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=60))
def test_encoder_equals_the_library(parts):
    from tokenizers import Tokenizer

    global _LIB
    _LIB = globals().get("_LIB") or Tokenizer.from_file(bpe.word_file())
    text, model, memo = "".join(parts), bpe.load(bpe.word_file()), bpe._ids_memo(bpe.word_file())
    want = _LIB.encode(text, add_special_tokens=False).ids
    assert [i for w in text.encode().split() for i in model.encode(w.decode())] == want
    assert [i for w in bpe.pieces_of(text) for i in memo[w]] == want
    words = tf.library_words(bpe.word_file())
    known = words.learn(set(bpe.pieces_of(text)))
    assert b"".join(known[w] for w in bpe.pieces_of(text)) == np.array(want, "<u4").tobytes()


def test_long_words_stream_in_bounded_memory(library):
    model = bpe.load(bpe.word_file())
    rng = np.random.default_rng(0)
    for word in ("a" * 9000, "".join(rng.choice(list("thenigaro"), 9000)), "haha" * 2000, "😀" * 3000, "!" * 9000):
        symbols = model.symbols(word)
        assert list(model.stream(iter(symbols))) == library.encode(word, add_special_tokens=False).ids == model.encode(word)


@settings(max_examples=300, deadline=None)
@given(st.text("aeinrstlhoguc", min_size=1, max_size=120), st.integers(1, 7))
def test_stream_equals_the_merges_of_the_whole_word(word, step):
    model = bpe.load(bpe.word_file())
    assert list(model.stream(iter(model.symbols(word)), step)) == model.merge(model.symbols(word))


def test_tokens_of_ordinary_long_words_are_emitted_early():
    model = bpe.load(bpe.word_file())
    word = "donaudampfschifffahrtsgesellschaftskapitaensmuetzenhersteller" * 20
    read, ahead = 0, []

    def symbols():
        nonlocal read
        for s in model.symbols(word):
            read += 1
            yield s

    done = 0
    for t in model.stream(symbols()):
        done += model.width[t]
        ahead.append(read - done)
    assert max(ahead) <= 128 < model.lookahead  # far less than the merge list's own lookahead


def test_digest_of_a_long_text_takes_constant_memory():
    import tracemalloc

    words = ["the", "Cat's", "m0r0n,", "größe", "中文", "x" * 30]
    rng = np.random.default_rng(3)
    peak = []
    for n in (200_000, 1_600_000):
        text = " ".join(rng.choice(words, n))
        bpe.Digest(bpe.word_file()).read(text[:1000])
        tracemalloc.start()
        bpe.Digest(bpe.word_file()).read(text)
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak[1] < 1.5 * peak[0] + 100_000 and peak[1] < 8 << 20


def test_digest_of_texts_over_slices_and_long_pieces(library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    for text in ("the cat " * 100, "a" * 300 + " b", " " * 200, "x " + "hello,world" * 40 + "\u3000" + " \u3000 y", "", "İΣ" * 60 + "\n" + "é" * 80):
        ids = library.encode(text, add_special_tokens=False).ids
        d = bpe.Digest(bpe.word_file()).read(text)
        assert (d.n, d.ids.hexdigest()) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert d.text.hexdigest() == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_what_follows_never_changes_final_tokens(library):
    """The lookahead holds: tokens that end a lookahead before the end of a prefix stand in every continuation."""
    model, rng = bpe.load(bpe.word_file()), np.random.default_rng(1)
    look = model.lookahead
    for _ in range(20):
        word = "".join(rng.choice(list("aeionrstlh"), look + 200))
        done, stable = 0, []
        for t in model.merge(model.symbols(word)[:-1]):
            done += model.width[t]
            if done > len(word) - 1 - look:
                break
            stable.append(t)
        for tail in ("", "ing", "".join(rng.choice(list("aeionrstlh"), 50))):
            assert model.merge(model.symbols(word + tail))[: len(stable)] == stable


def test_decoder_is_incremental():
    model = bpe.load(bpe.word_file())
    machine, text = bpe.Decoder(model), "wörld's 中😀 ok <|endoftext|> end"
    ids = model.encode(text)
    assert "".join([*map(machine.feed, ids), machine.close()]).split() == ["wörld", "'s", "中", "😀", "ok", "<|endoftext|>end"]
    assert machine.feed(10**9) == ""


ROWS = [(3, "The cat"), (1, None), (2, ""), (None, "x y"), (3, "The cat"), (9, "ß " * 4000), (-4, "  \n"), (5, "　")]


def test_digests_and_round_trip(spark, library):
    df = spark.createDataFrame([(*r, 0) for r in ROWS], "doc_id long, text string, ids int")
    got = sorted(map(tuple, bpe.digests(df).collect()), key=repr)
    want = []
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    back = bpe.decode_documents(bpe.encode_documents(df.select("doc_id", "text"))).collect()
    assert {r.text.strip() for r in back if r.doc_id == 3} == {"the cat"}


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_files(spark, tmp_path, library, mode, monkeypatch):
    df = spark.createDataFrame([(*r, "s") for r in ROWS], "doc_id long, text string, shard string")
    tf.write_token_files(df, str(tmp_path / mode), mode=mode)
    start, want = 0, []
    for i, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tf.read_token_files(spark, str(tmp_path / mode)).collect()), key=lambda r: r[1]) == want
    long = len(library.encode(ROWS[5][1], add_special_tokens=False).ids)
    assert {r.id: len(r.tokens) for r in tf.read_ids(spark, str(tmp_path / mode)).collect()}[9] == long + 1
    tf.write_token_files(df.where("false"), str(tmp_path / "none"), mode=mode)
    assert tf.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_documents_longer_than_a_frame(spark, tmp_path, library, monkeypatch):
    monkeypatch.setattr(tf, "CHUNK", 50)
    rows = [(k, "the cat " * (k * 7 % 90), None) for k in range(40)] + [(5, "repeated", 1), (5, "repeated", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk int").repartition(3)
    tf.write_token_files(df, str(tmp_path / "f"))
    start, want = 0, []
    for i, t, _ in sorted(rows, key=lambda r: (r[0], r[1])):
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tf.read_token_files(spark, str(tmp_path / "f")).collect()), key=lambda r: r[1]) == want
    assert spark.read.parquet(str(tmp_path / "f")).where("n_docs = 1 and n_ids > 50").count() > 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from(["byte", "bit"]), st.integers(1, 64))
def test_planes_round_trip(ids, mode, block):
    ids = np.array(ids, "<u4")
    frame = tf.pack(ids, np.array([len(ids)]), mode, block)
    assert (tf.unpack(frame)[0] == ids).all() and tf.unpack(frame)[1].tolist() == [len(ids)]
    if len(ids) > block:
        assert (tf.unpack(frame, range(1, 2))[0] == ids[block : 2 * block]).all()
    with pytest.raises(ValueError):
        tf.unpack(b"x" + frame[1:])
