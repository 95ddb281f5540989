"""Phrase collocations by hashed candidate counting: each pass counts phrases exactly and buckets of the next length."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import stored, table, text_of

#: Parameters of the query: words of a phrase, least count, percent from which a longer phrase covers a shorter, phrases a language.
LONGEST, LEAST, COVER, TOP = 3, 10, 50, 2000
#: Parameters: log2 of the buckets (the bitmaps that are sent have an eighth as many bytes), and buckets of a segment.
BITS, SEGMENT = 26, 1 << 16
#: Parameters: bytes of text that are tokenized together, buckets that a task holds before it sends their counts, salts of a language.
TOGETHER, HELD, SALTS = 6 << 20, 1 << 21, 64

UNKNOWN = "und"
#: Bytes that part pieces, bytes that part words.
STOPS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
KIND, LOW = np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
KIND[list(BLANKS)], KIND[list(STOPS)] = 1, 2
LOW[ord("A") : ord("Z") + 1] += 32
STEP, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

Batches = Iterator[pa.RecordBatch]


def word_hashes(langs: Iterable[str], words: Iterable[bytes]) -> np.ndarray:
    seeds: dict[str, int] = {}
    seed = lambda lang: seeds.get(lang) or seeds.setdefault(lang, xxhash.xxh32_intdigest(lang.encode()) | 1)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed(x)) for x, w in zip(langs, words, strict=True)), np.uint64)


def joined(hashes: list[np.ndarray], bits: int) -> np.ndarray:
    """The bucket of every phrase from the hashes of its words, one array a place."""
    h = hashes[0]
    for more in hashes[1:]:
        h = h * STEP + more
    return (((h ^ (h >> np.uint64(32))) * SPREAD) >> np.uint64(64 - bits)).astype(np.int64)


def is_set(bitmap: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bitmap[buckets >> 3] >> (buckets & 7).astype(np.uint8)) & 1 == 1


class Words:
    """The words of a few texts: a code for each occurrence, the language, word and hash of each code, and which words go on in one piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        edges = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        whole = texts.buffers()[2]
        data = np.frombuffer(whole, np.uint8)[edges[0] : edges[-1]] if whole else np.zeros(0, np.uint8)
        edges = edges - edges[0]
        kind = KIND[data]
        inside = kind == 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        firsts = edges[:-1][edges[:-1] < len(data)]
        begins[firsts] = inside[firsts]
        starts = np.flatnonzero(begins)
        place = np.cumsum(inside, dtype=np.int32)
        offsets = np.append(place[starts] - 1, place[-1] if len(place) else 0).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(LOW[data[inside]])).dictionary_encode()
        text = np.searchsorted(edges, starts, "right") - 1
        piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        self.goes_on = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
        names = langs.dictionary_encode()
        lang = np.asarray(names.indices)[text].astype(np.int64)
        both, self.codes = np.unique(lang * max(len(words.dictionary), 1) + np.asarray(words.indices), return_inverse=True)
        self.langs = names.dictionary.take(pa.array(both // max(len(words.dictionary), 1)))
        self.words = words.dictionary.take(pa.array(both % max(len(words.dictionary), 1)))
        self.hashes = word_hashes(self.langs.to_pylist(), (w.encode() for w in self.words.to_pylist()))

    def starts(self, length: int) -> np.ndarray:
        """Whether a phrase of this length begins at each word."""
        n = max(0, len(self.codes) - length + 1)
        ok = np.ones(n, bool)
        for k in range(length - 1):
            ok &= self.goes_on[k : k + n]
        return ok

    def buckets(self, at: np.ndarray, length: int, bits: int) -> np.ndarray:
        return joined([self.hashes[self.codes[at + k]] for k in range(length)], bits)

    def counted(self, at: np.ndarray, length: int) -> tuple[pa.Array, pa.Array, pa.Array]:
        """(lang, phrase, n) of the phrases that begin at the given words."""
        same, first = self.codes[at], np.arange(len(at))
        for k in range(1, length):
            same = np.unique(same * len(self.words) + self.codes[at + k], return_inverse=True)[1]
        _, first, n = np.unique(same, return_index=True, return_counts=True)
        at = at[first]
        parts = [self.words.take(pa.array(self.codes[at + k])) for k in range(length)]
        return self.langs.take(pa.array(self.codes[at])), pc.binary_join_element_wise(*parts, " "), pa.array(n, pa.int64())


def gathered(batches: Batches) -> Iterator[Words]:
    """Words of about TOGETHER bytes of text at a time. Longer texts are cut where a piece ends; a piece is never cut."""
    held: list[tuple[str, pa.Array]] = []
    size = 0

    def all_of() -> Words:
        return Words(pa.concat_arrays([t for _, t in held]), pa.array([x for x, t in held for _ in range(len(t))], pa.string()))

    stop = re.compile(b"[" + re.escape(STOPS) + b"]")
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = text.as_buffer()
            first = 0
            while data is not None and first < data.size:
                last = data.size
                if last - first > TOGETHER and (found := stop.search(data, first + TOGETHER)):
                    last = found.end()
                part = pa.py_buffer(data[first:last])
                held.append((lang, pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, last - first], np.int32)), part)))
                size, first = size + last - first, last
                if size >= TOGETHER:
                    yield all_of()
                    held, size = [], 0
    if held:
        yield all_of()


ROWS = "lang string, phrase string, n long, segment int, at binary, counts binary"
SCHEMA = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("segment", pa.int32()), ("at", pa.binary()), ("counts", pa.binary())])


def phrase_rows(lang: pa.Array, phrase: pa.Array, n: pa.Array) -> pa.RecordBatch:
    nulls = [pa.nulls(len(n), f.type) for f in list(SCHEMA)[3:]]
    return pa.RecordBatch.from_arrays([lang, phrase, n, *nulls], schema=SCHEMA)


def bucket_rows(buckets: list[np.ndarray], times: int = 1) -> Batches:
    """Counts of buckets (255 at most), by segments: places as 16-bit numbers, counts as bytes."""
    found, n = np.unique(np.concatenate(buckets or [np.zeros(0, np.int64)]), return_counts=True)
    if len(found):
        n = np.minimum(n * times, 255).astype(np.uint8)
        edges = np.flatnonzero(np.diff(found // SEGMENT, prepend=-1))
        spans = list(zip(edges, [*edges[1:], len(found)], strict=True))
        columns = [[int(found[a]) // SEGMENT for a, _ in spans], [(found[a:b] % SEGMENT).astype(np.uint16).tobytes() for a, b in spans], [n[a:b].tobytes() for a, b in spans]]
        arrays = [*(pa.nulls(len(spans), f.type) for f in list(SCHEMA)[:3]), *(pa.array(c, f.type) for c, f in zip(columns, list(SCHEMA)[3:], strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, schema=SCHEMA)


def bitmap(rows: DataFrame, least: int, bits: int) -> np.ndarray:
    """The buckets counted at least ``least`` times as one bit each: 2^bits / 8 bytes come to the driver, whatever the input."""

    def add_up(batches: Batches) -> Batches:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, at, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = sums.setdefault(segment, np.zeros(SEGMENT, np.uint8))
                at, counts = np.frombuffer(at, np.uint16), np.frombuffer(counts, np.uint8)
                total[at] = np.minimum(total[at].astype(np.uint16) + counts, 255)
        for segment, total in sums.items():
            packed = np.packbits(total >= least, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([packed], pa.binary())], names=["segment", "set"])

    out = np.zeros(1 << (bits - 3), np.uint8)
    rows = rows.where("segment is not null").select("segment", "at", "counts").repartition("segment")
    for segment, packed in rows.mapInArrow(add_up, "segment int, set binary").collect():
        out[segment * (SEGMENT >> 3) : (segment + 1) * (SEGMENT >> 3)] = np.frombuffer(packed, np.uint8)
    return out


def frequent_bitmap(phrases: DataFrame, length: int, bits: int) -> np.ndarray:
    """The buckets of exactly counted phrases."""

    def mark(batches: Batches) -> Batches:
        for batch in batches:
            langs, words = batch.column(0).to_pylist(), [p.encode().split(b" ") for p in batch.column(1).to_pylist()]
            if words:
                yield from bucket_rows([joined([word_hashes(langs, (w[k] for w in words)) for k in range(length)], bits)], 255)

    return bitmap(phrases.select("lang", "phrase").mapInArrow(mark, ROWS), 255, bits)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, bits: int = BITS, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): (lang, phrase, length, a) of the phrases found at least ``least`` times in their language, with exact
    counts, and (lang, n), the words of each language.

    Pass k reads the texts, counts phrases of k words and adds up buckets of phrases of k + 1 words. A phrase is counted
    only if its bucket reached ``least`` in the pass before and both phrases of k - 1 words within it are in the bitmap
    of the frequent ones; the buckets of the next length leave out what that rules out too. Both are bitmaps of fixed size,
    so they can let too much through, never too little; the exact counts decide. Counts are summed for some megabytes of text at
    a time, then before the shuffle, so a common phrase sends a row a task.
    """
    if not 1 <= least <= 255:
        raise ValueError("least must be from 1 to 255, as buckets count up to 255")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), text_of(text_col).alias("text"))
    context = docs.sparkSession.sparkContext
    all_phrases, totals, have, may_be = [], None, None, None
    for k in range(1, longest + 1):
        have_set, may_be_set = (context.broadcast(b) if b is not None else None for b in (have, may_be))

        def count(batches: Batches, k=k, have_set=have_set, may_be_set=may_be_set) -> Batches:
            held: list[np.ndarray] = []
            for words in gathered(batches):
                alive = words.starts(k)
                if k > 1:
                    at = np.flatnonzero(alive)
                    at = at[is_set(may_be_set.value, words.buckets(at, k, bits))]
                    for place in (0, 1):
                        at = at[is_set(have_set.value, words.buckets(at + place, k - 1, bits))]
                    alive[:] = False
                    alive[at] = True
                yield phrase_rows(*words.counted(np.flatnonzero(alive), k))
                if k < longest:
                    longer = words.starts(k + 1)
                    longer &= alive[:-1][: len(longer)] & alive[1:][: len(longer)]
                    held.append(words.buckets(np.flatnonzero(longer), k + 1, bits))
                    if sum(map(len, held)) >= HELD:
                        yield from bucket_rows(held)
                        held = []
            yield from bucket_rows(held)

        rows = stored(texts.mapInArrow(count, ROWS), f"pass{k}")
        sums = rows.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("a"))
        if k == 1:
            totals = rows.where("phrase is not null").groupBy("lang").agg(F.sum("n").alias("n"))
        found = stored(sums.where(F.col("a") >= least).select("lang", "phrase", F.lit(k).alias("length"), "a"), f"phrases{k}")
        all_phrases.append(found)
        if k < longest:
            have, may_be = frequent_bitmap(found, k, bits), bitmap(rows, least, bits)
    out = all_phrases[0]
    for more in all_phrases[1:]:
        out = out.unionByName(more)
    return out, totals


def first_of_each(rows: DataFrame, by: str, order: list, n: int, spread: str) -> DataFrame:
    """The first n rows of each group with their rank. Salted parts of a group keep their first n before they meet."""
    part = F.pmod(F.xxhash64(spread), F.lit(SALTS))
    rows = rows.withColumn("_part", part).withColumn("rank", F.row_number().over(W.partitionBy(by, "_part").orderBy(*order))).where(F.col("rank") <= n)
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n).drop("_part")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, cover: int = COVER, top: int = TOP, bits: int = BITS, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of 2 to ``longest`` words in each language.

    Texts are lowered (A-Z), cut into pieces at .,;:!? and line ends and into words at spaces and tabs; phrases lie within pieces.
    a counts a phrase, n all words of the language. A phrase is cut after each of its words into parts counted l and r; the
    cut of the least floor(10^6 a a / (l r)) is its score. Phrases that lie inside a longer frequent one with at least
    ``cover`` percent of their count go. Products are decimals of 38 digits: exact up to counts of 10^16.

    A null lang is ``und``; a null or empty text has no words; repeated rows count each time; ties go to the larger a, then to the
    phrase of smaller bytes; a text of any length is read whole, some megabytes at a time (a single piece, between two
    stops, must fit a worker); an empty table gives an empty result; other columns are not read.
    """
    phrases, totals = frequent_phrases(docs, longest, least, bits, lang_col, text_col)
    some = phrases.where("length > 1").withColumn("w", F.split("phrase", " "))
    cuts = some.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("head"), F.array_join(F.expr("slice(w, k + 1, length - k)"), " ").alias("tail"))
    part = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    cuts = cuts.join(part("head", "l"), ["lang", "head"]).join(part("tail", "r"), ["lang", "tail"])
    score = F.expr("cast(1000000bd * a * a as decimal(38,0)) div cast(cast(l as decimal(19,0)) * r as decimal(38,0))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", "b.score")
    inner = some.where("length > 2").select("lang", "w", "length", F.col("a").alias("of"))
    inner = inner.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("length") - 1)))
    inner = inner.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("size") + 1)))
    inner = inner.groupBy("lang", F.array_join(F.expr("slice(w, i, size)"), " ").alias("phrase")).agg(F.max("of").alias("of"))
    best = best.join(inner, ["lang", "phrase"], "left").where(F.coalesce(F.expr(f"100 * of < {cover} * a"), F.lit(True)))
    first = first_of_each(best, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "phrase")
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 4) t(k) WHERE len(w) >= k) u),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
cuts AS (SELECT c.*, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail FROM (SELECT c.*, unnest(range(1, k)) AS j FROM c) c),
s AS (SELECT cuts.lang, cuts.phrase, cuts.a, j, x.a AS l, y.a AS r, CAST(CAST(1000000 AS HUGEINT) * cuts.a * cuts.a // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
      FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS inner_phrase FROM c WHERE k = 3) t
  WHERE t.lang = b.lang AND t.inner_phrase = b.phrase AND 100 * t.a >= 50 * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""
