"""LM scoring by online logistic context mixing over bits, learned from a corpus.

A text is its lower-cased words, each with a space after it, and one newline as its end. Its probability is the product
over the bits of these bytes. Each bit has several predictors: hashed contexts of the last 1, 2 and 4 bytes (bit counts in
tables of a fixed number of cells), the word so far (exact counts of every prefix of the corpus' words, which grow with the
corpus; for the first DEEP bytes of a word), and the word so far after a text of the same state. The state crosses word edges: it is the
class of documents that the words before in the same document speak for, 0 before any of them does; hashed contexts that reach
beyond the start of the word hold it too. The predictors' log odds are combined by weights from one of 32 sets, gated by how often
the word so far was seen in that state, whether only one bit ever followed it, and whether other states saw it more often.
The weights are learned online, against counts without the occurrence itself, and the result is refined by an adaptive probability
map (gate by log odds to observed frequency). Each chunk of the vocabulary learns on its own, then weights are averaged and maps
summed. At last each document mixes the model, word by word, with two predictors that adapt to it online (see adapted).

Classes are a mixture of unigrams over frequent words, fitted by expectation maximisation over all training documents: a
round is one distributed sum. Frequent words are counted over all buckets, their number and that of the classes follow the corpus.

Layout: each task codes its documents into buckets of about BUCKET bytes, so texts are never shuffled; a bucket has its distinct words once
and each document as codes into them, so a word of a third of all documents is one row a bucket. The buckets' words are range-sorted into
chunks of about CHUNK rows; within a chunk counts of prefixes are range sums, and prefixes over a chunk's edge are summed in a
table of the chunks' edges that is joined to the chunks. A chunk sends a word's score in each state back to the buckets that hold it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, stored, table, text_of

#: Parameters: text bytes of a bucket, rows of a chunk, bytes of a word with exact counts, hashed orders and their cells.
BUCKET, CHUNK, DEEP = 16 << 20, 150_000, 48
ORDERS = ((1, 16), (2, 18), (4, 19))
GATES, STEPS, INPUTS = 32, 64, len(ORDERS) + 3
END = b"\n"
#: Parameters: most classes of documents and frequent words, words that a bucket reports, rounds of the fit, documents that it starts from.
CLASSES, FREQUENT, REPORTED, ROUNDS, SEEDS = 8, 1024, 4096, 6, 512
#: Parameters: tokens and word rows that are handled at a time.
SLICE = 1 << 16
#: Parameter: parts of the rows at one bit, after each of which weights move.
PARTS = 2


def squeeze(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values).tobytes())


def grow(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


# ---------------------------------------------------------------- documents to buckets of words and codes


class Bucket:
    """Distinct words of some documents, and these documents as codes into them."""

    def __init__(self):
        self.codes: defaultdict[bytes, int] = defaultdict()
        self.codes.default_factory = self.codes.__len__
        self.end = self.codes[END]
        self.docs: list[np.ndarray] = []
        self.ids: list = []
        self.held: list[bool] = []
        self.bytes = 0

    def add(self, name, held: bool, text: bytes) -> None:
        found = list(map(self.codes.__getitem__, text.lower().split()))  # of bytes: A-Z and the six white-space characters only
        found.append(self.end)
        self.docs.append(np.array(found, np.int32))
        self.ids.append(name)
        self.held.append(held)
        self.bytes += len(text) + 64

    def row(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        codes, lengths, held = np.concatenate(self.docs), np.array(list(map(len, self.docs))), np.array(self.held, bool)
        words = list(self.codes)
        words[0] = b""  # the end is one byte, as is the space after a word
        sizes = np.fromiter(map(len, words), np.int32, len(words)) + np.int32(1)
        data = np.frombuffer(b"\n" + b" ".join(words[1:]) + b" " if len(words) > 1 else b"\n", np.uint8)
        counts = np.bincount(codes[np.repeat(~held, lengths)], minlength=len(words))
        counts[0] = 0  # the end says nothing
        top = np.argsort(-counts, kind="stable")[:REPORTED]
        top = top[counts[top] > 0]
        reported = pa.StructArray.from_arrays([pa.array([words[k] + b" " for k in top.tolist()], pa.binary()), pa.array(counts[top], pa.int64())], names=["token", "n"])
        ends = np.cumsum(lengths)
        n_bytes = np.add.reduceat(sizes[codes], ends - lengths, dtype=np.int64)
        columns = {
            "bucket": pa.array([number], pa.int64()),
            "ids": pa.ListArray.from_arrays(pa.array([0, len(self.ids)], pa.int32()), pa.array(self.ids, kind)),
            "held": pa.array([squeeze(held)], pa.binary()),
            "codes": pa.array([squeeze(codes)], pa.binary()),
            "lengths": pa.array([squeeze(lengths.astype(np.int64))], pa.binary()),
            "sizes": pa.array([squeeze(n_bytes)], pa.binary()),
            "data": pa.array([squeeze(data)], pa.binary()),
            "token_lengths": pa.array([squeeze(sizes)], pa.binary()),
            "top": pa.ListArray.from_arrays(pa.array([0, len(reported)], pa.int32()), reported),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


CODED = "bucket long, ids array<{0}>, held binary, codes binary, lengths binary, sizes binary, data binary, token_lengths binary, top array<struct<token:binary,n:long>>"


def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, held, text) to one row a bucket. A task's buckets have numbers of their own."""
    number, bucket, kind = TaskContext.get().partitionId() << 24, Bucket(), None
    for batch in batches:
        kind = batch.schema.field(0).type
        for name, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
            bucket.add(name, held, text)
            if bucket.bytes >= BUCKET:
                yield bucket.row(number, kind)
                number, bucket = number + 1, Bucket()
    if bucket.ids:
        yield bucket.row(number, kind)


def binaries(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """An array of binary values that lie one after the other in data."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def tokens_of(data: bytes, lengths: bytes) -> pa.Array:
    return binaries(grow(data, np.uint8), np.cumsum(grow(lengths, np.int32), dtype=np.int64))


# ---------------------------------------------------------------- classes of documents


class Classes:
    """A mixture of unigrams: log probability of each frequent word (row) in each class (column), log share of each class."""

    def __init__(self, names: list[bytes], words: np.ndarray, share: np.ndarray):
        self.names, self.words, self.share = pa.array(names, pa.binary()), words, share

    @property
    def states(self) -> int:
        return len(self.share) + 1

    def frequent(self, tokens: pa.Array) -> np.ndarray:
        """The place of each token among the frequent words, or -1."""
        return pc.fill_null(pc.index_in(tokens, self.names), -1).to_numpy(zero_copy_only=False).astype(np.int32)


def start_classes(counts: np.ndarray, names: list[bytes], k: int) -> Classes:
    """Classes around up to k documents (rows of counts) far apart."""
    counts = counts[counts.sum(1) > 0].astype(np.float64)
    k = max(1, min(k, len(counts)))
    resp = np.zeros((len(counts), k))
    if len(counts):
        root = np.sqrt(counts / counts.sum(1, keepdims=True))
        chosen = [int(counts.sum(1).argmax())]
        while len(chosen) < k:
            chosen.append(int(((1 - root @ root[chosen].T).min(1) * np.log1p(counts.sum(1))).argmax()))
        resp[np.arange(len(counts)), (root @ root[chosen].T).argmax(1)] = 1
    return updated_classes(names, counts.T @ resp, resp.sum(0))


def updated_classes(names: list[bytes], mass: np.ndarray, docs: np.ndarray) -> Classes:
    mass = np.round(mass, 6) + 0.05  # sums come in any order: rounded, reruns agree
    docs = np.round(docs, 6) + 1
    return Classes(names, np.log(mass / mass.sum(0)), np.log(docs / docs.sum()))


def sparse_counts(classes: Classes, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, frequent word, count) of the training documents of a bucket."""
    codes, lengths, held = grow(row["codes"], np.int32), grow(row["lengths"], np.int64), grow(row["held"], bool)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    word = classes.frequent(tokens_of(row["data"], row["token_lengths"]))[codes]
    use = (word >= 0) & ~held[doc]
    f = max(1, len(classes.names))
    key, n = np.unique(doc[use] * f + word[use], return_counts=True)
    return key // f, key % f, n


def expected(classes: Classes, doc: np.ndarray, word: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mass of each word in each class, documents of each class) of one bucket's documents."""
    k, f = len(classes.share), len(classes.names)
    mass, docs = np.zeros((f, k)), np.zeros(k)
    if len(doc):
        starts = np.flatnonzero(np.concatenate(([True], np.diff(doc) != 0)))
        value = np.add.reduceat(classes.words[word] * n[:, None], starts, axis=0) + classes.share
        resp = np.exp(value - value.max(1, keepdims=True))
        resp /= resp.sum(1, keepdims=True)
        docs += resp.sum(0)
        each = np.repeat(resp, np.diff(np.append(starts, len(doc))), axis=0) * n[:, None]
        for c in range(k):
            mass[:, c] = np.bincount(word, each[:, c], f)
    return mass, docs


def fit_classes(coded: DataFrame) -> Classes:
    """By expectation maximisation over all training documents of coded, started from SEEDS of them."""
    spark = coded.sparkSession
    top = coded.select(F.explode("top").alias("t")).groupBy("t.token").agg(F.sum("t.n").alias("n"))
    names = [bytes(r["token"]) for r in top.orderBy(F.col("n").desc(), "token").limit(FREQUENT).collect()]
    found = spark.sparkContext.broadcast(Classes(names, np.zeros((len(names), 1)), np.zeros(1)))

    def sparse(batches):
        for batch in batches:
            for row in batch.to_pylist():
                doc, word, n = sparse_counts(found.value, row)
                spread = (np.unique(doc) * 2654435761 + row["bucket"] * 40503) % (1 << 32)
                few = np.unique(doc)[np.argsort(spread, kind="stable")[:16]]
                seeds = [(int(h), np.bincount(word[doc == d], n[doc == d], len(names)).astype("<i4").tobytes()) for d, h in zip(few, np.sort(spread))]
                kinds = pa.StructArray.from_arrays([pa.array([s[0] for s in seeds], pa.int64()), pa.array([s[1] for s in seeds], pa.binary())], names=["h", "n"])
                yield pa.RecordBatch.from_arrays([*(pa.array([squeeze(x.astype(np.int32))], pa.binary()) for x in (doc, word, n)), pa.ListArray.from_arrays(pa.array([0, len(seeds)], pa.int32()), kinds), pa.array([len(np.unique(doc))], pa.int64())], names=["doc", "word", "n", "seeds", "docs"])

    counts = stored(coded.select("bucket", "held", "codes", "lengths", "data", "token_lengths").mapInArrow(sparse, "doc binary, word binary, n binary, seeds array<struct<h:long,n:binary>>, docs long"), "classes")
    total = counts.agg(F.sum("docs")).first()[0] or 0
    k = int(min(CLASSES, 2 + math.log2(total + 1) / 2))
    seeds = counts.select(F.explode("seeds").alias("s")).orderBy("s.h", "s.n").limit(SEEDS).collect()
    matrix = np.frombuffer(b"".join(r["s"]["n"] for r in seeds), "<i4").reshape(len(seeds), len(names)) if seeds and names else np.zeros((0, len(names)), np.int32)
    classes = start_classes(matrix, names, k)

    def gather(model):
        def run(batches):
            mass, docs = np.zeros_like(model.value.words), np.zeros_like(model.value.share)
            for batch in batches:
                for row in batch.to_pylist():
                    m, d = expected(model.value, *(grow(row[c], np.int32).astype(np.int64) for c in ("doc", "word", "n")))
                    mass, docs = mass + m, docs + d
            value = np.append(mass.reshape(-1), docs)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value), dtype=np.int32)), pa.array(value)], names=["cell", "value"])

        return run

    for _ in range(ROUNDS if total and names else 0):
        model = spark.sparkContext.broadcast(classes)
        got = counts.select("doc", "word", "n").mapInArrow(gather(model), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
        value = np.zeros((len(names) + 1) * len(classes.share))  # of all tasks: a cell for each word and class
        value[got["cell"].to_numpy()] = got["value"].to_numpy()
        classes = updated_classes(names, value[: -len(classes.share)].reshape(len(names), -1), value[-len(classes.share) :])
    return classes


def states(classes: Classes, word: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The state at each token: 1 + the class that the frequent words before it in its document speak for, 0 before any.

    word: the frequent word at each token, or -1; lengths: tokens of each document. Tokens are handled SLICE at a time.
    """
    out = np.zeros(len(word), np.int64)
    starts = np.cumsum(lengths) - lengths
    table = np.vstack((classes.words, np.zeros((1, len(classes.share)))))  # the last row, at -1: nothing
    table = np.hstack((table, np.append(np.ones(len(classes.words)), 0)[:, None]))  # the last column counts
    carry = np.zeros(table.shape[1])
    doc = np.repeat(np.arange(len(lengths)), lengths)
    for at in range(0, len(word), SLICE):
        part, here = word[at : at + SLICE], doc[at : at + SLICE]
        own = table[part]
        path = np.cumsum(own, axis=0)
        before = path - own
        first = starts[here] - at  # where the document starts in this slice
        base = np.where((first >= 0)[:, None], before[np.maximum(first, 0)], -carry)
        since = before - base
        out[at : at + SLICE] = np.where(since[:, -1] > 0.5, 1 + (since[:, :-1] + classes.share).argmax(1), 0)
        carry = since[-1] + own[-1]
    return out


# ---------------------------------------------------------------- buckets to rows of words and chunks of words


PAIRED = "bucket long, ids array<{0}>, held binary, codes binary, lengths binary, sizes binary, present binary, token binary, code int, mask int, n binary"


def pair_rows(classes: Classes, row: dict, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """One row with the bucket's documents as codes of (word, state), and one row (token, bucket, code, mask of its states,
    training count in each state) for each of its words."""
    s, tokens = classes.states, tokens_of(row["data"], row["token_lengths"])
    codes, lengths, held = grow(row["codes"], np.int32).astype(np.int64), grow(row["lengths"], np.int64), grow(row["held"], bool)
    key = codes * s + states(classes, classes.frequent(tokens)[codes], lengths)
    there = np.zeros(len(tokens) * s, bool)
    there[key] = True
    counts = np.bincount(key[np.repeat(~held, lengths)], minlength=len(there)).astype("<i4").tobytes()
    named = np.cumsum(there) - 1
    mask = there.reshape(-1, s) @ (1 << np.arange(s))
    names = ["bucket", "ids", "held", "codes", "lengths", "sizes", "present", "token", "code", "mask", "n"]
    ids = pa.ListArray.from_arrays(pa.array([0, len(row["ids"])], pa.int32()), pa.array(row["ids"], kind))
    blobs = [row["held"], squeeze(named[key].astype(np.int32)), row["lengths"], row["sizes"], squeeze(np.flatnonzero(there).astype(np.int32)), None]
    yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]], pa.int64()), ids, *(pa.array([b], pa.binary()) for b in blobs), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary())], names=names)
    counts = binaries(np.frombuffer(counts, np.uint8), np.arange(1, len(tokens) + 1) * (4 * s))
    for at in range(0, len(tokens), SLICE):
        part, each = tokens.slice(at, SLICE), counts.slice(at, SLICE)
        m = len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m, row["bucket"])), pa.nulls(m, pa.list_(kind)), *[pa.nulls(m, pa.binary())] * 5, part, pa.array(np.arange(at, at + m, dtype=np.int32)), pa.array(mask[at : at + m].astype(np.int32)), each], names=names)


class Chunk:
    """Sorted distinct words with their training counts in each state; its rows are pairs (word, state), with ``trained`` only
    those that were counted. Walks down their bits."""

    def __init__(self, data: bytes, lengths: bytes, n: bytes, mask: bytes, trained: bool = False):
        self.data, size, mask = grow(data, np.uint8), grow(lengths, np.int32).astype(np.int64), grow(mask, np.int32)
        n = grow(n, np.int64).reshape(len(size), -1)
        self.states = n.shape[1]
        self.word, self.state = np.nonzero(n > 0 if trained else (mask[:, None] >> np.arange(self.states)) & 1)
        self.count = n[self.word, self.state]
        starts = np.cumsum(size) - size
        self.deep = deep = int(min(DEEP, size.max()))
        short = np.minimum(size, deep)
        row = np.repeat(np.arange(len(size)), short)
        col = np.arange(len(row)) - np.repeat(np.cumsum(short) - short, short)
        words = np.zeros((len(size), deep), np.uint8)
        words[row, col] = self.data[starts[row] + col]
        differ = words[1:] != words[:-1]
        some = differ.any(1)
        byte = np.where(some, differ.argmax(1), deep)
        at = np.arange(len(size) - 1)
        xor = words[1:][at, np.minimum(byte, deep - 1)] ^ words[:-1][at, np.minimum(byte, deep - 1)]
        shared = np.where(some, 8 * byte + 8 - np.ceil(np.log2(xor.astype(np.float64) + 1)).astype(np.int64), 8 * deep)  # bits that neighbours share
        self.bytes, self.lengths, self.starts = words[self.word], size[self.word], starts[self.word]
        self.common = np.full(max(0, len(self.word) - 1), 8 * deep)
        new = np.flatnonzero(self.word[1:] != self.word[:-1])
        if len(new):  # the least of what neighbours share from a row's word to the next row's
            self.common[new] = np.minimum.reduceat(shared[: self.word[-1]], self.word[new])

    def weights(self) -> np.ndarray:
        """Counts of the rows by state; the last column is of all states."""
        out = np.zeros((len(self.count), self.states + 1), np.int64)
        out[np.arange(len(self.count)), self.state] = self.count
        out[:, -1] = self.count
        return out

    def edge(self, row: int) -> Iterator[tuple[bytes, int]]:
        """(key, bits) of every prefix of a word: the key is its bytes with the bits after the prefix cleared."""
        word = self.bytes[row, : min(self.lengths[row], self.deep)].tobytes()
        for bits in range(8 * len(word) + 1):
            whole, rest = divmod(bits, 8)
            key = word[:whole] + (bytes([word[whole] >> (8 - rest) << (8 - rest)]) if rest else b"")
            yield key, bits

    def edge_sums(self) -> dict[tuple[bytes, int], np.ndarray]:
        """The chunk's own counts of every prefix of its first and its last word."""
        total, out = np.vstack((np.zeros(self.states + 1, np.int64), np.cumsum(self.weights(), axis=0))), {}
        n = len(self.count)
        for row, shared in ((0, np.minimum.accumulate(self.common)), (n - 1, np.minimum.accumulate(self.common[::-1]))):
            falling = -shared
            for key, bits in self.edge(row):
                reach = int(np.searchsorted(falling, -bits, "right"))  # neighbours that share the prefix
                out[key, bits] = total[reach + 1] if row == 0 else total[n] - total[n - 1 - reach]
        return out

    def walk(self, totals: dict[tuple[bytes, int], np.ndarray]):
        """For every byte and bit: (rows, byte position, bit, actual bits, node, counts before, counts after); counts are
        (of all states, of the row's state)."""
        rows, common, weights = np.arange(len(self.count)), self.common, self.weights()
        first = {bits: totals[key, bits] for key, bits in self.edge(0) if (key, bits) in totals}
        last = {bits: totals[key, bits] for key, bits in self.edge(len(rows) - 1) if (key, bits) in totals}
        has_first = has_last = True
        wide = self.states + 1

        def summed():
            out = np.zeros((len(rows) + 1, wide), np.int64)
            np.cumsum(weights if len(rows) == len(weights) else weights[rows], axis=0, out=out[1:])
            return out.reshape(-1), np.ascontiguousarray(out[:, -1]), self.state[rows]

        flat, whole, state = summed()

        def level(bits):
            starts = np.concatenate(([0], np.flatnonzero(common < bits) + 1)) if len(rows) > 1 else np.zeros(1, np.int64)
            ends = np.append(starts[1:], len(rows))
            size = ends - starts
            every = np.repeat(whole[ends] - whole[starts], size)
            own = flat[np.repeat(ends * wide, size) + state] - flat[np.repeat(starts * wide, size) + state]
            for there, known, at in ((has_first, first, slice(0, size[0])), (has_last, last, slice(len(rows) - size[-1], None))):
                if there and bits in known:
                    every[at], own[at] = known[bits][-1], known[bits][state[at]]
            return every, own

        for p in range(self.deep):
            if p:
                stay = self.lengths[rows] > p
                if not stay.all():
                    kept = np.flatnonzero(stay)
                    if not len(kept):
                        return
                    has_first, has_last = has_first and bool(stay[0]), has_last and bool(stay[-1])
                    least = common
                    common = np.minimum.reduceat(least, kept[:-1]) if len(kept) > 1 else least[:0]
                    if len(kept) > 1 and kept[-1] < len(rows) - 1:  # the last stretch of reduceat ran past the last kept row
                        common = common.copy()
                        common[-1] = least[kept[-2] : kept[-1]].min()
                    rows = rows[kept]
                    flat, whole, state = summed()
            byte = self.bytes[rows, p].astype(np.int32)
            before = level(8 * p)
            for b in range(8):
                after = level(8 * p + b + 1)
                yield rows, p, b, (byte >> (7 - b)) & 1, (1 << b) | (byte >> (8 - b)), before, after
                before = after

    def contexts(self, p: int, rows: np.ndarray) -> list[np.ndarray]:
        """Hashes of the last 1, 2 and 4 bytes before position p of the words in rows, the state where they reach beyond the word."""
        return [hashed([self.bytes[rows, p - k - 1].astype(np.uint32) if p > k else self.state[rows].astype(np.uint32) + np.uint32(0x100) for k in range(order)], len(rows)) for order, _ in ORDERS]

    def tails(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in data) of the bytes beyond DEEP."""
        long = np.flatnonzero(self.lengths > self.deep)
        size = self.lengths[long] - self.deep
        row = np.repeat(long, size)
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        return row, self.starts[row] + self.deep + inner

    def bits_of_tail(self):
        """(rows, contexts, byte) of bytes beyond DEEP, SLICE at a time."""
        row, place = self.tails()
        for at in range(0, len(row), SLICE):
            r, p = row[at : at + SLICE], place[at : at + SLICE]
            yield r, [hashed([self.data[p - k - 1].astype(np.uint32) for k in range(order)], len(r)) for order, _ in ORDERS], self.data[p].astype(np.int32)


PACKED = "chunk long, data binary, lengths binary, n binary, mask binary, row binary, bucket binary, code binary, states binary, edges array<struct<key:binary,bits:int,n:array<long>>>"


def pack_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (token, bucket, code, mask, n), sorted by token, to chunk rows that never part a token's rows (one a bucket)."""
    held: list[pa.RecordBatch] = []
    rows, number = 0, TaskContext.get().partitionId() << 24

    def packed(whole: pa.Table) -> pa.RecordBatch:
        nonlocal number
        token = pa.concat_arrays(whole.column("token").chunks)
        new = np.concatenate(([True], pc.not_equal(token[1:], token[:-1]).to_numpy(zero_copy_only=False))) if len(token) > 1 else np.ones(len(token), bool)
        starts = np.flatnonzero(new)
        words = token.take(pa.array(starts))
        each = np.frombuffer(b"".join(whole.column("n").to_pylist()), "<i4").reshape(whole.num_rows, -1)
        n = np.add.reduceat(each, starts, axis=0, dtype=np.int64)
        mask = whole.column("mask").to_numpy()
        data = np.frombuffer(b"".join(words.to_pylist()), np.uint8)
        head = [data, pc.binary_length(words).to_numpy().astype(np.int32), n, np.bitwise_or.reduceat(mask, starts)]
        blobs = [squeeze(x) for x in (*head, (np.cumsum(new) - 1).astype(np.int32), whole.column("bucket").to_numpy(), whole.column("code").to_numpy(), mask)]
        edges = Chunk(*blobs[:4]).edge_sums()
        kind = pa.list_(pa.struct([("key", pa.binary()), ("bits", pa.int32()), ("n", pa.list_(pa.int64()))]))
        edges = pa.array([[{"key": key, "bits": bits, "n": c.tolist()} for (key, bits), c in edges.items()]], kind)
        out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([b], pa.binary()) for b in blobs), edges], names=["chunk", "data", "lengths", "n", "mask", "row", "bucket", "code", "states", "edges"])
        number += 1
        return out

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            whole = pa.Table.from_batches(held)
            token = whole.column("token").combine_chunks()
            other = pc.indices_nonzero(pc.not_equal(token, token[len(token) - 1]))
            cut = other[len(other) - 1].as_py() + 1 if len(other) else 0  # the last token's rows start here
            if cut > 0:
                yield packed(whole.slice(0, cut))
                held = whole.slice(cut).to_batches()
                rows = whole.num_rows - cut
    if rows:
        yield packed(pa.Table.from_batches(held))


def with_totals(chunks: DataFrame, width: int) -> DataFrame:
    """chunks with ``totals`` in place of edges: what all chunks count together for those prefixes that several of them share."""
    edges = chunks.select("chunk", F.explode("edges").alias("e")).select("chunk", "e.key", "e.bits", "e.n")
    sums = edges.groupBy("key", "bits").agg(F.count("*").alias("chunks"), *(F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(width))).where("chunks > 1")
    sums = sums.select("key", "bits", F.array(*(f"n{k}" for k in range(width))).alias("n"))
    shared = edges.select("chunk", "key", "bits").join(sums, ["key", "bits"]).groupBy("chunk").agg(F.collect_list(F.struct("key", "bits", "n")).alias("totals"))
    return chunks.drop("edges").join(shared, "chunk", "left")


def totals_of(row: dict) -> dict[tuple[bytes, int], np.ndarray]:
    return {(e["key"], e["bits"]): np.array(e["n"], np.int64) for e in row["totals"] or ()}


def chunk_of(row: dict, trained: bool = False) -> Chunk:
    return Chunk(row["data"], row["lengths"], row["n"], row["mask"], trained)


# ---------------------------------------------------------------- hashed contexts


def hashed(before: list[np.ndarray], n: int) -> np.ndarray:
    x = np.zeros(n, np.uint32)
    for b in before:
        x = (x + b + np.uint32(1)) * np.uint32(0x9E3779B1)
    return x


def cells(context: np.ndarray, node: np.ndarray, k: int) -> np.ndarray:
    """Cells of order k, from 0."""
    return ((context ^ _NODES[node]) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - ORDERS[k][1])


_NODES = np.arange(256, dtype=np.uint32) * np.uint32(0x85EBCA6B)
CELLS = sum(1 << b for _, b in ORDERS)
_FIRST = np.cumsum([0, *(1 << b for _, b in ORDERS)]).astype(np.uint32)


class LowCounts:
    """Counts of 0 and 1 bits in each hashed cell, weighted by training counts, over any number of chunks."""

    def __init__(self):
        self.both = [np.zeros(2 << bits) for _, bits in ORDERS]
        self.parts: list[tuple[np.ndarray, list[np.ndarray], np.ndarray]] = []
        self.held = 0

    def add(self, chunk: Chunk) -> None:
        for p in range(chunk.deep):
            rows = np.flatnonzero((chunk.lengths > p) & (chunk.count > 0))
            for at in range(0, len(rows), SLICE):
                r = rows[at : at + SLICE]
                self._hold(chunk.count[r], chunk.contexts(p, r), chunk.bytes[r, p])
        for rows, contexts, byte in chunk.bits_of_tail():
            self._hold(chunk.count[rows], contexts, byte)

    def _hold(self, count, contexts, byte) -> None:
        self.parts.append((count.astype(np.float64), contexts, byte.astype(np.int32)))
        self.held += len(count)
        if self.held >= 16 * SLICE:
            self.flush()

    def flush(self) -> None:
        if self.parts:
            weight, byte = (np.concatenate([x[k] for x in self.parts]) for k in (0, 2))
            for k in range(len(ORDERS)):
                context = np.concatenate([x[1][k] for x in self.parts])
                for b in range(8):
                    at = (cells(context, (1 << b) | (byte >> (8 - b)), k) << np.uint32(1)) | ((byte >> (7 - b)) & 1).astype(np.uint32)
                    self.both[k] += np.bincount(at, weight, len(self.both[k]))
        self.parts, self.held = [], 0

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        self.flush()
        whole = np.concatenate(self.both).reshape(-1, 2)
        return whole[:, 0], whole[:, 1]


# ---------------------------------------------------------------- mixing


class Mixer:
    """Weights of each gate and the adaptive probability map (counts of 1 bits and of all, by gate and log odds)."""

    def __init__(self):
        self.weights = np.tile(np.array([*[0.1] * len(ORDERS), 0.3, 0.5, 0.0], np.float32), (GATES, 1))
        self.ones, self.all = np.zeros(GATES * STEPS), np.zeros(GATES * STEPS)

    def map(self) -> np.ndarray:
        centre = 1 / (1 + np.exp(-(np.arange(STEPS) / 4 - 8 + 0.125)))
        return ((self.ones + 2 * np.tile(centre, GATES)) / (self.all + 2)).astype(np.float32)


def odds_of(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.1) / (n0 + 0.1)).astype(np.float32)


def gate_of(n: np.ndarray, s0: np.ndarray, s1: np.ndarray) -> np.ndarray:
    """By how often the state saw the word so far, whether one bit only followed, whether others saw it more often."""
    s = s0 + s1
    return (np.minimum(np.frexp(s.astype(np.float32))[1], 7) * 4 + 2 * ((s0 == 0) | (s1 == 0)) + (n > 4 * s)).astype(np.int32)


def step_of(odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
    return gate * STEPS + np.clip((odds + 8) * 4, 0, STEPS - 1).astype(np.int32)


def learn(chunk: Chunk, totals: dict, stretch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One online pass over a chunk of counted rows: (weights, mass of each gate, the map's counts)."""
    mixer, power, mass = Mixer(), np.full((GATES, INPUTS), 1e-3), np.zeros(GATES)
    for rows, p, b, y, node, before, after in chunk.walk(totals) if len(chunk.count) else ():
        if b == 0:
            contexts, c = chunk.contexts(p, rows), chunk.count[rows].astype(np.float64)
        one = y == 1
        pairs = []
        for k in (0, 1):  # without this occurrence
            other = before[k] - after[k]
            own = after[k] - 1
            pairs.append((np.where(one, other, own), np.where(one, own, other)))
        (n0, n1), (s0, s1) = pairs
        gate = gate_of(n0 + n1, s0, s1)
        x = np.empty((INPUTS, len(rows)), np.float32)
        for k, context in enumerate(contexts):
            x[k] = stretch[cells(context, node, k) + _FIRST[k]]
        x[-3], x[-2], x[-1] = odds_of(n0, n1), odds_of(s0, s1), 0.3
        for part in range(PARTS):
            s = slice(part, None, PARTS)
            g, xs, n, t = gate[s], x[:, s], c[s], y[s]
            if not len(g):
                continue
            w = mixer.weights[g]
            odds = xs[0] * w[:, 0]
            for k in range(1, INPUTS):
                odds += xs[k] * w[:, k]
            np.clip(odds, -12, 12, out=odds)
            at = step_of(odds, g)
            mixer.all += np.bincount(at, n, GATES * STEPS)
            mixer.ones += np.bincount(at, n * t, GATES * STEPS)
            error = (1 / (1 + np.exp(-odds)) - t) * n
            here = np.bincount(g, n, GATES)
            mass += here
            slope = np.stack([np.bincount(g, error * xs[k], GATES) for k in range(INPUTS)], 1) / np.maximum(here, 1)[:, None]
            power += slope**2
            mixer.weights -= (0.06 * slope / np.sqrt(power)).astype(np.float32)
    return mixer.weights, mass, mixer.ones, mixer.all


def scores(chunk: Chunk, totals: dict, stretch: np.ndarray, weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """log10 of the probability of each row's word in its state."""
    out = np.zeros(len(chunk.count))

    def gain(odds, gate, bit):
        odds = np.clip(odds, -12, 12)
        p = 0.5 / (1 + np.exp(-odds)) + 0.5 * refined[step_of(odds, gate)]
        return np.log10(np.clip(np.where(bit == 1, p, 1 - p), 1e-6, 1))

    for rows, p, b, bit, node, before, after in chunk.walk(totals):
        if b == 0:
            contexts = chunk.contexts(p, rows)
        (n0, n1), (s0, s1) = ((np.where(bit == 1, f - a, a), np.where(bit == 1, a, f - a)) for f, a in ((before[k], after[k]) for k in (0, 1)))
        gate = gate_of(n0 + n1, s0, s1)
        w = weights[gate]
        odds = w[:, -3] * odds_of(n0, n1) + w[:, -2] * odds_of(s0, s1) + w[:, -1] * np.float32(0.3)
        for k, context in enumerate(contexts):
            odds += w[:, k] * stretch[cells(context, node, k) + _FIRST[k]]
        out[rows] += gain(odds, gate, bit)
    for rows, contexts, byte in chunk.bits_of_tail():
        gate = np.full(len(rows), 2, np.int32)  # nothing seen, so only one bit at most
        for b in range(8):
            node = (1 << b) | (byte >> (8 - b))
            odds = sum(weights[2, k] * stretch[cells(context, node, k) + _FIRST[k]] for k, context in enumerate(contexts)) + weights[2, -1] * np.float32(0.3)
            out += np.bincount(rows, gain(odds, gate, (byte >> (7 - b)) & 1), len(out))
    return out


def earlier(key: np.ndarray) -> np.ndarray:
    """How often each value stood before in the array."""
    order = np.argsort(key, kind="stable")
    new = np.concatenate(([True], np.diff(key[order]) != 0))
    at = np.arange(len(key))
    out = np.empty(len(key), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def adapted(codes: np.ndarray, logs: np.ndarray) -> float:
    """log10 of a document: the model mixed, word by word, with what the document itself has shown so far.

    Two predictors adapt online: the words so far, and the words that so far followed the word before. Each gets the share
    of positions so far at which it could have known the word (a repeated word, a repeated pair), so weights at a position
    depend on what came before only and each word's probabilities sum to one.
    """
    n, place = len(codes), np.arange(len(codes))
    seen = earlier(codes)
    pair = np.zeros(n, np.int64)
    pair[1:] = earlier((codes[:-1].astype(np.int64) << 32) | codes[1:])
    context = np.concatenate(([0], seen[:-1]))  # how often the word before had stood before

    def share(hit: np.ndarray) -> np.ndarray:
        return (np.cumsum(hit) - hit + 0.05) / (place + 3)

    follow = np.where(context > 0, 0.95 * share(pair > 0), 0.0)
    again = np.where(place > 0, 0.45 * (1 - follow) * share(seen > 0), 0.0)
    own = again * seen / np.maximum(place, 1) + follow * pair / np.maximum(context, 1)
    with np.errstate(divide="ignore"):
        return float(np.logaddexp(np.log(1 - follow - again) + logs, np.log(own)).sum() / math.log(10))


#: Bits of a place among tokens that are handled together, and of a word's code; a longer run is handled document by document.
PLACE, WORD = 18, 24


def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how often each value stood before, a number of each value) of an array of less than 2^PLACE values below 2^(62 - PLACE)."""
    order = np.sort((key << PLACE) | np.arange(len(key)))
    at, key = order & ((1 << PLACE) - 1), order >> PLACE
    new = np.concatenate(([True], key[1:] != key[:-1]))
    place = np.arange(len(key))
    seen, name = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
    seen[at] = place - np.maximum.accumulate(np.where(new, place, 0))
    name[at] = np.cumsum(new)
    return seen, name


def adapted_texts(codes: np.ndarray, logs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """adapted() of each of the documents that lie one after the other in codes and logs."""
    ends = np.cumsum(lengths)
    out, at = np.zeros(len(lengths)), 0
    while at < len(lengths):
        first = int(ends[at] - lengths[at])
        last = max(at + 1, int(np.searchsorted(ends, first + (1 << PLACE) - 1, "right")))
        c, v, n = codes[first : ends[last - 1]].astype(np.int64), logs[first : ends[last - 1]], lengths[at:last]
        out[at:last] = _adapted_run(c, v, n) if len(c) < 1 << PLACE and c.max() < 1 << WORD else [adapted(codes[a:b], logs[a:b]) for a, b in zip((ends[at:last] - n).tolist(), ends[at:last].tolist())]
        at = last
    return out


def _adapted_run(codes: np.ndarray, logs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - starts[doc]
    seen, name = ranked((doc << WORD) | codes)
    inside = place > 0
    before = np.where(inside, np.concatenate(([0], name[:-1])), 0)  # the word before, of this document
    pair = np.where(inside, ranked((before << WORD) | codes)[0], 0)
    context = np.where(inside, np.concatenate(([0], seen[:-1])), 0)

    def share(hit: np.ndarray) -> np.ndarray:
        sums = np.cumsum(hit) - hit
        return (sums - sums[starts][doc] + 0.05) / (place + 3)

    follow = np.where(context > 0, 0.95 * share(pair > 0), 0.0)
    again = np.where(inside, 0.45 * (1 - follow) * share(seen > 0), 0.0)
    own = again * seen / np.maximum(place, 1) + follow * pair / np.maximum(context, 1)
    with np.errstate(divide="ignore"):
        return np.add.reduceat(np.logaddexp(np.log(1 - follow - again) + logs, np.log(own)), starts) / math.log(10)


# ---------------------------------------------------------------- the operator


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, model_score, bits_per_byte), one row for each row of docs.

    Words come from documents whose id's crc32 modulo folds is not held. A null text is empty: its only token is the end.
    base_score is the sum of log10((c + 1) / (N + V + 1)); model_score is the mixer's alone, score has the document's own
    adaptive part too. Repeated rows each count and are scored each; a null id hashes as an empty text. A text of any length is
    one document of one bucket; words beyond DEEP bytes go on by hashed contexts. Other columns are not read. With nothing
    to learn from, every bit has the probability 1/2. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), (id_remainder(id_col, folds) == held).alias("held"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, model_score double, bits_per_byte double"
    coded = stored(rows.mapInArrow(code, CODED.format(kind)), "mixing-coded")
    classes = fit_classes(coded)
    width = classes.states + 1
    model = spark.sparkContext.broadcast(classes)

    def pair(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from pair_rows(model.value, row, batch.schema.field("ids").type.value_type)

    paired = stored(coded.drop("top").mapInArrow(pair, PAIRED.format(kind)), "mixing-paired")
    words = paired.where("token is not null").select("token", "bucket", "code", "mask", "n")
    chunks = stored(words.repartitionByRange("token").sortWithinPartitions("token").mapInArrow(pack_chunks, PACKED), "mixing-chunks")
    chunks = stored(with_totals(chunks, width), "mixing-chunks")
    parts = chunks.select("data", "lengths", "n", "mask", "totals")

    def gather(batches):
        low, n, v = LowCounts(), 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                low.add(chunk_of(row, True))
                each = grow(row["n"], np.int64).reshape(-1, classes.states).sum(1)
                n, v = n + int(each.sum()), v + int((each > 0).sum())
        zeros, ones = low.counts()
        at = np.flatnonzero(zeros + ones)
        for k in range(0, len(at), SLICE):
            some = at[k : k + SLICE]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(zeros[some]), pa.array(ones[some])], names=["cell", "zeros", "ones"])
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([float(n)]), pa.array([float(v)])], names=["cell", "zeros", "ones"])

    cell = parts.select("data", "lengths", "n", "mask").mapInArrow(gather, "cell int, zeros double, ones double")
    cell = cell.groupBy("cell").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow()  # CELLS + 1 rows at most
    at, zeros, ones = (cell[c].to_numpy() for c in ("cell", "zeros", "ones"))
    n_train, n_distinct = (int(x[at < 0].sum()) for x in (zeros, ones))
    stretch = np.zeros(CELLS, np.float32)
    stretch[at[at >= 0]] = np.clip(np.log((ones[at >= 0] + 0.4) / (zeros[at >= 0] + 0.4)), -10, 10)
    known = spark.sparkContext.broadcast(stretch)

    def train(batches):
        mixer, mass, weighted = Mixer(), np.zeros((GATES, 1)), np.zeros((GATES, INPUTS))
        for batch in batches:
            for row in batch.to_pylist():
                w, m, ones, all_ = learn(chunk_of(row, True), totals_of(row), known.value)
                weighted, mass = weighted + w * m[:, None], mass + m[:, None]
                mixer.ones, mixer.all = mixer.ones + ones, mixer.all + all_
        value = np.concatenate([x.reshape(-1) for x in (weighted, mass, mixer.ones, mixer.all)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value), dtype=np.int32)), pa.array(value)], names=["cell", "value"])

    got = parts.mapInArrow(train, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    value = np.zeros(GATES * (INPUTS + 1 + 2 * STEPS))
    value[got["cell"].to_numpy()] = got["value"].to_numpy()
    weighted, mass, ones, all_ = np.split(np.round(value, 4), np.cumsum([GATES * INPUTS, GATES, GATES * STEPS]))
    mixer = Mixer()
    weights = (weighted.reshape(GATES, INPUTS) + 1e-9 * mixer.weights) / (mass[:, None] + 1e-9)
    mixer.ones, mixer.all = ones, all_
    final = spark.sparkContext.broadcast((weights.astype(np.float32), mixer.map()))

    def score(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = chunk_of(row)
                value = scores(chunk, totals_of(row), known.value, *final.value)
                total = grow(row["n"], np.int64).reshape(-1, classes.states).sum(1)
                of, bucket, at, mask = (grow(row[c], t) for c, t in (("row", np.int32), ("bucket", np.int64), ("code", np.int32), ("states", np.int32)))
                grid = np.zeros((len(total), classes.states), np.float32)
                grid[chunk.word, chunk.state] = value
                order = np.argsort(bucket, kind="stable")
                starts = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0)))
                out = []
                for part in np.split(order, starts[1:]):
                    entry, state = np.nonzero((mask[part][:, None] >> np.arange(classes.states)) & 1)
                    out.append((int(bucket[part[0]]), squeeze(at[part][entry] * np.int32(classes.states) + state.astype(np.int32)), squeeze(total[of[part]][entry]), squeeze(grid[of[part][entry], state])))
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["at", "key", "seen", "value"])

    scored = chunks.mapInArrow(score, "at long, key binary, seen binary, value binary")
    texts = paired.where("token is null").select("bucket", "ids", "held", "codes", "lengths", "sizes", "present")
    n_all = n_train + n_distinct + 1

    def add_up(x: pa.Table, y: pa.Table) -> pa.Table:
        out = []
        for row in x.to_pylist():  # one
            key, seen, value = (np.concatenate([grow(b, t) for b in y.column(c).to_pylist()]) for c, t in (("key", np.int32), ("seen", np.int64), ("value", np.float32)))
            present, codes, lengths = grow(row["present"], np.int32), grow(row["codes"], np.int32), grow(row["lengths"], np.int64)
            order = np.argsort(key)  # present lists the same keys in ascending order
            count, logs = seen[order], value[order].astype(np.float64) * math.log(10)
            word, base = present // classes.states, np.log10((count + 1) / n_all)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            known_ = np.add.reduceat((count > 0)[codes], starts, dtype=np.int64)
            based, plain = np.add.reduceat(base[codes], starts), np.add.reduceat(logs[codes], starts) / math.log(10)
            whole = adapted_texts(word[codes], logs[codes], lengths)
            bits = -np.array(whole) * math.log2(10) / np.maximum(grow(row["sizes"], np.int64), 1)
            out.append(pa.table({"id": pa.array(row["ids"], x.schema.field("ids").type.value_type), "held_out": pa.array(grow(row["held"], bool)), "n_tokens": pa.array(lengths), "n_known": pa.array(known_, pa.int64()), "train_tokens": pa.array([n_train] * len(lengths), pa.int64()), "base_score": pa.array(based), "score": pa.array(whole), "model_score": pa.array(plain), "bits_per_byte": pa.array(bits)}))
        return pa.concat_tables(out)

    return texts.groupBy("bucket").cogroup(scored.groupBy("at")).applyInArrow(add_up, schema)


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
