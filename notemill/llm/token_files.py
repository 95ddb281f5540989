"""Token-id files: fixed-size id blocks transposed into bit or byte planes, each compressed with zstandard, with an index.

A file set is a Parquet folder written by Spark's own committer, so a lost executor leaves no half file and any store will
do. Each row is one frame of whole documents, at least CHUNK ids where there are as many, with its index columns: shard
and chunk in id order, ids before it in its shard, first and last document id, numbers of documents and ids. A frame is

    magic "NMT1" | mode u8 | width u8 | block u32 | documents u32 | ids u64 | lengths' size u32 | size u32 of each plane
    of each block | zstd(document lengths, u32) | the planes

Blocks have BLOCK ids (the last fewer). Byte mode keeps plane k = byte k of all ids of the block; bit mode keeps plane k =
bit k of all ids, packed. Width is the number of planes that are not all zero, from the lowest.
"""

from __future__ import annotations

import gc
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .bpe import pieces_of, word_and_ending, word_file
from .common import shared_folder, table, text_of

#: Parameters: ids of a block, ids after which a frame is closed, words that a worker remembers, new words encoded together.
BLOCK, CHUNK, MEMO, TOGETHER = 1 << 16, 1 << 20, 600_000, 1024
HEAD = struct.Struct("<4sBBIIQI")
MAGIC = b"NMT1"


def _planes(ids: np.ndarray, mode: str, width: int) -> list[bytes]:
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        return [rows[:, k].tobytes() for k in range(width)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(width)]


def _unplaned(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    if mode == "byte":
        rows = np.zeros((n, 4), np.uint8)
        for k, p in enumerate(planes):
            rows[:, k] = np.frombuffer(p, np.uint8)
    else:
        bits = np.zeros((n, 32), np.uint8)
        for k, p in enumerate(planes):
            bits[:, k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        rows = np.packbits(bits, axis=1, bitorder="little")
    return rows.reshape(-1).view("<u4")


def pack(ids: np.ndarray, lengths: np.ndarray, mode: str = "byte", block: int = BLOCK, level: int = 1) -> bytes:
    """One frame of documents whose lengths sum to len(ids)."""
    squeeze = zstandard.ZstdCompressor(level=level).compress
    top = int(ids.max()).bit_length() if len(ids) else 0
    width = -(-top // 8) if mode == "byte" else top
    sizes, body = [], []
    for at in range(0, len(ids), block):
        for plane in _planes(ids[at : at + block], mode, width):
            body.append(squeeze(plane))
            sizes.append(len(body[-1]))
    docs = squeeze(lengths.astype("<u4").tobytes())
    head = HEAD.pack(MAGIC, ("byte", "bit").index(mode), width, block, len(lengths), len(ids), len(docs))
    return b"".join([head, np.array(sizes, "<u4").tobytes(), docs, *body])


def unpack(frame: bytes, blocks: range | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, document lengths) of a frame; with ``blocks``, only those blocks' ids are decompressed."""
    magic, mode, width, block, n_docs, n, docs_size = HEAD.unpack_from(frame)
    if magic != MAGIC:
        raise ValueError("not a frame of token ids")
    mode, n_blocks = ("byte", "bit")[mode], -(-n // block)
    sizes = np.frombuffer(frame, "<u4", n_blocks * width, HEAD.size).astype(np.int64)
    at = HEAD.size + 4 * len(sizes)
    grow = zstandard.ZstdDecompressor().decompress
    lengths = np.frombuffer(grow(frame[at : at + docs_size], max_output_size=4 * n_docs or 1), "<u4") if n_docs else np.zeros(0, "<u4")
    starts = at + docs_size + np.concatenate(([0], np.cumsum(sizes)))
    out = []
    for b in range(n_blocks) if blocks is None else blocks:
        planes = [grow(frame[starts[b * width + k] : starts[b * width + k + 1]]) for k in range(width)]
        out.append(_unplaned(planes, min(block, n - b * block), mode))
    return (np.concatenate(out) if out else np.zeros(0, "<u4")), lengths


class Remembered(dict):
    """Ids of pieces; what it lacks comes from the generation before, or else gives None and is noted in ``missed``."""

    def __init__(self, old: dict):
        super().__init__()
        self.old, self.missed = old, []

    def __missing__(self, piece: bytes) -> bytes | None:
        known = self.old.get(piece)
        if known is None:
            self.missed.append(piece)
        else:
            self[piece] = known
        return known


class LibraryWords:
    """Ids (little-endian u32) that the tokenizers library gives for pieces between ASCII white space, remembered.

    The normaliser and the pre-tokeniser of the file never look over ASCII white space, so a text's ids are its pieces'
    ids in a row. Words that the normaliser would leave as they are skip it. New pieces go to the library many at a time, joined by spaces: the ids are told apart by the word-end
    marks, one a pre-token; if their number is not as expected, the pieces are encoded one by one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)  # for words that the normaliser leaves as they are and that are one pre-token
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        for tokenizer in (self.library, self.plain):
            tokenizer.no_truncation()
            tokenizer.no_padding()
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values(), default=0) + 1, bool)
        for t, i in vocab.items():
            self.ends[i] = t.endswith("</w>")
        self.pretokens = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.new = Remembered({})

    def _ids(self, texts: list[str], counts: np.ndarray | None) -> list[bytes] | None:
        """Ids of pieces of so many pre-tokens each (None: one), encoded in a row; None if their number is another."""
        tokenizer = self.plain if counts is None else self.library
        ids = np.array(tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != (len(texts) if counts is None else counts.sum()):
            return None
        cuts = [0, *(ends if counts is None else ends[np.cumsum(counts) - 1]).tolist()]
        blob = ids.tobytes()
        return [blob[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]

    def _encode(self, pieces: list[bytes], letters: bool) -> list[bytes]:
        texts = [p.decode("utf-8", "replace") for p in pieces]
        if letters:
            found = self._ids(texts, None)
        else:
            counts = np.array([len(self.pretokens.findall(t.lower())) for t in texts], np.int64)
            found = self._ids(texts, counts) if counts.all() and not any("|>" in t for t in texts) else None
        return found or [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """Encodes the pieces; the dict that has them."""
        new = self.new
        words, others, joined = set(), set(), []
        for p in pieces:
            if p.isalpha() and p.islower():  # of bytes: ASCII letters only
                words.add(p)
                continue
            word, ending = word_and_ending(p)
            if ending or word != p:
                joined.append((p, word, ending))
                (words if is_plain(word) else others).add(word)
                if ending:
                    others.add(ending)
            else:
                (words if is_plain(p) else others).add(p)
        for group, letters in ((words, True), (others, False)):
            todo = [p for p in group if p in pieces or new[p] is None]
            for at in range(0, len(todo), TOGETHER):
                new.update(zip(todo[at : at + TOGETHER], self._encode(todo[at : at + TOGETHER], letters)))
        for p, word, ending in joined:
            new[p] = new[word] + new[ending] if ending else new[word]
        new.missed = []
        return new

    def ids_of(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text. Each piece is looked up once; what is not known yet is encoded together, then filled in."""
        if len(self.new) > MEMO // 2:
            self.new.old = {}
            self.new = Remembered(self.new)
        new = self.new
        rows = [list(map(new.__getitem__, pieces_of(t))) for t in texts]
        missed, new.missed = new.missed, []  # in the order in which None stands in rows
        self.learn(set(missed))
        late = map(new.__getitem__, missed)
        return [b"".join([next(late) if ids is None else ids for ids in row]) for row in rows]


def is_plain(piece: bytes) -> bool:
    """Whether a piece is letters only, in normal form C and lower case."""
    if piece.isalpha():  # of bytes: ASCII letters only
        return piece.islower()
    text = piece.decode("utf-8", "replace")
    return text.isalpha() and text.islower() and text == text.lower() and unicodedata.is_normalized("NFC", text)


@lru_cache(maxsize=2)
def library_words(path: str) -> LibraryWords:
    return LibraryWords(path)


FRAMES = "shard int, chunk int, before long, first_id {0}, last_id {0}, n_docs long, n_ids long, ids array<{0}>, frame binary"


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 1, mode: str = "byte") -> None:
    """The ids of all texts, each with end_id after it, in ascending order of their documents' id (nulls first).

    Null texts are empty and hold the end id only. Repeated ids lie in the order of their texts, equal rows beside each other. Texts are range-sorted by
    id before they are encoded; shards follow the ranges. A text of any length is one document of one frame. Other columns are not
    read; an empty table gives an empty folder that reads as no documents.
    """
    path = path or word_file()
    end = np.array([end_id], "<u4").tobytes()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shard, chunk, before = library_words(path), TaskContext.get().partitionId(), 0, 0
        ids, blobs, n, names = [], [], 0, None

        def row(id_type):
            nonlocal chunk, before, ids, blobs, n
            frame = pack(np.frombuffer(b"".join(blobs), "<u4"), np.array([len(b) // 4 for b in blobs]), mode)
            values = [[shard], [chunk], [before], [ids[0]], [ids[-1]], [len(ids)], [n], [ids], [frame]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), id_type, id_type, pa.int64(), pa.int64(), pa.list_(id_type), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["shard", "chunk", "before", "first_id", "last_id", "n_docs", "n_ids", "ids", "frame"])
            chunk, before, ids, blobs, n = chunk + 1, before + n, [], [], 0
            return out

        gc.disable()  # what is kept here holds no cycles, and looking for them takes a twentieth of the time
        try:
            for batch in batches:
                names = batch.column(0).type
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    for i, blob in zip(part.column(0).to_pylist(), words.ids_of(part.column(1).cast(pa.binary()).to_pylist())):
                        ids.append(i)
                        blobs.append(blob + end)
                        n += len(blobs[-1]) // 4
                        if n >= CHUNK:
                            yield row(names)
        finally:
            gc.enable()
        if ids:
            yield row(names)

    rows.mapInArrow(frames, FRAMES.format(kind)).write.mode("overwrite").parquet(folder)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32), one row a document, from the files: start is the number of ids before it."""
    files = spark.read.parquet(folder)
    kind = files.schema["first_id"].dataType.simpleString()
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))  # reads the index columns only; one row a shard
    shards = shards.select("shard", (F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, lengths = unpack(batch.column(3)[k].as_py())
                blob, ends = memoryview(ids.tobytes()), np.cumsum(lengths.astype(np.int64))
                starts = ends - lengths
                sums = [zlib.crc32(blob[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays([batch.column(2)[k].values, pa.array(np.full(n, batch.column(0)[k].as_py(), np.int32)), pa.array(starts + batch.column(1)[k].as_py(), pa.int64()), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())], names=["id", "shard", "at", "n_tokens", "ids_crc32"])

    rows = files.select("shard", "before", "ids", "frame").mapInArrow(documents, f"id {kind}, shard int, at long, n_tokens long, ids_crc32 long")
    return rows.join(shards, "shard").select("id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(id, tokens array<long>) of every document in the files, the end id included."""
    files = spark.read.parquet(folder)
    kind = files.schema["first_id"].dataType.simpleString()

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, lengths = unpack(batch.column(1)[k].as_py())
                offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))], names=["id", "tokens"])

    return files.select("ids", "frame").mapInArrow(documents, f"id {kind}, tokens array<long>")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder).withColumnRenamed("id", "doc_id")
