"""BPE encoding and decoding as a bounded-lookahead streaming transducer.

Merges are applied by rank. If two texts share a prefix, their tokens can differ only near the end of that prefix: the
region of difference starts at the end and moves left by |u| when a rule (u, v) fires over its edge; a later rule can
move it on only if its v starts with what now stands at the edge, u or uv. The longest such chain of rules, summed over
|u|, is the merge list's sufficient lookahead: tokens that end at least so many symbols before the end of what has been
read are final, whatever follows. That holds for any text. For the text that has been read, the same chains are followed
through the tokens that really ended at each place while it was merged, in the order of ranks (stable_end), which mostly finds an end far closer:
the encoder looks at every STEP symbols, emits the tokens that are final by then, and encodes what follows as if it stood alone.
Its window never holds more than a few lookaheads, and a few STEPs on ordinary words.

The decoder is a machine that takes one id at a time: either to the text of the bytes that are complete by then, or, as the
library does for a file that names no decoder, to the tokens' strings with a space between.
"""

from __future__ import annotations

import bisect
import codecs
import hashlib
import heapq
import itertools
import json
import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

#: Parameters: words a worker remembers, in two generations, and their most bytes; symbols after which the encoder looks for
#: final tokens; bytes of text whose pieces are handled at a time.
MEMO, REMEMBERED, STEP, SLICE = 600_000, 1024, 16, 1 << 16


#: A rank beyond all.
NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Model:
    """A merge list with word-end marks, read from the JSON file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text = {i: t for t, i in (self.ids | self.special).items()}
        self.splits = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs = {(self.ids[u], self.ids[v]): rank for rank, (u, v) in enumerate(pairs)}
        self.made = [self.ids[u + v] for u, v in pairs]
        shown = byte_symbols()
        self.inner = [self.ids[c] for c in shown]
        self.final = [self.ids[c + self.suffix] for c in shown]
        self.bytes = {c: b for b, c in enumerate(shown)}
        self.lookahead = sufficient_lookahead(pairs, self.suffix)
        self.spaced = spec.get("decoder") is None
        rights: dict[int, list[tuple[str, int]]] = {}
        for rank, (u, v) in enumerate(pairs):
            rights.setdefault(self.ids[u], []).append((v, rank))
        self.ranks = {u: [rank for _, rank in x] for u, x in rights.items()}  # ascending
        self.rights = {u: sorted(x) for u, x in rights.items()}

    def symbols(self, piece: str) -> list[int]:
        """The start symbols of one pre-token: its bytes, the last with the word-end mark."""
        raw = piece.encode("utf-8")
        return [*(self.inner[b] for b in raw[:-1]), self.final[raw[-1]]]

    def words(self, text: str) -> Iterator[str | int]:
        """Pre-tokens of a text, normalised, and the ids of special tokens."""
        at = 0
        for m in self.splits.finditer(text) if self.splits else ():
            yield from (x[0] for x in self.pieces.finditer(normalised(text[at : m.start()])))
            yield self.special[m[0]]
            at = m.end()
        yield from (x[0] for x in self.pieces.finditer(normalised(text[at:])))

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of a sequence: the pair of least rank first, from the left."""
        if len(ids) > 64:
            return self.history(ids)[0]
        get, made, ids = self.pairs.get, self.made, list(ids)
        ranks = [get(pair, NEVER) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [new] = [made[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], new), NEVER)
            if i < len(ranks):
                ranks[i] = get((new, ids[i + 1]), NEVER)
        return ids

    def history(self, ids: list[int]) -> tuple[list[int], list[list[list[float]]], list[float]]:
        """The merged sequence; for each place the tokens that ended there, each as [token, rank at which it came, rank at which
        it went]; for each place the rank at which it went: when a merge took in both sides."""
        get, made, ids, n = self.pairs.get, self.made, list(ids), len(ids)
        right, left = [*range(1, n), n], [-1, *range(n - 1)]
        ended: list = [[], *([[x, -1, math.inf]] for x in ids)]
        gone = [math.inf] * (n + 1)
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = right[i]
            if j == n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = new, _ = made[rank], -1
            right[i] = end = right[j]
            ended[j][-1][2] = ended[end][-1][2] = gone[j] = rank
            ended[end].append([new, rank, math.inf])
            if end < n:
                left[end] = i
                if (f := get((new, ids[end]))) is not None:
                    heapq.heappush(heap, (f, i, new, ids[end]))
            if (k := left[i]) >= 0 and (f := get((ids[k], new))) is not None:
                heapq.heappush(heap, (f, k, ids[k], new))
        return [x for x in ids if x >= 0], ended, gone

    def fires(self, u: int, edge: str, known: str, after: float, until: float) -> float | None:
        """The least rank in (after, until] of a rule (u, v) whose v starts with edge and agrees with the known text, if any."""
        if not known:
            ranks = self.ranks.get(u, [])
            at = bisect.bisect_right(ranks, after)
            return ranks[at] if at < len(ranks) and ranks[at] <= until else None
        rights, best = self.rights.get(u, []), None
        at = bisect.bisect_left(rights, (known, -1))
        while at < len(rights) and rights[at][0].startswith(known):
            rank = rights[at][1]
            if after < rank <= until and (best is None or rank < best):
                best = rank
            at += 1
        for k in range(len(edge), len(known)):
            rank = self.pairs.get((u, self.ids.get(known[:k], -1)))
            if rank is not None and after < rank <= until and (best is None or rank < best):
                best = rank
        return best

    def stable_end(self, window: list[int], ended: list, gone: list[float]) -> int:
        """The place before which nothing that follows the window can change its tokens.

        A difference stands at a place from some rank on, with a token that starts there (edge) on one side of the two
        courses of merges. It moves left over a token u that ends there at that time if a rule (u, v) of a later rank can
        fire whose v starts with the edge, or if the window's own course takes u over the place later.
        """
        text = "".join(self.text[s] for s in window)
        least = n = len(window)
        best: dict[tuple[int, str], float] = {}
        todo: list[tuple[int, str, float]] = [(n, "", -2)]
        while todo:
            place, edge, rank = todo.pop()
            least = min(least, place)
            for u, came, went in ended[place]:
                if went < rank:
                    continue
                moved = self.fires(u, edge, text[place:], max(rank, came), went)
                if went == gone[place] and went > rank:
                    moved = went if moved is None else min(moved, went)
                if moved is not None:
                    after = place - self.width[u], self.text[u]
                    if moved < best.get(after, math.inf):
                        best[after] = moved
                        todo.append((*after, moved))
        return least

    def stream(self, symbols: Iterable[int], step: int = STEP) -> Iterator[int]:
        """Tokens of one pre-token, each as soon as it is final; the window has four lookaheads at most."""
        symbols, width, limit = iter(symbols), self.width, max(64, 4 * self.lookahead)
        window = list(itertools.islice(symbols, step))
        while (following := next(symbols, None)) is not None:
            tokens, *course = self.history(window)
            final = self.stable_end(window, *course)
            if len(window) >= limit:
                final = max(final, len(window) - self.lookahead - 1)
            done = 0
            for token in tokens:
                if done + width[token] > final:
                    break
                done += width[token]
                yield token
            window = [*window[done:], following]
            window += itertools.islice(symbols, max(step, len(window) // 2) - 1)
        yield from self.merge(window)

    def tokens(self, text: str) -> Iterator[int]:
        """The ids of a text, one by one."""
        for word in self.words(text):
            if isinstance(word, int):
                yield word
            else:
                yield from self.stream(self.symbols(word))

    def encode(self, text: str) -> list[int]:
        return list(self.tokens(text))

    @property
    def width(self) -> dict[int, int]:
        """Start symbols in each token."""
        if not hasattr(self, "_width"):
            self._width = {i: len(t.removesuffix(self.suffix)) if self.suffix else len(t) for t, i in self.ids.items()}
        return self._width


class Decoder:
    """An incremental machine: feed() takes one id and returns the text that is certain by then, close() the rest.

    ``spaced``: the strings of tokens with a space between, as the library decodes for a file without a decoder. Else a
    byte-to-text machine: the tokens' bytes as UTF-8, a space after each word end. Ids without a token give nothing.
    """

    def __init__(self, model: Model, spaced: bool = False):
        self.model, self.spaced, self.started = model, spaced, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, token: int) -> str:
        text = self.model.text.get(token)
        if text is None:
            return ""
        if self.spaced:
            before, self.started = " " if self.started else "", True
            return before + text
        if text in self.model.special:
            return self.close() + text
        end = bool(self.model.suffix) and text.endswith(self.model.suffix)
        raw = bytes(self.model.bytes[c] for c in text.removesuffix(self.model.suffix if end else ""))
        return self.utf8.decode(raw) + (self.close() + " " if end else "")

    def close(self) -> str:
        if self.spaced:
            return ""
        out = self.utf8.decode(b"", True)
        self.utf8.reset()
        return out


def sufficient_lookahead(pairs: list[tuple[str, str]], suffix: str = "") -> int:
    """Symbols to the left of the end of a prefix that what follows it can still change; see the module's text."""
    made: dict[str, tuple[str, str]] = {}
    for u, v in pairs:
        made.setdefault(u + v, (u, v))
    best: dict[str, int] = {}
    most = 0
    for u, v in pairs:
        edge, longest = v, 0
        while True:  # the left spine of v: what can have stood at the edge when v began
            longest = max(longest, best.get(edge, 0))
            if edge not in made:
                break
            edge = made[edge][0]
        reach = longest + len(u.removesuffix(suffix) if suffix else u)
        for t in (u, u + v):
            best[t] = max(best.get(t, 0), reach)
        most = max(most, reach)
    return most


#: White space of the normaliser.
SPACE = regex.compile("[\\t-\\r \\x85\\xa0  -     　]+")


def normalised(text: str) -> str:
    """NFC, runs of white space as one space, then lower case character by character (no final-sigma rule)."""
    if text.isascii():
        return text.lower()
    text = SPACE.sub(" ", unicodedata.normalize("NFC", text))
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


#: Signs that end a word as pre-tokens of their own.
ENDINGS = b".,;:!?%&$#*|\")"


def word_and_ending(piece: bytes) -> tuple[bytes, bytes]:
    """A piece as (letters, signs) whose tokens in a row are the piece's, or (piece, nothing); ASCII letters are lowered."""
    core = piece.rstrip(ENDINGS)
    if core.isalpha():  # of bytes: ASCII letters only
        return core.lower(), piece[len(core) :]
    if core and len(core) < len(piece):
        text = core.decode("utf-8", "replace")
        if text.isalpha() and normalised(text).isalpha():  # a capital that lower case turns into a letter and a mark is not
            return core, piece[len(core) :]
    return piece, b""


_PARTED = re.compile(rb"[,.](?=[ \n])(?<=[A-Za-z][,.])")  # a sign first, so that the search skips to signs


def pieces_of(text: str | bytes) -> list[bytes]:
    """The text (or its UTF-8 bytes) cut at ASCII white space; so that fewer pieces differ, a lone comma or stop after an ASCII letter is a
    piece of its own, as it is a pre-token of its own, and texts of ASCII only are lowered, as the normaliser would."""
    raw = text if isinstance(text, bytes) else text.encode("utf-8", "replace")
    if raw.isascii() and b"<|" not in raw:
        raw = raw.lower()
    return _PARTED.sub(rb" \g<0>", raw).split()


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    return Model(path)


def word_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memo(dict):
    """What make() gives for a key, remembered in two generations of at most half of MEMO keys."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= MEMO // 2:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def slices_of(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in parts of about ``size`` characters that end at ASCII white space, or after a whole word."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            found = _BLANK.search(text, end)
            end = found.end() if found else len(text)
        yield text[at:end]
        at = end


_BLANK = re.compile("[ \\t\\n\\x0b\\f\\r]")


def written(ids: Iterable[int]) -> bytes:
    return b" ".join([b"%d" % i for i in ids])


@lru_cache(maxsize=4)
def _written_memo(path: str) -> Memo:
    """Of a piece: its ids as decimal numbers with spaces between."""
    model = load(path)

    def make(piece: bytes) -> bytes:
        word, ending = word_and_ending(piece)
        if ending or word != piece:
            return b" ".join([memo[word], memo[ending]]) if ending else memo[word]
        return written(model.encode(piece.decode("utf-8", "replace")))

    memo = Memo(make)
    return memo


@lru_cache(maxsize=4)
def _spelled_memo(path: str) -> Memo:
    """Of some ids, written as by _written_memo: what a decoder that starts with them returns."""
    model = load(path)

    def make(ids: bytes) -> bytes:
        machine = Decoder(model, True)
        return "".join([machine.feed(int(i)) for i in ids.split()]).encode("utf-8")

    return Memo(make)


class Digest:
    """Number of ids, SHA-256 of the ids and of the decoded text, fed with runs of ids as they are final."""

    def __init__(self, path: str):
        self.model, self.encoded, self.decoded = load(path), _written_memo(path), _spelled_memo(path)
        self.n, self.ids, self.text = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, runs: list[bytes], spelled: list[bytes]) -> None:
        if runs:
            before = b" " if self.n else b""
            ids = before + b" ".join(runs)
            self.ids.update(ids)
            self.text.update(before + b" ".join(spelled))
            self.n += ids.count(b" ") + (not before)

    def read(self, text: str) -> Digest:
        encoded, decoded = self.encoded, self.decoded
        for part in slices_of(text):
            pieces = pieces_of(part)
            if len(part) > SLICE and max(map(len, pieces), default=0) > REMEMBERED:
                for piece in pieces:
                    self._long(piece) if len(piece) > REMEMBERED else self._runs([encoded[piece]])
                continue
            self._runs([encoded[w] for w in pieces])
        return self

    def _runs(self, runs: list[bytes]) -> None:
        decoded = self.decoded
        if b"" in runs:  # white space beyond ASCII only
            runs = [x for x in runs if x]
        self.add(runs, [decoded[x] for x in runs])

    def _long(self, piece: bytes) -> None:
        """A piece that is not remembered: ids go to the digests in runs, through one decoder each."""
        ids = self.model.tokens(piece.decode("utf-8", "replace"))
        while run := list(itertools.islice(ids, 4096)):
            machine = Decoder(self.model, True)
            self.add([written(run)], ["".join(map(machine.feed, run)).encode("utf-8")])


@lru_cache(maxsize=4)
def _ids_memo(path: str) -> Memo:
    model = load(path)
    return Memo(lambda chunk: tuple(model.encode(chunk.decode("utf-8", "replace"))))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row's whole text.

    A text goes through encoder, decoder and both digests slice by slice, so its ids and its decoded text are never held whole.
    It is cut at ASCII white space, over which neither the normaliser nor the pre-tokeniser looks; a worker remembers
    the ids of such pieces and the text of such ids (at most MEMO each). The decoder is the library's for a file that names none:
    the tokens' strings with a space between; a file that names one is refused. Null texts count as empty; nulls in the id, repeated rows and texts of any
    length are kept row by row; other columns are not read; an empty table gives an empty result.
    """
    path = path or word_file()
    if not load(path).spaced:
        raise ValueError("digests decodes as the library does for files that name no decoder")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Digest(path).read(text) for text in batch.column(1).to_pylist()]
            kinds = (pa.int64(), pa.string(), pa.string())
            values = [(d.n, d.ids.hexdigest(), d.text.hexdigest()) for d in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([v[k] for v in values], t) for k, t in enumerate(kinds))], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """docs with the column ``ids`` (array of int) in place of the text, and of a column of that name; null and empty texts
    give an empty array, repeated rows are encoded each, other columns stay, an empty table gives an empty result."""
    path = path or word_file()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        memo = _ids_memo(path)
        for texts in batches:
            yield pa.array([[i for w in pieces_of(text or "") for i in memo[w]] for text in texts.to_pylist()], pa.list_(pa.int32()))

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn("ids", F.arrow_udf(run, "array<int>")(F.col(text_col))).drop(text_col)


def decode_documents(encoded: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """encoded with the column ``text`` in place of the ids, and of a column of that name: the tokens' bytes as text, a space
    after each word end; null ids give an empty text."""
    path = path or word_file()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load(path)
        for rows in batches:
            out = []
            for ids in rows.to_pylist():
                machine = Decoder(model)
                out.append("".join([*map(machine.feed, ids or ()), machine.close()]))
            yield pa.array(out, pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return encoded.withColumn("text", F.arrow_udf(run, "string")(F.col(ids_col))).drop(ids_col)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
