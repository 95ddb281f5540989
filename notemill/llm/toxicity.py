"""Toxicity by noisy-channel deobfuscation: restore what was disguised, then score the restored text.

1. A character language model: counts of four-character sequences of words over all training documents, in a table of
   2**20 cells (32 classes of characters), smoothed by interpolation with shorter contexts.
2. A decoder: a stretch of text that may be disguised (digits or signs among letters, letters repeated three times or
   more, letters spaced out; of any length, anywhere in the text) is a lattice; a sign stands for a letter that it looks like, or for
   nothing; a letter may repeat the one before; letters spaced out may have a word's end between them. Viterbi search finds the likeliest words under the language model and the costs of
   the channel, exactly: every state (three classes before, last letter) keeps its best path, and time is linear in the stretch.
   A stretch without a second reading decodes to itself, so clean words skip the search.
3. A classifier: logistic regression on the presence of restored words and word beginnings, fitted on a bounded sample of
   labelled training rows (POSITIVES and NEGATIVES rows); the intercept is set for the label rate of all of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, stored, table, text_of

#: Parameters: labelled rows of each class that the classifier is fitted on, candidate features, features kept.
POSITIVES, NEGATIVES, CANDIDATES, KEPT = 4000, 8000, 8192, 1200
BEGINNINGS = (4, 5, 6, 7)

#: The letters that a sign can stand for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i", "¢": "c", "¥": "y", "§": "s", "µ": "u", "%": "", "#": "h", "*": "",
}
#: Costs of the channel in nats: a look-alike, a sign that stands for nothing, a repeated letter dropped, a word's end between
#: letters spaced out.
SWAP, DROP, REPEAT, BREAK = 0.7, 1.2, 2.0, 1.0

WORD = re.compile(r"[^\W\d_]+")
#: Signs that join a token and stand for nothing at its ends.
JOINERS = "#%&*._-'"
#: In a stretch: a place between two letters at which a word may end.
GAP = "\0"


def char_class(code: np.ndarray) -> np.ndarray:
    """0 for what is no letter, 1-26 for a-z, 27-31 for other letters."""
    return _CLASSES[np.minimum(code, len(_CLASSES) - 1)]


def _classes() -> np.ndarray:
    out = np.zeros(0x2000, np.uint32)
    for c in range(len(out)):
        if chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else 27 + c % 5
    return out


_CLASSES = _classes()


def sequence_counts(text: str) -> np.ndarray:
    """Cells (four classes, the last of them the predicted one) of a lower-cased text."""
    x = char_class(np.frombuffer((" " + text + " ").encode("utf-32-le", "replace"), np.uint32))
    pad = np.concatenate((np.zeros(3, np.uint32), x))
    cell = (pad[:-3] << 15) | (pad[1:-2] << 10) | (pad[2:-1] << 5) | pad[3:]
    return cell[(x != 0) | (pad[2:-1] != 0)]  # a run of non-letters is one boundary


class CharModel:
    """log P(next class | three classes before it), interpolated with two, one and none."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(32, 32, 32, 32).astype(np.float64)
        p = (c.sum((0, 1, 2)) + 1) / (c.sum() + 32)
        for axes in ((0, 1), (0,), ()):
            n = c.sum(axes) if axes else c
            total = n.sum(-1, keepdims=True)
            p = (n + 4 * p) / (total + 4)  # the shorter context's estimate counts as four
        self.log = np.log(p).astype(np.float32).reshape(-1)


def class_of(ch: str) -> int:
    code = ord(ch)
    return int(_CLASSES[code]) if code < len(_CLASSES) else (27 + code % 5 if ch.isalpha() else 0)


def restore(stretch: str, log: np.ndarray) -> str:
    """The likeliest text behind a stretch, by exact Viterbi search over (last three classes, last letter).

    A path is kept as a chain of its letters, so time and memory are linear in the stretch. Of equals the first found stays.
    """
    paths: dict = {(0, ""): (0.0, None)}  # (context, last letter): (log probability, (letter, chain before))
    for ch in stretch:
        following: dict = {}

        def offer(state, value, chain):
            if state not in following or value > following[state][0]:
                following[state] = value, chain

        if ch == GAP:
            for (context, last), (score, chain) in paths.items():
                offer((context, last), score, chain)
                if context & 31:
                    offer(((context << 5) & 0x7FFF, ""), score - BREAK + float(log[context << 5]), (" ", chain))
            paths = following
            continue
        plain = ch.isalpha()
        readings = [(ch, class_of(ch), 0.0)] if plain else [(x, class_of(x), SWAP) for x in LOOKS_LIKE.get(ch, "")]
        for (context, last), (score, chain) in paths.items():
            for letter, k, cost in readings:
                cell = (context << 5) | k
                offer((cell & 0x7FFF, letter), score - cost + float(log[cell]), (letter, chain))
                if letter == last:
                    offer((context, last), score - cost - REPEAT, chain)
            if not plain:
                offer((context, last), score - DROP, chain)
        paths = following
    best, chain = None, None
    for (context, _), (score, path) in paths.items():
        value = score + (float(log[context << 5]) if context & 31 else 0.0)
        if best is None or value > best:
            best, chain = value, path
    out = []
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return "".join(reversed(out))


LETTER, SIGN, JOINER = 1, 2, 4


def _kinds() -> np.ndarray:
    """By code point: letters, signs that look like a letter, joiners, 0 for others."""
    out = np.zeros(0x2100, np.uint8)
    for c in range(len(out)):
        out[c] = LETTER if chr(c).isalpha() else JOINER if chr(c) in JOINERS else SIGN if LOOKS_LIKE.get(chr(c)) else 0
    return out


_KINDS = _kinds()


def kinds_of(code: np.ndarray) -> np.ndarray:
    """Kinds of the characters of a text; beyond the table those of letters of other scripts count as letters."""
    return np.where(code < len(_KINDS), _KINDS[np.minimum(code, len(_KINDS) - 1)], np.uint8(LETTER))


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each run of True."""
    edge = np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def stretches(text: str) -> Iterator[str]:
    """What may be disguised in a lower-cased text, whole.

    Tokens: runs of letters, signs and joiners, without joiners at their ends, that hold a letter and a sign, an inner
    joiner or three equal letters in a row. Spaced letters: three or more single letters or signs in a row, a letter among
    them, with anything but letters and signs between them; GAP stands between them.
    """
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if len(code) < 3:
        return
    kind = kinds_of(code)
    letter, core = kind == LETTER, (kind == LETTER) | (kind == SIGN)
    triple = np.zeros(len(code), bool)
    triple[2:] = letter[2:] & (code[2:] == code[1:-1]) & (code[2:] == code[:-2])
    odd = (kind == SIGN) | triple
    inner = (kind == JOINER) & np.concatenate(([False], core[:-1])) & np.append(kind[1:] > 0, False)
    start, end = _runs(kind > 0)
    if len(start):
        sums = lambda x: np.add.reduceat(np.append(x, False).astype(np.int32), np.column_stack((start, end)).reshape(-1))[::2]
        maybe = (sums(letter) > 0) & ((sums(odd) > 0) | (sums(inner) > 0))
        for a, b in zip(start[maybe].tolist(), end[maybe].tolist()):
            token = text[a:b].strip(JOINERS)
            if len(token) > 2 and (odd[a:b].any() or not token.isalpha()):
                yield token
    start, end = _runs(core)
    single = end - start == 1
    first, last = _runs(single)
    for a, b in zip(first.tolist(), last.tolist()):
        if b - a >= 3 and letter[start[a:b]].any():
            yield GAP.join([text[k] for k in start[a:b].tolist()])


class Restorer:
    """Words of a text with what is disguised restored; stretches are remembered, at most 200,000 of up to 256 characters."""

    def __init__(self, log: np.ndarray):
        self.log, self.known = log, {}

    def restored(self, stretch: str) -> list[str]:
        words = self.known.get(stretch)
        if words is None:
            words = restore(stretch, self.log).split()
            if len(stretch) <= 256:
                if len(self.known) >= 200_000:
                    self.known.clear()
                self.known[stretch] = words
        return words

    def words(self, text: str) -> set[str]:
        """Lower-cased distinct words: those that stand in the text, and those that disguised stretches restore to."""
        text = text.lower()
        found = set(WORD.findall(text))
        for stretch in set(stretches(text)):
            found.update(self.restored(stretch))
        return found


def features(words: set[str]) -> set[str]:
    return words | {f"^{w[:n]}" for w in words for n in BEGINNINGS if len(w) >= n}


def _gather(docs: DataFrame, cells: int, count) -> np.ndarray:
    """Sum over all rows of count(text) cells, of which there are ``cells`` at most; each task sends one row a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(cells, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(count(text.lower()))
                n += len(held[-1])
                if n >= cells:
                    total += np.bincount(np.concatenate(held), minlength=cells)
                    held, n = [], 0
        total += np.bincount(np.concatenate(held), minlength=cells) if held else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    summed = docs.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.int64)
    out[summed["cell"].to_numpy()] = summed["n"].to_numpy()
    return out


def char_model(docs: DataFrame, text_col: str = "text") -> CharModel:
    return CharModel(_gather(docs.select(text_of(text_col).alias("text")), 1 << 20, sequence_counts))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 300) -> np.ndarray:
    """Weights and, last, the intercept, by accelerated gradient steps in single precision, until they stand still."""
    x = np.ascontiguousarray(np.hstack((x, np.ones((len(x), 1)))), np.float32)
    across, y, n = np.ascontiguousarray(x.T), y.astype(np.float32), np.float32(len(x))
    lift = np.float32(4.0 * len(x) / max(1.0, _top(x, across)))
    w = before = np.zeros(x.shape[1], np.float32)
    shrink = np.full(x.shape[1], ridge / len(x), np.float32)
    shrink[-1] = 0
    for k in range(rounds):
        ahead = w + np.float32(k / (k + 3)) * (w - before)
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        before, w = w, ahead - lift * (across @ (p - y) / n + shrink * ahead)
        if np.abs(w - before).max() < 1e-5:
            break
    return w.astype(np.float64)


def _top(x: np.ndarray, across: np.ndarray) -> float:
    """The largest eigenvalue of x'x, by power iteration."""
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = across @ (x @ v)
        n = float(np.linalg.norm(v))
        v /= max(n, 1e-9)
    return 1.05 * n


class Classifier:
    def __init__(self, log: np.ndarray, names: list[str], weights: np.ndarray, odds: np.ndarray, bias: float):
        self.log, self.weight, self.odds, self.bias = log, dict(zip(names, weights.tolist())), dict(zip(names, odds.tolist())), bias
        self.marker = float(weights[-1]) if len(weights) > len(names) else 0.0
        self.words = frozenset(n for n in names if not n.startswith("^"))
        self.shortest = min(BEGINNINGS)
        self.openings = frozenset(n[1 : 1 + self.shortest] for n in names if n.startswith("^"))

    def score(self, restorer: Restorer, text: str) -> float:
        words, weight, short, openings = restorer.words(text), self.weight, self.shortest, self.openings
        hits = set(words & self.words)
        for w in [w for w in words if w[:short] in openings]:
            hits.update(b for n in BEGINNINGS if (b := "^" + w[:n]) in weight and len(w) >= n)
        z = self.bias + sum(weight[h] for h in sorted(hits)) + self.marker * max((self.odds[h] for h in hits), default=0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier:
    """A classifier from the rows whose id's crc32 modulo ``folds`` is not 0.

    The language model covers all training documents. The classifier is fitted on at most POSITIVES and NEGATIVES
    labelled rows, those of the smallest hashes of their ids (of equal hashes the smaller ids), with one text of each id:
    where rows repeat an id, the least text and, of labels, the greater. Null ids and labels other than 0 and 1 are not
    learned from, null texts are empty. Other columns of docs and labels are not read. Without rows of both classes, or
    without documents, it scores every text by the label rate alone (0.5 without labels).
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = char_model(docs.where(id_remainder("id", folds) != 0))
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    named = named.where(id_remainder("id", folds) != 0)
    totals = {r["y"]: r["n"] for r in named.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        rate = 0.5 if pos == neg else (0.999 if pos else 0.001)
        return Classifier(model.log, [], np.zeros(0), np.zeros(0), math.log(rate / (1 - rate)))
    order = [F.xxhash64("id"), F.col("id")]
    sample = named.where("y = 1").orderBy(*order).limit(POSITIVES).unionByName(named.where("y = 0").orderBy(*order).limit(NEGATIVES))
    rows = docs.join(F.broadcast(sample.groupBy("id").agg(F.max("y").alias("y"))), "id").select("id", "y", text_of("text").alias("text"))
    rows = stored(rows.groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text")).select("y", "text"), "toxicity-sample")  # one text an id
    log = docs.sparkSession.sparkContext.broadcast(model.log)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, found = Restorer(log.value), Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                found.update(features(restorer.words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["f", "n"])

    least = max(3, min(pos, POSITIVES) // 400)
    found = rows.where("y = 1").mapInArrow(words, "f string, n long").groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    names = [r["f"] for r in found.orderBy(F.col("n").desc(), "f").limit(CANDIDATES).collect()]
    place = docs.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, at = Restorer(log.value), place.value
        for batch in batches:
            bits = []
            for text in batch.column(1).to_pylist():
                x = np.zeros(len(at), np.uint8)
                x[[at[f] for f in features(restorer.words(text)) if f in at]] = 1
                bits.append(np.packbits(x).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], names=["y", "bits"])

    got = rows.mapInArrow(presence, "y int, bits binary").toArrow()
    y = got["y"].to_numpy().astype(np.float32)
    if not 0 < y.sum() < len(y):  # labelled documents of one class only, or none
        return Classifier(model.log, [], np.zeros(0), np.zeros(0), math.log(pos / neg))
    x = np.unpackbits(np.frombuffer(b"".join(got["bits"].to_pylist()), np.uint8).reshape(len(y), -1), axis=1)[:, : len(names)] if names else np.zeros((len(y), 0), np.uint8)
    n1, n0 = y.sum(), len(y) - y.sum()
    a, b = x[y == 1].sum(0, dtype=np.float64), x[y == 0].sum(0, dtype=np.float64)
    odds = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1))
    gain = a / n1 * odds  # how often it speaks for the label, times how clearly
    keep = np.sort(np.argsort(-gain, kind="stable")[:KEPT])
    x, odds, names = x[:, keep].astype(np.float32), odds[keep], [names[i] for i in keep]
    strongest = np.where(x > 0, odds, 0).max(1, initial=0).astype(np.float32)
    w = logistic(np.hstack((x, strongest[:, None])), y)
    bias = w[-1] + math.log(pos / neg) - math.log(n1 / n0)
    return Classifier(model.log, names, w[:-1], odds, float(bias))


def with_scores(docs: DataFrame, classifier: Classifier, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1, in place of a column of that name. Null and empty texts have no words and get the score of
    the intercept; repeated rows and equal texts score alike; a text of any length is read whole; no rows give no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        restorer = Restorer(shared.value.log)
        for texts in batches:
            yield pa.array([shared.value.score(restorer, t or "") for t in texts.to_pylist()], pa.float64())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(name, F.arrow_udf(run, "double")(F.col(text_col)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classifier = fit(docs, table(spark, sf_dir, "labels"))
    scored = with_scores(docs, classifier)
    return scored.select("doc_id", (id_remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
