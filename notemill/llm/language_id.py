"""Language identification by string kernels: blended-spectrum n-gram presence, Nystroem landmarks, kernel ridge regression.

k(x, y) = |grams(x) & grams(y)| / sqrt(|grams(x)| |grams(y)|), where grams are the distinct sequences of 1 to MAX_N letters
(any run of other characters is one blank) in a table of CELLS cells for each length. LANDMARKS training rows span the
Nystroem space: features are k(x, landmarks) times the inverse root of k(landmarks, landmarks). One ridge regression a
language, one against the rest, is solved in that space on a bounded sample of training rows (SAMPLE for each language).
Scoring multiplies batches of presence rows by one matrix of cells x languages-in-landmark-space.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import id_remainder, table, text_of

#: Parameters.
MAX_N, CELLS, LANDMARKS, SAMPLE, RIDGE, SALTS = 4, 4096, 96, 640, 0.05, 128
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter (one of Unicode's L categories: numerals and marks are none)."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, set(text)))


_MIX = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


def grams(text: str) -> np.ndarray:
    """Presence of the text's grams: MAX_N * CELLS booleans."""
    out = np.zeros((MAX_N, CELLS), bool)
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    letter = letters()[code]
    x = np.where(letter, code, np.uint32(32))
    x = x[letter | np.concatenate(([True], letter[:-1]))]  # one blank for each run of others
    mixed = np.zeros(len(x), np.uint32)
    for n in range(MAX_N):
        if len(x) <= n:
            break
        mixed = (mixed[: len(x) - n] if n else mixed) * np.uint32(31) + x[n:] * _MIX[n]
        out[n, ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519)) >> np.uint32(20)] = True
    return out.reshape(-1)


def kernel(rows: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Of presence rows (float32) and presence landmarks."""
    size = np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1)) * np.sqrt(np.maximum(landmarks.sum(1), 1))
    return rows @ landmarks.T / size


class Classifier:
    """languages, and the matrix (cells x languages) and offsets by which presence rows are scored."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, weights: np.ndarray, offset: np.ndarray):
        self.languages, self.offset = languages, offset.astype(np.float32)
        scaled = landmarks / np.sqrt(np.maximum(landmarks.sum(1, keepdims=True), 1))
        self.matrix = (scaled.T @ weights).astype(np.float32)  # the landmark kernel and the regression in one product

    def predict(self, texts: list[str], batch: int = 256) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for at in range(0, len(texts), batch):
            part = texts[at : at + batch]
            rows = np.stack([grams(t) for t in part]).astype(np.float32)
            value = rows @ self.matrix / np.sqrt(np.maximum(rows.sum(1, keepdims=True), 1)) + self.offset
            share = np.exp(8 * (value - value.max(1, keepdims=True)))
            share /= share.sum(1, keepdims=True)
            for t, k, s in zip(part, value.argmax(1).tolist(), share.max(1).tolist()):
                out.append((self.languages[k], min(1.0, s)) if has_letter(t) else (UNKNOWN, 0.0))
        return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1) -> Classifier | None:
    """From rows with a language whose id's crc32 modulo ``folds`` is not ``held``; None if there is none.

    The sample of a language is its rows of the smallest salted hashes of id and text, an even share of SAMPLE from each of
    SALTS groups, so no task gathers a language; equal rows are one row of it, so a row that a third of all rows repeat, or a
    null id that they share, adds no more to the sample than any other. Null texts, texts without letters and rows without a
    language are not learned from; an empty table, or one without such rows, gives None. Whole texts are read where they lie;
    presence bits (2 KB a row, at most SAMPLE rows a language) are collected.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}") & (id_remainder("id", folds) != held))
    rows = rows.select("lang", "text", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "text", F.lit("sample")).alias("h")).withColumn("salt", F.pmod("h", F.lit(SALTS)))

    def bits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([np.packbits(grams(t)).tobytes() for t in texts.to_pylist()], pa.binary())

    bits.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    first = W.partitionBy("lang", "salt").orderBy("h")
    chosen = rows.select("lang", "salt", "h").withColumn("r", F.row_number().over(first)).where(F.col("r") <= SAMPLE // SALTS)
    top = chosen.groupBy("lang", "salt").agg(F.max("h").alias("last"))
    sample = rows.join(F.broadcast(top), ["lang", "salt"]).where("h <= last").groupBy("lang", "h").agg(F.any_value("text").alias("text"))  # one row a language and salt is broadcast
    got = sample.select("lang", "h", F.arrow_udf(bits, "binary")("text").alias("bits")).toPandas()
    if not len(got):
        return None
    got = got.sort_values(["lang", "h", "bits"], kind="stable")
    rows_x = np.unpackbits(np.frombuffer(b"".join(got["bits"]), np.uint8).reshape(len(got), -1), axis=1)
    languages = sorted(got["lang"].unique())
    place = got["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy()
    each = max(1, LANDMARKS // len(languages))
    marks = np.concatenate([np.flatnonzero(place == k)[:each] for k in range(len(languages))])
    landmarks = rows_x[marks].astype(np.float32)
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    k = np.vstack([kernel(rows_x[i : i + 256].astype(np.float32), landmarks) for i in range(0, len(rows_x), 256)])
    phi = k @ root
    y = np.where(place[:, None] == np.arange(len(languages)), 1.0, -1.0)
    share = 1.0 / np.bincount(place, minlength=len(languages))[place]  # every language weighs the same
    share *= len(share) / share.sum()
    mean, base = np.average(phi, 0, share), np.average(y, 0, share)
    a = (phi - mean) * share[:, None]
    w = np.linalg.solve(a.T @ (phi - mean) + RIDGE * np.eye(phi.shape[1]), a.T @ (y - base))
    return Classifier(languages, landmarks, root @ w, base - mean @ w)


def with_language(docs: DataFrame, classifier: Classifier | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1), in place of columns of these names: a learned language, or ``und`` with 0
    where the text is null or has no letter, or nothing was learned. A tie goes to the language first by code point; equal
    texts get equal results; a text of any length is read whole; no rows give no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for texts in batches:
            values = [t or "" for t in texts.to_pylist()]
            found = model.predict(values) if model and values else [(UNKNOWN, 0.0)] * len(values)
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["lang_pred", "score"])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = F.arrow_udf(run, "lang_pred string, score double")(F.col(text_col))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, found["lang_pred"].alias("lang_pred"), found["score"].alias("score"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    classifier = fit(docs.select("doc_id", "text", "lang"))
    found = with_language(docs.select("doc_id", "text"), classifier)
    return found.select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
