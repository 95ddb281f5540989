"""SimHash near-dedup: 64-bit fingerprints of word shingles, candidates by pigeonring chains, then the full Hamming check."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import cut, stored, table, text_of
from .components import connected_components

BITS, PARTS, SEED = 64, 4, 42
#: Parameters: documents whose shingles are counted for an order, and shingles that it names. They change no result.
ORDER_SAMPLE, ORDER_TOP = 4096, 1 << 18
#: Parameter: as many ids are broadcast at most.
BROADCAST_IDS = 1 << 19
#: Parameter: 64-bit words of a set's parity bits.
PARITY = 16
LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, words: int, digest=xxhash.xxh64_intdigest) -> np.ndarray:
    """XXH64 of every shingle, repeats included; of the whole sequence if it has fewer words; empty without words."""
    tokens = text.lower().split()  # of bytes: A-Z and the six white-space characters only
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-words] + 1))
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())], np.uint64, len(starts))


def majority(hashes: np.ndarray) -> np.uint64:
    """A bit is 1 if it is set in over half of the hashes; 0 without hashes."""
    n, counts = len(hashes), np.zeros((8, 8), np.int64)  # [bit of a byte, byte]
    for k in range(8):
        lanes = (hashes >> np.uint64(k)) & LANES
        whole = n // 255 * 255
        full = lanes[:whole].reshape(-1, 255).sum(axis=1)  # at most 255 in a byte: no carry
        counts[k] = np.append(full, lanes[whole:].sum()).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > n).T.astype(np.uint8)  # byte by byte, lowest bit first
    return np.packbits(bits.reshape(-1), bitorder="little").view("<u8")[0]


def fingerprint(text: bytes, words: int) -> int:
    return int(majority(shingle_hashes(text, words)))


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, fp): fp as a signed long of the same 64 bits."""

    def marks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            values = [fingerprint(x.encode("utf-8", "surrogatepass"), words) for x in texts]
            yield pd.Series(np.array(values, np.uint64).view(np.int64))

    marks.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.select(F.col(id_col).alias("id"), F.pandas_udf(marks, "long")(text_of(text_col)).alias("fp"))


def ring_links(points: DataFrame, fp: str = "fp", distance: int = 3) -> DataFrame:
    """(a, b), a < b: every pair of the distinct fingerprints in points that differ in at most ``distance`` <= 3 bits.

    The fingerprint is a ring of four 16-bit segments with d_0..d_3 differing bits. As they sum to at most 3, some
    start s has every chain within its proportional budget: d_s <= 3/4, d_s + d_s+1 <= 6/4, three segments <= 9/4, the
    ring <= 3 (the pigeonring principle). So a chain begins with an equal segment whose successor differs by one bit at
    most: both go into the join key, 34 bits with the start, the second as it is or with one of its 0-bits set
    (of two different segments, one has the bit 0). Longer chains and the full distance are checked on what meets.
    """
    if not 0 <= distance <= 3:
        raise ValueError("four segments hold for up to 3 differing bits")
    x = points.select(F.col(fp).alias("x"))

    def segment(col, k):
        return F.shiftrightunsigned(col, 16 * (k % 4)).bitwiseAND(F.lit(0xFFFF))

    rows, probes = [], []
    for s in range(PARTS):
        key = F.shiftleft(segment(F.col("x"), s), 16).bitwiseOR(F.lit(s << 32))
        near = segment(F.col("x"), s + 1)
        rows.append(F.struct(key.bitwiseOR(near).alias("k"), F.lit(s).alias("s")))
        probes.append(F.struct(key.bitwiseOR(near).alias("k"), F.lit(False).alias("flip")))
        probes += [F.when(near.bitwiseAND(F.lit(1 << j)) == 0, F.struct(key.bitwiseOR(near).bitwiseOR(F.lit(1 << j)).alias("k"), F.lit(True).alias("flip"))) for j in range(16)]
    index = x.select("x", F.inline(F.array(*rows)))
    probe = x.select(F.col("x").alias("y"), F.explode(F.filter(F.array(*probes), lambda p: p.isNotNull())).alias("p")).select("y", "p.*")
    met = index.join(probe, "k").where(F.col("flip") | (F.col("x") < F.col("y")))
    diff = F.col("x").bitwiseXOR(F.col("y"))
    chain = F.lit(False)
    for s in range(PARTS):
        chain = chain | ((F.col("s") == s) & (F.bit_count(segment(diff, s + 1)) + F.bit_count(segment(diff, s + 2)) <= 2))
    met = met.where(chain & (F.bit_count(diff) <= distance))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3) -> DataFrame:
    """(id, fp, component_id) for every row: component_id is the smallest id reachable over fingerprints that differ in
    at most ``distance`` bits, itself included.

    Copies share a fingerprint and are one node, so thousands of copies add no links. Rows with a null id get a
    fingerprint, no component (null) and link with nothing. Repeated rows share their component.
    """
    marked = cut(with_fingerprints(docs, id_col, text_col, words))
    nodes = marked.where("id is not null").groupBy("fp").agg(F.min("id").alias("least"))
    nodes = cut(nodes)
    found = connected_components(ring_links(nodes, distance=distance))
    named = nodes.join(found.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = named.join(named.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    out = marked.join(named, "fp", "left")
    return out.select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def shingle_order(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts): the most frequent shingles of ORDER_SAMPLE documents of rows (id, text), by shingle.

    They only say in which order a document's shingles are looked at, rare ones first; any order gives the same pairs.
    """
    every = max(1, rows.count() // ORDER_SAMPLE)
    some = rows.where(F.pmod(F.xxhash64("id", F.lit("order")), F.lit(every)) == 0).select("text")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, words).view(np.int64))], names=["s"])

    top = some.mapInArrow(shingles, "s long").groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    top = top.orderBy(F.col("n").desc(), "s").limit(ORDER_TOP).orderBy("s").toArrow()
    return top.column("s").to_numpy(), top.column("n").to_numpy()


def shingle_set(text: str, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text.encode("utf-8", "surrogatepass"), words))


def sorted_set(text: str, words: int) -> np.ndarray:
    return np.sort(shingle_set(text, words).view(np.int64))


def name_sets(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64))


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def first_shingles(shingles: np.ndarray, size: int, order: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The size first shingles (distinct longs, ascending) by count in order, then by value."""
    known, counts = order
    at = np.searchsorted(known, shingles)
    at[at == len(known)] = 0
    often = known[at] == shingles if len(known) else np.zeros(len(shingles), bool)
    rare = shingles[~often][:size]
    if len(rare) == size:
        return rare
    rest = shingles[often]
    return np.concatenate((rare, rest[np.lexsort((rest, counts[at[often]]))][: size - len(rare)]))


def parities(sets: list[np.ndarray]) -> list[pa.Array]:
    """PARITY columns: each member of a set flips one of its 64 * PARITY bits, chosen by the upper bits of its hash."""
    size = 64 * PARITY
    place = [s.view(np.uint64) >> np.uint64(64 - size.bit_length() + 1) for s in sets]
    cell = np.concatenate([np.zeros(0, np.int64), *(p.astype(np.int64) + k * size for k, p in enumerate(place))])
    odd = (np.bincount(cell, minlength=len(sets) * size) & 1).astype(np.uint8)
    words = np.packbits(odd, bitorder="little").view("<i8").reshape(len(sets), PARITY)
    return [pa.array(np.ascontiguousarray(words[:, k])) for k in range(PARITY)]


def within_parity(pairs: DataFrame, nodes: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs (a, b) whose sets can have a Jaccard similarity of p / q by their sizes and parity bits.

    Bits that differ are flipped by members of one set only, so there are at most as many as members that the sets do not
    share, of which similar sets of sizes n and m have at most (n + m) (q - p) / (q + p): no similar pair is left out.
    """
    marks = [f"b{k}" for k in range(PARITY)]
    sides = [nodes.select(F.col("x").alias(e), F.col("n").alias(f"{e}_n"), *(F.col(m).alias(f"{e}_{m}") for m in marks)) for e in "ab"]
    differ = sum((F.bit_count(F.col(f"a_{m}").bitwiseXOR(F.col(f"b_{m}"))) for m in marks), F.lit(0)).cast("long")
    met = pairs.join(sides[0], "a").join(sides[1], "b").where(differ * (p + q) <= (F.col("a_n") + F.col("b_n")) * (q - p))
    return met.select("a", "b")


def jaccard_links(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, words: int, p: int, q: int) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity is at least p / q. nodes (x, id, n, parity bits) names a row (id,
    text) of each set. Whole sets are compared, and sent, only for the pairs that sizes and parity bits allow."""
    pairs = stored(within_parity(pairs, nodes, p, q), "pairs")
    wanted = stored(nodes.select("x", "id").join(pairs.select(F.explode(F.array("a", "b")).alias("x")).distinct(), "x", "left_semi"), "wanted")
    ids = wanted.select("id").distinct()
    if wanted.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)  # else all texts are dealt by id

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted_set(t, words) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([name_sets(sets), lists(sets)], names=["x", "set"])

    found = stored(rows.join(ids, "id", "left_semi").select("text").mapInArrow(run, "x long, set array<long>"), "sets")
    of_a, of_b = found.select(F.col("x").alias("a"), F.col("set").alias("u")), found.select(F.col("x").alias("b"), F.col("set").alias("v"))
    both = F.size(F.array_intersect("u", "v")).cast("long")
    alike = pairs.join(of_a, "a").join(of_b, "b").where(both * (p + q) >= (F.size("u") + F.size("v")) * p)
    return stored(alike.select("a", "b").distinct(), "links")  # a row that is repeated has its set more than once


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id) for every row: groups of documents whose sets of word shingles have a Jaccard similarity of at
    least ``similarity``; component_id is the smallest id of the group. The groups are exact (up to equal 64-bit hashes).

    64 bits of a SimHash differ in up to 20 places at 0.8, so they give no exact key; shingles do. Two sets of sizes n and m
    that are similar by p / q share at least p (n + m) / (p + q) shingles. With all shingles in one order, their first common
    one has at least so many from there to the end in either set. So every similar pair meets on one of the first
    n - ceil(n p / q) + 1 shingles of both, whatever the number of documents, and rare shingles come first.

    Members of a key are first compared with one of them (for two such a document), so that a group of near copies becomes one
    component at once. Then, in each key that still has several components, all pairs across them are compared whose sizes
    and places allow the similarity. Pairs left out are in one component already.

    Texts of the same set are one node. Texts without words are copies of each other. Rows with a null id have a null
    component and link with nothing.
    """
    p, q = Fraction(str(similarity)).as_integer_ratio()
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    order = rows.sparkSession.sparkContext.broadcast(shingle_order(rows, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [sorted_set(t, words) for t in batch.column(1).to_pylist()]
            first = [first_shingles(s, len(s) - -(-len(s) * p // q) + 1, order.value) if len(s) else s for s in sets]
            columns = [batch.column(0), name_sets(sets), pa.array([len(s) for s in sets], pa.int32()), *parities(sets), lists(first)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "x", "n", *bits, "first"])

    bits = [f"b{k}" for k in range(PARITY)]
    kind = rows.schema["id"].dataType.simpleString()
    marked = stored(rows.mapInArrow(run, ", ".join([f"id {kind}, x long, n int", *(f"{b} long" for b in bits), "first array<long>"])), "marked")
    nodes = stored(marked.where("id is not null").groupBy("x").agg(F.min("id").alias("id"), *(F.max(c).alias(c) for c in ("n", *bits))), "nodes")
    keys = marked.where("id is not null").select("x", "n", F.posexplode("first").alias("pos", "key")).select("key", "x", "n", (F.col("n") - F.col("pos")).alias("left"))
    same = W.partitionBy("key")
    smaller = F.col("left") * (p + q) >= F.col("n") * (2 * p)  # may be the smaller one of a pair
    keys = keys.withColumn("hub", F.min(F.col("x").bitwiseXOR(F.col("key"))).over(same).bitwiseXOR(F.col("key")))
    keys = keys.withColumn("several", F.min("x").over(same) < F.max("x").over(same)).withColumn("meets", F.max(smaller).over(same))
    members = stored(keys.where("several and meets").select("key", "x", "n", "left", "hub").distinct(), "members")

    hubs = members.where("x = hub").select("key", F.col("n").alias("u_n"), F.col("left").alias("u_left"))
    near = members.where("x <> hub").join(hubs, "key").where(may_be_similar(p, q)).groupBy("x").agg(F.min("hub").alias("h1"), F.max("hub").alias("h2"))
    near = near.select("x", F.explode(F.array("h1", "h2")).alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    links = jaccard_links(near.distinct(), rows, nodes, words, p, q)
    groups = connected_components(links).withColumnRenamed("id", "x")
    links = links.unionByName(jaccard_links(pairs_across(members, groups, p, q), rows, nodes, words, p, q))

    found = connected_components(links).withColumnRenamed("id", "x")
    named = nodes.join(found, "x", "left").select("x", "id", F.coalesce("component", "x").alias("component"))
    named = named.join(named.groupBy("component").agg(F.min("id").alias("component_id")), "component").select("x", "component_id")
    out = marked.select("id", "x").join(named, "x", "left")
    return out.select("id", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def may_be_similar(p: int, q: int) -> Column:
    """Whether sets of the sizes n and u_n whose first common shingle has left and u_left to the end can be similar by p / q."""
    enough = F.least("u_left", "left") * (p + q) >= (F.col("u_n") + F.col("n")) * p
    return enough & (F.least("u_n", "n") * q >= F.greatest("u_n", "n") * p)


def pairs_across(members: DataFrame, groups: DataFrame, p: int, q: int) -> DataFrame:
    """(a, b) of different components that meet in members (key, x, n, left) and may be similar: in each key, those outside
    its most frequent component against all."""
    placed = members.join(groups, "x", "left").select("key", "x", "n", "left", F.coalesce("component", "x").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    placed = stored(placed.join(mixed, "key"), "placed")
    main = placed.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "component"))["component"].alias("main"))
    outside = placed.join(main, "key").where("component <> main")
    u, v = outside.select("key", *(F.col(c).alias(f"u_{c}") for c in ("x", "n", "left", "component"))), placed
    met = u.join(v, "key").where("u_component <> component")
    met = met.where(may_be_similar(p, q))
    return met.select(F.least("x", "u_x").alias("a"), F.greatest("x", "u_x").alias("b")).distinct()


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
