"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in built-in expressions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from .common import stored, table, text_of

#: Parameters: points of each shard on the ring, and the parts of an arc over which its keys are counted.
VIRTUAL_NODES, RANGES = 128, 256
#: Parameter: repeats of one row that are counted out at a time.
REPEATS = 4096
#: Parameter: shards of the query.
SHARDS = 8


def ring(n_shards: int, virtual_nodes: int) -> list[tuple[int, int]]:
    """(point, shard) of every virtual node, clockwise. A shard's points depend on its number alone."""
    point = lambda s, k: int(hashlib.md5(f"{s}:{k}".encode()).hexdigest()[:8], 16)
    return sorted((point(s, k), s) for s in range(n_shards) for k in range(virtual_nodes))


def capacities(n_rows: int, n_shards: int, slack: float = 0.0) -> list[int]:
    """The most rows of each shard. Without slack they sum to n_rows, so every shard is filled and counts are at most one apart."""
    if slack:
        return [int(-(-n_rows * (1 + slack) // n_shards))] * n_shards
    return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]


def plan(counts: list[int], nodes: list[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first, last, shard, slot): the keys of rank first..last - 1 of an arc go to a shard, in slots from slot on.

    All keys of an arc meet the same nodes clockwise, so counts decide: first every arc fills the shard of its own node, arc
    after arc; then what is left of each arc goes on clockwise to the next nodes whose shards have room.
    """
    room, cut, left = list(room), [], []
    for arc, n in enumerate(counts):
        shard = nodes[arc][1]
        kept = min(n, room[shard])
        room[shard] -= kept
        if kept:
            cut.append((arc, 0, kept, shard))
        if n > kept:
            left.append((arc, kept, n))
    for arc, first, last in left:
        for step in range(1, len(nodes)):
            shard = nodes[(arc + step) % len(nodes)][1]
            taken = min(last - first, room[shard])
            if taken:
                room[shard] -= taken
                cut.append((arc, first, first + taken, shard))
                first += taken
            if first == last:
                break
    slots, out = [0] * len(room), []
    for arc, first, last, shard in sorted(cut):
        out.append((arc, first, last, shard, slots[shard]))
        slots[shard] += last - first
    return out


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def _arc(point: Column, nodes: list[tuple[int, int]]) -> Column:
    """The first node at or after a point, by bisection in a constant array; past the last it is the first again."""
    points = F.expr(f"array({', '.join(f'{p}L' for p, _ in nodes)})")
    steps = [1 << k for k in range(len(nodes).bit_length() - 1, -1, -1)]
    before = lambda low, step: F.coalesce(F.get(points, low + step - 1) < point, F.lit(False))
    low = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when(before(low, step), low + step).otherwise(low))
    return F.when(low < len(nodes), low).otherwise(F.lit(0))


def _placed(entries: DataFrame, nodes: list[tuple[int, int]], n_shards: int, ranges: int, slack: float) -> DataFrame:
    """entries (arc, lie, tie, n) once for each of their n equal rows, with shard and slot."""
    entries = entries.withColumn("range", F.shiftright(_number(F.substring("lie", 1, 8)) * ranges, 32).cast("int"))
    parts = entries.groupBy("arc", "range").agg(F.sum("n").alias("rows"))
    counts = {r["arc"]: r["rows"] for r in parts.groupBy("arc").agg(F.sum("rows").alias("rows")).collect()}  # a row an arc
    counts = [counts.get(arc, 0) for arc in range(len(nodes))]
    pieces = plan(counts, nodes, capacities(sum(counts), n_shards, slack))
    in_arc = W.partitionBy("arc").orderBy("range").rowsBetween(W.unboundedPreceding, 0)
    parts = parts.select("arc", "range", (F.sum("rows").over(in_arc) - F.col("rows")).alias("before"))
    here = W.partitionBy("arc", "range").orderBy("lie", "tie").rowsBetween(W.unboundedPreceding, 0)
    rows = entries.join(parts, ["arc", "range"]).withColumn("start", F.col("before") + F.sum("n").over(here) - F.col("n"))
    spark = entries.sparkSession
    pieces = F.broadcast(spark.createDataFrame(pieces, "of int, first long, last long, shard int, slot long"))  # arcs times shards at most
    met = (F.col("arc") == F.col("of")) & (F.col("start") < F.col("last")) & (F.col("start") + F.col("n") > F.col("first"))
    rows = rows.join(pieces, met)
    low, high = F.greatest("start", "first"), F.least(F.col("start") + F.col("n"), "last")
    rows = rows.withColumn("high", high).withColumn("some", F.explode(F.sequence(low, high - 1, F.lit(REPEATS).cast("long"))))
    rows = rows.withColumn("rank", F.explode(F.sequence("some", F.least(F.col("some") + REPEATS, "high") - 1)))
    return rows.withColumn("slot", F.col("slot") + F.col("rank") - F.col("first")).drop("range", "before", "start", "of", "first", "last", "high", "some", "rank")


def _keys(id_col: str, text_col: str, nodes: list[tuple[int, int]]) -> list[Column]:
    """arc: by the id alone. lie: where a row lies in its arc, by id and text."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return [
        _arc(_number(F.substring(F.md5(key), 1, 8)), nodes).alias("arc"),
        F.md5(F.concat(key, F.lit(":"), F.md5(text_of(text_col)))).alias("lie"),
    ]


def shard_rows(docs: DataFrame, n_shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0, ranges: int = RANGES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot), one row for each row of docs; slots of a shard run from 0 without gaps.

    A ring of hashes holds virtual_nodes points of each shard. A key (the id) belongs to the first point clockwise of its
    hash. A shard takes at most its share of the rows (times 1 + slack): keys find room in their own shard first, in ring
    order, and those that overflow a full shard continue clockwise to the next one with room. Without slack the counts
    of shards are at most one apart; with slack fewer keys overflow, and fewer move when a shard is added.

    The number of keys in each arc, one row an arc, decides what goes where (``plan``); rows find their rank within the arc by
    two-level prefix sums over ``ranges`` parts by another hash, of id and text. So no group grows with one id or text,
    and equal rows, however many, are one entry until slots are dealt.

    A null id is one key of its own; a null text has size 1 and the crc32 of an empty text; a text of any length is hashed
    whole; rows that repeat an id may part, those that are equal get different slots; an empty table gives an empty
    result; other columns are not read. Reruns give every distinct row the same shards and slots.
    """
    nodes = ring(n_shards, virtual_nodes)
    text = text_of(text_col)
    keyed = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *_keys(id_col, text_col, nodes))
    same = ["id", "size", "text_crc32", "arc", "lie"]
    entries = stored(keyed.groupBy(*same).agg(F.count("*").alias("n")).withColumn("tie", F.xxhash64("id", "size")), "keys")
    return _placed(entries, nodes, n_shards, ranges, slack).select("id", "size", "text_crc32", "shard", "slot")


def sharded_documents(docs: DataFrame, n_shards: int = SHARDS, virtual_nodes: int = VIRTUAL_NODES, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, shard, slot): whole rows of docs, in a struct, as ``shard_rows`` deals them; ready for ``write_shards``."""
    nodes = ring(n_shards, virtual_nodes)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(row.alias("row"), *_keys(id_col, text_col, nodes)).withColumn("tie", F.xxhash64("row"))
    entries = stored(keyed.groupBy("arc", "lie", "tie").agg(F.count("*").alias("n")), "keys")
    placed = _placed(entries, nodes, n_shards, RANGES, slack).select(F.col("lie").alias("_lie"), F.col("tie").alias("_tie"), "shard", "slot")
    one = keyed.groupBy("lie", "tie").agg(F.any_value("row").alias("row"))
    return one.join(placed, (F.col("lie") == F.col("_lie")) & (F.col("tie") == F.col("_tie"))).select("row", "shard", "slot")


def write_shards(docs: DataFrame, path: str, parts: int = 16, **how) -> None:
    """Slots and whole rows, in a struct ``row``, as Parquet, a folder ``shard=k`` each: ``parts`` runs of slots a shard, each in
    order, so a shard is no one task's work."""
    dealt = sharded_documents(docs, **how)
    share = F.broadcast(dealt.groupBy(F.col("shard").alias("of")).agg(F.count("*").alias("rows")))  # a row a shard
    dealt = dealt.join(share, F.col("shard") == F.col("of")).withColumn("part", F.floor(F.col("slot") * parts / F.col("rows")).cast("int"))
    dealt = dealt.repartition("shard", "part").sortWithinPartitions("shard", "slot")
    dealt.select("shard", "slot", "row").write.partitionBy("shard").parquet(path)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return dealt.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: Key by key: each one that its own shard has no room for looks clockwise for the first node whose shard has.
OP13_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b) ORDER BY b) AS tab FROM range(256) r(b)),
d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, coalesce(CAST(doc_id AS VARCHAR), '') AS k, md5(coalesce(text, '')) AS t,
             list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
c AS (SELECT doc_id, size, CAST('0x' || md5(k)[1:8] AS BIGINT) AS point, md5(k || ':' || t) AS lie,
             xor(list_reduce(bytes, lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM d, tab),
v AS (SELECT s.s, CAST('0x' || md5(s.s || ':' || k.k)[1:8] AS BIGINT) AS point FROM range(8) s(s), range(128) k(k)),
nodes AS (SELECT list(s ORDER BY point, s) AS owner, list(point ORDER BY point, s) AS points FROM v),
arcs AS (SELECT c.*, (list_count(list_filter(points, lambda x: x < c.point)) % 1024) AS arc, owner FROM c, nodes),
room AS (SELECT list(n // 8 + CASE WHEN s < n % 8 THEN 1 ELSE 0 END ORDER BY s) AS cap FROM (SELECT count(*) AS n FROM c) x, range(8) s(s)),
home AS (SELECT a.*, owner[arc + 1] AS own, row_number() OVER (PARTITION BY owner[arc + 1] ORDER BY arc, lie, doc_id, size) AS place,
                row_number() OVER (ORDER BY arc, lie, doc_id, size) AS nr FROM arcs a),
split AS (SELECT h.*, place <= cap[own + 1] AS fits FROM home h, room),
late AS (SELECT nr, arc, row_number() OVER (ORDER BY nr) AS step FROM split WHERE NOT fits),
load AS (SELECT list(coalesce(n, 0) ORDER BY s) AS load FROM range(8) s(s) LEFT JOIN (SELECT own, count(*) AS n FROM split WHERE fits GROUP BY own) f ON f.own = s.s),
walk AS (
  SELECT CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS nr, CAST(NULL AS BIGINT) AS shard, load FROM load
  UNION ALL
  SELECT step, nr, shard, list_transform(load, lambda x, i: x + CASE WHEN i = shard + 1 THEN 1 ELSE 0 END)
  FROM (SELECT l.step, l.nr, w.load, owner[list_filter(range(1, 1024), lambda j: w.load[owner[(l.arc + j) % 1024 + 1] + 1] < cap[owner[(l.arc + j) % 1024 + 1] + 1])[1] + l.arc
                 - CASE WHEN list_filter(range(1, 1024), lambda j: w.load[owner[(l.arc + j) % 1024 + 1] + 1] < cap[owner[(l.arc + j) % 1024 + 1] + 1])[1] + l.arc >= 1024 THEN 1024 ELSE 0 END + 1] AS shard
        FROM walk w JOIN late l ON l.step = w.step + 1, nodes, room) u),
final AS (SELECT s.*, CAST(CASE WHEN fits THEN own ELSE w.shard END AS INTEGER) AS shard FROM split s LEFT JOIN walk w ON w.nr = s.nr AND w.step > 0)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY nr) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM final
"""
