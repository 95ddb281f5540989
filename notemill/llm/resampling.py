"""Importance resampling to a target distribution: array-scored weights, sorted runs, tournament trees up to the exact draw count."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, stored, table, text_of

#: What separates words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Parameters of the query.
BUCKETS, PERCENT, MIN_WORDS, SEED = 10_000, 10, 20, 2024
#: Parameters: rows that one tournament merges, about; the most such ranges; blocks of runs and keys of each from which ranges are cut.
RANGE_ROWS, MOST_RANGES, SAMPLE_BLOCKS, KEYS = 1 << 16, 1 << 14, 1 << 14, 8

BLOCK = "score array<long>, absent array<boolean>, id array<long>, n_features array<long>, tie array<long>, weight array<long>"
COLUMNS = ["score", "absent", "id", "n_features", "tie", "weight"]


def words_of(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), BETWEEN), lambda w: w != "")


def features_of(words: Column, longest: int) -> Column:
    """All runs of 1 to longest words, joined by a space, repeats included."""
    if longest == 1:
        return words
    found, runs = [words], words
    for n in range(2, longest + 1):  # null past the last word
        runs = F.zip_with(runs, F.slice(words, n, F.greatest(F.size(words), F.lit(n))), lambda run, w: F.concat(run, F.lit(" "), w))
        runs = F.filter(runs, lambda run: run.isNotNull())
        found.append(runs)
    return F.concat(*found)


def bucket_of(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature) % buckets).cast("int")


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> list[int]:
    """How many features of all texts each bucket has; a row a bucket comes to the driver."""
    each = texts.select(F.explode(features_of(words_of(text_of(text_col)), longest)).alias("f"))
    counts = dict(each.groupBy(bucket_of(F.col("f"), buckets).alias("b")).agg(F.count("*").alias("n")).collect())
    return [counts.get(b, 0) for b in range(buckets)]


def gains(have: list[int], want: list[int]) -> list[int]:
    """What a feature of each bucket adds to a weight: 1000 times the log of target over source, each smoothed by one, floored."""
    source, target, buckets = sum(have), sum(want), len(have)
    return [math.floor(1000 * math.log((t + 1.0) * (source + buckets) / ((s + 1.0) * (target + buckets)))) for s, t in zip(have, want, strict=True)]


def scored(docs: DataFrame, gain: list[int], longest: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_words, n_features, weight, score): the sum of gains over a text's features, looked up in one array, plus Gumbel noise by id."""
    array = F.expr(f"array({', '.join(f'{g}L' for g in gain)})")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), words_of(text_of(text_col)).alias("words"))
    features = features_of(F.col("words"), longest)
    weight = F.aggregate(features, F.lit(0).cast("long"), lambda total, f: total + F.get(array, bucket_of(f, len(gain))))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = rows.select("id", F.size("words").cast("long").alias("n_words"), F.size(features).cast("long").alias("n_features"), weight.alias("weight"), noise.alias("noise"))
    return rows.select("id", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score"))


Key = tuple[int, bool, int, int, int]


class Block:
    """Columns of rows that lie in the order of their keys: higher scores first, then smaller ids, null ids last."""

    def __init__(self, columns: dict[str, list]):
        self.columns = columns

    def __len__(self) -> int:
        return len(self.columns["score"])

    def key(self, i: int) -> Key:
        c = self.columns
        return (-c["score"][i], c["absent"][i], c["id"][i], c["n_features"][i], c["tie"][i])

    def rows(self) -> Iterator[tuple[Key, int]]:
        """(key, weight) of each row."""
        c = self.columns
        return (((-s, *rest), w) for s, *rest, w in zip(*(c[name] for name in COLUMNS), strict=True))

    def slices(self, fences: list[Key]) -> Iterator[tuple[int, Block]]:
        """(range, part): range r holds the keys from fence r - 1 up to, but without, fence r."""
        i, n = 0, len(self)
        while i < n:
            r = bisect_right(fences, self.key(i))
            j = bisect_left(range(n), fences[r], i, n, key=self.key) if r < len(fences) else n
            yield r, Block({name: values[i:j] for name, values in self.columns.items()})
            i = j


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every batch of sorted rows as one row of arrays, under the number of its task's run."""
    from pyspark import TaskContext

    run = TaskContext.get().partitionId()
    for k, batch in enumerate(b for b in batches if b.num_rows):
        edges = pa.array([0, batch.num_rows], pa.int32())
        columns = [pa.ListArray.from_arrays(edges, batch.column(name)) for name in COLUMNS]
        yield pa.RecordBatch.from_arrays([pa.array([run], pa.int32()), pa.array([k], pa.int64()), *columns], names=["run", "block", *COLUMNS])


def fences_of(runs: DataFrame, n_rows: int) -> list[Key]:
    """Keys between which about RANGE_ROWS rows lie, from evenly spaced keys of at most SAMPLE_BLOCKS blocks. They decide how the
    work is dealt, never what comes out."""
    ranges = min(MOST_RANGES, -(-n_rows // RANGE_ROWS))
    if ranges < 2:
        return []
    some = runs.orderBy(F.xxhash64("run", "block"), "run", "block").limit(SAMPLE_BLOCKS)
    spot = F.transform(F.sequence(F.lit(0), F.lit(KEYS - 1)), lambda j: F.floor((j + 0.5) * F.size("score") / KEYS).cast("int"))
    spots = some.withColumn("at", F.explode(F.array_distinct(spot))).select(*[F.get(c, F.col("at")).alias(c) for c in COLUMNS[:-1]])
    keys = sorted((-r["score"], r["absent"], r["id"], r["n_features"], r["tie"]) for r in spots.collect())
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)})


def tournament(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """All items of sorted runs in order: a tree keeps the loser of every match, and only the path of the last winner is played again."""
    k, end = len(runs), (math.inf,)
    heads = [next(r, (end,)) for r in runs]
    losers = [-1] * k

    def play(player: int) -> int:
        node = (player + k) // 2
        while node:
            other = losers[node]
            if other < 0:  # the first to come waits for the other half
                losers[node] = player
                return -1
            if heads[other][0] < heads[player][0]:
                losers[node], player = player, other
            node //= 2
        return player

    winner = max([play(i) for i in range(k)], default=-1)
    while winner >= 0 and heads[winner][0] is not end:
        yield heads[winner]
        heads[winner] = next(runs[winner], (end,))
        winner = play(winner)


def merged(slices: Iterable[tuple[int, Block]], before: int, drawn: int) -> Iterator[tuple[Key, int, int | None]]:
    """(key, weight, rank) of a range's rows, from its slices (run, part) in the order of each run. Ranks start after ``before``;
    the merge stops at rank ``drawn`` and what is left has none."""
    runs: dict[int, list[Block]] = {}
    for run, part in slices:
        runs.setdefault(run, []).append(part)
    chained = [(row for part in parts for row in part.rows()) for parts in runs.values()]
    rank = before
    if rank < drawn:
        for key, weight in tournament(chained):
            rank += 1
            yield key, weight, rank
            if rank >= drawn:
                break
        else:
            return
        seen = rank - before
        whole = sum(len(p) for parts in runs.values() for p in parts)
        if seen == whole:
            return
        last = key
        for parts in runs.values():
            for part in parts:
                yield from ((k, w, None) for k, w in part.rows() if k > last)
    else:
        for parts in runs.values():
            for part in parts:
                yield from ((k, w, None) for k, w in part.rows())


OUT = pa.schema([("id", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64()), ("rank", pa.int64())])


def draw(rows: DataFrame, n_drawn: int) -> DataFrame:
    """(id, n_features, weight, score, rank) of rows with these columns and an eligible one; n_drawn of the eligible rows get ranks.

    Each task sorts its eligible rows and stores them as a run of blocks. Keys drawn from the runs cut the order into ranges, the
    blocks are cut at them, and counts tell the first rank of each range. Only ranges before the last draw are merged, each
    by a tournament of its runs, which stops at the draw count. A serial number is the last part of a key, so that rows
    which agree in all else can lie in several ranges.
    """
    absent = F.col("id").isNull()
    eligible = rows.where("eligible").select("score", absent.alias("absent"), F.coalesce("id", F.lit(0)).alias("id"), "n_features", F.monotonically_increasing_id().alias("tie"), "weight")
    order = [F.col("score").desc(), *(F.col(c).asc() for c in ("absent", "id", "n_features", "tie"))]
    runs = stored(eligible.sortWithinPartitions(*order).mapInArrow(blocks, f"run int, block long, {BLOCK}"), "runs")
    n_rows = runs.agg(F.sum(F.size("id"))).first()[0] or 0
    fences = rows.sparkSession.sparkContext.broadcast(fences_of(runs, n_rows))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                parts = list(Block({c: row[c] for c in COLUMNS}).slices(fences.value))
                columns = [[r for r, _ in parts], [row["run"]] * len(parts), [row["block"]] * len(parts), *([p.columns[c] for _, p in parts] for c in COLUMNS)]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds, strict=True)], names=["range", "run", "block", *COLUMNS])

    kinds = [pa.int32(), pa.int32(), pa.int64(), *(pa.list_(pa.bool_() if c == "absent" else pa.int64()) for c in COLUMNS)]
    slices = stored(runs.mapInArrow(cut, f"range int, run int, block long, {BLOCK}"), "slices")
    sizes = dict(slices.groupBy("range").agg(F.sum(F.size("id"))).collect())  # a row a range
    before, total = {}, 0
    for r in sorted(sizes):
        before[r] = total
        total += sizes[r]
    before = {r: n for r, n in before.items() if n < n_drawn}
    last = max(before, default=-1)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(r: int, parts: list[tuple[int, Block]]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            for (negative, gone, i, n, _), weight, rank in merged(parts, before[r], n_drawn):
                held.append((None if gone else i, n, weight, -negative, rank))
                if len(held) == 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], schema=OUT)
                    held.clear()
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], schema=OUT)

        now, parts = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["range"] != now and parts:
                    yield from out(now, parts)
                    parts = []
                now = row["range"]
                parts.append((row["run"], Block({c: row[c] for c in COLUMNS})))
        if parts:
            yield from out(now, parts)

    near = slices.where(F.col("range") <= last).repartition("range").sortWithinPartitions("range", "run", "block")
    drawn = near.mapInArrow(ranked, "id long, n_features long, weight long, score long, rank long")
    beyond = slices.where(F.col("range") > last).select(F.explode(F.arrays_zip("absent", "id", "n_features", "weight", "score")).alias("r"))
    none = F.lit(None).cast("long").alias("rank")
    beyond = beyond.select(F.when(~F.col("r.absent"), F.col("r.id")).alias("id"), "r.n_features", "r.weight", "r.score", none)
    out = ["id", "n_features", "weight", "score"]
    return drawn.unionByName(beyond).unionByName(rows.where("not eligible").select(*out, none))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_features, weight, score, rank), one row for each row of docs: percent of the documents with at least min_words
    words are drawn without replacement, likelier the more their hashed features look like those of target; rank counts the
    draws from 1 and is null for the others.

    Features are runs of 1 to ``longest`` words. Each of ``buckets`` buckets has a gain, known to the driver and sent as one array,
    by which a text is scored where it is read. Noise depends on seed and id alone, so the highest scores are a draw in
    proportion to the weights, and reruns agree.

    ids are integers. A null text has no words; a null id hashes as an empty text, takes part and comes after other ids of its score;
    rows that repeat an id are scored and drawn one by one; among equal scores the smaller id comes first, then fewer
    features. A text of any length is scored whole. Of an empty table nothing is drawn; an empty target gives every bucket
    the gain of its smoothed share. Other columns are not read.
    """
    gain = gains(bucket_counts(docs, text_col, longest, buckets), bucket_counts(target, text_col, longest, buckets))
    rows = scored(docs, gain, longest, seed, id_col, text_col).withColumn("eligible", F.col("n_words") >= min_words)
    rows = stored(rows, "scored")
    return draw(rows, rows.where("eligible").count() * percent // 100)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


OP11_SQL = r"""
WITH tab AS (
  SELECT list(list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b) ORDER BY b) AS tab FROM range(256) r(b)),
texts AS (SELECT doc_id, true AS own, text FROM documents UNION ALL SELECT NULL, false, text FROM benchmark),
w AS (SELECT doc_id, own, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
h AS (SELECT word, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
                                   lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
      FROM (SELECT DISTINCT word FROM w) u, tab),
b AS (SELECT bucket, count(*) FILTER (WHERE own) AS s, count(*) FILTER (WHERE NOT own) AS t FROM w JOIN h USING (word) GROUP BY bucket),
total AS (SELECT CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM b),
gain AS (SELECT bucket, CAST(floor(1000 * ln((b.t + 1.0::DOUBLE) * (total.s + 10000) / ((b.s + 1.0::DOUBLE) * (total.t + 10000)))) AS BIGINT) AS gain FROM b, total),
weighed AS (SELECT w.doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN h USING (word) JOIN gain USING (bucket) WHERE own GROUP BY w.doc_id),
d AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) AS h
      FROM documents LEFT JOIN weighed USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d),
ranked AS (SELECT *, row_number() OVER (ORDER BY n_features >= 20 DESC, score DESC, doc_id) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM ranked
"""
