import random

import numpy as np
import pytest

from notemill.operators import ranks, records, references as ref


def spread(lengths, k):
    """Positions of the notes nearest to k even quantiles of length, one after another, none twice."""
    chosen = []
    for q in np.arange(k) / max(1, k - 1):
        far = np.abs(lengths - np.quantile(lengths, q))
        chosen.append(next(i for i in np.argsort(far, kind="stable") if i not in chosen))
    return chosen


def pool_of(seed):
    rng = random.Random(seed)
    sizes = {"a": 1, "b": 3, "c": 5, "d": 6, "e": 40, "f": 200}
    return [(p, f"r{k:03d}", "x" * rng.choice((1, 2, 3, 5, 8, 40, rng.randrange(1, 90)))) for p, n in sizes.items() for k in rng.sample(range(300), n)]


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5, 7])
def test_nearest_picks_equal_the_choice_over_all_notes(spark, k):
    rows = pool_of(k)
    df = spark.createDataFrame(rows, "professor string, record_id string, output string").repartition(5)
    want = []
    for p in sorted({r[0] for r in rows}):
        own = sorted((r[1], len(r[2])) for r in rows if r[0] == p)
        at = spread(np.array([n for _, n in own]), k) if len(own) > k else range(len(own))
        want += [(p, own[i][0], pick) for pick, i in enumerate(at, 1)]
    assert sorted(map(tuple, ref.selected(df, k).collect())) == sorted(want)
    assert ref.selected(df.where("false"), k).count() == 0


@pytest.mark.parametrize("n", [1, 3, 5, 6, 250])
def test_drawn_rows_are_those_of_the_generator(spark, n):
    rows = pool_of(n)
    df = spark.createDataFrame(rows + rows[:9], "professor string, record_id string, output string").repartition(3)
    keys, drawn = {}, {}
    for p, r, _ in rows:
        keys.setdefault(p, []).append(r)
    for p, own in keys.items():
        drawn[p] = sorted(own) if len(own) <= n else sorted(random.Random(f"7:{p}").sample(sorted(own), n))
    got = records.seeded_sample(df, "professor", "record_id", n, 7)
    assert sorted(map(tuple, got.collect())) == sorted((p, r) for p, own in drawn.items() for r in own)
    picked = ref.selected(spark.createDataFrame(rows, df.schema), n, "random", 7)
    assert sorted(map(tuple, picked.collect())) == sorted((p, r, k) for p, own in drawn.items() for k, r in enumerate(own, 1))


def test_a_group_of_many_rows_stays_in_many_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(40_000).selectExpr("'p' as professor", "lpad(cast(id as string), 6, '0') as record_id")
    parted = ranks.in_parts(df, "professor", "record_id")
    sizes = ranks.sizes_of(parted, "professor").collect()
    assert len(sizes) > 1 and max(r.n for r in sizes) < 30_000 and sum(r.n for r in sizes) == 40_000
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = sorted(r.record_id for r in records.seeded_sample(df, "professor", "record_id", 4, 1).collect())
    assert got == [f"{k:06d}" for k in sorted(random.Random("1:p").sample(range(40_000), 4))]


def test_repeated_rows_and_nulls(spark):
    df = spark.createDataFrame([("p", "a", "xx")] * 6 + [("p", None, "x"), ("q", None, None)], "professor string, record_id string, output string")
    assert ref.selected(df, 3).where("professor = 'p'").count() == 3
    assert records.seeded_sample(df, "professor", "record_id", 2, 1).count() == 3 and records.seeded_sample(df.where("false"), "professor", "record_id", 2, 1).count() == 0
