"""The side-by-side ranking must give the rows of the single-task window."""

import random

import pytest
from ledgerlens.operators.ranking import next_value, rank_and_run
from pyspark.sql import functions as F


def groups(spark, values):
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "id long, v int").select("id", F.col("v").cast("decimal(18,6)"))


def both(df, ranges):
    plain = rank_and_run(df, "v", ["id"], "r", "run").orderBy("id").collect()
    spread = rank_and_run(df, "v", ["id"], "r", "run", ranges).orderBy("id").collect()
    return plain, spread


@pytest.mark.parametrize("seed", range(4))
def test_random_values_with_ties_and_nulls(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([None, *range(-20, 20)]) for _ in range(500)]
    plain, spread = both(groups(spark, values), 7)
    assert plain == spread


def test_one_value_fills_many_ranges(spark):
    # A third of all groups tie, so the tie spans several ranges.
    values = [0] * 200 + list(range(1, 201)) + list(range(-200, 0))
    plain, spread = both(groups(spark, values), 16)
    assert plain == spread
    assert {r.r for r in spread if r.v == 0} == {201}


def test_everything_ties_and_all_null(spark):
    for values in ([5] * 50, [None] * 50, [None] * 30 + [1] * 30):
        plain, spread = both(groups(spark, values), 8)
        assert plain == spread


def test_competition_rank_and_running_total(spark):
    rows = rank_and_run(groups(spark, [3, 1, 1, None, 2]), "v", ["id"], "r", "run").orderBy("id")
    assert [r.r for r in rows.collect()] == [4, 1, 1, 5, 3]
    assert [int(r.run) for r in rows.collect()] == [7, 1, 2, 7, 4]


def test_next_value(spark):
    values = groups(spark, random.Random(1).sample(range(1000), 300)).select("v")
    plain = next_value(values, "v", "n").orderBy("v").collect()
    assert plain == next_value(values, "v", "n", ranges=9).orderBy("v").collect()
    assert plain[-1].n is None
