"""Budgeted calls against a serial loop."""

from random import Random

import pytest
from pyspark.sql import functions as F

from quire.operators import admission


def serial(calls, cap, already):
    spent, found = already, {}
    for i, cost in calls:
        found[i] = cost is not None and spent + cost <= cap
        spent += cost if found[i] else 0
    return found


@pytest.mark.parametrize("seed, most, cap, already", [(1, 10, 300, 0), (2, 1000, 20_000, 500), (3, 3, 5, 5), (4, 50, 10**9, 0), (5, 0, 0, 0), (6, 900, 1000, 990)])
def test_like_a_loop(spark, seed, most, cap, already):
    random = Random(seed)
    calls = [(i, random.choice([None, 0, most, most // 2, *[random.randint(0, most)] * 9])) for i in range(300)]
    frame = spark.createDataFrame(random.sample(calls, len(calls)), "i int, cost long")
    for ranges in (1, 7):
        got = {r.i: r.admitted for r in admission.admitted(frame, ["i"], cap, already, ranges).collect()}
        assert got == serial(calls, cap, already)


def test_nothing_and_costs(spark):
    none = spark.createDataFrame([], "i int, cost long")
    assert admission.admitted(none, ["i"], 10).collect() == []
    row = spark.range(1).select(admission.worst_case(F.lit(1000), F.lit(333), F.lit(3.0), F.lit(15.5)).alias("w")).first()
    assert row.w == 8162
    ledger = spark.createDataFrame([(0.0000015,), (2.0,)], "usd double")
    assert admission.spent(ledger) == 2_000_002 and admission.spent(ledger.limit(0)) == 0
