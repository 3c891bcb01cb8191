"""The coverage sweep against every pair of an instant and a version."""

import random
from datetime import date, datetime, timedelta

import pytest

from tidemark.operators import coverage as module
from tidemark.operators.coverage import Fenwick, covered

SCHEMA = "valid_from date, valid_to date, recorded_at timestamp_ntz, recorded_until timestamp_ntz"


def test_fenwick():
    rng, tree, plain = random.Random(1), Fenwick(37), [0] * 37
    for _ in range(500):
        at, delta = rng.randrange(37), rng.randrange(-3, 4)
        tree.add(at, delta)
        plain[at] += delta
        k = rng.randrange(37)
        assert tree.upto(k) == sum(plain[: k + 1])


@pytest.mark.parametrize(("span", "block", "held"), [(2_000, 4_000_000, 1_000_000), (3, 4_000_000, 5), (7, 40, 20)])
def test_sweep_equals_pairs(spark, monkeypatch, span, block, held):
    monkeypatch.setattr(module, "_RANGE", span)
    monkeypatch.setattr(module, "_HELD", held)
    rng = random.Random(span)
    day = lambda: date(2024, 1, 1) + timedelta(rng.randrange(25))
    moment = lambda: datetime(2024, 1, 1) + timedelta(hours=rng.randrange(60))
    maybe = lambda f, p: None if rng.random() < p else f()
    rows = [(maybe(day, 0.05), maybe(day, 0.4), maybe(moment, 0.05), maybe(moment, 0.4)) for _ in range(60)]
    asked = [(maybe(day, 0.03), maybe(moment, 0.03)) for _ in range(150)] + [(date(1999, 1, 1), datetime(1999, 1, 1)), (date(2050, 1, 1), datetime(2050, 1, 1))]
    live = lambda r, k: r[2] is not None and r[2] <= k and (r[3] is None or r[3] > k)
    holds = lambda r, v: r[0] is not None and r[0] <= v and (r[1] is None or r[1] > v)
    for table in (rows, rows[:2], []):
        want = sorted((v, k, any(live(r, k) for r in table), any(live(r, k) and holds(r, v) for r in table)) for v, k in {a for a in asked if None not in a})
        got = covered(spark.createDataFrame(table, SCHEMA).repartition(3), spark.createDataFrame(asked, "valid_at date, known_at timestamp_ntz"), block)
        assert sorted(map(tuple, got.collect())) == want
    assert covered(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([], "valid_at date, known_at timestamp_ntz")).count() == 0


def test_no_pairs_in_the_plan(spark):
    rows = spark.range(1000).selectExpr("date_add(date'2024-01-01', int(id % 90)) valid_from", "cast(null as date) valid_to", "timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,int(id)) recorded_at", "cast(null as timestamp_ntz) recorded_until")
    asked = spark.range(100_000).selectExpr("date_add(date'2024-01-01', int(id % 700)) valid_at", "timestamp_ntz'2023-12-01' + make_interval(0,0,0,0,0,int(id)) known_at")
    out = covered(rows, asked)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" not in plan
    assert out.count() == 100_000
