"""The as-of sweep gives the rows of the join."""

import random
from datetime import date, datetime, timedelta

import pytest

from tidemark.operators.temporal import as_of_join
from tidemark.operators.versions import rebuild_versions


@pytest.mark.parametrize(("seed", "hot", "stamp"), [(1, 5, "timestamp"), (2, 20, "timestamp_ntz"), (3, 60, "timestamp_ntz")])
def test_sweep_equals_join(spark, seed, hot, stamp):
    rng = random.Random(seed)
    log = []
    for s in ("a", "b", "c"):
        for d in range(40):
            t, start = datetime(2025, 1, 1) + timedelta(hours=5 * d), date(2025, 1, 1) + timedelta(rng.randrange(60))
            log.append((s, "base" if d == 0 else rng.choice(["amendment"] * 5 + ["correction"]), t, f"{s}{d:03d}", 0, f"{s}/{d}", start, start + timedelta(20) if rng.random() < 0.2 else None))
    versions = rebuild_versions(spark.createDataFrame(log, f"section_key string, kind string, recorded_at {stamp}, document_id string, clause_no int, text string, valid_from date, valid_to date"))
    same_day = [("a", date(2025, 2, 1), datetime(2025, 1, 5), 7)] * 90  # one day alone exceeds a slab, equal facts too
    facts = same_day + [(rng.choice("aaabcd"), date(2025, 1, 1) + timedelta(rng.randrange(-5, 80)), datetime(2025, 1, 1) + timedelta(hours=rng.randrange(-9, 230)), k) for k in range(400)]
    facts += [(None, date(2025, 2, 1), datetime(2025, 1, 5), 1), ("a", None, datetime(2025, 1, 5), 2), ("a", date(2025, 2, 1), None, 3)]
    df = spark.createDataFrame(facts, f"section_key string, day date, known {stamp}, version_no int").repartition(3)
    rows = lambda hot: sorted(map(str, map(tuple, as_of_join(df, versions, "section_key", "day", "known", hot).collect())))
    want = rows(None)
    assert rows(hot) == want and len(want) > 200
    assert as_of_join(df.limit(0), versions, "section_key", "day", "known", hot).count() == 0
    assert as_of_join(df, versions.limit(0), "section_key", "day", "known", hot).count() == 0


def test_one_hot_key_is_split(spark):
    versions = spark.range(500).selectExpr("1L as k", "int(id) as no", "date_add(date'2024-01-01', int(id)) valid_from", "date_add(date'2024-01-01', int(id) + 1) valid_to", "timestamp_ntz'2024-01-01' recorded_at", "cast(null as timestamp_ntz) recorded_until")
    facts = spark.range(40_000).selectExpr("1L as k", "id", "date_add(date'2024-01-01', int(id % 500)) as day", "timestamp_ntz'2024-06-01' as known")
    out = as_of_join(facts, versions, "k", "day", "known", 2_000)
    assert out.where("no = datediff(day, date'2024-01-01')").count() == 40_000
    assert out.selectExpr("spark_partition_id() as p").distinct().count() >= 1
