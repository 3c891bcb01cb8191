"""The exclusion sweep in slabs gives the rows of the sequential sweep, and of all pairs."""

import random
from collections import Counter
from datetime import date, datetime, timedelta

import pytest

from tidemark.operators.constraints import overlaps

SCHEMA = "section_key string, version_no int, valid_from date, valid_to date, recorded_at {0}, recorded_until {0}"


def greedy(rows):
    """Every row against all accepted ones."""
    out, accepted = Counter(), {}
    for r in sorted(rows, key=lambda r: (r[4], r[1], r[2] or date.min, (r[3] is not None, r[3]))):
        key, _, a, b, t, u = r
        b, u = b or date.max, u or datetime.max
        if a is None or a >= b or t >= u:
            continue
        if any(a < d and c < b and t < w and s < u for c, d, s, w in accepted.get(key, [])):
            out[key, r[1]] += 1
        else:
            accepted.setdefault(key, []).append((a, b, t, u))
    return out


@pytest.mark.parametrize(("seed", "hot", "long", "stamp"), [(1, 4, 0.1, "timestamp"), (2, 9, 0.5, "timestamp_ntz"), (3, 3, 0.9, "timestamp_ntz"), (4, 25, 0.3, "timestamp")])
def test_slabs_equal_pairs(spark, seed, hot, long, stamp):
    rng = random.Random(seed)
    rows = []
    for s in ["a", "b", None]:
        for k in range(70):
            start = date(2025, 1, 1) + timedelta(rng.randrange(60))
            at = datetime(2025, 1, 1) + timedelta(hours=rng.randrange(200))
            end = None if rng.random() < 0.1 else start + timedelta(rng.randrange(-1, 6))
            until = None if rng.random() < long else at + timedelta(hours=rng.randrange(0, 60))
            rows.append((s, k, None if rng.random() < 0.03 else start, end, at, until))
        rows += [rows[-1], rows[-1], rows[-5]]
    df = spark.createDataFrame(rows, SCHEMA.format(stamp)).repartition(3)
    want = greedy(rows)
    count = lambda out: Counter((r.section_key, r.version_no) for r in out.collect())
    assert want and count(overlaps(df, hot)) == want
    assert count(overlaps(df)) == want
    assert overlaps(df.limit(0), hot).count() == 0
    fine = df.where("section_key = 'a' and valid_from is not null").dropDuplicates(["recorded_at"]).withColumns({"valid_from": df["valid_from"] + df["version_no"] * 100, "valid_to": df["valid_from"] + df["version_no"] * 100 + 5})
    assert overlaps(fine, hot).count() == 0


def test_slabs_on_the_driver_are_bounded(spark, monkeypatch):
    from tidemark.operators import hotfold, hotoverlap

    rng = random.Random(7)
    row = lambda s, k: (s, k, date(2025, 1, 1) + timedelta(rng.randrange(60)), date(2025, 3, 1) + timedelta(rng.randrange(9)), datetime(2025, 1, 1) + timedelta(hours=k), None)
    rows = [row(f"s{s}", k) for s in range(60) for k in range(6)] + [row("giant", k) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA.format("timestamp"))
    cut, sweep = [], hotoverlap.overlaps_hot
    monkeypatch.setattr(hotfold, "SPANS", 8, raising=False)
    monkeypatch.setattr(hotoverlap, "overlaps_hot", lambda rows, counts, size: cut.append(sum(-(-n // size) for n in counts.values())) or sweep(rows, counts, size))
    count = lambda out: Counter((r.section_key, r.version_no) for r in out.collect())
    assert count(overlaps(df, 2)) == count(overlaps(df)) == greedy(rows)
    assert 1 < sum(cut) <= 2 * 8  # two rows a slab would make 330
