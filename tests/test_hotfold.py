"""Sections folded by many tasks give the rows of the sequential fold."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import hotfold
from tidemark.operators.hotfold import Effects
from tidemark.operators.versions import rebuild_versions

LOG = "section_key string, kind string, recorded_at {}, document_id string, clause_no int, text string, valid_from date, valid_to date"


def log(rng, sections, clauses, corrections, drift):
    """Random logs; ``drift`` moves amended days forward with time, so that timelines grow long."""
    out = []
    for s in sections:
        for d in range(clauses):
            t = datetime(1969, 12, 28) + timedelta(hours=3 * d + rng.randrange(3))
            start = date(2025, 1, 1) + timedelta(days=rng.randrange(40) + int(drift * d))
            kind = "base" if d == 0 else "correction" if rng.random() < corrections else "amendment"
            doc = f"{s}-{d:06d}"
            if kind == "correction":
                out.append((s, kind, t, doc, 0, f"{d}a", start, start + timedelta(days=8)))
                out.append((s, kind, t, doc, 1, f"{d}b", start + timedelta(days=8 + rng.choice([0, 3])), rng.choice([None, start + timedelta(days=20)])))
            else:
                out.append((s, kind, t, doc, 0, f"{d}", start, rng.choice([None, start + timedelta(days=30)]) if kind == "base" else None))
    return out


def rows(df):
    return sorted(str(tuple(r)) for r in df.select("section_key", "version_no", "text", "valid_from", "valid_to", "recorded_at", "recorded_until", "document_id", "supersedes", "version_id").collect())


@pytest.mark.parametrize(("seed", "hot", "corrections", "drift", "stamp"), [(1, 3, 0.0, 0.0, "timestamp"), (2, 4, 0.05, 1.0, "timestamp_ntz"), (3, 7, 0.2, 0.3, "timestamp_ntz"), (4, 1, 0.02, 0.5, "timestamp"), (5, 30, 0.01, 2.0, "timestamp_ntz")])
def test_many_spans_equal_one_fold(spark, seed, hot, corrections, drift, stamp):
    rng = random.Random(seed)
    table = log(rng, [f"s{k}" for k in range(12)] + [None], 60, corrections, drift) + log(rng, ["cold"], 1, 0, 0)
    rng.shuffle(table)
    df = spark.createDataFrame(table, LOG.format(stamp)).repartition(3)
    assert rows(rebuild_versions(df, hot)) == rows(rebuild_versions(df))


def test_one_large_section_spans_tasks(spark):
    n = 60_000
    big = spark.range(n).selectExpr(
        "'s' section_key", "case when id = 0 then 'base' when id % 20011 = 9 then 'correction' else 'amendment' end kind", "timestamp_ntz'2025-01-01' + make_interval(0,0,0,0,0,int(id)) recorded_at", "lpad(cast(id as string), 8, '0') document_id",
        "0 clause_no", "concat('t', id) text", "date_add(date'2025-01-01', int(id / 40 + id * 7919 % 61)) valid_from", "cast(null as date) valid_to",
    )
    assert rows(rebuild_versions(big, 5_000)) == rows(rebuild_versions(big))


def test_closing_span_is_the_first_that_cuts_below():
    rng = np.random.default_rng(3)
    cut = rng.integers(0, 50, 37)
    e = Effects(cut, cut, cut)
    spans, ends = rng.integers(0, 37, 500), rng.integers(0, 55, 500)
    want = [next((j for j in range(s + 1, 37) if cut[j] < end), 37) for s, end in zip(spans, ends, strict=True)]
    assert e.closing(spans, ends).tolist() == want


def many_small(spark, sections, clauses):
    """``sections`` sections of ``clauses`` clauses each."""
    return spark.range(sections * clauses).selectExpr(
        f"cast(id % {sections} as string) section_key", f"case when id < {sections} then 'base' else 'amendment' end kind", "timestamp_ntz'2025-01-01' + make_interval(0,0,0,0,0,int(id)) recorded_at", "cast(id as string) document_id",
        "0 clause_no", "concat('t', id) text", "date_add(date'2025-01-01', int(id * 7919 % 61)) valid_from", "cast(null as date) valid_to",
    )


def test_spans_on_the_driver_are_bounded(spark, monkeypatch):
    cut = []
    fold = hotfold.fold_hot
    monkeypatch.setattr(hotfold, "SPANS", 50, raising=False)
    monkeypatch.setattr(hotfold, "fold_hot", lambda log, counts, clauses: cut.append(sum(-(-n // clauses) for n in counts.values())) or fold(log, counts, clauses))
    log = many_small(spark, 60, 6).unionByName(many_small(spark, 1, 300).withColumn("section_key", F.lit("giant")))
    assert rows(rebuild_versions(log, 1)) == rows(rebuild_versions(log))
    assert 1 < sum(cut) <= 2 * 50  # one clause a span would make 660


def test_large_sections_are_as_many_as_the_bound_allows(spark):
    log = many_small(spark, 40, 6).unionByName(many_small(spark, 1, 100).withColumn("section_key", F.lit(None).cast("string")))
    assert hotfold.large_sections(log, 5, 1_000) == ({None: 100, **{str(k): 6 for k in range(40)}}, 5)
    assert hotfold.large_sections(log, 5, 40) == ({None: 100}, 9)
    assert hotfold.large_sections(log, 500) == ({}, 500) and hotfold.large_sections(log.limit(0), 5) == ({}, 5)


def test_a_small_section_beside_a_large_one_has_few_cuts(spark):
    log = many_small(spark, 4, 10).unionByName(many_small(spark, 1, 300).withColumn("section_key", F.lit("giant"))).withColumn("t", hotfold.micros("recorded_at", "timestamp_ntz"))
    found = hotfold.cuts_between(log, "t", {"giant": 300, **{str(k): 10 for k in range(4)}}, 5)
    assert len(found["giant"]) == 59 and all(len(found[str(k)]) == 1 for k in range(4))
