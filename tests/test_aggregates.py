"""Aggregates over vectors and hashes against plain ones."""

import numpy as np
import pytest

from tidemark.operators import retrieval, scoring

SCHEMA = "chunk_id long, section_key string, embedding array<double>"


def test_extremes_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(4)
    chunks = [(k, None if k % 17 == 0 else f"s{k % 5 * (k % 3)}", None if k % 19 == 0 else rng.normal(size=6).tolist()) for k in range(200)]
    chunks += [(900, "alone", rng.normal(size=6).tolist()), (901, "zero", [0.0] * 6), (902, "zero", [0.0] * 6)]
    asked = [(f"q{k}", f"s{k % 9}", rng.normal(size=6).tolist()) for k in range(60)] + [("a", "alone", rng.normal(size=6).tolist()), ("z", "zero", [1.0] * 6), ("n", None, [1.0] * 6), ("v", "s1", None)]
    df = spark.createDataFrame(chunks, SCHEMA).repartition(4)
    questions = spark.createDataFrame(asked, "question_id string, section_key string, embedding array<double>")
    cosine = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) if any(a) and any(b) else 0.0
    want = {}
    for q, s, v in asked:
        near = sorted((1 - round(1 - cosine(v, x), 6) for _, t, x in chunks if s is not None and v is not None and t == s and x is not None), reverse=True)
        if near:
            want[q] = (near[0], near[1] if len(near) > 1 else None, near[-1], len(near))
    for tile, block, resident in ((4_000_000, 4096, 1 << 28), (7, 11, 20 * 48)):
        monkeypatch.setattr(retrieval, "_TILE", tile)
        got = {r.question_id: r for r in retrieval.section_extremes(df, questions, block, resident).collect()}
        assert got.keys() == want.keys()
        for q, (best, second, worst, n) in want.items():
            assert (got[q].best, got[q].worst) == pytest.approx((best, worst), abs=2e-6) and got[q].versions == n
            assert got[q].second == (None if second is None else pytest.approx(second, abs=2e-6))
    assert retrieval.section_extremes(df.limit(0), questions).count() == 0 and retrieval.section_extremes(df, questions.limit(0)).count() == 0


def test_centroids_and_separation(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [3.0, 0.2]), (3, "b", [0.0, 2.0]), (4, None, [9.0, 9.0]), (5, "b", None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    c = retrieval.centroids_by_section(df)
    assert {r.section_key: [round(x, 9) for x in r.centroid] for r in c.collect()} == {"a": [2.0, 0.1], "b": [0.0, 2.0]}
    assert retrieval.centroids_by_section(df.limit(0)).count() == 0
    distances = lambda own, other: spark.createDataFrame([(own, other)], "own double, other double")
    assert scoring.separated(distances(0.4, 1.0)).first()["own"] == 0.4 and scoring.judged_separation(distances(0.5, 1.0)).first()["separates"]
    with pytest.raises(Exception, match="do not separate"):
        scoring.separated(distances(0.9, 1.0)).collect()


def test_chained_digest_equals_one_string(spark, monkeypatch):
    import hashlib
    import random

    monkeypatch.setattr(scoring, "_PIECE", 7)
    rng = random.Random(2)
    rows = [(rng.randrange(40), hashlib.sha256(str(k).encode()).hexdigest()) for k in range(500)] + [(3, "twin"), (3, "twin"), (4, None)]
    df = spark.createDataFrame(rows, "recorded_at int, content_hash string").repartition(5)
    want = hashlib.md5(",".join(h for _, h in sorted(r for r in rows if r[1])).encode()).hexdigest()[:12]
    assert [r.corpus_rev for r in scoring.corpus_revision(df).collect()] == [want]
    assert [r.corpus_rev for r in scoring.corpus_revision(df.limit(0)).collect()] == [""]
    plan = scoring.corpus_revision(df)._jdf.queryExecution().toString()
    assert "collect_list" not in plan
