"""Vector codes (op12) against a plain search over all entries."""

import hashlib
import random

import duckdb
import numpy as np
import pytest

from tests.conftest import DATA
from tidemark.llm import queries
from tidemark.llm.codes import Codebook, compress_vectors, fit_codebooks


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{DATA}/embeddings.parquet')")
    got = queries.queries()["op12_vector_codes"](spark, DATA)
    found = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.OP12_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(found) and len(found) == 500


@pytest.mark.parametrize("spread", [1, 40, 100_000])
def test_annulus_holds_the_nearest(spread):
    rng = np.random.default_rng(spread)
    entries = rng.integers(-spread, spread + 1, (16, 3)) * rng.integers(1, 6, (16, 1))
    x = np.concatenate([rng.integers(-6 * spread, 6 * spread + 1, (4000, 3)), entries, np.zeros((1, 3), np.int64)])
    got, distance, looked = Codebook(entries).nearest(x)
    every = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (got == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert looked < every.size


def naive(rows, parts=8, entries=16, rounds=6):
    rows = [(i, lab, [int(np.floor(4096 * np.float64(np.float32(x)))) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not rows:
        return []
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(rows[0][2]) // parts
    cut = [[r[2][p * w : (p + 1) * w] for r in rows] for p in range(parts)]
    books = [c[:entries] for c in cut]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        chosen = [[near(p, x)[1] for x in cut[p]] for p in range(parts)]
        for p in range(parts):
            books[p] = [
                [sum(col) // len(own) for col in zip(*own, strict=True)] if (own := [x for x, k in zip(cut[p], chosen[p], strict=True) if k == e]) else c
                for e, c in enumerate(books[p])
            ]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found = [[near(p, cut[p][k]) for p in range(parts)] for k in range(len(rows))]
    error = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, lab, _), e in zip(rows, error, strict=True):
        by[lab] = by.get(lab, 0) + e
    return [(r[0], "".join(f"{e:02x}" for _, e in f), e, by[r[1]], sha) for r, f, e in zip(rows, found, error, strict=True)]


def test_edges(spark):
    rng = random.Random(5)
    vector = lambda: [rng.choice([-1.5, -0.25, 0.0, 0.3, 0.7]) for _ in range(16)]
    rows = [(k, k % 3 if k % 4 else None, vector()) for k in range(60)]
    same = vector()
    rows += [(100, 1, same), (100, 1, same), (None, None, vector()), (101, 2, None), (102, 2, [float("nan")] * 16), (103, None, [None] * 16), (104, 1, [float("inf")] * 16), (7, 0, vector())]
    schema = "vec_id long, label int, embedding array<float>, code string, error string, _label string, label_error int"
    df = spark.createDataFrame([(*r, "c", "e", "l", 1) for r in rows], schema).repartition(3)
    got = [tuple(r) for r in compress_vectors(df).drop("label").collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(naive(rows), key=key)
    assert sorted(map(str, compress_vectors(df.repartition(7)).drop("label").collect())) == sorted(map(str, compress_vectors(df).drop("label").collect()))
    few = [tuple(r) for r in compress_vectors(df.where("vec_id < 5")).drop("label").collect()]
    assert sorted(few, key=key) == sorted(naive([r for r in rows if r[0] is not None and r[0] < 5]), key=key)
    assert compress_vectors(df.limit(0)).count() == 0 and fit_codebooks(df.limit(0)) == []
    with pytest.raises(Exception, match="must stay below"):
        compress_vectors(spark.createDataFrame([(1, 1, [1e6] * 8)], "vec_id long, label int, embedding array<double>"))
