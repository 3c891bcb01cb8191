"""Divergence of sources (op13) against SQL over the whole table and against a naive count."""

import random
import re
from collections import Counter

import duckdb
import pytest

from tests.conftest import DATA
from tests.llm.edges import docs, empty, rows
from tidemark.llm import queries
from tidemark.llm.divergence import TERM, source_divergence


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    got = queries.queries()["op13_source_divergence"](spark, DATA)
    found = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.OP13_SQL})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(found) and found


def naive(table, least, ranks=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(lang or "", source or "", re.findall(TERM, (text or "").translate(low))) for lang, source, text in table]
    out = []
    for lang in {f[0] for f in found}:
        held = Counter(t for la, _, ts in found if la == lang for t in set(ts))
        kept = [t for t, n in held.items() if n >= least]
        own = {s: Counter() for la, s, _ in found if la == lang}
        for la, s, ts in found:
            if la == lang:
                own[s].update(t for t in ts if held[t] >= least)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in own.items()}, share(sum(own.values(), Counter()))
        for s in own:
            pair = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            term = [(-gap(p[s][t], q[t]), t.encode(), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, each in (("pair", sorted(pair)), ("term", sorted(term)[:ranks])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(each)]
    return out


@pytest.mark.parametrize(("least", "shard_rows", "cells"), [(2, 400_000, 1_000_000), (3, 40, 7)])
def test_counts_of_mixed_texts(spark, least, shard_rows, cells):
    rng = random.Random(least)
    vocab = [*"abcdefgh", "Straße", "ünï", "Ünï", "中文", "😀x", "don't", "x_y", "ID42"]
    table = [(rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S3", "é", None]), " ".join(rng.choice(vocab) for _ in range(rng.randrange(12)))) for _ in range(120)]
    table += [("xx", "alone", "once"), ("yy", "a", None), ("yy", "b", ""), ("yy", None, "\x00 12 -"), ("en", "s1", "tie tie"), ("en", "s1", "tie tie")] + [("en", "s1", "copy of it")] * 5
    df = spark.createDataFrame([(*r, "p", 1, "i", 1) for r in table], "lang string, source string, text string, part string, shard int, item string, n int").repartition(5)
    got = source_divergence(df, least, cells=cells, shard_rows=shard_rows, chunk_bytes=500, partial_rows=30)
    assert sorted(map(tuple, got.collect())) == sorted(naive(table, least))


def test_edges(spark):
    got = source_divergence(docs(spark), 2)
    assert sorted(map(tuple, got.collect())) == sorted(naive([(r[2], r[3], r[1]) for r in rows()], 2))
    assert source_divergence(empty(spark)).count() == 0
