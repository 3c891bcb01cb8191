"""URL filters (op4), mixing (op6), nearest neighbours (op9) and the pipeline."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.edges import DATA, docs, empty
from tidemark.llm import queries
from tidemark.llm.ann import SmallWorld, nearest
from tidemark.llm.mixing import mix, range_digits, source_targets
from tidemark.llm.urlfilter import judge_urls


@pytest.mark.parametrize(("name", "table"), [("op4_url_filters", "pages"), ("op6_mixing", "documents")])
def test_query_equals_sql(spark, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DATA}/{table}.parquet')")
    got = queries.queries()[name](spark, DATA)
    found = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, found)) and found


URLS = {
    "http://a.net/": "block", "https://EXAMPLE.net/en/x?q": "allow", "https://example.net/EN/x": "block", "x://www.example.net/en/": "allow", "http://net": "allow",
    "http://example.com/de/1#f": "block", "http://example.com/de": "allow", "http://notexample.com/de/": "allow", "http://w3.org/fr/": "allow", "http://user.net:80/": "allow",
    "no scheme": "allow", "": "allow", None: "allow", "http://a.net?x=/": "allow", "a://b://c.net/": "allow",
}


@pytest.mark.parametrize("trie_rules", [1000, 0])
def test_url_rules(spark, trie_rules):
    rules = spark.createDataFrame([*queries.URL_RULES, ("net", "/", "allow"), ("deep.example.net", "/e", "block"), (None, None, "other")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    out = judge_urls(pages, rules, trie_rules=trie_rules)
    assert {r.url: r.verdict for r in out.collect()} == URLS
    assert {r.url: r.rule for r in out.collect()}["x://www.example.net/en/"] == "example.net/en/"
    assert judge_urls(pages.unionAll(pages), rules, trie_rules=trie_rules).count() == 2 * len(URLS)
    assert judge_urls(pages.limit(0), rules, trie_rules=trie_rules).count() == 0
    assert {r.verdict for r in judge_urls(pages, rules.limit(0), "block", trie_rules=trie_rules).collect()} == {"block"}


def test_targets_are_water_filled(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), (None, 900)], "source string, size long")
    got = {r.source: r.target for r in source_targets(sizes).collect()}
    assert got["a"] == 200 and got["b"] == pytest.approx(2800 / 3) and got[None] == 1800 or sum(got.values()) == pytest.approx(3000)


def test_mix_budgets(spark):
    d = docs(spark)
    rows = mix(d).collect()
    assert len(rows) == d.count()
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(t - target) <= 1 for t, target in by.values())
    assert sorted(map(str, rows)) == sorted(map(str, mix(d.repartition(7)).collect()))
    for digits in (1, 4):
        assert sorted(map(str, rows)) == sorted(map(str, mix(d, digits=digits).collect()))
    assert [range_digits(n, 100) for n in (0, 409_600, 409_601, 10**10)] == [3, 3, 4, 7]
    assert mix(empty(spark)).count() == 0


def test_op9_recall_and_order(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    got = {}
    for r in sorted(queries.op9_nearest_neighbours(spark, DATA).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r)
    hit = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        best = [ids[j] for j in np.lexsort((ids, d)) if ids[j] != q][:10]
        mine = got.pop(q)
        hit += len({r.vec_id for r in mine} & set(best))
        assert [r.rank for r in mine] == list(range(1, 11)) and [r.score for r in mine] == sorted(r.score for r in mine)
        assert all(r.score == pytest.approx(d[ids == r.vec_id][0], rel=1e-12) for r in mine)
    assert not got and hit >= 0.9 * 10 * (ids % 100 == 0).sum()


@pytest.mark.parametrize("kind", ["plain", "clustered"])
def test_op9_recall_over_many_shards(spark, kind):
    rng = np.random.default_rng(8)
    n, size = 4800, 24
    x = rng.normal(size=(n, size))
    if kind == "clustered":
        x = 3 * rng.normal(size=(40, size))[rng.integers(0, 40, n)] + 0.2 * x
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    rows = nearest(frame, frame.where("vec_id % 100 = 0"), k=10, shard_rows=600, block_rows=20).collect()
    assert len(rows) == 10 * n // 100
    best = {}
    for q in range(0, n, 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        best[q] = {int(i) for i in np.argsort(d, kind="stable") if i != q and d[i] <= np.sort(d)[10]}
    assert sum(r.vec_id in best[r.query_id] for r in rows) >= 0.9 * len(rows)


def test_op9_edges(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 2.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [None, 1.0]), (8, [inf, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (100, [0.0, 1.0]), (200, [0.0, 0.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    for options in ({}, {"shard_rows": 2, "block_rows": 1}):
        rows = nearest(frame, frame.where("vec_id % 100 = 0"), k=10, **options).collect()
        got = {q: [(r.vec_id, round(r.score, 6)) for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in rows}}
        far, near = round(5**0.5, 6), round(2**0.5, 6)
        assert got == {0: [(1, 0.0), (2, 0.0), (100, near), (3, far)], 100: [(3, 1.0), (0, near), (1, near), (2, near)]}
    copies = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(40)], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in nearest(copies, copies.where("vec_id = 5"), k=10).orderBy("rank").collect()] == [0, 1, 2, 3, 4, 6, 7, 8, 9, 10]
    assert nearest(frame.limit(0), frame).count() == 0 and nearest(frame, frame.limit(0)).count() == 0


def test_small_world_finds_clusters():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 16))[rng.integers(0, 30, 2000)] + rng.normal(scale=0.05, size=(2000, 16))
    graph = SmallWorld(x).flatten()
    hits = sum(len(set(graph.search(x[i], 64)[:10]) & set(np.argsort(((x - x[i]) ** 2).sum(axis=1))[:10])) for i in range(0, 2000, 40))
    assert hits >= 0.9 * 10 * 50


def test_pipeline_keeps_columns_and_takes_effect(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    table = docs(spark).unionByName(spark.read.parquet(f"{DATA}/documents.parquet"), allowMissingColumns=True)
    names = [n for n, _ in pipeline.STAGES]
    assert len(names) == 5
    sizes = [table.count()]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, table, DATA).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.columns == table.columns
        if k == 2:
            old = {r.doc_id: r.text for r in table.collect()}
            assert any(r.text != old[r.doc_id] and r.n_chars == len(r.text) for r in after.collect())
        table = after
        sizes.append(table.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4] == sizes[5]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        assert stage(spark, empty(spark), DATA).count() == 0, k


def test_pipeline_run(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    out = pipeline.run(spark, DATA)
    assert out.count() > 100 and {"doc_id", "text", "lang", "taken"} <= set(out.columns)
    assert out.where("text is not null and size > 0 and taken > 0").count() > 50


def test_scratch_spares_what_was_kept_before(spark):
    from tidemark.llm.common import kept, scratch

    before = kept(spark.range(3), "before")
    with scratch(spark):
        inside = kept(spark.range(5), "inside")
        assert inside.count() == 5
    assert spark.read.parquet(before.inputFiles()[0].rsplit("/", 1)[0]).count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound"):
        spark.read.parquet(inside.inputFiles()[0].rsplit("/", 1)[0]).count()


def test_scratch_spares_what_another_thread_keeps(spark):
    from threading import Thread

    from tidemark.llm.common import kept, scratch

    theirs = []
    with scratch(spark):
        other = Thread(target=lambda: theirs.append(kept(spark.range(4), "theirs")))
        other.start()
        other.join()
        with scratch(spark):
            kept(spark.range(2), "inner")
        mine = kept(spark.range(6), "mine")
        assert mine.count() == 6
    assert theirs[0].count() == 4


def test_columns_of_any_name_stay(spark):
    from tidemark.llm.langid import fit_languages, identify

    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([("http://a.net/", "f", "F", "b")], "url string, _found string, _found_ string, _best string")
    for trie_rules in (1000, 0):
        r = judge_urls(pages, rules, trie_rules=trie_rules).first()
        assert (r["_found"], r["_found_"], r["_best"], r["verdict"]) == ("f", "F", "b", "block")
    texts = spark.createDataFrame([(1, "ein kurzer Text", "de", "f")], "doc_id long, text string, lang string, _found string")
    assert identify(texts, fit_languages(texts)).first()["_found"] == "f"


def test_mix_with_whole_rows(spark):
    d = docs(spark)
    plain, wide = mix(d), mix(d, whole=True)
    assert set(wide.columns) == {*d.columns, "size", "source_size", "target", "taken"}
    cols = ["doc_id", "source", "size", "source_size", "target", "taken"]
    assert sorted(map(str, wide.select(cols).collect())) == sorted(map(str, plain.select(cols).collect()))
    assert sorted(str(r.text) for r in wide.collect()) == sorted(str(r.text) for r in d.collect())
