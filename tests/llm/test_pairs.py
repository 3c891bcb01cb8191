"""SimHash (op5), near-duplicate removal, components and decontamination (op2) against brute force."""

import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.edges import DATA, docs, empty
from tidemark.llm import decontam, queries
from tidemark.llm.components import connected_components
from tidemark.llm.decontam import MASKS, contaminated, decontaminate
from tidemark.llm.simhash import _SHORT, _apart, _folded, _forest, _parity, _unlike, block_masks, drop_near_duplicates, links, near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, width):
    words = (text or "").translate(LOWER).encode().split()
    runs = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def test_op5_equals_brute_force(spark):
    table = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    fps = [fingerprint(t, 4) for _, t in table]
    root = groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    want = {(table[i][0], f"{fps[i]:016x}", table[root[i]][0]) for i in range(len(fps))}
    assert {tuple(r) for r in queries.op5_simhash(spark, DATA).collect()} == want


def test_links_in_large_blocks_lose_nothing(spark):
    rng = random.Random(2)
    base = rng.getrandbits(63)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 3))) for _ in range(400)} | {rng.getrandbits(63) for _ in range(100)})
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = groups(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    for options in ({}, {"pairs_up_to": 4, "chunk": 50}):
        at = {x: i for i, x in enumerate(fps)}
        pairs = [(at[r.u], at[r.v]) for r in links(frame, 4, **options).collect()]
        assert all((fps[a] ^ fps[b]).bit_count() <= 4 for a, b in pairs)
        assert groups(len(fps), pairs) == want
    assert len(block_masks(6, 4)) == 15 and _forest(4)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (201, 202), (202, 201)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {201: 201, 202: 201}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingle_set(text):
    words = (text or "").translate(LOWER).encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def test_near_duplicate_removal_equals_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"v{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(120)]
        texts.append(base)
        for _ in range(rng.randint(0, 4)):
            near = list(base)
            at = rng.randrange(len(near) - 5)
            near[at : at + rng.randint(0, 5)] = [rng.choice(vocab)] * rng.randint(0, 3)
            texts.append(near)
    texts = [" ".join(t) for t in texts]
    sets = [shingle_set(t) for t in texts]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    root = groups(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk in (2048, 3):
        kept = {r.doc_id for r in drop_near_duplicates(frame, chunk=chunk).collect()}
        assert set(root) <= kept and len(kept - set(root)) <= 0.05 * (len(texts) - len(set(root)))  # none wrongly gone; fingerprints miss few


def test_near_duplicates_by_appended_cut_and_replaced_blocks(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"u{rng.getrandbits(40)}" for _ in range(n)]
    line = fresh(30)  # one passage that all texts have
    texts = []
    for k in range(60):
        base = fresh(150) + line
        block = rng.randrange(100)
        edited = [base + fresh(40), base[: len(base) - 32], base[:block] + fresh(15) + base[block + 15 :]][k % 3]
        texts += [base, edited]
    texts = [" ".join(t) for t in texts]
    sets = [shingle_set(t) for t in texts]
    root = groups(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    assert len(set(root)) == 60
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in drop_near_duplicates(frame).collect()} == set(root)


def test_pairs_across_groups_in_chunks(spark):
    from tidemark.llm.simhash import _remaining

    rng = random.Random(12)
    texts = []
    for _ in range(30):
        base = [f"u{rng.getrandbits(40)}" for _ in range(60)]
        texts += [base, base + [f"u{rng.getrandbits(40)}" for _ in range(10)], base[:52], base[5:]]
    rows = [(i, i, i, " ".join(t).encode()) for i, t in enumerate(texts)]
    sets = [shingle_set(t) for t in (r[3].decode() for r in rows)]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    frame = spark.createDataFrame(rows, "row long, node long, group long, text binary")
    for options in ({}, {"pairs_up_to": 1, "chunk": 2}):
        assert {(r.u, r.v) for r in _remaining(frame, frame.drop("text"), width=5, similarity=0.8, **options).collect()} == want
    assert len(want) > 60


def test_parity_maps_are_bounds():
    rng = np.random.default_rng(5)
    told = 0
    for _ in range(2000):
        n, extra = int(rng.integers(1, 900)), int(rng.integers(0, 300))
        pool = rng.integers(-(1 << 63), (1 << 63) - 1, n + extra)
        u, v = np.unique(pool[:n]), np.unique(pool[rng.random(n + extra) < rng.random()])
        apart = len(np.setxor1d(u, v))
        x, y = _parity(u), _parity(v)
        assert _apart(x.tobytes(), y.tobytes()) <= apart
        short = np.bitwise_count(_folded(x, _SHORT // 8) ^ _folded(y, _SHORT // 8)).sum()
        assert short <= apart
        similar = len(np.intersect1d(u, v)) >= 0.8 * len(np.union1d(u, v))
        possible = _apart(x.tobytes(), y.tobytes()) <= _unlike(0.8) * (len(u) + len(v)) + 1e-6
        assert possible or not similar
        told += possible == similar
    assert told > 1900


def test_edges_of_near_duplicates(spark):
    d = docs(spark)
    found = near_duplicates(d)
    assert found.count() == d.count()
    by_id = {r.doc_id: r for r in found.collect()}
    assert by_id[1].fingerprint == "0" * 16 and {by_id[i].component_id for i in (1, 2, 3)} == {1} and by_id[7].component_id == 6
    kept = drop_near_duplicates(d)
    assert kept.columns == d.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 8, 9, 10, 12] and ids.count(None) == 0
    assert near_duplicates(empty(spark)).count() == 0 and drop_near_duplicates(empty(spark)).count() == 0


def test_op2_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = sorted(con.execute(f"SELECT doc_id, item_id, matched, \"window\" FROM ({queries.OP2_SQL})").fetchall())
    assert sorted(tuple(r) for r in queries.op2_decontamination(spark, DATA).collect()) == want and want


def test_masks_survive_a_fifth_of_substitutions():
    from itertools import combinations
    from math import ceil

    for n in range(8, 21):
        places = [{s + o for o, c in enumerate(m) if c == "1"} for m, least, most in MASKS if least <= n and (most is None or n <= most) for s in range(n - len(m) + 1)]
        assert all(any(p.isdisjoint(gone) for p in places) for gone in combinations(range(n), n - ceil(0.8 * n))), n


def naive_contamination(texts, bench):
    """Every alignment and every window, token by token: the whole item, or 20 tokens, at 0.8; under 8 tokens all."""
    out = set()
    for i, t in texts:
        w = (t or "").translate(LOWER).split()
        for k, b in bench:
            b = (b or "").translate(LOWER).split()
            n = min(20, len(b))
            best = 0
            for d in range(-len(b), len(w) + 1):
                same = [0 <= d + j < len(w) and w[d + j] == b[j] for j in range(len(b))]
                best = max([best, *(sum(same[s : s + n]) for s in range(len(b) - n + 1))])
            if n >= 5 and best >= (n if n < 8 else -(-4 * n // 5)):
                out.add((i, k, best, n))
    return out


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_decontamination_equals_every_window(spark, limit):
    rng = random.Random(21)
    word = lambda: f"u{rng.getrandbits(40)}"
    bench = [(k, " ".join(word() for _ in range(3 + k % 38))) for k in range(40)]
    probe = [word() for _ in range(40)]
    bench.append((900, " ".join(probe)))
    texts = [(900, " ".join(w if i in (0, 1, 2, 3, 7) or 12 <= i < 32 and i not in (16, 20, 23, 24) else word() for i, w in enumerate(probe)))]
    for k, t in bench:
        for share in (0.15, 0.2, 0.25):
            w = t.split()
            for i in rng.sample(range(len(w)), int(share * len(w))):
                w[i] = word()
            texts.append((len(texts), " ".join([word() for _ in range(rng.randrange(4))] + w + [word() for _ in range(rng.randrange(4))])))
    texts += [(5000, bench[4][1]), (5001, bench[4][1] + " and more"), (5002, None)]
    docs_, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    found = {(r.doc_id, r.item_id, r.matched, r.window) for r in contaminated(docs_, items, broadcast_bytes=limit).collect()}
    assert found == naive_contamination(texts, bench) and (900, 900, 16, 20) in found and {(5000, 4, 7, 7), (5001, 4, 7, 7)} <= found


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_decontamination_of_planted_passages(spark, limit):
    item = [f"b{i}" for i in range(30)]
    swap = lambda k, n: [w if i % k else f"s{i}" for i, w in enumerate(item[:n])]
    texts = {1: item, 2: swap(5, 20), 3: swap(2, 30), 4: ["x"] * 40, 5: ["pre"] * 7 + [w.upper() for w in item[3:23]] + ["post"] * 9, 6: item[:15]}
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()] + [(7, None), (8, ""), (1, " ".join(item))], "doc_id long, text string").withColumn("row", F.lit(1))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "b1 b2 b3"), (3, None), (1, " ".join(item))], "item_id long, text string")
    found = contaminated(frame, bench, broadcast_bytes=limit)
    assert {(r.doc_id, r.item_id): r.matched for r in found.collect()} == {(1, 1): 20, (2, 1): 16, (5, 1): 20}
    left = decontaminate(frame, bench, broadcast_bytes=limit)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 6, 7, 8] and left.columns == frame.columns
    assert contaminated(empty(spark), bench).count() == 0 and decontaminate(frame, bench.limit(0)).count() == frame.count()
    assert decontaminate(docs(spark), bench).count() == docs(spark).count()


def test_decontamination_is_the_same_with_a_large_benchmark(spark):
    rng = random.Random(13)
    word = lambda: f"u{rng.getrandbits(40)}"
    masked = lambda item, keep: [w if k else word() for w, k in zip(item, keep, strict=True)]
    bench, texts = [], []
    for k in range(120):
        n = 24 if k == 0 else rng.randint(20, 70)
        item = [word() for _ in range(n)]
        keep = [c == "1" for c in "101011111111101100111111"] if k == 0 else [rng.random() < 0.78 for _ in range(n)]
        bench.append((k, " ".join(item)))
        texts.append((k, " ".join([word() for _ in range(rng.randrange(5))] + masked(item, keep) + [word()])))
    docs_, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    small, large = (sorted((r.doc_id, r.item_id, r.matched, r.window) for r in contaminated(docs_, items, broadcast_bytes=b).collect()) for b in (64 << 20, 0))
    assert small == large and (0, 0, 17, 20) in small


@pytest.mark.parametrize("limit", [64 << 20, 30_000, 0])
def test_copies_of_an_item_are_seeded_once(spark, limit, monkeypatch):
    rng = random.Random(5)
    word = lambda: f"u{rng.getrandbits(40)}"
    plain = [(k, " ".join(word() for _ in range(5 + 3 * k))) for k in range(9)]
    bench = [(k + 100 * c, t.upper() if c % 2 else t) for c in range(30) for k, t in plain] + [(None, plain[8][1]), (3, plain[7][1])]
    texts = [(k, f"{word()} {t} {word()}") for k, t in plain] + [(50, word()), (51, None)]
    docs_, items = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    seeded, seeds = [], decontam._seeds
    monkeypatch.setattr(decontam, "_seeds", lambda rows, masks, of_items=False: seeded.append(rows.count()) or seeds(rows, masks, of_items) if of_items else seeds(rows, masks))
    out = contaminated(docs_, items, broadcast_bytes=limit)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert seeded == [9] and (limit > 0) == ("LeftSemi" in plan or "strategy=broadcast" in plan) and (limit == 30_000) == ("LeftSemi" in plan)
    assert {(r.doc_id, r.item_id, r.matched, r.window) for r in out.collect()} == naive_contamination(texts, bench)
