"""Suffix trees (op7) and sparse suffix arrays (op8) against all windows in a set."""

import hashlib
import random

import numpy as np

from tests.llm.edges import DATA, docs, empty
from tidemark.llm import queries
from tidemark.llm.sparse import find_repeats, ranks
from tidemark.llm.subtree import count_prefixes, deep_nodes, hashed, remove_repeats
from tidemark.llm.suffixes import Chunk, exact_numbers, later_copies, later_windows, minimisers, pack_runs, unpack_runs


def brute(table, length):
    """Words covered by a window that occurs earlier, by document; a null id comes first."""
    seen, out = {}, []
    order = sorted(range(len(table)), key=lambda k: (table[k][0] is not None, table[k][0] or 0))
    for k in order:
        i, text = table[k]
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            place = (i is not None, i or 0, s)
            if seen.setdefault(tuple(words[s : s + length]), place) < place:
                gone[s : s + length] = [True] * length
        out.append((i, words, gone))
    return out


def digest(words, gone):
    return len(words), sum(gone), hashlib.sha256(b" ".join(w for w, g in zip(words, gone, strict=True) if not g)).hexdigest()


def random_table(n=120):
    rng = random.Random(9)
    passages = [[f"p{k}.{i}" for i in range(rng.randint(10, 70))] for k in range(12)]
    table = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages) if rng.random() < 0.5 else [rng.choice("abcd") for _ in range(rng.randint(1, 60))]
        table.append((i, rng.choice([" ", "\n", " \t "]).join(words)))
    return table


def test_op7_equals_brute_force(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = {(i, *digest(w, g)) for i, w, g in brute(table, 20)}
    assert {tuple(r) for r in queries.op7_substring_dedup(spark, DATA).collect()} == want


def test_op7_with_many_small_groups(spark):
    table = random_table()
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    want = {(i, *digest(w, g)) for i, w, g in brute(table, 20)}
    for options in ({}, {"group_words": 300, "chunk_words": 200}):
        assert {tuple(r) for r in remove_repeats(frame, length=20, digest=True, **options).collect()} == want


def test_op7_keeps_rows_and_untouched_texts(spark):
    d = docs(spark)
    out = remove_repeats(d, length=50)
    assert out.columns == [c for c in d.columns if c != "n_words"] + ["n_words", "n_removed"] and out.count() == d.count()
    by_id = {}
    for r in out.collect():
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[1][0].text is None and by_id[3][0].text == " \t\n\x0b\x0c\r" and by_id[5][0].n_words == 30_000
    assert by_id[10][0].text == "tail" and by_id[11][0].text == "head" and len(by_id[7]) == 2
    assert remove_repeats(empty(spark)).count() == 0


def spans(frame):
    got = {}
    for r in frame.collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    return got


def test_op8_equals_brute_force(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    want = {i: {k for k, x in enumerate(g) if x} for i, _, g in brute(table, 50) if any(g)}
    assert spans(queries.op8_sparse_suffix_dedup(spark, DATA)) == want and want


def test_op8_with_frequent_anchors_and_small_groups(spark):
    table = random_table()
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    want = {i: {k for k, x in enumerate(g) if x} for i, _, g in brute(table, 50) if any(g)}
    for options in ({}, {"frequent": 1, "group_words": 200, "chunk_words": 300}):
        assert spans(find_repeats(frame, length=50, **options)) == want


def test_op8_edges(spark):
    found = find_repeats(docs(spark))
    assert {tuple(r) for r in found.collect()} == {(10, 0, 60), (11, 1, 60)}
    assert find_repeats(empty(spark)).count() == 0


def weak(monkeypatch):
    """Hash codes of three bits: hundreds of words collide."""
    from tidemark.llm.suffixes import Chunk

    strong = Chunk._hash
    monkeypatch.setattr(Chunk, "_hash", staticmethod(lambda raw, starts, sizes: (strong(raw, starts, sizes) & np.uint64(7)) + np.uint64(1)))


def test_equal_hashes_of_different_words_remove_nothing(monkeypatch):
    """Chunks, runs and both ways to tell windows apart, with words whose hashes collide."""
    weak(monkeypatch)
    table = [(i, t) for i, t in random_table(60)]
    want = {(i, s) for i, words, _ in brute(table, 20) for s in range(len(words) - 19)}
    c = Chunk(np.array([i for i, _ in table]), np.arange(len(table)), [t.encode() for _, t in table])
    words, doc = c.word_list(), c.doc_of()
    numbers = exact_numbers(words, np.ones(c.words, bool))
    idx, at, _ = minimisers(c, 20, 5)
    assert {(int(c.ids[doc[i]]), int(i - c.first[doc[i]])) for i in idx} == want and ((at >= idx) & (at <= idx + 15)).all()
    seen, later = {}, set()
    for i in idx:
        key = tuple(c.texts[doc[i]].split()[i - c.first[doc[i]] :][:20])
        if seen.setdefault(key, i) != i:
            later.add(int(i))
    for judge in (deep_nodes, ranks):
        assert set(idx[later_copies(judge(numbers, idx, 20), c.ids[doc[idx]], idx - c.first[doc[idx]])].tolist()) == later and later
    ids, rows, starts, words, codes, places = unpack_runs([pack_runs(c, words, idx[k::2], np.zeros(len(idx[k::2]), bool), 20) for k in (0, 1)], 20)
    for judge in (deep_nodes, ranks):
        found = later_windows(words, codes, places, ids, starts, 20, judge)
        assert sorted(zip(ids[found].tolist(), starts[found].tolist(), strict=True)) == sorted((int(c.ids[doc[i]]), int(i - c.first[doc[i]])) for i in later)
    assert (rows == ids).all()


def test_op7_frequent_prefixes_are_lengthened(spark):
    """A beginning that all texts share, with varied ends, does not stay in one group."""
    rng = random.Random(6)
    head = [f"h{i}" for i in range(16)]
    table = [(i, " ".join(head + [rng.choice("abc") for _ in range(8)])) for i in range(400)]
    frame = spark.createDataFrame(table, "doc_id long, text string").repartition(6)
    want = {(i, *digest(w, g)) for i, w, g in brute(table, 20)}
    prefixes = count_prefixes(hashed(frame), 20, 5, group_words=100, chunk_words=300, least=4)
    assert len(prefixes.frequent) and prefixes.groups > 10
    assert {tuple(r) for r in remove_repeats(frame, length=20, digest=True, group_words=100, chunk_words=300).collect()} == want
