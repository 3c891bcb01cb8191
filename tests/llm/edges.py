"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

DATA = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row long, h long, fp long, words string, node long, score string, rank int, at int,"
    " lang_pred string, rejected string, target string, key string, block string, n_words string, item_id string,"
    " _found string, _best string, _label string"
)


def rows():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(50)]
    long = " ".join(rng.choice(vocab) for _ in range(30_000))
    shared = " ".join(f"p{i}" for i in range(60))
    texts = [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "Short TEXT"), (None, "a row without id " + shared), (None, None), (5, long), (6, "one two three four five six seven"),
        (7, "one two three four five six seven"), (7, "one two three four five six seven"), (8, "ünïcödé\u00a0nbsp straße ΑΒΓ 中文"), (9, "x" * 100_000), (10, shared + " tail"), (11, "head " + shared),
        (12, "1234 5678 !!!"),
    ]
    out = []
    for k, (i, t) in enumerate(texts):
        out.append((i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", len(t or ""), 1, 1, 1, "w", 1, "s", 1, 1, "l", "r", "t", "k", "b", "n", "i", "f", "b", "l"))
    return out


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
