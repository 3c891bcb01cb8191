"""Toxicity (op1), language models (op3) and language ID (op10)."""

import math
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.edges import DATA, docs, empty
from tidemark.llm import lm, queries
from tidemark.llm.langid import fit_languages, identify
from tidemark.llm.lm import GatedLM, Lanes, Vocabulary, _sequences, count_words, fit_lm, fit_vocabulary, gradients, score_documents, train
from tidemark.llm.suffixes import Chunk
from tidemark.llm.toxicity import Lexicon, folded, learn_lexicon, score_toxicity

LARGER = "/root/testdata/sf0.1"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_op1_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    found = [r for r in queries.op1_toxicity(spark, LARGER).collect() if r.doc_id in labels]
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    right = sum(r.predicted == labels[r.doc_id] for r in held) / len(held)
    caught = [r.predicted for r in held if labels[r.doc_id] == 1]
    assert right > 0.97 and sum(caught) / len(caught) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)


def test_lexicon_folds_spares_and_normalises():
    lex = Lexicon({"idiot ": 2.0, "lowei": 1.0, "idio": 0.5}, ["harmless idiot box"])
    assert folded("1D10T іdіоt") == " idiot idiot "
    assert folded("id!ot! $hit ïdîöt") == " idiot shit idiot "
    assert folded("5 13 7, $5 !") == folded("") == "  "
    assert lex.hits("An 1D10T, an іdіоt!")[:2] == (pytest.approx(2 * (1 + math.log(2))), 2)
    assert lex.hits("loweiab loweicd flowei")[:2] == (pytest.approx(1 + math.log(2)), 2)
    assert lex.hits("loweiab idiot")[:2] == (3.0, 2)
    assert lex.hits("a harmless idiot box")[:2] == (0, 0)
    assert lex.score("idiot") > lex.score("idiot " + "fine words " * 300) > lex.score("")


def test_toxicity_edges(spark):
    d = docs(spark)
    lex = learn_lexicon(d, spark.createDataFrame([(1, 0), (None, 1), (4, None), (6, 3)], "doc_id long, toxic int"))
    out = score_toxicity(d, lex)
    assert out.count() == d.count() and {c for c in out.columns} == {*d.columns, "predicted"} and {r.predicted for r in out.collect()} == {0}
    assert score_toxicity(empty(spark), lex).count() == 0


def test_toxicity_calibration_does_not_depend_on_the_sample(spark):
    rows = [(i, "vile words" if i % 10 < (9 if i < 300 else 1) else "fine words", int(i < 300)) for i in range(3300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    scores = [learn_lexicon(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"), rows_per_label=n).score("vile words") for n in (6000, 300)]
    assert abs(scores[0] - scores[1]) < 0.15 and max(scores) < 0.65, scores


def toxic_frame(spark, copies=1, parts=3):
    """Toxic texts hold "vile"; so do clean ones that speak of the vile river."""
    rows = []
    for i in range(900):
        toxic = i % 3 == 0
        words = [f"w{(i * 7 + k) % 40}" for k in range(12)]
        if toxic or i % 3 == 1:
            words[5:5] = ["vile"] if toxic else ["vile", "river"]
        rows.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(rows * copies, "doc_id long, text string, toxic int").repartition(parts)


def test_toxicity_learns_exception_phrases(spark):
    frame = toxic_frame(spark)
    lex = learn_lexicon(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"), least_weight=0.5)
    assert any(p.startswith("vile") for p in lex.weights) and "vile river" in lex.exceptions
    assert lex.hits("the vile river")[1] == 0 and lex.hits("a vile deed")[1] == 1 and lex.score("a vile deed") > 0.5 > lex.score("the vile river")


def test_toxicity_fit_takes_repeats_and_any_batch_size(spark):
    once = toxic_frame(spark)
    fits = []
    for frame, batch in ((once, 10_000), (once, 7), (toxic_frame(spark, 40, 5), 10_000)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
        fits.append(learn_lexicon(frame.select("doc_id", "text"), once.select("doc_id", "toxic"), rows_per_label=300, least_weight=0.5))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    for f in fits[1:]:
        assert f.weights == fits[0].weights and f.exceptions == fits[0].exceptions and np.allclose(f.coef, fits[0].coef)


def naive_hits(lex, text):
    """Every pattern tried at every word, every phrase at every place."""
    line = folded(text)
    starts = [i for i, c in enumerate(line) if c == " "]
    spared = [(i, i + len(folded(p))) for p in lex.exceptions for i in range(len(line)) if line.startswith(folded(p), i)]
    out = Counter()
    for i in starts:
        fits = [p for p in lex.weights if line.startswith(" " + p, i)]
        if fits:
            p = max(fits, key=len)
            if not any(a <= i and i + 1 + len(p) <= b for a, b in spared):
                out[p] += 1
    return sum(lex.weights[p] * (1 + math.log(c)) for p, c in out.items()), sum(out.values()), len(line.split())


def test_automaton_equals_naive_matching(spark):
    import random

    frame = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    lex = learn_lexicon(frame, spark.read.parquet(f"{DATA}/labels.parquet"), least_docs=2, least_weight=0.3)
    rng = random.Random(3)
    texts = [r.text for r in frame.collect() if len(r.text or "") < 3000]
    words = sorted({w for t in texts if t for w in folded(t).split()})
    lex = Lexicon(lex.weights | {w[:3]: 0.5 for w in rng.sample(words, 20)} | {f"{w} ": 1.5 for w in rng.sample(words, 20)}, [*lex.exceptions, *(" ".join(folded(t).split()[4:6]) for t in texts[:60] if t and len(t.split()) > 9)])
    assert lex.weights and lex.exceptions
    for t in texts:
        assert lex.hits(t or "") == pytest.approx(naive_hits(lex, t or "")), t


def test_op3_counts_equal_brute_force(spark):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    tokens = {i: [*(t or "").translate(LOWER).encode().split(), None] for i, t in table}
    counts = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = queries.op3_lm_scoring(spark, DATA).collect()
    assert len(rows) == len(table)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def small_model():
    text = b"a b c d e f g h " * 20
    c = Chunk(np.arange(1), np.zeros(1, np.int64), [text])
    codes = np.concatenate([np.zeros(1, np.uint64), np.unique(c.codes)[:5]])
    n = np.arange(6) + 1
    v = Vocabulary(codes, n, np.arange(6, dtype=np.int32), 100, 8, np.zeros(1 << 16, np.int32), np.log10([50.0]), n, np.array([40]))
    return GatedLM.start(v, 5, 4), text


def test_op3_probabilities_sum_to_one():
    model, _ = small_model()
    h = np.random.default_rng(0).normal(size=(3, 5)).astype(np.float32)
    for row in h:
        p = [float(np.exp(model.outputs(row[None], np.array([y]))[0][0])) for y in range(7)]
        assert sum(p) == pytest.approx(1, abs=1e-5)


def test_op3_state_crosses_windows_and_lanes():
    model, text = small_model()
    c = Chunk(np.arange(3), np.zeros(3, np.int64), [text, b"a b", b""])
    scores = [model.score(c, lanes=lanes, window=window)["model"] for lanes in (1, 2, 64) for window in (1, 7, 1000)]
    for s in scores[1:]:
        assert s == pytest.approx(scores[0], rel=1e-5)


def test_op3_gradients_across_a_window_edge():
    """Every kind of weight against differences of the loss of the second window, its first state given."""
    model, text = small_model()
    model.weights = {k: np.ascontiguousarray(w, np.float64) for k, w in model.weights.items()}
    c = Chunk(np.arange(3), np.zeros(3, np.int64), [text[:40], b"a b c", b"c d h e f g a"])
    _, number = model.vocabulary.encode(c)
    x, y, start = _sequences(c.first, number, model.vocabulary.end)
    plan = Lanes(np.diff(c.first) + 1, 2)
    state = gradients(model, x, y, start, plan, np.zeros((2, 5)), 0, 6)[1]
    grads, _, n, loss = gradients(model, x, y, start, plan, state, 6, 12)
    assert n > 6 and loss > 0 and start[np.concatenate([plan.at(t, start)[0] for t in range(6, 12)])].any()
    step = 1e-6
    for name, g in grads.items():
        flat, own = model.weights[name].reshape(-1), g.reshape(-1)
        for k in {0, len(flat) // 2, len(flat) - 1, int(np.abs(own).argmax())}:
            was = flat[k]
            flat[k] = was + step
            up = gradients(model, x, y, start, plan, state, 6, 12)[3]
            flat[k] = was - step
            down = gradients(model, x, y, start, plan, state, 6, 12)[3]
            flat[k] = was
            assert own[k] == pytest.approx((up - down) / (2 * step), abs=1e-5), (name, k)
    assert all(np.abs(grads[k]).max() > 1e-3 for k in ("U", "W", "E", "b", "C", "O"))


def test_op3_learns():
    model, text = small_model()
    c = Chunk(np.arange(1), np.zeros(1, np.int64), [text])
    before = model.score(c)["model"][0]
    assert train(model, [text] * 4, passes=20, rate=0.02, lanes=2, window=8).score(c)["model"][0] > before + 10


def naive_score(model, text, known):
    """Log10 probability of a text, token by token in plain arithmetic; ``known`` counts the words by code."""
    v, w = model.vocabulary, {k: a.astype(float) for k, a in model.weights.items()}
    c = Chunk(np.arange(1), np.zeros(1, np.int64), [text])
    sigmoid = lambda a: 1 / (1 + np.exp(-a))
    soft = lambda a: np.exp(a - a.max()) / np.exp(a - a.max()).sum()
    h, x, out, n = np.zeros(len(w["U"])), v.end, 0.0, len(w["U"])
    for code, ending in [*zip(c.codes.tolist(), c.endings.tolist(), strict=True), (0, None)]:
        gates, a = w["E"][x] @ w["W"] + w["b"], h @ w["U"]
        z, r = sigmoid(gates[:n] + a[:n]), sigmoid(gates[n : 2 * n] + a[n : 2 * n])
        h = z * h + (1 - z) * np.tanh(gates[2 * n :] + r * a[2 * n :])
        at = np.flatnonzero(v.codes == np.uint64(code))
        slot = int(v.slot[at[0]]) if len(at) else -1
        p = soft(h @ w["C"] + w["c"])
        if slot >= 0:
            out += math.log10(p[slot // 32] * soft(w["O"][slot // 32] @ h + w["o"][slot // 32])[slot % 32])
            x = slot
        else:
            tail = int(v.tail_of[ending])
            out += math.log10(p[len(w["o"]) + tail]) + math.log10(known[code] + 1) - v.tail_log[tail]
            x = v.head + tail
    return out


def test_op3_score_equals_naive_scoring(spark):
    frame = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    counts = count_words(frame)
    model = fit_lm(frame, counts, head=60, tail_classes=5, entries=200, replica_words=2000, fan_in=3, piece_words=300)
    known = Counter({r.code % (1 << 64): r.n for r in counts.collect()})
    texts = {r.doc_id: (r.text or "").translate(LOWER).encode() for r in frame.collect() if len(r.text or "") < 4000}
    assert len(texts) > 20
    for r in score_documents(frame, model, counts).collect():
        if r.doc_id in texts:
            assert r.score == pytest.approx(naive_score(model, texts[r.doc_id], known), rel=1e-4)


def test_op3_every_learning_row_trains(spark, monkeypatch):
    """Texts of all rows, repeats included, reach the network, in even shares of all replicas of every round."""
    rows = [(i, f"w{i % 50} a b") for i in range(9000)] + [(7, "again and again")] * 1000
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    rounds, collect = [], lm.bounded_rows
    monkeypatch.setattr(lm, "bounded_rows", lambda *a: rounds.append(collect(*a)) or rounds[-1])
    fit_lm(frame, count_words(frame), replica_words=2500)
    assert sum(r[1] for found in rounds for r in found) == 40_000
    assert all(len(found) == 4 and min(r[1] for r in found) > 2000 for found in rounds)


def test_op3_pieces_hold_every_token_once():
    model, text = small_model()
    texts = [text, b"", b"a b c d", b"a b c d"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 3]), pa.array([5, 6, 7, 7]), pa.array(texts, pa.binary())], names=["doc_id", "row", "text"])
    found = [r for b in lm._pieces(SimpleNamespace(value=model), 7, 1000)(iter([batch])) for r in b.to_pylist()]
    c = Chunk(np.array([1, 2, 3, 3]), np.array([5, 6, 7, 7]), texts)
    x, y, _ = _sequences(c.first, model.vocabulary.encode(c)[1], model.vocabulary.end)
    pieces = [np.frombuffer(r["piece"], np.uint16).astype(int) for r in found]
    assert [n for p in pieces for n in p[:-1]] == x.tolist() and [n for p in pieces for n in p[1:]] == y.tolist()
    assert [r["tokens"] for r in found] == [len(p) - 1 for p in pieces] and max(r["tokens"] for r in found) <= 7
    assert [(r["h"], r["nth"]) for r in found if r["h"] != 5] == [(6, 0), (7, 0), (7, 1)] and [r["no"] for r in found if r["h"] == 5] == list(range(23))


def test_op3_large_logits_are_shifted(monkeypatch):
    model, _ = small_model()
    h, y = np.random.default_rng(2).normal(size=(50, 5)).astype(np.float32), np.arange(50) % 7
    plain = model.outputs(h, y, back=True)
    monkeypatch.setattr(lm, "_SAFE", 0)
    shifted = model.outputs(h, y, back=True)
    assert shifted[0] == pytest.approx(plain[0], rel=1e-4) and np.allclose(shifted[1], plain[1], atol=1e-5)
    assert all(np.allclose(shifted[2][k], plain[2][k], atol=1e-4) for k in "CcOo")
    monkeypatch.undo()
    model.weights["C"] = model.weights["C"] * np.float32(1e4)
    assert np.isfinite(model.outputs(h, y, back=True)[0]).all()


def test_op3_long_texts_share_windows_and_chunks_share_a_run(monkeypatch):
    """A text far longer than the others takes windows by its tokens, and many chunks are one run with the same scores."""
    model, _ = small_model()
    texts = [b"a b c d " * 500, *[b"e f g h"] * 40, b""]
    ids = np.arange(len(texts))
    windows, runs, outputs, run = [], [], GatedLM.outputs, GatedLM.run
    monkeypatch.setattr(GatedLM, "outputs", lambda self, h, *a: windows.append(len(h)) or outputs(self, h, *a))
    monkeypatch.setattr(GatedLM, "run", lambda self, sizes, *a, **k: runs.append(len(sizes)) or run(self, sizes, *a, **k))
    alone = model.score(Chunk(ids, ids, texts))
    assert sum(windows) == 2001 + 40 * 5 + 1 and len(windows) < 5 and runs == [len(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids), pa.array(texts, pa.binary())], names=["doc_id", "row", "text"])
    for words in (10_000, 2050, 1):
        runs.clear()
        found = [r for b in lm._scorer(SimpleNamespace(value=model), 8, words)(iter([batch])) for r in b.to_pylist()]
        assert [r["doc_id"] for r in found] == ids.tolist() and [r["n_tokens"] for r in found] == alone["n_tokens"].tolist()
        assert [r["model"] for r in found] == pytest.approx(alone["model"].tolist(), rel=1e-5) and [r["known"] for r in found] == alone["known"].tolist()
        rest = [(r["doc_id"], np.uint64(c % (1 << 64))) for r in found for c, n in zip(r["codes"], r["times"], strict=True) for _ in range(n)]
        assert sorted(rest) == sorted(zip(alone["rest_doc"].tolist(), alone["rest_code"], strict=True))
        assert sum(runs) == 42 and (len(runs) == 1 if words == 10_000 else len(runs) > 1)


@pytest.mark.filterwarnings("error")
def test_op3_saturated_gates_are_quiet():
    model, text = small_model()
    model.weights |= {k: model.weights[k] * np.float32(1e4) for k in ("E", "W", "U")}
    assert math.isfinite(model.score(Chunk(np.arange(1), np.zeros(1, np.int64), [text]))["model"][0])


def test_op3_a_very_long_text_takes_memory_by_its_words():
    plan = Lanes(np.array([3, 2_000_000, 5, 4]), 256)
    assert len(plan.flat) == 2_000_012 and plan.steps == 2_000_000 and sorted(plan.at(0, np.zeros(3_000_000, bool))[0].tolist()) == [0, 3, 2_000_003, 2_000_008]


def test_op3_edges_and_words_outside_the_dictionary(spark):
    d = docs(spark)
    counts = count_words(d)
    for options in ({}, {"entries": 3, "head": 2, "tail_classes": 2}):
        model = fit_lm(d, counts, **options)
        assert len(model.vocabulary.codes) <= options.get("entries", 1 << 19) + 1
        rows = score_documents(d, model, counts).collect()
        assert len(rows) == d.count() and all(math.isfinite(r.score) and r.n_known == r.n_tokens for r in rows)
        assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
        total = sum(r.base_score for r in rows)
        assert total == pytest.approx(getattr(test_op3_edges_and_words_outside_the_dictionary, "total", total))
        test_op3_edges_and_words_outside_the_dictionary.total = total
    nothing = count_words(empty(spark))
    model = fit_lm(empty(spark), nothing)
    assert score_documents(empty(spark), model, nothing).count() == 0
    assert all(r.n_known == 0 and r.base_score == 0 for r in score_documents(d, model, nothing).collect())
    assert fit_vocabulary(nothing).tokens == 0


def test_op10_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    held = [r for r in queries.op10_language_id(spark, LARGER).collect() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.98
    assert sum(r.rejected for r in held) / len(held) < 0.01


def test_op10_margin_does_not_fall_with_length(spark):
    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = fit_languages(table)
    parts = {}
    for r in sorted(table.where("text is not null").collect(), key=lambda r: r.doc_id):
        parts.setdefault(r.lang, []).append(r.text)
    for lang, texts in parts.items():
        vocabulary = sorted({w for t in texts for w in t.split()})
        rng = np.random.default_rng(5)
        for size in (20_000, 400_000):
            assert (found := model.judge(" ".join(rng.choice(vocabulary, size))))[0] == lang and found[2] > 0.02, (lang, size, found)


def test_op10_equals_naive_encoding(spark):
    import zstandard

    table = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    model = fit_languages(table)
    for r in identify(table, model).collect():
        raw = "".join(c if c.isalpha() else " " for c in (r.text or "").lower())
        while "  " in raw:
            raw = raw.replace("  ", " ")
        if not raw.strip():
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0, True)
            continue
        raw = f" {raw} ".encode()
        raw = raw * 2 if len(raw) < 96 else raw
        n = -(-len(raw) // 8192)
        pieces = [raw[len(raw) * i // n : len(raw) * (i + 1) // n] for i in range(n)]
        sizes = Counter()
        for row in model.content:
            for lang, content in zip(model.langs, row, strict=True):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=6)
                sizes[lang] += sum(len(zstandard.ZstdCompressor(level=6, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(x)) for x in pieces)
            least, second = sorted(sizes.values())[:2]
            if (second - least) / second >= 0.03:
                break
        assert sizes[r.lang_pred] == least and r.margin == pytest.approx((second - least) / second) and r.rejected == (r.margin < 0.005)


def test_op10_fit_takes_repeats(spark):
    one = [(i, f"{'the and of' if i % 2 else 'der die das'} w{i}", "en" if i % 2 else "de") for i in range(1000)]
    hot = [(7, "the same row again", "en")] * 3000
    once = fit_languages(spark.createDataFrame([*one, hot[0]], "doc_id long, text string, lang string").repartition(3))
    many = fit_languages(spark.createDataFrame(one + hot, "doc_id long, text string, lang string").repartition(5))
    assert set(once.langs) == set(many.langs) == {"en", "de"}
    order = {k: i for i, k in enumerate(many.langs)}
    assert all(row[i] == other[order[k]] for row, other in zip(once.content, many.content, strict=True) for i, k in enumerate(once.langs))


def test_op10_edges(spark):
    d = docs(spark)
    out = identify(d, fit_languages(d))
    by_id = {r.doc_id: r for r in out.collect()}
    assert out.count() == d.count()
    assert {by_id[i].lang_pred for i in (1, 2, 3, 12)} == {"und"} and all(by_id[i].rejected and by_id[i].score == 0 for i in (1, 2, 3, 12))
    assert by_id[4].lang_pred == "en"
    none = fit_languages(empty(spark))
    assert {r.lang_pred for r in identify(d, none).collect()} == {"und"} and identify(empty(spark), none).count() == 0
