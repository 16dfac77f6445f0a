"""Token counts against a plain dynamic program; held-out accuracy of the classifier."""

import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from specweave.llm import langid, tokens


def brute_count(word, vocabulary):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        width = len(word[end - 1].encode())
        options = [(best[end - 1][0] + width * vocabulary.byte_score, -(best[end - 1][1] + width))]
        options += [(vocabulary.scores[word[start:end]] + best[start][0], -(best[start][1] + 1)) for start in range(end) if word[start:end] in vocabulary.scores]
        score, count = max(options)
        best[end] = (score, -count)
    return best[-1][1]


def test_counts(spark):
    rng = random.Random(2)
    pieces = {"▁": -3.0, "▁a": -2.0, "ab": -2.0, "b": -3.0, "a": -3.0, "ba": -3.5, "abab": -4.0, "é": -5.0, "aa": -6.0}
    small = tokens.Vocabulary(pieces)
    words = ["".join(rng.choice("abé?") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    trie = tokens.Trie(small)
    assert [trie.insert(tokens.MARK + w) for w in words] == [brute_count(tokens.MARK + w, small) for w in words]
    assert len(trie.children) == len({(tokens.MARK + w)[:n] for w in words for n in range(len(w) + 2)})
    texts = [None, "", " \n", "ab ab", " ".join(words), "b" * 5000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    got = sorted(tuple(r) for r in tokens.token_counts(docs, small).select("doc_id", "n_pretokens", "n_tokens").collect())
    assert got == [(i, len((t or "").split()), sum(brute_count(tokens.MARK + w, small) for w in (t or "").split())) for i, t in enumerate(texts)]
    assert tokens.token_counts(docs.limit(0), small).count() == 0


def test_vocabulary_file(spark, monkeypatch):
    """All words of a table with the real vocabulary, also when the trie starts anew again and again."""
    vocabulary = tokens.load_vocabulary(tokens.default_vocabulary_path())
    assert len(vocabulary.scores) > 30_000 and abs(sum(map(math.exp, vocabulary.scores.values())) - 1) < 1e-6
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(docs, vocabulary).collect()}
    assert got == {r["doc_id"]: sum(brute_count(tokens.MARK + w, vocabulary) for w in r["text"].split()) for r in docs.collect()}


def test_grams():
    idx, tf = langid.grams("Ab ab!", 16)
    # ` ab ab `: five different unigram, bigram and trigram kinds each occur as counted.
    assert tf.sum() == 7 + 6 + 5 and len(idx) == len(set(idx))
    assert len(langid.grams("12 _ ?", 16)[0]) == len(langid.grams(None, 16)[0]) == 0
    long = "wort und satz " * 900
    assert langid.grams(long, 16)[1].sum() == sum(len(f" {long.strip()} ") - n for n in range(3))


def test_temperature():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3)) * 2
    classes = np.array([rng.choice(3, p=langid.softmax(x / 2.5)) for x in logits])
    assert abs(langid.temperature(logits, classes) - 2.5) < 0.3
    assert langid.temperature(np.zeros((0, 3)), np.zeros(0, dtype=int)) == 1.0


def test_temperature_of_separable_rows():
    """Where every row is told apart the temperature is still inside the search, and scores stay below 1."""
    for size in (10, 1000):
        classes = np.arange(size) % 4
        logits = np.eye(4)[classes] * 9 + np.random.default_rng(1).random((size, 4))
        t = langid.temperature(logits, classes)
        assert 2 / langid.WIDEST < t < langid.WIDEST / 2
        mean = langid.softmax(logits / t)[np.arange(size), classes].mean()
        assert abs(mean - (size + 1) / (size + 2)) < 0.01
    assert langid.calibration_error(np.array([[0.9, 0.1]] * 10), np.array([0] * 9 + [1])) < 1e-9
    assert abs(langid.calibration_error(np.array([[0.9, 0.1]] * 10), np.array([1] * 10)) - 0.9) < 1e-9


def brute_grams(text, bits):
    """Hashes of the n-grams of the words of letters, each by itself."""
    words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    words = [w.lstrip("".join(c for c in set(w) if unicodedata.category(c)[0] == "M")) for w in words.split()]
    words = [w for w in words if w]
    line = f" {' '.join(words)} " if words else ""
    out, full = Counter(), 2**64
    for n in range(1, langid.MAX_GRAM + 1):
        for at in range(len(line) - n + 1):
            key = sum(ord(c) * int(m) for c, m in zip(line[at : at + n], langid._MULTIPLIERS, strict=False)) % full
            mixed = (key + n * langid._BY_LENGTH) % full
            out[(mixed ^ mixed >> 31) * int(langid._MIX) % full >> 64 - bits] += 1
    return out


def test_text_to_score(spark):
    """Document frequencies, TF-IDF, logits and scores by plain loops, on all documents of the smallest table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    out, settings = langid.held_out(F.col("doc_id")), langid.Settings(bits=12, rounds=1)
    model = langid.train(docs.filter(~out), settings=settings)
    bits = (model.weights.shape[1] - 1).bit_length() - 1
    learned = [brute_grams(r["text"], bits) for r in docs.filter(~out & F.col("lang").isNotNull()).collect()]
    df, total = Counter(f for g in learned for f in g), sum(map(bool, learned))
    assert all(abs(model.idf[f] - (math.log((1 + total) / (1 + df[f])) + 1)) < 1e-9 for f in range(1 << bits))
    for r in langid.predict(docs, model).collect():
        own = brute_grams(r["text"], bits)
        x = {f: (1 + math.log(n)) * model.idf[f] for f, n in own.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        logits = [(sum(float(w[f]) * v / norm for f, v in x.items()) + float(w[-1])) / model.temperature for w in model.weights]
        p = [math.exp(v - max(logits)) for v in logits]
        best = max(range(len(p)), key=lambda k: p[k])
        assert r["lang_pred"] == model.langs[best] and abs(r["score"] - p[best] / sum(p)) < 1e-4


def test_calibration_on_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.filter(~out))
    assert 2 / langid.WIDEST < model.temperature < langid.WIDEST / 2 and model.calibration_error < 0.02
    rows = [r for r in langid.predict(docs.filter(out & F.col("lang").isNotNull()), model).collect() if r["lang_pred"] != "und"]
    top = np.array([[r["score"], 0.0] for r in rows])
    assert langid.calibration_error(top, np.array([int(r["lang"] != r["lang_pred"]) for r in rows])) < 0.02


def test_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    out = langid.held_out(F.col("doc_id"))
    settings = langid.Settings(rows_per_lang=60, shards=2, rounds=2)
    model = langid.train(docs.filter(~out), settings=settings)
    assert (model.weights != 0).mean() < 0.3
    got = langid.predict(docs.filter(out), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got) > 200
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "42 !", "x"), (4, "the of and ing tion " * 30000, "x")], "doc_id long, text string, lang_pred string")
    rows = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and rows[1]["score"] == 0 and rows[4]["lang_pred"] == "en"
    empty = langid.train(docs.limit(0), settings=settings)
    assert empty.langs == [] and langid.predict(odd, empty).first()["lang_pred"] == "und"
    again = langid.train(docs.filter(~out), settings=settings)
    assert np.array_equal(again.weights, model.weights) and again.temperature == model.temperature


def test_letters():
    for text in (None, "", "½ ²", "Ⅷ", "12 _ 3", "\u0301"):
        assert not len(langid.grams(text, 12)[0])
    for text in ("ª", "a", "хорошо", "नमस्ते", "e\u0301"):
        assert len(langid.grams(text, 12)[0])
    # Marks belong to their word: it is not cut at them.
    assert [list(x) for x in langid.grams("नमस्ते", 12)] != [list(x) for x in langid.grams("नमस त", 12)]


def test_ftrl_brute():
    """Coordinate by coordinate, from the formulas of FTRL-proximal with elastic net."""
    rng = np.random.default_rng(3)
    s = langid.Settings(bits=4, alpha=0.7, beta=0.9, l1=0.08, l2=0.3)
    langs, size = 3, 17
    rows = [(int(rng.integers(langs)), np.sort(rng.choice(size, 6, replace=False)), rng.random(6)) for _ in range(60)]
    z, n = np.zeros((langs, size)), np.zeros((langs, size))
    langid.ftrl(rows, z, n, s)
    bz, bn = [[0.0] * size for _ in range(langs)], [[0.0] * size for _ in range(langs)]

    def weight(c, i):
        if abs(bz[c][i]) <= s.l1:
            return 0.0
        sign = 1 if bz[c][i] > 0 else -1
        return -(bz[c][i] - sign * s.l1) / ((s.beta + math.sqrt(bn[c][i])) / s.alpha + s.l2)

    for k, idx, x in rows:
        w = [[weight(c, i) for i in idx] for c in range(langs)]
        logit = [sum(a * b for a, b in zip(row, x, strict=True)) for row in w]
        total = sum(math.exp(v) for v in logit)
        for c in range(langs):
            for j, i in enumerate(idx):
                g = (math.exp(logit[c]) / total - (c == k)) * x[j]
                sigma = (math.sqrt(bn[c][i] + g * g) - math.sqrt(bn[c][i])) / s.alpha
                bz[c][i] += g - sigma * w[c][j]
                bn[c][i] += g * g
    assert np.allclose(z, bz) and np.allclose(n, bn) and (langid.weights_of(z, n, s) == 0).any() and abs(langid.weights_of(z, n, s)).max() > 0.1


def test_many_languages(spark):
    """Any number of languages, with features as the bound allows; ties and repeated rows."""
    rows = [(i, f"{chr(97 + i % 26) * 3} {chr(97 + i // 26 % 26) * 4} word", f"l{i % 450}") for i in range(1800)]
    docs = spark.createDataFrame(rows + rows[:5] + [(None, None, "l0"), (1, "x", None)], "doc_id long, text string, lang string")
    model = langid.train(docs, settings=langid.Settings(max_cells=1 << 16, rounds=1, epochs=1))
    assert len(model.langs) == 450 and model.weights.shape == (450, 129)
    got = langid.predict(docs.limit(50), model).collect()
    assert all(r["lang_pred"] in model.langs and 0 <= r["score"] <= 1 for r in got)
