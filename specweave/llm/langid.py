"""Language identification: sparse multinomial logistic regression on TF-IDF of character
n-grams, trained with follow-the-regularised-leader and elastic-net penalties, then
calibrated with a temperature.

A text is lower-cased, runs of anything but words become one space (a word is a letter, of
Unicode's category L, with the letters and marks that follow it), and its 1- to ``MAX_GRAM``-grams are hashed into 2**bits features. Document frequencies cover every row
that may be learned from. The classifier itself is fitted on a bounded sample of
those rows: at most ``rows_per_lang`` of a language and ``max_rows`` in all. Each
round, every shard of the sample continues the per-coordinate FTRL state for its own rows,
and the states are averaged. A fifth of the sample is held back for the temperature.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specweave.llm.common import boxed, quoted, stored, unboxed

UNDETERMINED = "und"
MAX_GRAM = 3
#: Odd 64-bit multipliers of the feature hash: one a character, one for the length, one to mix.
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_BY_LENGTH, _MIX = 0x27D4EB2F165667C5, np.uint64(0xFF51AFD7ED558CCD)
_WORDS, _ASCII_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*"), re.compile("[a-z]+")


@dataclass(frozen=True)
class Settings:
    """bits: the features are 2**bits hashes, fewer where languages x features would be over
    max_cells, which bounds the model and each round's state for any number of languages.
    max_rows and rows_per_lang: the bounded sample; each language has one row at least."""

    bits: int = 16
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.5
    rounds: int = 3
    epochs: int = 2
    shards: int = 6
    rows_per_lang: int = 1500
    max_rows: int = 6000
    max_cells: int = 1 << 25
    seed: int = 11


@dataclass
class Model:
    """langs: class names; idf: by feature; weights: classes x (features and a bias)."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    calibration_error: float = 0.0


def grams(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of a whole text, in order, and how often each occurs; none without a letter."""
    low = (text or "").lower()
    letters = " ".join((_ASCII_WORDS if low.isascii() else _WORDS).findall(low))
    if not letters:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    code = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    parts, key = [], np.zeros(len(code), dtype=np.uint64)
    for n in range(1, MAX_GRAM + 1):
        key = key[: len(code) - n + 1] + code[n - 1 :] * _MULTIPLIERS[n - 1]
        mixed = key + np.uint64(n * _BY_LENGTH & (2**64 - 1))
        parts.append((mixed ^ (mixed >> np.uint64(31))) * _MIX >> np.uint64(64 - bits))
    h = np.concatenate(parts).astype(np.int64)
    if len(h) < 4000:
        return np.unique(h, return_counts=True)
    counts = np.bincount(h, minlength=1 << bits)
    idx = np.flatnonzero(counts)
    return idx, counts[idx]


def weighed(idx: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values of unit length."""
    x = (1.0 + np.log(tf)) * idf[idx]
    norm = math.sqrt(float(x @ x))
    return x / norm if norm else x


def document_frequencies(docs: DataFrame, text_col: str, bits: int) -> tuple[int, np.ndarray]:
    """Texts with a letter, and the number of those that hold each feature. A task returns
    one row a feature, and the driver one number a feature, however many the rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(1 << bits, dtype=np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                idx, _ = grams(text, bits)
                df[idx] += 1
                n += len(idx) > 0
        found = np.flatnonzero(df)
        yield pd.DataFrame({"feature": np.append(found, -1), "n": np.append(df[found], n)})

    rows = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    total, df = 0, np.zeros(1 << bits)
    for row in rows:
        if row["feature"] < 0:
            total = row["n"]
        else:
            df[row["feature"]] = row["n"]
    return total, df


def weights_of(z: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    """Closed form of the FTRL-proximal weights; l1 makes them sparse."""
    return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], z: np.ndarray, n: np.ndarray, s: Settings) -> None:
    """One pass over rows of (class, features, values), changing the state z, n in place."""
    for k, idx, x in rows:
        zi, ni = z[:, idx], n[:, idx]
        w = weights_of(zi, ni, s)
        p = softmax(w @ x)
        p[k] -= 1.0
        g = p[:, None] * x[None, :]
        new = ni + g * g
        z[:, idx] = zi + g - (np.sqrt(new) - np.sqrt(ni)) / s.alpha * w
        n[:, idx] = new


def sample(docs: DataFrame, counts: dict[str, int], id_col: str, text_col: str, lang_col: str, s: Settings) -> DataFrame:
    """The stored bounded sample of rows as features; counts: rows by language. Rows go by
    the order of a seeded hash; only rows whose hash is low enough are sorted. Of rows that
    share id and text, which all have one place, any may be taken."""
    langs = sorted(counts)
    most = max(1, min(s.rows_per_lang, s.max_rows // max(1, len(langs))))
    scale = 1 << 30
    low = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(math.ceil(min(1.0, 1.5 * most / counts[lang]) * scale)))]) if langs else F.create_map()
    place = F.xxhash64(F.lit(s.seed), F.col(id_col).cast("string"))
    some = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), place.alias("place")).filter(F.pmod("place", F.lit(scale)) < F.element_at(low, F.col("lang"))) if langs else docs.limit(0).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), place.alias("place"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", F.md5("text")))
    some = some.withColumn("nth", first).filter(F.col("nth") <= most)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(lang, nth, *grams(text, s.bits)) for lang, nth, text in zip(batch["lang"], batch["nth"], batch["text"], strict=True)]
            yield pd.DataFrame([r for r in out if len(r[2])], columns=["lang", "nth", "idx", "tf"])

    return stored(some.select("lang", "nth", "text").mapInPandas(features, "lang string, nth int, idx array<int>, tf array<int>"), "sample")


def with_bias(idx: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and values of a sampled row, with the bias, the feature after the last."""
    return np.append(idx, len(idf)), np.append(weighed(idx, tf, idf), 1.0)


def _shard_fit(state: Broadcast, number: dict[str, int], turn: int, s: Settings) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """What continues the broadcast FTRL state (z, n) on a shard of the sample."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        z, n, idf = state.value[0].copy(), state.value[1].copy(), state.value[2]
        pdf = pdf.sort_values(["nth", "lang"])
        own = [(number[lang], *with_bias(np.asarray(i), np.asarray(t), idf)) for lang, i, t in zip(pdf["lang"], pdf["idx"], pdf["tf"], strict=True)]
        for epoch in range(s.epochs):
            order = np.random.default_rng(s.seed + 100 * turn + epoch).permutation(len(own))
            ftrl([own[i] for i in order], z, n, s)
        return pd.DataFrame({"k": range(len(z)), "z": [r.tobytes() for r in z], "n": [r.tobytes() for r in n]})

    return fit


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: Settings | None = None) -> Model:
    """A model from the rows of docs, all of which may be learned from. Rows without a
    language or a letter teach nothing; without any row the model has no language. Texts of any
    length are taken whole; repeated rows count as often as they occur; other columns of
    docs, whatever their names, are not read."""
    s = settings or Settings()
    docs = docs.filter(F.col(lang_col).isNotNull())
    spark = docs.sparkSession
    counts = {r["lang"]: r["n"] for r in docs.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}  # a row a language, as the model has
    langs = sorted(counts)
    s = replace(s, bits=max(4, min(s.bits, (s.max_cells // max(1, len(langs))).bit_length() - 1)))
    total, df = document_frequencies(docs, text_col, s.bits)
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    rows = sample(docs, counts, id_col, text_col, lang_col, s)
    number = {lang: k for k, lang in enumerate(langs)}
    size = (1 << s.bits) + 1  # the last is the bias
    z, n = np.zeros((len(langs), size)), np.zeros((len(langs), size))
    learn = rows.filter("nth % 5 <> 0").withColumn("shard", F.pmod("nth", F.lit(s.shards)))

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        of = lambda c: np.mean([np.frombuffer(b) for b in pdf[c]], axis=0).tobytes()
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "z": [of("z")], "n": [of("n")]})

    states = "k int, z binary, n binary"
    for turn in range(s.rounds if langs else 0):
        state = spark.sparkContext.broadcast((z, n, idf))
        fit = _shard_fit(state, number, turn, s)
        for row in learn.groupBy("shard").applyInPandas(fit, states).groupBy("k").applyInPandas(mean, states).collect():
            z[row["k"]], n[row["k"]] = np.frombuffer(row["z"]), np.frombuffer(row["n"])
        state.unpersist()
    weights = weights_of(z, n, s).astype(np.float32)

    held = rows.filter("nth % 5 = 0").collect()  # a fifth of the bounded sample
    logits = np.array([weights[:, i] @ x for i, x in (with_bias(np.array(r["idx"]), np.array(r["tf"]), idf) for r in held)]).reshape(len(held), len(langs))
    classes = np.array([number[r["lang"]] for r in held], dtype=int)
    t = temperature(logits, classes)
    return Model(langs, idf, weights, t, calibration_error(softmax(logits / t), classes) if len(held) else 0.0)


#: The search of the temperature ends at one hundredth and at one hundred.
WIDEST = 100.0


def temperature(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of the least negative log-likelihood, by golden section on a logarithmic scale;
    1 without rows or with one class.

    Of n rows none says that a class is certain: the own class counts (n + 1) / (n + 2), the others share the
    rest, as in Platt scaling. So there is a best temperature also where all rows are told apart,
    for which the likelihood alone would have scores of 1."""
    n, k = logits.shape
    if not n or k < 2:
        return 1.0
    own = (n + 1) / (n + 2)

    def loss(t: float) -> float:
        scaled = logits / math.exp(t)
        top = scaled.max(axis=1, keepdims=True)
        logs = scaled - top - np.log(np.exp(scaled - top).sum(axis=1, keepdims=True))
        true = logs[np.arange(n), classes]
        return -float((own * true + (1 - own) / (k - 1) * (logs.sum(axis=1) - true)).mean())

    low, high, g = -math.log(WIDEST), math.log(WIDEST), (math.sqrt(5) - 1) / 2
    for _ in range(80):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def calibration_error(p: np.ndarray, classes: np.ndarray, bins: int = 10) -> float:
    """The expected calibration error: by bins of the highest probability, how far the share of right answers
    is from its mean, weighed by rows."""
    top, right = p.max(axis=1), p.argmax(axis=1) == classes
    at = np.minimum((top * bins).astype(int), bins - 1)
    return float(sum(abs(right[at == b].mean() - top[at == b].mean()) * (at == b).mean() for b in np.unique(at)))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with ``lang_pred`` and ``score``, the calibrated probability of that language.

    A null text, one without a letter, and any text under a model without languages give
    `und` and 0. Rows stay rows, nothing is shuffled, and columns of these names are
    replaced; no column but the text is read for it. Equal texts get equal results. Of
    languages of equal probability the first by name is taken. An empty table gives an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        by_feature = np.ascontiguousarray(m.weights.T)
        bits = (m.weights.shape[1] - 1).bit_length() - 1
        out = []
        for text in texts:
            idx, tf = grams(text, bits)
            if not len(idx) or not m.langs:
                out.append((UNDETERMINED, 0.0))
                continue
            p = softmax((weighed(idx, tf, m.idf) @ by_feature[idx] + by_feature[-1]) / m.temperature)
            k = int(np.argmax(p))
            out.append((m.langs[k], float(p[k])))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    box = boxed(docs, ("lang_pred", "score"), p=of(quoted(text_col)))
    return unboxed(box, "p.lang_pred", "p.score")


def held_out(id_: Column) -> Column:
    """True for the fold that is never learned from: crc32 of the id as text, modulo 4, is 2.
    A null id counts as the empty text."""
    return F.crc32(F.coalesce(id_.cast("string"), F.lit(""))) % 4 == 2
