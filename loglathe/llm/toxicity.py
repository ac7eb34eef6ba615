"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams.

Features of a text are its distinct words, neighbouring word pairs and
skip-grams (two words with one between), hashed to ``2**bits`` coordinates.
Training is FTRL-proximal with per-coordinate rates and L1 sparsity, over at
most ``most_rows`` labelled texts: half of them of label 1 as far as there are
so many, chosen by a hash of the document id. The coordinates of the chosen
texts are made where the texts are; one task learns from them. The non-zero
weights (at most ``2**bits``) are broadcast; scoring is one pass over the texts
without a shuffle.

The default rate and L1 were chosen among ten settings by the log loss over one
fifth of the rows that may be learnt from, not over held-out rows.

Defined results: null and empty texts score as the bias alone; texts of any
length count whole; an id is toxic if any of its labels says so; of several
texts of an id, the last in order is learnt from, and each is scored; null
labels and null ids are not learnt from; without usable labels every score is
0.0; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Memo, small_batches

WORD = re.compile(r"\w+")
BITS = 20
_hashes = Memo(lambda w: zlib.crc32(w.encode("utf-8", "replace")) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Hashed coordinates of a whole text, with repeats."""
    words = WORD.findall(text.lower()) if text else []
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        near = (h[:-1] * np.uint64(3) + h[1:]) * np.uint64(0xD6E8FEB86659FD93)
        skip = (h[:-2] * np.uint64(5) + h[2:]) * np.uint64(0xCA5A826395121157)
    return (np.concatenate([h, near, skip]) >> np.uint64(64 - bits)).astype(np.int64)


def train_ftrl(rows: list[np.ndarray], labels, bits: int = BITS, alpha: float = 0.6, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0, epochs: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) learnt from rows of distinct coordinates; the bias bears no L1 and no L2."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = np.random.default_rng(7)
    rows = [np.append(r, size) for r in rows]
    labels = np.asarray(labels, float)

    def weights(i):
        w = -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2)
        w[np.abs(z[i]) <= l1] = 0
        if len(i) and i[-1] == size:
            w[-1] = -z[size] / ((beta + np.sqrt(n[size])) / alpha)
        return w

    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            i = rows[r]
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[r]
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / alpha * w
    w = weights(np.arange(size + 1))
    used = np.nonzero(w[:size])[0]
    return used, w[used].astype(np.float32), float(w[size])


def coordinates(text: Column, bits: int = BITS) -> Column:
    """The distinct coordinates of each text, ascending, as packed 32-bit integers."""
    small_batches()

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(features(t.as_py(), bits)).astype(np.int32).tobytes() for t in texts], pa.binary())

    return packed(text)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", most_rows: int = 6000, eligible: Column | None = None, bits: int = BITS, **options):
    """Learn from at most ``most_rows`` labelled rows; the bounded sample is all that leaves the executors."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull())
    if eligible is not None:
        known = known.where(eligible)
    known = known.groupBy("doc_id").agg(F.max(F.col(label_col).cast("int")).alias("__label"))
    chance = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    bad = known.where("__label = 1").orderBy(chance, "doc_id").limit(most_rows // 2)
    good = known.where("__label = 0").orderBy(chance, "doc_id").limit(most_rows // 2)
    sample = bad.unionByName(good).withColumnRenamed("doc_id", "__id")  # bounded by most_rows
    texts = docs.select(F.col("doc_id").alias("__doc"), "text").join(F.broadcast(sample), F.col("__doc") == F.col("__id"))
    texts = texts.groupBy("__id", "__label").agg(F.max("text").alias("text"))  # one row for each id
    rows = texts.select("__id", "__label", coordinates(F.col("text"), bits).alias("at"), F.lit(0).alias("__one"))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__id")
        i, w, bias = train_ftrl([np.frombuffer(x, np.int32) for x in pdf["at"]], pdf["__label"], bits, **options)
        return pd.DataFrame({"i": [i.tolist()], "w": [w.tolist()], "bias": [bias]})

    model = rows.groupBy("__one").applyInPandas(train, "i array<int>, w array<float>, bias double").first()
    return model if model is None else (np.array(model["i"], np.int32), np.array(model["w"], np.float32), model["bias"])


def score(text: Column, model, session, bits: int = BITS) -> Column:
    """Probability of label 1 of each whole text."""
    if model is None:
        return F.lit(0.0)
    small_batches(session)
    shared = session.sparkContext.broadcast(model)  # at most 2**bits weights
    dense: list[np.ndarray] = []

    @F.pandas_udf("double")
    def probability(texts: pd.Series) -> pd.Series:
        i, w, bias = shared.value
        if not dense:
            dense.append(np.zeros(1 << bits, np.float32))
            dense[0][i] = w
        sums = []
        for text in texts:
            at = features(text, bits)
            at = np.unique(at[dense[0][at] != 0])
            sums.append(bias + float(dense[0][at].sum()))
        return pd.Series(1 / (1 + np.exp(-np.clip(sums, -35, 35))), dtype=float)

    return probability(text)
