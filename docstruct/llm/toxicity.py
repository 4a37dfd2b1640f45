"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstruct.llm.scratch import stage
from docstruct.llm.textbatch import Carried, column, steps

#: n of the n-grams; 2 ** BITS hashed features.
GRAMS, BITS = (4, 5, 6), 21
#: Bound of the training sample: documents of each label, with their whole texts.
SAMPLE_PER_LABEL = 1000
#: Minima of a document's sketch, and the least share of them that agrees between copies (an estimate of their Jaccard similarity).
MINIMA, COPIES = 64, 0.8
#: Least log-likelihood ratio statistic (G) of a feature's document counts against the labels.
MIN_G = 20.0
_MULTIPLY = np.uint32(2654435761)


@dataclass
class Model:
    """weights: (2 ** BITS,) float32, zero where a feature has no say; the score is sigmoid(bias + sum over distinct features)."""

    weights: np.ndarray
    bias: float


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: (document, hashed n-gram) of every position of the lower-cased texts with a blank on both ends."""
    lowered = [(" " + t.decode("utf-8", "replace").lower() + " ").encode("utf-32-le") for t in texts]
    points = np.frombuffer(b"".join(lowered), "<u4")
    sizes = np.array([len(t) // 4 for t in lowered], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    rest = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(points))
    for n in GRAMS:
        if len(points) < n:
            continue
        code = np.full(len(points) - n + 1, n, np.uint32)
        for j in range(n):
            code = (code ^ points[j : len(points) - n + 1 + j]) * _MULTIPLY
            code ^= code >> np.uint32(15)
        inside = rest[: len(code)] >= n
        yield owner[: len(code)][inside], (code[inside] >> np.uint32(32 - BITS)).astype(np.int64)


def _distinct(texts: list[bytes], only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature), each once a document; only: a mask over features."""
    found = []
    for owner, feature in features(texts):
        if only is not None:
            hit = only[feature]
            owner, feature = owner[hit], feature[hit]
        found.append((owner << BITS) | feature)
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def sketch(feat: np.ndarray) -> np.ndarray:
    """MINIMA minima of a document's features under different hashes; zeros for a document without features."""
    if not len(feat):
        return np.zeros(MINIMA, np.uint32)
    salt = np.arange(1, MINIMA + 1, dtype=np.uint64)
    code = (feat.astype(np.uint64)[None, :] + salt[:, None] * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xFF51AFD7ED558CCD)
    code = (code ^ (code >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return (code >> np.uint64(32)).astype(np.uint32).min(axis=1)


def first_of_copies(minima: np.ndarray, y: np.ndarray, share: float = COPIES) -> np.ndarray:
    """Mask of the documents whose sketch agrees by less than `share` with that of any earlier kept one of their own label: else a group of copies would vote many times."""
    keep = np.zeros(len(y), bool)
    for label in np.unique(y):
        own: list[int] = []
        for i in np.nonzero(y == label)[0].tolist():
            if not own or ((minima[own] == minima[i]).mean(axis=1) < share).all():
                keep[i] = True
                own.append(i)
    return keep


def log_ratios(with_one: np.ndarray, with_none: np.ndarray, ones: int, nones: int) -> np.ndarray:
    """Naive Bayes log-count ratios of features from the documents of each label that have them."""
    return np.log((1 + with_one) / (1 + ones)) - np.log((1 + with_none) / (1 + nones))


def g_statistic(with_one: np.ndarray, with_none: np.ndarray, part: float) -> np.ndarray:
    """Log-likelihood ratio statistic of document counts against the labels, of which `part` are 1."""
    both = with_one + with_none
    with np.errstate(divide="ignore", invalid="ignore"):
        return 2 * (np.where(with_one > 0, with_one * np.log(with_one / (both * part)), 0) + np.where(with_none > 0, with_none * np.log(with_none / (both * (1 - part))), 0))


def fit(doc: np.ndarray, feat: np.ndarray, y: np.ndarray, ratio: np.ndarray, rounds: int = 250, rate: float = 0.5, decay: float = 2e-4) -> Model:
    """Logistic regression on the useful features (document, feature) scaled by their ratios (of all 2 ** BITS), classes of equal weight."""
    empty = np.zeros(1 << BITS, np.float32)
    if not len(y) or y.min() == y.max():
        return Model(empty, 4.0 if len(y) and y.max() == 1 else -4.0)
    columns, col = np.unique(feat, return_inverse=True)
    value = ratio[columns][col]
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, bias = np.full(len(columns), 0.05), -0.5
    for step in range(rounds):
        z = bias + np.bincount(doc, value * w[col], minlength=len(y))
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        pace = rate * (1 - step / rounds)
        w -= pace * (np.bincount(col, value * off[doc], minlength=len(columns)) + decay * w)
        bias -= pace * off.sum()
    weights = empty.copy()
    weights[columns] = w * ratio[columns]
    weights[np.abs(weights) < 0.02] = 0
    return Model(weights, float(bias))


def train(texts: list[bytes], labels: list[int]) -> Model:
    """The model of a few texts, by the steps that train_on() spreads over tasks."""
    y = np.array(labels, np.int64)
    doc, feat = _distinct(texts)
    minima = np.array([sketch(feat[doc == i]) for i in range(len(y))]).reshape(-1, MINIMA)
    own = first_of_copies(minima, y)
    hit = own[doc]
    doc, feat, y = (np.cumsum(own) - 1)[doc[hit]], feat[hit], y[own]
    ones, nones = int(y.sum()), int((1 - y).sum())
    if not ones or not nones:
        return fit(doc, feat, y, np.zeros(1 << BITS))
    with_one, with_none = (np.bincount(feat[y[doc] == k], minlength=1 << BITS).astype(np.float64) for k in (1, 0))
    hit = (g_statistic(with_one, with_none, ones / (ones + nones)) >= MIN_G)[feat]
    return fit(doc[hit], feat[hit], y, log_ratios(with_one, with_none, ones, nones))


def train_on(rows: DataFrame, text: str = "text", label: str = "y", key: str = "doc_id") -> Model:
    """The model of labelled rows (key, text, label), whatever the length of their texts.

    Keys must differ, as those of sample() do: of rows that repeat one the last would vote for all.

    Tasks turn whole texts into distinct features and sketches, written once. The driver gets the sketches (a few bytes a
    document), decides which copies don't vote, then gets the counts of the useful features alone, and each document's
    useful features: the number of rows bounds what reaches it, not the length of texts.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, "_text"):
            doc, feat = _distinct(texts)
            ends = np.cumsum(np.bincount(doc, minlength=len(texts)))[:-1]
            own = np.split(feat.astype(np.int32), ends)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in own], pa.binary()), pa.array([sketch(x).tobytes() for x in own], pa.binary())], names=["key", "y", "feats", "minima"])

    named = rows.select(column(key).cast("string").alias("key"), column(label).cast("int").alias("y"), column(text).alias("_text"))
    docs = stage(named.mapInArrow(spread, "key string, y int, feats binary, minima binary"), "features")
    found = sorted((r[0] or "", r[1], bytes(r[2])) for r in docs.select("key", "y", "minima").collect())
    y = np.array([r[1] for r in found], np.int64)
    own = first_of_copies(np.frombuffer(b"".join(r[2] for r in found), np.uint32).reshape(-1, MINIMA), y)
    names = {r[0]: i for i, r in enumerate(x for x, k in zip(found, own) if k)}
    y = y[own]
    ones, nones = int(y.sum()), int((1 - y).sum())
    if not ones or not nones:
        return fit(np.zeros(0, np.int64), np.zeros(0, np.int64), y, np.zeros(1 << BITS))
    voters = docs.sparkSession.sparkContext.broadcast(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            for name, label_, feats in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (name or "") in voters.value:
                    counts[label_, np.frombuffer(feats, np.int32)] += 1
        some = np.nonzero(counts.any(axis=0))[0]
        for at in range(0, len(some), 1 << 16):
            ids = some[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *(pa.array(counts[k, ids], pa.int64()) for k in (1, 0))], names=["feat", "a", "b"])

    summed = docs.select("key", "y", "feats").mapInArrow(count, "feat int, a long, b long").groupBy("feat").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    part = ones / (ones + nones)
    term = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("a") + F.col("b")) * F.lit(p)))).otherwise(0.0)
    useful = summed.where(2 * (term("a", part) + term("b", 1 - part)) >= MIN_G).collect()
    with_one, with_none = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for f, a, b in useful:
        with_one[f], with_none[f] = a, b
    wanted = docs.sparkSession.sparkContext.broadcast(np.array(sorted(r[0] for r in useful), np.int32))

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_ = [(voters.value[n or ""], np.intersect1d(np.frombuffer(f, np.int32), wanted.value, assume_unique=True).tobytes()) for n, f in zip(*(batch.column(i).to_pylist() for i in range(2))) if (n or "") in voters.value]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows_], pa.int32()), pa.array([r[1] for r in rows_], pa.binary())], names=["i", "feats"])

    own_feats = sorted((r[0], bytes(r[1])) for r in docs.select("key", "feats").mapInArrow(narrow, "i int, feats binary").collect())
    feats = [np.frombuffer(f, np.int32).astype(np.int64) for _, f in own_feats]
    doc = np.repeat(np.array([i for i, _ in own_feats], np.int64), [len(f) for f in feats])
    return fit(doc, np.concatenate([*feats, np.zeros(0, np.int64)]), y, log_ratios(with_one, with_none, ones, nones))


def score(model: Model, texts: list[bytes], only: np.ndarray) -> np.ndarray:
    doc, feat = _distinct(texts, only)
    z = model.bias + np.bincount(doc, model.weights[feat].astype(np.float64), minlength=len(texts))
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = SAMPLE_PER_LABEL, seed: int = 3) -> DataFrame:
    """(key, text, y): at most per_label labelled documents of each label, chosen by a hash of the key, with their whole texts.

    Only the chosen keys, bounded by twice per_label, meet the documents. Rows of labels without a key or a label don't
    count; a key with several labels counts as 1 if any is; of a key's several texts the last in order counts.
    """
    order = F.xxhash64(F.lit(seed), F.col("_key"))
    named = labels.select(column(key).alias("_key"), column(label).cast("int").alias("y")).where("_key IS NOT NULL AND y IS NOT NULL").groupBy("_key").agg(F.max("y").alias("y"))
    chosen = None
    for k in (0, 1):
        part = named.where(F.col("y") == k).orderBy(order, "_key").limit(per_label)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select(column(key).alias("_key"), column(text).alias("_t")).where("_t IS NOT NULL").join(F.broadcast(chosen), "_key").groupBy("_key", "y").agg(F.max("_t").alias("_t"))
    return rows.select(F.col("_key").alias(key), F.col("_t").alias(text), "y")


def predict(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from 0.5 on) to the columns `keep` of docs (None: all).

    Null and empty texts get the score of a text without words; repeated rows stay; columns of docs with these names are
    replaced, whatever their case; an empty table gives an empty result.
    """
    own = Carried(docs, keep, ("score", "predicted"))
    schema = T.StructType([*own.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast((np.nonzero(model.weights)[0], model.weights[np.nonzero(model.weights)[0]], model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, what, bias = sent.value
        full = Model(np.zeros(1 << BITS, np.float32), bias)
        full.weights[where] = what
        only = full.weights != 0
        for part, texts in steps(batches, "_text"):
            s = score(full, texts, only)
            yield pa.RecordBatch.from_arrays([*own.of(part), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=schema.names)

    return docs.select(*own.into(), column(text).alias("_text")).mapInArrow(run, schema).select(*own.back(), "score", "predicted")
