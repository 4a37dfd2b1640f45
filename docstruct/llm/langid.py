"""Language identification by a bidirectional gated recurrent network over bytes.

The network labels every byte position; a document's probabilities are the mean over its letter positions. Gates and
candidate use softsign (x / (1 + |x|)), which costs a division where tanh costs twenty. Texts are cut into windows that
overlap by CONTEXT bytes on both sides, so that memory is bounded for any length and every byte is labelled once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docstruct.llm.textbatch import Carried, column, steps

CORE, CONTEXT, BLOCK = 224, 16, 2048
#: Bounds of the training sample: windows of SAMPLE_CHARS characters of so many documents of each of the most frequent languages.
SAMPLE_PER_LANG, SAMPLE_CHARS, SAMPLE_LANGS = 400, 256, 256
UNDETERMINED = "und"
#: A byte that counts for the document: an ASCII letter or part of a longer character.
LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


@dataclass
class Model:
    """tables: (2, 3H, 256) input terms of each direction; u: (2, 3H, H); wo: (2, C, H); bo: (C, 1). Rows of 3H: reset, update, candidate."""

    langs: list[str]
    tables: np.ndarray
    u: np.ndarray
    wo: np.ndarray
    bo: np.ndarray


def _gate(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * x / (1 + np.abs(x))


def _states(model: Model, x: np.ndarray) -> list[np.ndarray]:
    """x: (L, B) bytes. For each direction the states (L, H, B) in the order of the text."""
    length, width = x.shape
    hidden = model.u.shape[2]
    found = []
    for d in range(2):
        out = np.empty((length, hidden, width), np.float32)
        table, u = np.ascontiguousarray(model.tables[d]), np.ascontiguousarray(model.u[d])
        h = np.zeros((hidden, width), np.float32)
        gi, g, a = np.empty((3 * hidden, width), np.float32), np.empty((3 * hidden, width), np.float32), np.empty((2 * hidden, width), np.float32)
        s, n, b = g[: 2 * hidden], g[2 * hidden :], a[:hidden]
        for t in range(length) if d == 0 else range(length - 1, -1, -1):
            np.take(table, x[t], axis=1, out=gi, mode="clip")
            np.matmul(u, h, out=g)
            s += gi[: 2 * hidden]
            np.abs(s, out=a)
            np.add(a, 1, out=a)
            np.divide(s, a, out=s)
            s *= 0.5
            s += 0.5
            n *= s[:hidden]
            n += gi[2 * hidden :]
            np.abs(n, out=b)
            np.add(b, 1, out=b)
            np.divide(n, b, out=n)
            np.subtract(h, n, out=b)
            b *= s[hidden:]
            h = out[t]
            np.add(n, b, out=h)
        found.append(out)
    return found


def label_positions(model: Model, x: np.ndarray) -> np.ndarray:
    """x: (L, B) bytes. Probabilities (L, C, B) of each language at each position."""
    ahead, back = _states(model, x)
    z = np.matmul(model.wo[0], ahead)
    z += np.matmul(model.wo[1], back)
    z += model.bo
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def pool(model: Model, texts: list[bytes]) -> np.ndarray:
    """(documents, languages): mean probabilities over the letter positions; zeros for a text without any."""
    sizes = np.array([len(t) for t in texts], np.int64)
    total = np.zeros((len(texts), len(model.langs)))
    letters = np.zeros(len(texts))
    data = np.frombuffer(b"\0" * CONTEXT + b"".join(texts) + b"\0" * (CORE + CONTEXT), np.uint8)
    first = np.cumsum(sizes) - sizes
    per = -(-sizes // CORE)
    doc = np.repeat(np.arange(len(texts)), per)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    begin = first[doc] + begin * CORE
    until = (first + sizes)[doc]
    span = np.arange(CORE + 2 * CONTEXT)[:, None]  # `data` has CONTEXT bytes before the first text
    for at in range(0, len(doc), BLOCK):
        some = slice(at, at + BLOCK)
        left = (until[some] - begin[some]).astype(np.int32)
        x = data[begin[some] + span]  # all of a length, so that a label depends on its own text alone
        x *= span.astype(np.int32) < left + CONTEXT
        x[:CONTEXT, begin[some] == first[doc[some]]] = 0
        p = label_positions(model, x.astype(np.intp))[CONTEXT : CONTEXT + CORE]
        counts = LETTER[x[CONTEXT : CONTEXT + CORE]]
        p[: len(counts)] *= counts[:, None, :]
        np.add.at(total, doc[some], p[: len(counts)].sum(axis=0).T)
        np.add.at(letters, doc[some], counts.sum(axis=0))
    return total / np.maximum(letters, 1)[:, None]


def train(windows: list[tuple[bytes, str]], hidden: int = 8, steps_: int = 300, batch: int = 96, length: int = 96, rate: float = 0.02, seed: int = 11) -> Model:
    """Fit by backpropagation through time with Adam on random crops; the same windows give the same model."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in windows})
    groups = [[np.frombuffer(t, np.uint8) for t, lang in sorted(windows) if lang == name and t] for name in langs]
    langs, groups = [x for x, g in zip(langs, groups) if g], [g for g in groups if g]
    c = len(langs)
    model = Model(langs, rng.normal(0, 0.3, (2, 3 * hidden, 256)), rng.normal(0, 0.3, (2, 3 * hidden, hidden)), rng.normal(0, 0.3, (2, c, hidden)), np.zeros((c, 1)))
    if c < 2:
        return _single(model)
    names = ("tables", "u", "wo", "bo")
    moments = {k: (np.zeros_like(getattr(model, k)), np.zeros_like(getattr(model, k))) for k in names}
    for step in range(1, steps_ + 1):
        x, y = np.zeros((length, batch), np.intp), rng.integers(0, c, batch)
        live = np.zeros((length, batch), bool)
        for j, k in enumerate(y):
            text = groups[k][rng.integers(len(groups[k]))]
            at = rng.integers(0, max(1, len(text) - length + 1))
            piece = text[at : at + length]
            x[: len(piece), j] = piece
            live[: len(piece), j] = LETTER[piece]
        grads = _gradients(model, x, y, live)
        norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
        pace = rate * (0.5 + 0.5 * np.cos(np.pi * step / (steps_ + 1)))
        for k in names:
            g = grads[k] * min(1.0, 1.0 / max(norm, 1e-9))
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            getattr(model, k)[...] -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(langs, *(np.ascontiguousarray(getattr(model, k), np.float32) for k in names))


def _single(model: Model) -> Model:
    return Model(model.langs, *(np.zeros_like(x, np.float32) for x in (model.tables, model.u, model.wo, model.bo)))


def _gradients(model: Model, x: np.ndarray, y: np.ndarray, live: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy of the positions in live."""
    length, width = x.shape
    hidden = model.u.shape[2]
    kept = []
    for d in range(2):
        h, path = np.zeros((hidden, width)), []
        for t in range(length) if d == 0 else range(length - 1, -1, -1):
            gi, g = model.tables[d][:, x[t]], model.u[d] @ h
            a = gi[: 2 * hidden] + g[: 2 * hidden]
            s = _gate(a)
            b = gi[2 * hidden :] + s[:hidden] * g[2 * hidden :]
            n = b / (1 + np.abs(b))
            new = n + s[hidden:] * (h - n)
            path.append((t, h, a, s, g[2 * hidden :], b, n))
            h = new
        kept.append((path, h))
    states = [np.empty((length, hidden, width)) for _ in range(2)]
    for d, (path, last) in enumerate(kept):
        for i, (t, *_rest) in enumerate(path):
            states[d][t] = path[i + 1][1] if i + 1 < length else last
    z = model.wo[0] @ states[0] + model.wo[1] @ states[1] + model.bo
    z = np.exp(z - z.max(axis=1, keepdims=True))
    z /= z.sum(axis=1, keepdims=True)
    z[:, y, np.arange(width)] -= 1
    z *= live[:, None, :] / max(1, live.sum())
    grads = {"tables": np.zeros_like(model.tables), "u": np.zeros_like(model.u), "wo": np.zeros_like(model.wo), "bo": z.sum(axis=(0, 2))[:, None]}
    for d, (path, _last) in enumerate(kept):
        grads["wo"][d] = np.einsum("tcb,thb->ch", z, states[d])
        carry = np.zeros((hidden, width))
        for t, h, a, s, gn, b, n in reversed(path):
            dh = carry + model.wo[d].T @ z[t]
            db = dh * (1 - s[hidden:]) / (1 + np.abs(b)) ** 2
            ds = np.concatenate([db * gn, dh * (h - n)]) * 0.5 / (1 + np.abs(a)) ** 2
            dg = np.concatenate([ds, db * s[:hidden]])
            np.add.at(grads["tables"][d].T, x[t], np.concatenate([ds, db]).T)
            grads["u"][d] += dg @ h.T
            carry = dh * s[hidden:] + model.u[d].T @ dg
    return grads


def sample(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = SAMPLE_PER_LANG, chars: int = SAMPLE_CHARS, langs: int = SAMPLE_LANGS, seed: int = 5) -> list[tuple[bytes, str]]:
    """At most per_lang windows of each of the `langs` most frequent languages, at hash-chosen places of hash-chosen documents.

    A first pass over the narrow columns counts the documents of each language; a threshold on the hash then leaves a few
    times per_lang rows of any language before they are ranked, however large it is. The windows are all that the driver
    gets. Languages beyond the bound (labels that are no languages, say) are not learned; null labels and texts neither.
    """
    rows = docs.select(column(text).alias("_t"), column(lang).alias("_l"), F.xxhash64(F.lit(seed), column(key), column(lang)).alias("_h")).where("_l is not null and _t is not null")
    counts = docs.select(column(lang).alias("_l")).where("_l is not null").groupBy("_l").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_l").limit(langs)
    few = rows.join(F.broadcast(counts), "_l").where(F.pmod("_h", F.lit(1_000_000)) * F.col("_n") < F.lit(4 * per_lang * 1_000_000))
    at = F.pmod(F.xxhash64("_h"), F.greatest(F.length("_t") - chars, F.lit(0)) + 1)
    few = few.select("_l", "_h", F.expr("_t").substr((at + 1).cast("int"), F.lit(chars)).alias("_w"))
    best = few.withColumn("_r", F.row_number().over(Window.partitionBy("_l").orderBy("_h", "_w"))).where(F.col("_r") <= per_lang)
    return [(r[1].encode(), r[0]) for r in best.select("_l", "_w").collect() if r[1]]


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score to the columns `keep` of docs (None: all).

    lang_pred: the language of the largest pooled probability, ties by name; 'und' if the text is null or has no letter, or
    if the model knows no language. score: that probability, 0 for 'und'. Columns of docs with these names are replaced,
    whatever their case; repeated rows stay; an empty table gives an empty result.
    """
    own = Carried(docs, keep, ("lang_pred", "score"))
    inner = docs.select(*own.into(), column(text).alias("_text"), F.coalesce(column(text).rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    schema = T.StructType([*own.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, "_text"):
            has = np.array(part.column(part.schema.get_field_index("_letters")).to_pylist(), bool) & bool(model.langs)
            probs = pool(model, texts) if model.langs else np.zeros((len(texts), 1))
            best = probs.argmax(axis=1)
            score = np.clip(probs[np.arange(len(texts)), best], 0, 1) * has
            lang = [model.langs[k] if ok else UNDETERMINED for k, ok in zip(best, has)]
            yield pa.RecordBatch.from_arrays([*own.of(part), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return inner.mapInArrow(label, schema).select(*own.back(), "lang_pred", "score")
