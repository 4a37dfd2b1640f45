"""Ranked lexical search: an automaton of all items' terms counts them in the documents' texts, without an index of documents."""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docstruct.llm.scratch import stage
from docstruct.llm.textbatch import column, steps

#: Terms are runs of characters other than these ASCII ones; of letters only A to Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of terms in one automaton; items beyond it are searched block by block, each by a scan of its own.
BLOCK_BYTES = 8_000_000
#: Scores that a task holds at once, and best rows after which it forgets all but the first of each item.
CELLS, KEPT = 1_000_000, 200_000
#: Parts in which an item's best rows are chosen before they meet.
PARTS = 32
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def folded(text: bytes) -> bytes:
    """Lower-cased UTF-8 bytes in which every character between terms is a blank."""
    return text.translate(_FOLD)


@dataclass
class Matcher:
    """Automaton over the bytes of guarded terms, and the items that hold each term."""

    terms: list[bytes]
    automaton: ahocorasick.Automaton

    @staticmethod
    def of(terms: Iterable[bytes]) -> Matcher:
        """terms: distinct and folded. A blank on both sides guards each, so that it matches whole terms alone."""
        terms = list(terms)
        automaton = ahocorasick.Automaton()
        for k, t in enumerate(terms):
            automaton.add_word(f" {t.decode('latin-1')} ", k)
        automaton.make_automaton()
        return Matcher(terms, automaton)

    def counts(self, text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """(terms of the text with repeats, numbers of the matcher's terms in it, their occurrences)."""
        body = folded(text)
        n = len(body.split())
        if not n or not self.terms:
            return n, np.zeros(0, np.int64), np.zeros(0, np.int64)
        # a single blank ends one term and begins the next: matches may share it
        found = Counter(k for _, k in self.automaton.iter(f" {body.decode('latin-1')} "))
        return n, np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))


_matchers: dict[str, Matcher] = {}


def _matcher(name: str, terms) -> Matcher:
    """The matcher of a broadcast list of terms; a worker keeps the last one."""
    if name not in _matchers:
        _matchers.clear()
        _matchers[name] = Matcher.of(terms.value)
    return _matchers[name]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def statistics(docs: DataFrame, name: str, terms, size: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, terms in all of them, documents that hold each of the matcher's terms): one scan, a row of sums for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(name, terms)
        n_docs, n_terms, df = 0, 0, np.zeros(size, np.int64)
        for _, texts in steps(batches, "_text"):
            for t in texts:
                n, found, _ = matcher.counts(t)
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
                df[found] += 1
        held = np.flatnonzero(df)
        if n_docs:
            yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *held.tolist()], pa.int64()), pa.array([n_docs, n_terms, *df[held].tolist()], pa.int64())], names=["term", "n"])

    sums = docs.select("_text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = dict(map(tuple, sums.collect()))
    return found.pop(-2, 0), found.pop(-1, 0), np.array([found.get(k, 0) for k in range(size)], np.int64)


class Best:
    """The rows of highest score of each item; equal scores by ascending key, a null key last."""

    def __init__(self, top: int):
        self.top, self.held = top, 0
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.least: dict[int, int] | np.ndarray = {}

    def add(self, item: np.ndarray, score: np.ndarray, null: np.ndarray, key: np.ndarray) -> None:
        self.parts.append((item, score, null, key))
        self.held += len(item)

    def rows(self) -> tuple[np.ndarray, ...]:
        """What is best so far, by item; all else is forgotten."""
        if not self.parts:
            return tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64))
        item, score, null, key = map(np.concatenate, zip(*self.parts))
        order = np.lexsort((key, null, -score, item))
        item, score, null, key = item[order], score[order], null[order], key[order]
        place = np.arange(len(item)) - np.searchsorted(item, item, side="left")
        kept = place < self.top
        rows = item[kept], score[kept], null[kept], key[kept]
        self.parts, self.held = [rows], len(rows[0])
        return rows


def scored(docs: DataFrame, name: str, terms, plan, top: int) -> DataFrame:
    """(_item, score, key): each task's best rows of each item, scored from the text.

    plan: a broadcast (documents, terms in all, weights, starts, items): the items of term k are items[starts[k]:starts[k + 1]].
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(name, terms)
        n_docs, n_terms, weights, starts, items, n_items = plan.value
        best, least = Best(top), np.zeros(n_items, np.int64)
        rows_at_once = max(1, CELLS // max(n_items, 1))
        for part, texts in steps(batches, "_text"):
            keys = part.column(0)
            null = np.asarray(keys.is_null())
            number = np.asarray(keys.fill_null(0), np.int64)
            for low in range(0, len(texts), rows_at_once):
                some = texts[low : low + rows_at_once]
                scores = np.zeros((len(some), n_items), np.int64)
                for row, text in enumerate(some):
                    n, found, tf = matcher.counts(text)
                    if not len(found):
                        continue
                    m = 100 - 50 + (50 * n * n_docs) // n_terms
                    gain = weights[found] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
                    many = starts[found + 1] - starts[found]
                    at = np.repeat(starts[found] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    np.add.at(scores[row], items[at], np.repeat(gain, many))
                row, item = np.nonzero((scores > 0) & (scores >= least))
                best.add(item, scores[row, item], null[low + row], number[low + row])
                if best.held > max(KEPT, 4 * top * n_items):
                    item, score, _, _ = best.rows()
                    full = np.bincount(item, minlength=n_items) >= top
                    last = np.zeros(n_items, np.int64)
                    last[item] = score  # rows come by falling score
                    least = np.where(full, last, 0)
        item, score, null, key = best.rows()
        for low in range(0, len(item), 10_000):
            cut = slice(low, low + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(item[cut]), pa.array(score[cut]), pa.array(key[cut], mask=null[cut])], names=["_item", "score", "_key"])

    return docs.mapInArrow(run, "_item long, score long, _key long")


def search(docs: DataFrame, items: DataFrame, top: int = 50, text: str = "text", key: str = "doc_id", item_text: str = "text", item: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, rank int, key, score long): each item's `top` documents of highest score above 0, equal scores by ascending key.

    An item's terms are those of its text, once each. A term's weight w is floor(1000 * ln((2N + 2) / (2 df + 1))), N the
    documents with a term, df those that hold it; a document of n terms has m = 50 + 50 n N div L, L all terms of all
    documents; its score sums w * (10^9 tf div (1000 tf + 20 m)) over the item's terms. Every whole text is read twice: a
    scan by the automaton for N, L and df, then one that counts again and scores. A task keeps the best rows of each item
    only, and an item's tasks meet in PARTS parts first, so that what is shuffled is bounded by tasks, items and `top`.

    Items are dealt by hash into blocks of about block_bytes bytes of terms, each with two scans of its own, so that the
    broadcast automaton is bounded whatever the number of items.

    key is an integer column. Null and empty texts and items hold no term and have no row; repeated rows of docs are
    documents of their own and count each; rows that repeat an item are one item with the terms of all, a null item is an
    item; a null key comes after all others of its score. An empty table on either side gives an empty result.
    """
    spark = docs.sparkSession
    own = docs.select(column(key).cast("long").alias("_key"), column(text).alias("_text"))
    words = F.regexp_extract_all(F.translate(column(item_text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(f"({TERM})"), F.lit(1))
    held = stage(items.select(column(item).alias("_name"), F.explode(words).alias("_term")).distinct(), "item_terms")
    size = held.agg(F.sum(F.octet_length("_term") + 2)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    out = None
    for block in range(blocks):
        some = held.where(F.pmod(F.xxhash64("_name"), F.lit(blocks)) == block) if blocks > 1 else held
        pairs = some.collect()  # bounded by block_bytes
        names = list(dict.fromkeys(p[0] for p in pairs))
        number = {n: k for k, n in enumerate(names)}
        postings: dict[str, list[int]] = {}
        for p in pairs:
            postings.setdefault(p[1], []).append(number[p[0]])
        terms = sorted(postings)
        name = uuid.uuid4().hex
        shared = spark.sparkContext.broadcast([t.encode() for t in terms])
        n_docs, n_terms, df = statistics(own, name, shared, len(terms))
        weights = np.array([weight(n_docs, int(d)) for d in df], np.int64)
        starts = np.cumsum([0, *(len(postings[t]) for t in terms)]).astype(np.int64)
        plan = spark.sparkContext.broadcast((n_docs, n_terms, weights, starts, np.array([i for t in terms for i in postings[t]], np.int64), len(names)))
        rows = scored(own, name, shared, plan, top)
        named = spark.createDataFrame([(k, n) for k, n in enumerate(names)], T.StructType([T.StructField("_item", T.LongType()), T.StructField("_name", held.schema["_name"].dataType)]))
        order = [F.col("score").desc(), F.col("_key").asc_nulls_last()]
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("_key"), F.lit(PARTS)))
        for by in (["_item", "_part"], ["_item"]):
            rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
        rows = rows.join(named, "_item").select(F.col("_name").alias(item), F.col("rank").cast("int").alias("rank"), F.col("_key").alias(key), "score")
        out = rows if out is None else out.union(rows)
    return out


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
c AS (SELECT count(*)::BIGINT AS nd, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
w AS (SELECT r, doc_id, len(ts)::BIGINT AS n, unnest(ts) AS t FROM d),
f AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, t, count(*)::BIGINT AS tf FROM w WHERE t IN (SELECT t FROM q) GROUP BY r, t),
i AS (SELECT t, floor(1000 * ln((2 * (SELECT nd FROM c) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f GROUP BY t),
s AS (SELECT q.item_id, r, any_value(doc_id) AS doc_id,
             sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * (SELECT nd FROM c)) // (SELECT l FROM c)))))::BIGINT AS score
      FROM q JOIN f USING (t) JOIN i USING (t) GROUP BY q.item_id, r),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM k WHERE rank <= 50
"""
