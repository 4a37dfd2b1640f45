"""Filter interaction audit: what each filter removes in every order of application, by wide packed counters."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstruct.llm.scratch import stage
from docstruct.llm.textbatch import column, steps

#: Filters, each named by its bit's letter: A few words, B few different words, C many capitals, D symbols, E an earlier copy.
FILTERS = "ABCDE"
#: Bits of a field; a field holds a count of rows, or at most 120 times that.
FIELD = 64
#: Counts that each order and step has a field for.
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
#: Parts that a task sums at once; with more it sends what it has and goes on.
PARTS = 256
#: Tasks in which a part's sums meet before the last one.
MEETING = 32
_SYMBOL = re.compile(rb"[#$%&*|]")
_OTHER = bytes(b for b in range(256) if not 65 <= b <= 90)
#: Bytes that begin no character.
_LATER = bytes(range(128, 192))
#: Orders of application in the order of the alphabet.
ORDERS = ["".join(o) for o in itertools.permutations(FILTERS)]
GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text of UTF-8 bytes fails."""
    words = text.split()
    points = len(text.translate(None, _LATER))
    capitals = len(text.translate(None, _OTHER))
    fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * points, _SYMBOL.search(text) is not None)
    return sum(1 << k for k, f in enumerate(fails) if f)


def packed(code: int) -> int:
    """A row's big integer: a field for each order, step and outcome, 1 where the outcome is the row's.

    code: bits of the filters that the row fails, GOOD and TOXIC. Fields stand in the order of ORDERS, steps and OUTCOMES,
    the first in the lowest bits.
    """
    fails = code & (GOOD - 1)
    total = at = 0
    for order in ORDERS:
        before = 0
        for letter in order:
            own = 1 << FILTERS.index(letter)
            alive = not fails & before
            hit = bool(fails & own)
            gone = alive and hit
            row = (alive and not hit, gone, hit and not alive, fails == own, gone and bool(code & GOOD), gone and bool(code & TOXIC))
            for yes in row:
                total |= int(yes) << at
                at += FIELD
            before |= own
    return total


def unpacked(total: int) -> np.ndarray:
    """(orders, steps, outcomes) int64: the fields of a sum."""
    size = len(ORDERS) * len(FILTERS) * len(OUTCOMES)
    return np.frombuffer(total.to_bytes(size * FIELD // 8, "little"), "<i8").reshape(len(ORDERS), len(FILTERS), len(OUTCOMES))


def _as_rows(sums: dict[str, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()), pa.array([v.to_bytes((v.bit_length() + 7) // 8, "little") for v in sums.values()], pa.binary())], names=["part", "total"])


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, total) of (part, code) rows: rows of one code add its integer as often as they are many."""
    integers: dict[int, int] = {}
    sums: dict[str, int] = {}
    for batch in batches:
        for group in pa.Table.from_batches([batch]).group_by(["part", "code"]).aggregate([([], "count_all")]).to_pylist():
            code = group["code"]
            if code not in integers:
                integers[code] = packed(code)
            sums[group["part"]] = sums.get(group["part"], 0) + group["count_all"] * integers[code]
            if len(sums) > PARTS:
                yield _as_rows(sums)
                sums = {}
    if sums:
        yield _as_rows(sums)


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, total) of (part, total) rows sorted by part: each part's sum, one part at a time."""
    part, total = None, 0
    for batch in batches:
        for name, value in zip(*(c.to_pylist() for c in batch.columns)):
            if name != part and part is not None:
                yield _as_rows({part: total})
                total = 0
            part, total = name, total + int.from_bytes(value, "little")
    if part is not None:
        yield _as_rows({part: total})


def reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """600 rows of each part's sum; a filter's removals over all orders are the sum of its own fields."""
    removed = OUTCOMES.index("removed")
    for batch in batches:
        for part, value in zip(*(c.to_pylist() for c in batch.columns)):
            fields = unpacked(int.from_bytes(value, "little"))
            places = np.array([[FILTERS.index(x) for x in o] for o in ORDERS])
            shapley = np.array([fields[..., removed][places == k].sum() for k in range(len(FILTERS))])
            n = len(ORDERS) * len(FILTERS)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n), pa.array([o for o in ORDERS for _ in FILTERS]), pa.array([k + 1 for _ in ORDERS for k in range(len(FILTERS))], pa.int32()), *(pa.array(fields[..., k].ravel()) for k in range(len(OUTCOMES))), pa.array(shapley[places].ravel())],
                names=["part", "filter_order", "step", *OUTCOMES, "shapley"],
            )


def coded(docs: DataFrame, labels: DataFrame, text: str, key: str, part: str) -> DataFrame:
    """(part, code): bits of the filters a row fails and of its labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in steps(batches, "_text"):
            same = pa.array([xxhash.xxh3_128_digest(t) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), same, pa.array(map(failures, texts), pa.int32())], names=["_key", "part", "same", "fails"])

    own = docs.select(column(key).alias("_key"), F.coalesce(column(part).cast("string"), F.lit("")).alias("part"), column(text).alias("_text"))
    kind = own.schema["_key"].dataType.simpleString()
    rows = stage(own.mapInArrow(run, f"_key {kind}, part string, same binary, fails int"), "failures")
    # the first copy of each text, found by its text and key together: a hot text is no hot key of this join
    first = rows.groupBy("same").agg(F.min("_key").alias("_key")).where("_key IS NOT NULL").withColumn("_first", F.lit(True))
    marked = rows.where("_key IS NOT NULL").join(first, ["same", "_key"], "left")
    earlier = F.when(F.col("_first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    judged = labels.groupBy(column(key).alias("_key")).agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    bit = lambda c, value: F.when(F.col(c), value).otherwise(0)
    named = marked.join(judged, "_key", "left").select("part", (F.col("fails") + earlier + bit("_good", GOOD) + bit("_toxic", TOXIC)).cast("int").alias("code"))
    return named.union(rows.where("_key IS NULL").select("part", "fails"))


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    Filters judge each whole text: A under 100 words, B fewer than 80 different ones in 100, C more than 10 capitals A to Z
    in 100 code points, D any of #$%&*|, E an equal text under a smaller key anywhere in the table. labels: (key, quality,
    toxic), where 1 means good or toxic; of several rows of a key one such is enough, keys without a row are neither.

    A row's code selects a big integer with a 64-bit field for each order, step and outcome. Tasks add the integers of their
    rows, so that what meets is one integer for each task and part; no field overflows below 2^63 rows. Copies are
    told by a 128-bit hash of their bytes.

    Null texts are empty; a null part is the empty string; rows with a null key are no copies of others, nor are others of
    them; rows that repeat the least key of a text are all first; an empty table gives an empty result. Other columns are not read.
    """
    sums = coded(docs, labels, text, key, part).mapInArrow(summed, "part string, total binary")
    for salt in ([F.pmod(F.spark_partition_id(), F.lit(MEETING))], []):
        sums = sums.repartition("part", *salt).sortWithinPartitions("part").mapInArrow(met, "part string, total binary")
    counts = ", ".join(f"{c} long" for c in (*OUTCOMES, "shapley"))
    return sums.mapInArrow(reported, f"part string, filter_order string, step int, {counts}")


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY x) AS m FROM t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             [len(ws) < 100, 100 * len(list_distinct(ws)) < 80 * len(ws), 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 10 * length(x),
              regexp_matches(x, '[#$%&*|]'), coalesce(doc_id > m, false)] AS fails
      FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, good, toxic, fails, count(*)::BIGINT AS n FROM f GROUP BY ALL),
s AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM s a JOIN s b ON b.k <> a.k JOIN s c ON c.k NOT IN (a.k, b.k) JOIN s d ON d.k NOT IN (a.k, b.k, c.k) JOIN s e ON e.k NOT IN (a.k, b.k, c.k, d.k)),
p AS (SELECT part, n, good, toxic, fails, o, s.k AS step, fails[o[s.k]] AS hit,
             NOT list_bool_or(list_transform(o[1:s.k - 1], lambda i: fails[i])) AS alive0, s.k = 1 AS first
      FROM g, o, s),
q AS (SELECT *, first OR coalesce(alive0, true) AS alive FROM p),
r AS (SELECT part, o, step, sum(n) FILTER (alive AND NOT hit) AS kept, sum(n) FILTER (alive AND hit) AS removed,
             sum(n) FILTER (hit AND NOT alive) AS redundant,
             sum(n) FILTER (hit AND len(list_filter(fails, lambda b: b)) = 1) AS unique_fails,
             sum(n) FILTER (alive AND hit AND good) AS good_lost, sum(n) FILTER (alive AND hit AND toxic) AS toxic_lost
      FROM q GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, step::INTEGER AS step,
       coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, o[step]))::BIGINT AS shapley
FROM r
"""
