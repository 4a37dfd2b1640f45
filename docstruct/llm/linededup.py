"""Line dedup by a sharded minimal perfect hash over the distinct line keys.

A shard is a cascade of bit arrays that sends its keys to 0 .. n-1 without gaps, beside an array of 32-bit fingerprints
and one of counts. Lines ask the shard of their key's hash; they never join other lines.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstruct.llm.scratch import stage
from docstruct.llm.textbatch import Carried, column, steps

#: Keys of a shard; lines that ask one copy of a shard. Both bound a task's memory and set no limit on the result.
SHARD_KEYS, ASK_ROWS = 200_000, 200_000
BLANKS = b" \t\n\x0b\x0c\r"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def line_key(line: bytes, min_chars: int = 1) -> bytes | None:
    """128-bit hash of the stripped, lower-cased line; None if it is shorter than min_chars code points."""
    key = line.strip(BLANKS).translate(_LOWER)
    return xxhash.xxh3_128_digest(key) if key and (min_chars <= 1 or len(key.decode()) >= min_chars) else None


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _place(a: np.ndarray, b: np.ndarray, level: int, bits: int) -> np.ndarray:
    x = (a + np.uint64(level) * b) ^ (a >> np.uint64(29))
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return (x ^ (x >> np.uint64(32))) % np.uint64(bits)


def _fingerprint(b: np.ndarray) -> np.ndarray:
    return ((b * _M1) >> np.uint64(32)).astype(np.uint32)


class Shard:
    """Minimal perfect hash of distinct 128-bit keys with a fingerprint and a count at each index."""

    def __init__(self, levels: list[np.ndarray], sizes: list[int], prints: np.ndarray, counts: np.ndarray):
        self.levels, self.sizes, self.prints, self.counts = levels, sizes, prints, counts
        each = [np.bitwise_count(x).astype(np.int64) for x in levels]
        ends = np.cumsum([x.sum() for x in each])
        self.ranks = [np.cumsum(x) - x + end - x.sum() for x, end in zip(each, ends)]

    @classmethod
    def build(cls, keys: list[bytes], counts: np.ndarray, spare: float = 1.6) -> Shard:
        a, b = _halves(keys)
        levels, sizes = [], []
        while len(a):
            if len(levels) > 200:
                raise ValueError("keys repeat")
            bits = max(64, int(len(a) * spare) + 63 & ~63)
            at = _place(a, b, len(levels), bits).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(bits)
            left = ~alone[at]
            a, b = a[left], b[left]
        shard = cls(levels, sizes, np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint32))
        a, b = _halves(keys)
        where = shard.index(a, b)
        shard.prints[where] = _fingerprint(b)
        shard.counts[where] = np.minimum(counts, 0xFFFFFFFF)
        return shard

    def index(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """0 .. n-1 of keys of the set; of others any index, or -1."""
        found = np.full(len(a), -1, np.int64)
        rest = np.arange(len(a))
        for level, (words, bits, ranks) in enumerate(zip(self.levels, self.sizes, self.ranks)):
            at = _place(a[rest], b[rest], level, bits)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            found[rest[hit]] = ranks[word[hit]] + below
            rest = rest[~hit]
        return found

    def count(self, keys: list[bytes]) -> np.ndarray:
        """Of each key; 0 where the fingerprint tells that the key is not in the set."""
        a, b = _halves(keys)
        where = self.index(a, b)
        known = where >= 0
        known[known] = self.prints[where[known]] == _fingerprint(b[known])
        out = np.zeros(len(keys), np.int64)
        out[known] = self.counts[where[known]]
        return out

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, sizes=np.array(self.sizes, np.int64), words=np.concatenate([*self.levels, np.zeros(0, np.uint64)]), prints=self.prints, counts=self.counts)
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> Shard:
        got = np.load(io.BytesIO(data), allow_pickle=False)
        sizes = got["sizes"].tolist()
        levels = np.split(got["words"], np.cumsum([n // 64 for n in sizes])[:-1]) if sizes else []
        return cls(levels, sizes, got["prints"], got["counts"])


def line_keys(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """(t1, t2, key): the distinct line keys of each row's text; t1 and t2 are hashes that name the text."""
    schema = T.StructType([T.StructField("t1", T.LongType()), T.StructField("t2", T.LongType()), T.StructField("key", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, "_text"):
            rows = [{k for k in (line_key(x, min_chars) for x in t.split(b"\n")) if k} for t in texts]
            at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), part.column(1).take(pa.array(at)), pa.array([k for r in rows for k in r], pa.binary())], names=["t1", "t2", "key"])

    return docs.select("t1", "t2", F.col(text).alias("_text")).mapInArrow(run, schema)


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """(shard, blob) from (key, n); a shard's keys are near SHARD_KEYS however many there are."""

    def build(table: pa.Table) -> pa.Table:
        shard = Shard.build(table["key"].to_pylist(), table["n"].to_numpy())
        return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "blob": pa.array([shard.dumps()], pa.binary())})

    return counts.withColumn("shard", shard_of(shards)).groupBy("shard").applyInArrow(build, "shard int, blob binary")


def shard_of(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def ask(lines: DataFrame, index: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """The (t1, t2, key) of lines whose key counts min_docs at least. A shard that many lines ask is copied, and its lines are dealt over the copies by their text."""
    asking = lines.distinct().withColumn("shard", shard_of(shards))
    copies = stage(asking.groupBy("shard").agg(F.ceil(F.count("*") / ASK_ROWS).cast("int").alias("copies")), "copies")
    dealt = asking.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("t1", "t2"), F.col("copies")).cast("int")).drop("copies")
    held = index.join(copies, "shard").select("shard", "blob", F.explode(F.expr("sequence(0, copies - 1)")).alias("copy"))

    def probe(asked: pa.Table, shard: pa.Table) -> pa.Table:
        if not asked.num_rows or not shard.num_rows:
            return asked.select(["t1", "t2", "key"]).slice(0, 0)
        counts = Shard.loads(shard["blob"][0].as_py()).count(asked["key"].to_pylist())
        return asked.select(["t1", "t2", "key"]).filter(pa.array(counts >= min_docs))

    return dealt.groupBy("shard", "copy").cogroup(held.groupBy("shard", "copy")).applyInArrow(probe, "t1 long, t2 long, key binary")


def drop_common_lines(docs: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1, keep: list[str] | None = None) -> DataFrame:
    """docs without the lines whose key stands in at least min_docs rows, with n_lines and n_dropped (long) added to the columns `keep` (None: all).

    A row counts once for a key however often it has the line; repeated rows count each. The text column is replaced;
    null and empty texts are one empty line, whose key has no code points and stays: both give an empty text. Rows that
    lose all lines keep an empty text. Only rows that lose lines are rebuilt. Columns named like a result are replaced,
    whatever their case; an empty table gives an empty result.
    """
    kept = Carried(docs, keep, ("n_lines", "n_dropped", text))
    body = column(text)
    own = docs.select(*kept.into(), body.alias("_text"), F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2"))
    lines = stage(line_keys(own, "_text", min_chars), "lines")
    counts = stage(lines.groupBy("key").agg(F.count("*").alias("n")), "counts")
    shards = max(1, math.ceil(counts.count() / SHARD_KEYS))
    index = stage(build_index(counts, shards), "index")
    common = ask(lines, index, shards, min_docs).groupBy("t1", "t2").agg(F.collect_list("key").alias("_drop"))
    common = stage(common, "common")
    schema = T.StructType([*kept.fields, T.StructField("_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, "_text"):
            left_over, n_lines, n_dropped = [], [], []
            for t, drop in zip(texts, part.column(part.schema.get_field_index("_drop")).to_pylist()):
                n_lines.append(t.count(b"\n") + 1)
                if drop:
                    gone = set(drop)
                    left = [x for x in t.split(b"\n") if line_key(x, min_chars) not in gone]
                    n_dropped.append(n_lines[-1] - len(left))
                    t = b"\n".join(left)
                else:
                    n_dropped.append(0)
                left_over.append(t)
            yield pa.RecordBatch.from_arrays([*kept.of(part), pa.array(left_over, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=schema.names)

    joined = own.join(common, ["t1", "t2"], "left").select(*kept.inner, "_text", "_drop")
    out = joined.mapInArrow(rebuild, schema)
    at = dict(zip(kept.names, kept.back())) | {text: F.col("_text").alias(text)}
    order = [c for c in (docs.columns if keep is None else [*keep, text]) if c in at]
    return out.select(*(at[c] for c in dict.fromkeys(order)), "n_lines", "n_dropped")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT id, string_split(t, chr(10)) AS ls FROM d)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT id) >= 10),
s AS (SELECT id, count(*)::BIGINT AS n_lines, count(*) FILTER (c.key IS NOT NULL)::BIGINT AS n_dropped,
             coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.key IS NULL), '') AS kept
      FROM k LEFT JOIN c USING (key) GROUP BY id)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN s USING (id)
"""
