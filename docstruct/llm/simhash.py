"""Near-duplicates by SimHash and meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docstruct.llm.components import connected_components
from docstruct.llm.scratch import stage
from docstruct.llm.textbatch import Carried, column, steps

WORDS, RADIUS, SEED = 3, 2, 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens_of(text: bytes) -> list[bytes]:
    """Lower-cased words; bytes.split() takes exactly the blanks 0x20 and 0x09 to 0x0D."""
    return text.translate(_LOWER).split()


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Hash of each run of so many lower-cased words; of the whole where there are no more, of nothing where there are none."""
    tokens = tokens_of(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    whole = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
    ends = np.cumsum(sizes)
    starts, n = ends - sizes, len(tokens) - words + 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[a:b], SEED) for a, b in zip(starts[:n].tolist(), (ends[words - 1 :] - 1).tolist())), np.uint64, n)


def fingerprint_of(hashes: np.ndarray) -> int:
    """64-bit fingerprint: the bits that over half the hashes have, 0 of none."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def simhash(text: bytes, words: int = WORDS) -> int:
    """64-bit fingerprint of the text's shingles."""
    return fingerprint_of(shingles(text, words))


def fingerprints(docs: DataFrame, text: str = "text", keep: list[str] | None = None, words: int = WORDS) -> DataFrame:
    """Add fp (long: the fingerprint's bits) to the columns `keep` of docs (None: all). Null and empty texts get 0; a column named fp is replaced."""
    own = Carried(docs, keep, ("fp",))
    schema = T.StructType([*own.fields, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, "_text"):
            fp = np.fromiter((simhash(t, words) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*own.of(part), pa.array(fp)], names=schema.names)

    return docs.select(*own.into(), column(text).alias("_text")).mapInArrow(run, schema).select(*own.back(), "fp")


def ball(fp: Column, radius: int) -> Column:
    """Array of all values within `radius` differing bits."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(64), k)]
    return F.array(*(fp.bitwiseXOR(F.lit(m if m < 1 << 63 else m - (1 << 64))) for m in masks))


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all pairs within `radius` differing bits.

    Two fingerprints within an even radius share a variant within half of it. All that share one lie within the radius of
    each other, so that a chain through them, in order, connects what their pairs would. With half a radius of 1 a
    variant has at most 65 fingerprints, whatever the data. Each link is verified.
    """
    if radius % 2:
        raise ValueError("the radius must be even")
    near = nodes.select("fp", F.explode(ball(F.col("fp"), radius // 2)).alias("_variant"))
    chained = near.withColumn("_prev", F.lag("fp").over(Window.partitionBy("_variant").orderBy("fp")))
    return chained.where(F.col("_prev").isNotNull() & (F.bit_count(F.col("fp").bitwiseXOR(F.col("_prev"))) <= radius)).select(F.col("_prev").alias("a"), F.col("fp").alias("b"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(key, fp, component_id) of each row: component_id is the least key of the documents reachable over links.

    Equal fingerprints are one node, so that copies never meet each other. Null keys have no say in component_id (null if
    no key of the component is known); empty and null texts all have fingerprint 0 and are linked like others; repeated
    rows stay; an empty table gives an empty result. The last join meets rows by fingerprint: a hot one is split by
    adaptive execution, as both sides come from exchanges.
    """
    printed = stage(fingerprints(docs.select(column(key).alias("_key"), column(text).alias("_body")), "_body", ["_key"], words), "fingerprints")
    every = components_of(printed, radius)
    return printed.join(every, "fp").select(F.col("_key").alias(key), "fp", "component_id")


def components_of(printed: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, component_id) of the fingerprints of rows (_key, fp)."""
    nodes = stage(printed.groupBy("fp").agg(F.min("_key").alias("low")), "nodes")
    found = connected_components(links(nodes, radius))
    members = stage(nodes.join(found, nodes["fp"] == found["node"], "inner").select("fp", "root", "low"), "members")
    lows = members.groupBy("root").agg(F.min("low").alias("component_id"))
    own = stage(members.join(lows, "root").select("fp", "component_id"), "classes")
    return stage(nodes.join(own, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")), "components")
