"""Near-duplicates at a Jaccard similarity of shingles, the pipeline's use of the SimHash operator.

Candidates are the operator's ball links between five-word fingerprints and, as texts of similarity 0.8 lie some ten bits
apart, where no ball of the operator's can reach, pairs that share a MinHash band. All are verified by the exact similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstruct.llm.components import connected_components
from docstruct.llm.scratch import stage
from docstruct.llm.simhash import fingerprint_of, links, shingles, tokens_of
from docstruct.llm.textbatch import column, steps

#: Words of a shingle, and the least similarity of near copies.
WORDS, SIMILAR = 5, 0.8
#: Bands of ROWS minima: a pair of similarity 0.8 shares one with a probability of 1 - (1 - 0.8 ** ROWS) ** BANDS = 0.99993, more similar ones more often.
BANDS, ROWS = 24, 5
#: Members of a bucket that all of it meet, before those that are still apart meet each other.
STARS = 4
#: Cells of the coarse bitmap of shingles, and members of a crowded bucket's block; blocks meet each other on tasks of their own.
CELLS, BLOCK = 1024, 1000
_RANDOM = np.random.default_rng(42)
_TIMES = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def _same(text: bytes) -> bytes:
    """Digest of the lower-cased words, equal where the words are."""
    return xxhash.xxh3_128_digest(b" ".join(tokens_of(text)))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """(set, BANDS) int64: hashes of each set's bands; no set may be empty."""
    points = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.zeros((len(sets), BANDS), np.uint64)
    for k in range(BANDS * ROWS):
        least = np.minimum.reduceat((points ^ _FLIP[k]) * _TIMES[k], starts)
        code = (out[:, k // ROWS] + np.uint64(k + 1) ^ least) * np.uint64(0x9E3779B97F4A7C15)
        out[:, k // ROWS] = code ^ code >> np.uint64(29)
    return out.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two arrays of distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _named(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(low, _text): a struct that names each row's key and text, and the text."""
    body = column(text)
    return docs.select(F.struct(column(key).alias("key"), F.xxhash64(body).alias("t1"), F.xxhash64(F.lit(1), body).alias("t2")).alias("low"), body.alias("_text"))


def sketches(named: DataFrame, words: int) -> DataFrame:
    """(low, same, n, fp, bands): digest of the words, number of distinct shingles, fingerprint, hashes of the bands (none for texts without words)."""
    schema = T.StructType([named.schema["low"], T.StructField("same", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, "_text"):
            every = [shingles(t, words) for t in texts]
            fp = np.fromiter(map(fingerprint_of, every), np.uint64, len(texts)).view(np.int64)
            sets = [np.unique(s) for s in every]
            has = [i for i, s in enumerate(sets) if len(s)]
            found: list = [[]] * len(texts)
            if has:
                for i, row in zip(has, bands([sets[i] for i in has]).tolist()):
                    found[i] = row
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(_same, texts), pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array(fp), pa.array(found, pa.list_(pa.int64()))], names=schema.names)

    return named.mapInArrow(run, schema)


def shingle_sets(named: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(same, set): the distinct shingles' hashes of each digest in wanted (low, same), read from the text that low names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in steps(batches, "_text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.unique(shingles(t, words)).tobytes() for t in texts], pa.binary())], ["same", "set"])

    texts = named.join(wanted, "low").dropDuplicates(["same"]).select("same", "_text")
    return texts.mapInArrow(run, "same binary, set binary")


def ball_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b): digests that the operator's ball links join, and those of equal fingerprints with the least of them."""
    prints = stage(nodes.where("n > 0").groupBy("fp").agg(F.min("same").alias("rep")), "prints")
    equal = nodes.join(prints, "fp").where("same <> rep").select(F.col("rep").alias("a"), F.col("same").alias("b"))
    first, second = (prints.select(F.col("fp").alias(c), F.col("rep").alias(f"_{c}")) for c in ("a", "b"))
    near = links(prints.select("fp")).join(first, "a").join(second, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
    return equal.union(near)


def odd_cells(hashes: np.ndarray, cells: int) -> np.ndarray:
    """Whether each of `cells` cells (a power of two, by the hashes' first bits) holds an odd number of them, as longs."""
    at = (hashes >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=cells) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def cells_for(n: int) -> int:
    """Cells of the fine bitmap of n shingles: at least two a shingle, so that cells seldom hide a difference; CELLS at least."""
    return max(CELLS, 1 << (2 * n - 1).bit_length())


def bitmaps(sets: DataFrame) -> DataFrame:
    """(same, bits, fine, half): the odd cells of a digest's shingles, coarse, and for sets that CELLS cells can't tell apart in cells_for(n) cells and in half as many.

    Two sets differ by at least as many shingles as their bits differ: an exact bound that costs a few machine words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            fine = [cells_for(len(x)) for x in own]
            columns = [[odd_cells(x, CELLS) for x in own]] + [[odd_cells(x, max(CELLS, m >> k)) if m > CELLS else [] for x, m in zip(own, fine)] for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.list_(pa.int64())) for c in columns)], names=["same", "bits", "fine", "half"])

    return sets.select("same", "set").mapInArrow(run, "same binary, bits array<long>, fine array<long>, half array<long>")


def differing() -> tuple[Column, Column]:
    """Bits in which bits and _bits differ, and those of the finest cells that both sides have (0 where the coarse ones are all)."""
    coarse = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("_bits")[i])) for i in range(CELLS // 64)), F.lit(0))
    own, other = F.size("fine"), F.size("_fine")
    pairs = F.zip_with(F.when(own <= other, F.col("fine")).otherwise(F.col("half")), F.when(other <= own, F.col("_fine")).otherwise(F.col("_half")), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    fine = F.when(F.least(own, other) > 0, F.aggregate(pairs, F.lit(0), lambda a, n: a + n)).otherwise(0)
    return coarse, fine


def verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The (a, b) of pairs whose sets are at least so similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(i)] for i in (2, 3))
            near = pa.array([similarity(p, q) >= similar for p, q in zip(x, y)], pa.bool_())
            yield batch.select(["a", "b"]).filter(near)

    left, right = sets.select(F.col("same").alias("a"), F.col("set").alias("_x")), sets.select(F.col("same").alias("b"), F.col("set").alias("_y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "_x", "_y").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """(low, component): for each row with a key a struct that names its key and text, and the least such struct of the documents reachable over pairs that are at least so similar.

    Texts of equal words are one node, so that copies never meet each other; all texts without words are one. Candidate
    pairs are verified unless they are connected already: ball links and each bucket's members with a few of them first,
    then all of a bucket that are still in different components and whose bitmaps don't rule it out, an exact bound that
    spares a large group of copies below the threshold most of its pairs. No bucket is cut and no similar pair left out.
    """
    named = _named(docs.where(column(key).isNotNull()), text, key)
    sketched = stage(sketches(named, words), "sketches")
    nodes = stage(sketched.groupBy("same").agg(F.min("low").alias("low"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    balls = stage(ball_pairs(nodes), "balls")
    buckets = stage(nodes.select("same", "n", F.explode("bands").alias("bucket")), "buckets")
    several = stage(buckets.groupBy("bucket").agg(F.count("*").alias("_many")).where("_many > 1").select("bucket"), "several")
    crowded = stage(buckets.join(several, "bucket"), "crowded")
    meeting = crowded.select("same").union(balls.select("a")).union(balls.select("b")).distinct()
    sets = stage(shingle_sets(named, nodes.join(meeting, "same").select("low", "same"), words), "sets")
    fits = F.least("n", "_n") >= similar * F.greatest("n", "_n") - 1e-6
    other = ["bucket", F.col("same").alias("_same"), F.col("n").alias("_n"), F.col("root").alias("_root")]
    # each bucket's members meet a few of them
    order = [F.xxhash64(F.lit(k), "bucket", "same") for k in range(STARS)]
    firsts = stage(crowded.groupBy("bucket").agg(F.array(*map(F.min, order)).alias("_orders")), "firsts")
    chosen = F.exists(F.arrays_zip("_orders", F.array(*order).alias("_own")), lambda x: x["_orders"] == x["_own"])
    some = crowded.withColumn("root", F.col("same")).join(firsts, "bucket").where(chosen).select(*other)
    pairs = crowded.join(stage(some, "some"), "bucket").where((F.col("same") != F.col("_same")) & fits)
    pairs = stage(pairs.select(F.least("same", "_same").alias("a"), F.greatest("same", "_same").alias("b")).union(balls).distinct(), "pairs")
    near = stage(verified(pairs, sets, similar), "near")
    roots = stage(connected_components(near), "roots")
    # those still apart meet all others of their bucket that their bitmaps allow
    rooted = stage(crowded.join(roots, crowded["same"] == roots["node"], "left").select("bucket", "same", "n", F.coalesce("root", "same").alias("root")), "rooted")
    sizes = rooted.groupBy("bucket", "root").agg(F.count("*").alias("_many"))
    mixed = sizes.groupBy("bucket").agg(F.max(F.struct("_many", "root")).alias("_top"), F.count("*").alias("_roots"), F.sum("_many").alias("_all")).where("_roots > 1")
    mixed = stage(mixed.select("bucket", F.col("_top.root").alias("_most"), F.ceil(F.col("_all") / BLOCK).cast("int").alias("_blocks")), "mixed")
    apart = stage(rooted.join(mixed, "bucket"), "apart")
    apart = stage(apart.join(stage(bitmaps(sets.join(apart.select("same").distinct(), "same")), "bitmaps"), "same"), "mapped")
    coarse, fine = differing()
    bound = (1 - similar) / (1 + similar) * (F.col("n") + F.col("_n")) + 1e-6
    # a crowded bucket is dealt in blocks: a row of block i stands for it against every block j
    block, every = F.pmod(F.xxhash64("same", F.lit(STARS)), "_blocks").cast("int"), F.expr("explode(sequence(0, _blocks - 1))")
    left = apart.withColumns({"_i": block, "_j": every}).drop("_most", "_blocks")
    rest = apart.where("root <> _most").withColumns({"_j": block, "_i": every}).select("_i", "_j", *other, *(F.col(c).alias(f"_{c}") for c in ("bits", "fine", "half")))
    more = left.join(rest, ["bucket", "_i", "_j"]).where((F.col("root") != F.col("_root")) & fits & (coarse <= bound) & (fine <= bound))
    more = more.select(F.least("same", "_same").alias("a"), F.greatest("same", "_same").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    roots = connected_components(near.union(stage(verified(stage(more, "more"), sets, similar), "nearer")))
    members = stage(nodes.join(roots, nodes["same"] == roots["node"], "left").select("same", F.coalesce("root", "same").alias("root"), "low"), "members")
    lows = members.groupBy("root").agg(F.min("low").alias("component"))
    own = stage(members.join(lows, "root").select("same", "component"), "classes")
    return sketched.join(own, "same").select("low", "component")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """docs with one document of each component: that of the least key and, where a key has several texts, of the text that its hash puts first.

    Of rows that repeat key and text one stays. Rows with a null key stay all, as nothing names them. Texts without words
    are one component. An empty table gives an empty result.
    """
    found = near_duplicates(docs, text, key, words, similar)
    chosen = stage(found.where("low = component").select("low.*").distinct(), "chosen")
    body = column(text)
    rows = docs.where(column(key).isNotNull()).withColumns({"_named1": F.xxhash64(body), "_named2": F.xxhash64(F.lit(1), body)})
    same = (rows[f"`{key}`"] == chosen["key"]) & (rows["_named1"] == chosen["t1"]) & (rows["_named2"] == chosen["t2"])
    kept = rows.join(chosen, same, "left_semi").dropDuplicates([key, "_named1", "_named2"]).drop("_named1", "_named2")
    return kept.union(docs.where(column(key).isNull()))
