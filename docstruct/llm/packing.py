"""Packing documents into training sequences by shortest-pack-first over the histogram of lengths."""

from __future__ import annotations

import heapq
import json
import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docstruct.llm.scratch import stage
from docstruct.llm.textbatch import Carried, column, steps

CAPACITY, END_ID = 2048, 1
#: Columns of a piece, and of its place.
CUT, PLACE = ("start", "length", "ids_crc32", "doc_tokens"), ("sequence_id", "offset")
#: Pieces of one bucket of a length, for ranks; a larger table has more buckets.
BUCKET_ROWS = 20_000
_BLANKS, _MANY_BLANKS = re.compile(r"\s\s"), re.compile(r"(?<!\s)\s{1000}")
#: The split of byte-level BPE into words, as both libraries publish it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_coders: dict[str, Coder] = {}


def _ranked(path: str):
    """The same vocabulary by rank, without and with look-ahead, or None if the file's merges do not make its ids in order."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    vocab, merges = model["model"]["vocab"], model["model"].get("merges", [])
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    decode = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
    if model["pre_tokenizer"].get("type") != "ByteLevel" or model.get("normalizer") or [vocab.get(m) for m in joined] != list(range(256, 256 + len(joined))) or set(decode) - set(vocab):
        return None
    ranks = {bytes(decode[c] for c in token): i for token, i in vocab.items() if i < 256 + len(joined)}
    return [tiktoken.Encoding("ranked", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (WORDS.replace(r"\s+(?!\S)|", ""), WORDS)]


class Coder:
    """Token ids of texts as little-endian 32-bit bytes, equal to the tokenizer's own.

    Where the file's merges are its ids in order, texts are encoded by rank, which gives the same ids in a third of the
    time; other files, and texts with added tokens, go to the tokenizer itself. Only texts with two adjacent blanks need
    the split's look-ahead, which costs a fifth more; its stack overflows on very long runs of blanks, so that texts with
    a thousand adjacent ones go to the tokenizer too.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_rank = _ranked(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        blanks = bool(_BLANKS.search(text))
        if self.by_rank is None or "<" in text and any(x in text for x in self.added) or blanks and _MANY_BLANKS.search(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.by_rank[blanks].encode_ordinary(text)
        return array("I", ids).tobytes()


def coder(path: str) -> Coder:
    """One for each worker process."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def pieces(docs: DataFrame, tokenizer: str, own: Carried, text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids (with END_ID at their end) at multiples of capacity: the carried columns under inner names, start, length, ids_crc32, doc_tokens, and ids if asked for."""
    more = [T.StructField(c, T.LongType()) for c in CUT]
    schema = T.StructType([*own.fields, *more, *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        this = coder(tokenizer)
        for part, texts in steps(batches, "_text", 2 << 20):
            coded = [this.encode(t.decode()) + end for t in texts]
            at, rows, ids = [], [], []
            for i, x in enumerate(coded):
                for start in range(0, len(x), 4 * capacity):
                    piece = x[start : start + 4 * capacity]
                    at.append(i)
                    rows.append((start // 4, len(piece) // 4, zlib.crc32(piece), len(x) // 4))
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
            columns = np.array(rows, np.int64).reshape(-1, 4)
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(x.take(where) for x in own.of(part)), *(pa.array(columns[:, k]) for k in range(4)), *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else [])], names=schema.names)

    return docs.select(*own.into(), column(text).alias("_text")).mapInArrow(run, schema)


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """(packs, their lengths in order). Lengths are placed longest first, each into the packs with most room that fit it.

    Works on counts of like packs, so that its cost and its result depend on the distinct lengths and not on the documents.
    """
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    rooms: list[int] = []

    def put(count: int, pack: tuple[int, ...], room: int) -> None:
        if room not in open_packs:
            open_packs[room] = []
            heapq.heappush(rooms, -room)
        open_packs[room].append((count, pack))

    for length in sorted(histogram, reverse=True):
        left, later = histogram[length], []
        while left > 0:
            if rooms and -rooms[0] >= length:
                room = -rooms[0]
                count, pack = open_packs[room].pop()
                if not open_packs[room]:
                    heapq.heappop(rooms)
                    del open_packs[room]
                used = min(count, left)
                left -= used
                if count > used:
                    put(count - used, pack, room)
                later.append((used, (*pack, length), room - length))
                if room - length >= length and not (rooms and -rooms[0] > room - length):
                    put(*later.pop())
            else:
                if later:  # what this length has begun counts as open for it too
                    for x in later:
                        put(*x)
                    later = []
                    continue
                fit = capacity // length
                if left >= fit:
                    put(left // fit, (length,) * fit, capacity - fit * length)
                    left %= fit
                else:
                    put(1, (length,) * left, capacity - left * length)
                    left = 0
        for x in later:
            put(*x)
    return sorted(x for group in open_packs.values() for x in group)


def _ranges(packs: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (length << 44 | first rank), with the first sequence and the offset of each run of ranks."""
    used: dict[int, int] = {}
    keys, sequences, offsets = [], [], []
    first = 0
    for count, lengths in packs:
        offset = 0
        for length in lengths:
            keys.append(length << 44 | used.get(length, 0))
            used[length] = used.get(length, 0) + count
            sequences.append(first)
            offsets.append(offset)
            offset += length
        first += count
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    return tuple(np.array(x, np.int64)[order] for x in (keys, sequences, offsets))


def place(cut: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to the pieces (key, length, start, ids_crc32, and more): patterns meet the pieces of a length by rank.

    Ranks are dealt in two levels, by (length, bucket) and within it, so that no length or group of copies meets in one
    task. The histogram (at most `capacity` rows) and the patterns are all that passes the driver; their number depends on
    the distinct lengths and saturates (near 3,000 patterns for any number of pieces).
    """
    total = cut.count()
    salt = F.xxhash64(column(key), "start", "ids_crc32")
    named = cut.select("*", salt.alias("_hash"), F.pmod(salt, F.lit(max(1, math.ceil(total / BUCKET_ROWS)))).cast("int").alias("_bucket"))
    counts = stage(named.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    sent = cut.sparkSession.sparkContext.broadcast(_ranges(shortest_pack_first(histogram, capacity)))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).drop("_n")
    before = stage(before, "ranks")
    ranked = named.withColumn("_at", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_hash", column(key), "start", "ids_crc32")))
    ranked = ranked.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_at") - 1)
    names = list(cut.columns)
    schema = T.StructType([*cut.schema.fields, *(T.StructField(c, T.LongType()) for c in PLACE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sequences, offsets = sent.value
        for part in batches:
            length, rank = (part.column(part.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            sequence = sequences[at] + rank - (keys[at] & ((1 << 44) - 1))
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(sequence), pa.array(offsets[at])], names=schema.names)

    return ranked.select(*map(column, names), "_rank").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", keep: list[str] | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece: the columns `keep` of docs (None: the key), start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if asked for.

    Null texts are empty; an empty text is END_ID alone. Documents longer than capacity give full sequences and a rest.
    Repeated rows and null keys are documents of their own; columns named like a result are replaced, whatever their case;
    an empty table gives an empty result. Nothing is padded here; a sequence's pieces stand gapless from 0.
    """
    added = (*CUT, *PLACE, "ids")
    own = Carried(docs, [key, *([] if keep is None else keep)], added)
    cut = stage(pieces(docs, tokenizer, own, text, capacity, with_ids), "pieces")
    placed = place(cut, own.inner[own.names.index(key)], capacity)
    wanted = [F.col(i).alias(c) for i, c in zip(own.inner, own.names) if keep is None or c in keep]
    return placed.select(*wanted, *CUT, *(["ids"] if with_ids else []), *PLACE)
