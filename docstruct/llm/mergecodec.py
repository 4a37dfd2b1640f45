"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking over longest matches."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstruct.llm.textbatch import Carried, as_bytes, column, steps

#: Bytes of one of two generations of units with their ids, and number of pairs, that a worker remembers; longer units than LONG characters are encoded each time.
REMEMBERED, PAIRS, LONG = 60_000_000, 400_000, 64
SPACE = "▁"
#: Texts whose normal form tells whether a model leaves texts as they are, but for blanks and the one in front.
PROBES = ("a", " a  b ", "Ａﬁ é\t½\n", "")


class Pieces:
    """Pieces of a merge-type model whose texts are only changed by a blank in front and by the mark for blanks."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        if any(model.normalize(t) != (SPACE + t.replace(" ", SPACE) if t else "") for t in PROBES):
            raise ValueError(f"{path} changes texts before it encodes them")
        size = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(size)]
        self.bos, self.eos, self.unk = model.bos_id(), model.eos_id(), model.unk_id()
        self.byte = {int(n[3:5], 16): i for i, n in enumerate(self.names) if model.is_byte(i)}
        self.normal = {n: i for i, n in enumerate(self.names) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        self.control = {i for i in range(size) if model.is_control(i)}
        scores = [model.get_score(i) for i in range(size)]
        order = {s: k for k, s in enumerate(sorted({scores[i] for i in self.normal.values()}, reverse=True))}
        self.rank = {n: order[scores[i]] for n, i in self.normal.items()}


def merged(symbols: list[str], rank: dict[str, int], border: int = -1) -> list[str] | None:
    """The symbols after all merges, best rank first and from the left; None once a merge crosses `border` (a number of characters)."""
    symbols, none = list(symbols), len(rank)
    ranks = [rank.get(a + b, none) for a, b in zip(symbols, symbols[1:])]
    while ranks and (best := min(ranks)) < none:
        k = ranks.index(best)
        start = sum(map(len, symbols[:k])) if border >= 0 else 0
        both = symbols[k] + symbols[k + 1]
        if start < border < start + len(both):
            return None
        symbols[k : k + 2] = [both]
        del ranks[k]
        if k:
            ranks[k - 1] = rank.get(symbols[k - 1] + both, none)
        if k < len(ranks):
            ranks[k] = rank.get(both + symbols[k + 1], none)
    return symbols


class Encoder:
    """Ids of a text, by the longest piece at each position and a way back where its neighbour does not fit.

    A row of pieces is what merging gives if and only if each piece merges to itself and no merge crosses the border of two
    neighbours when both are merged anew. So the encoder walks from left to right with the longest piece that fits its
    left neighbour and ends nowhere that has failed; where none fits, the position is marked as failed and the last piece
    gives way to a shorter one. Longest pieces at all positions come from one backward pass of an Aho-Corasick automaton
    over the reversed pieces.
    """

    def __init__(self, pieces: Pieces):
        self.pieces, self.rank = pieces, pieces.rank
        single = {n for n in pieces.normal if len(n) == 1}
        # a piece that does not merge to itself never comes out, nor does one with a letter that is no piece
        self.usable = {n: i for n, i in pieces.normal.items() if len(n) == 1 or set(n) <= single and merged(list(n), self.rank) == [n]}
        self.text_of = {i: n for n, i in self.usable.items()}
        self.shorter = {i: next((self.usable[n[:k]] for k in range(len(n) - 1, 0, -1) if n[:k] in self.usable), -1) for n, i in self.usable.items()}
        self.size = [len(self.text_of.get(i, "")) for i in range(len(pieces.names))]
        self.automaton = ahocorasick.Automaton()
        for name, i in self.usable.items():
            self.automaton.add_word(name[::-1], i)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.held, self.known, self.older = 0, {}, {}
        # blanks begin units, as no piece holds a blank behind another character; control characters of no piece stand alone
        alone = re.escape("".join(c for c in map(chr, range(32)) if not any(c in n for n in self.usable)))
        inner = any(SPACE in n.lstrip(SPACE) for n in self.usable)
        whole = [f"[^{alone}]+" if alone else "(?s:.+)"] if inner else [f"{SPACE}*[^{SPACE}{alone}]+", f"{SPACE}+"]
        self.units = re.compile("|".join([f"[{alone}]"] * bool(alone) + whole))
        # nor does a piece hold one of these signs behind a letter: a unit ends between them, too
        behind = {b for n in self.usable for a, b in zip(n, n[1:]) if a.isalpha()}
        signs = re.escape("".join(sorted(c for c in map(chr, range(33, 127)) if not c.isalpha() and c not in behind)))
        other = re.escape("".join(sorted({c for n in self.usable for c in n if re.match(r"[^\W\d_]", c) and not c.isalpha()})))  # as superscripts
        self.cuts = re.compile(rf"(?<=[^\W\d_{other}])(?=[{signs}])" if signs else "(?!)")

    def longest(self, unit: str) -> list[int]:
        """The longest piece that starts at each position, -1 where none does."""
        found = dict(reversed(list(self.automaton.iter(unit[::-1]))))  # of several pieces at one place the longest comes first
        return [found.get(k, -1) for k in range(len(unit) - 1, -1, -1)]

    def compatible(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay apart when their characters are merged anew; remembered in `fits`."""
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        left, right = self.text_of[a], self.text_of[b]
        found = self.fits[a << 32 | b] = merged(list(left + right), self.rank, len(left)) is not None
        return found

    def walk(self, unit: str) -> list[int]:
        """Ids of a unit."""
        first, size, shorter, fits, end = self.longest(unit), self.size, self.shorter, self.fits, len(unit)
        failed = bytearray(end // 8 + 1)
        out: list[int] = []
        base = at = 0  # out[base:] is what may be taken back
        now = first[0] if end else -1
        while at < end:
            if first[at] < 0:  # no piece holds this character: its bytes, and no merge crosses it
                byte = self.pieces.byte
                out += [byte[x] for x in unit[at].encode()] if byte else [self.pieces.unk]
                at, base = at + 1, len(out)
                now = first[at] if at < end else -1
                continue
            while now >= 0:
                to = at + size[now]
                if not failed[to >> 3] >> (to & 7) & 1:
                    if len(out) == base:
                        break
                    fit = fits.get(out[-1] << 32 | now)
                    if fit or fit is None and self.compatible(out[-1], now):
                        break
                now = shorter[now]
            if now >= 0:
                out.append(now)
                at = to
                now = first[at] if at < end else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                now = out.pop()
                at -= size[now]
                now = shorter[now]
        return out

    def unit(self, unit: str) -> bytes:
        """Little-endian ids of a unit that `known` does not hold: from the memory before it, from its parts, or anew."""
        found = self.older.get(unit)
        if found is None:
            parts = self.cuts.split(unit)
            if len(parts) > 1:
                found = b"".join([self.known.get(p) or self.unit(p) for p in parts])
            else:
                ids = self.walk(unit)
                found = struct.pack(f"<{len(ids)}I", *ids)
        if len(unit) <= LONG:
            self.held += len(unit) + len(found) + 200
            if self.held > REMEMBERED:  # frequent units come back from the older half
                self.older, self.known, self.held = self.known, {}, 0
            self.known[unit] = found
        return found

    def encode(self, text: str, ends: bool = True) -> bytes:
        """Little-endian ids of a text, between the begin and end ids if `ends`."""
        marked = SPACE + text.replace(" ", SPACE) if text else ""
        known, units = self.known, self.units.findall(marked)
        body = b"".join([known.get(u) or self.unit(u) for u in units])
        mark = [np.array([i] if ends and i >= 0 else [], "<u4").tobytes() for i in (self.pieces.bos, self.pieces.eos)]
        return mark[0] + body + mark[1]


class Decoder:
    """Texts of ids: control ids vanish, byte ids join to characters (a byte of none gives U+FFFD), the blank in front goes."""

    def __init__(self, pieces: Pieces):
        byte_of = {i: b for b, i in pieces.byte.items()}
        self.size = len(pieces.names)
        self.is_byte = np.zeros(self.size, bool)
        self.is_byte[list(byte_of)] = True
        self.marked = {i for i, n in enumerate(pieces.names) if n.startswith(SPACE) and pieces.normal.get(n) == i}
        self.control = pieces.control
        self.is_control = np.zeros(self.size, bool)
        self.is_control[list(self.control)] = True
        self.surface = [b"" if i in pieces.control else " ⁇ ".encode() if i == pieces.unk else bytes([byte_of[i]]) if i in byte_of else n.replace(SPACE, " ").encode() for i, n in enumerate(pieces.names)]

    def decode(self, ids: np.ndarray) -> str:
        if len(ids) and (ids.max() >= self.size or ids.min() < 0):
            raise ValueError(f"an id is outside the vocabulary of {self.size} pieces")
        surface, listed = self.surface, ids.tolist()
        data = b"".join([surface[i] for i in listed])
        front = next((i for i in listed if i not in self.control), -1)
        if front in self.marked:
            data = data[1:]
        if not self.is_control[ids[1:-1]].any():  # one inside would part bytes that join here
            try:
                return data.decode()
            except UnicodeDecodeError:
                pass
        return self._mended(listed, front)

    def _mended(self, ids: list[int], front: int) -> str:
        """The text where bytes form no characters: each run of byte ids is read for itself."""
        out, run, skip = [], bytearray(), front in self.marked
        for i in [*ids, -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.surface[i]
                continue
            out += characters(bytes(run))
            run.clear()
            if i >= 0:
                text = self.surface[i].decode()
                if skip and i not in self.control:
                    text, skip = text[1:], False
                out.append(text)
        return "".join(out)


def characters(data: bytes) -> Iterator[str]:
    """Characters of UTF-8 bytes; each byte that starts none is U+FFFD."""
    at = 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                yield data[at : at + n].decode()
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            yield "�"
            at += 1


_workers: dict[tuple[str, type], object] = {}


def _worker(path: str, kind: type) -> Pieces | Encoder | Decoder:
    if (path, kind) not in _workers:
        _workers[path, kind] = kind(path if kind is Pieces else _worker(path, Pieces))
    return _workers[path, kind]


def encode(docs: DataFrame, model: str, text: str = "text", ends: bool = True, packed: bool = False, decoded: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Add ids and n_tokens (long) to the columns `keep` of docs (None: all), exactly as sentencepiece encodes with the file `model`; with `decoded` also decoded (string), the text that decode() reads back from the ids.

    ids: array<int>, or with `packed` binary, each id a little-endian unsigned 32-bit integer. `ends` puts the begin and end
    ids around them. The model is of the merge type with identity normalization (else ValueError). Null texts count as
    empty (the begin and end ids alone), characters without a piece become their bytes; whole texts of any length are read;
    repeated rows stay; columns of docs with these names are replaced, whatever their case; an empty table gives an empty result.
    """
    added = ["ids", "n_tokens"] + ["decoded"] * decoded
    own = Carried(docs, keep, added)
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([*own.fields, T.StructField("ids", kind), T.StructField("n_tokens", T.LongType()), *[T.StructField("decoded", T.StringType())] * decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _worker(model, Encoder), _worker(model, Decoder) if decoded else None
        for part, texts in steps(batches, "_text"):
            found = [encoder.encode(t.decode(), ends) for t in texts]
            sizes = np.array([len(x) // 4 for x in found], np.int64)
            if packed:
                ids = pa.array(found, pa.binary())
            else:
                flat = np.frombuffer(b"".join(found), "<u4").astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
                ids = ids.cast(pa.list_(pa.field("element", pa.int32(), nullable=False)))
            back = [pa.array([decoder.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in found], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*own.of(part), ids, pa.array(sizes), *back], names=schema.names)

    return docs.select(*own.into(), column(text).alias("_text")).mapInArrow(run, schema).select(*own.back(), *added)


def decode(docs: DataFrame, model: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add decoded (string) to the columns `keep` of docs (None: all): the text that sentencepiece's decode gives for `ids`, an array of integers or packed binary.

    Null ids give null, no ids an empty text; null elements are left out, ids outside the vocabulary raise ValueError;
    repeated rows stay; a column named `decoded` is replaced, whatever its case; an empty table gives an empty result.
    """
    own = Carried(docs, keep, ["decoded"])
    schema = T.StructType([*own.fields, T.StructField("decoded", T.StringType())])
    packed = isinstance(docs.select(column(ids)).schema[0].dataType, T.BinaryType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _worker(model, Decoder)
        for batch in batches:
            found = batch.column(batch.schema.get_field_index("_ids"))
            if packed:
                texts = [None if x is None else decoder.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in found.to_pylist()]
            else:
                texts = [decoder.decode(np.asarray(x.values.drop_null(), np.int64)) if x.is_valid else None for x in found]
            yield pa.RecordBatch.from_arrays([*own.of(batch), pa.array(texts, pa.string())], names=schema.names)

    return docs.select(*own.into(), column(ids).alias("_ids")).mapInArrow(run, schema).select(*own.back(), "decoded")
