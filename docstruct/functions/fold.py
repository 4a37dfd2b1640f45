"""Sequential choices that depend on what was kept before: one pass over sorted rows, carrying a few values, not lists."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that a pass holds before it hands them on.
HELD = 20_000


class Fold:
    """State of one key: step() takes the values of a row, end() comes after the last; both yield tuples of results."""

    def step(self, *values) -> Iterable[tuple]:
        return ()

    def end(self) -> Iterable[tuple]:
        return ()


def fold_sorted(rows: DataFrame, keys: list[str], order: list[str], results: str, begin: Callable[[], Fold]) -> DataFrame:
    """(keys, results): each key's rows through a Fold of its own, in the order of the columns `order`, which are its values.

    Rows are dealt by key and sorted within partitions; a task reads its Arrow batches once and carries one key's state from
    batch to batch, so that memory does not grow with a key's rows. Null keys are values like others.
    """
    own = rows.select(*keys, *order)
    schema = T.StructType([*own.schema.fields[: len(keys)], *T._parse_datatype_string(results).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, held = None, None, []
        shape = to_arrow_schema(schema)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or row[: len(keys)] != key:
                    if state is not None:
                        held += [(*key, *r) for r in state.end()]
                    key, state = row[: len(keys)], begin()
                held += [(*key, *r) for r in state.step(*row[len(keys) :])]
            while len(held) >= HELD:
                yield _batch(held[:HELD], shape)
                held = held[HELD:]
        if state is not None:
            held += [(*key, *r) for r in state.end()]
        if held:
            yield _batch(held, shape)

    return own.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _batch(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)


class KeepApart(Fold):
    """Of positions in order, those at least `distance` behind the last one kept."""

    def __init__(self, distance: int):
        self.distance, self.last = distance, None

    def step(self, pos):
        if self.last is None or pos - self.last >= self.distance:
            self.last = pos
            yield (pos,)


class TrueMarkers(Fold):
    """Of (pos, number, priority) by position, the true markers.

    The first must be numbered 1. A later one must raise the number (unless its priority is 6 at least) and lie min_gap
    behind the last one kept; within the gap it replaces that one if its priority is higher.
    """

    def __init__(self, min_gap: int):
        self.gap, self.last = min_gap, None

    def step(self, pos, number, priority):
        if self.last is None:
            if number == 1:
                self.last = (pos, number, priority)
        elif pos - self.last[0] < self.gap:
            if priority > self.last[2]:
                self.last = (pos, number, priority)
        elif number > self.last[1] or priority >= 6:
            yield self.last
            self.last = (pos, number, priority)

    def end(self):
        if self.last is not None:
            yield self.last


class CitedSegments(Fold):
    """Of places (at, kind) in order, the segments (segment_no, kind, start, stop) between them.

    kind 0 ends a leading block, 1 a cited segment once it has `least` characters, 2 is the end of the text.
    """

    def __init__(self, least: int):
        self.least, self.last, self.n = least, 0, 0

    def step(self, at, kind):
        if kind == 0 or kind == 1 and at - self.last >= self.least or kind == 2 and (at > self.last or not self.n):
            self.n += 1
            yield self.n, ("leading", "cited", "plain")[kind], self.last, at
            self.last = at


def pack_greedily(parts: Iterable[str], most: int) -> list[str]:
    """Of texts in order, the texts joined by line breaks while they stay within `most` characters; a longer one stands alone."""
    done, size = [], most
    for part in parts:
        if size + 1 + len(part) <= most:
            done[-1].append(part)
            size += 1 + len(part)
        else:
            done.append([part])
            size = len(part)
    return ["\n".join(own) for own in done]


_END, _BRACKET = re.compile(r"(?<=[.!?。！？])[ \t\n\x0b\f\r]*"), re.compile(r"[(（「)）」]")


def cut_sentences(line: str) -> Iterator[str]:
    """A line cut behind sentence ends, without the blanks there, save where the next bracket is a closing one; a single pass, however long the line."""
    brackets = [(m.start(), m[0] in ")）」") for m in _BRACKET.finditer(line)]
    start = i = 0
    for m in _END.finditer(line):
        while i < len(brackets) and brackets[i][0] < m.start():
            i += 1
        if i == len(brackets) or not brackets[i][1]:
            yield line[start : m.start()]
            start = m.end()
    yield line[start:]


def cut_pieces(text: str, most: int) -> Iterator[str]:
    """The lines of a text; a longer one than `most` by sentences, and these at every `most` characters; empty pieces are left out."""
    for line in text.split("\n"):
        for part in (line,) if len(line) <= most else cut_sentences(line):
            for at in range(0, len(part), most):
                yield part[at : at + most]
