"""Helpers for Arrow batches of texts, and for the columns that an operator carries along."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one step handles at once, however many rows an Arrow batch has.
STEP_BYTES = 4 << 20


class Carried:
    """Columns of a table that pass through an operator under names that no column of its own has.

    keep: names in order (None: all). Those named like a result (`added`, whatever the case) go, as results replace them.
    """

    def __init__(self, docs: DataFrame, keep: Iterable[str] | None, added: Iterable[str]):
        gone = {a.lower() for a in added}
        wanted = docs.columns if keep is None else dict.fromkeys(keep)
        self.names = [c for c in wanted if c.lower() not in gone]
        self.inner = [f"_carried{i}" for i in range(len(self.names))]
        types = {f.name: f.dataType for f in docs.schema.fields} if keep is None else {c: docs.select(column(c)).schema[0].dataType for c in self.names}
        self.fields = [T.StructField(i, types[c]) for i, c in zip(self.inner, self.names)]

    def into(self) -> list[Column]:
        """The columns, to be selected from the table under inner names."""
        return [column(c).alias(i) for c, i in zip(self.names, self.inner)]

    def back(self) -> list[Column]:
        """The columns under their own names again."""
        return [F.col(i).alias(c) for c, i in zip(self.names, self.inner)]

    def of(self, part: pa.RecordBatch) -> list[pa.Array]:
        """Their arrays in a batch whose first columns they are."""
        return [part.column(i) for i in range(len(self.names))]


def column(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def steps(batches: Iterator[pa.RecordBatch], text: str, most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch in slices of about `most` bytes of text (a longer text is a slice of its own), with the texts as bytes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.cumsum(np.asarray(column.cast(pa.binary()).fill_null(b"").value_lengths() if hasattr(column, "value_lengths") else [len(x) for x in as_bytes(column)], dtype=np.int64)) if len(column) else np.zeros(0, np.int64)
        at = 0
        while at < len(column):
            done = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, done + most, side="right")))
            part = batch.slice(at, end - at)
            yield part, as_bytes(part.column(part.schema.get_field_index(text)))
            at = end
