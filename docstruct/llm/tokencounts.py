"""Token counts by a linear longest-match automaton over a vocabulary of word pieces."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstruct.llm.textbatch import Carried, column, steps

#: Bytes of words that a worker remembers; longer words than LONG bytes are counted each time.
REMEMBERED, LONG = 8_000_000, 64
BEGIN = "▁"


def read_pieces(path: str) -> tuple[list[str], list[str]]:
    """(pieces that begin a word, without their mark; pieces inside a word) of a sentencepiece model file; the empty piece stands for the mark alone."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [n[len(BEGIN) :] for n in names if n.startswith(BEGIN)], [n for n in names if BEGIN not in n]


class Automaton:
    """Two tries, for the begin and the inside of words, with failure links and the number of pieces that each link pops.

    A word is read once: where the trie has no way on, the link leads to the state of the text that is left after the
    longest matches so far, and their precomputed number is added. Pieces are never built.
    """

    def __init__(self, begin: Iterable[str], inside: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, words in ((0, begin), (1, inside)):
            for word in words:
                at = root
                for c in word:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                    at = self.next[at][c]
                ends[at] |= bool(word)
                if not word:
                    ends[root] = root == 0
        self.link = [-1] * len(self.next)
        self.pops = [0] * len(self.next)
        if ends[0]:  # the mark alone is a piece
            self.link[0], self.pops[0] = 1, 1
        queue = deque([0, 1])
        while queue:
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if ends[v]:
                    self.link[v], self.pops[v] = 1, 1
                    continue
                z, popped = self.link[u], self.pops[u]
                while z >= 0 and c not in self.next[z]:
                    popped += self.pops[z]
                    z = self.link[z]
                if z >= 0:
                    self.link[v], self.pops[v] = self.next[z][c], popped

    def count(self, word: str) -> int:
        """Pieces of the greedy longest match from left to right; 0 if it fails."""
        nexts, link, pops = self.next, self.link, self.pops
        at, n = 0, 0
        for c in word:
            while c not in nexts[at]:
                n += pops[at]
                at = link[at]
                if at < 0:
                    return 0
            at = nexts[at][c]
        while at != 1:
            n += pops[at]
            at = link[at]
            if at < 0:
                return 0
        return n


class Words(dict):
    """(pieces, unknown) of words, forgotten when they have many bytes."""

    def __init__(self, automaton: Automaton):
        self.automaton, self.held = automaton, 0

    def __missing__(self, word: bytes) -> tuple[int, int]:
        n = self.automaton.count(word.decode())
        found = (n, 0) if n else (1, 1)
        if len(word) <= LONG:
            self.held += len(word)
            if self.held > REMEMBERED:
                self.clear()
                self.held = len(word)
            self[word] = found
        return found


_workers: dict[str, Words] = {}


def token_counts(docs: DataFrame, pieces: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_words, n_tokens and n_unknown (long) to the columns `keep` of docs (None: all).

    Words are runs of other characters than 0x20 and 0x09 to 0x0D. A word whose greedy match fails is one unknown token.
    Null and empty texts have zeros; repeated rows stay; columns of docs with these names are replaced; an empty table gives
    an empty result. A worker builds the automaton once from the file `pieces`.
    """
    added = ["n_words", "n_tokens", "n_unknown"]
    own = Carried(docs, keep, added)
    schema = T.StructType([*own.fields, *(T.StructField(c, T.LongType()) for c in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if pieces not in _workers:
            _workers[pieces] = Words(Automaton(*read_pieces(pieces)))
        look = _workers[pieces].__getitem__
        for part, texts in steps(batches, "_text"):
            rows = []
            for t in texts:
                found = list(map(look, t.split()))
                rows.append((len(found), sum(x[0] for x in found), sum(x[1] for x in found)))
            yield pa.RecordBatch.from_arrays([*own.of(part), *(pa.array(c, pa.int64()) for c in zip(*rows))], names=schema.names)

    return docs.select(*own.into(), column(text).alias("_text")).mapInArrow(run, schema).select(*own.back(), *added)
