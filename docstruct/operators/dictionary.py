"""Occurrences of a dictionary's terms in texts of any script and length, as an equi join on each term's rarest pair of characters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a window; texts are cut into windows, so that no row carries a long text to the join. Terms may be as long.
WINDOW = 256
#: Bytes of a dictionary whose anchors are broadcast; a larger one meets the texts' pairs by a shuffle.
BROADCAST_BYTES = 16_000_000
#: A term that begins or ends with such a character is no part of a longer run of them; terms of other scripts stand anywhere.
WORD = r"[\p{IsLatin}0-9]"


def anchors(terms: DataFrame, term: str = "term") -> DataFrame:
    """(term, size, gram, offset, before, after) of the distinct terms: the pair of characters that fewest other terms hold, its place in the term, and whether the characters around a hit must be no word's."""
    own = terms.select(F.col(term).alias("term")).where(F.length("term") > 0).distinct()
    letters = F.split("term", "", -1)
    pairs = F.arrays_zip(letters.alias("x"), F.slice(letters, F.lit(2), F.size(letters)).alias("y"))
    spread = own.select("term", F.length("term").alias("size"), F.posexplode(pairs).alias("offset", "_p"))
    grams = spread.where("_p.y IS NOT NULL OR size = 1").select("term", "size", "offset", F.concat("_p.x", F.coalesce("_p.y", F.lit(""))).alias("gram"))
    rare = grams.groupBy("gram").agg(F.count_distinct("term").alias("_n"))
    best = grams.join(rare, "gram").groupBy("term", "size").agg(F.min(F.struct("_n", "gram", "offset")).alias("_b"))
    return best.select("term", "size", "_b.gram", "_b.offset", F.col("term").rlike(f"^{WORD}").alias("before"), F.col("term").rlike(f"{WORD}$").alias("after"))


@dataclass(frozen=True)
class Measure:
    """What one job tells of a dictionary: the characters of its longest term, whether all terms are whole words and any has one character, and whether it may be broadcast."""

    longest: int
    words: bool
    single: bool
    small: bool

    @staticmethod
    def of(terms: DataFrame, term: str) -> Measure:
        name = F.col(term)
        longest, words, least, size = terms.agg(F.max(F.length(name)), F.every(name.rlike(f"^{WORD}+$")), F.min(F.length(name)), F.sum(F.octet_length(name) + 40)).first()
        return Measure(longest or 0, bool(words), least == 1, (size or 0) <= BROADCAST_BYTES)

    def placed(self, own: DataFrame) -> DataFrame:
        """own, a table of the dictionary's size, marked for a join with texts; see placed_by()."""
        return placed_by(self.small, own)


def placed_by(small: bool, own: DataFrame) -> DataFrame:
    """own, to be broadcast if it is small, else to be joined by a shuffle, so that Spark never broadcasts what texts are spread to: it knows the size of the texts only, not of their pieces."""
    return F.broadcast(own) if small else own.hint("merge")


def is_small(rows: DataFrame) -> bool:
    """Whether whole rows may be broadcast; one job."""
    size = rows.agg(F.sum(F.octet_length(F.concat_ws("", *(F.col(c).cast("string") for c in rows.columns))) + 40)).first()[0]
    return (size or 0) <= BROADCAST_BYTES


def term_hits(docs: DataFrame, terms: DataFrame, text: str, keys: list[str], term: str = "term", outer: bool = False, words: bool = True, measure: Measure | None = None) -> DataFrame:
    """(keys, _row, term, pos): each occurrence of each term in the lower-cased text, overlaps included, by 0-based position.

    Terms are lower-case, of 1 to WINDOW characters (longer ones raise ValueError), in any script. A text is cut into
    windows that know the characters around them; a window's pairs of neighbouring characters meet the terms anchored at
    such a pair and are compared with the term there. The work is linear in the text, whatever the number of terms and of
    their lengths. One job measures the dictionary: up to BROADCAST_BYTES its anchors are broadcast, so that no character
    is shuffled; beyond, pairs are dealt by a shuffle, each with its window.

    _row tells input rows apart, whatever their keys. Without terms of one character a window emits half as much. Without
    `words`, texts keep their case and terms may lie within longer words. `outer`: rows without a hit, null texts among them,
    have one row with a null term.
    """
    known = measure or Measure.of(terms, term)
    longest = known.longest
    if longest > WINDOW:
        raise ValueError(f"a term is longer than {WINDOW} characters")
    found = known.placed(anchors(terms, term))
    body = F.coalesce(F.col(text), F.lit(""))
    chunks = F.regexp_extract_all(F.lower(body) if words else body, F.lit(f"(?s).{{1,{WINDOW}}}"), F.lit(0))
    around = F.arrays_zip(F.concat(F.array(F.lit("\n")), F.slice(chunks, F.lit(1), F.greatest(F.size(chunks) - 1, F.lit(0)))).alias("p"), chunks.alias("c"), F.slice(chunks, F.lit(2), F.greatest(F.size(chunks), F.lit(1))).alias("d"))
    rows = docs.select("*", F.monotonically_increasing_id().alias("_row"))
    windows = rows.select(*keys, "_row", F.posexplode(around).alias("_i", "_w"))
    body = F.concat(F.right("_w.p", F.lit(1)), F.coalesce("_w.c", F.lit("")), F.coalesce(F.left("_w.d", F.lit(longest)), F.lit("")))
    windows = windows.select(*keys, "_row", "_i", F.length(F.coalesce("_w.c", F.lit(""))).alias("_own"), body.alias("_body"))
    letters = F.split("_body", "", -1)
    pairs = F.arrays_zip(letters.alias("x"), F.slice(letters, F.lit(2), F.size(letters)).alias("y"))
    spread = windows.select(*keys, "_row", "_i", "_own", "_body", F.posexplode(pairs).alias("_k", "_p"))
    pair = F.concat("_p.x", F.coalesce("_p.y", F.lit("")))
    grams = spread.select(*keys, "_row", "_i", "_own", "_body", "_k", (F.explode(F.array_distinct(F.array(pair, F.col("_p.x")))) if known.single else pair).alias("gram"))
    met = grams.join(found, "gram", "left" if outer else "inner")
    start = F.col("_k") - F.col("offset")  # in the body, whose first character is the one before the window
    edge = lambda at: F.coalesce(F.substring("_body", at, F.lit(1)), F.lit("")).rlike(WORD)
    hit = start.between(1, F.col("_own")) & (F.substring("_body", start + 1, F.col("size")) == F.col("term"))
    if words:
        hit &= ~(F.col("before") & edge(start)) & ~(F.col("after") & edge(start + 1 + F.col("size")))
    ok = F.coalesce(hit, F.lit(False))
    pos = F.when(ok, F.col("_i") * WINDOW + start - 1).cast("long").alias("pos")
    kept = met.where(ok | ((F.col("_i") == 0) & (F.col("_k") == 0))) if outer else met.where(ok)
    return kept.select(*keys, "_row", F.when(ok, F.col("term")).alias("term"), pos)


def present_terms(docs: DataFrame, terms: DataFrame, text: str, keys: list[str], term: str = "term", outer: bool = False) -> DataFrame:
    """(keys, _row, term, n, pos): each term that a text holds, how often and, for their order, where first.

    A dictionary of nothing but whole words meets the texts' words, six times fewer than their characters (pos counts
    words then); any other goes through term_hits(). `outer`: rows without a term have one row with a null term.
    """
    known = Measure.of(terms, term)
    if known.words:
        found = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(f"({WORD}+)"), F.lit(1))
        own = known.placed(terms.select(F.col(term).alias("term")).distinct().withColumn("_in", F.lit(True)))
        rows = docs.select("*", F.monotonically_increasing_id().alias("_row")).select(*keys, "_row", (F.posexplode_outer if outer else F.posexplode)(found).alias("pos", "term"))
        hits = rows.join(own, "term", "left" if outer else "inner")
        hits = hits.select(*keys, "_row", F.when(F.col("_in"), F.col("term")).alias("term"), F.col("pos").cast("long").alias("pos"))
    else:
        hits = term_hits(docs, terms, text, keys, term, outer, measure=known)
    found = hits.groupBy(*keys, "_row", "term").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return found
