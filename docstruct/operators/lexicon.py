"""Lexicon matching as joins: terms are rows (term, field, category, term_rank), texts are exploded to keys that meet them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docstruct.functions.positions import join_on
from docstruct.operators.dictionary import is_small, placed_by, present_terms, term_hits


def tokens(text: str, pattern: str = "[a-z]+") -> Column:
    """Distinct lower-case tokens in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({pattern})"), F.lit(1)))


def match_terms(docs: DataFrame, lexicon: DataFrame, text: str, keys: list[str], lengths: list[int]) -> DataFrame:
    """(keys, term, field, category, term_rank, n) for every term that a text contains, overlaps included.

    Containment becomes an equi join: a text's distinct substrings of each term length meet the terms. For texts of a
    question's size; longer ones take match_tokens. One job measures the lexicon: a small one is broadcast to the
    substrings, which are not; a larger one meets them by a shuffle.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    grams = F.array_distinct(F.flatten(F.array(*(_grams(body, n) for n in lengths))))
    found = docs.select(*keys, body.alias("_text"), F.explode(grams).alias("term")).join(placed_by(is_small(lexicon), lexicon), "term")
    count = (F.length("_text") - F.length(F.replace(F.col("_text"), F.col("term"), F.lit("")))) / F.length("term")
    return found.select(*keys, "term", "field", "category", "term_rank", count.cast("long").alias("n"))


def _grams(body: Column, n: int) -> Column:
    return F.when(F.length(body) >= n, F.transform(F.sequence(F.lit(1), F.length(body) - (n - 1)), lambda i: F.substring(body, i, F.lit(n)))).otherwise(F.expr("CAST(array() AS array<string>)"))


def match_tokens(docs: DataFrame, lexicon: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, field, category, score): distinct terms of a lexicon in any script that a text holds, by field and category; see present_terms()."""
    return present_terms(docs, lexicon, text, keys).join(lexicon, "term").groupBy(*keys, "field", "category").agg(F.count("*").alias("score"))


def best_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; `order` must be total."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def best_field(hits: DataFrame, keys: list[str]) -> DataFrame:
    """The field with most hits; the first declared wins a tie."""
    counts = hits.groupBy(*keys, "field").agg(F.count("*").alias("n_hits"), F.min("term_rank").alias("_first"))
    return best_by(counts, keys, [F.desc("n_hits"), F.col("_first"), F.col("field")]).drop("_first")


def longest_term(hits: DataFrame, keys: list[str]) -> DataFrame:
    """T4: the longest term, the first declared on a tie."""
    return hits.groupBy(*keys).agg(F.max_by("term", F.struct(F.length("term"), -F.col("term_rank"))).alias("term"))


def term_rollup(hits: DataFrame, keys: list[str]) -> DataFrame:
    """T5: totals by field (category null) and by field and category, in one pass of grouping sets."""
    own = hits.select(*keys, "n", F.explode(F.array(F.struct("field", F.lit(None).cast("string").alias("category"), F.lit(True).alias("whole")), F.struct("field", "category", F.lit(False).alias("whole")))).alias("_g"))
    return own.groupBy(*keys, "_g").agg(F.sum("n").alias("total")).select(*keys, "_g.field", "_g.category", "total")


def term_tops(hits: DataFrame, keys: list[str], categories: int = 3, terms: int = 5) -> DataFrame:
    """T5: (keys, top_field, top_categories, top_terms): the field with most hits, the best (field, category) pairs and terms, each joined best first; ties go to the lower term_rank, then by name."""
    listed = lambda column, k: F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("_n")).alias("m"), "_r", F.col(column).alias("v")))), 1, k), lambda x: x["v"]), ",")
    level = lambda column: hits.withColumn("_v", column).groupBy(*keys, "_v").agg(F.sum("n").alias("_n"), F.min("term_rank").alias("_r"))
    fields = level(F.col("field")).groupBy(*keys).agg(listed("_v", 1).alias("top_field"))
    pairs = level(F.concat_ws("/", "field", "category")).groupBy(*keys).agg(listed("_v", categories).alias("top_categories"))
    return fields.join(pairs, keys).join(level(F.col("term")).groupBy(*keys).agg(listed("_v", terms).alias("top_terms")), keys)


def important_terms(docs: DataFrame, lexicon: DataFrame, text: str, keys: list[str], k: int) -> DataFrame:
    """At most k terms of a lexicon (term, tier) in any script of each text, lower tiers first, then in order of appearance; at one place the longer term first."""
    placed = present_terms(docs, lexicon, text, keys).join(lexicon, "term")
    order = Window.partitionBy(*keys, "_row").orderBy("tier", "pos", F.desc(F.length("term")), "term")
    return placed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*keys, "rank", "term", "tier")


def cooccurrence_rules(docs: DataFrame, clusters: DataFrame, text: str, keys: list[str], least: int = 2) -> DataFrame:
    """The first cluster (cluster_rank, theme, term), its terms in any script, of which a text holds `least` different ones."""
    found = present_terms(docs, clusters, text, keys).join(clusters, "term").groupBy(*keys, "_row", "cluster_rank", "theme").agg(F.count("*").alias("n_terms")).where(F.col("n_terms") >= least)
    return best_by(found, [*keys, "_row"], [F.col("cluster_rank"), F.col("theme")]).drop("cluster_rank", "_row")


def nearby(items: DataFrame, others: DataFrame, keys: list[str], pos: str, radius: int, id_column: str) -> DataFrame:
    """(keys, id, n_near) of others within `radius` of each item, for items that have any.

    No pair is formed: items' lower and upper bounds and the others are one stream by position, a running count of others
    stands at each bound, and an item's two differ by what lies between. Linear in items and others. Null keys are a key.
    """
    return _between(items, others.select(*keys, F.col(pos).alias("_q"), F.lit(1).cast("long").alias("_c")), keys, pos, radius, [id_column]).withColumnRenamed("_n", "n_near")


def _between(items: DataFrame, others: DataFrame, keys: list[str], pos: str, radius: int, names: list[str]) -> DataFrame:
    """(keys, names, _n) of the sums of _c of others (keys, _q, _c) within `radius` of each item, where above 0."""
    none = [F.lit(None).cast(items.schema[n].dataType).alias(n) for n in names]
    stream = others.select(*keys, *none, F.col("_q").cast("long").alias("_at"), F.lit(1).alias("_turn"), F.lit(0).alias("_sign"), "_c")
    bound = lambda at, turn, sign: F.struct(at.cast("long").alias("_at"), F.lit(turn).alias("_turn"), F.lit(sign).alias("_sign"), F.lit(0).cast("long").alias("_c"))
    bounds = F.array(bound(F.col(pos) - radius, 0, -1), bound(F.col(pos) + radius, 2, 1))  # a lower bound comes before what lies on it
    stream = stream.union(items.select(*keys, *names, F.explode(bounds).alias("_b")).select(*keys, *names, "_b.*"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_at", "_turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = stream.withColumn("_upto", upto).where("_sign <> 0").groupBy(*keys, *names).agg(F.sum(F.col("_sign") * F.col("_upto")).alias("_n"))
    return found.where("_n > 0")


def nearby_terms(items: DataFrame, blocks: DataFrame, keys: list[str], id_column: str, pos: str, text: str, radius: int, k: int, pattern: str = "([a-z]{2,})") -> DataFrame:
    """(keys, id, rank, word, n) of the k words that blocks within `radius` of each item have most: by frequency, then longer first, then by name.

    Items meet the distinct words of the bins around them, and count each as nearby() does, by running counts of the word:
    the work grows with items times words of their bins, not with the blocks that have them.
    """
    words = blocks.select(*keys, F.col(pos).alias("_q"), F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(pattern), F.lit(1))).alias("word")).groupBy(*keys, "_q", "word").agg(F.count("*").alias("_c"))
    there = words.select(*keys, F.expr(f"_q div {radius}").alias("_bin"), "word").distinct()
    around = items.select(*keys, id_column, F.col(pos).alias("_p"), F.explode(F.expr(f"sequence({pos} div {radius} - 1, {pos} div {radius} + 1)")).alias("_bin"))
    asked = join_on(around, there, [*keys, "_bin"]).select(*keys, "word", id_column, "_p").distinct()
    counts = _between(asked, words, [*keys, "word"], "_p", radius, [id_column]).withColumnRenamed("_n", "n")
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, id_column).orderBy(F.desc("n"), F.desc(F.length("word")), "word")))
    return ranked.where(F.col("rank") <= k).select(*keys, id_column, "rank", "word", "n")


def append_context(items: DataFrame, near: DataFrame, keys: list[str], id_column: str, text: str) -> DataFrame:
    """Items with the words of nearby_terms() appended to their text, in order of rank; items without any stay as they are."""
    listed = near.groupBy(*keys, id_column).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]), " ").alias("_context"))
    return items.join(listed, [*keys, id_column], "left").withColumn(text, F.concat_ws(" ", text, "_context")).drop("_context")


def apply_corrections(rows: DataFrame, name: str, corrections: list[tuple[str, str]]) -> DataFrame:
    """The canonical form of the first wrong form that the name holds, else the name itself."""
    return rows.withColumn("corrected", F.coalesce(*(F.when(F.contains(F.col(name), F.lit(w)), F.lit(c)) for w, c in corrections), F.col(name)))


def vocab_by_field(rows: DataFrame, field: str, term: str) -> DataFrame:
    """(field, term, n): the distinct terms of more than one character of each field, null as 'other', a row each, and how often they stand."""
    own = rows.where(F.length(term) > 1).groupBy(F.coalesce(field, F.lit("other")).alias("field"), F.col(term).alias("term"))
    return own.agg(F.count("*").alias("n"))


def canonicalize_labels(rows: DataFrame, label: str, exact: dict[str, str], contained: list[tuple[str, str]], default: str) -> DataFrame:
    """Exact form, then regardless of case, then the first contained form, else the default."""
    low = F.lower(F.col(label))
    steps = [F.when(F.col(label) == k, v) for k, v in exact.items()] + [F.when(low == k.lower(), v) for k, v in exact.items()] + [F.when(F.contains(low, F.lit(k)), v) for k, v in contained]
    return rows.withColumn("canonical", F.coalesce(*steps, F.lit(default)))


def keyword_candidates(texts: DataFrame, families: list[tuple[str, int]], priorities: list[str], text: str, keys: list[str], k: int = 20) -> DataFrame:
    """(keys, rank, keyword) of at most k candidates that the families (pattern, group) find, of 2 characters or more.

    A keyword counts once, at its first place in the order of families and matches; those that match an earlier pattern of `priorities` stand first.
    """
    found = F.concat(*(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(p), F.lit(g)) for p, g in families))
    distinct = F.array_distinct(F.filter(found, lambda x: F.length(x) >= 2))

    def rated(word: Column, i: Column) -> Column:
        level = F.coalesce(*(F.when(word.rlike(p), F.lit(n)) for n, p in enumerate(priorities)), F.lit(len(priorities)))
        return F.struct(level.alias("level"), i.alias("place"), word.alias("keyword"))

    best = F.slice(F.array_sort(F.transform(distinct, rated)), 1, k)
    return texts.select(*keys, F.posexplode(best).alias("_i", "_k")).select(*keys, (F.col("_i") + 1).alias("rank"), "_k.keyword")


def related_terms(themes: DataFrame, rules: list[tuple[str, str]], default: str, lexicon: DataFrame, generic: DataFrame, theme: str, keys: list[str], k: int) -> DataFrame:
    """(keys, category, rank, term): the category of the first rule (pattern, category) that the theme matches, and its first k terms of a lexicon (category, term, term_rank) that are not among the generic ones (term)."""
    ranked = lexicon.join(generic, "term", "left_anti").groupBy("category", "term").agg(F.min("term_rank").alias("term_rank"))
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy("term_rank", "term"))).where(F.col("rank") <= k)
    category = F.coalesce(*(F.when(F.col(theme).rlike(p), F.lit(c)) for p, c in rules), F.lit(default))
    return themes.select(*keys, category.alias("category")).join(ranked, "category").select(*keys, "category", "rank", "term")


def fuzzy_term_match(keywords: DataFrame, lexicon: DataFrame, keys: list[str], keyword: str, field: str) -> DataFrame:
    """The best lexicon term (term, field, term_rank) of each row's keyword, with its score.

    1.0 if equal, 0.8 if one contains the other, 0.6 if more than half of all their characters are shared, else 0.3;
    times 1.2 in the keyword's own field; ties go to the lower term_rank. Terms that share no character do not count.

    A ladder of equi joins over the distinct keywords: equality; containment, found at the contained one's rarest pair of
    characters; character sets, which meet on their rarest characters; and one term for each character, in the keyword's
    field and in all. A keyword and field keep one term of a class, so that nothing grows with the pairs of keywords and
    terms that merely share a character.
    """
    best = F.min(F.struct("term_rank", "term")).alias("_t")
    terms = lexicon.select("term", F.col("field").alias("term_field"), "term_rank").where(F.length("term") > 0)
    names = terms.select("term").distinct()
    own = keywords.select(F.col(keyword).alias("_keyword")).where(F.length("_keyword") > 0).distinct()
    of_field = lambda pairs: pairs.join(terms, "term").groupBy("_keyword", "term_field").agg(best)
    equal = of_field(own.join(names, own["_keyword"] == names["term"]))
    inner = term_hits(own, names, "_keyword", ["_keyword"], words=False).select("_keyword", "term")
    contained = of_field(inner.union(_holders(names, own)).where("_keyword <> term").distinct())
    letters = lambda c: F.array_distinct(F.split(F.col(c), ""))
    left = own.select("_keyword", letters("_keyword").alias("_a"))
    right = names.select("term", letters("term").alias("_b"))
    rarity = right.select(F.explode("_b").alias("_ch")).groupBy("_ch").agg(F.count("*").alias("_df"))

    def prefix(sets: DataFrame, name: str, letters_of: str) -> DataFrame:
        spread = sets.select(name, letters_of, F.explode(letters_of).alias("_ch")).join(rarity, "_ch", "left")
        ordered = spread.groupBy(name, letters_of).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), "_ch"))).alias("_o"))
        return ordered.select(name, letters_of, F.explode(F.slice(F.col("_o")["_ch"], F.lit(1), F.size(letters_of) - F.ceil(F.size(letters_of) / 2).cast("int") + 1)).alias("_ch"))

    shared = F.size(F.array_intersect("_a", "_b"))
    alike = prefix(left, "_keyword", "_a").join(prefix(right, "term", "_b"), "_ch").where((2 * F.least(F.size("_a"), F.size("_b")) > F.greatest(F.size("_a"), F.size("_b"))) & (3 * shared > F.size("_a") + F.size("_b")))
    alike = of_field(alike.select("_keyword", "term").distinct())
    rest = left.select("_keyword", F.explode("_a").alias("_ch"))
    of_letter = terms.select("term_field", "term_rank", "term", F.explode(letters("term")).alias("_ch"))
    firsts = of_letter.groupBy("_ch", "term_field").agg(best)
    asked = keywords.select(F.col(keyword).alias("_keyword"), F.col(field).alias("_field")).distinct()
    anywhere = firsts.groupBy("_ch").agg(F.min(F.struct("_t", "term_field")).alias("_x")).select("_ch", "_x.term_field", "_x._t")
    wanted = asked.join(rest, "_keyword")
    loose = wanted.join(firsts, (wanted["_ch"] == firsts["_ch"]) & (wanted["_field"] == firsts["term_field"])).select("_keyword", "_field", "term_field", "_t").union(wanted.join(anywhere, "_ch").select("_keyword", "_field", "term_field", "_t"))
    scored = [asked.join(rows, "_keyword").select("_keyword", "_field", "term_field", "_t", F.lit(score).alias("_score")) for rows, score in ((equal, 1.0), (contained, 0.8), (alike, 0.6))]
    found = scored[0].union(scored[1]).union(scored[2]).union(loose.select("*", F.lit(0.3)))
    rated = found.select("_keyword", "_field", "term_field", "_t.*", F.round(F.col("_score") * F.when(F.col("_field") == F.col("term_field"), 1.2).otherwise(1.0), 2).alias("score"))
    chosen = best_by(rated, ["_keyword", "_field"], [F.desc("score"), F.col("term_rank"), F.col("term"), F.col("term_field")]).select("_keyword", "_field", "term", "term_field", "score")
    rows = keywords.select(*keys, keyword, field)
    return rows.join(chosen, rows[keyword].eqNullSafe(F.col("_keyword")) & rows[field].eqNullSafe(F.col("_field"))).drop("_keyword", "_field")


def _holders(names: DataFrame, keywords: DataFrame) -> DataFrame:
    """(_keyword, term) of the terms that hold a keyword."""
    own = names.withColumnRenamed("term", "_name")
    return term_hits(own, keywords, "_name", ["_name"], "_keyword", words=False).select(F.col("term").alias("_keyword"), F.col("_name").alias("term"))


#: Cells in which words are counted for their order; words of a block of documents that are compared at once; rows of one word that are held at once.
CELLS, BLOCK_WORDS, BAND = 1 << 20, 4_000_000, 1 << 17
#: Pairs that are tested at once, 64-bit numbers of parities that a row carries at most, and sizes up to which sets are cut in 1, 8, 32, 128 ... parts.
STEP, WIDEST, SIZES = 1 << 21, 16, 512 * 4 ** np.arange(12)


def similar_documents(docs: DataFrame, text: str, key: str, threshold: float) -> DataFrame:
    """(key, class_id, n_links) for documents whose lower-case word sets have a Jaccard similarity of the threshold or more.

    Documents of equal sets (equal in 128 bits) are one class, named by the smallest key; n_links counts other classes that
    are similar. Classes meet on prefix words: with words ordered by rarity, similar sets of m words share one of their
    rarest m - ceil(threshold * m) + 1. At the first shared word the words from it on bound the overlap, by their number and
    by their parities. Large sets are cut by their words' hashes, as two that are similar have a part in which they are.
    Rows of a word that the bounds leave together get a label in common; then classes are sent once a label, and all pairs
    of a label are compared by 64-bit hashes. No pair is ever a row: what is shuffled grows with the words, and only the
    comparisons with the pairs. Empty and null texts have no words and no links.

    One job counts words in CELLS cells, for their order alone. Links tell classes by 64 bits, as they do words.
    """
    parts = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    words = F.sort_array(F.array_distinct(F.transform(parts, lambda w: F.xxhash64(w))))  # numbers are dealt, sorted and compared faster
    named = lambda rows: rows.select(F.col(key).alias("_key"), words.alias("_words")).select("*", F.xxhash64("_words").alias("_h"), F.xxhash64(F.lit(1), "_words").alias("_i"))
    spoken = named(docs.where(F.col(text).rlike(r"\S")))
    # copies are put together before they are dealt; both readers take all columns, so that the words are dealt once
    classes = spoken.groupBy("_h").agg(F.first(F.struct("_i", "_words")).alias("_c")).select("_h", "_c._i", "_c._words")
    ranks = docs.sparkSession.sparkContext.broadcast(_ranks(spoken))
    prefix = classes.mapInArrow(_prefixes(threshold, ranks), "_word long, _h long, _size long, _bits binary")
    marks = prefix.repartition("_word").sortWithinPartitions("_word", "_size").mapInArrow(_alike(threshold, BAND), "_label long, _h long, _m long")
    links = _linked(marks, classes, threshold)
    least = F.min("_key").over(Window.partitionBy("_h", "_i")).alias("class_id")
    found = named(docs).select("_key", "_h", "_i").select("*", least).join(links, ["_h", "_i"], "left")
    return found.select(F.col("_key").alias(key), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _ranks(sets: DataFrame) -> np.ndarray:
    """For each cell of words how often they stand, in steps of an eighth of a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            counts += np.bincount(_lists(batch.column(0))[0] & (CELLS - 1), minlength=CELLS)
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(counts[cells])], names=["_cell", "_n"])

    counts = sets.select("_words").mapInArrow(run, "_cell int, _n long").groupBy("_cell").agg(F.sum("_n").alias("_n"))
    found = counts.where("_n > 1").select("_cell", F.least(F.lit(255), F.floor(F.log2("_n") * 8)).cast("short").alias("_r")).toArrow()
    out = np.zeros(CELLS, np.uint8)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of lists of longs."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _folded(bits: np.ndarray, n: int) -> np.ndarray:
    """Rows of parities in as many cells as n numbers have."""
    return bits if bits.shape[1] == n else np.bitwise_xor.reduce(bits.reshape(len(bits), -1, n), axis=1)


def _pieces(values: np.ndarray, offsets: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, owners, sizes, values) of the sets that are cut alike: whole ones of level 0, else parts; a set is cut as those that it may be similar to."""
    sizes = np.diff(offsets)
    lowest, highest = np.searchsorted(SIZES, sizes), np.searchsorted(SIZES, np.floor(sizes / threshold + 1e-9))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    for level in range(int(lowest.min()), int(highest.max()) + 1):
        parts = 2 * 4**level if level else 1
        here = ((lowest <= level) & (level <= highest))[owner]
        own = values[here]
        piece, at, n = np.unique(owner[here] * parts + (own >> 40 & (parts - 1)), return_inverse=True, return_counts=True)
        yield level, piece // parts, n, own[np.argsort(at, kind="stable")]


def _prefixes(threshold: float, ranks: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(_h, _i, _words) to (_word, _h, _size, _bits) of each prefix word of a set or part: its size, level and place there in one number, and parities of the words from it on.

    Two of which this is the first shared word differ in no fewer of these words than parities. A row has two to four cells
    for each word that may differ.
    """

    def prefix(h: np.ndarray, level: int, sizes: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        starts = np.cumsum(sizes) - sizes
        rank = ranks.value[values & (CELLS - 1)].astype(np.int64)
        values = values[np.argsort(np.repeat(np.arange(len(sizes)), sizes) << 8 | rank, kind="stable")]
        lengths = sizes - np.ceil(np.round(threshold * sizes, 9)).astype(np.int64) + 1
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        may = np.repeat((1 - threshold) / threshold * sizes, lengths) - at  # words that may differ from here on
        widths = np.minimum(WIDEST, 1 << np.ceil(np.log2(np.maximum(may / 32, 1))).astype(np.int64))
        bits, first = [], 0
        for start, m, length in zip(starts.tolist(), sizes.tolist(), lengths.tolist()):
            width = widths[first : first + length]
            n, low = int(width[0]), int(width[-1])
            cell = values[start : start + m] >> 20 & (64 * n - 1)
            one = np.zeros((length, n), np.uint64)
            one[np.arange(length), cell[:length] >> 6] = np.uint64(1) << (cell[:length] & 63).astype(np.uint64)
            rest = np.packbits((np.bincount(cell[length:], minlength=64 * n) & 1).astype(np.uint8), bitorder="little").view(np.uint64)
            own = np.bitwise_xor.accumulate(one[::-1], axis=0)[::-1] ^ rest
            cuts = [0, length] if n == low else [0, *(np.flatnonzero(np.diff(width)) + 1).tolist(), length]
            bits += [_folded(own[a:b], int(width[a])).ravel() for a, b in zip(cuts, cuts[1:])]
            first += length
        ends = np.concatenate([[0], np.cumsum(widths) * 8]).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(bits))])
        words = values[np.repeat(starts, lengths) + at] ^ (level << 58)  # levels don't meet
        columns = [words, np.repeat(h, lengths), np.repeat(sizes, lengths) << 32 | level << 27 | at]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), packed], names=["_word", "_h", "_size", "_bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 500) for i in range(0, whole.num_rows, 500)):
                h = batch.column(0).to_numpy()
                for level, owner, sizes, values in _pieces(*_lists(batch.column(2)), threshold):
                    if len(sizes):
                        yield prefix(h[owner], level, sizes, values)

    return run


def _merge(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """root (the least row of each row's component) with x and y connected."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def _spans(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (x, y) of each x and the rows from begin to end of it, some STEP at a time."""
    counts = np.maximum(end - begin, 0)
    rows = np.flatnonzero(counts)
    total = np.cumsum(counts[rows])
    first = 0
    while first < len(rows):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + STEP, "right")))
        own = rows[first:last]
        n = counts[own]
        yield np.repeat(own, n), np.arange(n.sum()) + np.repeat(begin[own] - np.cumsum(n) + n, n)
        first = last


def _alike(threshold: float, band: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of _prefixes() sorted by word and size to (_label, _h, _m), the set's size about: rows of a word that the bounds don't tell apart have a label in common, the least _h of those they are connected with.

    Of a word more than `band` rows are taken in turns, and those held that a later, larger set may still meet.
    """
    least = threshold / (1 + threshold)  # of the words of two similar sets, the part that is shared

    def furthest(size: np.ndarray) -> np.ndarray:
        m, at = size >> 32, size & 0x7FFFFFF
        return np.floor((m - at) / least - m + 1e-6).astype(np.int64)

    def marks(rows: pa.RecordBatch, fresh: int) -> pa.RecordBatch:
        word, h, size = (rows.column(i).to_numpy() for i in range(3))
        m, after = size >> 32, (size >> 32) - (size & 0x7FFFFFF)
        level = size >> 27 & 31
        group = np.cumsum(np.concatenate([[0], word[1:] != word[:-1]])) << 32
        end = np.searchsorted(group | m, group | np.clip(furthest(size), 0, 0xFFFFFFFF), "right")
        starts = np.frombuffer(rows.column(3).buffers()[1], np.int32)[rows.column(3).offset :][: len(word) + 1].astype(np.int64) // 8
        bits, width = np.frombuffer(rows.column(3).buffers()[2], np.uint64), np.diff(starts)
        root = np.arange(len(word))
        for x, y in _spans(np.maximum(np.arange(len(word)) + 1, fresh), end):
            need = least * (m[x] + m[y])
            may = after[x] + after[y] - 2 * need + 1e-6  # words that may differ from here on
            open_ = (np.minimum(after[x], after[y]) >= need - 1e-6) & (root[x] != root[y])
            x, y, may = x[open_], y[open_], may[open_]
            both = width[x] << 32 | width[y]
            for kind in np.unique(both).tolist():
                here = np.flatnonzero(both == kind)
                p, q = kind >> 32, kind & 0xFFFFFFFF
                for some in np.array_split(here, len(here) * max(p, q) // STEP + 1):
                    a, b = (_folded(bits[starts[i[some]][:, None] + np.arange(n)], min(p, q)) for i, n in ((x, p), (y, q)))
                    near = some[np.bitwise_count(a ^ b).sum(axis=1) <= may[some]]
                    root = _merge(root, x[near], y[near])
        label = h.copy()
        np.minimum.at(label, root, h)
        kept = np.bincount(root, minlength=len(root))[root] > 1
        found = np.unique(np.stack([label[root][kept], h[kept], (m * np.where(level, 2 * 4**level, 1))[kept]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(3)], names=["_label", "_h", "_m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else pa.concat_batches([held, batch])
            word = rows.column(0).to_numpy()
            cut = int(np.searchsorted(np.cumsum(word != word[-1]), (word != word[-1]).sum(), "left")) + 1 if word[0] != word[-1] else 0
            if cut:
                yield marks(rows.slice(0, cut), fresh)
                fresh = 0
            held = rows.slice(cut)
            if held.num_rows > band:
                yield marks(held, fresh)
                size = held.column(2).to_numpy()
                held = held.filter(pa.array(furthest(size) >= size[-1] >> 32))
                fresh = held.num_rows
        if held is not None and held.num_rows:
            yield marks(held, fresh)

    return run


def _linked(marks: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(_h, _i, n_links) of the classes that marks (_label, _h, _m) name, compared with all of their labels' classes; a pair counts at the least label that both have.

    A label of many words is dealt in blocks, and each two of them meet.
    """
    block = ["_label", "_left", "_right"]
    members = marks.groupBy("_label", "_h").agg(F.max("_m").alias("_m"))
    of = F.ceil(F.sum(F.col("_m") + 256).over(Window.partitionBy("_label")) / BLOCK_WORDS).cast("int")
    asked = members.withColumn("_of", of).groupBy("_h").agg(F.collect_list(F.struct("_label", "_of")).alias("_labels"))
    rows = asked.join(classes, "_h").select("_h", "_i", "_words", "_labels", F.explode("_labels").alias("_l")).select("*", F.pmod("_i", "_l._of").cast("int").alias("_own"))
    lower = F.filter(F.col("_labels")["_label"], lambda x: x < F.col("_l._label")).alias("_lower")
    dealt = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("_l._of") - 1)).alias("_other"))
    dealt = dealt.select("_l._label", F.least("_own", "_other").alias("_left"), F.greatest("_own", "_other").alias("_right"), "_own", "_h", "_i", lower, "_words")
    compared = dealt.repartition(*block).sortWithinPartitions(*block).mapInArrow(_compared(threshold), "_h long, _i long, _n long")
    return compared.groupBy("_h", "_i").agg(F.sum("_n").alias("n_links"))


def _overlaps(values: np.ndarray, offsets: np.ndarray) -> Callable[[int, int], np.ndarray]:
    """Of n sets of distinct values, a function from two bounds to a matrix: how many values each set between them shares with each of the n.

    Values of many sets are columns of a matrix product, those of few are paired.
    """
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    _, code, times = np.unique(values, return_inverse=True, return_counts=True)
    dense = times > max(1, n // 16)
    if dense.sum() > 2048:
        dense &= times >= np.partition(times, -2048)[-2048]
        dense &= np.cumsum(dense) <= 2048
    at = dense[code]
    table = np.zeros((n, int(dense.sum())), np.float32)
    table[row[at], (np.cumsum(dense) - 1)[code[at]]] = 1
    thin = ~at & (times[code] > 1)
    code, owner = code[thin], row[thin]
    by_code = np.argsort(code, kind="stable")
    holders = owner[by_code]
    begin = np.searchsorted(code[by_code], code, "left")
    end = np.searchsorted(code[by_code], code, "right")

    def between(first: int, last: int) -> np.ndarray:
        out = table[first:last] @ table.T
        low, high = np.searchsorted(owner, [first, last])
        for x, y in _spans(begin[low:high], end[low:high]):
            out += np.bincount((owner[low:high][x] - first) * n + holders[y], minlength=out.size).reshape(out.shape)
        return out

    return between


def _compared(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by _label, _left and _right to (_h, _i, _n): the number of similar classes in each of these blocks that share no lower label."""

    def counts(rows: pa.RecordBatch) -> pa.RecordBatch:
        own = rows.column(3).to_numpy()
        cross = rows.column(1)[0] != rows.column(2)[0]
        values, offsets = _lists(rows.column(7))
        m, n = np.diff(offsets), len(own)
        words, lower = _overlaps(values, offsets), _overlaps(*_lists(rows.column(6)))
        out = np.zeros(n, np.int64)
        step = max(1, STEP // n)
        for first in range(0, n, step):
            last = min(n, first + step)
            shared = words(first, last)
            near = (shared >= threshold * (m[first:last, None] + m - shared) - 1e-9) & (lower(first, last) == 0)
            near[np.arange(last - first), np.arange(first, last)] = False
            out[first:last] = (near & (own[first:last, None] != own) if cross else near).sum(axis=1)
        some = out > 0
        return pa.RecordBatch.from_arrays([rows.column(4).filter(pa.array(some)), rows.column(5).filter(pa.array(some)), pa.array(out[some])], names=["_h", "_i", "_n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            names = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if last is not None and last != tuple(names[a]):
                        yield counts(pa.concat_batches(held))
                        held = []
                    last = tuple(names[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield counts(pa.concat_batches(held))

    return run
