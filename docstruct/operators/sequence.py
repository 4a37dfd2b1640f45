"""Sequence quality: gaps, duplicates, resets and repair. Windows run within a document, ordered by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _order(key: list[str], order: list[str]):
    return Window.partitionBy(*key).orderBy(*order)


def reset_groups(items: DataFrame, key: list[str], order: list[str], num: str, drop: int | None = None, pos: str | None = None, far: int = 500) -> DataFrame:
    """group_no counts from 1 and grows where the number returns to 1 after a larger one, or falls by `drop` at least; with `pos` only if the item lies `far` positions on at least."""
    w = _order(key, order)
    before = F.lag(num).over(w)
    new = (before - F.col(num) >= drop) if drop else (F.col(num) == 1) & (before > 1)
    if pos:
        new = new & (F.col(pos) - F.lag(pos).over(w) >= far)
    return items.withColumn("_new", F.coalesce(new.cast("int"), F.lit(0))).withColumn("group_no", 1 + F.sum("_new").over(w)).drop("_new")


def lookup_numbers(items: DataFrame, marker: str, numerals: DataFrame) -> DataFrame:
    """Q1: add number from the table numerals (marker, number), null if the marker is unknown; only distinct markers meet the table."""
    known = items.select(F.col(marker).alias("marker")).distinct().join(numerals.select("marker", "number").dropDuplicates(["marker"]), "marker", "left")
    return items.join(known.withColumnRenamed("marker", marker), marker, "left")


def lookup_pairs(items: DataFrame, marker: str, pattern: str, numerals: DataFrame, least: int = 1, most: int = 100) -> DataFrame:
    """Q1: add major and minor, the numbers of the two groups of `pattern` in a marker (a group without a match: null), resolved by the numerals table and kept if within bounds."""
    known = items.select(F.col(marker).alias("_marker")).distinct().withColumns({"_major": F.nullif(F.regexp_extract("_marker", pattern, 1), F.lit("")), "_minor": F.nullif(F.regexp_extract("_marker", pattern, 2), F.lit(""))})
    table = numerals.select(F.col("marker").alias("_n"), F.col("number").alias("_v")).where(F.col("number").between(least, most)).dropDuplicates(["_n"])
    for name in ("major", "minor"):
        known = known.join(table.select(F.col("_n").alias(f"_{name}"), F.col("_v").alias(name)), f"_{name}", "left")
    return items.join(known.select("_marker", "major", "minor"), items[marker] == known["_marker"], "left").drop("_marker")


def unresolved(resolved: DataFrame, marker: str) -> DataFrame:
    """Q1: the markers that no number was found for, with their counts."""
    return resolved.where("number IS NULL").groupBy(marker).agg(F.count("*").alias("n"))


def suffix_duplicates(items: DataFrame, key: list[str], name: str, order: list[str], out: str = "unique_name") -> DataFrame:
    """Q2: second and later occurrences of a name get _2, _3 and so on, in order."""
    at = F.row_number().over(Window.partitionBy(*key, name).orderBy(*order))
    return items.withColumn(out, F.when(at == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), at.cast("string"))))


def renumber_by_appearance(items: DataFrame, key: list[str], group: str, order: str, last: str | None = None) -> DataFrame:
    """Q3: groups numbered by first appearance (`last` behind all others), items numbered inside."""
    first = F.min(order).over(Window.partitionBy(*key, group))
    rank = F.dense_rank().over(Window.partitionBy(*key).orderBy(F.coalesce(F.col(group) == F.lit(last), F.lit(False)), "_first", group))
    return items.withColumn("_first", first).withColumns({"group_no": rank, "item_no": F.row_number().over(Window.partitionBy(*key, group).orderBy(order))}).drop("_first")


def gap_report(items: DataFrame, key: list[str], num: str) -> DataFrame:
    """Q4: (key, kind, from_no, to_no): 'start' if the least number is not 1, 'gap' with the missing range, 'duplicate' with its number."""
    counts = items.where(F.col(num).isNotNull()).groupBy(*key, num).agg(F.count("*").alias("_n"))
    before = F.lag(num).over(_order(key, [num]))
    found = counts.withColumn("_before", before)
    issue = F.array_compact(F.array(
        F.when(F.col("_before").isNull() & (F.col(num) != 1), F.struct(F.lit("start").alias("kind"), F.lit(1).cast("long").alias("from_no"), (F.col(num) - 1).cast("long").alias("to_no"))),
        F.when(F.col(num) - F.col("_before") > 1, F.struct(F.lit("gap").alias("kind"), (F.col("_before") + 1).cast("long").alias("from_no"), (F.col(num) - 1).cast("long").alias("to_no"))),
        F.when(F.col("_n") > 1, F.struct(F.lit("duplicate").alias("kind"), F.col(num).cast("long").alias("from_no"), F.col(num).cast("long").alias("to_no"))),
    ))
    return found.select(*key, F.explode(issue).alias("_i")).select(*key, "_i.*")


def merge_continuous(sections: DataFrame, key: list[str], first: str, last: str, sums: list[str], source: str) -> DataFrame:
    """Q5: neighbours merge where first = last of the one before + 1: sums, the first known source, and the list of what was merged."""
    w = _order(key, [first, last])
    marked = sections.withColumn("_break", F.coalesce((F.col(first) != F.lag(last).over(w) + 1).cast("int"), F.lit(0)))
    islands = marked.withColumn("island", 1 + F.sum("_break").over(w))
    own = F.array_sort(F.collect_list(F.struct(F.col(first).alias("f"), F.col(source).alias("s"))))
    return islands.groupBy(*key, "island").agg(F.min(first).alias(first), F.max(last).alias(last), F.count("*").alias("n_merged"), *(F.sum(c).alias(c) for c in sums), F.element_at(F.filter(F.transform(own, lambda x: x["s"]), lambda s: s.isNotNull()), 1).alias(source))


def suggest_relations(sections: DataFrame, key: list[str], first: str, last: str, most_gap: int) -> DataFrame:
    """Q5: (key, from_last, to_first, gap, relation) of neighbouring sections: 'continues' (gap 0), 'gap' up to most_gap missing numbers, or 'overlap'; others are unrelated and not listed."""
    w = _order(key, [first, last])
    pairs = sections.select(*key, F.lag(last).over(w).alias("from_last"), F.col(first).alias("to_first")).withColumn("gap", F.col("to_first") - F.col("from_last") - 1)
    relation = F.when(F.col("gap") == 0, "continues").when(F.col("gap") < 0, "overlap").when(F.col("gap") <= most_gap, "gap")
    return pairs.withColumn("relation", relation).where("relation IS NOT NULL")


def flag_misplaced(items: DataFrame, key: list[str], num: str, order: list[str], jump: int = 2) -> DataFrame:
    """Q6: misplaced is true from the first rise by more than `jump` on."""
    w = _order(key, order)
    leap = F.coalesce(F.col(num) - F.lag(num).over(w) > jump, F.lit(False))
    return items.withColumn("_leap", leap).withColumn("misplaced", F.max("_leap").over(w)).drop("_leap")


def first_late_section(items: DataFrame, doc: list[str], section: str, num: str, order: list[str], high: int = 9, among: int = 3) -> DataFrame:
    """Q6: (doc, section) of the first section of each document that shows a number of `high` or more among its first `among`."""
    early = items.withColumn("_at", F.row_number().over(_order([*doc, section], order))).where((F.col("_at") <= among) & (F.col(num) >= high))
    return early.groupBy(*doc).agg(F.min(section).alias(section))


def move_misplaced(items: DataFrame, doc: list[str], section: str, num: str, flag: str = "misplaced", step: int = 1) -> DataFrame:
    """Q7: flagged items go to the section `step` on; items are numbered anew inside by (number, old section)."""
    moved = items.withColumn("_was", F.col(section)).withColumn(section, F.col(section) + F.when(F.col(flag), step).otherwise(0))
    return moved.withColumn("item_no", F.row_number().over(Window.partitionBy(*doc, section).orderBy(num, "_was"))).drop("_was")


def dedupe_first(items: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """Q8: the first row of each key by order."""
    return items.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")


def drop_noise_items(items: DataFrame, text: str, min_chars: int, min_words: int, noise: str, cues: str | None = None) -> DataFrame:
    """Q9: add reason: 'short', 'noise' (what is left without the noise pattern is under 10 characters), 'repetitive' (fewer distinct words than min_words), 'no_cue' (no match of the cues that an instruction has, if given), or null for a good item."""
    body = F.coalesce(F.trim(F.col(text)), F.lit(""))
    words = F.size(F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit(r"([^\s]+)"), F.lit(1))))
    reason = F.when(F.length(body) < min_chars, "short").when(F.length(F.regexp_replace(body, noise, "")) < 10, "noise").when(words < min_words, "repetitive")
    return items.withColumn("reason", reason if cues is None else reason.when(~body.rlike(cues), "no_cue"))


def check_expectations(counts: DataFrame, expected: DataFrame, key: list[str], tol: int) -> DataFrame:
    """Q10: (key, actual, expected, issue) for keys that are missing, unexpected or off by more than tol."""
    both = counts.withColumnRenamed("n", "actual").join(expected.withColumnRenamed("n", "expected"), key, "full_outer")
    issue = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected").when(F.abs(F.col("actual") - F.col("expected")) > tol, "off")
    return both.withColumn("issue", issue).where("issue IS NOT NULL")


def rebalance_blocks(items: DataFrame, doc: str, block: str, order: list[str], want: int) -> DataFrame:
    """Q11: if block 1 has fewer than `want` items and block 2 can spare them, the head of block 2 moves over; items are numbered anew."""
    sizes = Window.partitionBy(doc)
    at = F.row_number().over(Window.partitionBy(doc, block).orderBy(*order))
    # places first, so that the sizes find rows sorted by them; new numbers follow from both and need no further sort
    marked = items.repartition(doc).withColumn("_at", at).withColumns({"_ones": F.count_if(F.col(block) == 1).over(sizes), "_spare": F.count_if(F.col(block) == 2).over(sizes)})
    need = F.lit(want) - F.col("_ones")
    able = (F.col(block) == 2) & (need > 0) & (F.col("_spare") > need)
    goes = able & (F.col("_at") <= need)
    number = F.when(goes, F.col("_ones") + F.col("_at")).when(able, F.col("_at") - need).otherwise(F.col("_at")).cast("int")
    moved = marked.withColumns({"item_no": number, block: F.when(goes, 1).otherwise(F.col(block))})
    return moved.drop("_ones", "_spare", "_at")


def anchor_sort(items: DataFrame, key: list[str], text: str, anchors: list[str], order: list[str]) -> DataFrame:
    """Q12: item_no by the first anchor that the text holds (99 without one), then by order."""
    rank = F.coalesce(*(F.when(F.contains(F.col(text), F.lit(a)), i) for i, a in enumerate(anchors)), F.lit(99))
    return items.withColumn("anchor", rank).withColumn("item_no", F.row_number().over(Window.partitionBy(*key).orderBy("anchor", *order)))
