"""Segmentation: markers, segments, headings, hierarchies and page layout. Positions are 0-based characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docstruct.functions.fold import CitedSegments, KeepApart, TrueMarkers, fold_sorted
from docstruct.functions.positions import join_on, locate_matches, of_rule


def lines_with_offsets(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys, line_no, line, pos) of every line; null texts have one empty line."""
    return locate_matches(docs, [], F.col(text), keys, lines=True).select(*keys, F.col("i").alias("line_no"), F.col("found").alias("line"), "pos")


def find_markers(docs: DataFrame, rules: list[tuple[str, str, int]], text: str, keys: list[str], group: int = 0, anywhere: bool = False, line: bool = False) -> DataFrame:
    """G1: (keys, line_no, pos, end, rule, priority, marker) of the matches of rules (name, pattern, priority) at line starts, or anywhere; marker is the pattern's `group` (0: all). With `line`, also the line that the marker begins in.

    Anywhere, the starts of lines join the stream of matches, and each match takes the last one before it: one pass in the
    order of positions, linear in matches and lines. Rows with null or repeated keys are found each.
    """
    extra = ["line"] if line else []
    if anywhere:
        hits = locate_matches(docs, [(name, p) for name, p, _ in rules], F.col(text), keys, group, lines=True, line_text=line)
        begins = F.col("rule_no") == len(rules)
        held = F.struct(F.col("i").alias("line_no"), *[F.col("found").alias("line")] * line)
        latest = F.last(F.when(begins, held), ignorenulls=True).over(Window.partitionBy("_row").orderBy("pos", (~begins).cast("int")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = hits.withColumn("_l", latest).where(~begins)
        return placed.select(*keys, "_l.line_no", "pos", "end", of_rule(F.col("rule_no"), [r[0] for r in rules]).alias("rule"), of_rule(F.col("rule_no"), [r[2] for r in rules]).alias("priority"), F.col("found").alias("marker"), *(["_l.line"] if line else []))
    hits = F.array_compact(F.array(*(F.when(F.col("line").rlike(f"^(?:{p})"), F.struct(F.lit(name).alias("rule"), F.lit(priority).alias("priority"), F.length(F.regexp_extract("line", f"^(?:{p})", 0)).alias("size"), F.regexp_extract("line", f"^(?:{p})", group).alias("marker"))) for name, p, priority in rules)))
    found = lines_with_offsets(docs, text, keys).select(*keys, "line_no", "line", "pos", F.explode(hits).alias("_h"))
    return found.select(*keys, "line_no", "pos", (F.col("pos") + F.col("_h.size")).alias("end"), "_h.rule", "_h.priority", "_h.marker", *extra)


def select_markers(markers: DataFrame, keys: list[str], min_gap: int, excluded: Column | None = None) -> DataFrame:
    """The true markers (pos, number, priority) of each document: the "1" of best priority (the earliest on a tie), then in order of position.

    excluded: a test for markers in the context of small questions, which are no candidates. One pass over a document's
    sorted markers carries the last one kept, in constant memory. Null keys are a document.
    """
    some = markers if excluded is None else markers.where(~F.coalesce(excluded, F.lit(False)))
    some = some.select(*keys, F.col("pos").cast("long").alias("pos"), F.col("number").cast("long").alias("number"), F.col("priority").cast("int").alias("priority"))
    first = some.where("number = 1").groupBy(*keys).agg(F.max_by("pos", F.struct("priority", -F.col("pos"))).alias("_from"))
    own = join_on(some, first, keys).where((F.col("pos") > F.col("_from")) | ((F.col("pos") == F.col("_from")) & (F.col("number") == 1)))
    kept = fold_sorted(own, keys, ["pos", "number", "priority"], "pos long, number long, priority int", lambda: TrueMarkers(min_gap))
    return kept.select(*keys, *(F.col(c).cast(markers.schema[c].dataType).alias(c) for c in ("pos", "number", "priority")))


def cut_segments(docs: DataFrame, markers: DataFrame, text: str, keys: list[str], least: int = 0) -> DataFrame:
    """(keys, segment_no, start, stop, segment): from each marker to the next or the end; a document without markers is one segment from 0. Segments under `least` characters go, the others keep their numbers.

    The keys name a document, null ones too; rows that repeat them share their markers.
    """
    w = Window.partitionBy(*keys).orderBy("pos")
    spans = markers.select(*keys, "pos").distinct().withColumns({"stop": F.lead("pos").over(w), "segment_no": F.row_number().over(w)})
    joined = join_on(docs.select(*keys, F.col(text).alias("_text")), spans, keys, "left")
    start, stop = F.coalesce("pos", F.lit(0)), F.coalesce("stop", F.length("_text"))
    cut = joined.select(*keys, F.coalesce("segment_no", F.lit(1)).alias("segment_no"), start.cast("long").alias("start"), stop.cast("long").alias("stop"), F.substring(F.col("_text"), (start + 1).cast("int"), (stop - start).cast("int")).alias("segment"))
    return cut.where(F.col("stop") - F.col("start") >= least) if least else cut


def equal_split(docs: DataFrame, n: int, text: str, keys: list[str]) -> DataFrame:
    """Lines in n equal groups, the remainder in the last: (keys, part, n_lines, segment)."""
    lines = docs.select(*keys, F.size(F.split(text, "\n", -1)).alias("_all"), F.posexplode(F.split(text, "\n", -1)).alias("i", "line"))
    part = F.least(F.expr(f"i div greatest(_all div {n}, 1)"), F.lit(n - 1)).cast("int")
    own = lines.withColumn("part", part).groupBy(*keys, "part").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("i", "line"))).alias("_l"))
    return own.select(*keys, "part", "n_lines", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("segment"))


def assign_heading(items: DataFrame, headings: DataFrame, keys: list[str], pos: str, heading: str) -> DataFrame:
    """Each item takes the latest heading at or before it, null if there is none."""
    both = items.withColumn(heading, F.lit(None).cast(headings.schema[heading].dataType)).withColumn("_item", F.lit(True)).unionByName(headings.select(*keys, pos, heading).withColumn("_item", F.lit(False)), allowMissingColumns=True)
    latest = F.last(heading, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(pos, "_item").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return both.withColumn(heading, latest).where("_item").drop("_item")


def build_hierarchy(lines: DataFrame, keys: list[str], order: list[str], level: Column) -> DataFrame:
    """Level 0, 1 or 2 of each line (null: none) into node_id, parent_id and level; nodes before their first parent are dropped."""
    leveled = lines.withColumn("level", level).where("level IS NOT NULL")
    w = Window.partitionBy(*keys).orderBy(*order)
    first = leveled.withColumn("_a", F.sum(F.when(F.col("level") == 0, 1).otherwise(0)).over(w))
    w = Window.partitionBy(*keys, "_a").orderBy(*order)
    second = first.where("_a > 0").withColumn("_b", F.sum(F.when(F.col("level") == 1, 1).otherwise(0)).over(w))
    w = Window.partitionBy(*keys, "_a", "_b").orderBy(*order)
    third = second.withColumn("_c", F.sum(F.when(F.col("level") == 2, 1).otherwise(0)).over(w)).where("level < 2 OR _b > 0")
    path = [F.col(c).cast("string") for c in ("_a", "_b", "_c")]
    node = F.when(F.col("level") == 0, path[0]).when(F.col("level") == 1, F.concat_ws("-", *path[:2])).otherwise(F.concat_ws("-", *path))
    parent = F.when(F.col("level") == 1, path[0]).when(F.col("level") == 2, F.concat_ws("-", *path[:2]))
    return third.withColumns({"node_id": node, "parent_id": parent}).drop("_a", "_b", "_c")


def extract_items(segments: DataFrame, patterns: list[str], text: str, keys: list[str], fallback: int = 20) -> DataFrame:
    """(keys, pattern_no, item_no, item) by the first pattern that yields anything; else the paragraphs over `fallback` characters as pattern 0."""
    tries = [F.struct(F.lit(i + 1).alias("pattern_no"), F.regexp_extract_all(F.col(text), F.lit(f"({p})"), F.lit(1)).alias("items")) for i, p in enumerate(patterns)]
    paragraphs = F.filter(F.split(text, "\n", -1), lambda x: F.length(x) > fallback)
    first = F.element_at(F.filter(F.array(*tries, F.struct(F.lit(0).alias("pattern_no"), paragraphs.alias("items"))), lambda x: (F.size(x["items"]) > 0) | (x["pattern_no"] == 0)), 1)
    return segments.select(*keys, first.alias("_f")).select(*keys, "_f.pattern_no", F.posexplode("_f.items").alias("item_no", "item"))


def choice_rows(rows: DataFrame, pattern: str, text: str, keys: list[str]) -> DataFrame:
    """(keys, choice_no, marker, choice): the options of each row by a pattern whose first group is the option's mark and whose second is its text, in order."""
    found = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias("marker"), F.trim(F.regexp_extract(m, pattern, 2)).alias("choice")))
    return rows.select(*keys, F.posexplode(found).alias("choice_no", "_c")).select(*keys, "choice_no", "_c.*")


def extract_choices(rows: DataFrame, pattern: str, text: str, keys: list[str]) -> DataFrame:
    """(keys, n_choices, n_distinct) of the pattern's first group."""
    return rows.select(*keys, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("choice")).groupBy(*keys).agg(F.count("*").alias("n_choices"), F.count_distinct("choice").alias("n_distinct"))


def thin_by_distance(hits: DataFrame, keys: list[str], pos: str, distance: int) -> DataFrame:
    """Hits at least `distance` behind the last kept one; one pass over a key's sorted hits, in constant memory however dense they are."""
    own = hits.select(*keys, F.col(pos).cast("long").alias(pos)).where(F.col(pos).isNotNull()).distinct()
    kept = fold_sorted(own, keys, [pos], f"`{pos}` long", lambda: KeepApart(distance))
    return kept.withColumn(pos, F.col(pos).cast(hits.schema[pos].dataType))


def split_by_citation(docs: DataFrame, citations: DataFrame, text: str, keys: list[str], least: int = 500, leading: str | None = None) -> DataFrame:
    """(keys, segment_no, kind, start, stop): segments end behind each citation's paragraph (the next blank line) once they have `least` characters; the text behind the last one is of kind 'plain'.

    What stands before the first citation is a segment 'leading' of its own if it matches the pattern `leading`, whatever
    its length. Paragraph ends and citations (keys, pos) are one stream in which each citation takes the next end; one pass
    over the ends keeps those far enough behind the last. Linear in both. The keys name a document, null ones too.
    """
    first = citations.groupBy(*keys).agg(F.min("pos").cast("int").alias("_first"))
    body = F.coalesce(F.col(text), F.lit(""))
    before = F.when(F.substring(body, F.lit(1), F.col("_first")).rlike(leading), F.col("_first")) if leading else F.lit(None).cast("int")
    heads = join_on(docs.select(*keys, text), first, keys, "left").select(*keys, F.length(body).cast("long").alias("_total"), F.when(F.col("_first") > 0, before).cast("long").alias("_lead"))
    blanks = locate_matches(docs, [("blank", "\n(?=\n)")], F.col(text), keys).select(*keys, "pos", (F.col("pos") + 2).alias("_end"), F.lit(False).alias("_cited"))
    stream = blanks.union(heads.select(*keys, "_total", "_total", F.lit(False))).union(citations.select(*keys, F.col("pos").cast("long"), F.lit(None).cast("long"), F.lit(True)))
    following = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("pos"), "_cited").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = stream.withColumn("at", following).where("_cited").select(*keys, "at", F.lit(1).alias("kind")).where("at IS NOT NULL").distinct()
    places = ends.union(heads.where("_lead IS NOT NULL").select(*keys, "_lead", F.lit(0))).union(heads.select(*keys, "_total", F.lit(2)))
    return fold_sorted(places, keys, ["at", "kind"], "segment_no int, kind string, start long, stop long", lambda: CitedSegments(least))


def reading_order(blocks: DataFrame, doc: str, tie: list[str] | None = None) -> DataFrame:
    """Add column (0 left or whole, 1 right) and order_no by page, column, height, and the columns `tie`.

    A page is in two columns if more than 3 blocks lie on each side of its middle and their heights overlap.
    """
    page = Window.partitionBy(doc, "page")
    sided = blocks.withColumn("_mid", F.max("x1").over(page) / 2).withColumn("_side", F.when(F.col("x1") <= F.col("_mid") * 1.1, 0).when(F.col("x0") >= F.col("_mid") * 0.9, 1))
    span = {f"_{f.__name__}{s}": f(F.when(F.col("_side") == s, F.col(c))).over(page) for s in (0, 1) for f, c in ((F.min, "y0"), (F.max, "y1"))}
    span |= {f"_n{s}": F.count_if(F.col("_side") == s).over(page) for s in (0, 1)}
    two = (F.col("_n0") > 3) & (F.col("_n1") > 3) & (F.col("_min0") < F.col("_max1")) & (F.col("_min1") < F.col("_max0"))
    placed = sided.withColumns(span).withColumn("column", F.when(two & (F.col("_side") == 1), 1).otherwise(0))
    order = F.row_number().over(Window.partitionBy(doc).orderBy("page", "column", "y0", "x0", *(tie or [])))
    return placed.withColumn("order_no", order).select(*blocks.columns, "column", "order_no")


def assemble_blocks(ordered: DataFrame, doc: str) -> DataFrame:
    """(doc, section_no, title, n_questions, source, body): a title starts a section; what precedes the first title is section 0."""
    w = Window.partitionBy(doc).orderBy("order_no")
    own = ordered.withColumn("section_no", F.sum(F.when(F.col("block_type") == "title", 1).otherwise(0)).over(w))
    pick = lambda kind: F.min_by("text", F.when(F.col("block_type") == kind, F.col("order_no")))
    body = F.array_sort(F.collect_list(F.when(~F.col("block_type").isin("title", "source"), F.struct("order_no", "text"))))
    return own.groupBy(doc, "section_no").agg(F.max(F.when(F.col("block_type") == "title", F.col("text"))).alias("title"), F.count_if(F.col("block_type") == "question").alias("n_questions"), F.max(F.when(F.col("block_type") == "source", F.col("text"))).alias("source"), F.array_join(F.transform(body, lambda x: x["text"]), "\n").alias("body"))


def merge_pages(items: DataFrame, keys: list[str], text: str, order: str) -> DataFrame:
    """Per key the longest text, the first on a tie, with the number of its candidates; null and empty texts are invalid."""
    valid = items.where(F.length(F.trim(text)) > 0)
    best = Window.partitionBy(*keys).orderBy(F.desc(F.length(text)), order)
    return valid.withColumns({"_r": F.row_number().over(best), "n_candidates": F.count("*").over(Window.partitionBy(*keys))}).where("_r = 1").drop("_r")
