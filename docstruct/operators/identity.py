"""Identity of a document: its year among candidates, year ranges, entity by aliases, length limits and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docstruct.functions.numerals import spoken_number
from docstruct.operators.dictionary import present_terms
from docstruct.operators.lexicon import best_by


def _by_rule(rule: str, values: dict[str, int]) -> Column:
    """The rule's value, null for a rule without one."""
    return F.coalesce(*(F.when(F.col(rule) == name, F.lit(v)) for name, v in values.items()), F.lit(None).cast("int"))


def select_year(candidates: DataFrame, keys: list[str], bonus: dict[str, int], priority: dict[str, int], recent: int, old: int) -> DataFrame:
    """(keys, year, score, step) of one year among the candidates (keys, year, pos, rule, excluded).

    A candidate earns 10 before position 50 and 5 before 200, and its rule's bonus; a year earns 5 from `recent` on, loses
    5 before `old` and 8 in an excluded context. The best score above zero wins (step 'score'), else the rule of highest
    priority ('priority'), else the latest year ('latest'); ties go to the first position, then to the later year.
    """
    place = F.when(F.col("pos") < 50, 10).when(F.col("pos") < 200, 5).otherwise(0)
    points = F.sum(place + F.coalesce(_by_rule("rule", bonus), F.lit(0)))
    age = F.when(F.col("year") >= recent, 5).when(F.col("year") < old, -5).otherwise(0)
    found = candidates.groupBy(*keys, "year").agg(points.alias("_p"), F.bool_or("excluded").alias("_x"), F.max(_by_rule("rule", priority)).alias("_rule"), F.min("pos").alias("_pos"))
    scored = found.withColumn("score", (F.col("_p") + age - F.when(F.col("_x"), 8).otherwise(0)).cast("long"))
    step = F.when(F.col("score") > 0, "score").when(F.col("_rule").isNotNull(), "priority").otherwise("latest")
    scored = scored.withColumn("step", step)
    order = [F.desc(F.greatest("score", F.lit(0))), F.desc(F.when(F.col("score") <= 0, F.coalesce("_rule", F.lit(-1)))), F.when(F.col("step") != "latest", F.col("_pos")), F.desc("year")]
    return best_by(scored, keys, order).select(*keys, "year", "score", "step")


def expand_year_range(docs: DataFrame, name: str, pivot: int = 50) -> DataFrame:
    """E5: one row per year of a name's range 'yy-yy', with column year; a name without a valid range keeps one row with a null year."""
    first, last = (F.regexp_extract(name, r"([0-9]{2})-([0-9]{2})", i).try_cast("int") for i in (1, 2))
    years = [v + F.when(v < pivot, 2000).otherwise(1900) for v in (first, last)]
    return docs.withColumn("year", F.explode_outer(F.when(years[0] <= years[1], F.sequence(*years))))


def year_confidence(candidates: DataFrame, keys: list[str], name_rule: str, strong: list[str], weak: str) -> DataFrame:
    """(keys, confidence): 0.5 for the name's rule, 0.2 for several rules, 0.2 for consecutive years, then 0.3 for a strong rule, at least 0.3 for the weak rule alone, else 0.1; at most 1."""
    rules, years = F.count_distinct("rule"), F.count_distinct("year")
    own = candidates.groupBy(*keys).agg(rules.alias("_r"), years.alias("_y"), (F.max("year") - F.min("year")).alias("_d"), F.bool_or(F.col("rule") == name_rule).alias("_name"), F.bool_or(F.col("rule").isin(strong)).alias("_s"), F.bool_or(F.col("rule") == weak).alias("_w"))
    tenths = F.when(F.col("_name"), 5).otherwise(0) + F.when(F.col("_r") > 1, 2).otherwise(0) + F.when((F.col("_y") > 1) & (F.col("_d") == F.col("_y") - 1), 2).otherwise(0)
    total = F.when(F.col("_s"), tenths + 3).when(F.col("_w") & (F.col("_r") == 1), F.greatest(tenths, F.lit(3))).otherwise(tenths + 1)
    return own.select(*keys, (F.least(total, F.lit(10)) / 10.0).alias("confidence"))


def detect_entity(docs: DataFrame, aliases: DataFrame, text: str, path: str, keys: list[str], head: int = 1000) -> DataFrame:
    """(keys, entity, score, confidence) of the best entity of aliases (alias, entity, priority, alias_rank).

    A hit among the first `head` characters counts twice the priority, up to three later ones once each, the file's name
    once and its folder's name 0.8 times. Aliases are lower-case and in any script, see present_terms(); confidence = min(score / 10, 1).
    """
    parts = F.split(F.coalesce(F.col(path), F.lit("")), "/")
    body = F.coalesce(F.col(text), F.lit(""))
    zones = {"head": F.substring(body, 1, head), "rest": F.substring(body, F.lit(head + 1), F.length(body)), "file": F.element_at(parts, -1), "folder": F.try_element_at(parts, F.lit(-2))}
    numbered = docs.select("*", F.monotonically_increasing_id().alias("_doc"))
    placed = numbered.select(*keys, "_doc", F.explode(F.array(*(F.struct(F.lit(z).alias("zone"), F.lower(c).alias("body")) for z, c in zones.items()))).alias("_z")).select(*keys, "_doc", "_z.*")
    hits = present_terms(placed, aliases, "body", [*keys, "_doc", "zone"], "alias").withColumnRenamed("term", "alias")
    counts = hits.join(aliases, "alias")
    points = F.col("priority") * F.when(F.col("zone") == "head", 2 * F.col("n")).when(F.col("zone") == "rest", F.least("n", F.lit(3))).when(F.col("zone") == "file", 1.0).otherwise(0.8)
    scores = counts.groupBy(*keys, "_doc", "entity").agg(F.round(F.sum(points), 1).alias("score"), F.min("alias_rank").alias("_first"))
    best = best_by(scores, [*keys, "_doc"], [F.desc("score"), F.col("_first"), F.col("entity")])
    return best.select(*keys, "entity", "score", F.round(F.least(F.col("score") / 10, F.lit(1.0)), 4).alias("confidence"))


def subject_and_kind(docs: DataFrame, subjects: list[tuple[str, str]], kinds: list[tuple[str, str]], text: str, keys: list[str], lines: int = 10) -> DataFrame:
    """(keys, subject, kind): the first rule (name, pattern) of each list that one of a text's first lines matches, null if none."""
    head = F.array_join(F.slice(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), 1, lines), "\n")
    first = lambda rules: F.coalesce(*(F.when(F.col("_head").rlike(p), F.lit(name)) for name, p in rules), F.lit(None).cast("string"))
    return docs.select(*keys, head.alias("_head")).select(*keys, first(subjects).alias("subject"), first(kinds).alias("kind"))


#: Limits of answers in Japanese papers, in order, for limit_histogram().
_NUMBER = "([0-9０-９一二三四五六七八九十百千〇]+)"
JAPANESE_LIMITS = [
    ("range", f"{_NUMBER}字(?:以上|から|[～~ー-])、?{_NUMBER}字(?:以内|以下|まで)?"),
    ("most", f"{_NUMBER}字(?:以内|以下|まで)"),
    ("about", f"(?:約|およそ){_NUMBER}字"),
    ("about", f"{_NUMBER}字(?:程度|前後|くらい|ほど)"),
    ("lines", f"{_NUMBER}行"),
    ("exact", f"{_NUMBER}字で"),
]


def limit_histogram(questions: DataFrame, rules: list[tuple[str, str]], text: str, by: list[str], line_chars: int = 40) -> DataFrame:
    """(by, label, least, most, n, pct) of the length limits that the first matching rule (kind, pattern) finds.

    A pattern has one number, for 'range' two, in any script that spoken_number() reads. 'most' bounds from above, 'about'
    by 20 % on both sides, 'lines' likewise with `line_chars` characters a line, 'exact' is both bounds, 'range' names
    them; questions without a limit have the label 'none', so that shares of both kinds stand side by side.
    """
    limits = []
    for kind, pattern in rules:
        number = spoken_number(F.regexp_extract(text, pattern, 1))
        size = number * (line_chars if kind == "lines" else 1)
        second = spoken_number(F.regexp_extract(text, pattern, 2)) if kind == "range" else size
        least = {"most": F.lit(0).cast("long"), "range": F.least(size, second), "exact": size}.get(kind, F.round(size * 8 / 10).cast("long"))
        most = {"most": size, "range": F.greatest(size, second), "exact": size}.get(kind, F.round(size * 12 / 10).cast("long"))
        label = F.concat_ws("-", least.cast("string"), most.cast("string")) if kind == "range" else F.concat_ws(" ", size.cast("string"), F.lit(kind if kind in ("most", "exact") else "about"))
        limits.append(F.when(number.isNotNull() & second.isNotNull(), F.struct(label.alias("label"), least.alias("least"), most.alias("most"))))
    none = F.struct(F.lit("none").alias("label"), F.lit(None).cast("long").alias("least"), F.lit(None).cast("long").alias("most"))
    counts = questions.select(*by, F.coalesce(*limits, none).alias("_l")).groupBy(*by, "_l").agg(F.count("*").alias("n"))
    share = F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 1)
    return counts.select(*by, "_l.*", "n", share.alias("pct"))


def score_sheet(sheets: DataFrame, questions: DataFrame, rules: list[str], total: str, text: str, keys: list[str], number: str) -> DataFrame:
    """The questions with their points and the sheet's total points, null where the sheet has none.

    A rule is a pattern of two numbers, question and points; the last match of the last rule wins. A sheet may have many questions, but a row a match.
    """

    def matches(k: int, p: str) -> Column:
        part = lambda m, i: F.regexp_extract(m, p, i).try_cast("long")
        return F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m, i: F.struct(F.lit(k).alias("_rule"), i.alias("_pos"), part(m, 1).alias(number), part(m, 2).alias("points")))

    found = F.concat(*(matches(k, p) for k, p in enumerate(rules)))
    points = sheets.select(*keys, F.explode(found).alias("_m")).groupBy(*keys, F.col("_m")[number].alias(number)).agg(F.max_by("_m.points", F.struct("_m._rule", "_m._pos")).alias("points"))
    totals = sheets.select(*keys, F.regexp_extract(text, total, 1).try_cast("long").alias("total_points"))
    return questions.join(points, [*keys, number], "left").join(totals, keys, "left")
