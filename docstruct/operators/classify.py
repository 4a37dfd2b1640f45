"""Classification, identity and theme decisions by rule tables. Rules are (label, pattern) in order, or weighted (class, pattern, weight)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docstruct.functions.positions import join_on, locate_matches, of_rule


@dataclass(frozen=True)
class Shape:
    """A rule of a text's structure for classify_first(); all that is set must hold.

    least and most bound its trimmed length, items is the least number of matches of item, holds a pattern anywhere, ends
    a pattern within its last end_chars characters (a citation's place).
    """

    least: int | None = None
    most: int | None = None
    item: str | None = None
    items: int = 1
    holds: str | None = None
    ends: str | None = None
    end_chars: int = 200

    def test(self, text: str) -> Column:
        body = F.trim(F.coalesce(F.col(text), F.lit("")))
        checks = [F.length(body) >= self.least] if self.least is not None else []
        checks += [F.length(body) <= self.most] if self.most is not None else []
        checks += [F.regexp_count(body, F.lit(self.item)) >= self.items] if self.item else []
        checks += [body.rlike(self.holds)] if self.holds else []
        checks += [F.right(body, F.lit(self.end_chars)).rlike(self.ends)] if self.ends else []
        out = F.lit(True)
        for one in checks:
            out = out & one
        return out


def classify_first(rows: DataFrame, rules: list[tuple[str, str | Shape]], text: str, default: str) -> DataFrame:
    """The first rule that holds of the text, a pattern that it has or a Shape, else the default."""
    tests = [(name, rule.test(text) if isinstance(rule, Shape) else F.col(text).rlike(rule)) for name, rule in rules]
    return rows.withColumn("label", F.coalesce(*(F.when(test, F.lit(name)) for name, test in tests), F.lit(default)))


def classify_multi(rows: DataFrame, rules: list[tuple[str, str]], text: str, keys: list[str]) -> DataFrame:
    """A row (keys, label) for every label that matches, 'none' if none does."""
    found = F.array_compact(F.array_distinct(F.array(*(F.when(F.col(text).rlike(p), F.lit(name)) for name, p in rules))))
    return rows.select(*keys, F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("none")))).alias("label"))


def score_weighted(rows: DataFrame, rules: list[tuple[str, str, float]], text: str, keys: list[str], boosts: tuple[tuple[str, str, float], ...] = (), flag: str | None = None, mixed: str = "mixed", current: str = "current") -> DataFrame:
    """(keys, best, score, total, decision) by weighted rules (class, pattern, weight) and boosts (class, pattern, points).

    A class scores count x weight of its rules, and a boost's points once if its pattern is found. The decision is the
    first step that holds: a score of 3 or more: best; at least 0.7 of the total: best; a text that matches `flag`: best
    with at least half of the total, else `current`; a score of 2 or more: best; else `mixed`. Ties go to the class declared first.
    """
    classes = list(dict.fromkeys([c for c, _, _ in rules] + [c for c, _, _ in boosts]))
    body = F.coalesce(F.col(text), F.lit(""))
    scores = {c: sum((F.regexp_count(body, F.lit(p)) * F.lit(float(w)) for k, p, w in rules if k == c), F.lit(0.0)) + sum((F.when(body.rlike(p), F.lit(float(w))).otherwise(0.0) for k, p, w in boosts if k == c), F.lit(0.0)) for c in classes}
    flagged = body.rlike(flag) if flag else F.lit(False)
    out = rows.select(*keys, flagged.alias("_flag"), *(F.round(s, 4).alias(f"_{c}") for c, s in scores.items()))
    top, total = F.greatest(*(F.col(f"_{c}") for c in classes)), sum((F.col(f"_{c}") for c in classes), F.lit(0.0))
    best = F.coalesce(*(F.when(F.col(f"_{c}") == F.col("score"), F.lit(c)) for c in classes))
    out = out.withColumns({"score": top if len(classes) > 1 else F.col(f"_{classes[0]}"), "total": F.round(total, 4)}).withColumn("best", best)
    share = F.col("score") / F.nullif(F.col("total"), F.lit(0.0))
    decision = F.when(F.col("score") >= 3, F.col("best")).when(share >= 0.7, F.col("best")).when(F.col("_flag"), F.when(share >= 0.5, F.col("best")).otherwise(current)).when(F.col("score") >= 2, F.col("best")).otherwise(mixed)
    return out.select(*keys, "best", "score", "total", decision.alias("decision"))


def top_labels_within(scores: DataFrame, keys: list[str], label: str, score: str, ratio: float, k: int) -> DataFrame:
    """Labels of at least `ratio` of the best score, at most k, joined best first."""
    w = Window.partitionBy(*keys)
    near = scores.withColumns({"_top": F.max(score).over(w), "_r": F.row_number().over(w.orderBy(F.desc(score), label))}).where((F.col(score) >= ratio * F.col("_top")) & (F.col("_r") <= k))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(label).alias("l")))), lambda x: x["l"])
    return near.groupBy(*keys).agg(F.array_join(listed, "+").alias("labels"))


def impute_dominant(rows: DataFrame, keys: list[str], label: str, mixed: str, feature: Column, least: float) -> DataFrame:
    """Rows labelled `mixed` that show the feature take the label that at least `least` of the key's other rows have."""
    counts = rows.where(F.col(label) != mixed).groupBy(*keys, label).agg(F.count("*").alias("_n"))
    shares = counts.withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys))).where(F.col("_n") >= least * F.col("_all"))
    dominant = shares.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), label))).where("_r = 1").select(*keys, F.col(label).alias("_dominant"))
    joined = rows.join(dominant, keys, "left")
    return joined.withColumn("imputed", F.when((F.col(label) == mixed) & feature, F.coalesce("_dominant", label)).otherwise(F.col(label))).drop("_dominant")


def choice_theme(choices: DataFrame, keys: list[str], tests: list[tuple[str, Column]], least: float = 0.6, concrete: tuple[Column, Column, list[str]] | None = None) -> DataFrame:
    """(keys, n, theme): the first theme whose test holds for at least `least` of a key's options, else the first concrete option.

    concrete: (an option's text, the test that it is concrete, columns that order the options); without it the theme is null.
    """
    picks = []
    if concrete:
        option, holds, order = concrete
        picks = [F.min_by(option, F.when(F.coalesce(holds, F.lit(False)), F.struct(*order))).alias("_concrete")]
    shares = choices.groupBy(*keys).agg(F.count("*").alias("n"), *picks, *(F.avg(F.coalesce(c, F.lit(False)).cast("int")).alias(f"_{name}") for name, c in tests))
    theme = [F.when(F.col(f"_{name}") >= least, F.lit(name)) for name, _ in tests]
    return shares.withColumn("theme", F.coalesce(*theme, *(["_concrete"] if concrete else []))).select(*keys, "n", "theme")


def decide_by_evidence(candidates: DataFrame, keys: list[str], score: str, tag: str, tags: list[str], order: str, field: str | None = None, proposed: str | None = None, strong: float = 30) -> DataFrame:
    """H2: the candidate of the highest score; ties by the tags' order, then by order. confidence = min(0.98, 0.5 + score / 100).

    With `field` and `proposed`, the column final_field is the candidate's proposed field where its score is `strong` at least, else the row's own.
    """
    rank = F.coalesce(F.array_position(F.lit(tags), F.col(tag)), F.lit(0))
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.when(rank == 0, len(tags) + 1).otherwise(rank), order)
    best = candidates.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").withColumn("confidence", F.round(F.least(F.lit(0.98), F.lit(0.5) + F.col(score) / 100), 4))
    return best.withColumn("final_field", F.when((F.col(score) >= strong) & F.col(proposed).isNotNull(), F.col(proposed)).otherwise(F.col(field))) if field and proposed else best


@dataclass(frozen=True)
class YearRule:
    """A pattern whose first group is a number; form: 'western' (a whole year), 'era' (the year is base + number) or 'two' (two digits, split at the pivot). Of all zones, or of one."""

    name: str
    pattern: str
    priority: int
    form: str = "western"
    base: int = 0
    zone: str | None = None


#: Digits that stand for 0 to 9, in the order of the second text. Ten is a place of its own.
_DIGITS = ("０１２３４５６７８９〇零一二三四五六七八九壱弐参肆伍陸柒捌玖", "012345678900123456789123456789")
_TEN = "十"
#: The first year of an era is base + 1.
REIWA, HEISEI = 2018, 1988
_KANJI = "[一二三四五六七八九十]"
#: Fixed value: two digits of a year in a text or a name.
_TWO_DIGITS = r"(?<![(0-9\n平成令和])([0-9]{2})年度?(?![)0-9])"
#: The rule pack for Japanese examination papers: whole years, eras by name and letter, two digits.
JAPANESE_YEARS = (
    YearRule("kanji", r"([〇零一二三四五六七八九０-９]{4})年度?", 11),
    YearRule("four_digits", r"(?<![0-9])((?:19|20)[0-9]{2})(?![0-9])", 9),
    YearRule("reiwa", r"令和([0-9０-９]{1,2}|" + _KANJI + "{1,3})", 8, "era", REIWA),
    YearRule("heisei", r"平成([0-9０-９]{1,2}|" + _KANJI + "{1,3})", 7, "era", HEISEI),
    YearRule("letter_r", r"(?<![A-Za-z])R([0-9]{1,2})(?![0-9])", 8, "era", REIWA, "name"),
    YearRule("letter_h", r"(?<![A-Za-z])H([0-9]{1,2})(?![0-9])", 7, "era", HEISEI, "name"),
    YearRule("two_digits", _TWO_DIGITS, 5, "two"),
)


def year_number(found: Column) -> Column:
    """The whole number that digits of any of these scripts say, null if none: 'X ten Y' is 10 X + Y, others are read place by place."""
    plain = F.translate(found, *_DIGITS)
    tens, ones = F.split_part(plain, F.lit(_TEN), F.lit(1)), F.split_part(plain, F.lit(_TEN), F.lit(2))
    with_ten = F.when(tens == "", 1).otherwise(tens.try_cast("int")) * 10 + F.when(ones == "", 0).otherwise(ones.try_cast("int"))
    return F.when(F.contains(plain, F.lit(_TEN)), with_ten).otherwise(plain.try_cast("int"))


def year_candidates(docs: DataFrame, text: str, keys: list[str], name: str | None = None, rules: tuple[YearRule, ...] = JAPANESE_YEARS, least: int = 1990, most: int = 2030, pivot: int = 50) -> DataFrame:
    """(keys, zone, rule, priority, pos, year): every mention of a year in the text and, if given, in the name, as a Western year within bounds.

    Each rule's matches are found on their own, with 0-based positions in their zone ('text', 'name'); two digits below
    the pivot are of this century. Null texts and names have none.
    """
    found = None
    for zone, column in (("text", text), ("name", name)):
        own = [r for r in rules if r.zone in (None, zone)]
        if column is None or not own:
            continue
        hits = locate_matches(docs, [(r.name, r.pattern) for r in own], F.col(column), keys, 1).withColumn("_v", year_number(F.col("found")))
        base = F.when(of_rule(F.col("rule_no"), [r.form for r in own]) == "two", F.when(F.col("_v") < pivot, 2000).otherwise(1900)).otherwise(of_rule(F.col("rule_no"), [r.base for r in own]))
        rows = hits.select(*keys, F.lit(zone).alias("zone"), of_rule(F.col("rule_no"), [r.name for r in own]).alias("rule"), of_rule(F.col("rule_no"), [r.priority for r in own]).alias("priority"), "pos", (F.col("_v") + base).alias("year"))
        found = rows if found is None else found.union(rows)
    return found.where(F.col("year").between(least, most))


def excluded_years(docs: DataFrame, text: str, keys: list[str], contexts: list[str]) -> DataFrame:
    """(keys, year) of the years that the contexts (patterns with one four-digit group) mention."""
    hits = locate_matches(docs, [(p, p) for p in contexts], F.col(text), keys, 1)
    return hits.select(*keys, F.col("found").try_cast("int").alias("year")).where("year IS NOT NULL").distinct()


def exclude_context(candidates: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose year does not stand among the excluded of the same keys."""
    return join_on(candidates, excluded, [*keys, "year"], "left_anti")


def keep_year_range(years: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, first, last, is_range): 2 or 3 consecutive years, all from `least` on, are a range."""
    own = years.groupBy(*keys).agg(F.count_distinct("year").alias("_n"), F.min("year").alias("first"), F.max("year").alias("last"))
    return own.withColumn("is_range", F.col("_n").between(2, 3) & (F.col("last") - F.col("first") == F.col("_n") - 1) & (F.col("first") >= least)).drop("_n")
