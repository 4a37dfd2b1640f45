"""Theme decisions by ordered rules. Rule lists are short and known when the plan is built, so they become columns of one pass over the rows."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docstruct.operators.dictionary import present_terms


def score_keywords(rows: DataFrame, keywords: list[tuple[str, str, int]] | DataFrame, text: str, keys: list[str], default: str, least: int = 1, tie: str = "first", first_chars: int | None = None, banded: bool = False) -> DataFrame:
    """C4: (keys, label, score, confidence) by keywords (label, word, weight) in any script, a list or a table with label_rank.

    A word's weight counts once if the text holds the word; with `first_chars` it counts at every occurrence among so many
    characters. The best label of at least `least` points (1 or more) wins, else the default; a tie goes to the first
    declared label or, with tie='mixed', to 'mixed'. confidence is the winner's share of all points or, `banded`, 0.2 and
    0.1 for each of its different words up to 0.95; 0 for the default. A row each, null texts and keys too.
    """
    table = keywords
    if not isinstance(keywords, DataFrame):
        labels = list(dict.fromkeys(label for label, _, _ in keywords))
        table = rows.sparkSession.createDataFrame([(label, word, weight, labels.index(label)) for label, word, weight in keywords], "label string, word string, weight int, label_rank int")
    body = rows if first_chars is None else rows.withColumn(text, F.substring(text, 1, first_chars))
    hits = present_terms(body, table, text, keys, "word", outer=True).withColumnRenamed("term", "word")
    each = F.col("weight") * (1 if first_chars is None else F.col("n"))
    points = hits.join(table, "word", "left").groupBy(*keys, "_row", "label", "label_rank").agg(F.sum(each).cast("long").alias("_p"), F.count("word").alias("_n"))
    points = points.withColumn("_p", F.when(F.col("label").isNotNull(), F.col("_p")))
    best = F.max(F.struct("_p", (-F.col("label_rank")).alias("_back"), "label", "_n")).alias("_b")
    ranked = points.withColumn("_top", F.max("_p").over(Window.partitionBy(*keys, "_row")))
    found = ranked.groupBy(*keys, "_row").agg(best, F.sum("_p").alias("_total"), F.count_if(F.col("_p") == F.col("_top")).alias("_tied"))
    top = F.greatest(F.coalesce("_b._p", F.lit(0)), F.lit(0))
    won = top >= max(least, 1)
    winner = F.when(F.col("_tied") > 1, "mixed").otherwise(F.col("_b.label")) if tie == "mixed" else F.col("_b.label")
    share = F.least(F.lit(0.95), F.round(0.2 + 0.1 * F.col("_b._n"), 4)) if banded else F.when(F.col("_total") > 0, F.round(top / F.col("_total"), 4)).otherwise(0.0)
    return found.select(*keys, F.when(won, winner).otherwise(default).alias("label"), top.cast("long").alias("score"), F.when(won, share).otherwise(0.0).alias("confidence"))


def period_and_region(rows: DataFrame, periods: list[tuple[str, list[str], list[str]]], century: str, regions: list[tuple[str, str]], text: str, keys: list[str], century_suffix: str = ". century") -> DataFrame:
    """(keys, period, tier, region) by periods (name, strong words, representative words) and regions (name, word), in any script.

    The first period with a strong word wins (tier 'strong'), else the number that `century` finds ('century'), else the
    period with most different representative words ('representative', first declared on a tie), else null. The region is
    that of the first listed word. A row each, null texts and keys too.
    """
    listed = [(w, "strong", k, n) for k, (n, own, _) in enumerate(periods) for w in own] + [(w, "word", k, n) for k, (n, _, own) in enumerate(periods) for w in own] + [(w, "region", k, n) for k, (n, w) in enumerate(regions)]
    table = rows.sparkSession.createDataFrame(listed, "term string, kind string, place int, name string").distinct()
    own = rows.withColumn("_c", F.nullif(F.regexp_extract(F.coalesce(F.col(text), F.lit("")), century, 1), F.lit("")))
    hits = present_terms(own, table, text, [*keys, "_c"], outer=True).join(table, "term", "left")
    counts = hits.groupBy(*keys, "_c", "_row", "kind", "place", "name").agg(F.count("kind").alias("_n"))
    pick = lambda kind, order: F.max(F.when(F.col("kind") == kind, F.struct(order.alias("o"), (-F.col("place")).alias("b"), F.col("name").alias("name"))))["name"]
    best = counts.groupBy(*keys, "_c", "_row").agg(pick("strong", F.lit(0)).alias("_strong"), pick("word", F.col("_n")).alias("_most"), pick("region", F.lit(0)).alias("region"))
    tier = F.when(F.col("_strong").isNotNull(), "strong").when(F.col("_c").isNotNull(), "century").when(F.col("_most").isNotNull(), "representative")
    return best.select(*keys, F.coalesce("_strong", F.concat("_c", F.lit(century_suffix)), "_most").alias("period"), tier.alias("tier"), "region")


def cascade(rows: DataFrame, stages: list[tuple[str, float, Column]], keys: list[str], text: str, suffixes: list[tuple[str, str]], excluded: str, exclude_before: str) -> DataFrame:
    """H1: (keys, theme, confidence, stage) of the first stage (name, confidence, keyword column) that gives a keyword.

    A text that matches `excluded` leaves the cascade before the stage `exclude_before` (stage 'excluded'); one without a
    keyword has stage 'none'. The theme is the keyword with the suffix of the first context pattern (pattern, suffix) in
    the text, else the keyword alone.
    """
    names = [name for name, _, _ in stages]
    cut = names.index(exclude_before) if exclude_before in names else len(names)

    def step(name: str, confidence: float, keyword: Column) -> Column:
        return F.when(keyword.isNotNull(), F.struct(keyword.alias("keyword"), F.lit(confidence).alias("confidence"), F.lit(name).alias("stage")))

    nothing = lambda stage: F.struct(F.lit(None).cast("string").alias("keyword"), F.lit(0.0).alias("confidence"), F.lit(stage).alias("stage"))
    steps = [step(*s) for s in stages]
    steps.insert(cut, F.when(F.col(text).rlike(excluded), nothing("excluded")))
    suffix = F.coalesce(*(F.when(F.col(text).rlike(p), F.lit(s)) for p, s in suffixes), F.lit(""))
    found = rows.select(*keys, F.coalesce(*steps, nothing("none")).alias("_k"), suffix.alias("_suffix"))
    return found.select(*keys, F.concat("_k.keyword", "_suffix").alias("theme"), "_k.confidence", "_k.stage")


def cascade_tables(rows: DataFrame, stages: list[tuple[str, float, DataFrame]], keys: list[str], text: str, suffixes: list[tuple[str, str]], classes: list[tuple[str, str]] = (), excluded: str | None = None, exclude_before: str | None = None) -> DataFrame:
    """H1 over tables: (keys, theme, confidence, stage) of the first stage (name, confidence, table of keys and theme) that has a row for a document.

    Stages may come from any operator: lexicon hits (T1), periods (C10), options (C12), clusters (T9). Their rows are
    brought together and the least stage wins, so that each table is read once. The theme takes the suffix of the first
    context pattern in the text, else that of the first keyword class (pattern of the theme, suffix). A text that matches
    `excluded` leaves before the stage `exclude_before`; documents of no stage have stage 'none'.
    """
    names = [n for n, _, _ in stages]
    found = None
    for i, (_, _, table) in enumerate(stages):
        own = table.select(*keys, F.lit(i).alias("_i"), F.col("theme").alias("_t")).where("_t IS NOT NULL")
        found = own if found is None else found.union(own)
    best = found.groupBy(*keys).agg(F.min(F.struct("_i", "_t")).alias("_b"))
    cut = names.index(exclude_before) if exclude_before in names else len(names)
    body = F.coalesce(F.col(text), F.lit(""))
    context = F.coalesce(*(F.when(body.rlike(p), F.lit(s)) for p, s in suffixes), F.lit(None).cast("string"))
    both = rows.select(*keys, context.alias("_suffix"), (body.rlike(excluded) if excluded else F.lit(False)).alias("_out")).join(best, keys, "left")
    gone = F.col("_out") & (F.coalesce("_b._i", F.lit(len(names))) >= cut)
    own = F.coalesce(*(F.when(F.col("_b._t").rlike(p), F.lit(s)) for p, s in classes), F.lit(""))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("_b._i") + 1)
    stage = F.when(gone, "excluded").when(F.col("_b").isNull(), "none").otherwise(pick(names))
    return both.select(*keys, F.when(~gone, F.concat(F.col("_b._t"), F.coalesce("_suffix", own))).alias("theme"), F.when(gone | F.col("_b").isNull(), 0.0).otherwise(pick([c for _, c, _ in stages])).alias("confidence"), stage.alias("stage"))


@dataclass(frozen=True)
class Stage:
    """A stage of theme_cascade(): its confidence, and where its terms are looked for, 'text' or 'options'."""

    name: str
    confidence: float
    zone: str = "text"


def theme_cascade(questions: DataFrame, stages: list[Stage], rules: DataFrame, text: str, keys: list[str], options: str | None = None, suffixes: list[tuple[str | None, str, str]] = (), excluded: str | None = None, exclude_before: str | None = None, fallback: str | None = None, fallback_confidence: float = 0.5) -> DataFrame:
    """H1 whole: (keys, theme, confidence, stage) of the first stage that has a theme for a question, all stages' terms found in one pass.

    rules: (stage, rule_rank, theme, need, term, class): a rule gives its theme where at least `need` different terms of
    it, in any script, stand in its stage's zone, so that single terms (a lexicon, periods, categories) and clusters (of
    the text, of the options) are rows of one table. A stage's rule of least rank wins, then of the longest term, then by
    name. The theme takes the suffix of the first of `suffixes` (class or null for all, word, suffix) whose class is the
    rule's and whose word the text holds; an empty word is a class's default.

    A text that matches `excluded` leaves before the stage `exclude_before` (stage 'excluded'); where no stage has a
    theme, the first group of `fallback` is one (stage 'fallback'), else the stage is 'none'. `options` is an array of
    strings. A row each; null texts, options and keys, too.
    """
    spark = questions.sparkSession
    names = [s.name for s in stages]
    cut = names.index(exclude_before) if exclude_before in names else len(names)
    places = spark.createDataFrame([(s.name, i, s.zone) for i, s in enumerate(stages)], "stage string, _i int, zone string")
    placed = rules.join(F.broadcast(places), "stage").select("term", "zone", "_i", "rule_rank", "theme", "need", "class")  # a row a stage
    wanted = sorted({w for _, w, _ in suffixes if w})
    dictionary = rules.select("term")
    dictionary = dictionary.union(spark.createDataFrame([(w,) for w in wanted], "term string")) if wanted else dictionary
    body = F.coalesce(F.col(text), F.lit(""))
    zones = [F.struct(F.lit("text").alias("zone"), body.alias("body"))] + ([F.struct(F.lit("options").alias("zone"), F.concat_ws("\n", options).alias("body"))] if options else [])
    own = questions.select(*keys, F.monotonically_increasing_id().alias("_q"), (body.rlike(excluded) if excluded else F.lit(False)).alias("_out"), (F.nullif(F.regexp_extract(body, fallback, 1), F.lit("")) if fallback else F.lit(None).cast("string")).alias("_fall"), F.array(*zones).alias("_z"))
    row = [*keys, "_q", "_out", "_fall"]
    hits = present_terms(own.select(*row, F.explode("_z").alias("_z")).select(*row, "_z.*"), dictionary, "body", [*row, "zone"], outer=True)
    context = F.collect_set(F.when((F.col("zone") == "text") & F.col("term").isin(wanted), F.col("term"))).alias("_c")
    counts = hits.join(placed, ["term", "zone"], "left").groupBy(*row, "_i", "rule_rank", "theme", "need", "class").agg(F.count_distinct("term").alias("_n"), F.max(F.length("term")).alias("_size"), context)
    best = F.min(F.when(F.col("_n") >= F.col("need"), F.struct("_i", "rule_rank", (-F.col("_size")).alias("_s"), "theme", "class"))).alias("_b")
    found = counts.groupBy(*row).agg(best, F.array_distinct(F.flatten(F.collect_list("_c"))).alias("_c"))
    gone = F.col("_out") & (F.coalesce("_b._i", F.lit(len(names))) >= cut)
    fits = lambda kind, word: (F.lit(True) if kind is None else F.coalesce(F.col("_b.class") == kind, F.lit(False))) & (F.array_contains("_c", word) if word else F.lit(True))
    suffix = F.coalesce(*(F.when(fits(kind, word), F.lit(s)) for kind, word, s in suffixes), F.lit(""))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("_b._i") + 1)
    some, fell = F.col("_b").isNotNull(), F.col("_fall").isNotNull()
    theme = F.when(gone, F.lit(None).cast("string")).when(some, F.concat("_b.theme", suffix)).otherwise(F.col("_fall"))
    confidence = F.when(gone, 0.0).when(some, pick([s.confidence for s in stages])).when(fell, fallback_confidence).otherwise(0.0)
    return found.select(*keys, theme.alias("theme"), confidence.alias("confidence"), F.when(gone, "excluded").when(some, pick(names)).when(fell, "fallback").otherwise("none").alias("stage"))


def stage_usage(decided: DataFrame, by: list[str]) -> DataFrame:
    """H1: rows and mean confidence of each stage by group."""
    return decided.groupBy(*by, "stage").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("mean_confidence"))


def validate_themes(rows: DataFrame, theme: str, doc: list[str], least: int, rules: list[tuple[str, str, str | None]]) -> DataFrame:
    """H4: the rows with rule, valid and repaired.

    rule is 'empty', 'short', the first rule (name, pattern, replacement) that the theme matches, or 'repeated' where a
    theme stands more than once in a document. Where the rule has a replacement, repaired is the theme with the match replaced; other invalid themes become null.
    """
    value = F.trim(F.coalesce(F.col(theme), F.lit("")))
    checks = [F.when(value == "", "empty"), F.when(F.length(value) < least, "short"), *(F.when(value.rlike(p), F.lit(name)) for name, p, _ in rules)]
    own = Window.partitionBy(*doc, theme)
    found = rows.withColumn("rule", F.coalesce(*checks, F.when(F.count("*").over(own) > 1, "repeated")))
    repairs = [F.when(F.col("rule") == name, F.regexp_replace(value, p, r)) for name, p, r in rules if r is not None]
    return found.withColumns({"valid": F.col("rule").isNull(), "repaired": F.coalesce(F.when(F.col("rule").isNull(), F.col(theme)), *repairs)})


def fragment_rates(validated: DataFrame, doc: list[str]) -> DataFrame:
    """H4: rows, invalid rows and their share of each document, in percent."""
    bad = F.count_if(~F.col("valid"))
    return validated.groupBy(*doc).agg(F.count("*").alias("n"), bad.alias("n_invalid"), F.round(100.0 * bad / F.count("*"), 1).alias("rate"))


def override_by_anchor(rows: DataFrame, anchors: list[tuple[str, str, str]], text: str, options: str, label: str, most: int = 2) -> DataFrame:
    """H5: label and theme forced by anchors (pattern, label, theme) in the main text, that is before the first match of `options`.

    The first anchor gives the label; the themes of the first `most` are joined by '+'. Rows without an anchor keep their label and have a null theme.
    """
    main = F.element_at(F.split(F.coalesce(F.col(text), F.lit("")), options, 2), 1)
    found = F.array_compact(F.array(*(F.when(F.col("_main").rlike(p), F.struct(F.lit(own).alias("label"), F.lit(theme).alias("theme"))) for p, own, theme in anchors)))
    out = rows.withColumn("_main", main).withColumn("_a", found)
    themes = F.array_join(F.array_distinct(F.slice(F.col("_a")["theme"], 1, most)), "+")
    return out.withColumns({label: F.coalesce(F.try_element_at("_a", F.lit(1))["label"], F.col(label)), "theme": F.when(F.size("_a") > 0, themes)}).drop("_main", "_a")


def extract_citations(docs: DataFrame, rules: list[tuple[str, str, int, float]], text: str, keys: list[str], valid: str, most: int = 10) -> DataFrame:
    """H6: (keys, rank, author, title, venue, rule, confidence, is_primary) of at most `most` citations of each document.

    A rule (name, pattern, priority, confidence) has groups author, title and, if any, venue. Authors and titles must
    match `valid`; each pair counts once with its best confidence; the rank is by priority, confidence and position.
    """
    def matches(k: int, name: str, pattern: str, priority: int, confidence: float) -> Column:
        venue = 3 if _groups(pattern) > 2 else 0
        part = lambda m, i: F.trim(F.regexp_extract(m, pattern, i))
        one = lambda m, i: F.struct(F.lit(-priority).alias("_order"), F.lit(-confidence).alias("_c"), i.alias("_pos"), F.lit(k).alias("_rule"), F.lit(name).alias("rule"), part(m, 1).alias("author"), part(m, 2).alias("title"), (F.nullif(part(m, 3), F.lit("")) if venue else F.lit(None).cast("string")).alias("venue"))
        return F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0)), one)

    found = docs.select(*keys, F.explode(F.concat(*(matches(k, *r) for k, r in enumerate(rules)))).alias("_m"))
    ok = found.where(F.col("_m.author").rlike(valid) & F.col("_m.title").rlike(valid))
    pairs = ok.groupBy(*keys, F.col("_m.author").alias("author"), F.col("_m.title").alias("title")).agg(F.min_by("_m", F.struct("_m._c", "_m._order", "_m._pos", "_m._rule")).alias("_m"))
    w = Window.partitionBy(*keys).orderBy("_m._order", "_m._c", "_m._pos", "_m._rule", "author", "title")
    ranked = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    return ranked.select(*keys, "rank", "author", "title", "_m.venue", "_m.rule", (-F.col("_m._c")).alias("confidence"), (F.col("rank") == 1).alias("is_primary"))


def _groups(pattern: str) -> int:
    return re.compile(pattern).groups
