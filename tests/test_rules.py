"""Themes, identity, matching, rule packs and reports by hand-computed rows: nulls, empty texts, ties and empty tables."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from docstruct.functions import numerals
from docstruct.operators import classify, identity, lexicon, prepare, themes
from docstruct.plans import compose
from docstruct.sources import reports


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


def test_select_year_steps(spark):
    found = spark.createDataFrame(
        [(1, 2020, 10, "strong", False), (1, 2021, 10, "plain", False), (2, 1990, 900, "plain", False), (2, 1995, 950, "weak", False), (3, 1990, 900, "other", False), (3, 1991, 800, "other", True), (4, 2020, 10, "strong", True), (4, 2020, 300, "plain", False)],
        "d int, year int, pos int, rule string, excluded boolean",
    )
    out = identity.select_year(found, ["d"], {"strong": 5, "plain": 3, "weak": -2}, {"strong": 3, "plain": 2, "weak": 1}, 2020, 2010)
    assert rows(out) == [(1, 2020, 20, "score"), (2, 1990, -2, "priority"), (3, 1991, -13, "latest"), (4, 2020, 15, "score")]
    assert rows(identity.select_year(found.limit(0), ["d"], {"strong": 5}, {"strong": 3}, 2020, 2010)) == []


def test_year_range_and_confidence(spark):
    docs = spark.createDataFrame([(1, "exam 14-16.txt"), (2, "98-02"), (3, None), (4, "16-14")], "d int, name string")
    got = rows(identity.expand_year_range(docs, "name"), "d", "year")
    assert got == sorted([(1, 2014), (1, 2015), (1, 2016), *((2, y) for y in range(1998, 2003)), (3, None), (4, None)], key=repr)
    found = spark.createDataFrame([(1, 2020, "name"), (1, 2021, "strong"), (2, 2020, "weak"), (3, 2018, "other"), (3, 2020, "other")], "d int, year int, rule string")
    assert rows(identity.year_confidence(found, ["d"], "name", ["strong"], "weak")) == [(1, 1.0), (2, 0.3), (3, 0.1)]


def test_detect_entity_zones(spark):
    aliases = spark.createDataFrame([("oak", "Oak School", 10, 1), ("elm", "Elm School", 10, 2)], "alias string, entity string, priority int, alias_rank int")
    docs = spark.createDataFrame([(1, "Oak elm elm", None), (2, None, "elm/oak"), (3, "", ""), (4, "oak elm", "x"), (5, "x" * 1000 + " elm elm elm elm oak", "a/b")], "d int, text string, path string")
    assert rows(identity.detect_entity(docs, aliases, "text", "path", ["d"])) == [(1, "Elm School", 40.0, 1.0), (2, "Oak School", 10.0, 1.0), (4, "Oak School", 20.0, 1.0), (5, "Elm School", 30.0, 1.0)]


def test_limits_and_points(spark):
    asked = spark.createDataFrame([("a", "within 20 words"), ("a", None), ("b", "3 lines"), ("b", "about 50 words, within 90 words")], "g string, q string")
    rules = [("about", "about ([0-9]+)"), ("most", "within ([0-9]+)"), ("lines", "([0-9]+) lines")]
    assert rows(identity.limit_histogram(asked, rules, "q", ["g"])) == sorted([("a", "20 most", 0, 20, 1, 50.0), ("a", "none", None, None, 1, 50.0), ("b", "120 about", 96, 144, 1, 50.0), ("b", "50 about", 40, 60, 1, 50.0)], key=repr)
    sheets = spark.createDataFrame([(1, "Q1: 5 points Q2: 6 points Q1: 7 points (2) 9 points of 100"), (2, None)], "d int, sheet string")
    questions = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "d int, q long")
    out = identity.score_sheet(sheets, questions, [r"Q(\d+): (\d+) points", r"\((\d+)\) (\d+) points"], r"of (\d+)", "sheet", ["d"], "q")
    assert rows(out, "d", "q", "points", "total_points") == [(1, 1, 7, 100), (1, 2, 9, 100), (1, 3, None, 100), (2, 1, None, None)]


def test_score_keywords_ties(spark):
    words = [("a", "red", 3), ("a", "blue", 1), ("b", "green", 3)]
    docs = spark.createDataFrame([(1, "red green"), (2, "Red blue red"), (3, None), (4, ""), (5, "green green red")], "d int, text string")
    assert rows(themes.score_keywords(docs, words, "text", ["d"], "none")) == [(1, "a", 3, 0.5), (2, "a", 4, 1.0), (3, "none", 0, 0.0), (4, "none", 0, 0.0), (5, "a", 3, 0.5)]
    assert rows(themes.score_keywords(docs, words, "text", ["d"], "none", tie="mixed"), "d", "label")[0] == (1, "mixed")
    assert rows(themes.score_keywords(docs, words, "text", ["d"], "none", first_chars=11), "d", "label", "score")[4] == (5, "b", 6)


def test_periods(spark):
    periods = [("old", ["bronze"], ["tomb"]), ("new", ["steam"], ["train", "mill"])]
    docs = spark.createDataFrame([(1, "steam and bronze"), (2, "the 12th of mill"), (3, "tomb train mill north"), (4, None), (5, "tomb mill")], "d int, text string")
    out = themes.period_and_region(docs, periods, "([0-9]+)th", [("N", "north")], "text", ["d"])
    assert rows(out) == [(1, "old", "strong", None), (2, "12. century", "century", None), (3, "new", "representative", "N"), (4, None, None, None), (5, "old", "representative", None)]


def test_cascade_order(spark):
    docs = spark.createDataFrame([(1, "castle politics"), (2, "skip this Heading"), (3, "Heading art"), (4, None), (5, "skip castle")], "d int, text string")
    stages = [("term", 0.9, F.nullif(F.regexp_extract("text", "castle", 0), F.lit(""))), ("pattern", 0.7, F.nullif(F.regexp_extract("text", "[A-Z]\\w+", 0), F.lit("")))]
    out = themes.cascade(docs, stages, ["d"], "text", [("politics", " and politics"), ("art", " in art")], "^skip", "pattern")
    assert rows(out) == [(1, "castle and politics", 0.9, "term"), (2, None, 0.0, "excluded"), (3, "Heading in art", 0.7, "pattern"), (4, None, 0.0, "none"), (5, "castle", 0.9, "term")]
    assert rows(themes.stage_usage(out.withColumn("g", F.lit(1)), ["g"])) == sorted([(1, "term", 2, 0.9), (1, "excluded", 1, 0.0), (1, "pattern", 1, 0.7), (1, "none", 1, 0.0)], key=repr)


def test_validation_and_anchors(spark):
    got = themes.validate_themes(spark.createDataFrame([(1, "a", "figure 2"), (2, "a", None), (3, "a", "ab"), (4, "a", "silk road"), (5, "a", "silk road"), (6, "b", "silk road"), (7, "b", "works of X")], "id int, d string, theme string"), "theme", ["d"], 3, [("figure", "^figure", None), ("works", "^works", "deeds")])
    assert rows(got, "id", "rule", "valid", "repaired") == [(1, "figure", False, None), (2, "empty", False, None), (3, "short", False, None), (4, "repeated", False, None), (5, "repeated", False, None), (6, None, True, "silk road"), (7, "works", False, "deeds of X")]
    assert rows(themes.fragment_rates(got, ["d"])) == [("a", 5, 5, 100.0), ("b", 2, 1, 50.0)]
    docs = spark.createDataFrame([(1, "x", "greenhouse map\n- factory"), (2, "x", "none\n- map"), (3, "x", None)], "id int, label string, text string")
    out = themes.override_by_anchor(docs, [("map", "geo", "maps"), ("greenhouse", "farm", "crops"), ("factory", "work", "plants")], "text", "\n- ", "label")
    assert rows(out, "id", "label", "theme") == [(1, "geo", "maps+crops"), (2, "x", None), (3, "x", None)]


def test_citations(spark):
    docs = spark.createDataFrame([(1, "(Kafka, Trial) by Kafka: Trial. by Mann: Faust; (1, 2)"), (2, None)], "d int, text string")
    out = themes.extract_citations(docs, [("by", r"by (\w+): (\w+)", 2, 0.6), ("paren", r"\((\w+), (\w+)\)", 1, 0.9)], "text", ["d"], "[A-Za-z]")
    assert rows(out, "rank", "author", "title", "rule", "confidence", "is_primary") == [(1, "Mann", "Faust", "by", 0.6, True), (2, "Kafka", "Trial", "paren", 0.9, False)]


def test_keyword_candidates(spark):
    docs = spark.createDataFrame([(1, "b1 aa1 cccc1 aa1 x1"), (2, None)], "d int, text string")
    assert rows(lexicon.keyword_candidates(docs, [("([a-z]+)1", 1)], ["c"], "text", ["d"])) == [(1, 1, "cccc"), (1, 2, "aa")]


def test_fuzzy_ties(spark):
    terms = spark.createDataFrame([("abcd", "f", 1), ("abce", "g", 2), ("abc", "g", 3)], "term string, field string, term_rank int")
    asked = spark.createDataFrame([(1, "abc", "x"), (2, "abcde", "g"), (3, "zz", "f"), (4, None, "f"), (5, "abdc", None)], "id int, kw string, own string")
    assert rows(lexicon.fuzzy_term_match(asked, terms, ["id"], "kw", "own"), "id", "term", "score") == [(1, "abc", 1.0), (2, "abc", 0.96), (5, "abcd", 0.6)]


@pytest.mark.parametrize("threshold", [0.5, 0.8, 1.0])
def test_similar_documents_brute_force(spark, threshold):
    draw = random.Random(7)
    base = [draw.sample("abcdefghijklmnopqrstuvwxyz", draw.randint(1, 9)) for _ in range(12)]
    texts = [" ".join(draw.sample(b, len(b)) + draw.sample("qrstuvwxyz", draw.randint(0, 2))) for b in base for _ in range(6)] + ["", None, "A b", "b  a"]
    out = {r["d"]: (r["class_id"], r["n_links"]) for r in lexicon.similar_documents(spark.createDataFrame(list(enumerate(texts)), "d int, text string"), "text", "d", threshold).collect()}
    sets = [frozenset((t or "").lower().split()) for t in texts]
    first = {s: sets.index(s) for s in sets}
    links = dict.fromkeys(first, 0)
    for a, b in itertools.combinations([s for s in first if s], 2):
        if len(a & b) >= threshold * len(a | b) - 1e-9:
            links[a] += 1
            links[b] += 1
    assert out == {i: (first[s], links[s]) for i, s in enumerate(sets)}


def test_rule_packs_and_chain(spark):
    packs = spark.createDataFrame([("p", "s1", 5, "k", "r1", 1), ("q", "s1", 9, "k", "r2", 1), ("any", "*", 1, "k", "r3", 1)], "pack string, school string, priority int, kind string, rule string, rule_order int")
    docs = spark.createDataFrame([(1, "s1"), (2, "s2"), (3, None)], "d int, school string")
    assert rows(compose.resolve_rule_pack(docs, packs, "school", ["d"]), "d", "pack", "rule") == [(1, "q", "r2"), (2, "any", "r3"), (3, "any", "r3")]
    assert rows(compose.pipeline([("a", lambda d: d.where("d > 1")), ("b", lambda d: d.select("d"))])(docs)) == [(2,), (3,)]
    with pytest.raises(RuntimeError, match="stage 'bad'"):
        compose.pipeline([("bad", lambda d: d.select("missing"))])(docs).collect()


def test_report(spark):
    facts = spark.createDataFrame([(1, 2, "b", None), (1, 1, "a", "x"), (1, 3, "b", "x")], "d int, n int, kind string, tag string")
    out = reports.render_reports(facts, ["d"], F.concat(F.lit("doc "), "d"), ["kind", "tag"], F.concat_ws(" ", "n", "kind"), ["n"])
    assert out.first()["report"] == "doc 1\nrows: 3\n[kind]\nb: 2 (66.7%)\na: 1 (33.3%)\n[tag]\nx: 2 (66.7%)\n-: 1 (33.3%)\n[details]\n1 a\n2 b\n3 b"
    assert out.count() == 1


def test_limits_in_other_scripts(spark):
    asked = ["八十字以内で説明しなさい。", "二百五十字程度で述べよ。", "２０字以上３０字以内で書きなさい。", "約120字で", "三行で", "十五字で抜き出しなさい", "千二百字以内", "答えなさい。", None]
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    got = {(r.label, r.least, r.most) for r in identity.limit_histogram(df, identity.JAPANESE_LIMITS, "q", []).collect()}
    assert got == {("80 most", 0, 80), ("250 about", 200, 300), ("20-30", 20, 30), ("120 about", 96, 144), ("120 about", 96, 144), ("15 exact", 15, 15), ("1200 most", 0, 1200), ("none", None, None)}
    said = ["百", "千", "二千五", "十", "１０", "0", "", "字", "九千九百九十九", "二〇"]
    numbers = spark.createDataFrame([(x,) for x in said], "x string").select("x", numerals.spoken_number(F.col("x")).alias("n"))
    assert {r.x: r.n for r in numbers.collect()} == {"百": 100, "千": 1000, "二千五": 2005, "十": 10, "１０": 10, "0": 0, "": None, "字": None, "九千九百九十九": 9999, "二〇": 20}


def test_structure_decides_in_order(spark):
    rules = [("empty", classify.Shape(most=0)), ("vocabulary", classify.Shape(item="[一二三四五]　", items=3, most=200)), ("reading", classify.Shape(least=50, ends="『[^』]+』")), ("short", classify.Shape(most=30)), ("map", "地図")]
    texts = ["", None, "一　漢字 二　語句 三　意味", "文" * 60 + "（夏目『こころ』）", "（夏目『こころ』）" + "文" * 300, "短い", "地図" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert [r.label for r in classify.classify_first(df, rules, "t", "other").orderBy("i").collect()] == ["empty", "empty", "vocabulary", "reading", "other", "short", "map"]


def test_compatibility_forms_are_composed_before_rules(spark):
    df = spark.createDataFrame([(1, "Ａ①　ﾊﾟ㈱"), (2, None)], "i int, t string")
    got = {r.i: (r.t, r.removed_digits) for r in prepare.clean_corpus(df, [("digits", "[0-9]", "")], "t", normalize=True).collect()}
    assert got == {1: ("A パ(株)", 1), 2: (None, 0)}


@pytest.mark.parametrize("words, band", [(200_000, 256), (50, 2)])
def test_similar_documents_in_blocks(spark, monkeypatch, words, band):
    """Near copies of one text, whose variants are alike or not, and texts of other sizes; words are sent once a block, so that no row of a pair carries them."""
    monkeypatch.setattr(lexicon, "BLOCK_WORDS", words)
    monkeypatch.setattr(lexicon, "BAND", band)
    draw = random.Random(3)
    base = [f"w{i}" for i in range(90)]
    texts = [" ".join(base[:k] + [f"x{n}_{i}" for i in range(90 - k)]) for n, k in enumerate([90, 89, 88, 86, 83, 82, 81, 80, 79] * 4)]
    texts += [" ".join(draw.sample(base, draw.randint(60, 90))) for _ in range(30)] + [" ".join(f"y{i}" for i in range(n)) for n in (1, 5, 31, 32, 33, 64, 65, 130)]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "d string, text string")
    sets = [frozenset(t.split()) for t in texts]
    for threshold in (0.2, 0.8):
        made = lexicon.similar_documents(docs, "text", "d", threshold)
        want = {s: sum(s != o and len(s & o) >= threshold * len(s | o) - 1e-9 for o in set(sets)) for s in set(sets)}
        assert {int(r.d): r.n_links for r in made.collect()} == {i: want[s] for i, s in enumerate(sets)}
    assert "array_intersect(_a" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_similar_documents_send_no_pairs(spark):
    """Each of n variants of one text is like all others: n * n / 2 pairs, of which none is a row that is shuffled."""
    n, base = 250, [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(base[: i % 60] + base[i % 60 + 1 :] + [f"x{i}"])) for i in range(n)], "d int, text string")
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def sent():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = sent()
    assert {(r.class_id, r.n_links) for r in lexicon.similar_documents(docs, "text", "d", 0.8).collect()} == {(i, n - 1) for i in range(n)}
    assert sent() - before < n * (n - 1) / 2


def test_similar_documents_of_any_size(spark):
    """Sets on both sides of the sizes at which they are cut in parts, whose difference lies in a few words or all over, at and beside the threshold."""
    draw = random.Random(11)
    sets = []
    for n, name in ((511, "a"), (513, "b"), (640, "c"), (2047, "d"), (2050, "e"), (2600, "f")):
        base = [f"{name}{i}" for i in range(n)]
        for gone in (0, 1, n // 9 - 1, n // 9, n // 9 + 1, n // 5, n // 5 + 1):
            for own in (0, gone):
                order = base if draw.random() < 0.5 else draw.sample(base, n)
                sets.append(frozenset(order[gone:] + [f"{name}{len(sets)}x{i}" for i in range(own)]))
    docs = spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(sets)], "d int, text string")
    want = {s: sum(s != o and len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in set(sets)) for s in set(sets)}
    assert {r.d: (r.class_id, r.n_links) for r in lexicon.similar_documents(docs, "text", "d", 0.8).collect()} == {i: (sets.index(s), want[s]) for i, s in enumerate(sets)}
    assert min(want.values()) == 0 < max(want.values())
