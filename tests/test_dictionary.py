"""Dictionary terms in texts of any script against a nested loop, and the operators that take such dictionaries."""

import collections
import random

import pytest
import regex
from pyspark.sql import functions as F

from docstruct.operators import dictionary, identity, lexicon, themes

TERMS = ["鎌倉", "鎌倉幕府", "藩", "ああ", "the", "he", "a1", "18歳", "x", "幕府の", "😀😀", "漢" * 250]
LEXICON = [("鎌倉幕府", "history", "period", 1), ("鎌倉", "history", "place", 2), ("源頼朝", "history", "person", 3), ("憲法", "civics", "law", 4), ("藩", "history", "land", 5), ("sdgs", "current", "goal", 6)]
QUESTIONS = [(1, "源頼朝が鎌倉幕府を開いた。鎌倉は海に近い。"), (2, "日本国憲法とSDGsについて"), (2, "日本国憲法とSDGsについて"), (None, "藩と鎌倉"), (3, None), (4, "なし")]


def plain_hits(rows, terms):
    word = lambda c: bool(regex.match(r"[\p{Latin}0-9]", c))
    found = collections.Counter()
    for k, t in rows:
        t = (t or "").lower()
        for w in terms:
            for p in range(len(t)):
                end = p + len(w)
                if t.startswith(w, p) and not (word(w[0]) and p and word(t[p - 1])) and not (word(w[-1]) and end < len(t) and word(t[end])):
                    found[k, w, p] += 1
    return found


@pytest.mark.parametrize("small", [16_000_000, 0])
def test_hits_equal_a_nested_loop(spark, monkeypatch, small):
    monkeypatch.setattr(dictionary, "BROADCAST_BYTES", small)
    rng, letters = random.Random(1), "鎌倉幕府藩あ the he a1 18歳x\n😀漢"
    rows = [(i % 7 if i % 5 else None, "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 255, 256, 257, 300, 700])))) for i in range(40)] + [(3, None), (3, "鎌倉幕府" * 300), (4, "漢" * 600)]
    docs, terms = spark.createDataFrame(rows, "k int, text string"), spark.createDataFrame([(t,) for t in TERMS + TERMS[:2]], "term string")
    hits = dictionary.term_hits(docs, terms, "text", ["k"])
    assert collections.Counter((r.k, r.term, r.pos) for r in hits.collect()) == plain_hits(rows, TERMS)
    outer = dictionary.term_hits(docs, terms, "text", ["k"], outer=True)
    assert outer.select("_row").distinct().count() == len(rows)
    assert dictionary.present_terms(docs.where("false"), terms, "text", ["k"]).count() == dictionary.present_terms(docs, terms.where("false"), "text", ["k"]).count() == 0
    with pytest.raises(ValueError):
        dictionary.term_hits(docs, spark.createDataFrame([("é" * 257,)], "term string"), "text", ["k"])


def test_a_long_text_takes_linear_time(spark):
    docs = spark.createDataFrame([(1, "山鎌倉幕府 " * 60_000)], "k int, text string")
    terms = spark.createDataFrame([("鎌倉幕府",), ("倉幕",), ("府",)], "term string")
    assert {(r.term, r.n, r.pos) for r in dictionary.present_terms(docs, terms, "text", ["k"]).collect()} == {("鎌倉幕府", 60_000, 1), ("倉幕", 60_000, 2), ("府", 60_000, 4)}


def test_operators_take_terms_without_word_breaks(spark):
    docs = spark.createDataFrame(QUESTIONS, "k int, text string")
    lex = spark.createDataFrame(LEXICON, "term string, field string, category string, term_rank int")
    got = sorted(map(str, lexicon.match_tokens(docs, lex, "text", ["k"]).collect()))
    assert got == sorted(f"Row(k={k}, field='{f}', category='{c}', score={n})" for k, f, c, n in [(1, "history", "period", 1), (1, "history", "place", 1), (1, "history", "person", 1), (2, "civics", "law", 2), (2, "current", "goal", 2), (None, "history", "land", 1), (None, "history", "place", 1)])
    top = lexicon.important_terms(docs, lex.selectExpr("term", "term_rank div 4 AS tier"), "text", ["k"], 2)
    assert sorted((str(r.k), r.rank, r.term) for r in top.collect()) == sorted([("1", 1, "源頼朝"), ("1", 2, "鎌倉幕府"), *[("2", 1, "憲法"), ("2", 2, "sdgs")] * 2, ("None", 1, "鎌倉"), ("None", 2, "藩")])
    clusters = spark.createDataFrame([("鎌倉幕府", "鎌倉時代", 1), ("源頼朝", "鎌倉時代", 1), ("藩", "江戸時代", 2), ("鎌倉", "江戸時代", 2)], "term string, theme string, cluster_rank int")
    assert sorted((str(r.k), r.theme, r.n_terms) for r in lexicon.cooccurrence_rules(docs, clusters, "text", ["k"]).collect()) == [("1", "鎌倉時代", 2), ("None", "江戸時代", 2)]
    words = [("history", "鎌倉", 2), ("history", "源頼朝", 3), ("civics", "憲法", 2), ("current", "sdgs", 2)]
    assert sorted(map(tuple, themes.score_keywords(docs, words, "text", ["k"], "none", 1, "mixed").collect()), key=str) == sorted([(1, "history", 5, 1.0), (2, "mixed", 2, 0.5), (2, "mixed", 2, 0.5), (None, "history", 2, 1.0), (3, "none", 0, 0.0), (4, "none", 0, 0.0)], key=str)
    assert {(r.k, r.score, r.confidence) for r in themes.score_keywords(docs, words, "text", ["k"], "none", first_chars=16, banded=True).where("k = 1").collect()} == {(1, 7, 0.4)}
    periods = [("飛鳥", ["憲法十七条"], ["憲法", "日本国"]), ("鎌倉", ["鎌倉幕府"], ["源頼朝"]), ("江戸", ["藩"], ["鎌倉"])]
    found = themes.period_and_region(docs, periods, "([0-9]+)世紀", [("関東", "鎌倉"), ("全国", "日本")], "text", ["k"])
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "鎌倉", "strong", "関東"), (2, "飛鳥", "representative", "全国"), (2, "飛鳥", "representative", "全国"), (None, "江戸", "strong", "関東"), (3, None, None, None), (4, None, None, None)], key=str)


def test_schools_are_found_by_their_names(spark):
    aliases = spark.createDataFrame([("開成中学", "開成中学校", 10, 1), ("開成", "開成中学校", 5, 2), ("桜蔭", "桜蔭中学校", 10, 3), ("武蔵", "武蔵中学校", 5, 4)], "alias string, entity string, priority int, alias_rank int")
    docs = spark.createDataFrame([(1, "開成中学入試問題" + "あ" * 1000 + "桜蔭" * 5, "社会/2023開成中学校問題.pdf"), (None, "武蔵野の自然", "桜蔭/2020.pdf"), (None, None, None)], "k int, text string, path string")
    got = sorted((r.entity, r.score, r.confidence) for r in identity.detect_entity(docs, aliases, "text", "path", ["k"]).collect())
    # 開成中学: 2 x 10 in the head and 10 by the file's name; 開成: 2 x 5 and 5; against 桜蔭: 3 x 10
    assert got == [("武蔵中学校", 10.0, 1.0), ("開成中学校", 45.0, 1.0)]


def test_spread_texts_are_never_broadcast(spark, tmp_path, monkeypatch):
    """Spark knows a table's size, not that of its substrings: a small table of texts must not be what is sent to all tasks."""
    spark.createDataFrame([(i, "STEEL TIN" * (1 + i % 3)) for i in range(50)], "d int, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    terms = spark.createDataFrame([("TIN", "metal", "soft", 1), ("EE", "pair", "two", 2)], "term string, field string, category string, term_rank int")
    low = terms.select(F.lower("term").alias("term"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    matched = lambda: lexicon.match_terms(docs, terms, "text", ["d"], [2, 3])
    placed = lambda: dictionary.term_hits(docs, low, "text", ["d"], words=False)
    want = sorted((i, t, (1 + i % 3)) for i in range(50) for t in ("TIN", "EE"))
    assert "BuildRight" in plan(matched()) and "BuildLeft" not in plan(matched())
    assert sorted((r.d, r.term, r.n) for r in matched().collect()) == want
    hits = sorted(map(tuple, placed().drop("_row").collect()))
    monkeypatch.setattr(dictionary, "BROADCAST_BYTES", 0)
    for made in (matched(), placed(), dictionary.present_terms(docs, low, "text", ["d"])):
        last = plan(made)[: plan(made).index("Generate")]
        assert "SortMergeJoin" in last and "BroadcastHashJoin" not in last
    assert sorted((r.d, r.term, r.n) for r in matched().collect()) == want
    assert sorted(map(tuple, placed().drop("_row").collect())) == hits
