"""Places of matches where keys are null or repeated, long texts, and choices that depend on the last kept item."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docstruct.functions.fold import KeepApart, TrueMarkers, fold_sorted
from docstruct.operators import classify, prepare, segment

RULES = (classify.YearRule("four", r"([0-9]{4})", 9),)


def test_rows_that_share_a_key_keep_their_own_places(spark):
    rows = [(1, "aa 2001 bb 2002"), (1, "2003 cc\n2004"), (None, "x 2005"), (None, "2006\ny 2007"), (2, None)]
    docs = spark.createDataFrame(rows, "k int, text string")
    want = [("1", 3, 2001), ("1", 11, 2002), ("1", 0, 2003), ("1", 8, 2004), ("None", 2, 2005), ("None", 0, 2006), ("None", 7, 2007)]
    found = classify.year_candidates(docs, "text", ["k"], rules=RULES)
    assert sorted((str(r.k), r.pos, r.year) for r in found.collect()) == sorted(want)
    lines = {2001: (0, "aa 2001 bb 2002"), 2002: (0, "aa 2001 bb 2002"), 2003: (0, "2003 cc"), 2004: (1, "2004"), 2005: (0, "x 2005"), 2006: (0, "2006"), 2007: (1, "y 2007")}
    marks = segment.find_markers(docs, [("year", "[0-9]{4}", 1)], "text", ["k"], anywhere=True, line=True)
    assert sorted((str(r.k), r.pos, int(r.marker), r.line_no, r.line) for r in marks.collect()) == sorted((k, p, y, *lines[y]) for k, p, y in want)
    begun = segment.find_markers(docs, [("year", "[0-9]{4}", 1)], "text", ["k"], line=True)
    assert sorted((str(r.k), r.pos, r.line_no, r.line) for r in begun.collect()) == [("1", 0, 0, "2003 cc"), ("1", 8, 1, "2004"), ("None", 0, 0, "2006")]
    assert sorted((str(r.k), r.year) for r in classify.exclude_context(found.where("year > 2004"), spark.createDataFrame([(None, 2006)], "k int, year int"), ["k"]).collect()) == [("None", 2005), ("None", 2007)]
    one = spark.createDataFrame([(None, "a 1\nb 2"), (3, "c")], "k int, text string")
    cut = segment.cut_segments(one, segment.find_markers(one, [("n", "[0-9]", 1)], "text", ["k"], anywhere=True), "text", ["k"])
    assert sorted((str(r.k), r.segment) for r in cut.collect()) == [("3", "c"), ("None", "1\nb "), ("None", "2")]


def test_markers_and_citations_of_a_long_text_take_linear_time(spark):
    docs = spark.createDataFrame([(1, "問1 abcdefg\n\n" * 100_000)], "k int, text string")
    began = time.time()
    marks = segment.find_markers(docs, [("q", "問([0-9])", 1)], "text", ["k"], 1, True)
    assert marks.agg(F.sum("line_no"), F.sum("pos"), F.count("*")).first() == (sum(range(0, 200_000, 2)), sum(range(0, 1_200_000, 12)), 100_000)
    parts = segment.split_by_citation(docs, marks, "text", ["k"]).agg(F.count("*"), F.min(F.col("stop") - F.col("start")), F.max("stop")).first()
    assert parts == (1_200_000 // 504 + 1, 1_200_000 % 504, 1_200_000) and time.time() - began < 90


def test_one_dense_key_is_folded_batch_by_batch(spark):
    hits = spark.range(400_000).select(F.lit(None).cast("int").alias("k"), (F.col("id") * 2).alias("pos"))
    kept = segment.thin_by_distance(hits, ["k"], "pos", 5)
    assert kept.agg(F.count("*"), F.max("pos")).first() == (-(-800_000 // 6), 799_998)
    # the pass holds a batch and the last kept item, however many rows a key has
    fold = KeepApart(5)
    assert sum(len(list(fold.step(p))) for p in range(100)) == 20 and vars(fold) == {"distance": 5, "last": 95}


def test_folds_equal_plain_loops_on_random_markers(spark):
    rng = random.Random(6)
    rows = [(k, rng.randrange(400), rng.randrange(1, 6), rng.choice([3, 5, 6, 8])) for k in (1, 2, None) for _ in range(150)]
    rows = list({(k, p): (k, p, n, q) for k, p, n, q in rows}.values())
    want = []
    for key in (1, 2, None):
        own = sorted(r[1:] for r in rows if r[0] == key)
        ones = [m for m in own if m[1] == 1]
        first = max(ones, key=lambda m: (m[2], -m[0]))
        kept = [first]
        for m in own:
            if m[0] > first[0]:
                if m[0] - kept[-1][0] < 20:
                    if m[2] > kept[-1][2]:
                        kept[-1] = m
                elif m[1] > kept[-1][1] or m[2] >= 6:
                    kept.append(m)
        want += [(key, *m) for m in kept]
    frame = spark.createDataFrame(rows, "k int, pos int, number int, priority int").repartition(5)
    assert sorted(map(tuple, segment.select_markers(frame, ["k"], 20).collect()), key=str) == sorted(want, key=str)
    assert fold_sorted(frame.where("false"), ["k"], ["pos", "number", "priority"], "pos long, number long, priority int", lambda: TrueMarkers(1)).count() == 0


def test_a_leading_block_is_a_segment_of_its_own(spark):
    text = "漢字の読み\n問1\n" + "a" * 30 + "\n(Author A)\n\n" + "b" * 600 + "\n(Author B)\n\n" + "c" * 20
    docs = spark.createDataFrame([(1, text), (None, "x" * 10 + "(Author C)"), (2, "漢字")], "d int, text string")
    cited = segment.find_markers(docs, [("a", r"\(Author [A-Z]\)", 1)], "text", ["d"], anywhere=True)
    got = [(r.d, r.kind, r.start, r.stop) for r in segment.split_by_citation(docs, cited, "text", ["d"], leading="漢字|語句").orderBy("d", "segment_no").collect()]
    first, end = text.index("(Author A"), text.index("\n\n" + "c") + 2
    assert got == [(None, "plain", 0, 20), (1, "leading", 0, first), (1, "cited", first, end), (1, "plain", end, len(text)), (2, "plain", 0, 2)]


@pytest.mark.parametrize("inner,cut", [("一。（二。三）四。五", ["一。", "（二。三）四。", "五"]), ("「あ。い」う。えおかきくけこ", ["「あ。い」う。", "えおかきくけこ"]), ("あ。い。う", ["あ。", "い。", "う"])])
def test_sentence_ends_within_brackets_do_not_cut(spark, inner, cut):
    docs = spark.createDataFrame([(1, inner)], "k int, text string")
    got = [r.chunk for r in prepare.chunk_documents(docs, max(4, max(map(len, cut))) if len(inner) > 8 else 2, "text", ["k"]).orderBy("chunk_no").collect()]
    assert "".join(c.replace("\n", "") for c in got) == inner and all(any(c.startswith(x) for c in "\n".join(got).split("\n")) for x in cut)
