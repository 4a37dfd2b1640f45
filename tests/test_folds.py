"""Sequential rules against hand-computed rows."""

import random
import re
import time

from pyspark.sql import functions as F

from docstruct.functions.fold import cut_sentences
from docstruct.operators import prepare, segment, sequence, stats


def test_select_markers(spark):
    rows = [(1, 0, 2, 3), (1, 10, 1, 3), (1, 14, 2, 5), (1, 60, 2, 3), (1, 90, 3, 3), (1, 140, 1, 3), (1, 200, 2, 6), (2, 5, 4, 9)]
    markers = spark.createDataFrame(rows, "doc_id long, pos int, number int, priority int")
    got = sorted(map(tuple, segment.select_markers(markers, ["doc_id"], 20).collect()))
    assert got == [(1, 14, 2, 5), (1, 90, 3, 3), (1, 200, 2, 6)]


def test_thin_by_distance_compares_with_the_last_kept(spark):
    hits = spark.createDataFrame([(1, p) for p in (0, 6, 12, 13, 22)], "doc_id long, pos long")
    assert sorted(r.pos for r in segment.thin_by_distance(hits, ["doc_id"], "pos", 10).collect()) == [0, 12, 22]


def test_chunks_keep_order_and_bound(spark):
    text = "a" * 30 + "\n" + "One. Two! " + "b" * 70 + "\n" + "c" * 10
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    got = sorted(map(tuple, prepare.chunk_documents(docs, 40, "text", ["doc_id"]).collect()))
    assert all(len(c) <= 40 for _, _, c in got) and {d for d, _, _ in got} == {1}
    squeeze = lambda s: "".join(s.split())
    assert squeeze("".join(c for _, _, c in got)) == squeeze(text)


def test_upsert_twice_is_upsert_once(spark):
    base, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c", 1), (3, "d", 2)], "k int, v string, w int")
    once = stats.upsert(base, new, ["k"])
    assert sorted(map(repr, once.collect())) == sorted(map(repr, stats.upsert(once, new, ["k"]).collect()))


def test_gap_report(spark):
    items = spark.createDataFrame([(1, n) for n in (2, 3, 3, 6)], "d int, n int")
    assert sorted(map(tuple, sequence.gap_report(items, ["d"], "n").collect())) == [(1, "duplicate", 3, 3), (1, "gap", 4, 5), (1, "start", 1, 1)]


def test_segments_rebuild_the_text(spark):
    docs = spark.createDataFrame([(1, "x\nThe a\nb\nThe c"), (2, "none"), (3, "")], "doc_id long, text string")
    marks = segment.find_markers(docs, [("the", "The ", 1)], "text", ["doc_id"])
    got = segment.cut_segments(docs, marks, "text", ["doc_id"]).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "segment"))), lambda x: x["segment"]), "").alias("t"))
    assert {r.doc_id: r.t for r in got.collect()} == {1: "The a\nb\nThe c", 2: "none", 3: ""}


def test_sentences_are_cut_in_one_pass(spark):
    """As by the pattern that looks for a closing bracket from every sentence end, which takes the square of a line's length."""
    pattern = re.compile(r"(?<=[.!?。！？])[ \t\n\x0b\f\r]*(?![^(（「]*[)）」])")
    draw = random.Random(5)
    for _ in range(3000):
        line = "".join(draw.choices("ab. 。!?(（「)）」\t　", k=draw.randint(0, 14)))
        want, start = [], 0
        for m in pattern.finditer(line):
            want, start = want + [line[start : m.start()]], m.end()
        assert list(cut_sentences(line)) == want + [line[start:]]
    line = "Some words end. " * 60_000 + "(so) 「x。」"
    begin = time.time()
    chunks = [r.chunk for r in prepare.chunk_documents(spark.createDataFrame([(1, line), (2, None)], "d int, text string"), 800, "text", ["d"]).orderBy("chunk_no").collect()]
    assert time.time() - begin < 60
    assert "\n".join(chunks) == "Some words end.\n" * 60_000 + "(so) 「x。」"


def test_blocks_are_rebalanced_by_one_sort(spark):
    draw = random.Random(11)
    rows = [(d, draw.choice([1, 2, 2, 2, 3, None]), n) for d in [*range(60), None] for n in range(draw.randint(0, 9))]
    made = sequence.rebalance_blocks(spark.createDataFrame(rows, "d int, block int, n int"), "d", "block", ["n"], 3)
    want = []
    for d in {r[0] for r in rows}:
        own = {b: sorted(n for k, c, n in rows if k == d and c == b) for b in (1, 2, 3, None)}
        need = 3 - len(own[1])
        if 0 < need < len(own[2]):
            own[1], own[2] = own[1] + own[2][:need], own[2][need:]
        want += [(d, b, n, i + 1) for b, ns in own.items() for i, n in enumerate(ns)]
    assert sorted(map(tuple, made.select("d", "block", "n", "item_no").collect()), key=repr) == sorted(want, key=repr)
    assert made._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
