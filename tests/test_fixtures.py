"""Years of file names, papers end to end, null keys and multi-batch streams by rows."""

from pyspark.sql import functions as F

from docstruct.operators import classify, identity, lexicon, segment, sequence, stats, themes
from docstruct.sources import ingest, registry_table
from docstruct.streaming import jobs

#: Names of examination papers and the years they must give.
NAMES = [
    ("2023年日本工業大学駒場中学校問題_社会.pdf", 2023), ("2025年開成中学校問題_国語.pdf", 2025), ("開成中学校_2024.pdf", 2024), ("2020年東京電機大学中学校問題_社会.pdf", 2020),
    ("令和5年度入試問題.pdf", 2023), ("R5_麻布中学校.pdf", 2023), ("令和6年桜蔭中学校.pdf", 2024), ("R4年度_武蔵中学校.pdf", 2022),
    ("平成31年度入試.pdf", 2019), ("H31_慶應中等部.pdf", 2019), ("平成30年早稲田実業.pdf", 2018),
    ("23年筑駒入試.pdf", 2023), ("25年度入試予想問題.pdf", 2025), ("99年過去問.pdf", 1999),
    ("開成中学校入試問題.pdf", None), ("社会科入試分析.pdf", None),
]


def test_years_of_file_names(spark):
    docs = spark.createDataFrame([(i, None, n) for i, (n, _) in enumerate(NAMES)], "d int, text string, name string")
    found = classify.year_candidates(docs, "text", ["d"], "name").withColumn("excluded", F.lit(False))
    got = {r.d: r.year for r in identity.select_year(found, ["d"], {}, {r.name: r.priority for r in classify.JAPANESE_YEARS}, 2020, 1990).collect()}
    assert [got.get(i) for i in range(len(NAMES))] == [y for _, y in NAMES]


def test_years_in_texts_have_rules_and_places(spark):
    docs = spark.createDataFrame([(1, "二〇二五年度と平成二十七年、平成十年、令和３年。(15) 1850年"), (2, None)], "d int, text string")
    got = sorted((r.pos, r.rule, r.year) for r in classify.year_candidates(docs, "text", ["d"]).collect())
    assert got == [(0, "kanji", 2025), (7, "heisei", 2015), (14, "heisei", 1998), (19, "reiwa", 2021)]
    left = classify.exclude_context(classify.year_candidates(docs, "text", ["d"]), classify.excluded_years(spark.createDataFrame([(1, "写真 2015 年の")], "d int, text string"), "text", ["d"], ["写真 ([0-9]{4})"]), ["d"])
    assert sorted(r.year for r in left.collect()) == [1998, 2021, 2025]


def test_a_paper_from_markers_to_repaired_order(spark):
    text = "大問1 歴史\n問1 年号を答えよ。\n問2 人物を答えよ。\n問9 首都を答えよ。\n大問2 地理\n問1 川を答えよ。見よ 問2 山を答えよ。"
    docs = spark.createDataFrame([(1, text)], "d int, text string")
    sections = segment.find_markers(docs, [("section", "大問([0-9]+)", 8)], "text", ["d"], 1).withColumn("number", F.col("marker").cast("int"))
    chosen = segment.select_markers(sections, ["d"], 5)
    assert [r.number for r in chosen.orderBy("pos").collect()] == [1, 2]
    cut = segment.cut_segments(docs, chosen, "text", ["d"])
    assert "".join(r.segment for r in cut.orderBy("start").collect()) == text
    asked = segment.find_markers(docs, [("question", "(?<!大)問([0-9]+)", 5)], "text", ["d"], 1, True).withColumn("num", F.col("marker").cast("int"))
    assert [(r.num, r.line_no) for r in asked.orderBy("pos").collect()] == [(1, 1), (2, 2), (9, 3), (1, 5), (2, 5)]
    placed = segment.assign_heading(asked.select("d", "pos", "num"), chosen.select("d", "pos", F.col("number").alias("section")), ["d"], "pos", "section")
    flagged = sequence.flag_misplaced(placed, ["d", "section"], "num", ["pos"])
    assert [(r.section, r.num) for r in flagged.where("misplaced").collect()] == [(1, 9)]
    moved = sequence.move_misplaced(flagged, ["d"], "section", "num")
    assert sorted((r.section, r.item_no, r.num) for r in moved.collect()) == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2), (2, 3, 9)]
    assert sorted((r.kind, r.from_no, r.to_no) for r in sequence.gap_report(moved.where("section = 2"), ["d"], "num").collect()) == [("gap", 3, 8)]
    assert [r.section for r in sequence.first_late_section(placed, ["d"], "section", "num", ["pos"]).collect()] == [1]


def test_true_markers_begin_at_the_best_one_and_leave_small_questions(spark):
    rows = [(1, 0, 1, 3, False), (1, 50, 1, 8, False), (1, 90, 2, 8, True), (1, 120, 2, 5, False)]
    marks = spark.createDataFrame(rows, "d int, pos int, number int, priority int, small boolean")
    got = sorted((r.pos, r.number) for r in segment.select_markers(marks, ["d"], 20, F.col("small")).collect())
    assert got == [(50, 1), (120, 2)]


def test_islands_equal_the_plain_fold(spark):
    import random

    rng = random.Random(1)
    hits = [(k, rng.randrange(3000)) for k in range(5) for _ in range(300)]
    want = set()
    for k in range(5):
        last = None
        for p in sorted({p for q, p in hits if q == k}):
            if last is None or p - last >= 10:
                want.add((k, p))
                last = p
    assert {tuple(r) for r in segment.thin_by_distance(spark.createDataFrame(hits, "k int, pos int"), ["k"], "pos", 10).collect()} == want


def test_segments_end_behind_citations(spark):
    text = "a" * 600 + "\n(Author A)\n\n" + "b" * 100 + "\n(Author B)\n\n" + "c" * 50
    docs = spark.createDataFrame([(1, text), (2, "plain")], "d int, text string")
    cited = segment.lines_with_offsets(docs, "text", ["d"]).where(F.col("line").rlike("Author"))
    got = [(r.d, r.segment_no, r.kind, r.start, r.stop) for r in segment.split_by_citation(docs, cited, "text", ["d"]).orderBy("d", "segment_no").collect()]
    assert got == [(1, 1, "cited", 0, 613), (1, 2, "plain", 613, len(text)), (2, 1, "plain", 0, 5)]


def test_columns_are_read_left_first(spark):
    blocks = [(1, 1, x, x + 40.0, 10.0 * i, 10.0 * i + 9, "title" if i == 0 and x == 0 else "question" if i % 2 else "source", f"{'LR'[x > 0]}{i}") for x in (0.0, 60.0) for i in range(5)]
    df = spark.createDataFrame(blocks, "d int, page int, x0 double, x1 double, y0 double, y1 double, block_type string, text string")
    ordered = segment.reading_order(df, "d")
    assert [r.text for r in ordered.orderBy("order_no").collect()] == [f"{s}{i}" for s in "LR" for i in range(5)]
    assert [(r.title, r.n_questions, r.source, r.body) for r in segment.assemble_blocks(ordered, "d").collect()] == [("L0", 4, "R4", "L1\nL3\nR1\nR3")]


def test_null_keys_are_values(spark, tmp_path):
    base = spark.createDataFrame([(None, 2020, "a"), ("s", 2020, "b")], "school string, year int, v string")
    new = spark.createDataFrame([(None, 2020, "c")], "school string, year int, v string")
    once = stats.upsert(base, new, ["school", "year"])
    assert sorted(map(str, once.collect())) == sorted(map(str, stats.upsert(once, new, ["school", "year"]).collect())) and once.count() == 2
    path = str(tmp_path / "registry")
    registry_table.upsert_groups(base, path, ["school", "year"], "school")
    registry_table.upsert_groups(spark.createDataFrame([(None, 2021, "d")], "school string, year int, v string"), path, ["school", "year"], "school")
    assert sorted((str(r.school), r.year) for r in registry_table.read_registry(spark, path).collect()) == [("None", 2020), ("None", 2021), ("s", 2020)]
    assert sorted((r.label, r.n) for r in stats.zero_filled_counts(base, "v", ["school"], spark.createDataFrame([("a",), ("z",)], "label string")).collect()) == [("a", 0), ("a", 1), ("z", 0), ("z", 0)]


def test_batches_add_up_and_state_expires(spark, tmp_path):
    for i, (s, t) in enumerate([("a", 10), ("a", 20), ("b", 100_000), ("c", 150_000), ("a", 200_000)]):
        spark.createDataFrame([(s, t)], "school string, s long").select("school", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), "school string, ts timestamp", files_a_batch=1)
    chain = lambda df: df.groupBy("school").agg(F.count("*").alias("n"))
    for _ in range(2):
        jobs.stream_ingest(stream, chain, str(tmp_path / "registry"), ["school"], "school", str(tmp_path / "state"), ("n",)).awaitTermination()
    assert {r.school: r.n for r in registry_table.read_registry(spark, str(tmp_path / "registry")).collect()} == {"a": 3, "b": 1, "c": 1}
    jobs.dedupe_with_ttl(stream, "school", "ts").writeStream.format("memory").queryName("expires").option("checkpointLocation", str(tmp_path / "ttl")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.school for r in spark.table("expires").collect()) == ["a", "a", "b", "c"]


def test_ladder_tops_and_context(spark):
    docs = spark.createDataFrame([(1, "x x x"), (2, "x y news"), (3, "x x y news"), (4, "x y x y x y"), (5, None)], "d int, text string")
    out = classify.score_weighted(docs, [("a", "x", 0.5), ("b", "y", 0.5)], "text", ["d"], (("b", "z", 3.0),), "news")
    assert {r.d: r.decision for r in out.collect()} == {1: "a", 2: "a", 3: "a", 4: "mixed", 5: "mixed"}
    blocks = spark.createDataFrame([(1, 0, "war peace war"), (1, 50, "castle"), (1, 5000, "far away")], "d int, pos int, text string")
    items = spark.createDataFrame([(1, 7, 10, "asked"), (1, 8, 9000, "alone")], "d int, q int, pos int, text string")
    near = lexicon.nearby_terms(items, blocks, ["d"], "q", "pos", "text", 100, 2)
    assert sorted((r.q, r["rank"], r.word, r.n) for r in near.collect()) == [(7, 1, "war", 2), (7, 2, "castle", 1)]
    assert {r.q: r.text for r in lexicon.append_context(items, near, ["d"], "q", "text").collect()} == {7: "asked war castle", 8: "alone"}


def test_cascade_takes_the_first_table_and_latest_rows_are_capped(spark):
    docs = spark.createDataFrame([(1, "castle"), (2, "skip"), (3, "none"), (4, None)], "d int, text string")
    first, second = (spark.createDataFrame(r, "d int, theme string") for r in ([(1, "castle")], [(1, "late"), (2, "late"), (3, "era")]))
    out = themes.cascade_tables(docs, [("one", 0.9, first), ("two", 0.7, second)], ["d"], "text", [("politics", " and politics")], [("^castle", " and lords")], "^skip", "two")
    assert sorted(map(str, out.collect())) == sorted(map(str, spark.createDataFrame([(1, "castle and lords", 0.9, "one"), (2, None, 0.0, "excluded"), (3, "era", 0.7, "two"), (4, None, 0.0, "none")], out.schema).collect()))
    rows = spark.createDataFrame([("g", 1, 1), ("g", 1, 2), ("g", 2, 3), ("h", 3, 4)], "k string, v int, ts int")
    assert sorted((r.k, r.ts, r["rank"]) for r in ingest.latest_per_group(rows, ["k"], ["ts"], 2, None, ["k", "v"]).collect()) == [("g", 2, 2), ("g", 3, 1), ("h", 4, 1)]
    pages = spark.createDataFrame([("<h1>Big <b>Word</b></h1><li>the</li><li>x</li><td>Big Word</td>",)], "html string")
    assert [(r.term, r.n) for r in ingest.harvest_terms(pages, "html", stop=["the"]).collect()] == [("Big Word", 2)]
