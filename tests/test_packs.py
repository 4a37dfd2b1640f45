"""The Japanese rule pack on papers, formats and fields; numerals of all scripts."""

from pyspark.sql import functions as F

from docstruct.functions.numerals import clean_marker, numeral_table
from docstruct.operators import classify, prepare, segment, sequence, themes
from docstruct.plans import compose, packs


def test_numerals_of_all_scripts(spark):
    table = {r.marker: r.number for r in numeral_table(spark).collect()}
    want = {"7": 7, "１００": 100, "十": 10, "十一": 11, "二十": 20, "九十九": 99, "百": 100, "弐十参": 23, "IX": 9, "XLII": 42, "C": 100, "Ⅻ": 12, "①": 1, "⑳": 20, "㉑": 21, "㊿": 50}
    assert {m: table.get(m) for m in want} == want
    assert table.get("０") is None and sorted(set(table.values())) == list(range(1, 101))
    cleaned = spark.createDataFrame([("問問3",), ("間２",), ("人間の問",), (None,)], "m string").select(clean_marker(F.col("m")).alias("m"))
    assert [r.m for r in cleaned.collect()] == ["問3", "問２", "人間の問", None]


PAPER = """社会

1. 次の文章を読んで、問いに答えなさい。
りんごは寒い土地で育つ。
問1. 正しいものを選びなさい。
ア. 北
イ. 南
問2. 理由を選びなさい。
ア. 雨
イ. 雪
ウ. 風
２. 次の地図を見て、答えなさい。
問１ 川の名を答えなさい。
三、次の表を見なさい。
間1 都市を選びなさい。
ア. 港
イ. 山
"""


def test_a_paper_by_the_pack(spark):
    numerals = numeral_table(spark)
    docs = spark.createDataFrame([(1, PAPER)], "d int, text string").withColumn("text", clean_marker(F.col("text")))
    marks = sequence.lookup_numbers(segment.find_markers(docs, packs.SECTION_MARKERS, "text", ["d"], 1), "marker", numerals)
    chosen = segment.select_markers(marks, ["d"], 5)
    assert [r.number for r in chosen.orderBy("pos").collect()] == [1, 2, 3]
    headings = chosen.select("d", "pos", F.col("number").alias("section"))
    asked = sequence.lookup_numbers(segment.find_markers(docs, packs.QUESTION_MARKERS, "text", ["d"], 1, True), "marker", numerals)
    placed = segment.assign_heading(asked, headings, ["d"], "pos", "section")
    assert [(r.section, r.number) for r in placed.orderBy("pos").collect()] == [(1, 1), (1, 2), (2, 1), (3, 1)]
    cut = segment.cut_segments(docs, chosen.withColumn("marker", F.lit("")), "text", ["d"])
    options = segment.choice_rows(cut, packs.CHOICE, "segment", ["segment_no"])
    assert sorted((r.segment_no, r.choice_no, r.marker, r.choice) for r in options.collect()) == [(1, 0, "ア", "北"), (1, 1, "イ", "南"), (1, 2, "ア", "雨"), (1, 3, "イ", "雪"), (1, 4, "ウ", "風"), (3, 0, "ア", "港"), (3, 1, "イ", "山")]


def test_formats_and_fields_by_the_pack(spark):
    #: Wordings and their formats, questions and their fields.
    formats = [("答えなさい", "short_answer"), ("選びなさい", "multiple_choice"), ("説明しなさい", "descriptive"), ("空欄に入る語句", "fill_in_blank"), ("正しいものを", "true_false"), ("", "other")]
    fields = [
        ("織田信長が行った楽市楽座について、その目的と影響を説明しなさい。", "history"), ("東京、大阪、名古屋の三大都市圏について、それぞれの特徴を述べなさい。", "geography"),
        ("参議院と衆議院の違いについて、選挙制度の観点から説明しなさい。", "civics"), ("SDGsの17の目標のうち、日本が特に取り組むべき課題を3つ選んで説明しなさい。", "current"), ("", "mixed"),
    ]
    rows = spark.createDataFrame(formats, "text string, want string")
    assert all(r.label == r.want for r in classify.classify_first(rows, packs.FORMATS, "text", "other").collect())
    rows = spark.createDataFrame(fields, "text string, want string")
    got = classify.score_weighted(rows, packs.FIELD_RULES, "text", ["want"], packs.FIELD_BOOSTS, packs.CURRENT)
    assert {r.want: r.decision for r in got.collect()} == {w: w for _, w in fields}
    docs = spark.createDataFrame([(1, "s")], "d int, school string")
    rules = compose.resolve_rule_pack(docs, packs.japanese_pack(spark), "school", ["d"])
    assert rules.where("kind = 'section'").orderBy("rule_order").first().rule == packs.SECTION_MARKERS[0][1]


def test_long_texts_chunk_in_linear_time(spark):
    text = "\n".join("w" * (i % 30) for i in range(60_000))
    got = [r.chunk for r in prepare.chunk_documents(spark.createDataFrame([(1, text), (2, None), (3, "")], "d int, text string"), 100, "text", ["d"]).orderBy("chunk_no").collect()]
    want, now = [], None
    for line in filter(None, text.split("\n")):
        if now is not None and len(now) + 1 + len(line) <= 100:
            now += "\n" + line
        else:
            want += [now] if now is not None else []
            now = line
    assert got == [*want, now]


def test_materials_periods_and_regions_by_the_pack(spark):
    texts = ["次の地図と棒グラフを見て", "表１の統計と年表", "日本国憲法の条文", "問い", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = sorted((r.i, r.label) for r in classify.classify_multi(docs, packs.RESOURCES, "t", ["i"]).collect())
    assert got == [(0, "graph"), (0, "map"), (1, "table"), (1, "timeline"), (2, "document"), (3, "none"), (4, "none")]
    texts = ["鎌倉幕府と江戸の町", "18世紀のイギリスとアジア", "関東の工業", "中国地方とインド", "平安時代の東北", "なし"]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = themes.period_and_region(docs, packs.PERIODS, packs.CENTURY, packs.REGIONS, "t", ["i"], packs.CENTURY_SUFFIX)
    want = [("鎌倉時代", None), ("18世紀", "アジア"), (None, "日本・関東地方"), (None, "日本・中国地方"), ("平安時代", "日本・東北地方"), (None, None)]
    assert [(r.period, r.region) for r in found.orderBy("i").collect()] == want
