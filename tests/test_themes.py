"""The whole cascade of themes over Japanese questions: ten stages as rows of one table."""

from docstruct.operators import themes

STAGES = [
    themes.Stage("lexicon", 0.9), themes.Stage("period", 0.85), themes.Stage("options", 0.8, "options"), themes.Stage("refined", 0.9), themes.Stage("cluster", 0.9),
    themes.Stage("specific", 0.95), themes.Stage("category", 0.85), themes.Stage("abstract", 0.75),
]
#: (stage, theme, need, terms, class)
TABLE = [
    ("lexicon", None, 1, ["江戸時代", "室町時代", "平安時代"], "period"),
    ("lexicon", None, 1, ["太平洋戦争", "日本国憲法", "少子高齢化", "三権分立", "阪神・淡路大震災", "sdgs", "大化の改新", "選挙制度", "明治維新", "環境問題"], None),
    ("period", "縄文時代", 1, ["土偶", "貝塚"], "period"),
    ("options", "日本の中世の寺院", 2, ["延暦寺", "東大寺", "法隆寺", "平等院"], None),
    ("refined", "選挙制度", 2, ["選挙", "比例代表", "参議院", "小選挙区"], None),
    ("refined", "環境問題", 2, ["温暖化", "温室効果ガス", "京都議定書", "パリ協定"], None),
    ("cluster", "明治維新", 2, ["大政奉還", "王政復古", "廃藩置県"], None),
    ("cluster", "三権分立", 3, ["立法", "行政", "司法"], None),
    ("cluster", "鎌倉幕府", 2, ["源頼朝", "鎌倉", "執権"], None),
    ("specific", "青森", 2, ["りんご", "ねぶた", "津軽"], None),
    ("specific", "関東地方", 4, ["東京", "神奈川", "千葉", "埼玉", "茨城", "栃木", "群馬"], None),
    ("category", None, 1, ["関東地方", "北海道", "沖縄"], "region"),
    ("category", None, 1, ["地球温暖化"], None),
    ("abstract", "資料の読み取り", 1, ["雨温図", "統計"], None),
]
SUFFIXES = [("period", "文化", "の文化"), ("period", "文学", "の文化"), ("region", "農業", "の農業"), ("region", "工業", "の産業"), ("region", "", "の特徴")]
EXCLUDED = "^(下線部|地図中|次の表)"

#: Questions and their themes.
CASES = [
    ("問1 下線部①について、竪穴式住居で土器を使い、土偶を作って生活していた時代を答えなさい。", ["ア 縄文時代", "イ 弥生時代", "ウ 古墳時代", "エ 飛鳥時代"], "縄文時代"),
    ("問2 空欄に当てはまる都道府県を答えなさい。りんごの生産量が日本一で、ねぶた祭りが有名な（　　）県。", ["ア 青森", "イ 長野", "ウ 山形", "エ 秋田"], "青森"),
    ("問3 参議院議員選挙において、比例代表制で投票する際の方法について正しいものを選びなさい。", ["ア 候補者名を書く", "イ 政党名を書く", "ウ 候補者名か政党名を書く", "エ 記号で選ぶ"], "選挙制度"),
    ("問4 下線部について、1868年に大政奉還が行われ、王政復古の大号令により始まった改革を何というか。", [], "明治維新"),
    ("問5 東京、神奈川、千葉、埼玉、茨城、栃木、群馬の7都県からなる地方を何というか。", [], "関東地方"),
    ("問6 国会、内閣、裁判所がそれぞれ立法、行政、司法の権限を持ち、互いにチェックし合う仕組みを何というか。", [], "三権分立"),
    ("問7 空欄を埋めなさい。江戸時代に大名が1年ごとに江戸と領地を往復する制度を（　　）という。", ["参勤交代", "鎖国", "天領", "幕藩体制"], "江戸時代"),
    ("問8 地球温暖化の原因となる温室効果ガスのうち、最も割合が高いCO2の削減について、京都議定書やパリ協定で定められた目標について述べなさい。", [], "環境問題"),
]
#: Questions of which at least 80 in 100 must have a theme.
COVERAGE = [
    "江戸時代の農業について説明しなさい。", "明治維新の影響を述べなさい。", "下線部⑥について答えなさい。", "太平洋戦争の原因について説明しなさい。", "関東地方の工業の特徴を述べなさい。",
    "日本国憲法の三原則について答えなさい。", "地図中のAの都市名を答えなさい。", "次の表から読み取れることを説明しなさい。", "源頼朝が鎌倉に幕府を開いた理由を述べなさい。", "環境問題への対策について説明しなさい。",
    "少子高齢化の影響について述べなさい。", "三権分立の仕組みについて説明しなさい。", "室町時代の文化の特徴を答えなさい。", "阪神・淡路大震災の被害について述べなさい。", "SDGsの目標について説明しなさい。",
    "大化の改新の内容を説明しなさい。", "北海道の農業の特徴を述べなさい。", "選挙制度について説明しなさい。", "平安時代の文学について述べなさい。", "地球温暖化の原因について説明しなさい。",
]


def rules(spark):
    rows = [(stage, rank, theme or term, need, term, kind) for rank, (stage, theme, need, terms, kind) in enumerate(TABLE) for term in terms]
    return spark.createDataFrame(rows, "stage string, rule_rank int, theme string, need int, term string, class string")


def cascade(spark, rows, **more):
    df = spark.createDataFrame([(i, t, o) for i, (t, o) in enumerate(rows)], "i int, t string, o array<string>")
    return [r for r in themes.theme_cascade(df, STAGES, rules(spark), "t", ["i"], "o", SUFFIXES, EXCLUDED, "refined", **more).orderBy("i").collect()]


def test_questions_have_their_themes(spark):
    got = cascade(spark, [(t, o) for t, o, _ in CASES])
    assert [r.theme for r in got] == [theme for _, _, theme in CASES]
    assert [r.stage for r in got] == ["period", "specific", "refined", "cluster", "specific", "cluster", "lexicon", "refined"]
    assert [r.confidence for r in got] == [0.85, 0.95, 0.9, 0.9, 0.95, 0.9, 0.9, 0.9]


def test_most_questions_have_a_theme_and_context_words_their_suffix(spark):
    got = cascade(spark, [(t, None) for t in COVERAGE])
    assert sum(r.theme is not None for r in got) >= 0.8 * len(COVERAGE)
    by = {COVERAGE[r.i]: (r.theme, r.stage) for r in got}
    assert by["室町時代の文化の特徴を答えなさい。"] == ("室町時代の文化", "lexicon") and by["北海道の農業の特徴を述べなさい。"] == ("北海道の農業", "category") and by["関東地方の工業の特徴を述べなさい。"] == ("関東地方の産業", "category")
    assert by["下線部⑥について答えなさい。"] == (None, "excluded") and by["源頼朝が鎌倉に幕府を開いた理由を述べなさい。"] == ("鎌倉幕府", "cluster")


def test_options_exclusion_fallback_and_nulls(spark):
    rows = [("下線部の寺院を選びなさい。", ["延暦寺", "東大寺", None]), ("下線部の統計", None), ("雨温図の都市", []), ("石炭について", None), (None, None), ("北海道", ["東大寺"])]
    got = cascade(spark, rows, fallback="^(.{2,10}?)について")
    assert [(r.theme, r.confidence, r.stage) for r in got] == [("日本の中世の寺院", 0.8, "options"), (None, 0.0, "excluded"), ("資料の読み取り", 0.75, "abstract"), ("石炭", 0.5, "fallback"), (None, 0.0, "none"), ("北海道の特徴", 0.85, "category")]
