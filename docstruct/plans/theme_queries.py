"""Bindings of the theme family to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docstruct.operators import lexicon, themes
from docstruct.plans.registry import query

KEYWORDS = [("en", "the", 3), ("en", "of", 2), ("en", "for", 1), ("de", "der", 3), ("de", "und", 2), ("de", "ist", 1), ("fr", "les", 3), ("fr", "que", 2), ("es", "los", 3), ("es", "que", 2)]
_W = r"w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{Latin}0-9]+')) AS ws FROM documents)"
_POINTS = {c: " + ".join(f"{v} * list_contains(ws, '{w}')::INT" for k, w, v in KEYWORDS if k == c) for c in ("en", "de", "fr", "es")}


@query(f"WITH {_W}, s AS (SELECT doc_id, [" + ", ".join(_POINTS.values()) + """] AS s FROM w), m AS (SELECT doc_id, s, list_max(s) AS top FROM s)
SELECT doc_id, CASE WHEN top < 2 THEN 'none' WHEN len(list_filter(s, lambda x: x = top)) > 1 THEN 'mixed' ELSE ['en', 'de', 'fr', 'es'][list_position(s, top)] END AS label, top::BIGINT AS score, CASE WHEN top >= 2 THEN round(top / list_sum(s)::DOUBLE, 4) ELSE 0 END AS confidence FROM m""")
def c4_score_keywords(t):
    return themes.score_keywords(t("documents"), KEYWORDS, "text", ["doc_id"], "none", 2, "mixed")


_COUNTS = {c: " + ".join(f"{v} * len(list_filter(ws, lambda x: x = '{w}'))" for k, w, v in KEYWORDS if k == c) for c in ("en", "de", "fr", "es")}


@query(r"WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{Latin}0-9]+') AS ws FROM conversations), s AS (SELECT conv_id, turn, [" + ", ".join(_COUNTS.values()) + """] AS s FROM w), m AS (SELECT conv_id, turn, s, list_max(s) AS top FROM s)
SELECT conv_id, turn, CASE WHEN top < 1 THEN 'none' ELSE ['en', 'de', 'fr', 'es'][list_position(s, top)] END AS label, top::BIGINT AS score, CASE WHEN top >= 1 THEN round(top / list_sum(s)::DOUBLE, 4) ELSE 0 END AS confidence FROM m""")
def c4_score_keyword_counts(t):
    return themes.score_keywords(t("conversations"), KEYWORDS, "text", ["conv_id", "turn"], "none", first_chars=2**31 - 1)


PERIODS = [("early", ["thanks", "licensed"], ["the", "and", "of"]), ("middle", ["rights"], ["der", "und"]), ("late", ["password"], ["les", "los", "que"])]
REGIONS = [("north", "der"), ("south", "los"), ("west", "les")]


@query(f"WITH {_W}, h AS (SELECT doc_id, ws, regexp_extract(text, '([0-9]{{2}})th', 1) AS c, [" + ", ".join("len(list_intersect(ws, [" + ", ".join(f"'{w}'" for w in words) + "]))" for _, _, words in PERIODS) + """] AS hits FROM w JOIN documents USING (doc_id)), p AS (SELECT *, CASE """ + " ".join(f"WHEN len(list_intersect(ws, {words})) > 0 THEN '{name}'" for name, words, _ in PERIODS) + """ END AS strong FROM h)
SELECT doc_id, coalesce(strong, nullif(c, '') || '. century', CASE WHEN list_max(hits) > 0 THEN ['early', 'middle', 'late'][list_position(hits, list_max(hits))] END) AS period,
CASE WHEN strong IS NOT NULL THEN 'strong' WHEN c <> '' THEN 'century' WHEN list_max(hits) > 0 THEN 'representative' END AS tier,
CASE """ + " ".join(f"WHEN list_contains(ws, '{w}') THEN '{n}'" for n, w in REGIONS) + " END AS region FROM p")
def c10_period_and_region(t):
    return themes.period_and_region(t("documents"), PERIODS, "([0-9]{2})th", REGIONS, "text", ["doc_id"])


_SUFFIXES = [("[Ll]icens", " and law"), ("[0-9]{4}", " and numbers"), ("\n", " in paragraphs")]
_STAGES = [("phrase", 0.9, "[a-z]+tion of"), ("mail", 0.85, "[a-z]+@[a-z]+"), ("heading", 0.75, "^[A-Z][a-z]+ [a-z]+")]


def _cascade(t):
    stages = [(name, confidence, F.nullif(F.regexp_extract("text", p, 0), F.lit(""))) for name, confidence, p in _STAGES]
    return themes.cascade(t("documents"), stages, ["doc_id", "lang"], "text", _SUFFIXES, "[|].*[|]", "heading")


_DECIDED = ("WITH k AS (SELECT doc_id, lang, " + ", ".join(f"nullif(regexp_extract(text, '{p}'), '') AS {n}" for n, _, p in _STAGES) + ", regexp_matches(text, '[|].*[|]') AS x, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{s}'" for p, s in _SUFFIXES) + """ ELSE '' END AS suffix FROM documents),
d AS (SELECT doc_id, lang, CASE WHEN phrase IS NOT NULL THEN phrase WHEN mail IS NOT NULL THEN mail WHEN x THEN NULL ELSE heading END || suffix AS theme,
CASE WHEN phrase IS NOT NULL THEN 0.9::DOUBLE WHEN mail IS NOT NULL THEN 0.85::DOUBLE WHEN x OR heading IS NULL THEN 0 ELSE 0.75::DOUBLE END AS confidence,
CASE WHEN phrase IS NOT NULL THEN 'phrase' WHEN mail IS NOT NULL THEN 'mail' WHEN x THEN 'excluded' WHEN heading IS NULL THEN 'none' ELSE 'heading' END AS stage FROM k) """)


@query(_DECIDED + "SELECT * FROM d")
def h1_cascade(t):
    return _cascade(t)


@query(_DECIDED + "SELECT lang, stage, count(*) AS n, round(avg(confidence), 4) AS mean_confidence FROM d GROUP BY ALL")
def h1_stage_usage(t):
    return themes.stage_usage(_cascade(t), ["lang"])


TERMS = [("the", "en", "article", 1), ("rights", "en", "law", 2), ("der", "de", "article", 3), ("los", "es", "article", 4), ("password", "en", "safety", 5)]
CLUSTERS = [("und", "german", 1), ("die", "german", 1), ("les", "french", 2), ("que", "french", 2)]
_CLASSES = [("^(german|french)$", " letters"), ("^[a-z]+$", " words")]


@query(f"WITH {_W}, lex(term, field, category, term_rank) AS (VALUES " + ", ".join(map(str, TERMS)) + "), cl(term, theme, r) AS (VALUES " + ", ".join(map(str, CLUSTERS)) + """), k AS (SELECT doc_id, unnest(ws) AS term FROM w),
a AS (SELECT doc_id, 0 AS i, arg_max(term, struct_pack(l := length(term), r := -term_rank)) AS theme FROM k JOIN lex USING (term) WHERE category <> 'article' GROUP BY doc_id),
b AS (SELECT doc_id, 1 AS i, nullif(regexp_extract(text, '([0-9]{2})th', 1), '') || '. century' AS theme FROM documents),
c AS (SELECT doc_id, 2 AS i, theme FROM (SELECT doc_id, theme, r, count(*) AS n FROM k JOIN cl USING (term) GROUP BY ALL HAVING count(*) >= 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY r) = 1),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE theme IS NOT NULL UNION ALL SELECT * FROM c), m AS (SELECT doc_id, arg_min(theme, i) AS t, min(i) AS i FROM u GROUP BY doc_id),
d AS (SELECT doc_id, t, i, regexp_matches(text, '[|].*[|]') AND coalesce(i, 3) >= 2 AS gone, CASE """ + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{s}'" for p, s in _SUFFIXES) + """ END AS suffix FROM documents LEFT JOIN m USING (doc_id))
SELECT doc_id, CASE WHEN NOT gone THEN t || coalesce(suffix, CASE """ + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{s}'" for p, s in _CLASSES) + """ ELSE '' END) END AS theme, CASE WHEN gone OR i IS NULL THEN 0 ELSE [0.9, 0.85, 0.75][i + 1]::DOUBLE END AS confidence,
CASE WHEN gone THEN 'excluded' WHEN i IS NULL THEN 'none' ELSE ['lexicon', 'period', 'cluster'][i + 1] END AS stage FROM d""")
def h1_cascade_tables(t):
    docs = t("documents")
    lex = docs.sparkSession.createDataFrame(TERMS, "term string, field string, category string, term_rank int")
    hits = docs.select("doc_id", F.explode(lexicon.tokens("text", r"[\p{IsLatin}0-9]+")).alias("term")).join(lex.where("category <> 'article'"), "term")
    clusters = docs.sparkSession.createDataFrame(CLUSTERS, "term string, theme string, cluster_rank int")
    periods = themes.period_and_region(docs, [("none", ["qqqq"], ["qqqq"])], "([0-9]{2})th", [("none", "qqqq")], "text", ["doc_id"])
    stages = [
        ("lexicon", 0.9, lexicon.longest_term(hits, ["doc_id"]).withColumnRenamed("term", "theme")),
        ("period", 0.85, periods.select("doc_id", F.col("period").alias("theme"))),
        ("cluster", 0.75, lexicon.cooccurrence_rules(docs, clusters, "text", ["doc_id"])),
    ]
    return themes.cascade_tables(docs, stages, ["doc_id"], "text", _SUFFIXES, _CLASSES, "[|].*[|]", "cluster")


_FRAGMENTS = [("cold", "^cold ", "cool "), ("plain", "^[a-z]+ bolt$", None)]
_VALID = """WITH v AS (SELECT p_partkey, p_brand, p_name, CASE WHEN trim(p_name) = '' THEN 'empty' WHEN length(p_name) < 9 THEN 'short' WHEN regexp_matches(p_name, '^cold ') THEN 'cold' WHEN regexp_matches(p_name, '^[a-z]+ bolt$') THEN 'plain'
WHEN count(*) OVER (PARTITION BY p_brand, p_name) > 1 THEN 'repeated' END AS rule FROM part) """


def _validated(t):
    return themes.validate_themes(t("part").select("p_partkey", "p_brand", "p_name"), "p_name", ["p_brand"], 9, _FRAGMENTS)


@query(_VALID + "SELECT *, rule IS NULL AS valid, CASE WHEN rule IS NULL THEN p_name WHEN rule = 'cold' THEN regexp_replace(p_name, '^cold ', 'cool ') END AS repaired FROM v")
def h4_validate_themes(t):
    return _validated(t)


@query(_VALID + "SELECT p_brand, count(*) AS n, count(rule) AS n_invalid, round(100.0::DOUBLE * count(rule) / count(*), 1) AS rate FROM v GROUP BY p_brand")
def h4_fragment_rates(t):
    return themes.fragment_rates(_validated(t), ["p_brand"])


_ANCHORS = [("[Ll]icensed", "law", "license"), ("password|token", "safety", "access"), ("[0-9]{5}", "figures", "numbers"), (" the ", "prose", "article")]


@query("WITH m AS (SELECT doc_id, lang, string_split_regex(text, '\n[-*] ')[1] AS main FROM documents), a AS (SELECT doc_id, lang, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(main, '{p}') THEN '{l}|{n}' END" for p, l, n in _ANCHORS) + """], lambda x: x IS NOT NULL) AS a FROM m)
SELECT doc_id, coalesce(split_part(a[1], '|', 1), lang) AS lang, CASE WHEN len(a) > 0 THEN array_to_string(list_transform(a[1:2], lambda x: split_part(x, '|', 2)), '+') END AS theme FROM a""")
def h5_override_by_anchor(t):
    return themes.override_by_anchor(t("documents").select("doc_id", "lang", "text"), _ANCHORS, "text", "\n[-*] ", "lang").drop("text")


_LINKS = [("site", "https?://([a-z0-9.]+)/([a-z]+)/([0-9]+)", 2, 0.9), ("link", '<a href="/([^"/]{1,2})([^"]*)">', 1, 0.5)]


@query("""WITH h AS (SELECT page_id, html || ' ' || url AS body FROM pages),
a AS (SELECT page_id, 2 AS p, 0.9::DOUBLE AS c, 'site' AS rule, regexp_extract_all(body, 'https?://([a-z0-9.]+)/([a-z]+)/([0-9]+)', 0) AS ms FROM h UNION ALL SELECT page_id, 1, 0.5::DOUBLE, 'link', regexp_extract_all(body, '<a href="/([^"/]{1,2})([^"]*)">', 0) FROM h),
e AS (SELECT page_id, p, c, rule, unnest(ms) AS m, unnest(range(len(ms))) AS pos FROM a),
x AS (SELECT page_id, p, c, rule, pos, trim(regexp_extract(m, CASE rule WHEN 'site' THEN 'https?://([a-z0-9.]+)/([a-z]+)/([0-9]+)' ELSE '<a href="/([^"/]{1,2})([^"]*)">' END, 1)) AS author, trim(regexp_extract(m, CASE rule WHEN 'site' THEN 'https?://([a-z0-9.]+)/([a-z]+)/([0-9]+)' ELSE '<a href="/([^"/]{1,2})([^"]*)">' END, 2)) AS title, CASE rule WHEN 'site' THEN nullif(regexp_extract(m, 'https?://([a-z0-9.]+)/([a-z]+)/([0-9]+)', 3), '') END AS venue FROM e),
u AS (SELECT * FROM x WHERE regexp_matches(author, '[A-Za-z]') AND regexp_matches(title, '[A-Za-z]') QUALIFY row_number() OVER (PARTITION BY page_id, author, title ORDER BY c DESC, p DESC, pos) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY p DESC, c DESC, pos, author, title) AS rank FROM u)
SELECT page_id, rank, author, title, venue, rule, c AS confidence, rank = 1 AS is_primary FROM r WHERE rank <= 10""")
def h6_extract_citations(t):
    pages = t("pages").select("page_id", F.concat_ws(" ", "html", "url").alias("body"))
    return themes.extract_citations(pages, _LINKS, "body", ["page_id"], "[A-Za-z]")


THEME_STAGES = [themes.Stage("lexicon", 0.9), themes.Stage("options", 0.8, "options"), themes.Stage("cluster", 0.85), themes.Stage("category", 0.75)]
THEME_RULES = [
    ("lexicon", 1, "rights", 1, "rights", "law"), ("lexicon", 2, "safety", 1, "password", None), ("options", 1, "first source", 1, "src1", None), ("options", 2, "french news", 2, "src2", "word"),
    ("options", 2, "french news", 2, "fr", "word"), ("cluster", 1, "german", 2, "und", "word"), ("cluster", 1, "german", 2, "die", "word"), ("cluster", 2, "spanish", 3, "los", "word"), ("cluster", 2, "spanish", 3, "que", "word"), ("cluster", 2, "spanish", 3, "del", "word"), ("category", 1, "english", 1, "the", "word"), ("category", 1, "english", 1, "of", "word"),
]
THEME_SUFFIXES = [("word", "ist", " in use"), (None, "licensed", " and law"), ("word", "", " words")]


@query("WITH rules(stage, rank, theme, need, term, class) AS (VALUES " + ", ".join(map(repr, THEME_RULES)).replace("None", "NULL") + "), st(stage, i, zone, confidence) AS (VALUES " + ", ".join(map(repr, [(s.name, i, s.zone, s.confidence) for i, s in enumerate(THEME_STAGES)])) + r"""),
w AS (SELECT doc_id, 'text' AS zone, list_distinct(regexp_extract_all(lower(text), '[\p{Latin}0-9]+')) AS ws FROM documents UNION ALL SELECT doc_id, 'options', [source, lang] FROM documents),
h AS (SELECT doc_id, zone, unnest(ws) AS term FROM w), g AS (SELECT doc_id, i, rank, theme, class, confidence, stage, -max(length(term)) AS s FROM h JOIN rules USING (term) JOIN st USING (stage, zone) GROUP BY doc_id, i, rank, theme, class, confidence, stage, need HAVING count(DISTINCT term) >= need),
b AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i, rank, s, theme) = 1),
c AS (SELECT d.doc_id, regexp_matches(text, '[|].*[|]') AS out, nullif(regexp_extract(text, '^([A-Z][a-z]+) ', 1), '') AS fall, ws, i, theme, class, confidence, stage FROM documents d JOIN w ON w.doc_id = d.doc_id AND w.zone = 'text' LEFT JOIN b ON b.doc_id = d.doc_id)
SELECT doc_id, CASE WHEN out AND coalesce(i, 4) >= 2 THEN NULL WHEN i IS NULL THEN fall ELSE theme || CASE WHEN class = 'word' AND list_contains(ws, 'ist') THEN ' in use' WHEN list_contains(ws, 'licensed') THEN ' and law' WHEN class = 'word' THEN ' words' ELSE '' END END AS theme,
CASE WHEN out AND coalesce(i, 4) >= 2 THEN 0 WHEN i IS NOT NULL THEN confidence WHEN fall IS NOT NULL THEN 0.5 ELSE 0 END::DOUBLE AS confidence,
CASE WHEN out AND coalesce(i, 4) >= 2 THEN 'excluded' WHEN i IS NOT NULL THEN stage WHEN fall IS NOT NULL THEN 'fallback' ELSE 'none' END AS stage FROM c""")
def h1_theme_cascade(t):
    docs = t("documents").withColumn("options", F.array("source", "lang"))
    rules = docs.sparkSession.createDataFrame(THEME_RULES, "stage string, rule_rank int, theme string, need int, term string, class string")
    return themes.theme_cascade(docs, THEME_STAGES, rules, "text", ["doc_id"], "options", THEME_SUFFIXES, "[|].*[|]", "cluster", "^([A-Z][a-z]+) ")
