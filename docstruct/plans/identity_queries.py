"""Bindings of the identity family to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docstruct.operators import classify, identity
from docstruct.plans.lexicon_queries import YEARS_OF_DOCUMENTS, years_of_documents
from docstruct.plans.registry import query

_BONUS = {"four": 5, "item": 3, "two": -2}
_PRIORITY = {"four": 9, "item": 8, "two": 5}
_EXCLUDED = ["([0-9]{4})[0-9]"]


def _case(values):
    return "CASE rule " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


def _candidates(t):
    """E1's mentions with E2's contexts as a flag."""
    found = classify.excluded_years(t("documents"), "text", ["doc_id"], _EXCLUDED).withColumn("_x", F.lit(True))
    return years_of_documents(t).join(found, ["doc_id", "year"], "left").withColumn("excluded", F.coalesce("_x", F.lit(False))).drop("_x")


@query(f"""WITH x AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{_EXCLUDED[0]}', 1))::INT AS year, true AS x FROM documents),
c AS (SELECT y.doc_id, y.year, pos, coalesce({_case(_BONUS)}, 0) AS b, {_case(_PRIORITY)} AS p, coalesce(x, false) AS x FROM ({YEARS_OF_DOCUMENTS}) y LEFT JOIN x ON x.doc_id = y.doc_id AND x.year = y.year),
g AS (SELECT doc_id, year, (sum(CASE WHEN c.pos < 50 THEN 10 WHEN c.pos < 200 THEN 5 ELSE 0 END + b) + CASE WHEN year >= 2020 THEN 5 WHEN year < 2005 THEN -5 ELSE 0 END - CASE WHEN bool_or(x) THEN 8 ELSE 0 END)::BIGINT AS score, max(c.p) AS p, min(c.pos) AS pos FROM c GROUP BY doc_id, year),
top AS (SELECT doc_id, max(score) AS m, max(p) AS mp FROM g GROUP BY ALL)
SELECT doc_id, year, score, CASE WHEN m > 0 THEN 'score' WHEN mp IS NOT NULL THEN 'priority' ELSE 'latest' END AS step FROM g JOIN top USING (doc_id)
WHERE CASE WHEN m > 0 THEN score = m WHEN mp IS NOT NULL THEN p = mp ELSE true END
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN m > 0 OR mp IS NOT NULL THEN pos ELSE 0 END, year DESC) = 1""")
def e3_select_year(t):
    return identity.select_year(_candidates(t), ["doc_id"], _BONUS, _PRIORITY, 2020, 2005)


@query("""WITH n AS (SELECT page_id, url, page_id % 60 AS a, page_id % 60 + page_id % 7 - 1 AS b FROM pages), y AS (SELECT page_id, a, b, CASE WHEN a < 50 THEN 2000 + a ELSE 1900 + a END AS lo, CASE WHEN b < 50 THEN 2000 + b ELSE 1900 + b END AS hi FROM n)
SELECT page_id, unnest(CASE WHEN b >= 0 AND lo <= hi THEN range(lo, hi + 1) ELSE [NULL] END)::INT AS year FROM y""")
def e5_expand_year_range(t):
    two = lambda c: F.when(c >= 0, F.lpad(c.cast("string"), 2, "0")).otherwise("no")
    n = F.col("page_id")
    name = F.concat(F.regexp_replace("url", "[0-9]+", ""), F.lit("#"), two(n % 60), F.lit("-"), two(n % 60 + n % 7 - 1))
    return identity.expand_year_range(t("pages").select("page_id", name.alias("name")), "name").drop("name")


@query(f"""WITH c AS ({YEARS_OF_DOCUMENTS}), g AS (SELECT doc_id, count(DISTINCT rule) AS r, count(DISTINCT year) AS y, max(year) - min(year) AS d, bool_or(rule = 'item') AS name, bool_or(rule = 'four') AS s, bool_or(rule = 'two') AS w FROM c GROUP BY ALL),
p AS (SELECT *, name::INT * 5 + (r > 1)::INT * 2 + (y > 1 AND d = y - 1)::INT * 2 AS b FROM g)
SELECT doc_id, (least(CASE WHEN s THEN b + 3 WHEN w AND r = 1 THEN greatest(b, 3) ELSE b + 1 END, 10) / 10.0)::DOUBLE AS confidence FROM p""")
def e7_year_confidence(t):
    return identity.year_confidence(years_of_documents(t), ["doc_id"], "item", ["four"], "two")


_SUBJECTS = [("law", "[Ll]icens|rights"), ("figures", "[0-9]{4}"), ("prose", "[a-z]{4}")]
_KINDS = [("table", "[|]"), ("list", "\n[-*] "), ("text", "[.]")]


@query("WITH h AS (SELECT doc_id, array_to_string(string_split(text, chr(10))[1:10], chr(10)) AS h FROM documents) SELECT doc_id, " + ", ".join("CASE " + " ".join(f"WHEN regexp_matches(h, '{p}') THEN '{n}'" for n, p in rules) + f" END AS {name}" for name, rules in (("subject", _SUBJECTS), ("kind", _KINDS))) + " FROM h")
def e8_subject_and_kind(t):
    return identity.subject_and_kind(t("documents"), _SUBJECTS, _KINDS, "text", ["doc_id"])


ALIASES = [("der", "german", 10, 1), ("und", "german", 8, 2), ("the", "english", 10, 3), ("of", "english", 5, 4), ("les", "french", 10, 5), ("los", "spanish", 10, 6), ("src1", "first", 5, 7), ("fr", "french", 5, 8)]


@query("WITH al(alias, entity, priority, alias_rank) AS (VALUES " + ", ".join(map(str, ALIASES)) + r"""), z AS (
SELECT doc_id, 'head' AS zone, unnest(regexp_extract_all(lower(substring(text, 1, 1000)), '[\p{Latin}0-9]+')) AS alias FROM documents
UNION ALL SELECT doc_id, 'rest', unnest(regexp_extract_all(lower(substring(text, 1001)), '[\p{Latin}0-9]+')) FROM documents
UNION ALL SELECT doc_id, 'file', source FROM documents UNION ALL SELECT doc_id, 'folder', lang FROM documents),
c AS (SELECT doc_id, entity, alias, priority, alias_rank, zone, count(*) AS n FROM z JOIN al USING (alias) GROUP BY ALL),
s AS (SELECT doc_id, entity, round(sum(priority * CASE zone WHEN 'head' THEN 2.0::DOUBLE * n WHEN 'rest' THEN least(n, 3) WHEN 'file' THEN 1 ELSE 0.8::DOUBLE END), 1) AS score, min(alias_rank) AS f FROM c GROUP BY ALL)
SELECT doc_id, entity, score, round(least(score / 10, 1.0::DOUBLE), 4) AS confidence FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, f, entity) = 1""")
def e8_detect_entity(t):
    docs = t("documents")
    aliases = docs.sparkSession.createDataFrame(ALIASES, "alias string, entity string, priority int, alias_rank int")
    return identity.detect_entity(docs.withColumn("path", F.concat_ws("/", "lang", "source")), aliases, "text", "path", ["doc_id"])


_LIMITS = [("most", "within ([0-9]+) words"), ("about", "about ([0-9]+) words"), ("lines", "([0-9]+) lines")]


@query("""WITH k AS (SELECT p_type, p_size::BIGINT * CASE WHEN p_partkey % 4 = 2 THEN 40 ELSE 1 END AS v, p_partkey % 4 AS m FROM part),
l AS (SELECT p_type, CASE m WHEN 0 THEN v || ' most' WHEN 3 THEN 'none' ELSE v || ' about' END AS label, CASE m WHEN 0 THEN 0 WHEN 3 THEN NULL ELSE round(v * 8 / 10.0)::BIGINT END AS least, CASE m WHEN 0 THEN v WHEN 3 THEN NULL ELSE round(v * 12 / 10.0)::BIGINT END AS most FROM k),
c AS (SELECT p_type, label, least, most, count(*) AS n FROM l GROUP BY ALL)
SELECT *, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY p_type), 1) AS pct FROM c""")
def e10_limit_histogram(t):
    asked = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat('Explain within ', p_size, ' words') WHEN 1 THEN concat('Explain in about ', p_size, ' words') WHEN 2 THEN concat('Use ', p_size, ' lines') ELSE 'Explain' END")
    return identity.limit_histogram(t("part").select("p_type", asked.alias("asked")), _LIMITS, "asked", ["p_type"])


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r, l_quantity::BIGINT AS q, l_partkey FROM lineitem),
m AS (SELECT l_orderkey, l_linenumber, q AS points, (l_partkey % 3 = 0) AS later, r FROM l WHERE l_partkey % 3 < 2),
b AS (SELECT l_orderkey, l_linenumber, points FROM m QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY later DESC, r DESC) = 1),
t AS (SELECT l_orderkey, sum(l_quantity)::BIGINT AS total_points FROM lineitem GROUP BY ALL), d AS (SELECT DISTINCT l_orderkey, l_linenumber::BIGINT AS l_linenumber FROM lineitem)
SELECT d.l_orderkey, d.l_linenumber, points, CASE WHEN d.l_orderkey % 2 = 0 THEN total_points END AS total_points FROM d LEFT JOIN b USING (l_orderkey, l_linenumber) JOIN t USING (l_orderkey)""")
def e11_score_sheet(t):
    items = t("lineitem").selectExpr("l_orderkey", "CAST(l_linenumber AS long) AS l_linenumber", "l_partkey", "l_suppkey", "CAST(l_quantity AS long) AS q")
    row = F.expr("CASE l_partkey % 3 WHEN 0 THEN concat('(', l_linenumber, ') ', q, ' points') WHEN 1 THEN concat('Q', l_linenumber, ': ', q, ' points') ELSE concat('Q', l_linenumber, ': none') END")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "q", row.alias("row")))), lambda x: x["row"])
    sheets = items.groupBy("l_orderkey").agg(F.array_join(listed, "\n").alias("rows"), F.sum("q").alias("all"))
    sheets = sheets.select("l_orderkey", F.concat("rows", F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("\nTotal: "), "all")).otherwise("")).alias("sheet"))
    questions = items.select("l_orderkey", "l_linenumber").distinct()
    return identity.score_sheet(sheets, questions, [r"Q([0-9]+): ([0-9]+) points", r"\(([0-9]+)\) ([0-9]+) points"], "Total: ([0-9]+)", "sheet", ["l_orderkey"], "l_linenumber")
