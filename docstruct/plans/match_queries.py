"""Bindings of keyword candidates, related terms, fuzzy matches, similar documents, rule packs, chains and reports to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docstruct.operators import lexicon, stats
from docstruct.plans import compose
from docstruct.plans.registry import query
from docstruct.sources import reports

_FAMILIES = [("[a-z]+(?:tion|keit|heit)", 0), ("[A-Z][a-z]{2,}", 0), ("[0-9]{2,} ([a-z]+)", 1)]
_FOUND = "list_concat(" + ", ".join(f"regexp_extract_all(text, '{p}', {g})" for p, g in _FAMILIES) + ")"


@query(f"""WITH f AS (SELECT doc_id, {_FOUND} AS ws FROM documents), p AS (SELECT doc_id, unnest(ws) AS keyword, unnest(range(len(ws))) AS pos FROM f),
d AS (SELECT doc_id, keyword, min(pos) AS pos FROM p WHERE length(keyword) >= 2 GROUP BY ALL),
r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN regexp_matches(keyword, '(tion|keit)$') THEN 0 WHEN regexp_matches(keyword, '^.{{4,}}') THEN 1 ELSE 2 END, pos) AS rank, keyword FROM d)
SELECT * FROM r WHERE rank <= 20""")
def t6_keyword_candidates(t):
    return lexicon.keyword_candidates(t("documents"), _FAMILIES, ["(tion|keit)$", "^.{4,}"], "text", ["doc_id"])


@query("""WITH l AS (SELECT split_part(p_name, ' ', 2) AS category, split_part(p_name, ' ', 1) || ' ' || p_brand AS term, min(p_partkey) AS term_rank FROM part GROUP BY ALL HAVING NOT contains(term, 'cold')),
k AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY term_rank, term) AS rank FROM l QUALIFY rank <= 3)
SELECT p.p_partkey, k.category, rank, term FROM (SELECT p_partkey, CASE WHEN regexp_matches(p_type, '^(PROMO|SMALL)') THEN 'bolt' WHEN contains(p_type, 'STANDARD') THEN 'widget' ELSE 'gear' END AS category FROM part) p JOIN k USING (category)""")
def t8_related_terms(t):
    part = t("part")
    own = part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("category"), F.concat_ws(" ", F.split_part("p_name", F.lit(" "), F.lit(1)), "p_brand").alias("term"), F.col("p_partkey").alias("term_rank"))
    generic = own.where(F.contains("term", F.lit("cold"))).select("term").distinct()
    return lexicon.related_terms(part, [("^(PROMO|SMALL)", "bolt"), ("STANDARD", "widget")], "gear", own, generic, "p_type", ["p_partkey"], 3)


FUZZY = [("bolt", "Brand#13", 1), ("large", "Brand#5", 2), ("small widget", "Brand#19", 3), ("cogs", "Brand#2", 4), ("wide", "Brand#3", 5), ("gears", "Brand#4", 6), ("hot", "Brand#1", 7)]


@query("WITH lex(term, term_field, term_rank) AS (VALUES " + ", ".join(map(str, FUZZY)) + """), k AS (SELECT DISTINCT p_name AS kw, p_brand AS f FROM part),
c AS (SELECT kw, f, term, term_field, term_rank, list_distinct(string_split(kw, '')) AS a, list_distinct(string_split(term, '')) AS b FROM k CROSS JOIN lex),
s AS (SELECT kw, f, term, term_field, term_rank, round(CASE WHEN kw = term THEN 1.0::DOUBLE WHEN contains(kw, term) OR contains(term, kw) THEN 0.8 WHEN 2 * len(list_intersect(a, b)) > len(a) + len(b) - len(list_intersect(a, b)) THEN 0.6 ELSE 0.3 END * CASE WHEN f = term_field THEN 1.2::DOUBLE ELSE 1 END, 2) AS score FROM c WHERE len(list_intersect(a, b)) > 0),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY kw, f ORDER BY score DESC, term_rank, term) = 1)
SELECT p_partkey, p_name, p_brand, term, term_field, score FROM part JOIN b ON p_name = kw AND p_brand = f""")
def t10_fuzzy_term_match(t):
    part = t("part")
    terms = part.sparkSession.createDataFrame(FUZZY, "term string, field string, term_rank int")
    return lexicon.fuzzy_term_match(part, terms, ["p_partkey"], "p_name", "p_brand")


@query(r"""WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> ''))) AS ws FROM documents),
c AS (SELECT ws, min(doc_id) AS class_id FROM w GROUP BY ws), x AS (SELECT class_id, len(ws) AS m, unnest(ws) AS word FROM c WHERE len(ws) > 0),
p AS (SELECT a.class_id AS a, b.class_id AS b, count(*) AS s FROM x a JOIN x b ON a.word = b.word AND a.class_id <> b.class_id GROUP BY ALL HAVING count(*) >= 0.8::DOUBLE * (any_value(a.m) + any_value(b.m) - count(*)) - 1e-9),
l AS (SELECT a AS class_id, count(*) AS n FROM p GROUP BY a)
SELECT doc_id, class_id, coalesce(n, 0) AS n_links FROM w JOIN c USING (ws) LEFT JOIN l USING (class_id)""")
def t15_similar_documents(t):
    return lexicon.similar_documents(t("documents"), "text", "doc_id", 0.8)


PACKS = [("german", "de", 5, "label", "der", 1), ("german", "de", 5, "label", "und", 2), ("plain", "de", 5, "label", "ein", 1), ("english", "en", 3, "theme", "tion", 1), ("late", "en", 2, "theme", "ing", 1), ("any", "*", 1, "label", "[0-9]", 1), ("any", "*", 1, "theme", "[a-z]", 2)]


@query("WITH packs(pack, school, priority, kind, rule, rule_order) AS (VALUES " + ", ".join(map(str, PACKS)) + """), b AS (SELECT school, pack FROM packs QUALIFY row_number() OVER (PARTITION BY school ORDER BY priority DESC, pack, rule_order) = 1)
SELECT doc_id, p.pack, kind, rule, rule_order FROM documents d LEFT JOIN b ON b.school = d.lang JOIN packs p ON p.pack = coalesce(b.pack, 'any')""")
def u1_resolve_rule_pack(t):
    docs = t("documents")
    packs = docs.sparkSession.createDataFrame(PACKS, "pack string, school string, priority int, kind string, rule string, rule_order int")
    return compose.resolve_rule_pack(docs, packs, "lang", ["doc_id"])


@query("""WITH s AS (SELECT lang, CASE WHEN length(text) >= 2000 THEN 'long' ELSE 'short' END AS size FROM documents WHERE text IS NOT NULL AND length(text) > 0), c AS (SELECT lang, size AS label, count(*) AS n FROM s GROUP BY ALL)
SELECT lang, label, n FROM c WHERE n > 1""")
def u2_pipeline(t):
    chain = compose.pipeline([
        ("input", lambda d: d.where(F.length("text") > 0)),
        ("label", lambda d: d.select("lang", F.when(F.length("text") >= 2000, "long").otherwise("short").alias("label"))),
        ("count", lambda d: stats.distribution(d, "label", ["lang"])),
        ("keep", lambda d: d.where("n > 1").select("lang", "label", "n")),
    ])
    return chain(t("documents"))


@query("""WITH b AS (SELECT conv_id, turn, role, CASE WHEN length(text) > 200 THEN 'long' ELSE 'short' END AS size, length(text) AS n FROM conversations), t AS (SELECT conv_id, count(*) AS n, string_agg(turn || ' ' || role || ' ' || n, chr(10) ORDER BY turn, role, n) AS details FROM b GROUP BY conv_id),
x AS (SELECT conv_id, 0 AS d, role AS label, count(*) AS n FROM b GROUP BY ALL UNION ALL SELECT conv_id, 1, size, count(*) FROM b GROUP BY ALL),
s AS (SELECT conv_id, d, string_agg(label || ': ' || x.n || ' (' || printf('%.1f', round(100.0::DOUBLE * x.n / t.n, 1)) || '%)', chr(10) ORDER BY x.n DESC, label) AS lines FROM x JOIN t USING (conv_id) GROUP BY ALL)
SELECT t.conv_id, 'conversation ' || t.conv_id || chr(10) || 'rows: ' || t.n || chr(10) || '[role]' || chr(10) || a.lines || chr(10) || '[size]' || chr(10) || z.lines || chr(10) || '[details]' || chr(10) || details AS report
FROM t JOIN s a ON a.conv_id = t.conv_id AND a.d = 0 JOIN s z ON z.conv_id = t.conv_id AND z.d = 1""")
def s9_render_reports(t):
    rows = t("conversations").withColumns({"n": F.length("text"), "size": F.when(F.length("text") > 200, "long").otherwise("short")})
    return reports.render_reports(rows, ["conv_id"], F.concat(F.lit("conversation "), "conv_id"), ["role", "size"], F.concat_ws(" ", "turn", "role", "n"), ["turn", "role", "n"])
