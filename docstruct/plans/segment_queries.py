"""Bindings of the segmentation and preparation families to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docstruct.operators import prepare, segment
from docstruct.plans.registry import query

RULES = [("article", "(?:The|Le|Der|El) ", 3), ("capital", "[A-Z][a-z]+[.] ", 5)]
_LINES = "SELECT doc_id, i, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"
_MARKERS = "WITH l AS (" + _LINES + "), m AS (" + " UNION ALL ".join(f"SELECT doc_id, i AS line_no, pos, '{n}' AS rule, {p} AS priority, regexp_extract(line, '^(?:{r})') AS marker FROM l WHERE regexp_matches(line, '^(?:{r})')" for n, r, p in RULES) + ")"


@query(_MARKERS + " SELECT doc_id, line_no, pos, pos + length(marker) AS \"end\", rule, priority, marker FROM m")
def g1_find_markers(t):
    return segment.find_markers(t("documents"), RULES, "text", ["doc_id"]).select("doc_id", F.col("line_no").cast("long").alias("line_no"), "pos", "end", "rule", "priority", "marker")


_ANYWHERE = [("dotted", "([A-Z])[a-z]{3,5}[.]", 3), ("figure", "([0-9])[0-9]{3,}", 6)]
_PLACED = "a AS (" + " UNION ALL ".join(f"""SELECT doc_id, '{n}' AS rule, {p} AS priority, v AS marker, coalesce(sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(g) AS pos, length(m) AS size
FROM (SELECT doc_id, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g FROM (SELECT doc_id, regexp_extract_all(text, '({r})', 1) AS ms, regexp_extract_all(text, '({r})', 2) AS vs, string_split_regex(text, '{r}') AS gs FROM documents))""" for n, r, p in _ANYWHERE) + ")"


@query("WITH " + _PLACED + """, x AS (SELECT doc_id, length(regexp_replace(substr(text, 1, pos), '[^\n]', '', 'g')) AS line_no, pos, pos + size AS "end", rule, priority, marker, text FROM a JOIN documents USING (doc_id))
SELECT * EXCLUDE (text), string_split(text, chr(10))[line_no + 1] AS line FROM x""")
def g1_find_markers_anywhere(t):
    return segment.find_markers(t("documents"), _ANYWHERE, "text", ["doc_id"], 1, True, True).withColumn("line_no", F.col("line_no").cast("long"))


@query("WITH RECURSIVE " + _PLACED + """, m AS (SELECT DISTINCT doc_id, pos, 1 + (ascii(marker) % 7)::BIGINT AS number, priority FROM a WHERE ascii(marker) % 5 > 0),
f AS (SELECT doc_id, arg_max(pos, struct_pack(p := priority, q := -pos)) AS pos FROM m WHERE number = 1 GROUP BY doc_id),
o AS (SELECT m.*, row_number() OVER (PARTITION BY doc_id ORDER BY m.pos, m.number, m.priority) AS i FROM m JOIN f USING (doc_id) WHERE m.pos > f.pos OR m.pos = f.pos AND m.number = 1),
r AS (SELECT doc_id, i, [struct_pack(pos := pos, number := number, priority := priority)] AS k FROM o WHERE i = 1
UNION ALL SELECT o.doc_id, o.i, CASE WHEN o.pos - k[len(k)].pos < 30 AND o.priority > k[len(k)].priority THEN list_append(k[1:len(k) - 1], struct_pack(pos := o.pos, number := o.number, priority := o.priority))
WHEN o.pos - k[len(k)].pos >= 30 AND (o.number > k[len(k)].number OR o.priority >= 6) THEN list_append(k, struct_pack(pos := o.pos, number := o.number, priority := o.priority)) ELSE k END FROM r JOIN o ON o.doc_id = r.doc_id AND o.i = r.i + 1),
z AS (SELECT doc_id, unnest(k) AS x FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1)
SELECT doc_id, x.pos AS pos, x.number AS number, x.priority AS priority FROM z""")
def g2_select_markers(t):
    found = segment.find_markers(t("documents"), _ANYWHERE, "text", ["doc_id"], 1, True)
    numbered = found.selectExpr("doc_id", "pos", "bigint(1 + ascii(marker) % 7) AS number", "priority", "ascii(marker) % 5 = 0 AS small").distinct()
    return segment.select_markers(numbered, ["doc_id"], 30, F.col("small"))


@query(_MARKERS + """, s AS (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS stop, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM (SELECT DISTINCT doc_id, pos FROM m))
SELECT doc_id, coalesce(n, 1) AS segment_no, coalesce(pos, 0) AS start, coalesce(stop, length(text)) AS stop, substr(text, coalesce(pos, 0) + 1, coalesce(stop, length(text)) - coalesce(pos, 0)) AS segment FROM documents LEFT JOIN s USING (doc_id)""")
def g3_cut_segments(t):
    docs = t("documents")
    return segment.cut_segments(docs, segment.find_markers(docs, RULES, "text", ["doc_id"]), "text", ["doc_id"])


@query("""WITH l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line, len(ls) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
SELECT doc_id, least(i // greatest(n // 4, 1), 3)::BIGINT AS part, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS segment FROM l GROUP BY ALL""")
def g4_equal_split(t):
    return segment.equal_split(t("documents"), 4, "text", ["doc_id"]).withColumn("part", F.col("part").cast("long"))


@query("""WITH i AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type <> 'error'), h AS (SELECT user_id, ts, event_id AS heading FROM events WHERE event_type = 'error')
SELECT event_id, i.user_id, i.ts, value, h.heading FROM i ASOF LEFT JOIN h ON i.user_id = h.user_id AND i.ts >= h.ts""")
def g6_assign_heading(t):
    events = t("events")
    return segment.assign_heading(events.where("event_type <> 'error'").select("event_id", "user_id", "ts", "value"), events.where("event_type = 'error'").select("user_id", "ts", F.col("event_id").alias("heading")), ["user_id"], "ts", "heading")


@query("""WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 0 WHEN role = 'user' THEN 1 ELSE 2 END AS level FROM conversations),
a AS (SELECT *, sum((level = 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS a FROM l),
b AS (SELECT *, sum((level = 1)::INT) OVER (PARTITION BY conv_id, a ORDER BY turn)::BIGINT AS b FROM a WHERE a > 0),
c AS (SELECT *, sum((level = 2)::INT) OVER (PARTITION BY conv_id, a, b ORDER BY turn)::BIGINT AS c FROM b)
SELECT conv_id, turn, level, CASE level WHEN 0 THEN a::VARCHAR WHEN 1 THEN a || '-' || b ELSE a || '-' || b || '-' || c END AS node_id, CASE level WHEN 1 THEN a::VARCHAR WHEN 2 THEN a || '-' || b END AS parent_id FROM c WHERE level < 2 OR b > 0""")
def g7_build_hierarchy(t):
    level = F.expr("CASE WHEN turn % 5 = 0 THEN 0 WHEN role = 'user' THEN 1 ELSE 2 END")
    return segment.build_hierarchy(t("conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], level).drop("role")


_PATTERNS = ["[0-9]+ [a-z]+", "[A-Z]{2,}"]


@query(f"""WITH e AS (SELECT doc_id, regexp_extract_all(text, '{_PATTERNS[0]}') AS a, regexp_extract_all(text, '{_PATTERNS[1]}') AS b, list_filter(string_split(text, chr(10)), lambda x: length(x) > 20) AS c FROM documents),
f AS (SELECT doc_id, CASE WHEN len(a) > 0 THEN 1 WHEN len(b) > 0 THEN 2 ELSE 0 END AS pattern_no, CASE WHEN len(a) > 0 THEN a WHEN len(b) > 0 THEN b ELSE c END AS items FROM e)
SELECT doc_id, pattern_no, unnest(range(len(items))) AS item_no, unnest(items) AS item FROM f""")
def g8_extract_items(t):
    return segment.extract_items(t("documents"), _PATTERNS, "text", ["doc_id"]).withColumn("item_no", F.col("item_no").cast("long"))


@query("""SELECT page_id, count(*) AS n_choices, count(DISTINCT c) AS n_distinct FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li>(<a[^>]*>)?([^<]*)', 2)) AS c FROM pages) GROUP BY page_id""")
def g9_extract_choices(t):
    return segment.extract_choices(t("pages"), "<li>(?:<a[^>]*>)?([^<]*)", "html", ["page_id"])


@query("""SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::BIGINT AS choice_no, regexp_extract(m, '<(li|td)>([^<]*)', 1) AS marker, trim(regexp_extract(m, '<(li|td)>([^<]*)', 2)) AS choice FROM (SELECT page_id, unnest(ms) AS m, unnest(range(len(ms))) AS i FROM (SELECT page_id, regexp_extract_all(html, '<(li|td)>([^<]*)', 0) AS ms FROM pages))""")
def g9_choice_rows(t):
    return segment.choice_rows(t("pages"), "<(li|td)>([^<]*)", "html", ["page_id"]).withColumn("choice_no", F.col("choice_no").cast("long"))


@query("""WITH RECURSIVE p AS (SELECT DISTINCT user_id, epoch_us(ts) AS pos FROM events), k AS (SELECT user_id, min(pos) AS pos FROM p GROUP BY user_id
UNION ALL SELECT k.user_id, (SELECT min(p.pos) FROM p WHERE p.user_id = k.user_id AND p.pos >= k.pos + 600000000) FROM k WHERE k.pos IS NOT NULL) SELECT user_id, pos FROM k WHERE pos IS NOT NULL""")
def g10_thin_by_distance(t):
    return segment.thin_by_distance(t("events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("pos")), ["user_id"], "pos", 600_000_000)


@query("WITH RECURSIVE l AS (" + _LINES + """), n AS (SELECT doc_id, max(i) AS last FROM l GROUP BY doc_id), c AS (SELECT doc_id, pos FROM l WHERE regexp_matches(line, '[(][A-Z]|[0-9]{4}')),
b AS (SELECT doc_id, pos - 1 AS p, pos + 1 AS e FROM l JOIN n USING (doc_id) WHERE line = '' AND i > 0 AND i < last), t AS (SELECT doc_id, length(text)::BIGINT AS total FROM documents),
e AS (SELECT DISTINCT doc_id, e FROM (SELECT c.doc_id, c.pos, coalesce(min(b.e), min(total)) AS e FROM c JOIN t ON t.doc_id = c.doc_id LEFT JOIN b ON c.doc_id = b.doc_id AND c.pos <= b.p GROUP BY c.doc_id, c.pos)),
f AS (SELECT doc_id, min(pos) AS f FROM c GROUP BY doc_id), h AS (SELECT doc_id, CASE WHEN f > 0 AND regexp_matches(substr(text, 1, f), ' the | der ') THEN f END AS lead FROM documents LEFT JOIN f USING (doc_id)),
k AS (SELECT doc_id, coalesce(lead, 0)::BIGINT AS stop, 0::BIGINT AS start, CASE WHEN lead IS NULL THEN 'none' ELSE 'leading' END AS kind FROM h
UNION ALL SELECT k.doc_id, (SELECT min(e.e) FROM e WHERE e.doc_id = k.doc_id AND e.e >= k.stop + 500), k.stop, 'cited' FROM k WHERE k.stop IS NOT NULL),
s AS (SELECT doc_id, kind, start, stop FROM k WHERE stop IS NOT NULL AND kind <> 'none'), m AS (SELECT t.doc_id, total, max(stop) AS stop FROM t LEFT JOIN s USING (doc_id) GROUP BY ALL),
u AS (SELECT * FROM s UNION ALL SELECT doc_id, 'plain', coalesce(stop, 0), total FROM m WHERE stop IS NULL OR stop < total)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY stop) AS segment_no, kind, start, stop FROM u""")
def g11_split_by_citation(t):
    docs = t("documents")
    cited = segment.lines_with_offsets(docs, "text", ["doc_id"]).where(F.col("line").rlike("[(][A-Z]|[0-9]{4}"))
    return segment.split_by_citation(docs, cited, "text", ["doc_id"], leading=" the | der ").withColumn("segment_no", F.col("segment_no").cast("long"))


_BLOCKS = "SELECT l_orderkey, l_partkey % 2 AS page, (l_suppkey % 2) * 300.0::DOUBLE AS x0, (l_suppkey % 2) * 300.0::DOUBLE + 250 AS x1, l_linenumber * 10.0::DOUBLE + l_partkey % 7 AS y0, l_linenumber * 10.0::DOUBLE + 9 + l_partkey % 7 AS y1, l_partkey, CASE l_returnflag WHEN 'A' THEN 'title' WHEN 'R' THEN 'question' ELSE 'source' END AS block_type, 'P' || l_partkey AS text FROM lineitem"


def _blocks(t):
    return t("lineitem").selectExpr("l_orderkey", "l_partkey % 2 AS page", "(l_suppkey % 2) * 300.0D AS x0", "(l_suppkey % 2) * 300.0D + 250 AS x1", "l_linenumber * 10.0D + l_partkey % 7 AS y0", "l_linenumber * 10.0D + 9 + l_partkey % 7 AS y1", "l_partkey", "CASE l_returnflag WHEN 'A' THEN 'title' WHEN 'R' THEN 'question' ELSE 'source' END AS block_type", "'P' || l_partkey AS text")


_COLUMNS = "WITH b AS (" + _BLOCKS + """), m AS (SELECT *, max(x1) OVER (PARTITION BY l_orderkey, page) / 2 AS mid FROM b), s AS (SELECT *, CASE WHEN x1 <= mid * 1.1::DOUBLE THEN 0 WHEN x0 >= mid * 0.9::DOUBLE THEN 1 END AS side FROM m),
w AS (SELECT *, count(*) FILTER (side = 0) OVER q AS n0, count(*) FILTER (side = 1) OVER q AS n1, min(y0) FILTER (side = 0) OVER q AS a0, max(y1) FILTER (side = 0) OVER q AS b0, min(y0) FILTER (side = 1) OVER q AS a1, max(y1) FILTER (side = 1) OVER q AS b1 FROM s WINDOW q AS (PARTITION BY l_orderkey, page)),
c AS (SELECT *, CASE WHEN n0 > 3 AND n1 > 3 AND a0 < b1 AND a1 < b0 AND side = 1 THEN 1 ELSE 0 END AS "column" FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY page, "column", y0, x0, l_partkey, block_type) AS order_no FROM c) """


@query(_COLUMNS + """SELECT l_orderkey, page, x0, x1, y0, y1, l_partkey, block_type, text, "column", order_no FROM r""")
def g12_reading_order(t):
    return segment.reading_order(_blocks(t), "l_orderkey", ["l_partkey", "block_type"])


@query(_COLUMNS + """, t AS (SELECT *, sum((block_type = 'title')::INT) OVER (PARTITION BY l_orderkey ORDER BY order_no)::BIGINT AS section_no FROM r)
SELECT l_orderkey, section_no, max(text) FILTER (block_type = 'title') AS title, count(*) FILTER (block_type = 'question') AS n_questions, max(text) FILTER (block_type = 'source') AS source, coalesce(string_agg(text, chr(10) ORDER BY order_no) FILTER (block_type NOT IN ('title', 'source')), '') AS body FROM t GROUP BY ALL""")
def g13_assemble_blocks(t):
    return segment.assemble_blocks(segment.reading_order(_blocks(t), "l_orderkey", ["l_partkey", "block_type"]), "l_orderkey")


@query("""SELECT conv_id, turn, role, n AS n_candidates FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY length(text) DESC, turn) AS r, count(*) OVER (PARTITION BY conv_id, role) AS n
FROM conversations WHERE length(trim(text)) > 0) WHERE r = 1""")
def g14_merge_pages(t):
    return segment.merge_pages(t("conversations"), ["conv_id", "role"], "text", "turn").select("conv_id", "turn", "role", "n_candidates")


CLEAN = [("table_bars", r"[|]+", " "), ("marks", r"!+", "!"), ("digits", r"[0-9]{4,}", "#"), ("spaces", r" {2,}", " ")]
_SIZE = r"length(regexp_replace({}, '\s+', '', 'g'))"
_CLEAN_SQL = "WITH t0 AS (SELECT doc_id, lang, source, text AS t0 FROM documents)" + "".join(f", t{i + 1} AS (SELECT *, regexp_replace(t{i}, '{p}', '{r}', 'g') AS t{i + 1} FROM t{i})" for i, (_, p, r) in enumerate(CLEAN))


@query(_CLEAN_SQL + f" SELECT doc_id, t{len(CLEAN)} AS text, {_SIZE.format('t0')} AS chars_before, {_SIZE.format(f't{len(CLEAN)}')} AS chars_after, " + ", ".join(f"{_SIZE.format(f't{i}')} - {_SIZE.format(f't{i + 1}')} AS removed_{n}" for i, (n, _, _) in enumerate(CLEAN)) + f" FROM t{len(CLEAN)}")
def p1_clean_corpus(t):
    out = prepare.clean_corpus(t("documents").select("doc_id", "text"), CLEAN, "text")
    return out.select("doc_id", "text", *(F.col(c).cast("long").alias(c) for c in out.columns[2:]))


@query(_CLEAN_SQL + ", r AS (" + " UNION ALL ".join(f"SELECT lang, '{n}' AS rule, {_SIZE.format('t0')} AS c, {_SIZE.format(f't{i}')} - {_SIZE.format(f't{i + 1}')} AS gone FROM t{len(CLEAN)}" for i, (n, _, _) in enumerate(CLEAN)) + """)
SELECT lang, rule, count(*) FILTER (gone > 0) AS docs_hit, sum(gone)::BIGINT AS removed, sum(c)::BIGINT AS chars, round(sum(gone) * 100.0::DOUBLE / sum(c), 1) AS pct FROM r GROUP BY ALL""")
def p2_cleaning_report(t):
    return prepare.cleaning_report(prepare.clean_corpus(t("documents"), CLEAN, "text"), ["lang"], [n for n, _, _ in CLEAN])


TAILS = ["All rights reserved", "Licensed under", "the of"]
STRONG = ("password", "and the")


_CUT = "WITH p AS (SELECT doc_id, lang, text, floor(length(text) * 0.5::DOUBLE)::BIGINT AS b FROM documents), q AS (SELECT *, list_min(list_filter([" + ", ".join(f"struct_pack(at := CASE WHEN instr(substr(text, b + 1), '{m}') > 0 THEN b + instr(substr(text, b + 1), '{m}') ELSE 0 END, by := '{m}')" for m in TAILS) + "], lambda x: x.at > 0)) AS f, list_max(list_filter([" + ", ".join(f"struct_pack(at := CASE WHEN contains(text, '{m}') THEN length(text) - instr(reverse(text), reverse('{m}')) - length('{m}') + 2 ELSE 0 END, by := '{m}')" for m in STRONG) + "], lambda x: x.at > 0)) AS l FROM p), c AS (SELECT doc_id, lang, text AS was, (coalesce(f.at, l.at) - 1)::BIGINT AS cut_at, coalesce(f.by, l.by) AS cut_by FROM q) "


def _cut(t):
    return prepare.cut_boilerplate_tail(t("documents").select("doc_id", "lang", "text"), TAILS, "text", strong=STRONG)


@query(_CUT + "SELECT doc_id, cut_at, cut_by, CASE WHEN cut_at IS NULL THEN was ELSE substr(was, 1, cut_at) END AS text FROM c")
def p3_cut_boilerplate_tail(t):
    return _cut(t).select("doc_id", F.col("cut_at").cast("long").alias("cut_at"), "cut_by", "text")


@query(_CUT + "SELECT lang, count(*) AS n_docs, count(cut_at) AS n_cut, sum(CASE WHEN cut_at IS NOT NULL THEN length(was) - cut_at ELSE 0 END)::BIGINT AS chars_cut, round(sum(CASE WHEN cut_at IS NOT NULL THEN length(was) - cut_at ELSE 0 END) * 100.0::DOUBLE / sum(length(was)), 1) AS pct FROM c GROUP BY lang")
def p3_cut_report(t):
    return prepare.cut_report(t("documents"), _cut(t), ["doc_id"], "text", ["lang"])


DROP = [("empty", r"^\s*$"), ("numeric", r"^[0-9 .]+$"), ("table", r"[|].*[|]")]
_RULE = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for n, p in DROP) + " END"


@query(f"SELECT rule, count(*) AS n FROM (SELECT {_RULE} AS rule FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE rule IS NOT NULL GROUP BY rule")
def p5_line_rule_counts(t):
    return prepare.line_verdicts(t("documents"), DROP, "text", ["doc_id"]).where("rule IS NOT NULL").groupBy("rule").agg(F.count("*").alias("n"))


@query("WITH k AS (SELECT doc_id, string_split(text, chr(10)) AS ls, list_filter(string_split(text, chr(10)), lambda line: NOT (" + " OR ".join(f"regexp_matches(line, '{p}')" for _, p in DROP) + ")) AS ks FROM documents) SELECT doc_id, len(ls) - len(ks) AS n_dropped, array_to_string(ks, chr(10)) AS text FROM k")
def p5_filter_lines(t):
    return prepare.filter_lines(t("documents").select("doc_id", "text"), DROP, "text").select("doc_id", F.col("n_dropped").cast("long").alias("n_dropped"), "text")


@query("""SELECT source, reason, count(*) AS n FROM (SELECT source, CASE WHEN coalesce(length(trim(text)), 0) = 0 THEN 'empty' WHEN length(trim(text)) < 500 THEN 'too_short' WHEN length(trim(text)) > 5000 THEN 'too_long' END AS reason FROM documents) GROUP BY ALL""")
def p6_length_gate(t):
    return prepare.length_gate(t("documents"), "text", 500, 5000).groupBy("source", "reason").agg(F.count("*").alias("n"))


#: Sentence ends that no bracket protects, long pieces cut, and packing by one step a chunk over prefix sums.
@query(r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
q AS (SELECT doc_id, i, unnest(range(len(qs))) AS j, unnest(qs) AS part FROM (SELECT doc_id, i, CASE WHEN length(line) <= 800 THEN [line] ELSE string_split(regexp_replace(line, '([.!?。！？])\s*', '\1' || chr(1), 'g'), chr(1)) END AS qs FROM l)),
o AS (SELECT *, string_agg(part, '') OVER (PARTITION BY doc_id, i ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM q),
g AS (SELECT *, sum(CASE WHEN j = 0 OR regexp_matches(rest, '^[^(（「]*[)）」]') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, i ORDER BY j) AS g FROM o),
s AS (SELECT doc_id, i, g, string_agg(part, '' ORDER BY j) AS part FROM g GROUP BY ALL),
x AS (SELECT doc_id, i, g, k, substr(part, k * 800 + 1, 800) AS piece FROM (SELECT doc_id, i, g, part, unnest(range((length(part) + 799) // 800)) AS k FROM s)),
p AS (SELECT doc_id, piece, row_number() OVER w AS n, (sum(length(piece) + 1) OVER w)::BIGINT AS c FROM x WHERE length(piece) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY i, g, k)),
r AS (SELECT doc_id, 0 AS chunk_no, 0::BIGINT AS base, (SELECT max(p.c) FROM p WHERE p.doc_id = d.doc_id AND p.c <= 801)::BIGINT AS upto FROM (SELECT DISTINCT doc_id FROM p) d
UNION ALL SELECT r.doc_id, chunk_no + 1, r.upto, (SELECT max(p.c) FROM p WHERE p.doc_id = r.doc_id AND p.c > r.upto AND p.c <= r.upto + 801)::BIGINT FROM r WHERE r.upto IS NOT NULL)
SELECT doc_id, chunk_no::INTEGER AS chunk_no, string_agg(piece, chr(10) ORDER BY n) AS chunk FROM r JOIN p USING (doc_id) WHERE p.c > r.base AND p.c <= r.upto GROUP BY ALL""")
def p8_chunk_documents(t):
    return prepare.chunk_documents(t("documents"), 800, "text", ["doc_id"])


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def p10_filter_labels(t):
    return prepare.filter_labels(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1-URGENT", "2-HIGH"])
