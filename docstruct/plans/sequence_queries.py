"""Bindings of the sequence family to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docstruct.functions.numerals import numeral_table
from docstruct.operators import sequence
from docstruct.plans.registry import query

_LINES = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_LINE_COLUMNS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query("""WITH b AS (SELECT event_id, user_id, event_id % 5 + 1 AS num, lag(event_id % 5 + 1) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
SELECT event_id, user_id, num, 1 + sum(CASE WHEN num = 1 AND p > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS group_no FROM b""")
def g5_reset_groups(t):
    return sequence.reset_groups(t("events").selectExpr("event_id", "user_id", "event_id % 5 + 1 AS num"), ["user_id"], ["event_id"], "num")


@query("""WITH b AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, lag(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS p FROM lineitem)
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, 1 + sum(CASE WHEN p - l_linenumber >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING)::BIGINT AS group_no FROM b""")
def g5_reset_groups_by_drop(t):
    return sequence.reset_groups(t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], "l_linenumber", 3)


_NUMERALS = [("1-URGENT", 1), ("2-HIGH", 2), ("3-MEDIUM", 3), ("5-LOW", 5)]


@query("""WITH n(m, number) AS (VALUES """ + ", ".join(map(str, _NUMERALS)) + """) SELECT o_orderkey, o_orderpriority, number::BIGINT AS number FROM orders LEFT JOIN n ON m = o_orderpriority""")
def q1_lookup_numbers(t):
    orders = t("orders").select("o_orderkey", "o_orderpriority")
    return sequence.lookup_numbers(orders, "o_orderpriority", orders.sparkSession.createDataFrame(_NUMERALS, "marker string, number long")).select("o_orderkey", "o_orderpriority", "number")


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderpriority NOT IN (""" + ", ".join(f"'{m}'" for m, _ in _NUMERALS) + """) GROUP BY o_orderpriority""")
def q1_unresolved_markers(t):
    orders = t("orders").select("o_orderkey", "o_orderpriority")
    return sequence.unresolved(sequence.lookup_numbers(orders, "o_orderpriority", orders.sparkSession.createDataFrame(_NUMERALS, "marker string, number long")), "o_orderpriority")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS number FROM lineitem""")
def q1_numerals_of_scripts(t):
    digits = F.col("l_quantity").cast("int").cast("string")
    wide = F.when(F.col("l_orderkey") % 2 == 0, F.translate(digits, "0123456789", "０１２３４５６７８９")).otherwise(digits)
    items = t("lineitem").select(*_LINE_COLUMNS, wide.alias("marker"))
    return sequence.lookup_numbers(items, "marker", numeral_table(items.sparkSession)).select(*_LINE_COLUMNS, "number")


@query("""SELECT p_partkey, p_brand, p_brand || CASE WHEN r = 1 THEN '' ELSE '_' || r END AS unique_name FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)""")
def q2_suffix_duplicates(t):
    return sequence.suffix_duplicates(t("part").select("p_partkey", "p_brand"), [], "p_brand", ["p_partkey"])


@query("""WITH f AS (SELECT event_id, user_id, event_type, min(event_id) OVER (PARTITION BY user_id, event_type) AS f FROM events)
SELECT event_id, user_id, event_type, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type = 'view', f, event_type) AS group_no, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS item_no FROM f""")
def q3_renumber_by_appearance(t):
    return sequence.renumber_by_appearance(t("events").select("event_id", "user_id", "event_type"), ["user_id"], "event_type", "event_id", "view")


@query("""WITH i AS (SELECT l_orderkey, l_linenumber + CASE WHEN l_quantity > 40 THEN 2 ELSE 0 END AS num FROM lineitem), c AS (SELECT l_orderkey, num, count(*) AS n FROM i GROUP BY ALL),
b AS (SELECT *, lag(num) OVER (PARTITION BY l_orderkey ORDER BY num) AS p FROM c)
SELECT l_orderkey, 'start' AS kind, 1::BIGINT AS from_no, (num - 1)::BIGINT AS to_no FROM b WHERE p IS NULL AND num <> 1
UNION ALL SELECT l_orderkey, 'gap', p + 1, num - 1 FROM b WHERE num - p > 1 UNION ALL SELECT l_orderkey, 'duplicate', num, num FROM b WHERE n > 1""")
def q4_gap_report(t):
    return sequence.gap_report(t("lineitem").selectExpr("l_orderkey", "l_linenumber + CASE WHEN l_quantity > 40 THEN 2 ELSE 0 END AS num"), ["l_orderkey"], "num")


@query("""WITH d AS (SELECT o_custkey, datediff('day', DATE '1990-01-01', o_orderdate::DATE) // 30 AS first, min(o_orderpriority) AS source, count(*) AS chars FROM orders GROUP BY ALL),
m AS (SELECT *, CASE WHEN first <> lag(first) OVER (PARTITION BY o_custkey ORDER BY first) + 1 THEN 1 ELSE 0 END AS b FROM d),
i AS (SELECT *, 1 + sum(b) OVER (PARTITION BY o_custkey ORDER BY first)::BIGINT AS island FROM m)
SELECT o_custkey, island, min(first)::BIGINT AS first, max(first)::BIGINT AS last, count(*) AS n_merged, sum(chars)::BIGINT AS chars, arg_min(source, first) AS source FROM i GROUP BY ALL""")
def q5_merge_continuous(t):
    months = t("orders").withColumn("first", F.expr("bigint(datediff(date(o_orderdate), date'1990-01-01') div 30)")).groupBy("o_custkey", "first").agg(F.min("o_orderpriority").alias("source"), F.count("*").alias("chars"))
    return sequence.merge_continuous(months.withColumn("last", F.col("first")), ["o_custkey"], "first", "last", ["chars"], "source")


@query("""WITH d AS (SELECT DISTINCT o_custkey, datediff('day', DATE '1990-01-01', o_orderdate::DATE) // 30 AS first, datediff('day', DATE '1990-01-01', o_orderdate::DATE) // 30 + o_orderkey % 2 AS last FROM orders),
p AS (SELECT o_custkey, lag(last) OVER (PARTITION BY o_custkey ORDER BY first, last) AS from_last, first AS to_first FROM d), g AS (SELECT *, to_first - from_last - 1 AS gap FROM p)
SELECT *, CASE WHEN gap = 0 THEN 'continues' WHEN gap < 0 THEN 'overlap' ELSE 'gap' END AS relation FROM g WHERE gap <= 3""")
def q5_suggest_relations(t):
    months = t("orders").selectExpr("o_custkey", "bigint(datediff(date(o_orderdate), date'1990-01-01') div 30) AS first", "bigint(datediff(date(o_orderdate), date'1990-01-01') div 30) + o_orderkey % 2 AS last").distinct()
    return sequence.suggest_relations(months, ["o_custkey"], "first", "last", 3)


@query("""WITH e AS (SELECT l_orderkey, l_linenumber % 3 AS section, l_linenumber + l_partkey % 8 AS num, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem)
SELECT l_orderkey, min(section) AS section FROM e WHERE r <= 3 AND num >= 9 GROUP BY l_orderkey""")
def q6_first_late_section(t):
    items = t("lineitem").selectExpr(*_LINE_COLUMNS, "l_linenumber % 3 AS section", "l_linenumber + l_partkey % 8 AS num")
    return sequence.first_late_section(items, ["l_orderkey"], "section", "num", _ORDERED)


_ROMAN = [("ONE", 1), ("URGENT", 1), ("HIGH", 2), ("MEDIUM", 3), ("LOW", 5), ("1", 1), ("2", 2), ("3", 3), ("4", 400)]


@query("""WITH n(m, v) AS (VALUES """ + ", ".join(map(str, _ROMAN)) + """) SELECT o_orderkey, o_orderpriority, a.v::BIGINT AS major, b.v::BIGINT AS minor FROM orders LEFT JOIN (SELECT * FROM n WHERE v <= 100) a ON a.m = regexp_extract(o_orderpriority, '([0-9])-([A-Z]+)', 1) LEFT JOIN (SELECT * FROM n WHERE v <= 100) b ON b.m = regexp_extract(o_orderpriority, '([0-9])-([A-Z]+)', 2)""")
def q1_lookup_pairs(t):
    orders = t("orders").select("o_orderkey", "o_orderpriority")
    return sequence.lookup_pairs(orders, "o_orderpriority", "([0-9])-([A-Z]+)", orders.sparkSession.createDataFrame(_ROMAN, "marker string, number long"))


@query("""WITH b AS (SELECT event_id, user_id, event_id % 5 + 1 AS num, event_id * 100 AS pos, lag(event_id % 5 + 1) OVER (PARTITION BY user_id ORDER BY event_id) AS p, lag(event_id * 100) OVER (PARTITION BY user_id ORDER BY event_id) AS q FROM events)
SELECT event_id, user_id, num, pos, 1 + sum(CASE WHEN num = 1 AND p > 1 AND pos - q >= 500 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS group_no FROM b""")
def g5_reset_groups_by_distance(t):
    return sequence.reset_groups(t("events").selectExpr("event_id", "user_id", "event_id % 5 + 1 AS num", "event_id * 100 AS pos"), ["user_id"], ["event_id"], "num", pos="pos")


_ORDERED = ["l_linenumber", "l_partkey", "l_suppkey"]


@query(f"""WITH n AS (SELECT {_LINES}, l_linenumber + CASE WHEN l_quantity > 45 THEN 3 ELSE 0 END AS num FROM lineitem),
b AS (SELECT *, num - lag(num) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) > 2 AS leap FROM n)
SELECT {_LINES}, num, bool_or(coalesce(leap, false)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS misplaced FROM b""")
def q6_flag_misplaced(t):
    items = t("lineitem").selectExpr(*_LINE_COLUMNS, "l_linenumber + CASE WHEN l_quantity > 45 THEN 3 ELSE 0 END AS num")
    return sequence.flag_misplaced(items, ["l_orderkey"], "num", _ORDERED)


@query("""WITH i AS (SELECT event_id, user_id, event_id % 3 AS section, event_id AS num, event_type = 'error' AS misplaced FROM events),
m AS (SELECT event_id, user_id, section + CASE WHEN misplaced THEN 1 ELSE 0 END AS section, num, misplaced, section AS was FROM i)
SELECT event_id, user_id, section, num, misplaced, row_number() OVER (PARTITION BY user_id, section ORDER BY num, was) AS item_no FROM m""")
def q7_move_misplaced(t):
    items = t("events").selectExpr("event_id", "user_id", "event_id % 3 AS section", "event_id AS num", "event_type = 'error' AS misplaced")
    return sequence.move_misplaced(items, ["user_id"], "section", "num")


@query("""SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def q8_dedupe_first(t):
    return sequence.dedupe_first(t("documents"), F.sha2("text", 256), ["doc_id"]).select("doc_id", "source")


@query(r"""WITH x AS (SELECT doc_id, unnest(range(len(ls))) AS i, trim(unnest(ls)) AS b FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
SELECT doc_id, i, CASE WHEN length(b) < 20 THEN 'short' WHEN length(regexp_replace(b, '[0-9|!*#$%&]+', '', 'g')) < 10 THEN 'noise'
WHEN len(list_distinct(regexp_extract_all(lower(b), '[^\s]+'))) < 3 THEN 'repetitive' WHEN NOT regexp_matches(b, '[.?!]') THEN 'no_cue' END AS reason FROM x""")
def q9_drop_noise_items(t):
    lines = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return sequence.drop_noise_items(lines, "line", 20, 3, r"[0-9|!*#$%&]+", "[.?!]").select("doc_id", F.col("i").cast("long").alias("i"), "reason")


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS actual FROM customer GROUP BY ALL), e AS (SELECT s_nationkey + s_suppkey % 2 AS k, 50 + count(*) AS expected FROM supplier GROUP BY ALL)
SELECT k, actual, expected, issue FROM (SELECT k, actual, expected, CASE WHEN actual IS NULL THEN 'missing' WHEN expected IS NULL THEN 'unexpected' WHEN abs(actual - expected) > 5 THEN 'off' END AS issue FROM a FULL JOIN e USING (k)) WHERE issue IS NOT NULL""")
def q10_check_expectations(t):
    counts = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    expected = t("supplier").groupBy(F.expr("s_nationkey + s_suppkey % 2").alias("k")).agg((50 + F.count("*")).alias("n"))
    return sequence.check_expectations(counts, expected, ["k"], 5)


@query(f"""WITH b AS (SELECT {_LINES}, CASE WHEN l_linenumber <= 1 THEN 1 ELSE 2 END AS block FROM lineitem),
m AS (SELECT *, 3 - count(*) FILTER (block = 1) OVER (PARTITION BY l_orderkey) AS need, count(*) FILTER (block = 2) OVER (PARTITION BY l_orderkey) AS spare,
  row_number() OVER (PARTITION BY l_orderkey, block ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos FROM b),
n AS (SELECT {_LINES}, block AS was, CASE WHEN block = 2 AND need > 0 AND spare > need AND pos <= need THEN 1 ELSE block END AS block FROM m)
SELECT {_LINES}, block, row_number() OVER (PARTITION BY l_orderkey, block ORDER BY was, l_linenumber, l_partkey, l_suppkey) AS item_no FROM n""")
def q11_rebalance_blocks(t):
    items = t("lineitem").selectExpr(*_LINE_COLUMNS, "CASE WHEN l_linenumber <= 1 THEN 1 ELSE 2 END AS block")
    return sequence.rebalance_blocks(items, "l_orderkey", "block", _ORDERED, 3)


@query("""WITH a AS (SELECT p_partkey, p_brand, p_type, CASE WHEN contains(p_type, 'STEEL') THEN 0 WHEN contains(p_type, 'BRASS') THEN 1 WHEN contains(p_type, 'TIN') THEN 2 ELSE 99 END AS anchor FROM part)
SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY anchor, p_partkey) AS item_no FROM a""")
def q12_anchor_sort(t):
    return sequence.anchor_sort(t("part").select("p_partkey", "p_brand", "p_type"), ["p_brand"], "p_type", ["STEEL", "BRASS", "TIN"], ["p_partkey"])
