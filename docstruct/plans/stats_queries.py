"""Bindings of the aggregation family to the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docstruct.operators import stats
from docstruct.plans.registry import query

_PCT = "round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY {}), 1)"


@query(f"""SELECT l_linestatus, l_returnflag AS label, n, {_PCT.format('l_linestatus')} AS pct
FROM (SELECT l_linestatus, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL)""")
def a1_distribution(t):
    return stats.distribution(t("lineitem"), "l_returnflag", ["l_linestatus"])


_TOKENS = r"list_distinct(regexp_extract_all(lower(text), '[a-z]+'))"


@query(f"""WITH m AS (SELECT lang, unnest({_TOKENS}) AS label FROM documents), c AS (SELECT lang, label, count(*) AS n FROM m GROUP BY ALL),
d AS (SELECT lang, count(*) AS total FROM documents GROUP BY lang)
SELECT lang, label, n, round(n * 100.0::DOUBLE / total, 1) AS pct FROM c JOIN d USING (lang)""")
def a2_distribution_multi(t):
    docs = t("documents").select("lang", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("words"))
    return stats.distribution_multi(docs, "words", ["lang"])


@query(f"""WITH m AS (SELECT lang, unnest({_TOKENS}) AS label FROM documents), c AS (SELECT lang, label, count(*) AS n FROM m GROUP BY ALL)
SELECT lang, label, n, {_PCT.format('lang')} AS pct FROM c""")
def a2_distribution_mentions(t):
    docs = t("documents").select("lang", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("words"))
    return stats.distribution_multi(docs, "words", ["lang"], "mentions")


@query("""SELECT quality, n, n_toxic, n_clean, round(n_toxic * 100.0::DOUBLE / n, 1) AS pct_toxic, round(n_clean * 100.0::DOUBLE / n, 1) AS pct_clean
FROM (SELECT quality, count(*) AS n, count(*) FILTER (toxic = 1) AS n_toxic, count(*) FILTER (toxic = 0) AS n_clean FROM labels GROUP BY quality)""")
def a3_flag_shares(t):
    return stats.flag_shares(t("labels"), {"toxic": F.col("toxic") == 1, "clean": F.col("toxic") == 0}, ["quality"])


@query("""WITH g AS (SELECT DISTINCT o_custkey FROM orders), d AS (SELECT DISTINCT o_orderpriority AS label FROM orders),
c AS (SELECT o_custkey, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, label, coalesce(n, 0) AS n FROM g CROSS JOIN d LEFT JOIN c USING (o_custkey, label)""")
def a4_zero_filled_counts(t):
    orders = t("orders")
    return stats.zero_filled_counts(orders, "o_orderpriority", ["o_custkey"], orders.select(F.col("o_orderpriority").alias("label")))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) FILTER (l_returnflag = 'A') AS n_a, count(*) FILTER (l_returnflag = 'N') AS n_n,
count(*) FILTER (l_returnflag = 'R') AS n_r, count(*) FILTER (l_suppkey % 6 = 4) AS options_4, count(*) FILTER (l_suppkey % 6 = 5) AS options_5, count(*) FILTER (l_suppkey % 6 < 4) AS options_other,
count(*) FILTER (l_partkey % 3 = 0) AS extract_one, count(*) FILTER (l_partkey % 3 = 1) AS extract_two, sum(l_quantity) AS chars, count(*) FILTER (l_discount > 0.05) AS with_limit, count(*) FILTER (NOT l_discount > 0.05) AS without_limit
FROM lineitem GROUP BY ROLLUP (l_orderkey, l_linenumber) HAVING grouping_id(l_orderkey, l_linenumber) < 3""")
def a5_section_metrics(t):
    extracts = {"one": F.col("l_partkey") % 3 == 0, "two": F.col("l_partkey") % 3 == 1}
    return stats.section_metrics(t("lineitem"), "l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity"), F.col("l_discount") > 0.05, ["A", "N", "R"], F.col("l_suppkey") % 6, (4, 5), extracts)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS s FROM lineitem)
SELECT l_orderkey, count(*) AS n_items, """ + ", ".join(f"max(CASE WHEN s = {i} THEN l_partkey END) AS part_{i}, max(CASE WHEN s = {i} THEN l_quantity END) AS quantity_{i}" for i in (1, 2, 3)) + " FROM r GROUP BY l_orderkey")
def a6_wide_registry_row(t):
    return stats.wide_registry_row(t("lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], {"part": "l_partkey", "quantity": "l_quantity"}, 3)


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS s FROM lineitem)
SELECT l_orderkey, count(*) AS n_items, """ + ", ".join(f"max(CASE WHEN s = {i} AND l_returnflag = '{k}' THEN l_partkey END) AS part_{k.lower()}_{i}" for k in "ANR" for i in (1, 2)) + " FROM r GROUP BY l_orderkey")
def a6_wide_registry_row_by_kind(t):
    return stats.wide_registry_row(t("lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], {"part": "l_partkey"}, 2, "l_returnflag", ("A", "N", "R"))


_MAPPING = [("1-URGENT", "urgent", 1), ("2-HIGH", "urgent", 1), ("3-MEDIUM", "normal", 2), ("3-MEDIUM", "low", 2)]


@query("""WITH m(kind, c, parts) AS (VALUES """ + ", ".join(map(str, _MAPPING)) + """), n AS (SELECT o_custkey, o_orderpriority AS kind, count(*) AS n FROM orders GROUP BY ALL),
p AS (SELECT o_custkey, coalesce(c, 'other') AS c, n // coalesce(parts, 1) AS n FROM n LEFT JOIN m USING (kind))
SELECT o_custkey, """ + ", ".join(f"coalesce(sum(n) FILTER (c = '{c}'), 0)::BIGINT AS {c}" for c in ("urgent", "normal", "low", "other")) + " FROM p GROUP BY o_custkey")
def a7_type_pivot(t):
    orders = t("orders")
    mapping = orders.sparkSession.createDataFrame(_MAPPING, "kind string, column string, parts int")
    return stats.type_pivot(orders, ["o_custkey"], "o_orderpriority", mapping, ["urgent", "normal", "low"])


@query("""SELECT o_custkey, count(*) AS n_rows, min(year(o_orderdate)) AS first_year, max(year(o_orderdate)) AS last_year, round(avg(year(o_orderdate)), 2) AS mean_year
FROM orders GROUP BY o_custkey""")
def a8_group_summary(t):
    return stats.group_summary(t("orders"), ["o_custkey"], F.year("o_orderdate").cast("long"), {"mean_year": F.year("o_orderdate")})


@query("""WITH s AS (SELECT p_partkey, 0 AS a, p_brand AS value FROM part UNION ALL SELECT p_partkey, 1, p_type FROM part),
g AS (SELECT value, count(*) AS n, min(p_partkey * 2 + a) AS f FROM s WHERE value IS NOT NULL GROUP BY value)
SELECT row_number() OVER (ORDER BY n DESC, f, value) AS rank, value, n FROM g ORDER BY n DESC, f, value LIMIT 25""")
def a9_top_values(t):
    return stats.top_values(t("part"), ["p_brand", "p_type"], "p_partkey", 25)


@query("""WITH n AS (SELECT c_custkey, 'MOVED' AS c_name, c_nationkey, c_custkey % 7 AS touched FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT c_custkey + 10000000, 'ADDED', c_nationkey, c_custkey % 7 FROM customer WHERE c_custkey % 5 = 0)
SELECT c_custkey, c_name, c_nationkey, NULL AS touched FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL SELECT * FROM n""")
def a10_upsert(t):
    base = t("customer").select("c_custkey", "c_name", "c_nationkey")
    touched = (F.col("c_custkey") % 7).alias("touched")
    new = base.where("c_custkey % 3 = 0").select("c_custkey", F.lit("MOVED").alias("c_name"), "c_nationkey", touched)
    added = base.where("c_custkey % 5 = 0").select((F.col("c_custkey") + 10000000).alias("c_custkey"), F.lit("ADDED").alias("c_name"), "c_nationkey", touched)
    return stats.upsert(base, new.union(added), ["c_custkey"])


@query("""SELECT coalesce(n.k, c.c_custkey) AS c_custkey, coalesce(n.v, c.c_name) AS c_name, c.c_acctbal
FROM customer c FULL JOIN (SELECT c_custkey + 1000 * (c_custkey % 2) AS k, CASE WHEN c_custkey % 4 = 0 THEN 'NEW' END AS v FROM customer WHERE c_custkey % 2 = 0) n ON n.k = c.c_custkey""")
def a10_upsert_columns(t):
    base = t("customer").select("c_custkey", "c_name", "c_acctbal")
    new = base.where("c_custkey % 2 = 0").select((F.col("c_custkey") + 1000 * (F.col("c_custkey") % 2)).alias("c_custkey"), F.expr("CASE WHEN c_custkey % 4 = 0 THEN 'NEW' END").alias("c_name"))
    return stats.upsert_columns(base, new, ["c_custkey"])


@query("""WITH r AS (SELECT c_nationkey, CASE WHEN c_custkey % 10 > 0 THEN c_name END AS name, CASE WHEN c_custkey % 6 = 0 THEN 'x' || c_custkey ELSE c_custkey::VARCHAR END AS year FROM customer),
p AS (SELECT c_nationkey, count(*) AS n_rows, count(*) FILTER (name IS NULL) AS a, count(*) FILTER (year IS NOT NULL AND try_cast(year AS INT) IS NULL) AS b FROM r GROUP BY c_nationkey)
SELECT c_nationkey, n_rows, 'missing:name' AS problem, a AS n FROM p WHERE a > 0 UNION ALL SELECT c_nationkey, n_rows, 'uncastable:year', b FROM p WHERE b > 0 UNION ALL SELECT c_nationkey, n_rows, 'absent:school', n_rows FROM p""")
def a11_validate_registry(t):
    rows = t("customer").selectExpr("c_nationkey", "CASE WHEN c_custkey % 10 > 0 THEN c_name END AS name", "CASE WHEN c_custkey % 6 = 0 THEN 'x' || c_custkey ELSE string(c_custkey) END AS year")
    return stats.validate_registry(rows, "c_nationkey", ["name", "school"], {"year": "int"})


@query("""SELECT lang, i // 10 AS bin, count(*) AS n FROM (SELECT lang, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT lang, string_split(text, chr(10)) AS ls FROM documents))
WHERE regexp_matches(line, '[0-9]') GROUP BY ALL""")
def a12_density_bins(t):
    lines = t("documents").select("lang", F.posexplode(F.split("text", "\n")).alias("i", "line")).where(F.col("line").rlike("[0-9]"))
    return stats.density_bins(lines, ["lang"], F.col("i"), 10)


@query("""WITH s AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 4 WHEN 'click' THEN 3 ELSE 1 END + CASE WHEN value > 10 THEN 2 ELSE 0 END AS score, user_id % 4 AS bin FROM events),
q(bin, k) AS (VALUES (0, 5), (1, 3), (2, 10), (3, 2000))
SELECT event_id, user_id, score, bin, rank FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY score DESC, event_id) AS rank FROM s JOIN q USING (bin) WHERE score >= 3) WHERE rank <= k""")
def a13_top_per_bin(t):
    events = t("events").selectExpr("event_id", "user_id", "CASE event_type WHEN 'error' THEN 5 WHEN 'purchase' THEN 4 WHEN 'click' THEN 3 ELSE 1 END + CASE WHEN value > 10 THEN 2 ELSE 0 END AS score")
    quota = events.sparkSession.createDataFrame([(0, 5), (1, 3), (2, 10), (3, 2000)], "bin long, k int")
    return stats.top_per_bin(events, F.col("user_id") % 4, "score", ["event_id"], quota, 3)


@query("""SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, count(*) AS n_total FROM conversations GROUP BY conv_id""")
def a14_level_counts(t):
    return stats.level_counts(t("conversations"), "conv_id", "role", ["user", "assistant"])


@query("""SELECT user_id, round(coalesce(avg(CASE WHEN event_type <> 'view' THEN value END), 0.0::DOUBLE), 4) AS confidence FROM events GROUP BY user_id""")
def a15_mean_confidence(t):
    return stats.mean_confidence(t("events"), ["user_id"], F.when(F.col("event_type") != "view", F.col("value")))


@query("""WITH c AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r FROM c)
SELECT p_brand, string_agg(p_type || ' (' || n || ')', '; ' ORDER BY r) AS themes FROM r WHERE r <= 5 GROUP BY p_brand""")
def a16_theme_listing(t):
    return stats.theme_listing(t("part"), "p_brand", "p_type", 5)


@query(f"""WITH c AS (SELECT o_orderstatus, year(o_orderdate) AS y, o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL),
p AS (SELECT *, {_PCT.format('o_orderstatus, y')} AS pct FROM c)
SELECT o_orderstatus, y, label, n, pct, round(pct - lag(pct) OVER (PARTITION BY o_orderstatus, label ORDER BY y), 1) AS change FROM p""")
def a17_label_trend(t):
    return stats.label_trend(t("orders").withColumn("y", F.year("o_orderdate").cast("long")), ["o_orderstatus"], "y", "o_orderpriority")
