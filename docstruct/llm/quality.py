"""Quality rules with adaptive thresholds from mergeable quantile sketches. DataFrame operations only.

A sketch is a log-linear histogram: a value's bucket keeps its six leading bits, so that a quantile is right to 1/32 of
itself. Buckets hold counts; sketches of (language, source) merge into those of a language and of all by adding them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docstruct.llm.scratch import stage
from docstruct.llm.textbatch import Carried, column

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Index bits of a packed (hash, index); the hash keeps the rest and only proposes repeats, which are compared as text.
INDEX_BITS = 30


@dataclass(frozen=True)
class Rule:
    """A metric fails beyond quartile + width * max(quartile range, least range); sides: 1 above, -1 below."""

    metric: str
    value: str
    sides: tuple[int, ...]
    width: int
    least: int


#: Metrics are whole numbers: parts of 10,000, and hundredths of a character.
RULES = (
    Rule("symbols", "10000 * n_symbols div greatest(word_chars, 1)", (1,), 4, 125),
    Rule("dup_lines", "10000 * n_dup_lines div greatest(n_lines, 1)", (1,), 4, 750),
    Rule("repeats", "10000 * n_repeat_words div greatest(n_words, 1)", (1,), 4, 500),
    Rule("word_length", "100 * word_chars div greatest(n_words, 1)", (1, -1), 4, 50),
)
#: A sketch of fewer documents gives way to that of its language, then to that of all.
MIN_DOCS = 100


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long) to docs; null texts count as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumns({"_words": F.regexp_extract_all(body, F.lit(f"({WORD})"), F.lit(1)), "_lines": F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD)), "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long")})
    grams = f"""CASE WHEN size(_words) >= 4 THEN sort_array(transform(sequence(0, size(_words) - 3), i ->
        shiftleft(xxhash64(_words[i], _words[i + 1], _words[i + 2]), {INDEX_BITS}) + i)) END"""
    out = out.withColumns({"_grams": F.expr(grams), "n_words": F.size("_words").cast("long"), "word_chars": F.length(F.array_join("_words", "")).cast("long"), "n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")})
    alike = f"""transform(filter(sequence(0, size(_grams) - 1), j ->
        (j > 0 AND shiftright(_grams[greatest(j - 1, 0)], {INDEX_BITS}) = shiftright(_grams[j], {INDEX_BITS}))
        OR (j < size(_grams) - 1 AND shiftright(_grams[least(j + 1, size(_grams) - 1)], {INDEX_BITS}) = shiftright(_grams[j], {INDEX_BITS}))),
        j -> int(_grams[j] & {(1 << INDEX_BITS) - 1}))"""
    out = out.withColumn("_alike", F.expr(f"CASE WHEN _grams IS NOT NULL THEN {alike} END"))
    out = out.withColumn("_texts", F.expr("CASE WHEN size(_alike) > 1 THEN sort_array(transform(_alike, p -> struct(concat_ws(' ', _words[p], _words[p + 1], _words[p + 2]) AS g, p AS p))) END"))
    repeats = """CASE WHEN _texts IS NULL THEN 0 ELSE size(array_distinct(flatten(transform(filter(sequence(0, size(_texts) - 1), j ->
        (j > 0 AND _texts[greatest(j - 1, 0)].g = _texts[j].g) OR (j < size(_texts) - 1 AND _texts[least(j + 1, size(_texts) - 1)].g = _texts[j].g)),
        j -> sequence(_texts[j].p, _texts[j].p + 2))))) END"""
    return out.withColumn("n_repeat_words", F.expr(repeats).cast("long")).drop("_words", "_lines", "_grams", "_alike", "_texts")


def bucket(value: Column) -> Column:
    """Of a whole number of at least 0."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return (shift * 64 + F.call_function("shiftrightunsigned", value, shift)).cast("int")


def bucket_floor(b: Column) -> Column:
    """Least value of a bucket."""
    return F.call_function("shiftleft", F.pmod(b, F.lit(64)).cast("long"), (b / 64).cast("int"))


def sketches(measured: DataFrame, by: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(by, metric, bucket, n) of the rows of measured."""
    values = F.explode(F.array(*(F.struct(F.lit(r.metric).alias("metric"), bucket(F.expr(r.value).cast("long")).alias("bucket")) for r in rules)))
    return measured.select(*by, values.alias("_v")).groupBy(*by, "_v.metric", "_v.bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    """(by, metric, docs, one column for each name of at): the least bucket whose running count reaches that share."""
    group = Window.partitionBy(*by, "metric")
    ran = sketch.withColumns({"_run": F.sum("n").over(group.orderBy("bucket")), "_all": F.sum("n").over(group)})
    picks = [F.min(F.when(F.col("_run") >= F.ceil(F.col("_all") * F.lit(p)), F.col("bucket"))).alias(name) for name, p in at.items()]
    found = ran.groupBy(*by, "metric").agg(F.max("_all").alias("docs"), *picks)
    return found.withColumns({name: bucket_floor(F.col(name)) for name in at})


def thresholds(measured: DataFrame, by: list[str], rules: tuple[Rule, ...] = RULES, min_docs: int = MIN_DOCS) -> DataFrame:
    """A row for each value of `by` (never null there) with <metric>_hi and <metric>_lo, null where a rule has no such side."""
    fine = stage(sketches(measured, by, rules), "sketches")
    at = {"q1": 0.25, "q3": 0.75}
    levels = []
    for depth in range(len(by), -1, -1):
        merged = fine.groupBy(*by[:depth], "metric", "bucket").agg(F.sum("n").alias("n"))
        levels.append(quantiles(merged, by[:depth], at).select(*by[:depth], "metric", *(F.col(c).alias(f"{c}_{depth}") for c in ("docs", *at))))
    rows = levels[0]
    for depth, level in zip(range(len(by) - 1, -1, -1), levels[1:]):
        rows = rows.join(level, [*by[:depth], "metric"])
    depth = F.expr("CASE " + " ".join(f"WHEN docs_{d} >= {min_docs} THEN {d}" for d in range(len(by), 0, -1)) + " ELSE 0 END")
    pick = lambda c: F.expr(f"CASE {depth_name} " + " ".join(f"WHEN {d} THEN {c}_{d}" for d in range(len(by) + 1)) + " END")
    depth_name = "_depth"
    rows = rows.withColumn("_depth", depth).select(*by, "metric", pick("q1").alias("q1"), pick("q3").alias("q3"))
    columns = []
    for r in rules:
        reach = F.greatest(F.col("q3") - F.col("q1"), F.lit(r.least)) * r.width
        mine = F.col("metric") == r.metric
        columns += [F.max(F.when(mine, F.col("q3") + reach)).alias(f"{r.metric}_hi")] if 1 in r.sides else []
        columns += [F.max(F.when(mine, F.col("q1") - reach)).alias(f"{r.metric}_lo")] if -1 in r.sides else []
    return rows.groupBy(*by).agg(*columns)


def judge(docs: DataFrame, text: str = "text", by: tuple[str, ...] = ("lang", "source"), keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES, min_docs: int = MIN_DOCS) -> DataFrame:
    """Add the measures, base_failed, failed_rules (array of metric names) and kept to the columns `keep` of docs (None: all).

    base_failed: fewer than 50 words, or over half of them in repeated windows. Documents that pass feed the sketches of
    their language and source (null is a value of its own); each is held against the thresholds of its group. Null texts
    have no words and fail; columns named like a result are replaced, whatever their case. Empty tables give empty
    results; repeated rows count each.
    """
    added = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "failed_rules", "kept"]
    own = Carried(docs, keep, added)
    groups = [f"_by{i}" for i in range(len(by))]
    keyed = docs.select(*own.into(), column(text).alias("_text"), *(F.coalesce(F.concat(F.lit("="), column(c).cast("string")), F.lit("")).alias(g) for c, g in zip(by, groups)))
    measured = measure(keyed, "_text").drop("_text").withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    measured = stage(measured, "measures")
    limits = stage(thresholds(measured.where("NOT base_failed"), groups, rules, min_docs), "thresholds")
    fails = [F.when(F.expr(" OR ".join([f"({r.value}) > {r.metric}_hi"] * (1 in r.sides) + [f"({r.value}) < {r.metric}_lo"] * (-1 in r.sides))), F.lit(r.metric)) for r in rules]
    joined = measured.join(limits, groups, "left").withColumn("failed_rules", F.filter(F.array(*fails), lambda x: x.isNotNull()))
    return joined.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).select(*own.back(), *added)


def _oracle() -> str:
    values = {"symbols": "10000 * n_symbols // greatest(word_chars, 1)", "dup_lines": "10000 * n_dup_lines // greatest(n_lines, 1)", "repeats": "10000 * n_repeat_words // greatest(n_words, 1)", "word_length": "100 * word_chars // greatest(n_words, 1)"}
    struct = ", ".join(f"{{'metric': '{r.metric}', 'v': ({values[r.metric]})::BIGINT}}" for r in RULES)
    reach = "CASE metric " + " ".join(f"WHEN '{r.metric}' THEN greatest(q3 - q1, {r.least}) * {r.width}" for r in RULES) + " END"
    low = "CASE WHEN metric IN (" + ", ".join(f"'{r.metric}'" for r in RULES if -1 in r.sides) + ") THEN q1 - reach END"
    level = lambda cols: f"""SELECT {cols + ',' if cols else ''} metric, max(a) AS docs, min(CASE WHEN run >= ceil(a * 0.25::DOUBLE) THEN f END) AS q1, min(CASE WHEN run >= ceil(a * 0.75::DOUBLE) THEN f END) AS q3
      FROM (SELECT *, sum(n) OVER (PARTITION BY {cols + ',' if cols else ''} metric ORDER BY b)::BIGINT AS run, sum(n) OVER (PARTITION BY {cols + ',' if cols else ''} metric)::BIGINT AS a
            FROM (SELECT {cols + ',' if cols else ''} metric, b, f, count(*) AS n FROM vals GROUP BY ALL)) GROUP BY {cols + ',' if cols else ''} metric"""  # noqa: E731
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '') AS l, coalesce('=' || source, '') AS s, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT id, i FROM g QUALIFY count(*) OVER (PARTITION BY id, g) > 1),
cov AS (SELECT id, count(DISTINCT i + k) AS c FROM rep, (VALUES (0), (1), (2)) o(k) GROUP BY id),
m AS (SELECT w.id, doc_id, l, s, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov USING (id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, unnest([{struct}], recursive := true) FROM m),
e AS (SELECT *, greatest(length(bin(v)) - 6, 0) AS e FROM b),
vals AS (SELECT *, e * 64 + (v >> e) AS b, (v >> e) << e AS f FROM e WHERE NOT base_failed),
q2 AS ({level("l, s")}), q1 AS ({level("l")}), q0 AS ({level("")}),
th AS (SELECT q2.l, q2.s, metric,
         CASE WHEN q2.docs >= {MIN_DOCS} THEN q2.q1 WHEN q1.docs >= {MIN_DOCS} THEN q1.q1 ELSE q0.q1 END AS q1,
         CASE WHEN q2.docs >= {MIN_DOCS} THEN q2.q3 WHEN q1.docs >= {MIN_DOCS} THEN q1.q3 ELSE q0.q3 END AS q3
       FROM q2 JOIN q1 USING (l, metric) JOIN q0 USING (metric)),
lim AS (SELECT *, {low} AS lo FROM (SELECT *, {reach} AS reach FROM th)),
bad AS (SELECT e.id, bool_or(coalesce(v > q3 + reach, false) OR coalesce(v < lo, false)) AS bad FROM e LEFT JOIN lim USING (l, s, metric) GROUP BY e.id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT bad AS kept
FROM m JOIN bad USING (id)
"""


ORACLE_SQL = _oracle()
