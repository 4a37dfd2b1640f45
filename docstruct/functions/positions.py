"""All matches of patterns with their positions, which Spark has no function for, and joins of what was found to where it came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def locate_matches(rows: DataFrame, rules: list[tuple[str, str]], text: Column, keys: list[str], group: int = 0, lines: bool = False, line_text: bool = True) -> DataFrame:
    """(keys, _row, rule_no, i, pos, end, found): the leftmost non-overlapping matches of each rule (name, pattern) in the text, with 0-based positions; found is the pattern's `group` (0: all).

    A rule's matches and the texts between them are zipped and spread to rows; running sums of their lengths within the
    row and the rule are the positions, so that the work is linear in the matches. _row tells rows apart, so that null and
    repeated keys don't mix. `lines`: every line is a match of one more rule, numbered len(rules): pos is its start, i its number, found its text if `line_text`, else null.
    """
    found, body = [], F.coalesce(text, F.lit(""))
    for n, (_, pattern) in enumerate(rules):
        shape = F.lit(f"({pattern})")
        zipped = F.arrays_zip(F.regexp_extract_all(body, shape, F.lit(1)).alias("m"), F.regexp_extract_all(body, shape, F.lit(1 + group)).alias("v"), F.split(body, pattern, -1).alias("p"))
        found.append(_numbered(F.filter(zipped, lambda x: x["m"].isNotNull()), n))
    if lines:
        found.append(F.transform(F.split(body, "\n", -1), lambda x, i: F.struct(F.lit(len(rules)).alias("rule_no"), i.alias("i"), F.lit(0).cast("long").alias("gap"), (F.length(x) + 1).alias("size"), (x if line_text else F.lit(None).cast("string")).alias("found"))))
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    spread = numbered.select(*keys, "_row", F.explode(F.concat(*found)).alias("_m")).select(*keys, "_row", "_m.*")
    # by the row alone, so that what follows within rows moves nothing again
    upto = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("_row", "rule_no").orderBy("i"))
    return spread.repartition("_row").withColumn("end", upto).select(*keys, "_row", "rule_no", "i", (F.col("end") - F.col("size")).alias("pos"), "end", "found")


def _numbered(matches: Column, n: int) -> Column:
    return F.transform(matches, lambda x, i: F.struct(F.lit(n).alias("rule_no"), i.alias("i"), F.length(x["p"]).cast("long").alias("gap"), F.length(x["m"]).alias("size"), x["v"].alias("found")))


def of_rule(rule_no: Column, values: list) -> Column:
    """The value of a rule by its number."""
    return F.element_at(F.array(*map(F.lit, values)), rule_no + 1)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join in which null keys meet each other; the keys are those of the left side."""
    own = right.select(*(F.col(k).alias(f"_right{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_right{i}")) for i, k in enumerate(keys)]
    condition = same[0]
    for one in same[1:]:
        condition = condition & one
    return left.join(own, condition, how).drop(*(f"_right{i}" for i in range(len(keys))))
