"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docstruct.llm.scratch import stage
from docstruct.llm.textbatch import Carried, column

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one bucket of the hash order, if one source had all; a larger table has more buckets.
BUCKET_ROWS = 20_000
SOURCE = ["_null", "_source"]


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(column(text), F.lit(WORD)), F.lit(0)).cast("long")


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Weights that repeat along the sources in code-point order, null last. Its one window runs over a row for each source."""
    at = F.row_number().over(Window.orderBy(*SOURCE)) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), (F.pmod(at, F.lit(len(cycle))) + 1).cast("int")))


def water_fill(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Add target to sources (source_size, weight): `share` of all sizes dealt by weight, each at most `most` times its size.

    Sources above their limit are clamped and their excess is dealt by weight to the others, until none is above. Each
    round sends two sums to the driver; the level only rises, so that there are at most as many rounds as sources.
    """
    limit = F.col("source_size") * F.lit(float(most))
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    total, clamped, left = float(total or 0) * share, 0.0, weights or 0
    while left:
        level = (total - clamped) / left
        above = F.col("weight") * F.lit(level) > limit
        clamped, now = sources.agg(F.sum(F.when(above, limit).otherwise(0.0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if now == left:
            return sources.withColumn("target", F.least(limit, F.col("weight") * F.lit(level)))
        left = now
    return sources.withColumn("target", limit)


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", share: float = 1.5, most: float = 2.0, cycle: tuple[int, ...] = (3, 1, 2), seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """How many words the mix takes of each document.

    Adds size, source_size, target and taken to the columns `keep` of docs (None: all). A source's whole repetitions take
    every document; for the fractional one its documents are ordered by a seeded hash of the key and taken until the
    target is met, the last in part, so that the words taken are the target rounded to a whole number.

    Only the hash at which a source's target is met is looked for: sums by bucket of the hash name its bucket, sums by hash
    within that bucket name the hash. The rows of one key share its hash, and are looked through in the same way by a hash
    of their row's number. Rows then compare with the place found, so that no text, no group of equal keys and no hot source
    is ever sorted or gathered, and the last row is taken in part, so that the words taken are the target to a word.

    Null texts have size 0, a null source is a source of its own, null keys hash like an empty string, repeated rows are
    documents of their own, told apart by their place in the table; columns named like a result are replaced, whatever their case. An empty table gives an empty
    result.
    """
    added = ("size", "source_size", "target", "taken")
    own = Carried(docs, keep, added)
    order = F.md5(F.concat(F.coalesce(column(key).cast("string"), F.lit("")), F.lit(f":{seed}")))
    sized = docs.select(*own.into(), column(source).isNull().alias("_null"), F.coalesce(column(source).cast("string"), F.lit("")).alias("_source"), word_count(text).alias("size"), order.alias("_order"), F.xxhash64(F.monotonically_increasing_id()).alias("_tie"))
    narrow = stage(sized if text not in own.names else sized.select(*SOURCE, "size", "_order", "_tie"), "sizes")
    many = max(1, -(-narrow.count() // BUCKET_ROWS))
    bucket = F.expr(f"bigint(conv(substring(_order, 1, 8), 16, 10)) * {many} div 4294967296").alias("_bucket")
    buckets = stage(narrow.groupBy(*SOURCE, bucket).agg(F.sum("size").alias("_words")), "buckets")
    sources = stage(buckets.groupBy(*SOURCE).agg(F.sum("_words").alias("source_size")), "sources")
    targets = water_fill(stage(cyclic_weights(sources, cycle), "weights"), share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("_whole", whole).withColumn("_part", F.floor(F.col("target") - F.col("_whole") * F.col("source_size") + 0.5).cast("long"))
    targets = stage(targets.select(*SOURCE, "source_size", "target", "_whole", "_part"), "targets")

    def meets(sums: DataFrame, by: str, wanted: DataFrame, left: str) -> DataFrame:
        """The first value of `by` in each source with whose words the sum passes `left`, and what is left there."""
        ran = sums.withColumn("_upto", F.sum("_words").over(Window.partitionBy(*SOURCE).orderBy(by)))
        hit = ran.join(wanted, SOURCE).where((F.col("_upto") > F.col(left)) & (F.col("_upto") - F.col("_words") <= F.col(left)))
        return hit.select(*SOURCE, by, (F.col(left) - F.col("_upto") + F.col("_words")).alias("_left"))

    in_bucket = stage(meets(buckets, "_bucket", targets.select(*SOURCE, "_part"), "_part"), "in_bucket")
    near = narrow.select(*SOURCE, "size", "_order", bucket).join(in_bucket.select(*SOURCE, "_bucket"), [*SOURCE, "_bucket"])
    hashes = stage(near.groupBy(*SOURCE, "_order").agg(F.sum("size").alias("_words")), "hashes")
    in_key = stage(meets(hashes, "_order", in_bucket.select(*SOURCE, "_left"), "_left").select(*SOURCE, "_order", "_left"), "in_key")
    # the rows of that key, by a part of their numbers' hashes and then by the hash
    group = F.pmod("_tie", F.lit(many)).alias("_group")
    rows = stage(narrow.join(in_key.drop("_left"), [*SOURCE, "_order"]).groupBy(*SOURCE, "_order", group, "_tie").agg(F.sum("size").alias("_words")), "rows")
    groups = stage(rows.groupBy(*SOURCE, "_group").agg(F.sum("_words").alias("_words")), "groups")
    in_group = stage(meets(groups, "_group", in_key.select(*SOURCE, "_left"), "_left").select(*SOURCE, "_group", "_left"), "in_group")
    last = meets(rows.join(in_group.drop("_left"), [*SOURCE, "_group"]), "_tie", in_group.select(*SOURCE, "_left"), "_left")
    last = last.select(*SOURCE, F.col("_tie").alias("_tie_at"), F.col("_left").alias("_rest"))
    at = in_key.join(in_group.select(*SOURCE, F.col("_group").alias("_group_at")), SOURCE).join(last, SOURCE).select(*SOURCE, F.col("_order").alias("_at"), "_group_at", "_tie_at", "_rest")
    plan = stage(targets.join(at, SOURCE, "left"), "plan")
    place = f"struct(_order, pmod(_tie, {many}) AS g, _tie)"
    partly = F.expr(f"CASE WHEN _at IS NULL THEN IF(_part > 0, size, 0) WHEN {place} < struct(_at AS _order, _group_at AS g, _tie_at AS _tie) THEN size WHEN {place} > struct(_at AS _order, _group_at AS g, _tie_at AS _tie) THEN 0 ELSE _rest END")
    joined = (sized if text in own.names else narrow).join(plan, SOURCE)
    return joined.select(*own.back(), "size", "source_size", "target", (F.col("_whole") * F.col("size") + partly).cast("long").alias("taken"))


def repeat(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The rows of mix() as often as they are taken: whole texts, and for a rest the first words that make it up, joined by blanks. Rows of which nothing is taken go."""
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = (F.col("taken") - copies * F.col("size")).cast("int")
    counted = mixed.withColumn("_copy", F.explode(F.expr("sequence(1, 1 + int(floor(taken / greatest(size, 1))))"))).withColumn("_rest", rest)
    part = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.greatest(F.col("_rest"), F.lit(1))), " ")
    whole = F.col("_copy") <= copies
    return counted.where(whole | (F.col("_rest") > 0)).withColumn(text, F.when(whole, F.col(text)).otherwise(part)).drop("_copy", "_rest")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source IS NULL AS n, coalesce(source, '') AS s,
         coalesce(length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':17') AS h, row_number() OVER () AS r
  FROM documents),
src AS (SELECT n, s, sum(size)::BIGINT AS source_size FROM sized GROUP BY n, s),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY n, s) - 1) % 3 + 1)::INT] AS weight FROM src),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap,
             row_number() OVER (ORDER BY source_size * 2.0::DOUBLE / weight, n, s) AS k FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM src)::DOUBLE * 1.5::DOUBLE
               - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
              / (sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lev FROM r),
lev AS (SELECT lev FROM l WHERE NOT (weight * lev > cap) ORDER BY k LIMIT 1),
t AS (SELECT n, s, source_size, least(cap, weight * (SELECT lev FROM lev)) AS target FROM r),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
q AS (SELECT *, floor(target - whole * source_size + 0.5)::BIGINT AS part FROM p),
c AS (SELECT *, sum(size) OVER (PARTITION BY n, s ORDER BY h, r ROWS UNBOUNDED PRECEDING) - size AS before FROM sized)
SELECT c.doc_id, c.size, q.source_size, q.target,
       (q.whole * c.size + greatest(0, least(c.size, q.part - before)))::BIGINT AS taken
FROM c JOIN q USING (n, s)
"""
