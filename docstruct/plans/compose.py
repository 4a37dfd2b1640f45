"""How users extend the library: rule packs chosen by data, and chains of their own stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def resolve_rule_pack(docs: DataFrame, packs: DataFrame, school: str, keys: list[str]) -> DataFrame:
    """(keys, pack, kind, rule, rule_order): the rules of the pack of each document's school, else of the pack for '*'.

    Packs are rows (pack, school, priority, kind, rule, rule_order). The pack of highest priority wins, the first name on
    a tie. It is chosen by school, before documents are met, so a school with a third of them costs nothing more.
    """
    names = packs.groupBy("school", "pack").agg(F.max("priority").alias("priority"))
    best = names.withColumn("_r", F.row_number().over(Window.partitionBy("school").orderBy(F.desc("priority"), "pack"))).where("_r = 1").select("school", "pack")
    asked = docs.select(F.col(school).alias("_school")).distinct()
    own = best.where("school <> '*'").withColumnRenamed("school", "_school")
    other = best.where("school = '*'").agg(F.first("pack").alias("_other"))  # one row, null without such a pack
    chosen = asked.join(own, "_school", "left").crossJoin(other).select("_school", F.coalesce("pack", "_other").alias("pack"))
    rules = chosen.join(packs.select("pack", "kind", "rule", "rule_order").distinct(), "pack")
    return docs.join(rules, F.col(school).eqNullSafe(F.col("_school"))).select(*keys, "pack", "kind", "rule", "rule_order")


def pipeline(stages: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> Callable[[DataFrame], DataFrame]:
    """The stages (name, function) in order as one lazy plan; a stage that fails to plan is named in the error."""

    def run(rows: DataFrame) -> DataFrame:
        for name, stage in stages:
            try:
                rows = rows.transform(stage)
            except Exception as error:
                raise RuntimeError(f"stage {name!r} failed: {error}") from error
        return rows

    return run
