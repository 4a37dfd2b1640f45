"""Text reports, one row for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def render_reports(rows: DataFrame, keys: list[str], title: Column, dimensions: list[str], detail: Column, order: list[str]) -> DataFrame:
    """(keys, report): title, number of rows, the distribution of each dimension (most frequent first, then by label) and the detail lines in order.

    Details are a row's line each and gather in one report text, so keys should name documents, not whole corpora.
    """
    base = rows.select(*keys, title.alias("_title"), detail.alias("_line"), *order, *(F.coalesce(F.col(d).cast("string"), F.lit("-")).alias(f"_d{i}") for i, d in enumerate(dimensions)))
    listed = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col("_line").alias("_text")))), lambda x: x["_text"])
    body = base.groupBy(*keys).agg(F.min("_title").alias("_title"), F.count("*").alias("_n"), F.array_join(listed, "\n").alias("_details"))
    labels = F.array(*(F.struct(F.lit(i).alias("dimension"), F.col(f"_d{i}").alias("label")) for i in range(len(dimensions))))
    counts = base.select(*keys, F.explode(labels).alias("_x")).groupBy(*keys, "_x").agg(F.count("*").alias("n"))
    entry = F.struct(F.col("_x.dimension").alias("dimension"), (-F.col("n")).alias("minus"), F.col("_x.label").alias("label"))
    sections = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_s"))
    joined = body.join(sections, keys)

    def section(i: int, name: str) -> Column:
        lines = F.transform(F.filter("_s", lambda s: s["dimension"] == i), lambda s: F.format_string("%s: %d (%.1f%%)", s["label"], -s["minus"], F.round(-100.0 * s["minus"] / F.col("_n"), 1)))
        return F.concat(F.lit(f"[{name}]\n"), F.array_join(lines, "\n"))

    parts = [F.col("_title"), F.concat(F.lit("rows: "), F.col("_n").cast("string")), *(section(i, d) for i, d in enumerate(dimensions)), F.concat(F.lit("[details]\n"), F.col("_details"))]
    return joined.select(*keys, F.concat_ws("\n", *parts).alias("report"))
