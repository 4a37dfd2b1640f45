"""What came in: outcomes of attempts, the latest of each group, and terms harvested from pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docstruct.functions.fold import Fold, fold_sorted


def ingest_summary(attempts: DataFrame, by: list[str], succeeded: Column, duration: str) -> DataFrame:
    """(by, total, success, failed, rate, mean_duration); a null outcome has failed, durations that are not known don't count."""
    ok = F.coalesce(succeeded, F.lit(False))
    own = attempts.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"), F.round(F.avg(duration), 4).alias("mean_duration"))
    return own.withColumn("rate", F.round(F.try_divide(F.col("success") * F.lit(100.0), F.col("total")), 1))


def latest_per_group(rows: DataFrame, group: list[str], newest: list[str], k: int, total_k: int | None = None, same: list[str] | None = None) -> DataFrame:
    """S3: the k newest rows of each group (by the columns `newest`, larger first) with their rank, at most total_k of all; of rows that agree in `same` only the newest counts."""
    order = [F.desc(c) for c in newest]
    if same:
        first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*same).orderBy(*order)))
        rows = first.where("_r = 1").drop("_r")
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)
    return best if total_k is None else best.orderBy(*order).limit(total_k)


class OpenTags(Fold):
    """Of a page's tags in order, each with the text behind it, the texts of the wanted ones that close.

    A stack for each kind holds what is open, so that a list within a list ends at its own end; a text that is too long is
    no longer gathered, so that a page's state is bounded by its depth. An end without a start closes nothing, a start
    without an end gives nothing.
    """

    def __init__(self, tags: tuple[str, ...], most: int):
        self.most, self.open = most, {t: [] for t in tags}

    def step(self, i, tag, closing, text):
        if tag in self.open:
            if not closing:
                self.open[tag].append("")
            elif self.open[tag]:
                found = self.open[tag].pop()
                if found is not None:
                    yield (found.strip(" "),)
        if text:
            for spans in self.open.values():
                for k, own in enumerate(spans):
                    if own is not None:
                        own = (own + text).lstrip(" ")
                        spans[k] = None if len(own.rstrip(" ")) > self.most else own


def harvest_terms(pages: DataFrame, html: str, tags: tuple[str, ...] = ("h1", "h2", "h3", "li", "td", "th", "a"), least: int = 2, most: int = 30, stop: list[str] = ()) -> DataFrame:
    """(term, n) of the texts of these tags, with the text of tags inside them, of `least` to `most` characters and no stop words (lower case).

    Tags become rows in order, and one pass over a page's rows keeps a stack of open ones, so that an element within one of
    its own kind gives both texts, the inner and the whole. Null pages have no tags.
    """
    piece = "<[/!?A-Za-z][^>]*+>[^<]*+(?:<(?![/!?A-Za-z])[^<]*+)*+"  # a tag and the text up to the next one
    numbered = pages.withColumn("_row", F.monotonically_increasing_id())
    found = numbered.select("_row", F.posexplode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(f"({piece})"), F.lit(1))).alias("i", "_m"))
    tag = F.regexp_extract("_m", r"^</?([A-Za-z][A-Za-z0-9]*)\b", 1)
    rows = found.select("_row", "i", tag.alias("tag"), F.startswith("_m", F.lit("</")).alias("closing"), F.regexp_replace("_m", "^<[^>]*>", "").alias("text"))
    terms = fold_sorted(rows, ["_row"], ["i", "tag", "closing", "text"], "term string", lambda: OpenTags(tags, most))
    kept = terms.where(F.length("term").between(least, most) & ~F.lower("term").isin(list(stop)))
    return kept.groupBy("term").agg(F.count("*").alias("n"))
