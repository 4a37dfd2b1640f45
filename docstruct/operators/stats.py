"""Aggregations, pivots and the registry. Percentages are rounded half up to one decimal; nulls are a label of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def share(part: Column, whole: Column) -> Column:
    """Percentage to one decimal, null if there is nothing to share."""
    return F.round(F.try_divide(part * F.lit(100.0), whole), 1)


def distribution(rows: DataFrame, dim: str, by: list[str]) -> DataFrame:
    """A1: (by, label, n, pct) of each label within its group. Only the counted labels of a group meet in its window."""
    counts = rows.groupBy(*by, F.col(dim).alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", share(F.col("n"), F.sum("n").over(Window.partitionBy(*by))))


def distribution_multi(rows: DataFrame, array_dim: str, by: list[str], denominator: str = "rows") -> DataFrame:
    """A2: as A1 over an array column; pct is of the group's rows, or of its mentions."""
    mentions = rows.select(*by, F.explode(array_dim).alias("label")).groupBy(*by, "label").agg(F.count("*").alias("n"))
    if denominator == "mentions":
        return mentions.withColumn("pct", share(F.col("n"), F.sum("n").over(Window.partitionBy(*by))))
    totals = rows.groupBy(*by).agg(F.count("*").alias("_total"))
    return mentions.join(totals, by).withColumn("pct", share(F.col("n"), F.col("_total"))).drop("_total")


def flag_shares(rows: DataFrame, flags: dict[str, Column], by: list[str]) -> DataFrame:
    """A3: n rows, and for each flag its count and percentage. A null flag is not set."""
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.count_if(F.coalesce(c, F.lit(False))).alias(f"n_{k}") for k, c in flags.items()))
    return out.withColumns({f"pct_{k}": share(F.col(f"n_{k}"), F.col("n")) for k in flags})


def zero_filled_counts(rows: DataFrame, dim: str, by: list[str], domain: DataFrame) -> DataFrame:
    """A4: (by, label, n) for every group and every value of domain (column label), 0 included. The grid is as large as the result; a small domain is broadcast by its size."""
    labels = domain.select("label").distinct()
    counts = rows.groupBy(*by, F.col(dim).alias("label")).agg(F.count("*").alias("n"))
    grid = rows.select(*by).distinct().join(labels.withColumn("_any", F.lit(1)), F.lit(1) == F.col("_any")).drop("_any")
    right = counts.select(*(F.col(c).alias(f"_{c}") for c in [*by, "label"]), "n")
    same = [grid[c].eqNullSafe(right[f"_{c}"]) for c in [*by, "label"]]
    return grid.join(right, same, "left").select(*by, "label", F.coalesce("n", F.lit(0)).alias("n"))


def section_metrics(items: DataFrame, doc: str, section: str, kind: str, chars: Column, limited: Column, kinds: list[str], options: Column | None = None, option_counts: tuple[int, ...] = (), extracts: dict[str, Column] | None = None) -> DataFrame:
    """A5: per section and, with a null section, per document: items, each kind's count, characters, items with and without a limit.

    options: an item's number of options, of which option_counts are counted (options_<n>), others as options_other;
    extracts: tests for kinds of extracts, counted as extract_<name>. A document's row is the sum of its sections.
    """
    counts = [F.count_if(F.col(kind) == k).alias(f"n_{k.lower()}") for k in kinds]
    if options is not None:
        counts += [F.count_if(options == n).alias(f"options_{n}") for n in option_counts] + [F.count_if(options.isNotNull() & ~options.isin(*option_counts)).alias("options_other")]
    counts += [F.count_if(F.coalesce(c, F.lit(False))).alias(f"extract_{name}") for name, c in (extracts or {}).items()]
    limit = F.coalesce(limited, F.lit(False))
    return items.rollup(doc, section).agg(F.count("*").alias("n"), *counts, F.sum(chars).alias("chars"), F.count_if(limit).alias("with_limit"), F.count_if(~limit).alias("without_limit"), F.grouping_id().alias("_g")).where("_g < 3").drop("_g")


def wide_registry_row(items: DataFrame, key: str, order: list[str], values: dict[str, str], slots: int, kind: str | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """The first `slots` items of each key (of each of its kinds, if given) as numbered columns; missing ones are null, the rest is dropped. n_items counts all."""
    ranked = items.withColumn("_slot", F.row_number().over(Window.partitionBy(*([key, kind] if kind else [key])).orderBy(*order)))
    picks = []
    for own in kinds if kind else (None,):
        mine = F.lit(True) if own is None else F.col(kind) == own
        picks += [F.max(F.when(mine & (F.col("_slot") == i), F.col(c))).alias("_".join([name, *([own.lower()] if own else []), str(i)])) for i in range(1, slots + 1) for name, c in values.items()]
    return ranked.groupBy(key).agg(F.count("*").alias("n_items"), *picks)


def type_pivot(rows: DataFrame, by: list[str], kind: str, mapping: DataFrame, columns: list[str], other: str = "other") -> DataFrame:
    """Counts of each kind in the columns that mapping (kind, column, parts) gives it; a kind of several parts is dealt evenly, rounded down; unmapped kinds count as `other`."""
    counts = rows.groupBy(*by, F.col(kind).alias("kind")).agg(F.count("*").alias("_n"))
    placed = counts.join(mapping, "kind", "left").select(*by, F.coalesce("column", F.lit(other)).alias("_c"), F.expr("_n div coalesce(parts, 1)").alias("_n"))
    return placed.groupBy(*by).agg(*(F.coalesce(F.sum(F.when(F.col("_c") == c, F.col("_n"))), F.lit(0)).alias(c) for c in [*columns, other]))


def group_summary(rows: DataFrame, by: list[str], year: Column, means: dict[str, Column]) -> DataFrame:
    """Rows, first and last year, and means rounded to two decimals."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.min(year).alias("first_year"), F.max(year).alias("last_year"), *(F.round(F.avg(c), 2).alias(k) for k, c in means.items()))


def top_values(rows: DataFrame, columns: list[str], order: str, k: int) -> DataFrame:
    """The k most common values over several columns together; the value seen first (by `order`, then column) wins a tie. Nulls don't count."""
    seen = rows.select(order, F.posexplode(F.array(*columns)).alias("_at", "value")).where("value is not null")
    ranked = seen.groupBy("value").agg(F.count("*").alias("n"), F.min(F.struct(order, "_at")).alias("_first"))
    best = ranked.orderBy(F.desc("n"), "_first", "value").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "_first", "value"))).select("rank", "value", "n")


def upsert(registry: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """A10: rows of new replace those of the same key (null is a value), others are added; either side may have columns the other lacks. Doing it twice changes nothing."""
    keys = new.select(*(F.col(k).alias(f"_new_{k}") for k in key)).distinct()
    return registry.join(keys, [registry[k].eqNullSafe(keys[f"_new_{k}"]) for k in key], "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_columns(registry: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """A10, column form: only non-null values of new overwrite."""
    left, right = registry.alias("l"), new.alias("r")
    names = list(dict.fromkeys([*registry.columns, *new.columns]))
    pick = [F.coalesce(*([F.col(f"r.{c}")] if c in new.columns else []), *([F.col(f"l.{c}")] if c in registry.columns else [])).alias(c) for c in names]
    return left.join(right, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key], "full_outer").select(*pick)


def validate_registry(rows: DataFrame, by: str, required: list[str], casts: dict[str, str]) -> DataFrame:
    """(by, n_rows, problem, n) for missing required values ('missing:<c>'), values that can't be cast ('uncastable:<c>') and required or cast columns that rows lack ('absent:<c>', all rows of the group); groups without a problem have none."""
    has = set(rows.columns)
    checks = {f"missing:{c}": F.col(c).isNull() for c in required if c in has} | {f"uncastable:{c}": F.col(c).isNotNull() & F.col(c).cast("string").try_cast(t).isNull() for c, t in casts.items() if c in has}
    checks |= {f"absent:{c}": F.lit(True) for c in dict.fromkeys([*required, *casts]) if c not in has}
    wide = rows.groupBy(by).agg(F.count("*").alias("n_rows"), *(F.count_if(c).alias(f"_{i}") for i, c in enumerate(checks.values())))
    pairs = F.explode(F.array(*(F.struct(F.lit(name).alias("problem"), F.col(f"_{i}").alias("n")) for i, name in enumerate(checks))))
    return wide.select(by, "n_rows", pairs.alias("_p")).select(by, "n_rows", "_p.problem", "_p.n").where("n > 0")


def density_bins(hits: DataFrame, by: list[str], position: Column, width: int) -> DataFrame:
    """Hits in each bin of `width` positions."""
    return hits.groupBy(*by, F.floor(position / width).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def top_per_bin(scored: DataFrame, bin: Column, score: str, order: list[str], quota: DataFrame, least: float, parts: int = 64) -> DataFrame:
    """The best rows of each bin, as many as quota (bin, k) gives it, with a score of `least` at least; bins without a quota give none.

    Each of `parts` parts of a bin meets the bin's quota and leaves its k best; so few meet in the bin's own ranking, however
    many rows it has, and no k is too large. One bin may have all rows: they are dealt by bin and part.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int")
    asked = quota.select("bin", "k", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"))
    ranked = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), *order))).where("rank <= k")
    near = ranked(scored.where(F.col(score) >= least).withColumns({"bin": bin, "_part": part}).join(asked, ["bin", "_part"]), "bin", "_part")
    return ranked(near.drop("rank", "_part"), "bin").drop("k")


def level_counts(nodes: DataFrame, doc: str, level: str, levels: list) -> DataFrame:
    """Nodes of each level and in all."""
    return nodes.groupBy(doc).agg(*(F.count_if(F.col(level) == v).alias(f"n_{v}") for v in levels), F.count("*").alias("n_total"))


def mean_confidence(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """Mean of the known values, 0 when there is none."""
    return rows.groupBy(*by).agg(F.round(F.coalesce(F.avg(value), F.lit(0.0)), 4).alias("confidence"))


def theme_listing(rows: DataFrame, by: str, theme: str, k: int) -> DataFrame:
    """Each group's k most common themes, ties by name, as one ordered text."""
    counts = rows.where(F.col(theme).isNotNull()).groupBy(by, theme).agg(F.count("*").alias("n"))
    best = counts.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), theme))).where(F.col("_r") <= k)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(theme).alias("t"), "n"))), lambda x: F.concat(x["t"], F.lit(" ("), x["n"].cast("string"), F.lit(")")))
    return best.groupBy(by).agg(F.array_join(listed, "; ").alias("themes"))


def label_trend(rows: DataFrame, by: list[str], year: str, label: str) -> DataFrame:
    """Each label's share within (by, year) and its change in points from the label's previous recorded year."""
    shares = distribution(rows, label, [*by, year])
    before = F.lag("pct").over(Window.partitionBy(*by, "label").orderBy(year))
    return shares.withColumn("change", F.round(F.col("pct") - before, 1))
