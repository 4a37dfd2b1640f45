"""Corpus preparation: cleaning, filtering, gating and chunking."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstruct.functions.fold import cut_pieces, pack_greedily


@F.pandas_udf(T.StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode compatibility composition, which Spark has no function for."""
    for s in texts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def clean_corpus(docs: DataFrame, rules: list[tuple[str, str, str]], text: str, normalize: bool = False) -> DataFrame:
    """Apply (name, pattern, replacement) in order to the text column; adds chars_before, chars_after and removed_<name> (non-blank characters).

    All rules are one chain of expressions; null texts stay null with zero counts.
    """
    size = lambda c: F.coalesce(F.length(c) - F.regexp_count(c, F.lit(r"\s")), F.lit(0))
    out = docs.withColumn("_t0", nfkc(text) if normalize else F.col(text))
    for i, (_, pattern, replacement) in enumerate(rules):
        out = out.withColumn(f"_t{i + 1}", F.regexp_replace(f"_t{i}", pattern, replacement))
    out = out.withColumn("_s0", size(F.col("_t0")))
    for i in range(len(rules)):  # a text that a rule leaves alone is not measured anew
        out = out.withColumn(f"_s{i + 1}", F.when(F.col(f"_t{i}") == F.col(f"_t{i + 1}"), F.col(f"_s{i}")).otherwise(size(F.col(f"_t{i + 1}"))))
    sizes = {f"removed_{name}": F.col(f"_s{i}") - F.col(f"_s{i + 1}") for i, (name, _, _) in enumerate(rules)}
    out = out.withColumns({"chars_before": F.col("_s0"), "chars_after": F.col(f"_s{len(rules)}"), **sizes, text: F.col(f"_t{len(rules)}")})
    return out.drop(*(f"_{c}{i}" for i in range(len(rules) + 1) for c in "ts"))


def cleaning_report(cleaned: DataFrame, by: list[str], rules: list[str]) -> DataFrame:
    """(by, rule, docs_hit, removed, chars, pct)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(f"removed_{r}").alias("gone")) for r in rules)))
    own = cleaned.select(*by, F.col("chars_before").alias("_chars"), pairs.alias("_p"))
    out = own.groupBy(*by, "_p.rule").agg(F.count_if(F.col("_p.gone") > 0).alias("docs_hit"), F.sum("_p.gone").cast("long").alias("removed"), F.sum("_chars").cast("long").alias("chars"))
    return out.withColumn("pct", F.round(F.try_divide(F.col("removed") * 100.0, F.col("chars")), 1))


def cut_boilerplate_tail(docs: DataFrame, markers: list[str], text: str, from_fraction: float = 0.5, strong: tuple[str, ...] = ()) -> DataFrame:
    """Cut each text at the earliest marker that lies in its part from from_fraction on, or else at the last occurrence of a strong marker anywhere; adds cut_at (null: nothing cut) and cut_by (the marker)."""
    begin = F.floor(F.length(text) * from_fraction).cast("int") + 1
    body = F.col(text)
    at = [F.struct(F.call_function("locate", F.lit(m), body, begin).alias("at"), F.lit(m).alias("by")) for m in markers]
    first = F.array_min(F.filter(F.array(*at), lambda x: x["at"] > 0)) if markers else F.lit(None).cast("struct<at:int,by:string>")
    # the last occurrence lies where the reversed marker is first met in the reversed text
    back = [F.struct((F.length(body) - F.call_function("locate", F.lit(m[::-1]), F.reverse(body)) - len(m) + 2).alias("at"), F.lit(m).alias("by"), F.call_function("locate", F.lit(m[::-1]), F.reverse(body)).alias("met")) for m in strong]
    last = F.array_max(F.filter(F.array(*back), lambda x: x["met"] > 0)) if strong else F.lit(None).cast("struct<at:int,by:string,met:int>")
    out = docs.withColumn("_first", first).withColumn("_last", last)
    out = out.withColumns({"cut_at": F.coalesce("_first.at", "_last.at") - 1, "cut_by": F.coalesce("_first.by", "_last.by")}).drop("_first", "_last")
    return out.withColumn(text, F.when(F.col("cut_at").isNotNull(), F.substring(F.col(text), F.lit(1), F.col("cut_at"))).otherwise(F.col(text)))


def cut_report(before: DataFrame, cut: DataFrame, keys: list[str], text: str, by: list[str]) -> DataFrame:
    """(by, n_docs, n_cut, chars_cut, pct): what cut_boilerplate_tail() took from each group."""
    sizes = before.select(*keys, F.coalesce(F.length(text), F.lit(0)).alias("_was"))
    both = cut.select(*keys, *by, "cut_at").join(sizes, keys)
    gone = F.when(F.col("cut_at").isNotNull(), F.col("_was") - F.col("cut_at")).otherwise(0)
    own = both.groupBy(*by).agg(F.count("*").alias("n_docs"), F.count("cut_at").alias("n_cut"), F.sum(gone).cast("long").alias("chars_cut"), F.sum("_was").alias("_all"))
    return own.withColumn("pct", F.round(F.try_divide(F.col("chars_cut") * F.lit(100.0), F.col("_all")), 1)).drop("_all")


def line_verdicts(docs: DataFrame, drop_rules: list[tuple[str, str]], text: str, keys: list[str]) -> DataFrame:
    """P5: every line with the first rule (name, pattern) that drops it, null if none."""
    lines = docs.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    rule = F.coalesce(*(F.when(F.col("line").rlike(p), F.lit(name)) for name, p in drop_rules), F.lit(None))
    return lines.withColumn("rule", rule)


def filter_lines(docs: DataFrame, drop_rules: list[tuple[str, str]], text: str) -> DataFrame:
    """P5: the text without the lines that a rule drops, in order, and n_dropped; done within each row."""
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda x: ~F.coalesce(*(F.when(x.rlike(p), F.lit(True)) for _, p in drop_rules), F.lit(False)))
    return docs.withColumn("n_dropped", F.size(lines) - F.size(kept)).withColumn(text, F.array_join(kept, "\n"))


def length_gate(docs: DataFrame, text: str, least: int, most: int) -> DataFrame:
    """Add reason: 'empty', 'too_short', 'too_long' or null if accepted."""
    n = F.length(F.trim(F.col(text)))
    return docs.withColumn("reason", F.when(F.coalesce(n, F.lit(0)) == 0, "empty").when(n < least, "too_short").when(n > most, "too_long"))


def chunk_documents(docs: DataFrame, most: int, text: str, keys: list[str]) -> DataFrame:
    """(keys, chunk_no, chunk): paragraphs packed in order into chunks of at most `most` characters; longer paragraphs are cut behind sentence ends, and a sentence that is longer still at every `most` characters. One pass over each text."""
    own = docs.select(*keys, F.col(text).alias("_text"))
    schema = T.StructType([*own.schema.fields[:-1], T.StructField("chunk_no", T.IntegerType()), T.StructField("chunk", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = [pack_greedily(cut_pieces(one or "", most), most) for one in batch.column(len(keys)).to_pylist()]
            row = pa.array([i for i, one in enumerate(chunks) for _ in one], pa.int32())
            kept = [batch.column(i).take(row) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([n for one in chunks for n in range(len(one))], pa.int32()), pa.array([c for one in chunks for c in one], pa.string())], names=schema.names)

    return own.mapInArrow(run, schema)


def filter_labels(rows: DataFrame, label: str, enabled: list[str]) -> DataFrame:
    """P10: rows whose label is enabled."""
    return rows.where(F.col(label).isin(*enabled))
