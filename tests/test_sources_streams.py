"""Sources, the stored registry and streams on small folders."""

from pyspark.sql import functions as F

from docstruct.sources import ingest, corpus, registry_table
from docstruct.streaming import jobs


def test_text_corpus_tries_encodings(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "u.txt").write_text("問1 é", encoding="utf-8")
    (tmp_path / "s.txt").write_bytes("問題".encode("shift_jis"))
    (tmp_path / "bad.txt").write_bytes(b"\x80\xff\xff")
    got = {r.path.rsplit("/", 1)[-1]: (r.text, r.encoding, r.error) for r in corpus.read_text_corpus(spark, str(tmp_path)).collect()}
    assert got["u.txt"] == ("問1 é", "utf-8", None) and got["s.txt"][:2] == ("問題", "shift_jis") and got["bad.txt"][0] is None and got["bad.txt"][2]


def test_lexicons_merge_in_order(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"f": ["b", "a"], "g": ["x"]}')
    base = corpus.read_lexicon(spark, str(tmp_path / "l.json"))
    add = spark.createDataFrame([("f", "a", 0), ("f", "c", 1)], "field string, term string, term_rank int")
    assert sorted((r.field, r.term_rank, r.term) for r in corpus.merge_lexicons(base, add).collect()) == [("f", 0, "b"), ("f", 1, "a"), ("f", 2, "c"), ("g", 0, "x")]


def test_registry_stream_is_idempotent_and_grows_columns(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "registry")
    spark.createDataFrame([("s", 2020, 1), ("s", 2021, 2), ("t", 2020, 3)], "school string, year int, n int").write.parquet(source)
    stream = jobs.file_stream(spark, source, "school string, year int, n int")
    for _ in range(2):
        jobs.stream_ingest(stream, lambda df: df, path, ["school", "year"], "school", str(tmp_path / "c")).awaitTermination()
    registry_table.upsert_groups(spark.createDataFrame([("s", 2021, 9, "x")], "school string, year int, n int, extra string"), path, ["school", "year"], "school")
    got = sorted((r.school, r.year, r.n, r.extra) for r in registry_table.read_registry(spark, path).collect())
    assert got == [("s", 2020, 1, None), ("s", 2021, 9, "x"), ("t", 2020, 3, None)]


def test_stream_dedupe_and_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("b", 9)], "text string, s int").select("text", F.timestamp_seconds("s").alias("ts"))
    rows.coalesce(1).write.parquet(source)
    stream = jobs.file_stream(spark, source, "text string, ts timestamp")
    for name, df, mode in (("once", jobs.dedupe_with_ttl(stream, "text", "ts"), "append"), ("counts", jobs.running_distribution(stream, "text", []), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("once").count() == 2
    assert {r.label: r.n for r in spark.table("counts").collect()} == {"a": 2, "b": 1}


def test_nested_export(spark):
    items = spark.createDataFrame([(1, 2, "x"), (1, 1, "y"), (1, 3, "x")], "d int, n int, k string")
    row = corpus.export_nested(items, "d", ["n"], "k", ["k"]).first()
    assert row.n_items == 3 and row.type_counts == {"x": 2, "y": 1} and [i.n for i in row["items"]] == [1, 2, 3]


def test_lexicons_of_other_forms(spark, tmp_path):
    (tmp_path / "periods.json").write_text('{"old": {"strong": ["bronze"], "representative": ["tomb", "jar"]}, "new": {"strong": [], "representative": ["train"]}}')
    found = corpus.read_period_index(spark, str(tmp_path / "periods.json"))
    assert sorted(map(tuple, found.select("field", "tier", "term_rank", "term").collect())) == [("new", "representative", 0, "train"), ("old", "representative", 0, "tomb"), ("old", "representative", 1, "jar"), ("old", "strong", 0, "bronze")]
    (tmp_path / "terms.md").write_text("# Terms\n- lost\n## history\n- king, duke\n### wars\n* siege、 truce\n- siege\n\ntext\n## law\n- court\n")
    found = corpus.read_markdown_lexicon(spark, str(tmp_path / "terms.md"))
    rows = found.select("field", F.coalesce("category", F.lit("-")), "term_rank", "term").collect()
    assert sorted(map(tuple, rows)) == [("history", "-", 0, "king"), ("history", "-", 1, "duke"), ("history", "wars", 0, "siege"), ("history", "wars", 1, "truce"), ("law", "-", 0, "court")]


def test_tags_within_their_own_kind_keep_both_texts(spark):
    pages = ["<ul><li>fruit <ul><li>apple</li><li> red <b>pear</b> </li></ul> end</li></ul>", "</li><li>open<li>closed</li><td>a < b</td>", "<h1>" + "x" * 40 + "<a>link</a></h1><a>li</a><a>Stop</a>", None, ""]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)] + [(0, pages[2])], "i int, html string").repartition(3)
    got = {r.term: r.n for r in ingest.harvest_terms(df, "html", stop=["stop"]).collect()}
    assert got == {"fruit apple red pear  end": 1, "apple": 1, "red pear": 1, "closed": 1, "a < b": 1, "link": 2, "li": 2}
