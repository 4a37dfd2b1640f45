"""Files through the whole chain, contents within a time to live, and nested documents."""

import json
import random

from pyspark.sql import functions as F

from docstruct.plans import papers
from docstruct.sources import corpus, registry_table
from docstruct.streaming import jobs

PAPER = "開成中学校 社会\n\n1. 次の文章を読んで、答えなさい。\n問1 川の名を答えなさい。\n問2 理由を選びなさい。\n２. 次の地図を見て、答えなさい。\n問１ 山の名を答えなさい。\n"
OTHER = "桜蔭中学校\n三、次の表\n一、次の文章を読んで\n問1 何\n"
ALIASES = [("開成", "開成中学校", 10, 1), ("桜蔭", "桜蔭中学校", 10, 2)]


def test_two_drops_of_files_equal_one_batch(spark, tmp_path):
    aliases = spark.createDataFrame(ALIASES, "alias string, entity string, priority int, alias_rank int")
    drops = [{"2023年開成.txt": PAPER.encode(), "令和6年桜蔭.txt": OTHER.encode("shift_jis")}, {"2023年開成追試.txt": PAPER.encode("euc_jp"), "H30開成.txt": PAPER.encode(), "broken.txt": b"\xff\xfe\x00\xff"}]
    folder, path = tmp_path / "in", str(tmp_path / "registry")
    for drop in drops:
        (folder / "社会").mkdir(parents=True, exist_ok=True)
        for name, data in drop.items():
            (folder / "社会" / name).write_bytes(data)
        for _ in range(2):  # nothing new the second time
            papers.ingest_papers(spark, str(folder), path, aliases, str(tmp_path / "state"), files_a_batch=1).awaitTermination()
    whole = papers.paper_rows(corpus.read_text_corpus(spark, str(folder)), aliases)
    got = registry_table.read_registry(spark, path).select(whole.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
    n = len(PAPER)
    assert sorted(map(tuple, got.collect())) == [("桜蔭中学校", 2024, 1, 1, 1, len(OTHER)), ("開成中学校", 2018, 1, 2, 3, n), ("開成中学校", 2023, 2, 4, 6, 2 * n)]
    assert not list(tmp_path.glob("registry.next/*"))


def test_contents_come_again_after_their_time_to_live_however_rows_are_dealt(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), t) for i, t in enumerate(sorted(rng.randrange(40_000) for _ in range(300)))]
    want, last = [], {}
    for i, text, t in rows:
        if text not in last or t - last[text] >= 3600:
            want.append(i)
            last[text] = t
    results = []
    for size in (300, 60, 7):
        folder = str(tmp_path / f"in{size}")
        for low in range(0, 300, size):
            some = spark.createDataFrame(rows[low : low + size], "id long, text string, t long").select("id", "text", F.timestamp_seconds("t").alias("ts"))
            some.coalesce(1).write.mode("append").parquet(folder)
            if size == 7 and low > 70:
                break
            stream = jobs.file_stream(spark, folder, "id long, text string, ts timestamp")
            if size < 300:
                jobs.ttl_ingest(stream, ["text"], "ts", "id", 3600, f"{folder}.out", f"{folder}.state").awaitTermination()
        if size == 300:
            jobs.ttl_ingest(stream, ["text"], "ts", "id", 3600, f"{folder}.out", f"{folder}.state").awaitTermination()
        results.append(sorted(r.id for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}.out/rows").collect()))
    assert results[0] == results[1] == want and results[2] == [i for i in want if i < len(results[2]) or i <= max(results[2])]
    # what comes behind the newest event less the time to live is counted, not kept
    late = spark.createDataFrame([(1000, "z", 5), (1001, None, None)], "id long, text string, t long").select("id", "text", F.timestamp_seconds("t").alias("ts"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in60"))
    jobs.ttl_ingest(jobs.file_stream(spark, str(tmp_path / "in60"), "id long, text string, ts timestamp"), ["text"], "ts", "id", 3600, f"{tmp_path}/in60.out", f"{tmp_path}/in60.state").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/in60.out/marks/5").first().n_late == 2
    assert spark.read.parquet(f"{tmp_path}/in60.out/state/5").count() <= 3


def test_documents_nest_sections_and_questions(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "d int, name string")
    sections = spark.createDataFrame([(1, 2, "second"), (1, 1, "first"), (1, 3, "empty")], "d int, s int, title string")
    questions = spark.createDataFrame([(1, 1, 2, "x", "q2"), (1, 1, 1, "y", "q1"), (1, 2, 1, "x", "q3"), (1, 9, 1, "x", "lost")], "d int, s int, n int, kind string, text string")
    nested = corpus.export_documents(docs, sections, questions, "d", "s", "n", "kind", ["text"])
    nested.write.json(str(tmp_path / "out"))
    rows = {r["d"]: r for f in (tmp_path / "out").glob("*.json") for r in map(json.loads, f.read_text().splitlines())}
    assert rows[2] == {"d": 2, "name": "b", "n_sections": 0, "n_questions": 0, "type_counts": {}, "sections": []}
    assert (rows[1]["n_sections"], rows[1]["n_questions"], rows[1]["type_counts"]) == (3, 3, {"x": 2, "y": 1})
    assert [(s["title"], s["n_questions"], s["type_counts"], [q["text"] for q in s["questions"]]) for s in rows[1]["sections"]] == [("first", 2, {"x": 1, "y": 1}, ["q1", "q2"]), ("second", 1, {"x": 1}, ["q3"]), ("empty", 0, {}, [])]


def test_a_task_of_the_nested_export_holds_a_small_part_of_the_documents(spark):
    docs = spark.range(2000).select(F.col("id").alias("d"))
    sections = docs.select("d", F.explode(F.array(F.lit(1), F.lit(2))).alias("s"))
    questions = sections.select("d", "s", F.lit(1).alias("n"), F.lit("x").alias("kind"), F.lit("q").alias("text"))
    nested = corpus.export_documents(docs, sections, questions, "d", "s", "n", "kind", ["text"]).where("n_sections = 2 AND n_questions = 2")
    held = [r["count"] for r in nested.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 2000 and max(held) < 100


def test_nested_export_of_null_and_repeated_rows_and_many_kinds(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "again"), (None, "none"), (2, "b")], "d int, name string")
    sections = spark.createDataFrame([(1, 1, "first"), (1, 1, "twice"), (1, None, "null"), (None, 1, "lost")], "d int, s int, title string")
    many = [(1, 1, i, f"k{i % 3000:04}", "q") for i in range(9000)]
    questions = spark.createDataFrame([*many, (1, None, 1, "x", "lost"), (None, 1, 1, "x", "lost"), (2, 1, 1, "x", "lost")], "d int, s int, n int, kind string, text string")
    rows = {r["name"]: r for r in corpus.export_documents(docs, sections, questions, "d", "s", "n", "kind", ["text"], parts=4).collect()}
    for name in ("a", "again"):
        assert (rows[name]["n_sections"], rows[name]["n_questions"]) == (3, 18000) and rows[name]["type_counts"] == {f"k{i:04}": 3 for i in range(3000)}
        assert {s["title"]: (s["n_questions"], len(s["type_counts"]), [q["n"] for q in s["questions"]]) for s in rows[name]["sections"]} == {"first": (9000, 3000, list(range(9000))), "twice": (9000, 3000, list(range(9000))), "null": (0, 0, [])}
    for name in ("none", "b"):
        assert (rows[name]["n_sections"], rows[name]["n_questions"], rows[name]["type_counts"], rows[name]["sections"]) == (0, 0, {}, [])
