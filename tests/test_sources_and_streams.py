"""Readers and writers on small files; streams against their batch twins."""

import json

from pyspark.sql import functions as F

from millrace.sources import readers, writers
from millrace.streaming import replay


def test_runs_with_sidecars_and_corrupt_records(spark, tmp_path):
    def put(place, record, timing=None):
        folder = tmp_path / "eval-1" / place
        folder.mkdir(parents=True)
        (folder / "grading.json").write_text(record if isinstance(record, str) else json.dumps(record))
        if timing:
            (folder / "timing.json").write_text(json.dumps(timing))

    base = {"summary": {"passed": 2, "failed": 1, "total": 3, "pass_rate": 0.67}, "execution_metrics": {"output_chars": 50}}
    put("with/run-1", base | {"timing": {"total_duration_seconds": 0.0}}, {"total_tokens": 9, "total_duration_seconds": 4.0})
    put("with/run-2", base | {"timing": {"total_duration_seconds": 7.0}}, {"total_tokens": 9, "total_duration_seconds": 4.0})
    put("without/run-1", "{broken")
    good, bad = readers.runs(spark, str(tmp_path))
    got = {(r.config, r.run_number): (r.time_seconds, r.tokens, r.tokens_source, r.passed) for r in good.collect()}
    assert got == {("with", 1): (4.0, 9, "timing", 2), ("with", 2): (7.0, 50, "characters", 2)}
    assert bad.count() == 1


def test_qa_pairs_keep_empty_answers(spark, tmp_path):
    (tmp_path / "qa.xml").write_text("<evaluation><qa_pair><question>a</question><answer>b</answer></qa_pair><qa_pair><question>c</question></qa_pair><qa_pair><question>d</question><answer></answer></qa_pair></evaluation>")
    assert sorted(tuple(r) for r in readers.qa_pairs(spark, str(tmp_path / "qa.xml")).collect()) == [("a", "b"), ("d", "")]


def test_markdown_inventory_and_manifests(spark, tmp_path):
    (tmp_path / "index.md").write_text("# a\nb")
    (tmp_path / "p1" / "figures").mkdir(parents=True)
    (tmp_path / "p1" / "x.md").write_text("# x")
    (tmp_path / "p1" / "figures" / "figures_manifest.json").write_text(json.dumps([{"fig_num": 1, "page": 2}, {"fig_num": 2, "page": 3, "suspect": True}]))
    assert [r.file for r in readers.markdown(spark, str(tmp_path)).collect()] == ["index.md"]
    assert readers.markdown(spark, str(tmp_path), recursive=True).count() == 2
    assert sorted((r.paper, r.fig_num, r.suspect) for r in readers.manifests(spark, str(tmp_path)).collect()) == [("p1", 1, None), ("p1", 2, True)]
    files = readers.inventory(spark, str(tmp_path))
    assert {r.suffix for r in files.collect()} == {".md", ".json"}
    assert [r.problem for r in readers.export_check(files, tmp_path.name).collect()] == ["nested_markdown"]


def test_run_folders_stop_at_the_first_hit(spark):
    paths = spark.createDataFrame([("/a/r1/outputs/x",), ("/a/r1/outputs/y/outputs/z",), ("/a/node_modules/r/outputs/x",), ("/a/none/x",)], "path string")
    assert [r.folder for r in readers.run_folders(paths).collect()] == ["/a/r1"]


def test_chunked_write_isolates_a_bad_row(spark):
    def send(rows):
        if any(r["id"] == 7 for r in rows):
            raise ValueError("bad")

    got = writers.write_chunks(spark.range(25).coalesce(1), send, tries=1).first()
    assert (got.written, got.skipped) == (24, 1)


def test_state_is_replaced(spark, tmp_path):
    path = str(tmp_path / "state")
    writers.replace_state(spark.range(3), path)
    writers.replace_state(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["state"]


def test_report_tables(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id int, name string")
    assert writers.as_markdown(df, ["id"]).first()[0] == "| id | name |\n| --- | --- |\n| 1 | a |\n| 2 | b |"
    assert json.loads(writers.as_json(df, ["id"]).first()[0]) == [{"id": 1, "name": "a"}, {"id": 2, "name": "b"}]


def test_refused_conditional_update(spark):
    state = spark.createDataFrame([("a", "1"), ("b", "1")], "k string, hash string")
    change = spark.createDataFrame([("a", "1", "2"), ("b", "0", "2")], "k string, expected string, hash string")
    after, refused = writers.conditional_update(state, change, "k")
    assert {r.k: r.hash for r in after.collect()} == {"a": "2", "b": "1"}
    assert [r.k for r in refused.collect()] == ["b"]


def test_replayed_batches_leave_one_copy(spark, tmp_path):
    write = writers.write_batch(str(tmp_path))
    write(spark.range(4), 0)
    write(spark.range(4), 0)
    assert spark.read.parquet(str(tmp_path)).count() == 4


def test_stream_dedupe_equals_batch(spark, tmp_path):
    rows = [(i % 5, f"2024-01-01 00:0{i % 5}:00") for i in range(12)]
    df = spark.createDataFrame(rows, "id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = replay.dedupe_stream(stream, "id", "ts").writeStream.format("memory").queryName("deduped").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert spark.table("deduped").count() == replay.dedupe_stream(df, "id", "ts").count() == 5


def test_state_machine_stream_equals_batch(spark, tmp_path):
    rows = [("a", 1, "view"), ("a", 2, "click"), ("a", 3, "error"), ("b", 1, "error"), ("b", 2, "click"), ("c", 1, "view")]
    df = spark.createDataFrame(rows, "user string, event_id int, kind string").withColumn("body", F.lit(""))
    batch = {r.user: r.decision for r in replay.decide(df, "user", "event_id", "kind", "click", "body", F.lit(True), ["error"]).collect() if r.decision != "open"}
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = replay.decide_stream(stream, "user", "event_id", "kind", "click", "body", F.lit(True), ["error"], None, None).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {r.user: r.decision for r in spark.table("decided").collect()} == batch == {"a": "accepted", "b": "rejected"}


def fetch(root, cursor):
    at = cursor or 0
    return [f"{root}{at}", f"{root}{at + 1}"], (at + 2 if at < 4 else None)


def test_paged_source(spark):
    spark.dataSource.register(readers.PagedSource)
    got = spark.read.format("paged").option("roots", "x,y").option("fetch", "tests.test_sources_and_streams:fetch").load()
    assert got.count() == 12


def test_state_machine_looks_for_the_needle_and_leaves_early(spark, tmp_path):
    rows = [
        ("yes", 1, "start", "", True), ("yes", 2, "piece", "ab", True), ("yes", 3, "piece", "cd", True), ("yes", 4, "stop", "", True), ("no", 1, "start", "", True), ("no", 2, "piece", "ab", True), ("no", 3, "stop", "", True), ("wrong", 1, "start", "", False),
        ("wrong", 2, "start", "bc", True), ("again", 1, "start", "a", True), ("again", 2, "start", "", True), ("again", 3, "piece", "bc", True), ("open", 1, "start", "b", True), ("early", 1, "stop", "", True), (None, 1, "start", "xbcx", True),
    ]
    df = spark.createDataFrame(rows, "user string, n int, kind string, body string, ok boolean").repartition(3)
    want = {"yes": "accepted", "no": "rejected", "wrong": "rejected", "again": "accepted", "open": "open", "early": "rejected", None: "accepted"}
    arguments = ("user", "n", "kind", "start", "body", F.col("ok"), ["stop"], "bc")
    assert {r.user: r.decision for r in replay.decide(df, *arguments).collect()} == want
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = replay.decide_stream(stream, *arguments, None).writeStream.format("memory").queryName("needles").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {r.user: r.decision for r in spark.table("needles").collect()} == {k: v for k, v in want.items() if v != "open"}


def test_folders_ids_embedding_and_pages(spark, tmp_path):
    for name in ("eval-3", "eval-x"):
        (tmp_path / name / "c" / "run-1").mkdir(parents=True)
        (tmp_path / name / "c" / "run-1" / "grading.json").write_text(json.dumps({"summary": {"passed": 1, "failed": 0, "total": 1, "pass_rate": 1.0}}))
    good, _ = readers.runs(spark, str(tmp_path))
    folders = sorted(r.folder for r in good.collect())
    meta = spark.createDataFrame([(folders[1], 77)], "folder string, eval_id long")
    assert {r.folder[-6:]: r.eval_id for r in readers.with_eval_id(good, meta).collect()} == {"eval-3": 3, "eval-x": 77}
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.toml").write_text("x")
    (tmp_path / "f" / "b.svg").write_text("<svg/>")
    (tmp_path / "f" / "c.pdf").write_bytes(b"one\x00\x0ctwo")
    got = {r.path[-5:]: (r.kind, r.text or r.data) for r in readers.embedded(spark, str(tmp_path / "f")).collect()}
    assert got["a.toml"[-5:]] == ("text", "x") and got["b.svg"] == ("image", "data:image/svg+xml;base64,PHN2Zy8+") and got["c.pdf"][0] == "pdf"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(str(tmp_path / "f"))
    pages = readers.page_texts(files, lambda content: content.decode().split("\x0c"))
    assert sorted((r.page, r.text) for r in pages.collect()) == [(1, "one"), (2, "two")]
    assert readers.joined_pages(pages).first().text == "=== PAGE 1 ===\none\n\n=== PAGE 2 ===\ntwo\n\n"
