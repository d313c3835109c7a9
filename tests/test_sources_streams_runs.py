"""Readers with their quirks, sinks, streams against batch, runs and markers."""

import json

import pytest

from corpusmill import run as R
from corpusmill.operators import metrics as M
from corpusmill.sources import readers as S, sinks
from corpusmill.streaming import live


def test_mixed_directory(spark, tmp_path):
    (tmp_path / "one.txt").write_bytes(b"first\r\nline")
    (tmp_path / "two.md").write_text("# second")
    (tmp_path / "three.jsonl").write_text('{"id": "a", "text": "x", "n": 1}\n\n{"text": null}\n')
    (tmp_path / "four.csv").write_text('id,text\n1,"quoted\nline"\n2,\n,third\n')
    (tmp_path / "skip.bin").write_bytes(b"no")
    got = S.sequence(S.read(spark, [S.Source("s", str(tmp_path))])).orderBy("seq").collect()
    assert [r.text for r in got] == ["quoted\nline", "third", "first\nline", "x", "None", "# second"]
    keys = [r.doc_key.rsplit("#", 1)[-1] for r in got]
    assert keys[:2] == ["1", "None"] and keys[3:5] == ["a", "3"]
    assert json.loads(got[3].extras) == {"id": "a", "n": "1"}


def test_broken_inputs_are_errors(spark, tmp_path):
    for name, content in (("a.jsonl", '{"text": '), ("b.jsonl", '{"other": 1}'), ("c.jsonl", '{"text": " "}'), ("d.txt", "  ")):
        d = tmp_path / name.replace(".", "_")
        d.mkdir()
        (d / name).write_text(content)
        with pytest.raises(Exception):
            S.read(spark, [S.Source("s", str(d))]).collect()
    assert S.read(spark, []).count() == 0


def test_parquet_and_small_corpus(spark, tmp_path):
    spark.createDataFrame([("p1", "text"), ("p2", " "), ("p3", None)], "id string, text string").write.parquet(str(tmp_path / "t"))
    assert [r.text for r in S.read(spark, [S.Source("s", str(tmp_path / "t"))]).collect()] == ["text"]
    d = tmp_path / "small"
    d.mkdir()
    for name, text in (("a.txt", " "), ("b.md", " body \n")):
        (d / name).write_text(text)
    assert [tuple(r) for r in S.small_corpus(spark, str(d)).collect()] == [("doc-00001", "body")]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(2, "b"), (1, "a")], "seq long, text string")
    sinks.write_corpus(d, str(tmp_path / "c"))
    sinks.export_jsonl(d, str(tmp_path / "j"))
    sinks.layer_csv([d, d.withColumnRenamed("text", "other")], str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2 and spark.read.json(str(tmp_path / "j")).count() == 2
    assert spark.read.option("header", True).csv(str(tmp_path / "l")).columns == ["other", "seq", "text"]
    sinks.write_json({"b": 1, "a": "é"}, str(tmp_path / "x" / "m.json"))
    assert json.loads((tmp_path / "x" / "m.json").read_text(encoding="utf8"))["a"] == "é"
    assert "polyline" in sinks.line_chart([(1, 2.0), (2, float("nan")), (3, 1.0)], "t") and "| a |" in sinks.markdown_summary("t", [{"a": 1}])
    assert S.artifacts(spark, str(tmp_path / "x")).first().category == "metadata"
    events = spark.createDataFrame([(1, "t", "train", "written", "r", "{}")], S.ARTIFACT_EVENT)
    sinks.append_events(events, str(tmp_path / "e")), sinks.append_events(events, str(tmp_path / "e")), sinks.append_events(events.limit(0), str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2 and not (tmp_path / "none").exists()


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    """A JSONL file that is read in many blocks keeps its line numbers, and Parquet rows their order."""
    rows = [json.dumps({"text": f"line {k} " + "x" * (k % 90)}) if k % 7 else "" for k in range(3000)]
    (tmp_path / "a.jsonl").write_text("\n".join(rows))
    spark.range(5000).selectExpr("cast(id as string) as id", "concat('row ', id) as text").coalesce(1).write.option("parquet.block.size", 8192).parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = S.read(spark, [S.Source("s", str(tmp_path / "a.jsonl"), id_field=None)])
        assert {r.position: r.text for r in got.collect()} == {k: json.loads(x)["text"] for k, x in enumerate(rows) if x}
        got = S.read(spark, [S.Source("s", str(tmp_path / "p"))]).collect()
        assert {r.position: r.text for r in got} == {k: f"row {k}" for k in range(5000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_evaluation_files_and_prompts(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A text\r\nof its own")
    (tmp_path / "b.jsonl").write_text('{"id": "j1", "question": "Why?", "expected": "So."}\n\n{"id": "j2", "text": " ", "prompt": ""}\n{"text": "plain", "answer": "", "target": "t"}\n')
    (tmp_path / "c.csv").write_text('id,context,cloze,answer\nc1,"Two\nlines",A _ b,x\nc2,,,\n')
    got = {r.example_id.rsplit("/", 1)[-1].split("#")[0].removeprefix("t:"): (r.prompt, r.answer, r.text) for r in S.eval_files(spark, "t", "recall", str(tmp_path)).collect()}
    assert got == {"a.md": (None, None, "# A text\nof its own"), "j1": ("Why?", "So.", "Why?\nSo."), "b.jsonl": (None, "t", "plain"), "c1": ("A _ b", "x", "A _ b\nTwo\nlines\nx")}
    (tmp_path / "bad.jsonl").write_text("{broken")
    with pytest.raises(Exception):
        S.eval_files(spark, "t", "recall", str(tmp_path)).collect()
    assert [tuple(r) for r in S.inline_prompts(spark, ["a", "b"]).collect()] == [("qualitative:prompt_000", "qualitative", "a"), ("qualitative:prompt_001", "qualitative", "b")]


ROWS = [(k, "t", "train", k, "train_loss", v, None, "r" + str(k % 2), "{}") for k, v in enumerate([1.0, 2.0, 1.02, 2.1, 1.2, 1.9, 1.3, 2.5])]


def test_streams_equal_batch(spark, tmp_path):
    batch = spark.createDataFrame(ROWS, S.METRIC_ROW)
    for k in range(0, len(ROWS), 3):
        spark.createDataFrame(ROWS[k : k + 3], S.METRIC_ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    stream = live.metric_stream(spark, str(tmp_path / "m"), files=1)
    q = live.latest(stream).writeStream.format("memory").queryName("latest_rows").outputMode("complete").start()
    q.processAllAvailable(), q.stop()
    assert sorted(map(tuple, spark.table("latest_rows").collect()), key=str) == sorted(map(tuple, M.latest(batch, "stage", "name").collect()), key=str)


def test_stop_stream_equals_batch(spark, tmp_path):
    batch = spark.createDataFrame(ROWS, S.METRIC_ROW)
    batch.coalesce(1).write.parquet(str(tmp_path / "m"))
    q = live.stops(live.metric_stream(spark, str(tmp_path / "m")), patience=2).writeStream.format("memory").queryName("stop_rows").outputMode("append").start()
    q.processAllAvailable(), q.stop()
    got = {(r.run, r.step) for r in spark.table("stop_rows").where("stop").groupBy("run").agg({"step": "min"}).withColumnRenamed("min(step)", "step").collect()}
    want = {(r.config_hash, r.stop_step) for r in M.early_stop(M.step_series(batch, "config_hash"), "config_hash", patience=2, min_steps=0).collect()}
    assert got == want and want


def test_config_hash_and_markers(spark, tmp_path):
    base = {"clean": {"min_chars": 200, "new": 1}, "runtime": {"x": 1}}
    assert R.config_hash(base, {"clean": {"new": 1}}) == R.config_hash({"clean": {"min_chars": 200}, "runtime": {"x": 2}}, {"clean": {"new": 1}})
    assert R.override(base, "clean.min_chars", 5)["clean"]["min_chars"] == 5
    with pytest.raises(KeyError):
        R.override(base, "clean.none", 5)
    run, d = R.Run(str(tmp_path), "h1"), spark.range(3)
    with pytest.raises(R.StaleStage):
        run.require("clean")
    run.finish("ingest", d, "p")
    run.require("clean"), run.verify("ingest", d.repartition(2))
    assert not R.Run(str(tmp_path), "h2").current("ingest")
    with pytest.raises(R.StaleStage):
        run.verify("ingest", spark.range(4))
    with pytest.raises(ValueError):
        R.require_rows("clean", 0)


def test_entry_without_the_subpackage(monkeypatch):
    import builtins

    import __spark_entry__ as e

    real = builtins.__import__

    def blocked(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith("corpusmill.llm"):
            raise ImportError(name)
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", blocked)
    names = set(e.queries())
    assert names and not any(n[0] == "p" for n in names) and set(e.oracle_sql()) <= names
