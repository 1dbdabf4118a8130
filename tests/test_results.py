"""Results that appear at once, documents in parts, and recordings that grow while they are read."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files, results, sinks
from tidemark.sources.results import Results, Written
from tidemark.streaming.sources import GrowingPcm


def files_of(folder):
    return sorted(os.path.relpath(os.path.join(d, x), folder) for d, _, names in os.walk(folder) for x in names)


def lines_of(folder, ext):
    return sorted(x for f in files_of(folder) if f.endswith(ext) for x in open(f"{folder}/{f}", encoding="utf-8").read().splitlines())


def test_kinds_of_results(spark, tmp_path):
    spark.dataSource.register(Results)
    rows = spark.createDataFrame([("a", "one\ttwo", 1.5), ("b", None, 2.0)], "file string, value string, x double").repartition(3)
    for kind, ext, want in (("json", "jsonl", ['{"file": "a", "value": "one\\ttwo", "x": 1.5}', '{"file": "b", "x": 2.0}']), ("tsv", "tsv", ['a\t"one\ttwo"\t1.5', "b\t\t2.0"]), ("text", "txt", ["a", "b"])):
        rows.write.format("results").option("kind", kind).mode("append").save(str(tmp_path / kind))
        assert lines_of(tmp_path / kind, ext) == want and not [f for f in files_of(tmp_path / kind) if f.startswith("_")]
    rows.write.format("results").option("kind", "documents").mode("append").save(str(tmp_path / "d"))
    assert {f.split("/", 1)[1]: (tmp_path / "d" / f).read_text() for f in files_of(tmp_path / "d")} == {"a": "one\ttwo", "b": ""}
    rows.limit(1).write.format("results").option("kind", "text").mode("overwrite").save(str(tmp_path / "text"))
    assert lines_of(tmp_path / "text", "txt") in (["a"], ["b"])
    assert spark.read.option("recursiveFileLookup", True).json(str(tmp_path / "json")).count() == 2
    with pytest.raises(Exception, match="no writer"):
        rows.write.format("results").option("kind", "x").mode("append").save(str(tmp_path / "x"))


def test_an_aborted_job_leaves_nothing_to_see(spark, tmp_path):
    spark.dataSource.register(Results)
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("id").cast("string")).alias("value"))
    with pytest.raises(Exception, match="broken"):
        bad.write.format("results").option("kind", "text").mode("append").save(str(tmp_path / "out"))
    assert [f for f in files_of(tmp_path / "out") if not f.startswith("_")] == []
    assert spark.read.option("recursiveFileLookup", True).schema("value string").text(str(tmp_path / "out")).count() == 0


def test_attempts_that_do_not_count(tmp_path):
    """Two attempts of one task have both written; the commit names one of them."""
    from pyspark.sql import Row
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([StructField("value", StringType())])
    writer = results._BatchWriter({"path": str(tmp_path), "kind": "text"}, schema, False)
    lost, kept = writer.write(iter([Row("a"), Row("b")])), writer.write(iter([Row("a"), Row("b")]))
    assert files_of(tmp_path) and lost.files != kept.files
    assert not [f for f in files_of(tmp_path) if not f.startswith(results.STAGING)]
    writer.commit([kept, None])
    assert len(files_of(tmp_path)) == 1 and lines_of(tmp_path, "txt") == ["a", "b"] and kept.rows == 2
    stream = results._StreamWriter({"path": str(tmp_path / "s"), "kind": "text"}, schema)
    for _ in range(2):  # a batch that is committed again after a crash
        stream.write(iter([Row("lost")]))
        stream.commit([stream.write(iter([Row("x")]))], 0)
    stream.commit([stream.write(iter([Row("y")]))], 1)
    assert lines_of(tmp_path / "s", "txt") == ["x", "y"] and len(files_of(tmp_path / "s")) == 2
    stream.abort([Written([], 0)], 2)


def test_results_of_a_stream(spark, tmp_path):
    spark.dataSource.register(Results)
    for k in range(3):
        spark.createDataFrame([(k, j) for j in range(4)], "k int, j int").coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = spark.readStream.schema("k int, j int").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    q = stream.writeStream.format("results").option("kind", "json").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    got = sorted((json.loads(x)["k"], json.loads(x)["j"]) for x in lines_of(tmp_path / "out", "jsonl"))
    assert got == [(k, j) for k in range(3) for j in range(4)]
    assert {f.split("/")[0] for f in files_of(tmp_path / "out")} == {"batch=0", "batch=1", "batch=2"}


def test_documents_in_parts(spark, tmp_path):
    rows = [(f"f{k:04}", k / 3, None if k % 5 == 0 else f'said "{k}"\n日', float(k), None) for k in range(2000)]
    df = spark.createDataFrame(rows, "file string, duration double, transcription string, first_token_latency_ms double, last_token_latency_ms double").repartition(7)
    manifest = results.write_document({"n": 3, "none": None}, df, ["file"], str(tmp_path / "doc"), parts=5)
    assert len(manifest["parts"]) == 5 and [p["skip"] for p in manifest["parts"]] == [1, 0, 0, 0, 0]
    pieces = list(results.joined(str(tmp_path / "doc"), 1000))
    assert max(map(len, pieces)) <= 1000
    document = json.loads(b"".join(pieces))
    assert document["n"] == 3 and document["none"] is None and [tuple(r.values()) for r in document["results"]] == rows
    results.write_summary(df, str(tmp_path / "summary"))
    today = sinks.batch_summary(df).first().asDict(True)  # one row with all results
    assert json.loads(b"".join(results.joined(str(tmp_path / "summary")))) == json.loads(json.dumps(today))
    results.write_document({}, df.where("1 = 0"), ["file"], str(tmp_path / "none"))
    assert json.loads(b"".join(results.joined(str(tmp_path / "none")))) == {"results": []}


def test_the_evaluation_document(spark, tmp_path):
    from tidemark.operators import evaluate

    pairs = spark.createDataFrame([("a", "one two", "one too", True), ("b", "x", None, False)], "file string, reference string, generated string, is_matched boolean")
    metrics = evaluate.metric_rows(pairs, F.lit("en"))
    results.write_evaluation(pairs, metrics, str(tmp_path / "e"))
    got = json.loads(b"".join(results.joined(str(tmp_path / "e"))))
    assert got == json.loads(json.dumps(evaluate.summary(pairs, metrics, per_file=True).first().asDict(True)))


def test_no_rows_are_collected_into_one(spark, tmp_path):
    import inspect

    assert "collect_list" not in inspect.getsource(results) and "coalesce(1)" not in inspect.getsource(results)


def test_recordings_that_grow(spark, tmp_path):
    """A slow batch is followed by a longer chunk; a restart goes on where the query stood; the odd byte waits; what is too short waits for its end."""
    spark.dataSource.register(GrowingPcm)
    folder = tmp_path / "in"
    folder.mkdir()
    seen, sent = [], {"a": b"", "b": b""}

    def say(name, n):
        more = bytes((len(sent[name]) + k) % 251 for k in range(n))
        sent[name] += more
        with open(folder / f"{name}.pcm", "ab") as f:
            f.write(more)

    def take(batch, number):
        rows = sorted((r["stream"], r["first_sample"], bytes(r["pcm"])) for r in batch.collect())
        seen.append((number, rows))
        if rows and not any(n for n, _ in slow):
            slow.append((number, None))
            time.sleep(3)

    def start():
        rows = spark.readStream.format("growing_pcm").option("rate", 100).option("min_chunk", 0.5).option("max_row", 2).load(str(folder))
        return rows.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()

    def read(name):
        return b"".join(raw for _, rows in seen for s, _, raw in rows if s == name)

    slow: list = []
    say("a", 201)
    say("b", 50)  # less than half a second: it waits
    query = start()
    until = time.time() + 90
    while time.time() < until and not seen:
        time.sleep(0.1)
    for _ in range(25):  # while the first batch is slow
        say("a", 40)
        time.sleep(0.1)
    while time.time() < until and len(read("a")) < len(sent["a"]) - 100:
        time.sleep(0.2)
    sizes = [sum(len(raw) for s, _, raw in rows if s == "a") for _, rows in seen if rows]
    assert len(sizes) >= 2 and max(sizes[1:]) > 2 * 40, sizes
    query.stop()
    (folder / "a.done").touch()
    (folder / "b.done").touch()
    say("a", 30)
    query = start()
    while time.time() < until and (len(read("a")) < len(sent["a"]) // 2 * 2 or len(read("b")) < 50):
        time.sleep(0.2)
    query.stop()
    assert read("a") == sent["a"][: len(sent["a"]) // 2 * 2] and read("b") == sent["b"]
    assert all(len(raw) <= 400 for _, rows in seen for *_, raw in rows)
    firsts = [(s, first) for _, rows in seen for s, first, _ in rows]
    assert len(firsts) == len(set(firsts))


def test_one_file_for_each_iteration(spark, tmp_path):
    """However many tasks hold rows of a segment, each of its iterations is one file, and all rows come back under their keys."""
    names = ["a", "b/c =%", "é ü", None]
    rows = spark.createDataFrame([(names[k % 4], k % 3, f"t{k}" if k % 5 else None) for k in range(120)], "segment string, iteration int, text string").repartition(6)
    path = str(tmp_path / "i")
    sinks.write_iterations(rows, path)
    assert len([f for f in files_of(path) if f.endswith(".txt")]) == 12
    got = sorted(map(repr, map(tuple, files.iterations(spark, path).collect())))
    assert got == sorted(repr((names[k % 4], str(k % 3), f"t{k}" if k % 5 else "")) for k in range(120))
    assert {tuple(r) for r in spark.read.text(path).select("segment", "iteration").distinct().collect()} == {(n, k) for n in names for k in range(3)}
    with pytest.raises(FileExistsError):
        sinks.write_iterations(rows, path)
    sinks.write_iterations(rows.where("1 = 0"), path + "0")
    assert files.iterations(spark, path + "0").count() == 0
