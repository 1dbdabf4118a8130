import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import files, sinks


def rows_of(df, *names):
    return sorted(tuple(r) for r in (df.select(*names) if names else df).collect())


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_references_and_hypotheses(spark, tmp_path):
    refs = put(tmp_path / "ref.json", json.dumps([{"audio_path": "d/a.wav", "text_en": "one"}, {"audio_path": "d/b.wav", "text_en": ""}, {"audio_path": "e/a.wav", "text_en": "two"}, {"audio_path": "c", "other": 1}]))
    assert rows_of(files.references(spark, refs)) == [("a", "two"), ("a.wav", "two")]
    put(tmp_path / "out" / "a_transcription.txt", " hello\n")
    assert rows_of(files.any_hypotheses(spark, str(tmp_path / "out"))) == [("a", "hello")]
    batch = {"total_files": 1, "processed_files": 1, "results": [{"file": "d/a.wav", "duration": 1.0, "transcription": ""}]}
    put(tmp_path / "out" / "batch_transcriptions.json", json.dumps(batch))
    assert rows_of(files.any_hypotheses(spark, str(tmp_path / "out")), "file", "generated") == [("a", ""), ("a.wav", "")]


def test_individual_files_are_whole_texts(spark, tmp_path):
    for k in range(3):
        put(tmp_path / f"a{k}_transcription.txt", f" one {k}\ntwo\n\nthree\n")
    assert rows_of(files.individual_hypotheses(spark, str(tmp_path))) == [(f"a{k}", f"one {k}\ntwo\n\nthree") for k in range(3)]


def test_line_formats(spark):
    lines = spark.createDataFrame([("BAC009S0764W0121 你好 吗",), ("",), ("BAC009S0764W0122",)], "value string")
    assert rows_of(files.id_lines(lines, ".wav", "wav")) == [("wav/S0764/BAC009S0764W0121.wav", "你好 吗"), ("wav/S0764/BAC009S0764W0122.wav", "")]
    tabs = spark.createDataFrame([("a1.wav\tx\ty\thi",), ("# c\tz",), ("",), ("one",), ("b.wav\t ",)], "value string")
    assert rows_of(files.tab_lines(tabs).where("skipped IS NULL"), "name", "text") == [("a1.wav", "hi")]
    assert sorted(r[0] for r in files.tab_lines(tabs).where("skipped IS NOT NULL").select("skipped").collect()) == ["blank", "comment", "empty", "short"]
    named = spark.createDataFrame([("a7.wav", 0), ("b.wav", 1)], "name string, o int")
    assert rows_of(files.indexed(named, "name", "o", 10), "name", "index") == [("a7.wav", 7), ("b.wav", 11)]


def test_samples_and_sniffing(spark, tmp_path):
    good = {"k_best_candidates": ["a", "b"], "previous_transcript": "p", "continuation_transcript": "c", "audio_path": "x.wav", "timestamp": 1.5}
    path = put(tmp_path / "s.jsonl", "\n" + json.dumps(good) + "\n{broken\n")
    assert files.is_sample_format(spark, path)
    assert files.samples(spark, path).where("audio_path IS NOT NULL").count() == 1
    plain = put(tmp_path / "t.jsonl", json.dumps({"instruction": "i", "response": "r"}))
    assert not files.is_sample_format(spark, plain)
    assert files.dataset(spark, plain, {"instruction": "q"}).columns == ["q", "response"]
    assert rows_of(files.processed_keys(spark, path)) == [("x.wav",)] and files.processed_keys(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        files.dataset(spark, "x.bin")
    with pytest.raises(ValueError):
        files.from_lists(spark, ["a"], [], ["b"])
    assert files.from_lists(spark, ["a"], ["b"], ["c"]).count() == 1


def sequential(lines, k):
    """A line-by-line reading, for comparison."""
    import re

    out, now, loop = [], None, []
    for line in lines:
        if re.search(files.FINISH, line):
            break
        if m := re.search(files.HEADER, line):
            if now:
                now["topk"] = loop[-k:]
            now, loop = {"start": float(m[1]), "end": float(m[2]), "previous_transcript": "", "outputs": [], "topk": []}, []
            out.append(now)
        elif now is None:
            continue
        elif re.search(files.RESET, line):
            loop = []
        elif m := re.search(files.CANDIDATE, line):
            loop.append(m[1])
        elif m := re.search(files.OUTPUT, line):
            now["outputs"].append(m[1].strip())
        elif m := re.search(files.PREVIOUS, line):
            now["previous_transcript"] = m[1].strip()
    if now:
        now["topk"] = loop[-k:]
    return out


def test_logs_against_a_sequential_reading(spark):
    import random

    rng = random.Random(2)
    logs = {}
    for f in range(6):
        lines = []
        for n in range(60):
            lines.append(rng.choice([f"INFO    The system received audio from {n}.0 s to {n + 1}.0 s", "INFO Decoding loop starts", f"DEBUG   <|startoftranscript|><|zh|><|transcribe|><|notimestamps|>c {n}", f"INFO    Output: o{n} ", f"INFO  Previous confirmed transcript: p{n}", "noise"]))
        logs[f"f{f}"] = lines[:50] + (["INFO Finish"] if f % 2 else []) + lines[50:]
    df = spark.createDataFrame([(f, k, x) for f, ls in logs.items() for k, x in enumerate(ls)], "file string, line_no int, value string")
    got = {f: [r.asDict() for r in sorted(files.log_chunks(df).where(F.col("file") == f).collect(), key=lambda r: r["chunk"])] for f in logs}
    for f, lines in logs.items():
        assert [{k: r[k] for k in ("start", "end", "previous_transcript", "outputs", "topk")} for r in got[f]] == sequential(lines, 4)


def test_marks_and_digests(spark, tmp_path):
    put(tmp_path / "a.log", "Ref: one\nHyp: x\nRef: two")
    lines = files.numbered_lines(spark, str(tmp_path / "a.log"))
    assert rows_of(files.last_marked(lines, "Ref:")) == [("a.log", "two")]
    assert spark.range(1).select(files.has_digest(F.lit("x").cast("binary"), hashlib.sha256(b"x").hexdigest())).first()[0]
    for n in ("b.WAV", "sub/a.mp3", "c.txt"):
        put(tmp_path / "audio" / n, "x")
    assert [r["path"].rsplit("/", 1)[1] for r in files.audio_files(spark, str(tmp_path / "audio")).collect()] == ["b.WAV", "a.mp3"]


def test_blob_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, ("p.wav", bytearray(b"ab")))], "id int, audio struct<path:string,bytes:binary>")
    df.write.parquet(str(tmp_path / "t"))
    blobs, rest = files.parquet_with_blob(spark, str(tmp_path / "t"))
    assert rows_of(blobs) == [("p.wav", bytearray(b"ab"))] and rest.columns == ["id"]


SEGMENTS = [("f", 0, 0.0, 1.5, " Hi-->there\tyou "), ("f", 1, 3661.5, 3662.0, "b")]


def segments(spark):
    return spark.createDataFrame(SEGMENTS, "file string, seq int, start double, end double, text string")


def test_subtitles(spark):
    srt = sinks.documents(sinks.srt_blocks(segments(spark), "file", "seq"), "file", "seq").first()["value"]
    assert srt == "1\n00:00:00,000 --> 00:00:01,500\nHi->there\tyou\n\n2\n01:01:01,500 --> 01:01:02,000\nb\n"
    vtt = sinks.documents(sinks.vtt_blocks(segments(spark), "file", "seq"), "file", "seq", "WEBVTT\n\n").first()["value"]
    assert vtt.startswith("WEBVTT\n\n00:00.000 --> 00:01.500\nHi->there")
    assert rows_of(sinks.tsv_rows(segments(spark))) == [(0, 1500, "Hi-->there you"), (3661500, 3662000, "b")]


def test_cues():
    words = [(0, " one", 0.0, 0.5), (0, " two", 0.5, 1.0), (0, " three", 1.0, 1.5), (0, " four", 9.0, 9.5), (1, " five", 9.5, 10.0)]
    assert sinks.cue_fold(words, None, None) == [(0.0, 9.5, "one two three four"), (9.5, 10.0, "five")]
    assert sinks.cue_fold(words, 8, 2) == [(0.0, 1.5, "one two\nthree"), (9.0, 10.0, "four\nfive")]
    assert sinks.cue_fold([], 8, 2) == []


def test_packets_lines_and_files(spark, tmp_path):
    got = spark.createDataFrame([("ab" * 5 + "\nrest",)], "t string").select(sinks.packets("t", 4), sinks.packets("t", 4, True)).first()
    assert b"".join(map(bytes, got[0])) == b"ababababab\n" and [len(x) for x in got[1]] == [4, 4, 4]
    whole, failed = sinks.failed_keys(spark.createDataFrame([("a", "x", None), ("b", "x", "y")], "k string, ref string, hyp string"), "k", "ref", "hyp")
    assert rows_of(whole, "k") == [("b",)] and rows_of(failed) == [("a",)]
    sinks.write_all(segments(spark), str(tmp_path / "all"))
    assert spark.read.json(str(tmp_path / "all" / "json")).count() == 2
    sinks.append_json(failed, str(tmp_path / "log"))
    sinks.append_json(failed, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    sinks.write_json(failed, str(tmp_path / "one"), True)
    from tidemark.functions.text import emission_line

    assert spark.range(1).select(emission_line(F.lit(1.5), F.lit(0.0), F.lit(1.0), F.lit("hi"))).first()[0] == "1500.0000 0 1000 hi"
    summary = sinks.batch_summary(spark.createDataFrame([("a", 1.0, "x", 2.0, None), ("b", 1.0, None, 4.0, None)], "file string, duration double, transcription string, first_token_latency_ms double, last_token_latency_ms double")).first()
    assert (summary["total_files"], summary["processed_files"], summary["average_first_token_latency_ms"], summary["average_last_token_latency_ms"]) == (2, 1, 3.0, None)


def test_lines_of_a_file_that_several_tasks_read(spark, tmp_path):
    for name, n in (("a.log", 3000), ("b.log", 5)):
        (tmp_path / name).write_text("\n".join(f"{name} line {k}" for k in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = files.numbered_lines(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 0
        got = sorted((r["file"], r["line_no"], r["value"]) for r in lines.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted((name, k, f"{name} line {k}") for name, n in (("a.log", 3000), ("b.log", 5)) for k in range(n))


def test_a_file_of_many_blocks_is_numbered_by_as_many_tasks(spark, tmp_path, monkeypatch):
    lines = [f"line {k} {'x' * (k % 50)}" for k in range(20_000)]
    (tmp_path / "one.log").write_text("\n".join(lines))
    size = (tmp_path / "one.log").stat().st_size
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.set(name, str(-(-size // 16)))
    try:
        for most in (files.MAX_BLOCKS, 3):
            monkeypatch.setattr(files, "MAX_BLOCKS", most)
            got = files.numbered_lines(spark, str(tmp_path / "one.log"))
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert "Window" not in plan.split("InMemoryRelation")[0] or most == 3
            if most > 3:  # no line is shuffled: each task numbers the block that it reads
                assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan.split("InMemoryRelation")[0]
                tasks = {r["t"]: r["n"] for r in got.groupBy(F.spark_partition_id().alias("t")).count().withColumnRenamed("count", "n").collect()}
                assert len(tasks) == 16 and min(tasks.values()) > 500
            assert sorted((r["line_no"], r["value"]) for r in got.collect()) == list(enumerate(lines))
    finally:
        for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(name)


def test_running_counts_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(files, "BLOCK_LINES", 7)
    import random

    rng = random.Random(5)
    rows = [(f, k, rng.choice("ab")) for f in "xyz" for k in range(0, 90, rng.choice([1, 2, 5]))] + [("n", 3, None)]
    got = files.running(spark.createDataFrame(rows, "f string, k int, v string"), "f", "k", a=F.col("v") == "a", b=F.col("v") == "b").collect()
    want = {(f, k): tuple(sum(g == f and j <= k and w == c for g, j, w in rows) for c in "ab") for f, k, _ in rows}
    assert {(r["f"], r["k"]): (r["a"], r["b"]) for r in got} == want


def test_all_writers(spark, tmp_path):
    segments = spark.createDataFrame([("f", 0.0, 1.5, " one"), ("f", 2.0, 3.0, "two-->")], "file string, start double, end double, text string")
    sinks.write_all(segments, str(tmp_path / "out"))
    read = lambda kind: "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(str(tmp_path / "out" / kind)).collect())
    assert read("srt").strip() == "1\n00:00:00,000 --> 00:00:01,500\none\n\n2\n00:00:02,000 --> 00:00:03,000\ntwo->"
    assert read("vtt").strip() == "WEBVTT\n\n00:00.000 --> 00:01.500\none\n\n00:02.000 --> 00:03.000\ntwo->"
    assert set(sinks.WRITERS) == {"txt", "vtt", "srt", "tsv", "json"}


def test_cues_of_many_short_keys(spark):
    """Words of a key are those between two changes of it, whatever the batches of rows; no group of rows is made for each."""
    rows = spark.range(40_000).selectExpr("IF(id % 4000 = 7, NULL, id % 4000) AS k", "0 AS segment", "id AS seq", "concat(' w', id % 7) AS text", "CAST(id AS double) AS start", "id + 0.5D AS end")
    got = sinks.cues(rows, "k", 8, 2)
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
    found = {}
    for r in got.orderBy("k", "seq").collect():
        found.setdefault(r["k"], []).append((r["start"], r["end"], r["text"]))
    words = lambda k: [(0, f" w{i % 7}", float(i), i + 0.5) for i in range(k, 40_000, 4000)]
    assert found == {None if k == 7 else k: sinks.cue_fold(words(k), 8, 2, 3.0) for k in range(4000)}
