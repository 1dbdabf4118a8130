import random
import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import processors as P
from tidemark.streaming.sources import PcmSource, first_of_each, sessions, tumbling
from tidemark.streaming.voice import Buffer, Detector, Router, blocks, merged, whole_characters

rng = random.Random(7)
N = 40
CASES = {
    "events": (P.VoiceEvents(), "prob double", [(rng.choice([0.1, 0.6, 0.9]),) for _ in range(N)]),
    "routing": (P.VoiceRouting(0.1), "probs array<double>, n_samples int", [([rng.choice([0.1, 0.9])] * 2, 1024) for _ in range(N)]),
    "agreement": (P.Agreement(), "text string, is_last boolean", [("abcdefgh"[: rng.randrange(9)], k == N - 1) for k in range(N)]),
    "monotone": (P.Monotone(), "beg double, end double", [(rng.random() * 9, rng.random() * 9) for _ in range(N)]),
    "lines": (P.ChangedLine(), "line string", [(rng.choice("ab"),) for _ in range(N)]),
    "characters": (P.CharacterCarry(), "raw binary", [(bytearray([b]),) for b in "né日😀".encode() * 4][:N]),
    "retention": (P.Retention(3.0), "length double", [(rng.random() * 2,) for _ in range(N)]),
    "context": (P.ContextBuffer(5), "text string, is_last boolean", [(f"w{k} x", k % 9 == 8) for k in range(N)]),
}


@pytest.mark.parametrize("name", CASES)
def test_stream_equals_batch(spark, tmp_path, name):
    operator, schema, values = CASES[name]
    rows = [(s, k, *v) for s in ("a", "b") for k, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"s string, k int, {schema}")
    want = sorted(map(tuple, P.batch(df, operator, "s", "k").collect()))
    for part, (lo, hi) in enumerate([(0, 7), (7, 8), (8, N)]):
        df.where(f"k >= {lo} AND k < {hi}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p={part}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p=*"))
    query = P.stream(stream, operator, "s", "k").writeStream.format("memory").queryName(f"t_{name}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table(f"t_{name}").collect())) == want


def test_detector():
    d = Detector()
    events = [d.step(p) for p in [0.9] * 3 + [0.6] * 40 + [0.1] * 17]
    assert [e for e in events if e] == [("start", 0), ("end", 44 * 512 + 1600 - 512)]
    assert merged([("start", 5), ("end", 9), ("start", 12)]) == {"start": 5}
    assert merged([("end", 3), ("end", 8)]) == {"end": 8} and merged([None]) == {}
    assert [len(b) for b in blocks([0.0] * 511, [0.0] * 514)[0]] == [512, 512] and len(blocks([], [0.0] * 511)[1]) == 511


def test_router():
    r = Router()
    assert r.step(20000, {}) == [] and (r.offset, r.size) == (4000, 16000)
    assert r.step(1000, {"start": 20500}) == [("init", 20500, 20500), ("send", 20500, 21000)]
    assert r.trigger(0.01) == "run" and r.trigger(0.01) == "wait"
    assert r.step(1000, {}) == [("send", 21000, 22000)]
    assert r.step(1000, {"end": 22400}) == [("send", 22000, 22400)] and r.size == 600
    assert r.trigger(1.0) == "finish" and r.offset == 0
    assert Router().step(1000, {"start": 100, "end": 300}) == [("init", 100, 100), ("send", 100, 300)]


def test_carried_characters():
    raw, held, out = "aé日😀".encode(), b"", ""
    for b in raw:
        text, held = whole_characters(held, bytes([b]))
        out += text
    assert out == "aé日😀" and held == b""
    assert whole_characters(b"", b"\xff\xff\xff\xff\xff")[1] == b""


def test_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch = {(r["start"], r["event_type"]): r["n"] for r in tumbling(events, "ts", "1 day", "event_type").collect()}
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events*.parquet")
    q = tumbling(stream, "ts", "1 day", "event_type").writeStream.format("memory").queryName("t_windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("t_windows").collect()}
    assert got and all(batch[k] == n for k, n in got.items())
    assert len(batch) - len(got) <= 5  # the last window is still open
    assert sum(r["n"] for r in sessions(events, "ts", "6 hours", "user_id").collect()) == events.count()
    assert sum(r["n"] for r in tumbling(events, "ts", "1 day", slide="12 hours").collect()) == 2 * events.count()
    q = first_of_each(stream, "ts", ["user_id"]).writeStream.format("memory").queryName("t_first").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("t_first").count() == events.select("user_id").distinct().count() == first_of_each(events, "ts", ["user_id"]).count()


def test_pcm_keeps_samples_aligned_and_waits_for_enough():
    from tidemark.streaming.sources import _PcmReader

    server = socket.create_server(("127.0.0.1", 0))
    reader = _PcmReader({"host": "127.0.0.1", "port": str(server.getsockname()[1]), "min_chunk": "0.01"})  # 320 bytes
    sent = bytes(k % 251 for k in range(1001))
    offset, got = reader.initialOffset(), []

    def more() -> bytes:
        nonlocal offset
        rows, offset = reader.read(offset)
        got.append(b"".join(r[1] for r in rows))
        return got[-1]

    links: list = []
    threading.Thread(target=lambda: links.append(server.accept()[0]), daemon=True).start()
    assert more() == b""
    links[0].sendall(sent[:101])
    assert more() == b""  # too little, and a timeout gives nothing out
    links[0].sendall(sent[101:501])
    assert len(more()) == 500  # the odd byte waits
    links[0].sendall(sent[501:])
    links[0].close()
    while len(more()):
        pass
    assert b"".join(got) == sent[:1000] and offset == {"bytes": 1000}


def test_pcm_socket(spark, tmp_path):
    server = socket.create_server(("127.0.0.1", 0))
    sent = bytes(range(256)) * 40

    def serve():
        link, _ = server.accept()
        link.sendall(sent + b"\x01")
        time.sleep(8)
        link.close()

    threading.Thread(target=serve, daemon=True).start()
    spark.dataSource.register(PcmSource)
    rows = spark.readStream.format("pcm_socket").option("host", "127.0.0.1").option("port", server.getsockname()[1]).option("min_chunk", "0.1").load()
    q = rows.writeStream.format("memory").queryName("t_pcm").option("checkpointLocation", str(tmp_path)).start()
    until = time.time() + 40
    while time.time() < until and sum(len(r["pcm"]) for r in spark.table("t_pcm").collect()) < len(sent):
        time.sleep(0.5)
    q.stop()
    got = sorted(spark.table("t_pcm").collect(), key=lambda r: r["first_sample"])
    assert b"".join(bytes(r["pcm"]) for r in got) == sent


def test_sessions_of_two_connections(spark, tmp_path):
    """Two connections side by side: one falls quiet and is ended by its timer while the other goes on; it comes back, and is closed by a row."""
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from tidemark.streaming import connections as C

    began = datetime(2024, 1, 1)
    rows, texts = [], ["one", "one two", "one two thr", "one two three"]
    for k in range(40):  # a speaks at 0-3 s and again from 30 s on; b speaks all the time
        if k < 4 or 30 <= k < 33:
            rows.append(("a", k, began + timedelta(seconds=k), texts[k % 4], k == 32))
        rows.append(("b", k, began + timedelta(seconds=k), f"{'so ' * k}", False))
    df = spark.createDataFrame(rows, "s string, k int, t timestamp, text string, shut boolean").withColumn("is_last", F.lit(False))
    how = dict(operator=P.Agreement(), key="s", order="k", time="t", quiet_ms=10_000, closes=F.col("shut"))
    want = sorted(map(str, C.batch(df, **how).collect()))
    for part in range(8):
        df.where(f"k >= {5 * part} AND k < {5 * part + 5}").coalesce(1).write.parquet(str(tmp_path / "in" / f"p={part}"))
        time.sleep(0.05)
    seen = []

    def batch_of(out, number):
        seen.extend((number, r) for r in out.collect())

    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "p=*"))
    query = C.stream(stream, **how).writeStream.foreachBatch(batch_of).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = [r for _, r in seen]
    ends = {(r["s"], r["session"]): (n, r["ended"]) for n, r in seen if r["ended"]}
    assert ends["a", 0][1] == "quiet" and ends["a", 1][1] == "closed" and ("b", 0) not in ends
    came_back = min(n for n, r in seen if r["s"] == "a" and r["session"] == 1)
    assert ends["a", 0][0] < came_back  # the timer ended it, not the row that came back
    open_b = [x for x in want if x not in set(map(str, got))]
    assert sorted(map(str, got)) == [x for x in want if x not in open_b] and all("s='b'" in x for x in open_b)


def test_sessions_end_by_the_clock_and_their_state_expires(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.streaming import connections as C

    def add(k, s):
        spark.createDataFrame([(s, k, f"text {s}")], "s string, k int, text string").withColumn("t", F.current_timestamp()).withColumn("is_last", F.lit(False)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    add(0, "a")
    stream = spark.readStream.schema("s string, k int, text string, t timestamp, is_last boolean").parquet(str(tmp_path / "in"))
    out = C.stream(stream, P.Agreement(), "s", "k", "t", 1500, by_clock=True, keep_ms=4000)
    query = out.writeStream.format("memory").queryName("t_clock").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    until, k = time.time() + 90, 1
    sessions = lambda: {(r["s"], r["session"]): r["ended"] for r in spark.table("t_clock").where("ended IS NOT NULL").collect()}
    while time.time() < until and ("a", 0) not in sessions():
        add(k, "b")  # rows of another connection: batches, in which timers fire
        k, _ = k + 1, time.sleep(1)
    assert sessions().get(("a", 0)) == "quiet"
    assert [r["delta"] for r in spark.table("t_clock").where("s = 'a' AND delta IS NOT NULL").collect()] == ["text a"]
    time.sleep(5)  # longer than what is left of it lives
    add(1000, "a")
    while time.time() < until and spark.table("t_clock").where("s = 'a' AND ended IS NOT NULL").count() < 2:
        add(k, "b")
        k, _ = k + 1, time.sleep(1)
    query.stop()
    assert sorted(r["session"] for r in spark.table("t_clock").where("s = 'a' AND ended IS NOT NULL").collect()) == [0, 0]  # the number was forgotten


def test_retention_of_lengths_that_make_the_most_but_for_rounding():
    """Six lengths that make 30 s, of which floats make a little more, stay."""
    b, gone = Buffer(30.0), 0.0
    for x in (71.81, 89.95, 173.68, 176.06, 64.05, 24.45):
        gone += b.add(x / 20)
    assert gone == 0.0 and len(b.lengths) == 6
    assert b.add(0.001) == 71.81 / 20


def test_batch_of_many_short_streams(spark):
    """Streams end where the key changes, in the middle of a batch of rows or at its border; a null key is one stream; no group of rows is made."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 5000 > 0, F.col("id") % 5000).alias("s"), F.col("id").alias("k"), F.lit("x").alias("line"))
    got = P.batch(rows, P.ChangedLine(), "s", "k")
    assert got.agg(F.count("*"), F.max("k"), F.count_if(F.col("s").isNull())).first() == (5000, 4999, 1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan
