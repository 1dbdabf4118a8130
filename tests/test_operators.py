import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import commit, evaluate, prepare, segment, select, timing
from tidemark.plans import plugins


def rows_of(df, *names):
    return sorted(tuple(r) for r in (df.select(*names) if names else df).collect())


def test_evaluation(spark):
    refs = spark.createDataFrame([("a/x.wav", "one two"), ("b/y.wav", "three"), ("c/x.wav", "later wins")], "p string, reference string").withColumn("n", F.monotonically_increasing_id())
    keyed = evaluate.dual_keyed(refs, "p", "n").select("file", "reference")
    assert dict(rows_of(keyed)) == {"x.wav": "later wins", "x": "later wins", "y.wav": "three", "y": "three"}
    hyps = spark.createDataFrame([("x.wav", "later won")], "file string, generated string")
    pairs = evaluate.matched(keyed, hyps)
    metrics = evaluate.metric_rows(pairs, F.lit("en"))
    late = spark.createDataFrame([("x.wav", 0.5, 0.0)], "file string, first_token_latency double, last_token_latency double")
    got = evaluate.summary(pairs, evaluate.with_latencies(metrics, late)).first()
    assert (got["total_files"], got["matched_files"], got["unmatched_files"], got["average_mer"]) == (4, 1, 3, 0.5)
    assert (got["average_first_token_latency_ms"], got["average_last_token_latency_ms"]) == (500.0, None)
    assert evaluate.summary(pairs.where("1 = 0"), metrics.where("1 = 0")).first()["average_cer"] == 0.0


def test_as_of(spark):
    left = spark.createDataFrame([(1, 1.0), (1, 5.0), (2, 1.0)], "k int, t double")
    right = spark.createDataFrame([(1, 1.0, "a"), (1, 4.0, "b"), (2, 2.0, "c")], "k int, s double, v string")
    assert sorted(((r["k"], r["t"], r["v"]) for r in evaluate.as_of(left, right, "k", "t", "s", "v").collect()), key=str) == [(1, 1.0, "a"), (1, 5.0, "b"), (2, 1.0, None)]


def test_hysteresis_equals_the_fold(spark):
    rng = random.Random(1)
    rows = [(s, k, rng.choice([0.1, 0.6, 0.9]), float(k)) for s in range(5) for k in range(120)]
    want = []
    for s in range(5):
        on, low = False, None
        for _, k, p, t in (r for r in rows if r[0] == s):
            if p >= 0.7:
                low = None
                if not on:
                    on = True
                    want.append((s, "start", t))
            elif p < 0.55 and on:
                low = t if low is None else low
                if t - low >= 3:
                    want.append((s, "end", low))
                    on, low = False, None
    df = spark.createDataFrame(rows, "s int, k int, p double, t double")
    assert rows_of(segment.hysteresis(df, "s", "k", F.col("p") >= 0.7, F.col("p") < 0.55, F.col("t"), 3.0)) == sorted(want)


def test_chunks(spark):
    df = spark.createDataFrame([(1, 2.5), (2, 0.4), (3, 2.0)], "id int, d double")
    got = rows_of(segment.chunks(df, "d", 1.0), "id", "beg", "end")
    assert got == [(1, 0.0, 1.0), (1, 1.0, 2.0), (1, 2.0, 2.5), (2, 0.0, 1.0), (3, 0.0, 1.0), (3, 1.0, 2.0)]


def test_budget_pairs_and_triggers(spark):
    df = spark.createDataFrame([("a", k, n) for k, n in enumerate([5, 4, 3, 2, 1])], "s string, k int, n int")
    assert rows_of(segment.within_budget(df, "s", ["k"], "n", 7), "k") == [(2,), (3,), (4,)]
    assert rows_of(segment.within_budget(df, "s", ["k"], "n", 8, F.col("k") == 0), "k") == [(0,), (3,), (4,)]
    assert rows_of(segment.triggered(df, "s", "k", "n", 6.0), "k", "runs") == [(0, False), (1, True), (2, False), (3, False), (4, False)]
    flags = spark.createDataFrame([("a", k, k in (0, 3, 4, 6)) for k in range(8)], "s string, k int, f boolean")
    assert [r[1] for r in rows_of(segment.pair_segments(flags, "s", ["k"], F.col("f")), "k", "segment")] == [0, 0, 0, 0, 1, 1, 1, 1]
    assert rows_of(segment.last_of_subgroup(df.withColumn("g", F.col("k") % 2), "s", "g", "k", 1), "k") == [(3,)]
    assert len(rows_of(segment.jumps(df.withColumn("v", F.lit(1)), "s", "k", "v"))) == 1


def test_agreement(spark):
    df = spark.createDataFrame([("s", k, t, last) for k, (t, last) in enumerate([("hello wor", False), ("hello world is", False), (" ", False), ("hello world was", False), ("jello world was big", True)])], "s string, k int, text string, is_last boolean")
    got = [r[2] for r in rows_of(commit.local_agreement(df, "s", "k", "text", "is_last"))]
    assert got == ["", "hello wor", "", "ld ", "was big"]
    assert commit.common_prefix("", "x") == "" and commit.after_longest_match("abc", "xyz") == "xyz"


def test_committed_text_only_grows():
    rng = random.Random(3)
    state, emitted = ("", ""), ""
    for _ in range(200):
        full = "".join(rng.choices("ab ", k=rng.randrange(1, 12)))
        state, delta = commit.agreement_step(state, full, rng.random() < 0.1)
        emitted += delta
        assert state[1] == emitted


def test_cuts_and_words(spark):
    steps = spark.createDataFrame([("s", k, f, 100) for k, f in enumerate([10, 50, 85, 20])], "s string, k int, frame int, content int")
    assert rows_of(commit.attention_cut(steps, "s", "k", "frame", "content", 20), "k") == [(0,), (1,)]
    assert rows_of(commit.attention_cut(steps, "s", "k", "frame", "content", 20, F.lit(True)), "k") == [(0,), (1,), (2,), (3,)]
    assert rows_of(commit.rewind_cut(steps, "s", "k", "frame", 40), "k") == [(0,), (1,), (2,)]
    w = F.array(F.lit("a"), F.lit("b"))
    got = spark.range(1).select(commit.committed_words(w, F.lit(False), F.lit(False)).alias("a"), commit.committed_words(w, F.lit(True), F.lit(False)).alias("b"), commit.committed_words(F.array(F.lit("a")), F.lit(False), F.lit(False)).alias("c")).first()
    assert list(got) == [["a"], ["a", "b"], []]
    words = F.array(F.struct(F.lit("x").alias("text"), F.array(F.lit(1), F.lit(2)).alias("tokens")), F.struct(F.lit("y").alias("text"), F.array(F.lit(3)).alias("tokens")))
    t = spark.range(1).select(commit.word_times(words, F.array(F.lit(10), F.lit(20)), F.lit(1.0))).first()[0]
    assert [(round(x["start"], 3), round(x["end"], 3)) for x in t] == [(1.2, 1.2), (1.4, 1.4)]


def test_monotone(spark):
    df = spark.createDataFrame([("s", 0, 1.0, 2.0), ("s", 1, 1.5, 1.6), ("s", 2, 9.0, 9.0)], "s string, k int, b double, e double")
    got = rows_of(commit.monotone(df, "s", "k", "b", "e"))
    assert np.allclose([r[2:] for r in got], [(1, 2), (2.001, 2.002), (9, 9.001)])


def test_selection(spark):
    beams = spark.createDataFrame([("a", b, t, s, [b]) for b, t, s in [(0, 1, -0.1), (0, 9, -0.2), (0, 2, -0.9), (0, 3, -1.5), (1, 1, -0.3), (1, 2, -0.4)]], "key string, beam int, token int, score double, seq array<int>")
    going, done = select.beam_step(beams, "key", "beam", "token", "score", "seq", 2, 9)
    assert rows_of(going, "beam", "seq") == [(0, [0, 1]), (1, [1, 1])] and rows_of(done, "seq") == [([0, 9],)]
    final = select.finalised(done, going, "key", "score", "seq", 2, 9)
    assert rows_of(final, "seq") == [([0, 1, 9],), ([0, 9],)]
    tries = spark.createDataFrame([("a", 0.0, "x", False), ("a", 0.2, "y", True), ("b", 0.0, "z", False), ("b", 0.2, "w", False)], "key string, t double, r string, ok boolean")
    assert rows_of(select.ladder(tries, "key", "t", F.col("ok"), "r"), "key", "r") == [("a", "y"), ("b", "w")]
    picks = spark.createDataFrame([("a", 0, -2.0, 1), ("a", 1, -2.0, 1), ("a", 2, -3.0, 4)], "key string, i int, lp double, n int")
    assert rows_of(select.ranked_best(picks, "key", "i", "lp", "n"), "i") == [(2,)]
    lang = spark.createDataFrame([("a", "en", 1.0), ("a", "zh", 2.0), ("a", "xx", 9.0)], "key string, language string, x double")
    got = select.detected_language(lang, "key", "language", "x", ["en", "zh"]).first()
    assert got["language"] == "zh" and math.isclose(sum(got["probabilities"].values()), 1)
    assert rows_of(select.greedy(lang.withColumn("t", F.length("language") + F.col("x").cast("int")), "key", "t", "x"), "t") == [(11,)]


def test_preparation(spark):
    words = lambda s: F.array(*map(F.lit, s.split()))
    got = spark.range(1).select(
        prepare.best_offset(words("a b c"), words("x y a b c d")).alias("o"), prepare.best_offset(words("q"), words("z")).alias("p"), prepare.python_slice(words("a b c d"), F.lit(-2), F.lit(9)).alias("s"),
        prepare.continuation(F.lit("ni hao"), F.lit("ni hao ma ya"), F.array(F.lit(""), F.lit("ni hao ma"))).alias("c"), prepare.continuation(F.lit("a"), F.lit("b"), F.array().cast("array<string>")).alias("n"),
    ).first()
    assert list(got) == [2, 0, ["c", "d"], " MA", ""]
    df = spark.range(1000).withColumnRenamed("id", "k")
    train, valid = prepare.split(df, "k", 0.1)
    assert train.count() + valid.count() == 1000 and 60 < valid.count() < 140
    assert prepare.sample(df, "k", 7).count() == 7
    assert sorted(r["copy"] for r in prepare.repeated(df.where("k = 3"), F.col("k")).collect()) == [1, 2, 3]
    assert prepare.weighted_union([(df.limit(2), 3), (df.limit(1), 0)]).count() == 7
    assert [r[1] for r in rows_of(prepare.dealt(df, "k", 3), "k", "worker")] == [k % 3 for k in range(1000)]
    batch = spark.createDataFrame([(1, [5, 6, 7], 1), (1, [8], 0)], "b int, ids array<int>, p int")
    assert rows_of(prepare.collated(batch, "b", "ids", "p", 0), "input_ids", "attention_mask", "labels") == [([5, 6, 7], [1, 1, 1], [-100, 6, 7]), ([8, 0, 0], [1, 0, 0], [8, -100, -100])]


def test_samples_become_instructions(spark):
    chunk = spark.createDataFrame([("f", 1.0, "ni hao", ["ni hao ma�"], "ni hao ma ya")], "audio_path string, end double, previous_transcript string, topk array<string>, ref string")
    got = prepare.correction_samples(chunk, "ref", 4, 500)
    row = prepare.instruction_rows(got, True).first()
    assert row["response"] == " MA" and "1. NI HAO MA" in row["instruction"] and row["timestamp"] == 1.0


def test_word_timing():
    w = timing.Word
    merged = timing.merge_punctuation([w(" \"", 0, 0), w("Hi", 0, 1), w(",", 1, 1), w(" you", 1, 2), w(".", 2, 2)])
    assert [x.text for x in merged] == [' "Hi,', " you."]
    long = [w("a", 0, 1), w(".", 1, 9), w("b", 9, 30)]
    assert [(x.start, x.end) for x in timing.shorten(long, 2)] == [(0, 1), (1, 3), (28, 30)]
    assert timing.duration_limits([]) == (0.0, 0.0)
    words, start, end = timing.reconcile([w("a", 1.0, 2.0), w("b", 2.0, 3.0)], 0.8, 3.2, 0.0, 0.5)
    assert (start, end) == (1.0, 3.0) and len(words) == 2


def plain_edges(words, start, end, last_speech, median):
    """The survey's account of a segment's edges, on lists of [start, end]."""
    t = [list(x) for x in words]
    limit = 2 * median
    if t[0][1] - last_speech > 4 * median and (t[0][1] - t[0][0] > limit or (len(t) > 1 and t[1][1] - t[0][0] > 2 * limit)):
        if len(t) > 1 and t[1][1] - t[1][0] > limit:
            t[0][1] = t[1][0] = max(t[1][1] / 2, t[1][1] - limit)
        t[0][0] = max(0, t[0][1] - limit)
    if start < t[0][1] and start - 0.5 > t[0][0]:
        t[0][0] = max(0, min(t[0][1] - median, start))
    else:
        start = t[0][0]
    if end > t[-1][0] and end + 0.5 < t[-1][1]:
        t[-1][1] = max(t[-1][0] + median, end)
    else:
        end = t[-1][1]
    return t, start, end


def test_segment_edges_against_a_plain_account():
    import random

    rng = random.Random(8)
    for _ in range(3000):
        times, at = [], rng.random() * 6
        for _ in range(rng.randrange(1, 5)):
            stop = at + rng.choice([0.1, 0.3, 1.0, 4.0]) * rng.random()
            times.append((at, stop))
            at = stop + rng.choice([0, 0.2])
        start, end = times[0][0] + rng.uniform(-1, 2), times[-1][1] + rng.uniform(-2, 1)
        last, median = rng.choice([0.0, times[0][0] / 2]), rng.choice([0.1, 0.4])
        words, a, b = timing.reconcile([timing.Word("x", *x) for x in times], start, end, last, median)
        want = plain_edges(times, start, end, last, median)
        assert [x for w in words for x in (w.start, w.end)] + [a, b] == pytest.approx([x for w in want[0] for x in w] + list(want[1:]))


def test_long_words_keep_their_median():
    words = [timing.Word("a", 0, 1.0), timing.Word("b", 1, 2.0), timing.Word("", 2, 2)]
    assert timing.duration_limits(words) == (1.0, 2.0)


def test_windows_of_files_as_rows(spark):
    begin = 100

    def decoder():
        return lambda key, seek, size: {"tokens": [begin, 1, begin + 40 + key, begin + 40 + key]} if key < 3 else {"tokens": [1], "no_speech_prob": 0.9, "avg_logprob": -2.0}

    files = spark.createDataFrame([(k, 300) for k in range(4)], "file long, frames int")
    got = rows_of(timing.windowed(files, "file", "frames", decoder, begin, window=150))
    want = {(k, x["id"], x["seek"], x["start"], x["end"], tuple(x["tokens"])) for k in range(3) for x in timing.seek_windows(lambda s, n, k=k: decoder()(k, s, n), 300, begin, 150)}
    assert {(*r[:5], tuple(r[5])) for r in got} == want and len(want) > 6


def test_waiting_and_refreshing(spark):
    rows = spark.createDataFrame([("a", k, 0.4, k in (2, 5), k == 5, "en" if k in (1, 6) else None) for k in range(8)], "key string, k int, s double, reset boolean, whole boolean, lang string")
    assert [r["ready"] for r in segment.waits(rows, "key", "k", "s", 1.0).orderBy("k").collect()] == [False, False] + [True] * 6
    got = segment.refreshed(rows, "key", "k", F.col("reset"), "lang", F.col("whole")).orderBy("k").collect()
    assert [(r["segment"], r["step"], r["detected"], r["is_first"]) for r in got] == [(0, 0, None, True), (0, 1, "en", False), (1, 0, None, False), (1, 1, None, False), (1, 2, None, False), (2, 0, None, True), (2, 1, "en", False), (2, 2, "en", False)]
    assert segment.long_enough(spark.createDataFrame([(1, 1599), (2, 1600)], "k int, n int"), "n").count() == 1


def test_token_cuts_and_windows():
    B = 100
    assert timing.cut_tokens([B, 1, B + 5, B + 5, 2, B + 9, B + 9], B, 0.0, 30.0, 3000)[1] == 18
    segments, step = timing.cut_tokens([B, 1, B + 50], B, 10.0, 30.0, 3000)
    assert segments == [(10.0, 11.0, [B, 1, B + 50])] and step == 3000
    made = timing.seek_windows(lambda seek, size: {"tokens": [B, 1, B + 100, B + 100]}, 1000, B, window=500)
    assert [m["seek"] for m in made] == [0, 200, 400, 600, 800] and made[1]["start"] == 2.0
    assert timing.seek_windows(lambda seek, size: {"tokens": [1], "no_speech_prob": 0.9, "avg_logprob": -2.0}, 1000, B, window=500) == []


def test_alignment_follows_the_diagonal():
    a = np.full((2, 4, 40), -5.0)
    for t in range(4):
        a[:, t, t * 10 : t * 10 + 10] = 5.0
    spans = timing.align_tokens(a, [2, 1])
    assert spans[0][0] == 0.0 and abs(spans[1][0] - 0.4) < 0.07


def test_repair_per_file(spark):
    rows = [("f", 0, 0.0, 2.0, k, t, s, e) for k, (t, s, e) in enumerate([(" a", 0.0, 1.0), (" b", 1.0, 1.8), (".", 1.8, 2.0)])]
    df = spark.createDataFrame(rows, "f string, segment long, seg_start double, seg_end double, seq long, text string, start double, end double")
    assert [r[3] for r in rows_of(timing.repaired(df, "f"))] == [" a", " b."]


def test_beam_decoder(spark):
    decoder = plugins.BeamDecoder("key", 2, 0)
    first = spark.createDataFrame([("a", 0, t, s, [9]) for t, s in ((1, -1.0), (2, -2.0), (0, -3.0), (3, -4.0))], "key string, beam int, token int, score double, seq array<int>")
    going = decoder.update(first)
    assert [(r["beam"], r["seq"], r["score"]) for r in going.orderBy("beam").collect()] == [(0, [9, 1], -1.0), (1, [9, 2], -2.0)]
    steps = [(r["beam"], t, r["score"] + s, r["seq"]) for r in going.collect() for t, s in ((0, -0.5), (4, -0.7))]
    decoder.update(spark.createDataFrame([("a", *x) for x in steps], first.schema))
    assert decoder.complete().count() == 1
    assert [(r["seq"], r["score"]) for r in decoder.finalise().orderBy(F.desc("score")).collect()] == [([9, 1, 0], -1.5), ([9, 2, 0], -2.5)]
    decoder.reset()
    one = plugins.GreedyDecoder("key", 0)
    one.update(first)
    assert one.finished.count() == 0 and [r["seq"] for r in one.finalise().collect()] == [[9, 1, 0]]
    decoder.reset()
    assert decoder.finished is None


def test_places_in_order(spark):
    rows = [(k * 7919 % 1009, str(k)) for k in range(1009)] + [(None, "x")]
    got = prepare.ranked(spark.createDataFrame(rows, "k int, s string").repartition(5), "k").collect()
    assert sorted((r["place"], r["k"]) for r in got) == [(0, None)] + [(k + 1, k) for k in range(1009)]
    by_text = prepare.ranked(spark.createDataFrame(rows, "k int, s string"), "s").collect()
    assert [r["s"] for r in sorted(by_text, key=lambda r: r["place"])] == sorted(s for _, s in rows)
    assert prepare.ranked(spark.createDataFrame([], "k int"), "k").count() == 0


def test_plugins(spark):
    @plugins.scorer("double")
    def factory(by=2):
        return lambda batch: batch.assign(y=batch["x"] * by)

    assert rows_of(plugins.scored(spark.createDataFrame([(1,), (2,)], "x long"), "double", "x long, y long", by=3)) == [(1, 3), (2, 6)]
    assert plugins.agreed_extension("ab", ["abcd", "abce", "x", " "]) == "c"
    df = spark.createDataFrame([("ab", ["abcd", "abcd"])], "p string, c array<string>")
    assert plugins.corrected(df, "p", "c").first()["correction"] == "cd"
    assert plugins.with_fallback(lambda x: 1 / 0, lambda x: [x])("q") == [(0, "q")]
    got = plugins.guarded(spark.createDataFrame([(1,), (0,)], "x long"), "x", lambda r: {"y": 6 // int(r["x"])}, {"y": "long"}).collect()
    assert {(r["x"], r["error"] is None) for r in got} == {(1, True), (0, False)}


def test_latencies(spark):
    df = spark.createDataFrame([("s", 0, 9.0, 0.0, True), ("s", 1, 3.0, 1.0, False), ("s", 2, 8.0, 4.0, False)], "s string, k int, e double, r double, w boolean")
    assert rows_of(evaluate.latencies(df, "s", "e", "r", "k", "w")) == [("s", 2.0, 4.0)]
    assert spark.range(1).select(evaluate.corrected_latency(F.lit(5.0), F.lit(4.0), F.lit(3))).first()[0] == pytest.approx(2.0)


def test_options(tmp_path):
    from tidemark.plans import config

    options = config.DecodeOptions(beam_size=4, patience=1.5)
    config.save(options, str(tmp_path / "o.json"))
    assert config.load(config.DecodeOptions, str(tmp_path / "o.json")) == options and options.max_candidates == 6
    for bad in ({"beam_size": 2, "best_of": 2}, {"patience": 1.0}, {"length_penalty": 2.0}):
        with pytest.raises(ValueError):
            config.DecodeOptions(**bad)
    with pytest.raises(ValueError):
        config.StreamOptions(min_chunk=0)


def test_cleared_and_nested_summary(spark):
    rows = spark.createDataFrame([(0.0, 1.0, "a", [1]), (1.0, 1.0, "b", [2]), (1.0, 2.0, " ", [3])], "start double, end double, text string, tokens array<int>")
    assert rows_of(select.cleared(rows), "text", "tokens") == [("", []), ("", []), ("a", [1])]
    pairs = spark.createDataFrame([("x", "a b", "a b", True), ("y", "q", None, False)], "file string, reference string, generated string, is_matched boolean")
    got = evaluate.summary(pairs, evaluate.metric_rows(pairs, F.lit("en")), per_file=True).first()
    assert (got["total_files"], got["matched_files"], [r["file"] for r in got["per_file_results"]]) == (2, 1, ["x"])


def test_counted(spark):
    from tidemark.sources.files import counted

    rows, seen = counted(spark.range(10), "c", odd=F.col("id") % 2 == 1)
    assert rows.count() == 10 and seen.get == {"rows": 10, "odd": 5}
