"""Queries over whole texts and all rows, against brute force on a small fixture."""

import random
import re

import pytest

from tidemark.plans import catalogue


def distance(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def worse(words: list[str]) -> list[str]:
    return [w.replace("e", "a") if k % 3 == 0 else w for k, w in enumerate(words) if k % 5 != 4]


@pytest.fixture(scope="module")
def talks():
    """(conv_id, turn, words): 0 to 130 words, with no letter e, and so no changed word, before word 20."""
    rng = random.Random(3)
    rows = []
    for conv in range(4):
        for turn in range(3):
            n = rng.choice([0, 3, 25, 60, 130])
            rows.append((conv, turn, [rng.choice(["sand", "wind", "moon"] if k < 20 else ["tree", "sea", "be", "sun", "seen"]) + str(rng.randrange(60)) for k in range(n)]))
    return rows


@pytest.fixture(scope="module")
def folder(spark, talks, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(c, t, "user", " ".join(w)) for c, t, w in talks], "conv_id long, turn int, role string, text string").write.parquet(f"{out}/conversations.parquet")
    return out


def run(spark, name, folder):
    return catalogue.queries()[name](spark, folder).collect()


def test_mixed_error_rate_of_whole_texts(spark, talks, folder):
    want = {(c, t): (len(w), len(worse(w)), distance(w, worse(w))) for c, t, w in talks}
    rows = run(spark, "q_mer_rows", folder)
    assert {(r["conv_id"], r["turn"]): (r["n_ref"], r["n_hyp"], r["edits"]) for r in rows} == want
    (mean,) = run(spark, "q_mer_summary", folder)
    rates = [e / n if n else 0.0 for (_, t), (n, _, e) in want.items() if t % 4 != 3]
    assert mean["total_files"] == len(want) and abs(mean["average_mer"] - sum(rates) / len(rates)) < 1e-6


def test_distances_of_many_distinct_tokens(spark):
    """From 20,000 distinct tokens on, characters of the other planes stand for them; a table would take too long."""
    from pyspark.sql import functions as F

    from tidemark.functions import edit

    a = F.transform(F.sequence(F.lit(1), F.lit(20_001)), lambda x: x.cast("string"))
    b = F.concat(F.array(F.lit("0")), F.slice(a, 1, 10_000), F.slice(a, 10_002, 10_000))
    assert spark.range(1).select(edit.token_distance(a, b)).first()[0] == 2


def test_long_token_distance_of_whole_texts(spark, talks, folder):
    rows = [r for r in run(spark, "q_token_distance_long", folder) if r["turn"] == 0]
    assert {r["conv_id"]: r["edits"] for r in rows} == {c: distance(w, worse(w)) for c, t, w in talks if t == 0}


def test_long_token_distance_of_long_arrays(spark):
    """A fold over a table of 400 million cells would not end; the one for use inside lambdas agrees on short arrays."""
    from pyspark.sql import functions as F

    from tidemark.functions import edit

    a = F.transform(F.sequence(F.lit(1), F.lit(20_001)), lambda x: x.cast("string"))
    b = F.concat(F.array(F.lit("0")), F.slice(a, 1, 10_000), F.slice(a, 10_002, 10_000))
    assert spark.range(1).select(edit.token_distance_long(a, b)).first()[0] == 2
    rows = [(list(x), list(y)) for x, y in (("kitten", "sitting"), ("", "abc"), ("abc", ""), ("", ""), ("aaaabbbbcccc", "ccccbaabbaaaa"), ("x", "yyyyyyyyxyyyyyyyy"))]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(edit._folded_distance(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [distance(x, y) for x, y in rows]


def test_word_times_of_many_words(spark):
    """200,000 words in time that grows with them; the square of it would not end. Words of no token end where the one before does."""
    from pyspark.sql import functions as F

    from tidemark.operators import commit

    n = 200_000
    words = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.struct(k.cast("string").alias("text"), F.array_repeat(F.lit(7), (k % 3).cast("int")).alias("tokens")))
    got = spark.range(1).select(F.sequence(F.lit(1), F.lit(n + 1)).alias("f"), words.alias("w")).select(F.inline(commit.word_times("w", "f", F.lit(0.0), 1.0))).agg(F.sum("start"), F.sum("end"), F.count("*"), F.max_by("end", F.col("text").cast("int"))).first()
    upto, starts, ends = 0, 0.0, 0.0
    for k in range(1, n + 1):
        starts, upto = starts + upto + 1, upto + k % 3
        ends += upto
    assert list(got) == [starts, ends, n, upto]


def test_candidates_and_words_of_whole_texts(spark, talks, folder):
    by = {(c, t): w for c, t, w in talks}
    got = {r["conv_id"]: r["top"] for r in run(spark, "q_kbest", folder)}
    assert got == {c: next((x for t in range(3) if (x := " ".join(worse(by[c, t])))), "") for c in range(4)}
    got = {(r["conv_id"], r["turn"]): r["n"] for r in run(spark, "q_last_word", folder)}
    assert got == {(c, t): len(w) if t % 2 == 0 else max(0, len(w) - 1) for c, t, w in talks}


def test_character_error_rate_of_whole_texts(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["The", "fox", "mixes", "a", "path,", "stone"]) for _ in range(n)) for n in (1, 5, 60, 400)] + ["y" * 300 + "x" * 90, "ab", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plain = lambda t: re.sub(r"[!-/:-@\[-`{-~]", "", t.strip().lower()).strip()
    want = {}
    for k, t in enumerate(texts):
        r, h = plain(t or ""), plain((t or "")[2:].replace("x", "ks"))
        if r and h:
            want[k] = (len(r), round(distance(r, h) / len(r), 6))
    got = {r["doc_id"]: (r["n_ref"], r["cer"]) for r in run(spark, "q_cer_rows", tmp_path)}
    assert got == want and max(n for n, _ in want.values()) > 1000


def test_close_distance_at_each_width(spark):
    from pyspark.sql import functions as F

    from tidemark.functions import edit

    rows = [("a" * n, "a" * (n - k) + "b" * k) for n, k in ((10, 3), (100, 17), (400, 300), (1300, 1250), (1, 0))] + [("", "x" * 200), ("x" * 20, "")]
    got = spark.createDataFrame(rows, "a string, b string").select(edit.close_distance("a", "b").alias("d"), F.levenshtein("a", "b").alias("w")).collect()
    assert [r["d"] for r in got] == [r["w"] for r in got]


def test_pieces_and_cues_hold_all_words(spark, talks, folder):
    got = {(r["conv_id"], r["turn"]): r["words"].replace("|", "") for r in run(spark, "q_words_from_pieces", folder)}
    assert got == {(c, t): " ".join(w) for c, t, w in talks if w}
    rows = sorted(run(spark, "q_subtitle_cues", folder), key=lambda r: (r["conv_id"], r["seq"]))
    for c in range(4):
        mine = [r for r in rows if r["conv_id"] == c]
        assert " ".join(r["text"] for r in mine).split() == [x for k, _, w in talks if k == c for x in w]
        assert all(a["end"] <= b["start"] for a, b in zip(mine, mine[1:]))


def test_agreement_and_lengths_of_whole_texts(spark, tmp_path):
    texts = ["same " * 30 + "one", "same " * 30 + "two and more", "same"]
    spark.createDataFrame([(1, k, "user", t) for k, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, "banana " * 100)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, [0.0] * 63 + [5.0])], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {r["turn"]: r["n_agreed"] for r in run(spark, "q_lcp_prev", tmp_path)} == {0: 0, 1: 150, 2: 4}
    ids = {r["turn"]: r["input_ids"] for r in run(spark, "q_collate_labels", tmp_path)}
    assert ids[0].split(",") == [*["4"] * 30, "3", "0", "0"] and ids[1].split(",") == [*["4"] * 30, "3", "3", "4"]
    assert run(spark, "q_syllables", tmp_path)[0]["n"] == 400
    assert run(spark, "q_language_top", tmp_path)[0]["language"] == "l63"


def test_all_rows_take_part(spark, talks, folder, tmp_path):
    rows = run(spark, "q_token_distance_long", folder)
    assert {(r["conv_id"], r["turn"]): r["edits"] for r in rows} == {(c, t): distance(w, worse(w)) for c, t, w in talks}
    spark.createDataFrame([(k, n) for k in range(9) for n in (1, 2, 3)], "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    rows = run(spark, "q_en_numbers", tmp_path)
    assert {(r["l_orderkey"], r["l_linenumber"]): r["n"] for r in rows} == {(k, n): (f"paid {k + 16}%", f"-{k + 16} left", f"{k + 16}.3 of")[n - 1] for k in range(9) for n in (1, 2, 3)}
    spark.createDataFrame([(k, k % 3) for k in range(50)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, 7) for k in range(5)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    rows = run(spark, "rel_join_full", tmp_path)
    assert {r["k"]: (r["nc"], r["ns"]) for r in rows} == {0: (17, 1), 1: (17, 1), 2: (16, 1), 7: (0, 2)}
