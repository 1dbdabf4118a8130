"""Phrase-level conversion between scripts, against a plain longest match."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import numbers, script


def plain(table, t):
    out, k, longest = "", 0, max(map(len, table))
    while k < len(t):
        n = next((n for n in range(min(longest, len(t) - k), 0, -1) if t[k : k + n] in table), 0)
        out, k = out + (table[t[k : k + n]] if n else t[k]), k + max(n, 1)
    return out


def test_longest_phrase_of_any_table():
    rng = random.Random(1)
    for _ in range(300):
        letters = "abcd𠀀"
        some = lambda of, a, b: "".join(rng.choice(of) for _ in range(rng.randrange(a, b)))
        table = {some(letters, 1, 5): some("XYZ里", 0, 5) for _ in range(rng.randrange(1, 15))}
        texts = [some(letters + "e", 0, 30) for _ in range(6)]
        assert script.Phrases(table)(texts) == [plain(table, t) for t in texts]


def test_no_phrase_goes_from_one_text_to_the_next():
    assert script.Phrases({"ab": "X", "b": "Y"})(["a", "b", "", "ab", "a"]) == ["a", "Y", "", "X", "a"]
    assert script.Phrases({})(["ab", ""]) == ["ab", ""] and script.Phrases({"a": "b"})([]) == []


def test_words_that_differ_from_their_characters():
    both = script.Script()
    for simple, traditional in (x.split() for x in script.PHRASES.split("|")):
        assert both(simple, "yue") == traditional and both(traditional, "zh") == simple
    assert both.batch(["头发发现", "皇后在后面", None, "头发"], ["yue", "yue", "zh", "en"]) == ["頭髮發現", "皇后在後面", None, "头发"]
    assert both("乾隆的餅乾", "zh") == "乾隆的饼干"


def test_given_tables_and_their_order(spark, tmp_path):
    (tmp_path / "words.txt").write_text("# a comment\n\n头发\t頭髮 头髮\n发\t發\n里\t裏\n里\t裡\nno tab\n", encoding="utf-8")
    table = script.phrase_table(spark, str(tmp_path / "words.txt"))
    assert table == {"头发": "頭髮", "发": "發", "里": "裏"}
    with pytest.raises(ValueError, match="more than 2"):
        script.phrase_table(spark, str(tmp_path / "words.txt"), 2)
    given = script.Script(to_traditional=[table, {"裏": "裡"}])
    rows = spark.createDataFrame([(1, "头发里发", "yue"), (2, None, "yue"), (3, "", "zh"), (4, "头发", None), (5, "头发12%里", "yue")], "k int, t string, l string")
    got = {r["k"]: (r["a"], r["b"]) for r in rows.select("k", script.converted("t", "l", given).alias("a"), numbers.han_numbers_column(F.col("t"), F.col("l"), script=given).alias("b")).collect()}
    assert got == {1: ("頭髮裡發",) * 2, 2: (None, None), 3: ("", ""), 4: ("头发",) * 2, 5: ("頭髮12%裡", "頭髮百分之十二裡")}
