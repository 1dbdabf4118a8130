import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import arrays, edit, normalise, numbers, text, tokens

L = F.lit


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first())


def test_scripts_and_languages(spark):
    got = values(spark, *(text.has_cjk(L(x)) for x in ("abc", "a中", "𠀀", "ｱ")))
    assert got == [False, True, True, False]
    cases = [("yue", "x", "yue"), ("Cantonese", "x", "yue"), ("en-HK", "x", "yue"), ("cmn-Hans", "x", "zh"), ("en", "中", "zh"), ("en", "abc", None), (None, "", None), (" ZH ", "x", "zh")]
    assert values(spark, *(text.normalisation_language(L(a), L(b)) for a, b, _ in cases)) == [c for *_, c in cases]


def test_text_normalisation(spark):
    got = values(
        spark, text.ascii_lower(L("ÀBC")), text.unify_variants(L("两萬億")), text.drop_punctuation(L("a,b。c$")), text.punctuation_to_space(L("a,b$c。")), text.collapse(L("  a　\tb ")),
        text.for_training(L("hi,中文ok!")), text.strip_replacement_marks(L("ab��")), text.for_mixed_rate(L(" Hello,  World! "), L("en")), text.strip_brackets(L("A <b>[c] (d) e-f")),
    )
    assert got == ["Àbc", "二万亿", "abc$", "a b c ", "a b", "HI 中文 OK", "ab", "hello world", "a e f"]


def test_tokens_and_syllables(spark):
    got = values(spark, text.mixed_tokens(L("我ab，c é"), L("zh")), text.mixed_tokens(L(" a　b  c "), L("en")), text.mixed_tokens(L(""), L("en")), text.syllables(L("hello中 rhythm")))
    assert got == [["我", "ab", "，", "c", "é"], ["a", "b", "c"], [], ["hel", "lo", "中", " ", "rhyt", "hm"]]


def test_paths(spark):
    names = ["a/b/c.tar.gz", ".hidden", "x", "d/.profile.txt", "rec_012-3.wav"]
    assert values(spark, *(text.stem(L(n)) for n in names)) == ["c.tar", ".hidden", "x", ".profile", "rec_012-3"]
    assert values(spark, *(text.first_integer(L(n)) for n in names)) == [None, None, None, None, 12]
    assert values(spark, text.extension(L("a/B.WAV")), text.extension(L(".x"))) == [".wav", ""]


def test_prompts(spark):
    got = values(spark, text.prompt(F.array(L("x"), L("y"), L("z")), L("pre"), 2), text.conversation(L("q"), L("a")), text.conversation(L("q"), L(None).cast("string")))
    assert "  1. x\n  2. y\n\nBased on the context and candidates" in got[0] and "z" not in got[0].split("K-best")[1].split("Based")[0]
    assert [m["role"] for m in got[1]] == ["system", "user", "assistant"] and len(got[2]) == 2


def test_timestamps(spark):
    cases = [(0.0, "00:00.000"), (61.5, "01:01.500"), (3661.0015, "01:01:01.002"), (0.0005, "00:00.000")]
    assert values(spark, *(text.timestamp_text(L(s)) for s, _ in cases)) == [t for _, t in cases]
    assert values(spark, text.timestamp_text(L(1.25), True, ","), text.timestamp_text(L(-1.0)), text.cue_text(L(" a-->b "))) == ["00:00:01,250", None, "a->b"]


@settings(max_examples=25, deadline=None)
@given(pairs=st.lists(st.tuples(st.text("ab中", max_size=6), st.text("ab中", max_size=6)), min_size=1, max_size=8))
def test_prefixes(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    import os

    got = [r[0] for r in df.select(text.common_prefix("a", "b")).collect()]
    assert got == [os.path.commonprefix(p) for p in pairs]


def distance(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=20, deadline=None)
@given(pairs=st.lists(st.tuples(*[st.lists(st.sampled_from(["a", "b", "cc", "中"]), max_size=7)] * 2), min_size=1, max_size=6))
def test_edit_distance(spark, pairs):
    df = spark.createDataFrame(pairs, "a array<string>, b array<string>").select(edit.token_distance("a", "b"), edit.token_distance_long("a", "b"), edit.token_distance("b", "a"), edit.token_distance("a", "a"))
    for (a, b), r in zip(pairs, df.collect(), strict=True):
        assert list(r) == [distance(a, b)] * 3 + [0]


def test_error_rates(spark):
    rate = lambda a, b, lang="en": edit.mixed_error_rate(L(a), L(b), L(lang))
    got = values(spark, rate("a b c d", "a x c"), rate("", ""), rate("", "x"), rate("我们去", "我去", "zh"), edit.character_error_rate(L("abc"), L("axc"), L("en")), edit.character_error_rate(L("你好。"), L("你 好"), L("zh")))
    assert got == pytest.approx([0.5, 0.0, 1.0, 1 / 3, 1 / 3, 0.0])


def tag_by_tag(words):
    """The survey's account of spelled numbers, as a plain walk over the words with the number in progress as text."""
    from fractions import Fraction

    lex, out, num, fixed, sign, k = numbers.LEXICON, [], None, False, "", 0
    plain = lambda w, kind: w in lex and lex[w][0] == kind and not lex[w][2]
    is_fig = lambda w: w is not None and numbers.NUMERIC.fullmatch(w) is not None

    def put(x):
        nonlocal num, fixed, sign
        out.append(sign + x)
        num, fixed, sign = None, False, ""

    while k < len(words):
        w, prev, nxt = words[k], words[k - 1] if k else None, words[k + 1] if k + 1 < len(words) else None
        k += 1
        goes_on = is_fig(nxt) or nxt in numbers.KNOWN
        bare = w[1:] if w[0] in numbers.PREFIXES else w
        if is_fig(bare):
            if num is not None and fixed and num[-1] == ".":
                num += w
                continue
            if num is not None:
                put(num)
            sign = w[0] if bare != w else sign
            f = Fraction(bare)
            num, fixed = (str(f), False) if f.denominator == 1 else (bare, True)
        elif w in numbers.ZEROS or (w in ("double", "triple") and (nxt in numbers.ZEROS or plain(nxt, "unit"))):
            times = {"double": 2, "triple": 3}.get(w, 1)
            digit = "0" if w in numbers.ZEROS or nxt in numbers.ZEROS else str(lex[nxt][1])
            num, fixed, k = ("" if num is None or (num == "0" and not fixed) else num) + digit * times, True, k + (times > 1)
        elif w in lex:
            kind, value, tail = lex[w]
            if num is None:
                num = str(value)
            elif kind == "scale":
                try:
                    f = Fraction(num) * value
                except ValueError:
                    f = Fraction(1, 2)
                if fixed and f.denominator > 1:
                    put(num)
                    num = str(value)
                else:
                    num = str(f) if fixed else str(int(num) // 1000 * 1000 + int(num) % 1000 * value)
                fixed = False
            else:
                small = kind == "unit" and value < 10
                if fixed and small and plain(prev, "ten"):
                    num = num[:-1] + str(value)
                elif fixed or (kind == "unit" and plain(prev, "unit")) or int(num) % (10 if small else 100):
                    num, fixed = num + str(value), True
                else:
                    num = str(int(num) + value)
            if tail:
                put(num + tail)
        elif w in numbers.SIGNS and goes_on:
            if num is not None:
                put(num)
            sign = numbers.SIGNS[w]
        elif w in numbers.CURRENCIES and num is not None:
            sign = numbers.CURRENCIES[w]
            put(num)
        elif num is not None and (w == "percent" or (w == "per" and nxt == "cent")):
            put(num + "%")
            k += w == "per"
        elif w == "and" and goes_on and plain(prev, "scale"):
            pass
        elif w == "point" and goes_on:
            if is_fig(nxt) or nxt in numbers.ZEROS or plain(nxt, "unit") or plain(nxt, "ten"):
                num, fixed = ("" if num is None or (num == "0" and not fixed) else num) + ".", True
        else:
            if num is not None:
                put(num)
            put(w)
    if num is not None:
        put(num)
    return out


@settings(max_examples=400, deadline=None)
@given(words=st.lists(st.sampled_from([*sorted(numbers.KNOWN), "cat", "5", "12", "3.5", "-4", "$20", "0", "100", *["and", "point", "double", "hundred", "thousand", "twenty", "one", "five", "percent", "dollars"] * 5]), max_size=8))
def test_english_numbers_against_a_plain_walk(words):
    got = " ".join(numbers.printed(numbers.reduced(numbers.tagged(words))))
    assert got == " ".join(tag_by_tag(words))


def test_cents_alone():
    assert numbers.english_numbers("zero point zero seven dollars") == "¢7"
    assert (numbers.english_numbers("o dollars 12"), numbers.english_numbers("o dollars 12", True)) == ("$0 12", "¢12")


def test_chinese_numbers():
    cases = {"0": "零", "10": "十", "105": "一百零五", "1010": "一千零一十", "10001": "一万零一", "20.5": "二十点五", "100000000": "一亿", "123456789": "一亿二千三百四十五万六千七百八十九"}
    assert {k: numbers.chinese_numeral(k) for k in cases} == cases
    assert numbers.chinese_numeral("9" * 17) is None
    assert numbers.han_numbers("有1和12个，50%", "zh") == "有一和十二个，百分之五十"
    assert numbers.han_numbers("1和12", "zh", faithful=True) == "一和一2"
    assert numbers.han_numbers("12", None) == "12"


@pytest.mark.parametrize(
    ("words", "digits"),
    [
        ("twenty five", "25"), ("one oh one", "101"), ("two hundred and five", "205"), ("three point one four", "3.14"), ("nineteen eighty four", "1984"), ("two and a half million", "2500000"),
        ("five dollars and seven cents", "$5.07"), ("twenty first", "21st"), ("minus three percent", "-3%"), ("double oh seven", "007"), ("one", "one"), ("fifty per cent", "50%"), ("salt and pepper", "salt and pepper"),
        ("one hundred twenty three thousand four hundred fifty six", "123456"), ("the sixties", "the 60s"), ("", ""),
    ],
)
def test_english_numbers(words, digits):
    assert numbers.english_numbers(words) == digits


def test_normalisers(spark):
    got = values(spark, normalise.basic(L("Ünï <x> (y) a-b"), True), normalise.basic(L("ab"), False, True), normalise.english(L("I won't pay Mr. Smith twenty dollars, um, it's colour")), normalise.respelled(L("grey  cat")))
    assert got == ["uni a b", "a b", "i will not pay mister smith $20 it is color", "gray cat"]
    assert normalise.without_symbols("ß½ é", False) == "ss1 2 e"
    got = values(spark, normalise.respelled(L("favourite organisation recognised analysing advise surprised travelled metre kilometres cheque anise paid")))
    assert got == ["favorite organization recognized analyzing advise surprised traveled meter kilometers check anise paid"]


def test_language_and_script_tables(spark):
    assert len(tokens.LANGUAGES) == 100 and len(numbers.SIMPLE) == len(numbers.TRADITIONAL)
    assert values(spark, tokens.language_code(L("Welsh")), tokens.language_code(L("haitian creole")), tokens.language_code(L("flemish"))) == ["cy", "ht", "nl"]
    script = numbers.Script()
    assert script("他们说这个国语听书", "yue") == "他們說這個國語聽書" and script("他們說這個國語聽書", "zh") == "他们说这个国语听书"


def test_array_functions(spark):
    a = F.array(*map(L, [1.0, 5.0, 2.0, 8.0, 3.0]))
    got = values(spark, arrays.arg_max(a), arrays.median(a), arrays.median_filter(a, 3), arrays.median_filter(a, 11), arrays.pad_or_trim(a, 7), arrays.pad_or_trim(a, 2), arrays.cumulative(a), arrays.masked(a, [1]), arrays.mean(a))
    x = np.array([1.0, 5, 2, 8, 3])
    padded = np.pad(x, 1, mode="reflect")
    assert got[:2] == [3, 3.0] and got[2] == [float(np.median(padded[k : k + 3])) for k in range(5)] and got[3] == list(x)
    assert got[4] == [*x, 0, 0] and got[5] == [1, 5] and got[6] == list(np.cumsum(x)) and got[7][1] == -math.inf and got[8] == 3.8
    soft, logs, z = values(spark, arrays.softmax(a), arrays.log_softmax(a), arrays.z_norm(a))
    e = np.exp(x - 8)
    assert np.allclose(soft, e / e.sum()) and np.allclose(logs, np.log(e / e.sum())) and np.allclose(z, (x - x.mean()) / x.std())


def test_dtw_against_all_paths(spark):
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (3, 4), (4, 2)):
        cost = rng.random((n, m))
        best = np.full((n + 1, m + 1), np.inf)
        best[0, 0] = 0
        for i in range(1, n + 1):
            for j in range(1, m + 1):
                best[i, j] = cost[i - 1, j - 1] + min(best[i - 1, j - 1], best[i - 1, j], best[i, j - 1])
        rows, columns = arrays.dtw_path(cost)
        assert math.isclose(cost[rows, columns].sum(), best[n, m])
        assert (rows[0], columns[0], rows[-1], columns[-1]) == (0, 0, n - 1, m - 1)
        matrix = F.array(*(F.array(*map(L, r)) for r in cost.tolist()))
        assert math.isclose(values(spark, arrays.dtw_cost(matrix))[0], best[n, m])


def test_firing(spark):
    a = F.array(*map(L, [0.2, 3.0, 0.3]))
    got = values(spark, arrays.cif_resized(a, L(1.5)), arrays.cif_fires(a), *(arrays.fire_policy(L(m), L(n), L(f)) for m, n, f in ((False, False, False), (True, False, False), (True, False, True), (True, True, True))))
    assert math.isclose(sum(got[0]), 1.5) and max(got[0]) <= 0.999 and got[2:] == [True, False, True, False]


def test_timestamp_rules(spark):
    logits = F.array(*map(L, [0.0] * 10))
    kept = lambda seq: [k for k, x in enumerate(values(spark, arrays.timestamp_rules(F.array(*map(L, seq)) if seq else F.array().cast("array<int>"), logits, 6, 5, None, 1))[0]) if x > -math.inf]
    assert kept([]) == [6, 7]  # time first, and early
    assert kept([6, 1, 7]) == [7, 8, 9]  # a pair must close, with the end or a time that isn't earlier
    assert kept([6, 7]) == [0, 1, 2, 3, 4, 5]  # closed: text


def test_timestamp_rules_against_a_plain_filter(spark):
    """All rules on random histories, one id at a time."""
    rng = np.random.default_rng(5)
    begin, eot, plain_mark, most, size = 10, 9, 8, 2, 16

    def allowed(seq, x):
        times = [t for t in seq if t >= begin]
        last, before = bool(seq) and seq[-1] >= begin, len(seq) < 2 or seq[-2] >= begin
        out = []
        for k in range(size):
            bad = k == plain_mark or (last and before and k >= begin) or (last and not before and k < eot) or (not seq and (k < begin or k > begin + most))
            bad |= bool(times) and begin <= k and (k < times[-1] if last and not before else k <= times[-1])
            out.append(not bad)
        e = np.where(out, np.exp(x), 0)
        if e[begin:].sum() > e[:begin].max():
            out = [o and k >= begin for k, o in enumerate(out)]
        return out

    rows = [([int(t) for t in rng.choice([1, 2, 10, 11, 12, 13], rng.integers(0, 5))], rng.normal(0, 2, size).tolist()) for _ in range(200)]
    got = spark.createDataFrame(rows, "t array<int>, x array<double>").coalesce(1).select("t", "x", arrays.timestamp_rules("t", "x", begin, eot, plain_mark, most).alias("y")).collect()
    for r in got:
        assert [v > -math.inf for v in r["y"]] == allowed(list(r["t"]), np.array(r["x"]))


def test_time_grows_with_the_array_alone(spark):
    """What a lambda needs for all elements is computed once: arrays ten times as long don't take a hundred times as long."""
    import time

    def took(n, f):
        df = spark.range(300).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.rand(3) + k / n).alias("a"))
        began = time.perf_counter()
        df.select(f("a")).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    for f in (arrays.softmax, arrays.log_softmax, arrays.z_norm, arrays.cif_fires):
        took(20, f)
        assert took(1500, f) < 30 * max(took(150, f), 0.1), f.__name__


def test_pcm_and_wav(spark, tmp_path):
    import io
    import wave

    x = np.array([0, 16384, -32768, 32767], "<i2")
    df = spark.createDataFrame([(bytes(x.tobytes()) + b"\0",)], "b binary")
    assert np.allclose(df.select(arrays.decode_pcm("b")).first()[0], x / 32768)
    raw = io.BytesIO()
    with wave.open(raw, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.repeat(np.arange(800, dtype="<i2"), 2).tobytes())
    got = spark.createDataFrame([(raw.getvalue(),)], "b binary").select(arrays.decode_wav("b")).first()[0]
    assert len(got) == 1600 and math.isclose(got[100], 50 / 32768, rel_tol=1e-3)
    assert values(spark, arrays.pcm16(F.array(L(2.0), L(-2.0), L(0.5))))[0] == [32767, -32768, 16383]
    assert arrays.log_mel(np.sin(np.arange(1600) / 5)).shape == (80, 10)


def test_cross_entropy_and_slices(spark):
    got = values(spark, arrays.cross_entropy(F.array(L(-1.0), L(-2.0), L(-3.0)), F.array(L(5), L(-100), L(7))), arrays.time_slice(F.array(*map(L, range(10))), L(0.2), L(0.5), 10))
    assert got == [2.0, [2, 3, 4]]


def test_token_functions(spark):
    raw = ["é"[:1].encode()[:1], "é".encode()[1:], b"ab"]
    parts = F.array(*(L(x) for x in raw))
    got = values(spark, tokens.split_on_unicode(parts), tokens.words_from_pieces(F.array(*map(L, [" He", "llo", ",", " wor", "ld"]))), tokens.text_ids(F.array(L(3), L(9)), 5), tokens.with_prompt(F.array(*map(L, range(6))), [90], F.array(L(1)), 99, 8), tokens.language_code(L("Mandarin")))
    assert [[bytes(b) for b in g] for g in got[0]] == [raw[:2], raw[2:]]
    assert got[1:] == [[" Hello", ",", " world"], [3], [99, 3, 4, 5, 90, 1], "zh"]


def test_open_bytes_are_a_last_group(spark):
    parts = [bytearray(x) for x in (b"a", "世".encode()[:2])]
    df = spark.createDataFrame([(parts,), ([bytearray("世".encode()[:2]), bytearray("世".encode()[2:])],), ([],)], "p array<binary>")
    got = [[[bytes(b) for b in g] for g in r[0]] for r in df.select(tokens.split_on_unicode("p")).collect()]
    assert got == [[[b"a"], ["世".encode()[:2]]], [["世".encode()[:2], "世".encode()[2:]]], []]


def test_pieces_of_unspaced_languages_are_words(spark):
    df = spark.createDataFrame([(["今", "天", " ", "!"], x) for x in ("zh", "en", None)], "p array<string>, l string")
    got = {r[1]: r[0] for r in df.select(tokens.words_from_pieces("p", language=F.col("l")), "l").collect()}
    assert got == {"zh": ["今", "天", " ", "!"], "en": ["今天", " ", "!"], None: ["今天", " ", "!"]}


def test_no_word_beyond_the_map_is_respelled(spark, tmp_path):
    kept = "practise louise denise valise marquise trellised metropolises promise advise exercise wise rise surprised franchise"
    assert values(spark, normalise.respelled(L(kept))) == [kept]
    (tmp_path / "s.json").write_text('{\n "practise": "practice",\n "louise": "luise"\n}')
    (tmp_path / "s.txt").write_text("practise practice\n\nlouise\tluise\nalone\n")
    for name in ("s.json", "s.txt"):
        given = normalise.spellings_of(spark, str(tmp_path / name))
        assert given == {"practise": "practice", "louise": "luise"}
        assert values(spark, normalise.respelled(L("practise  colour louise"), given)) == ["practice colour luise"]
    with pytest.raises(ValueError, match="more than 1"):
        normalise.spellings_of(spark, str(tmp_path / "s.txt"), 1)


def plain_english(text):
    """The normaliser's stages one after the other, from its tables."""
    import re
    import unicodedata

    t = re.sub(r"\(([^)]+?)\)", "", re.sub(r"[<\[][^>\]]*[>\]]", "", text.lower()))
    t = re.sub(r"\s+'", "'", re.sub(normalise.FILLERS, "", t))
    for table, form in ((normalise.WORDS, r"\b{}\b"), (normalise.TITLES, r"\b{}\b"), (normalise.ENDINGS, r"{}\b")):
        for k, v in table.items():
            t = re.sub(form.format(k), {id(normalise.WORDS): v, id(normalise.TITLES): v + " ", id(normalise.ENDINGS): " " + v}[id(table)], t)
    t = re.sub(r"\.([^0-9]|$)", r" \1", re.sub(r"(\d),(\d)", r"\1\2", t))
    out = ""
    for c in unicodedata.normalize("NFKD", t):
        kind = unicodedata.category(c)
        out += c if c in normalise.KEPT_SYMBOLS else normalise.EXTRA.get(c, "" if kind == "Mn" else " " if kind[0] in "MSP" else c)
    t = " ".join(normalise.SPELLINGS.get(w, w) for w in numbers.english_numbers(out).split())
    return re.sub(r"\s+", " ", re.sub(r"([^0-9])%", r"\1 ", re.sub(r"[.$¢€£]([^0-9])", r" \1", t)))


def test_english_normaliser_of_whole_texts(spark, tmp_path):
    from tidemark.plans import catalogue

    texts = [
        "Um, I WON'T pay Mr. Smith twenty-five dollars [laughs] (aside) for the colour, it's 1,000.50% sure.", "She'd been there; they've gone - y'all gotta organise the theatre programme!", "Café naïve Ærø: £5.07, 3rd, o'clock 's got...",
        "", "  ", "Louise's valise, practise makes", "one hundred and five point two per cent of the sixties. Dr. No",
    ]
    spark.createDataFrame([(k, 0, "user", t) for k, t in enumerate(texts)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r["t"] for r in catalogue.queries()["q_en_normaliser"](spark, str(tmp_path)).collect()}
    assert got == {k: plain_english(t) for k, t in enumerate(texts)}


def test_strip_takes_all_white_space(spark):
    """What Java's Unicode classes hold as white space goes at both ends, and nothing else does."""
    from pyspark.sql import functions as F

    from tidemark.functions import text

    c = spark.range(0x3100).select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    t = c.select(F.explode(F.array("c", F.concat("c", F.lit("a"), "c", F.lit("a"), "c"), F.concat(F.lit(" "), "c", F.lit("\r\n")))).alias("t"))
    assert t.where(~text.strip("t").eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
    assert t.count() == 3 * 0x3100
