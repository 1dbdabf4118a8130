import itertools

import numpy as np

from tidemark.llm import language

TEXTS = {"en": "the quick brown fox and the lazy dog were in the house of that man with this", "de": "der schnelle braune Fuchs und der faule Hund waren in dem Haus von diesem Mann mit", "ru": "быстрая лиса и ленивая собака были в доме этого человека и он был там"}


def train(spark):
    rows = [(k, " ".join(np.random.default_rng(k).permutation(t.split())), lang) for k in range(30) for lang, t in TEXTS.items()]
    return language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def brute(scores, penalty):
    best = None
    for path in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        s = sum(scores[k, x] for k, x in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))
        if best is None or s > best[0] + 1e-12:
            best = (s, path)
    return best[0]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(30):
        sizes = rng.integers(0, 7, 4)
        first = np.concatenate(([0], np.cumsum(sizes)))
        scores = rng.normal(size=(first[-1], 3))
        labels = language.spans(scores, first, 1.0)
        for a, b in zip(first[:-1], first[1:]):
            if b > a:
                path = labels[a:b]
                got = scores[np.arange(a, b), path].sum() - (path[1:] != path[:-1]).sum()
                assert abs(got - brute(scores[a:b], 1.0)) < 1e-9


def test_spans_of_a_mixed_text(spark):
    model = train(spark)
    mixed = f"{TEXTS['en']} {TEXTS['de']} {TEXTS['ru']}"
    import pyarrow as pa

    langs, _, n = language.label(pa.array([mixed, TEXTS["ru"]]), model)
    assert n.tolist() == [3, 1] and langs[1] == "ru"


def test_scripts_narrow_candidates(spark):
    model = train(spark)
    buf = np.frombuffer("слово word".encode(), np.uint8)
    scores, lettered, known = language.word_scores(buf, np.array([0, 11]), np.array([10, 15]), model, np.zeros(1, int))
    assert lettered.all() and known.all()
    assert scores[0].argmax() == model.langs.index("ru") and (np.sort(scores[0])[:2] == -50).all()
    assert scores[1, model.langs.index("ru")] == -50


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(language.training_rows(docs))
    rows = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 250
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)
    import zlib

    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)


def test_odd_and_no_rows(spark, odd, empty):
    model = train(spark)
    rows = language.predict(odd, model).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == odd.count()
    assert all((by[k]["lang_pred"], by[k]["score"]) == ("und", 0.0) for k in (1, 2, 3, 9, 10))
    assert not by[None]["held_out"]
    assert language.predict(empty, model).count() == 0
    nothing = language.fit(empty)
    assert {r["lang_pred"] for r in language.predict(odd, nothing).collect()} == {"und"}
    assert language.keep_known(odd, model).schema == odd.schema


def test_every_language_is_learned(spark):
    """More languages than full tables are for: the rare ones too, each text by its own words."""
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = {f"l{k:03}": ["".join(rng.choice(letters, 6)) for _ in range(12)] for k in range(130)}
    rows = [(f"l{k:03}", " ".join(rng.permutation(words[f"l{k:03}"]))) for k in range(130) for _ in range(2 if k % 2 else 6)]
    model = language.fit(spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string"))
    assert model.langs == sorted(words)
    assert sum(t.size for t in model.tables) <= language.FULL_LANGS * sum(size for _, size in language.GRAMS)
    tests = spark.createDataFrame([(k, " ".join(rng.permutation(w))) for k, w in enumerate(words.values())], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(tests, model).collect()}
    assert sum(got[k] == lang for k, lang in enumerate(words)) >= 128


def test_tables_of_few_languages_are_full():
    assert language.grams(4) == language.grams(50) == list(language.GRAMS) and language.grams(51)[2][1] == 1 << 16
    assert language.grams(10**6)[2][1] == language.LEAST_SLOTS


def test_runs_of_a_long_text_score_as_one(spark, monkeypatch):
    model = train(spark)
    buf = np.frombuffer(" ".join(TEXTS.values()).encode(), np.uint8)
    starts, ends = language.word_spans(buf, np.array([0, len(buf)]))
    want = language.word_scores(buf, starts, ends, model, np.zeros(1, int))[0]
    monkeypatch.setattr(language, "PIECE_BYTES", 1)
    assert np.allclose(language.word_scores(buf, starts, ends, model, np.zeros(1, int))[0], want, atol=1e-3)


def plain_grams(text, n, size):
    """(id of the n bytes that end at each byte) of a text as the operator sees it, one at a time."""
    seen = b"".join((c.lower() if c < "\x80" else c).encode() if c.isalpha() else b" " * len(c.encode()) for c in text)
    out = []
    for k in range(len(seen)):
        h = 0
        for j in range(n):
            at = k - n + 1 + j
            h = h * 0x01000193 % 2**32 ^ (seen[at] if at >= 0 else 32) + j
        out.append((h * 0x9E3779B1 % 2**32) >> 33 - size.bit_length())
    return seen, out


def test_fit_and_word_scores_against_counting(spark):
    import math
    from collections import Counter

    rows = [("en", "the “quick” fox, 3 times"), ("en", "a fox"), ("ru", "лиса и дом"), ("de", "der Fuchs über")]
    model = language.fit(spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate(rows)], "doc_id long, text string, lang string").coalesce(1))
    assert model.langs == ["de", "en", "ru"]
    text = "The fox лиса 12 über"
    buf = np.frombuffer(text.encode(), np.uint8)
    starts, ends = language.word_spans(buf, np.array([0, len(buf)]))
    scores, lettered, known = language.word_scores(buf, starts, ends, model, np.zeros(1, int))
    assert lettered.tolist() == [True, True, True, False, True] == known.tolist()
    want = np.zeros((len(starts), 3))
    for n, size in language.GRAMS:
        table = []
        for lang in model.langs:
            c = Counter()
            for x, t in rows:
                if x == lang:
                    c.update(plain_grams(t, n, size)[1])
            table.append((c, sum(c.values())))
        seen, ids = plain_grams(text, n, size)
        for w, (a, b) in enumerate(zip(starts, ends)):
            for k in range(a, min(b, len(seen) - 1) + 1):
                p = [math.log((c[ids[k]] + language.SMOOTHING) / (total + language.SMOOTHING * size)) for c, total in table]
                want[w] += (np.array(p) - np.mean(p)) * (0.5 if seen[k] == 32 else 1)
    assert np.allclose(scores[[0, 1, 4]][:, :2], want[[0, 1, 4]][:, :2], atol=1e-3)
    assert (scores[2] == [-50, -50, scores[2, 2]]).all() and (scores[[0, 1, 4], 2] == -50).all() and not scores[3].any()


def test_unlearned_scripts_and_punctuation(spark):
    rows = [(k, t, x) for k in range(20) for x, t in TEXTS.items() if x != "ru"]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = ["ภาษาไทยเป็นภาษาที่ใช้ในประเทศ", "日本語の文章です これは長い", "“the “quick “brown “fox", "— … “” ×÷ ’", "the quick brown ภาษาไทย", "አማርኛ ቋንቋ"]
    import pyarrow as pa

    langs, score, _ = language.label(pa.array(texts), model)
    assert score[0] == score[1] == score[5] == 0 and all(x in model.langs for x in (langs[0], langs[1], langs[5]))
    assert (langs[2], score[2]) == ("en", 1.0) and langs[3] == "und"
    assert langs[4] == "en" and 0.3 < score[4] < 0.6


def test_a_text_does_not_depend_on_its_neighbours(spark):
    import pyarrow as pa

    model = train(spark)
    texts = [*TEXTS.values(), "é", "x", "", None, "der the", "the der"] * 3
    together = language.label(pa.array(texts), model)
    for k, t in enumerate(texts):
        alone = language.label(pa.array([t]), model)
        assert (together[0][k], together[1][k], together[2][k]) == (alone[0][0], alone[1][0], alone[2][0])


def test_scripts_by_code_point():
    text = "aÉß×ñ Ω я “ก” 漢カ한𠀀 9·"
    got = dict(zip(text, (language.letter_scripts(np.frombuffer(text.encode(), np.uint8))[np.cumsum([0, *(len(c.encode()) for c in text)])[:-1]]).tolist()))
    names = [None, *language.SCRIPT_BLOCKS, "other"]
    assert {c: names[k] for c, k in got.items() if k} == {"a": "latin", "É": "latin", "ß": "latin", "ñ": "latin", "Ω": "greek", "я": "cyrillic", "ก": "thai", "漢": "han", "カ": "kana", "한": "hangul", "𠀀": "han"}
