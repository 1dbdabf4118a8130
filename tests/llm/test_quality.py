from collections import Counter

from tidemark.llm.quality import SCHEMA, judge, keep


def plain(text):
    words = (text or "").encode().split()
    seen, lines, again = set(), 0, 0
    for line in (text or "").split("\n"):
        if line.encode().split():
            lines += line in seen
            again += sum(len(w.decode()) for w in line.encode().split()) if line in seen else 0
            seen.add(line)
    covered = {}
    for n in (3, 5, 7, 10):
        grams = Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
        covered[n] = {k + j for k in range(len(words) - n + 1) if grams[tuple(words[k : k + n])] > 1 for j in range(n)}
    chars = [len(w.decode()) for w in words]
    share = {n: sum(chars[k] for k in covered[n]) / max(1, sum(chars)) for n in (5, 7, 10)} | {"_line": again / max(1, sum(chars))}
    return len(words), sum(chars), sum((text or "").count(c) for c in "#*$%&|<>"), lines, len(covered[3]), share


def check(df):
    rows = judge(df).collect()
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for r in rows:
        n, chars, symbols, lines, repeat, share = plain(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["base_failed"] and r["kept"])
        for k in share:
            assert abs(share[k] - r[f"dup{k}"]) < 1e-9
        assert r["kept"] == (not r["base_failed"] and share["_line"] <= 0.3 and symbols <= 0.4 * n and share[5] <= 0.4 and share[7] <= 0.35 and share[10] <= 0.3)
    return rows


def test_against_counting(documents, odd):
    assert len(check(documents)) == documents.count()
    check(odd)


def test_repeated_lines_and_passages(spark):
    clean = " ".join(f"w{k}" for k in range(300))
    line = "the same line of some eight words again here"
    rows = [(1, clean), (2, "\n".join([line] * 40)), (3, clean + "\n" + clean), (4, clean + "\n" + "\n".join(f"{line} {k}" for k in range(3)))]
    got = {r["doc_id"]: r for r in check(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert [got[k]["kept"] for k in (1, 2, 3, 4)] == [True, False, False, True]


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = judge(docs).join(labels, "doc_id").where("quality = 1 AND NOT base_failed").collect()
    assert len(rows) > 100
    assert all(r["kept"] for r in rows)


def test_filter_keeps_columns(odd, empty):
    assert keep(odd).schema == odd.schema
    assert keep(empty).count() == 0
    assert judge(empty).count() == 0
    assert SCHEMA.startswith("doc_id long")
