import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import piece_bpe, piece_codec, token_counts, token_store

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
hf = Tokenizer.from_file(BYTES)
random.seed(3)
ALPHABET = [*"ab e.,\n\t é日😀<>sth'", "th", "the ", " in", "  ", "ing", " ", "　", " à", "<|endoftext|>", "12", "'s"]
RANDOM = ["".join(random.choices(ALPHABET, k=random.randint(0, 40))) for _ in range(300)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_codec_gives_the_librarys_ids(spark, documents):
    texts = [*RANDOM, *(r["text"] for r in documents.collect())]
    for r in piece_codec.encode(frame(spark, texts)).collect():
        assert r["ids"] == sp.encode(texts[r["doc_id"]])
    for r in piece_codec.round_trip(frame(spark, texts)).collect():
        assert r["decoded_equal"] == ("▁" not in texts[r["doc_id"]]) and r["n_tokens"] == len(sp.encode(texts[r["doc_id"]]))


def test_suffix_array_and_edges():
    chars = np.array(list(map(ord, "banana▁bananas")))
    order = piece_codec.suffix_array(chars, 16)
    text = "banana▁bananas"
    assert [text[k:] for k in order] == sorted(text[k:] for k in range(len(text)))
    limit = np.full(len(chars), len(chars))
    both = [sorted(zip(*map(list, f), strict=True)) for f in (piece_codec.suffix_edges(PIECES, chars, limit), piece_bpe.trie_edges(piece_bpe.vocabulary(PIECES), chars, limit))]
    assert both[0] == both[1]


def test_counts_at_every_prefix(spark):
    texts = [t for t in RANDOM[:120] if "▁" not in t]
    for text, counts in zip(texts, token_counts.prefix_counts(texts), strict=True):
        assert list(counts) == [len(sp.encode(text[:k])) for k in range(len(text) + 1)]


def test_counts(spark, documents, odd, empty):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in token_counts.count(documents).collect():
        assert (r["n_bytes"], r["n_tokens"]) == (len(texts[r["doc_id"]].encode()), len(sp.encode(texts[r["doc_id"]])))
    limit = 100
    for r in token_counts.count(documents, limit=limit).collect():
        assert r["over_limit"] == (r["n_tokens"] > limit)
        if r["over_limit"]:
            assert len(sp.encode(texts[r["doc_id"]][: r["limit_chars"]])) <= limit
    rows = token_counts.count(odd).collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(len(sp.encode(t or "")) for t in [r["text"] for r in odd.collect()])
    assert token_counts.count(empty).count() == 0
    rows = piece_codec.round_trip(odd).collect()
    assert len(rows) == odd.count() and all(r["decoded_equal"] == (r["doc_id"] != 8) for r in rows)  # 8 holds the space mark
    assert piece_codec.round_trip(empty).count() == 0


def test_any_budget_from_a_stored_table(spark, documents, odd):
    from pyspark.sql import functions as F

    from tidemark.llm.common import written

    texts = [*(t for t in RANDOM if "▁" not in t), None, "x" * 5000, *(r["text"] for r in documents.limit(40).collect())]
    table = written(token_counts.prefix_table(frame(spark, texts)))
    assert "text" not in table.columns
    exact = token_counts.prefix_counts([t or "" for t in texts])
    for limit in (1, 7, 300):
        for r in token_counts.within_budget(table, limit).collect():
            counts = exact[r["doc_id"]]
            assert r["n_tokens"] == counts[-1] and r["over_limit"] == (counts[-1] > limit)
            assert r["limit_chars"] == (np.flatnonzero(counts <= limit)[-1] if counts[-1] > limit else None)
    some = table.withColumn("n", F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 23))
    for r in token_counts.truncated(some, "n").collect():
        assert r["truncated_tokens"] == (None if r["n"] is None else len(sp.encode((texts[r["doc_id"]] or "")[: r["n"]])))
    assert token_counts.prefix_table(odd).count() == odd.count()
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.total_counts(odd).collect()} == {r["doc_id"]: r["n_tokens"] for r in token_counts.count(odd).collect()}


def test_steps_beyond_a_byte():
    counts = np.array([1, 2, 400, 3, 3, 70_000])
    assert token_counts.unpack_counts(token_counts.pack_counts(counts)).tolist() == [0, *counts.tolist()]
    assert token_counts.unpack_counts(token_counts.pack_counts(counts[:0])).tolist() == [0]


def stored(spark, df):
    folder = token_store.write(df)
    return folder, token_store.read_back(spark, folder).collect()


def test_store_round_trip(spark, documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()} | {10_000 + k: t for k, t in enumerate(RANDOM)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    folder, rows = stored(spark, df)
    at = 0
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        ids = [*hf.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"], r["verified"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        at += len(ids)
    assert all(r["ok"] for r in token_store.verify(spark, folder).collect())
    some = spark.createDataFrame([(3,), (10_005,)], "doc_id long")
    for r in token_store.reconstruct(spark, folder, some).collect():
        assert r["ids"] == [*hf.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2]


def test_store_keeps_a_chunk_once(spark):
    text = " ".join(f"token{k}" for k in range(4000))
    folder, rows = stored(spark, spark.createDataFrame([(k, text) for k in range(50)], "doc_id long, text string").repartition(8))
    assert len({r["ids_crc32"] for r in rows}) == 1
    keys = [r["key"] for r in token_store.chunks(spark, folder).collect()]
    n = rows[0]["n_tokens"]
    assert len(keys) == len(set(keys)) and len(keys) <= n // token_store.MIN_CHUNK + 1


def test_store_of_odd_and_no_rows(spark, odd, empty):
    _, rows = stored(spark, odd)
    assert len(rows) == odd.count() and all(r["verified"] for r in rows)
    assert min(rows, key=lambda r: r["start"])["doc_id"] is None
    assert stored(spark, empty)[1] == []


def test_ids_beyond_16_bits(spark, tmp_path):
    """A vocabulary of 70,001 entries: ids of its last pieces are stored and read back whole."""
    import json

    spec = json.load(open(BYTES, encoding="utf-8"))
    vocab = spec["model"]["vocab"]
    for k in range(len(vocab), 70_000):
        vocab[f"~~{k}"] = k
    vocab["zzqq"] = 70_000
    spec["model"]["merges"] += [["zz", "qq"]] if isinstance(spec["model"]["merges"][0], list) else ["zz qq"]
    assert "zz" in vocab and "qq" in vocab
    path = str(tmp_path / "large.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    want = Tokenizer.from_file(path).encode("zzqq b", add_special_tokens=False).ids
    assert 70_000 in want
    folder = token_store.write(frame(spark, ["zzqq b", "zzqq" * 900]), path)
    assert token_store.reconstruct(spark, folder, spark.createDataFrame([(0,)], "doc_id long")).first()["ids"] == [*want, 2]
    rows = {r["doc_id"]: r for r in token_store.read_back(spark, folder).collect()}
    assert rows[0]["ids_crc32"] == zlib.crc32(np.array([*want, 2], "<u4").tobytes()) and all(r["verified"] for r in rows.values())


def test_merkle_roots():
    leaves = [bytes([k]) * 16 for k in range(11)]

    def plain(x):
        if len(x) == 1:
            return x[0]
        half = 1 << (len(x) - 1).bit_length() - 1
        return token_store._hash(plain(x[:half]) + plain(x[half:]))

    for n in range(1, 12):
        tree = token_store.Merkle()
        tree.extend(leaves[: n // 2])
        tree.extend(leaves[n // 2 : n])
        assert tree.root() == plain(leaves[:n]) and tree.n == n


def test_crc_of_parts():
    parts = [b"abc", b"", b"defgh" * 9]
    assert token_store.crc_of([(zlib.crc32(x), len(x)) for x in parts]) == zlib.crc32(b"".join(parts))


def test_tampering_shows(spark, documents):
    folder = token_store.write(documents)
    recipes = spark.read.parquet(f"{folder}/recipes")
    from pyspark.sql import functions as F

    recipes.withColumn("keys", F.when(F.col("doc_id") == 17, F.slice("keys", 1, F.size("keys") - 1)).otherwise(F.col("keys"))).write.partitionBy("kind").parquet(f"{folder}/other/recipes")
    assert all(r["ok"] for r in token_store.verify(spark, folder).collect())
    assert sum(not r["ok"] for r in token_store.verify(spark, f"{folder}/other").collect()) == 1


def test_counts_beyond_16_bits(spark):
    """A text without spaces, of more tokens than 16 bits hold: each of its characters is four byte tokens."""
    text = "".join(chr(0x13000 + k % 900) for k in range(20_000))
    (counts,) = token_counts.prefix_counts([text])
    assert counts[-1] == len(sp.encode(text)) > 70_000
    for k in (1, 16_000, 16_384, 16_385, 18_000, 19_999):
        assert counts[k] == len(sp.encode(text[:k]))
    (r,) = token_counts.count(frame(spark, [text]), limit=70_000).collect()
    assert r["n_tokens"] == counts[-1] and r["limit_chars"] == np.flatnonzero(counts <= 70_000)[-1]


def test_span_table_holds_ids_beyond_16_bits():
    from tidemark.llm.spans_table import SpanTable

    t = SpanTable()
    t.add(np.array([3], np.uint64), np.array([2]), np.array([1, 65_535], np.uint32))
    assert t.values.dtype == np.uint16
    t.add(np.array([2, 9], np.uint64), np.array([1, 2]), np.array([65_536, 7, 200_000], np.uint32))
    values, which = t.expand(t.find(np.array([2, 3, 9], np.uint64)))
    assert values.tolist() == [65_536, 1, 65_535, 7, 200_000] and which.tolist() == [0, 1, 1, 2, 2]


def test_encoder_parts_words_from_marks():
    """A word is encoded once, whatever mark or line break follows; ids are the library's, special strings inside texts too."""
    import random

    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from tidemark.llm.common import pieces
    from tidemark.llm.token_store import Encoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    e, library, rng = Encoder(path), Tokenizer.from_file(path), random.Random(5)

    def rows(texts):
        for lo, hi, buf, offsets in pieces(pa.array(texts)):
            ids, sizes = e.rows(buf, offsets)
            for t, end, n in zip(texts[lo:hi], sizes.cumsum().tolist(), sizes.tolist(), strict=True):
                assert ids[end - n : end].tolist() == [*library.encode(t, add_special_tokens=False).ids, 2], t

    rows([" thonshor" + mark + " treelle" + mark for mark in ".,;:!?%*)"])
    assert len(e.table.keys) == 2 + 9
    some = ["a", "St", "the", "n't", "'s", "'", " ", "  ", "\n", "\n\n", "\r\n", "\t", ".", ",", "/", "_", "-", '"', ")", "%%%", "1", "é", "日", "😀", "\u00a0", "\u3000", "\u0085", "\x1c", "<|endoftext|>", "<|", "|>", "endoftext", " the"]
    rows(["".join(rng.choice(some) for _ in range(rng.randrange(25))) for _ in range(3000)])
