"""Language ID (operator 6).

Training counts byte n-grams and scripts per language on a bounded, stratified sample of labelled rows. Prediction gives
each word a log score per language: the script of its first letter narrows the candidates, n-gram tables score the
rest. Viterbi with a penalty for each switch then labels spans, so a text may change language; the document's language
is the one whose spans hold most bytes of words. All documents of a piece step through Viterbi together in numpy. The score is the share of the
bytes of words with letters that lie in the language's spans and in a script that some language has been learned in.

Defined cases: null or empty text, and text without any letter, is `und` with score 0; a text in scripts that no language was learned in has
score 0 under the language first in the alphabet, as all its words do without telling languages apart; ties go to the language first in
the alphabet; a null lang takes no part in training; with no training row at all every text is `und`; lang, source and
doc_id are never inputs of a prediction. Every language value is learned, so the driver holds as much as there are such values.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii, owner, pieces, word_spans

#: The sample's bound: so many rows of each language at most, in the mean, chosen by a hash of doc_id.
SAMPLE_ROWS_PER_LANG = 4000
#: Rows of the sample that one task counts.
COUNT_ROWS = 20_000
#: Every labelled language is learned. Up to so many share full tables and pieces; beyond, both get smaller as languages get more.
FULL_LANGS = 50
GRAMS = ((2, 1 << 14), (3, 1 << 16), (4, 1 << 17))
#: Tables are not made smaller than this.
LEAST_SLOTS = 1 << 10
PIECE_BYTES = 1 << 20
SMOOTHING = 0.5
SWITCH_PENALTY = 12.0
#: A language takes part for a script if at least this share of its letters is in it.
SCRIPT_SHARE = 0.02
#: The filtering stage lets a document go if less than this share of it is in its language.
REJECT_BELOW = 0.4
#: First and last code points of blocks by script; letters beyond them are of one further script.
SCRIPT_BLOCKS = {
    "latin": [(0x41, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)], "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)], "devanagari": [(0x900, 0x97F)], "bengali": [(0x980, 0x9FF)], "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)], "tamil": [(0xB80, 0xBFF)], "telugu": [(0xC00, 0xC7F)], "kannada": [(0xC80, 0xCFF)], "malayalam": [(0xD00, 0xD7F)], "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)], "lao": [(0xE80, 0xEFF)], "tibetan": [(0xF00, 0xFFF)], "myanmar": [(0x1000, 0x109F)], "georgian": [(0x10A0, 0x10FF), (0x2D00, 0x2D2F)],
    "ethiopic": [(0x1200, 0x139F)], "khmer": [(0x1780, 0x17FF)], "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)], "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
N_SCRIPTS = len(SCRIPT_BLOCKS) + 2
#: Code points from here on are no letters.
LAST_LETTER = 0x33480


def _script_table() -> np.ndarray:
    """Script of each code point: 0 for what is no letter, and the last number for letters of other scripts. Marks count as letters of their block."""
    letter = np.fromiter((c.isalpha() or unicodedata.category(c) in ("Mn", "Mc") for c in map(chr, range(LAST_LETTER))), bool, LAST_LETTER)
    t = np.where(letter, N_SCRIPTS - 1, 0).astype(np.int8)
    for number, blocks in enumerate(SCRIPT_BLOCKS.values(), 1):
        for first, last in blocks:
            t[first : last + 1][letter[first : last + 1]] = number
    return np.concatenate((t, np.zeros(0x200000 - LAST_LETTER, np.int8)))


SCRIPT = _script_table()


def letter_scripts(buf: np.ndarray) -> np.ndarray:
    """Script number at the first byte of every letter of UTF-8 text, 0 elsewhere."""
    out = SCRIPT[:256][np.where(buf < 128, buf, 0)]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        first = buf[lead].astype(np.int64)
        width = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
        padded = np.concatenate((buf, np.zeros(3, np.uint8))).astype(np.int64)
        point = first & np.array([0, 0, 0x1F, 0x0F, 0x07])[width]
        for k in (1, 2, 3):
            more = width > k
            point[more] = point[more] << 6 | padded[lead[more] + k] & 0x3F
        out[lead] = SCRIPT[np.minimum(point, len(SCRIPT) - 1)]
    return out


def gram_ids(buf: np.ndarray, n: int, size: int, begins: np.ndarray) -> np.ndarray:
    """For every byte the id of the n bytes that end there; white space before the begin of each text."""
    padded = np.concatenate((np.full(n - 1, 32, np.uint32), buf.astype(np.uint32)))

    def hashed(byte_at) -> np.ndarray:
        out = np.uint32(0)
        for k in range(n):
            out = (out * np.uint32(0x01000193)) ^ (byte_at(k) + np.uint32(k))
        out = out * np.uint32(0x9E3779B1)
        return (out >> np.uint32(32 - int(size).bit_length() + 1)).astype(np.int64)

    out = hashed(lambda k: padded[k : k + len(buf)])
    for d in range(n - 1):  # the first bytes of each text have no part of the text before in their n-grams
        at = begins[begins + d < len(buf)] + d
        out[at] = hashed(lambda k, at=at, d=d: padded[at + k] if k >= n - 1 - d else np.full(len(at), 32, np.uint32))
    return out


def grams(n_langs: int) -> list[tuple[int, int]]:
    """(n, slots) of the tables: their cells stay about the same in number beyond FULL_LANGS, down to LEAST_SLOTS for a language."""
    shift = max(0, -(-n_langs // FULL_LANGS) - 1).bit_length()
    return [(n, max(size >> shift, LEAST_SLOTS)) for n, size in GRAMS]


def piece_bytes(n_langs: int) -> int:
    return max(1 << 12, min(PIECE_BYTES, PIECE_BYTES * FULL_LANGS // max(n_langs, 1)))


@dataclass
class Model:
    langs: list[str]
    tables: list[np.ndarray]  # one (size, langs) table of centred log probabilities for each n
    scripts: np.ndarray  # (N_SCRIPTS, langs): may the language be written in the script


def _normal(buf: np.ndarray, script: np.ndarray) -> np.ndarray:
    """Letters in lower case (A-Z), spaces for all else. script: by letter_scripts."""
    first = np.where((buf & 0xC0) != 0x80, np.arange(len(buf)), 0)
    inside = script[np.maximum.accumulate(first)] > 0 if len(buf) else np.zeros(0, bool)
    return np.where(inside, lower_ascii(buf), np.uint8(32))


def _count(batches: Iterator[pa.RecordBatch], langs: list[str]) -> Iterator[pa.RecordBatch]:
    where = {x: k for k, x in enumerate(langs)}
    tables = grams(len(langs))
    width = [size for _, size in tables] + [N_SCRIPTS]
    total = [np.zeros((w, len(langs)), np.int64) for w in width]
    for batch in batches:
        lang = np.array([where[x] for x in batch.column(1).to_pylist()], np.int64)
        for lo, _, buf, offsets in pieces(batch.column(0)):
            of = lang[lo + owner(offsets, np.arange(len(buf)))]
            script = letter_scripts(buf)
            low = _normal(buf, script)
            for k, (n, size) in enumerate(tables):
                total[k] += np.bincount(gram_ids(low, n, size, offsets[:-1]) * len(langs) + of, minlength=size * len(langs)).reshape(size, -1)
            total[-1] += np.bincount(script.astype(np.int64) * len(langs) + of, minlength=N_SCRIPTS * len(langs)).reshape(N_SCRIPTS, -1)
    for k, t in enumerate(total):
        for j in range(len(langs)):
            at = np.flatnonzero(t[:, j])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(np.full(len(at), j)), pa.array(at), pa.array(t[at, j])], names=["part", "lang", "gram", "n"])


def fit(labelled: DataFrame, per_lang: int = SAMPLE_ROWS_PER_LANG) -> Model:
    """labelled: doc_id, text, lang. What reaches the driver is bounded by the tables' sizes and the number of languages, not by the rows."""
    labelled = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    counts = sorted((r["lang"], r["n"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect())
    if not counts:
        return Model([], [], np.zeros((N_SCRIPTS, 0), bool))
    langs = [x for x, _ in counts]
    cut = {x: min(1.0, per_lang / n) for x, n in counts if n > per_lang}
    limit = F.coalesce(F.create_map(*(F.lit(y) for item in cut.items() for y in item))[F.col("lang")], F.lit(1.0)) if cut else F.lit(1.0)
    roll = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # Few tasks count, as each one's tables are large; the scan itself and the sample's choice take all tasks there are.
    tasks = max(4, -(-sum(min(n, per_lang) for _, n in counts) // COUNT_ROWS))
    sample = labelled.where(roll < limit).select("text", "lang", "doc_id").repartition(tasks, F.xxhash64("doc_id", "text")).select("text", "lang")
    got = sample.mapInArrow(lambda b: _count(b, langs), "part long, lang long, gram long, n long").groupBy("part", "lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    tables = []
    for k, size in enumerate([s for _, s in grams(len(langs))] + [N_SCRIPTS]):
        mine = got[got["part"] == k]
        t = np.zeros((size, len(langs)))
        t[mine["gram"].to_numpy(int), mine["lang"].to_numpy(int)] = mine["n"].to_numpy(float)
        tables.append(t)
    letters = tables.pop()[1:]
    share = letters / np.maximum(letters.sum(0), 1)
    scripts = np.vstack((np.zeros((1, len(langs)), bool), share >= SCRIPT_SHARE))
    out = []
    for t in tables:
        p = np.log((t + SMOOTHING) / (t.sum(0) + SMOOTHING * len(t)))
        out.append((p - p.mean(1, keepdims=True)).astype(np.float32))
    return Model(langs, out, scripts)


def word_scripts(script: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The script of each word's first letter, 0 without a letter."""
    at = np.flatnonzero(script)
    k = np.searchsorted(at, starts)
    has = k < len(at)
    has[has] = at[k[has]] < ends[has]
    kind = np.zeros(len(starts), np.int64)
    kind[has] = script[at[k[has]]]
    return kind


def word_scores(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: Model, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """((words, langs) log scores, has the word a letter, may any language be written in its script) of texts that begin at begins. Words
    for which the last isn't so score 0."""
    total = np.zeros((len(starts), len(model.langs)))
    if not len(starts):
        return total, np.zeros(0, bool), np.zeros(0, bool)
    script = letter_scripts(buf)
    low = _normal(buf, script)
    stop = np.append(begins[1:], len(buf))[np.searchsorted(begins, starts, "right") - 1]
    reach = np.minimum(ends, stop - 1)  # the white space after a word is part of its last n-gram
    step = PIECE_BYTES * FULL_LANGS // len(model.langs)  # a long text of a piece of its own is scored in runs of so many bytes
    for (n, size), t in zip(grams(len(model.langs)), model.tables, strict=True):
        ids, a = gram_ids(low, n, size, begins), 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(reach, starts[a] + step)))
            lo, hi = (0 if a == 0 else int(starts[a])), (len(buf) if b == len(starts) else int(reach[b - 1]) + 1)
            upto = np.zeros((hi - lo + 1, len(model.langs)), np.float32)
            scores = t[ids[lo:hi]]
            scores[low[lo:hi] == 32] *= 0.5
            np.cumsum(scores, axis=0, out=upto[1:])
            total[a:b] += upto[reach[a:b] + 1 - lo] - upto[starts[a:b] - lo]
            a = b
    kind = word_scripts(script, starts, ends)
    allowed = model.scripts[kind]
    known = allowed.any(1)
    total[known] = np.where(allowed[known], total[known], -50.0)
    total[~known] = 0
    return total, kind > 0, known


def spans(scores: np.ndarray, first: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best label of every word; first: where each document's words begin, with the end after the last. All
    documents, longest first, take a step at once."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    lengths, begin = lengths[order], first[:-1][order]
    labels = np.zeros(len(scores), np.int64)
    if not len(scores) or scores.shape[1] < 2:
        return labels
    steps = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), "left")  # documents longer than the step
    stay = np.ones(scores.shape, bool)
    source = np.zeros(len(scores), np.int64)
    best = scores[begin[: active[0]]].copy()
    final = np.zeros(len(order), np.int64)
    for t in range(1, steps):
        n = active[t]
        if n < len(best):
            final[n : len(best)] = best[n:].argmax(1)
            best = best[:n]
        at = begin[:n] + t
        top = best.argmax(1)
        rival = best[np.arange(n), top] - penalty
        source[at] = top
        stay[at] = kept = best >= rival[:, None]
        best = np.where(kept, best, rival[:, None]) + scores[at]
    final[: len(best)] = best.argmax(1)
    now = np.zeros(len(order), np.int64)
    for t in range(steps - 1, -1, -1):
        n = active[t]
        m = active[t + 1] if t + 1 < steps else 0
        now[m:n] = final[m:n]
        at = begin[:n] + t
        labels[at] = now[:n]
        now[:n] = np.where(stay[at, now[:n]], now[:n], source[at])
    return labels


def label(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and score of each text, and its number of spans."""
    n = len(column)
    langs, score, n_spans = np.full(n, "und", object), np.zeros(n), np.zeros(n, np.int64)
    for lo, hi, buf, offsets in pieces(column, piece_bytes(len(model.langs))):
        if not model.langs:
            break
        starts, ends = word_spans(buf, offsets)
        docs = owner(offsets, starts)
        first = np.searchsorted(docs, np.arange(hi - lo + 1))
        scores, lettered, known = word_scores(buf, starts, ends, model, offsets[:-1])
        got = spans(scores, first)
        size = ends - starts
        mine = np.zeros((hi - lo, len(model.langs)))
        np.add.at(mine, (docs[known], got[known]), size[known])
        total = np.bincount(docs[lettered], size[lettered], hi - lo)
        langs[lo:hi] = np.array(model.langs, object)[mine.argmax(1)]
        score[lo:hi] = mine.max(1) / np.maximum(total, 1)
        new = np.ones(len(got), bool)
        new[1:] = (got[1:] != got[:-1]) | (docs[1:] != docs[:-1])
        n_spans[lo:hi] = np.bincount(docs[new], minlength=hi - lo)
    for k, text in enumerate(column.to_pylist()):
        if not text or not any(map(str.isalpha, text)):
            langs[k], score[k], n_spans[k] = "und", 0.0, 0
    return list(langs), score, n_spans


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document. No shuffle; the model travels with the tasks, of a size bounded by GRAMS and, beyond FULL_LANGS, LEAST_SLOTS for a language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, n_spans = label(batch.column(1), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(score), pa.array(n_spans)], names=["doc_id", "held_out", "lang_pred", "score", "n_spans"])

    return docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(work, "doc_id long, held_out boolean, lang_pred string, score double, n_spans long")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is known, with all their columns."""
    at = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, _ = label(batch.column(at), shared.value)
            yield batch.filter(pa.array(np.array([x != "und" for x in langs], bool) & (score >= REJECT_BELOW)))

    return docs.mapInArrow(work, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out())


__all__ = ["Model", "fit", "held_out", "keep_known", "label", "predict", "spans", "training_rows", "word_scores", "word_scripts"]
