"""The catalogue: one query for each operator family over the driver's tables, and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import arrays, edit, normalise, numbers, script, text, tokens
from tidemark.operators import commit, evaluate, prepare, segment, select
from tidemark.plans import file_queries, single_functions  # noqa: F401  register their queries
from tidemark.plans.bridge import FRAMES_SQL, PAIRS_SQL, frames, pairs, table, words
from tidemark.plans.registry import QUERIES, SQL, Query, query
from tidemark.sources import files, sinks
from tidemark.streaming import processors

r6 = lambda c: F.round(c, 6)

# --- error rates -----------------------------------------------------------------------------------------------------
_PUNCT = r"[!-/:-@\[-`{-~]|\p{P}"
#: Rows of the edit table, one after the other; a row's cells are the least of what comes from above and what goes on from the left, a running minimum.
_DISTANCE = """
rr AS (SELECT conv_id, turn, unnest(range(1, len(r) + 1)) AS i, unnest(r) AS w FROM norm), hh AS (SELECT conv_id, turn, unnest(range(1, len(h) + 1)) AS j, unnest(h) AS w FROM norm),
edge(conv_id, turn, i, j, v) AS (
  SELECT conv_id, turn, 0::BIGINT, unnest(range(len(h) + 1)), unnest(range(len(h) + 1)) FROM norm
  UNION ALL
  SELECT conv_id, turn, i, j, min(t - j) OVER (PARTITION BY conv_id, turn ORDER BY j) + j FROM (
    SELECT e.conv_id, e.turn, rr.i, e.j, least(v + 1, coalesce(lag(v) OVER (PARTITION BY e.conv_id, e.turn ORDER BY e.j) + CASE WHEN hh.w = rr.w THEN 0 ELSE 1 END, v + 1)) AS t
    FROM edge e JOIN rr ON rr.conv_id = e.conv_id AND rr.turn = e.turn AND rr.i = e.i + 1 LEFT JOIN hh ON hh.conv_id = e.conv_id AND hh.turn = e.turn AND hh.j = e.j)),
rates AS (SELECT conv_id, turn, len(r) AS n_ref, len(h) AS n_hyp, v AS edits FROM edge JOIN norm USING (conv_id, turn) WHERE i = len(r) AND j = len(h))
"""
_NORM = f"""
norm AS (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(lower(array_to_string(ref, ' ')), '{_PUNCT}', ' ', 'g'), '\\s+'), lambda x: x <> '') AS r,
  list_filter(string_split_regex(regexp_replace(lower(array_to_string(hyp, ' ')), '{_PUNCT}', ' ', 'g'), '\\s+'), lambda x: x <> '') AS h FROM pairs)
"""
_RATES = f"WITH RECURSIVE {PAIRS_SQL}, {_NORM}, {_DISTANCE}"
_RATE = "CASE WHEN n_ref = 0 THEN CASE WHEN n_hyp = 0 THEN 0.0 ELSE 1.0 END ELSE edits / n_ref END"
#: DuckDB's levenshtein compares bytes, so letters of two bytes are put to ASCII's capitals and signs first, which are gone by then.
_TWO_BYTES = "ß" + "".join(chr(c) for c in range(0xE0, 0x100) if c != 0xF7)


def _bare(x: str) -> str:
    """A text as the character error rate of languages without Han sees it."""
    trimmed = lambda t: rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"
    bare = rf"regexp_replace(lower({trimmed(x)}), '[!-/:-@\[-`{{-~]', '', 'g')"
    return trimmed(f"translate({bare}, '{_TWO_BYTES}', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&*')")


_CER = "CASE WHEN length(cr) = 0 THEN CASE WHEN length(ch) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein(cr, ch) / length(cr) END"
_METRICS = f"""{_RATES}, texts AS (SELECT conv_id, turn, array_to_string(ref, ' ') AS reference, array_to_string(hyp, ' ') AS generated FROM pairs),
metrics AS (SELECT conv_id, turn, reference, generated, {_CER} AS cer, {_RATE} AS mer FROM (SELECT *, {_bare('reference')} AS cr, {_bare('generated')} AS ch FROM texts) JOIN rates USING (conv_id, turn))"""


def _joined_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).select("conv_id", "turn", F.array_join("ref", " ").alias("reference"), F.array_join("hyp", " ").alias("generated"))


@query(_RATES + f"SELECT conv_id, turn, n_ref, n_hyp, edits, round({_RATE}, 6) AS mer FROM rates")
def q_mer_rows(spark, sf_dir):
    norm = [text.mixed_tokens(text.for_mixed_rate(c, F.lit("en")), F.lit("en")) for c in ("reference", "generated")]
    rows = _joined_pairs(spark, sf_dir).select("conv_id", "turn", norm[0].alias("r"), norm[1].alias("h"))
    rows = rows.select("conv_id", "turn", F.size("r").cast("bigint").alias("n_ref"), F.size("h").cast("bigint").alias("n_hyp"), edit.token_distance("r", "h").cast("bigint").alias("edits"))
    return rows.withColumn("mer", r6(edit.rate(F.col("edits"), F.col("n_ref"), F.col("n_hyp"))))


@query(_RATES + f"SELECT conv_id, turn, round({_RATE}, 6) AS mer FROM rates")
def q_mixed_error_rate(spark, sf_dir):
    return _joined_pairs(spark, sf_dir).select("conv_id", "turn", r6(edit.mixed_error_rate("reference", "generated", F.lit("en"))).alias("mer"))


def _matched(spark, sf_dir):
    """Each fourth turn has no hypothesis."""
    rows = _joined_pairs(spark, sf_dir).withColumn("file", F.concat_ws("-", "conv_id", "turn"))
    return rows, evaluate.matched(rows.select("file", "reference", "turn"), rows.where("turn % 4 <> 3").select("file", "generated"))


@query(_METRICS + "SELECT conv_id || '-' || turn AS file, round(cer, 6) AS cer, round(mer, 6) AS mer, length(reference) AS ref_length, length(generated) AS gen_length FROM metrics WHERE turn % 4 <> 3")
def q_metric_rows(spark, sf_dir):
    _, found = _matched(spark, sf_dir)
    return evaluate.metric_rows(found, F.lit("en")).select("file", r6("cer").alias("cer"), r6("mer").alias("mer"), "ref_length", "gen_length")


@query(_METRICS + """SELECT count(*) AS total_files, count(*) FILTER (WHERE turn % 4 <> 3) AS matched_files, count(*) FILTER (WHERE turn % 4 = 3) AS unmatched_files,
  round(coalesce(avg(cer) FILTER (WHERE turn % 4 <> 3), 0.0), 6) AS average_cer, round(coalesce(avg(mer) FILTER (WHERE turn % 4 <> 3), 0.0), 6) AS average_mer, round(avg(1000.0 * (turn + 1)) FILTER (WHERE turn % 4 <> 3), 6) AS average_first_ms FROM metrics""")
def q_mer_summary(spark, sf_dir):
    """Latencies are a second for each turn up to it."""
    rows, found = _matched(spark, sf_dir)
    late = rows.select("file", (F.col("turn") + 1).cast("double").alias("first_token_latency"), F.lit(0.0).alias("last_token_latency"))
    got = evaluate.summary(found, evaluate.with_latencies(evaluate.metric_rows(found, F.lit("en")), late))
    return got.select("total_files", "matched_files", "unmatched_files", r6("average_cer").alias("average_cer"), r6("average_mer").alias("average_mer"), r6("average_first_token_latency_ms").alias("average_first_ms"))


@query(f"""SELECT doc_id, length(cr) AS n_ref, round(levenshtein(cr, ch) / length(cr), 6) AS cer
FROM (SELECT doc_id, {_bare("text")} AS cr, {_bare("replace(substr(text, 3), 'x', 'ks')")} AS ch FROM documents) WHERE length(cr) > 0 AND length(ch) > 0""")
def q_cer_rows(spark, sf_dir):
    """Whole texts against themselves without their first two characters and with each x as ks."""
    docs = evaluate.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.select("doc_id", F.col("text").alias("a"), F.replace(F.expr("substring(text, 3)"), F.lit("x"), F.lit("ks")).alias("b"))
    r, h = text.for_character_rate("a", "b", F.lit("en"))
    # Texts of which something is left; a filter on what comes out of Python would be evaluated there a second time.
    some = lambda c: F.col(c).rlike(r"(?U)[^\s!-/:-@\[-`{-~]")
    rows = docs.where(some("a") & some("b")).select("doc_id", edit.compared(text.strip(r), text.strip(h)).alias("c"))
    return rows.select("doc_id", F.col("c.n_a").alias("n_ref"), r6(F.col("c.edits") / F.col("c.n_a")).alias("cer"))


_NAMES = r"regexp_replace(lower(trim(n_name)), '[!-/:-@\[-`{-~]', '', 'g')"


@query(f"""
WITH RECURSIVE n AS (SELECT n_nationkey AS k, {_NAMES} AS r, {_NAMES.replace('n_name', "replace(n_name, 'A', 'EE')")} AS h FROM nation),
norm AS (SELECT k AS conv_id, 0 AS turn, string_split(r, '') AS r, string_split(h, '') AS h FROM n), {_DISTANCE} SELECT CAST(conv_id AS INTEGER) AS n_nationkey, round(edits / n_ref, 6) AS cer FROM rates""")
def q_character_error_rate(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").withColumn("h", F.replace("n_name", F.lit("A"), F.lit("EE")))
    return rows.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), r6(edit.character_error_rate("n_name", "h", F.lit("en"))).alias("cer"))


@query(f"WITH RECURSIVE {PAIRS_SQL}, norm AS (SELECT conv_id, turn, ref AS r, hyp AS h FROM pairs), {_DISTANCE} SELECT conv_id, turn, CAST(edits AS INTEGER) AS edits FROM rates")
def q_token_distance_long(spark, sf_dir):
    return evaluate.spread(pairs(spark, sf_dir)).select("conv_id", "turn", edit.token_distance_long("ref", "hyp").alias("edits"))


# --- normalisation and tokens ------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, md5(regexp_replace(text, '{_PUNCT}', ' ', 'g')) AS spaced, md5(regexp_replace(text, '\\p{{P}}', '', 'g')) AS dropped FROM documents")
def q_norm_punct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.punctuation_to_space("text")).alias("spaced"), F.md5(text.drop_punctuation("text")).alias("dropped"))


@query("SELECT doc_id, md5(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS low, md5(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS up FROM documents")
def q_ascii_case(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.ascii_lower("text")).alias("low"), F.md5(text.ascii_upper("text")).alias("up"))


#: Digits as characters, among them variants and some beyond the basic plane.
_AS_CHARACTERS = ("0123456789", "两兩俩萬億a世界x𠀀")
_IN_CHARACTERS = "translate(CAST(p_partkey AS VARCHAR), '{}', '{}')".format(*_AS_CHARACTERS)


@query(f"SELECT p_partkey, translate(s, '两兩俩萬億', '二二二万亿') AS v, regexp_matches(s, '[\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{20000}}-\\x{{2EBEF}}]') AS cjk FROM (SELECT p_partkey, {_IN_CHARACTERS} AS s FROM part)")
def q_variants(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.translate(F.col("p_partkey").cast("string"), *_AS_CHARACTERS).alias("s"))
    return rows.select("p_partkey", text.unify_variants("s").alias("v"), text.has_cjk("s").alias("cjk"))


@query("""SELECT doc_id, CASE WHEN text = '' THEN NULL WHEN lower(source) IN ('yue', 'zh') THEN lower(source) WHEN regexp_matches(source, 'src1$|yue|canton|hongkong|hk') AND source <> 'src1' THEN 'yue' WHEN regexp_matches(source, 'zh|cmn|mandarin|chi|cn') THEN 'zh' ELSE NULL END AS resolved FROM documents""")
def q_lang_resolve(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalisation_language("source", "text").alias("resolved"))


@query(r"""SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, '|')) AS joined FROM (SELECT doc_id, regexp_extract_all(text, '[\x21-\x7E]+|[^\s\x00-\x7F]') AS t FROM documents)""")
def q_mixed_tokens(spark, sf_dir):
    t = text.mixed_tokens("text", F.lit("zh"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.md5(F.array_join(t, "|")).alias("joined"))


@query(rf"""SELECT doc_id, md5(translate(regexp_replace(text, '{_PUNCT}', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS t FROM documents""")
def q_latin_han_spacing(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.for_training("text")).alias("t"))


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+|[\x{4E00}-\x{9FFF}]|\s+|\S')) AS w FROM documents)
SELECT doc_id, CAST(sum(CASE WHEN regexp_full_match(w, '[A-Za-z]+') THEN len(regexp_extract_all(w, '[^aeiouyAEIOUY]*[aeiouyAEIOUY]+|[^aeiouyAEIOUY]+')) ELSE 1 END) AS BIGINT) AS n FROM w GROUP BY doc_id
""")
def q_syllables(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.size(text.syllables("text")).cast("bigint").alias("n"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '[<\[][^>\]]*[>\]]', '', 'g'), '\(([^)]+?)\)', '', 'g'), '[\p{M}\p{S}\p{P}]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents""")
def q_html_strip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.strip_brackets("text")).alias("t"))


_EXTRA_SQL = "lower(text)"
for _a, _b in normalise.EXTRA.items():
    if _a == _a.lower():
        _EXTRA_SQL = f"replace({_EXTRA_SQL}, '{_a}', '{_b}')"


@query(rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(strip_accents(regexp_replace(regexp_replace({_EXTRA_SQL}, '[<\[][^>\]]*[>\]]', '', 'g'), '\(([^)]+?)\)', '', 'g')), '[\p{{M}}\p{{S}}\p{{P}}]', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM documents""")
def q_basic_normaliser(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(normalise.basic("text", remove_diacritics=True)).alias("t"))


_UNIT_WORDS = ["", *"one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()]
_TEN_WORDS = ["", "", *"twenty thirty forty fifty sixty seventy eighty ninety".split()]


def _spelled(n):
    """A number below a million in words, from their lists."""
    units, tens = F.array(*map(F.lit, _UNIT_WORDS)), F.array(*map(F.lit, _TEN_WORDS))

    def below_thousand(x):
        h, r = F.floor(x / 100).cast("int"), (x % 100).cast("int")
        small = F.when(r < 20, F.get(units, r)).otherwise(F.concat_ws(" ", F.get(tens, F.floor(r / 10).cast("int")), F.nullif(F.get(units, r % 10), F.lit(""))))
        return F.concat_ws(" and ", F.when(h > 0, F.concat(F.get(units, h), F.lit(" hundred"))), F.nullif(small, F.lit("")))

    t, r = F.floor(n / 1000), n % 1000
    return F.concat_ws(" ", F.when(t > 0, F.concat(below_thousand(t), F.lit(" thousand"))), F.nullif(below_thousand(r), F.lit("")))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN '$' || n WHEN 1 THEN 'paid ' || n || '%' WHEN 2 THEN '-' || n || ' left' ELSE n || '.' || l_linenumber || ' of' END AS n
FROM (SELECT l_orderkey, l_linenumber, CAST(l_orderkey % 999983 + 16 AS VARCHAR) AS n FROM lineitem)""")
def q_en_numbers(spark, sf_dir):
    """Numbers spelled out, with money, percent, a sign or a decimal, read back."""
    k, line = F.col("l_linenumber") % 4, F.get(F.array(*map(F.lit, _UNIT_WORDS)), F.col("l_linenumber").cast("int"))
    n = _spelled(F.col("l_orderkey") % 999_983 + 16)
    said = F.when(k == 0, F.concat(n, F.lit(" dollars"))).when(k == 1, F.concat(F.lit("paid "), n, F.lit(" per cent"))).when(k == 2, F.concat(F.lit("minus "), n, F.lit(" left"))).otherwise(F.concat(n, F.lit(" point "), line, F.lit(" of")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.english_numbers_column(said).alias("n"))


@query()
def q_en_normaliser(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", normalise.english("text").alias("t"))


_GROUP = r"regexp_replace(regexp_replace(regexp_replace(printf('%04d', {0}), '^(.)(.)(.)(.)$', '\1千\2百\3十\4'), '0[千百十]?', '0', 'g'), '0+$', '')"
_ZERO = r"regexp_replace(translate(regexp_replace({0}, '0+', '0', 'g'), '0123456789', '零一二三四五六七八九'), '^零|零$', '', 'g')"


def _numeral_sql(n: str) -> str:
    """The Chinese numeral of a number below 10^8, by DuckDB."""
    low, high = _GROUP.format(f"{n} % 10000"), _GROUP.format(f"{n} // 10000")
    both = _ZERO.format(f"CASE WHEN {n} >= 10000 THEN {high} || '万' || {low} ELSE {low} END")
    return f"CASE WHEN {n} = 0 THEN '零' ELSE regexp_replace({both}, '^一十', '十') END"


@query(f"SELECT p_partkey, '百分之' || {_numeral_sql('p_size')} || '和' || {_numeral_sql('p_partkey')} || '或' || {_numeral_sql('(p_partkey * 1009)')} AS n FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)")
def q_zh_numbers(spark, sf_dir):
    said = F.concat(F.col("p_size").cast("string"), F.lit("%和"), F.col("p_partkey").cast("string"), F.lit("或"), (F.col("p_partkey") * 1009).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", numbers.han_numbers_column(said, F.lit("zh")).alias("n"))


_PHRASES = [x.split() for x in script.PHRASES.split("|")]
_SAID = [f"p_partkey * {k} % {len(_PHRASES)}" for k in (1, 7, 13)] + [f"p_size % {len(_PHRASES)}"]


def _said_sql(which: int) -> str:
    phrases = "[" + ", ".join(f"'{p[which]}'" for p in _PHRASES) + "]"
    return " || '的' || ".join(f"({phrases})[CAST({k} AS BIGINT) + 1]" for k in _SAID)


@query(f"SELECT p_partkey, {_said_sql(1)} AS traditional, {_said_sql(0)} AS simple FROM part")
def q_script_phrases(spark, sf_dir):
    """Words of which a character is converted differently alone, put together by part, to the other script and back."""
    said = F.concat_ws("的", *(F.get(F.array(*(F.lit(a) for a, _ in _PHRASES)), F.expr(k).cast("int")) for k in _SAID))
    up = script.converted(said, F.lit("yue"))
    return table(spark, sf_dir, "part").select("p_partkey", up.alias("traditional")).withColumn("simple", script.converted("traditional", F.lit("zh")))


@query()
def q_compression_ratio(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", r6(arrays.compression_ratio("text")).alias("ratio"))


@query(r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+') AS t FROM conversations),
e AS (SELECT conv_id, turn, unnest(range(len(t))) AS k, unnest(t) AS x FROM t),
g AS (SELECT *, sum(CASE WHEN k = 0 OR starts_with(x, ' ') OR regexp_full_match(trim(x), '[!-/:-@\[-`{-~]') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY k) AS g FROM e),
w AS (SELECT conv_id, turn, g, string_agg(x, '' ORDER BY k) AS w FROM g GROUP BY ALL)
SELECT conv_id, turn, string_agg(w, '|' ORDER BY g) AS words FROM w GROUP BY ALL""")
def q_words_from_pieces(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text <> ''")
    return rows.select("conv_id", "turn", F.array_join(tokens.words_from_pieces(tokens.pre_tokens("text")), "|").alias("words"))


# --- paths, sources and prompts -----------------------------------------------------------------------------------------
@query(r"""SELECT page_id, b AS base, regexp_replace(b, '^(.+)\.[^.]*$', '\1') AS stem FROM (SELECT page_id, string_split(url, '/')[-1] AS b FROM pages)""")
def q_url_stem(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.base_name("url").alias("base"), text.stem("url").alias("stem"))


@query(r"""SELECT doc_id, TRY_CAST(nullif(regexp_extract(source, '(\d+)', 1), '') AS INTEGER) AS n FROM documents""")
def q_first_int(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.first_integer("source").alias("n"))


@query(r"""SELECT doc_id, regexp_replace(text, chr(65533) || '+$', '') = text AS same, source || '/' || doc_id || '.wav' AS path FROM documents""")
def q_paths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", (text.strip_replacement_marks("text") == F.col("text")).alias("same"), text.join_path("source", F.concat(F.col("doc_id").cast("string"), F.lit(".wav"))).alias("path"))


_K_BEST = f"{PAIRS_SQL}, k AS (SELECT conv_id, list(array_to_string(hyp, ' ') ORDER BY turn) AS c, min_by(array_to_string(ref, ' '), turn) AS p FROM pairs GROUP BY conv_id)"


def _k_best(rows):
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.array_join("hyp", " ").alias("h")))).alias("l"), F.min_by(F.array_join("ref", " "), "turn").alias("p"))
    return rows.select("conv_id", F.transform("l", lambda x: x["h"]).alias("c"), "p")


@query(f"""WITH {_K_BEST} SELECT conv_id, md5('Given the following ASR transcription candidates, predict the correct continuation.' || chr(10) || chr(10) || 'Previous confirmed transcript: "' || p || '"' || chr(10) || chr(10) || 'K-best candidates for the continuation:' || chr(10)
  || array_to_string(list_transform(list_zip(c[1:3], range(1, 4)), lambda z: '  ' || z[2] || '. ' || z[1])[1:least(3, len(c))], chr(10)) || chr(10) || chr(10) || 'Based on the context and candidates, what is the correct text that should be appended after "' || p || '"?') AS prompt FROM k""")
def q_prompt_format(spark, sf_dir):
    return _k_best(pairs(spark, sf_dir)).select("conv_id", F.md5(text.prompt("c", "p", 3)).alias("prompt"))


@query(f"WITH {_K_BEST} SELECT conv_id, coalesce(list_filter(c, lambda x: trim(x) <> '')[1], '') AS top, len(list_filter(c, lambda x: trim(x) <> '')) AS n FROM k")
def q_kbest(spark, sf_dir):
    return _k_best(pairs(spark, sf_dir)).select("conv_id", text.first_not_blank("c").alias("top"), F.size(text.drop_blank("c")).cast("bigint").alias("n"))


_EVENT_LINES = """
e AS (SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line_no, event_type, event_id FROM events),
lines AS (SELECT file, line_no, CASE event_type WHEN 'view' THEN 'DEBUG    <|startoftranscript|><|zh|><|transcribe|><|notimestamps|>c' || event_id WHEN 'click' THEN 'INFO Decoding loop starts' WHEN 'error' THEN 'INFO    Output: o' || event_id
  WHEN 'signup' THEN 'INFO Previous confirmed transcript: p' || event_id ELSE 'INFO  The system received audio from ' || line_no || '.5 s to ' || (line_no + 1) || '.5 s' END AS value FROM e)
"""


def _event_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("line_no"), "event_type", "event_id")
    t, n = F.col("event_type"), F.col("event_id").cast("string")
    value = (
        F.when(t == "view", F.concat(F.lit("DEBUG    <|startoftranscript|><|zh|><|transcribe|><|notimestamps|>c"), n)).when(t == "click", F.lit("INFO Decoding loop starts"))
        .when(t == "error", F.concat(F.lit("INFO    Output: o"), n)).when(t == "signup", F.concat(F.lit("INFO Previous confirmed transcript: p"), n))
        .otherwise(F.concat(F.lit("INFO  The system received audio from "), F.col("line_no").cast("string"), F.lit(".5 s to "), (F.col("line_no") + 1).cast("string"), F.lit(".5 s")))
    )
    return rows.select("file", "line_no", value.alias("value"))


@query(f"""WITH {_EVENT_LINES},
c AS (SELECT *, sum(CASE WHEN value LIKE 'INFO  The system%' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no) AS chunk FROM lines),
l AS (SELECT *, sum(CASE WHEN value LIKE 'INFO Decoding%' THEN 1 ELSE 0 END) OVER (PARTITION BY file, chunk ORDER BY line_no) AS loop FROM c WHERE chunk > 0),
m AS (SELECT *, max(loop) OVER (PARTITION BY file, chunk) AS last_loop FROM l),
g AS (SELECT file, chunk, max(regexp_extract(value, 'from ([\\d.]+) s', 1)) AS s, list(regexp_extract(value, 'notimestamps\\|>(.*)$', 1) ORDER BY line_no) FILTER (WHERE value LIKE 'DEBUG%' AND loop = last_loop) AS d,
  list(regexp_extract(value, 'Output: (.*)$', 1) ORDER BY line_no) FILTER (WHERE value LIKE '%Output:%') AS o, max_by(regexp_extract(value, 'transcript: (.*)$', 1), line_no) FILTER (WHERE value LIKE '%confirmed%') AS p FROM m GROUP BY file, chunk)
SELECT file, CAST(chunk AS BIGINT) AS chunk, CAST(s AS DOUBLE) AS start, coalesce(p, '') AS previous_transcript, coalesce(array_to_string(d[greatest(len(d) - 3, 1):], '|'), '') AS topk, coalesce(array_to_string(o, '|'), '') AS outputs FROM g""")
def q_log_parse(spark, sf_dir):
    got = files.log_chunks(_event_lines(spark, sf_dir))
    return got.select("file", "chunk", "start", "previous_transcript", F.array_join("topk", "|").alias("topk"), F.array_join("outputs", "|").alias("outputs"))


@query(f"WITH {_EVENT_LINES} SELECT file, trim(replace(max_by(value, line_no), 'INFO    Output:', '')) AS text FROM lines WHERE value LIKE 'INFO    Output:%' GROUP BY file")
def q_last_marked(spark, sf_dir):
    return files.last_marked(_event_lines(spark, sf_dir), "INFO    Output:")


@query("SELECT doc_id, CASE WHEN text LIKE '%' || chr(9) || '%' THEN NULL ELSE 'short' END AS skipped FROM documents WHERE trim(text, ' ' || chr(10)) <> '' AND text NOT LIKE '#%'")
def q_tab_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where(r"trim(BOTH ' \n' FROM text) <> '' AND text NOT LIKE '#%'").select("doc_id", F.col("text").alias("value"))
    return rows.select("doc_id", files.why_skipped("value").alias("skipped"))


# --- evaluation joins ---------------------------------------------------------------------------------------------------
@query("SELECT d.doc_id, l.quality IS NOT NULL AS is_matched, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def q_eval_join(spark, sf_dir):
    refs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), F.col("text").alias("reference"))
    hyps = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file"), F.col("quality").alias("generated"))
    return evaluate.matched(refs, hyps).select(F.col("file").alias("doc_id"), "is_matched", F.col("generated").alias("quality"))


@query("SELECT count(*) AS total_files, count(l.doc_id) AS matched_files, count(*) - count(l.doc_id) AS unmatched_files FROM documents d LEFT JOIN labels l USING (doc_id)")
def q_eval_unmatched(spark, sf_dir):
    got = q_eval_join(spark, sf_dir)
    return got.agg(F.count("*").alias("total_files"), F.count_if("is_matched").alias("matched_files"), F.count_if(~F.col("is_matched")).alias("unmatched_files"))


@query(r"""
WITH k AS (SELECT page_id, unnest(list_distinct([b, regexp_replace(b, '^(.+)\.[^.]*$', '\1')])) AS file FROM (SELECT page_id, string_split(url, '/')[-1] AS b FROM pages))
SELECT file, max(page_id) AS page_id FROM k GROUP BY file""")
def q_dual_key(spark, sf_dir):
    return evaluate.dual_keyed(table(spark, sf_dir, "pages").select("page_id", "url"), "url", "page_id").select("file", "page_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_anti_processed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return prepare.not_processed(docs, table(spark, sf_dir, "labels"), F.col("doc_id"), F.col("doc_id"))


@query("SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE d.doc_id = b.item_id)")
def q_semi_benchmark(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "benchmark"), F.col("doc_id") == F.col("item_id"), "left_semi").select("doc_id")


@query("SELECT user_id, round(min_by(value, event_id), 6) AS first_token_latency, round(max_by(value, event_id), 6) AS last_token_latency FROM events WHERE event_type <> 'signup' GROUP BY user_id")
def q_first_last_latency(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("emitted"), F.lit(0.0).alias("received"), (F.col("event_type") == "signup").alias("warm"))
    got = evaluate.latencies(rows, "user_id", "emitted", "received", "event_id", "warm")
    return got.select("user_id", r6("first_token_latency").alias("first_token_latency"), r6("last_token_latency").alias("last_token_latency"))


@query(f"WITH {FRAMES_SQL} SELECT e.event_id, (SELECT max_by(c.value, c.event_id) FROM frames c WHERE c.user_id = e.user_id AND c.event_type = 'click' AND c.t <= e.t) AS click_value FROM frames e WHERE e.event_type = 'purchase'")
def q_as_of_click(spark, sf_dir):
    rows = frames(spark, sf_dir)
    clicks = rows.where("event_type = 'click'").select("user_id", F.col("t").alias("ct"), F.col("value").alias("click_value"))
    return evaluate.as_of(rows.where("event_type = 'purchase'").select("event_id", "user_id", "t"), clicks, "user_id", "t", "ct", "click_value").select("event_id", "click_value")


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS final_text, count(*) AS n FROM conversations GROUP BY conv_id")
def q_transcript_concat(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").cast("double").alias("start"), F.col("turn").cast("double").alias("end"), "text")
    return evaluate.run_results(rows, "conv_id", "turn").select("conv_id", "final_text", F.size("segments").cast("bigint").alias("n"))


@query("SELECT count(*) AS total_files, count(text) AS processed_files, round(avg(turn), 6) AS average_first FROM conversations")
def q_batch_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("file"), F.lit(1.0).alias("duration"), F.col("text").alias("transcription"), F.col("turn").cast("double").alias("first_token_latency_ms"), F.lit(None).cast("double").alias("last_token_latency_ms"))
    return sinks.batch_summary(rows).select("total_files", "processed_files", r6("average_first_token_latency_ms").alias("average_first"))


# --- segmentation ---------------------------------------------------------------------------------------------------------
@query("""WITH d AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS duration FROM part),
c AS (SELECT p_partkey, duration, unnest(range(CAST(greatest(ceil(duration / 7), 1) AS BIGINT))) AS chunk FROM d)
SELECT p_partkey, CAST(chunk AS INTEGER) AS chunk, CAST(chunk * 7 AS DOUBLE) AS beg, CAST(CASE WHEN chunk = 0 THEN 7 ELSE least(chunk * 7 + 7, duration) END AS DOUBLE) AS "end" FROM c""")
def q_chunks_clip(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("duration"))
    return segment.chunks(parts, "duration", 7.0).select("p_partkey", "chunk", "beg", "end")


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_chunks_tumbling(spark, sf_dir):
    from tidemark.streaming.sources import tumbling

    return tumbling(table(spark, sf_dir, "events"), "ts", "1 day", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(f"""WITH {FRAMES_SQL},
g AS (SELECT user_id, t, value, sum(CASE WHEN value >= 70 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS grp FROM frames),
a AS (SELECT user_id, grp, min(t) FILTER (WHERE value >= 70) AS s, min(t) FILTER (WHERE value < 55) AS e, max(t) FILTER (WHERE value < 55) AS l FROM g WHERE grp > 0 GROUP BY user_id, grp),
b AS (SELECT *, coalesce(l - e >= 86400, FALSE) AS ends FROM a),
c AS (SELECT *, coalesce(lag(ends) OVER (PARTITION BY user_id ORDER BY grp), TRUE) AS starts FROM b)
SELECT user_id, 'start' AS event, round(s, 3) AS at FROM c WHERE starts UNION ALL SELECT user_id, 'end', round(e, 3) FROM c WHERE ends""")
def q_vad_segments(spark, sf_dir):
    got = segment.hysteresis(frames(spark, sf_dir), "user_id", "event_id", F.col("value") >= 70, F.col("value") < 55, F.col("t"), 86400.0)
    return got.select("user_id", "event", F.round("at", 3).alias("at"))


@query(f"""WITH {FRAMES_SQL}, n AS (SELECT event_id, user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY event_id) > 43200 THEN 1 ELSE 0 END AS fresh FROM frames)
SELECT event_id, user_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS session FROM n""")
def q_gap_sessions(spark, sf_dir):
    return segment.gap_sessions(frames(spark, sf_dir), "user_id", F.col("t"), ["event_id"], 43200).select("event_id", "user_id", "session")


@query("""WITH f AS (SELECT event_id, user_id, event_type IN ('view', 'click') AS ts FROM events), c AS (SELECT *, CASE WHEN ts AND lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) THEN 1 ELSE 0 END AS cut FROM f)
SELECT event_id, CAST(sum(cut) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS segment FROM c""")
def q_pair_segments(spark, sf_dir):
    return segment.pair_segments(table(spark, sf_dir, "events"), "user_id", ["event_id"], F.col("event_type").isin("view", "click")).select("event_id", "segment")


@query(f"""WITH {FRAMES_SQL} SELECT event_id, round(sum(value) OVER w, 4) AS buffered, count(*) OVER w AS n_buffered FROM (SELECT *, CAST(floor(t) AS BIGINT) AS sec FROM frames) WINDOW w AS (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)""")
def q_buffer_30(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("sec", F.floor("t"))
    return segment.retained(rows, "user_id", F.col("sec"), 86400, "value").select("event_id", F.round("buffered", 4).alias("buffered"), "n_buffered")


@query("""WITH n AS (SELECT conv_id, turn, length(text) AS n FROM conversations), s AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS upto FROM n)
SELECT conv_id, turn FROM s WHERE upto <= 600""")
def q_context_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("n", F.length("text"))
    return segment.within_budget(rows, "conv_id", ["turn"], "n", 600).select("conv_id", "turn")


@query("""WITH m AS (SELECT *, max(event_type) OVER (PARTITION BY user_id) AS last_type FROM events), r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM m WHERE event_type = last_type)
SELECT event_id, user_id FROM r WHERE k <= 4""")
def q_last_of_subgroup(spark, sf_dir):
    return segment.last_of_subgroup(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id", 4).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def q_changed_lines(spark, sf_dir):
    return commit.changed_lines(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("event_id", "user_id")


_EVENTS_IN_ORDER = "o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id, value FROM events)"


@query(f"""WITH RECURSIVE {_EVENTS_IN_ORDER},
m AS (SELECT user_id, k, event_id, value AS s FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, o.event_id, CASE WHEN m.s > 500 THEN 0 ELSE m.s END + o.value FROM m JOIN o ON o.user_id = m.user_id AND o.k = m.k + 1)
SELECT user_id, event_id, s > 500 AS runs FROM m""")
def q_triggered(spark, sf_dir):
    return segment.triggered(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 500.0)


# --- commit policies ------------------------------------------------------------------------------------------------------
@query("""WITH p AS (SELECT conv_id, turn, text AS b, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS a FROM conversations),
n AS (SELECT conv_id, turn, list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda k: a[1:k] = b[1:k])) AS k, b FROM p)
SELECT conv_id, turn, k AS n_agreed, CASE WHEN k = 0 THEN '' ELSE b[1:k] END AS agreed FROM n""")
def q_lcp_prev(spark, sf_dir):
    got = commit.prefix_agreement(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("t")), "conv_id", "turn", "t")
    return got.select("conv_id", "turn", F.length("agreed").cast("bigint").alias("n_agreed"), "agreed")


@query("""WITH RECURSIVE o AS (SELECT conv_id, turn, 'the same start ' || text AS f, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE trim(text) <> ''),
c AS (SELECT conv_id, turn, k, coalesce(lag(f) OVER (PARTITION BY conv_id ORDER BY k), '') AS p, f FROM o),
d AS (SELECT conv_id, turn, k, f[1:list_max(list_filter(range(0, least(length(p), length(f)) + 1), lambda n: p[1:n] = f[1:n]))] AS g FROM c),
m AS (SELECT conv_id, turn, k, g AS delta, g AS committed FROM d WHERE k = 1 UNION ALL
  SELECT conv_id, turn, k, delta, committed || delta FROM (SELECT d.conv_id, d.turn, d.k, m.committed,
    CASE WHEN starts_with(d.g, m.committed) THEN d.g[length(m.committed) + 1:] WHEN d.g = '' THEN ''
      ELSE coalesce(list_sort(list_filter(flatten(list_transform(range(1, length(d.g) + 1), lambda j: list_transform(range(j, length(d.g) + 1), lambda e: {'n': j - e - 1, 'a': instr(m.committed, d.g[j:e]), 'b': j, 'rest': d.g[e + 1:]}))), lambda x: x.a > 0))[1].rest, d.g) END AS delta
    FROM m JOIN d ON d.conv_id = m.conv_id AND d.k = m.k + 1))
SELECT conv_id, turn, delta, committed FROM m""")
def q_local_agreement(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("the same start "), "text").alias("text"), F.lit(False).alias("is_last"))
    return commit.local_agreement(rows, "conv_id", "turn", "text", "is_last")


@query("""WITH RECURSIVE o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id, value AS b, value + 5 AS e FROM events),
m AS (SELECT user_id, k, event_id, b, greatest(e, b + 0.001) AS e FROM o WHERE k = 1 UNION ALL
  SELECT o.user_id, o.k, o.event_id, greatest(o.b, m.e + 0.001), greatest(o.e, greatest(o.b, m.e + 0.001) + 0.001) FROM m JOIN o ON o.user_id = m.user_id AND o.k = m.k + 1)
SELECT user_id, event_id, round(b, 4) AS beg, round(e, 4) AS "end" FROM m""")
def q_monotone_clamp(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("beg"), (F.col("value") + 5).alias("end"))
    return commit.monotone(rows, "user_id", "event_id", "beg", "end").select("user_id", "event_id", F.round("beg", 4).alias("beg"), F.round("end", 4).alias("end"))


@query("""WITH s AS (SELECT user_id, event_id, min(event_id) FILTER (WHERE 490 - value <= 20) OVER (PARTITION BY user_id) AS cut FROM events) SELECT user_id, event_id FROM s WHERE cut IS NULL OR event_id < cut""")
def q_alignatt_cut(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("content", F.lit(490.0))
    return commit.attention_cut(rows, "user_id", "event_id", "value", "content", 20).select("user_id", "event_id")


@query("""WITH l AS (SELECT user_id, event_id, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) - value > 150 AS back FROM events),
s AS (SELECT user_id, event_id, min(event_id) FILTER (WHERE back) OVER (PARTITION BY user_id) AS cut FROM l) SELECT user_id, event_id FROM s WHERE cut IS NULL OR event_id < cut""")
def q_rewind_cut(spark, sf_dir):
    return commit.rewind_cut(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 150).select("user_id", "event_id")


@query(f"WITH {PAIRS_SQL} SELECT conv_id, turn, len(CASE WHEN turn % 2 = 0 THEN ref ELSE ref[1:greatest(len(ref) - 1, 0)] END) AS n FROM pairs")
def q_last_word(spark, sf_dir):
    got = commit.committed_words("ref", F.col("turn") % 2 == 0, F.lit(False))
    return pairs(spark, sf_dir).select("conv_id", "turn", F.size(got).cast("bigint").alias("n"))


# --- arrays ---------------------------------------------------------------------------------------------------------------
def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def _flat(df: DataFrame, c) -> DataFrame:
    return df.select("vec_id", F.posexplode(c).alias("i", "x")).select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("x", 6).alias("x"))


@query(f"WITH {_V}, e AS (SELECT vec_id, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM v) SELECT vec_id, unnest(range(64)) AS i, unnest(list_transform(e, lambda x: round(x / list_sum(e), 6))) AS x FROM e")
def q_softmax(spark, sf_dir):
    return _flat(_vectors(spark, sf_dir), arrays.softmax("v"))


@query(f"WITH {_V} SELECT vec_id, CAST(list_position(v, list_max(v)) - 1 AS INTEGER) AS frame FROM v")
def q_argmax(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", arrays.arg_max("v").alias("frame"))


@query(f"WITH {_V}, s AS (SELECT vec_id, v, list_avg(v) AS m, list_stddev_pop(v) AS sd FROM v) SELECT vec_id, unnest(range(64)) AS i, unnest(list_transform(v, lambda x: round((x - m) / sd, 6))) AS x FROM s")
def q_znorm(spark, sf_dir):
    return _flat(_vectors(spark, sf_dir), arrays.z_norm("v"))


@query(f"""WITH {_V}, p AS (SELECT vec_id, unnest(range(64)) AS i, v FROM v),
w AS (SELECT vec_id, i, v, unnest(range(-3, 4)) AS k FROM p), a AS (SELECT vec_id, i, v[1 + CASE WHEN i + k < 0 THEN -(i + k) WHEN i + k > 63 THEN 126 - (i + k) ELSE i + k END] AS x FROM w)
SELECT vec_id, i, round(median(x), 6) AS x FROM a GROUP BY vec_id, i""")
def q_median_filter(spark, sf_dir):
    return _flat(_vectors(spark, sf_dir), arrays.median_filter("v", 7))


@query(f"WITH {_V}, p AS (SELECT vec_id, list_concat(v, list_transform(range(36), lambda z: 0.0))[1:80] AS a FROM v) SELECT vec_id, unnest(range(80)) AS i, unnest(list_transform(a, lambda x: round(x, 6))) AS x FROM p")
def q_pad_trim(spark, sf_dir):
    return _flat(_vectors(spark, sf_dir), arrays.pad_or_trim("v", 80))


@query(f"WITH {_V} SELECT vec_id, unnest(range(64)) AS i, unnest(list_transform(range(1, 65), lambda k: round(list_sum(v[1:k]), 6))) AS x FROM v")
def q_cumulative(spark, sf_dir):
    return _flat(_vectors(spark, sf_dir), arrays.cumulative("v"))


@query(f"""WITH {_V}, a AS (SELECT vec_id, list_transform(v, lambda x: 1 / (1 + exp(-x))) AS a FROM v), t AS (SELECT vec_id, a, round_even(list_sum(a), 0) AS t, list_sum(a) AS s FROM a),
c AS (SELECT vec_id, t, list_transform(range(1, 65), lambda k: list_sum(a[1:k]) * t / s) AS c FROM t)
SELECT vec_id, coalesce(t > 0 AND list_min(list_filter(range(64), lambda k: c[k + 1] >= t * 0.999)) >= 62, FALSE) AS fires FROM c""")
def q_cif_fire(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", arrays.cif_fires("v").alias("fires"))


@query(f"""WITH RECURSIVE {_V}, a AS (SELECT vec_id, list_transform(v, lambda x: abs(x)) AS a FROM v),
r AS (SELECT vec_id, 0 AS k, list_transform(a, lambda x: x * 6.0 / list_sum(a)) AS a FROM a UNION ALL
  SELECT vec_id, k + 1, CASE WHEN list_max(a) <= 0.999 THEN a ELSE list_transform(a, lambda x: CASE WHEN x > 0.999 THEN x * 0.5 WHEN rest > 0 THEN x + x * lost / rest ELSE x END) END
  FROM (SELECT vec_id, k, a, list_sum(list_transform(a, lambda x: CASE WHEN x > 0.999 THEN x * 0.5 ELSE 0.0 END)) AS lost, list_sum(list_transform(a, lambda x: CASE WHEN x > 0.999 THEN 0.0 ELSE x END)) AS rest FROM r WHERE k < 10))
SELECT vec_id, unnest(range(64)) AS i, unnest(list_transform(a, lambda x: round(x, 6))) AS x FROM r WHERE k = 10""")
def q_cif_resize(spark, sf_dir):
    return _flat(_vectors(spark, sf_dir), arrays.cif_resized(F.transform("v", F.abs), F.lit(6.0)))


@query(f"""WITH RECURSIVE {_V}, m AS (SELECT vec_id, list_transform(v, lambda x: abs(x)) AS m FROM v),
c AS (SELECT vec_id, m, 0 AS k, [0.0::DOUBLE] AS best, [0] AS step FROM m UNION ALL
  SELECT vec_id, m, k + 1, list_append(best, x), list_append(step, s) FROM (
    SELECT vec_id, m, k, best, step, CASE WHEN i = 0 OR j = 0 THEN 'inf'::DOUBLE WHEN s0 = 0 THEN d + m[(i - 1) * 8 + j] WHEN s0 = 1 THEN u + m[(i - 1) * 8 + j] ELSE l + m[(i - 1) * 8 + j] END AS x,
      CASE WHEN i = 0 THEN 2 WHEN j = 0 THEN 1 ELSE s0 END AS s
    FROM (SELECT *, CASE WHEN d < u AND d < l THEN 0 WHEN u < d AND u < l THEN 1 ELSE 2 END AS s0
      FROM (SELECT *, (k + 1) // 9 AS i, (k + 1) % 9 AS j, best[k + 1 - 9] AS d, best[k + 2 - 9] AS u, best[k + 1] AS l FROM c WHERE k < 80)))),
b AS (SELECT vec_id, best[81] AS cost, step, 8 AS i, 8 AS j, 0 AS steps FROM c WHERE k = 80 UNION ALL
  SELECT vec_id, cost, step, i - CASE WHEN step[i * 9 + j + 1] <> 2 THEN 1 ELSE 0 END, j - CASE WHEN step[i * 9 + j + 1] <> 1 THEN 1 ELSE 0 END, steps + 1 FROM b WHERE i > 0 OR j > 0)
SELECT vec_id, round(cost, 6) AS cost, steps FROM b WHERE i = 0 AND j = 0""")
def q_dtw_cost(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.transform(F.slice("v", r * 8 + 1, F.lit(8)), lambda x: F.abs(x))).alias("m"))
    return rows.select("vec_id", r6(arrays.dtw_cost("m")).alias("cost"), F.size(arrays.dtw_alignment("m")).alias("steps"))


@query(f"WITH {_V} SELECT label, unnest(range(64)) AS i, unnest(list_transform(range(1, 65), lambda k: round(avg_k[k], 6))) AS x FROM (SELECT label, list(a ORDER BY i) AS avg_k FROM (SELECT label, i, avg(x) AS a FROM (SELECT label, unnest(range(64)) AS i, unnest(v) AS x FROM v) GROUP BY label, i) GROUP BY label)")
def q_head_mean(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("label", F.posexplode("v").alias("i", "x"))
    return rows.groupBy("label", "i").agg(F.round(F.avg("x"), 6).alias("x")).select("label", F.col("i").cast("bigint").alias("i"), "x")


@query(f"""WITH {_V}, p AS (SELECT vec_id, label + 41 AS stamp, v FROM v),
x AS (SELECT vec_id, list_transform(list_zip(v, range(64)), lambda z: CASE WHEN z[2] < 38 OR z[2] = 39 OR (z[2] >= 40 AND z[2] < stamp) THEN '-inf'::DOUBLE ELSE z[1] END) AS x FROM p),
w AS (SELECT vec_id, x, ln(list_sum(list_transform(x[41:], lambda y: exp(y)))) > list_max(x[1:40]) AS times_win FROM x)
SELECT vec_id, CAST(len(list_filter(CASE WHEN times_win THEN x[41:] ELSE x END, lambda y: y > '-inf'::DOUBLE)) AS INTEGER) AS allowed FROM w""")
def q_timestamp_rules(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("tokens", F.array(F.lit(3), F.lit(40), F.lit(5), (F.col("label") + 41)))
    kept = F.transform(arrays.timestamp_rules("tokens", "v", 40, 38, 39), lambda x: F.when(x > float("-inf"), F.lit(1)).otherwise(F.lit(0)))
    return rows.select("vec_id", F.aggregate(kept, F.lit(0), lambda s, x: s + x).alias("allowed"))


# --- selection ------------------------------------------------------------------------------------------------------------
@query(f"""WITH {_V}, e AS (SELECT vec_id, label, unnest(range(64)) AS token, unnest(v) AS logit FROM v), l AS (SELECT vec_id, label, token, logit - ln(sum(exp(logit)) OVER (PARTITION BY vec_id)) AS score FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, token) AS k FROM l), g AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id, token) AS n FROM k WHERE k <= 5 AND token <> 63)
SELECT CAST(n - 1 AS INTEGER) AS beam, label, round(score, 6) AS score FROM g WHERE n <= 4""")
def q_beam_topk(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("label", F.col("vec_id").alias("beam"), F.posexplode(arrays.log_softmax("v")).alias("token", "score"), F.array(F.col("vec_id").cast("int")).alias("seq"))
    going, _ = select.beam_step(rows, "label", "beam", "token", "score", "seq", 4, 63)
    return going.select("beam", "label", r6("score").alias("score"))


@query(f"WITH {_V}, e AS (SELECT vec_id, unnest(range(64)) AS token, unnest(v) AS logit FROM v) SELECT vec_id, CAST(arg_max(token, logit) AS INTEGER) AS token, round(max(logit) - ln(sum(exp(logit))), 6) AS logprob FROM e GROUP BY vec_id")
def q_greedy(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("vec_id", F.posexplode("v").alias("token", "logit"))
    return select.greedy(rows, "vec_id", "token", "logit").select("vec_id", "token", r6("logprob").alias("logprob"))


@query("""WITH s AS (SELECT user_id, event_id, -value / pow((5 + event_id % 20) / 6, 0.6) AS score FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, event_id) AS k FROM s)
SELECT user_id, event_id, round(score, 6) AS score FROM r WHERE k = 1""")
def q_rank_length_penalty(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (-F.col("value")).alias("lp"), (F.col("event_id") % 20).alias("n"))
    return select.ranked_best(rows, "user_id", "event_id", "lp", "n", 0.6).select("user_id", "event_id", r6("score").alias("score"))


@query("""SELECT user_id, coalesce(min_by(event_id, event_id) FILTER (WHERE NOT ((value / 100 > 2.4 OR -value / 100 < -1) AND NOT (event_id % 10 > 6))), max_by(event_id, event_id)) AS event_id FROM events GROUP BY user_id""")
def q_ladder(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    bad = select.needs_fallback(F.col("value") / 100, -F.col("value") / 100, F.col("event_id") % 10, no_speech_limit=6)
    return select.ladder(rows.withColumn("t", F.col("event_id")), "user_id", "t", ~bad, "event_id").select("user_id", "event_id")


@query(f"WITH {_V}, e AS (SELECT label AS vec, unnest(range(64)) AS l, unnest(v) AS x, vec_id FROM v), p AS (SELECT vec_id, l, exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id) AS p FROM e) SELECT vec_id, 'l' || arg_max(l, p) AS language, round(max(p), 6) AS p FROM p GROUP BY vec_id")
def q_language_top(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("vec_id", F.posexplode("v").alias("l", "x")).select("vec_id", F.concat(F.lit("l"), F.col("l").cast("string")).alias("language"), "x")
    got = select.detected_language(rows, "vec_id", "language", "x")
    return got.select("vec_id", "language", r6(F.array_max(F.map_values("probabilities"))).alias("p"))


@query("""WITH r AS (SELECT user_id, event_id, CASE WHEN value > 200 THEN event_id + 1 END AS r FROM events) SELECT user_id, event_id, coalesce(max(r) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prompt_from FROM r""")
def q_prompt_carry(spark, sf_dir):
    return select.carried_from(table(spark, sf_dir, "events"), "user_id", "event_id", "value", limit=200).select("user_id", "event_id", "prompt_from")


# --- preparation ----------------------------------------------------------------------------------------------------------
@query(f"""WITH {PAIRS_SQL}, s AS (SELECT conv_id, turn, ref, list_concat(['x', 'y'], ref)[1:len(ref)] AS shifted, [0, -6, -5, -4, -3, -2, -1, 1, 2, 3, 4, 5, 6] AS os FROM pairs),
o AS (SELECT conv_id, turn, ref, shifted, unnest(os) AS o, unnest(range(13)) AS k FROM s),
c AS (SELECT conv_id, turn, o, k, len(list_filter(range(len(ref)), lambda i: i + o >= 0 AND i + o < len(shifted) AND ref[i + 1] = shifted[i + o + 1])) AS n FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, k) AS rn FROM c)
SELECT conv_id, turn, CAST(o AS INTEGER) AS shift FROM r WHERE rn = 1""")
def q_offset_align(spark, sf_dir):
    rows = pairs(spark, sf_dir).withColumn("shifted", F.slice(F.concat(F.array(F.lit("x"), F.lit("y")), "ref"), F.lit(1), F.size("ref")))
    return rows.select("conv_id", "turn", prepare.best_offset("ref", "shifted").alias("shift"))


@query("""SELECT n_name AS name, CAST(i AS INTEGER) AS copy FROM (SELECT n_name, n_regionkey, unnest(range(1, greatest(n_regionkey, 1) + 1)) AS i FROM nation) UNION ALL SELECT r_name, 1 FROM region""")
def q_weighted_union(spark, sf_dir):
    nation = prepare.repeated(table(spark, sf_dir, "nation"), F.col("n_regionkey")).select(F.col("n_name").alias("name"), "copy")
    return prepare.weighted_union([(nation, 1), (table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit(1).alias("copy")), 0)])


@query("SELECT p_partkey, CAST((row_number() OVER (ORDER BY p_partkey) - 1) % 4 AS INTEGER) AS worker FROM part")
def q_round_robin(spark, sf_dir):
    return prepare.dealt(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 4)


@query("SELECT p_partkey, CAST(('0x' || md5('42:' || p_partkey)[1:6]) AS BIGINT) % 10000 < 1000 AS is_validation FROM part")
def q_hash_split(spark, sf_dir):
    train, valid = prepare.split(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 0.1)
    return train.withColumn("is_validation", F.lit(False)).unionByName(valid.withColumn("is_validation", F.lit(True)))


@query("SELECT p_partkey FROM part ORDER BY md5('21:' || p_partkey), p_partkey LIMIT 100")
def q_sample(spark, sf_dir):
    return prepare.sample(table(spark, sf_dir, "part"), "p_partkey", 100).select("p_partkey")


@query("""WITH t AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda x: length(x)) AS ids FROM conversations), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS m FROM t)
SELECT conv_id, turn, array_to_string(list_concat(ids, list_transform(range(m - len(ids)), lambda z: 0)), ',') AS input_ids, array_to_string(list_transform(range(m), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END), ',') AS attention_mask,
  array_to_string(list_transform(range(m), lambda i: CASE WHEN i < 2 OR i >= len(ids) THEN -100 ELSE ids[i + 1] END), ',') AS labels FROM m""")
def q_collate_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(F.split("text", " "), lambda x: F.length(x)).alias("ids"), F.lit(2).alias("p"))
    got = prepare.collated(rows, "conv_id", "ids", "p", 0)
    return got.select("conv_id", "turn", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("input_ids", "attention_mask", "labels")))


# --- sinks ----------------------------------------------------------------------------------------------------------------
def _cues(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") * 10).alias("start"), (F.col("value") * 10 + 1.5).alias("end"), F.col("event_type").alias("text"))


_MS = "CAST(round_even(CAST({} AS DECIMAL(24, 9)) * 1000, 0) AS BIGINT)"
_SRT = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query(f"""WITH c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, {_MS.format('value * 10')} AS s, {_MS.format('value * 10 + 1.5')} AS e, event_type FROM events)
SELECT user_id, event_id, n || chr(10) || {_SRT.format('s')} || ' --> ' || {_SRT.format('e')} || chr(10) || event_type || chr(10) AS block FROM c""")
def q_subtitles_srt(spark, sf_dir):
    return sinks.srt_blocks(_cues(spark, sf_dir), "user_id", "event_id")


@query(f"SELECT {_MS.format('value * 10')} AS start, {_MS.format('value * 10 + 1.5')} AS \"end\", event_type AS text FROM events")
def q_tsv_ms(spark, sf_dir):
    return sinks.tsv_rows(_cues(spark, sf_dir))


@query("SELECT doc_id, octet_length(encode(string_split(text, chr(10))[1])) + 1 AS n_bytes, CAST(ceil((octet_length(encode(string_split(text, chr(10))[1])) + 1) / 512) AS BIGINT) AS n_packets FROM documents")
def q_packets(spark, sf_dir):
    p = sinks.packets("text", 512)
    return table(spark, sf_dir, "documents").select("doc_id", F.aggregate(p, F.lit(0), lambda s, x: s + F.octet_length(x)).cast("bigint").alias("n_bytes"), F.size(p).cast("bigint").alias("n_packets"))


@query(f"""WITH RECURSIVE {PAIRS_SQL}, e AS (SELECT conv_id, turn, unnest(range(len(ref))) AS seq, unnest(ref) AS w FROM w),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, seq) AS n, w FROM e),
m AS (SELECT conv_id, n, w, 0 AS cue, 0 AS line, length(w) AS used FROM o WHERE n = 1 UNION ALL
  SELECT o.conv_id, o.n, o.w, CASE WHEN used + 1 + length(o.w) > 42 AND line = 1 THEN cue + 1 ELSE cue END, CASE WHEN used + 1 + length(o.w) <= 42 THEN line ELSE 1 - line END,
    CASE WHEN used + 1 + length(o.w) <= 42 THEN used + 1 ELSE 0 END + length(o.w) FROM m JOIN o ON o.conv_id = m.conv_id AND o.n = m.n + 1),
l AS (SELECT conv_id, cue, line, min(n) AS a, max(n) AS b, string_agg(w, ' ' ORDER BY n) AS t FROM m GROUP BY conv_id, cue, line)
SELECT conv_id, CAST(cue AS BIGINT) AS seq, CAST(min(a) - 1 AS DOUBLE) AS start, CAST(max(b) - 0.5 AS DOUBLE) AS "end", string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY conv_id, cue""")
def q_subtitle_cues(spark, sf_dir):
    """All words of all turns; each takes a second of its conversation."""
    before = F.sum(F.size("w")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", words().alias("w")).withColumn("before", F.coalesce(before, F.lit(0)))
    rows = rows.select("conv_id", F.col("turn").alias("segment"), "before", F.posexplode("w").alias("seq", "w"))
    rows = rows.select("conv_id", "segment", F.col("seq").cast("bigint").alias("seq"), F.concat(F.lit(" "), "w").alias("text"), (F.col("before") + F.col("seq")).cast("double").alias("start"), (F.col("before") + F.col("seq") + 0.5).cast("double").alias("end"))
    return sinks.cues(rows, "conv_id", 42, 2)


# --- stateful operators in their batch form ---------------------------------------------------------------------------------
@query(f"""WITH RECURSIVE {_EVENTS_IN_ORDER}, p AS (SELECT user_id, k, event_id, least(value / 100, 1.0) AS p FROM o),
m(user_id, k, event_id, is_on, since, event, "at") AS (SELECT user_id, k, event_id, p >= 0.7, NULL::BIGINT, CASE WHEN p >= 0.7 THEN 'start' END, CASE WHEN p >= 0.7 THEN 0 END::BIGINT FROM p WHERE k = 1 UNION ALL
  SELECT user_id, k, event_id, CASE WHEN ends THEN FALSE ELSE is_on OR p >= 0.7 END, CASE WHEN ends OR p >= 0.7 THEN NULL ELSE quiet END,
    CASE WHEN ends THEN 'end' WHEN p >= 0.7 AND NOT is_on THEN 'start' END, CASE WHEN ends THEN quiet + 1600 - 512 WHEN p >= 0.7 AND NOT is_on THEN greatest(0, k * 512 - 1600 - 512) END
  FROM (SELECT *, coalesce(p < 0.55 AND is_on AND k * 512 - quiet >= 8000, FALSE) AS ends FROM (SELECT p.user_id, p.k, p.event_id, p.p, m.is_on, CASE WHEN p.p < 0.55 AND m.is_on THEN coalesce(m.since, p.k * 512) ELSE m.since END AS quiet
    FROM m JOIN p ON p.user_id = m.user_id AND p.k = m.k + 1)))
SELECT user_id, event_id, event, CAST("at" AS BIGINT) AS "at" FROM m WHERE event IS NOT NULL""")
def q_stateful_vad(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.least(F.col("value") / 100, F.lit(1.0)).alias("prob"))
    return processors.batch(rows, processors.VoiceEvents(), "user_id", "event_id")


@query(f"""WITH {_EVENTS_IN_ORDER}, s AS (SELECT user_id, k, event_id, value / 20 AS n, sum(value / 20) OVER (PARTITION BY user_id ORDER BY k) AS upto FROM o),
f AS (SELECT a.user_id, a.k, a.event_id, a.upto, min(b.k) FILTER (WHERE b.k = a.k OR a.upto - b.upto + b.n <= 30 + 1e-9) AS first FROM s a JOIN s b ON b.user_id = a.user_id AND b.k <= a.k GROUP BY a.user_id, a.k, a.event_id, a.upto),
w AS (SELECT f.*, s.upto - s.n AS gone FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.first)
SELECT user_id, event_id, round(gone - coalesce(lag(gone) OVER (PARTITION BY user_id ORDER BY k), 0), 6) + 0.0 AS evicted, round(upto - gone, 6) AS buffered FROM w""")
def q_stateful_retention(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 20).alias("length"))
    return processors.batch(rows, processors.Retention(), "user_id", "event_id").withColumn("evicted", r6("evicted")).withColumn("buffered", r6("buffered"))


# --- relational coverage ----------------------------------------------------------------------------------------------------
def relational(name: str, spark_sql: str, sql: str | None = None, tables: tuple[str, ...] = ()) -> None:
    """A query in SQL over the driver's tables, read by path so that nothing is left in the session's catalogue."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(spark_sql, **{t: table(spark, sf_dir, t) for t in tables})

    run.__name__ = name
    QUERIES[name] = run
    ready = sql or spark_sql
    for t in tables:
        ready = ready.replace("{" + t + "}", t)
    SQL[name] = ready


relational("rel_join_inner", "SELECT c_custkey, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {customer} c JOIN {orders} o ON c_custkey = o_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY c_custkey, n_name", tables=("customer", "orders", "nation"))
relational("rel_join_full", "SELECT coalesce(c_nationkey, s_nationkey) AS k, count(c_custkey) AS nc, count(s_suppkey) AS ns FROM {customer} c FULL OUTER JOIN {supplier} s ON c_custkey = s_suppkey * 20 GROUP BY 1", tables=("customer", "supplier"))
relational("rel_join_semi_anti", "SELECT c_custkey, 'with' AS kind FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey) UNION ALL SELECT c_custkey, 'without' FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)", tables=("customer", "orders"))
relational("rel_join_range", "SELECT p_partkey, count(*) AS n FROM {part} p JOIN {region} r ON p_size BETWEEN r_regionkey * 10 AND r_regionkey * 10 + 14 GROUP BY p_partkey", tables=("part", "region"))
relational("rel_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)", tables=("lineitem",))
relational("rel_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)", tables=("orders",))
relational("rel_grouping_sets", "SELECT event_type, user_id % 10 AS u, count(DISTINCT user_id) AS n FROM {events} GROUP BY GROUPING SETS ((event_type), (user_id % 10), ())", tables=("events",))
relational("rel_rank_family", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", "SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER w AS INTEGER) AS rk, CAST(dense_rank() OVER w AS INTEGER) AS dr, CAST(ntile(4) OVER w AS INTEGER) AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", ("orders",))
relational("rel_frames", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 6) AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM {events}", tables=("events",))
relational("rel_set_ops", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier} EXCEPT SELECT n_nationkey FROM {nation} WHERE n_regionkey = 0", tables=("customer", "supplier", "nation"))
relational("rel_top_k", "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM {lineitem}) WHERE k <= 5", "SELECT * FROM (SELECT l_orderkey, l_linenumber, l_returnflag, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS INTEGER) AS k FROM lineitem) WHERE k <= 5", ("lineitem",))
relational("rel_dates", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY 1, 2", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2", ("orders",))
relational("rel_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", ("events",))
relational("rel_maps", "SELECT user_id, size(map_from_entries(array_agg(DISTINCT struct(event_type, length(event_type))))) AS n FROM {events} GROUP BY user_id", "SELECT user_id, CAST(count(DISTINCT event_type) AS INTEGER) AS n FROM events GROUP BY user_id", ("events",))
relational("rel_filters", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, round(avg(l_discount), 6) AS d FROM {lineitem} WHERE l_shipdate >= TIMESTAMP_NTZ '1995-01-01 00:00:00' GROUP BY l_returnflag", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, round(avg(l_discount), 6) AS d FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY l_returnflag", ("lineitem",))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
