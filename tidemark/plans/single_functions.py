"""Queries that call one function or operator each, where the catalogue's larger ones don't, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import arrays, text, tokens
from tidemark.operators import commit, evaluate, prepare, segment, select, timing
from tidemark.plans.bridge import table, words
from tidemark.plans.registry import query
from tidemark.sources import files, sinks
from tidemark.streaming import processors

r6 = lambda c: F.round(c, 6)
_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _flat(rows, c, *keys):
    return rows.select(*keys, F.posexplode(c).alias("i", "x")).select(*keys, F.col("i").cast("bigint").alias("i"), "x")


# --- lines, names and texts -----------------------------------------------------------------------------------------------
@query("SELECT 'root/' || substr(id, 7, 5) || '/' || id || '.wav' AS audio_path, trim(t) AS text FROM (SELECT 'o' || lpad(o_orderkey::VARCHAR, 11, '0') AS id, o_orderpriority AS t FROM orders)")
def q_id_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "orders").select(F.concat(F.lit(" o"), F.lpad(F.col("o_orderkey").cast("string"), 11, "0"), F.lit(" \t "), "o_orderpriority").alias("value"))
    return files.id_lines(lines, ".wav", "root")


@query("SELECT split_part(l, chr(9), 1) AS name, split_part(l, chr(9), 2) AS text FROM (SELECT c_custkey || chr(9) || c_nationkey AS l FROM customer)")
def q_tab_cells(spark, sf_dir):
    lines = table(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit("\t"), F.col("c_nationkey").cast("string"), F.lit(" ")).alias("value"))
    return files.tab_lines(lines).where("skipped IS NULL").select("name", "text")


@query("SELECT page_id, coalesce(TRY_CAST(nullif(regexp_extract(regexp_replace(string_split(url, '/')[-1], '^(.+)\\.[^.]*$', '\\1'), '(\\d{1,9})', 1), '') AS BIGINT), row_number() OVER (ORDER BY page_id) + 4) AS index FROM pages")
def q_indexed(spark, sf_dir):
    return files.indexed(table(spark, sf_dir, "pages").select("page_id", "url"), "url", "page_id", 5).select("page_id", F.col("index").cast("bigint").alias("index"))


@query("""SELECT conv_id, turn, md5('system:You are a helpful assistant.|user:' || text || CASE WHEN turn % 2 = 0 THEN '|assistant:' || role ELSE '' END) AS messages FROM conversations""")
def q_chat_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("answer", F.when(F.col("turn") % 2 == 0, F.col("role")))
    said = F.transform(text.conversation("text", "answer"), lambda m: F.concat(m["role"], F.lit(":"), m["content"]))
    return rows.select("conv_id", "turn", F.md5(F.array_join(said, "|")).alias("messages"))


@query("""SELECT conv_id, turn, md5('Given the following ASR transcription candidates, predict the correct continuation.' || chr(10) || chr(10) || 'Previous confirmed transcript: "' || role || '"' || chr(10) || chr(10) || 'K-best candidates for the continuation:' || chr(10)
  || '  1. ' || text || chr(10) || '  2. ' || role || chr(10) || chr(10) || 'Based on the context and candidates, what is the correct text that should be appended after "' || role || '"?') AS instruction, md5(text) AS response FROM conversations""")
def q_instruction_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array("text", "role", "text").alias("k_best_candidates"), F.lit(2).alias("num_candidates"), F.col("role").alias("previous_transcript"), F.col("text").alias("continuation_transcript"))
    return prepare.instruction_rows(rows, keep=("conv_id", "turn")).select("conv_id", "turn", F.md5("instruction").alias("instruction"), F.md5("response").alias("response"))


@query("SELECT event_id, printf('%.4f %.0f %.0f %s', value * 100, value * 1000, (value + 1) * 1000, event_type) AS line FROM events")
def q_emission_line(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.emission_line(F.col("value") / 10, "value", F.col("value") + 1, "event_type").alias("line"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS flag, o_custkey AS whole FROM orders")
def q_parsed(spark, sf_dir):
    word = F.get(F.array(F.lit("True"), F.lit("False"), F.lit("maybe")), (F.col("o_orderkey") % 3).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.parse_bool(word).alias("flag"), text.exact_div(F.col("o_custkey") * 7, F.lit(7)).alias("whole"))


@query("SELECT conv_id, turn, md5(CASE WHEN instr(text, w) = 0 OR w = '' THEN text ELSE text[1:instr(text, w) - 1] || '<u>' || w || '</u>' || text[instr(text, w) + length(w):] END) AS t FROM (SELECT *, coalesce(string_split(text, ' ')[2], '') AS w FROM conversations)")
def q_underlined(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("w", F.coalesce(F.get(F.split("text", " "), 1), F.lit("")))
    return rows.select("conv_id", "turn", F.md5(text.underlined("text", "w")).alias("t"))


@query("SELECT doc_id, lang AS code FROM documents WHERE lang IS NOT NULL")
def q_language_code(spark, sf_dir):
    names = F.create_map(*(F.lit(x) for kv in tokens.LANGUAGES.items() for x in kv))
    return table(spark, sf_dir, "documents").where("lang IS NOT NULL").select("doc_id", tokens.language_code(F.coalesce(names[F.col("lang")], "lang")).alias("code"))


# --- evaluation and sinks ---------------------------------------------------------------------------------------------------
@query("SELECT d.doc_id::VARCHAR AS file, d.n_chars AS reference FROM documents d WHERE d.doc_id = 17")
def q_point_lookup(spark, sf_dir):
    refs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file"), F.col("n_chars").alias("reference"))
    return evaluate.point_lookup(refs, "17")


@query("SELECT o_orderkey AS file, CAST(CASE WHEN o_custkey % 5 <> 0 THEN (o_custkey % 5) * 1000.0 END AS DOUBLE) AS first_token_latency_ms, CAST(CASE WHEN o_custkey % 7 <> 0 THEN (o_custkey % 7) * 1000.0 END AS DOUBLE) AS last_token_latency_ms FROM orders")
def q_latency_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), (F.col("o_custkey") % 5).cast("double").alias("first_token_latency"), (F.col("o_custkey") % 7).cast("double").alias("last_token_latency"))
    got = evaluate.with_latencies(rows.select("file"), rows)
    return got.select("file", *(r6(c).alias(c) for c in ("first_token_latency_ms", "last_token_latency_ms")))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity - l_discount / (l_linenumber + 1) * l_linenumber, 6) AS latency FROM lineitem")
def q_corrected_latency(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r6(evaluate.corrected_latency(F.col("l_quantity"), F.col("l_discount"), F.col("l_linenumber"))).alias("latency"))


@query("SELECT doc_id, lang IS NULL OR text = '' AS failed FROM documents")
def q_failed_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.nullif("text", F.lit("")).alias("text"))
    complete, failed = sinks.failed_keys(rows, "doc_id", "lang", "text")
    return complete.select("doc_id", F.lit(False).alias("failed")).unionByName(failed.withColumn("failed", F.lit(True)))


@query("SELECT md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS value FROM conversations")
def q_text_lines(spark, sf_dir):
    return sinks.text_lines(table(spark, sf_dir, "conversations")).select(F.md5("value").alias("value"))


_CLOCK = "CASE WHEN {0} >= 3600000 THEN printf('%02d:', {0} // 3600000) ELSE '' END || printf('%02d:%02d.%03d', {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
_MS = "CAST(round_even(CAST({} AS DECIMAL(24, 9)) * 1000, 0) AS BIGINT)"


@query(f"""WITH c AS (SELECT user_id, event_id, {_MS.format('value * 10')} AS s, {_MS.format('value * 10 + 1.5')} AS e, event_type FROM events)
SELECT user_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_CLOCK.format('s')} || ' --> ' || {_CLOCK.format('e')} || chr(10) || event_type || '->' || chr(10), chr(10) ORDER BY event_id) AS value FROM c GROUP BY user_id""")
def q_subtitles_vtt(spark, sf_dir):
    cues = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") * 10).alias("start"), (F.col("value") * 10 + 1.5).alias("end"), F.concat(F.lit(" "), "event_type", F.lit("-->")).alias("text"))
    return sinks.documents(sinks.vtt_blocks(cues, "user_id", "event_id"), "user_id", "event_id", "WEBVTT\n\n")


# --- selection ----------------------------------------------------------------------------------------------------------------
@query("SELECT event_id, value / 500 > 0.6 AND NOT -value / 300 > -1 AS silent, round(-value / (event_id % 20 + 1), 6) AS logprob FROM events")
def q_silence(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", select.is_silent(v / 500, -v / 300).alias("silent"), r6(select.average_logprob(-v, F.col("event_id") % 20)).alias("logprob"))


@query("""WITH b AS (SELECT user_id, event_id, value, CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END AS late, CASE event_type WHEN 'purchase' THEN 1 ELSE 2 END AS n FROM events WHERE event_type IN ('purchase', 'view')),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY late, value DESC, event_id) AS k FROM b) SELECT user_id, event_id, value AS score, n FROM r WHERE late = 0 OR k <= 4""")
def q_finalised(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.array(F.col("event_id").cast("long")).alias("seq"), F.col("value").alias("score"))
    got = select.finalised(rows.where("event_type = 'purchase'").drop("event_type"), rows.where("event_type = 'view'").drop("event_type"), "user_id", "score", "seq", 4, 0)
    return got.select("user_id", F.get("seq", 0).alias("event_id"), "score", F.size("seq").alias("n"))


@query("SELECT event_id, CASE WHEN event_type = 'click' OR event_id % 3 = 0 THEN '' ELSE event_type END AS text, CASE WHEN event_type = 'click' OR event_id % 3 = 0 THEN 0 ELSE 1 END AS n FROM events")
def q_cleared(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.col("value").alias("start"), F.when(F.col("event_id") % 3 == 0, F.col("value")).otherwise(F.col("value") + 1).alias("end"), F.when(F.col("event_type") == "click", F.lit("  ")).otherwise(F.col("event_type")).alias("text"), F.array("event_id").alias("tokens"))
    return select.cleared(rows).select("event_id", "text", F.size("tokens").alias("n"))


# --- token sequences -----------------------------------------------------------------------------------------------------------
_IDS = "ids AS (SELECT vec_id, list_transform(v, lambda x: CAST(floor(x * 100) AS INTEGER)) AS ids FROM v)"


def _ids(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", F.transform("v", lambda x: F.floor(x * 100).cast("int")).alias("ids"))


_joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query(f"WITH {_V}, {_IDS} SELECT vec_id, array_to_string(list_filter(ids, lambda x: x < 5), ',') AS text_ids, array_to_string(list_filter(ids, lambda x: x < -3), ',') AS untimed FROM ids")
def q_token_filters(spark, sf_dir):
    return _ids(spark, sf_dir).select("vec_id", _joined(tokens.text_ids("ids", 5)).alias("text_ids"), _joined(tokens.without_timestamps("ids", -3)).alias("untimed"))


@query(f"WITH {_V}, {_IDS} SELECT vec_id, array_to_string(list_concat([99], ids[-7:], [90, 91], ids[1:2]), ',') AS prompt, 5 AS n FROM ids")
def q_token_prompt(spark, sf_dir):
    rows = _ids(spark, sf_dir)
    return rows.select("vec_id", _joined(tokens.with_prompt("ids", [90, 91], F.slice("ids", 1, 2), 99, 16)).alias("prompt"), F.size(tokens.beams("ids", 5)).alias("n"))


# --- arrays ----------------------------------------------------------------------------------------------------------------------
@query(f"WITH {_V} SELECT vec_id, unnest(range(64)) AS i, unnest(list_transform(list_zip(v, range(64)), lambda z: CASE WHEN z[2] IN (3, 5) OR (label = 0 AND z[2] IN (7, 8)) THEN NULL ELSE round(z[1], 6) END)) AS x FROM v")
def q_masked(spark, sf_dir):
    chain = arrays.filter_chain("v", [lambda a: arrays.masked(a, [3, 5]), lambda a: arrays.masked_at_start(a, F.col("label"), [7, 8])])
    return _flat(_vectors(spark, sf_dir).select("vec_id", F.transform(chain, lambda x: F.when(x > float("-inf"), r6(x))).alias("y")), "y", "vec_id")


@query(f"WITH {_V}, s AS (SELECT vec_id, v[label % 10 + 1:label % 10 + 5] AS part FROM v) SELECT vec_id, round(list_sum(part) / len(part), 6) AS m, round(part[1], 6) AS first FROM s")
def q_slice_mean(spark, sf_dir):
    start = F.col("label") % 10
    part = arrays.time_slice("v", start / 10, (start + 5) / 10, 10)
    return _vectors(spark, sf_dir).select("vec_id", r6(arrays.slice_mean("v", start, F.lit(5))).alias("m"), r6(F.get(part, 0)).alias("first"))


@query(f"WITH {_V} SELECT vec_id, unnest(range(64)) AS i, unnest(list_transform(v, lambda x: CAST(trunc(greatest(-32768.0, least(32767.0, x * 4 * 32767))) AS SMALLINT))) AS x FROM v")
def q_pcm16(spark, sf_dir):
    return _flat(_vectors(spark, sf_dir), arrays.pcm16(F.transform("v", lambda x: x * 4)), "vec_id")


@query(f"WITH {_V} SELECT vec_id, round(list_sum(list_transform(list_filter(range(1, 64), lambda k: k % 3 <> 0), lambda k: -v[k])) / 42, 6) AS loss FROM v")
def q_cross_entropy(spark, sf_dir):
    """The label of position k (from 0) is k, or ignored where 3 divides it; it goes with the number before it."""
    labels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(k % 3 == 0, -100).otherwise(k))
    return _vectors(spark, sf_dir).select("vec_id", r6(arrays.cross_entropy("v", labels)).alias("loss"))


@query(f"WITH {_V} SELECT vec_id, CASE WHEN label % 3 = 0 THEN FALSE WHEN label % 2 = 0 THEN TRUE ELSE v[1] > 0 END AS fires, v[63] <= 0 AND v[64] > 0 AS single_end FROM v")
def q_fire_policy(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    fires = arrays.fire_policy(F.col("label") % 2 != 0, F.col("label") % 3 == 0, F.get("v", 0) > 0)
    return rows.select("vec_id", fires.alias("fires"), segment.ends_single(F.transform("v", lambda x: x > 0)).alias("single_end"))


# --- streams as rows ---------------------------------------------------------------------------------------------------------------
@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b, length(event_type) AS n, lag(length(event_type)) OVER (PARTITION BY user_id ORDER BY event_id) AS m FROM events) WHERE m IS NULL OR n <> m")
def q_jumps(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("n", F.length("event_type"))
    return segment.jumps(rows, "user_id", "event_id", "n").select("event_id")


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN greatest(0, event_id * 100 - 2112) ELSE event_id * 100 + 1088 END AS pos FROM events")
def q_padded_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", "start").otherwise("end").alias("event"), (F.col("event_id") * 100).alias("at"))
    return segment.padded_edges(rows).select("event_id", F.col("at").cast("bigint").alias("pos"))


@query("SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) >= 300 AS ready FROM events WHERE CAST(floor(value * 100) AS BIGINT) >= 1600")
def q_waits(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("samples", F.floor(F.col("value") * 100))
    return segment.waits(segment.long_enough(rows, "samples"), "user_id", "event_id", "value", 300.0).select("event_id", "ready")


@query("""WITH m AS (SELECT *, sum(CASE WHEN event_type IN ('signup', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS segment, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS w FROM events)
SELECT event_id, CAST(segment AS BIGINT) AS segment, CAST(row_number() OVER (PARTITION BY user_id, segment ORDER BY event_id) - 1 AS INTEGER) AS step, min_by(event_id, event_id) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id, segment ORDER BY event_id) AS detected,
  row_number() OVER (PARTITION BY user_id, w ORDER BY event_id) = 1 AS is_first FROM m""")
def q_refreshed(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("lang", F.when(F.col("event_type") == "click", F.col("event_id")))
    got = segment.refreshed(rows, "user_id", "event_id", F.col("event_type").isin("signup", "error"), "lang", F.col("event_type") == "error")
    return got.select("event_id", "segment", "step", "detected", "is_first")


@query("""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '[ \n\t]+'), lambda x: x <> '') AS w FROM conversations),
e AS (SELECT conv_id, turn, unnest(range(len(w))) AS i, unnest(w) AS x FROM w), s AS (SELECT *, sum(length(x) % 3 + 1) OVER (PARTITION BY conv_id, turn ORDER BY i) AS upto FROM e)
SELECT conv_id, turn, CAST(i AS INTEGER) AS i, x AS text, round((upto - length(x) % 3) * 0.02::DOUBLE + turn, 6) AS start, round(upto * 0.02::DOUBLE + turn, 6) AS "end" FROM s""")
def q_word_times(spark, sf_dir):
    """Each word has as many tokens as its length says, each token its own frame."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(words(), lambda w: F.struct(w.alias("text"), F.array_repeat(F.lit(1), (F.length(w) % 3 + 1).cast("int")).alias("tokens"))).alias("w"))
    frames = F.sequence(F.lit(1), F.greatest(F.aggregate("w", F.lit(0), lambda n, w: n + F.size(w["tokens"])), F.lit(1)))
    timed = rows.withColumn("f", frames).withColumn("t", commit.word_times("w", "f", F.col("turn")))
    return timed.select("conv_id", "turn", F.posexplode("t").alias("i", "x")).select("conv_id", "turn", "i", "x.text", r6("x.start").alias("start"), r6("x.end").alias("end"))


_BEGIN = 100


def _decoder():
    """Windows of a file: half of the files with a silent start, all others with one segment after the other."""

    def decode(key, seek, size):
        if key % 2 and seek == 0:
            return {"tokens": [7], "no_speech_prob": 0.9, "avg_logprob": -2.0}
        return {"tokens": [_BEGIN, 7, _BEGIN + 40 + key, _BEGIN + 40 + key]}

    return decode


_SEEK_SQL = """WITH RECURSIVE f AS (SELECT CAST(n_nationkey AS BIGINT) AS k, 1000 + 100 * n_nationkey AS n FROM nation),
s AS (SELECT k, n, CASE WHEN k % 2 = 1 THEN least(600, n) ELSE 0 END AS seek, 0 AS id FROM f UNION ALL SELECT k, n, seek + {step}, id + 1 FROM s WHERE seek + {step} < n)
SELECT k, CAST(id AS BIGINT) AS id, CAST(seek AS BIGINT) AS seek, round(seek * 0.01::DOUBLE, 6) AS start, round(seek * 0.01::DOUBLE + (40 + k) * 0.02::DOUBLE, 6) AS "end" FROM s WHERE seek < n"""


def _seek(spark, sf_dir, padded):
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), (F.col("n_nationkey") * 100 + 1000).alias("frames"))
    got = timing.windowed(rows, "k", "frames", _decoder, _BEGIN, 600, padded)
    return got.select("k", "id", "seek", r6("start").alias("start"), r6("end").alias("end"))


@query(_SEEK_SQL.format(step="2 * (40 + k)"))
def q_seek_windows(spark, sf_dir):
    return _seek(spark, sf_dir, True)


@query(_SEEK_SQL.format(step="least(2 * (40 + k), least(600, n - seek))"))
def q_seek_windows_unpadded(spark, sf_dir):
    return _seek(spark, sf_dir, False)


# --- stateful operators in their batch form -------------------------------------------------------------------------------------------
@query(r"""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations),
a AS (SELECT conv_id, turn, flatten(list(w) OVER (PARTITION BY conv_id ORDER BY turn)) AS a FROM w) SELECT conv_id, turn, array_to_string(a[-50:], ' ') AS context FROM a""")
def q_stateful_context(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lit(False).alias("is_last"))
    return processors.batch(rows, processors.ContextBuffer(50), "conv_id", "turn")


@query("SELECT conv_id * 1000 + turn AS k, md5(text) AS t FROM conversations WHERE text <> ''")
def q_stateful_characters(spark, sf_dir):
    """Texts cut after every third byte, and put together again."""
    raw = F.encode("text", "UTF-8")
    n = F.ceil(F.octet_length("text") / 3).cast("int")
    rows = table(spark, sf_dir, "conversations").where("text <> ''").select((F.col("conv_id") * 1000 + F.col("turn")).alias("k"), F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(raw, i * 3 + 1, F.lit(3)))).alias("seq", "raw"))
    got = processors.batch(rows, processors.CharacterCarry(), "k", "seq")
    return got.groupBy("k").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")).alias("t"))


@query("SELECT user_id, event_id, event_type AS line FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def q_stateful_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("line"))
    return processors.batch(rows, processors.ChangedLine(), "user_id", "event_id")


@query("""WITH RECURSIVE o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id, value AS b, value + 5 AS e FROM events),
m AS (SELECT user_id, k, event_id, b, greatest(e, b + 0.001) AS e FROM o WHERE k = 1 UNION ALL
  SELECT o.user_id, o.k, o.event_id, greatest(o.b, m.e + 0.001), greatest(o.e, greatest(o.b, m.e + 0.001) + 0.001) FROM m JOIN o ON o.user_id = m.user_id AND o.k = m.k + 1)
SELECT user_id, event_id, round(b, 4) AS beg, round(e, 4) AS "end" FROM m""")
def q_stateful_monotone(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("beg"), (F.col("value") + 5).alias("end"))
    return processors.batch(rows, processors.Monotone(), "user_id", "event_id").select("user_id", "event_id", F.round("beg", 4).alias("beg"), F.round("end", 4).alias("end"))
