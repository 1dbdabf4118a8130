"""Queries over files that they write themselves from the given tables, and over extension points, with their SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import arrays, text
from tidemark.operators import prepare, timing
from tidemark.plans import plugins
from tidemark.plans.bridge import table
from tidemark.plans.registry import query
from tidemark.sources import files, results, sinks
from tidemark.streaming.sources import first_of_each


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: below spark.checkpoint.dir, or where that is unset and all runs in one process a temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return f"{folder.rstrip('/')}/{sc.applicationId}/{uuid.uuid4().hex}"
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
    local = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    return local


def as_documents(spark: SparkSession, rows: DataFrame, file: Column, value: Column) -> str:
    """A folder of one file for each row."""
    results.register(spark)
    folder = scratch(spark)
    rows.select(file.alias("file"), value.alias("value")).write.format("results").option("kind", "documents").mode("append").save(folder)
    return f"{folder}/job=*"


def _talks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("name", F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn"))


# --- readers --------------------------------------------------------------------------------------------------------------
@query("""WITH t AS (SELECT 'c' || conv_id || '-' || turn AS name, text FROM conversations WHERE coalesce(text, '') <> '')
SELECT name AS file, md5(text) AS reference FROM t UNION ALL SELECT name || '.wav', md5(text) FROM t""")
def q_references(spark, sf_dir):
    """Each conversation's texts as a JSON array in a file of its own."""
    rows = _talks(spark, sf_dir).select("conv_id", F.struct(F.concat(F.lit("d/"), "name", F.lit(".wav")).alias("audio_path"), F.col("text").alias("text_en")).alias("r"))
    rows = rows.groupBy("conv_id").agg(F.to_json(F.collect_list("r")).alias("value"))
    got = files.references(spark, as_documents(spark, rows, F.concat(F.col("conv_id").cast("string"), F.lit(".json")), F.col("value")))
    return got.select("file", F.md5("reference").alias("reference"))


@query("""WITH t AS (SELECT 'c' || conv_id || '-' || turn AS name, coalesce(text, '') AS text, turn + 0.5 AS late FROM conversations)
SELECT name AS file, md5(text) AS generated, CAST(late AS DOUBLE) AS late FROM t UNION ALL SELECT name || '.wav', md5(text), CAST(late AS DOUBLE) FROM t""")
def q_batch_hypotheses(spark, sf_dir):
    item = F.struct(F.concat(F.lit("d/"), "name", F.lit(".wav")).alias("file"), F.lit(1.0).alias("duration"), F.col("text").alias("transcription"), (F.col("turn") + 0.5).alias("first_token_latency_ms"))
    rows = _talks(spark, sf_dir).groupBy("conv_id").agg(F.to_json(F.struct(F.count("*").alias("total_files"), F.collect_list(item).alias("results"))).alias("value"))
    got = files.hypotheses(spark, as_documents(spark, rows, F.concat(F.col("conv_id").cast("string"), F.lit(".json")), F.col("value")))
    return got.select("file", F.md5("generated").alias("generated"), F.col("first_token_latency_ms").alias("late"))


@query(r"SELECT 'c' || conv_id || '-' || turn AS file, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS generated FROM conversations")
def q_individual_hypotheses(spark, sf_dir):
    folder = as_documents(spark, _talks(spark, sf_dir), F.concat("name", F.lit("_transcription.txt")), F.col("text"))
    return files.individual_hypotheses(spark, folder).select("file", F.md5("generated").alias("generated"))


@query("SELECT 'conv-' || conv_id || '.log' AS file, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line_no, md5(replace(text, chr(10), ' ')) AS value FROM conversations")
def q_numbered_lines(spark, sf_dir):
    line = F.struct("turn", F.replace("text", F.lit("\n"), F.lit(" ")).alias("t"))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("value"))
    folder = as_documents(spark, rows, F.concat(F.lit("conv-"), "conv_id", F.lit(".log")), F.col("value"))
    return files.numbered_lines(spark, folder).select("file", "line_no", F.md5("value").alias("value"))


@query("SELECT doc_id, md5(text) AS continuation, len(string_split(text, ' ')) AS n FROM documents WHERE doc_id % 3 <> 0")
def q_sample_lines(spark, sf_dir):
    """Correction samples as JSON lines, each third one broken."""
    path = scratch(spark) + "/samples"
    line = F.to_json(F.struct(F.split("text", " ").alias("k_best_candidates"), F.lit(1).alias("num_candidates"), F.lit("p").alias("previous_transcript"), F.col("text").alias("continuation_transcript"), F.col("doc_id").cast("string").alias("audio_path")))
    docs = table(spark, sf_dir, "documents")
    docs.select(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("{"), line)).otherwise(line).alias("value")).write.text(path)
    got = files.samples(spark, path)
    return got.select(F.col("audio_path").cast("bigint").alias("doc_id"), F.md5("continuation_transcript").alias("continuation"), F.size("k_best_candidates").cast("bigint").alias("n"))


@query("SELECT kind, p_partkey, p_name AS title FROM part, (VALUES ('csv'), ('json'), ('parquet')) k(kind)")
def q_dataset_formats(spark, sf_dir):
    """One table in three formats, read by extension with a column renamed."""
    path, part, out = scratch(spark), table(spark, sf_dir, "part").select("p_partkey", "p_name"), None
    part.write.option("header", True).csv(f"{path}/t.csv")
    part.write.json(f"{path}/t.jsonl")
    part.write.parquet(f"{path}/t.parquet")
    for kind in ("csv", "jsonl", "parquet"):
        rows = files.dataset(spark, f"{path}/t.{kind}", {"p_name": "title"}).select(F.lit(kind.removesuffix("l") if kind == "jsonl" else kind).alias("kind"), F.col("p_partkey").cast("bigint").alias("p_partkey"), "title")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 1")
def q_resumed(spark, sf_dir):
    """An output that holds some keys already, appended twice; what is left to do."""
    path, docs = scratch(spark) + "/out", table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("audio_path"))
    for k in range(2):
        sinks.append_json(docs.where(f"doc_id % 8 = {1 + 4 * k}").select("audio_path"), path)
    done = files.processed_keys(spark, path)
    return prepare.not_processed(docs, done, F.col("audio_path"), F.col("audio_path")).select("doc_id")


@query("SELECT 'd/' || doc_id || '.wav' AS path, md5(text) AS bytes FROM documents WHERE text IS NOT NULL")
def q_blob_table(spark, sf_dir):
    path = scratch(spark) + "/blobs"
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    docs.select("doc_id", F.struct(F.concat(F.lit("d/"), "doc_id", F.lit(".wav")).alias("path"), F.col("text").cast("binary").alias("bytes")).alias("audio")).write.parquet(path)
    blobs, _ = files.parquet_with_blob(spark, path)
    return blobs.select("path", F.md5("bytes").alias("bytes"))


def _pcm(v: str) -> Column:
    """A vector's numbers, a third of them each, as 16-bit samples."""
    sample = lambda x: F.pmod(F.floor(x.cast("double") * 8192).cast("int"), F.lit(65536))
    two = lambda n: F.concat(F.lpad(F.hex(n % 256), 2, "0"), F.lpad(F.hex(F.floor(n / 256)), 2, "0"))
    return F.unhex(F.array_join(F.transform(v, lambda x: two(sample(F.greatest(F.least(x, F.lit(3.9)), F.lit(-3.9))))), ""))


_SAMPLES = "list_transform(embedding, lambda x: floor(greatest(least(x, CAST(3.9 AS FLOAT)), CAST(-3.9 AS FLOAT))::DOUBLE * 8192) / 32768)"


@query(f"SELECT vec_id, len(embedding) AS n, round(list_sum({_SAMPLES}), 5) AS total FROM embeddings")
def q_pcm_samples(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", arrays.decode_pcm(_pcm("embedding")).alias("x"))
    return rows.select("vec_id", F.size("x").cast("bigint").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query(f"SELECT vec_id, len(embedding) AS n, round(list_sum({_SAMPLES}), 5) AS total FROM embeddings")
def q_wav_samples(spark, sf_dir):
    """The same with a header of 16 kHz, one channel."""
    size = lambda n: F.concat(*(F.lpad(F.hex(F.floor(n / 256**k) % 256), 2, "0") for k in range(4)))
    pcm = _pcm("embedding")
    n = F.octet_length(pcm)
    head = F.concat(F.lit("52494646"), size(n + 36), F.lit("57415645666D74201000000001000100803E0000007D00000200100064617461"), size(n))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", arrays.decode_wav(F.concat(F.unhex(head), pcm)).alias("x"))
    return rows.select("vec_id", F.size("x").cast("bigint").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


# --- writers --------------------------------------------------------------------------------------------------------------
@query("SELECT user_id AS segment, event_id % 3 AS iteration, count(*) AS n FROM events GROUP BY ALL")
def q_iterations(spark, sf_dir):
    path = scratch(spark) + "/iterations"
    sinks.write_iterations(table(spark, sf_dir, "events").select(F.col("user_id").alias("segment"), (F.col("event_id") % 3).alias("iteration"), F.col("event_type").alias("text")), path)
    return files.iterations(spark, path).groupBy(F.col("segment").cast("bigint").alias("segment"), F.col("iteration").cast("bigint").alias("iteration")).agg(F.count("*").alias("n"))


@query("SELECT event_id, event_type AS text, CAST(round_even(value * 1000, 0) AS BIGINT) AS ms FROM events WHERE value > 100")
def q_published(spark, sf_dir):
    """Rows through the results writer, and read again."""
    results.register(spark)
    path = scratch(spark)
    rows = table(spark, sf_dir, "events").where("value > 100").select("event_id", F.col("event_type").alias("text"), F.bround(F.col("value") * 1000).cast("bigint").alias("ms"))
    rows.write.format("results").option("kind", "json").mode("append").save(path)
    return spark.read.schema("event_id bigint, text string, ms bigint").option("recursiveFileLookup", True).json(path)


@query("SELECT count(*) AS total_files, count(text) AS processed_files, sum(length(text)) AS n_chars FROM conversations")
def q_summary_document(spark, sf_dir):
    """The summary document of all transcripts in parts, counted again from the parts."""
    path = scratch(spark) + "/summary"
    rows = _talks(spark, sf_dir).select(F.col("name").alias("file"), F.lit(1.0).alias("duration"), F.col("text").alias("transcription"), F.lit(2.0).alias("first_token_latency_ms"), F.lit(None).cast("double").alias("last_token_latency_ms"))
    results.write_summary(rows, path, ["file"])
    parts = spark.read.text(f"{path}/parts").select(F.from_json(F.substring("value", 2, 2**31 - 1), "file string, transcription string").alias("r"))
    return parts.agg(F.count("*").alias("total_files"), F.count("r.transcription").alias("processed_files"), F.sum(F.length("r.transcription")).cast("bigint").alias("n_chars"))


# --- preparation, timing and extension points --------------------------------------------------------------------------------
@query("""WITH c AS (SELECT conv_id, list(text ORDER BY turn) AS c, min_by(text, turn) AS p, max_by(text, turn) AS r FROM conversations GROUP BY conv_id)
SELECT conv_id, md5('Given the following ASR transcription candidates, predict the correct continuation.' || chr(10) || chr(10) || 'Previous confirmed transcript: "' || p || '"' || chr(10) || chr(10) || 'K-best candidates for the continuation:' || chr(10)
  || array_to_string(list_transform(list_zip(c[1:2], range(1, 3)), lambda z: '  ' || z[2] || '. ' || z[1])[1:least(2, len(c))], chr(10)) || chr(10) || chr(10) || 'Based on the context and candidates, what is the correct text that should be appended after "' || p || '"?') AS instruction, md5(r) AS response FROM c""")
def q_instructions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("k_best_candidates"), F.min_by("text", "turn").alias("previous_transcript"), F.max_by("text", "turn").alias("continuation_transcript"), F.lit(2).alias("num_candidates")
    )
    return prepare.instruction_rows(rows, keep=("conv_id",)).select("conv_id", F.md5("instruction").alias("instruction"), F.md5("response").alias("response"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def q_first_of_each(spark, sf_dir):
    return first_of_each(table(spark, sf_dir, "events"), "ts", ["user_id", "event_type"]).select("user_id", "event_type")


@query(r"SELECT page_id, lower(regexp_extract(string_split(url, '/')[-1], '.(\.[^.]*)$', 1)) AS ext FROM pages")
def q_extension(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.extension("url").alias("ext"))


@plugins.scorer("length")
def _length_scorer(scale: float = 1.0):
    return lambda batch: batch.assign(score=batch["text"].str.len() * scale)[["doc_id", "score"]]


@query("SELECT doc_id, length(text) * 0.5::DOUBLE AS score FROM documents WHERE text IS NOT NULL")
def q_scored(spark, sf_dir):
    return plugins.scored(table(spark, sf_dir, "documents").select("doc_id", "text").where("text IS NOT NULL"), "length", "doc_id long, score double", scale=0.5)


@query("SELECT conv_id, md5(list_sort(list_filter(list(text), lambda x: x IS NOT NULL))[-1]) AS correction FROM conversations GROUP BY conv_id HAVING count(text) > 0")
def q_corrected(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.lit("").alias("previous"), F.collect_list("text").alias("candidates")).where("size(candidates) > 0")
    largest = lambda previous, candidates: max(candidates, key=str.encode)
    return plugins.corrected(rows, "previous", "candidates", largest).select("conv_id", F.md5("correction").alias("correction"))


@query("SELECT event_id, CASE WHEN event_type <> 'error' THEN length(event_type) END AS n, CASE WHEN event_type = 'error' THEN 'an error' END AS error FROM events")
def q_guarded(spark, sf_dir):
    def work(row):
        if row["event_type"] == "error":
            raise ValueError("an error")
        return {"n": len(row["event_type"])}

    return plugins.guarded(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", work, {"n": "bigint"})


def _seconds_before(seq: Column) -> Column:
    """Nine words take 8 * 0.25 + 2 s; the first nine have no long one."""
    full = F.floor(seq / 9)
    return seq * 0.25 + F.when(seq % 9 == 0, F.greatest(full - 1, F.lit(0))).otherwise(full) * 1.75


@query(r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[^\s.,!?]+|[.,!?]') AS w FROM conversations), e AS (SELECT conv_id, turn, unnest(range(len(w))) AS i, unnest(w) AS x FROM t),
d AS (SELECT *, regexp_full_match(x, '[.,!?]') AS mark, CASE WHEN i >= 2 AND i % 9 = 0 THEN 2.0::DOUBLE ELSE 0.25::DOUBLE END AS d FROM e),
s AS (SELECT *, turn * 1000 + sum(d) OVER w AS "end", lag(x) OVER w IN ('.', '!', '?') AS after_mark, sum(CASE WHEN mark AND i > 0 THEN 0 ELSE 1 END) OVER w - 1 AS seq FROM d WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
c AS (SELECT *, CASE WHEN d > 0.5 AND NOT mark AND after_mark THEN "end" - 0.5::DOUBLE ELSE "end" - d END AS start FROM s)
SELECT conv_id, turn AS segment, CAST(seq AS BIGINT) AS seq, string_agg(CASE WHEN mark THEN x ELSE ' ' || x END, '' ORDER BY i) AS text, round(min_by(start, i), 2) AS start, round(min_by("end", i), 2) AS "end" FROM c GROUP BY conv_id, turn, seq""")
def q_word_repair(spark, sf_dir):
    """Words of a quarter of a second, each ninth of two, with marks apart: marks join their words, and a long word after a sentence's end is shortened."""
    marked = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("segment"), F.regexp_extract_all("text", F.lit(r"[^\s.,!?]+|[.,!?]"), 0).alias("w"))
    begins = lambda seq: F.col("segment") * 1000 + _seconds_before(seq)
    lasts = lambda seq: F.when((seq >= 2) & (seq % 9 == 0), 2.0).otherwise(0.25)
    end = F.size("w") - 1
    rows = marked.select("conv_id", "segment", begins(F.lit(0)).alias("seg_start"), (begins(end) + lasts(end)).alias("seg_end"), F.posexplode("w").alias("seq", "x"))
    seq = F.col("seq")
    rows = rows.withColumns({"start": begins(seq), "end": begins(seq) + lasts(seq), "text": F.when(F.col("x").rlike("^[.,!?]$"), F.col("x")).otherwise(F.concat(F.lit(" "), "x"))})
    return timing.repaired(rows.drop("x"), "conv_id")


_SERIES = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings"


@query(f"""WITH v AS ({_SERIES}) SELECT vec_id, CAST(unnest(range(64)) AS BIGINT) AS step, CAST(unnest(range(64)) AS BIGINT) AS i, CAST(unnest(range(64)) AS BIGINT) AS j, 0.0::DOUBLE AS cost FROM v""")
def q_warped(spark, sf_dir):
    """Each vector's running sums of absolute values against themselves: the diagonal."""
    from tidemark.functions import alignment

    v = F.transform("embedding", lambda x, i: i * 1000 + x.cast("double"))
    return alignment.warped(table(spark, sf_dir, "embeddings").select("vec_id", v.alias("x"), v.alias("y")), "vec_id", "x", "y")


