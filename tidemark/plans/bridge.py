"""Views that put the driver's tables into the library's terms, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(c: str = "text"):
    return F.filter(F.split(F.col(c), "[ \n\t]+"), lambda w: w != "")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as references and worse hypotheses: their words, and those without each fifth, with letters changed in each third."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", words().alias("ref"))
    kept = F.filter(F.transform("ref", lambda w, i: F.when(i % 3 == 0, F.replace(w, F.lit("e"), F.lit("a"))).otherwise(w)), lambda w, i: i % 5 != 4)
    return rows.withColumn("hyp", kept)


PAIRS_SQL = """
w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '[ \n\t]+'), lambda x: x <> '') AS ref FROM conversations),
pairs AS (SELECT conv_id, turn, ref, list_filter(list_transform(list_zip(ref, range(len(ref))), lambda z: CASE WHEN z[2] % 5 = 4 THEN NULL WHEN z[2] % 3 = 0 THEN replace(z[1], 'e', 'a') ELSE z[1] END), lambda x: x IS NOT NULL) AS hyp FROM w)
"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of a stream for each user, with seconds since 1970."""
    rows = table(spark, sf_dir, "events")
    return rows.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


FRAMES_SQL = "frames AS (SELECT *, epoch_us(ts) / 1e6 AS t FROM events)"
