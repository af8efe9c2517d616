"""Sources and sinks: dialogue samples, diagnostics and reports as JSON, with declared schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: field names and types of recorded files
SAMPLE = "conversationId STRING, initiatorWorkerId LONG, respondentWorkerId LONG, messages ARRAY<STRUCT<senderWorkerId: LONG, text: STRING>>, movieMentions STRING, respondentQuestions STRING"
RESPONSE = "conversation_id STRING, turn_index LONG, selected_movie STRING, generated_response STRING, reference_response STRING"
DIAGNOSTIC = (
    "conversation_id STRING, dataset STRING, turn_index LONG, format LONG, dialogue_history STRING, ground_truth_movies ARRAY<STRING>, kbrd_top1 STRING, selected_movie STRING, selected_candidate_source STRING, "
    "gold_candidate_source STRING, gold_rank LONG, candidate_count LONG, skip_reranker BOOLEAN, correct BOOLEAN, gold_in_top_1 BOOLEAN, gold_in_top_10 BOOLEAN, gold_in_top_50 BOOLEAN, reranker_fallback BOOLEAN, weak_seed_fallback BOOLEAN, "
    "detected_decades ARRAY<STRING>, extracted_seeds ARRAY<STRING>, qwen_fallback_seeds ARRAY<STRING>, filtered_noisy_seeds ARRAY<STRING>, fused_candidate_titles ARRAY<STRING>, seed_entity_ids ARRAY<LONG>, "
    "candidate_sources MAP<STRING, LONG>, num_extracted_seeds LONG, num_matched_seeds LONG, num_filtered_noisy_seeds LONG, num_fused_seed_candidates LONG, num_fused_qwen_candidates LONG"
)
HUMAN_SCORES = "scores ARRAY<STRUCT<id: INT, movie: STRING, fluency: INT, informativeness: INT, consistency: INT>>, averages STRUCT<fluency: DOUBLE, informativeness: DOUBLE, consistency: DOUBLE>"
BAD = "_bad"


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


def read_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, bad) of a JSON lines file; bad lines are kept apart as text, so that they can be counted."""
    full = T._parse_datatype_string(schema).add(BAD, "string")
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r")).select("r.*")
    return parsed.where(F.col(BAD).isNull()).drop(BAD), parsed.where(F.col(BAD).isNotNull()).select(BAD)


def read_samples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(samples, bad lines). Maps that come as lists are empty maps; a missing worker id is -1."""
    rows, bad = read_lines(spark, path, SAMPLE)
    mapped = lambda c, kind: F.coalesce(F.from_json(c, kind), F.create_map().cast(kind))
    samples = rows.withColumn("movieMentions", mapped("movieMentions", "map<string,string>")).withColumn("respondentQuestions", mapped("respondentQuestions", "map<string,struct<suggested:int>>"))
    return samples.fillna(-1, ["initiatorWorkerId", "respondentWorkerId"]), bad


def read_report(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One multi-line JSON document a file, byte order marks allowed."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON cache, or an empty frame of its schema where there is none."""
    return read_report(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def latest(spark: SparkSession, pattern: str) -> str | None:
    """The last path by code points that matches pattern."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(pattern)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return max((str(f.getPath()) for f in found), default=None) if found else None


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines; the committer publishes all files or none."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_document(report: DataFrame, path: str, indent: int = 4) -> None:
    """The one row of report as an indented JSON document."""
    (row,) = report.limit(2).collect()
    text = json.dumps(row.asDict(recursive=True), indent=indent, ensure_ascii=False)
    report.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def metrics_long(report: DataFrame, keys: list[str]) -> DataFrame:
    """keys, metric, value of a wide report: '@' in names becomes '_at_', nulls are left out."""
    names = [c for c in report.columns if c not in keys]
    rows = report.select(*keys, F.explode(F.array(*[F.struct(F.lit(c.replace("@", "_at_")).alias("metric"), F.col(f"`{c}`").cast("double").alias("value")) for c in names])).alias("m"))
    return rows.select(*keys, "m.metric", "m.value").where("value IS NOT NULL")
