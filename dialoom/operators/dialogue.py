"""Dialogues from message rows (conv_id, turn, role, text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def lines(messages: DataFrame) -> DataFrame:
    """messages with line, 'User: …' or 'System: …', cleaned; blank messages dropped."""
    cleaned = messages.withColumn("text", F.trim(T.unescaped(F.col("text")))).where("text <> ''")
    role = F.when(F.col("role") == "user", "User").otherwise("System")
    return cleaned.withColumn("line", F.concat(role, F.lit(": "), F.col("text")))


def rendered(messages: DataFrame) -> DataFrame:
    """conv_id, dialogue: the lines of each conversation in order of turns."""
    rows = lines(messages).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("l"))
    return rows.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("dialogue"))


def prefixes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, prefix: for each message all lines before it, '' for the first."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return lines(messages).select("conv_id", "turn", "role", F.array_join(F.collect_list("line").over(before), "\n").alias("prefix"))


def from_samples(samples: DataFrame) -> DataFrame:
    """Message rows from dialogue samples as sources.read_samples gives them: mentions put in, the initiator is the user."""
    each = samples.select("conversationId", "initiatorWorkerId", "movieMentions", F.posexplode("messages").alias("turn", "m"))
    mentions = F.coalesce("movieMentions", F.create_map().cast("map<string,string>"))
    return each.select(F.col("conversationId").alias("conv_id"), "turn", F.when(F.col("m.senderWorkerId").eqNullSafe(F.col("initiatorWorkerId")), "user").otherwise("assistant").alias("role"), T.with_mentions(F.col("m.text"), mentions).alias("text"))


def gold_titles(samples: DataFrame) -> DataFrame:
    """conv_id, turn, title: of each respondent message the mentioned titles that were suggested; duplicates stay."""
    each = samples.select("conversationId", "respondentWorkerId", "movieMentions", "respondentQuestions", F.posexplode("messages").alias("turn", "m")).where("m.senderWorkerId = respondentWorkerId")
    ids = each.select(F.col("conversationId").alias("conv_id"), "turn", "movieMentions", "respondentQuestions", F.explode(T.mention_ids(F.col("m.text"))).alias("id"))
    title = F.trim(F.lower(F.col("movieMentions")[F.col("id")]))
    return ids.where(F.col("respondentQuestions")[F.col("id")]["suggested"] == 1).select("conv_id", "turn", title.alias("title")).where("title <> ''")
