"""Chat sessions: what each user message does to a session's state, for all sessions in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed value: what is said when there is no recommender, or when it fails.
TROUBLE = "I encountered an issue with the recommendation model. Please try again or rephrase your request."


def received(messages: DataFrame) -> DataFrame:
    """messages (session, turn, text) with the text trimmed; blank ones are refused and count no turn."""
    return messages.withColumn("text", F.trim(F.coalesce("text", F.lit("")))).where("text <> ''")


def noted(messages: DataFrame) -> DataFrame:
    """messages with the genres, decades and films that each names."""
    return messages.withColumns({"genres": T.message_genres(F.col("text")), "decades": T.message_decades(F.col("text")), "films": T.mentioned_titles(F.col("text"))})


def seen(column: str, window) -> Column:
    """The distinct values of the arrays so far, in the order first seen."""
    return F.array_distinct(F.flatten(F.collect_list(column).over(window)))


def states(messages: DataFrame, follow_up: Column, movie: Column, weak: Column, loaded: bool = True) -> DataFrame:
    """The state after each message of messages (session, turn, text): session, turn, number, route, movie (the one the
    answer is about), genres, decades, films, seed_count, fallback_used, previously_recommended, response (null where a
    model says it).

    follow_up: whether the message is labelled a follow-up; movie: what the recommender picks for it, null where it
    fails; weak: whether it fell back for weak seeds. A follow-up is one only if the session has a movie, which is so as
    soon as the recommender has answered once; it leaves movie, fallback_used and recommendations as they are. If the
    recommender is not loaded, messages that need it get an apology and leave the profile untouched."""
    rows = noted(received(messages)).withColumns({"label": follow_up, "pick": movie if loaded else F.lit(None).cast("string"), "weak": weak})
    by = Window.partitionBy("session").orderBy("turn")
    before, upto = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0)
    had = F.coalesce(F.max(F.col("pick").isNotNull()).over(before), F.lit(False))
    rows = rows.withColumn("number", F.row_number().over(by)).withColumn("route", F.when(F.col("label") & had, "FOLLOW_UP").otherwise("NEW_PREFERENCE"))
    new = F.col("route") == "NEW_PREFERENCE"
    # the profile takes part in all but messages that a missing recommender should have answered
    kept = lambda c: F.when(F.lit(loaded) | ~new, F.col(c)).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({c: kept(c) for c in ("genres", "decades", "films")}).withColumn("recommended", F.when(new, F.col("pick")))
    told = F.when(new & F.col("pick").isNull(), F.lit(TROUBLE))
    return rows.select(
        "session", "turn", "number", "route", F.when(new, F.col("pick")).otherwise(F.last("recommended", True).over(upto)).alias("movie"), seen("genres", upto).alias("genres"), seen("decades", upto).alias("decades"),
        seen("films", upto).alias("films"), F.size(seen("films", upto)).alias("seed_count"), F.coalesce(F.last(F.when(new, F.coalesce("weak", F.lit(False))), True).over(upto), F.lit(False)).alias("fallback_used"),
        F.array_distinct(F.collect_list("recommended").over(upto)).alias("previously_recommended"), told.alias("response"),
    )


def shown_choice(selected: Column, candidates: Column, most: int = 5) -> Column:
    """(rank, in_top) of the selected title among the first `most` candidates' titles, letter case aside."""
    place = F.nullif(F.array_position(F.transform(F.slice(candidates, 1, most), F.lower), F.lower(selected)), F.lit(0))
    return F.struct(place.cast("int").alias("rank"), place.isNotNull().alias("in_top"))
