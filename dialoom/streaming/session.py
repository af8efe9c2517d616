"""Session profiles and chats as streams: the state of each session lives in Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import chat

OUT = "user_id long, event_id long, turn long, profile string"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    turn, seen = state.get if state.exists else (0, "")
    profile = seen.split(",") if seen else []
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    out = []
    for event_id, kind in zip(rows["event_id"], rows["event_type"], strict=True):
        turn += 1
        if kind is not None and kind not in profile:
            profile.append(kind)
        out.append((key[0], int(event_id), turn, ",".join(profile)))
    state.update((turn, ",".join(profile)))
    yield pd.DataFrame(out, columns=["user_id", "event_id", "turn", "profile"])


def profile_stream(events: DataFrame) -> DataFrame:
    """A streaming frame of OUT from a streaming frame of events (user_id, event_id, ts, event_type). A session's events
    of one batch are put in order; later batches go on from its state."""
    return events.select("user_id", "event_id", "ts", "event_type").groupBy("user_id").applyInPandasWithState(_advance, OUT, "turn long, seen string", "append", GroupStateTimeout.NoTimeout)


def run_available(events: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there now and append it to Parquet at path."""
    profile_stream(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


CHAT = "session long, turn long, number int, route string, movie string, genres array<string>, decades array<string>, films array<string>, seed_count int, fallback_used boolean, previously_recommended array<string>, response string"
CHAT_STATE = "number int, movie string, genres array<string>, decades array<string>, films array<string>, fallback_used boolean, previously_recommended array<string>"


def _answer(loaded: bool, forget_ms: int | None):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        number, movie, genres, decades, films, weak, told = state.get if state.exists else (0, None, [], [], [], False, [])
        genres, decades, films, told = (list(x) for x in (genres, decades, films, told))
        out = []
        for m in pd.concat(list(batches)).sort_values("turn").itertuples():
            number += 1
            follows = bool(m.label) and movie is not None
            pick = m.pick if loaded and isinstance(m.pick, str) else None
            if follows or loaded:
                for have, got in ((genres, m.genres), (decades, m.decades), (films, m.films)):
                    have += [x for x in dict.fromkeys(got) if x not in have]
            if not follows:
                weak = bool(m.weak)
                if pick is not None:
                    movie = pick
                    told += [pick] if pick not in told else []
            about = movie if follows else pick
            out.append((key[0], m.turn, number, "FOLLOW_UP" if follows else "NEW_PREFERENCE", about, list(genres), list(decades), list(films), len(films), weak, list(told), None if follows or pick is not None else chat.TROUBLE))
        state.update((number, movie, genres, decades, films, weak, told))
        if forget_ms:
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHAT.split(", ")])

    return step


def chat_stream(messages: DataFrame, loaded: bool = True, forget_ms: int | None = None) -> DataFrame:
    """The states of operators.chat as a stream, from a streaming frame of messages (session, turn, text, label, pick, weak).
    A session's messages of one batch are put in order; later batches go on from its state. Sessions that say nothing for
    forget_ms are forgotten; a stream that forgets never ends by itself, also not by availableNow."""
    rows = chat.noted(chat.received(messages)).select("session", "turn", F.coalesce("label", F.lit(False)).alias("label"), "pick", F.coalesce("weak", F.lit(False)).alias("weak"), "genres", "decades", "films")
    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout
    return rows.groupBy("session").applyInPandasWithState(_answer(loaded, forget_ms), CHAT, CHAT_STATE, "append", timeout)
