"""Chat sessions in batch and as a stream, against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from dialoom.operators import chat as C
from dialoom.streaming.session import chat_stream

SAID = ["I want a scary film", "Tell me more", "war and comedy from the 80s", " ", None, "I saw Blade Runner, or the nineties", 'like "the big short" please', "Tell me more about it"]


@pytest.fixture(scope="module")
def messages(spark):
    rng = random.Random(2)
    rows = []
    for session in range(12):
        for turn in range(rng.randint(1, 14)):
            text = rng.choice(SAID)
            rows.append((session, turn * 2, text, bool(text) and text.startswith("Tell"), rng.choice(["Alien", "Jaws", "Heat", None]), rng.random() < 0.3))
    return rows, spark.createDataFrame(rows, "session long, turn long, text string, label boolean, pick string, weak boolean")


def played(spark, rows, loaded):
    """The state after each message, one after the other."""
    said = sorted({r[2].strip() for r in rows if (r[2] or "").strip()})
    noted = {r.text: r for r in C.noted(spark.createDataFrame([(t,) for t in said], "text string")).collect()}
    out, state = {}, {}
    for session, turn, text, label, pick, weak in sorted(rows, key=lambda r: r[:2]):
        if not (text or "").strip():
            continue
        s = state.setdefault(session, {"n": 0, "movie": None, "genres": [], "decades": [], "films": [], "weak": False, "told": []})
        s["n"] += 1
        follows = label and s["movie"] is not None
        if follows or loaded:
            for c in ("genres", "decades", "films"):
                s[c] += [x for x in noted[text.strip()][c] if x not in s[c]]
        pick = pick if loaded else None
        if not follows:
            s["weak"] = weak
            if pick:
                s["movie"] = pick
                s["told"] += [pick] if pick not in s["told"] else []
        out[session, turn] = (s["n"], "FOLLOW_UP" if follows else "NEW_PREFERENCE", s["movie"] if follows else pick, list(s["genres"]), list(s["decades"]), list(s["films"]), len(s["films"]), s["weak"], list(s["told"]), None if follows or pick else C.TROUBLE)
    return out


@pytest.mark.parametrize("loaded", [True, False])
def test_states(spark, messages, loaded):
    rows, df = messages
    got = C.states(df.drop("label", "pick", "weak").join(df.select("session", "turn", "label", "pick", F.col("weak").alias("w")), ["session", "turn"]), F.col("label"), F.col("pick"), F.col("w"), loaded)
    assert {(r[0], r[1]): tuple(r)[2:] for r in got.collect()} == played(spark, rows, loaded)


def test_the_stream_keeps_the_same_state(spark, messages, tmp_path):
    rows, df = messages
    for n, part in enumerate((df.where("turn < 8"), df.where("turn >= 8"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = chat_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r[0], r[1]): tuple(r)[2:] for r in got} == played(spark, rows, True)


def test_shown_choice(spark):
    df = spark.createDataFrame([("HEAT", ["Jaws", "Heat"]), ("x", ["Jaws"]), ("f", list("abcdef"))], "s string, c array<string>")
    assert [tuple(r[0]) for r in df.select(C.shown_choice(F.col("s"), F.col("c"))).collect()] == [(2, True), (None, False), (None, False)]
