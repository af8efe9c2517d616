"""Session state over events: users are sessions, event types the values of a profile, errors resets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chat as C
from ..operators import session as S
from ..functions import vocab
from ..sources.io import is_folder
from ..streaming.session import run_available
from .registry import Tables, query

SEEN = """firsts AS (SELECT user_id, seg, event_type, min((ts, event_id)) AS f FROM e GROUP BY ALL),
turns AS (SELECT *, row_number() OVER (PARTITION BY user_id, seg ORDER BY ts, event_id) AS turn FROM e)
SELECT t.user_id, t.event_id, {0} t.turn, string_agg(f.event_type, ',' ORDER BY f.f) AS profile FROM turns t JOIN firsts f ON f.user_id = t.user_id AND f.seg = t.seg AND f.f <= (t.ts, t.event_id) GROUP BY ALL"""
ORDER = ["ts", "event_id"]
SAID = "text || CASE WHEN turn % 4 = 2 THEN ' Tell me more about it' WHEN turn % 3 = 0 THEN ' a scary war film of the 80s, sci fi or family drama' ELSE '' END"
PICK = "CASE WHEN (conv_id + turn) % 7 = 3 THEN NULL ELSE 'Item ' || (conv_id * 7 + turn) % 4 END"


def events(t: Tables) -> DataFrame:
    return t.events.select("user_id", "event_id", "ts", "event_type")


@query(f"WITH e AS (SELECT user_id, event_id, ts, event_type, 0 AS seg FROM events), {SEEN.format('')}")
def session_profile(t: Tables) -> DataFrame:
    return S.profiles(events(t), ["user_id"], ORDER, "event_type").select("user_id", "event_id", F.col("turn").cast("long").alias("turn"), F.array_join("profile", ",").alias("profile"))


@query(f"WITH e AS (SELECT user_id, event_id, ts, event_type, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS seg FROM events), {SEEN.format('t.seg AS segment,')}")
def session_reset_segments(t: Tables) -> DataFrame:
    parted = S.segments(events(t), "user_id", ORDER, F.col("event_type") == "error")
    return S.profiles(parted, ["user_id", "segment"], ORDER, "event_type").select("user_id", "event_id", "segment", F.col("turn").cast("long").alias("turn"), F.array_join("profile", ",").alias("profile"))


@query(f"WITH e AS (SELECT user_id, event_id, ts, event_type, 0 AS seg FROM events), {SEEN.format('')}")
def session_profile_stream(t: Tables) -> DataFrame:
    """session_profile, run as a stream to its end."""
    spark = t.spark
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        base = f"file://{tempfile.mkdtemp(prefix='dialoom-stream-')}"
    path = f"{base}/session-stream-{uuid.uuid4().hex}"
    reader, name = spark.readStream.schema(t.events.schema), "events.parquet"
    # a stream reads folders: that of the table, or the one its file is in
    source = reader.parquet(f"{t.sf_dir}/{name}") if is_folder(spark, f"{t.sf_dir}/{name}") else reader.option("pathGlobFilter", name).parquet(t.sf_dir)
    run_available(source, f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out")


INTENT = "CASE WHEN regexp_matches(lower(text), '\\bwhy\\b|tell me more|what is it about|who directed|i watched|i liked') THEN 'FOLLOW_UP' ELSE 'NEW_PREFERENCE' END"


@query(rf"""WITH c AS (SELECT conv_id, turn, role, text || CASE WHEN turn % 4 = 2 THEN ' Tell me more about it' ELSE '' END AS text FROM conversations),
i AS (SELECT *, {INTENT} AS label, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS has_last FROM c)
SELECT conv_id, turn, label, CASE WHEN label = 'FOLLOW_UP' AND has_last THEN 'FOLLOW_UP' ELSE 'NEW_PREFERENCE' END AS route FROM i WHERE role = 'user'""")
def intent_route(t: Tables) -> DataFrame:
    """The stand-in labels a message; a follow-up also needs an earlier recommendation."""
    from pyspark.sql import Window

    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    said = F.concat("text", F.when(F.col("turn") % 4 == 2, " Tell me more about it").otherwise(""))
    follow = F.rlike(F.lower(said), F.lit(r"\bwhy\b|tell me more|what is it about|who directed|i watched|i liked"))
    rows = t.conversations.withColumn("label", F.when(follow, "FOLLOW_UP").otherwise("NEW_PREFERENCE")).withColumn("last", F.count(F.when(F.col("role") == "assistant", 1)).over(before))
    return rows.where("role = 'user'").select("conv_id", "turn", "label", F.when((F.col("label") == "FOLLOW_UP") & (F.col("last") > 0), "FOLLOW_UP").otherwise("NEW_PREFERENCE").alias("route"))


@query("""WITH p AS (SELECT user_id, event_type, min((ts, event_id)) AS f FROM events GROUP BY ALL), s AS (SELECT user_id, list(event_type ORDER BY f) AS l FROM p GROUP BY user_id)
SELECT user_id, array_to_string(l[1:2], ',') AS shown, greatest(len(l) - 2, 0)::BIGINT AS hidden, CASE WHEN l[1] IS NULL OR l[1] = 'error' THEN '-' ELSE upper(left(l[1], 1)) || substr(l[1], 2) END AS first FROM s""")
def profile_display(t: Tables) -> DataFrame:
    """The first two values of a profile, how many more there are, and the first one for display."""
    firsts = events(t).groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f"))
    l = firsts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("f", "event_type"))).alias("s")).select("user_id", F.transform("s", lambda x: x["event_type"]).alias("l"))  # noqa: E741
    head = F.get("l", F.lit(0))
    return l.select("user_id", F.array_join(F.slice("l", 1, 2), ",").alias("shown"), F.greatest(F.size("l") - 2, F.lit(0)).cast("long").alias("hidden"), F.when(head.isNull() | (head == "error"), "-").otherwise(F.concat(F.upper(F.substring(head, 1, 1)), F.substring(head, 2, 1 << 20))).alias("first"))


def sql_running(name: str, values: str) -> str:
    """A CTE: session, turn, name, the distinct values so far in the order first seen."""
    return f"""{name}_v AS (SELECT conv_id, turn, unnest(v) AS v, generate_subscripts(v, 1) AS i FROM (SELECT conv_id, turn, {values} AS v FROM r)),
{name}_f AS (SELECT conv_id, v, min((turn, i)) AS f FROM {name}_v GROUP BY ALL),
{name}_s AS (SELECT r.conv_id, r.turn, coalesce(string_agg(v, ',' ORDER BY f) FILTER (v IS NOT NULL), '') AS {name} FROM r LEFT JOIN {name}_f f ON f.conv_id = r.conv_id AND f.f[1] <= r.turn GROUP BY ALL)"""


GENRES = ", ".join(f"'{k}': '{v}'" for k, v in vocab.PROFILE_GENRES.items())
DECADES = ", ".join(f"CASE WHEN regexp_matches(lower(t), '{p}') THEN '{d}' END" for p, d in vocab.PROFILE_DECADES)
NAMED = rf"""list_concat(CASE WHEN contains(lower(t), 'science fiction') OR contains(lower(t), 'sci fi') OR contains(lower(t), 'sci-fi') THEN ['Sci-Fi'] ELSE [] END,
list_filter(list_transform(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}_''-]+'), lambda w: MAP {{{GENRES}}}[w]), lambda x: x IS NOT NULL))"""


@query(rf"""WITH m AS (SELECT conv_id, turn, trim({SAID}) AS t, {PICK} AS pick FROM conversations WHERE role = 'user' AND trim({SAID}) <> ''),
r AS (SELECT *, row_number() OVER w AS number, {INTENT.replace('text', 't')} AS label, coalesce(bool_or(pick IS NOT NULL) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS had FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
{sql_running("genres", NAMED)},
{sql_running("decades", f"list_filter([{DECADES}], lambda x: x IS NOT NULL)")},
{sql_running("previously_recommended", "CASE WHEN pick IS NOT NULL AND NOT (label = 'FOLLOW_UP' AND had) THEN [pick] ELSE []::VARCHAR[] END")},
x AS (SELECT *, CASE WHEN label = 'FOLLOW_UP' AND had THEN 'FOLLOW_UP' ELSE 'NEW_PREFERENCE' END AS route FROM r)
SELECT x.conv_id AS session, x.turn, number, route, CASE WHEN route = 'NEW_PREFERENCE' THEN pick ELSE last_value(CASE WHEN route = 'NEW_PREFERENCE' THEN pick END IGNORE NULLS) OVER (PARTITION BY x.conv_id ORDER BY x.turn ROWS UNBOUNDED PRECEDING) END AS movie,
genres, decades, previously_recommended, route = 'NEW_PREFERENCE' AND pick IS NULL AS trouble
FROM x JOIN genres_s USING (conv_id, turn) JOIN decades_s USING (conv_id, turn) JOIN previously_recommended_s USING (conv_id, turn)""")
def session_chat(t: Tables) -> DataFrame:
    """The state after each user message, follow-ups and new preferences; the recommender is a stand-in that sometimes fails."""
    rows = t.conversations.where("role = 'user'").select(F.col("conv_id").alias("session"), "turn", F.expr(SAID).alias("text"), F.expr(PICK).alias("pick"))
    follow = F.rlike(F.lower("text"), F.lit(r"\bwhy\b|tell me more|what is it about|who directed|i watched|i liked"))
    got = C.states(rows, follow, F.col("pick"), F.lit(False))
    listed = [F.array_join(c, ",").alias(c) for c in ("genres", "decades", "previously_recommended")]
    return got.select("session", "turn", F.col("number").cast("long").alias("number"), "route", "movie", *listed, F.col("response").isNotNull().alias("trouble"))
