"""Dialogues, normalisation, mentions and text metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import bleu4, rouge_l
from ..operators import dialogue as D
from ..operators import overlap
from .registry import Tables, query

P = r"[^\p{L}\p{N}_\s]"
LINES = r"""
lines AS (SELECT conv_id, turn, role, t, CASE WHEN role = 'user' THEN 'User' ELSE 'System' END || ': ' || t AS line
          FROM (SELECT *, trim(replace(replace(text, '&quot;', '"'), '&amp;', '&')) AS t FROM conversations) WHERE t <> ''),
dialogues AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS dialogue FROM lines GROUP BY conv_id)
"""
TOKENS = rf"list_filter(string_split_regex(regexp_replace(lower(%s), '{P}', '', 'g'), '\s+'), lambda w: w <> '')"


@query(rf"""SELECT doc_id, trim(lower(regexp_replace(regexp_replace(regexp_replace(text, '\(\d{{4}}\)', '', 'g'), '{P}', '', 'g'), '\s+', ' ', 'g'))) AS title FROM documents""")
def title_normalise_a(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.normalised_title(F.col("text")).alias("title"))


@query(rf"""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' & ' || p_brand || ' (1999)'), '{P}', '', 'g')) AS key FROM part""")
def title_normalise_b(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", T.index_key(F.concat("p_name", F.lit(" & "), "p_brand", F.lit(" (1999)"))).alias("key"))


@query(f"WITH {LINES} SELECT * FROM dialogues")
def dialogue_render(t: Tables) -> DataFrame:
    return D.rendered(t.conversations)


@query(f"WITH {LINES} SELECT conv_id, turn, role, coalesce(string_agg(line, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prefix FROM lines")
def dialogue_prefix(t: Tables) -> DataFrame:
    return D.prefixes(t.conversations)


@query(rf"""WITH {LINES}, l AS (SELECT *, list_filter(string_split(trim(dialogue), chr(10)), lambda x: trim(x) <> '') AS l FROM dialogues)
SELECT conv_id, CASE WHEN len(l) > 5 THEN array_to_string(l[-5:], chr(10)) ELSE dialogue END AS history FROM l""")
def history_truncate(t: Tables) -> DataFrame:
    return D.rendered(t.conversations).select("conv_id", T.last_lines(F.col("dialogue"), 5).alias("history"))


@query(rf"""WITH {LINES}, c AS (SELECT conv_id, dialogue, list_filter(string_split(dialogue, chr(10)), lambda x: starts_with(x, 'User:')) AS u FROM dialogues)
SELECT conv_id, CASE WHEN contains(dialogue, 'User: ') THEN 'User: ' || string_split(dialogue, 'User: ')[-1] ELSE dialogue END AS last_part,
coalesce(nullif(left(trim(substr(u[-1], 6)), 50), ''), 'matches user preference from conversation') AS reason FROM c""")
def last_user_turn(t: Tables) -> DataFrame:
    d = D.rendered(t.conversations)
    users = F.filter(F.split("dialogue", "\n"), lambda x: F.startswith(x, F.lit("User:")))
    said = F.substring(F.trim(F.substring(F.try_element_at(users, F.lit(-1)), 6, 1 << 20)), 1, 50)
    return d.select("conv_id", T.last_user_part(F.col("dialogue")).alias("last_part"), F.coalesce(F.nullif(said, F.lit("")), F.lit("matches user preference from conversation")).alias("reason"))


@query("""SELECT page_id, replace(replace(html, '&quot;', '"'), '&amp;', '&') AS html FROM pages""")
def html_unescape(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.unescaped(F.col("html")).alias("html"))


INJECTED = "text || ' @' || conv_id || ' and @' || (turn * 10 + 1) || '!'"


@query(rf"""SELECT conv_id, turn, array_to_string(regexp_extract_all({INJECTED}, '@(\d+)', 1), ',') AS ids FROM conversations""")
def mention_extract(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.array_join(T.mention_ids(F.expr(INJECTED)), ",").alias("ids"))


@query(rf"""SELECT conv_id, turn, replace(replace({INJECTED}, '@1', 'The Matrix (1999)'), '@11', 'Jaws') AS said FROM conversations""")
def mention_substitute(t: Tables) -> DataFrame:
    """In the map's order: @1 also changes the start of @11."""
    mentions = F.create_map(F.lit("1"), F.lit("The Matrix (1999)"), F.lit("11"), F.lit("Jaws"))
    return t.conversations.select("conv_id", "turn", T.with_mentions(F.expr(INJECTED), mentions).alias("said"))


@query("""SELECT doc_id, lower(trim(text)) AS title FROM labels JOIN documents USING (doc_id) WHERE quality = 1 AND trim(text) <> ''""")
def gold_titles(t: Tables) -> DataFrame:
    """Suggested items with a title: labels stand for suggested flags, whole texts for titles."""
    title = F.lower(F.trim("text"))
    return t.labels.where("quality = 1").select("doc_id").join(t.documents.select("doc_id", title.alias("title")), "doc_id").where("title <> ''")


N_ASSISTANT = rf"w AS (SELECT conv_id, turn, {TOKENS % 'text'} AS w FROM conversations WHERE role = 'assistant')"


@query(f"""WITH {N_ASSISTANT}, g AS (SELECT n, array_to_string(w[i:i + n - 1], ' ') AS g FROM w, (VALUES (2), (3), (4)) k(n), range(1, len(w) - n + 2) r(i) WHERE len(w) >= n)
SELECT k.n, count(DISTINCT g) AS n_unique, count(g) AS n_total, round(coalesce(count(DISTINCT g) / nullif(count(g), 0)::DOUBLE, 0.0::DOUBLE), 6) AS distinct_n FROM (VALUES (2), (3), (4)) k(n) LEFT JOIN g ON g.n = k.n GROUP BY k.n""")
def distinct_n(t: Tables) -> DataFrame:
    words = t.conversations.where("role = 'assistant'").select(T.tokens(F.col("text")).alias("w"))
    grams = words.select(F.explode(F.array(*[F.struct(F.lit(n).alias("n"), T.ngrams(F.col("w"), n).alias("g")) for n in (2, 3, 4)])).alias("s")).select("s.n", F.explode("s.g").alias("g"))
    per = grams.groupBy("n", "g").agg(F.count("*").alias("c")).groupBy("n").agg(F.count("*").alias("n_unique"), F.sum("c").alias("n_total"))
    every = t.spark.createDataFrame([(2,), (3,), (4,)], "n int")
    return every.join(per, "n", "left").fillna(0).withColumn("distinct_n", F.round(F.coalesce(F.col("n_unique") / F.nullif("n_total", F.lit(0)), F.lit(0.0)), 6))


@query(f"WITH {N_ASSISTANT} SELECT count(*) AS responses, round(avg(len(w)), 6) AS mean_length FROM w")
def response_length(t: Tables) -> DataFrame:
    words = t.conversations.where("role = 'assistant'").select(F.size(T.tokens(F.col("text"))).alias("n"))
    return words.agg(F.count("*").alias("responses"), F.round(F.avg("n"), 6).alias("mean_length"))


def adjacent(t: Tables) -> DataFrame:
    """conv_id, turn, ref, hyp: the words of each message and of the one before it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    words = t.conversations.select("conv_id", "turn", T.tokens(F.col("text")).alias("hyp"))
    return words.withColumn("ref", F.lag("hyp").over(w)).where("ref IS NOT NULL")


@query(f"""WITH w AS (SELECT conv_id, turn, {TOKENS % 'text'} AS w FROM conversations),
p AS (SELECT conv_id, turn, w AS hyp, lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS ref FROM w QUALIFY ref IS NOT NULL),
g AS (SELECT conv_id, turn, n, side, array_to_string(l[i:i + n - 1], ' ') AS g FROM (SELECT conv_id, turn, unnest(['h', 'r']) AS side, unnest([hyp, ref]) AS l FROM p), (VALUES (1), (2)) k(n), range(1, len(l) - n + 2) r(i) WHERE len(l) >= n),
c AS (SELECT conv_id, turn, n, g, count(*) FILTER (side = 'h') AS h, count(*) FILTER (side = 'r') AS r FROM g GROUP BY ALL),
m AS (SELECT conv_id, turn, n, sum(least(h, r)) AS hit, sum(h) + sum(r) AS size FROM c GROUP BY ALL)
SELECT p.conv_id, p.turn, round(coalesce(max(2.0::DOUBLE * hit / size) FILTER (n = 1), 0.0::DOUBLE), 6) AS rouge_1, round(coalesce(max(2.0::DOUBLE * hit / size) FILTER (n = 2), 0.0::DOUBLE), 6) AS rouge_2
FROM p LEFT JOIN m USING (conv_id, turn) GROUP BY p.conv_id, p.turn""")
def rouge_n(t: Tables) -> DataFrame:
    """F-measures of the words and pairs of words that two neighbouring messages share, each as often as in the one that has
    it less often."""
    found = overlap.rouge(adjacent(t), ["conv_id", "turn"])
    return found.select("conv_id", "turn", *[F.round(f"rouge_{n}", 6).alias(f"rouge_{n}") for n in (1, 2)])


@query()
def rouge_l_score(t: Tables) -> DataFrame:
    return adjacent(t).select("conv_id", "turn", F.round(rouge_l("ref", "hyp"), 6).alias("rouge_l"))


@query()
def bleu_score(t: Tables) -> DataFrame:
    return adjacent(t).select("conv_id", "turn", F.round(bleu4("ref", "hyp"), 6).alias("bleu"))


@query(rf"""WITH n AS (SELECT conv_id, unnest({TOKENS % 'text'}) AS w FROM conversations) SELECT w AS word, count(*) AS n FROM n GROUP BY w ORDER BY n DESC, word LIMIT 30""")
def seed_frequency(t: Tables) -> DataFrame:
    words = t.conversations.select(F.explode(T.tokens(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(30)
