"""Re-ranking prompts, stand-in answers, responses, list answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..operators import dialogue as D
from .registry import Tables, query
from .texts import LINES

FIELDS = "p_name AS title, CASE WHEN p_size % 3 > 0 THEN CAST(1950 + p_size AS STRING) END AS year, CASE WHEN p_size % 4 > 0 THEN p_type ELSE 'Unknown' END AS genre, CASE WHEN p_size % 5 > 0 THEN CAST(1950 + p_size // 10 * 10 AS STRING) || 's' ELSE 'Unknown' END AS decade, CASE WHEN p_size % 2 > 0 THEN p_brand END AS director"
HEAD = "CASE WHEN year IS NOT NULL THEN title || ' (' || year || ')' ELSE title END"


def candidates(t: Tables) -> DataFrame:
    """Lists of ten neighbouring parts as candidates: every part is in one, and their number grows with the table."""
    fields = t.part.selectExpr("p_partkey", "p_partkey div 10 AS list_id", *FIELDS.replace("//", "div").split(", "))
    return fields.withColumn("rank", F.row_number().over(Window.partitionBy("list_id").orderBy("p_partkey")))


LISTS = f"cand AS (SELECT p_partkey, p_partkey // 10 AS list_id, {FIELDS}, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY p_partkey) AS rank FROM part)"
SHOW = "CASE WHEN {0} NOT IN ('', 'Unknown') THEN {0} END"
BLOCK = f"blocks AS (SELECT list_id, string_agg(rank || '. ' || concat_ws(' | ', {HEAD}, {SHOW.format('genre')}, {SHOW.format('decade')}, {SHOW.format('director')}), chr(10) ORDER BY rank) AS block FROM cand GROUP BY list_id)"


def blocks(t: Tables, shape: int) -> DataFrame:
    line = T.candidate_line(F.col("rank"), *(F.col(c) for c in ("title", "year", "genre", "decade", "director")), shape)
    rows = candidates(t).select("list_id", "rank", line.alias("line")).groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    return rows.select("list_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("block"))


@query(f"""WITH {LISTS} SELECT p_partkey, rank || '. ' || title AS line_1, rank || '. ' || {HEAD} AS line_2, rank || '. ' || concat_ws(' | ', {HEAD}, {SHOW.format('genre')}, {SHOW.format('decade')}) AS line_3,
rank || '. ' || concat_ws(' | ', {HEAD}, {SHOW.format('genre')}, {SHOW.format('decade')}, {SHOW.format('director')}) AS line_4,
CASE WHEN decade <> 'Unknown' THEN chr(10) || 'Detected user era preference: ' || decade || '. Strongly prefer candidates from this era.' || chr(10) ELSE '' END AS era FROM cand""")
def candidate_serialise(t: Tables) -> DataFrame:
    cols = [F.col(c) for c in ("title", "year", "genre", "decade", "director")]
    eras = F.when(F.col("decade") != "Unknown", F.array("decade")).otherwise(F.array().cast("array<string>"))
    return candidates(t).select("p_partkey", *[T.candidate_line(F.col("rank"), *cols, shape).alias(f"line_{shape}") for shape in (1, 2, 3, 4)], T.era_section(eras).alias("era"))


ANSWER = " ".join(f"WHEN regexp_matches(lower(p), '{'|'.join(w)}') THEN {n}" for w, n in vocab.STUB_RULES)
ASKED = "CASE conv_id % 4 WHEN 0 THEN ' Something funny.' WHEN 1 THEN ' An OLD one.' WHEN 2 THEN ' marvel' ELSE '' END"


@query(f"""WITH {LISTS}, {BLOCK}, {LINES}, h AS (SELECT conv_id, list_filter(string_split(trim(dialogue), chr(10)), lambda x: trim(x) <> '') AS l, dialogue FROM dialogues),
n AS (SELECT max(list_id) + 1 AS n FROM cand),
q AS (SELECT conv_id, list_id, '[Dialogue History]' || chr(10) || CASE WHEN len(l) > 5 THEN array_to_string(l[-5:], chr(10)) ELSE dialogue END || {ASKED} || chr(10) || '[Candidate List]' || chr(10) || block AS p FROM h, n JOIN blocks ON blocks.list_id = conv_id % n),
a AS (SELECT conv_id, list_id, CASE {ANSWER} ELSE 1 END + conv_id % 5 AS n FROM q), s AS (SELECT list_id, max(rank) AS size FROM cand GROUP BY list_id)
SELECT conv_id, n::BIGINT AS answer, n > size AS is_fallback, title AS selected FROM a JOIN s USING (list_id) JOIN cand c ON c.list_id = a.list_id AND c.rank = CASE WHEN n > size THEN 1 ELSE n END""")
def rerank_stub(t: Tables) -> DataFrame:
    """Prompt, answer of the stand-in (moved on by conv_id % 5, so that some answers are out of range), choice. Dialogues are
    dealt to all lists in turn."""
    lists = candidates(t).select("list_id", "rank", "title")
    sizes = lists.groupBy("list_id").agg(F.max("rank").alias("size"))
    dealt = D.rendered(t.conversations).crossJoin(F.broadcast(t.part.agg(F.expr("max(p_partkey) div 10 + 1").alias("n"))))
    asked = dealt.select("conv_id", (F.col("conv_id") % F.col("n")).alias("list_id"), F.concat(T.last_lines(F.col("dialogue"), 5), F.expr(ASKED)).alias("h"))
    prompt = F.concat(F.lit("[Dialogue History]\n"), "h", F.lit("\n[Candidate List]\n"), "block")
    answered = asked.join(blocks(t, 4), "list_id").select("conv_id", "list_id", (T.parsed_answer(T.stub_answer(prompt)) + F.col("conv_id") % 5).alias("n"))
    judged = answered.join(sizes, "list_id").withColumn("is_fallback", ~F.coalesce(F.col("n").between(1, F.col("size")), F.lit(False)))
    picked = judged.withColumn("rank", F.when(F.col("is_fallback"), F.lit(1)).otherwise(F.col("n")))
    return picked.join(lists, ["list_id", "rank"]).select("conv_id", F.col("n").cast("long").alias("answer"), "is_fallback", F.col("title").alias("selected"))


ABOUT = f"concat_ws(' ', lower({SHOW.format('genre')}), 'from the ' || {SHOW.format('decade')})"


@query(f"""WITH {LISTS} SELECT p_partkey, CASE WHEN {ABOUT} <> '' THEN 'I would recommend ' || title || '. It is a great film ' || {ABOUT} || ' that matches what you are looking for.' ELSE 'I would recommend ' || title || '. I think it fits well with what you described.' END AS response FROM cand""")
def response_template(t: Tables) -> DataFrame:
    return candidates(t).select("p_partkey", T.recommendation_sentence(F.col("title"), F.col("genre"), F.col("decade")).alias("response"))


ANSWERS = "'1. \"' || left(text, 5) || '\"' || chr(10) || '2) Jaws' || chr(10) || chr(10) || '  3 - ' || role || chr(10) || turn || chr(10) || '5.' || chr(10) || '''Alien''' || chr(10) || 'a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || 'd' || chr(10) || 'e' || chr(10) || 'f'"
PARSED = rf"list_filter(list_transform(list_transform(string_split(trim({ANSWERS}), chr(10)), lambda x: trim(regexp_replace(trim(x), '^\d+[.)\-*]*\s*', ''))), lambda x: regexp_replace(x, '^[\"'']|[\"'']$', '', 'g')), lambda x: x <> '')[1:10]"


def parsed(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.parsed_list(F.expr(ANSWERS.replace("chr(10)", "'\\n'").replace("'''Alien'''", "'\\'Alien\\''"))).alias("l"))


@query(f"SELECT conv_id, turn, array_to_string({PARSED}, '|') AS titles FROM conversations")
def zeroshot_parse(t: Tables) -> DataFrame:
    return parsed(t).select("conv_id", "turn", F.array_join("l", "|").alias("titles"))


@query(f"""WITH p AS (SELECT conv_id, turn, {PARSED} AS l FROM conversations), e AS (SELECT conv_id, turn, role, list_position(list_transform(CASE WHEN len(l) > 0 THEN l ELSE ['Unknown'] END, lambda x: lower(x)), CASE WHEN conv_id % 2 = 0 THEN 'alien' WHEN conv_id % 3 = 0 THEN 'jaws' ELSE 'nothing' END) AS r FROM p JOIN conversations USING (conv_id, turn))
SELECT role, count(*) AS instances, round(avg((r = 1)::INT), 6) AS hit_1, round(avg((r <= 10)::INT), 6) AS hit_10, round(avg(coalesce(1.0::DOUBLE / nullif(r, 0), 0.0::DOUBLE)), 6) AS mrr FROM (SELECT role, coalesce(r, 0) AS r0, nullif(coalesce(r, 0), 0) AS r FROM e) GROUP BY role""".replace("avg((r = 1)::INT)", "avg(coalesce(r = 1, false)::INT)").replace("avg((r <= 10)::INT)", "avg(coalesce(r <= 10, false)::INT)"))
def zeroshot_eval(t: Tables) -> DataFrame:
    gold = F.when(F.col("conv_id") % 2 == 0, "alien").when(F.col("conv_id") % 3 == 0, "jaws").otherwise("nothing")
    shown = F.when(F.size("l") > 0, F.col("l")).otherwise(F.array_repeat(F.lit("Unknown"), 10))
    each = parsed(t).withColumn("r", F.array_position(F.transform(shown, F.lower), gold)).join(t.conversations.select("conv_id", "turn", "role"), ["conv_id", "turn"])
    hit = lambda k: F.round(F.avg(F.col("r").between(1, k).cast("int")), 6).alias(f"hit_{k}")
    return each.groupBy("role").agg(F.count("*").alias("instances"), hit(1), hit(10), F.round(F.avg(F.when(F.col("r") > 0, 1 / F.col("r")).otherwise(F.lit(0.0))), 6).alias("mrr"))


FALLBACK = ", ".join(f"({i + 1}, {row[0]}, '{row[1]}')" for i, row in enumerate(vocab.FALLBACK_LIST))


@query(f"""WITH n AS (SELECT conv_id, count(*) AS seeds FROM conversations WHERE role = 'user' GROUP BY conv_id), l AS (SELECT conv_id, seeds, CASE WHEN seeds < 4 THEN string_split('The Matrix (1999)' || chr(10) || chr(10) || 'Jaws' || chr(10) || 'Shrek (2001)' || chr(10) || 'Alien', chr(10)) ELSE [] END AS t FROM n),
s AS (SELECT conv_id, seeds, unnest(list_filter(t, lambda x: trim(x) <> '')[1:3]) AS title FROM l)
SELECT s.conv_id, s.seeds, s.title, f.id FROM s JOIN (VALUES {FALLBACK}) f(rank, id, title) ON s.title = f.title""")
def weak_seed_fallback(t: Tables) -> DataFrame:
    """A conversation with less than four seeds (here: user messages) asks the stand-in for titles: the first three lines
    that aren't blank, linked to a catalogue."""
    seeds = t.conversations.where("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("seeds")).where("seeds < 4")
    answer = F.lit("The Matrix (1999)\n\nJaws\nShrek (2001)\nAlien")
    titles = seeds.select("conv_id", "seeds", F.explode(F.slice(F.filter(F.split(answer, "\n"), lambda x: F.trim(x) != ""), 1, 3)).alias("title"))
    catalogue = t.spark.createDataFrame([(r[0], r[1]) for r in vocab.FALLBACK_LIST], "id int, title string")
    return titles.join(F.broadcast(catalogue), "title").select("conv_id", "seeds", "title", "id")


@query(f"""WITH {LISTS}, s AS (SELECT list_id, CASE WHEN list_id % 3 = 0 THEN upper(max(title) FILTER (rank = 3)) WHEN list_id % 3 = 1 THEN max(title) FILTER (rank = 8) ELSE 'No such title' END AS selected FROM cand GROUP BY list_id)
SELECT s.list_id, selected, min(rank) AS rank, min(rank) IS NOT NULL AS in_top5 FROM s LEFT JOIN cand c ON c.list_id = s.list_id AND c.rank <= 5 AND lower(c.title) = lower(selected) GROUP BY ALL""")
def selected_rank_top5(t: Tables) -> DataFrame:
    c = candidates(t).select("list_id", "rank", "title")
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("title")))
    s = c.groupBy("list_id").agg(F.when(F.col("list_id") % 3 == 0, F.upper(at(3))).when(F.col("list_id") % 3 == 1, at(8)).otherwise(F.lit("No such title")).alias("selected"))
    hits = c.where("rank <= 5").select(F.col("list_id").alias("l"), F.col("rank").alias("r"), F.lower("title").alias("low"))
    joined = s.join(hits, (F.col("l") == F.col("list_id")) & (F.col("low") == F.lower("selected")), "left")
    return joined.groupBy("list_id", "selected").agg(F.min("r").cast("long").alias("rank")).withColumn("in_top5", F.col("rank").isNotNull())


MENTIONED = "text || CASE WHEN conv_id % 3 = 0 THEN ' see @' || turn ELSE '' END"


@query(f"""WITH {LINES}, x AS (SELECT conv_id, turn, {MENTIONED} AS t FROM conversations WHERE role = 'assistant'), f AS (SELECT conv_id, min(turn) AS turn FROM x WHERE contains(t, '@') GROUP BY conv_id ORDER BY conv_id LIMIT 2)
SELECT conv_id, turn, coalesce((SELECT string_agg(line, chr(10) ORDER BY l.turn) FROM lines l WHERE l.conv_id = f.conv_id AND l.turn < f.turn), '') AS history FROM f""")
def first_mention_history(t: Tables) -> DataFrame:
    """A report of two conversations: all that was said before the first message of the system that mentions a title."""
    said = t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.expr(MENTIONED).alias("t")).where("contains(t, '@')")
    first = said.groupBy("conv_id").agg(F.min("turn").alias("turn")).orderBy("conv_id").limit(2)
    return first.join(D.prefixes(t.conversations), ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("prefix", F.lit("")).alias("history"))


LIST_RULES = "You are a movie recommender. Name ten movies that fit the dialogue, as a numbered list of titles only.\n\nDialogue History:\n"


@query(f"WITH {LINES} SELECT conv_id, '" + LIST_RULES.replace("\n", "' || chr(10) || '") + "' || dialogue || chr(10) || chr(10) || 'Recommendations:' || chr(10) AS prompt FROM dialogues")
def zeroshot_prompt(t: Tables) -> DataFrame:
    return D.rendered(t.conversations).select("conv_id", F.concat(F.lit(LIST_RULES), "dialogue", F.lit("\n\nRecommendations:\n")).alias("prompt"))


@query(f"""WITH {LISTS} SELECT p_partkey, 'Selected: ' || title || ' | genres: ' || coalesce(genre, 'unknown') || ' | decade: ' || coalesce(decade, 'unknown') AS selected,
coalesce(nullif(trim(CASE WHEN p_partkey % 2 = 0 THEN '  ' ELSE ' ' || title || ' it is. ' END), ''), 'Regarding **' || title || '**: ask anything else about it, or for another one.') AS follow_up FROM cand""")
def follow_up_text(t: Tables) -> DataFrame:
    """A model's answer (here every second one is blank), or a fixed sentence about the last title."""
    answer = F.when(F.col("p_partkey") % 2 == 0, "  ").otherwise(F.concat(F.lit(" "), "title", F.lit(" it is. ")))
    fixed = F.concat(F.lit("Regarding **"), "title", F.lit("**: ask anything else about it, or for another one."))
    selected = F.concat(F.lit("Selected: "), "title", F.lit(" | genres: "), F.coalesce("genre", F.lit("unknown")), F.lit(" | decade: "), F.coalesce("decade", F.lit("unknown")))
    return candidates(t).select("p_partkey", selected.alias("selected"), F.coalesce(F.nullif(F.trim(answer), F.lit("")), fixed).alias("follow_up"))


@query("""WITH r AS (SELECT conv_id, turn, role, left(text, 200) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'System: ' END || said, chr(10) ORDER BY turn) AS recent FROM r WHERE n <= 4 GROUP BY conv_id""")
def recent_turns(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    last = t.conversations.withColumn("n", F.row_number().over(w)).where("n <= 4")
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("System: "), F.substring("text", 1, 200))
    rows = last.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("s"))
    return rows.select("conv_id", F.array_join(F.transform("s", lambda x: x["l"]), "\n").alias("recent"))


@query(f"""WITH {LISTS} SELECT list_id, array_to_string(list(title ORDER BY rank) FILTER (rank <= 5), '|') AS top_5, count(*) FILTER (rank <= 5) AS n FROM cand GROUP BY list_id""")
def recommendation_payload(t: Tables) -> DataFrame:
    top = candidates(t).where("rank <= 5").groupBy("list_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("s"))
    return top.select("list_id", F.array_join(F.transform("s", lambda x: x["title"]), "|").alias("top_5"), F.size("s").cast("long").alias("n"))
