"""Phrases and their links; years, decades and genres; metadata. Titles are the first two words of documents, resources
the third and fourth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..operators import dialogue as D
from ..operators import linking as L
from ..operators import recommend as P_
from .registry import Tables, query
from .texts import LINES, TOKENS, P

BLOCKED = ", ".join(f"'{w}'" for w in vocab.PHRASE_BLOCKLIST)
NAMES = r"names AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS w FROM documents)"
INDEX = rf"""{NAMES}, idx AS (SELECT key, max(doc_id) AS entity_id FROM (SELECT doc_id, trim(regexp_replace(lower(w[1] || ' ' || w[2]), '{P}', '', 'g')) AS key FROM names WHERE len(w) >= 2) WHERE key <> '' GROUP BY key),
res AS (SELECT uri, max(doc_id) AS entity_id FROM (SELECT doc_id, '<http://dbpedia.org/resource/' || upper(left(a, 1)) || lower(substr(a, 2)) || '_' || upper(left(b, 1)) || lower(substr(b, 2)) || '>' AS uri FROM
  (SELECT doc_id, regexp_replace(lower(w[3]), '{P}', '', 'g') AS a, regexp_replace(lower(w[4]), '{P}', '', 'g') AS b FROM names WHERE len(w) >= 4)) GROUP BY uri)"""
PHRASES = rf"""{LINES}, tok AS (SELECT conv_id, {TOKENS % 'dialogue'} AS w FROM dialogues),
grams AS (SELECT conv_id, 3 - n AS block, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM tok, (VALUES (1), (2), (3)) k(n), range(1, len(w) - n + 2) r(i) WHERE len(w) >= n),
firsts AS (SELECT conv_id, phrase, min((block, i)) AS f FROM grams GROUP BY conv_id, phrase),
phrases AS (SELECT conv_id, phrase, row_number() OVER (PARTITION BY conv_id ORDER BY length(phrase) DESC, f) - 1 AS pos FROM firsts)"""


def names(t: Tables, first: int):
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return t.documents.select(F.col("doc_id").alias("entity_id"), F.slice(words, first, 2).alias("w")).where("size(w) = 2")


def index(t: Tables) -> DataFrame:
    return L.title_index(names(t, 1).select("entity_id", F.array_join("w", " ").alias("title")))


def resources(t: Tables) -> DataFrame:
    bare = F.transform("w", lambda x: F.regexp_replace(F.lower(x), T.PUNCTUATION, ""))
    named = names(t, 3).select("entity_id", F.transform(bare, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1 << 20)))).alias("w"))
    return named.groupBy(F.concat(F.lit("<http://dbpedia.org/resource/"), F.array_join("w", "_"), F.lit(">")).alias("uri")).agg(F.max("entity_id").alias("entity_id"))


@query(f"WITH {PHRASES} SELECT conv_id, phrase, pos, length(phrase) AS n_chars FROM phrases WHERE phrase NOT IN ({BLOCKED})")
def ngram_candidates(t: Tables) -> DataFrame:
    return L.phrases(D.rendered(t.conversations)).select("conv_id", "phrase", F.col("pos").cast("long").alias("pos"), F.length("phrase").cast("long").alias("n_chars"))


@query(f"WITH {PHRASES}, {INDEX} SELECT conv_id, phrase, entity_id FROM phrases JOIN idx ON phrase = key WHERE phrase NOT IN ({BLOCKED})")
def exact_entity_link(t: Tables) -> DataFrame:
    return L.exact(L.phrases(D.rendered(t.conversations)), index(t)).select("conv_id", "phrase", "entity_id")


CAP = "array_to_string(list_transform(string_split(phrase, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), '_')"


@query(f"""WITH {PHRASES}, {INDEX} SELECT conv_id, phrase, coalesce(idx.entity_id, res.entity_id) AS entity_id, CASE WHEN idx.entity_id IS NOT NULL THEN 'title' WHEN res.entity_id IS NOT NULL THEN 'resource' ELSE 'none' END AS stage
FROM phrases LEFT JOIN idx ON phrase = key LEFT JOIN res ON uri = '<http://dbpedia.org/resource/' || {CAP} || '>' WHERE phrase NOT IN ({BLOCKED})""")
def cascade_entity_link(t: Tables) -> DataFrame:
    return L.cascade(L.phrases(D.rendered(t.conversations)), index(t), resources(t)).drop("pos")


def unmatched(t: Tables) -> DataFrame:
    return L.cascade(L.phrases(D.rendered(t.conversations)), index(t), resources(t)).where("stage = 'none'").select("conv_id", "phrase", "pos")


@query()
def fuzzy_entity_link(t: Tables) -> DataFrame:
    return L.fuzzy(unmatched(t), index(t), 0.92)


@query()
def link_dialogue(t: Tables) -> DataFrame:
    """The seeds of each conversation by the whole chain: titles, resources, similar titles, genres."""
    seeds, _ = L.linked(D.rendered(t.conversations), index(t), resources(t))
    return seeds.select("conv_id", "entity_id", "stage", "phrase")


@query()
def retrieve_fuse(t: Tables) -> DataFrame:
    """Candidates of each conversation: a scorer's list (here: every entity that is near in number), seeds, and what the
    stand-in names."""
    dialogues = D.rendered(t.conversations)
    seeds, _ = L.linked(dialogues, index(t), resources(t))
    catalogue = resources(t).select("entity_id", "uri")
    near = dialogues.select("conv_id", F.explode(F.sequence(F.col("conv_id") + 1, F.col("conv_id") + 220)).alias("entity_id")).withColumn("score", 1 / (F.col("entity_id") - F.col("conv_id")))
    return P_.retrieve(dialogues, seeds, near, index(t), catalogue, catalogue.where("entity_id % 2 = 0"), None)


@query()
def person_fuzzy_link(t: Tables) -> DataFrame:
    """Customer names with a letter left out, linked to customers."""
    misspelt = F.concat(F.substring("c_name", 1, 3), F.substring("c_name", 5, 1 << 20))
    return L.persons(t.customer.select(misspelt.alias("name")), t.customer.select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("label")))


STOPS, NEAR = (", ".join(f"'{w}'" for w in ws) for ws in (vocab.STOP_WORDS, vocab.STRONG_CONTEXT))


@query(rf"""WITH {LINES}, w AS (SELECT conv_id, list_filter(string_split_regex(dialogue, '\s+'), lambda x: x <> '') AS w FROM dialogues),
r AS (SELECT conv_id, i, w[i] AS raw, CASE WHEN i > 1 THEN w[i - 1] END AS prev, w[i + 1] AS nxt FROM w, range(1, len(w) + 1) k(i)),
b AS (SELECT *, regexp_replace(lower(raw), '{P}', '', 'g') AS phrase, regexp_replace(lower(prev), '{P}', '', 'g') AS p, regexp_replace(lower(nxt), '{P}', '', 'g') AS n FROM r)
SELECT conv_id, phrase, bool_or((regexp_matches(raw, '^[A-Z][a-z]+') AND prev IS NOT NULL AND NOT regexp_matches(coalesce(prev, ''), '[.,!?:;]$')) OR coalesce(p IN ({NEAR}), false) OR coalesce(n IN ({NEAR}), false) OR phrase NOT IN ({STOPS})) AS accepted
FROM b WHERE phrase <> '' GROUP BY ALL""")
def one_word_filter(t: Tables) -> DataFrame:
    words = F.filter(F.split("dialogue", r"\s+"), lambda x: x != "")
    return L.one_word_seeds(D.rendered(t.conversations).select("conv_id", F.posexplode(words).alias("pos", "raw")))


def sql_matches(rules, c: str) -> str:
    listed = ", ".join(f"CASE WHEN regexp_matches({c}, '{p}') THEN '{d}' END" for p, d in rules)
    return f"list_filter([{listed}], lambda x: x IS NOT NULL)"


ERA = "CASE WHEN conv_id % 3 = 0 THEN dialogue || chr(10) || 'User: a ' || (1950 + conv_id % 60) || ' film, or the 80s' || chr(10) || 'System: from the nineties?' WHEN conv_id % 3 = 1 THEN 'User: seventies stuff' || chr(10) || dialogue ELSE dialogue END"
LAST = "CASE WHEN contains(d, 'User: ') THEN 'User: ' || string_split(d, 'User: ')[-1] ELSE d END"


@query(f"""WITH {LINES}, d AS (SELECT conv_id, {ERA} AS d FROM dialogues), m AS (SELECT conv_id, {sql_matches(vocab.DIALOGUE_DECADES, f"lower({LAST})")} AS l, {sql_matches(vocab.DIALOGUE_DECADES, "lower(d)")} AS a, {sql_matches(vocab.PROFILE_DECADES, "lower(d)")} AS u FROM d)
SELECT conv_id, array_to_string(CASE WHEN len(l) > 0 THEN l ELSE a END, ',') AS decades, array_to_string(u, ',') AS message_decades FROM m""")
def decade_detect(t: Tables) -> DataFrame:
    d = D.rendered(t.conversations).select("conv_id", F.expr(ERA.replace("chr(10)", "'\\n'")).alias("d"))
    return d.select("conv_id", F.array_join(T.dialogue_decades(F.col("d")), ",").alias("decades"), F.array_join(T.message_decades(F.col("d")), ",").alias("message_decades"))


GENRE_TEXT = "text || CASE WHEN turn % 3 = 0 THEN ' a scary war film, sci fi or romantic comedy' WHEN turn % 3 = 1 THEN ' Horror! and family drama' ELSE '' END"


@query(rf"""WITH x AS (SELECT conv_id, turn, lower({GENRE_TEXT}) AS t FROM conversations), k AS (SELECT unnest([{", ".join(f"'{k}'" for k in vocab.PROFILE_GENRES)}]) AS w, unnest([{", ".join(f"'{v}'" for v in vocab.PROFILE_GENRES.values())}]) AS g),
s AS (SELECT conv_id, turn, 0 AS i, 'Sci-Fi' AS g FROM x WHERE contains(t, 'science fiction') OR contains(t, 'sci fi') OR contains(t, 'sci-fi')
      UNION ALL SELECT conv_id, turn, i, k.g FROM (SELECT conv_id, turn, w, i FROM (SELECT conv_id, turn, regexp_extract_all(t, '[\p{{L}}\p{{N}}_''-]+') AS l FROM x), LATERAL (SELECT unnest(l) AS w, generate_subscripts(l, 1) AS i)) y JOIN k USING (w)),
f AS (SELECT conv_id, turn, g, min(i) AS i FROM s GROUP BY ALL)
SELECT x.conv_id, x.turn, coalesce(string_agg(g, ',' ORDER BY i), '') AS genres FROM x LEFT JOIN f USING (conv_id, turn) GROUP BY ALL""")
def genre_detect(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.array_join(T.message_genres(F.expr(GENRE_TEXT)), ",").alias("genres"))


@query(rf"""WITH x AS (SELECT conv_id, turn, role, trim(replace(replace({GENRE_TEXT}, '&quot;', '"'), '&amp;', '&')) AS t FROM conversations),
dialogues AS (SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'System' END || ': ' || t, chr(10) ORDER BY turn) AS d FROM x WHERE t <> '' GROUP BY conv_id),
k AS (SELECT unnest([{", ".join(f"'{k}'" for k in vocab.GENRE_RESOURCES)}]) AS g, unnest([{", ".join(f"'{v.replace(chr(39), chr(39) * 2)}'" for v in vocab.GENRE_RESOURCES.values())}]) AS uri),
l AS (SELECT DISTINCT conv_id, g, uri FROM (SELECT conv_id, unnest({TOKENS % LAST}) AS g FROM dialogues) JOIN k USING (g)),
a AS (SELECT DISTINCT conv_id, g, uri FROM (SELECT conv_id, unnest({TOKENS % 'd'}) AS g FROM dialogues) JOIN k USING (g))
SELECT conv_id, uri, 1 + 15 * count(*) AS seeds FROM l GROUP BY ALL UNION ALL SELECT DISTINCT conv_id, uri, 1 FROM a WHERE NOT EXISTS (FROM l WHERE l.conv_id = a.conv_id)""")
def genre_boost(t: Tables) -> DataFrame:
    """Genres of the last user turn, else of the whole dialogue, are seeds; those of the last turn fifteen times again."""
    return L.genre_seeds(D.rendered(t.conversations.withColumn("text", F.expr(GENRE_TEXT)))).select("conv_id", "uri", F.col("seeds").cast("long").alias("seeds"))


@query()
def movie_mention_extract(t: Tables) -> DataFrame:
    said = F.concat("text", F.lit(' I loved "the big short" and watched Blade Runner, or saw The Lord of Rings.'))
    return t.conversations.select("conv_id", "turn", F.array_join(T.mentioned_titles(said), "|").alias("titles"))


URI = "'<http://dbpedia.org/resource/' || replace(p_name, ' ', '_') || CASE p_partkey % 7 WHEN 0 THEN '_(' || (1870 + p_size * 3) || '_film)' WHEN 1 THEN '_(' || (1890 + p_size) || ')' WHEN 2 THEN '_' || (1950 + p_size) || '_part' WHEN 3 THEN '_(novel)' WHEN 4 THEN '_(film)' WHEN 5 THEN '_(film_series)' ELSE '' END || '>'"
YEAR = r"(18[8-9]\d|19\d{2}|20[0-2]\d|2030)"


@query(rf"""WITH u AS (SELECT p_partkey, {URI} AS uri FROM part),
y AS (SELECT *, CASE WHEN contains(lower(uri), 'novel') OR contains(lower(uri), 'book') OR contains(lower(uri), 'character') THEN ''
  WHEN contains(lower(uri), '_film') THEN regexp_extract(uri, '(?i)\({YEAR}_film\)', 1) ELSE coalesce(nullif(regexp_extract(uri, '\({YEAR}\)', 1), ''), regexp_extract(uri, '_{YEAR}_', 1)) END AS y0,
  trim(regexp_replace(regexp_replace(replace(regexp_extract(uri, 'resource/(.+)>', 1), '_', ' '), '(?i)\s*\(film\)', '', 'g'), '(?i)\s*\(\d{{4}} film\)', '', 'g')) AS title FROM u),
z AS (SELECT *, CASE WHEN y0 >= '1900' THEN y0 ELSE '' END AS year FROM y)
SELECT p_partkey, title, year, CASE WHEN year = '' THEN 'Unknown' ELSE left(year, 3) || '0s' END AS decade, coalesce(nullif(regexp_extract(uri, '_\((\d{{4}})_film\)', 1), ''), nullif(regexp_extract(uri, '_\((\d{{4}})\)', 1), '')) AS tagged_year,
NOT (starts_with(lower(title), 'list of ') OR starts_with(lower(title), 'category: ') OR lower(title) IN ('carriers', 'films', 'movies', 'cinema') OR contains(lower(title), '(film series)') OR contains(lower(title), '(tv series)') OR contains(lower(title), '(franchise)'))
  AND length(title) >= 2 AND NOT regexp_matches(title, '^\d+$') AS valid FROM z""")
def year_decade_from_uri(t: Tables) -> DataFrame:
    u = t.part.select("p_partkey", F.expr(URI).alias("uri"))
    year, title = T.release_year(F.col("uri")), T.title_of_resource(F.col("uri"))
    return u.select("p_partkey", title.alias("title"), year.alias("year"), T.decade_of(year).alias("decade"), T.tagged_year(F.col("uri")).alias("tagged_year"), T.is_candidate(title).alias("valid"))


TITLES = "CASE p_partkey % 6 WHEN 0 THEN 'Toy Story (1995)' WHEN 1 THEN p_name || ' ghost' WHEN 2 THEN p_name || ' Lovers in space' ELSE p_name END"
KNOWN = ", ".join(f"('{k}', '{v}')" for k, v in vocab.TITLE_GENRES.items())
KEYED = " ".join(f"WHEN regexp_matches(c, '{'|'.join(w)}') THEN '{g}'" for g, w in vocab.GENRE_KEYWORDS.items())


@query(rf"""WITH x AS (SELECT p_partkey, {TITLES} AS title, p_type AS uri FROM part), y AS (SELECT *, trim(regexp_replace(lower(title), '\s*\(\d{{4}}\)', '', 'g')) AS bare, lower(uri || ' ' || title) AS c FROM x)
SELECT p_partkey, coalesce(k.g, CASE {KEYED} ELSE 'Unknown' END) AS genre FROM y LEFT JOIN (VALUES {KNOWN}) k(t, g) ON k.t = bare""")
def genre_infer(t: Tables) -> DataFrame:
    x = t.part.select("p_partkey", F.expr(TITLES).alias("title"), F.col("p_type").alias("uri"))
    return x.select("p_partkey", T.inferred_genre(F.col("uri"), F.col("title")).alias("genre"))


IDS = ", ".join(f"({k}, '{v}')" for k, v in vocab.METADATA_GENRES.items())
DIM = "SELECT p_partkey AS pos, p_name AS m_title, p_size * 3 AS votes, split_part(lower(p_name), ' ', 1) AS key, CAST(1920 + p_size * 2 AS STRING) || '-05-01' AS released, round(p_retailprice, 1) AS rating FROM part"
ASK = "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 1) || ' zzz' END AS title, split_part(lower(p_name), ' ', 1) AS key FROM part"
TIER = "CASE WHEN lower(m_title) = lower(title) THEN 1 WHEN contains(lower(m_title), lower(title)) OR contains(lower(title), lower(m_title)) THEN 2 ELSE 3 END"


@query(f"""WITH d AS ({DIM}), a AS ({ASK}), j AS (SELECT p_partkey, title, d.*, {TIER} AS tier FROM a LEFT JOIN d ON a.key = d.key AND votes > 10)
SELECT p_partkey, title, arg_min(m_title, (tier, pos)) AS m_title, CASE WHEN count(m_title) > 0 THEN min(tier) END AS tier,
CAST(CAST(left(arg_min(released, (tier, pos)), 4) AS INT) // 10 * 10 AS STRING) || 's' AS decade, nullif(arg_min(rating, (tier, pos)), 0) AS rating FROM j GROUP BY ALL""")
def metadata_ranked_match(t: Tables) -> DataFrame:
    """Every part's title against the whole catalogue. Of the hits for a title (equal first words, more than ten votes): an equal title, else one that contains the
    other, else the first. Keeping the least (tier, position) of each title needs no sort of hits. The tier depends on
    the two titles only, so distinct titles meet the first hit of each distinct catalogue title."""
    t.part.createOrReplaceTempView("dialoom_part")
    d, a = (t.spark.sql(x.replace("FROM part", "FROM dialoom_part")) for x in (DIM, ASK))
    hits = d.where("votes > 10").groupBy("key", "m_title").agg(F.min(F.struct("pos", "released", "rating")).alias("h"))
    j = a.select("key", "title").distinct().join(hits, "key").withColumn("tier", F.expr(TIER))
    best = j.groupBy("key", "title").agg(F.min(F.struct("tier", "h.pos", "m_title", "h.released", "h.rating")).alias("b"))
    decade = F.concat((F.floor(F.substring("b.released", 1, 4).cast("int") / 10) * 10).cast("string"), F.lit("s"))
    return a.join(best, ["key", "title"], "left").select("p_partkey", "title", "b.m_title", "b.tier", decade.alias("decade"), F.nullif("b.rating", F.lit(0.0)).alias("rating"))


@query(f"""WITH p AS (SELECT p_partkey, {TITLES} AS title, p_type AS uri FROM part), c AS (SELECT CAST(p_partkey AS STRING) AS id, [CASE WHEN p_size % 2 = 0 THEN 'Western' ELSE 'Unknown' END, 'War'] AS genres, ['Director ' || (p_partkey % 11), 'Other'] AS directors, CAST(1930 + p_size AS STRING) AS year FROM part WHERE p_partkey % 3 = 0),
x AS (SELECT p_partkey AS pk, 'Music' AS genre, '1970s' AS decade FROM part WHERE p_partkey % 4 = 0),
i AS (SELECT p.p_partkey, CASE {KEYED.replace("(c,", "(lower(uri || ' ' || title),")} ELSE 'Unknown' END AS inferred FROM p)
SELECT p_partkey, coalesce(nullif(inferred, 'Unknown'), nullif(c.genres[1], 'Unknown'), x.genre, 'Unknown') AS genre, c.directors[1] AS director, c.year, coalesce(x.decade, 'Unknown') AS decade FROM i LEFT JOIN c ON CAST(p_partkey AS STRING) = c.id LEFT JOIN x ON pk = p_partkey""")
def enrich_coalesce(t: Tables) -> DataFrame:
    """Genre: inferred, else the cache's first, else external. The decade never comes from the cached year."""
    p = t.part.select("p_partkey", "p_size", "p_type", F.expr(TITLES).alias("title"))
    cache = t.part.where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("id"), F.array(F.when(F.col("p_size") % 2 == 0, "Western").otherwise("Unknown"), F.lit("War")).alias("genres"), F.array(F.concat(F.lit("Director "), F.col("p_partkey") % 11), F.lit("Other")).alias("directors"), (F.col("p_size") + 1930).cast("string").alias("year"))
    external = t.part.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("pk"), F.lit("Music").alias("x_genre"), F.lit("1970s").alias("x_decade"))
    both = F.lower(F.concat("p_type", F.lit(" "), "title"))
    keyword = F.coalesce(T.first_match([("|".join(w), g) for g, w in vocab.GENRE_KEYWORDS.items()], both), F.lit("Unknown"))
    joined = p.join(cache, F.col("p_partkey").cast("string") == F.col("id"), "left").join(external, F.col("pk") == F.col("p_partkey"), "left")
    known = lambda c: F.nullif(c, F.lit("Unknown"))
    return joined.select("p_partkey", F.coalesce(known(keyword), known(F.get("genres", 0)), "x_genre", F.lit("Unknown")).alias("genre"), F.get("directors", 0).alias("director"), "year", F.coalesce("x_decade", F.lit("Unknown")).alias("decade"))


@query(f"""WITH g AS (SELECT p_partkey, [28, p_size, 35, 878, 99999] AS ids FROM part), x AS (SELECT p_partkey, i, ids[i] AS id FROM g, range(1, 6) r(i))
SELECT p_partkey, string_agg(name, ', ' ORDER BY i) AS genres FROM x JOIN (VALUES {IDS}) v(id, name) USING (id) GROUP BY p_partkey""")
def genre_id_names(t: Tables) -> DataFrame:
    """Names of genre ids in their order; ids without a name are dropped."""
    names = F.create_map(*[F.lit(x) for kv in vocab.METADATA_GENRES.items() for x in kv])
    ids = F.array(F.lit(28), F.col("p_size").cast("int"), F.lit(35), F.lit(878), F.lit(99999))
    return t.part.select("p_partkey", F.array_join(F.filter(F.transform(ids, lambda i: names[i]), lambda x: x.isNotNull()), ", ").alias("genres"))
