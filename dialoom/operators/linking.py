"""Linking phrases of dialogues to titles and resources: exact, by resource name, fuzzy, persons."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab
from ..functions.similarity import block_ratio, indel_ratio
from ..sources.scratch import stored

Tagger = Callable[[list[str]], list[list[str]]]


def title_index(titles: DataFrame) -> DataFrame:
    """key, entity_id of (entity_id, title): the last id wins for equal keys; blank keys dropped."""
    return titles.select(T.index_key(F.col("title")).alias("key"), "entity_id").where("key <> ''").groupBy("key").agg(F.max("entity_id").alias("entity_id"))


def phrases(dialogues: DataFrame, blocked: bool = True) -> DataFrame:
    """conv_id, phrase, pos of each distinct 3-, 2- and 1-gram; pos is its place: more characters first, then larger n,
    then first occurrence."""
    words = dialogues.select("conv_id", T.tokens(F.col("dialogue")).alias("w"))
    distinct = words.select("conv_id", F.array_distinct(F.concat(*[T.ngrams(F.col("w"), n) for n in (3, 2, 1)])).alias("g"))
    placed = F.array_sort(F.transform("g", lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("phrase"))))
    runs = distinct.select("conv_id", F.posexplode(placed).alias("pos", "s")).select("conv_id", "pos", "s.phrase")
    return runs.where(~F.col("phrase").isin(vocab.PHRASE_BLOCKLIST)) if blocked else runs


def genre_seeds(dialogues: DataFrame, boost: int = 15) -> DataFrame:
    """conv_id, uri, seeds of dialogues (conv_id, dialogue): each genre resource that the last user turn names counts
    1 + boost a word; without any, each one that the dialogue names counts 1."""
    known = F.create_map(*[F.lit(x) for kv in vocab.GENRE_RESOURCES.items() for x in kv])
    named = lambda text: F.filter(F.transform(F.array_distinct(T.tokens(text)), lambda w: known[w]), lambda u: u.isNotNull())
    both = dialogues.select("conv_id", named(T.last_user_part(F.col("dialogue"))).alias("last"), F.array_distinct(named(F.col("dialogue"))).alias("every"))
    rows = both.select("conv_id", F.explode(F.when(F.size("last") > 0, F.col("last")).otherwise(F.col("every"))).alias("uri"), F.when(F.size("last") > 0, boost).otherwise(0).alias("more"))
    return rows.groupBy("conv_id", "uri").agg((F.sum("more") + 1).alias("seeds"))


def exact(phrase_rows: DataFrame, index: DataFrame) -> DataFrame:
    return phrase_rows.join(index, F.col("phrase") == F.col("key")).drop("key")


def cascade(phrase_rows: DataFrame, index: DataFrame, resources: DataFrame) -> DataFrame:
    """phrase_rows with entity_id and stage: 'title' if the index has the phrase, else 'resource' if resources (uri,
    entity_id) has the phrase's resource name, else 'none'."""
    left = phrase_rows.withColumn("uri", T.resource_of(F.col("phrase")))
    titled = _shuffled(left, index.select(F.col("key").alias("phrase"), F.col("entity_id").alias("t")), "phrase", "left")
    both = _shuffled(titled, resources.select("uri", F.col("entity_id").alias("r")), "uri", "left")
    stage = F.when(F.col("t").isNotNull(), "title").when(F.col("r").isNotNull(), "resource").otherwise("none")
    return both.select("conv_id", "phrase", "pos", F.coalesce("t", "r").alias("entity_id"), stage.alias("stage"))


def _segment(n: Column, parts: Column, i: Column) -> tuple[Column, Column]:
    """(first, length) of the i-th of parts even segments of n characters."""
    first = F.floor(n * i / parts).cast("int")
    return first, F.floor(n * (i + 1) / parts).cast("int") - first


def _shuffled(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """left joined with right without a broadcast, for tables that are larger than their files or plans tell."""
    return left.join(right.hint("merge"), keys, how)


def _letters(c: Column) -> Column:
    """A set of bits of a string: one for each class of letters it has, another for each it has twice. To insert or delete
    a character changes one bit at most."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x)
    kinds = F.transform(F.split(c, ""), lambda x: F.pmod(F.ascii(x), F.lit(32)))
    return F.aggregate(kinds, F.lit(0).cast("long"), lambda had, k: had.bitwiseOR(F.when(had.bitwiseAND(bit(k)) == 0, bit(k)).otherwise(bit(k + 32))))


def fuzzy_pairs(left: DataFrame, right: DataFrame, cutoff: float) -> DataFrame:
    """l, r: distinct strings of left (l) and right (r) that may have 2 * common / (sum of lengths) >= cutoff.

    Such strings differ by d insertions and deletions, at most (1 - cutoff) * sum of lengths and as odd or even as the
    sum. Of d + 1 even segments of r or more, some i-th stands unchanged in l with exactly i insertions and deletions before it and
    d - i at most behind: count one edit off a segment from the left on, and take the first segment that is left without any. So
    it is moved by i, i - 2, ..., -i places, and the rest has no more to move than it may. An equi-join on (length of r, segment,
    content) finds all pairs, without comparing everything with everything. The bound is symmetric: pass the smaller side as left.
    The join is always by shuffle: Spark takes the pieces of a string for one row, so a small table of many pieces would
    pass for small and be sent through the driver. Pairs whose letters differ by more than d (compared as bits, since pieces of few
    characters are common to very many strings) or that are more than d edits apart are dropped inside the join."""
    ratio = cutoff / (2 - cutoff)
    allowed = lambda n, m: F.floor((1 - cutoff) * (n + m) + 1e-9).cast("int")
    longest = lambda n: F.floor(n / ratio + 1e-9).cast("int")
    rs = right.select("r").where("r <> ''").distinct().withColumn("m", F.length("r")).withColumn("r_letters", _letters(F.col("r")))
    parts = lambda m: allowed(longest(m), m) + 1
    seg = rs.withColumn("i", F.explode(F.sequence(F.lit(0), parts(F.col("m")) - 1)))
    first, length = _segment(F.col("m"), parts(F.col("m")), F.col("i"))
    seg = seg.select("r", "r_letters", "m", "i", F.substring(F.col("r"), first + 1, length).alias("s")).where("s <> ''")
    ls = left.select("l").where("l <> ''").distinct().withColumn("n", F.length("l")).withColumn("l_letters", _letters(F.col("l")))
    ls = ls.withColumn("m", F.explode(F.sequence(F.greatest(F.lit(1), F.ceil(F.col("n") * ratio - 1e-9).cast("int")), longest(F.col("n")))))
    d = allowed(F.col("n"), F.col("m"))
    ls = ls.withColumn("d", d - F.pmod(F.col("n") + F.col("m") - d, F.lit(2))).where("d >= abs(n - m)")
    ls = ls.withColumn("i", F.explode(F.sequence(F.lit(0), F.least(F.col("d"), parts(F.col("m")) - 1))))
    ls = ls.withColumn("moved", F.explode(F.sequence(-F.col("i"), F.col("i"), F.lit(2)))).where("abs(n - m - moved) <= d - i")
    first, length = _segment(F.col("m"), parts(F.col("m")), F.col("i"))
    at = first + F.col("moved")
    ls = ls.where((at >= 0) & (at + length <= F.col("n")))
    ls = ls.select("l", "l_letters", "d", "m", "i", F.substring(F.col("l"), at + 1, length).alias("s")).where("s <> ''").distinct()
    # unmatched characters are at least as many as edits, so that no pair at the cutoff is lost here
    few = F.expr("bit_count(l_letters ^ r_letters) <= d AND levenshtein(l, r, d) >= 0")
    return _shuffled(ls, seg, ["m", "i", "s"]).where(few).select("l", "r").distinct()


def fuzzy(phrase_rows: DataFrame, index: DataFrame, cutoff: float, least_length: int = 6) -> DataFrame:
    """conv_id, phrase, key, entity_id, ratio: the best title at or above cutoff; of equals the last by code points."""
    index = stored(index)
    most = index.agg(F.max(F.length("key"))).first()[0] or 0
    fits = F.length("phrase").between(least_length, int(most * (2 - cutoff) / cutoff + 1e-9))  # longer ones are like no title
    wanted = stored(phrase_rows.where(fits))  # read three times, like index
    # titles are few and phrases many: shifted pieces are made of titles, the even segments of phrases
    pairs = fuzzy_pairs(index.select(F.col("key").alias("l")), wanted.select(F.col("phrase").alias("r")), cutoff).select(F.col("r").alias("l"), F.col("l").alias("r"))
    rated = pairs.withColumn("ratio", block_ratio(cutoff)("l", "r")).where(F.col("ratio") >= cutoff)
    best = rated.groupBy("l").agg(F.max(F.struct("ratio", "r")).alias("b")).select(F.col("l").alias("phrase"), F.col("b.r").alias("key"), F.col("b.ratio").alias("ratio"))
    return _shuffled(_shuffled(wanted, best, "phrase"), index, "key").select("conv_id", "phrase", "key", "entity_id", "ratio")


#: Names are first compared at this score, where candidates are few.
STRICT = 96.0


def persons(names: DataFrame, entities: DataFrame, threshold: float = 85.0) -> DataFrame:
    """name, entity_id, score of names (name) and entities (entity_id, label): an equal label, else the most similar one
    above threshold; the first id wins. A name with a label above STRICT has its best one there, so that only the others
    are compared with all that is above threshold."""
    named = names.select(F.lower(F.trim("name")).alias("l"), "name").distinct()
    labels = entities.select(F.lower("label").alias("r"), "entity_id")
    best = _best_labels(named, labels, max(threshold, STRICT))
    if threshold < STRICT:
        best = stored(best)
        best = best.unionByName(_best_labels(_shuffled(named, best, "l", "left_anti"), labels, threshold))
    return _shuffled(named, best, "l").select("name", (-F.col("b.last")).alias("entity_id"), F.col("b.score").alias("score"))


def _best_labels(named: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    pairs = fuzzy_pairs(named, labels, threshold / 100).withColumn("score", F.when(F.col("l") == F.col("r"), F.lit(100.0)).otherwise(indel_ratio("l", "r")))
    rated = _shuffled(pairs.where((F.col("score") > threshold) | (F.col("l") == F.col("r"))), labels, "r")
    return rated.groupBy("l").agg(F.max(F.struct("score", (-F.col("entity_id")).alias("last"))).alias("b"))


def one_word_seeds(words: DataFrame) -> DataFrame:
    """conv_id, phrase, accepted of tokens (conv_id, pos, raw): a one-word phrase is accepted if one of its tokens is
    capitalised inside a sentence, stands beside a word like 'called', or is no stop word."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("pos")
    bare = lambda c: F.lower(F.regexp_replace(c, T.PUNCTUATION, ""))
    near = words.withColumn("phrase", bare(F.col("raw"))).withColumn("prev", F.lag("raw").over(w)).withColumn("next", F.lead("raw").over(w)).where("phrase <> ''")
    inside = F.rlike("raw", F.lit(r"^[A-Z][a-z]+")) & F.col("prev").isNotNull() & ~F.rlike(F.coalesce("prev", F.lit("")), F.lit(r"[.,!?:;]$"))
    context = F.coalesce(bare(F.col("prev")).isin(vocab.STRONG_CONTEXT), F.lit(False)) | F.coalesce(bare(F.col("next")).isin(vocab.STRONG_CONTEXT), F.lit(False))
    good = inside | context | ~F.col("phrase").isin(vocab.STOP_WORDS)
    return near.withColumn("good", good).groupBy("conv_id", "phrase").agg(F.bool_or("good").alias("accepted"))


def tagged(dialogues: DataFrame, tagger: Tagger) -> DataFrame:
    """conv_id, name of dialogues (conv_id, dialogue): the distinct names that tagger finds, a function from a list of
    texts to a list of lists of names. A null dialogue is an empty text; blank names go."""
    kind = dialogues.schema["conv_id"].dataType.simpleString()

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = tagger([t or "" for t in b.column(1).to_pylist()])
            if len(found) != b.num_rows:
                raise ValueError(f"the tagger gave {len(found)} lists of names for {b.num_rows} texts")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([list(f or []) for f in found], pa.list_(pa.string()))], names=["conv_id", "names"])

    rows = dialogues.select("conv_id", "dialogue").mapInArrow(tag, f"conv_id {kind}, names array<string>")
    return rows.select("conv_id", F.explode("names").alias("name")).where("trim(name) <> ''").distinct()


GENRE_URI = "<http://dbpedia.org/resource/"


def linked(dialogues: DataFrame, index: DataFrame, resources: DataFrame, names: DataFrame | None = None, entities: DataFrame | None = None, *, cutoff: float = 0.92, threshold: float = 85.0) -> tuple[DataFrame, DataFrame]:
    """(seeds, noise) of dialogues (conv_id, dialogue): conv_id, entity_id, stage, phrase, place of each entity that a
    dialogue names, once, by the first of these that finds it; and conv_id, phrase of the single words that were refused.

    Phrases go from long to short; single words must pass `one_word_seeds`. A phrase is a title of index, else a resource,
    else, from six characters on and unless it is part of a phrase or title found before, the most similar title. Then
    come the genres of `genre_seeds`, and persons: names (conv_id, name), as a tagger of one's own choice finds them,
    against entities (entity_id, label)."""
    words = F.filter(F.split("dialogue", r"\s+"), lambda x: x != "")
    single = one_word_seeds(dialogues.select("conv_id", F.posexplode(words).alias("pos", "raw")))
    rows = stored(_shuffled(phrases(dialogues), single, ["conv_id", "phrase"], "left").withColumn("ok", F.contains("phrase", F.lit(" ")) | F.coalesce("accepted", F.lit(False))))
    noise = rows.where("NOT ok").select("conv_id", "phrase")
    staged = stored(cascade(rows.where("ok").select("conv_id", "phrase", "pos"), index, resources))
    found = staged.where("stage <> 'none'")
    told = found.groupBy("conv_id").agg(F.collect_set("phrase").alias("told"))
    rest = _shuffled(staged.where((F.col("stage") == "none") & (F.length("phrase") >= 6)), told, "conv_id", "left")
    rest = rest.where(~F.coalesce(F.exists("told", lambda x: F.contains(x, F.col("phrase"))), F.lit(False))).select("conv_id", "phrase", "pos")
    rest = stored(rest)
    near = stored(_shuffled(fuzzy(rest, index, cutoff), rest, ["conv_id", "phrase"]))
    earlier = near.groupBy("conv_id").agg(F.collect_list(F.struct("pos", "phrase", "key")).alias("all"))
    part = lambda x: (x["pos"] < F.col("pos")) & (F.contains(x["phrase"], F.col("phrase")) | F.contains(x["key"], F.col("phrase")))
    near = _shuffled(near, earlier, "conv_id").where(~F.exists("all", part))
    genres = _shuffled(genre_seeds(dialogues).withColumn("uri", F.concat(F.lit(GENRE_URI), "uri", F.lit(">"))), resources, "uri")
    every = found.select("conv_id", "entity_id", F.lit(0).alias("step"), "pos", "stage", "phrase").unionByName(near.select("conv_id", "entity_id", F.lit(1).alias("step"), "pos", F.lit("fuzzy").alias("stage"), "phrase"))
    every = every.unionByName(genres.select("conv_id", "entity_id", F.lit(2).alias("step"), F.lit(0).alias("pos"), F.lit("genre").alias("stage"), F.col("uri").alias("phrase")))
    if names is not None and entities is not None:
        people = _shuffled(names, persons(names, entities, threshold), "name").select("conv_id", "entity_id", F.lit(3).alias("step"), F.lit(0).alias("pos"), F.lit("person").alias("stage"), F.col("name").alias("phrase"))
        every = every.unionByName(people)
    first = every.groupBy("conv_id", "entity_id").agg(F.min(F.struct("step", "pos", "phrase", "stage")).alias("f"))
    return first.select("conv_id", "entity_id", "f.stage", "f.phrase", F.struct("f.step", "f.pos", "f.phrase").alias("place")), noise


def resolved(titles: DataFrame, index: DataFrame, cutoff: float = 0.85) -> DataFrame:
    """conv_id, place, entity_id of titles (conv_id, place, title), as a model writes them: the title of index with an equal
    key, else the most similar one from cutoff on."""
    keyed = titles.withColumn("phrase", T.index_key(F.col("title")))
    same = keyed.join(index, F.col("phrase") == F.col("key"), "left")
    rest = same.where("key IS NULL AND phrase <> ''").select("conv_id", "phrase").distinct()
    near = fuzzy(rest, index, cutoff, least_length=1).select("conv_id", "phrase", F.col("entity_id").alias("near"))
    both = same.join(near, ["conv_id", "phrase"], "left").withColumn("e", F.coalesce("entity_id", "near"))
    return both.where("e IS NOT NULL").select("conv_id", "place", F.col("e").alias("entity_id"))
