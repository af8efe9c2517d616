"""From dialogues to ranked lists, a chosen title and a response, for many dialogues in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import stored
from . import linking as L
from . import models as M
from . import ranking as R

STRINGS = "array<string>"


def seeds(dialogues: DataFrame, index: DataFrame) -> DataFrame:
    """k, seeds of dialogues (k, dialogue): the indexed titles that each names, longer phrases first."""
    found = L.exact(L.phrases(dialogues.select(F.col("k").alias("conv_id"), "dialogue")), index)
    rows = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "entity_id"))).alias("s"))
    return rows.select(F.col("conv_id").alias("k"), F.array_distinct(F.transform("s", lambda x: x["entity_id"])).alias("seeds"))


def fused_list(base: Column, extra: Column, preserved: int, most_extra: int, top_k: int) -> Column:
    """base with up to most_extra titles of extra that it doesn't hold set in after the first `preserved` ones."""
    new = F.slice(F.array_except(extra, base), 1, most_extra)
    return F.slice(F.concat(F.slice(base, 1, preserved), new, F.slice(base, preserved + 1, top_k)), 1, top_k)


def retrieved(dialogues: DataFrame, base: list[str], index: DataFrame, *, use_fusion: bool = True, preserved: int = 30, most_extra: int = 15, top_k: int = 50) -> DataFrame:
    """dialogues (k, dialogue, ...) with seeds, decades and titles, the ranked list. base is one scorer's list for all,
    of top_k titles at most; without any title a list is empty."""
    none = F.array().cast(STRINGS)
    own = F.array(*[F.lit(t) for t in base[:top_k]]).cast(STRINGS)
    rows = dialogues.join(seeds(dialogues, index), "k", "left").withColumn("seeds", F.coalesce("seeds", none))
    listed = fused_list(own, F.col("seeds"), preserved, most_extra, top_k) if use_fusion else own
    return rows.withColumn("decades", T.dialogue_decades(F.col("dialogue"))).withColumn("titles", listed)


def candidates(lists: DataFrame, metadata: DataFrame | None) -> DataFrame:
    """k, rank, title and year, genre, decade, director (null where metadata, one row a title, has none)."""
    rows = lists.select("k", F.posexplode("titles").alias("rank", "title")).withColumn("rank", F.col("rank") + 1)
    facts = ("year", "genre", "decade", "director")
    if metadata is None:
        return rows.select("*", *[F.lit(None).cast("string").alias(c) for c in facts])
    return rows.join(metadata.select("title", *facts), "title", "left").select("k", "rank", "title", *facts)


def reranked(lists: DataFrame, metadata: DataFrame | None, shape: int, model: M.Model | None) -> DataFrame:
    """k, title, is_fallback: what the model picks from each list, shown in one of four shapes."""
    rows = candidates(lists, metadata)
    lines = rows.select("k", "rank", T.candidate_line(*[F.col(c) for c in ("rank", "title", "year", "genre", "decade", "director")], shape).alias("line"))
    blocks = lines.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("b"))
    block = F.coalesce(F.array_join(F.transform("b", lambda x: x["line"]), "\n"), F.lit(""))
    prompts = lists.join(blocks, "k", "left").select("k", M.rerank_prompt(F.col("dialogue"), block, F.col("decades"), F.array().cast(STRINGS)).alias("prompt"))
    return M.chosen(M.answered(prompts, model), rows, "k")


def first_choice(lists: DataFrame) -> DataFrame:
    """k, title, is_fallback: the head of each list, 'Unknown' if it is empty."""
    return lists.select("k", F.coalesce(F.get("titles", F.lit(0)), F.lit("Unknown")).alias("title"), F.lit(False).alias("is_fallback"))


def answers(chosen: DataFrame, metadata: DataFrame | None, model: M.Model | None) -> DataFrame:
    """chosen (k, dialogue, title, ...) with response; without a model, or where it fails, a plain sentence."""
    facts = chosen.withColumns({c: F.lit(None).cast("string") for c in ("genre", "decade")}) if metadata is None else chosen.join(metadata.select("title", "genre", "decade"), "title", "left")
    asked = facts.withColumn("prompt", F.concat(F.lit("Recommend this title in two sentences: "), F.col("title"), F.lit("\n[Dialogue History]\n"), T.last_lines(F.col("dialogue"), 5)))
    told = M.answered(asked, model) if model else asked.withColumn("answer", F.lit(None).cast("string"))
    return M.responses(told).drop("prompt", "answer")


def movies_of(rows: DataFrame, catalogue: DataFrame, movies: DataFrame) -> DataFrame:
    """rows (entity_id, ...) with title, of those entities that are movies (entity_id) and whose resource in catalogue
    (entity_id, uri) gives a title that may be shown. Genres, persons and other entities go."""
    titled = L._shuffled(L._shuffled(rows, movies.select("entity_id"), "entity_id", "left_semi"), catalogue.select("entity_id", T.title_of_resource(F.col("uri")).alias("title")), "entity_id")
    return titled.where(T.is_candidate(F.col("title")))


def scored_list(scored: DataFrame, catalogue: DataFrame, movies: DataFrame, top_k: int = 50) -> DataFrame:
    """conv_id, id, title, rank of scored (conv_id, entity_id, score): of the 4 * top_k best by score the first top_k that
    may be shown; of equal scores the least id."""
    best = scored.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "entity_id"))).where(F.col("place") <= 4 * top_k)
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("place"))
    return movies_of(best, catalogue, movies).withColumn("rank", rank).where(F.col("rank") <= top_k).select("conv_id", F.col("entity_id").alias("id"), "title", "rank")


def weak_titles(dialogues: DataFrame, seeds: DataFrame, model: M.Model | None, *, threshold: int = 4, most: int = 3) -> DataFrame:
    """conv_id, place, title: what the model names for dialogues with fewer than threshold seeds (conv_id, ...); the first
    `most` lines that aren't blank. A model that fails names nothing."""
    counts = seeds.groupBy("conv_id").agg(F.count("*").alias("seeds"))
    weak = L._shuffled(dialogues, counts, "conv_id", "left").where(F.coalesce("seeds", F.lit(0)) < threshold)
    asked = weak.select("conv_id", F.concat(F.lit(f"Name {most} well-known movies that fit this dialogue, one title a line.\n"), "dialogue").alias("prompt"))
    lines = F.filter(F.transform(F.split(F.coalesce("answer", F.lit("")), "\n"), F.trim), lambda x: x != "")
    return M.answered(asked, model).select("conv_id", F.posexplode(F.slice(lines, 1, most)).alias("place", "title"))


def retrieve(dialogues: DataFrame, seeds: DataFrame, scored: DataFrame, index: DataFrame, catalogue: DataFrame, movies: DataFrame, model: M.Model | None, *, use_fusion: bool = True, preserved: int = 30, most_extra: int = 15, top_k: int = 50, threshold: int = 4, cutoff: float = 0.85) -> DataFrame:
    """conv_id, rank, id, title, source of the candidates of dialogues (conv_id, dialogue).

    seeds (conv_id, entity_id, place) are those of linking.linked; a dialogue with few also gets those of titles that the
    model names. One without any, or without a scored title that may be shown, gets the fixed list. The others get the
    scorer's list (scored: conv_id, entity_id, score), with movies among the seeds and the model's titles, both new to
    it, set in after the first `preserved` ones (unless use_fusion is off)."""
    seeds, dialogues = stored(seeds), stored(dialogues)
    named = stored(resolved_titles(stored(weak_titles(dialogues, seeds, model, threshold=threshold)), index, cutoff))
    seeded = seeds.select("conv_id").unionByName(named.select("conv_id")).distinct()
    base = stored(scored_list(L._shuffled(scored, seeded, "conv_id", "left_semi"), catalogue, movies, top_k))
    known = lambda d: d.withColumn("norm", T.index_key(F.col("title")))
    if use_fusion:
        own = movies_of(seeds, catalogue, movies).select("conv_id", F.col("entity_id").alias("id"), "title", F.struct(F.lit(0).alias("kind"), F.col("place.step"), F.col("place.pos"), F.col("place.phrase")).alias("pos"))
        told = movies_of(named, catalogue, movies).select("conv_id", F.col("entity_id").alias("id"), "title", F.struct(F.lit(1).alias("kind"), F.lit(0).alias("step"), F.col("place").alias("pos"), F.lit("").alias("phrase")).alias("pos"))
        extra = stored(L._shuffled(own.unionByName(told), base.select("conv_id").distinct(), "conv_id", "left_semi"))
        got = R.fused(known(base), known(extra), ["conv_id"], preserved=preserved, most_extra=most_extra, top_k=top_k, same="norm")
        first = extra.groupBy("conv_id", "id").agg(F.min("pos.kind").alias("kind"))
        got = L._shuffled(got, first, ["conv_id", "id"], "left").withColumn("source", F.when(F.col("block") != 1, "SCORER").when(F.col("kind") == 0, "SEED_FUSION").otherwise("MODEL_FUSION"))
    else:
        got = base.withColumn("source", F.lit("SCORER"))
    fixed = M.fallback_list(dialogues.sparkSession, top_k).select("rank", F.col("id").cast("long").alias("id"), "title", F.lit("FALLBACK").alias("source"))
    none = L._shuffled(dialogues.select("conv_id"), base.select("conv_id").distinct(), "conv_id", "left_anti").crossJoin(F.broadcast(fixed))
    return got.select("conv_id", "rank", F.col("id").cast("long").alias("id"), "title", "source").unionByName(none.select("conv_id", "rank", "id", "title", "source"))


def resolved_titles(titles: DataFrame, index: DataFrame, cutoff: float) -> DataFrame:
    """conv_id, entity_id, place of the model's titles that the index resolves, each entity once."""
    return L.resolved(titles, index, cutoff).groupBy("conv_id", "entity_id").agg(F.min("place").alias("place"))
