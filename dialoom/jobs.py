"""Command-line jobs: python -m dialoom.jobs evaluate|popularity|zeroshot|splits …, or the same file with spark-submit."""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ship
from .functions import text as T
from .operators import dialogue as D
from .operators import linking as L
from .operators import models as M
from .operators import ranking as R
from .operators import recommend as P
from .operators.overlap import text_scores
from .sources import io
from .sources.scratch import stored


def instances(samples: DataFrame) -> DataFrame:
    """conv_id, turn, title (normalised): the gold titles of each respondent turn that has any."""
    return D.gold_titles(samples).select("conv_id", "turn", T.normalised_title(F.col("title")).alias("title"))


def limited(gold: DataFrame, most: int | None) -> DataFrame:
    """gold of the first `most` conversations that have instances, by id; all without most."""
    if not most:
        return gold
    return gold.join(gold.select("conv_id").distinct().orderBy("conv_id").limit(most), "conv_id", "left_semi")


def report(found: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """One row of means over instances, and of the conversations' successes, from matches; with NDCG if they have
    n_all, the number of gold titles with duplicates."""
    sized = "n_all" in found.columns
    per = R.instance_metrics(found, ["conv_id", "turn", *(["n_all"] if sized else [])], ks)
    rank = F.when(F.col("first_rank") > 0, F.col("first_rank").cast("double"))
    ndcg = [F.avg(F.col(f"dcg_{k}") / R.ideal_gain(F.col("n_all"), k)).alias(f"NDCG@{k}") for k in ks] if sized else []
    means = per.agg(F.count("*").alias("instances"), *[F.avg(f"hit_{k}").alias(f"Recall@{k}") for k in ks], *[F.avg(f"precision_{k}").alias(f"Precision@{k}") for k in ks], *ndcg, F.avg("mrr").alias("MRR"), F.avg(rank).alias("AvgGoldRank"), F.median(rank).alias("MedianGoldRank"))
    conv = per.groupBy("conv_id").agg(*[F.max(f"hit_{k}").alias(f"hit_{k}") for k in ks])
    return means.join(conv.agg(F.count("*").alias("conversations"), *[F.avg(f"hit_{k}").alias(f"ConvRecall@{k}") for k in ks]))


def popularity(spark: SparkSession, train: str, test: str, top_n: int = 50, most: int | None = None) -> DataFrame:
    ranked = R.popularity(instances(io.read_samples(spark, train)[0]), top_n, ["conv_id", "turn"])
    return report(R.matches(limited(instances(io.read_samples(spark, test)[0]), most), ranked, ["conv_id", "turn"]), (1, 10, 50))


def zeroshot(spark: SparkSession, answers: str, test: str, most: int | None = 1500) -> DataFrame:
    """answers: JSON lines of conv_id, turn, answer (numbered lists of a model)."""
    gold = limited(instances(io.read_samples(spark, test)[0]), most)
    lists = io.read_lines(spark, answers, "conv_id STRING, turn INT, answer STRING")[0].withColumn("l", T.parsed_list(F.col("answer")))
    shown = lists.withColumn("l", F.when(F.size("l") > 0, F.col("l")).otherwise(F.array_repeat(F.lit("Unknown"), 10)))
    ranked = shown.select("conv_id", "turn", F.posexplode("l").alias("p", "t")).select("conv_id", "turn", (F.col("p") + 1).alias("rank"), T.normalised_title(F.col("t")).alias("title"))
    best = ranked.groupBy("conv_id", "turn", "title").agg(F.min("rank").alias("rank"))
    return report(gold.distinct().join(best, ["conv_id", "turn", "title"], "left"), (1, 10))


def text_means(responses: DataFrame) -> DataFrame:
    """One row: mean length of responses and Distinct-2 to -4 over all of them."""
    words = responses.select(T.tokens(F.col("generated_response")).alias("w"))
    grams = words.select(F.explode(F.array(*[F.struct(F.lit(n).alias("n"), T.ngrams(F.col("w"), n).alias("g")) for n in (2, 3, 4)])).alias("s")).select("s.n", F.explode("s.g").alias("g"))
    per = grams.groupBy("n", "g").agg(F.count("*").alias("c")).groupBy("n").agg((F.count("*") / F.sum("c")).alias("d"))
    distinct = per.agg(*[F.coalesce(F.max(F.when(F.col("n") == n, F.col("d"))), F.lit(0.0)).alias(f"Distinct-{n}") for n in (2, 3, 4)])
    return words.agg(F.avg(F.size("w")).alias("MeanLength")).join(distinct)


def linked_lists(spark: SparkSession, dialogues: DataFrame, base: list[str], catalogue: str, model: M.Model | None, use_fusion: bool, tagger: L.Tagger | None = None) -> DataFrame:
    """dialogues (k, dialogue, ...) with seeds (phrases), decades, titles (normalised) and sources, the ranked list of the
    whole chain: linking, weak seeds, movies only, fusion or the fixed list. The scorer's list is base, of fifty titles at
    most, for all. catalogue: JSON lines of entity_id, uri, movie. Names that tagger finds are linked with its resources' names."""
    rows = stored(io.read_lines(spark, catalogue, "entity_id LONG, uri STRING, movie BOOLEAN")[0].where("entity_id IS NOT NULL AND uri IS NOT NULL"))
    movies = rows.where("movie").select("entity_id", T.title_of_resource(F.col("uri")).alias("title"))
    index, asked = L.title_index(movies), dialogues.select(F.col("k").alias("conv_id"), "dialogue")
    ranked = spark.createDataFrame([(t, -float(n)) for n, t in enumerate(base)], "title string, score double")
    best = movies.withColumn("title", T.normalised_title(F.col("title"))).join(F.broadcast(ranked), "title").select("entity_id", "score")
    names = L.tagged(asked, tagger) if tagger else None
    labels = rows.select("entity_id", F.translate(F.regexp_extract("uri", "resource/(.+)>", 1), "_", " ").alias("label")).where("label <> ''")
    seeds, _ = L.linked(asked, index, rows.select("uri", "entity_id"), names, labels)
    seeds = stored(seeds)
    # a title may stand for several entities, so what is sent out is cut to the best 200, which is as far as a list looks
    scored = asked.select("conv_id").crossJoin(F.broadcast(best.orderBy(F.desc("score"), "entity_id").limit(200)))
    got = P.retrieve(asked, seeds, scored, index, rows.select("entity_id", "uri"), movies.select("entity_id"), model, use_fusion=use_fusion)
    shown = got.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("rank", T.normalised_title(F.col("title")).alias("title"), "source"))).alias("l"))
    told = seeds.groupBy("conv_id").agg(F.array_sort(F.collect_list("place")).alias("p"))
    both = dialogues.join(shown.withColumnRenamed("conv_id", "k"), "k").join(told.withColumnRenamed("conv_id", "k"), "k", "left")
    phrases = F.coalesce(F.transform("p", lambda x: x["phrase"]), F.array().cast(P.STRINGS))
    return both.select(*dialogues.columns, phrases.alias("seeds"), T.dialogue_decades(F.col("dialogue")).alias("decades"), F.col("l.title").alias("titles"), F.col("l.source").alias("sources"))


def evaluate(
    spark: SparkSession, train: str, test: str, *, shape: int = 1, most: int | None = None, rerank: bool = True, use_fusion: bool = True, respond: bool = True, metadata: str | None = None, catalogue: str | None = None, model: M.Model | None = None, tagger: L.Tagger | None = None
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(report, diagnostics, responses) of the whole chain: dialogues up to each gold turn, retrieval by popularity in
    train and titles that the dialogue names, choice, response. metadata: JSON lines of title, year, genre, decade,
    director; titles are compared normalised, and the first row of equal ones counts. catalogue: JSON lines of entity_id,
    uri, movie; with it lists come from the whole chain of linking and retrieval, where tagger finds names. Without respond there are no responses."""
    (samples, bad), known = io.read_samples(spark, test), instances(io.read_samples(spark, train)[0])
    every = instances(samples)
    gold = limited(every, most).groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list("title")).alias("gold"))
    messages = D.from_samples(samples)
    histories = D.prefixes(messages).select("conv_id", "turn", F.col("prefix").alias("dialogue"))
    dialogues = gold.join(histories, ["conv_id", "turn"]).withColumn("k", F.to_json(F.struct("conv_id", "turn")))
    base = [r["title"] for r in R.popularity(known, 50, ["conv_id", "turn"]).orderBy("rank").collect()]  # fifty titles at most
    facts = None
    if metadata:
        rows = io.read_lines(spark, metadata, "title STRING, year STRING, genre STRING, decade STRING, director STRING")[0].withColumn("title", T.normalised_title(F.col("title")))
        facts = rows.groupBy("title").agg(F.min(F.struct("year", "genre", "decade", "director")).alias("f")).select("title", "f.*")
    # read by the prompts, the choice and the metrics
    if catalogue:
        lists = linked_lists(spark, stored(dialogues), base, catalogue, model, use_fusion, tagger).persist()
    else:
        lists = P.retrieved(dialogues, base, L.title_index(known.select(F.col("title").alias("entity_id"), "title")), use_fusion=use_fusion).persist()
    picked = P.reranked(lists, facts, shape, model) if rerank else P.first_choice(lists)
    # one pass of the model serves the report, the diagnostics and the responses
    chosen = lists.join(picked, "k").withColumn("correct", F.array_contains("gold", F.col("title"))).persist()
    place = lambda t: F.nullif(F.array_position("titles", t), F.lit(0))
    found = chosen.select("conv_id", "turn", F.size("gold").alias("n_all"), F.explode(F.array_distinct("gold")).alias("title")).join(chosen.select("conv_id", "turn", "titles"), ["conv_id", "turn"])
    means = report(found.select("conv_id", "turn", "n_all", "title", place(F.col("title")).cast("int").alias("rank")), (1, 10, 50))
    means = means.join(chosen.agg(F.avg(F.col("correct").cast("int")).alias("RerankHit@1"), F.count_if("is_fallback").alias("reranker_fallbacks")))
    # what was not evaluated: lines that can't be read, and conversations and turns beyond the first `most`
    asked = every.select("conv_id", "turn").distinct().agg(F.count("*").alias("all_instances"), F.count_distinct("conv_id").alias("all_conversations"))
    means = means.join(bad.agg(F.count("*").alias("skipped_conversations"))).join(asked)
    means = means.withColumn("left_out_instances", F.col("all_instances") - F.col("instances")).withColumn("left_out_conversations", F.col("all_conversations") - F.col("conversations")).drop("all_instances", "all_conversations")
    rank = F.array_min(F.filter(F.transform("gold", place), lambda x: x.isNotNull()))
    own = F.array(*[F.lit(t) for t in base]).cast(P.STRINGS)
    source = F.get("sources", place(F.col("title")) - 1) if catalogue else F.when(F.array_contains(own, F.col("title")), "popularity").when(F.array_contains("titles", F.col("title")), "seed")
    source = F.coalesce(source, F.lit("NOT_IN_LIST"))
    diagnostics = chosen.withColumn("rank", rank).select(
        F.col("conv_id").alias("conversation_id"), F.col("turn").cast("long").alias("turn_index"), F.lit(shape).cast("long").alias("format"), F.col("dialogue").alias("dialogue_history"), F.col("gold").alias("ground_truth_movies"),
        F.col("title").alias("selected_movie"), source.alias("selected_candidate_source"), F.coalesce("rank", F.lit(-1)).cast("long").alias("gold_rank"), F.size("titles").cast("long").alias("candidate_count"), F.lit(not rerank).alias("skip_reranker"), "correct",
        *[F.coalesce(F.col("rank") <= k, F.lit(False)).alias(f"gold_in_top_{k}") for k in (1, 10, 50)], F.col("is_fallback").alias("reranker_fallback"), F.col("decades").alias("detected_decades"), F.col("seeds").alias("extracted_seeds"),
    )
    if not respond:
        return means, diagnostics, None
    said = messages.select("conv_id", "turn", F.trim(T.unescaped(F.col("text"))).alias("reference_response"))
    told = P.answers(chosen.select("conv_id", "turn", "dialogue", "title"), facts, model).join(said, ["conv_id", "turn"])
    responses = told.select(F.col("conv_id").alias("conversation_id"), F.col("turn").cast("long").alias("turn_index"), F.col("title").alias("selected_movie"), F.col("response").alias("generated_response"), "reference_response").persist()
    return means.join(text_means(responses)).join(text_scores(responses, ["conversation_id", "turn_index"])), diagnostics, responses


def example_failures(diagnostics: DataFrame, most: int = 10) -> DataFrame:
    """Some instances whose gold title was not among the first fifty although seeds were found, in order."""
    missed = diagnostics.where((F.size("extracted_seeds") > 0) & ~F.col("gold_in_top_50"))
    return missed.select("conversation_id", "turn_index", "ground_truth_movies", "extracted_seeds", "selected_movie").orderBy("conversation_id", "turn_index").limit(most)


def splits(spark: SparkSession, **paths: str) -> DataFrame:
    """split_a, split_b, shared, verdict for each pair of sample files."""
    rows = None
    for name, path in paths.items():
        ids = io.read_samples(spark, path)[0].select(F.col("conversationId").alias("id")).distinct().withColumn("split", F.lit(name))
        rows = ids if rows is None else rows.unionByName(ids)
    per = rows.groupBy("id").agg(F.collect_set("split").alias("s"))
    names = list(paths)
    pairs = [(a, b) for n, a in enumerate(names) for b in names[n + 1 :]]
    both = per.agg(*[F.count(F.when(F.array_contains("s", a) & F.array_contains("s", b), 1)).alias(f"{a}|{b}") for a, b in pairs])
    listed = both.select(F.explode(F.array(*[F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"), F.col(f"{a}|{b}").alias("shared")) for a, b in pairs])).alias("r")).select("r.*")
    return listed.withColumn("verdict", F.when(F.col("shared") == 0, "PASSED").otherwise("FAILED"))


def first_mentions(samples: DataFrame, conversations: int = 2) -> DataFrame:
    """conv_id, turn, history of the first respondent turn with a mention, for the first conversations by id."""
    each = samples.select(F.col("conversationId").alias("conv_id"), "respondentWorkerId", F.posexplode("messages").alias("turn", "m")).where("m.senderWorkerId = respondentWorkerId AND contains(m.text, '@')")
    first = each.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("n = 1").select("conv_id", "turn").orderBy("conv_id").limit(conversations)
    return first.join(D.prefixes(D.from_samples(samples)).select("conv_id", "turn", F.col("prefix").alias("history")), ["conv_id", "turn"])


def function_of(name: str):
    """The function that module:function names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)
    for job, needed in (("evaluate", ("train", "test")), ("popularity", ("train", "test")), ("zeroshot", ("answers", "test")), ("splits", ("train", "valid", "test"))):
        p = jobs.add_parser(job)
        for name in needed:
            p.add_argument(f"--{name}", required=True)
        p.add_argument("--out", help="folder for the report as JSON lines; shown if it isn't given")
        if job != "splits":
            p.add_argument("--max-samples", type=int, help="conversations; 0: all; evaluate: 200, zeroshot: 1500 if it isn't given")
        if job == "evaluate":
            p.add_argument("--format", type=int, choices=(1, 2, 3, 4), default=1, help="shape of candidates in prompts")
            for flag in ("recommendation-only", "skip-reranker", "disable-fusion"):
                p.add_argument(f"--{flag}", action="store_true")
            p.add_argument("--save-error-analysis", help="folder for one diagnostics row an instance")
            p.add_argument("--save-responses", help="folder for the responses")
            p.add_argument("--save-examples", help="folder for ten instances that had seeds and missed")
            p.add_argument("--metadata", help="JSON lines of title, year, genre, decade, director")
            p.add_argument("--catalogue", help="JSON lines of entity_id, uri, movie: lists come from the whole chain of linking and retrieval")
            p.add_argument("--tagger", help="module:function from a list of texts to a list of lists of names; with --catalogue only")
            p.add_argument("--model", help="module:function from a list of prompts to a list of answers; a stand-in if it isn't given")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    for path in filter(None, (getattr(args, n, None) for n in ("train", "test", "answers", "valid", "metadata", "catalogue"))):
        if not io.exists(spark, path):
            print(f"No file {path}")
            return
    if args.job == "splits":
        out = splits(spark, train=args.train, valid=args.valid, test=args.test)
    elif args.job == "evaluate":
        model, tagger = (function_of(f) if f else None for f in (args.model, args.tagger))
        means, diagnostics, responses = evaluate(
            spark, args.train, args.test, shape=args.format, most=200 if args.max_samples is None else args.max_samples, rerank=not args.skip_reranker, use_fusion=not args.disable_fusion, respond=not args.recommendation_only, metadata=args.metadata, catalogue=args.catalogue, model=model, tagger=tagger
        )
        if args.save_error_analysis:
            io.write_lines(diagnostics, args.save_error_analysis)
        if args.save_examples:
            io.write_lines(example_failures(diagnostics), args.save_examples)
        if args.save_responses and responses is not None:
            io.write_lines(responses, args.save_responses)
        out = io.metrics_long(means, [])
    elif args.job == "popularity":
        out = io.metrics_long(popularity(spark, args.train, args.test, most=args.max_samples), [])
    else:
        out = io.metrics_long(zeroshot(spark, args.answers, args.test, 1500 if args.max_samples is None else args.max_samples), [])
    io.write_lines(out, args.out) if args.out else out.show(50, truncate=False)


if __name__ == "__main__":
    main()
