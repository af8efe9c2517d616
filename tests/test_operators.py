"""Linking, ranking, sessions, sources and streams on small fixtures."""

from __future__ import annotations

import difflib
import json
import math
import random

from pyspark.sql import functions as F

from dialoom import jobs
from dialoom.functions.similarity import common_subsequence
from dialoom.operators import dialogue as D
from dialoom.operators import linking as L
from dialoom.operators import models as M
from dialoom.operators import recommend as P
from dialoom.operators import ranking as R
from dialoom.operators import session as S
from dialoom.sources import io
from dialoom.streaming.session import run_available


def strings(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(3, 24))).strip() or "x" for _ in range(n)]
    out = list(base)
    for b in base:
        i = rng.randrange(len(b))
        out += [b[:i] + b[i + 1 :], b[:i] + "z" + b[i:], b[:i] + "q" + b[i + 1 :]]
    return sorted({s for s in out if s})


def test_fuzzy_pairs_lose_none(spark):
    left, right = strings(1, 25), strings(1, 25)[::2] + strings(2, 10)
    for cutoff in (0.92, 0.85):
        got = L.fuzzy_pairs(spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string"), cutoff)
        found = {tuple(r) for r in got.select("l", "r").collect()}
        wanted = {(a, b) for a in left for b in right if 2 * common_subsequence(a, b) >= cutoff * (len(a) + len(b))}
        assert wanted <= found


def test_fuzzy_pairs_drops_pairs_of_other_letters_in_the_join(spark):
    l = "abcdefghijklmno"  # noqa: E741
    right = ["abXdefghiYklmno", "abdefghijklmnoc", "abcdefghijklmn", "bcdefghijklmnoé"]  # the first has four unmatched characters
    got = L.fuzzy_pairs(spark.createDataFrame([(l,)], "l string"), spark.createDataFrame([(x,) for x in right], "r string"), 0.92)
    assert {r.r for r in got.collect()} == set(right[1:])


def test_fuzzy_links_the_best_title(spark):
    titles = ["blade runner", "blade runners", "toy story", "the godfather"]
    index = L.title_index(spark.createDataFrame(list(enumerate(titles)), "entity_id long, title string"))
    phrases = ["blade runer", "toy storyy", "godfather", "other thing"]
    rows = spark.createDataFrame([(1, p, i) for i, p in enumerate(phrases)], "conv_id long, phrase string, pos int")
    got = {r["phrase"]: r["key"] for r in L.fuzzy(rows, index, 0.92).collect()}
    assert got == {p: m[0] for p in phrases if (m := difflib.get_close_matches(p, titles, n=3, cutoff=0.92))}


def test_persons(spark):
    names = spark.createDataFrame([("Sigourney Weaver",), ("Sigourny Weaver",), ("Nobody Known",)], "name string")
    entities = spark.createDataFrame([(5, "Sigourney Weaver"), (3, "sigourney weaver"), (9, "Sigourney Weavers")], "entity_id long, label string")
    got = {r["name"]: (r["entity_id"], r["score"]) for r in L.persons(names, entities).collect()}
    assert got["Sigourney Weaver"] == (3, 100.0) and got["Sigourny Weaver"][0] == 3 and "Nobody Known" not in got


def test_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "title string, rank int")
    gold = spark.createDataFrame([(1, "b"), (1, "z"), (2, "y"), (3, "a"), (3, "c")], "i int, title string")
    got = {r["i"]: r for r in R.instance_metrics(R.matches(gold, ranked, ["i"]), ["i"], (1, 3)).collect()}
    assert [got[i]["first_rank"] for i in (1, 2, 3)] == [2, 0, 1]
    assert [got[i]["hit_1"] for i in (1, 2, 3)] == [0, 0, 1] and got[3]["precision_3"] == 2 / 3
    assert math.isclose(got[3]["dcg_3"], 1 + 1 / 2) and got[1]["mrr"] == 0.5
    ideal = spark.range(1).select(R.ideal_gain(F.lit(5), 3)).first()[0]
    assert math.isclose(ideal, sum(1 / math.log2(i + 1) for i in (1, 2, 3)))


def test_fusion(spark):
    base = spark.createDataFrame([(1, i, f"t{i}", i) for i in range(1, 8)], "q int, id int, title string, rank int")
    extra = spark.createDataFrame([(1, 3, "new", 1), (1, 20, "t5", 2), (1, 21, "n1", 3), (1, 22, "n1", 4), (1, 21, "n2", 5), (1, 23, "n3", 6), (1, 24, "n4", 7)], "q int, id int, title string, pos int")
    got = [r["id"] for r in R.fused(base, extra, ["q"], preserved=3, most_extra=2, top_k=6).orderBy("rank").collect()]
    assert got == [1, 2, 3, 21, 23, 4]


def test_samples_round_trip(spark, tmp_path):
    lines = [
        {"conversationId": "1", "initiatorWorkerId": 7, "respondentWorkerId": 8, "messages": [{"senderWorkerId": 7, "text": "like @11 &amp; co"}, {"senderWorkerId": 8, "text": " "}, {"senderWorkerId": 8, "text": "see @12 and @13"}], "movieMentions": {"11": "Jaws", "12": "Alien (1979)", "13": ""}, "respondentQuestions": {"12": {"suggested": 1}, "13": {"suggested": 1}}},
        {"conversationId": "2", "messages": [{"senderWorkerId": 3, "text": "hi"}], "movieMentions": [], "respondentQuestions": []},
    ]
    path = tmp_path / "samples.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)) + "\n{broken\n\n")
    samples, bad = io.read_samples(spark, str(path))
    assert samples.count() == 2 and bad.count() == 1
    messages = D.from_samples(samples)
    dialogue = {r["conv_id"]: r["dialogue"] for r in D.rendered(messages).collect()}
    assert dialogue["1"] == "User: like Jaws & co\nSystem: see Alien (1979) and" and dialogue["2"] == "System: hi"
    assert [tuple(r) for r in D.gold_titles(samples).collect()] == [("1", 2, "alien (1979)")]
    prefix = {(r["conv_id"], r["turn"]): r["prefix"] for r in D.prefixes(messages).collect()}
    assert prefix["1", 2] == "User: like Jaws & co" and prefix["1", 0] == ""


def test_reports_and_caches(spark, tmp_path):
    (tmp_path / "r_1.json").write_bytes(b"\xef\xbb\xbf" + json.dumps({"dataset": "x", "Recall@10": 0.5, "nothing": None}, indent=2).encode())
    (tmp_path / "r_2.json").write_text("{}")
    assert io.latest(spark, f"{tmp_path}/r_*.json").endswith("r_2.json") and io.latest(spark, f"{tmp_path}/none_*") is None
    report = io.read_report(spark, f"{tmp_path}/r_1.json", "dataset STRING, `Recall@10` DOUBLE, nothing DOUBLE")
    assert [tuple(r) for r in io.metrics_long(report, ["dataset"]).collect()] == [("x", "Recall_at_10", 0.5)]
    assert io.read_cache(spark, f"{tmp_path}/absent.json", "id STRING").count() == 0
    rows = spark.createDataFrame([("c1", 1, "m", "g", None)], io.RESPONSE)
    io.write_lines(rows, f"{tmp_path}/out")
    again, bad = io.read_lines(spark, f"{tmp_path}/out", io.RESPONSE)
    assert again.collect() == rows.collect() and bad.count() == 0


def test_human_scores(spark, tmp_path):
    doc = {"scores": [{"id": i, "movie": "m", "fluency": 2, "informativeness": 1 + i % 2, "consistency": 2} for i in range(4)], "averages": {"fluency": 2.0, "informativeness": 1.5, "consistency": 2.0}}
    (tmp_path / "h.json").write_text(json.dumps(doc, indent=1))
    read = io.read_report(spark, f"{tmp_path}/h.json", io.HUMAN_SCORES)
    means = read.select(F.explode("scores").alias("s")).agg(F.avg("s.fluency"), F.avg("s.informativeness"), F.avg("s.consistency")).first()
    assert tuple(means) == tuple(read.select("averages.*").first())


def test_stream_goes_on_from_its_state(spark, table, tmp_path):
    events = table("events")
    middle = events.agg(F.percentile_approx("ts", 0.5)).first()[0]
    run = lambda: run_available(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state")
    for part in (events.where(F.col("ts") <= F.lit(middle)), events.where(F.col("ts") > F.lit(middle))):
        part.write.mode("append").parquet(f"{tmp_path}/in")
        run()
    batch = S.profiles(events, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", F.col("turn").cast("long").alias("turn"), F.array_join("profile", ",").alias("profile"))
    stream = spark.read.parquet(f"{tmp_path}/out")
    assert stream.count() == events.count() and stream.exceptAll(batch).count() == 0


def test_reset_starts_a_new_profile(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "reset"), (1, 4, "b"), (1, 5, None), (1, 6, "a")], "s int, t int, v string")
    parted = S.segments(rows, "s", ["t"], F.coalesce(F.col("v") == "reset", F.lit(False)))
    got = [(r["segment"], r["turn"], r["profile"]) for r in S.profiles(parted, ["s", "segment"], ["t"], "v").orderBy("t").collect()]
    assert got == [(0, 1, ["a"]), (0, 2, ["a", "b"]), (1, 1, ["reset"]), (1, 2, ["reset", "b"]), (1, 3, ["reset", "b"]), (1, 4, ["reset", "b", "a"])]


def sample(cid, said, titles, suggested=1):
    """A conversation whose respondent (2) mentions titles by number."""
    messages = [{"senderWorkerId": 1, "text": "hi"}] + [{"senderWorkerId": 2, "text": t} for t in said]
    return {"conversationId": cid, "initiatorWorkerId": 1, "respondentWorkerId": 2, "messages": messages, "movieMentions": titles, "respondentQuestions": {k: {"suggested": suggested} for k in titles}}


def test_jobs(spark, tmp_path, capsys):
    train = [sample(str(i), ["try @1", "or @2" if i % 2 else "or @1"], {"1": "Jaws (1975)", "2": "Alien"}) for i in range(4)]
    test = [sample("7", ["@3 then"], {"3": "JAWS"}), sample("8", ["@4", "@5 @6"], {"4": "Up", "5": "alien", "6": "Jaws!"}), sample("1", ["none"], {}), sample("9", ["@9"], {"9": "Jaws"}, 0)]
    for name, rows in (("train", train), ("test", test)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    got = jobs.popularity(spark, f"{tmp_path}/train.jsonl", f"{tmp_path}/test.jsonl").first()
    assert (got["instances"], got["conversations"]) == (3, 2)
    assert math.isclose(got["Recall@1"], 2 / 3) and math.isclose(got["MRR"], 2 / 3) and got["MedianGoldRank"] == 1.0 and got["ConvRecall@1"] == 1.0
    answers = [{"conv_id": "7", "turn": 1, "answer": "1. Up\n2. Jaws (1975)"}, {"conv_id": "8", "turn": 1, "answer": ""}, {"conv_id": "8", "turn": 2, "answer": "1. \"Alien\""}]
    (tmp_path / "answers.jsonl").write_text("\n".join(map(json.dumps, answers)))
    got = jobs.zeroshot(spark, f"{tmp_path}/answers.jsonl", f"{tmp_path}/test.jsonl").first()
    assert math.isclose(got["Recall@1"], 1 / 3) and math.isclose(got["Recall@10"], 2 / 3) and math.isclose(got["MRR"], 0.5)
    shared = {(r["split_a"], r["split_b"]): (r["shared"], r["verdict"]) for r in jobs.splits(spark, train=f"{tmp_path}/train.jsonl", test=f"{tmp_path}/test.jsonl").collect()}
    assert shared == {("train", "test"): (1, "FAILED")}
    samples, _ = io.read_samples(spark, f"{tmp_path}/test.jsonl")
    assert [tuple(r) for r in jobs.first_mentions(samples).orderBy("conv_id").collect()] == [("7", 1, "User: hi"), ("8", 1, "User: hi")]
    jobs.main(["popularity", "--train", f"{tmp_path}/train.jsonl", "--test", f"{tmp_path}/absent.jsonl"])
    assert "No file" in capsys.readouterr().out
    jobs.main(["popularity", "--train", f"{tmp_path}/train.jsonl", "--test", f"{tmp_path}/test.jsonl", "--out", f"{tmp_path}/report"])
    assert "Recall_at_1" in {r["metric"] for r in spark.read.json(f"{tmp_path}/report").collect()}


def test_evaluate_with_a_catalogue(spark, tmp_path):
    train = [sample(str(i), ["try @1", "or @2" if i % 2 else "or @1"], {"1": "Jaws (1975)", "2": "Alien"}) for i in range(4)]
    test = [sample("7", ["maybe aliens or jaws?", "@2 then"], {"2": "Aliens"}), sample("8", ["hm @1"], {"1": "Jaws"}), sample("9", ["a horror", "@1"], {"1": "Jaws"})]
    names = {1: "Jaws", 2: "Alien_(film)", 3: "Aliens_(film)", 4: "Horror_film"}
    things = [{"entity_id": i, "uri": f"<http://dbpedia.org/resource/{n}>", "movie": i != 4} for i, n in names.items()]
    for name, rows in (("train", train), ("test", test), ("things", things)):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    means, diagnostics, _ = jobs.evaluate(spark, f"{tmp_path}/train.jsonl", f"{tmp_path}/test.jsonl", catalogue=f"{tmp_path}/things.jsonl", respond=False, rerank=False)
    rows = {r["conversation_id"]: r for r in diagnostics.collect()}
    assert (rows["7"]["gold_rank"], rows["7"]["candidate_count"], rows["7"]["selected_movie"], rows["7"]["selected_candidate_source"]) == (3, 3, "jaws", "SCORER")
    assert rows["7"]["extracted_seeds"] == ["aliens", "jaws"]
    # nothing named: the fixed list; a genre only: the scorer's list
    assert (rows["8"]["selected_candidate_source"], rows["8"]["gold_rank"], rows["8"]["candidate_count"]) == ("FALLBACK", -1, 5)
    assert (rows["9"]["gold_rank"], rows["9"]["candidate_count"], rows["9"]["selected_candidate_source"]) == (1, 2, "SCORER")
    got = means.first()
    assert (got["instances"], got["Recall@1"], got["Recall@10"]) == (3, 1 / 3, 2 / 3)


def test_evaluate(spark, tmp_path):
    train = [sample(str(i), ["try @1", "or @2" if i % 2 else "or @1"], {"1": "Jaws (1975)", "2": "Alien"}) for i in range(4)] + [sample("x", ["see @5"], {"5": "Up"})]
    test = [sample("7", ["maybe alien?", "@2 then"], {"2": "ALIEN"}), sample("8", ["@9"], {"9": "Nowhere"}), sample("9", ["@1"], {"1": "Jaws"}, 0)]
    for name, rows in (("train", train), ("test", test), ("facts", [{"title": "Jaws", "genre": "Thriller", "decade": "1970s"}])):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    paths = (spark, f"{tmp_path}/train.jsonl", f"{tmp_path}/test.jsonl")
    means, diagnostics, responses = jobs.evaluate(*paths, metadata=f"{tmp_path}/facts.jsonl")
    got = means.first()
    # the lists are jaws, alien, up; the stand-in picks the first
    assert (got["instances"], got["conversations"], got["Recall@1"], got["Recall@10"], got["MRR"], got["RerankHit@1"], got["reranker_fallbacks"]) == (2, 2, 0.0, 0.5, 0.25, 0.0, 0)
    assert math.isclose(got["NDCG@10"], 0.5 / math.log2(3)) and got["MeanLength"] > 5 and got["Distinct-2"] == 0.5
    assert [got[c] for c in ("BLEU", "ROUGE-1", "ROUGE-2", "ROUGE-L")] == [0.0] * 4  # no word of the references is in the responses
    rows = {r["conversation_id"]: r for r in diagnostics.collect()}
    assert (rows["7"]["gold_rank"], rows["7"]["extracted_seeds"], rows["7"]["gold_in_top_1"], rows["8"]["gold_rank"], rows["8"]["candidate_count"]) == (2, ["alien"], False, -1, 3)
    assert "from the 1970s" in responses.first()["generated_response"]
    second = jobs.evaluate(*paths, respond=False, model=lambda ps: ["ANSWER: 2" if "alien?" in p else "?" for p in ps])[0].first()
    assert (second["RerankHit@1"], second["reranker_fallbacks"]) == (0.5, 1)
    (tmp_path / "none.jsonl").write_text("")
    empty = jobs.evaluate(spark, f"{tmp_path}/none.jsonl", f"{tmp_path}/test.jsonl")
    assert {r["selected_movie"] for r in empty[1].collect()} == {"Unknown"} and empty[0].first()["Recall@50"] == 0.0
    jobs.main(["evaluate", "--train", f"{tmp_path}/train.jsonl", "--test", f"{tmp_path}/test.jsonl", "--max-samples", "1", "--skip-reranker", "--disable-fusion", "--recommendation-only", "--out", f"{tmp_path}/r", "--save-error-analysis", f"{tmp_path}/e", "--save-responses", f"{tmp_path}/s"])
    written = {r["metric"]: r["value"] for r in spark.read.json(f"{tmp_path}/r").collect()}
    assert "NDCG_at_10" in written and "MeanLength" not in written and "BLEU" not in written and written["instances"] == 1
    assert spark.read.json(f"{tmp_path}/e").first()["skip_reranker"] and not io.exists(spark, f"{tmp_path}/s")


def test_fused_list(spark):
    row = spark.range(1).select(P.fused_list(F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, "bxyz")), 2, 2, 5).alias("l")).first()
    assert row["l"] == ["a", "b", "x", "y", "c"]


def test_models_and_their_fallbacks(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "q int, prompt string")
    lists = spark.createDataFrame([(q, r, f"t{q}{r}") for q in (1, 2, 3) for r in (1, 2)], "q int, rank int, title string")
    model = lambda ps: [{"a": "ANSWER: 2", "b": "ANSWER: 9", "c": "no idea", "d": "ANSWER: 1"}[p] for p in ps]
    got = {r["q"]: (r["title"], r["is_fallback"]) for r in M.chosen(M.answered(prompts, model), lists, "q").collect()}
    assert got == {1: ("t12", False), 2: ("t21", True), 3: ("t31", True), 4: ("Unknown", True)}

    def broken(ps):
        raise OSError

    assert {r["answer"] for r in M.answered(prompts, broken).collect()} == {None}
    assert {r["answer"] for r in M.answered(prompts, None).collect()} == {"ANSWER: 1"}
    rows = spark.createDataFrame([("T", "Horror", "1980s", " hi "), ("T", "", "", "  "), ("T", None, None, None)], "title string, genre string, decade string, answer string")
    assert [r["response"] for r in M.responses(rows).collect()] == ["hi"] + ["I would recommend T. I think it fits well with what you described."] * 2
    prompt = spark.range(1).select(M.rerank_prompt(F.lit("User: x"), F.lit("1. t"), F.array(F.lit("1980s")), F.array(F.lit("Up")))).first()[0]
    assert "Up" in prompt and "1980s" in prompt and prompt.endswith("1. t") and M.fallback_list(spark, 3).count() == 3
