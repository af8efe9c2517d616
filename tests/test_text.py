"""Scalar functions against plain Python versions."""

from __future__ import annotations

import difflib
import re

import pytest
from pyspark.sql import functions as F

from dialoom.functions import text as T
from dialoom.functions import vocab
from dialoom.functions.similarity import bleu4, block_ratio, common_subsequence, indel_ratio, rouge_l

SAMPLES = ["The Matrix (1999)", "Amélie  (2001) !", "", "   ", "Harold & Kumar", "WALL·E_2", "a\tb\nc", "Ünïcode (12345)", "(2000)(2001) x", "don't-stop"]


def column(spark, values, *cols):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r)[1:] for r in df.select("i", *cols).orderBy("i").collect()]


def test_titles(spark):
    def a(t):
        t = re.sub(r"[^\w\s]", "", re.sub(r"\(\d{4}\)", "", t))
        return re.sub(r"\s+", " ", t).lower().strip()

    def b(t):
        return re.sub(r"[^\w\s]", "", t.lower()).strip(" ")

    got = column(spark, SAMPLES, T.normalised_title(F.col("v")), T.index_key(F.col("v")))
    assert got == [(a(s), b(s)) for s in SAMPLES]


def test_words_and_runs(spark):
    got = column(spark, SAMPLES, T.tokens(F.col("v")), T.ngrams(T.tokens(F.col("v")), 2))
    for s, (words, pairs) in zip(SAMPLES, got):
        w = re.sub(r"[^\w\s]", "", s.lower()).split()
        assert words == w and pairs == [" ".join(w[i : i + 2]) for i in range(len(w) - 1)]


@pytest.mark.parametrize(
    ("uri", "year", "tagged", "title"),
    [
        ("<http://dbpedia.org/resource/It_(2017_film)>", "2017", "2017", "It"),
        ("<http://dbpedia.org/resource/Scream_(1996)>", "1996", "1996", "Scream (1996)"),
        ("<http://dbpedia.org/resource/The_Conjuring>", "", None, "The Conjuring"),
        ("<http://dbpedia.org/resource/The_Notebook_(2004_film)>", "", "2004", "The Notebook"),
        ("<http://dbpedia.org/resource/X_(1885_film)>", "", "1885", "X"),
        ("<http://dbpedia.org/resource/A_1984_b>", "1984", None, "A 1984 b"),
        ("<http://dbpedia.org/resource/A_film_1984_b>", "", None, "A film 1984 b"),
        ("<http://dbpedia.org/resource/Alien_(Film)>", "", None, "Alien"),
        ("plain_text", "", None, "plain text"),
    ],
)
def test_resources(spark, uri, year, tagged, title):
    c = F.col("v")
    assert column(spark, [uri], T.release_year(c), T.tagged_year(c), T.title_of_resource(c)) == [(year, tagged, title)]


def test_decades_and_genres(spark):
    dialogues = ["User: an 80s film\nSystem: from 1994?\nUser: no, the seventies", "User: hi\nSystem: 1984s or 90s\nUser: any", "System: 2003", "User: twenties 20s"]
    assert column(spark, dialogues, T.dialogue_decades(F.col("v"))) == [(["1970s"],), (["1980s", "1990s"],), (["2000s"],), (["1920s"],)]
    messages = ["I want a scary sci-fi War film from the righties", "romantic comedy, romance", "1990s nineties 2020s", ""]
    assert column(spark, messages, T.message_genres(F.col("v")), T.message_decades(F.col("v"))) == [(["Sci-Fi", "Horror", "War"], ["1980s"]), (["Romance", "Comedy"], []), ([], ["1990s", "2020s"]), ([], [])]
    titles = ["Alien (1979)", "Glover", "Spiderwick", "Quiet"]
    assert column(spark, titles, T.inferred_genre(F.lit("x"), F.col("v"))) == [("Sci-Fi",), ("Romance",), ("Action",), ("Unknown",)]


def test_mentions(spark):
    m = F.create_map(F.lit("12"), F.lit("A"), F.lit("1234"), F.lit("B"))
    assert column(spark, ["see @12 @1234", "@x @7"], T.with_mentions(F.col("v"), m), T.mention_ids(F.col("v"))) == [("see A A34", ["12", "1234"]), ("@x @7", ["7"])]
    said = ['I loved "the big short" and watched Blade Runner, or saw it', "nothing here", "The Lord of Rings"]
    got = column(spark, said, T.mentioned_titles(F.col("v")))
    assert got[0][0] == ["The Big Short", "Blade Runner"] and got[1][0] == [] and got[2][0] == ["The Lord of Rings"]
    words = ["2nd ocean-eleven", "o'neil ÉCOLE"]
    assert column(spark, words, T.title_case(F.col("v"))) == [(w.title(),) for w in words]


def test_answers_and_lists(spark):
    assert column(spark, ["ANSWER: 12 x", "answer: 3", "ANSWER:\n7 ANSWER: 8", ""], T.parsed_answer(F.col("v"))) == [(12,), (None,), (7,), (None,)]
    listed = "1. \"Jaws\"\n2) Alien\n\n 3- 'Up'\n4.\nplain"
    assert column(spark, [listed, ""], T.parsed_list(F.col("v"))) == [(["Jaws", "Alien", "Up", "plain"],), ([],)]
    prompts = ["MARVEL old", "a funny horror", "classic", "else"]
    assert column(spark, prompts, T.stub_answer(F.col("v"))) == [("ANSWER: 8",), ("ANSWER: 7",), ("ANSWER: 4",), ("ANSWER: 1",)]


def test_history(spark):
    h = ["a\n\nb", "1\n2\n\n3\n4\n5\n6", ""]
    assert column(spark, h, T.last_lines(F.col("v"), 5)) == [("a\n\nb",), ("2\n3\n4\n5\n6",), ("",)]
    d = ["User: a\nSystem: b", "User: a\nUser: b\nSystem: c", "none"]
    assert column(spark, d, T.last_user_part(F.col("v"))) == [("User: a\nSystem: b",), ("User: b\nSystem: c",), ("none",)]


def test_sentences(spark):
    row = lambda g, d: column(spark, ["T"], T.recommendation_sentence(F.col("v"), F.lit(g), F.lit(d)))[0][0]
    assert row("Horror", "1980s") == "I would recommend T. It is a great film horror from the 1980s that matches what you are looking for."
    assert row("Unknown", "") == "I would recommend T. I think it fits well with what you described."
    assert column(spark, ["<a href='x'>&\"</a>"], T.html_escaped(F.col("v"))) == [("&lt;a href=&#039;x&#039;&gt;&amp;&quot;&lt;/a&gt;",)]
    assert column(spark, ["x&amp;quot;&quot;"], T.unescaped(F.col("v"))) == [('x&quot;"',)]


def test_similarities(spark):
    pairs = [("blade runner", "blade runer"), ("abc", "xyz"), ("same", "same")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", block_ratio()("a", "b").alias("r"), indel_ratio("a", "b").alias("i"))
    for r in df.collect():
        assert r["r"] == difflib.SequenceMatcher(None, r["b"], r["a"]).ratio()
        assert r["i"] == 200 * common_subsequence(r["a"], r["b"]) / (len(r["a"]) + len(r["b"]))
    words = spark.createDataFrame([(["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e"]), (["a", "b"], ["c", "d"]), ([], ["c"])], "r array<string>, h array<string>")
    got = [tuple(x) for x in words.select(bleu4("r", "h"), rouge_l("r", "h")).collect()]
    assert got[0] == pytest.approx((1.0, 1.0)) and got[1] == (0.0, 0.0) and got[2] == (0.0, 0.0)


def test_vocabularies_are_whole():
    assert len(vocab.PHRASE_BLOCKLIST) == 68 and len(vocab.DIALOGUE_DECADES) == 18 and len(vocab.METADATA_GENRES) == 19
