"""Queries give a row for everything they are asked, also beyond the sizes at which they are held against SQL."""

from __future__ import annotations

import pytest

from dialoom.operators import linking as L
from dialoom.plans import QUERIES

NAMES = ("red ring", "red", "Red Ring", "blue plate", "blue", "old bolt", None)


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Saves rows (key, name, size) as the part table of a folder."""

    def save(rows):
        path = str(tmp_path_factory.mktemp("part"))
        schema = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
        spark.createDataFrame([(k, name, "Brand#1", "SMALL", size, 10.0 + k) for k, name, size in rows], schema).write.parquet(f"{path}/part.parquet")
        return path

    return save


def test_metadata_ranked_match(spark, parts):
    rows = [(k, NAMES[k % 7], k * 5 % 23) for k in range(120)]
    got = {r.p_partkey: r for r in QUERIES["metadata_ranked_match"](spark, parts(rows)).collect()}
    assert sorted(got) == list(range(120))
    for k, name, _ in rows:
        if name is None:
            assert got[k].title is None and got[k].m_title is None and got[k].tier is None
            continue
        first = name.split(" ")[0]
        title = name if k % 3 == 0 else first if k % 3 == 1 else f"{first} zzz"
        tier = lambda m: 1 if m.lower() == title.lower() else 2 if m.lower() in title.lower() or title.lower() in m.lower() else 3  # noqa: E731, B023
        hits = [(tier(m), pos, m, f"{(1920 + size * 2) // 10 * 10}s", 10.0 + pos) for pos, m, size in rows if m and m.lower().split(" ")[0] == first.lower() and size * 3 > 10]
        best = min(hits)
        assert (got[k].title, got[k].tier, got[k].m_title, got[k].decade, got[k].rating) == (title, best[0], *best[2:])


def test_every_part_is_in_a_list_of_ten(spark, parts):
    n = 4_321
    path = parts([(k, f"title {k}", 1) for k in range(n)])
    for name in ("candidate_serialise", "response_template", "follow_up_text"):
        assert sorted(r.p_partkey for r in QUERIES[name](spark, path).select("p_partkey").collect()) == list(range(n)), name
    ranks = [int(r.line_1.split(".")[0]) for r in QUERIES["candidate_serialise"](spark, path).collect()]
    assert min(ranks) == 1 and max(ranks) == 10
    shown = [title for r in QUERIES["recommendation_payload"](spark, path).collect() for title in r.top_5.split("|")]
    assert len(shown) == len(set(shown)) == sum(k % 10 < 5 for k in range(n))
    assert QUERIES["selected_rank_top5"](spark, path).count() == 433


def test_dialogues_are_dealt_to_all_lists(spark, parts):
    path = parts([(k, f"title {k}", 1) for k in range(4_100)])
    said = [(c, 0, "user", "hello") for c in range(700)]
    spark.createDataFrame(said, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    got = {r.conv_id: int(r.selected.split(" ")[1]) for r in QUERIES["rerank_stub"](spark, path).collect()}
    assert sorted(got) == list(range(700))
    assert all(k // 10 == c % 410 for c, k in got.items())


def test_names_between_85_and_96_are_linked(spark, tmp_path):
    known = [(1, "Abcdefg"), (2, "Customer#000000002"), (3, "Abcdefgh ijk"), (4, "zzz")]
    spark.createDataFrame(known, "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.name: (r.entity_id, round(r.score, 1)) for r in QUERIES["person_fuzzy_link"](spark, str(tmp_path)).collect()}
    # 6 of 7 and 11 of 12 letters: 92.3 and 95.7
    assert got == {"Abcefg": (1, 92.3), "Cusomer#000000002": (2, 97.1), "Abcefgh ijk": (3, 95.7), "zzz": (4, 100.0)}
    labels = spark.createDataFrame(known, "entity_id long, label string")
    names = spark.createDataFrame([("Customer#000000011",), ("Abcdefg",), ("qqq",)], "name string")
    assert {r.name: r.entity_id for r in L.persons(names, labels).collect()} == {"Customer#000000011": 2, "Abcdefg": 1}


def test_gold_titles(spark, tmp_path):
    texts = [(1, " " * 25 + "A Title"), (2, "The Long Title Of A Film That Goes On"), (3, " "), (4, "Other")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.title for r in QUERIES["gold_titles"](spark, str(tmp_path)).collect()}
    assert got == {1: "a title", 2: "the long title of a film that goes on"}


def _sent(df):
    """The broadcasts of df's plan before it runs and, as run, after it."""
    plan = df._jdf.queryExecution().executedPlan()
    before = plan.toString()
    rows = df.collect()
    return before.count("BroadcastExchange") + plan.toString().count("BroadcastExchange"), rows


def test_pieces_of_strings_are_not_sent_through_the_driver(spark, tmp_path):
    spark.createDataFrame([(k, f"title number {k}") for k in range(60)], "entity_id long, key string").write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    said = spark.createDataFrame([(1, f"titel number {k}") for k in range(60)], "conv_id long, phrase string")
    broadcasts, rows = _sent(L.fuzzy_pairs(index.select(index.key.alias("l")), said.select(said.phrase.alias("r")), 0.92))
    assert not broadcasts and {(f"title number {k}", f"titel number {k}") for k in range(60)} <= {(r.l, r.r) for r in rows}
    broadcasts, rows = _sent(L.fuzzy(said, index, 0.92))
    assert not broadcasts and {r.phrase: r.entity_id for r in rows}["titel number 17"] == 17 and len(rows) == 60


def test_names_are_not_sent_through_the_driver(spark, tmp_path):
    spark.createDataFrame([(k, f"Customer#{k:09d}") for k in range(60)], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    broadcasts, rows = _sent(QUERIES["person_fuzzy_link"](spark, str(tmp_path)))
    assert not broadcasts and {r.name: r.entity_id for r in rows} == {f"Cusomer#{k:09d}": k for k in range(60)}


def test_phrases_of_dialogues_meet_titles_by_shuffle(spark):
    said = spark.createDataFrame([(1, "jaws", 0), (1, "big city", 1), (1, "so what", 2)], "conv_id long, phrase string, pos int")
    index = spark.createDataFrame([("jaws", 3)], "key string, entity_id long")
    resources = spark.createDataFrame([("<http://dbpedia.org/resource/Big_City>", 4)], "uri string, entity_id long")
    broadcasts, rows = _sent(L.cascade(said, index, resources))
    assert not broadcasts and {r.phrase: (r.entity_id, r.stage) for r in rows} == {"jaws": (3, "title"), "big city": (4, "resource"), "so what": (None, "none")}
