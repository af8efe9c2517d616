"""The chain from dialogue to candidates against plain Python on a small catalogue."""

from __future__ import annotations

from difflib import get_close_matches

from pyspark.sql import functions as F

from dialoom.functions import vocab
from dialoom.operators import linking as L
from dialoom.operators import recommend as P

TITLES = {1: "Blade Runner", 2: "The Big Short", 3: "Jaws", 4: "Alien", 5: "Alien", 6: "Terminator", 7: "Paddington Bear", 8: "12", 9: "List of films"}
URIS = {f"<http://dbpedia.org/resource/{t.replace(' ', '_')}>": i for i, t in TITLES.items()} | {"<http://dbpedia.org/resource/Horror_film>": 50, "<http://dbpedia.org/resource/Big_City>": 60, "<http://dbpedia.org/resource/Tom_Hanks>": 70}
SAID = {
    10: "User: I saw blade runer and the big short\nSystem: ok\nUser: Big City was a scary horror",
    11: "User: hello there",
    12: "User: a film called jaws with Tom Hank\nSystem: alien\nUser: paddingtonn bear please",
}


def frames(spark):
    said = spark.createDataFrame(list(SAID.items()), "conv_id long, dialogue string")
    index = L.title_index(spark.createDataFrame(list(TITLES.items()), "entity_id long, title string"))
    return said, index, spark.createDataFrame(list(URIS.items()), "uri string, entity_id long")


def test_linked(spark):
    said, index, resources = frames(spark)
    names = spark.createDataFrame([(12, "Tom Hank"), (11, "Nobody")], "conv_id long, name string")
    seeds, noise = L.linked(said, index, resources, names, resources.select("entity_id", F.regexp_extract("uri", "resource/(.+)>", 1).alias("label")).withColumn("label", F.replace("label", F.lit("_"), F.lit(" "))))
    got = {(r.conv_id, r.entity_id): (r.stage, r.phrase) for r in seeds.collect()}
    keys = [t.lower() for t in TITLES.values()]
    assert get_close_matches("blade runer", keys, n=3, cutoff=0.92) == ["blade runner"]
    assert got == {
        (10, 1): ("fuzzy", "blade runer"), (10, 2): ("title", "the big short"), (10, 60): ("resource", "big city"), (10, 50): ("genre", "<http://dbpedia.org/resource/Horror_film>"),
        (12, 3): ("title", "jaws"), (12, 5): ("title", "alien"), (12, 7): ("fuzzy", "paddingtonn bear"), (12, 70): ("person", "Tom Hank"),
    }
    assert {r.phrase for r in noise.where("conv_id = 10").collect()} >= {"i"}


def test_tagged(spark):
    said = spark.createDataFrame([("a", "with Tom Hank"), ("b", None), ("c", "none")], "conv_id string, dialogue string")

    def tagger(texts):
        return [["Tom Hank", "Tom Hank", " "] if "Tom" in t else None if t else [] for t in texts]

    assert [tuple(r) for r in L.tagged(said, tagger).collect()] == [("a", "Tom Hank")]
    _, index, resources = frames(spark)
    labels = spark.createDataFrame([(70, "Tom Hanks")], "entity_id long, label string")
    seeds, _ = L.linked(said, index, resources, L.tagged(said, tagger), labels)
    assert [(r.conv_id, r.entity_id, r.stage) for r in seeds.collect()] == [("a", 70, "person")]


def test_resolved(spark):
    _, index, _ = frames(spark)
    asked = [(1, 0, "Jaws!"), (1, 1, "Terminater"), (1, 2, "Nothing like it"), (2, 0, "The Big Shorts"), (2, 1, "")]
    got = {(r.conv_id, r.place): r.entity_id for r in L.resolved(spark.createDataFrame(asked, "conv_id long, place int, title string"), index).collect()}
    keys = [t.lower() for t in TITLES.values()]
    assert get_close_matches("terminater", keys, n=1, cutoff=0.85) == ["terminator"] and not get_close_matches("nothing like it", keys, n=1, cutoff=0.85)
    assert got == {(1, 0): 3, (1, 1): 6, (2, 0): 2}


def test_retrieve(spark):
    said, index, resources = frames(spark)
    said = said.unionByName(spark.createDataFrame([(13, "User: zzz"), (14, "User: jaws")], said.schema))
    seeds, _ = L.linked(said, index, resources)
    scored = spark.createDataFrame([(c, e, -float(e)) for c in (10, 11, 12, 13) for e in (1, 6, 8, 9, 50, 5)], "conv_id long, entity_id long, score double")
    movies = spark.createDataFrame([(e,) for e in TITLES], "entity_id long")
    catalogue = resources.select("entity_id", "uri")

    def model(prompts):
        assert all("10" not in p for p in prompts)
        return ["Terminater\n\n Jaws \nThe Big Short\nAlien" if "hello" in p or "jaws" in p else "" for p in prompts]

    lists = {}
    for r in P.retrieve(said, seeds, scored, index, catalogue, movies, model, preserved=1, top_k=4).orderBy("conv_id", "rank").collect():
        lists.setdefault(r.conv_id, []).append((r.id, r.source))
    # 8 and 9 have no title that may be shown, 50 is no movie
    assert lists[10] == [(1, "SCORER"), (2, "SEED_FUSION"), (5, "SCORER"), (6, "SCORER")]
    assert lists[11] == [(1, "SCORER"), (3, "MODEL_FUSION"), (2, "MODEL_FUSION"), (5, "SCORER")]
    assert lists[12] == [(1, "SCORER"), (3, "SEED_FUSION"), (7, "SEED_FUSION"), (2, "MODEL_FUSION")]
    fixed = [(r[0], "FALLBACK") for r in vocab.FALLBACK_LIST[:4]]
    assert lists[13] == fixed and lists[14] == fixed  # no seed; no scored title
    pure = P.retrieve(said, seeds, scored, index, catalogue, movies, model, use_fusion=False, top_k=4).where("conv_id = 12").orderBy("rank").collect()
    assert [r.id for r in pure] == [1, 5, 6]
