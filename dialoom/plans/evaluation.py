"""Popularity baseline and ranking metrics: items are parts, instances orders, conversations customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking as R
from ..operators.retrieval import nearest
from .registry import Tables, query

SPLIT = "2000-01-01"
KEYS = ["o_orderkey", "o_custkey"]

X = f"""
x AS (SELECT o_orderkey, o_custkey, l_linenumber, o_orderdate < TIMESTAMP '{SPLIT}' AS train, title
      FROM orders JOIN lineitem ON o_orderkey = l_orderkey
      JOIN (SELECT p_partkey, trim(lower(regexp_replace(regexp_replace(regexp_replace(p_name || ' ' || p_brand, '\\(\\d{{4}}\\)', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS title FROM part) ON l_partkey = p_partkey),
list AS (SELECT title, n, row_number() OVER (ORDER BY n DESC, f, title) AS rank FROM (SELECT title, count(*) AS n, min((o_orderkey, l_linenumber)) AS f FROM x WHERE train AND title <> '' GROUP BY title ORDER BY n DESC, f, title LIMIT 50)),
gold AS (SELECT o_orderkey, o_custkey, title, count(*) AS copies FROM x WHERE NOT train GROUP BY ALL),
found AS (SELECT gold.*, rank FROM gold LEFT JOIN list USING (title)),
inst AS (SELECT o_orderkey, o_custkey, count(*) AS n_gold, sum(copies) AS n_copies, coalesce(min(rank), 0) AS first_rank,
                max(coalesce(rank <= 10, false)::INT) AS hit_10, max(coalesce(rank <= 50, false)::INT) AS hit_50,
                count(*) FILTER (rank <= 10) / 10.0::DOUBLE AS precision_10, count(*) FILTER (rank <= 50) / 50.0::DOUBLE AS precision_50,
                coalesce(sum(1 / log2(rank + 1.0::DOUBLE)) FILTER (rank <= 10), 0.0::DOUBLE) AS dcg_10, coalesce(sum(1 / log2(rank + 1.0::DOUBLE)) FILTER (rank <= 50), 0.0::DOUBLE) AS dcg_50
         FROM found GROUP BY o_orderkey, o_custkey)
"""


def interactions(t: Tables) -> DataFrame:
    titled = t.part.select("p_partkey", T.normalised_title(F.concat("p_name", F.lit(" "), "p_brand")).alias("title"))
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber").join(titled, F.col("l_partkey") == F.col("p_partkey"))
    return t.orders.select("o_orderkey", "o_custkey", "o_orderdate").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))


def split(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(train, test) interactions; each reads only its orders."""
    x, cut = interactions(t), F.lit(SPLIT).cast("timestamp")
    return x.where(F.col("o_orderdate") < cut), x.where(F.col("o_orderdate") >= cut)


def ranked(t: Tables, n: int = 50) -> DataFrame:
    return R.popularity(split(t)[0], n, ["o_orderkey", "l_linenumber"])


def found(t: Tables) -> DataFrame:
    return R.matches(split(t)[1], ranked(t), KEYS)


def instances(t: Tables) -> DataFrame:
    return R.instance_metrics(found(t), KEYS, (10, 50))


def mean(c: str, name: str):
    return F.round(F.avg(F.col(c).cast("double")), 6).alias(name)


@query(f"WITH {X} SELECT title, n, rank FROM list")
def popularity_topk(t: Tables) -> DataFrame:
    return ranked(t).select("title", "n", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {X} SELECT count(*) AS instances, round(avg(hit_10), 6) AS hit_10, round(avg(hit_50), 6) AS hit_50, round(avg(precision_50), 6) AS precision_50,
round(avg(CASE WHEN first_rank > 0 THEN 1.0::DOUBLE / first_rank ELSE 0.0::DOUBLE END), 6) AS mrr, round(avg(dcg_10), 6) AS dcg_10,
round(avg(first_rank) FILTER (first_rank > 0), 6) AS mean_rank, median(first_rank::DOUBLE) FILTER (first_rank > 0) AS median_rank FROM inst""")
def popularity_eval(t: Tables) -> DataFrame:
    rank = F.when(F.col("first_rank") > 0, F.col("first_rank").cast("double"))
    return instances(t).agg(F.count("*").alias("instances"), mean("hit_10", "hit_10"), mean("hit_50", "hit_50"), mean("precision_50", "precision_50"), mean("mrr", "mrr"), mean("dcg_10", "dcg_10"), F.round(F.avg(rank), 6).alias("mean_rank"), F.median(rank).alias("median_rank"))


@query(f"""WITH {X} SELECT o_orderkey, n_copies::BIGINT AS n_gold, precision_10, precision_50, round(dcg_10 / list_sum(list_transform(range(1, least(n_copies, 10)::BIGINT + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE))), 6) AS ndcg_10,
round(dcg_50 / list_sum(list_transform(range(1, least(n_copies, 50)::BIGINT + 1), lambda i: 1.0::DOUBLE / log2(i + 1.0::DOUBLE))), 6) AS ndcg_50 FROM inst""")
def precision_ndcg_at_k(t: Tables) -> DataFrame:
    copies = split(t)[1].groupBy("o_orderkey").agg(F.count("*").alias("n_gold"))
    per = instances(t).drop("n_gold").join(copies, "o_orderkey")
    return per.select("o_orderkey", "n_gold", "precision_10", "precision_50", *[F.round(F.col(f"dcg_{k}") / R.ideal_gain(F.col("n_gold"), k), 6).alias(f"ndcg_{k}") for k in (10, 50)])


@query(f"WITH {X} SELECT o_orderkey, first_rank, round(CASE WHEN first_rank > 0 THEN 1.0::DOUBLE / first_rank ELSE 0.0::DOUBLE END, 6) AS mrr FROM inst")
def first_hit_rank(t: Tables) -> DataFrame:
    return instances(t).select("o_orderkey", F.col("first_rank").cast("long").alias("first_rank"), F.round("mrr", 6).alias("mrr"))


@query(f"""WITH {X}, conv AS (SELECT o_custkey, max((first_rank = 1)::INT) AS s1, max(hit_10) AS r10, max(hit_50) AS r50 FROM inst GROUP BY o_custkey)
SELECT count(*) AS conversations, round(avg(s1), 6) AS success_1, round(avg(r10), 6) AS recall_10, round(avg(r50), 6) AS recall_50 FROM conv""")
def conversation_success(t: Tables) -> DataFrame:
    per = instances(t).groupBy("o_custkey").agg(F.max((F.col("first_rank") == 1).cast("int")).alias("s1"), F.max("hit_10").alias("r10"), F.max("hit_50").alias("r50"))
    return per.agg(F.count("*").alias("conversations"), mean("s1", "success_1"), mean("r10", "recall_10"), mean("r50", "recall_50"))


@query(f"""WITH {X}, r AS (SELECT o_custkey, row_number() OVER w AS seq, avg(hit_50) OVER (w ROWS UNBOUNDED PRECEDING) AS a FROM inst WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_custkey, seq, round(a, 6) AS running_recall FROM r WHERE seq % 2 = 0""")
def running_recall(t: Tables) -> DataFrame:
    """Progress of each customer every two instances: a running mean has an order only inside a key at scale."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    run = instances(t).select("o_custkey", F.row_number().over(w).alias("seq"), F.avg("hit_50").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("a"))
    return run.where("seq % 2 = 0").select("o_custkey", F.col("seq").cast("long").alias("seq"), F.round("a", 6).alias("running_recall"))


@query(f"""WITH {X}, s AS (SELECT o_orderkey, coalesce(arg_min(CASE WHEN rank <= 30 THEN 'BASE' ELSE 'TAIL' END, rank), 'NOT_IN_LIST') AS source FROM found GROUP BY o_orderkey)
SELECT source, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percent FROM s GROUP BY source""")
def gold_source_breakdown(t: Tables) -> DataFrame:
    source = F.when(F.col("rank") <= 30, "BASE").when(F.col("rank").isNotNull(), "TAIL")
    per = found(t).groupBy("o_orderkey").agg(F.coalesce(F.min_by(source, "rank"), F.lit("NOT_IN_LIST")).alias("source"))
    return per.groupBy("source").agg(F.count("*").alias("n")).withColumn("percent", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


SUMMARY = {"gold_in_top_10": "hit_10 = 1", "gold_in_top_50": "hit_50 = 1", "not_found": "first_rank = 0", "weak": "n_gold < 2", "weak_and_found": "n_gold < 2 AND first_rank > 0"}


@query(f"WITH {X} SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER ({c}) AS {n}, printf('%.2f%%', 100.0 * count(*) FILTER ({c}) / count(*)) AS {n}_share" for n, c in SUMMARY.items()) + ", sum(n_gold)::BIGINT AS gold_titles FROM inst")
def diagnostics_summary(t: Tables) -> DataFrame:
    cols = [F.count("*").alias("total")]
    for name, cond in SUMMARY.items():
        n = F.count(F.when(F.expr(cond), 1))
        cols += [n.alias(name), F.format_string("%.2f%%", F.when(F.count("*") == 0, F.lit(0.0)).otherwise(F.lit(100.0) * n / F.count("*"))).alias(f"{name}_share")]
    return instances(t).agg(*cols, F.coalesce(F.sum("n_gold"), F.lit(0)).alias("gold_titles"))


@query(f"""WITH {X}, m AS (SELECT avg(hit_10) AS "Recall@10", avg(hit_50) AS "Recall@50", avg(precision_50) AS "Precision@50", avg(first_rank) FILTER (first_rank > 50) AS AvgLateRank FROM inst)
SELECT replace(name, '@', '_at_') AS metric, round(value, 6) AS value FROM (UNPIVOT m ON COLUMNS(*) INTO NAME name VALUE value)""")
def report_metrics_long(t: Tables) -> DataFrame:
    from ..sources.io import metrics_long

    late = F.avg(F.when(F.col("first_rank") > 50, F.col("first_rank")))
    wide = instances(t).agg(F.avg("hit_10").alias("Recall@10"), F.avg("hit_50").alias("Recall@50"), F.avg("precision_50").alias("Precision@50"), late.alias("AvgLateRank"))
    return metrics_long(wide, []).select("metric", F.round("value", 6).alias("value"))


@query("""SELECT s, count(*) AS conversations, min(conv_id) AS first_id FROM (SELECT DISTINCT conv_id, CASE WHEN conv_id % 10 < 8 THEN 'train' WHEN conv_id % 10 = 8 THEN 'valid' ELSE 'test' END AS s FROM conversations) GROUP BY s""")
def split_counts(t: Tables) -> DataFrame:
    s = F.when(F.col("conv_id") % 10 < 8, "train").when(F.col("conv_id") % 10 == 8, "valid").otherwise("test")
    return t.conversations.select("conv_id", s.alias("s")).distinct().groupBy("s").agg(F.count("*").alias("conversations"), F.min("conv_id").alias("first_id"))


@query("""WITH s AS (SELECT DISTINCT conv_id, unnest(CASE WHEN conv_id % 10 = 0 THEN ['train', 'valid'] WHEN conv_id % 10 < 8 THEN ['train'] WHEN conv_id % 10 = 8 THEN ['valid'] ELSE ['test'] END) AS split FROM conversations)
SELECT p.a, p.b, count(x.conv_id) AS shared, CASE WHEN count(x.conv_id) = 0 THEN 'PASSED' ELSE 'FAILED' END AS verdict
FROM (VALUES ('train', 'valid'), ('train', 'test'), ('valid', 'test')) p(a, b) LEFT JOIN (SELECT l.conv_id, l.split AS a, r.split AS b FROM s l JOIN s r ON l.conv_id = r.conv_id) x ON x.a = p.a AND x.b = p.b GROUP BY p.a, p.b""")
def split_overlap(t: Tables) -> DataFrame:
    """Pairwise shared conversation ids of splits, of which train and valid were made to leak."""
    c = F.col("conv_id") % 10
    names = F.when(c == 0, F.array(F.lit("train"), F.lit("valid"))).when(c < 8, F.array(F.lit("train"))).when(c == 8, F.array(F.lit("valid"))).otherwise(F.array(F.lit("test")))
    per = t.conversations.select("conv_id", F.explode(names).alias("s")).distinct().groupBy("conv_id").agg(F.collect_set("s").alias("in_splits"))
    pairs = [("train", "valid"), ("train", "test"), ("valid", "test")]
    both = per.agg(*[F.count(F.when(F.array_contains("in_splits", a) & F.array_contains("in_splits", b), 1)).alias(f"{a}_{b}") for a, b in pairs])
    rows = both.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("shared")) for a, b in pairs])).alias("r")).select("r.*")
    return rows.withColumn("verdict", F.when(F.col("shared") == 0, "PASSED").otherwise("FAILED"))


@query("""SELECT lang, count(*) AS rated, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic, printf('%.2f%%', 100.0 * count(*) FILTER (quality = 1 AND toxic = 0) / count(*)) AS clean_share FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def quality_label_rates(t: Tables) -> DataFrame:
    both = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    clean = F.count(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1))
    return both.groupBy("lang").agg(F.count("*").alias("rated"), mean("quality", "quality"), mean("toxic", "toxic"), F.format_string("%.2f%%", F.lit(100.0) * clean / F.count("*")).alias("clean_share"))


VECTORS = """
q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT query_id, vec_id AS id, 'Item ' || (vec_id % 97) AS title, round(list_sum(list_transform(range(1, 65), lambda i: q.embedding[i]::DOUBLE * e.embedding[i]::DOUBLE)), 6) AS score FROM q, embeddings e WHERE vec_id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM s),
base AS (SELECT query_id, id, title, score, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM r WHERE place <= 200 AND id % 7 <> 3 QUALIFY rank <= 50)
"""


def base_list(t: Tables, k: int = 50) -> DataFrame:
    """For each vector whose id is divisible by 100 the first k valid of the 4 * k best: not the same as the k best of
    the valid ones."""
    best = nearest(t.embeddings.where("vec_id % 100 = 0"), t.embeddings, "vec_id", "embedding", 4 * k).where("id % 7 <> 3")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "id", F.concat(F.lit("Item "), F.col("id") % 97).alias("title"), "score", "rank")


@query(f"WITH {VECTORS} SELECT query_id, id, score, rank FROM base")
def vector_topk(t: Tables) -> DataFrame:
    return base_list(t).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {VECTORS}, extra AS (SELECT query_id, query_id + 13 * pos AS id, 'Item ' || ((query_id + 13 * pos) % 97) AS title, pos FROM (SELECT DISTINCT query_id FROM base) b, range(1, 31) p(pos)),
new AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM (SELECT * FROM extra x WHERE NOT EXISTS (FROM base b WHERE b.query_id = x.query_id AND (b.id = x.id OR b.title = x.title)) QUALIFY row_number() OVER (PARTITION BY query_id, title ORDER BY pos) = 1) QUALIFY n <= 15),
u AS (SELECT query_id, id, title, CASE WHEN rank <= 30 THEN 0 ELSE 2 END AS block, rank AS spot FROM base UNION ALL SELECT query_id, id, title, 1, n FROM new)
SELECT query_id, id, title, block, row_number() OVER (PARTITION BY query_id ORDER BY block, spot) AS rank FROM u QUALIFY rank <= 50""")
def rank_fusion(t: Tables) -> DataFrame:
    """Lists of fifty, of which thirty stay, with up to fifteen of thirty seeds (here: ids after the query's) set in."""
    base = base_list(t).select("query_id", "id", "title", "rank")
    seeds = base.select("query_id").distinct().select("query_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(30).cast("long"))).alias("pos")).withColumn("id", F.col("query_id") + 13 * F.col("pos"))
    extra = seeds.select("query_id", "id", F.concat(F.lit("Item "), F.col("id") % 97).alias("title"), "pos")
    return R.fused(base, extra, ["query_id"], preserved=30, most_extra=15, top_k=50).withColumn("rank", F.col("rank").cast("long"))
