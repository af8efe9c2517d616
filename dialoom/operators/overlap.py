"""How much of a reference text a response has: ROUGE and BLEU of many pairs in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.similarity import bleu4, rouge_l
from ..functions.stem import stems


def rouge(pairs: DataFrame, keys: list[str], sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """keys, rouge_n for each n of sizes: F-measures of the runs of n words that ref and hyp (word arrays, one row for
    each combination of keys) share, each as often as in the one that has it less often; 0 without any."""
    side = lambda c, n: F.transform(T.ngrams(F.col(c), n), lambda g: F.struct(F.lit(n).alias("n"), F.lit(c).alias("side"), g.alias("g")))
    grams = pairs.select(*keys, F.explode(F.concat(*[side(c, n) for c in ("hyp", "ref") for n in sizes])).alias("s")).select(*keys, "s.*")
    per = grams.groupBy(*keys, "n", "g").agg(F.count_if(F.col("side") == "hyp").alias("h"), F.count_if(F.col("side") == "ref").alias("r"))
    share = per.groupBy(*keys, "n").agg((F.lit(2.0) * F.sum(F.least("h", "r")) / F.sum(F.col("h") + F.col("r"))).alias("f"))
    found = share.groupBy(*keys).agg(*[F.max(F.when(F.col("n") == n, F.col("f"))).alias(f"f{n}") for n in sizes])
    return pairs.select(*keys).join(found, keys, "left").select(*keys, *[F.coalesce(f"f{n}", F.lit(0.0)).alias(f"rouge_{n}") for n in sizes])


def text_scores(pairs: DataFrame, keys: list[str], *, stemmed: bool = True) -> DataFrame:
    """One row: means of BLEU on words, and of ROUGE-1, -2 and -L on their stems, over pairs (keys, reference_response,
    generated_response), of which a null is an empty text. Null without pairs."""
    words = pairs.select(*keys, *[T.tokens(F.coalesce(F.col(c), F.lit(""))).alias(n) for c, n in (("reference_response", "ref"), ("generated_response", "hyp"))])
    roots = words.withColumns({c: stems(c) for c in ("ref", "hyp")}) if stemmed else words
    counted = rouge(roots, keys).agg(F.avg("rouge_1").alias("ROUGE-1"), F.avg("rouge_2").alias("ROUGE-2"))
    return words.agg(F.avg(bleu4("ref", "hyp")).alias("BLEU")).join(counted).join(roots.agg(F.avg(rouge_l("ref", "hyp")).alias("ROUGE-L")))
