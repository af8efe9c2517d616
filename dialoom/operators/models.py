"""Re-ranking and answering with pluggable models: text in, text out, in Arrow batches, with retries and fallbacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vocab

Model = Callable[[list[str]], list[str]]


def answered(prompts: DataFrame, model: Model | None, prompt: str = "prompt", out: str = "answer", retries: int = 3) -> DataFrame:
    """prompts with the model's answer to each prompt; null where it failed `retries` times. Without a model the
    deterministic stand-in answers inside the JVM."""
    if model is None:
        return prompts.withColumn(out, T.stub_answer(F.col(prompt)))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got: list[str | None] = [None] * len(b)
            for _ in range(retries):
                try:
                    got = list(model(b[prompt].tolist()))
                    break
                except Exception:  # any failure of an outside model counts as one try
                    continue
            yield b.assign(**{out: pd.Series(got, index=b.index, dtype="object")})

    return prompts.mapInPandas(ask, prompts.withColumn(out, F.lit(None).cast("string")).schema)


def chosen(answers: DataFrame, candidates: DataFrame, key: str, answer: str = "answer") -> DataFrame:
    """key, title, is_fallback: the candidate (key, rank, title) whose place the answer names, else the first one; a key
    without candidates is 'Unknown'."""
    sizes = candidates.groupBy(key).agg(F.max("rank").alias("_size"))
    judged = answers.join(sizes, key, "left").withColumn("_n", T.parsed_answer(F.col(answer)))
    good = F.coalesce(F.col("_n").between(1, F.col("_size")), F.lit(False))
    picked = judged.select(key, (~good).alias("is_fallback"), F.when(good, F.col("_n")).otherwise(F.lit(1)).alias("rank"))
    return picked.join(candidates.select(key, "rank", "title"), [key, "rank"], "left").select(key, F.coalesce("title", F.lit("Unknown")).alias("title"), "is_fallback")


def responses(selected: DataFrame, answer: str = "answer") -> DataFrame:
    """selected (title, genre, decade, answer) with response: the trimmed answer, or a plain sentence if it is blank."""
    return selected.withColumn("response", F.coalesce(F.nullif(F.trim(answer), F.lit("")), T.recommendation_sentence(F.col("title"), F.col("genre"), F.col("decade"))))


def rerank_prompt(history: Column, block: Column, decades: Column, previous: Column) -> Column:
    """The prompt of a re-ranking request: rules, wanted eras, the last five lines, numbered candidates. Titles already
    recommended are only named in it, not removed from the list."""
    before = F.when(F.size(previous) > 0, F.concat(F.lit("Already suggested, do not repeat: "), F.array_join(previous, ", "), F.lit("\n"))).otherwise(F.lit(""))
    return F.concat(before, F.lit("Pick the one best candidate for this dialogue. Reply with ANSWER: <number> only.\n"), T.era_section(decades), F.lit("\n[Dialogue History]\n"), T.last_lines(history, 5), F.lit("\n\n[Candidate List]\n"), block)


def fallback_list(spark, top_k: int) -> DataFrame:
    """The fixed list that stands in when nothing can be retrieved."""
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(vocab.FALLBACK_LIST[:top_k])], "rank int, id int, title string, genre string, decade string")
