"""Similarities that Spark lacks, as Arrow-batched functions."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def common_subsequence(a, b) -> int:
    """The length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        left = diagonal = 0
        for j, y in enumerate(b, 1):
            up = row[j]
            left = diagonal + 1 if x == y else max(left, up)
            diagonal, row[j] = up, left
    return row[-1]


def block_ratio(cutoff: float = 0.0):
    """A function of two string columns: their Ratcliff-Obershelp similarity, 0 to 1, null below cutoff; the first is the
    text compared with, as in close matches. Upper bounds from lengths and letters spare most comparisons."""

    @pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        matcher, now = SequenceMatcher(None, "", ""), None

        def of(x: str | None, y: str | None) -> float | None:
            nonlocal now
            if x is None or y is None:
                return None
            if x != now:
                matcher.set_seq2(x)
                now = x
            matcher.set_seq1(y)
            if cutoff and (matcher.real_quick_ratio() < cutoff or matcher.quick_ratio() < cutoff):
                return None
            got = matcher.ratio()
            return got if got >= cutoff else None

        return pd.Series([of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio


@pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * 2 * longest common subsequence / sum of lengths."""
    return pd.Series([(200.0 * common_subsequence(x, y) / (len(x) + len(y)) if x or y else 100.0) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


@pandas_udf(DoubleType())
def rouge_l(reference: pd.Series, response: pd.Series) -> pd.Series:
    """F-measure of the longest common subsequence of two word arrays."""

    def f(r, s) -> float:
        r, s = list(r), list(s)
        n = common_subsequence(r, s)
        return 2 * n / (len(r) + len(s)) if n else 0.0

    return pd.Series([f(r, s) for r, s in zip(reference, response, strict=True)], dtype="float64")


@pandas_udf(DoubleType())
def bleu4(reference: pd.Series, response: pd.Series) -> pd.Series:
    """Sentence BLEU of order 4 of two word arrays; orders without a match count 0.1 of one."""
    import math

    def score(r, s) -> float:
        r, s = list(r), list(s)
        if not s or not r:
            return 0.0
        logs = []
        for n in range(1, 5):
            mine = Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1))
            theirs = Counter(tuple(r[i : i + n]) for i in range(len(r) - n + 1))
            hit = sum((mine & theirs).values())
            if n == 1 and not hit:
                return 0.0
            logs.append(math.log((hit or 0.1) / max(1, len(s) - n + 1)))
        return math.exp(sum(logs) / 4 + min(0.0, 1 - len(r) / len(s)))

    return pd.Series([score(r, s) for r, s in zip(reference, response, strict=True)], dtype="float64")
