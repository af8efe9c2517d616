"""Porter's suffix stripping (1980) with the later rules of the stemmer that ROUGE scores are usually taken with."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType

# fixed values: words with a stem of their own
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "inning": "inning", "innings": "inning", "outing": "outing",
    "outings": "outing", "canning": "canning", "cannings": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# fixed values: suffixes of the second, third and fourth step and what stands for them
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "fulli": "ful", "logi": "log",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def shape(word: str) -> str:
    """v or c for each letter; y is a consonant at the start and after a vowel."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def measure(word: str) -> int:
    """How often a consonant follows a vowel."""
    return shape(word).count("vc")


def short_end(word: str) -> bool:
    s = shape(word)
    return (s[-3:] == "cvc" and word[-1] not in "wxy") or s == "vc"


def longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def plural(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def past(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) else w
    end = longest(w, ("ed", "ing"))
    if end is None or "v" not in shape(w[: -len(end)]):
        return w
    w = w[: -len(end)]
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if w[-1] == w[-2:-1] and shape(w)[-1] == "c":
        return w if w[-1] in "lsz" else w[:-1]
    return w + "e" if measure(w) == 1 and short_end(w) else w


def replaced(w: str, table: dict[str, str]) -> str:
    end = longest(w, table)
    if end is None:
        return w
    head = w[: -len(end)]
    if not measure(head + "l" * (end == "logi")):
        return w
    w = head + table[end]
    return replaced(w, table) if end == "alli" else w


def stripped(w: str) -> str:
    end = longest(w, FOURTH)
    if end is None:
        return w
    head = w[: -len(end)]
    return head if measure(head) > 1 and (end != "ion" or head[-1] in "st") else w


@lru_cache(100_000)
def stem(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters stay."""
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    w = past(plural(word))
    if w.endswith("y") and len(w) > 2 and shape(w)[-2] == "c":
        w = w[:-1] + "i"
    w = stripped(replaced(replaced(w, SECOND), THIRD))
    if w.endswith("e"):
        m = measure(w[:-1])
        w = w[:-1] if m > 1 or (m == 1 and not short_end(w[:-1])) else w
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


@pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    """Arrays of words with each word of more than three letters replaced by its stem; null stays null."""
    return words.map(lambda ws: None if ws is None else [stem(w) if len(w) > 3 else w for w in ws])
