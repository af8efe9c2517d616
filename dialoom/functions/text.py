"""Scalar functions on text columns; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

PUNCTUATION = r"[^\p{L}\p{N}_\s]"


def normalised_title(c: Column) -> Column:
    """The key titles are compared by in metrics: no (year), no punctuation, single blanks, lower case."""
    bare = F.regexp_replace(F.regexp_replace(c, r"\(\d{4}\)", ""), PUNCTUATION, "")
    return F.trim(F.lower(F.regexp_replace(bare, r"\s+", " ")))


def index_key(c: Column) -> Column:
    """The key of the title index: lower case without punctuation; blanks and years stay."""
    return F.trim(F.regexp_replace(F.lower(c), PUNCTUATION, ""))


def tokens(c: Column) -> Column:
    """Words of lower-cased text without punctuation; [] for blank text."""
    return F.filter(F.split(F.regexp_replace(F.lower(c), PUNCTUATION, ""), r"\s+"), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, joined by a blank; [] if there are fewer."""
    runs = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
    return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))


def unescaped(c: Column) -> Column:
    """Only &quot; and &amp;, in that order."""
    return F.replace(F.replace(c, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))


def mention_ids(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"@(\d+)"), F.lit(1))


def with_mentions(c: Column, mentions: Column) -> Column:
    """Each @id of the map mentions (id -> title) replaced, in the map's order, wherever the characters occur."""
    return F.aggregate(F.map_entries(mentions), c, lambda t, e: F.replace(t, F.concat(F.lit("@"), e["key"]), e["value"]))


def title_of_resource(uri: Column) -> Column:
    inner = F.regexp_extract(uri, r"(?s)resource/(.+)>", 1)
    title = F.replace(F.when(inner != "", inner).otherwise(uri), F.lit("_"), F.lit(" "))
    return F.trim(F.regexp_replace(F.regexp_replace(title, r"(?i)\s*\(film\)", ""), r"(?i)\s*\(\d{4} film\)", ""))


def resource_of(phrase: Column) -> Column:
    """The resource a phrase would have: its words capitalised and joined."""
    words = F.transform(F.split(phrase, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 20))))
    return F.concat(F.lit("<http://dbpedia.org/resource/"), F.array_join(words, "_"), F.lit(">"))


def tagged_year(uri: Column) -> Column:
    """The year of _(dddd_film), else of _(dddd), else null."""
    found = lambda p: F.nullif(F.regexp_extract(uri, p, 1), F.lit(""))
    return F.coalesce(found(r"_\((\d{4})_film\)"), found(r"_\((\d{4})\)"))


def release_year(text: Column) -> Column:
    """The year of release, '' if there is none from 1900 to 2030, or the text names a novel, book or character."""
    year = r"(18[8-9]\d|19\d{2}|20[0-2]\d|2030)"
    low = F.lower(text)
    strict = F.regexp_extract(text, rf"(?i)\({year}_film\)", 1)
    loose = F.coalesce(F.nullif(F.regexp_extract(text, rf"\({year}\)", 1), F.lit("")), F.regexp_extract(text, rf"_{year}_", 1))
    found = F.when(F.contains(low, F.lit("_film")), strict).otherwise(loose)
    other = F.contains(low, F.lit("novel")) | F.contains(low, F.lit("book")) | F.contains(low, F.lit("character"))
    return F.when(~other & (found >= "1900"), found).otherwise(F.lit(""))


def decade_of(year: Column) -> Column:
    return F.when(F.coalesce(year, F.lit("")) == "", F.lit("Unknown")).otherwise(F.concat(F.substring(year, 1, 3), F.lit("0s")))


def is_title(title: Column) -> Column:
    low = F.lower(title)
    bad = F.startswith(low, F.lit("list of ")) | F.startswith(low, F.lit("category: ")) | low.isin(vocab.TITLE_BLOCKLIST)
    for part in ("(film series)", "(tv series)", "(franchise)"):
        bad = bad | F.contains(low, F.lit(part))
    return ~bad


def is_candidate(title: Column) -> Column:
    """A title that may be shown: valid, two characters at least, not only digits."""
    return is_title(title) & (F.length(title) >= 2) & ~F.rlike(title, F.lit(r"^\d+$"))


def inferred_genre(uri: Column, title: Column) -> Column:
    """The genre of a known title, else the first whose keyword occurs in resource or title, else Unknown."""
    known = F.create_map(*[F.lit(x) for kv in vocab.TITLE_GENRES.items() for x in kv])
    bare = F.trim(F.regexp_replace(F.lower(title), r"\s*\(\d{4}\)", ""))
    both = F.lower(F.concat(uri, F.lit(" "), title))
    return F.coalesce(known[bare], first_match([("|".join(words), genre) for genre, words in vocab.GENRE_KEYWORDS.items()], both), F.lit("Unknown"))


def first_match(rules: Iterable[tuple[str, object]], c: Column) -> Column:
    """The value of the first rule whose pattern is found in c, else null."""
    return F.coalesce(*[F.when(F.rlike(c, F.lit(p)), F.lit(v)) for p, v in rules])


def all_matches(rules: Iterable[tuple[str, str]], c: Column) -> Column:
    """The values of all rules whose pattern is found in c, in order."""
    return F.filter(F.array(*[F.when(F.rlike(c, F.lit(p)), F.lit(v)) for p, v in rules]), lambda x: x.isNotNull())


def last_user_part(dialogue: Column) -> Column:
    """From the last 'User: ' to the end; the whole dialogue if there is none."""
    return F.when(F.contains(dialogue, F.lit("User: ")), F.concat(F.lit("User: "), F.substring_index(dialogue, "User: ", -1))).otherwise(dialogue)


def dialogue_decades(dialogue: Column) -> Column:
    """Decades of the last user part if it names any, else of the whole dialogue."""
    last = all_matches(vocab.DIALOGUE_DECADES, F.lower(last_user_part(dialogue)))
    return F.when(F.size(last) > 0, last).otherwise(all_matches(vocab.DIALOGUE_DECADES, F.lower(dialogue)))


def message_decades(c: Column) -> Column:
    return all_matches(vocab.PROFILE_DECADES, F.lower(c))


def message_genres(c: Column) -> Column:
    """Genres of a chat message, in the order first seen; science fiction phrases first."""
    low = F.lower(c)
    known = F.create_map(*[F.lit(x) for kv in vocab.PROFILE_GENRES.items() for x in kv])
    phrase = F.filter(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit("Sci-Fi")) for p in vocab.PROFILE_GENRE_PHRASES]), lambda x: x.isNotNull())
    words = F.filter(F.transform(F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_'-]+"), F.lit(0)), lambda w: known[w]), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(phrase, words))


def mentioned_titles(c: Column) -> Column:
    """Titles in a chat message: quoted, after a verb of watching, or runs of capitalised words, in this order."""
    # fixed values: the three patterns
    patterns = (
        (r'''["“”‘’]([^"']{3,60})["“”‘’]''', 1),
        (r"\b(?:like|loved?|watch(?:ed)?|seen|saw|enjoy(?:ed)?|similar to|such as|films? like|movies? like)\s+([A-Z][A-Za-z0-9 :'!&\-]{1,50}?)(?=[,\.!?\n]|$|\s+(?:and|but|or|which|because)\b)", 1),
        (r"\b([A-Z][a-z0-9]*(?:\s+(?:[a-z]{1,3}\s+)?[A-Z][a-z0-9]*)+)\b", 1),
    )
    quoted, after, capital = (F.transform(F.regexp_extract_all(c, F.lit(p), F.lit(g)), F.trim) for p, g in patterns)
    long = lambda a: F.filter(a, lambda t: F.length(t) > 2)
    return F.array_distinct(F.concat(F.transform(quoted, title_case), long(after), long(capital)))


def title_case(c: Column) -> Column:
    """Every run of letters with its first letter in upper case and the rest in lower case."""
    parts = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20)))), "")


def last_lines(history: Column, n: int) -> Column:
    """The last n lines that aren't blank; the history as it is if it has no more than n."""
    lines = F.filter(F.split(F.trim(history), "\n"), lambda x: F.trim(x) != "")
    return F.when(F.size(lines) > n, F.array_join(F.slice(lines, F.greatest(F.size(lines) - (n - 1), F.lit(1)), F.lit(n)), "\n")).otherwise(history)


def parsed_answer(c: Column) -> Column:
    """The number of the first 'ANSWER: n', else null."""
    return F.nullif(F.regexp_extract(c, r"ANSWER:\s*(\d+)", 1), F.lit("")).cast("int")


def parsed_list(c: Column, most: int = 10) -> Column:
    """The entries of a numbered list, without numbers and one quote at either end, blanks dropped."""
    lines = F.transform(F.split(F.trim(c), "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\d+[.)\-*]*\s*", "")))
    return F.slice(F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^[\"']|[\"']$", "")), lambda x: x != ""), 1, most)


def shown(c: Column) -> Column:
    """null for null, blank and 'Unknown'."""
    return F.when((c != "") & (c != "Unknown"), c)


def candidate_line(position: Column, title: Column, year: Column, genre: Column, decade: Column, director: Column, shape: int) -> Column:
    """One line of a re-ranking prompt: title; with year from shape 2, genre and decade from 3, director from 4."""
    head = title if shape == 1 else F.when(F.coalesce(year, F.lit("")) != "", F.concat(title, F.lit(" ("), year, F.lit(")"))).otherwise(title)
    parts = [head, *([shown(genre), shown(decade)] if shape >= 3 else []), *([shown(director)] if shape >= 4 else [])]
    return F.concat(position.cast("string"), F.lit(". "), F.concat_ws(" | ", *parts))


def era_section(decades: Column) -> Column:
    # fixed value: the wording of the section
    return F.when(F.size(decades) > 0, F.concat(F.lit("\nDetected user era preference: "), F.array_join(decades, ", "), F.lit(". Strongly prefer candidates from this era.\n"))).otherwise(F.lit(""))


def stub_answer(prompt: Column) -> Column:
    """What the deterministic stand-in for a model answers to a prompt."""
    return F.concat(F.lit("ANSWER: "), F.coalesce(first_match([("|".join(words), n) for words, n in vocab.STUB_RULES], F.lower(prompt)), F.lit(1)).cast("string"))


def recommendation_sentence(title: Column, genre: Column, decade: Column) -> Column:
    # fixed values: the wording of both sentences
    about = F.concat_ws(" ", F.lower(shown(genre)), F.concat(F.lit("from the "), shown(decade)))
    plain = F.concat(F.lit("I would recommend "), title, F.lit(". I think it fits well with what you described."))
    return F.when(about != "", F.concat(F.lit("I would recommend "), title, F.lit(". It is a great film "), about, F.lit(" that matches what you are looking for."))).otherwise(plain)


def html_escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c
