r"""Secret scans with corpus-wide ownership frequency, with DataFrame operations only.

Candidates come from three fixed patterns (assign, access, hex) and a fourth, looser one: runs of 24 or more key
characters with lower and upper case letters and digits, outside the others' spans. The hash of each candidate's value
is counted over the corpus by distinct owners and repositories. A value that at least `example_owners` owners hold, or
`example_repos` repositories of any owners, is a widely copied example; any other is owner-specific and looks live. Loose candidates become spans (kind
`owned`) only if they are owner-specific; spans of the three patterns always stay and are split into live and example.

Positions are code points, ends exclusive. A pattern's matches are found by splitting the text at them: the lengths of
the parts before a match add up to its start.

Null texts are empty; a null owner is an owner of its own; repeated rows are scanned each, and count once for a
repository. Empty tables give empty results. Extra columns are ignored by `scan` and kept by `redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import counted_lookup, stored, unused

#: Kinds in their order, pattern, group that holds the value, least length of that group.
KINDS = (
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)(?-i)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
LOOSE = ("owned", r"[A-Za-z0-9+/_=-]{24,}", 0, 24)
NAMES = [k[0] for k in (*KINDS, LOOSE)]
MARK = "[SECRET]"
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 100


def found(text: Column, no: int, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, kind, end, value>> of one pattern's matches that hold."""
    regex = F.lit(pattern)
    matches = F.regexp_extract_all(text, regex, F.lit(0))
    zipped = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(matches, F.length).alias("len"), (F.regexp_extract_all(text, regex, F.lit(group)) if group else matches).alias("value"))
    span = "struct<start:int,kind:int,end:int,value:string>"
    none = F.array().cast(f"array<{span}>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        one = F.array(F.struct(start.alias("start"), F.lit(no).alias("kind"), (start + x["len"]).alias("end"), x["value"].alias("value")).cast(span))
        return F.struct((start + F.coalesce(x["len"], F.lit(0))).alias("at"), F.when(F.length(x["value"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.rlike(text, regex), spans).otherwise(none)


def base_spans(text: Column) -> Column:
    return F.array_sort(F.concat(*[found(text, no, *kind[1:]) for no, kind in enumerate(KINDS)]))


def loose_spans(text: Column, base: Column) -> Column:
    value = lambda x: x["value"]
    mixed = lambda x: F.rlike(value(x), F.lit("[a-z]")) & F.rlike(value(x), F.lit("[A-Z]")) & F.rlike(value(x), F.lit("[0-9]"))
    return F.filter(found(text, len(KINDS), *LOOSE[1:]), lambda x: mixed(x) & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, of spans in order."""
    names = F.array(*[F.lit(n) for n in NAMES])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str | None, repo_col: str | None) -> DataFrame:
    """row, id_col, key (of id and text), owner, repo, base and loose spans with hashes for values; stored."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lone = lambda c: (F.col(c).cast("string") if c else F.lit(None).cast("string"))
    spans = docs.select(F.col(id_col).alias("id"), lone(owner_col).alias("owner"), lone(repo_col or id_col).alias("repo"), text.alias("t")).withColumn("base", base_spans(F.col("t"))).withColumn("loose", loose_spans(F.col("t"), F.col("base")))
    hashed = lambda c: F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.xxhash64(x["value"]).alias("h")))
    return stored(spans.select(F.monotonically_increasing_id().alias("row"), F.col("id").alias(id_col), F.xxhash64("t").alias("key"), "owner", "repo", hashed(F.col("base")).alias("base"), hashed(F.col("loose")).alias("loose")), "secrets")


def ownership(cands: DataFrame) -> DataFrame:
    """h, owners, repos: of each candidate hash how many distinct owners, and repositories of an owner, hold it."""
    each = cands.select("owner", "repo", F.explode(F.concat("base", "loose")).alias("s")).select("owner", "repo", F.col("s.h").alias("h"))
    return each.groupBy("h", "owner", "repo").agg(F.count("*").alias("n")).groupBy("h", "owner").agg(F.count("*").alias("repos")).groupBy("h").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


def examples(cands: DataFrame, example_owners: int, example_repos: int) -> DataFrame:
    """h, example (true) of each candidate hash that is a widely copied example; stored."""
    wide = (F.col("owners") >= example_owners) | (F.col("repos") >= example_repos)
    return stored(ownership(cands).where(wide).select("h", F.lit(True).alias("example")), "secret-examples")


def judged(cands: DataFrame, example_owners: int, example_repos: int, broadcast_rows: int) -> DataFrame:
    """row, n_live, n_example (of the base spans), owned (spans). Only hashes of examples are joined: broadcast if they are
    few, else the most copied ones apart from the others."""
    each = cands.select("row", F.explode(F.concat("base", "loose")).alias("s")).select("row", "s.*")
    known = examples(cands, example_owners, example_repos)
    joined = each.join(F.broadcast(known), "h", "left") if known.count() <= broadcast_rows else counted_lookup(each, known, ["h"], how="left")
    live = joined.withColumn("live", F.col("example").isNull())
    loose = F.col("kind") == len(KINDS)
    return live.groupBy("row").agg(
        F.count(F.when(~loose & F.col("live"), 1)).alias("n_live"),
        F.count(F.when(~loose & ~F.col("live"), 1)).alias("n_example"),
        F.collect_list(F.when(loose & F.col("live"), F.struct("start", "kind", "end"))).alias("owned"),
    )


def bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = None, example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS, broadcast_rows: int = 100_000) -> DataFrame:
    """id_col, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example for every row of docs. The repository
    of a row is repo_col, or the row's id if there is none."""
    cands = candidates(docs, id_col, text_col, owner_col, repo_col)
    verdict = judged(cands, example_owners, example_repos, broadcast_rows)
    per = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return cands.join(verdict, "row", "left").select(
        id_col, per(0).alias("n_assign"), per(1).alias("n_access"), per(2).alias("n_hex"), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat(bare(F.col("base")), F.coalesce("owned", none)))).alias("spans"), F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"),
    )


def without(text: Column, spans: Column, mark: str) -> Column:
    """text with each run of overlapping spans replaced by mark."""

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str | None = "source", repo_col: str | None = None, chars_col: str | None = "n_chars", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS, mark: str = MARK, broadcast_rows: int = 100_000) -> DataFrame:
    """docs with every span, those of kind owned included, replaced by mark, and chars_col recounted. Spans that were
    found come back by id and hash of the text. Up to broadcast_rows texts with spans no text is moved or scanned again;
    beyond, the patterns' spans are found again in place and only the owned ones come back."""
    cands = candidates(docs, id_col, text_col, owner_col, repo_col)
    owned = judged(cands.where(F.size("base") + F.size("loose") > 0), example_owners, example_repos, broadcast_rows)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    every = cands.where(F.size("base") + F.size("loose") > 0).join(owned.select("row", "owned"), "row", "left")
    id_name, key, spans = (unused(docs, c) for c in ("span_id", "span_key", "spans"))
    every = every.select(F.col(id_col).alias(id_name), F.col("key").alias(key), "base", F.coalesce("owned", none).alias("owned")).dropDuplicates([id_name, key])
    every = stored(every.withColumn(spans, F.array_sort(F.concat(bare(F.col("base")), "owned"))).where(F.size(spans) > 0), "secrets-spans")
    few = every.count() <= broadcast_rows
    text = docs[text_col].cast("string")
    filled = F.coalesce(text, F.lit(""))
    back = every.select(id_name, key, spans) if few else every.where(F.size("owned") > 0).select(id_name, key, F.col("owned").alias(spans))
    back = F.broadcast(back) if few or back.count() <= broadcast_rows else back
    joined = docs.join(back, docs[id_col].eqNullSafe(F.col(id_name)) & (F.xxhash64(filled) == F.col(key)), "left")
    own = F.coalesce(F.col(spans), none)
    joined = joined.withColumn(spans, own if few else F.array_sort(F.concat(bare(base_spans(F.coalesce(F.col(text_col).cast("string"), F.lit("")))), own)))
    made = unused(joined, "redacted")
    plain = F.col(text_col).cast("string")
    out = joined.withColumn(made, F.when(F.size(spans) > 0, without(plain, F.col(spans), mark)).otherwise(plain))
    cols = [F.col(made).alias(c) if c == text_col else F.length(made).cast(docs.schema[c].dataType).alias(c) if c == chars_col and text_col in docs.columns else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*cols)
