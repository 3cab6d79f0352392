"""Path expressions: cleaning, globs with **, routing by extension, validity."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions that the line-window chunker takes.
TEXT_EXTENSIONS = "txt text rst adoc org yaml yml toml ini cfg conf sh bash sql proto py js ts rb rs java c h cpp hpp css html xml json".split()
#: Directories that are never taken in.
EXCLUDED_DIRS = ("vendor", "node_modules", ".git")
MAX_FILE_BYTES = 1 << 20
#: Globs of a side that is broadcast: about 20 MB.
BROADCAST_GLOBS = 100_000
#: Fixed value: the line by which Go tools mark what they generate.
GENERATED = r"(?m)^// Code generated .* DO NOT EDIT\.$"


def clean(path: Column) -> Column:
    """Lexically shortest form: no empty or . segments, .. taken back where it can be, "." for nothing."""
    rooted = path.startswith("/")
    segments = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))

    def step(done: Column, s: Column) -> Column:
        back = (s == "..") & (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when(F.size(done) == 0, F.when((s == "..") & rooted, done).otherwise(F.array(s))).when(back, F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(s)))

    joined = F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case part after the last dot of the last segment, or empty."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def route(path: Column) -> Column:
    """Chunker of a path: markdown, go, line-window, or null."""
    e = extension(path)
    return F.when(e.isin("md", "markdown"), "markdown").when(e == "go", "go").when(e.isin(*TEXT_EXTENSIONS), "line-window")


def language(path: Column) -> Column:
    e = extension(path)
    return F.when(e.isin("md", "markdown"), "markdown").when(e == "go", "go").when(e.isin(*TEXT_EXTENSIONS), e)


def valid(path: Column) -> Column:
    """Not empty, relative, no backslash, already clean, not above its root."""
    return (path != "") & ~path.startswith("/") & ~F.contains(path, F.lit("\\")) & (clean(path) == path) & (path != "..") & ~path.startswith("../")


def skip_reason(path: Column, size: Column) -> Column:
    """Why a file isn't taken in, or null: its directory, its extension, its size, in this order. The wordings are fixed values: they are counted and shown as they are."""
    bad = F.filter(F.split(path, "/"), lambda s: s.isin(*EXCLUDED_DIRS))
    dotted = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    unroutable = F.when(dotted == "", F.lit("no extension")).otherwise(F.concat(F.lit("unroutable extension: "), dotted))
    return (
        F.when(F.size(bad) > 0, F.concat(F.lit("excluded directory: "), bad[0]))
        .when(route(path).isNull(), unroutable)
        .when(size > MAX_FILE_BYTES, F.concat(F.lit("size "), size.cast("string"), F.lit(f" exceeds cap {MAX_FILE_BYTES}")))
    )


def _segment(glob: str) -> str:
    """One pattern without ** as a regular expression; * and ? stay within a segment."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end]
            out += "[" + ("^" if inner[0] == "^" else "") + inner.lstrip("^").replace("[", r"\[") + "]"
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += re.escape(glob[i])
        else:
            out += re.escape(c)
        i += 1
    return out


def glob_regex(pattern: str) -> str:
    """A regular expression that finds the glob in any suffix of a path that begins at a segment; ** is any number of segments."""
    parts = [p.strip("/") for p in re.sub(r"/+", "/", pattern.removeprefix("./")).split("**")]
    out = _segment(parts[0])
    for k, p in enumerate(parts[1:], 1):
        before = bool(parts[k - 1]) or k > 1
        if p:
            out += "(?:/|/.*/)" if before and parts[k - 1] else "(?:.*/)?"
            out += _segment(p)
        else:
            out += "(?:/.*)?" if parts[k - 1] else ".*"
    return f"(?:^|/){out}$"


def glob_match(pattern: str, path: Column) -> Column:
    return clean(path).rlike(glob_regex(pattern))


def glob_words(pattern: str) -> list[str]:
    """Segments without wildcards that every path that matches the glob holds; none where that isn't plain (brackets, escapes, ** beside **)."""
    parts = [p.strip("/") for p in re.sub(r"/+", "/", pattern.removeprefix("./")).split("**")]
    if not all(parts[1:-1]) or any(c in pattern for c in "[]\\"):
        return []
    return sorted({s for p in parts for s in p.split("/") if s and "*" not in s and "?" not in s})


def path_words(path: Column) -> Column:
    """Distinct segments of a clean path, the last one also without a line end, which the end of a regular expression passes over."""
    return F.array_distinct(F.concat(F.split(path, "/"), F.array(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\r\n|[\n\r\u0085\u2028\u2029])\z", ""))))


def glob_matches(paths: DataFrame, path: str, globs: DataFrame, glob: str) -> DataFrame:
    """Each row of paths beside each distinct glob that matches it; any number of globs.

    A glob is looked up by the rarest of its plain segments among those of the paths, and its expression is only tried on paths that have it; globs without a plain segment are tried on all paths.
    """
    regex, words = F.udf(glob_regex, "string"), F.udf(glob_words, "array<string>")
    g = globs.where(F.col(glob).isNotNull()).select(F.col(glob).alias("_glob")).distinct().select("_glob", regex("_glob").alias("_regex"), words("_glob").alias("_words"))
    few = g.count() <= BROADCAST_GLOBS
    small = lambda df: F.broadcast(df) if few else df
    p = paths.withColumn("_path", clean(F.col(path)))
    by_word = p.withColumn("_word", F.explode(path_words(F.col("_path"))))
    wanted = g.select("_glob", "_regex", F.explode("_words").alias("_word"))
    counts = by_word.select("_word").join(small(wanted.select("_word").distinct()), "_word", "left_semi").groupBy("_word").agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0).cast("long"))
    rarest = wanted.join(counts, "_word", "left").groupBy("_glob", "_regex").agg(F.min_by("_word", F.struct(n, F.col("_word"))).alias("_word"), F.min(n).alias("_n")).where("_n > 0").drop("_n")
    # Beyond what a broadcast holds, the same joins without one.
    found = by_word.join(small(rarest), "_word").where(F.expr("_path rlike _regex")).drop("_word")
    rest = p.join(small(g.where(F.size("_words") == 0).drop("_words")), F.expr("_path rlike _regex"))
    columns = [*paths.columns, "_glob"]
    return found.select(columns).unionByName(rest.select(columns)).withColumnRenamed("_glob", glob)
