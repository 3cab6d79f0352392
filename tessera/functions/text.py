"""Text expressions: the analyzer of full-text search, identifier decomposition, byte-exact truncation, candidate words."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Lower-case Latin letters that carry marks, and the letters without, by the rule of canonical decomposition."""
    marked, plain = [], []
    for c in map(chr, [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]):
        parts = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(parts) > 1 and all(unicodedata.category(p) == "Mn" for p in parts[1:]):
            marked.append(c)
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _folding()

#: Words that are never keywords.
STOP_WORDS = (
    "a an the and or but in on at to for of with is it be are was were been have has had do does did will would could should may might "
    "i me my you your we our they their he she this that what how when where why who not no from by as if its about into just can also"
).split()


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), MARKED, PLAIN)


def terms(text: Column) -> Column:
    """Lower-cased, folded runs of letters and digits."""
    return F.filter(F.split(folded(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_phrases(text: Column) -> Column:
    """One phrase (array of terms) for each blank-separated word that has a term; a word with punctuation has several."""
    return F.filter(F.transform(F.split(F.trim(text), r"\s+"), terms), lambda p: F.size(p) > 0)


def candidate_words(prompt: Column) -> Column:
    """Distinct words in first-seen order: punctuation trimmed, lower case, 3 bytes or more, no stop words."""
    trimmed = F.transform(F.split(prompt, r"\s+"), lambda w: F.lower(F.btrim(w, F.lit(".,;:!?\"'()[]{}"))))
    return F.array_distinct(F.filter(trimmed, lambda w: (F.octet_length(w) >= 3) & ~w.isin(*STOP_WORDS)))


def decomposed(text: Column) -> Column:
    """Identifiers as words: separators to spaces, camelCase and acronym ends split, lower case, blanks collapsed."""
    t = F.regexp_replace(text, r"[/._:\-]", " ")
    t = F.regexp_replace(t, r"([\p{Ll}\p{Nd}])(?=\p{Lu})", "$1 ")
    t = F.regexp_replace(t, r"(\p{Lu})(?=\p{Lu}\p{Ll})", "$1 ")
    return F.trim(F.lower(F.regexp_replace(t, r"\s+", " ")))


def weight(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(text, r"(?U)\s", ""))


def cut_bytes(text: Column, limit: int, mark: str = "") -> Column:
    """At most limit bytes of UTF-8, whole characters only, with a mark if cut.

    The longest prefix is found among the few character counts that limit bytes can hold: limit / 4 to limit.
    """
    short = F.substring(text, 1, limit)
    over = F.octet_length(short) - limit
    # Every character dropped frees 1 to 4 bytes: drop a quarter of the excess at a time, at most log steps until it fits.
    steps = F.sequence(F.lit(1), F.lit(max(8, 4 * limit.bit_length())))

    def drop(t: Column, _: Column) -> Column:
        excess = F.octet_length(t) - limit
        return F.when(excess > 0, F.substring(t, F.lit(1), (F.length(t) - F.ceil(excess / 4)).cast("int"))).otherwise(t)

    cut = F.when(over > 0, F.aggregate(steps, short, drop)).otherwise(short)
    return F.when(F.octet_length(text) > limit, F.concat(cut, F.lit(mark))).otherwise(text)
