"""PII by weak supervision (operator 8). DataFrame and SQL functions only.

Base spans (email, ip, card, phone) are regular expressions with checks, and always stand. For kinds that no expression settles (secrets,
loosely written numbers, names) every candidate gets votes: a regex labeler looks at its form, a gazetteer labeler at the word before it, two context labelers at
the marks around it and at its mix of characters; each says yes (1), no (-1) or nothing (0). Votes are counted by pattern over all documents. From these counts, a few
hundred numbers whatever the corpus, expectation maximisation estimates how reliable each labeler is and how likely each pattern is a true span; with those as soft
labels a naive Bayes classifier over the candidates' features is trained, and a candidate is added as a span where
its probability is at least a half.

The patterns are written so that no text makes them slow: runs are possessive, and a match may only begin where a run begins
(or where the last match ended), which is where the leftmost match of the plain pattern begins. Positions are code points: parts between matches and the matches
themselves have lengths, whose running sums are the starts. What stands around a place is read from pieces of the text, and a candidate looks for base spans by halving, so
that a text costs no more than its length times a logarithm, however many spans it has. One scan of the documents counts votes, one finds spans; neither shuffles texts.

Cases: a null text counts as empty; repeated rows are answered each; a null id stays null; an empty table gives an empty table, and with no
candidates at all nothing is added; added spans that overlap a base span are left out; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running, running_sums

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "number", "name")
#: Fixed patterns of the contract, possessive, begun at the start of a run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}+",
    "number": r"(?<![A-Za-z0-9+.-])\(?[0-9]{3}(?:\)\x20?|[\x20.-])[0-9]{2,3}[\x20.-][0-9]{4}(?![A-Za-z0-9-])",
    "name": r"(?=[A-Z])(?<=\b(?:Mr|Ms|Mrs|Dr)\.\x20|\bDear\x20|\bname\x20is\x20)[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?(?![A-Za-z])",
}
#: What a text must hold for a pattern to be worth a look: one of some strings, or a simpler pattern that every good match holds.
GATES = {"email": ("@",), "phone": ("+",), "name": ("Mr. ", "Ms. ", "Mrs. ", "Dr. ", "Dear ", "name is ")}
SIMPLER = {"ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){13}[0-9]", "number": r"[0-9][\x20.-][0-9]{4}"}
#: Fixed words of the gazetteer: before a span of personal data, and before something else.
CUES = ("token", "key", "apikey", "api_key", "secret", "password", "passwd", "pwd", "bearer", "auth", "phone", "tel", "call", "mobile", "fax", "ssn", "passport", "account", "id", "dear", "mr", "ms", "mrs", "dr", "is", "name")
OTHERS = ("isbn", "issn", "version", "page", "chapter", "order", "figure", "table", "sha1", "commit", "md5", "checksum", "of", "the")
AROUND = 24
#: Code points of a piece: finding a place in a text costs its distance from the start, in a piece at most this.
PIECE = 1024
LABELERS = ("form", "gazetteer", "marks", "mixture")


def matches(text: Column, kind: str) -> Column:
    """Array of (start, end, value) of a pattern's matches; start and end in code points."""
    pattern = PATTERNS[kind]

    def places(parts: Column, hits: Column) -> Column:
        lengths = F.transform(hits, lambda h, i: (F.length(parts[i]) + F.length(h)).cast("long"))
        return let(running_sums(lengths), lambda ends: F.transform(hits, lambda h, i: F.struct((ends[i] - F.length(h)).alias("start"), ends[i].alias("end"), h.alias("value"))))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, let(F.split(text, pattern, -1), lambda parts: places(parts, hits))))
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    found = F.coalesce(found, none)
    worth = None
    for some in GATES.get(kind, ()):
        worth = F.contains(text, F.lit(some)) if worth is None else worth | F.contains(text, F.lit(some))
    if kind in SIMPLER:
        worth = F.regexp_like(text, F.lit(SIMPLER[kind]))
    return found if worth is None else F.when(worth, found).otherwise(none)


def pieces(text: Column) -> Column:
    return F.when(F.length(text) <= PIECE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))


def cut(parts: Column, at: Column, n: Column) -> Column:
    """n code points from place at (from 0) on, of a text in pieces."""
    first, last = F.floor(at / PIECE).cast("int"), F.floor((at + n - 1) / PIECE).cast("int")
    return F.array_join(F.slice(parts, first + 1, F.greatest(last - first + 1, F.lit(0))), "").substr((at - first * PIECE + 1).cast("int"), n.cast("int"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the check: every second digit from the right doubled, digits summed."""

    def worth(d: Column, i: Column) -> Column:
        x = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.transform(F.split(F.reverse(number), ""), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """The contract's check of a base match."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda t: F.when(F.length(t) > 3, F.lit(False)).when(t == "", F.lit(True)).otherwise(t.cast("int") <= 255)))
    if kind == "card":
        return let(digits(value), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (start, rank, end) of base spans, in the contract's order."""
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")

    def of(rank: int, kind: str) -> Column:
        good = F.filter(matches(text, kind), lambda m: holds(kind, m["value"]))
        return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))

    kinds = [of(r, k) for r, k in enumerate(BASE)]
    return F.array_sort(F.concat(none, *kinds))


def votes(kind: str, parts: Column, m: Column) -> Column:
    """The labelers' votes on a candidate, as a string of LABELERS votes (y, n or -), and its features."""
    before = cut(parts, F.greatest(m["start"] - AROUND, F.lit(0)), F.least(m["start"], F.lit(AROUND)))
    after = cut(parts, m["end"], F.lit(2))
    word = lambda before: F.lower(F.regexp_extract(before, r"([A-Za-z_0-9]+)[^A-Za-z_0-9]*$", 1))
    # Each computed once: they are looked at many times.
    return let(before, lambda before: let(after, lambda after: let(word(before), lambda word: judged(kind, m["value"], before, after, word))))


def judged(kind: str, value: Column, before: Column, after: Column, word: Column) -> Column:
    """Votes and features of a candidate by its value, what stands around it, and the word before it."""
    has = {c: value.rlike(p) for c, p in (("lower", "[a-z]"), ("upper", "[A-Z]"), ("digit", "[0-9]"))}
    share = F.length(digits(value)) / F.length(value)
    say = lambda yes, no: F.when(yes, "y").when(no, "n").otherwise("-")
    form = {
        "secret": say(value.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|[A-Za-z]{2,4}_[A-Za-z0-9]{16,})$"), ~has["digit"]),
        "number": say(F.length(digits(value)).isin(9, 10), F.length(digits(value)) < 9),
        "name": say(F.contains(value, F.lit(" ")), F.length(value) < 3),
    }[kind]
    gazetteer = say(word.isin(*CUES), word.isin(*OTHERS))
    marks = say(before.rlike("""[=:]\\s*["']?$|["']$|\\bis\\s$|\\.\\s$"""), before.rlike(r"[/#]$") | after.rlike("^/"))
    mixture = {"secret": say(share.between(0.25, 0.95), (share == 0) | (share == 1)), "number": say(share >= 0.7, share < 0.6), "name": say(has["lower"], has["digit"])}[kind]
    mix = F.concat(*[F.when(has[c], c[0]).otherwise("-") for c in ("lower", "upper", "digit")])
    size = F.concat(F.lit("size"), F.floor(F.log2(F.length(value))).cast("string"))
    part = F.concat(F.lit("share"), F.floor(share * 4).cast("string"))
    cue = F.when(word.isin(*CUES), "cue").otherwise("nocue")
    mark = F.concat(F.lit("mark"), F.translate(F.right(before, F.lit(1)), "'`", '""'))
    mark = F.when(F.right(before, F.lit(1)).rlike("^[ =:\"'/#(\\[]$"), mark).otherwise("mark?")
    return F.struct(F.concat(form, gazetteer, marks, mixture).alias("votes"), F.array(mix, size, part, cue, mark).alias("features"))


def candidates(text: Column) -> Column:
    """Array of (kind, start, end, votes, features) over the added kinds."""
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,votes:string,features:array<string>>>")

    def of(kind: str, parts: Column) -> Column:
        return F.transform(matches(text, kind), lambda m: let(votes(kind, parts, m), lambda v: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), v["votes"].alias("votes"), v["features"].alias("features"))))

    return let(pieces(text), lambda parts: F.concat(none, *[of(k, parts) for k in ADDED]))


def reliabilities(counts: dict[str, float], rounds: int = 60) -> dict[str, float]:
    """Expectation maximisation over counts of vote patterns: the probability that a candidate with each pattern is a true span.

    Two classes; each labeler says yes, no or nothing with probabilities of its own in each class. It starts from labelers that are right in four cases of
    five, and counts are smoothed.
    """
    prior, says = 0.5, {c: [{"y": 0.6 if c else 0.15, "n": 0.15 if c else 0.6, "-": 0.25} for _ in LABELERS] for c in (0, 1)}
    chance: dict[str, float] = {}
    for _ in range(rounds):
        for pattern in counts:
            like = [math.log(p) + sum(math.log(s[v]) for s, v in zip(says[c], pattern, strict=True)) for c, p in ((0, 1 - prior), (1, prior))]
            chance[pattern] = 1 / (1 + math.exp(min(700, like[0] - like[1])))
        total = sum(counts.values())
        prior = min(0.99, max(0.01, sum(n * chance[p] for p, n in counts.items()) / max(total, 1e-9)))
        for c in (0, 1):
            for k in range(len(LABELERS)):
                sums = {v: (1.0 if v == ("y" if c else "n") else 0.5) for v in "yn-"}
                for p, n in counts.items():
                    sums[p[k]] += n * (chance[p] if c else 1 - chance[p])
                says[c][k] = {v: s / sum(sums.values()) for v, s in sums.items()}
    return chance


def train(df: DataFrame, text_col: str = "text") -> dict[str, dict[str, float]]:
    """For each added kind, log odds of each feature that the corpus has and of none ("")."""
    rows = df.select(F.explode(candidates(F.coalesce(F.col(text_col), F.lit("")))).alias("c")).groupBy("c.kind", "c.votes", "c.features").agg(F.count("*").alias("n"))
    # Bounded: kinds x 3 ** labelers x the few values of the features, whatever the corpus.
    table = [(r["kind"], r["votes"], tuple(r["features"]), r["n"]) for r in rows.collect()]
    model: dict[str, dict[str, float]] = {}
    for kind in sorted({t[0] for t in table}):
        counts: dict[str, float] = defaultdict(float)
        for k, v, _, n in table:
            if k == kind:
                counts[v] += n
        chance = reliabilities(dict(counts))
        sums: tuple[dict, dict] = (defaultdict(float), defaultdict(float))
        for k, v, features, n in table:
            if k == kind:
                for c, w in ((0, n * (1 - chance[v])), (1, n * chance[v])):
                    sums[c][""] += w
                    for f in features:
                        sums[c][f] += w
        odds = {"": math.log((sums[1][""] + 1) / (sums[0][""] + 1))}
        for f in sorted(set(sums[0]) | set(sums[1]) - {""}):
            if f:
                odds[f] = math.log((sums[1][f] + 0.5) / (sums[1][""] + 1)) - math.log((sums[0][f] + 0.5) / (sums[0][""] + 1))
        model[kind] = odds
    return model


def accepted(c: Column, model: dict[str, dict[str, float]]) -> Column:
    """Whether the classifier takes a candidate: log odds of 0 or more."""
    def score(odds: dict[str, float]) -> Column:
        table = F.create_map(*[x for f, w in odds.items() if f for x in (F.lit(f), F.lit(w))])
        return F.aggregate(c["features"], F.lit(odds[""]), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))

    out = F.lit(False)
    for kind, odds in model.items():
        out = F.when(c["kind"] == kind, score(odds) >= 0).otherwise(out)
    return out


def find_spans(df: DataFrame, model: dict[str, dict[str, float]], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, base (array of start, rank, end; rank in BASE) and added (same; ranks go on with ADDED), after columns in keep."""
    kept = keep or []
    rows = df.select(*kept, F.col(id_col).cast("long").alias("doc_id_"), F.coalesce(F.col(text_col), F.lit("")).alias("text_"))
    rows = rows.withColumn("base", base_spans(F.col("text_")))
    text = F.col("text_")
    ranks = F.create_map(*[x for r, k in enumerate(ADDED) for x in (F.lit(k), F.lit(len(BASE) + r))])

    def over(c: Column, own: Column) -> Column:
        """Whether a candidate overlaps one of a kind's spans, which are in order and apart: the last that begins before its end, found by halving."""
        n = F.aggregate(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), F.lit(0), lambda n, p: F.when(n + p > F.size(own), n).when(own[n + p - 1]["start"] < c["end"], n + p).otherwise(n))
        return F.when(F.size(own) > 0, let(n, lambda n: F.when(n > 0, own[n - 1]["end"] > c["start"]).otherwise(False))).otherwise(False)

    added = F.filter(candidates(text), lambda c: accepted(c, model))

    def clear(found: Column, rank: int) -> Column:
        return let(F.filter("base", lambda b: b["rank"] == rank), lambda own: F.filter(found, lambda c: ~over(c, own)))

    for r in range(len(BASE)):
        added = clear(added, r)
    added = F.transform(added, lambda c: F.struct(c["start"].alias("start"), ranks[c["kind"]].alias("rank"), c["end"].alias("end")))
    rows = rows.withColumn("added", added if model else F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>"))
    return rows.select(*kept, *([] if "doc_id" in kept else [F.col("doc_id_").alias("doc_id")]), F.col("text_").alias("searched"), "base", "added")


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in BASE + ADDED])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with each span, or run of overlapping spans, replaced by its first kind in brackets. spans are in order."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in BASE + ADDED])

    def done(parts: Column, own: Column, ends: Column) -> Column:
        def part(s: Column, i: Column) -> Column:
            at = F.when(i > 0, ends[i - 1]).otherwise(F.lit(0).cast("long"))
            return F.when(s["start"] >= at, F.concat(cut(parts, at, s["start"] - at), names[s["rank"]])).otherwise("")

        last = F.element_at(ends, -1)
        return F.concat(F.array_join(F.transform(own, part), ""), cut(parts, last, F.length(text) - last))

    ends = lambda own: running(F.transform(own, lambda s: s["end"]), F.greatest)
    return F.when(F.size(spans) > 0, let(pieces(text), lambda parts: let(spans, lambda own: let(ends(own), lambda e: done(parts, own, e))))).otherwise(text)
