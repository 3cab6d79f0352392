"""Operator 8's added spans and the columns of its query, against a plain version."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import pii
from tessera.llm.queries import op8_pii

from . import brute

PATTERNS = {
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}",
    "number": r"(?<![A-Za-z0-9+.-])\(?[0-9]{3}(?:\) ?|[ .-])[0-9]{2,3}[ .-][0-9]{4}(?![A-Za-z0-9-])",
    "name": r"(?:(?<=\bMr\. )|(?<=\bMs\. )|(?<=\bMrs\. )|(?<=\bDr\. )|(?<=\bDear )|(?<=\bname is ))[A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20})?(?![A-Za-z])",
}


def judged(kind, text, m):
    before, after, value = text[max(0, m.start() - 24) : m.start()], text[m.end() : m.end() + 2], m[0]
    word = (re.search(r"([A-Za-z_0-9]+)[^A-Za-z_0-9]*$", before) or [None, ""])[1].lower()
    digits = len(re.sub("[^0-9]", "", value))
    share = digits / len(value)
    has = {c: re.search(p, value) is not None for c, p in (("l", "[a-z]"), ("u", "[A-Z]"), ("d", "[0-9]"))}
    say = lambda yes, no: "y" if yes else "n" if no else "-"
    form = {
        "secret": lambda: say(re.search(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|[A-Za-z]{2,4}_[A-Za-z0-9]{16,})$", value), not has["d"]),
        "number": lambda: say(digits in (9, 10), digits < 9),
        "name": lambda: say(" " in value, len(value) < 3),
    }[kind]()
    gazetteer = say(word in pii.CUES, word in pii.OTHERS)
    marks = say(re.search(r"""[=:]\s*["']?$|["']$|\bis\s$|\.\s$""", before), re.search(r"[/#]$", before) or after.startswith("/"))
    mixture = {"secret": lambda: say(0.25 <= share <= 0.95, share in (0, 1)), "number": lambda: say(share >= 0.7, share < 0.6), "name": lambda: say(has["l"], has["d"])}[kind]()
    last = before[-1:]
    mark = "mark" + {"'": '"', "`": '"'}.get(last, last) if re.fullmatch("[ =:\"'/#(\\[]", last) else "mark?"
    features = ("".join(c if has[c] else "-" for c in "lud"), f"size{int(math.log2(len(value)))}", f"share{int(share * 4)}", "cue" if word in pii.CUES else "nocue", mark)
    return form + gazetteer + marks + mixture, features


def found(text):
    return [(kind, m.start(), m.end(), *judged(kind, text, m)) for kind, p in PATTERNS.items() for m in re.finditer(p, text or "")]


def trained(texts):
    counts = Counter((k, v, f) for t in texts for k, _, _, v, f in found(t))
    model = {}
    for kind in {k for k, _, _ in counts}:
        own = {(v, f): n for (k, v, f), n in counts.items() if k == kind}
        patterns = defaultdict(float)
        for (v, _), n in own.items():
            patterns[v] += n
        chance = pii.reliabilities(dict(patterns))
        good, bad = defaultdict(float), defaultdict(float)
        for (v, f), n in own.items():
            for x in ("", *f):
                good[x] += n * chance[v]
                bad[x] += n * (1 - chance[v])
        model[kind] = {f: math.log((good[f] + 0.5) / (good[""] + 1)) - math.log((bad[f] + 0.5) / (bad[""] + 1)) for f in good | bad if f}
        model[kind][""] = math.log((good[""] + 1) / (bad[""] + 1))
    return model


def spans(text, model):
    base = brute.pii(text)
    added = []
    for kind, a, b, _, features in found(text):
        if kind in model and sum((model[kind].get(f, 0.0) for f in features), model[kind][""]) >= 0 and not any(x < b and y > a for x, _, y in base):
            added.append((a, len(pii.BASE) + pii.ADDED.index(kind), b))
    return base, sorted(added)


BITS = ["token = ", "key: ", 'secret "', "commit ", "sha1 ", "/", "#", "0123456789abcdef0123456789abcdef", "AbCdEf0123456789XyZ01", "an_identifier_without_digits", "99999999999999999999999", "ab_0123456789abcdefgh"]
BITS += ["call (415) 555-2671", "555-266-1234", "isbn 978 12 3456", "tel 030.12.3456", "Mr. Smith", "Dear Anna Berg", "my name is Bo", "Dr. Xu ", "Mrs. Abcdefghijklmnopqrstuvwxyz", " ", ". ", '"', "'", "\n", "é", "😀", "a@b.co", "8.8.8.8", "=", "x"]


def texts(n):
    random.seed(77)
    return ["".join(random.choices(BITS, k=random.randint(0, 9))) for _ in range(n)] + [None, ""]


def test_model_and_spans(spark):
    some = texts(1200)
    df = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").withColumns({"base": F.lit("clash"), "c": F.lit(1)})
    want, got = trained(some), pii.train(df)
    assert set(got) == set(want) == set(pii.ADDED)
    for kind in want:
        assert got[kind].keys() == want[kind].keys() and got[kind] == pytest.approx(want[kind], abs=1e-9)
    n = 0
    for r in pii.find_spans(df, got).collect():
        base, added = spans(some[r["doc_id"]] or "", want)
        assert ([tuple(s) for s in r["base"]], sorted(tuple(s) for s in r["added"])) == (base, added)
        n += len(added)
    assert n > 100


def test_query_columns(spark, tmp_path):
    some = texts(300)
    spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    model, kinds = trained(some), pii.BASE + pii.ADDED
    listed = lambda xs: ",".join(f"{kinds[r]}:{a}:{b}" for a, r, b in sorted(xs))
    got = op8_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(some)
    for r in got:
        base, added = spans(some[r["doc_id"]] or "", model)
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[1] == i for x in base) for i in range(4)]
        assert r["base_sha256"] == brute.sha(listed(base)) and r["spans"] == listed(base + added)
