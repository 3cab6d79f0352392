"""Quality rules by distribution divergence (operator 1).

Two histograms of a document, over character classes and over a language's most common words (and one bin for all
other words), are compared with the language's own by Jensen-Shannon distance (base 2, 0 to 1). A document is
kept if it passes the base rules and some language is near enough in both. Guards: under MIN_CHARS characters the class
histogram isn't judged, under MIN_WORDS words the word histogram isn't; the limits widen with 1/sqrt(n), as the distance
of a sample from its own source does.

References cover every document with a language and a text, in one pass. Each task sums class counts, words in all and every distinct word of a language; the sums are
added up by (language, word) in the shuffle, where each language's COMMON most frequent words are taken (a group limit in each task, then one over what is
left). What reaches the driver is languages x (classes + 1 + COMMON) numbers, MAX_LANGUAGES languages at most: more are an error.

Cases: a null or empty text has no words and fails the base rules; null languages take no part in references, and without any
reference the base rules decide alone; ties between words go by their bytes; repeated rows are counted and answered each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import ASCII_SPACE, give_back, map_texts, slices, two_columns

MAX_LANGUAGES = 1000
COMMON = 100
#: Distinct words of all languages that a task counts before it sends them on.
REMEMBERED = 200_000
MIN_CHARS, MIN_WORDS = 200, 50
CLASS_LIMIT, WORD_LIMIT, CLASS_SLACK, WORD_SLACK = 0.20, 0.30, 1.0, 2.0
SYMBOLS = "#*$%&|<>"
CLASSES = ("lower", "upper", "digit", "space", "stop", "symbol", "other")


@cache
def class_table() -> np.ndarray:
    """Number of the class of each code point."""
    out = np.full(0x110000, CLASSES.index("other"), np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        out[c] = CLASSES.index("upper" if kind in ("Lu", "Lt") else "lower" if kind[0] in "LM" else "digit" if kind[0] == "N" else "space" if kind[0] == "Z" or chr(c) in ASCII_SPACE else "other")
    for name, chars in (("stop", ".,;:!?'\"()-"), ("symbol", SYMBOLS + "@+=_~^`\\/{}[]")):
        out[[ord(c) for c in chars]] = CLASSES.index(name)
    return out


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(class_table()[points], minlength=len(CLASSES))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances of a histogram from those in the rows of q."""
    p = p / p.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.maximum(0, (a + b) / 2))


def references(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict:
    """langs, class shares (languages x classes), common words of each language, and their shares with the rest last."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    schema = pa.schema([("lang", pa.string()), ("kind", pa.string()), ("word", pa.binary()), ("n", pa.int64())])

    def count(batches):
        """Sums of this task: class counts (a byte for the class), words in all, and each word."""
        classes: dict[str, np.ndarray] = {}
        found: dict[str, Counter] = {}

        def sent():
            for lang, c in found.items():
                out = [("class", bytes([k]), int(x)) for k, x in enumerate(classes[lang])] + [("all", b"", c.total())] + [("word", w, n) for w, n in c.items()]
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(out), "kind": [k for k, _, _ in out], "word": [w for _, w, _ in out], "n": [n for _, _, n in out]}, schema=schema)
            classes.clear()
            found.clear()

        for langs, texts in slices(batches, ["lang", "text"]):
            for lang, text in zip(langs, texts, strict=True):
                classes[lang] = classes.get(lang, 0) + class_counts(text)
                found.setdefault(lang, Counter()).update(text.encode("utf-8", "surrogatepass").split())
            if sum(map(len, found.values())) > REMEMBERED:
                yield from sent()
        yield from sent()
        give_back()

    sums = rows.mapInArrow(count, "lang string, kind string, word binary, n long").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    best = sums.withColumn("k", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "word"))).where(F.col("k") <= COMMON)
    most = len(CLASSES) + 1 + COMMON  # rows of a language; with one language more than allowed, the limit still shows it
    got = best.limit((MAX_LANGUAGES + 1) * most).toArrow().to_pylist()
    langs = sorted({r["lang"] for r in got})
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    at = {x: i for i, x in enumerate(langs)}
    classes, shares = np.zeros((len(langs), len(CLASSES))), np.zeros((len(langs), COMMON + 1))
    words: list[list[bytes]] = [[b""] * COMMON for _ in langs]
    for r in got:
        i = at[r["lang"]]
        if r["kind"] == "class":
            classes[i, r["word"][0]] = r["n"]
        elif r["kind"] == "all":
            shares[i, COMMON] += r["n"]
        else:
            words[i][r["k"] - 1] = r["word"]
            shares[i, r["k"] - 1] = r["n"]
            shares[i, COMMON] -= r["n"]
    words = [[w for w in ws if w] for ws in words]
    part = lambda x: x / np.maximum(x.sum(1, keepdims=True), 1)
    return {"langs": langs, "classes": part(classes), "words": words, "shares": part(shares)}


def measures(text: str | None) -> tuple[list[bytes], dict]:
    """Words of a text, and its base counts."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    ws = data.split()
    out = {"n_words": len(ws), "word_chars": len(text) - sum(map(text.count, ASCII_SPACE)), "n_symbols": sum(map(text.count, SYMBOLS))}
    lines = [x for x in data.split(b"\n") if x.strip()]
    out["n_dup_lines"] = len(lines) - len(set(lines))
    triples = list(zip(ws, ws[1:], ws[2:], strict=False))
    out["n_repeat_words"] = 0
    if len(triples) > len(set(triples)):
        times = Counter(triples)
        upto = covered = 0
        for i, t in enumerate(triples):
            if times[t] > 1:
                covered += i + 3 - max(upto, i)
                upto = i + 3
        out["n_repeat_words"] = covered
    return ws, out


def judge(df: DataFrame, reference: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts, base_failed, kept, then the nearest language and its two distances (null where not judged)."""
    shared = df.sparkSession.sparkContext.broadcast(reference)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in counts], ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("nearest", pa.string()), ("class_distance", pa.float64()), ("word_distance", pa.float64())])

    def make():
        ref = shared.value
        langs, number = ref["langs"], [{w: i for i, w in enumerate(ws)} for ws in ref["words"]]

        def run(ids, texts):
            out = {f.name: [] for f in schema}
            out["doc_id"] = ids
            for text in texts:
                ws, base = measures(text)
                for c in counts:
                    out[c].append(base[c])
                n = base["n_words"]
                failed = n < 50 or 100 * base["n_repeat_words"] > 50 * n
                near, by_class, by_word, good = None, None, None, True
                if langs and text:
                    a = distance(class_counts(text), ref["classes"]) if len(text) >= MIN_CHARS else np.zeros(len(langs))
                    b = np.zeros(len(langs))
                    if n >= MIN_WORDS:
                        for k, table in enumerate(number):
                            h = np.bincount([table[w] for w in ws if w in table], minlength=COMMON + 1).astype(float)
                            h[COMMON] = n - h.sum()
                            b[k] = distance(h, ref["shares"][k])
                    over = np.maximum(a / (CLASS_LIMIT + CLASS_SLACK / np.sqrt(len(text))), b / (WORD_LIMIT + WORD_SLACK / np.sqrt(max(n, 1))))
                    k = int(over.argmin())
                    near, good = langs[k], bool(over[k] <= 1)
                    by_class, by_word = float(a[k]) if len(text) >= MIN_CHARS else None, float(b[k]) if n >= MIN_WORDS else None
                for c, x in (("base_failed", failed), ("kept", good and not failed), ("nearest", near), ("class_distance", by_class), ("word_distance", by_word)):
                    out[c].append(x)
            return out

        return run

    return map_texts(two_columns(df, id_col, text_col), make, schema)
