"""Language identification by segmentation-marginalised unigrams (operator 5).

A language is a unigram distribution over the pieces of a fixed public vocabulary. A word's
probability is the sum, over all ways to cut it into pieces, of the product of their probabilities: a forward
pass over the word, with every piece of the vocabulary that consists of letters. Pieces don't cross words, so a text's log probability is
the sum over its words (runs of letters, lowered), and each distinct word is scored once per worker, many words of a length at a time.
Words over SHORT letters go through the same sums block by block, rescaled on the way, however long they are.

Training is expectation maximisation over the distinct words of each language: one scan counts them, summed per task before the
shuffle, into a table in the shared folder; an iteration's forward and backward passes give the expected uses of each piece in each language,
at most languages x pieces rows a task, however hot a language is. The model (languages x pieces) is
bounded by the vocabulary and by MAX_LANGUAGES, which is checked, and is broadcast.

Cases: null text, or one without a letter (Unicode category L): ``und``, score 0. Null languages don't train; more than MAX_LANGUAGES languages
are an error. No trainable row: every text is ``und``. Repeated rows count and are answered each. A word of any length is scored whole; to train on one takes some 40 bytes of
memory a letter. Ties go to the language first in order. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_chars, give_back, slices, stored

MAX_LANGUAGES = 1000
#: A vocabulary with longer pieces is refused: a lattice has so many rows at most.
LONGEST = 64
#: Letters of a word, mark included, whose probability needs no rescaling.
SHORT = 32
#: Positions of a long word at a time, and after how many of them sums are rescaled.
BLOCK, RESCALE = 4096, 16
#: Distinct words that a task counts before it sends them on; words, and numbers in all, in the table of a worker's scored words.
REMEMBERED, SCORED, TABLE = 200_000, 400_000, 16_000_000
#: Of a piece that a language never used, and of a letter that no piece has.
FLOOR, UNKNOWN = 1e-8, 1e-7

_letters = re.compile(r"[^\W\d_]+")
#: What the expression above takes for letters that aren't of category L: numerals such as fractions.
_numerals = dict.fromkeys([c for c in range(0x80, sys.maxunicode + 1) if _letters.match(chr(c)) and unicodedata.category(chr(c))[0] != "L"], " ")
_numeral_chars = frozenset(map(chr, _numerals))
_loaded: dict[str, Pieces] = {}


class Pieces:
    """Numbers of the pieces that consist of letters; a word begins with the mark that the vocabulary gives it.

    Substrings are looked up by a 64-bit polynomial hash, all words of a length at once, in two hash tables: the
    second has the few pieces whose place in the first was taken.
    """

    BASE, BITS = 0x9E3779B97F4A7C15, 18

    def __init__(self, model: bytes):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = sorted({p.lower() for i in range(m.get_piece_size()) if (p := m.id_to_piece(i)).lstrip("▁").isalpha() or p == "▁"})
        self.longest = max(map(len, names))
        if self.longest > LONGEST:
            raise ValueError(f"a piece has {self.longest} characters, more than {LONGEST}")
        self.n = len(names)  # number n: a letter that no piece has; n + 1: nothing
        self.tables, left = [], [(self.hash(p), i) for i, p in enumerate(names)]
        multiplier = 0xD6E8FEB86659FD93
        while left:
            keys, ids, over = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, self.n + 1, np.int32), []
            for h, i in left:
                at = (h * multiplier & 0xFFFFFFFFFFFFFFFF) >> (64 - self.BITS)
                if ids[at] > self.n:
                    keys[at], ids[at] = h, i
                else:
                    over.append((h, i))
            self.tables.append((np.uint64(multiplier), keys, ids))
            left, multiplier = over, multiplier * 3 & 0xFFFFFFFFFFFFFFFF

    def hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * self.BASE + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(hashes.shape, self.n + 1, np.int32)
        for multiplier, keys, ids in self.tables:
            at = (hashes * multiplier) >> np.uint64(64 - self.BITS)
            found = keys[at] == hashes
            out[found] = ids[at[found]]
        return out

    def lattice(self, words: list[str]) -> np.ndarray:
        """Piece number of each (length - 1, end, word) for words of one length, mark included."""
        n = len(words[0])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), n).T.astype(np.uint64) + np.uint64(1)
        top = min(n, self.longest)
        out = np.full((top, n + 1, len(words)), self.n + 1, np.int32)
        h = np.zeros((n, len(words)), np.uint64)
        for d in range(1, top + 1):
            h = h[: n - d + 1] * np.uint64(self.BASE) + points[d - 1 :]
            out[d - 1, d:] = self.numbers(h)
        letters = out[0, 1:]
        letters[letters > self.n] = self.n
        return out


def pieces_of(model: bytes) -> Pieces:
    key = hashlib.sha256(model).hexdigest()
    if key not in _loaded:
        _loaded[key] = Pieces(model)
    return _loaded[key]


def by_length(words) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w in words:
        out.setdefault(len(w), []).append(w)
    return out


def words_of(text: str | None) -> list[str]:
    if not text:
        return []
    text = text.lower()
    if not (text.isascii() or _numeral_chars.isdisjoint(text)):
        text = text.translate(_numerals)
    return _letters.findall(text)


def forward(lattice: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of each prefix: (prefix, words, languages), p: (pieces + 2, languages)."""
    top, n1, count = lattice.shape
    alpha = np.zeros((n1, count, p.shape[1]))
    alpha[0] = 1
    for j in range(1, n1):
        for d in range(1, min(j, top) + 1):
            alpha[j] += alpha[j - d] * p[lattice[d - 1, j]]
    return alpha


def long_blocks(pieces: Pieces, word: str, size: int):
    """(first position, lattice of its pieces that end after it), size positions of a word at a time."""
    for at in range(0, len(word), size):
        low = max(0, at + 1 - pieces.longest)
        own = pieces.lattice([word[low : at + size]])[:, at - low + 1 :, 0]
        yield at, np.concatenate([own, np.full((pieces.longest - len(own), own.shape[1]), pieces.n + 1, np.int32)])


def long_forward(pieces: Pieces, word: str, p: np.ndarray) -> np.ndarray:
    """Logarithm of the sum over all segmentations of a word of any length, in each language."""
    top, size = pieces.longest, max(64, min(BLOCK, 4_000_000 // (pieces.longest * p.shape[1])))
    ring, logs = np.zeros((top, p.shape[1])), np.zeros(p.shape[1])
    ring[-1] = 1  # sums of the last positions; the last one is the empty prefix
    for _, ids in long_blocks(pieces, word, size):
        weights = p[ids[::-1]]
        sums = np.concatenate([ring, np.zeros((ids.shape[1], p.shape[1]))])
        for j in range(ids.shape[1]):
            sums[top + j] = (sums[j : j + top] * weights[:, j]).sum(0)
            if j % RESCALE == 0:
                most = sums[j + 1 : j + top + 1].max(0)
                sums[j + 1 : j + top + 1] /= most
                logs += np.log(most)
        ring = sums[-top:]
    return logs + np.log(ring[-1])


def long_expected(pieces: Pieces, word: str, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in a word of any length; p: its language's probabilities."""
    top, n = pieces.longest, len(word)
    ids = np.concatenate([x for _, x in long_blocks(pieces, word, BLOCK)], 1)  # (length - 1, end - 1)
    alpha, scale = np.zeros(n + top), np.zeros(n + top)  # of prefixes, top - 1 places on; true values are alpha * exp(scale)
    alpha[top - 1] = 1
    log = 0.0
    for j in range(n):
        at = top + j
        alpha[at] = (alpha[j : j + top] * np.exp(scale[j : j + top] - log) * p[ids[::-1, j]]).sum()
        scale[at] = log
        if j % RESCALE == 0:
            log += np.log(alpha[at])
    total = np.log(alpha[-1]) + scale[-1]
    beta, back, use = np.zeros(n + 1 + top), np.zeros(n + 1 + top), np.zeros(pieces.n + 2)  # of suffixes
    beta[n], log, step = 1, 0.0, np.arange(top)
    for j in range(n - 1, -1, -1):  # pieces that begin at j: of length d they end at j + d
        own = ids[step, np.minimum(j + step, n - 1)]
        own = np.where(j + step < n, own, pieces.n + 1)
        later = p[own] * beta[j + 1 : j + 1 + top]
        np.add.at(use, own, later * alpha[top - 1 + j] * np.exp(back[j + 1 : j + 1 + top] + scale[top - 1 + j] - total))
        beta[j] = (later * np.exp(back[j + 1 : j + 1 + top] - log)).sum()
        back[j] = log
        if j % RESCALE == 0:
            log += np.log(beta[j])
    return use[: pieces.n]


def expected(pieces: Pieces, counted: Counter, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in the words of one language; p: its probabilities."""
    use = np.zeros(pieces.n + 2)
    for length, some in by_length("▁" + w for w in counted).items():
        if length > SHORT:
            for w in some:
                use[: pieces.n] += counted[w[1:]] * long_expected(pieces, w, p)
            continue
        for at in range(0, len(some), 4096):
            group = some[at : at + 4096]
            lattice = pieces.lattice(group)
            alpha = forward(lattice, p[:, None])[:, :, 0]
            top, n1, _ = lattice.shape
            beta, flows = np.zeros_like(alpha), np.zeros(lattice.shape)
            beta[-1] = np.array([counted[w[1:]] for w in group]) / alpha[-1]
            for j in range(n1 - 1, 0, -1):
                for d in range(1, min(j, top) + 1):
                    flow = p[lattice[d - 1, j]] * beta[j]
                    beta[j - d] += flow
                    flows[d - 1, j] = flow * alpha[j - d]
            use += np.bincount(lattice.reshape(-1), flows.reshape(-1), pieces.n + 2)
    return use[: pieces.n]


COUNTED = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
USED = pa.schema([("lang", pa.string()), ("piece", pa.int32()), ("used", pa.float64())])


def count_words(df: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """lang, word and n: every language's distinct words, and an empty word for the language itself."""
    rows = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches):
        counted: dict[str, Counter] = {}

        def sent():
            for lang, c in counted.items():
                yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(c) + 1), "word": ["", *c], "n": [0, *c.values()]}, schema=COUNTED)
            counted.clear()

        for tags, texts in slices(batches, ["lang", "text"]):
            for lang, text in zip(tags, texts, strict=True):
                counted.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, counted.values())) > REMEMBERED:
                yield from sent()
        yield from sent()
        give_back()

    return rows.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def train(df: DataFrame, model: bytes, lang_col: str = "lang", text_col: str = "text", iterations: int = 2) -> tuple[list[str], np.ndarray]:
    """Languages, and piece probabilities (pieces + 2, languages); rows with a null language or text don't count."""
    counts = stored(count_words(df, lang_col, text_col))
    shared = df.sparkSession.sparkContext.broadcast(model)
    pieces = pieces_of(model)
    langs: list[str] = []
    p = np.zeros((pieces.n + 2, 0))
    for step in range(iterations):
        known = df.sparkSession.sparkContext.broadcast((langs, p)) if step else None

        def run(batches, known=known):
            pieces, uses = pieces_of(shared.value), {}
            langs, p = known.value if known else ([], None)
            flat = np.r_[np.full(pieces.n, 1 / pieces.n), UNKNOWN, 0.0]
            waiting: dict[str, dict[str, int]] = {}

            def add():
                for lang, c in waiting.items():
                    q = np.ascontiguousarray(p[:, langs.index(lang)]) if lang in langs else flat
                    uses[lang] = uses.get(lang, 0) + expected(pieces, c, q)
                waiting.clear()

            for batch in batches:
                for lang, word, n in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in COUNTED.names), strict=True):
                    own = waiting.setdefault(lang, {})
                    if word:
                        own[word] = n
                if sum(map(len, waiting.values())) > REMEMBERED // 2:
                    add()
            add()
            for lang, use in uses.items():
                ids = np.flatnonzero(use)
                yield pa.RecordBatch.from_pydict({"lang": [lang] * max(1, len(ids)), "piece": ids if len(ids) else [0], "used": use[ids] if len(ids) else [0.0]}, schema=USED)
            give_back()

        sums = counts.mapInArrow(run, "lang string, piece int, used double").groupBy("lang", "piece").agg(F.sum("used").alias("used"))
        got = sums.limit((MAX_LANGUAGES + 1) * pieces.n).toArrow()  # beyond the limit there is a language too many, which is an error
        langs = sorted(set(got["lang"].to_pylist()))
        if len(langs) > MAX_LANGUAGES or got.num_rows > MAX_LANGUAGES * pieces.n:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        p = np.zeros((pieces.n + 2, len(langs)))
        column = {x: i for i, x in enumerate(langs)}
        p[got["piece"].to_numpy(), [column[x] for x in got["lang"].to_pylist()]] = got["used"].to_numpy()
        p[: pieces.n] = np.maximum(p[: pieces.n] / np.maximum(p.sum(0), 1e-9), FLOOR)
        p[pieces.n] = UNKNOWN
    return langs, p


class Scorer:
    """Log probabilities of distinct words in every language, kept in a table that grows as words are met."""

    def __init__(self, pieces: Pieces, p: np.ndarray):
        self.pieces, self.p = pieces, p
        self.row: dict[str, int] = {}
        self.table = np.zeros((0, p.shape[1]))

    def learn(self, words: list[str]) -> None:
        found = np.zeros((len(words), self.p.shape[1]))
        place = {w: i for i, w in enumerate(words)}
        size = max(64, min(4096, 20_000_000 // (SHORT * self.p.shape[1])))
        for length, some in by_length("▁" + w for w in words).items():
            for at in range(0, len(some), size):
                group = some[at : at + size]
                logs = np.log(forward(self.pieces.lattice(group), self.p)[-1]) if length <= SHORT else np.array([long_forward(self.pieces, w, self.p) for w in group])
                found[[place[w[1:]] for w in group]] = logs
        base = len(self.row)
        self.row.update(zip(words, range(base, base + len(words)), strict=True))
        self.table = np.concatenate([self.table, found])

    def scores(self, texts: list[str | None]) -> list[np.ndarray | None]:
        found = [words_of(t) for t in texts]
        if len(self.row) > min(SCORED, TABLE // self.p.shape[1]):
            self.row, self.table = {}, self.table[:0]
        if new := list(dict.fromkeys([w for ws in found for w in ws if w not in self.row])):
            self.learn(new)
        sizes = np.array([len(ws) for ws in found])
        rows = self.table[[self.row[w] for ws in found for w in ws]]
        sums = np.zeros((len(texts), self.p.shape[1]))
        if len(rows):
            sums[sizes > 0] = np.add.reduceat(rows, (np.cumsum(sizes) - sizes)[sizes > 0])
        return [s if n else None for s, n in zip(sums, sizes.tolist(), strict=True)]


def identify(df: DataFrame, model: bytes, trained: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred and score (the predicted language's share of the posterior, flat prior), after columns in keep."""
    shared = df.sparkSession.sparkContext.broadcast((model, *trained))
    kept = [c for c in (keep or []) if c not in ("doc_id", "text", "lang_pred", "score")]
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *kept)
    schema = f"doc_id long, {'text string, ' * bool(keep)}{''.join(f'`{c}` {dict(rows.dtypes)[c]}, ' for c in kept)}lang_pred string, score double"

    def run(batches):
        model, langs, p = shared.value
        scorer = Scorer(pieces_of(model), p) if langs else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, end in by_chars(texts):
                pred, score = [], []
                for s in scorer.scores(texts[first:end]) if scorer else [None] * (end - first):
                    k = -1 if s is None else int(s.argmax())
                    pred.append("und" if k < 0 else langs[k])
                    score.append(0.0 if k < 0 else float(1 / np.exp(s - s[k]).sum()))
                part = batch.slice(first, end - first)
                columns = part.columns if keep else part.columns[:1]
                names = part.schema.names if keep else part.schema.names[:1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])
        del scorer
        give_back()

    return rows.mapInArrow(run, schema)


def remainder(id_col: str, by: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % by
