"""BPE encoding and decoding (operator 2).

Words of a text (runs without white space) never share a token, so a text is cut into words,
each distinct word is normalised, cut into pre-tokens (where it isn't ASCII by the library's own tables, so that both
know the same Unicode) and merged once per task, and the
ids of a text are the concatenation of its words' ids. Merging keeps a priority queue of
merge ranks over a doubly linked symbol list; entries whose symbols have changed since they
were queued are stale and skipped, so a pre-token of n bytes costs O(n log n).
Decoding concatenates vocabulary strings, with a space between where the vocabulary file
names no decoder.

Cases: a null text counts as empty (no ids, empty decoded text); repeated rows each give a
row; a null id stays null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from copy import copy
from heapq import heapify, heappop, heappush

import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame

from .common import map_texts, two_columns

#: White space of the Unicode standard, as the vocabulary file's pattern counts it.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Distinct words whose ids a task remembers; beyond, it forgets all and starts anew.
REMEMBERED = 600_000
#: Distinct pre-tokens likewise: a word comes with many a mark beside it, and in either case.
REMEMBERED_PIECES = 200_000

_loaded: dict[str, BytePairs] = {}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if it prints, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, free = [""] * 256, 0x100
    for b in shown:
        out[b] = chr(b)
    for b in range(256):
        if not out[b]:
            out[b] = chr(free)
            free += 1
    return out


class BytePairs:
    """A byte-level BPE vocabulary whose words end in a suffix; lower case, white space dropped."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        known = self.vocab | self.special
        self.text_of = [""] * (max(known.values()) + 1)
        for t, i in known.items():
            self.text_of[i] = t
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        shown = byte_characters()
        self.inner = [self.vocab.get(c, -1) for c in shown]
        self.last = [self.vocab.get(c + self.suffix, -1) for c in shown]
        self.between = re.compile(f"[{SPACE}]+")
        self.pieces = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^0-9a-z]+")  # of lowered ASCII words, which hold no white space
        self.library = tokenizers.Tokenizer.from_str(content.decode())  # its normalizer and pre-tokenizer, not its merges
        self.byte_of = {c: b for b, c in enumerate(shown)}
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.merged: dict[bytes, list[int]] = {}

    def merge(self, symbols: list[int]) -> list[int]:
        """Symbols after all merges, lowest rank first, leftmost first within a rank.

        A queue entry is rank * n + place. It's stale if the pair that stands there now has another rank or none.
        """
        n, get = len(symbols), self.ranks.get
        if n < 2:
            return symbols
        queue = [r[0] * n + i for i, pair in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := get(pair))]
        if not queue:
            return symbols
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        symbols = [*symbols, -1]
        while queue:
            rank, i = divmod(heappop(queue), n)
            j = after[i]
            r = get((symbols[i], symbols[j])) if j <= n else None
            if r is None or r[0] != rank:
                continue
            joined = symbols[i] = r[1]
            symbols[j] = -1
            k = after[i] = after[j]
            after[j] = n + 1
            if k < n:
                before[k] = i
                if r := get((joined, symbols[k])):
                    heappush(queue, r[0] * n + i)
            if (h := before[i]) >= 0 and (r := get((symbols[h], joined))):
                heappush(queue, r[0] * n + h)
        return [s for s in symbols if s >= 0]

    def encode_word(self, word: str) -> list[int]:
        if word.isascii():
            word = word.lower()
            pieces = [p.encode() for p in ([word] if word.isalpha() else self.pieces.findall(word))]
        else:
            # What is a letter, and how it is composed and lowered, follows the Unicode version of the installed library.
            shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(word))
            pieces = [bytes([self.byte_of[c] for c in p]) for p, _ in shown]
        ids: list[int] = []
        for data in pieces:
            if (found := self.merged.get(data)) is None:
                symbols = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
                found = self.merge([s for s in symbols if s >= 0])
                if len(data) < 200:
                    if len(self.merged) >= REMEMBERED_PIECES:
                        self.merged.clear()
                    self.merged[data] = found
            ids += found
        return ids

    def decode(self, ids: bytes) -> str:
        text = self.text_of
        return " ".join([text[i] for i in array("I", ids)])

    def remembered(self, word: str) -> bytes:
        if (found := self.known.get(word)) is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            found = pack(self.encode_word(word))
            if len(word) < 200:
                self.known[word] = found
        return found

    def plain(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        found = text.split() if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") else self.between.split(text)
        known = self.known
        return b"".join([known.get(w) or self.remembered(w) for w in found if w])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.specials and any(s in text for s in self.special):
            return b"".join([pack([self.special[p]]) if k % 2 else self.plain(p) for k, p in enumerate(self.specials.split(text))])
        return self.plain(text)

    def for_a_task(self) -> BytePairs:
        """The same vocabulary with a memory of its own, which goes with it."""
        own = copy(self)
        own.known, own.merged = {}, {}
        return own


def pack(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(4, "little") for i in ids)


def vocabulary(content: bytes) -> BytePairs:
    """The vocabulary of a file's content, parsed once in a process."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _loaded:
        _loaded[key] = BytePairs(content)
    return _loaded[key]


def encode_documents(df: DataFrame, content: bytes, id_col: str = "doc_id", text_col: str = "text", *, ids: bool = True, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, then with ids: token_ids (packed little-endian unsigned 32-bit) and decoded; with digest: the
    lowercase hex SHA-256 of each.

    content is a tokenizer file's content: its size is fixed, so it's broadcast. One map over the scan, no shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(content)
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64())]
    fields += [("token_ids", pa.binary()), ("decoded", pa.string())] * ids
    fields += [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] * digest

    def make():
        vocab = vocabulary(shared.value).for_a_task()

        def run(keys, texts):
            done = [(p, vocab.decode(p)) for t in texts for p in (vocab.encode(t or ""),)]
            out = {"doc_id": keys, "n_tokens": [len(p) // 4 for p, _ in done]}
            if ids:
                out |= {"token_ids": [p for p, _ in done], "decoded": [d for _, d in done]}
            if digest:
                out |= {"ids_sha256": [hashlib.sha256(p).hexdigest() for p, _ in done]}
                out |= {"decoded_sha256": [hashlib.sha256(d.encode("utf-8", "surrogatepass")).hexdigest() for _, d in done]}
            return out

        return run

    return map_texts(two_columns(df, id_col, text_col), make, pa.schema(fields))
