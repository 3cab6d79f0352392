"""Benchmark decontamination by spaced-seed hashing (operator 7).

A seed is a fixed mask over consecutive tokens: its hash takes the marked positions and ignores the others, so a
substituted word there doesn't hide a passage. Seed hashes of documents are joined with those of the benchmark, and each hit's alignment
is verified: some window of WINDOW tokens (all of a shorter item's) agrees in at least AGREE of its places.

Tokens are runs of letters, digits and underscores, lowered. The benchmark goes to the tasks in slices under SLICE_BYTES of text, a size
that is checked; a larger benchmark is more slices, each met with all documents. Documents aren't shuffled.

A text that repeats itself costs no more than its length times an item's: hits are places of a text and items, HITS at a time, and alignments are made only
where they are few.

Cases: null texts and items have no tokens and match nothing; items under SHORTEST tokens match nothing; repeated items or documents are each answered; ties between windows go to the earliest; empty
tables give empty results; other columns are kept by clean() and ignored by leaks().
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_chars, ddl, give_back, slices, two_columns

#: Fixed masks: 1 is compared, 0 ignored. The first find every window of WINDOW tokens that agrees in AGREE of its places,
#: wherever the others are; the second do the same for shorter items.
MASKS = ("1111011", "1110111", "1110100011")
SHORT_MASKS = ("11111", "111011", "111101", "110111", "101111", "1101011", "1110011", "11010011")
WINDOW, AGREE, SHORTEST = 20, 0.8, 6
SLICE_BYTES = 16_000_000
#: Hits (a place in a text and an item) that are held at a time.
HITS = 1_000_000

_tokens = re.compile(r"\w+")
BREAK = np.uint64(0)

OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_start", pa.int64()), ("item_start", pa.int64()), ("n_window", pa.int64()), ("n_equal", pa.int64())])


def tokens(text: str | None) -> list[str]:
    return _tokens.findall(text.lower()) if text else []


def coefficients(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(max(n, 1), 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)[:n]


def seed_hashes(row: np.ndarray, offsets: list[int]) -> np.ndarray:
    """Hash of the masked tokens from each place of a row of token numbers; 0 where a masked place has none."""
    n = len(row) - offsets[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for o, c in zip(offsets, coefficients(len(offsets)), strict=True):
        x = row[o : o + n]
        h += (x * np.uint64(0xBF58476D1CE4E5B9) ^ (x >> np.uint64(7))) * c
        whole &= x != BREAK
    h ^= h >> np.uint64(31)
    return np.where(whole, h | np.uint64(1), np.uint64(0))


def windows_along(row: np.ndarray, x: np.ndarray, diagonals: np.ndarray, w: int) -> tuple | None:
    """The best window on some diagonals (document place less item place): (-equal, document place, item place, w), or None."""
    best = None
    for start in diagonals.tolist():
        low, high = max(start, 0), min(start + len(x), len(row))
        if high - low < w:
            continue
        sums = np.cumsum(np.r_[0, row[low:high] == x[low - start : high - start]])
        sums = sums[w:] - sums[:-w]
        k = int(sums.argmax())
        if sums[k] >= AGREE * w:
            got = (-int(sums[k]), low + k, low + k - start, w)
            best = got if best is None else min(best, got)
    return best


def windows_everywhere(row: np.ndarray, x: np.ndarray, w: int) -> tuple | None:
    """The best window on all diagonals, of the same form: a pass over the shorter side, with sums for each place of the longer one."""
    turned = len(x) > len(row)
    short, long = (row, x) if turned else (x, row)
    sums, best = np.zeros(len(long), np.int32), None
    for q in range(len(short)):
        sums[1:] = sums[:-1]  # the window that ends at (q, p) follows the one that ends at (q - 1, p - 1)
        sums[0] = 0
        sums += (long == short[q]) & (short[q] != BREAK)
        if q >= w:
            sums[w:] -= (long[:-w] == short[q - w]) & (short[q - w] != BREAK)
        if q >= w - 1 and len(long) >= w:
            most = int(sums[w - 1 :].max())
            if most >= AGREE * w and (best is None or -most <= best[0]):
                p = int(sums[w - 1 :].argmax())
                got = (-most, q - w + 1, p, w) if turned else (-most, p, q - w + 1, w)
                best = got if best is None else min(best, got)
    return best


class Seeds:
    """A slice of the benchmark: token numbers of its words, and sorted seed hashes by mask."""

    def __init__(self, items: list[tuple[int, str]]):
        self.number: dict[str, int] = {}
        kept = [(i, t) for i, text in items if len(t := tokens(text)) >= SHORTEST]
        self.ids = [i for i, _ in kept]
        self.rows = [np.array([self.number.setdefault(w, len(self.number) + 1) for w in t], np.uint64) for _, t in kept]
        self.tables = []
        for mask, short in [*((m, False) for m in MASKS), *((m, True) for m in SHORT_MASKS)]:
            offsets = [k for k, c in enumerate(mask) if c == "1"]
            rows = [(i, r) for i, r in enumerate(self.rows) if (len(r) < WINDOW) == short]
            found = [(h, i, p) for i, r in rows for p, h in enumerate(seed_hashes(r, offsets).tolist()) if h]
            if found:
                found.sort()
                h, item = np.array([f[0] for f in found], np.uint64), np.array([f[1] for f in found])
                gate = np.zeros(1 << 16, bool)
                gate[h >> np.uint64(48)] = True
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (item[1:] != item[:-1])])  # of each hash in each item
                self.tables.append((offsets, h[first], item[first], np.r_[first, len(h)], np.array([f[2] for f in found]), gate))

    def leaks(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int, int]]]:
        """For each text, (item number, start in text, start in item, window, equal tokens) of the best window of each item that it leaks.

        A hit is a place of a text and a hash of an item, which may stand at many places of the item. A pair of text and item with no more alignments than tokens
        has each of its diagonals verified; one with more (both repeat themselves) is verified on all diagonals at once, so neither time nor memory follows the product of repeats.
        """
        out: list[list] = [[] for _ in texts]
        if not self.rows:
            return out
        get, gap = self.number.get, 64
        numbers = [np.array([get(w, 0) for w in tokens(t)], np.uint64) for t in texts]
        sizes = np.array([len(x) + gap for x in numbers])
        starts = np.cumsum(sizes) - sizes
        row = np.zeros(int(sizes.sum()) + gap, np.uint64)
        for s, x in zip(starts.tolist(), numbers, strict=True):
            row[s : s + len(x)] = x
        hits: dict[tuple[int, int], list] = {}  # by text and item: alignments so far, and arrays of diagonals while they're few
        for offsets, h, item, bounds, places, gate in self.tables:
            own = seed_hashes(row, offsets)
            at = np.flatnonzero(gate[own >> np.uint64(48)] & (own != 0))
            low, high = np.searchsorted(h, own[at], "left"), np.searchsorted(h, own[at], "right")
            at, low, times = at[high > low], low[high > low], (high - low)[high > low]
            for some in runs(times, HITS):
                groups = np.repeat(low[some] - np.cumsum(times[some]) + times[some], times[some]) + np.arange(times[some].sum())
                place = np.repeat(at[some], times[some])
                text = np.searchsorted(starts, place, "right") - 1
                order = np.lexsort((item[groups], text))
                place, text, groups = place[order], text[order], groups[order]
                edge = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (item[groups][1:] != item[groups][:-1])])
                for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(text)], strict=True):
                    d, i = int(text[a]), int(item[groups[a]])
                    known = hits.setdefault((d, i), [0, []])
                    n = bounds[groups[a:b] + 1] - bounds[groups[a:b]]
                    known[0] += int(n.sum())
                    if known[0] > len(numbers[d]) + len(self.rows[i]):
                        known[1] = []
                    else:
                        which = np.repeat(bounds[groups[a:b]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                        known[1].append(np.repeat(place[a:b] - starts[d], n) - places[which])
        for (d, i), (n, diagonals) in sorted(hits.items()):
            x, w = self.rows[i], min(WINDOW, len(self.rows[i]))
            if n > len(numbers[d]) + len(x):
                best = windows_everywhere(numbers[d], x, w)
            else:
                best = windows_along(numbers[d], x, np.unique(np.concatenate(diagonals)), w)
            if best:
                equal, a, b, w = best
                out[d].append((i, a, b, w, -equal))
        return out


def runs(times: np.ndarray, most: int):
    """Slices of rows that stand for about most hits each; a row with more comes alone."""
    if not len(times):
        return
    part = (np.cumsum(times) - times) // most
    edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist()
    yield from (slice(a, b) for a, b in zip(edge, [*edge[1:], len(times)], strict=True))


def benchmark_slices(benchmark: DataFrame, id_col: str, text_col: str) -> list[list[tuple[int, str]]]:
    """The benchmark, a slice of at most about SLICE_BYTES at a time."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-size // SLICE_BYTES))
    for k in range(n):
        yield [(r["item_id"], r["text"]) for r in (items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).toArrow().to_pylist()]


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item that it leaks: doc_id, item_id, token offsets of the best window, its size and equal tokens."""
    rows, found = two_columns(docs, id_col, text_col), None
    for some in benchmark_slices(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(some)

        def run(batches, shared=shared):
            seeds = Seeds(shared.value)
            for ids, texts in slices(batches, ["doc_id", "text"]):
                got = [(d, seeds.ids[i], *rest) for d, hits in zip(ids, seeds.leaks(texts), strict=True) for i, *rest in hits]
                yield pa.RecordBatch.from_pydict({f.name: [g[k] for g in got] for k, f in enumerate(OUT)}, schema=OUT)

        own = rows.mapInArrow(run, ddl(OUT))
        found = own if found is None else found.unionByName(own)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that leak nothing."""
    for some in benchmark_slices(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(some)

        def run(batches, shared=shared):
            seeds = Seeds(shared.value)
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                for first, end in by_chars(texts):
                    yield batch.slice(first, end - first).filter(pa.array([not x for x in seeds.leaks(texts[first:end])], pa.bool_()))
            give_back()

        docs = docs.mapInArrow(run, docs.schema)
    return docs
