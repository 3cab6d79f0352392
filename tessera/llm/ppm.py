"""LM scoring by prediction by partial matching (operator 9).

The model is a trie of byte contexts up to ORDER bytes, pretrained on the training documents. A symbol is coded in the
longest context seen; where the context never had it, an escape is coded (as many counts as the context has
distinct symbols) and the next shorter context is asked, from which all symbols of the longer one are excluded. Below order 0 the symbols left
are equally likely. Text is lower-cased (A to Z), preceded by ORDER zero bytes and ended by one.

Since a longer context has seen no more symbols than its suffixes, exclusion needs two numbers per context: the distinct
symbols, and their total in the next shorter context. So the trie is kept as sorted arrays of (context, symbol) counts,
dealt by the last three context bytes: orders 3 and up of a context chain are together, and no context has more than 65,536 strings in a bucket.
Orders 0 to 2, whose counts are added up over all tasks first, are broadcast: 256 ** 3 numbers at the very most (some 200 MB) whatever the corpus, and in text
as many as it has different runs of three bytes.

Buckets of documents send their distinct strings of ORDER + 1 bytes, with training counts, to the parts of the trie, which add up the
counts and answer with log probabilities; the same goes for words and the unigram base. Text is shuffled once;
what else moves follows the distinct strings of each bucket. Nothing of the model is collected or broadcast beyond the bound above.

Cases: a null text counts as empty (its end alone is scored); no training rows: every byte has probability 1/256, and the base uses N = V = 0; a text of any
length is scored whole, SLICE bytes at a time in its bucket; repeated rows count and are answered each; a null id is never held out; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BUCKETS, ddl, give_back, in_buckets, partitions_for, slices, two_columns

ORDER = 4
SLICE = 1 << 20
#: Reserved word for a text's end; no word holds a space.
END = b" "

SENT = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary()), ("words", pa.binary()), ("word_counts", pa.binary())])
ANSWER = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("grams", pa.binary()), ("words", pa.binary()), ("n", pa.int64()), ("v", pa.int64())])
OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER + 1 bytes that end at each symbol of each text and at its end, as numbers, and the text of each."""
    pad = b"\0" * ORDER
    data = np.frombuffer(b"".join([pad + t + b"\0" for t in texts]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(sizes + ORDER) - sizes
    n = len(data) - ORDER
    codes = np.zeros(n, np.uint64)
    for k in range(ORDER + 1):
        codes = (codes << np.uint64(8)) | data[k : k + n]
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner] + starts[owner] - ORDER
    return codes[at], owner


def text_slices(texts: list[bytes]):
    """Numbers of texts, about SLICE bytes at a time."""
    some, room = [], 0
    for i, t in enumerate(texts):
        if room + len(t) > SLICE and some:
            yield some
            some, room = [], 0
        some.append(i)
        room += len(t)
    if some:
        yield some


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, which = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(which, np.concatenate(counts), len(every)).astype(np.int64)


def order(k: int, g: np.ndarray, n: np.ndarray, shorter: tuple | None) -> tuple[np.ndarray, ...]:
    """One order of the trie from its sorted strings of k + 1 bytes and their counts: strings, counts, contexts, and of each context its
    total, its distinct symbols and what these have in the next shorter context."""
    contexts, first, distinct = np.unique(g >> np.uint64(8), return_index=True, return_counts=True)
    total = np.add.reduceat(n, first) if len(g) else np.zeros(0, np.int64)
    if k and len(g):
        below = shorter[1][np.searchsorted(shorter[0], g & np.uint64((1 << 8 * k) - 1))]
        taken = np.add.reduceat(below, first)
    else:
        taken = np.zeros(len(contexts), np.int64)
    return g, n, contexts, total, distinct, taken


def bounded_orders(triples: tuple[np.ndarray, np.ndarray]) -> list[tuple[np.ndarray, ...]]:
    """Orders 0 to 2 from the counts of runs of three bytes."""
    out: list[tuple[np.ndarray, ...]] = []
    for k in range(3):
        g, n = add_up([triples[0].astype(np.uint64) & np.uint64((1 << 8 * (k + 1)) - 1)], [triples[1]])
        out.append(order(k, g, n, out[-1] if out else None))
    return out


class Trie:
    """Counts of (context, symbol) for contexts of 3 to ORDER bytes in one part, over the bounded orders below."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, bounded: list[tuple[np.ndarray, ...]]):
        self.orders = list(bounded)
        for k in range(len(bounded), ORDER + 1):
            g, n = add_up([grams & np.uint64((1 << 8 * (k + 1)) - 1)], [counts])
            self.orders.append(order(k, g[n > 0], n[n > 0], self.orders[-1]))

    def log10(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros(len(grams))
        open_ = np.ones(len(grams), bool)
        less_total, less_distinct = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
        for k in range(ORDER, -1, -1):
            g, n, contexts, total, distinct, taken = self.orders[k]
            if not len(g):
                continue
            own = grams & np.uint64((1 << 8 * (k + 1)) - 1)
            c, at_c = find(contexts, own >> np.uint64(8))
            s, at_s = find(g, own)
            known = open_ & c
            rest, kinds = (total[at_c] - less_total), (distinct[at_c] - less_distinct)
            room = np.maximum(rest + kinds, 1)
            seen, escape = known & s, known & ~s & (kinds > 0)
            out[seen] += np.log10(n[at_s][seen] / room[seen])
            out[escape] += np.log10(kinds[escape] / room[escape])
            open_ &= ~seen
            less_total = np.where(known, taken[at_c], less_total)
            less_distinct = np.where(known, distinct[at_c], less_distinct)
        out[open_] -= np.log10(256 - len(self.orders[0][0]))
        return out


def find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return keys[at] == x, at


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def low_orders(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Runs of three bytes, as numbers, and their counts over the training rows: 256 ** 3 at most reach the driver, whatever the corpus."""
    schema = pa.schema([("triple", pa.int32()), ("n", pa.int64())])

    def run(batches):
        keys, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for (texts,) in slices(batches, ["text"]):
            texts = [lowered(t) for t in texts]
            for some in text_slices(texts):
                data = np.frombuffer(b"".join([b"\0\0" + texts[i] + b"\0" for i in some]), np.uint8).astype(np.uint32)
                starts = np.cumsum([0, *(len(texts[i]) + 3 for i in some[:-1])])
                ends = np.ones(len(data), bool)  # where a run may end: not in what precedes a text
                ends[starts] = ends[starts + 1] = False
                g, n = np.unique(((data[:-2] << 16) | (data[1:-1] << 8) | data[2:])[ends[2:]], return_counts=True)
                keys.append(g)
                counts.append(n)
            if len(keys) > 64:
                keys, counts = map(lambda x: [x], add_up(keys, counts))
        g, n = add_up(keys, counts)
        give_back()
        yield pa.RecordBatch.from_pydict({"triple": g.astype(np.int32), "n": n}, schema=schema)

    got = docs.where(~F.col("held_out")).select("text").mapInArrow(run, "triple int, n long").groupBy("triple").agg(F.sum("n").alias("n")).toArrow()
    triple, n = got["triple"].to_numpy(), got["n"].to_numpy()
    by_number = np.argsort(triple, kind="stable")
    return triple[by_number].astype(np.uint32), n[by_number]


def score(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Every row scored by a model of the rows that aren't held out (held_out: over id_col)."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    n = partitions or partitions_for(two_columns(docs))
    triples = docs.sparkSession.sparkContext.broadcast(low_orders(docs))
    dealt = in_buckets(docs, BUCKETS * n).groupBy("bucket")

    def distinct(table: pa.Table):
        """Distinct grams and words of a bucket with their training counts, in an order that is the same each time."""
        ids, held, texts = table["doc_id"].to_pylist(), table["held_out"].to_pylist(), [lowered(t) for t in table["text"].to_pylist()]
        keys, counts = [], []
        words: Counter = Counter()
        for some in text_slices(texts):
            for out in (False, True):
                if own := [texts[i] for i in some if held[i] == out]:
                    g, c = np.unique(grams_of(own)[0], return_counts=True)
                    keys.append(g)
                    counts.append(c * (not out))
            for i in some:
                if held[i]:
                    words.update(dict.fromkeys(texts[i].split(), 0))
                else:
                    words.update(texts[i].split())
        words[END] += sum(not h for h in held)
        return ids, held, texts, *add_up(keys, counts), words

    def part_of(grams: np.ndarray) -> np.ndarray:
        mixed = ((grams >> np.uint64(8)) & np.uint64(0xFFFFFF)) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(32)) % np.uint64(n)).astype(np.int64)

    def dealt_out(grams: np.ndarray, words: Counter):
        """(part, places of its grams, its words) for each part."""
        parts = part_of(grams)
        order = np.argsort(parts, kind="stable")
        bounds = np.searchsorted(parts[order], np.arange(n + 1))
        own: list[list[bytes]] = [[] for _ in range(n)]
        for w in sorted(words):
            own[zlib.crc32(w) % n].append(w)
        return [(p, order[bounds[p] : bounds[p + 1]], own[p]) for p in range(n) if bounds[p] < bounds[p + 1] or own[p]]

    def send(table: pa.Table) -> pa.Table:
        *_, grams, counts, words = distinct(table)
        bucket = table["bucket"][0].as_py()
        rows = [(p, bucket, grams[at].tobytes(), counts[at].astype(np.uint32).tobytes(), b"\n".join(ws), np.array([words[w] for w in ws], np.uint32).tobytes()) for p, at, ws in dealt_out(grams, words)]
        return pa.table({f.name: pa.array([r[k] for r in rows], f.type) for k, f in enumerate(SENT)})

    orders: list[tuple[np.ndarray, ...]] = []

    def answer(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(g, np.uint64) for g in table["grams"].to_pylist()]
        counts = [np.frombuffer(c, np.uint32).astype(np.int64) for c in table["counts"].to_pylist()]
        grams, summed = add_up(lists, counts)
        if not orders:  # once a task
            orders.extend(bounded_orders(triples.value))
        logs = Trie(grams, summed, orders).log10(grams)
        words: Counter = Counter()
        owned = [w.split(b"\n") if w else [] for w in table["words"].to_pylist()]
        for ws, c in zip(owned, table["word_counts"].to_pylist(), strict=True):
            for w, k in zip(ws, np.frombuffer(c, np.uint32).tolist(), strict=True):
                words[w] += k
        rows = []
        for bucket, part, g, ws in zip(table["bucket"].to_pylist(), table["part"].to_pylist(), lists, owned, strict=True):
            rows.append((bucket, part, logs[np.searchsorted(grams, g)].tobytes(), np.array([words[w] for w in ws], np.int64).tobytes(), None, None))
        rows.append((-1, table["part"][0].as_py(), b"", b"", sum(words.values()), sum(k > 0 for k in words.values())))
        return pa.table({f.name: pa.array([r[k] for r in rows], f.type) for k, f in enumerate(ANSWER)})

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return OUT.empty_table()
        ids, held, texts, grams, counts, words = distinct(table)
        got = {p: (g, w) for p, g, w in zip(answers["part"].to_pylist(), answers["grams"].to_pylist(), answers["words"].to_pylist(), strict=True)}
        totals = [(a, b) for p, a, b in zip(answers["part"].to_pylist(), answers["n"].to_pylist(), answers["v"].to_pylist(), strict=True) if p < 0]
        total, kinds = totals[0]
        logs, known = np.zeros(len(grams)), {}
        for p, at, ws in dealt_out(grams, words):
            g, w = got[p]
            logs[at] = np.frombuffer(g, np.float64)
            known.update(zip(ws, np.frombuffer(w, np.int64).tolist(), strict=True))
        base = {w: np.log10((c + 0.5) / (total + 0.5 * (kinds + 1))) for w, c in known.items()}
        end = np.log10((known[END] + 0.5) / (total + 0.5 * (kinds + 1)))
        # Open table: a frequent gram takes its slot from a rarer one; the few left out are searched for.
        bits = max(12, int(len(grams)).bit_length() + 1)
        mix, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
        slot = ((grams * mix) >> shift).astype(np.int64)
        by_count = np.argsort(counts, kind="stable")
        holder = np.zeros(1 << bits, np.int64)
        holder[slot[by_count]] = by_count
        sums = np.zeros(len(texts))
        for some in text_slices(texts):
            g, owner = grams_of([texts[i] for i in some])
            at = holder[((g * mix) >> shift).astype(np.int64)]
            wrong = np.flatnonzero(grams[at] != g)
            at[wrong] = np.searchsorted(grams, g[wrong])
            sums[some] = np.bincount(owner, logs[at], len(some))
        n_tokens, n_known, base_score = [], [], []
        for t in texts:
            ws = t.split()
            n_tokens.append(len(ws) + 1)
            n_known.append(sum([known[w] > 0 for w in ws]) + (known[END] > 0))
            base_score.append(float(sum([base[w] for w in ws]) + end))
        del grams, counts, words, logs, known, base, holder
        give_back()
        return pa.table({"doc_id": ids, "held_out": held, "n_tokens": n_tokens, "n_known": n_known, "train_tokens": [total] * len(ids), "base_score": base_score, "score": sums}, schema=OUT)

    answers = dealt.applyInArrow(send, ddl(SENT)).groupBy("part").applyInArrow(answer, ddl(ANSWER))
    totals = answers.where("bucket < 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v"))
    # The two totals go to every bucket as one more answer.
    totals = totals.select(F.explode(F.sequence(F.lit(0), F.lit(BUCKETS * n - 1))).alias("bucket"), F.lit(-1).alias("part"), F.lit(b"").alias("grams"), F.lit(b"").alias("words"), "n", "v")
    return dealt.cogroup(answers.where("bucket >= 0").unionByName(totals).groupBy("bucket")).applyInArrow(finish, ddl(OUT))
