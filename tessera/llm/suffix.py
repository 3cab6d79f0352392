"""Suffix-array dedup (operator 4): a common-prefix-aware distributed merge sort of front-coded suffix runs.

A byte is removed if it lies in a WINDOW-byte string that also starts earlier: in a smaller doc_id, or earlier in
the same document. Every window has an anchor: the leftmost position in it whose GRAM-byte string hashes
least. It depends on the window's bytes alone, so equal windows have anchors at the same place. Consecutive windows
with one anchor form a block (35 windows on average), and blocks, not windows, are sorted:

1. Each bucket of documents sends the distinct hashes of its anchors, and gets back which occur elsewhere too. The other
   blocks can't hold a repeated window.
2. Each bucket sorts the suffixes that start at the surviving anchors (bytes from the anchor to the end of its last window, then
   those before it, reversed), keeps the first of equal ones, and sends the sorted run front-coded: length
   of the prefix shared with the one before, and the rest. Runs go to the partition of their anchor's hash.
3. A partition merges its runs with a loser tree whose nodes keep the prefix length known to be shared with
   the last winner: two candidates are compared from there on only, and not at all where these lengths differ. Equal suffixes
   come out as one class, whose earliest block decides; neighbours that share the anchor but not all bytes are compared window by
   window, by hash and then by their bytes.
4. Verdicts return to the buckets, which mark windows, remove what they cover and hash the rest.

An anchor that very many buckets have (in a common line, say, each time with other surroundings) would bring all its blocks to one partition. Blocks of such an anchor are first
cut by how far their windows reach left of it, STEP places at a time; windows of a part have all but STEP - 1 of their bytes in common, and by these
bytes the part is dealt. So no partition gets more than what agrees in nearly a whole window.

This is a variant of a suffix sort: one suffix in 35 is sorted, in an order by anchors, and windows that are shared by blocks which aren't equal are found by their hashes and bytes
within the anchor's class, not by the order itself.

Text is shuffled once; what else moves is hashes and surviving suffixes, each distinct one once per bucket, so
a group of copies costs a bucket no more than one copy. Buckets are dealt by id and text, partitions by hash.

Cases: a null or short text loses nothing; rows that repeat an id are ordered by a hash of their text, equal rows
arbitrarily but each counted once as earlier; null ids come first; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BUCKETS, ddl, give_back, in_buckets, partitions_for, two_columns

WINDOW, GRAM = 100, 32
PLACES = WINDOW - GRAM + 1
#: Buckets from which an anchor's blocks are cut before they're dealt, and places of a part.
HOT, STEP = 64, 9
SEGMENT_BITS = 20
SEGMENT = 1 << SEGMENT_BITS
BASE = 0x9E3779B97F4A7C15
MASK64 = (1 << 64) - 1

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, 1024), base, np.uint64)
        out[0] = 1
        _powers[base] = np.cumprod(out, dtype=np.uint64)
    return _powers[base][:n]


def window_hashes(data: np.ndarray, size: int, base: int = BASE) -> np.ndarray:
    """64-bit hash of each size bytes of data."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, n), out=sums[1:])
    h = (sums[size:] - sums[: n - size + 1]) * powers(pow(base, -1, 1 << 64), n - size + 1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


class Blocks:
    """Blocks of a bucket's documents: doc (number), anchor, low and high (first and last window), all in bytes of the document; gram."""

    def __init__(self, texts: list[bytes]):
        found: list[tuple[np.ndarray, ...]] = []
        waiting: list[tuple[int, int, bytes]] = []
        room = 0
        for d, t in enumerate(texts):
            for at in range(0, max(1, len(t) - WINDOW + 1), SEGMENT - WINDOW + 1):
                part = t[at : at + SEGMENT] if len(t) > SEGMENT else t
                if len(part) < WINDOW:
                    continue
                if room + len(part) > SEGMENT:
                    found.append(self.scan(waiting))
                    waiting, room = [], 0
                waiting.append((d, at, part))
                room += len(part)
        if waiting:
            found.append(self.scan(waiting))
        names = ("doc", "anchor", "low", "high", "gram")
        kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64)
        for k, (name, kind) in enumerate(zip(names, kinds, strict=True)):
            setattr(self, name, np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind))

    @staticmethod
    def scan(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        h = window_hashes(data, GRAM)
        low_bits = np.uint64(SEGMENT - 1)
        least = sliding_minimum((h & ~low_bits) | np.arange(len(h), dtype=np.uint64), PLACES)
        anchor = (least & low_bits).astype(np.int64)
        sizes = np.array([len(p) for _, _, p in parts])
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(parts)), sizes)[: len(anchor)]
        valid = np.arange(len(anchor)) <= (starts + sizes - WINDOW)[owner]
        windows = np.flatnonzero(valid)
        a, o = anchor[windows], owner[windows]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (o[1:] != o[:-1])])
        last = np.r_[first[1:], len(windows)] - 1
        o, low, high = o[first], windows[first], windows[last]
        shift = np.array([at for _, at, _ in parts])[o] - starts[o]
        doc = np.array([d for d, _, _ in parts])[o]
        return doc, a[first] + shift, low + shift, high + shift, h[a[first]]


class Bucket:
    """A bucket's documents in order, and its blocks. Made anew, and alike, in each step."""

    def __init__(self, table: pa.Table, parts: int):
        rows = sorted(zip(table["doc_id"].to_pylist(), table["tie"].to_pylist(), table["text"].to_pylist(), strict=True), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        self.ids = [r[0] for r in rows]
        self.order = [(-(1 << 63) if r[0] is None else r[0], r[1], k) for k, r in enumerate(rows)]
        self.texts = [(r[2] or "").encode("utf-8", "surrogatepass") for r in rows]
        self.blocks = Blocks(self.texts)
        grams, self.which, counts = np.unique(self.blocks.gram, return_inverse=True, return_counts=True)
        self.parts = (grams % np.uint64(parts)).astype(np.int64)
        by_part = np.argsort(self.parts, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(self.parts[by_part]) != 0]) if len(grams) else np.zeros(0, np.int64)
        self.lists = [(int(self.parts[x[0]]), x) for x in np.split(by_part, cuts[1:])] if len(grams) else []
        self.grams, self.counts = grams, counts

    def entries(self, replies: dict[int, tuple[bytes, bytes]], parts: int) -> Entries:
        """Surviving blocks, those of hot anchors cut into parts."""
        shared, hot = np.zeros(len(self.grams), bool), np.zeros(len(self.grams), bool)
        for part, where in self.lists:
            if part in replies:
                for flags, packed in zip((shared, hot), replies[part], strict=True):
                    flags[where] = np.unpackbits(np.frombuffer(packed, np.uint8), count=len(where)).astype(bool)
        b = self.blocks
        chosen = np.flatnonzero(shared[self.which]) if len(self.grams) else np.zeros(0, np.int64)
        doc, anchor, low, high = (x[chosen] for x in (b.doc, b.anchor, b.low, b.high))
        part, step = (self.parts[self.which[chosen]], np.full(len(chosen), -1)) if len(chosen) else (chosen, chosen)
        if len(chosen) and hot.any():
            cut = hot[self.which[chosen]]
            first, last = (anchor - high)[cut] // STEP, (anchor - low)[cut] // STEP
            times = last - first + 1
            own = np.repeat(np.arange(len(times)), times)
            steps = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
            lows = np.maximum(low[cut][own], anchor[cut][own] - steps * STEP - STEP + 1)
            highs = np.minimum(high[cut][own], anchor[cut][own] - steps * STEP)
            whole = ~cut
            doc, anchor = np.r_[doc[whole], doc[cut][own]], np.r_[anchor[whole], anchor[cut][own]]
            low, high, part, step = np.r_[low[whole], lows], np.r_[high[whole], highs], np.r_[part[whole], np.zeros(len(own), np.int64)], np.r_[step[whole], steps]
        keys, first_of, part = [], {}, part.tolist()
        for i, (d, a, x, z, k) in enumerate(zip(doc.tolist(), anchor.tolist(), low.tolist(), high.tolist(), step.tolist(), strict=True)):
            t = self.texts[d]
            key = t[a : z + WINDOW] + t[x:a][::-1] + bytes((z + WINDOW - a,))
            if k >= 0:  # what all windows of the part have in common
                part[i] = int.from_bytes(hashlib.blake2b(t[a - k * STEP : a + WINDOW - k * STEP - STEP + 1], digest_size=8, salt=bytes((k,))).digest(), "little") % parts
            keys.append(key)
            first_of.setdefault(key, i)
        return Entries(doc, low, high, keys, first_of, sorted((part[i], k) for k, i in first_of.items()))


class Entries(NamedTuple):
    """Blocks as they're sorted: document, first and last window, key; the first one of each key; (part, key) in the order of runs."""

    doc: np.ndarray
    low: np.ndarray
    high: np.ndarray
    keys: list[bytes]
    first: dict[bytes, int]
    ordered: list[tuple[int, bytes]]


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which known bytes are known."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(keys: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Shared prefix lengths, rest lengths (a byte each) and rests of sorted keys."""
    shared = [0] * len(keys)
    for i in range(1, len(keys)):
        shared[i] = shared_prefix(keys[i - 1], keys[i], 0)
    return bytes(shared), bytes([len(k) - s for k, s in zip(keys, shared, strict=True)]), b"".join([k[s:] for k, s in zip(keys, shared, strict=True)])


def front_decode(shared: bytes, sizes: bytes, rests: bytes):
    at, key = 0, b""
    for s, n in zip(shared, sizes, strict=True):
        key = key[:s] + rests[at : at + n]
        at += n
        yield key, s


def merge_runs(runs: list):
    """Merges iterators of (key, prefix shared with the one before) into (key, prefix shared with the one before, run).

    A loser tree. shared[r] is how many bytes run r's next key has in common with the last winner; since that winner is
    no larger than either, of two keys the one that shares more is the smaller, and if they share equally, they
    are compared from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    keys: list[bytes | None] = [None] * size
    shared = [-1] * size
    for r, run in enumerate(runs):
        for keys[r], _ in run:
            shared[r] = 0
            break
    losers = [0] * size

    def play(node: int) -> int:
        """Fills the tree below a node with the losers of the first round; its winner."""
        if node >= size:
            return node - size
        a, b = play(2 * node), play(2 * node + 1)
        if shared[a] >= 0 and shared[a] == shared[b]:
            h = shared_prefix(keys[a], keys[b], shared[a])
            if keys[b][h : h + 1] < keys[a][h : h + 1]:
                a, b = b, a
            shared[b] = h
        elif shared[b] > shared[a]:
            a, b = b, a
        losers[node] = b
        return a

    winner = play(1)
    while shared[winner] >= 0:
        yield keys[winner], shared[winner], winner
        for keys[winner], shared[winner] in runs[winner]:
            break
        else:
            shared[winner] = -1
        node = (winner + size) >> 1
        h = shared[winner]
        while node:
            other = losers[node]
            g = shared[other]
            if g > h:
                losers[node], winner, h = winner, other, g
            elif g == h and h >= 0:
                a, b = keys[winner], keys[other]
                h2 = shared_prefix(a, b, h)
                if b[h2 : h2 + 1] < a[h2 : h2 + 1]:
                    shared[winner] = h2
                    losers[node], winner = winner, other
                else:
                    shared[other] = h2
            node >>= 1


def window_verdicts(groups: list[list[tuple[bytes, int]]]) -> list[list[bytes | None]]:
    """For each group of blocks with one anchor, as (key, position of its first window): bits of the windows that occur at an
    earlier position in another block, or None for none. Positions order windows: a document's number shifted, plus the byte."""
    flat = [x for g in groups for x in g]
    out: list[bytes | None] = [None] * len(flat)
    at = 0
    while at < len(flat):
        # Whole groups, up to SEGMENT bytes at a time: a group's windows must meet.
        pass_end, room, g_at = at, 0, at
        for g in groups_from(groups, at):
            size = sum(len(k) for k, _ in g)
            if room and room + size > 4 * SEGMENT:
                break
            room += size
            pass_end = g_at = g_at + len(g)
        some = flat[at:pass_end]
        texts = [k[k[-1] : -1][::-1] + k[: k[-1]] for k, _ in some]
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(data)) - starts[owner]
        windows = np.flatnonzero(place <= (sizes - WINDOW)[owner])
        h = window_hashes(data, WINDOW)[windows]
        position = np.array([p for _, p in some])[owner[windows]] + place[windows]
        order = np.lexsort((position, h))
        hs = h[order]
        first = np.maximum.accumulate(np.where(np.r_[True, hs[1:] != hs[:-1]], np.arange(len(hs)), 0))
        repeat = np.flatnonzero(first != np.arange(len(hs)))
        later, earlier = windows[order[repeat]], windows[order[first[repeat]]]
        view = np.lib.stride_tricks.sliding_window_view(data, WINDOW)
        same = np.concatenate([(view[later[i : i + 50_000]] == view[earlier[i : i + 50_000]]).all(1) for i in range(0, len(later), 50_000)]) if len(later) else np.zeros(0, bool)
        marked = np.zeros(len(data), bool)
        marked[later[same]] = True
        if not same.all():  # two strings with one hash: exactly, by their bytes
            seen: set[bytes] = set()
            for k in order[np.isin(hs, hs[repeat[~same]])]:
                w = data[windows[k] : windows[k] + WINDOW].tobytes()
                marked[windows[k]] = w in seen
                seen.add(w)
        hit = np.add.reduceat(marked, starts) if len(starts) else []
        for i in np.flatnonzero(hit):
            out[at + i] = np.packbits(marked[starts[i] : starts[i] + sizes[i] - WINDOW + 1]).tobytes()
        at = pass_end
    result, k = [], 0
    for g in groups:
        result.append(out[k : k + len(g)])
        k += len(g)
    return result


def groups_from(groups: list, at: int):
    k = 0
    for g in groups:
        if k >= at:
            yield g
        k += len(g)


A_SCHEMA = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("grams", pa.binary()), ("many", pa.binary())])
R_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("part", pa.int32()), ("data", pa.binary()), ("masks", pa.binary())])
B_SCHEMA = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("shared", pa.binary()), ("sizes", pa.binary()), ("rests", pa.binary()), ("places", pa.binary())])
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table({f.name: pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)}, schema=schema)


def replies_of(table: pa.Table, kind: int) -> dict[int, tuple[bytes, bytes]]:
    return {p: (d, m) for k, p, d, m in zip(*(table[c].to_pylist() for c in ("kind", "part", "data", "masks")), strict=True) if k == kind}


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, texts: bool = True, partitions: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with texts the kept bytes."""
    docs = two_columns(df, id_col, text_col)
    n = partitions or partitions_for(docs)
    docs = in_buckets(docs, BUCKETS * n)

    def send_grams(table: pa.Table) -> pa.Table:
        b = Bucket(table, n)
        bucket = table["bucket"][0].as_py()
        return table_of([(p, bucket, b.grams[x].tobytes(), np.packbits(b.counts[x] > 1).tobytes()) for p, x in b.lists], A_SCHEMA)

    def answer_grams(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(g, np.uint64) for g in table["grams"].to_pylist()]
        every = np.concatenate(lists)
        grams, which, counts = np.unique(every, return_inverse=True, return_counts=True)
        shared, hot, rows, at = (counts > 1)[which], (counts >= HOT)[which], [], 0
        for bucket, part, g, many in zip(table["bucket"].to_pylist(), table["part"].to_pylist(), lists, table["many"].to_pylist(), strict=True):
            bits = shared[at : at + len(g)] | np.unpackbits(np.frombuffer(many, np.uint8), count=len(g)).astype(bool)
            rows.append((bucket, 0, part, np.packbits(bits).tobytes(), np.packbits(hot[at : at + len(g)]).tobytes()))
            at += len(g)
        return table_of(rows, R_SCHEMA)

    def send_runs(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return table_of([], B_SCHEMA)
        b, rows = Bucket(table, n), []
        found = b.entries(replies_of(replies, 0), n)
        ordered, bucket, at = found.ordered, table["bucket"][0].as_py(), 0
        while at < len(ordered):
            part, end = ordered[at][0], at
            while end < len(ordered) and ordered[end][0] == part:
                end += 1
            keys = [k for _, k in ordered[at:end]]
            blocks = [found.first[k] for k in keys]
            places = np.array([(*b.order[d], low) for d, low in zip(found.doc[blocks].tolist(), found.low[blocks].tolist(), strict=True)], np.int64)
            rows.append((part, bucket, *front_code(keys), places.tobytes()))
            at = end
        del b, found, ordered
        give_back()
        return table_of(rows, B_SCHEMA)

    def merge(table: pa.Table) -> pa.Table:
        columns = {c: table[c].to_pylist() for c in B_SCHEMA.names}
        counts = [len(x) for x in columns["shared"]]
        base = np.cumsum([0, *counts]).tolist()
        places = np.concatenate([np.frombuffer(p, np.int64).reshape(-1, 4) for p in columns["places"]])
        ranked = np.unique(places[:, :3], axis=0, return_inverse=True)[1].reshape(-1)
        bits = int(places[:, 3].max() + WINDOW).bit_length()  # a window's place in its document
        if int(ranked.max()) >> (63 - bits):
            raise OverflowError("more documents in a part than positions have room for: use more partitions")
        position = ((ranked << bits) + places[:, 3]).tolist()
        verdict = np.zeros(len(places), np.uint8)
        masks: dict[int, bytes] = {}
        groups: list[list[tuple[bytes, int]]] = []
        members: list[list[int]] = []
        runs = [front_decode(s, z, r) for s, z, r in zip(columns["shared"], columns["sizes"], columns["rests"], strict=True)]
        taken = base[:-1]
        last, lead = None, -1
        group: list[tuple[bytes, int]] = []
        leads: list[int] = []

        def close():
            if len(group) > 1:
                groups.append([(k, position[e]) for (k, _), e in zip(group, leads, strict=True)])
                members.append(leads.copy())

        for key, shared, run in merge_runs(runs):
            e = taken[run]
            taken[run] += 1
            if key == last:
                if position[e] < position[lead]:
                    verdict[lead], lead = 1, e
                    leads[-1] = e
                else:
                    verdict[e] = 1
                continue
            if last is not None and shared < GRAM:
                close()
                group, leads = [], []
            last, lead = key, e
            group.append((key, e))
            leads.append(e)
        close()
        for owners, found in zip(members, window_verdicts(groups), strict=True):
            for e, bits in zip(owners, found, strict=True):
                if bits:
                    verdict[e], masks[e] = 2, bits.ljust(WINDOW // 8, b"\0")
        del places, position, groups, members
        give_back()
        rows = []
        for k, (bucket, part) in enumerate(zip(columns["bucket"], columns["part"], strict=True)):
            own = verdict[base[k] : base[k + 1]]
            rows.append((bucket, 1, part, own.tobytes(), b"".join(masks[e] for e in (np.flatnonzero(own == 2) + base[k]).tolist())))
        return table_of(rows, R_SCHEMA)

    out_schema = pa.schema([*OUT, ("kept", pa.binary())]) if texts else OUT

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table_of([], out_schema)
        b, verdicts = Bucket(table, n), replies_of(replies, 1)
        found = b.entries(replies_of(replies, 0), n)
        said: dict[bytes, bytes | int] = {}
        seen: dict[int, int] = {}
        mask_at: dict[int, int] = {}
        for part, key in found.ordered:
            data, masks = verdicts[part]
            k = seen.get(part, 0)
            seen[part] = k + 1
            v = data[k]
            if v == 2:
                m = mask_at.get(part, 0)
                mask_at[part] = m + WINDOW // 8
                said[key] = masks[m : m + WINDOW // 8]
            else:
                said[key] = v
        sizes = np.array([len(t) for t in b.texts])
        starts = np.cumsum(sizes) - sizes
        change = np.zeros(int(sizes.sum()) + 1, np.int32)
        lows = starts[found.doc] + found.low
        highs = starts[found.doc] + found.high
        for i, (key, low, high) in enumerate(zip(found.keys, lows.tolist(), highs.tolist(), strict=True)):
            v = said[key]
            if v == 1 or found.first[key] != i:
                change[low] += 1
                change[high + WINDOW] -= 1
            elif v:
                w = low + np.flatnonzero(np.unpackbits(np.frombuffer(v, np.uint8), count=high - low + 1))
                np.add.at(change, w, 1)
                np.add.at(change, w + WINDOW, -1)
        covered = np.cumsum(change[:-1]) > 0
        rows = []
        for k, text in enumerate(b.texts):
            gone = covered[starts[k] : starts[k] + sizes[k]]
            n_gone = int(gone.sum())
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if n_gone else text
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n_gone else 0
            rows.append((b.ids[k], len(text), n_gone, spans, hashlib.sha256(kept).hexdigest(), *([kept] * texts)))
        del b, found, said, change, covered
        give_back()
        return table_of(rows, out_schema)

    grams = docs.groupBy("bucket").applyInArrow(send_grams, ddl(A_SCHEMA))
    shared = grams.groupBy("part").applyInArrow(answer_grams, ddl(R_SCHEMA))
    dealt = docs.groupBy("bucket")
    runs = dealt.cogroup(shared.groupBy("bucket")).applyInArrow(send_runs, ddl(B_SCHEMA))
    verdicts = runs.groupBy("part").applyInArrow(merge, ddl(R_SCHEMA))
    return dealt.cogroup(shared.union(verdicts).groupBy("bucket")).applyInArrow(finish, ddl(out_schema))
