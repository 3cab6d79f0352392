"""N-gram Jaccard join (operator 6): a size-aware heavy-light similarity join, for components of near-duplicates.

A document's set is its distinct shingles of so many words, as 64-bit hashes. Sets link when intersection / union >= level / 100.
Both numbers are parameters of near_duplicates; operator 6's contract fixes SHINGLE and LEVEL.
Documents with one set are one node, named by its smallest doc_id.

- Light: sets of up to x elements. Two of them link just when they share a subset of as many elements as their sizes call for, so each
  enumerates its subsets of those sizes; sharers of a subset are tied to the smallest set among them, without a comparison.
- Heavy: larger sets, by inverted lists. In one global order of shingles, rare ones first (by a fixed-size sketch of counts over all
  documents), linked sets share one of their first n - ceil(level n / 100) + 1. Lists of these are scanned. Sets just under x have their lists too,
  for links across the boundary.
  A pair counts only where the places of the shared shingle leave room for the overlap that their sizes call for.
- The boundary x is where the summed cost is least: subsets of a size against list entries and their comparisons, over the sizes counted.

Lists of near-duplicates overlap and would give the square of a group's size in pairs. So nodes many of whose lists are long first go to
their SEVERAL longest only, in blocks of CLUSTER, dealt anew for each list, where all pairs are compared by scanning the block's own inverted index; the links found
are contracted. After that a list matters only where it joins two components. Its pairs, now between different components, must first pass an
exact bound (overlap is at most the sum of smaller counts over hash bins), and what passes is compared in full. A list longer than a block is cut by classes of
size first, as sets whose sizes differ by more than the level allows can't link. No link between components
is lost, and none within one is enumerated. Texts are only fetched for nodes of long lists and for pairs that pass the bound.

Cases: null texts and texts without words have empty sets, link to nothing and are their own component; a null id links to nothing and has a null
component; rows that repeat an id are one document, linked by any of its texts, and all get its component; equal rows give equal rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, forget, give_back, kept_at, slices, stored, two_columns
from .components import components, join_on_hot_key

#: Words of a shingle and least similarity, in hundredths, of operator 6.
SHINGLE, LEVEL = 3, 90
SKETCH_BITS = 18
#: Largest set that may be light, whatever the costs.
LIGHT_LIMIT = 29
#: What comparing two entries of a list costs, in entries moved.
COMPARISON = 0.01
#: Entries of a list that meet at a time, and of its sets that are first compared with each other.
BLOCK, CLUSTER = 512, 64
#: A list is long from LONG sets on; a node with SEVERAL long lists, and a quarter of its lists long, is first compared in blocks of its longest
#: SEVERAL. (Near-duplicates in large groups have such lists; the quarter keeps out those who only share common phrases, who get more as a corpus grows.)
LONG, SEVERAL = 16, 3
#: Shingles of a set that are remembered before each, so that a pair isn't made at all that it shares.
BEFORE = 12
#: Rows (of three numbers at most) of a side that is broadcast, and bytes of one that has bins.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 24_000_000
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        out = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(max(n, 1 << 16), b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word (bytes that aren't ASCII white space) in UTF-8 bytes."""
    inside = np.r_[False, ~SPACE[data], False]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return start, mix((sums[end] - sums[start]) * down[start])


def shingle_sets(texts: list[str | None], shingle: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for some in chunks(texts):
        raw = [(t or "").encode("utf-8", "surrogatepass").lower() + b" " for t in some]
        start, words = word_hashes(np.frombuffer(b"".join(raw), np.uint8))
        ends = np.searchsorted(start, np.cumsum([len(r) for r in raw]))
        n = len(words)
        runs = np.zeros(n, np.uint64)
        if n >= shingle:
            for k in range(shingle):
                runs[: n - shingle + 1] = mix(runs[: n - shingle + 1] * np.uint64(BASE) + words[k : n - shingle + 1 + k])
        low = 0
        for high in ends.tolist():
            if high - low >= shingle:
                out.append(np.unique(runs[low : high - shingle + 1]))
            elif high > low:  # the whole, shorter sequence; its length keeps it apart from shingles
                h = np.full(1, high - low, np.uint64)
                for k in range(low, high):
                    h = mix(h * np.uint64(BASE) + words[k : k + 1])
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
            low = high
    return out


def chunks(texts: list[str | None], size: int = 1 << 20):
    some, room = [], 0
    for t in texts:
        if some and room + len(t or "") > size:
            yield some
            some, room = [], 0
        some.append(t)
        room += len(t or "")
    if some:
        yield some


def least_overlap(n: int, level: int) -> int:
    """Elements that a set of n must share with any set it links with."""
    return -(-level * n // 100)


def linked(n: np.ndarray | int, m: np.ndarray | int, shared: np.ndarray | int, level: int):
    return 100 * shared >= level * (n + m - shared)


def n_subsets(n: int, level: int) -> int:
    return sum(comb(n, c) for c in range(least_overlap(n, level), n + 1))


def subset_keys(hashes: np.ndarray, level: int) -> list[tuple[int, int]]:
    """(size, hash) of each subset that could be what the set shares with a linked one."""
    n, whole = len(hashes), int(hashes.sum(dtype=np.uint64))
    values = hashes.tolist()
    out = []
    for c in range(least_overlap(n, level), n + 1):
        out += [(c, (whole - sum(gone)) & 0xFFFFFFFFFFFFFFFF) for gone in combinations(values, n - c)]
    return out


def bins(hashes: np.ndarray) -> np.ndarray:
    """How many elements fall in each of about n / 3 bins by their low bits, 255 for more."""
    size = 1 << max(4, min(14, len(hashes).bit_length() - 2))
    return np.minimum(np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8)


def may_link(n: int, m: int, a: bytes, b: bytes, level: int) -> bool:
    """False only if two sets can't link: the overlap is at most the sum over bins of the smaller count."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int64), np.frombuffer(b, np.uint8).astype(np.int64)
    if max(x.max(), y.max()) >= 255:
        return True
    while len(x) > len(y):
        x = x[: len(x) // 2] + x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] + y[len(y) // 2 :]
    return bool(linked(n, m, int(np.minimum(x, y).sum()), level))


def statistics(docs: DataFrame, shingle: int) -> tuple[np.ndarray, dict[int, int]]:
    """Sketch of shingle counts over all documents (2 ** SKETCH_BITS numbers), and how many documents have each size up to LIGHT_LIMIT."""
    schema = pa.schema([("slot", pa.int32()), ("n", pa.int64())])

    def run(batches):
        sketch, sizes = np.zeros(1 << SKETCH_BITS, np.int64), np.zeros(LIGHT_LIMIT + 1, np.int64)
        for (texts,) in slices(batches, ["text"]):
            sets = shingle_sets(texts, shingle)
            sketch += np.bincount((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
            sizes += np.bincount([min(len(s), LIGHT_LIMIT + 1) for s in sets], minlength=LIGHT_LIMIT + 2)[: LIGHT_LIMIT + 1]
        at = np.flatnonzero(sketch)
        give_back()
        yield pa.RecordBatch.from_pydict({"slot": np.r_[at, -1 - np.arange(len(sizes))], "n": np.r_[sketch[at], sizes]}, schema=schema)

    got = docs.select("text").mapInArrow(run, ddl(schema)).groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    slot, n = got["slot"].to_numpy(), got["n"].to_numpy()
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    sketch[slot[slot >= 0]] = n[slot >= 0]
    return sketch, {-1 - s: k for s, k in zip(slot[slot < 0].tolist(), n[slot < 0].tolist(), strict=True)}


def boundary(sketch: np.ndarray, sizes: dict[int, int], level: int = LEVEL) -> int:
    """The largest light size, where the cost of all sets is least, in entries that are moved: a subset is one, a shingle's place in a list is one
    and its comparisons with the list's others, of about the mean length of the sketch's counts."""
    length = float(sketch.mean())

    def cost(x: int) -> float:
        return sum(k * (n_subsets(n, level) if n <= x else (n - least_overlap(n, level) + 1) * (1 + COMPARISON * length)) for n, k in sizes.items() if n)

    return min(range(LIGHT_LIMIT + 1), key=lambda x: (cost(x), x))


SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_id", pa.binary()), ("tokens", pa.list_(pa.int64())), ("subsets", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("bins", pa.binary())])


def signatures(docs: DataFrame, sketch: np.ndarray, light: int, shingle: int, level: int) -> DataFrame:
    """doc_id, n, set_id, first tokens of the global order (heavy and boundary sets), subsets and their sizes (light sets), bins."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    crossing = least_overlap(light + 1, level)

    def run(batches):
        counts = shared.value
        for ids, texts in slices(batches, ["doc_id", "text"]):
            out: dict[str, list] = {f.name: [] for f in SIGNED}
            for i, s in zip(ids, shingle_sets(texts, shingle), strict=True):
                n = len(s)
                keys = subset_keys(s, level) if 0 < n <= light else []
                first = n - least_overlap(n, level) + 1 if n > light or n >= crossing else 0
                if first:
                    order = np.lexsort((s, counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
                row = (i, n, hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s[order[:first]].view(np.int64) if first else [], np.array([k for _, k in keys], np.uint64).view(np.int64), [c for c, _ in keys], bins(s).tobytes())
                for f, x in zip(SIGNED, row, strict=True):
                    out[f.name].append(x)
            yield pa.RecordBatch.from_pydict(out, schema=SIGNED)
        give_back()

    return docs.mapInArrow(run, "doc_id long, n long, set_id binary, tokens array<long>, subsets array<long>, sizes array<int>, bins binary")


def small(ids: DataFrame) -> DataFrame:
    """ids as a table, to be broadcast if it has BROADCAST_ROWS rows at most: else the join with the documents shuffles them."""
    ids = stored(ids)
    return kept_at(F.broadcast(ids), ids) if ids.count() <= BROADCAST_ROWS else ids


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def cluster(ids: list[int], texts: list[str], shingle: int, level: int) -> list[tuple[int, int]]:
    """Links that connect all of a block's linked sets (a forest), by scanning the block's inverted lists set by set."""
    sets = shingle_sets(texts, shingle)
    sizes = np.array([len(s) for s in sets])
    values, number, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by_value = np.argsort(number, kind="stable")
    postings, bounds = owner[by_value], np.r_[0, np.cumsum(df)]
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    at, links = np.r_[0, np.cumsum(sizes)], []
    for i in range(1, len(ids)):
        own = number[at[i] : at[i + 1]]
        own = own[df[own] > 1]
        lengths = df[own]
        which = np.repeat(bounds[own] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        shared = np.bincount(postings[which], minlength=len(ids))[:i]
        for j in np.flatnonzero(linked(sizes[i], sizes[:i], shared, level) & (shared > 0)).tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((ids[i], ids[j]))
    return links


def link_table(links: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": [a for a, _ in links], "b": [b for _, b in links]}, schema=LINK)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, level: int = LEVEL) -> DataFrame:
    """doc_id, n_shingles, component_id. shingle: words of a shingle; level: least similarity of a link, in hundredths."""
    if shingle < 1 or not 1 <= level <= 100:
        raise ValueError(f"shingle {shingle} must be 1 at least, and level {level} 1 to 100")
    docs = two_columns(df, id_col, text_col)
    sketch, sizes = statistics(docs, shingle)
    light = boundary(sketch, sizes, level)
    signed = stored(signatures(docs, sketch, light, shingle, level))
    some = signed.where("n > 0 and doc_id is not null")
    nodes = some.groupBy("set_id").agg(F.min_by(F.struct("doc_id", "n", "tokens", "subsets", "sizes", "bins"), "doc_id").alias("x"), F.count("*").alias("copies"))
    nodes = stored(nodes.select("set_id", "x.*", "copies").withColumnRenamed("doc_id", "node"))

    # An id with several sets is one document: it ties their nodes, which are named by ids too.
    sid = F.xxhash64("set_id")
    twice = small(signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(sid).alias("low"), F.max(sid).alias("high")).where("low <> high").select("doc_id"))
    own_sets = some.select("doc_id", "set_id").join(twice, "doc_id", "left_semi").distinct()
    ties = own_sets.join(nodes.select("set_id", "node"), "set_id").where("node <> doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    # Light: sharers of a subset, tied to the smallest of them.
    entries = nodes.where(F.size("subsets") > 0).select("node", "n", F.explode(F.arrays_zip("subsets", "sizes")).alias("e")).select("node", "n", F.col("e.subsets").alias("key"), F.col("e.sizes").alias("size"))
    hubs = entries.groupBy("key", "size").agg(F.min(F.struct("n", "node")).alias("hub"), F.count("*").alias("k")).where("k > 1")
    light_links = entries.join(hubs, ["key", "size"]).where(f"node <> hub.node and 100 * size >= {level} * (n + hub.n - size)").select(F.col("node").alias("a"), F.col("hub.node").alias("b"))

    # Heavy: of each set, its shingles that have a list of several sets, in the set's order, with their places and the lists' lengths.
    entries = nodes.where(F.size("tokens") > 0).select(F.xxhash64("set_id").alias("sid"), "node", "n", F.posexplode("tokens").alias("place", "token"))
    lists = entries.groupBy("token").agg(F.count("*").cast("int").alias("length")).where("length > 1")
    entries = entries.join(lists, "token").groupBy("sid", "node", "n").agg(F.sort_array(F.collect_list(F.struct("place", "token", "length"))).alias("lists"))
    heavy = stored(entries.select("sid", "node", F.col("n").cast("int").alias("n"), "lists"))

    # Sets of several long lists, each in a block of its longest few.
    ranked = F.reverse(F.array_sort(F.transform("lists", lambda x: F.struct(x["length"].alias("length"), x["token"].alias("token")))))
    n_long, n_first = F.size(F.filter("lists", lambda x: x["length"] >= LONG)), F.floor((100 - level) * F.col("n") / 100) + 1
    long = heavy.where((n_long >= SEVERAL) & (4 * n_long >= n_first)).select(F.col("node").alias("doc_id"), F.explode(F.slice(ranked, 1, SEVERAL)).alias("list")).distinct()
    first = small(long.select("doc_id", "list.token", F.pmod(F.xxhash64("doc_id", "list.token"), F.ceil(F.col("list.length") / min(BLOCK, CLUSTER))).alias("block")))

    def in_block(table: pa.Table) -> pa.Table:
        return link_table(cluster(table["doc_id"].to_pylist(), table["text"].to_pylist(), shingle, level) if table.num_rows > 1 else [])

    block_links = docs.join(first, "doc_id").groupBy("token", "block").applyInArrow(in_block, ddl(LINK))
    links = stored(light_links.union(block_links).union(ties))

    # What lists still join: pairs of different components. Long lists meet block by block: an entry goes to each pair of blocks that has its own.
    # A pair counts at the first shingle that both have; it is made again only after BEFORE shingles that they don't share.
    found = components(links)
    label = small(found)
    entries = heavy.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    entries = entries.withColumn("order", F.transform("lists", lambda x: x["token"])).select("node", "n", "component", "order", F.posexplode("lists").alias("k", "list"))
    entries = entries.select("node", "n", "component", "list.*", F.slice("order", F.greatest(F.col("k") - BEFORE, F.lit(0)) + 1, F.least("k", F.lit(BEFORE))).alias("before"))
    # Only sets of nearly one size can link: a list beyond a block is cut by sizes, each entry standing in the class of its own and, as a guest, in the next.
    own_class = F.floor(F.log(F.col("n").cast("double")) / log(100.01 / level)).cast("int") if level < 100 else F.col("n").cast("int")
    classes = F.array(own_class, own_class + 1)
    crowds = heavy.select("n", F.explode("lists").alias("list")).where(F.col("list.length") > BLOCK).select("list.token", F.explode(classes).alias("size"))
    crowds = small(crowds.groupBy("token", "size").agg(F.count("*").cast("int").alias("crowd")))
    entries = entries.withColumn("size", F.explode(F.when(F.col("length") > BLOCK, classes).otherwise(F.array(F.lit(-1))))).withColumn("guest", (F.col("length") > BLOCK) & (F.col("size") != own_class))
    entries = entries.join(crowds, ["token", "size"], "left").withColumn("length", F.coalesce("crowd", "length"))
    blocks = F.ceil(F.col("length") / BLOCK).cast("int")
    entries = entries.withColumn("own", F.pmod(F.xxhash64("node", "token"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    entries = stored(entries.select("token", "size", "guest", "node", "n", "place", "component", "before", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")))
    e, f = entries.alias("e"), entries.alias("f")
    meet = F.expr("e.token = f.token and e.size = f.size and e.x = f.x and e.y = f.y and e.node < f.node and e.component <> f.component and (e.x = e.y or e.own <> f.own) and not (e.guest and f.guest)")
    fits = F.expr(f"{level} * greatest(e.n, f.n) <= 100 * least(e.n, f.n) and {100 + level} * least(e.n - e.place, f.n - f.place) >= {level} * (e.n + f.n)")
    pairs = e.join(f, meet & fits & F.expr("not arrays_overlap(e.before, f.before)")).select(F.col("e.node").alias("a"), F.col("f.node").alias("b")).distinct()
    met = small(pairs)
    shape = nodes.select("node", "n", "bins")

    def bounded(batches):
        for batch in batches:
            good = [may_link(*r, level) for r in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("n", "m", "bins", "bins_b")), strict=True)]
            yield batch.filter(pa.array(good, pa.bool_())).select(["a", "b"])

    shaped = stored(shape.toDF("a", "n", "bins").join(met, "a"))
    size = shaped.agg(F.coalesce(F.sum(F.octet_length("bins") + 24), F.lit(0)).alias("n")).first()["n"]
    pairs = shape.toDF("b", "m", "bins_b").join(F.broadcast(shaped) if size <= BROADCAST_BYTES else shaped, "b")
    pairs = stored(pairs.mapInArrow(bounded, ddl(LINK)))
    wanted = small(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    text = stored(docs.join(wanted, "doc_id").select("doc_id", "text"))

    def compared(batches):
        for a, b, x, y in slices(batches, ["a", "b", "text", "text_b"]):
            s, t = shingle_sets(x, shingle), shingle_sets(y, shingle)
            good = [(i, j) for i, j, p, q in zip(a, b, s, t, strict=True) if linked(len(p), len(q), len(np.intersect1d(p, q, True)), level)]
            yield pa.RecordBatch.from_pydict({"a": [i for i, _ in good], "b": [j for _, j in good]}, schema=LINK)

    more = pairs.join(text.toDF("a", "text"), "a").join(text.toDF("b", "text_b"), "b").mapInArrow(compared, ddl(LINK))
    last = components(links.union(more))
    done, label = [found, label, heavy, first, links, crowds, entries, met, shaped, pairs, wanted, text, last], small(last)
    forget(*done)
    named = nodes.select("set_id", "node").join(label, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    # Rows without a set or an id need no name; a set with very many copies is looked up where its rows are.
    shares = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copied = nodes.where(F.col("copies") > max(BLOCK, signed.count() // shares)).select("set_id")  # no more than shares of them
    rows = join_on_hot_key(some.select("set_id", "doc_id", "n"), named, "set_id", copied).select("doc_id", "n", "component")
    tied = own_sets.join(named, "set_id").select("doc_id", F.col("component").alias("tied")).distinct()
    rest = signed.where("n = 0 or doc_id is null").select("doc_id", "n").join(tied, "doc_id", "left").select("doc_id", "n", F.coalesce("tied", "doc_id").alias("component"))
    return rows.unionByName(rest).toDF("doc_id", "n_shingles", "component_id")
