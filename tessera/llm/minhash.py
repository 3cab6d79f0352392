"""MinHash near-duplicates (operator 12): many universal hash minima, banding, verification by signature and by full sets, components by large-star and small-star.

A document's set is its distinct shingles of so many words (64-bit hashes). Its signature: the minima of HASHES functions a * x + b modulo 2 ** 32 over it. BANDS bands of ROWS minima are hashed;
two sets of a similarity of 0.85 share no band with a chance under 1e-10 (1 - (1 - 0.85 ** 6) ** 50). Documents with one set are one node, named by its smallest doc_id.

Sharers of a band are candidates, but a group of near copies would give the square of its size in pairs. So:
1. In a few bands (FIRST), each set meets one other of its bucket, dealt by hash; the TRIES of its partners whose signatures agree best are compared in full. Links found are contracted to
   components.
2. In all bands, what's left are buckets that join two components. Where one of them is large (over SMALL sets), the sets of the other visit it: blocks of its members meet blocks of
   visitors, a text once in each cell of two blocks, and are compared in full there, by the cell's own inverted lists. A visitor sends on one link for a cell.
3. Links found are contracted again. What then joins two components in a bucket, both small in step 1, are pairs in small buckets, and in large ones cells of two blocks each, compared by
   signature within a task. Rows of the component that has most of a large bucket never meet each other there.
A pair of steps 1 and 3 must have about equal sizes and a signature whose agreement isn't SIGMAS deviations under what the level calls for; then it's confirmed on full sets of whole texts. What a large bucket's sets of different components cost
by signature grows with their square within the bucket; no pair of them is made unless signatures agree.

Cases: null texts and texts without words have empty sets, link to nothing and are their own component; a null id links to nothing, has a null component and is kept; rows that repeat an id are
one document, linked by any of its texts, and all get its component; equal rows give equal rows; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from math import floor, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ddl, forget, give_back, slices, stored, two_columns
from .components import join_on_hot_key, star_components
from .jaccard import BASE, LINK, linked, mix, shingle_sets, small

#: Words of a shingle and least similarity, in hundredths, where a contract names no others.
SHINGLE, LEVEL = 5, 80
BANDS, ROWS = 50, 6
HASHES = BANDS * ROWS
#: Bands of the first step, and partners of a set that are compared in full there.
FIRST, TRIES = 12, 2
#: Deviations of the number of equal minima that a linked pair may stay below its mean.
SIGMAS = 7
#: Sets of a bucket up to which pairs are made at once, and of a component that isn't large; sets of a block beyond that.
SMALL, BLOCK = 64, 512
#: Members, and visitors, of a cell of a large component: their texts meet in a task.
CELL = 256
#: Odd factors and addends of the hash functions, by a rule.
FACTORS = (mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(BASE)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
ADDENDS = (mix(np.arange(HASHES + 1, 2 * HASHES + 1, dtype=np.uint64) * np.uint64(BASE)) >> np.uint64(32)).astype(np.uint32)
SIGNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_id", pa.binary()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64()))])


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(set, function): the least value of each hash function over each set. Sets aren't empty."""
    out = np.zeros((len(sets), HASHES), np.uint32)
    first = 0
    while first < len(sets):
        end, room = first, 0
        while end < len(sets) and (end == first or room + len(sets[end]) <= 1 << 16):
            room += len(sets[end])
            end += 1
        x = (np.concatenate(sets[first:end]) >> np.uint64(32)).astype(np.uint32)
        start = np.r_[0, np.cumsum([len(s) for s in sets[first:end]])[:-1]]
        values = np.empty(len(x), np.uint32)
        for k in range(HASHES):
            np.multiply(x, FACTORS[k], out=values)
            np.add(values, ADDENDS[k], out=values)
            out[first:end, k] = np.minimum.reduceat(values, start)
        first = end
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    """(set, band): a hash of the band's minima and of its number."""
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(mins), BANDS))
    for r in range(ROWS):
        keys = mix(keys * np.uint64(BASE) + mins[:, r::ROWS].astype(np.uint64))
    return keys


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n, set_id, signature (a byte of each minimum), bands. Empty sets have neither signature nor bands."""

    def run(batches):
        for ids, texts in slices(batches, ["doc_id", "text"]):
            sets = shingle_sets(texts, shingle)
            full = [i for i, s in enumerate(sets) if len(s)]
            signature, bands = [None] * len(sets), [None] * len(sets)
            if full:
                mins = minima([sets[i] for i in full])
                code = ((mins * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
                for i, c, k in zip(full, code, band_keys(mins).view(np.int64), strict=True):
                    signature[i], bands[i] = c.tobytes(), k
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "n": [len(s) for s in sets], "set_id": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "signature": signature, "bands": bands}, schema=SIGNED)
        give_back()

    return docs.mapInArrow(run, "doc_id long, n long, set_id binary, signature binary, bands array<long>")


def least_equal(level: int) -> int:
    """Equal bytes of two signatures under which a pair isn't linked but for a chance of about 1e-11."""
    p = level / 100
    return max(0, floor(HASHES * p - SIGMAS * sqrt(HASHES * p * (1 - p))))


def agreeing(pairs: DataFrame, shape: DataFrame, level: int) -> DataFrame:
    """a, b, equal (bytes of their signatures) of pairs (a, b) that may link. shape: node, n, signature."""
    least = least_equal(level)
    met = pairs.join(shape.toDF("a", "n_a", "signature_a"), "a").join(shape.toDF("b", "n_b", "signature_b"), "b").where(f"{level} * greatest(n_a, n_b) <= 100 * least(n_a, n_b)")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("signature_a", "signature_b"))
            equal = (x == y).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(equal, pa.int32())], names=["a", "b", "equal"]).filter(pa.array(equal >= least))

    return met.select("a", "b", "signature_a", "signature_b").mapInArrow(run, "a long, b long, equal int")


def confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, level: int) -> tuple[DataFrame, list[DataFrame]]:
    """Those of pairs (a, b) whose full sets link, and tables to forget afterwards. a's texts move once for each of its pairs: a should have few."""
    wanted = small(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    text = stored(docs.join(wanted, "doc_id").select("doc_id", "text"))

    def run(batches):
        for a, b, x, y in slices(batches, ["a", "b", "text", "text_b"]):
            s, t = shingle_sets(x, shingle), shingle_sets(y, shingle)
            good = [(i, j) for i, j, p, q in zip(a, b, s, t, strict=True) if len(p) and linked(len(p), len(q), len(np.intersect1d(p, q, True)), level)]
            yield pa.RecordBatch.from_pydict({"a": [i for i, _ in good], "b": [j for _, j in good]}, schema=LINK)

    return pairs.select("a", "b").join(text.toDF("a", "text"), "a").join(text.toDF("b", "text_b"), "b").mapInArrow(run, ddl(LINK)), [wanted, text]


def in_cell(level: int):
    """Pairs of a cell of two blocks of a bucket, of different components, that may link and share no band before the bucket's own: there they have met already."""
    least = least_equal(level)

    def run(t: pa.Table) -> pa.Table:
        own, node, n, component = (t[c].to_numpy() for c in ("own", "node", "n", "component"))
        signature = np.frombuffer(b"".join(t["signature"].to_pylist()), np.uint8).reshape(-1, HASHES)
        keys = t["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        band = int((keys == t["key"][0].as_py()).any(0).argmax())
        x, y = t["x"][0].as_py(), t["y"][0].as_py()
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        out: list[np.ndarray] = []
        for i in range(0, len(left), 16):
            rows = left[i : i + 16]
            equal = (signature[rows, None] == signature[None, right]).sum(2)
            few, many = np.minimum(n[rows, None], n[None, right]), np.maximum(n[rows, None], n[None, right])
            good = (equal >= least) & (component[rows, None] != component[None, right]) & (level * many <= 100 * few)
            good &= (node[rows, None] < node[None, right]) | (x != y)
            r, c = np.nonzero(good)
            fresh = ~(keys[rows[r], :band] == keys[right[c], :band]).any(1)
            r, c = r[fresh], c[fresh]
            out.append(np.stack([node[rows[r]], node[right[c]]], 1))
        pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs.max(1, initial=0) if not len(pairs) else pairs.max(1), "b": pairs.min(1, initial=0) if not len(pairs) else pairs.min(1)}, schema=LINK)

    return run


def in_group(shingle: int, level: int):
    """A link for each visitor of a cell that links with a member of it."""

    def run(t: pa.Table) -> pa.Table:
        ids, visits = t["doc_id"].to_pylist(), t["visits"].to_numpy()
        sets = shingle_sets(t["text"].to_pylist(), shingle)
        members = [i for i in np.flatnonzero(~visits).tolist() if len(sets[i])]
        out: list[tuple[int, int]] = []
        if members:
            sizes = np.array([len(sets[i]) for i in members])
            values, number = np.unique(np.concatenate([sets[i] for i in members]), return_inverse=True)
            postings = np.repeat(np.arange(len(members)), sizes)[np.argsort(number, kind="stable")]
            bounds = np.r_[0, np.cumsum(np.bincount(number))]
            for i in np.flatnonzero(visits).tolist():
                at = np.minimum(np.searchsorted(values, sets[i]), len(values) - 1)
                own = at[values[at] == sets[i]]
                lengths = bounds[own + 1] - bounds[own]
                which = np.repeat(bounds[own] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
                shared = np.bincount(postings[which], minlength=len(members))
                good = np.flatnonzero((shared > 0) & linked(len(sets[i]), sizes, shared, level))
                if len(good):
                    out.append((ids[i], ids[members[good[0]]]))
        return pa.table({"a": [a for a, _ in out], "b": [b for _, b in out]}, schema=LINK)

    return run


def visits(entries: DataFrame, label: DataFrame, large: DataFrame, docs: DataFrame, shingle: int, level: int) -> tuple[DataFrame, list[DataFrame]]:
    """Links between large components and sets of others that share a bucket with them, and tables to forget. entries: key, node, component; large: component, rows. Of two large ones the smaller visits."""
    hosts = entries.join(large, "component").select("key", F.col("component").alias("host"), F.col("rows").alias("host_rows")).distinct()
    guests = entries.join(large, "component", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    guests = guests.join(hosts, "key").where("component <> host and (rows < host_rows or rows = host_rows and component > host)")
    guests = stored(guests.select("node", F.col("host").alias("component")).distinct())
    n = stored(guests.groupBy("component").agg(F.ceil(F.count("*") / CELL).cast("int").alias("guest_blocks")).join(large.withColumn("blocks", F.ceil(F.col("rows") / CELL).cast("int")), "component").select("component", "guest_blocks", "blocks"))

    def dealt(rows: DataFrame, blocks: str, others: str, visiting: bool) -> DataFrame:
        own, other = F.pmod(F.xxhash64("node", "component"), F.col(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        rows = rows.join(n, "component").select("node", "component", own.alias("own"), other.alias("other"))
        return rows.select(F.col("node").alias("doc_id"), "component", F.lit(visiting).alias("visits"), F.col("other" if visiting else "own").alias("x"), F.col("own" if visiting else "other").alias("y"))

    cells = dealt(label.select("node", "component"), "blocks", "guest_blocks", False).unionByName(dealt(guests, "guest_blocks", "blocks", True))
    wanted = small(cells.select("doc_id").distinct())
    text = stored(docs.join(wanted, "doc_id").select("doc_id", "text"))
    found = cells.join(text, "doc_id").groupBy("component", "x", "y").applyInArrow(in_group(shingle, level), ddl(LINK))
    return found, [guests, n, wanted, text]


def large_buckets(own: DataFrame, shape: DataFrame, level: int) -> DataFrame:
    """a, b of large buckets (own: key, node, component): those of different components whose signatures may link.

    Of a bucket's components one has most rows: those go to blocks of their own, which meet the blocks of the others only.
    """
    sizes = own.groupBy("key", "component").agg(F.count("*").alias("rows")).groupBy("key").agg(F.max_by("component", "rows").alias("main"), F.max("rows").alias("main_rows"), F.sum("rows").alias("rows")).where("rows > main_rows")
    own = own.join(sizes, "key").withColumn("is_main", F.col("component") == F.col("main"))
    others = F.ceil((F.col("rows") - F.col("main_rows")) / BLOCK).cast("int")
    mains = F.ceil(F.col("main_rows") / BLOCK).cast("int")
    spot = F.pmod(F.xxhash64("node", "key"), F.when(F.col("is_main"), mains).otherwise(others)).cast("int")
    own = own.withColumn("others", others).withColumn("all", others + mains).withColumn("own", F.when(F.col("is_main"), others + spot).otherwise(spot))
    cells = F.explode(F.when(F.col("is_main"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("all") - 1)))
    own = own.withColumn("other", cells).select("key", "node", "component", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    own = own.join(shape, "node")  # with bands
    return own.groupBy("key", "x", "y").applyInArrow(in_cell(level), ddl(LINK)).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, level: int = LEVEL) -> DataFrame:
    """doc_id, n_shingles, component_id, kept. shingle: words of a shingle; level: least similarity of a link, in hundredths (80 at least, for which the bands are made)."""
    if shingle < 1 or not 80 <= level <= 100:
        raise ValueError(f"shingle {shingle} must be 1 at least, and level {level} 80 to 100")
    docs = two_columns(df, id_col, text_col)
    full = stored(signatures(docs, shingle))
    some = full.where("n > 0 and doc_id is not null")
    nodes = some.groupBy("set_id").agg(F.min_by(F.struct("doc_id", "n", "signature", "bands"), "doc_id").alias("x"), F.count("*").alias("copies"))
    nodes = stored(nodes.select("set_id", "x.*", "copies").withColumnRenamed("doc_id", "node"))
    shape = nodes.select("node", "n", "signature").dropDuplicates(["node", "signature"])
    signed = stored(full.select("doc_id", "n", "set_id"))
    forget(full)
    some = signed.where("n > 0 and doc_id is not null")

    # An id with several sets is one document: it ties their nodes, which are named by ids too.
    sid = F.xxhash64("set_id")
    twice = small(signed.where("doc_id is not null").groupBy("doc_id").agg(F.min(sid).alias("low"), F.max(sid).alias("high")).where("low <> high").select("doc_id"))
    own_sets = some.select("doc_id", "set_id").join(twice, "doc_id", "left_semi").distinct()
    ties = own_sets.join(nodes.select("set_id", "node"), "set_id").where("node <> doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    # First, a partner in each of a few bands; the best of them in full.
    entries = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    first = entries.where(F.col("band") < FIRST).select("node", "key")
    partner = small(first.groupBy("key").agg(F.count("*").alias("k"), F.min_by("node", F.xxhash64("key", "node")).alias("partner")).where("k > 1").select("key", "partner"))
    pairs = first.join(partner, "key").where("node <> partner").select(F.col("node").alias("a"), F.col("partner").alias("b")).distinct()
    best = agreeing(pairs, shape, level).groupBy("a").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("equal", "b")))), 1, TRIES).alias("x"))  # FIRST at most
    best = stored(best.select("a", F.explode("x.b").alias("b")))
    links, own = confirmed(best, docs, shingle, level)
    links = stored(links.union(ties))
    found = star_components(links)
    label = small(found)
    forget(best, partner, *own)

    # Buckets that still join two components.
    entries = entries.select("key", "node").join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = entries.groupBy("key").agg(F.count("*").cast("int").alias("k"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    mixed = small(mixed.select("key", "k"))
    entries = stored(entries.join(mixed, "key"))
    large = small(label.groupBy("component").agg(F.count("*").alias("rows")).where(F.col("rows") > SMALL))
    visiting, own = visits(entries.drop("k"), label, large, docs, shingle, level)
    more = stored(links.union(visiting))
    forget(*own)
    again = star_components(more)
    label = small(again)
    left = entries.join(large.select("component"), "component", "left_anti").drop("component").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    few = left.where(F.col("k") <= SMALL)
    e, f = few.alias("e"), few.alias("f")
    met = e.join(f, F.expr("e.key = f.key and e.node > f.node and e.component <> f.component")).select(F.col("e.node").alias("a"), F.col("f.node").alias("b")).distinct()
    many = left.where(F.col("k") > SMALL).select("key", "node", "component")
    may = stored(agreeing(met, shape, level).select("a", "b").union(large_buckets(many, nodes.select("node", "n", "signature", "bands").dropDuplicates(["node", "signature"]), level)).distinct())
    last_links, last_own = confirmed(may, docs, shingle, level)
    last = star_components(more.union(last_links))
    label = small(last)
    forget(found, links, again, more, entries, mixed, large, may, *last_own)

    named = nodes.select("set_id", "node").join(label, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    # Rows without a set or an id need no name; a set with very many copies is looked up where its rows are.
    shares = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copied = nodes.where(F.col("copies") > F.greatest(F.lit(BLOCK), F.lit(signed.count() // shares))).select("set_id")  # no more than shares of them
    rows = join_on_hot_key(some.select("set_id", "doc_id", "n"), named, "set_id", copied).select("doc_id", "n", "component")
    tied = own_sets.join(named, "set_id").select("doc_id", F.col("component").alias("tied")).distinct()
    rest = signed.where("n = 0 or doc_id is null").select("doc_id", "n").join(tied, "doc_id", "left").select("doc_id", "n", F.coalesce("tied", "doc_id").alias("component"))
    return rows.unionByName(rest).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))
