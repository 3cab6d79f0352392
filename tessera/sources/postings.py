"""Kept postings: an index of terms that searches read instead of the texts, in segments, with top-k searches that skip what can't reach the result.

Each build or update writes one segment and touches no other:
- postings: term, tier, slice, mean, bound, docs, entries (id, len, pos: places), a row for each block, sorted by term in each file. A term's documents are dealt to tiers by their
  impact (what a document's frequency and length make of BM25, at the mean length of that time), and to slices of about SLICE documents, so that a block of a common term stays small. bound is the block's
  greatest impact; at another mean length m it is at most bound * max(1, m / mean), as the length's part of the denominator shrinks by that much at most.
- documents: id, len, terms (in order), sorted by id in each file.
- counts: term, docs: documents with a term that came (above 0) or went (below); the empty term counts documents, and lens adds their lengths.
- gone: ids that the segment replaces or deletes in all older ones.
Documents are written first, and the rest is made of them: a task packs blocks where its documents lie, and packed rows of many blocks are exchanged once, by term and slice.
So an update reads, of what is kept, the rows of changed documents only, and writes the blocks of their new texts. compact() makes one segment of all. Segments appear and go by one commit
(sources.tables.Snapshots).

A search of single terms finds each query's rarest term, whose documents hold all matches. Of its blocks the best are scored, up to LEAD times the wanted number of documents; the k-th score found
is a threshold, and of all other blocks only those are read that could exceed it with the greatest impacts of the query's other terms. Queries with phrases of several terms go by places.

Cases: null texts have no terms but count as documents; rows that repeat an id are one entry with all their places, under the length of the shortest, and each counts as a document; ids asked away that aren't there
change nothing; an update without rows is an empty segment; an empty table is an index of nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import terms
from tessera.operators import search
from tessera.session import ship
from tessera.sources.tables import Snapshots, written

TIERS = 16
#: Documents of a segment for each slice of its terms' tiers.
SLICE = 65_536
#: Places of terms for each partition of blocks.
PLACES = 1_000_000
#: Places that a task packs together.
PACK = 4_000_000
#: Batches in which packed rows leave Python, so that the JVM holds a part of them at a time.
PIECES = 8
#: What sets the slices of a term apart in the deal of buckets: a prime.
SPACED = 1_000_003
#: Documents of the rarest term that are scored first, for each that is wanted.
LEAD = 4
#: Ids up to which a change's set is broadcast.
FEW = 1_000_000
#: Terms of a stated set of queries up to which they are pushed down to the scan as values; beyond that they are joined.
VALUES = 2000


def impact(tf, length, mean: float):
    """What a frequency and a length make of BM25 at a mean length: of columns, or of arrays."""
    return tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * length / (mean or 1.0)))


def together(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    """Batches as tables that have about most values in the lists of a column (rows, if it has no lists), or one batch."""
    held, n = [], 0
    for batch in batches:
        lists = batch.column(column)
        own = len(lists.flatten()) if pa.types.is_list(lists.type) else len(lists)
        if held and n + own > most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
        held.append(batch)
        n += own
    if held:
        yield pa.Table.from_batches(held)


def flat(table: pa.Table, column: str) -> pa.Array:
    """What the lists of a column hold, in one array."""
    lists = table.column(column)
    return pa.concat_arrays([c.flatten() for c in lists.chunks]) if lists.num_chunks else pa.array([], lists.type.value_type)


def heads_of(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def lists_of(heads: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[heads, len(values)].astype("int32")), values)


def tier_of(own: np.ndarray) -> np.ndarray:
    return np.minimum(TIERS - 1, np.floor(own / (search.K1 + 1) * TIERS)).astype("int64")


def dealt(words: pa.Array, code: np.ndarray, ids: pa.Array, lens: np.ndarray, places: pa.ListArray, part: np.ndarray, mean: float, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of entries (a term's code in words, id, len, places, slice), a row for each bucket: its blocks' terms, tiers, slices and docs, and their entries one after the other."""
    tf = np.diff(places.offsets.to_numpy())
    tier = tier_of(impact(tf, lens, mean))
    hashed = np.fromiter((crc32(w) for w in words.cast(pa.binary()).to_pylist()), "int64", len(words))
    bucket = (hashed[code] + part * SPACED) % buckets
    order = np.lexsort((part, tier, code, bucket))
    code, tier, part, bucket = code[order], tier[order], part[order], bucket[order]
    heads = heads_of(bucket, code, tier, part)
    rows, docs = heads_of(bucket[heads]), np.diff(np.r_[heads, len(code)])
    first = heads[rows]
    moved = places.take(pa.array(order))
    at = moved.offsets.to_numpy()[first]
    ints = lambda x: pa.array(x.astype("int32"))
    columns = [
        ints(bucket[first]), lists_of(rows, words.take(pa.array(code[heads]))), lists_of(rows, ints(tier[heads])), lists_of(rows, ints(part[heads])), lists_of(rows, ints(docs)),
        lists_of(first, ids.take(pa.array(order))), lists_of(first, ints(lens[order])), lists_of(first, ints(tf[order])), lists_of(at, moved.values),
    ]
    packed = pa.RecordBatch.from_arrays(columns, ["bucket", "term", "tier", "slice", "docs", "id", "len", "tf", "pos"])
    step = max(1, -(-len(packed) // PIECES))
    yield from (packed.slice(i, step) for i in range(0, len(packed), step))


def packer(mean: float, slices: int, buckets: int):
    """A mapInArrow function from documents (id, len, terms) to packed blocks, as far as PACK places have their entries.

    A task's documents go to a slice until it has SLICE of them, and then to the next: documents that are packed together are of one slice mostly, so rows don't grow with the slices.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, here = 0, TaskContext.get().partitionId()
        for table in together(batches, "terms", PACK):
            part = (here + (seen + np.arange(len(table))) // SLICE) % slices
            seen += len(table)
            words = flat(table, "terms")
            if not len(words):
                continue
            n = np.concatenate([np.diff(c.offsets.to_numpy()) for c in table["terms"].chunks])
            row = np.repeat(np.arange(len(n)), n)
            coded = words.dictionary_encode()
            # Places by term, then row; the sort is stable, so places of both stay in order.
            key = coded.indices.to_numpy().astype("int64") * len(n) + row
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = heads_of(key)
            pos = (np.arange(len(row)) - (np.cumsum(n) - n)[row])[order].astype("int32")
            code, row = key[starts] // len(n), row[order][starts]
            ids = table["id"].combine_chunks().take(pa.array(row))
            yield from dealt(coded.dictionary, code, ids, table["len"].to_numpy()[row], lists_of(starts, pa.array(pos)), part[row], mean, buckets)

    return pack


def packer_of_entries(mean: float, slices: int, buckets: int):
    """The same of entries (term, id, len, pos, slice)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in together(batches, "pos", PACK):
            coded = table["term"].combine_chunks().dictionary_encode()
            places = table["pos"].combine_chunks()
            n = np.diff(places.offsets.to_numpy())
            places = lists_of(np.cumsum(n) - n, places.flatten())
            yield from dealt(coded.dictionary, coded.indices.to_numpy().astype("int64"), table["id"].combine_chunks(), table["len"].to_numpy(), places, table["slice"].to_numpy().astype("int64"), mean, buckets)

    return pack


def merger(mean: float):
    """A mapInArrow function from packed blocks to one block of each term, tier and slice, sorted. Of blocks with one key, all must be in one task."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(map(len, held)):
            return
        table = pa.Table.from_batches(held)
        number = lambda c: flat(table, c).to_numpy()
        coded = flat(table, "term").dictionary_encode()
        rank = np.empty(len(coded.dictionary), "int64")
        rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
        code, tier, part, docs, tf, lens = coded.indices.to_numpy(), number("tier"), number("slice"), number("docs"), number("tf"), number("len")
        order = np.lexsort((part, tier, rank[code]))
        place = np.empty(len(order), "int64")
        place[order] = np.arange(len(order))
        moved = pa.array(np.argsort(np.repeat(place, docs), kind="stable"))
        code, tier, part, docs = code[order], tier[order], part[order], docs[order]
        blocks = heads_of(code, tier, part)
        heads = (np.cumsum(docs) - docs)[blocks]
        places = lists_of(np.cumsum(tf) - tf, flat(table, "pos"))
        entries = pa.StructArray.from_arrays([a.take(moved) for a in (flat(table, "id"), flat(table, "len"), places)], ["id", "len", "pos"])
        columns = [
            coded.dictionary.take(pa.array(code[blocks])), pa.array(tier[blocks]), pa.array(part[blocks]), pa.array(np.full(len(blocks), mean)),
            pa.array(np.maximum.reduceat(impact(tf, lens, mean)[moved.to_numpy()], heads)), pa.array(np.add.reduceat(docs, blocks).astype("int32")), lists_of(heads, entries),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["term", "tier", "slice", "mean", "bound", "docs", "entries"])

    return merge


def kept_blocks(mean: float, n: int, places: int, id_type: T.DataType, documents: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """One block of each term, tier and slice, of documents (id, len, terms) or of entries (term, id, len, pos), whichever are given, with so many documents and places in all.

    Each task packs the blocks of its own rows, and packed rows are exchanged once, by bucket: a bucket has about PLACES places, so a task's rows don't grow with the documents, and a term's
    entries of a slice are few, however common it is. Only documents that repeat an id are brought together before: one entry a term, under the shortest length.
    """
    slices, buckets = max(1, -(-n // SLICE)), max(1, -(-places // PLACES))
    ints, whole, word = T.ArrayType(T.IntegerType()), T.IntegerType(), T.StringType()
    fields = lambda **of: T.StructType([T.StructField(k, v) for k, v in of.items()])
    out = fields(bucket=whole, term=T.ArrayType(word), tier=ints, slice=ints, docs=ints, id=T.ArrayType(id_type), len=ints, tf=ints, pos=ints)
    packed = None
    if documents is not None:
        ship(documents.sparkSession)
        rows = documents.select("id", F.col("len").cast("int").alias("len"), "terms")
        again = repeated(documents)
        if again is not None:
            same = rows["id"].eqNullSafe(again["_again"])
            met = rows.join(again, same, "left_semi").select("id", "len", F.posexplode("terms").alias("pos", "term"))
            entries = met.groupBy("term", "id").agg(F.min("len").alias("len"), F.sort_array(F.collect_list("pos")).alias("pos"))
            rows = rows.join(again, same, "left_anti")
        packed = rows.mapInArrow(packer(mean, slices, buckets), out)
    if entries is not None:
        ship(entries.sparkSession)
        rows = entries.select("term", "id", F.col("len").cast("int").alias("len"), "pos", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"))
        rows = rows.mapInArrow(packer_of_entries(mean, slices, buckets), out)
        packed = rows if packed is None else packed.unionByName(rows)
    entry = fields(id=id_type, len=whole, pos=ints)
    blocks = fields(term=word, tier=whole, slice=whole, mean=T.DoubleType(), bound=T.DoubleType(), docs=whole, entries=T.ArrayType(entry))
    return packed.repartitionById(buckets, "bucket").mapInArrow(merger(mean), blocks)


def repeated(rows: DataFrame) -> DataFrame | None:
    """_again: ids that several rows have; None, if none has."""
    again = written(rows.groupBy(F.col("id").alias("_again")).agg(F.count("*").alias("n")).where("n > 1").select("_again"))
    return None if again.isEmpty() else again


class Postings:
    def __init__(self, spark: SparkSession, root: str, columns: tuple[str, ...] = ("content", "subject", "category")):
        self.spark, self.tables, self.columns = spark, Snapshots(spark, root), columns

    def _segments(self, version: int | None = None) -> list[int]:
        known = self.tables._versions()
        last = version if version is not None else max((v for v, _, _ in known), default=0)
        emptied = [int(n.split("_")[1]) for v, n, _ in known if v == last and n.startswith("whole_")]
        return sorted(s for s in (int(n.split("_")[1]) for v, n, _ in known if v == last and n.startswith("postings_")) if s >= max(emptied, default=0))

    def _read(self, name: str, version: int | None = None) -> DataFrame:
        """A table of all segments, with the number of each row's segment."""
        out = None
        for s in self._segments(version):
            own = self.tables.read(f"{name}_{s}", version).withColumn("segment", F.lit(s))
            out = own if out is None else out.unionByName(own)
        if out is None:
            raise KeyError(name)
        return out

    def _live(self, rows: DataFrame, version: int | None = None) -> DataFrame:
        """rows (id, segment) that no later segment replaces."""
        if len(self._segments(version)) == 1:
            return rows
        gone = self._read("gone", version).groupBy(F.col("id").alias("_gone")).agg(F.max("segment").alias("_until"))
        return rows.join(gone, (F.col("id") == F.col("_gone")) & (F.col("segment") < F.col("_until")), "left_anti")

    def _commit(self, docs: DataFrame, gone: DataFrame, was: DataFrame | None, whole: bool) -> int:
        """A segment of docs. was: id, len, terms of the documents that gone takes away."""
        known = self.tables._versions()
        s = max((v for v, _, _ in known), default=0) + 1
        tokens = docs.select("id", terms(F.concat_ws(" ", *self.columns)).alias("terms")).select("id", F.size("terms").cast("long").alias("len"), "terms")
        documents = self.tables.put(f"documents_{s}", tokens.sortWithinPartitions("id"))
        n, places = documents.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        mean = places / n if n else 0.0
        postings = self.tables.put(f"postings_{s}", kept_blocks(mean, n, places, documents.schema["id"].dataType, documents))
        # A term counts once for an id, however many rows have it.
        by_term, lens = postings.select("term", F.col("docs").cast("long").alias("d")), [(n, places)]
        if was is not None:
            lens.append(tuple(-x for x in was.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()))
            old = was.select("id", F.explode(F.array_distinct("terms")).alias("term"))
            by_term = by_term.unionByName((old if repeated(was) is None else old.distinct()).select("term", F.lit(-1).cast("long").alias("d")))
        counts = by_term.groupBy("term").agg(F.sum("d").alias("docs")).where("docs <> 0").select("term", "docs", F.lit(0).cast("long").alias("lens"))
        # The empty term stands for documents.
        counts = counts.unionByName(self.spark.createDataFrame([("", *map(sum, zip(*lens)))], counts.schema))
        new = {f"postings_{s}": postings, f"documents_{s}": documents, f"counts_{s}": counts.sortWithinPartitions("term"), f"gone_{s}": gone.select("id").distinct()}
        if whole:
            new[f"whole_{s}"] = self.spark.range(1)
        return self.tables.commit(**new)

    def build(self, docs: DataFrame) -> int:
        """Postings of all documents (id and text columns), as a new version that reads no older segment."""
        return self._commit(docs, docs.select("id").limit(0), None, True)

    def update(self, changed: DataFrame, gone: DataFrame | None = None) -> int:
        """A new version, by one more segment: changed documents as they are now, without those in gone (id)."""
        out = written((changed.select("id") if gone is None else changed.select("id").unionByName(gone.select("id"))).distinct())
        low, high, n = out.agg(F.min("id"), F.max("id"), F.count("*")).first()
        kept = self._read("documents").where(F.col("id").between(low, high) if n else F.lit(False))  # reaches the scan: files are sorted by id
        was = self._live(kept.join(F.broadcast(out) if n <= FEW else out, "id", "left_semi"))
        return self._commit(changed, out, was, False)

    def compact(self) -> int:
        """A new version of one segment, made of the blocks of all: no text is read."""
        s = max(v for v, _, _ in self.tables._versions()) + 1
        documents = self.tables.put(f"documents_{s}", self._live(self._read("documents")).select("id", "len", "terms").sortWithinPartitions("id"))
        n, places = documents.agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        mean = places / n if n else 0.0
        counts = self._read("counts").groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("lens").alias("lens")).where("docs <> 0 or term = ''")
        new = {
            f"postings_{s}": kept_blocks(mean, n, places, documents.schema["id"].dataType, entries=self._entries(self._read("postings"))), f"documents_{s}": documents,
            f"counts_{s}": counts.sortWithinPartitions("term"), f"gone_{s}": documents.select("id").limit(0), f"whole_{s}": self.spark.range(1),
        }
        return self.tables.commit(**new)

    def _entries(self, blocks: DataFrame, version: int | None = None) -> DataFrame:
        """term, id, len, pos (array) of the live entries of blocks."""
        return self._live(blocks.select("segment", "term", F.explode("entries").alias("e")).select("segment", "term", "e.*"), version)

    def _of_terms(self, name: str, asked: DataFrame, version: int | None = None, also: tuple[str, ...] = ()) -> DataFrame:
        """Rows of the asked terms (term): by values that reach the scan, where there are few, else by a join."""
        words = [r["term"] for r in asked.select("term").distinct().limit(VALUES + 1).collect()]
        rows = self._read(name, version)
        if len(words) > VALUES:
            more = asked.select("term").distinct().unionByName(self.spark.createDataFrame([(w,) for w in also], "term string"))
            return rows.join(more, "term", "left_semi")
        return rows.where(F.col("term").isin(*words, *also))

    def places(self, asked: DataFrame, version: int | None = None) -> DataFrame:
        """term, id, len, pos of the asked terms (term), and a row with an empty term for each document: what search.bm25 takes as found."""
        rows = self._entries(self._of_terms("postings", asked, version), version).select("term", "id", F.col("len").cast("int").alias("len"), F.explode("pos").alias("pos"))
        docs = self._live(self._read("documents", version).select("id", "len", "segment"), version)
        return rows.unionByName(docs.select(F.lit("").alias("term"), "id", F.col("len").cast("int").alias("len"), F.lit(0).alias("pos")))

    def term_doc_counts(self, words: DataFrame, version: int | None = None) -> DataFrame:
        """word, df, docs, as search.term_doc_counts: of counts alone."""
        found = self._of_terms("counts", words.select(F.col("word").alias("term")), version, ("",))
        found = found.groupBy("term").agg(F.sum("docs").alias("df"))
        size = found.where("term = ''").select(F.col("df").alias("docs"))  # one row
        return words.select("word").distinct().join(found.withColumnRenamed("term", "word"), "word", "left").fillna(0, ["df"]).crossJoin(size)

    def bm25(self, queries: DataFrame, fetch: int, limit: Column | None = None, within: DataFrame | None = None, version: int | None = None) -> DataFrame:
        """query_id, id, score: the best fetch of each query (query_id, text), or as many as its own limit (a column of queries, fetch at most), of ids in within (id), as search.bm25 has them."""
        wanted = written(queries.groupBy("query_id").agg(F.least(F.max(F.lit(fetch) if limit is None else limit), F.lit(fetch)).cast("int").alias("k")))
        asked = written(search.query_terms(queries))
        long_ones = asked.where("wanted > 1").select("query_id").distinct()
        by_places = asked.join(long_ones, "query_id", "left_semi")
        found = None
        if not by_places.isEmpty():
            some = queries.join(long_ones, "query_id", "left_semi")
            scored = search.bm25(None, some, found=written(self.places(by_places, version)))
            found = scored if within is None else scored.join(within.select("id").distinct(), "id", "left_semi")
        single = asked.join(long_ones, "query_id", "left_anti")
        if not single.isEmpty():
            scored = self._pruned(single, wanted, within, version)
            found = scored if found is None else found.select("query_id", "id", "score").unionByName(scored)
        if found is None:
            return asked.select("query_id", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score")).limit(0)
        found = found.select("query_id", "id", "score").join(wanted, "query_id")
        return search.first_of(found, ("query_id",), [F.desc("score"), F.col("id")], F.col("k"), fetch).select("query_id", "id", "score")

    def _pruned(self, asked: DataFrame, wanted: DataFrame, within: DataFrame | None, version: int | None) -> DataFrame:
        """query_id, id, score of all that can be among the first k of each query of single terms."""
        # A word that a query repeats weighs as often: each phrase is one.
        phrases = asked.groupBy("query_id", "term").agg(F.count("*").alias("times"))
        known = self._of_terms("counts", phrases, version, ("",)).groupBy("term").agg(F.sum("docs").alias("having"), F.sum("lens").alias("lens"))
        size = known.where("term = ''").first()
        docs, mean = (size["having"], size["lens"] / size["having"] if size["having"] else 0.0) if size else (0, 0.0)
        idf = F.log((docs - F.col("having") + 0.5) / (F.col("having") + 0.5))
        weights = known.where("having > 0 and term <> ''").select("term", "having", F.when(idf <= 0, search.TINY_IDF).otherwise(idf).alias("idf"))
        weights = phrases.join(weights, "term").select("query_id", "term", "having", (F.col("idf") * F.col("times")).alias("weight"))
        blocks = self._of_terms("postings", phrases, version)
        heads = written(blocks.select("segment", "term", "tier", "slice", "docs", (F.col("bound") * F.greatest(F.lit(1.0), F.lit(mean) / F.col("mean"))).alias("bound")))
        most = heads.groupBy("term").agg(F.max("bound").alias("most"))
        # Queries whose terms all have documents; best: what the query's terms can add up to.
        weights = weights.join(most, "term")
        whole = phrases.groupBy("query_id").agg(F.count("*").alias("terms")).join(weights.groupBy("query_id").agg(F.count("*").alias("there"), F.sum(F.col("weight") * F.col("most")).alias("best")), "query_id").where("terms = there")
        weights = written(weights.join(whole.select("query_id", "terms", "best"), "query_id"))
        lead = weights.groupBy("query_id").agg(F.min_by("term", F.struct("having", "term")).alias("term"))
        # upper: no document of the block scores more. A little is added for sums in another order.
        upper = weights.join(heads, "term").withColumn("upper", (F.col("best") + F.col("weight") * (F.col("bound") - F.col("most"))) * (1 + 1e-9))
        upper = written(upper.select("query_id", "term", "segment", "tier", "slice", "docs", "upper", "weight", "terms"))
        leading = upper.join(lead, ["query_id", "term"])
        before = F.sum("docs").over(Window.partitionBy("query_id").orderBy(F.desc("upper"), "segment", "tier", "slice").rowsBetween(Window.unboundedPreceding, -1))  # of a query's blocks, not its documents
        first = leading.withColumn("before", F.coalesce(before, F.lit(0))).join(wanted, "query_id").where(F.col("before") < LEAD * F.col("k")).select("query_id", "term", "segment", "tier", "slice")
        scored = written(self._scored(blocks, upper, first, mean, within, version))
        ranked = search.first_of(scored.join(wanted, "query_id"), ("query_id",), [F.desc("score"), F.col("id")], F.col("k"), int(wanted.agg(F.coalesce(F.max("k"), F.lit(1))).first()[0]))
        least = ranked.where("place = k").select("query_id", F.col("score").alias("least"))
        upper = upper.join(least, "query_id", "left").where("least is null or upper >= least").drop("least")
        rest = upper.join(lead, ["query_id", "term"]).select("query_id", "term", "segment", "tier", "slice").join(first, ["query_id", "term", "segment", "tier", "slice"], "left_anti")
        return scored.unionByName(self._scored(blocks, upper, rest, mean, within, version))

    def _scored(self, blocks: DataFrame, upper: DataFrame, lead: DataFrame, mean: float, within: DataFrame | None, version: int | None) -> DataFrame:
        """query_id, id, score of documents in the lead blocks that the other terms' blocks in upper complete. What else upper lacks can't be in the result."""
        key = ["term", "segment", "tier", "slice"]
        chosen = lead.join(upper.select("query_id", *key, "weight", "terms"), ["query_id", *key])
        others = upper.join(lead.select("query_id", "term").distinct(), ["query_id", "term"], "left_anti").join(lead.select("query_id").distinct(), "query_id", "left_semi").select("query_id", *key, "weight", "terms")
        both = chosen.select("query_id", *key, "weight", "terms").unionByName(others)
        # Where the terms stand isn't needed, nor moved. Blocks have entries: explode() would test that, on all rows of the scan and before terms are.
        blocks = blocks.select(*key, F.transform("entries", lambda e: F.struct(e["id"].alias("id"), e["len"].alias("len"), F.size(e["pos"]).alias("tf"))).alias("entries"))
        rows = blocks.join(both, key).select("segment", "query_id", "weight", "terms", F.explode_outer("entries").alias("e")).select("segment", "query_id", "weight", "terms", "e.*")
        rows = self._live(rows, version)
        if within is not None:
            rows = rows.join(within.select("id").distinct(), "id", "left_semi")
        rows = rows.groupBy("query_id", "id").agg(F.sum(F.col("weight") * impact(F.col("tf"), F.col("len"), mean)).alias("score"), F.count("*").alias("found"), F.first("terms").alias("terms"))
        return rows.where("found = terms").select("query_id", "id", "score")
