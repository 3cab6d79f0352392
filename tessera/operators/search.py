"""Lexical, vector and hybrid search. Many queries at once are the general case; one query is a table of one row.

A search of a few queries analyses the corpus once: the scan's tokens meet the queries' terms in a join, and where they stand is written, beside the length of each
document, to the shared folder; matches, statistics and counts are all read from there. Postings that are kept (sources.postings) take the scan's place.
Per-query top-k uses a group limit before the shuffle.

Cases, of every function here: null texts and columns count as empty; a query without a term finds nothing; rows that repeat an id are counted each, and where the id is named their
matches add up; rows that repeat a query's id are one query with all their words; ties go to the smaller id; empty tables give empty tables; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import cut_bytes, query_phrases, terms
from tessera.functions.vector import cosine, norm
from tessera.sources.tables import written

K1, B = 1.2, 0.75
TINY_IDF = 1e-6
#: Queries that each row meets at a time.
QUERIES_AT_ONCE = 2000


@dataclass(frozen=True)
class SearchOptions:
    max_results: int = 20
    lexical_weight: float = 0.0
    vector_weight: float = 0.0
    rerank_mode: str = "off"  # off, gate, balanced, dominant
    rerank_weight: float = 0.7
    rerank_threshold: float = 0.0
    rerank_candidates: int = 40
    rerank_bytes: int = 2800
    confirmed_boost: bool = True
    half_life_s: float = 0.0
    category_half_life_s: dict = field(default_factory=dict)

    @property
    def weights(self) -> tuple[float, float]:
        """Defaults hold only if neither weight is given."""
        return (0.6, 0.4) if self.lexical_weight == self.vector_weight == 0 else (self.lexical_weight, self.vector_weight)

    @property
    def fetch(self) -> int:
        return max(self.rerank_candidates if self.rerank_mode != "off" else 0, 2 * self.max_results)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, phrase, at, term, wanted (terms of the phrase): a row for each term of each phrase."""
    phrases = queries.select("query_id", F.posexplode(query_phrases(F.col("text"))).alias("phrase", "want"))
    return phrases.select("query_id", "phrase", F.size("want").alias("wanted"), F.posexplode("want").alias("at", "term"))


def places(docs: DataFrame, wanted: DataFrame, columns: tuple[str, ...] = ("content", "subject", "category")) -> DataFrame:
    """term, id, len, pos: where each wanted term (term) stands in each document, and a row with an empty term for the document itself. One scan."""
    tokens = docs.select("id", terms(F.concat_ws(" ", *columns)).alias("terms")).withColumn("len", F.size("terms"))
    tokens = tokens.select("id", "len", F.posexplode(F.concat(F.array(F.lit("")), "terms")).alias("pos", "term"))
    itself = wanted.sparkSession.range(1).select(F.lit("").alias("term"))
    # The terms of queries are few; the optimizer broadcasts them by their measured size.
    return tokens.join(wanted.select("term").distinct().unionByName(itself), "term").select("term", "id", "len", "pos")


def matches(found: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, phrase, id, tf, len of places: a phrase stands where all its terms do, one after the other."""
    met = found.join(asked, "term").withColumn("start", F.col("pos") - F.col("at"))
    whole = met.where("wanted = 1").select("query_id", "phrase", "id", "len", "start")
    longer = met.where("wanted > 1").groupBy("query_id", "phrase", "id", "start").agg(F.countDistinct("at").alias("n"), F.first("wanted").alias("wanted"), F.first("len").alias("len"))
    whole = whole.unionByName(longer.where("n = wanted").select("query_id", "phrase", "id", "len", "start"))
    return whole.groupBy("query_id", "phrase", "id").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def bm25(docs: DataFrame | None, queries: DataFrame, columns: tuple[str, ...] = ("content", "subject", "category"), population: DataFrame | None = None, fetch: int | None = None, found: DataFrame | None = None) -> DataFrame:
    """query_id, id, score of docs (id and text columns) that match all phrases of a query (query_id, text).

    Statistics (documents, mean length, documents with a phrase) are of population, docs itself by default. found: places of the queries' terms, if the caller has
    them already (of a scan, or of kept postings); docs isn't read then.
    """
    asked = query_terms(queries)
    if found is None:
        found = written(places(docs, asked, columns))
    stats_of = found if population is None else written(places(population, asked, columns))
    size = stats_of.where("term = ''").agg(F.count("*").alias("docs"), F.avg("len").alias("mean_len"))
    own = matches(found, asked)
    having = (own if population is None else matches(stats_of, asked)).groupBy("query_id", "phrase").agg(F.count("*").alias("having"))
    idf = F.log((F.col("docs") - F.col("having") + 0.5) / (F.col("having") + 0.5))
    idf = F.when(idf <= 0, TINY_IDF).otherwise(idf)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean_len")))
    phrases = asked.groupBy("query_id").agg(F.countDistinct("phrase").alias("phrases"))
    scored = own.join(having, ["query_id", "phrase"]).crossJoin(size)  # size is one row
    scored = scored.groupBy("query_id", "id").agg(F.sum(part).alias("score"), F.count("*").alias("matched"))
    scored = scored.join(phrases, "query_id").where("matched = phrases").select("query_id", "id", "score")
    return top(scored, fetch) if fetch else scored


def top(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k best ids of each query, ties by id. The group limit runs before the shuffle."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "id"))
    return scored.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def first_of(rows: DataFrame, by: tuple[str, ...], order: list[Column], k: Column, most: int) -> DataFrame:
    """Rows of each key in order, up to the key's own limit k, with their place (from 1). most bounds all limits; as a constant it lets each task keep that many rows of a
    key at most before they are shuffled (a group limit), and so a key that all rows have doesn't meet in one task."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("place", place).where((F.col("place") <= most) & (F.col("place") <= k))


def beside(rows: DataFrame, queries: DataFrame, key: str = "query_id") -> DataFrame:
    """Each row beside each query of a stated set. Queries are counted first and broadcast, QUERIES_AT_ONCE of them about at a time."""
    blocks = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    out = None
    for k in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == k)
        own = rows.crossJoin(F.broadcast(own))
        out = own if out is None else out.unionByName(own)
    return out


def nearest(docs: DataFrame, queries: DataFrame, fetch: int | None = None) -> DataFrame:
    """query_id, id, score: exact cosine, positive only. docs: id, embedding; queries: query_id, vector, a stated set that each row meets, in blocks. Null vectors find nothing and aren't found."""
    d = docs.where("embedding is not null").select("id", "embedding", norm(F.col("embedding")).alias("length"))
    q = queries.where("vector is not null").select("query_id", "vector", norm(F.col("vector")).alias("q_length"))
    sim = beside(d, q).select("query_id", "id", cosine(F.col("embedding"), F.col("vector"), F.col("length"), F.col("q_length")).alias("score"))
    sim = sim.where("score > 0")
    return top(sim, fetch) if fetch else sim


def merge_arms(lexical: DataFrame, vector: DataFrame, weights: tuple[float, float]) -> DataFrame:
    """query_id, id, fts (divided by the query's largest), vec, combined: each id once per query."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    left = lexical.withColumn("_best", best).select("query_id", "id", F.when(F.col("_best") > 0, F.col("score") / F.col("_best")).otherwise(F.col("score")).alias("fts"))
    both = left.join(vector.select("query_id", "id", F.col("score").alias("vec")), ["query_id", "id"], "full_outer").fillna(0.0, ["fts", "vec"])
    return both.withColumn("combined", weights[0] * F.col("fts") + weights[1] * F.col("vec"))


def fuse_score(mode: str, weight: float, rerank: Column, first: Column) -> Column:
    """A second-stage score fused with the first: balanced mixes, dominant uses the first for ties only, gate and off keep it."""
    w = weight if weight > 0 else 0.7
    return {"balanced": w * rerank + (1 - w) * first, "dominant": rerank + 1e-6 * first}.get(mode, first)


def overlap_scorer(query: Column, doc: Column) -> Column:
    """Stand-in second stage: the share of the query's distinct terms that the document has."""
    q = F.array_distinct(terms(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, terms(doc))) / F.size(q)).otherwise(F.lit(0.0))


def rerank(merged: DataFrame, docs: DataFrame, queries: DataFrame, o: SearchOptions, scorer=overlap_scorer) -> DataFrame:
    """The pool (best rerank_candidates of each query) gets a rerank score, null elsewhere; a threshold keeps only what reaches it.

    scorer None is an outage: order stays, and no threshold applies.
    """
    if o.rerank_mode == "off" or scorer is None:
        return merged.withColumn("rerank", F.lit(None).cast("double"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("combined"), "id"))
    rows = merged.withColumn("_place", place).join(docs.select("id", F.col("content").alias("_content")), "id").join(queries.select("query_id", F.col("text").alias("_query")), "query_id")
    score = scorer(F.col("_query"), cut_bytes(F.col("_content"), o.rerank_bytes))
    rows = rows.withColumn("rerank", F.when(F.col("_place") <= o.rerank_candidates, score.cast("double")))
    fused = F.when(F.col("rerank").isNotNull(), fuse_score(o.rerank_mode, o.rerank_weight, F.col("rerank"), F.col("combined"))).otherwise(F.col("combined"))
    rows = rows.withColumn("combined", fused).drop("_place", "_content", "_query")
    return rows.where(F.col("rerank") >= o.rerank_threshold) if o.rerank_threshold > 0 else rows


def boosted(rows: DataFrame, o: SearchOptions, now) -> DataFrame:
    """Trust first (0.05 a confirmation, 0.15 at most), then decay by age; a category may have its own half-life, 0 for none. now is given, never read."""
    combined = F.col("combined")
    if o.confirmed_boost:
        combined = combined + F.least(0.05 * F.coalesce("confirmed_count", F.lit(0)), F.lit(0.15))
    half = F.lit(float(o.half_life_s))
    for category, seconds in o.category_half_life_s.items():
        half = F.when(F.col("category") == category, F.lit(float(seconds))).otherwise(half)
    age = F.lit(now).cast("timestamp").cast("double") - F.col("created_at").cast("double")
    return rows.withColumn("combined", F.when(half > 0, combined * F.pow(F.lit(0.5), age / F.when(half > 0, half).otherwise(1.0))).otherwise(combined))


def search(docs: DataFrame, queries: DataFrame, o: SearchOptions = SearchOptions(), now="2025-01-01", lexical_only: bool = False, scorer=None, population: DataFrame | None = None, kept=None) -> DataFrame:
    """query_id, rank, id, fts, vec, rerank, combined. docs: scoped facts; queries: query_id, text and, unless lexical_only, vector.

    kept: postings (sources.postings) of the population, docs itself or more; texts of docs aren't analysed then, and blocks of postings that can't reach the result aren't read.
    """
    fetch = o.fetch
    lexical = bm25(docs, queries, population=population, fetch=fetch) if kept is None else kept.bm25(queries, fetch, within=docs)
    if lexical_only:
        merged = merge_arms(lexical, lexical.limit(0), (1.0, 0.0))
    else:
        merged = merge_arms(lexical, nearest(docs, queries, fetch), o.weights)
    ranked = rerank(merged, docs, queries, o, scorer)
    ranked = boosted(ranked.join(docs.select("id", "category", "confirmed_count", "created_at"), "id"), o, now)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("combined"), "id"))
    return ranked.withColumn("rank", place).where(F.col("rank") <= o.max_results).select("query_id", "rank", "id", "fts", "vec", "rerank", "combined")


def term_doc_counts(docs: DataFrame | None, words: DataFrame, columns: tuple[str, ...] = ("content", "subject", "category"), found: DataFrame | None = None) -> DataFrame:
    """word, df, docs: documents with each word, and all documents, of one population. found: places of the words, if there are any already."""
    asked = words.select(F.col("word").alias("term")).distinct()
    found = written(places(docs, asked, columns)) if found is None else found
    counts = found.select(F.col("term").alias("word"), "id").distinct().groupBy("word").agg(F.count("*").alias("df"))
    size = found.where("term = ''").agg(F.count("*").alias("docs"))
    return words.select("word").distinct().join(counts, "word", "left").fillna(0, ["df"]).crossJoin(size)
