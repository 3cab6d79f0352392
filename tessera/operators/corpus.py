"""The document corpus: manifest sync, upserts, span checks, citations, two-tier search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.functions.text import decomposed
from tessera.operators import search
from tessera.sources.tables import written

KEY = ["namespace", "user_id", "repo_url", "path"]


def manifest_errors(manifest: DataFrame) -> DataFrame:
    """path, error of entries that make a manifest invalid: bad path, given twice, or a hash that isn't 64 hex digits."""
    n = F.count("*").over(Window.partitionBy("path"))
    rows = manifest.withColumn("n", n)
    hash_needed = paths.skip_reason(F.col("path"), F.col("size")).isNull()
    error = F.when(~F.coalesce(paths.valid(F.col("path")), F.lit(False)), "invalid path").when(F.col("n") > 1, "duplicate").when(hash_needed & ~F.coalesce(F.col("sha256").rlike("^[0-9A-Fa-f]{64}$"), F.lit(False)), "bad hash")
    return rows.withColumn("error", error).where("error is not null").select("path", "error").distinct()


def sync(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """path, action (need, unchanged, skip, orphan), reason. manifest: path, sha256 (hex), size; stored: path, sha256 (hex).

    A skipped path counts as mentioned: what is stored under it isn't orphaned.
    """
    m = manifest.select("path", F.lower("sha256").alias("sha"), paths.skip_reason(F.col("path"), F.col("size")).alias("reason"), F.lit(True).alias("named"))
    s = stored.select("path", F.lower("sha256").alias("have"))
    both = m.join(s, "path", "full_outer")
    action = F.when(F.col("named").isNull(), "orphan").when(F.col("reason").isNotNull(), "skip").when(F.coalesce(F.col("sha") == F.col("have"), F.lit(False)), "unchanged").otherwise("need")
    return both.select("path", action.alias("action"), "reason")


def skip_counts(synced: DataFrame) -> DataFrame:
    return synced.where("action = 'skip'").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def same_document(a: str, b: str) -> Column:
    """Identity of documents; a null repository means a loose file, equal to other loose files only."""
    return F.expr(" and ".join(f"{a}.{k} <=> {b}.{k}" for k in KEY))


def upsert_documents(docs: DataFrame, chunks: DataFrame, new_docs: DataFrame, new_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with new documents in place of the old of the same identity; an old document's chunks go with it."""
    replaced = docs.alias("d").join(new_docs.select(*KEY).alias("n"), same_document("d", "n"), "left_semi").select(F.col("id").alias("document_id"))
    kept = docs.alias("d").join(new_docs.select(*KEY).alias("n"), same_document("d", "n"), "left_anti")
    return kept.unionByName(new_docs, allowMissingColumns=True), chunks.join(replaced, "document_id", "left_anti").unionByName(new_chunks, allowMissingColumns=True)


def delete_documents(docs: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without the documents of a repository's paths. gone: repo_url, path."""
    hit = docs.alias("d").join(gone.alias("g"), F.expr("d.repo_url <=> g.repo_url and d.path = g.path"), "left_semi").select("id")
    return docs.join(hit, "id", "left_anti"), chunks.join(hit.withColumnRenamed("id", "document_id"), "document_id", "left_anti")


def span_errors(chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """key, ordinal, error of chunks that break the rules: ordinals dense from 0, starts that grow, sizes that match, lines that run forward."""
    w = Window.partitionBy(key).orderBy("ordinal")
    rows = chunks.withColumns({"k": F.row_number().over(w) - 1, "before": F.lag("byte_start").over(w)})
    error = (
        F.when(F.col("ordinal") != F.col("k"), "ordinal")
        .when(F.col("byte_start") <= F.col("before"), "start")
        .when(F.octet_length("content") != F.col("byte_end") - F.col("byte_start"), "size")
        .when((F.col("line_start") < 1) | (F.col("line_end") < F.col("line_start")), "lines")
    )
    return rows.withColumn("error", error).where("error is not null").select(key, "ordinal", "error")


def citation(repo: Column, commit: Column, path: Column, first: Column, last: Column) -> Column:
    """repo@commit path:L1-2, without the parts that are empty."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    origin = F.when(blank(repo) == "", "").otherwise(F.concat(repo, F.when(blank(commit) == "", "").otherwise(F.concat(F.lit("@"), commit)), F.lit(" ")))
    return F.concat(origin, blank(path), F.lit(":L"), first.cast("string"), F.lit("-"), last.cast("string"))


def manifest(docs: DataFrame, namespace: str, repo_url: str = "", user_id: int | None = None) -> DataFrame:
    """id, path, file_sha256, dirty of a repository's documents, by path. An empty repository means loose files, never all."""
    own = docs.where(F.col("namespace") == namespace)
    own = own if user_id is None else own.where(F.col("user_id") == user_id)
    own = own.where(F.col("repo_url") == repo_url) if repo_url else own.where(F.col("repo_url").isNull())
    return own.select("id", "path", "file_sha256", "dirty").orderBy("path")


def document(docs: DataFrame, document_id: int, namespace: str, user_id: int | None = None) -> DataFrame:
    """A document of the scope by its id; no row for one outside."""
    own = docs.where((F.col("id") == document_id) & (F.col("namespace") == namespace))
    return own if user_id is None else own.where(F.col("user_id") == user_id)


def document_chunks(docs: DataFrame, chunks: DataFrame, document_id: int, namespace: str, user_id: int | None = None) -> DataFrame:
    """Its chunks by ordinal; none for a document outside the scope."""
    own = chunks.where(F.col("document_id") == document_id)
    return own.join(document(docs, document_id, namespace, user_id).select(F.col("id").alias("document_id")), "document_id", "left_semi").orderBy("ordinal")


def search_documents(chunks: DataFrame, docs: DataFrame, queries: DataFrame, limit: int = 20, include_generated: bool = False, **filters: str) -> DataFrame:
    """search_chunks over chunks (id, document_id, namespace, user_id, ordinal, content) joined with their documents by id, namespace and owner, under path_filters.

    query_id, place, id, fallback, score, then repo_url and path.
    """
    kept = path_filters(docs, **filters).select(F.col("id").alias("document_id"), "namespace", "user_id", "repo_url", "path", "generated")
    rows = chunks.drop("repo_url", "path", "generated").join(kept, ["document_id", "namespace", "user_id"])
    found = search_chunks(rows, queries, limit if limit > 0 else 20, include_generated)
    return found.join(rows.select("id", "repo_url", "path"), "id").select("query_id", "place", "id", (F.col("tier") == 1).alias("fallback"), "score", "repo_url", "path")


def search_chunks(chunks: DataFrame, queries: DataFrame, limit: int = 10, include_generated: bool = False) -> DataFrame:
    """query_id, place, id, tier, score: exact matches first; only where these leave room, matches of the decomposed query on decomposed text.

    chunks: id, content, document_id, ordinal, generated. The second pass is only made for queries with room that decomposition changes; without any, it isn't made at all.
    """
    rows = chunks if include_generated else chunks.where("not generated")
    at = rows.select("id", "document_id", "ordinal")

    def placed(found: DataFrame) -> DataFrame:
        # Sums of the same terms in another order are the same score.
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "document_id", "ordinal"))
        return found.join(at, "id").withColumn("place", place).where(F.col("place") <= limit).select("query_id", "place", "id", "score")

    exact = written(placed(search.bm25(rows, queries, columns=("content",))))
    room = queries.join(exact.groupBy("query_id").agg(F.count("*").alias("_full")), "query_id", "left").withColumn("_full", F.coalesce("_full", F.lit(0))).where(F.col("_full") < limit)
    loose_queries = written(room.select("query_id", "_full", decomposed(F.col("text")).alias("text"), F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))).alias("plain")).where("text <> plain and text <> ''"))
    both = exact.withColumn("tier", F.lit(0))
    if not loose_queries.isEmpty():
        found = search.bm25(rows.select("id", decomposed(F.col("content")).alias("content")), loose_queries, columns=("content",)).join(exact.select("query_id", "id"), ["query_id", "id"], "left_anti")
        loose = placed(found).join(loose_queries.select("query_id", "_full"), "query_id").withColumn("place", F.col("place") + F.col("_full")).where(F.col("place") <= limit)
        both = both.unionByName(loose.select("query_id", F.col("place").cast("int").alias("place"), "id", "score", F.lit(1).alias("tier")))
    return both.select("query_id", "place", "id", "tier", "score")


def path_filters(docs: DataFrame, prefix: str = "", basename: str = "", lang: str = "", repo: str = "") -> DataFrame:
    """Filters of a corpus search; an empty value is no filter."""
    if prefix:
        docs = docs.where(F.col("path").startswith(prefix))
    if basename:
        docs = docs.where(paths.basename(F.col("path")) == basename)
    if lang:
        docs = docs.where(F.col("lang") == lang)
    return docs.where(F.col("repo_url") == repo) if repo else docs


def upload_errors(files: DataFrame) -> DataFrame:
    """files (path, content, sha256 in hex) with error: why an upload is refused, or null. In order: path, reason to skip, hash format, hash, text."""
    text = F.col("content").cast("string")
    error = (
        F.when(~F.coalesce(paths.valid(F.col("path")), F.lit(False)), F.lit("invalid path"))
        .when(paths.skip_reason(F.col("path"), F.octet_length("content")).isNotNull(), paths.skip_reason(F.col("path"), F.octet_length("content")))
        .when(~F.coalesce(F.col("sha256").rlike("^[0-9A-Fa-f]{64}$"), F.lit(False)), F.lit("bad hash"))
        .when(F.lower("sha256") != F.sha2("content", 256), F.lit("hash does not match"))
        .when(~F.is_valid_utf8(text) | F.contains(text, F.lit("\0")), F.lit("not text"))
    )
    return files.withColumn("error", error)
