"""Snapshots as Parquet tables, intermediate tables in the shared folder, and a directory as a source of files."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import paths

#: Rows of a partition that spread() deals.
SPREAD_ROWS = 500_000
#: Of snapshot tables, which are kept: a little more time in writing than the default, for fewer bytes.
COMPRESSION = "zstd"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where that is unset, a session on one machine gets a folder of its own; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "/tmp/checkpoints/tessera")
    return sc._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and a lost executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys into partitions of about SPREAD_ROWS rows, counted: what a task then holds of them in memory doesn't grow with the table.

    Adaptive execution joins partitions by their compressed bytes, of which sorted or repeated numbers have few. For keys that no value of is hot.
    """
    return df.repartition(max(1, -(-df.count() // SPREAD_ROWS)), *keys)


def create_file(spark: SparkSession, path: str, text: str) -> None:
    """A small file that must not be there yet: of two who create it, one fails."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def streamed(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table as a stream of all its rows, whether it's one file or a folder of files. Spark streams folders only: a file is one that its folder holds by that name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return source.parquet(path)
    return source.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())


class Snapshots:
    """A set of tables that change together: each commit writes new folders, then points to them by one small file.

    Readers follow the newest pointer, so they see all tables of a commit or none; a failed commit leaves folders that nothing points to. Of two writers
    that begin from one version, the second fails when it comes to point, and may begin anew.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._put: list[tuple[DataFrame, str]] = []

    def _versions(self) -> list[tuple[int, str, str]]:
        try:
            rows = self.spark.read.json(f"{self.root}/_commits/*", schema="version long, name string, path string").collect()
        except Exception as e:  # no commit yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return []
        return [(r["version"], r["name"], r["path"]) for r in rows]

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """df, written to a folder that nothing points to yet. The next commit that gets what this returns points there, and doesn't write it again."""
        path = f"{self.root}/{name}/{uuid.uuid4()}"
        df.write.option("compression", COMPRESSION).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._put.append((out, path))
        return out

    def commit(self, by: tuple[str, ...] = (), **tables: DataFrame) -> int:
        """Writes tables, in folders by the columns in by, and points to them with those of the version before."""
        known = self._versions()
        version = max((v for v, _, _ in known), default=0) + 1
        current = {n: p for v, n, p in sorted(known) if v == version - 1}
        for name, df in tables.items():
            path = next((p for d, p in self._put if d is df), None)
            if path is None:
                path = f"{self.root}/{name}/{version}-{uuid.uuid4()}"
                (df.write.partitionBy(*by) if by else df.write).option("compression", COMPRESSION).parquet(path)
            current[name] = path
        self._put = []
        text = "".join(json.dumps({"version": version, "name": n, "path": p}) + "\n" for n, p in sorted(current.items()))
        create_file(self.spark, f"{self.root}/_commits/{version}/pointer.json", text)
        return version

    def read(self, name: str, version: int | None = None) -> DataFrame:
        found = sorted((v, p) for v, n, p in self._versions() if n == name and (version is None or v == version))
        if not found:
            raise KeyError(name)
        return self.spark.read.parquet(found[-1][1])


def directory(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), size, sha256 (hex), content of every file below a root, read by Spark's binary source.

    Files that would be skipped for their path or size are listed with their reason and without content.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    at = F.instr("path", base) + len(base) + 1
    rows = files.select(F.col("path").substr(at, F.lit(1 << 20)).alias("path"), F.col("length").alias("size"), "content")
    reason = paths.skip_reason(F.col("path"), F.col("size"))
    return rows.select("path", "size", reason.alias("skip"), F.when(reason.isNull(), F.sha2("content", 256)).alias("sha256"), F.when(reason.isNull(), F.col("content")).alias("content"))
