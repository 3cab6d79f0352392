"""Helpers that the training-data operators share.

Documents come in as any DataFrame with an id and a text column; every operator first
narrows to these two, so extra columns (whatever their names) neither cost a scan nor clash
with what it adds. Python stages get Arrow batches, and work through them in slices whose
text is bounded, so that a run of very long documents can't fill a worker.
"""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship
from tessera.sources.tables import shared_folder

#: ASCII white space: the bytes that separate words in every contract here.
ASCII_SPACE = " \t\n\x0b\x0c\r"
SLICE_CHARS = 4_000_000
#: Buckets of documents for each part.
BUCKETS = 2


def two_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches: Iterator[pa.RecordBatch], names: list[str], text: str = "text") -> Iterator[list[list]]:
    """Lists of the named columns, row-aligned, at most SLICE_CHARS of text at a time (a longer text comes alone)."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]
        texts, start, room = columns[names.index(text)], 0, 0
        for i, t in enumerate(texts):
            room += len(t) if t else 0
            if room > SLICE_CHARS and i > start:
                yield [c[start:i] for c in columns]
                start, room = i, len(t) if t else 0
        if start < len(texts):
            yield [c[start:] for c in columns]


def by_chars(texts: list[str | None], most: int = 1_000_000):
    """(first, end) of runs of texts with about so many characters."""
    first = room = 0
    for i, t in enumerate(texts):
        if room + len(t or "") > most and i > first:
            yield first, i
            first, room = i, 0
        room += len(t or "")
    if first < len(texts):
        yield first, len(texts)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list, list], dict]], schema: pa.Schema) -> DataFrame:
    """Runs make()'s function over (ids, texts) of each slice; it returns columns of the schema.

    make runs once in each task: it loads what the function needs. What it remembers ends with the task, as workers live on
    and serve other operators.
    """

    def run(batches):
        function = make()
        for ids, texts in slices(batches, ["doc_id", "text"]):
            yield pa.RecordBatch.from_pydict(function(ids, texts), schema=schema)
        del function
        give_back()

    return df.mapInArrow(run, ddl(schema))


def ddl(schema: pa.Schema) -> str:
    kinds = {"int64": "bigint", "int32": "int", "string": "string", "binary": "binary", "double": "double", "bool": "boolean", "float": "float", "large_binary": "binary"}
    return ", ".join(f"`{f.name}` {kinds[str(f.type)]}" for f in schema)


def words(text: str | None) -> list[bytes]:
    """Words of the contract: maximal runs of characters that aren't ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def partitions_for(df: DataFrame) -> int:
    """How many parts to deal what buckets of documents send each other into: as many as the session shuffles to, and no fewer
    than the scan has splits, however large the input. Documents themselves go to BUCKETS times as many buckets, so that a
    bucket holds about half a split's text: a Python worker has all of it at once."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on, and what a large group took would stay with it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def in_buckets(df: DataFrame, n: int) -> DataFrame:
    """Documents with bucket and tie: dealt by id and text, so that neither a hot source nor a hot id fills a bucket."""
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    return df.withColumn("tie", tie).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(n)).cast("int"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and tables, set where it wasn't."""
    return shared_folder(spark)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read from it from now on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared checkpoint folder: compressed, and read column by column. It lies in the context's own folder there."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.option("compression", compression).parquet(path)
    return kept_at(df.sparkSession.read.schema(df.schema).parquet(path), path)


def kept_at(df: DataFrame, at: str | DataFrame) -> DataFrame:
    """df, marked as what forget() deletes with a path or with the table of another frame."""
    df._stored_at = at if isinstance(at, str) else at._stored_at
    return df


def forget(*tables: DataFrame) -> None:
    """Deletes what stored() wrote. Only for tables that nothing still to be computed reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside a lambda a plain expression would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """step (a sum, say, or the greater of two; associative, with 0 as its start) over the elements up to and with each, of an array of longs. Built in runs of 256: appending to one array would cost the square."""

    def within(run: Column) -> Column:
        return F.aggregate(run, F.array(F.lit(0).cast("long")), lambda done, x: F.concat(done, F.array(step(F.element_at(done, -1), x))))

    def runs(x: Column) -> Column:
        some = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 256).cast("int")), lambda k: within(F.slice(x, k * 256 + 1, 256)))
        return F.when(F.size(x) > 0, some).otherwise(F.array().cast("array<array<long>>"))

    def joined(parts: Column) -> Column:
        before = F.aggregate(parts, F.array(F.lit(0).cast("long")), lambda done, p: F.concat(done, F.array(step(F.element_at(done, -1), F.element_at(p, -1)))))
        return let(before, lambda b: F.flatten(F.transform(parts, lambda p, k: F.transform(F.slice(p, 2, 256), lambda x: step(b[k], x)))))

    return let(values, lambda x: let(runs(x), joined))


def running_sums(lengths: Column) -> Column:
    """Sums of the elements up to and with each, of an array of longs."""
    return running(lengths, lambda a, x: a + x)
