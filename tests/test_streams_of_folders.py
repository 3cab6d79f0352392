"""A table may be one file or a folder of files: a stream of it has the same rows."""

import pytest
from pyspark.sql import functions as F

from tessera.plans import more_queries, store_queries
from tessera.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("folders"))
    for name in ("pages", "documents"):
        spark.read.parquet(f"{SF}/{name}.parquet").repartition(3).write.parquet(f"{root}/{name}.parquet")
    return root


def rows(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("query", [more_queries.changed_page_files, store_queries.stream_retries])
def test_stream_of_a_folder(spark, folders, query):
    assert rows(query(spark, folders)) == rows(query(spark, SF)) != []


def test_drained_folder_has_every_row(spark, folders):
    got = store_queries.drained(spark, folders, "documents", lambda s: s.select(F.col("doc_id").alias("id")))
    assert rows(got) == rows(fx.facts(spark, SF).select("id"))
