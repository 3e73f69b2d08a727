"""Reading tables, sizing partitions and the two scopes shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import shared_dir

# The white space of the contracts, as a Java and a Python class.
SPACE = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One of the given tables, cut to ``columns`` where it is read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def in_fold(doc_id: str | Column, modulus: int, rest: int = 2) -> Column:
    """Whether ``crc32(doc_id as text) mod modulus`` is ``rest``; false for a null id."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string")) % modulus == rest, F.lit(False))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column, by one aggregate over it."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared folder of the cluster."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def keep(df: DataFrame, label: str, **options: str | int) -> DataFrame:
    """Write rows to the shared folder, with ``options`` of the writer, and read them back, which cuts the lineage."""
    path = fresh_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int, read_rows: int | None = None) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is run inside; rows with whole texts are large.

    With ``read_rows`` a scan decodes no more rows than these at a time.
    """
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows}
    if read_rows is not None:
        settings["spark.sql.parquet.columnarReaderBatchSize"] = read_rows
    usual = {setting: spark.conf.get(setting) for setting in settings}
    try:
        for setting, value in settings.items():
            spark.conf.set(setting, value)
        yield
    finally:
        for setting, value in usual.items():
            spark.conf.set(setting, value)
