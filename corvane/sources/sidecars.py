"""Parser metadata beside the texts: JSON sidecars as variants with a digest of their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_sidecars(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """``(path, metadata, checksum, digest, readable)`` of every sidecar file below ``root``.

    Spark lists no empty files, so an empty sidecar is like none.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return parse_sidecars(files.select("path", F.decode("content", "UTF-8").alias("content")))


def parse_sidecars(files: DataFrame) -> DataFrame:
    """The same from ``files (path, content)``.

    ``metadata`` is a variant: the object of the file, ``{"value": ...}`` around anything else, and an
    empty object where the content is no JSON. ``checksum`` is of the bytes; ``digest`` of the metadata
    in canonical form, keys in order and without white space, so that only a change of content changes it.
    """
    parsed = F.try_parse_json("content")
    whole = F.schema_of_variant(F.col("_v")).startswith("OBJECT")
    wrapped = F.parse_json(F.concat(F.lit('{"value":'), F.to_json("_v"), F.lit("}")))
    metadata = F.when(F.col("_v").isNull(), F.parse_json(F.lit("{}"))).when(whole, F.col("_v")).otherwise(wrapped)
    rows = files.select("path", "content", parsed.alias("_v")).select("path", metadata.alias("metadata"), F.sha2("content", 256).alias("checksum"), F.col("_v").isNotNull().alias("readable"))
    return rows.select("path", "metadata", "checksum", canonical_digest(F.col("metadata")).alias("digest"), "readable")


def canonical_digest(metadata: Column) -> Column:
    """Digest of a variant; variants keep the keys of their objects in order."""
    return F.sha2(F.to_json(metadata), 256)


def with_sidecars(chunks: DataFrame, sidecars: DataFrame, path: str = "metadata_path") -> DataFrame:
    """Chunks with ``parser_digest``, that of their sidecar or the empty string."""
    known = sidecars.select(F.col("path").alias(path), F.col("digest").alias("parser_digest"))
    return chunks.join(known, path, "left").withColumn("parser_digest", F.coalesce("parser_digest", F.lit("")))
