"""Readers and writers for JSON, JSONL, markdown trees and CSV.

Readers never fail on a bad line: it is skipped and can be counted.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.text import SPACE_CHARS
from corvane.operators import registry
from corvane.operators.relational import latest_per_key, union_all
from corvane.session import through_table

CORRUPT = "_corrupt"
LISTED = 10_000  # names of a folder in one batch
HELD_BYTES = 4 << 20  # contents of files in one batch
SHARE_BYTES = 64 << 20  # contents of files in one task
HIDDEN = re.compile(r"_[^=]*$|\.|.*\._COPYING_$")


def read_jsonl(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines; blank, malformed and non-object lines are skipped."""
    return read_jsonl_checked(spark, path, schema).filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_jsonl_checked(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """The same with ``_corrupt`` holding the text of each bad line."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_lines(spark: SparkSession, path) -> DataFrame:
    """``(path, pos, value)`` of text files; ``pos`` (block of the file, line in it) orders the lines of a file.

    Files are split, so a log of any size is read by many tasks.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("line")).alias("pos"), "value")
    return lines.filter(F.btrim("value", F.lit(SPACE_CHARS)) != "")


def read_keyed_log(spark: SparkSession, path, schema: T.StructType, key: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, corrupt)``: the last valid line of each key, and the lines that do not parse."""
    lines = read_lines(spark, path)
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = lines.withColumn("row", F.from_json("value", full, {"columnNameOfCorruptRecord": CORRUPT}))
    corrupt = parsed.filter(F.col(f"row.{CORRUPT}").isNotNull()).select("path", "pos", "value")
    rows = parsed.filter(F.col(f"row.{CORRUPT}").isNull() & (F.coalesce(F.col(f"row.{key}"), F.lit("")) != "")).select(
        F.struct("path", "pos").alias("_seq"), "row.*").drop(CORRUPT)
    return latest_per_key(rows, [key], "_seq").drop("_seq"), corrupt


def read_registry(spark: SparkSession, path, now: str) -> tuple[DataFrame, DataFrame]:
    """Registry rows with defaults, last line of a source wins; and the corrupt lines."""
    rows, corrupt = read_keyed_log(spark, path, registry.SCHEMA, "source_id")
    return registry.with_defaults(rows, now), corrupt


def write_registry(rows: DataFrame, path: str) -> None:
    """Registry as JSON lines in key order, in a new folder."""
    rows.orderBy("source_id").write.json(path)


def read_page_states(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Append log of page states compacted to the last row of each URL."""
    return read_keyed_log(spark, path, schema, "url")[0]


def read_json_document(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """Rows of whole-file JSON arrays or objects.

    Of a file with something after its first JSON value only that value is read.
    """
    wanted = json.loads(schema.json())
    names = [f["name"] for f in wanted["fields"]]

    def first_value(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = json.JSONDecoder()
        for batch in batches:
            rows = []
            for text in batch["value"]:
                try:
                    value, _ = decoder.raw_decode(text.lstrip("﻿ \t\r\n"))
                except ValueError:
                    continue
                rows += [json.dumps(v) for v in (value if isinstance(value, list) else [value]) if isinstance(v, dict)]
            yield pd.DataFrame({"value": rows}, dtype="object")

    files = spark.read.text(path, wholetext=True)
    parsed = files.mapInPandas(first_value, "value string").select(F.from_json("value", schema).alias("row"))
    return parsed.select(*[F.col(f"row.{n}").alias(n) for n in names])


def _tree_place(root: str):
    """Store and folder of ``root``, or None if pyarrow does not reach it."""
    from pyarrow import ArrowInvalid, fs

    try:
        return fs.FileSystem.from_uri(root)
    except (ArrowInvalid, NotImplementedError, OSError):
        return None


def _listed(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = _tree_place(root)
        for batch in batches:
            for folder in batch["path"]:
                at = f"{base}/{folder}".rstrip("/")
                # what Spark's readers pass over
                found = [f for f in store.get_file_info(fs.FileSelector(at)) if not HIDDEN.match(f.base_name)]
                found = [f for f in found if f.type == fs.FileType.Directory or (f.is_file and f.base_name.endswith(".md"))]
                for start in range(0, len(found), LISTED):
                    part = found[start : start + LISTED]
                    yield pd.DataFrame({
                        "path": [f"{folder}/{f.base_name}".lstrip("/") for f in part], "folder": [not f.is_file for f in part],
                        "size": [f.size or 0 for f in part], "ms": [(f.mtime_ns or 0) // 1_000_000 for f in part]})

    return run


def _contents(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _tree_place(root)
        for batch in batches:
            rows, held = [], 0
            for path, ms in zip(batch["path"], batch["ms"]):
                with store.open_input_stream(f"{base.rstrip('/')}/{path}", compression=None) as at:
                    content = at.read()
                rows.append((path, content, len(content), ms))
                held += len(content)
                if held >= HELD_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "content", "length", "ms"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["path", "content", "length", "ms"])

    return run


def read_markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(path, text, size_bytes, modified_at, checksum)`` of every markdown file below ``root``.

    Paths are relative to ``root``. Tasks list the folders, level by level, and read the files, shares
    of them by their bytes: Spark's own scan keeps all file names on the driver and makes a task of
    every 32 small files. It is left for stores that pyarrow does not reach.
    """
    root = root if ":/" in root else os.path.abspath(root)
    place = _tree_place(root)
    if place is None:
        files = (
            spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
        )
        clean = root.rstrip("/") if "://" in root else re.sub("^file:/+", "/", root).rstrip("/")
        relative = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + clean.replace(".", r"\.") + "/", "")
        files = files.select(relative.alias("path"), "content", "length", F.col("modificationTime").alias("modified_at"))
    else:
        from pyarrow import fs

        if place[0].get_file_info(place[1]).type != fs.FileType.Directory:
            raise FileNotFoundError(root)
        cores = spark.sparkContext.defaultParallelism
        levels, folders = [], spark.createDataFrame([("",)], "path string")
        while True:
            dealt = folders.select("path").repartition(cores)
            level = through_table(dealt.mapInPandas(_listed(root), "path string, folder boolean, size bigint, ms bigint"), "tree-level")
            levels.append(level.filter(~F.col("folder")))
            folders = level.filter("folder")
            if folders.isEmpty():
                break
        names = union_all(levels)
        parts = max(cores, -(-(names.agg(F.sum("size")).first()[0] or 0) // SHARE_BYTES))
        read = names.select("path", "ms").repartition(parts, F.xxhash64("path")).mapInPandas(
            _contents(root), "path string, content binary, length bigint, ms bigint")
        files = read.select("path", "content", "length", F.timestamp_millis("ms").alias("modified_at"))
    return files.select(
        "path", F.decode("content", "UTF-8").alias("text"), F.col("length").alias("size_bytes"), "modified_at", F.sha2("content", 256).alias("checksum"))


def latest_report(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Newest parseable JSON report below ``root``: ``(path, modified_at, value)``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)
    rows = files.select("path", F.col("modificationTime").alias("modified_at"), F.decode("content", "UTF-8").alias("value"))
    return rows.filter(F.try_parse_json("value").isNotNull()).orderBy(F.col("modified_at").desc(), F.col("path").desc()).limit(1)


# a field that is complete on its line, after its comma; never matched from inside its quotes
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"[^,]*+'
_FIELD = rf',(?:{_QUOTED}|(?!")[^,]*+)'
_CLOSING = r'^[^"]*+(?:""[^"]*+)*+"[^,]*+'


def _scanned(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """What the rows before each one do to the state "inside quotes", as ``_turns`` and ``_last``.

    A row either toggles the state (``_toggle`` 1), leaves it, or sets it (``_sets`` not null), so the
    rows before amount to the last one that sets it and the number of toggles since.
    """
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    turned = rows.withColumn("_turns", F.coalesce(F.sum("_toggle").over(before), F.lit(0)))
    return turned.withColumn("_last", F.max(F.when(F.col("_sets").isNotNull(), F.struct(order, "_sets", "_turns"))).over(before))


def _odd(n: Column) -> Column:
    return n % 2 == 1


def _csv_lines(spark: SparkSession, path, split_bytes: int | None = None) -> DataFrame:
    """``(path, block, pos, value, inside, open)`` of every line: whether it begins and whether it ends in quotes.

    Blocks of a file are split by Spark; each is summed up in one row, and what the blocks before
    amount to tells whether a block begins in quotes.
    """
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"), "value")
    rest = lambda line: F.regexp_replace(line, _FIELD, "")
    opens = rest(F.concat(F.lit(","), "value")) != ""
    closes = F.col("value").rlike(_CLOSING) & (rest(F.regexp_replace("value", _CLOSING, "")) == "")
    judged = raw.withColumn("_opens", opens).withColumn("_closes", closes)
    judged = judged.withColumn("_sets", F.when(F.col("_opens") != F.col("_closes"), F.col("_opens"))).withColumn("_toggle", (F.col("_opens") & F.col("_closes")).cast("long"))
    setting, usual = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        if split_bytes:
            spark.conf.set(setting, split_bytes)
        lines = through_table(judged, "csv-lines")
    finally:
        spark.conf.set(setting, usual)
    scanned = _scanned(lines, ["path", "block"], "pos")
    sums = scanned.groupBy("path", "block").agg(F.max(F.when(F.col("_sets").isNotNull(), F.struct("pos", "_sets", "_turns"))).alias("_at"), F.sum("_toggle").alias("_all"))
    blocks = sums.select(
        "path", "block", F.when(F.col("_at").isNotNull(), F.col("_at._sets") != _odd(F.col("_all") - F.col("_at._turns"))).alias("_sets"),
        F.when(F.col("_at").isNull(), F.col("_all") % 2).otherwise(0).alias("_toggle"))
    before = lambda entry: F.when(F.col("_last").isNull(), entry != _odd(F.col("_turns"))).otherwise(F.col("_last._sets") != _odd(F.col("_turns") - F.col("_last._turns")))
    entries = _scanned(blocks, ["path"], "block").select("path", "block", before(F.lit(False)).alias("_entry"))
    met = scanned.join(entries, ["path", "block"]).withColumn("inside", before(F.col("_entry")))
    return met.select("path", "block", "pos", "value", "inside", F.when(F.col("inside"), ~F.col("_closes")).otherwise(F.col("_opens")).alias("open"))


def read_csv_rows(spark: SparkSession, path, split_bytes: int | None = None) -> DataFrame:
    """``(path, pos, cells)`` of CSV files: all text, ragged rows keep their own width.

    Files are split; ``pos`` (block of the file and line in it) orders the records of a file. Cells
    may be quoted, quotes doubled within, and hold line breaks, so a record may span lines, and
    blocks. Quotes inside a plain cell are text, as is what follows a closing quote; a quote that is
    never closed takes the rest of the file. A blank line is a record without cells. ``split_bytes``
    is the size of a block, that of the session unless given.
    """
    lines = _csv_lines(spark, path, split_bytes)
    place = F.struct("block", "pos")
    whole = lines.filter(~F.col("inside") & ~F.col("open")).select("path", place.alias("pos"), F.col("value").alias("record"))
    # lines of records that span several, with the line each begins on
    parts = lines.filter(F.col("inside") | F.col("open")).withColumn("at", place).withColumn("first", F.when(~F.col("inside"), F.col("at")))
    upto = Window.partitionBy("path", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    own = parts.withColumn("first", F.max("first").over(upto))
    borders = parts.groupBy("path", "block").agg(F.max("first").alias("_latest"))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    borders = borders.select("path", "block", F.max("_latest").over(earlier).alias("_before"))
    begun = own.join(borders, ["path", "block"]).withColumn("first", F.coalesce("first", "_before"))
    spanning = begun.groupBy("path", F.col("first").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("_lines")).select(
        "path", "pos", F.array_join(F.transform("_lines", lambda x: x["value"]), "\n").alias("record"))
    first = (F.col("pos.block") == 0) & (F.col("pos.pos") == 0)
    text = F.regexp_replace(F.when(first, F.regexp_replace("record", "^﻿", "")).otherwise(F.col("record")), r"\r$", "")
    # a comma before every cell: an empty match would pass over the one after it
    found = F.regexp_extract_all(F.concat(F.lit(","), "_text"), F.lit(rf',({_QUOTED}|"[\s\S]*+|(?!")[^,]*+)'), F.lit(1))
    opened = r'^"([^"]*+(?:""[^"]*+)*+)"?([\s\S]*+)$'
    plain = lambda c: F.when(c.startswith('"'), F.concat(F.replace(F.regexp_extract(c, opened, 1), F.lit('""'), F.lit('"')), F.regexp_extract(c, opened, 2))).otherwise(c)
    cells = F.when(F.col("_text") == "", F.array().cast("array<string>")).otherwise(F.transform(found, plain))
    return whole.unionByName(spanning).withColumn("_text", text).select("path", "pos", cells.alias("cells"))


def append_rows(rows: DataFrame, path: str) -> None:
    """Append JSON lines: run events, ledgers, metric events."""
    rows.write.mode("append").json(path)


def replace_vectors(rows: DataFrame, path: str, dimensions: int) -> int:
    """Write a vector table ``(id, vector, ...)`` whole, or not at all.

    Every row must have a vector of exactly ``dimensions``; else nothing is written.
    """
    bad = rows.filter(F.coalesce(F.size("vector"), F.lit(-1)) != dimensions).count()
    if bad:
        raise ValueError(f"{bad} rows without a vector of {dimensions} dimensions")
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path).count()


def write_pages(pieces: DataFrame, path: str, key: str, order: list[str], text: str = "text") -> None:
    """Ordered text pieces of pages; range-partitioned, so a large page spans tasks."""
    ranged = pieces.repartitionByRange(F.col(key), *[F.col(c) for c in order]).sortWithinPartitions(key, *order)
    ranged.select(key, *order, text).write.parquet(path)


def write_markdown_tree(rows: DataFrame, root: str) -> None:
    """One file for each of ``rows (path, text)`` below ``root``, written by tasks; the later of equal paths wins.

    A file is replaced whole. ``root`` is a folder of a store that pyarrow reaches.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import posixpath

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        made: set[str] = set()
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                target = posixpath.join(base, path)
                folder = posixpath.dirname(target)
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(target) as out:
                    out.write((text or "").encode())
            yield pd.DataFrame({"n": [len(batch)]})

    rows.select("path", "text").mapInPandas(run, "n bigint").write.format("noop").mode("overwrite").save()


def sample_urls(rows: DataFrame, order: str, limit: int, offset: int = 0) -> DataFrame:
    """``limit`` non-blank URLs after the first ``offset`` rows in ``order``."""
    rest = rows.orderBy(order).offset(offset).filter(F.trim(F.coalesce("url", F.lit(""))) != "")
    return rest.orderBy(order).limit(max(1, limit))
