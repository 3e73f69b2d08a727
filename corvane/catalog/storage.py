"""Tables written by the sinks and read again by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.catalog.registry import query, table
from corvane.session import run_dir, through_table
from corvane.sources import files

EVENT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType())])


@query("stored_events", "SELECT event_id, user_id, event_type FROM events")
def q_events(spark, sf):
    """Run events appended in two batches, with broken lines between, and read tolerantly."""
    path = run_dir(spark, "events")
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    files.append_rows(e.filter("event_id % 2 = 0"), path)
    files.append_rows(e.filter("event_id % 2 = 1"), path)
    e.filter("event_id % 50 = 0").select(F.concat(F.lit('{"event_id": '), "event_id", F.lit(', "user')).alias("value")).write.mode("append").text(path)
    return files.read_jsonl(spark, path, EVENT)


@query("stored_page_states", """
SELECT url, event_type AS status FROM (SELECT *, 'u' || user_id AS url, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def q_states(spark, sf):
    """An append log of page states, compacted to the last line of each url."""
    path = run_dir(spark, "states")
    e = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("url"), F.col("event_type").alias("status"), "event_id")
    # files in the order of the events, written by many tasks
    e.repartitionByRange("event_id").sortWithinPartitions("event_id").select("url", "status").write.json(path)
    schema = T.StructType([T.StructField("url", T.StringType()), T.StructField("status", T.StringType())])
    return files.read_page_states(spark, path, schema)


@query("stored_keyed_log", """
WITH e AS (SELECT 'u' || user_id AS url, event_type AS status, event_id FROM events WHERE event_id % 13 <> 0)
SELECT url, status FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY event_id DESC) AS n FROM e) WHERE n = 1""")
def q_keyed_log(spark, sf):
    """The same with several lines of every url in a file of many blocks, broken and blank lines between."""
    path = run_dir(spark, "keyed-log")
    e = table(spark, sf, "events")
    good = F.to_json(F.struct(F.concat(F.lit("u"), "user_id").alias("url"), F.col("event_type").alias("status")))
    line = F.when(F.col("event_id") % 13 == 0, F.concat(F.lit('{"url": "u'), "user_id", F.lit('", "sta'))).when(F.col("event_id") % 17 == 0, F.concat(good, F.lit("\n\n[1]"))).otherwise(good)
    e.select("event_id", line.alias("value")).repartitionByRange("event_id").sortWithinPartitions("event_id").select("value").write.text(path)
    schema = T.StructType([T.StructField("url", T.StringType()), T.StructField("status", T.StringType())])
    setting, usual = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set(setting, 16_384)
        return through_table(files.read_page_states(spark, path, schema), "states")
    finally:
        spark.conf.set(setting, usual)


@query("stored_registry", """
SELECT 'raw_' || doc_id AS source_id, 'web' AS source_kind, source || ' ' || lang AS title, sha256(text) AS checksum FROM documents""")
def q_registry(spark, sf):
    """Registry rows written as JSON lines; the later line of a source wins."""
    path = run_dir(spark, "registry")
    rows = table(spark, sf, "documents", "doc_id", "text", "lang", "source").select(
        F.concat(F.lit("raw_"), "doc_id").alias("source_id"), F.lit("web").alias("source_kind"), F.concat_ws(" ", "source", "lang").alias("title"), F.sha2("text", 256).alias("checksum"))
    files.write_registry(rows, path)
    found, _ = files.read_registry(spark, path, "2026-01-01T00:00:00Z")
    return found.select("source_id", "source_kind", "title", "checksum")


@query("stored_pages", """
SELECT source || '/' || doc_id || '.md' AS path, length(text) AS chars, sha256(text) AS checksum FROM documents""")
def q_markdown(spark, sf):
    """Page texts written by range of path and read again whole."""
    path = run_dir(spark, "pages")
    d = table(spark, sf, "documents", "doc_id", "text", "source")
    pieces = d.select(F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("path"), F.lit(0).alias("part"), "text")
    files.write_pages(pieces, path, "path", ["part"])
    return spark.read.parquet(path).select("path", F.length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("checksum"))


@query("stored_vectors", """
SELECT vec_id AS id, label, len(embedding)::INTEGER AS dimensions, round(list_sum(embedding)::DOUBLE, 3) AS total FROM embeddings""")
def q_vectors(spark, sf):
    """The vector table written whole after a check of every vector."""
    path = run_dir(spark, "vectors")
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")
    files.replace_vectors(v, path, v.agg(F.max(F.size("vector"))).first()[0])
    total = F.aggregate("vector", F.lit(0.0).cast("double"), lambda a, x: a + x)
    return spark.read.parquet(path).select("id", "label", F.size("vector").alias("dimensions"), F.round(total, 3).alias("total"))


@query("stored_csv", """
SELECT c_custkey, len(CASE WHEN c_custkey % 4 = 0 THEN [1, 2] ELSE [1, 2, 3] END)::INTEGER AS width, c_name || ', "' || c_mktsegment || '"' AS cell FROM customer""")
def q_csv(spark, sf):
    """Ragged CSV lines with quoted commas and quotes."""
    path = run_dir(spark, "csv")
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    quoted = F.concat(F.lit('"'), "c_name", F.lit(', ""'), "c_mktsegment", F.lit('"""'))
    c.select(F.concat_ws(",", F.col("c_custkey").cast("string"), quoted, F.when(F.col("c_custkey") % 4 != 0, F.lit("")))).write.text(path)
    rows = files.read_csv_rows(spark, path)
    return rows.select(rows.cells[0].cast("bigint").alias("c_custkey"), F.size("cells").alias("width"), rows.cells[1].alias("cell"))


@query("stored_csv_records", """
SELECT c_custkey AS custkey, CASE c_custkey % 5 WHEN 0 THEN '' ELSE c_name END AS first_cell, CASE c_custkey % 3 WHEN 0 THEN c_mktsegment || chr(10) || chr(10) || '"' || c_nationkey || '",' || chr(10)
  ELSE c_mktsegment || ', ' || c_nationkey END AS second_cell, CASE c_custkey % 4 WHEN 0 THEN 3 ELSE 4 END::INTEGER AS width FROM customer""")
def q_csv_records(spark, sf):
    """Records with quoted line breaks, commas and quotes and with empty first cells, in files of many blocks."""
    path = run_dir(spark, "csv-records")
    k = F.col("c_custkey")
    cell = F.when(k % 3 == 0, F.concat("c_mktsegment", F.lit('\n\n"'), "c_nationkey", F.lit('",\n'))).otherwise(F.concat("c_mktsegment", F.lit(", "), "c_nationkey"))
    quoted = F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))
    first = F.when(k % 5 == 0, "").otherwise(F.col("c_name"))
    record = F.concat_ws(",", first, quoted, k.cast("string"), F.when(k % 4 != 0, F.lit("")))
    table(spark, sf, "customer").coalesce(2).select(record).write.text(path)
    rows = files.read_csv_rows(spark, path, split_bytes=4096).select("cells")
    return rows.select(
        rows.cells[2].cast("bigint").alias("custkey"), rows.cells[0].alias("first_cell"), rows.cells[1].alias("second_cell"), F.size("cells").alias("width"))


@query("sampled_urls", """
SELECT page_id, url FROM (SELECT * FROM (SELECT * FROM pages ORDER BY page_id OFFSET 20) WHERE trim(coalesce(url, '')) <> '' ORDER BY page_id LIMIT 100)""")
def q_sampled(spark, sf):
    """The sampling operator's own limit: 100 urls after the first 20."""
    return files.sample_urls(table(spark, sf, "pages", "page_id", "url"), "page_id", 100, 20)
