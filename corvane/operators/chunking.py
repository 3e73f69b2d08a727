"""Cutting long text into overlapping character windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions.text import strip


def explode_chunks(
    df: DataFrame, text: str = "text", size: int = 1600, overlap: int = 200, index: str = "chunk_index"
) -> DataFrame:
    """One row per window of ``size`` characters, numbered from 1.

    Runs of three or more line breaks are folded and the ends trimmed first. A window
    starts ``size - overlap`` characters after the one before; the last one ends at
    the end of the text. Empty windows are dropped before numbering. The window
    starts follow in closed form from the length, so no row is looped over.
    """
    step = max(size - overlap, 1)
    cleaned = df.withColumn("_c", strip(F.regexp_replace(F.col(text), "\n{3,}", "\n\n")))
    sized = cleaned.withColumn("_n", F.length("_c")).filter(F.col("_n") > 0)
    last = F.when(F.col("_n") <= size, 0).otherwise(F.ceil((F.col("_n") - size) / F.lit(float(step))))
    starts = F.sequence(F.lit(0), last.cast("int"))
    pieces = F.transform(starts, lambda i: strip(F.substring(F.col("_c"), i * step + 1, F.lit(size))))
    keep = [c for c in df.columns if c != text]
    return sized.select(
        *keep, F.posexplode(F.filter(pieces, lambda p: p != "")).alias("_i", text)
    ).select(*keep, (F.col("_i") + 1).alias(index), text)


def explode_page_chunks(
    df: DataFrame, text: str = "text", size: int = 1200, overlap: int = 200, index: str = "chunk_index"
) -> DataFrame:
    """PDF page windows: no trimming, numbered from 0, tail windows are kept.

    Windows go on while their start lies inside the text, so the last one may lie
    wholly inside the one before.
    """
    size = max(1, size)
    step = size - min(max(0, overlap), size - 1)
    sized = df.withColumn("_n", F.length(text)).filter(F.col("_n") > 0)
    starts = F.sequence(F.lit(0), (F.ceil(F.col("_n") / F.lit(float(step))) - 1).cast("int"))
    pieces = F.transform(starts, lambda i: F.substring(F.col(text), i * step + 1, F.lit(size)))
    keep = [c for c in df.columns if c != text]
    return sized.select(*keep, F.posexplode(pieces).alias(index, text))


def pack_blocks(df: DataFrame, text: str = "text", limit: int = 20_000, index: str = "part_index", count: str | None = None) -> DataFrame:
    """Greedy packing of blank-line separated blocks into parts of ``limit`` characters.

    A block over the limit closes the open part and is cut hard. The fold runs over
    one text's own blocks inside the row; numbering starts at 1 after empty parts
    are dropped. ``count`` names a column for the number of parts of the text.
    """
    cleaned = df.withColumn("_c", strip(F.col(text))).filter(F.col("_c") != "")
    blocks = F.filter(F.transform(F.split("_c", "\n{2,}"), strip), lambda b: b != "")
    hard = lambda b: F.transform(
        F.sequence(F.lit(0), (F.ceil(F.length(b) / F.lit(float(limit))) - 1).cast("int")),
        lambda i: strip(F.substring(b, i * limit + 1, F.lit(limit))),
    )
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, block):
        done, opened = acc["done"], acc["open"]
        closed = F.when(opened != "", F.concat(done, F.array(opened))).otherwise(done)
        joined = F.concat(opened, F.lit("\n\n"), block)
        return (
            F.when(F.length(block) > limit, F.struct(F.concat(closed, hard(block)).alias("done"), F.lit("").alias("open")))
            .when(opened == "", F.struct(done.alias("done"), block.alias("open")))
            .when(F.length(joined) > limit, F.struct(closed.alias("done"), block.alias("open")))
            .otherwise(F.struct(done.alias("done"), joined.alias("open")))
        )

    folded = F.aggregate(
        blocks, zero, step,
        lambda acc: F.when(acc["open"] != "", F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"]),
    )
    parts = F.when(F.length("_c") <= limit, F.array(F.col("_c"))).otherwise(folded)
    keep = [c for c in df.columns if c != text]
    packed = cleaned.select(*keep, F.filter(parts, lambda p: p != "").alias("_parts"))
    counted = [F.size("_parts").alias(count)] if count else []
    return packed.select(*keep, *counted, F.posexplode("_parts").alias("_i", text)).select(
        *keep, *([count] if count else []), (F.col("_i") + 1).alias(index), text)
