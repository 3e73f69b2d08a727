"""Benchmark decontamination by a positional inverted index.

The index is stored by blocks of documents: one row for about ``SHARD_BYTES`` of text holds the
documents, the distinct words and, for each word, its places in the block in rising order. Nothing
is shuffled to build it and a frequent word has no list longer than its block.

Windows of benchmark items come to the blocks in parts of at most ``PART_WINDOWS`` windows, which
bounds what is broadcast; each part is one pass over the stored index. In a block only windows
all of whose words occur there stay. For each of them the list of its rarest word, less the
word's offset, gives the possible beginnings, and these are intersected with the other words'
lists, from the next rarest on. All windows advance together: the lists of the words asked for
are one sorted array of (word, place), so that a step is one binary search for all beginnings.

A proximity match asks less than a phrase: every word of the window, in any order, within
``within`` consecutive words of one document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import batches_of, keep
from corvane.llm.tokens import Words, byte_class, give_back, text_blocks

WIDTH = 10
WITHIN = 15
SHARD_BYTES = 3_000_000
PART_WINDOWS = 400_000
CANDIDATES = 250_000
# a row of the index is some MB: a writer holds no more than this and looks at it after each row
GROUP_BYTES = 16_000_000
# texts, and blocks of the index, handed to a task at once
BATCH_ROWS, BATCH_BLOCKS = 1000, 2
# The contract's word characters after lower-casing, as bytes and as a Java class.
WORD_BYTES = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NONE = np.iinfo(np.int64).max


def word_list(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(item, words)``: the distinct windows of ``items (item_id, text)``.

    A window is ``width`` consecutive words; an item of fewer, but not none, is one window.
    """
    words = items.select(F.col("item_id").alias("item"), word_list(F.col("text")).alias("words")).filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - width, F.lit(0))
    at = F.explode(F.sequence(F.lit(0), last)).alias("at")
    return words.select("item", "words", at).select("item", F.slice("words", F.col("at") + 1, F.lit(width)).alias("words")).distinct()


def _index(names: list[str], shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for block in text_blocks(batches, shard_bytes, "_text"):
            words = Words(block.column("_text"), WORD_BYTES)
            coded = words.strings().dictionary_encode()
            codes = coded.indices.to_numpy()
            # a place without a word after each document, so that no phrase runs on into the next
            places = np.arange(len(codes)) + np.repeat(np.arange(len(words.counts)), words.counts)
            order = np.argsort(codes, kind="stable")
            sizes = np.bincount(codes, minlength=len(coded.dictionary))
            terms = coded.dictionary
            ends = np.frombuffer(terms.buffers()[1], np.int64)[terms.offset + 1 : terms.offset + len(terms) + 1] if len(terms) else np.zeros(0, np.int64)
            held = pa.StructArray.from_arrays([*(block.column(n) for n in names), pa.array(words.counts, pa.int64())], names=[*names, "n_words"])
            yield pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held),
                pa.array(["".join(terms.to_pylist()).encode()], pa.binary()), pa.array([ends.astype("<i4").tobytes()], pa.binary()),
                pa.array([sizes.astype("<i4").tobytes()], pa.binary()), pa.array([places[order].astype("<i4").tobytes()], pa.binary())],
                names=["shard", "docs", "terms", "term_ends", "sizes", "places"])
            shard += 1
            del words, coded, codes, places, order, sizes, terms, ends, held
        block = None
        give_back()

    return run


def build_index(docs: DataFrame, carry: list[str], text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Store the positional index of ``docs``; one row for each block of documents.

    ``docs`` in a row are the block's documents with the columns ``carry`` and ``n_words``, in the
    order of their places. Null and empty texts are documents without words; repeated rows are
    documents of their own; an empty table gives no rows.
    """
    names = [c for c in carry if c != "n_words"]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], F.col(f"`{text}`").alias("_text"))
    inner = T.StructType([*(T.StructField(f"_c{i}", rows.schema[f"_c{i}"].dataType) for i in range(len(names))), T.StructField("n_words", T.LongType())])
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("docs", T.ArrayType(inner)),
        *(T.StructField(n, T.BinaryType()) for n in ("terms", "term_ends", "sizes", "places"))])
    with batches_of(docs.sparkSession, BATCH_ROWS):
        checks = {f"parquet.{what}.size.row.check.{edge}": 1 for what in ("block", "page") for edge in ("min", "max")}
        index = keep(rows.mapInArrow(_index([f"_c{i}" for i in range(len(names))], shard_bytes), schema), "phrase-index", **{"parquet.block.size": GROUP_BYTES}, **checks)
    named = T.ArrayType(T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(names, inner.fields)), T.StructField("n_words", T.LongType())]))
    return index.withColumn("docs", F.col("docs").cast(named))


class Part:
    """Windows packed for the blocks: their words' numbers, and the items each belongs to."""

    def __init__(self, rows: pa.Table) -> None:
        lists = rows.column("words").combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().cast(pa.large_string()).dictionary_encode()
        self.vocabulary = coded.dictionary
        width = int(sizes.max(initial=1))
        grid = np.full((len(sizes), width), -1, np.int64)
        grid[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = coded.indices.to_numpy()
        # each distinct window once, with the rows it came from
        self.grid, back = np.unique(grid, axis=0, return_inverse=True) if len(grid) else (grid, np.zeros(0, np.int64))
        self.widths = (self.grid >= 0).sum(axis=1)
        order = np.argsort(back.ravel(), kind="stable")
        self.item_starts = np.searchsorted(back.ravel()[order], np.arange(len(self.grid) + 1))
        item = rows.column("item").combine_chunks().take(pa.array(order)).dictionary_encode()
        self.item_of, self.items = item.indices, item.dictionary
        self.item_of = pc.fill_null(self.item_of, len(self.items)).to_numpy().astype(np.int64)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` for each ``i``, ``sizes[i]`` of them."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class Block:
    """One row of the index, open for a part's windows."""

    def __init__(self, row: dict, counts: np.ndarray, part: Part) -> None:
        self.counts = counts
        self.firsts = np.cumsum(counts + 1) - (counts + 1)
        self.part = part
        ends = np.frombuffer(row["term_ends"], "<i4").astype(np.int64)
        terms = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate(([0], ends))), pa.py_buffer(row["terms"]))
        sizes = np.frombuffer(row["sizes"], "<i4").astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        code = pc.fill_null(pc.index_in(part.vocabulary, value_set=terms), -1).to_numpy().astype(np.int64)
        length = np.where(code >= 0, sizes[code] if len(sizes) else 0, 0)
        of = np.where(part.grid >= 0, length[part.grid], _NONE)
        self.live = np.flatnonzero(of.min(axis=1) > 0) if len(of) else np.zeros(0, np.int64)
        self.grid, self.sizes = part.grid[self.live], of[self.live]
        asked = np.unique(self.grid[self.grid >= 0])
        places = np.frombuffer(row["places"], "<i4")
        self.length, self.start = np.zeros(len(length) + 1, np.int64), np.zeros(len(length) + 1, np.int64)
        self.length[asked] = length[asked]
        self.start[asked] = np.cumsum(length[asked]) - length[asked]
        self.places = places[_ranges(starts[code[asked]], length[asked])].astype(np.int64)
        self.keys = np.repeat(asked, length[asked]) << 32 | self.places

    def doc_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, place, "right") - 1

    def has(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether the term stands at a place from ``low`` to ``high``."""
        at = np.searchsorted(self.keys, term << 32 | low)
        return (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] <= (term << 32 | high))

    def beginnings(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Windows, places of their rarest word, and its offset, in runs of about ``CANDIDATES``."""
        rarest = self.sizes.argmin(axis=1) if len(self.live) else np.zeros(0, np.int64)
        term = self.grid[np.arange(len(self.live)), rarest]
        total = np.cumsum(self.length[term])
        at = 0
        while at < len(term):
            stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CANDIDATES, "right")))
            mine = term[at:stop]
            window = np.repeat(np.arange(at, stop), self.length[mine])
            yield window, self.places[_ranges(self.start[mine], self.length[mine])], rarest[window]
            at = stop

    def matches(self, within: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows and beginnings of the phrases; windows and documents of the proximity matches."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        near: list[tuple[np.ndarray, np.ndarray]] = []
        by_size = np.argsort(self.sizes, axis=1, kind="stable")
        for window, place, offset in self.beginnings():
            if within:
                near.append(self._near(window, place, by_size, within))
            start = place - offset
            for step in range(1, self.grid.shape[1]):
                column = by_size[window, step]
                term = self.grid[window, column]
                spot = start + column
                stays = (term < 0) | ((start >= 0) & self.has(np.maximum(term, 0), np.maximum(spot, 0), spot))
                window, start = window[stays], start[stays]
            found.append((window, start))
        join = lambda pairs: tuple(np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
        (window, start), (close, doc) = join(found), join(near)
        return self.live[window], start, self.live[close], doc

    def _near(self, window: np.ndarray, place: np.ndarray, by_size: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows all of whose words lie within ``within`` words, and the document."""
        doc = self.doc_of(place)
        first, last = self.firsts[doc], self.firsts[doc] + self.counts[doc] - 1
        for step in range(1, self.grid.shape[1]):
            term = self.grid[window, by_size[window, step]]
            stays = (term < 0) | self.has(np.maximum(term, 0), np.maximum(place - within + 1, first), np.minimum(place + within - 1, last))
            window, place, doc, first, last = (x[stays] for x in (window, place, doc, first, last))
        close = np.zeros(len(window), bool)
        for back in range(within):
            low, high = np.maximum(place - back, first), np.minimum(place - back + within - 1, last)
            todo = np.flatnonzero(~close)
            for step in range(1, self.grid.shape[1]):
                term = self.grid[window[todo], by_size[window[todo], step]]
                todo = todo[(term < 0) | self.has(np.maximum(term, 0), low[todo], high[todo])]
            close[todo] = True
        pairs = np.unique(np.stack([window[close], doc[close]]), axis=1)
        return pairs[0], pairs[1]

    def spans(self, window: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents, first and last hit word (from 0) of every run of words inside a phrase."""
        total = int(self.firsts[-1] + self.counts[-1]) + 2 if len(self.counts) else 2
        change = np.bincount(start, minlength=total) - np.bincount(start + self.part.widths[window], minlength=total)
        edges = np.flatnonzero(np.diff((np.cumsum(change) > 0).view(np.int8), prepend=np.int8(0)))
        begin, end = edges[::2], edges[1::2]
        doc = self.doc_of(begin)
        return doc, begin - self.firsts[doc], end - 1 - self.firsts[doc]

    def item_pairs(self, window: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct documents and items, by document."""
        if len(window):
            window, doc = np.unique(np.stack([window, doc]), axis=1)
        sizes = self.part.item_starts[window + 1] - self.part.item_starts[window]
        item = self.part.item_of[_ranges(self.part.item_starts[window], sizes)]
        pairs = np.unique(np.stack([np.repeat(doc, sizes), item]), axis=1)
        return pairs[0], pairs[1]


def _listed(docs: np.ndarray, owners: np.ndarray, values: pa.Array) -> pa.Array:
    """The values of each of ``docs`` as a list; ``owners`` are sorted."""
    return pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(owners, docs), len(owners)), pa.int32()), values)


def _match(shared, within: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: Part = shared.value
        items = pa.concat_arrays([part.items, pa.nulls(1, part.items.type)])
        for batch in batches:
            counts = batch.column("counts")
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_buffer() for n in ("terms", "term_ends", "sizes", "places")}
                block = Block(row, counts[i].values.to_numpy().astype(np.int64), part)
                if not len(block.live):
                    continue
                window, start, close, close_doc = block.matches(within)
                doc, first, last = block.spans(window, start)
                hit_doc, hit_item = block.item_pairs(window, block.doc_of(start))
                near_doc, near_item = block.item_pairs(close, close_doc)
                docs = np.union1d(doc, near_doc)
                spans = pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(last, pa.int64())], names=["first", "last"])
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(docs), batch.column("shard")[i].as_py()), pa.int64()), pa.array(docs, pa.int32()), _listed(docs, doc, spans),
                    _listed(docs, hit_doc, items.take(pa.array(hit_item))), _listed(docs, near_doc, items.take(pa.array(near_item)))],
                    names=["shard", "at", "spans", "items", "near_items"])
                del block, row, window, start, close, close_doc
        give_back()

    return run


def find(index: DataFrame, benchmark: DataFrame, width: int = WIDTH, within: int | None = None, part_windows: int = PART_WINDOWS) -> DataFrame:
    """Every document of the index with what it holds of ``benchmark (item_id, text)``.

    Beside the columns carried by the index and ``n_words``: ``n_hit`` words inside a phrase, the
    ``spans`` of them (first and last word, from 0), the distinct ``items`` with a phrase there,
    sorted, and ``near_items``, those with a proximity match within ``within`` words (none if it
    is not given). Items without words match nothing; rows that repeat an id are one item; a null
    id is one item as well, sorted last. Documents without a match have empty lists. Carried
    columns with the names of the results are replaced.
    """
    spark = index.sparkSession
    asked = keep(windows(benchmark, width), "windows")
    parts = max(1, math.ceil(asked.count() / part_windows))
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("at", T.IntegerType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
        T.StructField("items", T.ArrayType(asked.schema["item"].dataType)), T.StructField("near_items", T.ArrayType(asked.schema["item"].dataType))])
    stored = index.select("shard", F.transform("docs", lambda d: d["n_words"]).alias("counts"), "terms", "term_ends", "sizes", "places")
    found = None
    for part in range(parts):  # a pass for each part, whose windows are bounded
        rows = asked.filter(F.pmod(F.xxhash64("words", "item"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast(Part(rows.toArrow()))
        with batches_of(spark, BATCH_BLOCKS, BATCH_BLOCKS):
            hits = keep(stored.mapInArrow(_match(shared, within), schema), "phrases")
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    if parts > 1:
        found = found.groupBy("shard", "at").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near_items")])
    # the spans of several parts can overlap
    start = F.struct(F.lit(-1).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate(F.array_sort("spans"), start, lambda acc, s: F.struct(
        F.greatest(acc["end"], s["last"]).alias("end"), (acc["n"] + F.greatest(s["last"] - F.greatest(acc["end"], s["first"] - 1), F.lit(0).cast("bigint"))).alias("n")), lambda acc: acc["n"])
    found = found.select("shard", "at", covered.alias("n_hit"), "spans", *[F.array_sort(F.array_distinct(c)).alias(c) for c in ("items", "near_items")])
    docs = index.select("shard", F.posexplode("docs").alias("at", "doc"))
    carried = [f.name for f in index.schema["docs"].dataType.elementType.fields if f.name not in ("n_hit", "spans", "items", "near_items")]
    none = lambda c: F.coalesce(F.col(c), F.array().cast(found.schema[c].dataType)).alias(c)
    return docs.join(found, ["shard", "at"], "left").select(
        *[F.col("doc").getField(c).alias(c) for c in carried], F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), *[none(c) for c in ("spans", "items", "near_items")])
