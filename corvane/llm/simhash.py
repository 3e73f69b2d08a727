"""Near-duplicate groups by SimHash fingerprints.

Fingerprints are compared through their segments of two bits. The bit count of a segment
is 0, 1 or 2, and the Manhattan distance of two count vectors is at most the Hamming
distance of the fingerprints. Written as unary digits (00, 01, 11) a count vector is again
64 bits, and its Manhattan distance to another is the number of differing bits.

The 32 segments form three bands with radii 1, 1 and 0. If two vectors lie within
Manhattan distance 4, some band lies within its radius, since 2 + 2 + 1 > 4. So a
fingerprint stands in the grid cell of its counts in each band, and in bands of radius 1
also in the cells one count higher; two vectors one count apart share the higher one's
cell. Within a cell pairs pass the Manhattan bound first and the exact Hamming test next.

Equal fingerprints are one row before all this. A cell leaves a spanning forest of its
links, not its pairs, and a cell of over ``CELL_ROWS`` fingerprints is cut into blocks
whose pairs are compared block by block, so no task holds it whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import keep
from corvane.llm.components import components

WORDS = 4
DISTANCE = 4
SEED = 42
CELL_ROWS = 4096
SMALL_CELL = 64
# first segment, segments and radius of the bands; the radii plus one add up to over DISTANCE
BANDS = ((0, 11, 1), (11, 11, 1), (22, 10, 0))
_LOW = 0x5555555555555555


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 bits: set where over half of the shingles' hashes have the bit."""
    tokens = (text or "").encode("utf-8").lower().split()
    if not tokens:
        return 0
    flat = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(flat, SEED)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist())
    hashes = np.fromiter((digest(flat[a:b], SEED) for a, b in spans), np.uint64, len(tokens) - words + 1)
    return bit_majority(hashes)


def bit_majority(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes, counted in runs of bounded size."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64), pa.int64())], names=["doc_id", "bits"])

    return run


def unary(bits: np.ndarray) -> np.ndarray:
    """Counts of the two-bit segments as unary digits."""
    low, high = bits & np.uint64(_LOW), (bits >> np.uint64(1)) & np.uint64(_LOW)
    return (low | high) | ((low & high) << np.uint64(1))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every fingerprint once for each cell it stands in: (cell, band, bits)."""
    for batch in batches:
        bits = batch.column("bits").to_numpy(zero_copy_only=False).view(np.uint64)
        count = unary(bits)
        cells, bands, owners = [], [], []
        for band, (first, segments, radius) in enumerate(BANDS):
            mask = np.uint64(((1 << (2 * segments)) - 1) << (2 * first))
            home = count & mask
            cells.append(home), bands.append(np.full(len(bits), band)), owners.append(bits)
            for segment in range(first, first + segments) if radius else ():
                digit = (home >> np.uint64(2 * segment)) & np.uint64(3)
                up = digit < 3
                step = np.where(digit[up] == 0, 1, 2).astype(np.uint64) << np.uint64(2 * segment)
                cells.append(home[up] | step), bands.append(np.full(int(up.sum()), band)), owners.append(bits[up])
        if len(bits):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(cells).view(np.int64)), pa.array(np.concatenate(bands), pa.int32()),
                pa.array(np.concatenate(owners).view(np.int64))], names=["cell", "band", "bits"])


def linked(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Pairs within ``distance``: the bound by counts first, then the bits."""
    near = np.bitwise_count(unary(a) ^ unary(b)) <= distance
    near[near] = np.bitwise_count(np.broadcast_to(a, near.shape)[near] ^ np.broadcast_to(b, near.shape)[near]) <= distance
    return near


def forest(bits: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among distinct ``bits``: fewer than there are bits."""
    rest, out = np.unique(bits), []
    while len(rest) > 1:
        open_, rest = [rest[0]], rest[1:]
        while open_ and len(rest):
            one = open_.pop()
            near = linked(one, rest, distance)
            if near.any():
                found = rest[near]
                out += [(int(one), int(f)) for f in found.view(np.int64).view(np.uint64)]
                open_ += list(found)
                rest = rest[~near]
    return out


def _links(distance: int):
    """Links within cells; rows come sorted by cell, band and block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "band", "part", "bits")]
            if held is not None:
                rows = [np.concatenate(p) for p in zip(held, rows)]
            key = list(zip(*(r[-1:] for r in rows[:3])))[0] if len(rows[0]) else None
            last = np.ones(len(rows[0]), bool)
            for r, k in zip(rows[:3], key or ()):
                last &= r == k
            held = [r[last] for r in rows]
            yield from _link_batches([r[~last] for r in rows], distance)
        if held is not None:
            yield from _link_batches(held, distance)

    return run


def _link_batches(rows: list[np.ndarray], distance: int) -> Iterator[pa.RecordBatch]:
    cell, band, part, bits = rows
    bits = bits.view(np.uint64)
    n = len(bits)
    if n < 2:
        return
    fresh = np.ones(n, bool)
    fresh[1:] = (cell[1:] != cell[:-1]) | (band[1:] != band[:-1]) | (part[1:] != part[:-1])
    group = np.cumsum(fresh) - 1
    starts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(starts, n))
    left, right = [], []
    small = sizes[group] <= SMALL_CELL
    for step in range(1, min(SMALL_CELL, n)):  # all pairs of small cells, by one comparison for each offset
        at = np.flatnonzero(small[:-step] & (group[:-step] == group[step:]))
        if not len(at):
            break
        at = at[linked(bits[at], bits[at + step], distance)]
        left.append(bits[at]), right.append(bits[at + step])
    for g in np.flatnonzero(sizes > SMALL_CELL):
        pairs = forest(bits[starts[g] : starts[g] + sizes[g]], distance)
        left.append(np.array([p[0] for p in pairs], np.uint64)), right.append(np.array([p[1] for p in pairs], np.uint64))
    if left:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (left, right)], names=["u", "v"])


def fingerprint_links(distinct: DataFrame, distance: int = DISTANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links ``(u, v)`` that connect all of ``distinct (bits)`` within ``distance`` bits."""
    if distance > DISTANCE:
        raise ValueError("the bands find distances up to 4")
    cells = distinct.mapInArrow(_cells, "cell bigint, band int, bits bigint")
    crowded = cells.groupBy("cell", "band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_rows)
    blocks = F.ceil(F.col("n") / cell_rows).cast("int")
    own = F.pmod(F.xxhash64("bits"), blocks).cast("int")
    # a block meets itself and every other one: part (i, j) holds the blocks i <= j
    parts = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.least(j, own) * blocks + F.greatest(j, own))
    placed = cells.join(crowded, ["cell", "band"], "left").select(
        "cell", "band", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(parts)).alias("part"), "bits")
    return (
        placed.repartition("cell", "band", "part").sortWithinPartitions("cell", "band", "part", "bits")
        .mapInArrow(_links(distance), "u bigint, v bigint").distinct())


def simhash_groups(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of ``docs (doc_id, text)``.

    Texts link where their fingerprints differ in ``distance`` bits or fewer; ``component_id``
    is the smallest ``doc_id`` that links reach. A null, empty or blank text has fingerprint
    zero and links like any other. Repeated rows give one result each; a null ``doc_id`` is
    kept and is never a component's id unless all of its members are null; other columns are
    ignored; an empty table gives no rows.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    prints = keep(docs.select("doc_id", "text").mapInArrow(_fingerprints(words), f"doc_id {id_type}, bits bigint"), "simhash")
    groups = prints.groupBy("bits").agg(F.min("doc_id").alias("first"))
    roots = components(fingerprint_links(groups.select("bits"), distance, cell_rows))
    joined = groups.join(roots.withColumnRenamed("u", "bits"), "bits", "left").withColumn("root", F.coalesce("root", "bits"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    members = joined.select("bits", "root").join(least, "root").select("bits", "component_id")
    shown = F.lpad(F.lower(F.hex("bits")), 16, "0")
    return prints.join(members, "bits").select("doc_id", shown.alias("fingerprint"), "component_id")
