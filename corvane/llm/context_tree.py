"""Code length of texts under context-tree weighting, beside an add-one word model.

The text of a document is its lower-cased words, each followed by a blank but the last,
and a line feed as end. Each byte is eight binary decisions; every decision has its own
context tree over the preceding bytes. A node's Krichevsky-Trofimov estimate and the
product of its children are mixed half and half, from the deepest contexts to the root.
A context that training never saw ends the path at its parent.

Documents are dealt into blocks of about ``BLOCK_BYTES`` by a hash of the whole row. A
block asks once for each distinct gram (context and byte) and each distinct word it
holds, with its own training counts; what is asked for is dealt out by context, so that
a whole subtree meets in one task. The answers go back to the blocks. Grams and words
travel as packed arrays, so the number of rows is blocks times buckets. Only the nodes
of depth 0 and 1, at most 65,536 by the alphabet, pass through the driver.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import in_fold, keep, text_bytes

DEPTH = 5
BLOCK_BYTES = 16_000_000
CHUNK_BYTES = 1_000_000

_LOG_HALF = math.log(0.5)
_SMALL = np.array([math.lgamma(i / 2) for i in range(1, 129)])


def normalised(text: str | None) -> bytes:
    """Lower-cased words joined by one blank, and the end."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()) + b"\n"


def log_gamma_half(twice: np.ndarray) -> np.ndarray:
    """log Gamma(twice / 2) for whole numbers ``twice`` from 1."""
    z = np.maximum(twice, 100) / 2.0
    far = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3)
    return np.where(twice <= 128, _SMALL[np.minimum(twice, 128) - 1], far)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the KT block probability of so many zeros and ones."""
    return log_gamma_half(2 * zeros + 1) + log_gamma_half(2 * ones + 1) - math.log(math.pi) - log_gamma_half(2 * (zeros + ones) + 2)


def mixed(zeros: np.ndarray, ones: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log probability of nodes, and the weight of their own estimate."""
    own = _LOG_HALF + log_kt(zeros, ones)
    weighted = np.logaddexp(own, _LOG_HALF + children)
    return weighted, np.exp(own - weighted)


def gram_codes(docs: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all grams, nearest context byte first and the byte itself last; grams per document."""
    pad = b"\n" * depth
    flat = np.frombuffer(pad + pad.join(docs), np.uint8).astype(np.uint64)
    codes = flat[depth:].copy()
    for back in range(1, depth + 1):
        codes |= flat[depth - back : len(flat) - back] << np.uint64(8 * (depth + 1 - back))
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    if depth and len(docs) > 1:
        ends = np.cumsum(sizes + depth)[:-1] - depth
        real = np.ones(len(codes), bool)
        real[(ends[:, None] + np.arange(depth)).ravel()] = False
        codes = codes[real]
    return codes, sizes


def chunks(docs: list[bytes], flags: list[bool]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Runs of documents of about ``CHUNK_BYTES``."""
    start = size = 0
    for i, doc in enumerate(docs):
        size += len(doc)
        if size >= CHUNK_BYTES or i + 1 == len(docs):
            yield docs[start : i + 1], np.array(flags[start : i + 1], bool)
            start, size = i + 1, 0


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(counts), len(distinct)).astype(np.int64)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes, which compress well; planes of zeros are left out."""
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8).T
    used = [p for p in range(8) if planes[p].any()]
    return bytes([len(used), *used]) + b"".join(planes[p].tobytes() for p in used)


def unpack(blob: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    for i in range(blob[0]):
        out[:, blob[1 + i]] = np.frombuffer(blob, np.uint8, n, 1 + blob[0] + i * n)
    return out.view("<u8").ravel()


REQUEST = "block int, bucket int, kind string, n int, keys binary, counts binary"


def request_rows(depth: int, buckets: int):
    """Per block: distinct grams and words with their training counts, by bucket."""

    def ask(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        words: Counter = Counter()
        for batch in batches:
            docs = [normalised(t) for t in batch.column("text").to_pylist()]
            for part, train in chunks(docs, batch.column("_train").to_pylist()):
                codes, sizes = gram_codes(part, depth)
                at, distinct = pd.factorize(codes)
                grams.append(np.asarray(distinct, np.uint64))
                counts.append(np.bincount(at[np.repeat(train, sizes)], minlength=len(distinct)))
                if len(grams) >= 16:
                    merged = summed(grams, counts)
                    grams, counts = [merged[0]], [merged[1]]
                learned = b" ".join(d for d, t in zip(part, train) if t).split()
                words.update(learned)
                words[b"\n"] += int(train.sum())
                words.update(dict.fromkeys(b" ".join(d for d, t in zip(part, train) if not t).split(), 0))
        out: list[tuple] = []
        codes, n = summed(grams, counts)
        place = ((codes >> np.uint64(8 * max(depth - 1, 0))) * np.uint64(40503) & np.uint64(0xFFFF)) % np.uint64(buckets)
        order = np.argsort(place, kind="stable")
        codes, n, place = codes[order], n[order], place[order]
        cuts = np.searchsorted(place, np.arange(buckets + 1).astype(np.uint64))
        for b in range(buckets):
            lo, hi = cuts[b], cuts[b + 1]
            if hi > lo:
                out.append((b, "g", hi - lo, pack(codes[lo:hi]), pack(n[lo:hi])))
        dealt: dict[int, list[bytes]] = {}
        for word in words:
            dealt.setdefault(zlib.crc32(word) % buckets, []).append(word)
        for b, own in dealt.items():
            out.append((b, "w", len(own), b" ".join(own), pack(np.array([words[w] for w in own]))))
        yield request_batch(key[0].as_py(), out)

    return ask


def request_batch(block: int, rows: list[tuple]) -> pa.RecordBatch:
    bucket, kind, n, keys, counts = (list(c) for c in zip(*rows)) if rows else ([],) * 5
    return pa.RecordBatch.from_arrays([
        pa.array([block] * len(rows), pa.int32()), pa.array(bucket, pa.int32()), pa.array(kind, pa.string()), pa.array(n, pa.int32()),
        pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["block", "bucket", "kind", "n", "keys", "counts"])


class Nodes:
    """Binary nodes of one context depth and bit, over the sorted grams of that depth."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, bit: int) -> None:
        byte = (keys & np.uint64(255)).astype(np.int64)
        one = (byte >> (7 - bit)) & 1
        fresh = np.ones(len(keys), bool)
        fresh[1:] = (keys[1:] >> np.uint64(8 - bit)) != (keys[:-1] >> np.uint64(8 - bit))
        self.first = np.flatnonzero(fresh)
        self.at = np.cumsum(fresh) - 1
        self.total = np.add.reduceat(counts, self.first)
        self.ones = np.add.reduceat(counts * one, self.first)
        self.zeros = self.total - self.ones

    def estimate(self, node: np.ndarray, one: np.ndarray) -> np.ndarray:
        """KT chance of the bit ``one`` at each ``node``."""
        return (np.where(one, self.ones[node], self.zeros[node]) + 0.5) / (self.total[node] + 1.0)


class Levels:
    """Grams of one bucket by context depth, from ``depth`` up to ``top``."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int, top: int) -> None:
        self.byte = (codes & np.uint64(255)).astype(np.int64)
        self.keys, self.counts, self.up = [codes], [counts], []
        for _ in range(depth - top):
            # the byte farthest back goes
            shorter = ((self.keys[-1] >> np.uint64(16)) << np.uint64(8)) | (self.keys[-1] & np.uint64(255))
            keys, above = np.unique(shorter, return_inverse=True)
            self.counts.append(np.bincount(above, self.counts[-1], len(keys)).astype(np.int64))
            self.keys.append(keys)
            self.up.append(above)

    def weigh(self, bit: int) -> tuple[list[Nodes], list[np.ndarray | None], np.ndarray]:
        """Nodes from the deepest on, the weights of their own estimates, log weights at the top."""
        nodes = [Nodes(k, c, bit) for k, c in zip(self.keys, self.counts)]
        weight, own = log_kt(nodes[0].zeros, nodes[0].ones), [None]
        for below, node, up in zip(nodes, nodes[1:], self.up):
            children = np.bincount(node.at[up[below.first]], weight, len(node.total))
            weight, share = mixed(node.zeros, node.ones, children)
            own.append(share)
        return nodes, own, weight

    def chance(self, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """For each gram: chance of its bit seen from the top, and whether training saw the top node."""
        nodes, own, _ = self.weigh(bit)
        one = ((self.byte >> (7 - bit)) & 1).astype(bool)
        at, index = nodes[0].at, None
        chance, seen = nodes[0].estimate(at, one), nodes[0].total[at] > 0
        for node, share, up in zip(nodes[1:], own[1:], self.up):
            index = up if index is None else up[index]
            at = node.at[index]
            estimate = node.estimate(at, one)
            chance = np.where(seen, share[at] * estimate + (1 - share[at]) * chance, estimate)
            seen = node.total[at] > 0
        return chance, seen


def top_sums(depth: int):
    """Per bucket: what nodes of depth 1 need of it, by (byte before, binary node), and the word totals."""

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        kinds, n, keys, counts = (table.column(c).to_pylist() for c in ("kind", "n", "keys", "counts"))
        rows: list[tuple] = []
        grams = [i for i, k in enumerate(kinds) if k == "g"]
        if grams:
            codes, total = summed([unpack(keys[i], n[i]) for i in grams], [unpack(counts[i], n[i]) for i in grams])
            known = total > 0
            top = min(2, depth)
            level = Levels(codes[known], total[known], depth, top)
            for bit in range(8 if known.any() else 0):
                nodes, _, weight = level.weigh(bit)
                node, keys_ = nodes[-1], level.keys[-1][nodes[-1].first]
                prefix = (np.uint64(1) << np.uint64(bit)) | ((keys_ & np.uint64(255)) >> np.uint64(8 - bit))
                place = ((keys_ >> np.uint64(8 * top)) << np.uint64(8) | prefix).astype(np.int64)
                place, index = np.unique(place, return_inverse=True)
                sums = [np.bincount(index, x, len(place)) for x in (node.zeros, node.ones, weight)]
                rows += zip(place.tolist(), sums[0].astype(np.int64).tolist(), sums[1].astype(np.int64).tolist(), sums[2].tolist())
        total = Counter()
        for i, k in enumerate(kinds):
            if k == "w":
                for word, c in zip(split_words(keys[i], n[i]), unpack(counts[i], n[i]).tolist()):
                    if c:
                        total[word] += c
        if total:
            rows.append((-1, sum(total.values()), len(total), 0.0))
        node, zeros, ones, below = (list(c) for c in zip(*rows)) if rows else ([],) * 4
        return pa.table({"node": pa.array(node, pa.int32()), "zeros": pa.array(zeros, pa.int64()), "ones": pa.array(ones, pa.int64()), "below": pa.array(below, pa.float64())})

    return fold


def split_words(blob: bytes, n: int) -> list[bytes]:
    return blob.split(b" ") if n else []


def roots(rows: list, depth: int) -> dict:
    """Depth 0 and 1 from the summed rows: counts, and weights of the own estimates."""
    zeros, ones, below = (np.zeros(65536, t) for t in (np.int64, np.int64, np.float64))
    train_tokens = distinct = 0
    for r in rows:
        if r["node"] < 0:
            train_tokens, distinct = r["zeros"], r["ones"]
        else:
            zeros[r["node"]], ones[r["node"]], below[r["node"]] = r["zeros"], r["ones"], r["below"]
    weight, own = mixed(zeros, ones, below) if depth > 1 else (log_kt(zeros, ones), np.ones(65536))
    zeros0, ones0 = zeros.reshape(256, 256).sum(0), ones.reshape(256, 256).sum(0)
    _, own0 = mixed(zeros0, ones0, weight.reshape(256, 256).sum(0))
    return {"zeros": zeros, "ones": ones, "own": own, "zeros0": zeros0, "ones0": ones0, "own0": own0, "tokens": train_tokens, "distinct": distinct}


def answer_rows(depth: int, sent):
    """Per bucket: log10 chance of every gram asked for and count of every word, back to the blocks."""

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        top = sent.value
        blocks, kinds, n, keys, counts = (table.column(c).to_pylist() for c in ("block", "kind", "n", "keys", "counts"))
        out: list[tuple] = []
        grams = [i for i, k in enumerate(kinds) if k == "g"]
        if grams:
            asked = [unpack(keys[i], n[i]) for i in grams]
            codes, total = summed(asked, [unpack(counts[i], n[i]) for i in grams])
            level, score = Levels(codes, total, depth, min(2, depth)), np.zeros(len(codes))
            before = (codes >> np.uint64(8 * depth)).astype(np.int64)
            for bit in range(8):
                one = (level.byte >> (7 - bit)) & 1
                prefix = (1 << bit) | (level.byte >> (8 - bit))
                node = before * 256 + prefix
                near = top["zeros"][node] + top["ones"][node]
                estimate = (np.where(one == 1, top["ones"][node], top["zeros"][node]) + 0.5) / (near + 1.0)
                if depth > 1:
                    chance, seen = level.chance(bit)
                    estimate = np.where(seen, top["own"][node] * estimate + (1 - top["own"][node]) * chance, estimate)
                far = top["zeros0"][prefix] + top["ones0"][prefix]
                root = (np.where(one == 1, top["ones0"][prefix], top["zeros0"][prefix]) + 0.5) / (far + 1.0)
                score += np.log10(np.where(near > 0, top["own0"][prefix] * root + (1 - top["own0"][prefix]) * estimate, root))
            for i, own in zip(grams, asked):
                out.append((blocks[i], "g", n[i], keys[i], score[np.searchsorted(codes, own)].astype("<f4").tobytes()))
        sums: dict[bytes, int] = {}
        for i, k in enumerate(kinds):
            if k == "w":
                for word, c in zip(split_words(keys[i], n[i]), unpack(counts[i], n[i]).tolist()):
                    sums[word] = sums.get(word, 0) + c
        for i, k in enumerate(kinds):
            if k == "w":
                out.append((blocks[i], "w", n[i], keys[i], pack(np.array([sums[w] for w in split_words(keys[i], n[i])]))))
        block, kind, size, names, values = (list(c) for c in zip(*out)) if out else ([],) * 5
        return pa.table({"block": pa.array(block, pa.int32()), "kind": pa.array(kind, pa.string()), "n": pa.array(size, pa.int32()), "keys": pa.array(names, pa.binary()), "values": pa.array(values, pa.binary())})

    return answer


def score_rows(depth: int, tokens: int, distinct: int):
    """Per block: scores of its documents from the answers."""
    norm = math.log10(tokens + distinct + 1)

    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        kinds, n, keys, values = (answers.column(c).to_pylist() for c in ("kind", "n", "keys", "values"))
        codes = np.concatenate([np.zeros(0, np.uint64)] + [unpack(keys[i], n[i]) for i, k in enumerate(kinds) if k == "g"])
        chance = np.concatenate([np.zeros(0, "<f4")] + [np.frombuffer(values[i], "<f4") for i, k in enumerate(kinds) if k == "g"])
        order = np.argsort(codes)
        codes, chance = codes[order], chance[order].astype(np.float64)
        known: dict[bytes, int] = {}
        for i, k in enumerate(kinds):
            if k == "w":
                known.update(zip(split_words(keys[i], n[i]), unpack(values[i], n[i]).tolist()))
        n_tokens, n_known, base, model = [], [], [], []
        texts = [normalised(t) for t in docs.column("text").to_pylist()]
        for part, _ in chunks(texts, [False] * len(texts)):
            grams, sizes = gram_codes(part, depth)
            at, found = pd.factorize(grams)
            each = chance[np.searchsorted(codes, np.asarray(found, np.uint64))][at]
            model.append(np.add.reduceat(each, np.cumsum(sizes) - sizes))
            split = [d.split() for d in part]
            size = np.fromiter(map(len, split), np.int64, len(part)) + 1
            flat = np.fromiter((known[w] for words in split for w in (*words, b"\n")), np.int64, int(size.sum()))
            starts = np.cumsum(size) - size
            n_tokens.append(size)
            n_known.append(np.add.reduceat((flat > 0).astype(np.int64), starts))
            base.append(np.add.reduceat(np.log10(flat + 1.0), starts) - size * norm)
        join = lambda xs: np.concatenate(xs) if xs else np.zeros(0)
        return pa.table({
            "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(join(n_tokens), pa.int64()), "n_known": pa.array(join(n_known), pa.int64()),
            "train_tokens": pa.array([tokens] * len(texts), pa.int64()), "base_score": pa.array(join(base), pa.float64()), "score": pa.array(join(model), pa.float64()), "n_bytes": pa.array(list(map(len, texts)), pa.int64())})

    return score


def context_tree_scores(docs: DataFrame, held_out: int = 7, depth: int = DEPTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte)`` of ``docs (doc_id, text)``.

    Rows whose ``crc32(doc_id) mod held_out`` is 2 are not learned from. ``depth`` counts the
    context bytes, 1 to 7. A null text is empty and scores its end alone; a null ``doc_id`` is
    learned from; repeated rows and ids give one result each and are learned from each time;
    other columns are ignored; an empty table gives no rows.
    """
    if not 1 <= depth <= 7:
        raise ValueError("a context has 1 to 7 bytes")
    spark = docs.sparkSession
    blocks = max(1, math.ceil(text_bytes(docs) / block_bytes))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select(
        "doc_id", "text", in_fold("doc_id", held_out).alias("held_out"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("_block"))
    asked = keep(
        dealt.select("_block", "text", (~F.col("held_out")).alias("_train")).groupBy("_block")
        .applyInArrow(request_rows(depth, blocks), REQUEST), "ctw-requests")
    sums = (
        asked.groupBy("bucket").applyInArrow(top_sums(depth), "node int, zeros bigint, ones bigint, below double")
        .groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")))
    top = roots(sums.collect(), depth)  # at most 256 * 256 + 1 rows: previous byte and binary node
    answers = asked.groupBy("bucket").applyInArrow(answer_rows(depth, spark.sparkContext.broadcast(top)), "block int, kind string, n int, keys binary, values binary")
    scored = dealt.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(
        score_rows(depth, top["tokens"], top["distinct"]),
        f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint")
    bits = -F.col("score") * math.log2(10) / F.col("n_bytes")
    return scored.withColumn("bits_per_byte", bits).drop("n_bytes")
