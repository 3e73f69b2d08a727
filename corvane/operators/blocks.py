"""Scoring blocks of documents against a small query set inside tasks.

Documents are read in place; a task scores block after block as one matrix product and
keeps only its best ``k`` rows for each query. What Spark shuffles is ``k`` rows per
query and task, never the documents and never one row per pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.operators.relational import top_k

BLOCK_CELLS = 4_000_000
OUT_ROWS = 50_000
DIGITS = 9


class Best:
    """Best ``k`` (score descending, id ascending) of each query seen so far."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.scores, self.ids = k, np.zeros((queries, 0)), None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` is queries by documents, ``ids`` the documents of the block."""
        by_id = np.argsort(ids, kind="stable")
        scores, ids = scores[:, by_id], ids[by_id]
        pick = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
        fresh_scores, fresh_ids = np.take_along_axis(scores, pick, axis=1), ids[pick]
        if self.ids is None:
            self.scores, self.ids = fresh_scores, fresh_ids
            return
        all_scores = np.concatenate([self.scores, fresh_scores], axis=1)
        all_ids = np.concatenate([self.ids, fresh_ids], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=-1)[:, : self.k]
        self.scores, self.ids = np.take_along_axis(all_scores, order, axis=1), np.take_along_axis(all_ids, order, axis=1)

    def rows(self, accept: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query positions, ids and scores of the accepted rows."""
        if self.ids is None:
            return np.zeros(0, int), np.zeros(0, object), np.zeros(0)
        q, c = np.nonzero(accept(self.scores))
        return q, self.ids[q, c], self.scores[q, c]


def _groups(batch: pa.RecordBatch, by: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Row positions of each combination of the group columns."""
    if not by:
        yield (), np.arange(batch.num_rows)
        return
    keys = list(zip(*[batch.column(b).to_pylist() for b in by]))
    places: dict[tuple, list[int]] = {}
    for i, key in enumerate(keys):
        places.setdefault(key, []).append(i)
    for key, rows in places.items():
        yield key, np.array(rows)


def block_top_k(
    rows: DataFrame, qids: list, qid_type: T.DataType, by: list[str], k: int, score, accept, block_rows: int
) -> DataFrame:
    """``(qid, by..., id, score, rank)`` of the best ``k`` rows of each query and group.

    ``score(batch, positions, key)`` gives queries by documents; ``accept`` masks the scores
    that count. ``rows`` has ``id``, the ``by`` columns and what ``score`` reads.
    """
    fields = [T.StructField("qid", qid_type), *[T.StructField(b, rows.schema[b].dataType) for b in by],
              T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields)
    kinds = [f.type for f in to_arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, Best] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, block_rows):
                batch = whole.slice(start, block_rows)
                ids = np.array(batch.column("id").to_pylist())
                for key, positions in _groups(batch, by):
                    keep = best.setdefault(key, Best(len(qids), k))
                    keep.add(np.round(score(batch, positions, key), DIGITS), ids[positions])
        for key, keep in best.items():
            q, found, scores = keep.rows(accept)
            if len(q):
                values = [[qids[i] for i in q], *[[value] * len(q) for value in key], found.tolist(), scores.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, kind) for v, kind in zip(values, kinds)], names=[f.name for f in fields])

    return top_k(rows.mapInArrow(run, schema), ["qid", *by], [F.col("score").desc(), F.col("id")], k)


def block_scores(rows: DataFrame, qids: list, qid_type: T.DataType, carry: list[str], score, block_rows: int) -> DataFrame:
    """``(qid, carry..., score)`` of every query and row with a score above zero, in the blocks they are read in.

    ``score(batch)`` gives queries by documents. ``rows`` has the columns ``carry`` and what ``score`` reads.
    """
    schema = T.StructType([T.StructField("qid", qid_type), *[T.StructField(c, rows.schema[c].dataType) for c in carry], T.StructField("score", T.DoubleType())])
    kinds = [f.type for f in to_arrow_schema(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(qids, kinds[0])
        for whole in batches:
            for start in range(0, whole.num_rows, block_rows):
                batch = whole.slice(start, block_rows)
                scores = score(batch)
                q, c = np.nonzero(scores > 0)
                for at in range(0, len(q), OUT_ROWS):
                    own, found = q[at : at + OUT_ROWS], c[at : at + OUT_ROWS]
                    values = [names.take(pa.array(own)), *[batch.column(n).take(pa.array(found)) for n in carry], pa.array(scores[own, found])]
                    yield pa.RecordBatch.from_arrays([v.cast(kind) for v, kind in zip(values, kinds)], names=schema.names)

    return rows.mapInArrow(run, schema)


def token_weights(batch: pa.RecordBatch, positions: np.ndarray, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Term counts (documents by vocabulary) and token totals of the rows at ``positions``."""
    tokens = batch.column("tokens").take(pa.array(positions))
    sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    terms = pc.fill_null(pc.index_in(tokens.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
    docs = np.repeat(np.arange(len(positions)), sizes)
    known = terms >= 0
    width = len(vocabulary)
    flat = np.bincount(docs[known] * width + terms[known], minlength=len(positions) * width)
    return flat.reshape(len(positions), width).astype(np.float64), sizes
