"""SentencePiece encoding by streaming Viterbi, and decoding.

The best segmentation is found from left to right. A piece reaches at most ``longest``
characters, so scores are held for that many positions only. Back pointers are held from
the last committed boundary on: whenever the paths to all positions that are still open
run through one boundary, everything before it is final and its ids are committed.

Where no piece of the vocabulary crosses a kind of boundary (before a word mark, around a
character that stands in no longer piece), all paths converge there by themselves; segments
between such boundaries repeat and are remembered, a bounded number at a time.

Scores are those of a unigram model. A model of merges has ranks instead, which are turned
into log probabilities by Zipf's law; its ids are then the most probable segmentation into
its pieces, not the outcome of its merges. A character without a piece becomes its bytes,
at the cost of one unknown piece, or ``<unk>`` if the model has no byte pieces.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
REMEMBERED = 250_000
UNKNOWN_PENALTY = 10.0


class Vocabulary:
    """Pieces, scores and byte pieces of a model file's bytes."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = sp.vocab_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        scores = [sp.get_score(i) for i in plain]
        if scores and all(s == -r for r, s in enumerate(scores)):
            total = sum(1.0 / (r + 1) for r in range(len(scores)))
            scores = [-math.log((r + 1) * total) for r in range(len(scores))]
        self._index({sp.id_to_piece(i): (i, s) for i, s in zip(plain, scores)}, {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}, sp.unk_id(), size)

    @classmethod
    def of(cls, pieces: dict[str, tuple[int, float]], bytes_: dict[int, int], unknown: int, size: int) -> Vocabulary:
        self = cls.__new__(cls)
        self._index(pieces, bytes_, unknown, size)
        return self

    def _index(self, pieces: dict, bytes_: dict, unknown: int, size: int) -> None:
        self.pieces, self.bytes, self.unknown = pieces, bytes_ if len(bytes_) == 256 else {}, unknown
        self.longest = max(map(len, pieces), default=1)
        self.unknown_score = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self.text = [b""] * size
        for piece, (i, _) in pieces.items():
            self.text[i] = piece.replace(MARK, " ").encode("utf-8")
        for b, i in self.bytes.items():
            self.text[i] = bytes([b])
        if 0 <= unknown < size:
            self.text[unknown] = " ⁇ ".encode()
        # the same for whole columns of ids; what lies outside is the last, empty one
        self.spellings = pa.array([*self.text, b""], pa.large_binary())
        crossed = any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)
        joined = {c for p in pieces if len(p) > 1 for c in p}
        alone = "".join(c for c in "\n\r\t" if c not in joined)
        # segments no piece reaches beyond; one segment, the whole text, if pieces cross the marks
        self.segments = None if crossed else re.compile(f"[{alone}]|{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" if alone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    @cached_property
    def trie(self) -> dict:
        """For each character the nodes that follow, under "" the score of the piece that ends here; only encoding asks for it."""
        root: dict = {}
        for piece, (_, score) in self.pieces.items():
            node = root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score
        return root

    def spelled(self, char: str) -> list[int]:
        """Ids of a character that no piece covers; of a literal word mark, which is not a blank."""
        return [self.bytes[b] for b in char.encode("utf-8")] if self.bytes else [self.unknown]


class StreamingViterbi:
    """Feed characters, take committed ids; ``finish`` commits the rest."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.base = 0  # position of the last committed boundary
        self.text = ""  # characters from there on
        self.best: list[float] = [0.0]
        self.back: list[int] = [0]  # where the best piece that ends here begins
        self.done = 0  # positions, from base, whose pieces are entered
        self.check = 4 * vocabulary.longest

    def feed(self, text: str) -> list[int]:
        """Take in characters; positions whose pieces may reach past the end wait."""
        self.text += text
        more = len(self.text) + 1 - len(self.best)
        self.best += [-math.inf] * more
        self.back += [0] * more
        return self._advance(len(self.text) - self.v.longest + 1)

    def finish(self) -> list[int]:
        return self._advance(len(self.text)) + self._emit(len(self.text))

    def _advance(self, end: int) -> list[int]:
        """Enter the pieces of all positions before ``end``; commit what has converged on the way."""
        out: list[int] = []
        while self.done < end:
            stop = min(end, self.check)
            self._enter(stop)
            if stop < end or self.done >= self.check:
                before = self.done
                out += self._commit()
                end -= before - self.done
        return out

    def _enter(self, stop: int) -> None:
        trie, longest, text, best, back, unknown = self.v.trie, self.v.longest, self.text, self.best, self.back, self.v.unknown_score
        for i in range(self.done, stop):
            score, node, one = best[i], trie, False
            j = i
            for c in text[i : i + longest]:
                node = node.get(c)
                if node is None:
                    break
                j += 1
                own = node.get("")
                if own is not None:
                    total = score + own
                    if j == i + 1:
                        one = True
                    if total > best[j]:
                        best[j], back[j] = total, i
            if not one and score + unknown > best[i + 1]:
                best[i + 1], back[i + 1] = score + unknown, i
        self.done = max(self.done, stop)

    def _commit(self) -> list[int]:
        """Commit up to the boundary that all open paths run through."""
        open_ = {j for j in range(self.done, min(self.done + self.v.longest, len(self.best))) if self.best[j] > -math.inf}
        while len(open_) > 1:
            last = max(open_)
            open_.discard(last)
            open_.add(self.back[last])
        out = self._emit(open_.pop())
        # paths that have not met yet are looked at again when their length has doubled
        self.check = max(4 * self.v.longest, 2 * self.done)
        return out

    def _emit(self, end: int) -> list[int]:
        cuts = []
        at = end
        while at > 0:
            cuts.append(at)
            at = self.back[at]
        out: list[int] = []
        for stop in reversed(cuts):
            piece = self.text[at:stop]
            found = self.v.pieces.get(piece)
            out += [found[0]] if found else self.v.spelled(piece)
            at = stop
        shift = self.best[end] if end < len(self.best) else 0.0
        self.text, self.best, self.back = self.text[end:], [s - shift for s in self.best[end:]], [max(b - end, 0) for b in self.back[end:]]
        self.done -= end
        self.base += end
        return out


class Encoder:
    """Ids of texts; remembers the ids of segments."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def segment(self, text: str) -> bytes:
        found = self.known.get(text)
        if found is not None:
            return found
        found = self.older.get(text)
        if found is None:
            viterbi = StreamingViterbi(self.v)
            ids: list[int] = []
            for at in range(0, len(text), 65536):
                ids += viterbi.feed(text[at : at + 65536])
            ids += viterbi.finish()
            found = array("i", ids).tobytes()
        if len(self.known) >= REMEMBERED:  # the generation before last is forgotten
            self.known, self.older = {}, self.known
        if len(text) <= 256:
            self.known[text] = found
        return found

    def ids(self, text: str) -> bytes:
        """32-bit ids; a blank goes before the text, as the models were made."""
        if not text:
            return b""
        # a literal word mark would come back as a blank: it is spelled in bytes
        runs = text.split(MARK)
        spelled = np.array(self.v.spelled(MARK), "<i4").tobytes()
        return spelled.join(self._run(("" if i else MARK) + run.replace(" ", MARK)) for i, run in enumerate(runs))

    def _run(self, text: str) -> bytes:
        if not text:
            return b""
        if self.v.segments is None:
            return self.segment(text)
        parts = self.v.segments.findall(text)
        found = list(map(self.known.get, parts))
        if None in found:
            found = [self.segment(part) if ids is None else ids for part, ids in zip(parts, found)]
        return b"".join(found)


def _encode(sent, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(sent.value))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            start = 0
            while start < len(texts):  # lists of bounded size
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size < 4_000_000):
                    size += len(texts[stop] or "")
                    stop += 1
                found = [None if t is None else encoder.ids(t) for t in texts[start:stop]]
                sizes = np.fromiter((len(f or b"") // 4 for f in found), np.int64, len(found))
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(f or b"" for f in found), "<i4"))
                ids = pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([f is None for f in found]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, stop - start) for c in names), ids], names=[*names, "ids"])
                start = stop

    return run


def decoded(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """Text of ids; ids outside the vocabulary and control pieces are nothing, bad bytes U+FFFD."""
    return decoded_all(vocabulary, ids, np.array([0, len(ids)]))[0]


def decoded_all(vocabulary: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """The texts of the lists of ids that lie between ``bounds``."""
    size = len(vocabulary.text)
    spelled = vocabulary.spellings.take(pa.array(np.where((ids >= 0) & (ids < size), ids, size)))
    whole = memoryview(spelled.buffers()[2] or b"")
    ends = np.frombuffer(spelled.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    at = ends[bounds].tolist()
    return [str(whole[a + 1 if a < b and whole[a] == 0x20 else a : b], "utf-8", "replace") for a, b in zip(at[:-1], at[1:])]


def _decode(sent, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(sent.value)
        for batch in batches:
            column = batch.column("ids")
            ends = column.offsets.to_numpy().astype(np.int64)
            start = 0
            while start < batch.num_rows:  # texts of bounded size at a time
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + 1_000_000, "right")) - 1)
                first, last = int(ends[start]), int(ends[stop])
                ids = column.values.slice(first, last - first).to_numpy(zero_copy_only=False)
                texts = pa.array(decoded_all(vocabulary, ids, ends[start : stop + 1] - first), pa.string())
                valid = column.slice(start, stop - start).is_valid()
                texts = pc.if_else(valid, texts, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, stop - start) for c in names), texts], names=[*names, "decoded"])
                start = stop

    return run


def _mapped(df: DataFrame, make, model: str, names: list[str], source: str, result: str) -> DataFrame:
    with open(model, "rb") as f:  # on the driver only
        sent = df.sparkSession.sparkContext.broadcast(f.read())
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema.fields]
    columns = names if source in names else [*names, source]
    return df.select(*columns).mapInArrow(make(sent, names), ", ".join([*fields, result]))


def encode(docs: DataFrame, carry: list[str], model: str = MODEL) -> DataFrame:
    """The columns ``carry`` with ``ids array<int>`` of ``text``.

    A null text has null ids, an empty one none. Every other text comes back from ``decode``
    as it was, white space and word marks included, if the model has byte pieces. Repeated rows
    give one result each; a column named ``ids`` is replaced; an empty table gives no rows.
    """
    return _mapped(docs, _encode, model, [c for c in carry if c != "ids"], "text", "ids array<int>")


def decode(rows: DataFrame, carry: list[str], model: str = MODEL) -> DataFrame:
    """The columns ``carry`` with ``decoded``, the text of ``ids``; null ids give null."""
    return _mapped(rows, _decode, model, [c for c in carry if c != "decoded"], "ids", "decoded string")
