"""Language identification by cross-parsing entropy.

A bounded sample of labelled text gives each language a suffix automaton. A text is parsed
greedily against it: the longest match with the sample is one phrase, then the next begins;
a byte the sample lacks is a phrase of its own. The fewer phrases, the smaller the cross
entropy ``phrases * log2(n) / n``; the language that needs the fewest wins.

The automata become one table ``state, byte class -> next state, phrases ended``, so a batch
of texts is parsed in step by array look-ups, every text against every language at once.
Texts are parsed in segments of ``SEGMENT`` bytes, whole, and a segment's end ends a phrase.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import in_fold

WINDOWS = 48  # windows of text sampled for a language
WINDOW_CHARS = 400
MAX_LANGUAGES = 512
SEGMENT = 1024
PASS_CHARS = 8_000_000
RESULTS = ("lang_pred", "score", "cross_entropy")


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; a negative symbol separates texts."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        if s < 0:
            last = 0
            continue
        if s in step[last] and length[step[last][s]] == length[last] + 1:
            last = step[last][s]
            continue
        new = len(step)
        step.append({}), link.append(0), length.append(length[last] + 1)
        at = last
        while at >= 0 and s not in step[at]:
            step[at][s] = new
            at = link[at]
        clone_of = step[at][s] if at >= 0 else -1
        if at >= 0 and length[clone_of] == length[at] + 1:
            link[new] = clone_of
        elif at >= 0:
            clone = len(step)
            step.append(dict(step[clone_of])), link.append(link[clone_of]), length.append(length[at] + 1)
            while at >= 0 and step[at].get(s) == clone_of:
                step[at][s] = clone
                at = link[at]
            link[clone_of] = link[new] = clone
        last = new
    return step


def classes() -> np.ndarray:
    """Bytes with everything of ASCII that is no letter turned into a blank."""
    table = np.arange(256, dtype=np.uint8)
    for b in range(128):
        if not chr(b).isalpha():
            table[b] = 32
    return table


def encoded(text: str) -> bytes:
    return text.lower().encode("utf-8")


class Parser:
    """The automata of all languages as one look-up table."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        self.languages = sorted(samples)
        plain = classes()
        texts = {k: [plain[np.frombuffer(encoded(t), np.uint8)] for t in samples[k]] for k in self.languages}
        seen = np.zeros(256, bool)
        for parts in texts.values():
            for p in parts:
                seen[p] = True
        # class 0 is every byte no sample has
        self.symbol = np.where(seen, np.cumsum(seen), 0).astype(np.uint8)[plain] if not seen.all() else plain
        self.size = int(seen.sum()) + 1 if not seen.all() else 256
        tables, self.roots, base = [], [], 0
        for k in self.languages:
            flat: list[int] = []
            for t in samples[k]:
                flat += self.symbol[np.frombuffer(encoded(t), np.uint8)].tolist() + [-1]
            step = automaton(flat)
            root = base * self.size
            go = np.full((len(step), self.size), -1, np.int64)
            for state, edges in enumerate(step):
                for s, to in edges.items():
                    go[state, s] = to
            first = np.where(go[0] >= 0, go[0], 0)
            alone = (go[0] < 0).astype(np.int64)  # a byte the sample lacks
            fresh = (base + first) * self.size * 4 + alone
            onward = (base + np.maximum(go, 0)) * self.size * 4
            ended = np.where(go >= 0, onward, fresh + 1)
            ended[0] = fresh
            tables.append(ended.ravel()), self.roots.append(root)
            base += len(step)
        self.table = np.concatenate(tables).astype(np.int32 if base * self.size * 4 < 2**31 else np.int64) if tables else np.zeros(0, np.int32)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text for each language."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = self.symbol[np.frombuffer(b"".join(texts), np.uint8)]
        pieces = -(-sizes // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), pieces)
        starts = np.cumsum(sizes) - sizes
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = starts[owner] + nth * SEGMENT
        length = np.minimum(SEGMENT, starts[owner] + sizes[owner] - begin)
        order = np.argsort(-length, kind="stable")
        begin, length, owner = begin[order], length[order], owner[order]
        total = np.zeros((len(self.languages), len(texts)), np.int64)
        active = np.searchsorted(-length, -np.arange(SEGMENT), side="left")
        for lang, root in enumerate(self.roots):
            state = np.full(len(begin), root, self.table.dtype)
            count = np.zeros(len(begin), np.int32)
            for i in range(SEGMENT):
                n = active[i]
                if not n:
                    break
                found = self.table[state[:n] + flat[begin[:n] + i]]
                count[:n] += found & 3
                state[:n] = found >> 2
            count += state != root
            total[lang] = np.bincount(owner, count, len(texts)).astype(np.int64)
        return total.T

    def judge(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """(language, score, cross entropy in bits per byte) of texts that have a letter."""
        raw = [encoded(t) for t in texts]
        out = []
        for count, n in zip(self.phrases(raw).tolist(), map(len, raw)):
            order = sorted(range(len(count)), key=lambda i: (count[i], i))
            best = count[order[0]]
            second = count[order[1]] if len(order) > 1 else None
            out.append((self.languages[order[0]], 1.0 if second is None else 1.0 - best / second, best * math.log2(n + 1) / n))
        return out


def sample_windows(docs: DataFrame, held_out: int, windows: int, window_chars: int) -> dict[str, list[str]]:
    """At most ``windows`` windows for each language, of as many different texts, chosen by hash, on the driver."""
    spare = F.greatest(F.char_length("text") - window_chars + 1, F.lit(1))
    spot = (F.pmod(F.xxhash64(F.lit("window"), "text"), spare) + 1).cast("int")
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~in_fold("doc_id", held_out)).select(
        "lang", F.substring(F.col("text"), spot, F.lit(window_chars)).alias("window"), F.xxhash64("text").alias("_h")).filter(F.col("window").rlike(r"\p{L}"))
    # the texts are chosen by hash alone, each once; only their windows are shuffled
    first = Window.partitionBy("lang").orderBy("_h")
    texts = rows.select("lang", "_h").distinct().withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= windows)
    chosen = rows.join(F.broadcast(texts), ["lang", "_h"]).groupBy("lang", "_n").agg(F.min("window").alias("window"))
    found = chosen.orderBy("lang", "_n").limit(MAX_LANGUAGES * windows + 1).collect()
    samples: dict[str, list[str]] = {}
    for r in found:
        samples.setdefault(r["lang"], []).append(r["window"])
    if len(samples) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels: not a table of languages")
    return samples


def fit(docs: DataFrame, held_out: int = 4, windows: int = WINDOWS, window_chars: int = WINDOW_CHARS) -> Parser:
    """Parser learned from ``docs (doc_id, text, lang)`` outside the held-out fold."""
    return Parser(sample_windows(docs, held_out, windows, window_chars))


def _predict(sent, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = sent.value
        for batch in batches:
            texts, letters = batch.column("text").to_pylist(), batch.column("_letter").to_pylist()
            out: list[tuple] = [("und", 0.0, None)] * len(texts)
            run_, size = [], 0
            for i, t in enumerate(texts):
                if letters[i] and parser.languages:
                    run_.append(i)
                    size += len(t)
                if run_ and (size >= PASS_CHARS or i + 1 == len(texts)):
                    for at, found in zip(run_, parser.judge([texts[k] for k in run_])):
                        out[at] = found
                    run_, size = [], 0
            lang, score, bits = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())],
                names=[*names, *RESULTS])

    return run


def identify(docs: DataFrame, parser: Parser, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of every row with ``lang_pred``, ``score`` and ``cross_entropy``.

    ``score`` is 1 less the ratio of phrases of the best language and the next; 1 if there is
    one language only. Equal counts go to the first name, with score 0. A null text or one
    without a letter is ``und`` with score 0, as is every text if no label could be learned
    from. ``carry`` may hold ``text``; columns with the names of the results are replaced.
    """
    names = [c for c in carry if c not in RESULTS]
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letter")
    sent = docs.sparkSession.sparkContext.broadcast(parser)
    rows = docs.select(*names, *([] if "text" in names else ["text"]), letter)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields)
    return rows.mapInArrow(_predict(sent, names), f"{schema}, lang_pred string, score double, cross_entropy double")
