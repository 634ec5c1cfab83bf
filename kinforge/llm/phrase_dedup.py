"""Operator 2: substring dedup with repeated-phrase automata.

Removes each word covered by a window of `length` words whose word sequence also starts earlier (smaller doc_id, or the same document, earlier).
The regions of texts that may repeat (see regions) are streamed to shards by anchor. In each shard the recurring passages are confirmed word
by word, compiled into an Aho-Corasick automaton over word numbers, and all the shard's regions are run through it: every occurrence of every
passage is found, the earliest is kept, and the others' words go.

Defined results: null text has no words; a text of fewer words than `length` keeps all; rows equal in doc_id and text are the same document and
neither is earlier; rows that share a doc_id with different texts are ordered by their texts' hashes; a null doc_id is smaller than any other;
other columns of docs are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import regions as R
from .common import keyed_text, row_texts, shown_id
from .textscan import SPACE, word_hashes, words

LENGTH, GRAM = 20, 4
SHARD_BYTES = 1_500_000


def later(bodies: list[bytes], windows: list[int], places: list[tuple], length: int) -> list[np.ndarray]:
    """For each body (at places: sortable, the first window's), which windows' word sequences also start at a smaller place."""
    import ahocorasick

    numbers: dict[bytes, int] = {}
    texts = [tuple(numbers.setdefault(w, len(numbers)) for w in body.split()) for body in bodies]
    # Confirm: the word sequences that occur in more than one region.
    seen: dict[tuple, bool] = {}
    for text, n in zip(texts, windows, strict=True):
        for w in range(n):
            passage = text[w : w + length]
            seen[passage] = passage in seen
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    confirmed = [p for p, again in seen.items() if again]
    marks = [np.zeros(n, bool) for n in windows]
    if not confirmed:
        return marks
    for k, passage in enumerate(confirmed):
        automaton.add_word(passage, k)
    automaton.make_automaton()
    earliest: list = [None] * len(confirmed)
    found = []
    for i, (text, place) in enumerate(zip(texts, places, strict=True)):
        for end, k in automaton.iter(text):
            w = end - length + 1
            at = (*place[:-1], place[-1] + w)
            found.append((i, w, k, at))
            if earliest[k] is None or at < earliest[k]:
                earliest[k] = at
    for i, w, k, at in found:
        if w < windows[i] and earliest[k] < at:
            marks[i][w] = True
    return marks


def joined_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words joined by one space each, as bytes and offsets."""
    texts = [b" ".join(t.split()) for t in row_texts(column)]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def scan(length: int, gram: int) -> R.Scan:
    def units(data: np.ndarray, offsets: np.ndarray):
        start, end, bounds = words(data, offsets, SPACE)
        return bounds, start, end, lambda a, b: word_hashes(data, start[a:b], end[a:b])

    return R.Scan(units, length, gram, joined_words)


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_classes: int = R.HOT_CLASSES, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) of docs (doc_id, text)."""
    texts = keyed_text(docs)

    def decide(rows: list[dict]) -> list[np.ndarray]:
        return later([r["body"] for r in rows], [r["n"] for r in rows], [(r["doc_id"], r["salt"], r["start"]) for r in rows], length)

    not_first = lambda: F.struct("doc_id", "salt", "start") != F.col("first")
    told = R.repeats(texts, scan(length, gram), R.Rules(decide, not_first, SHARD_BYTES, hot_classes))
    extra = ", kept string" if keep_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for text, rs in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ws = text.split()
                kept = ws
                if rs:
                    kept, at = [], 0
                    for a, b in zip(*(x.tolist() for x in R.window_runs(rs, length)), strict=True):
                        kept += ws[at:a]
                        at = b
                    kept += ws[at:]
                joined = b" ".join(kept)
                for values, v in zip(out, (len(ws), len(ws) - len(kept), hashlib.sha256(joined).hexdigest(), joined), strict=True):
                    values.append(v)
            columns = [pa.array(v, t) for v, t in zip(out[:3], (pa.int64(), pa.int64(), pa.string()), strict=True)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns, names = [*columns, pa.array(out[3], pa.binary()).cast(pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    joined = texts.join(told, ["doc_id", "salt"], "left").select(shown_id(), "text", "rs")
    return joined.mapInArrow(run, f"doc_id long, n_words long, n_removed long, kept_sha256 string{extra}")


def op2_phrases(docs: DataFrame) -> DataFrame:
    return deduplicated(docs)
